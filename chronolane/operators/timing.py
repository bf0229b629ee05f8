"""What was known when: as-of gates, availability clocks, freshness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.times import col


def ladder(*steps: tuple[Column, str], otherwise: str | None = None) -> Column:
    """The name of the first step that holds, in the order given; unknown counts as not holding."""
    return F.coalesce(*(F.when(c, F.lit(name)) for c, name in steps), F.lit(otherwise))


def failures(*steps: tuple[Column, str]) -> Column:
    """The names of all steps that hold, in the order given."""
    return F.array_compact(F.array(*(F.when(c, F.lit(name)) for c, name in steps)))


def asof_state(availability, cutoff, kickoff) -> Column:
    """availability <= cutoff < kickoff, with the first thing that is wrong."""
    a, c, k = col(availability), col(cutoff), col(kickoff)
    return ladder(
        (a.isNull() | c.isNull() | k.isNull(), "UNKNOWN_TIME"), (c >= k, "INVALID_BOUNDARY"), (a >= k, "POSTMATCH_ONLY"), (a > c, "FUTURE_DATA"), otherwise="AVAILABLE",
    )


def gated_state(gate, availability, cutoff, kickoff) -> Column:
    """As asof_state, but a gate that already refused the row wins."""
    g = col(gate)
    return F.when(g.isNotNull() & (g != "PASSED"), F.concat(F.lit("GATE_"), g)).otherwise(asof_state(availability, cutoff, kickoff))


def first_known(*clocks) -> Column:
    """The first clock that is set, in order of preference."""
    return F.coalesce(*map(col, clocks))


def record_times(source, captured, ingested, availability, cutoff, kickoff) -> Column:
    """What is wrong with a record's clocks, all of it."""
    s, cap, i, a, c, k = map(col, (source, captured, ingested, availability, cutoff, kickoff))
    return failures((cap < s, "CAPTURED_BEFORE_SOURCE"), (i < cap, "INGESTED_BEFORE_CAPTURE"), (a > c, "AFTER_CUTOFF"), (c >= k, "CUTOFF_AFTER_KICKOFF"))


def upload_evidence(uploaded, kickoff) -> Column:
    u, k = col(uploaded), col(kickoff)
    return ladder((u.isNull() | k.isNull(), "REVIEW"), (u >= k, "INELIGIBLE"), otherwise="ELIGIBLE")


def freshness(valid_from, expires, retrieved, as_of, cutoff, kickoff) -> Column:
    """(state, blockers) of a fact at a moment, and at a cutoff if there is one.

    Without a start UNKNOWN_TIME, before it FUTURE_DATA, past its end (not at it) STALE, else CURRENT. A cutoff
    that is not before kickoff makes it BLOCKED; a fact that starts or was fetched after the cutoff, or has no
    start, is FUTURE_DATA there whatever else it is.
    """
    v, e, r, a, c, k = map(col, (valid_from, expires, retrieved, as_of, cutoff, kickoff))
    late = c >= k
    ineligible = c.isNotNull() & (v.isNull() | F.coalesce(v > c, F.lit(False)) | F.coalesce(r > c, F.lit(False)))
    state = ladder((ineligible, "FUTURE_DATA"), (late, "BLOCKED"), (v.isNull(), "UNKNOWN_TIME"), (v > a, "FUTURE_DATA"), (e < a, "STALE"), otherwise="CURRENT")
    found = failures(
        (v.isNull(), "VALID_FROM_UNKNOWN_TIME"), (v > a, "VALID_FROM_AFTER_AS_OF"), ((v <= a) & (e < a), "EXPIRED"),
        (late, "CUTOFF_NOT_BEFORE_KICKOFF"), (ineligible, "NOT_ELIGIBLE_AT_CUTOFF"),
    )
    return F.struct(state.alias("state"), found.alias("blockers"))


def visible(records: DataFrame, cutoff, keys: list[str], when: str = "available_at", domain: str = "domain", revision: str = "revision", tie: str = "record_id") -> DataFrame:
    """The highest revision of each key among rows known at the cutoff; post-match rows are always visible."""
    seen = records.where((F.col(domain) == "POST_MATCH") | (F.col(when) <= cutoff))
    rest = [c for c in records.columns if c not in keys]
    return seen.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(revision, tie)).alias("row")).select(*keys, "row.*")


def snapshot_digest(records: DataFrame, by: list[str], piece: Column, order: list[str], payload: list[str]) -> DataFrame:
    """Number of rows of each group, and sha256 over the digests of its pieces in order, each over its rows' payload in order.

    Rows are gathered by piece (a day, say), never by group, so a large group is no single value.
    """
    text = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in payload))
    digest = lambda rows: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(rows)), lambda r: r.text), "\n"), 256)
    pieces = records.withColumn("piece", piece).groupBy(*by, "piece").agg(F.count("*").alias("n"), digest(F.struct(*order, text.alias("text"))).alias("d"))
    return pieces.groupBy(*by).agg(F.sum("n").alias("n"), F.concat(F.lit("sha256:"), digest(F.struct("piece", F.col("d").alias("text")))).alias("digest"))
