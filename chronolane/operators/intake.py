"""Typed intake of observations about teams and markets, and the samples built from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .timing import ladder


def team_intake(rows: DataFrame, identities: DataFrame, links: DataFrame) -> DataFrame:
    """rows(match_id, side, team_id, cutoff, future) with the first reason to refuse them, or null, and a revision among the accepted.

    identities(match_id, kickoff) has a row for each match, links(match_id, side, linked_team, link_at) any number; the latest link of a side counts.
    """
    latest = links.groupBy("match_id", "side").agg(F.max_by("linked_team", F.struct("link_at", "linked_team")).alias("linked_team"))
    both = rows.join(identities, "match_id", "left").join(latest, ["match_id", "side"], "left")
    why = ladder(
        (F.col("kickoff").isNull(), "IDENTITY_MISSING"), (F.col("linked_team").isNull(), "LINK_MISSING"), (F.col("team_id") != F.col("linked_team"), "TEAM_NOT_ON_SIDE"),
        (F.col("cutoff") >= F.col("kickoff"), "CUTOFF_AFTER_KICKOFF"), (F.col("future"), "FUTURE_DATA"),
    )
    both = both.withColumn("reject", why)
    w = Window.partitionBy("match_id", "side", F.col("reject").isNull()).orderBy("cutoff", "observation_id")
    return both.withColumn("revision", F.when(F.col("reject").isNull(), F.row_number().over(w)))


def external_revisions(rows: DataFrame, key: list[str], order: list[str], identity: str, supersedes: str) -> DataFrame:
    """Revision of each row in its key, and whether the row it supersedes shares the key."""
    own = rows.select(F.col(identity).alias("_sid"), F.struct(*key).alias("_skey"))
    r = rows.withColumn("revision", F.row_number().over(Window.partitionBy(*key).orderBy(*order)))
    r = r.join(own, F.col(supersedes) == F.col("_sid"), "left")
    state = ladder((F.col(supersedes).isNull(), "FIRST"), (F.col("_sid").isNull(), "DANGLING"), (~F.col("_skey").eqNullSafe(F.struct(*key)), "OTHER_KEY"), otherwise="OK")
    return r.withColumn("supersedes_state", state).drop("_sid", "_skey")


def cell_state(available, present, candidates: Column) -> Column:
    """What a printed cell says, from the market's availability, the cell's presence and its candidate readings."""
    n = F.size(candidates)
    return ladder((~available, "MARKET_UNAVAILABLE"), (~present, "NOT_PRESENT"), (n > 1, "CONFLICT"), (n == 0, "UNRESOLVED"), (F.try_element_at(candidates, F.lit(1)).rlike(r"^[0-9]+(\.[0-9]+)?$"), "PARSED"), otherwise="AMBIGUOUS")


def layout_match(spans: Column, profile: Column, tolerance: float) -> Column:
    """Whether two sorted arrays of span positions have equal length and agree within the tolerance."""
    return (F.size(spans) == F.size(profile)) & F.forall(F.zip_with(F.array_sort(spans), F.array_sort(profile), lambda a, b: F.abs(a - b) <= tolerance), lambda ok: F.coalesce(ok, F.lit(False)))


def located(cells: DataFrame, profiles: DataFrame, inventory: DataFrame) -> DataFrame:
    """cells(profile, market, label, width, height) with their place in the picture, by declared layouts.

    profiles(profile, market, left, top, right, bottom, rows, columns) gives each market's region in shares
    of the picture, inventory(market, label, row, column) each cell's place in the region's grid.
    place is LOCATED with the cell's rectangle (6 digits) and its smallest one of whole pixels, or the
    first reason why there is none.
    """
    p = profiles.select("profile", "market", *(F.col(c).alias(f"_{c}") for c in ("left", "top", "right", "bottom", "rows", "columns")))
    i = inventory.select("market", "label", F.col("row").alias("_row"), F.col("column").alias("_column"))
    both = cells.join(p, ["profile", "market"], "left").join(i, ["market", "label"], "left")
    place = ladder((F.col("_left").isNull(), "UNKNOWN_PROFILE"), (F.col("_row").isNull(), "UNKNOWN_CELL"), ((F.col("_row") >= F.col("_rows")) | (F.col("_column") >= F.col("_columns")), "OUTSIDE_GRID"), otherwise="LOCATED")
    wide, high = (F.col("_right") - F.col("_left")) / F.col("_columns"), (F.col("_bottom") - F.col("_top")) / F.col("_rows")
    edges = {"left": F.col("_left") + F.col("_column") * wide, "top": F.col("_top") + F.col("_row") * high, "right": F.col("_left") + (F.col("_column") + 1) * wide, "bottom": F.col("_top") + (F.col("_row") + 1) * high}
    out = both.withColumn("place", place).withColumns({k: F.when(F.col("place") == "LOCATED", F.round(v, 6)) for k, v in edges.items()})
    pixels = {k: (F.floor if k in ("left", "top") else F.ceil)(F.col(k) * F.col("width" if k in ("left", "right") else "height")) for k in edges}
    return out.withColumns({f"{k}_px": v for k, v in pixels.items()}).select(*cells.columns, "place", *edges, *(f"{k}_px" for k in edges))


def bar_spans(lines: DataFrame, image: str, y: str, dark: str, least_share: float = 0.8, least_height: int = 10) -> DataFrame:
    """(image, start, end) of the runs of picture lines that are dark in at least `least_share`, of `least_height` lines or more; end is exclusive.

    Of dark lines alone, y less the rank is constant within a run. A picture has as many lines as it is high.
    """
    bars = lines.where(F.col(dark) >= least_share).select(image, y)
    runs = bars.withColumn("_run", F.col(y) - F.row_number().over(Window.partitionBy(image).orderBy(y)))
    return runs.groupBy(image, "_run").agg(F.min(y).alias("start"), (F.max(y) + 1).alias("end")).where(F.col("end") - F.col("start") >= least_height).select(image, "start", "end")


def minimum_eligibility(samples: DataFrame, values: DataFrame, sample: str, feature: str, state: str, required: list[str]) -> DataFrame:
    """Each sample's missing required features, its availability mask, and whether it may train."""
    need = F.array(*map(F.lit, required))
    got = values.where(F.col(state) == "AVAILABLE").groupBy(sample).agg(F.collect_set(feature).alias("_got"))
    s = samples.join(got, sample, "left").withColumn("_got", F.coalesce("_got", F.array().cast("array<string>")))
    mask = F.transform(need, lambda f: F.when(F.array_contains("_got", f), 1).otherwise(0))
    return s.select(sample, F.array_except(need, F.col("_got")).alias("lacking"), mask.alias("mask"), (F.size(F.array_except(need, F.col("_got"))) == 0).alias("eligible"))


def applied_prefix(history: DataFrame, by: list[str], order: str, step: str, expected: list[str]) -> DataFrame:
    """NONE, PREFIX, COMPLETE or DIVERGED: how an ordered history relates to the expected steps."""
    want = F.array(*map(F.lit, expected))
    g = history.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, step))), lambda s: s[step]).alias("_h"))
    n = F.size("_h")
    state = ladder((F.col("_h") == want, "COMPLETE"), ((n > 0) & (n < len(expected)) & (F.slice(want, F.lit(1), F.greatest(n, F.lit(1))) == F.col("_h")), "PREFIX"), otherwise="DIVERGED")
    return g.select(*by, n.cast("long").alias("steps"), state.alias("applied"))


def tactical(rows: DataFrame, vocabulary: DataFrame, term: str, value: str, state: str, at: str, expires: str, cutoff: Column) -> DataFrame:
    """State of a vocabulary feature: no time BLOCKED, after the cutoff FUTURE_DATA, expired before it (not at it) STALE if it was AVAILABLE; the value then goes. Other rows keep their state."""
    v = vocabulary.select(term, F.lit(True).alias("_known"))
    r = rows.join(v, term, "left")
    gone = ladder((F.col("_known").isNull(), "UNKNOWN_TERM"), (F.col(at).isNull(), "BLOCKED"), (F.col(at) > cutoff, "FUTURE_DATA"), ((F.col(expires) < cutoff) & (F.col(state) == "AVAILABLE"), "STALE"))
    return r.withColumn("_gone", gone).withColumns({"term_state": F.coalesce("_gone", state), value: F.when(F.col("_gone").isNull(), F.col(value))}).drop("_known", "_gone")


def resolution_covers(claims: DataFrame, resolutions: DataFrame, claim: str, evidence: str) -> DataFrame:
    """Whether a resolution lists exactly the evidence of its claim."""
    a = claims.groupBy(claim).agg(F.array_sort(F.collect_set(evidence)).alias("_a"))
    b = resolutions.groupBy(claim).agg(F.array_sort(F.collect_set(evidence)).alias("_b"))
    return a.join(b, claim, "left").select(claim, ladder((F.col("_b").isNull(), "OPEN"), (F.col("_a") == F.col("_b"), "COVERED"), otherwise="INCOMPLETE").alias("resolution"))
