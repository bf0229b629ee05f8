"""Who is who: business and structural keys, aliases, duplicates, repeated deliveries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import written
from .timing import ladder


def first_writer(rows: DataFrame, key: list[str], seq: str, identity: str) -> DataFrame:
    """rows with `root`, the identity of the first row of each key by ingest sequence."""
    firsts = rows.groupBy(*key).agg(F.min_by(identity, F.struct(seq, identity)).alias("root"))
    return rows.join(firsts, key)


def resolve(rows: DataFrame, known: DataFrame, business: list[str], structural: list[str], identity: str = "identity_id") -> DataFrame:
    """Each row's identity by its business key, else by its structural key; disagreement is CONFLICT, neither NEW.

    known holds one row for each business key and each structural key.
    """
    by_business = known.select(*business, F.col(identity).alias("by_business"))
    by_structure = known.groupBy(*structural).agg(F.min(identity).alias("by_structure"))
    both = rows.join(by_business, business, "left").join(by_structure, structural, "left")
    b, s = F.col("by_business"), F.col("by_structure")
    state = ladder((b.isNotNull() & s.isNotNull() & (b != s), "CONFLICT"), (b.isNotNull(), "BUSINESS_KEY"), (s.isNotNull(), "STRUCTURAL_KEY"), otherwise="NEW")
    return both.withColumn("match_state", state).withColumn("resolved", F.when(F.col("match_state") != "CONFLICT", F.coalesce(b, s)))


#: The columns in which an observation must agree with its identity, and the code of each.
COMPARED = {"competition": "COMPETITION_ID_CONFLICT", "kickoff": "KICKOFF_CONFLICT", "zone": "TIMEZONE_CONFLICT", "home": "HOME_AWAY_ORIENTATION_CONFLICT", "away": "HOME_AWAY_ORIENTATION_CONFLICT"}


def first_pairs(pairs: DataFrame) -> DataFrame:
    """Of pairs(b, s, q), q unique, those that taking them in order of q one by one leaves: whose b and s are in no earlier pair that was taken. Written.

    In each round every pair that is the least of both its b and its s is taken, and all that share
    one of them with it go; the order in which a round's pairs are taken does not matter, so the result is
    the sequential one. The rounds are logarithmic for orders without a pattern; a chain in which every
    pair waits for the one before it takes as many rounds as it is long.
    """
    left, taken = written(pairs.select("b", "s", "q"), "pairs"), None
    while True:
        by_b = left.groupBy("b").agg(F.min("q").alias("q"))
        by_s = left.groupBy("s").agg(F.min("q").alias("q"))
        now = written(by_b.join(by_s, "q").select("b", "s", "q"), "taken")
        taken = now if taken is None else taken.unionByName(now)
        left = written(left.join(now.select("b"), "b", "left_anti").join(now.select("s"), "s", "left_anti").select("b", "s", "q"), "pairs")
        if left.isEmpty():
            return written(taken, "taken")


def arrivals(rows: DataFrame, seq: str, business: str, structural: list[str], compared: dict[str, str], delivery: list[str]) -> DataFrame:
    """rows with what happens to each when they arrive in order of seq: `action`, `root` (the seq of the row whose identity it has) and `conflicts`.

    A row with a business key makes a root (ROOT_CREATED) if no root before it has its business key or its
    structural key. Otherwise it belongs to the root of its business key (SOURCE_ALIAS), else to that of its
    structural key (CROSS_SOURCE_ALIAS); if it differs from the root in a compared column it is BLOCKED_CONFLICT
    with the codes of those columns. Without a business key only a structural root will do, and without one the
    row is BLOCKED_MISSING_OFFICIAL_REF. A delivery whose columns equal those of an accepted one is a DUPLICATE_NOOP with
    its root; delivery is to hold the keys and the compared columns. seq is unique; nulls equal nulls, but
    a null business key is none. Rows keep all their columns.
    """
    key = lambda columns: F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    r = rows.withColumns({"_b": F.col(business).cast("string"), "_s": key(structural), "_d": F.sha2(key(delivery), 256), "_is": F.struct(*compared)})
    # of rows with the same two keys only the first can make a root
    roots = first_pairs(r.where("_b is not null").groupBy(F.col("_b").alias("b"), F.col("_s").alias("s")).agg(F.min(seq).alias("q")))
    roots = written(roots.join(r.select(F.col(seq).alias("q"), F.col("_is").alias("was")), "q"), "roots")

    def root_by(name: str, column: str) -> DataFrame:
        return roots.select(F.col(name).alias(column), F.struct("q", "was").alias(f"_root{column}"))

    at = r.join(root_by("b", "_b"), "_b", "left").join(root_by("s", "_s"), "_s", "left")
    here = lambda c: F.when(F.col(f"_root{c}.q") <= F.col(seq), F.col(f"_root{c}"))
    at = at.withColumns({"_own": here("_b"), "_like": here("_s")}).withColumn("_root", F.coalesce("_own", "_like"))
    codes = F.array_distinct(F.array_compact(F.array(*(F.when(~F.col(f"_is.{c}").eqNullSafe(F.col(f"_root.was.{c}")), F.lit(code)) for c, code in compared.items()))))
    at = at.withColumn("conflicts", F.when(F.col("_root").isNotNull(), codes).otherwise(F.array().cast("array<string>")))
    action = ladder(
        (F.col("_root").isNull(), "BLOCKED_MISSING_OFFICIAL_REF"), (F.col("_root.q") == F.col(seq), "ROOT_CREATED"), (F.size("conflicts") > 0, "BLOCKED_CONFLICT"),
        (F.col("_own").isNotNull(), "SOURCE_ALIAS"), otherwise="CROSS_SOURCE_ALIAS",
    )
    at = written(at.select(*rows.columns, "_d", action.alias("action"), F.col("_root.q").alias("root"), "conflicts"), "arrivals")
    accepted = at.where("action not like 'BLOCKED%'").groupBy("_d").agg(F.min(seq).alias("_first"), F.min_by("root", seq).alias("_of"))
    again = F.col("_first") < F.col(seq)
    done = at.join(accepted, "_d", "left")
    return done.select(
        *rows.columns, F.when(again, "DUPLICATE_NOOP").otherwise(F.col("action")).alias("action"), F.when(again, F.col("_of")).otherwise(F.col("root")).alias("root"),
        F.when(again, F.array().cast("array<string>")).otherwise(F.col("conflicts")).alias("conflicts"),
    )


def conflicts(rows: DataFrame, key: list[str], seq: str, columns: list[str]) -> DataFrame:
    """One row for each column in which a row differs from the first writer of its key; nulls equal nulls."""
    roots = rows.groupBy(*key).agg(F.min_by(F.struct(*columns), seq).alias("root"), F.min(seq).alias("root_seq"))
    both = rows.join(roots, key).where(F.col(seq) != F.col("root_seq"))
    differs = F.array_compact(F.array(*(F.when(~F.col(c).eqNullSafe(F.col(f"root.{c}")), F.struct(F.lit(c).alias("field"), F.col(f"root.{c}").cast("string").alias("first"), F.col(c).cast("string").alias("later"))) for c in columns)))
    return both.withColumn("d", F.explode(differs)).select(*key, seq, "d.*")


def duplicates(rows: DataFrame, key: list[str], seq: str, identity: str) -> DataFrame:
    """rows with duplicate_of: the first identity of an equal key, null for the first itself."""
    r = first_writer(rows, key, seq, identity)
    return r.withColumn("duplicate_of", F.when(F.col(identity) != F.col("root"), F.col("root"))).drop("root")


def duplicate_class(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """How two candidates relate, from equality of id, content, source, time and key."""
    same = {k: a[k].eqNullSafe(b[k]) for k in a}
    return ladder(
        (same["content"] & same["source"] & same["time"], "EXACT_REPLAY"), (same["content"] & same["key"], "SAME_CONTENT"),
        (same["key"] & ~same["content"], "CONFLICTING_CONTENT"), otherwise="DISTINCT",
    )


def duplicate_pairs(rows: DataFrame) -> DataFrame:
    """(relation, pairs) over all pairs of rows(content, source, time, key), by duplicate_class; each row is one candidate.

    Equal rows are counted first, then pairs come from the counts of what two rows share, so a hot
    key makes no pairs. Nulls are equal, as in duplicate_class; a relation without pairs has no row.
    """
    n = rows.groupBy("content", "source", "time", "key").agg(F.count("*").alias("n"))

    def pairs(name: str, *same: str) -> DataFrame:
        """The pairs of rows that agree in these columns."""
        m = F.col("m").cast("decimal(38,0)")
        return n.groupBy(*same).agg(F.sum("n").alias("m")).agg(F.coalesce(F.sum((m * (m - 1) / 2).cast("long")), F.lit(0)).alias(name))

    t = pairs("total").crossJoin(pairs("replay", "content", "source", "time")).crossJoin(pairs("both", "content", "key")).crossJoin(pairs("all4", "content", "source", "time", "key")).crossJoin(pairs("one_key", "key"))
    same, conflict = F.col("both") - F.col("all4"), F.col("one_key") - F.col("both")
    found = (("EXACT_REPLAY", F.col("replay")), ("SAME_CONTENT", same), ("CONFLICTING_CONTENT", conflict), ("DISTINCT", F.col("total") - F.col("replay") - same - conflict))
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("relation"), c.alias("pairs")) for k, c in found)))
    return t.select(each.alias("x")).select("x.*").where("pairs > 0")


def deliveries(rows: DataFrame, key: str, content: str, seq: str) -> DataFrame:
    """ACCEPTED for the first delivery of a key, DUPLICATE_NOOP for the same content again, KEY_CONFLICT for other content."""
    firsts = rows.groupBy(key).agg(F.min(seq).alias("first_seq"), F.min_by(content, seq).alias("first_content"))
    state = F.when(F.col(seq) == F.col("first_seq"), "ACCEPTED").when(F.col(content).eqNullSafe(F.col("first_content")), "DUPLICATE_NOOP").otherwise("KEY_CONFLICT")
    return rows.join(firsts, key).withColumn("delivery", state).drop("first_seq", "first_content")


def alias_links(rows: DataFrame, names: DataFrame, alias: str, side: str) -> DataFrame:
    """rows(alias, match, side) against names(match_id, home_key, away_key): the own side's name links, the other's conflicts."""
    own = F.when(F.col(side) == "HOME", F.col("home_key")).otherwise(F.col("away_key"))
    other = F.when(F.col(side) == "HOME", F.col("away_key")).otherwise(F.col("home_key"))
    state = ladder((F.col("home_key").isNull(), "UNKNOWN_MATCH"), (F.col(alias) == own, "LINKED"), (F.col(alias) == other, "ALIAS_SIDE_CONFLICT"), otherwise="NO_MATCH")
    return rows.join(names, "match_id", "left").withColumn("link", state)
