"""How filters interact: what each removes at each step of each order, from counts of subsets' survivors.

A document is five failure flags. The flags are counted by part once; a SQL CUBE over the flags and the
part of those counts has, for each set of filters, a row whose selected flags are all false: the
documents that survive the set. Whatever an order of filters does at a step follows from two subsets,
the filters before the step and those with it, so each step of each order is a join of two subset
rows; no document is read again for any of the orders.

The filters, over whole texts (words are maximal `[^\\x20\\x09-\\x0D]+`, case counts):
A fewer than 100 words; B 100 * distinct words < 80 * words; C 100 * `[A-Z]` > 10 * code points;
D holds one of `#$%&*|`; E the text is that of a smaller doc_id anywhere in the table.

A null text counts as empty; null texts and empty ones are equal texts. A null lang is the part ''.
Repeated rows count each; none of the rows with a text's least doc_id fails E. A row without a doc_id
takes part, but never fails E and has no label; it makes no other row fail. Of repeated labels any
that says 1 counts. Further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written

FILTERS = "ABCDE"
#: Characters that fail D.
SYMBOLS = "#$%&*|"
CUBE = """
select part, chosen, n, good, toxic from (
  select a, b, c, d, e, part, sum(n) as n, sum(good) as good, sum(toxic) as toxic, grouping(part) as whole,
    (1 - grouping(a)) + 2 * (1 - grouping(b)) + 4 * (1 - grouping(c)) + 8 * (1 - grouping(d)) + 16 * (1 - grouping(e)) as chosen
  from {profile} group by cube(a, b, c, d, e, part))
where whole = 0 and not coalesce(a, false) and not coalesce(b, false) and not coalesce(c, false) and not coalesce(d, false) and not coalesce(e, false)"""


def judged(docs: DataFrame) -> DataFrame:
    """doc_id, part, digest of the text and the flags a to d of every row of docs(doc_id, text, lang)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    d = d.withColumn("words", F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != ""))
    d = d.withColumns({"n_words": F.size("words"), "n_distinct": F.size(F.array_distinct("words"))})
    capitals = F.length("text") - F.length(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return d.select(
        "doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), (F.col("n_words") < 100).alias("a"), (100 * F.col("n_distinct") < 80 * F.col("n_words")).alias("b"),
        (100 * capitals.cast("long") > 10 * F.length("text")).alias("c"), F.col("text").rlike(f"[{SYMBOLS}]").alias("d"),
    )


def profiles(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, a to e, and n, good and toxic documents of each combination.

    A text's least doc_id comes from a grouping that combines before its shuffle; rows find it by digest
    and doc_id together, so copies of one text are dealt apart.
    """
    rows = written(judged(docs), "judged")
    least = rows.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("least", F.lit(True))
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    known = rows.where("doc_id is not null").join(least, ["digest", "doc_id"], "left").join(marks, "doc_id", "left")
    known = known.select("part", "a", "b", "c", "d", F.col("least").isNull().alias("e"), *(F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")))
    unknown = rows.where("doc_id is null").select("part", "a", "b", "c", "d", *(F.lit(False).alias(c) for c in ("e", "good", "toxic")))
    return known.unionByName(unknown).groupBy("part", "a", "b", "c", "d", "e").agg(F.count("*").alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic"))


def survivors(profile: DataFrame) -> DataFrame:
    """part, chosen (a bit for each filter), and n, good and toxic documents that no chosen filter fails; zeros included."""
    chosen = profile.sparkSession.sql(CUBE, profile=profile)
    every = profile.select("part").distinct().select("part", F.explode(F.sequence(F.lit(0), F.lit(2 ** len(FILTERS) - 1))).alias("chosen"))
    return every.join(chosen, ["part", "chosen"], "left").fillna(0, ["n", "good", "toxic"])


def steps(spark) -> DataFrame:
    """filter_order, step, bit of its filter, and the chosen sets before and after it: 600 rows."""
    rows = []
    for order in permutations(FILTERS):
        before = 0
        for i, letter in enumerate(order):
            bit = 1 << FILTERS.index(letter)
            rows.append(("".join(order), i + 1, bit, before, before | bit))
            before |= bit
    return spark.createDataFrame(rows, "filter_order string, step int, bit int, before int, after int")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley for all orders of the five filters."""
    left = written(survivors(profiles(docs, labels)), "survivors")  # 32 rows a part
    all_bits = 2 ** len(FILTERS) - 1

    def subset(name: str) -> DataFrame:
        return left.select("part", F.col("chosen").alias(name), *(F.col(c).alias(f"{name}_{c}") for c in ("n", "good", "toxic")))

    pairs = subset("before").join(F.broadcast(steps(docs.sparkSession)), "before").join(subset("after"), ["part", "after"])
    lost = lambda c: F.col(f"before_{c}") - F.col(f"after_{c}")
    moves = pairs.select("part", "filter_order", "step", "bit", F.col("after_n").alias("kept"), lost("n").alias("removed"), lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"))
    # a filter's own failures, those that only it fails, and what it removes over all orders
    bits = F.explode(F.array(*(F.lit(1 << i) for i in range(len(FILTERS))))).alias("bit")
    own = left.where("chosen = 0").select("part", F.col("n").alias("everything"), bits)
    own = own.join(left.select("part", F.col("chosen").alias("bit"), F.col("n").alias("passing")), ["part", "bit"])
    others = left.select("part", (F.lit(all_bits) - F.col("chosen")).alias("bit"), F.col("n").alias("without"))
    own = own.join(others, ["part", "bit"]).join(left.where(F.col("chosen") == all_bits).select("part", F.col("n").alias("clean")), "part")
    own = own.select("part", "bit", (F.col("everything") - F.col("passing")).alias("failing"), (F.col("without") - F.col("clean")).alias("unique_fails"))
    own = own.join(moves.groupBy("part", "bit").agg(F.sum("removed").alias("shapley")), ["part", "bit"])
    return moves.join(own, ["part", "bit"]).select("part", "filter_order", "step", "kept", "removed", (F.col("failing") - F.col("removed")).alias("redundant"), "unique_fails", "good_lost", "toxic_lost", "shapley")


#: Every document is taken through every order.
AUDIT_SQL = """
with t as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as text from documents),
w as (select *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') as words, min(doc_id) over (partition by text) as least from t),
m as (select doc_id, bool_or(quality = 1) as good, bool_or(toxic = 1) as toxic from labels group by doc_id),
f as (select part, {'A': len(words) < 100, 'B': 100 * len(list_distinct(words)) < 80 * len(words), 'C': 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 10 * length(text),
    'D': regexp_matches(text, '[#$%&*|]'), 'E': coalesce(w.doc_id > least, false)} as fails, coalesce(good, false) as good, coalesce(toxic, false) as toxic from w left join m on w.doc_id = m.doc_id),
g as (select part, [k for k in ['A', 'B', 'C', 'D', 'E'] if case k when 'A' then fails.A when 'B' then fails.B when 'C' then fails.C when 'D' then fails.D else fails.E end] as fails, good, toxic from f),
l as (select unnest(['A', 'B', 'C', 'D', 'E']) as x),
o as (select a.x || b.x || c.x || d.x || e.x as filter_order from l a, l b, l c, l d, l e where len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s as (select filter_order, unnest([1, 2, 3, 4, 5]) as step from o),
k as (select *, substr(filter_order, step, 1) as letter, string_split(substr(filter_order, 1, step - 1), '') as before from s),
j as (select part, filter_order, step, letter, good, toxic, list_contains(fails, letter) as fail, list_has_any(fails, before) as gone, len(fails) = 1 as one from g, k),
c as (select part, filter_order, step, letter, count(*) filter (not gone and not fail) as kept, count(*) filter (not gone and fail) as removed, count(*) filter (gone and fail) as redundant,
    count(*) filter (fail and one) as unique_fails, count(*) filter (not gone and fail and good) as good_lost, count(*) filter (not gone and fail and toxic) as toxic_lost from j group by all)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, cast(sum(removed) over (partition by part, letter) as bigint) as shapley from c
"""
