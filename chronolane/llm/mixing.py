"""Mixing sources to target weights with a hierarchical token budget, in DataFrame functions alone.

Leaves are (domain, lang, source). A total of tokens is shared down the tree by weight: at each node
the children get budget * weight, and what a child cannot use (its tokens times the most epochs) goes
to its siblings by their weights; only what all of them cannot use goes back to the parent's
siblings. Each leaf then takes its budget from its epochs: whole epochs first, then a prefix of the
next one. An epoch's order is that of md5(seed:epoch:doc_id), so it does not depend on partitions.

A prefix of a large leaf is found without sorting the leaf: tokens are summed by the leading hex
digits of the order, sums are accumulated, and only the one bucket in which the budget ends is ranked.

Tokens of a text: its blanks plus one; none if it is null or empty. Documents without tokens are
never selected. Null lang or source count as ''. Budgets are rounded down to whole tokens at each
node. Repeated rows take part each. A weight of 0, null or below, or an empty table, selects nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

LEAF = ("domain", "lang", "source")
#: Rows that one bucket of a leaf's order may hold, about.
BUCKET_ROWS = 20_000


def tokens(text: str = "text") -> Column:
    t = F.coalesce(F.col(text), F.lit(""))
    return F.when(t == "", 0).otherwise(F.length(t) - F.length(F.replace(t, F.lit(" "), F.lit(""))) + 1).cast("long")


def order_key(seed: int, epoch: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))


def shared_out(nodes: DataFrame, parent: list[str], name: str, weight: Column) -> DataFrame:
    """nodes(parent.., name, capacity, budget of the parent) with `budget` of each node: the least of its capacity and level * weight.

    With the children in order of capacity / weight, the level is the largest of (budget - capacities
    before) / (weights from here on): it rises while children are full and falls afterwards.
    """
    rated = nodes.withColumn("weight", F.greatest(F.coalesce(weight.cast("double"), F.lit(0.0)), F.lit(0.0))).where("weight > 0")
    by = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    up = by.orderBy(F.col("capacity") / F.col("weight"), name).rowsBetween(Window.unboundedPreceding, -1)
    before, lighter = F.coalesce(F.sum("capacity").over(up), F.lit(0)), F.coalesce(F.sum("weight").over(up), F.lit(0.0))
    levels = rated.withColumn("level", (F.col("above") - before) / (F.sum("weight").over(by) - lighter))
    levels = levels.withColumn("level", F.max("level").over(by))
    return levels.withColumn("budget", F.floor(F.least(F.col("capacity").cast("double"), F.col("level") * F.col("weight"))))


def budgets(leaves: DataFrame, total: Column, weights: dict[str, Column], max_epochs: int) -> DataFrame:
    """(domain, lang, source, size, rows, budget) of leaves(domain, lang, source, size, rows); total is a column of no table."""
    leaves = leaves.withColumn("capacity", F.col("size") * max_epochs)
    # nodes of weight 0 and all below them take no part in any capacity
    for c in LEAF:
        leaves = leaves.where(F.coalesce(weights[c].cast("double"), F.lit(0.0)) > 0)
    domains = leaves.groupBy("domain").agg(F.sum("capacity").alias("capacity"))
    everything = domains.agg(F.sum("capacity").alias("everything"))  # one row
    domains = domains.crossJoin(everything).withColumn("above", F.least(total.cast("double"), F.col("everything").cast("double"))).drop("everything")
    domains = shared_out(domains, [], "domain", weights["domain"]).select("domain", F.col("budget").alias("above"))
    langs = leaves.groupBy("domain", "lang").agg(F.sum("capacity").alias("capacity")).join(domains, "domain")
    langs = shared_out(langs, ["domain"], "lang", weights["lang"]).select("domain", "lang", F.col("budget").alias("above"))
    sources = leaves.join(langs, ["domain", "lang"])
    return shared_out(sources, ["domain", "lang"], "source", weights["source"]).select(*LEAF, "size", "rows", "budget")


def mix(docs: DataFrame, weights: dict[str, Column], total_share: float, max_epochs: int = 4, seed: int = 1) -> DataFrame:
    """doc_id, domain, lang, source, epoch, n_tokens, taken: a row for each document and epoch selected.

    docs has doc_id, lang, source, text and domain; weights gives a column over each level's name;
    the total is total_share of all tokens, rounded down. The last document of a prefix may be
    taken in part: `taken` is below n_tokens there.
    """
    sized = docs.select("doc_id", F.coalesce("domain", F.lit("")).alias("domain"), F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), tokens().alias("n_tokens")).where("n_tokens > 0")
    sized = written(sized, "sized")
    leaves = sized.groupBy(*LEAF).agg(F.sum("n_tokens").alias("size"), F.count("*").alias("rows"))
    total = sized.agg(F.floor(F.coalesce(F.sum("n_tokens"), F.lit(0)) * total_share)).first()[0]
    planned = budgets(leaves, F.lit(total), weights, max_epochs)
    planned = planned.withColumn("epochs", F.floor(F.col("budget") / F.col("size"))).withColumn("rest", F.col("budget") - F.col("epochs") * F.col("size"))
    planned = written(planned.where("budget > 0"), "planned")  # a row a leaf; small ones are broadcast by their known size
    most = planned.agg(F.coalesce(F.max("rows"), F.lit(0))).first()[0]
    digits = 1
    while most / 16**digits > BUCKET_ROWS:
        digits += 1

    rows = sized.join(planned.select(*LEAF, "size", "epochs", "rest"), list(LEAF))
    complete = rows.where("epochs > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("epochs").cast("int") - 1)))
    complete = complete.select("doc_id", *LEAF, "epoch", "n_tokens", F.col("n_tokens").alias("taken"))

    partial = rows.where("rest > 0").withColumn("epoch", F.col("epochs").cast("int")).withColumn("key", order_key(seed, F.col("epoch"))).withColumn("bucket", F.substring("key", 1, digits))
    sums = partial.groupBy(*LEAF, "bucket").agg(F.sum("n_tokens").alias("held"))
    up = Window.partitionBy(*LEAF).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("start", F.coalesce(F.sum("held").over(up), F.lit(0)))
    placed = partial.join(sums, [*LEAF, "bucket"]).where("start < rest")
    inside = placed.where("start + held <= rest").select("doc_id", *LEAF, "epoch", "n_tokens", F.col("n_tokens").alias("taken"))
    ranked = Window.partitionBy(*LEAF, "bucket").orderBy("key", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    edge = placed.where("start + held > rest").withColumn("at", F.col("start") + F.coalesce(F.sum("n_tokens").over(ranked), F.lit(0))).where("at < rest")
    edge = edge.select("doc_id", *LEAF, "epoch", "n_tokens", F.least(F.col("n_tokens"), F.col("rest") - F.col("at")).alias("taken"))
    return complete.unionByName(inside).unionByName(edge)


# The production mixture over `documents`: four domains of sources, by the number in a source's name.


def source_number() -> Column:
    return F.coalesce(F.expr("try_cast(nullif(regexp_extract(source, '[0-9]+$', 0), '') as int)"), F.lit(0))


def domain() -> Column:
    return F.concat(F.lit("domain"), (source_number() % 4).cast("string"))


def production_weights() -> dict[str, Column]:
    lang = F.col("lang")
    return {
        "domain": F.expr("4 - cast(substring(domain, 7) as int)"),
        "lang": F.when(lang == "en", 5).when(lang.isin("fr", "de"), 2).otherwise(1),
        "source": 1 + source_number() % 3,
    }


TOTAL_SHARE, MAX_EPOCHS, SEED = 0.6, 4, 1


def mixture(docs: DataFrame, total_share: float = TOTAL_SHARE, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    return mix(docs.withColumn("domain", domain()), production_weights(), total_share, max_epochs, seed)


def selected(docs: DataFrame, total_share: float, seed: int = SEED) -> DataFrame:
    """The rows of docs, with all their columns, that the production mixture selects when no text is repeated.

    A document in which a prefix ends is kept whole. A row without a doc_id is told by a digest of its text.
    """
    ref = F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text"))
    known = docs.select(ref.alias("doc_id"), "lang", "source", "text")
    taken = mixture(known, total_share, 1, seed).select(F.col("doc_id").alias("taken_id")).distinct()
    return docs.join(taken, ref == taken["taken_id"], "left_semi")


def _level(name: str, parent: str, weight: str) -> str:
    """DuckDB SQL of shared_out."""
    by = f"partition by {parent}" if parent else ""
    up = f"{by} order by capacity / weight, {name} rows between unbounded preceding and 1 preceding"
    return f"""
    select * exclude (level), cast(floor(least(cast(capacity as double), max(level) over ({by}) * weight)) as bigint) as budget from (
      select *, (above - coalesce(sum(capacity) over ({up}), 0)) / (sum(weight) over ({by}) - coalesce(sum(weight) over ({up}), 0)) as level
      from (select *, cast({weight} as double) as weight from nodes))"""


MIXTURE_SQL = f"""
with n as (select doc_id, coalesce(lang, '') as lang, coalesce(source, '') as source,
    coalesce(try_cast(nullif(regexp_extract(source, '[0-9]+$', 0), '') as int), 0) as num,
    case when coalesce(text, '') = '' then 0 else length(text) - length(replace(text, ' ', '')) + 1 end as n_tokens
  from documents),
sized as (select *, 'domain' || cast(num % 4 as varchar) as domain from n where n_tokens > 0),
leaves as (select domain, lang, source, max(num) as num, cast(sum(n_tokens) as double) as size, cast(sum(n_tokens) as double) * {MAX_EPOCHS} as capacity from sized group by all),
domains as (with nodes as (select domain, sum(capacity) as capacity,
      least(floor((select sum(size) from leaves) * {TOTAL_SHARE}), (select sum(capacity) from leaves)) as above from leaves group by domain)
  {_level("domain", "", "4 - cast(substr(domain, 7) as int)")}),
langs as (with nodes as (select l.domain, lang, sum(l.capacity) as capacity, any_value(d.budget) as above from leaves l join domains d on l.domain = d.domain group by l.domain, lang)
  {_level("lang", "domain", "case when lang = 'en' then 5 when lang in ('fr', 'de') then 2 else 1 end")}),
sources as (with nodes as (select l.domain, l.lang, source, num, size, l.capacity, g.budget as above from leaves l join langs g on l.domain = g.domain and l.lang = g.lang)
  {_level("source", "domain, lang", "1 + num % 3")}),
planned as (select domain, lang, source, cast(floor(budget / size) as int) as epochs, cast(budget - floor(budget / size) * size as bigint) as rest from sources where budget > 0),
complete as (select doc_id, s.domain, s.lang, s.source, cast(unnest(range(epochs)) as int) as epoch, n_tokens, n_tokens as taken
  from sized s join planned p on s.domain = p.domain and s.lang = p.lang and s.source = p.source where epochs > 0),
ranked as (select doc_id, s.domain, s.lang, s.source, epochs as epoch, n_tokens, rest,
    coalesce(sum(n_tokens) over (partition by s.domain, s.lang, s.source order by md5('{SEED}:' || epochs || ':' || doc_id), doc_id, n_tokens rows between unbounded preceding and 1 preceding), 0) as begins
  from sized s join planned p on s.domain = p.domain and s.lang = p.lang and s.source = p.source where rest > 0)
select doc_id, domain, lang, source, epoch, cast(n_tokens as bigint) as n_tokens, cast(taken as bigint) as taken from complete
union all
select doc_id, domain, lang, source, epoch, cast(n_tokens as bigint), cast(least(n_tokens, rest - begins) as bigint) from ranked where begins < rest
"""
