"""Append-only revisions: latest rows, chains, appends that must not change what is there."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import written
from .ranks import joined_on, previous, ranked
from .series import daily, lagged, running_sum
from .timing import failures, ladder


def current(rows: DataFrame, key: list[str], *order: str) -> DataFrame:
    """The row of each key that is last by the order columns (descending); the last of them should be unique."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("row")).select(*key, "row.*")


def revision_check(rows: DataFrame, key: list[str], revision: str, supersedes: str, identity: str) -> DataFrame:
    """rows with what is wrong: a first revision that is not 1, a gap, or a pointer to another row than the one before."""
    w = Window.partitionBy(*key).orderBy(revision, identity)
    before, before_id = F.lag(revision).over(w), F.lag(identity).over(w)
    checked = rows.withColumn("_before", before).withColumn("_id", before_id)
    state = ladder(
        (F.col("_before").isNull() & (F.col(revision) != 1), "MISSING_FIRST"), (F.col("_before").isNull() & F.col(supersedes).isNotNull(), "DANGLING"),
        (F.col("_before").isNotNull() & (F.col(revision) != F.col("_before") + 1), "GAP"), (F.col("_before").isNotNull() & ~F.col(supersedes).eqNullSafe(F.col("_id")), "WRONG_PARENT"), otherwise="OK",
    )
    return checked.withColumn("revision_state", state).drop("_before", "_id")


def hash_revisions(rows: DataFrame, key: list[str], order: tuple[str, str], content: str) -> DataFrame:
    """rows with revision: it rises by one whenever the content differs from the row before, in order of a time and a tie."""
    time, tie = order
    r = lagged(rows.withColumn("_there", F.lit(True)), key, time, tie, {"_content": content, "_follows": "_there"}, daily(time))
    same = F.coalesce(F.col("_follows"), F.lit(False)) & F.col(content).eqNullSafe(F.col("_content"))
    r = r.withColumn("_changed", F.when(same, 0).otherwise(1)).drop("_there", "_content", "_follows")
    return running_sum(r, key, time, tie, "_changed", "revision", daily(time)).drop("_changed")


def audit_chain(rows: DataFrame, entity: list[str], order: list[str], payload: str) -> DataFrame:
    """rows with prev_hash and entry_hash: each entry covers its payload and the entry before it, so a change shows in all later ones.

    A chain is sequential by nature: an entity's rows stream in order through one task, which carries one
    hash. Columns of `order` should be unique within an entity.
    """
    schema = T.StructType([*rows.schema.fields, T.StructField("prev_hash", T.StringType()), T.StructField("entry_hash", T.StringType())])
    names = schema.names
    keyed = rows.withColumns({"_of": F.to_json(F.struct(*entity)), "_own": F.sha2(F.col(payload), 256)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, last = None, None
        for batch in batches:
            before, entries = [], []
            for key, own in zip(batch.column("_of").to_pylist(), batch.column("_own").to_pylist()):
                last = last if key == of else None
                before.append(last)
                of, last = key, hashlib.sha256(f"{last or ''}|{own or ''}".encode()).hexdigest()
                entries.append(last)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names[:-2]), pa.array(before, pa.string()), pa.array(entries, pa.string())], names)

    return keyed.repartition("_of").sortWithinPartitions("_of", *order).mapInArrow(run, schema)


def verified_chain(rows: DataFrame, entity: list[str], order: list[str], payload: str, before: str = "prev_hash", entry: str = "entry_hash") -> DataFrame:
    """rows with `broken`: which of ENTRY_MISMATCH (the stored entry is not that of the stored payload and prev_hash) and LINK_BROKEN (prev_hash is not the entry of the row before) hold.

    No row waits for another's hash, so a chain is checked in many tasks however long it is; an altered row shows at
    itself, or at the link after it where its own hash was made anew. order is unique within an entity.
    """
    made = F.sha2(F.concat(F.coalesce(before, F.lit("")), F.lit("|"), F.coalesce(F.sha2(F.col(payload), 256), F.lit(""))), 256)
    at = previous(rows.withColumn("_made", made), entity, order, {"_linked": entry})
    return at.withColumn("broken", failures((~F.col("_made").eqNullSafe(F.col(entry)), "ENTRY_MISMATCH"), (~F.col("_linked").eqNullSafe(F.col(before)), "LINK_BROKEN"))).drop("_made", "_linked")


#: Entries of one block of a tree of digests.
FAN = 1024


def digest_tree(rows: DataFrame, entity: list[str], order: list[str], entry: str = "entry_hash", fan: int = FAN) -> DataFrame:
    """(entity, level, block, digest): a tree over each entity's entries, `fan` of them to a block of level 0, `fan` blocks to one of the next level, up to the entity's root, a level of one block.

    Digests of an entity that differ somewhere differ on the way from there to the root, so two copies are compared from the root down.
    """
    digest = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", F.coalesce("_is", F.lit("")).alias("_is")))), lambda x: x["_is"]), ","), 256)
    level, leaf, out = 0, ranked(rows.select(*entity, *order, F.col(entry).alias("_is")), entity, order).select(*entity, F.col("before").alias("_at"), "_is"), None
    while True:
        tree = leaf.withColumn("block", F.floor(F.col("_at") / fan)).groupBy(*entity, "block").agg(digest.alias("digest"))
        tree = written(tree.select(*entity, F.lit(level).alias("level"), "block", "digest"), "tree")
        out = tree if out is None else out.unionByName(tree)
        several = tree.groupBy(*entity).agg(F.max("block").alias("_top")).where("_top > 0")
        if several.isEmpty():
            return out
        level, leaf = level + 1, joined_on(tree, several, entity).select(*entity, F.col("block").alias("_at"), F.col("digest").alias("_is"))


def first_differing(a: DataFrame, b: DataFrame, entity: list[str]) -> DataFrame:
    """entity and `block`: the first block of level 0 in which two digest trees differ; an entity without a row is the same in both."""
    base = lambda t, name: t.where("level = 0").select(*entity, "block", F.col("digest").alias(name))
    both = base(a, "_a").join(base(b, "_b"), [*entity, "block"], "full_outer").where("not (_a <=> _b)")
    return both.groupBy(*entity).agg(F.min("block").alias("block"))


def append_state(batch: DataFrame, stored: DataFrame, key: str, content: str) -> DataFrame:
    """What appending each row would do: NEW, NOOP for equal content, CONFLICT for other content."""
    s = stored.select(key, F.col(content).alias("_stored"), F.lit(True).alias("_there"))
    state = F.when(F.col("_there").isNull(), "NEW").when(F.col(content).eqNullSafe(F.col("_stored")), "NOOP").otherwise("CONFLICT")
    return batch.join(s, key, "left").withColumn("append_state", state).drop("_stored", "_there")


def edge_pass_rate(edges: DataFrame, by: list[str], child_parent: str, parent_output: str) -> DataFrame:
    """Share of edges whose child names its parent's output; a missing parent fails."""
    return edges.groupBy(*by).agg(F.count("*").alias("edges"), F.avg(F.coalesce(F.col(child_parent) == F.col(parent_output), F.lit(False)).cast("double")).alias("pass_rate"))


def chain_states(rows: DataFrame, key: list[str], node: str, parent: str) -> DataFrame:
    """(key, node, chain, depth) of all rows by pointer jumping: REACHED from a root with its depth, DANGLING below a missing parent, or CYCLE.

    Each round doubles the steps a row looks up, so the rounds are log2 of the longest chain that ends, and one
    more. A round writes the rows that moved in it; those that stand are left where they were written. Where a round
    lets none of the moving rows stand, each of them looks up another one: they are on a cycle, or behind one.
    (key, node) is unique; repeated rows count once.
    """
    edges = rows.select(*key, F.col(node).alias("node"), F.col(parent).alias("up")).distinct()
    # up: the ancestor so many steps away; null where the row stands at its root already, or hangs
    start = edges.withColumn("steps", F.when(F.col("up").isNull(), 0).otherwise(1).cast("long")).withColumn("hangs", F.lit(False))
    # the tables are equi-joined by sort, as each would be broadcast through the driver in every round while it is small
    at = written(start, "chain")
    stands, moving = at.where("up is null"), at.where("up is not null")
    left, before, most, far = moving.count(), None, at.count(), 1
    while left and left != before and far <= most:  # with (key, node) unique, the second ends it long before the third
        via = moving.unionByName(stands).select(*key, F.col("node").alias("up"), F.col("up").alias("_beyond"), F.col("steps").alias("_more"), F.col("hangs").alias("_hangs"))
        both = moving.join(via.hint("merge"), [*key, "up"], "left")
        moved = both.select(*key, "node", F.col("_beyond").alias("up"), (F.col("steps") + F.coalesce("_more", F.lit(0))).alias("steps"), F.coalesce("_hangs", F.lit(True)).alias("hangs"))
        moved = written(moved, "chain")
        stands, moving = stands.unionByName(moved.where("up is null")), moved.where("up is not null")
        left, before, far = moving.count(), left, far * 2
    at = stands.unionByName(moving)
    state = ladder((F.col("up").isNotNull(), "CYCLE"), (F.col("hangs"), "DANGLING"), otherwise="REACHED")
    return at.select(*key, "node", state.alias("chain"), F.when(F.col("up").isNull() & ~F.col("hangs"), F.col("steps")).cast("int").alias("depth"))


def chain_depth(rows: DataFrame, key: list[str], node: str, parent: str) -> DataFrame:
    """(key, node, depth) of all rows that a root reaches, whatever the depth; see chain_states."""
    return chain_states(rows, key, node, parent).where("chain = 'REACHED'").drop("chain")


def resolved(states: DataFrame, strict: bool = False) -> DataFrame:
    """states as they are; the job fails at a CYCLE, and if strict at a DANGLING row too."""
    bad = F.col("chain").isin(*(("CYCLE", "DANGLING") if strict else ("CYCLE",)))
    return states.withColumn("chain", F.when(bad, F.raise_error(F.concat_ws(" ", F.lit("unresolvable chain:"), F.col("node").cast("string"), "chain"))).otherwise(F.col("chain")))
