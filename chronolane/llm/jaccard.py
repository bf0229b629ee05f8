"""Exact similarity join of documents on word shingles: the grouped prefix join.

Documents with equal size and equal prefix form one group. Only groups are indexed by their prefix
shingles; pairs of groups are filtered, then expanded to the distinct sets in them and verified on
whole sets. A prefix is the first |s| - ceil(0.75 |s|) + 1 shingles in one global order, so two
sets with Jaccard >= 0.75 always share a prefix shingle. The order puts shingles that many
documents share last, by the power of two of an estimated document frequency; it decides speed only.

Links are found in two steps. First each group is verified against one group that is central in a
list they share, which joins large families of near copies along a star. Then the pairs that share
a list and are still in different components are filtered and verified. Two bounds filter, and
neither loses a link: the overlap that counted prefix shingles can still reach, and parity bitmaps,
whose differing bits are at most the differing shingles. Nothing is capped: after the second step
every pair of sets that shares a prefix shingle lies in one component or cannot link.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textvec
from .components import components
from .shared import SLICE_BYTES, most_counted, slices, written

#: A shingle in fewer documents than this counts as rare in the order of shingles.
FREQUENT = 12
#: At most this many frequent shingles are told to the tasks (9 bytes each); others count as rare. It changes speed, not results.
ORDERED = 1 << 20
#: Longs of a set's parity bitmap.
BITMAP = 16
#: Members of one star that one task run verifies together.
STAR_PART = 256
#: Members of a list that are compared with as many others of it at once.
LIST_PART = 512


def needed(n):
    """The least overlap of a set of n with any set that links to it: ceil(0.75 n)."""
    return (3 * n + 3) // 4


def needed_sql(n: str):
    return F.floor((3 * F.col(n) + 3) / 4)


def named(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*(F.col(c).alias(prefix + c) for c in df.columns))


def differing():
    """Bits in which the bitmaps of x and y differ; at most the shingles that only one of them has."""
    out = F.lit(0)
    for i in range(BITMAP):
        out = out + F.bit_count(F.get("x_bits", F.lit(i)).bitwiseXOR(F.get("y_bits", F.lit(i))))
    return out


def can_link():
    """Whether sizes and bitmaps allow Jaccard >= 0.75, which is: at most a seventh of both sizes differs."""
    x, y = F.col("x_n"), F.col("y_n")
    return (4 * F.least(x, y) >= 3 * F.greatest(x, y)) & (7 * differing() <= x + y)


def frequent_shingles(docs: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles frequent in at least one task, and the power of two of their summed counts. Bounded by ORDERED."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, pending, size = np.zeros(0, np.uint64), np.zeros(0, np.int64), [], 0

        def merged():
            new, n = np.unique(np.concatenate(pending), return_counts=True)
            at = np.searchsorted(new, keys)
            at[at == len(new)] = 0
            known = new[at] == keys if len(new) else np.zeros(len(keys), bool)
            n[at[known]] += counts[known]
            many = n >= 2
            k2, c2 = np.concatenate((new[many], keys[~known])), np.concatenate((n[many], counts[~known]))
            if len(k2) > ORDERED:
                top = np.argpartition(-c2, ORDERED)[:ORDERED]
                k2, c2 = k2[top], c2[top]
            order = np.argsort(k2)
            return k2[order], c2[order]

        for batch in slices(batches):
            for s in textvec.shingle_sets(batch.column("text"), k):
                pending.append(s)
                size += len(s)
            if size > 1 << 19:
                keys, counts = merged()
                pending, size = [], 0
        if pending:
            keys, counts = merged()
        often = counts >= 2
        yield pa.RecordBatch.from_arrays([pa.array(keys[often].view(np.int64)), pa.array(counts[often])], ["k", "c"])

    local = docs.select("text").mapInArrow(count, "k long, c long")
    h, c = most_counted(written(local.groupBy("k").agg(F.sum("c").alias("c")).where(F.col("c") >= FREQUENT), "frequent"), ORDERED)
    h = h.view(np.uint64)
    order = np.argsort(h)
    return h[order], np.log2(np.maximum(c[order], 1)).astype(np.uint8)


def digest() -> Column:
    return F.xxhash64("text")


def ref() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), digest())


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, digest, ref, n (set size), node (hash of the set), grp (hash of size and prefix), prefix (array of shingles), bits (parity bitmap).

    ref finds the row's text again: the doc_id, or the text's digest where that is null.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest().alias("digest"), ref().alias("ref"), "text")
    order = docs.sparkSession.sparkContext.broadcast(frequent_shingles(docs, k))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, level = order.value
        for batch in slices(batches):
            sets = textvec.shingle_sets(batch.column("text"), k)
            n, node, grp, prefixes, bits = [], [], [], [], []
            for s in sets:
                size = len(s)
                p = size - needed(size) + 1 if size else 0
                rank = s
                if len(frequent) and size:
                    at = np.searchsorted(frequent, s)
                    at[at == len(frequent)] = 0
                    hit = frequent[at] == s
                    if hit.any():
                        rank = s[np.lexsort((s, np.where(hit, level[at], 0)))]
                prefix = rank[:p]
                n.append(size)
                node.append(node_id(s))
                grp.append(int(textvec.mix(np.add(textvec.mix(prefix + np.uint64(77)).sum(dtype=np.uint64), np.uint64(size), dtype=np.uint64)[None]).view(np.int64)[0]))
                prefixes.append(prefix)
                odd = np.bincount((s & np.uint64(64 * BITMAP - 1)).astype(np.int64), minlength=64 * BITMAP) & 1
                bits.append(np.packbits(odd.astype(np.uint8)).view(np.int64))
            flat = np.concatenate(prefixes) if prefixes else np.zeros(0, np.uint64)
            ends = np.concatenate(([0], np.cumsum([len(x) for x in prefixes]))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "digest", "ref")), pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(grp, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64))), pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * BITMAP), pa.array(np.concatenate(bits)))],
                ["doc_id", "digest", "ref", "n", "node", "grp", "prefix", "bits"],
            )

    return rows.mapInArrow(sign, "doc_id long, digest long, ref long, n long, node long, grp long, prefix array<long>, bits array<long>")


def node_id(s: np.ndarray) -> int:
    return int(textvec.mix(np.add(textvec.mix(s).sum(dtype=np.uint64), np.uint64(len(s)), dtype=np.uint64)[None]).view(np.int64)[0]) if len(s) else 0


def verified(pairs: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """Of pairs(a, a_doc, b, b_doc), where a and b are nodes and the docs hold their texts, those with Jaccard >= 0.75.

    Texts travel compressed. b's text goes once to each part of b's pairs, ahead of the a's; a part
    has a bounded share of a hot b's pairs and streams through its task.
    """
    parts = pairs.groupBy("b").agg(F.ceil(F.count("*") / STAR_PART).alias("parts"))
    pairs = pairs.join(parts, "b").withColumn("part", F.pmod(F.xxhash64("a"), F.col("parts")))
    left = pairs.select(F.col("a_doc").alias("id"), F.col("a").alias("node"), "b", "part", F.lit(1).alias("side"))
    right = pairs.select(F.col("b_doc").alias("id"), F.col("b").alias("node"), "b", "part", F.lit(0).alias("side")).distinct()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([squeeze((x or "").encode()) for x in batch.column("text").to_pylist()], pa.binary())], ["id", "packed"])

    packed = docs.select(ref().alias("id"), "text").mapInArrow(pack, "id long, packed binary")
    sides = left.unionByName(right).join(packed, "id").select("b", "part", "side", "node", "packed")
    dealt = sides.repartition("b", "part").sortWithinPartitions("b", "part", "side")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, pivot = None, None
        unsqueeze = zstandard.ZstdDecompressor().decompress
        for batch in unpacked_slices(batches):
            b, part, side, node = (batch.column(c).to_pylist() for c in ("b", "part", "side", "node"))
            sets = textvec.shingle_sets(pa.array([unsqueeze(x).decode() for x in batch.column("packed").to_pylist()], pa.large_string()), k)
            good: tuple[list, list] = ([], [])
            for i, s in enumerate(sets):
                if node_id(s) != node[i]:  # another row with the same doc_id
                    continue
                if side[i] == 0:
                    key, pivot = (b[i], part[i]), s
                elif key == (b[i], part[i]):
                    shared = common(s, pivot)
                    if 100 * shared >= 75 * (len(s) + len(pivot) - shared):
                        good[0].append(node[i])
                        good[1].append(b[i])
            yield pa.RecordBatch.from_arrays([pa.array(good[0], pa.int64()), pa.array(good[1], pa.int64())], ["a", "b"])

    return dealt.mapInArrow(verify, "a long, b long")


def unpacked_slices(batches: Iterator[pa.RecordBatch], limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in order, in batches whose column `packed` has about `limit` bytes once it is unpacked."""
    for batch in slices(batches, "packed"):
        start, size = 0, 0
        for i, x in enumerate(batch.column("packed").to_pylist()):
            size += zstandard.frame_content_size(x)
            if size >= limit:
                yield batch.slice(start, i + 1 - start)
                start, size = i + 1, 0
        if start < len(batch):
            yield batch.slice(start)


def common(x: np.ndarray, y: np.ndarray) -> int:
    z = np.concatenate((x, y))
    z.sort()
    return int((z[1:] == z[:-1]).sum())


def classes(docs: DataFrame, k: int = 5) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, digest, ref, n, node, root; equal roots are one component, null where the set is empty."""
    # prefixes are worked out again for the grouping rather than written: they would be half of the folder's bytes
    full = signatures(docs, k)
    signed = written(full.drop("prefix"), "signatures")
    # one grouping, which combines before its shuffle: copies collapse where they are read, and prefixes travel once
    rep = F.max_by(F.struct("node", F.col("ref").alias("doc"), "bits"), F.struct("node", (-F.col("ref")).alias("least"))).alias("rep")
    groups = full.where("n > 0").groupBy("n", "grp").agg(rep, F.first("prefix").alias("prefix"), F.min("node").alias("other"))
    groups = written(groups.select("n", "grp", "rep.*", (F.col("other") != F.col("rep.node")).alias("several"), "prefix"), "groups")
    info = groups.select("node", "doc", "n", "grp", "bits")

    posting = groups.select(F.explode("prefix").alias("tok"), "node")
    lists = posting.groupBy("tok").agg(F.count("*").alias("size")).where("size > 1")
    hits = written(posting.join(lists, "tok"), "hits")

    # the sets of one group beyond its representative; copies of a set are one row before they meet
    many = groups.where("several").select("n", "grp", F.col("node").alias("b"), F.col("doc").alias("b_doc"))
    sets = signed.where("n > 0").groupBy("n", "grp", "node").agg(F.min("ref").alias("doc"), F.first("bits").alias("bits"))
    within = sets.join(many, ["n", "grp"]).where("node != b")
    within = written(within.select("n", "grp", F.col("node").alias("a"), F.col("doc").alias("a_doc"), "bits", "b", "b_doc"), "within")

    # step 1: each group with the nearest of its lists' most central groups; an unedited text shares most of its prefix
    central = hits.groupBy("node").count().join(groups.select("node", "n"), "node").select("node", (F.col("count") / (F.col("n") - needed_sql("n") + 1)).alias("central"))
    heads = hits.join(central, "node").groupBy("tok").agg(F.max_by("node", F.struct("central", "node")).alias("pivot"))
    stars = hits.join(heads, "tok").where("node != pivot").select("node", "pivot").distinct()
    stars = stars.join(named(info, "x_"), F.col("node") == F.col("x_node")).join(named(info, "y_"), F.col("pivot") == F.col("y_node")).where(can_link())
    stars = stars.groupBy(F.col("x_node").alias("a"), F.col("x_doc").alias("a_doc")).agg(F.min_by(F.struct(F.col("y_node").alias("b"), F.col("y_doc").alias("b_doc")), F.struct(differing().alias("d"), "y_node")).alias("best"))
    stars = stars.select("a", "a_doc", "best.b", "best.b_doc").unionByName(within.select("a", "a_doc", "b", "b_doc"))
    links = written(verified(stars, docs, k), "links")
    roots = components(links)

    # step 2: pairs of groups that share a list while some of their sets are in different components
    sets = groups.select("grp", "n", "node", "doc", "bits").unionByName(within.select("grp", "n", F.col("a").alias("node"), F.col("a_doc").alias("doc"), "bits"))
    placed = written(sets.join(roots, sets.node == roots.id, "left").select("grp", "n", "node", "doc", "bits", F.coalesce("root", "node").alias("root")), "placed")
    span = placed.groupBy("grp", "n").agg(F.min("root").alias("lo"), F.max("root").alias("hi"))
    span = groups.select("grp", "n", "node", "several", "bits").join(span, ["grp", "n"])
    mixed = hits.join(span.select("node", "lo", "hi"), "node").groupBy("tok").agg(F.min("lo").alias("a"), F.max("hi").alias("b")).where("a != b").select("tok")
    open_lists = written(hits.join(mixed, "tok").join(span, "node"), "open")
    # a long list is dealt in squares of LIST_PART members a side, each of which is compared by itself
    side = F.ceil(F.col("size") / LIST_PART).cast("int")
    dealt = open_lists.withColumn("strip", F.pmod(F.xxhash64("node"), side).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), side - 1)))
    dealt = dealt.withColumns({"row": F.least("strip", "other"), "col": F.greatest("strip", "other")}).drop("other", "size")
    same = [F.col(f"x_{c}") == F.col(f"y_{c}") for c in ("tok", "row", "col")]
    apart = named(dealt, "x_").join(named(dealt, "y_"), same).where("x_node < y_node and (x_row = x_col or x_strip != y_strip) and not (x_lo = x_hi and y_lo = y_hi and x_lo = y_lo)")
    apart = apart.where("4 * least(x_n, y_n) >= 3 * greatest(x_n, y_n)").where(F.col("x_several") | F.col("y_several") | can_link())
    apart = apart.groupBy("x_node", "y_node", "x_n", "y_n", "x_grp", "y_grp").agg(F.count("*").alias("shared"))
    # overlap needed: ceil(3 (x + y) / 7); beyond the prefix that ends first at most n - p = ceil(0.75 n) - 1 can be shared
    apart = apart.where(F.col("shared") + F.greatest(needed_sql("x_n"), needed_sql("y_n")) - 1 >= F.ceil(3 * (F.col("x_n") + F.col("y_n")) / 7))
    inner = within.select(F.col("grp").alias("x_grp"), F.col("n").alias("x_n"), F.col("grp").alias("y_grp"), F.col("n").alias("y_n")).distinct()
    apart = apart.select("x_grp", "x_n", "y_grp", "y_n").unionByName(inner)
    x, y = named(placed, "x_"), named(placed, "y_")
    rest = apart.join(x, ["x_grp", "x_n"]).join(y, ["y_grp", "y_n"]).where("x_root != y_root and (x_node < y_node or x_grp != y_grp or x_n != y_n)").where(can_link())
    rest = written(rest.select(F.col("x_node").alias("a"), F.col("x_doc").alias("a_doc"), F.col("y_node").alias("b"), F.col("y_doc").alias("b_doc")).distinct(), "rest")
    if not rest.isEmpty():
        roots = components(links.unionByName(verified(rest, docs, k)))

    out = signed.select("doc_id", "digest", "ref", "n", "node").join(roots, signed.node == roots.id, "left")
    return out.select("doc_id", "digest", "ref", "n", "node", F.when(F.col("n") > 0, F.coalesce("root", "node")).alias("root"))


def similar_sets(spark: SparkSession, docs: DataFrame, k: int = 5) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, n_shingles, component_id.

    component_id is the smallest doc_id that links reach. Null or empty texts have an empty set and
    are linked with nothing; texts of fewer than k words count as one shingle. Repeated rows come
    back as often as they came, in one component. Further columns of docs are ignored. A row with a null
    doc_id is kept and links like any other; its component is the smallest known doc_id in it, or null.
    Rows of one doc_id with different texts are rows of their own.
    """
    rows = classes(docs, k)
    nodes = rows.where("root is not null").groupBy("node", "root").agg(F.min("doc_id").alias("doc"))
    least = nodes.groupBy("root").agg(F.min("doc").alias("component_id"))
    least = nodes.join(least, "root").select(F.col("node").alias("of"), "component_id")
    out = rows.join(least, (F.col("n") > 0) & (rows.node == F.col("of")), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def one_of_each(spark: SparkSession, docs: DataFrame, k: int = 5) -> DataFrame:
    """Of docs, with all their columns, one row for each component: the one with the smallest doc_id, and of equal ones the smallest digest of the text.

    Rows without a doc_id come after those with one. Texts without words are linked with nothing and stay.
    """
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "digest")
    first = classes(docs.select("doc_id", "text"), k).where("root is not null").groupBy("root").agg(F.min_by(F.struct("ref", "digest"), order).alias("row"))
    kept = first.select(F.col("row.ref").alias("_kept_ref"), F.col("row.digest").alias("_kept_digest"))
    rows = docs.withColumns({"_ref": ref(), "_digest": digest()})
    rows = rows.join(kept, (F.col("_ref") == F.col("_kept_ref")) & (F.col("_digest") == F.col("_kept_digest")), "left_semi")
    rows = rows.dropDuplicates(["_ref", "_digest"]).drop("_ref", "_digest")
    return rows.unionByName(docs.where(F.col("text").isNull() | ~F.col("text").rlike(r"[^ \t-\r]")))


#: Every pair that shares a shingle is counted, and links are walked to their end.
SIMILAR_SQL = """
with recursive t as (select row_number() over () as node, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w from documents),
s as materialized (select node, unnest(case when len(w) >= 5 then list_distinct([array_to_string(w[i : i + 4], ' ') for i in range(1, len(w) - 3)]) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as shingle from t),
n as (select node, count(*) as n from s group by node),
p as (select a.node as a, b.node as b, count(*) as shared from s a join s b on a.shingle = b.shingle and a.node != b.node group by all),
l as materialized (select a, b from p join n x on x.node = a join n y on y.node = b where 100 * shared >= 75 * (x.n + y.n - shared)),
r as (select a as node, a as far from (select distinct a from l) union select r.node, l.b from r join l on r.far = l.a),
c as (select r.node, min(t.doc_id) as component_id from r join t on r.far = t.node group by r.node)
select doc_id, coalesce(n, 0) as n_shingles, coalesce(component_id, doc_id) as component_id from t left join n on t.node = n.node left join c on t.node = c.node
"""
