"""Nearest neighbours by cosine: inverted lists scanned adaptively by dimension.

Equal vectors are one class, with the least ids that a result can need, so a vector that many rows
share is compared once. Centroids are fitted on a bounded sample, every class is put into its
nearest list, and lists are cut into blocks of bounded size. The number of lists to probe is set on
the sample, so that the wanted recall is reached there; a query whose lists hold too few classes for a
whole result probes further ones by rising distance. A list that many queries probe is dealt to several
tasks, each with a part of the queries.

In a block vectors are unit length and rotated at random. Column blocks are added one by one; after
each, the partial squared distance of d' of d columns estimates the whole, and a candidate is
abandoned when distance * d / d' exceeds the worst of the best so far by more than the test's margin,
(1 + CERTAINTY / sqrt(d'))^2. The best so far come from the block's first vectors and, after the
first column block, from those that then look nearest. What is left is measured exactly, in double precision on the original vectors.

Vectors of different lengths have no cosine: each length has an index of its own, and one with up to BLOCK
classes is a single list. Vectors are scaled by powers of two before they are squared, so that large and
tiny components neither overflow nor vanish and scores stay what they are.

Null, zero and non-finite vectors and vectors with null components take no part. Ties go to the smaller vec_id. Rows that repeat a vec_id with the
same vector count once; a query never finds its own vec_id. An empty table has no result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

#: Rows to fit on, vectors of one block, and what the sample's probes must find of its true neighbours.
SAMPLE, BLOCK, WANTED_RECALL = 10_000, 2048, 0.97
#: Queries of a list that one task answers, about.
QUERIES = 2048
COLUMNS, CERTAINTY, FIRST = 16, 2.1, 48


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and the vector as array<double>, of rows that take part."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).where("vec_id is not null and v is not null and size(v) > 0")
    return v.where("forall(v, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(v, x -> x != 0)")


def scaled(x: np.ndarray) -> np.ndarray:
    """Each row times the power of two that brings its largest component between 1/2 and 1."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=-1, keepdims=True))[1])


def unit(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@dataclass
class Index:
    """Of one length: centroids, rotation, the lists to probe, and the number of the first list."""

    centroids: np.ndarray
    rotation: np.ndarray
    probes: int
    first: int


def fit(classes: DataFrame, count: int, k: int, seed: int = 3) -> tuple[np.ndarray, np.ndarray, int]:
    """Centroids, rotation and the lists to probe, from the SAMPLE classes with the least hash; all have one length."""
    rows = classes.select("v").orderBy(F.xxhash64("v"), "v").limit(SAMPLE).toArrow().column("v")
    x = unit(np.array([r.values.to_numpy() for r in rows]))
    n, d = x.shape
    rng = np.random.default_rng(seed)
    lists = int(min(max(1, math.sqrt(count) / 6), 4096, n))
    c = x[rng.permutation(n)[:lists]]
    for _ in range(8):
        near = (x @ c.T).argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(size > 1e-12, sums / np.maximum(size, 1e-12), c)
    rotation = np.linalg.qr(rng.standard_normal((d, d)))[0]
    near = (x @ c.T).argmax(1)
    asked = rng.permutation(n)[:400]
    s = x[asked] @ x.T
    s[np.arange(len(asked)), asked] = -2
    true = np.argsort(-s, axis=1)[:, :k]
    order = np.argsort(-(x[asked] @ c.T), axis=1)
    place = np.empty_like(order)
    place[np.arange(len(asked))[:, None], order] = np.arange(lists)
    needed = np.take_along_axis(place, near[true], axis=1).ravel() if n > 1 else np.zeros(1)
    probes = int(np.quantile(needed, WANTED_RECALL, method="higher")) + 1
    return c, rotation, min(lists, probes)


def scan(original: np.ndarray, rotated_q: np.ndarray, vectors: np.ndarray, originals: np.ndarray, norms: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices and exact cosines of the block's up to k nearest to one query."""
    n, d = vectors.shape
    first = min(n, max(FIRST, k))
    diff = vectors[:first] - rotated_q
    start = np.einsum("ij,ij->i", diff, diff)
    alive = np.arange(first)
    if n > first:
        best = np.partition(start, k - 1)[:k]
        left, part = np.arange(first, n), np.zeros(n - first)
        for at in range(0, d, COLUMNS):
            end = min(d, at + COLUMNS)
            diff = vectors[left, at:end] - rotated_q[at:end]
            part = part + np.einsum("ij,ij->i", diff, diff)
            if at == 0 and end < d and len(left) > k:
                diff = vectors[left[np.argpartition(part, k)[:k]]] - rotated_q
                best = np.partition(np.concatenate((best, np.einsum("ij,ij->i", diff, diff))), k - 1)[:k]
            limit = best.max()
            bound = limit * end / d * (1 + CERTAINTY / math.sqrt(end)) ** 2 if end < d else limit
            keep = part <= bound + 1e-9
            left, part = left[keep], part[keep]
        alive = np.concatenate((alive, left))
    exact = (originals[alive] * original).sum(axis=1) / (norms[alive] * math.sqrt((original * original).sum()))
    order = np.argsort(-exact, kind="stable")[:k]
    return alive[order], exact[order]


def search(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of queries(vec_id, embedding), its k nearest rows of vectors found."""
    spark = vectors.sparkSession
    v = usable(vectors).withColumn("key", F.xxhash64("v"))
    least = Window.partitionBy("key", "v").orderBy("vec_id")
    # k + 1 ids of each class are enough: the query itself may be among them
    limited = v.distinct().withColumn("i", F.row_number().over(least)).where(F.col("i") <= k + 1)
    classes = written(limited.groupBy("key", "v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "classes")
    lengths = classes.groupBy(F.size("v").alias("d")).count().orderBy("d").collect()  # a row a length
    names = "query_id long, rank int, vec_id long, score double"
    if not lengths:
        return spark.createDataFrame([], names)
    indexes, lists = {}, 0
    for d, count in lengths:
        c, rotation, probes = fit(classes.where(F.size("v") == d), count, k) if count > BLOCK else (np.zeros((1, d)), np.eye(d), 1)
        indexes[d] = Index(c, rotation, probes, lists)
        lists += len(c)
    index = spark.sparkContext.broadcast(indexes)  # for each length at most 4096 centroids, and one rotation

    def place(sizes: np.ndarray | None = None):
        """The nearest list of each vector; where sizes has the lists' classes, those to probe, and further ones until they hold k + 1 classes."""

        def placed(d: int, batch: pa.RecordBatch) -> pa.RecordBatch:
            i, x = index.value[d], unit(np.array([r.values.to_numpy() for r in batch.column("v")]))
            near = np.argsort(-(x @ i.centroids.T), axis=1, kind="stable").astype(np.int32)
            taken = np.full(len(near), 1)
            if sizes is not None:
                short = (np.cumsum(sizes[near + i.first], axis=1) < k + 1).sum(axis=1) + 1
                taken = np.minimum(np.maximum(i.probes, short), near.shape[1])
            ends = np.concatenate(([0], np.cumsum(taken))).astype(np.int32)
            lists = near[np.arange(near.shape[1]) < taken[:, None]] + np.int32(i.first)
            rotated = x @ i.rotation
            return pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in batch.schema.names), pa.ListArray.from_arrays(pa.array(ends), pa.array(lists)), pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1, dtype=np.int32) * d), pa.array(rotated.ravel()))],
                [*batch.schema.names, "lists", "rotated"],
            )

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                d = np.diff(batch.column("v").offsets.to_numpy())
                for one in np.unique(d).tolist():
                    if one in index.value:  # a query may have a length that no vector has
                        yield placed(one, batch.take(pa.array(np.flatnonzero(d == one))))

        return run

    placed = classes.select("v", "ids").mapInArrow(place(), "v array<double>, ids array<long>, lists array<int>, rotated array<double>")
    placed = written(placed.select(F.col("lists")[0].alias("list"), "v", "ids", "rotated"), "placed")
    sizes = np.zeros(lists, np.int64)
    for r in placed.groupBy("list").count().collect():  # a row a list
        sizes[r["list"]] = r["count"]

    asked = usable(queries).withColumn("key", F.xxhash64("v"))
    # queries of one vector are asked once
    distinct = asked.groupBy("key", "v").agg(F.min("vec_id").alias("id"))
    probed = distinct.select("v", "id").mapInArrow(place(sizes), "v array<double>, id long, lists array<int>, rotated array<double>")
    probed = written(probed, "probed")
    load = probed.select(F.explode("lists").alias("list")).groupBy("list").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("parts"))
    blocks = spark.createDataFrame([(i, int(-(-n // BLOCK))) for i, n in enumerate(sizes.tolist()) if n], "list int, blocks int").join(load, "list")

    def numbers(n: str):
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    # a list that nobody probes is not sent; each part of a list's queries has the list's vectors
    stored = placed.join(F.broadcast(blocks), "list").select("list", F.pmod(F.xxhash64("ids"), F.col("blocks")).cast("int").alias("block"), numbers("parts").alias("part"), F.lit(0).alias("side"), F.col("ids")[0].alias("id"), "ids", "v", "rotated")
    probed = probed.withColumn("list", F.explode("lists")).join(F.broadcast(blocks), "list").withColumn("block", numbers("blocks"))
    probed = probed.select("list", "block", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("side"), "id", F.lit(None).cast("array<long>").alias("ids"), "v", "rotated")
    dealt = stored.unionByName(probed).repartition("list", "block", "part").sortWithinPartitions("list", "block", "part", "side", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, originals, vectors, ready = None, [], [], [], None
        for batch in batches:
            rows = zip(*(batch.column(n).to_pylist() for n in ("list", "block", "part", "side", "id", "ids")), batch.column("v"), batch.column("rotated"))
            out: tuple[list, list, list] = ([], [], [])
            for lst, block, share, side, one, members, x, r in rows:
                if key != (lst, block, share):
                    key, ids, originals, vectors, ready = (lst, block, share), [], [], [], None
                x, r = scaled(x.values.to_numpy()), r.values.to_numpy()
                if side == 0:
                    ids.append(members)
                    originals.append(x)
                    vectors.append(r)
                elif ids:
                    if ready is None:
                        o = np.array(originals)
                        ready = (np.array(vectors), o, np.sqrt((o * o).sum(axis=1)))
                    i, s = scan(x, r, *ready, k + 1)
                    out[0].extend([one] * len(i))
                    out[1].extend(s.tolist())
                    out[2].extend(ids[j] for j in i.tolist())
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.float64()), pa.array(out[2], pa.list_(pa.int64()))], ["id", "score", "ids"])

    found = dealt.mapInArrow(run, "id long, score double, ids array<long>")
    best = Window.partitionBy("id").orderBy(F.desc("score"), F.col("ids")[0])
    found = found.withColumn("i", F.row_number().over(best)).where(F.col("i") <= k + 1)
    # at most k + 1 classes of at most k + 1 ids each
    found = found.select("id", F.explode("ids").alias("vec_id"), "score").groupBy("id").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("far"), "vec_id"))).alias("near"))
    answers = asked.select(F.col("vec_id").alias("query_id"), "key", "v").distinct().join(distinct.withColumnRenamed("v", "w").withColumnRenamed("key", "key2"), (F.col("key") == F.col("key2")) & (F.col("v") == F.col("w"))).join(found, "id")
    answers = answers.select("query_id", F.posexplode(F.slice(F.filter("near", lambda x: x.vec_id != F.col("query_id")), 1, k)).alias("pos", "hit"))
    return answers.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), (-F.col("hit.far")).alias("score"))
