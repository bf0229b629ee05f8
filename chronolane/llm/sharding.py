"""Sharding by sampled splitters: rows in key order are cut into shards of nearly equal bytes.

The key is a digest of the text, then doc_id, so copies of one text are neighbours and a shard border is
the only place where they part. A sample of keys, drawn by size, gives the splitters: its quantiles are
the borders of ranges. Ranges that hold more than RANGE_ROWS rows are overfull (a large table, a hot text,
an unlucky sample); each gets a sample of its own and is subdivided, until none is. Bytes and rows of the
ranges are summed, and within a range, where one task sorts its rows, each row learns how many bytes and
rows stand before it in the whole table. A row goes to the shard in which the middle of its bytes lies: the
law is `bytes`, and a shard is off its share by at most half of the two rows at its borders.

A null text has no bytes and size 1. Rows without a doc_id come first among equal texts. Rows that are
equal in all of the key are told apart by where they were written, so a text of which every row has
the same doc_id is subdivided too. Further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

SHARDS = 8
#: Ranges of the first round, draws for each range to come, and rows that one task may sort.
SPLITS, DRAWS, RANGE_ROWS = 256, 24, 1 << 22
#: Null doc_ids first; a tie is the place of the row in the table that `sized` wrote.
KEY = ("digest", "has_id", "id", "tie")
KEY_TYPE = np.dtype([("digest", "i8"), ("has_id", "?"), ("id", "i8"), ("tie", "i8")])


def sized(docs: DataFrame) -> DataFrame:
    """The key, size and text_crc32 of every row; written, so that a tie stays what it is."""
    data, doc_id = F.encode(F.coalesce(F.col("text"), F.lit("")), "utf-8"), F.col("doc_id").cast("long")
    # 60 bits of the md5; equal texts have equal ones, and other texts that share them are only neighbours
    digest = F.conv(F.substring(F.md5(data), 1, 15), 16, 10).cast("long")
    key = (digest.alias("digest"), doc_id.isNotNull().alias("has_id"), F.coalesce(doc_id, F.lit(0)).alias("id"), F.monotonically_increasing_id().alias("tie"))
    return written(docs.select(*key, (F.octet_length(data) + 1).cast("long").alias("size"), F.crc32(data).alias("text_crc32")), "sized")


def keys_of(table: pa.Table | pa.RecordBatch) -> np.ndarray:
    out = np.empty(table.num_rows, KEY_TYPE)
    for name in KEY:
        out[name] = table.column(name).to_numpy(zero_copy_only=False)
    return out


def splitters(rows: DataFrame, ranges: np.ndarray, wanted: dict[int, int], level: int) -> dict[int, np.ndarray]:
    """Sorted borders for each range of wanted (how many parts it is to have): quantiles of a sample of its keys.

    ranges has rows and bytes of each range. A row is drawn by the mean of its shares of the range's
    bytes and of its rows, so that neither a long text nor many short ones keep the borders to themselves.
    About DRAWS keys for each part reach the driver.
    """
    spark = rows.sparkSession
    table = [(r, float(parts * DRAWS), int(ranges["bytes"][r]), int(ranges["rows"][r])) for r, parts in wanted.items()]
    told = F.broadcast(spark.createDataFrame(table, "range long, draws double, held_bytes long, held_rows long"))  # a row for each overfull range
    weight = F.col("draws") * (F.col("size") / F.col("held_bytes") + 1 / F.col("held_rows")) / 2
    die = F.xxhash64(*KEY, F.lit(level)) / float(1 << 64) + 0.5
    drawn = rows.join(told, "range").where(die < weight).select("range", *KEY, F.greatest(weight, F.lit(1.0)).alias("weight")).toArrow()
    keys, of, weights = keys_of(drawn), drawn.column("range").to_numpy(), drawn.column("weight").to_numpy()
    order = np.lexsort((keys["tie"], keys["id"], keys["has_id"], keys["digest"], of))
    keys, of, weights = keys[order], of[order], weights[order]
    found = {}
    for r, parts in wanted.items():
        a, b = np.searchsorted(of, r), np.searchsorted(of, r, side="right")
        up = np.cumsum(weights[a:b])
        # no border is the sample's first key: something of the range always stays below a border
        at = np.searchsorted(up, up[-1] * np.arange(1, parts) / parts) if b > a + 1 else np.zeros(0, np.int64)
        found[r] = keys[a:b][np.unique(np.clip(at, 1, b - a - 1))]
    return found


def above(borders: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """For each key, how many of the sorted borders are not above it."""
    both = np.concatenate((borders, keys))
    border = np.arange(len(both)) < len(borders)
    order = np.lexsort((~border, both["tie"], both["id"], both["has_id"], both["digest"]))  # a border stands before a key that equals it
    out = np.empty(len(both), np.int64)
    out[order] = np.cumsum(border[order])
    return out[len(borders) :]


def divided(rows: DataFrame, borders: dict[int, np.ndarray], ranges: int) -> DataFrame:
    """rows with ranges numbered anew, in key order: a range with borders becomes one more than it has borders."""
    first = np.concatenate(([0], np.cumsum([len(borders.get(r, ())) + 1 for r in range(ranges)])))
    told = rows.sparkSession.sparkContext.broadcast((first, borders))  # a few keys for each RANGE_ROWS rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, borders = told.value
        for batch in batches:
            was, keys = batch.column("range").to_numpy(), keys_of(batch)
            place = first[was]
            for r in np.unique(was).tolist():
                if len(borders.get(r, ())):
                    mine = was == r
                    place[mine] += above(borders[r], keys[mine])
            yield batch.set_column(batch.schema.get_field_index("range"), "range", pa.array(place))

    return rows.mapInArrow(run, rows.schema)


def ranged(rows: DataFrame, splits: int = SPLITS, most: int = RANGE_ROWS) -> tuple[DataFrame, np.ndarray]:
    """rows with a range none of which holds more than `most` rows, numbered in key order; and each range's rows and bytes."""
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    ranges = np.array([(n, total)], dtype=[("rows", "i8"), ("bytes", "i8")])
    rows, wanted, level = rows.withColumn("range", F.lit(0).cast("long")), {0: splits} if n else {}, 0
    while wanted:
        borders = splitters(rows, ranges, wanted, level)
        rows = written(divided(rows, borders, len(ranges)), "ranged")
        ranges = np.zeros(len(ranges) + sum(map(len, borders.values())), ranges.dtype)
        for r in rows.groupBy("range").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes")).collect():  # some 2 rows for each `most` rows
            ranges[r["range"]] = r["rows"], r["bytes"]
        wanted = {int(r): min(splits, int(2 * ranges["rows"][r] // most) + 1) for r in np.flatnonzero(ranges["rows"] > most)}
        level += 1
    return rows, ranges


def shard(docs: DataFrame, shards: int = SHARDS, splits: int = SPLITS, most: int = RANGE_ROWS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row of docs(doc_id, text)."""
    rows, ranges = ranged(sized(docs), splits, most)
    before = {c: np.concatenate(([0], np.cumsum(ranges[c])[:-1])) for c in ("rows", "bytes")}
    starts = [(r, int(before["rows"][r]), int(before["bytes"][r])) for r in range(len(ranges))]
    starts = docs.sparkSession.createDataFrame(starts, "range long, rows_before long, bytes_before long")
    inside = Window.partitionBy("range").orderBy(*KEY).rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumns({"start": F.coalesce(F.sum("size").over(inside), F.lit(0)), "rank": F.count("*").over(inside)}).join(starts, "range")
    placed = placed.withColumn("shard", F.expr(f"cast((2 * (bytes_before + start) + size) * {shards} div {2 * max(1, int(ranges['bytes'].sum()))} as int)"))
    doc_id = F.when(F.col("has_id"), F.col("id")).alias("doc_id")
    placed = written(placed.select(doc_id, "size", "text_crc32", "shard", (F.col("rows_before") + F.col("rank")).alias("rank")), "placed")
    first = placed.groupBy("shard").agg(F.min("rank").alias("first"))  # a row a shard
    return placed.join(F.broadcast(first), "shard").select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("rank") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


#: The same order and law over one sorted table; DuckDB has no crc32, so it is reckoned byte by byte from its polynomial.
SHARD_SQL = f"""
with recursive poly as (select range as n, range as c, 0 as k from range(256) union all select n, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, k + 1 from poly where k < 8),
tab as materialized (select list(c order by n) as crc from poly where k = 8),
t as (select doc_id, strlen(coalesce(text, '')) + 1 as size, cast('0x' || substr(md5(coalesce(text, '')), 1, 15) as bigint) as digest, coalesce(text, '') as text from documents),
u as (select text, xor(4294967295, list_reduce(list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: cast('0x' || x as bigint)), lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1]), 4294967295)) as text_crc32 from (select distinct text from t), tab),
s as (select *, sum(size) over (order by digest, doc_id nulls first rows unbounded preceding) - size as start, row_number() over (order by digest, doc_id nulls first) as place, sum(size) over () as total from t),
p as (select doc_id, size, text, place, cast((2 * start + size) * {SHARDS} // (2 * total) as int) as shard from s)
select doc_id, size, cast(text_crc32 as bigint) as text_crc32, 'bytes' as law, shard, row_number() over (partition by shard order by place) - 1 as slot, cast(null as int) as grown_shard from p join u on p.text = u.text
"""
