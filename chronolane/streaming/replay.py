"""The same rules on a stream: per-row lateness, idempotent deliveries, append-only sinks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.timing import asof_state


def read_quotes(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    """Quotes from Parquet files that arrive in a folder."""
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def gated(stream: DataFrame, available: str, cutoff: str, kickoff: str) -> DataFrame:
    """Each row with its as-of state. Lateness is the row's own cutoff, so no watermark is involved."""
    return stream.withColumn("gate_state", asof_state(available, cutoff, kickoff))


def once(stream: DataFrame, key: list[str], at: str, horizon: str = "1 day") -> DataFrame:
    """The first delivery of each key; a key is remembered for the horizon after its event time."""
    return stream.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", horizon).dropDuplicatesWithinWatermark(key).drop("_at")


def judged(stream: DataFrame, key: str, content: str, at: str, seq: str, horizon_days: int = 1) -> DataFrame:
    """(key, seq, content, delivery) of each row at once: ACCEPTED, DUPLICATE_NOOP or KEY_CONFLICT against the first that came.

    Rows of one micro-batch are judged in order of seq, as `identity.deliveries` judges a batch; between micro-batches
    what came first is first, whatever its seq (`settled` waits instead). Null contents equal each other. A key's first
    content is forgotten once the watermark passes its latest event time by the horizon: a delivery after
    that is ACCEPTED anew. A row without event time comes out as NO_EVENT_TIME.
    """
    horizon = horizon_days * 86_400_000

    def step(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values("seq", kind="stable")  # one key's rows of one micro-batch
        contents = [None if pd.isna(x) else x for x in rows["content"]]
        first, latest = state.get if state.exists else (contents[0], 0)
        out = ["ACCEPTED" if i == 0 and not state.exists else "DUPLICATE_NOOP" if x == first else "KEY_CONFLICT" for i, x in enumerate(contents)]
        latest = max(latest, int(rows["at"].max().timestamp() * 1000))
        state.update((first, latest))
        state.setTimeoutTimestamp(max(latest + horizon, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"key": keys[0], "seq": rows["seq"].to_numpy(), "content": contents, "delivery": out})

    rows = _delivered(stream, key, content, at, seq)
    timed = rows.where("at is not null").withWatermark("at", f"{horizon_days} days")
    out = timed.groupBy("key").applyInPandasWithState(step, "key string, seq long, content string, delivery string", "first string, latest long", "append", GroupStateTimeout.EventTimeTimeout)
    return out.unionByName(_timeless(rows))


def _delivered(stream: DataFrame, key: str, content: str, at: str, seq: str) -> DataFrame:
    return stream.select(F.col(key).cast("string").alias("key"), F.col(content).cast("string").alias("content"), F.col(at).cast("timestamp").alias("at"), F.col(seq).cast("long").alias("seq"))


def _timeless(rows: DataFrame) -> DataFrame:
    return rows.where("at is null").select("key", "seq", "content", F.lit("NO_EVENT_TIME").alias("delivery"))


class _Judge(StatefulProcessor):
    """The deliveries of a bucket of keys: a key's are kept until the watermark is past the first of them by the horizon, then judged by seq; later ones at once.

    The bucket's states are lists that are read and written as a whole, and its one timer is that of the key that is due next,
    so the calls to the store follow the buckets and not the keys.
    """

    def __init__(self, horizon: int):
        self.horizon = horizon  # milliseconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "key string, seq long, content string, due long")  # due: when the row's key can be judged
        self.first = handle.getListState("first", "key string, content string, due long")  # due: when the key is forgotten
        self.due = handle.getValueState("due", "at long")

    def remind(self, at: int) -> None:
        """A timer at a time, unless there is an earlier one."""
        if self.due.exists():
            before = self.due.get()[0]
            if before <= at:
                return
            self.handle.deleteTimer(before)
        self.due.update((at,))
        self.handle.registerTimer(at)

    @staticmethod
    def store(state, rows: list[tuple]) -> None:
        state.put(rows) if rows else state.clear()

    @staticmethod
    def judged(key: str | None, rows: list[tuple], accepted: bool, content: str | None) -> list[tuple]:
        """(key, seq, content, delivery) of rows(seq, content) in order; the first of them is the accepted one if none was before."""
        return [(key, seq, c, "ACCEPTED" if k == 0 and not accepted else "DUPLICATE_NOOP" if c == content else "KEY_CONFLICT") for k, (seq, c) in enumerate(rows)]

    @staticmethod
    def frame(rows: list[tuple]) -> pd.DataFrame:
        key, seq, content, delivery = zip(*rows)
        return pd.DataFrame({"key": list(key), "seq": pd.array(seq, "Int64"), "content": list(content), "delivery": list(delivery)})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        first = {k: (c, due) for k, c, due in self.first.get()} if self.first.exists() else {}
        wait, late = [], {}
        for batch in rows:
            names, seqs, contents = (batch[c].astype(object).where(batch[c].notna(), None) for c in ("key", "seq", "content"))
            for k, s, c, ms in zip(names, seqs, contents, batch["ms"]):
                s, at = None if s is None else int(s), max(int(ms) + self.horizon, now + 1)
                if k in first:
                    late.setdefault(k, []).append((s, c))
                    first[k] = first[k][0], max(first[k][1], at)
                else:
                    wait.append((k, s, c, at))
        if wait:
            self.waiting.appendList(wait)
            self.remind(min(r[3] for r in wait))
        if late:
            self.first.put([(k, *x) for k, x in first.items()])
            yield self.frame([r for k, x in late.items() for r in self.judged(k, sorted(x, key=_by_seq), True, first[k][0])])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        self.due.clear()
        first = [r for r in self.first.get() if r[2] >= now] if self.first.exists() else []
        groups, rest, out = {}, [], []
        for k, s, c, due in self.waiting.get() if self.waiting.exists() else []:
            groups.setdefault(k, []).append((s, c, due))
        for k, rows in groups.items():
            due = min(r[2] for r in rows)
            if due >= now:
                rest += [(k, *r) for r in rows]
                continue
            rows = sorted((r[:2] for r in rows), key=_by_seq)
            first.append((k, rows[0][1], max(due + self.horizon, now + 1)))
            out += self.judged(k, rows, False, rows[0][1])
        self.store(self.first, [tuple(r) for r in first])
        self.store(self.waiting, rest)
        if first or rest:
            self.remind(min([r[2] for r in first] + [r[3] for r in rest]))
        if out:
            yield self.frame(out)

    def close(self) -> None:
        pass


def _by_seq(row: tuple) -> tuple:
    return row[0] is None, row[0] or 0


#: Buckets of keys, each with a state of its own; a stream keeps their number for its life.
BUCKETS = 512


def settled(stream: DataFrame, key: str, content: str, at: str, seq: str, horizon_days: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """(key, seq, content, delivery) of each row: ACCEPTED, DUPLICATE_NOOP or KEY_CONFLICT, as `identity.deliveries` judges a batch.

    Rows may arrive over any number of micro-batches and in any order within the horizon: a key's deliveries are
    kept in its state until the watermark, which follows the latest event time by the horizon, is past the
    first of them by the horizon again, so one with a smaller seq is there by then; then the smallest seq is
    accepted. What comes later is judged at once, until a further horizon has gone by and the key is
    forgotten. Null contents equal each other. A row without event time cannot wait for a watermark: it comes
    out as NO_EVENT_TIME. A stream that ends leaves what still waits in its checkpoint. Keys come in buckets by their hash; a
    bucket's rows are judged in one call and fit a task. Needs the RocksDB state store, which this sets for the session where none is set.
    """
    horizon = horizon_days * 86_400_000
    conf, store = stream.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    if "RocksDB" not in conf.get(store, ""):
        conf.set(store, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = _delivered(stream, key, content, at, seq)
    timed = rows.where("at is not null").withWatermark("at", f"{horizon_days} days").withColumns({"ms": F.unix_millis("at"), "bucket": F.pmod(F.xxhash64("key"), F.lit(buckets))})
    out = timed.groupBy("bucket").transformWithStateInPandas(_Judge(horizon), "key string, seq long, content string, delivery string", "Append", "EventTime")
    return out.unionByName(_timeless(rows))


def into(stream: DataFrame, path: str, checkpoint: str):
    """Appends the stream to Parquet, exactly once by its checkpoint, with what is available now."""
    return stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
