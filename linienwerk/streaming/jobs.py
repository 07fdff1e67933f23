"""Structured Streaming jobs on logs, requests and shared journeys."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from linienwerk.operators.usage import parse_log


def stream_daily_access(lines: DataFrame, late: str = "1 day") -> DataFrame:
    """``line → (day, hits, plans, unique_ips, bots)`` for days that the watermark has closed; later lines are dropped.

    A first aggregation holds a row for each day and address that are still
    open, a second one adds those of a day up, so addresses are counted exactly.
    """
    p = parse_log(lines).withColumn("ts", F.col("day").cast("timestamp")).withWatermark("ts", late)
    man = ~F.col("bot")
    each = p.groupBy(F.window("ts", "1 day").alias("span"), "ip").agg(F.count_if(man).alias("hits"), F.count_if(man & F.col("plan")).alias("plans"), F.count_if(F.col("bot")).alias("bots"))
    g = each.groupBy(F.window("span", "1 day").alias("span")).agg(F.sum("hits").alias("hits"), F.sum("plans").alias("plans"), F.count_if(F.col("hits") > 0).alias("unique_ips"), F.sum("bots").alias("bots"))
    return g.select(F.col("span.start").cast("date").alias("day"), "hits", "plans", "unique_ips", "bots")


def stream_create_once(creates: DataFrame, key: str = "share_id", ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """The first record of each id within the watermark."""
    return creates.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def stream_latest_wins(queries: DataFrame, key: str, ts: str, value: str, gap: str, late: str = "10 minutes") -> DataFrame:
    """The last query of each burst, once its pause is over."""
    g = queries.withWatermark(ts, late).groupBy(F.session_window(ts, gap), key).agg(F.count("*").alias("n"), F.max_by(value, ts).alias("last"))
    return g.select(key, F.col("session_window.start").alias("start"), "n", "last")


class Throttle(StatefulProcessor):
    """Keeps the accepted stamps of the keys of a bucket, at most ``most`` of a key in a span of ``seconds``, and the events that the watermark hasn't passed.

    Events are judged in the order of time when the watermark passes them, so
    that it doesn't matter in which micro-batch they came. A timer stands for
    the next event to judge, or else for the end of the last stamp, when
    nothing of the bucket is kept any longer. Both tables are kept as Arrow
    bytes, so a micro-batch costs a few calls a bucket, not a few a key.
    """

    def __init__(self, key: str, ts: str, seconds: int, most: int, waiting: StructType, tie: tuple[str, ...]):
        self.key, self.ts, self.seconds, self.most, self.waiting_schema, self.tie = key, ts, seconds, most, waiting, tie

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", StructType([StructField("waiting", BinaryType()), StructField("stamps", BinaryType())]))
        self.events = to_arrow_schema(self.waiting_schema)
        self.stamps = pa.schema([("key", self.events.field(self.key).type), ("t", pa.int64())])

    def read(self) -> tuple[pa.Table, pa.Table]:
        if not self.state.exists():
            return self.events.empty_table(), self.stamps.empty_table()
        return tuple(pa.ipc.open_stream(bytes(x)).read_all() for x in self.state.get())

    def write(self, *tables: pa.Table) -> None:
        out = []
        for t in tables:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, t.schema) as w:
                w.write_table(t)
            out.append(sink.getvalue().to_pybytes())
        self.state.update(tuple(out))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new, first = [], None
        for pdf in rows:
            micros = pdf[self.ts].astype("datetime64[us]").astype("int64")
            new.append(pa.Table.from_pandas(pdf.assign(**{self.ts: micros})[self.waiting_schema.names], self.events, preserve_index=False).replace_schema_metadata(None))
            first = int(micros.min()) if first is None else min(first, int(micros.min()))
        if new:
            waiting, stamps = self.read()
            self.write(pa.concat_tables([waiting, *new]).combine_chunks(), stamps)
            self.handle.registerTimer(first // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, span = timerValues.getCurrentWatermarkInMs() * 1000, self.seconds * 1_000_000
        waiting, stamps = self.read()
        held: dict = {}
        for k, t in zip(stamps["key"].to_pylist(), stamps["t"].to_pylist(), strict=True):
            held.setdefault(k, []).append(t)
        passed = pc.less(waiting[self.ts], now)
        ready, rest = waiting.filter(passed), waiting.filter(pc.invert(passed))
        place = ready.select([self.ts, *self.tie]).to_pandas().sort_values([self.ts, *self.tie], kind="stable").index
        ready = ready.take(pa.array(place.to_numpy()))
        said = []
        for k, t in zip(ready[self.key].to_pylist(), ready[self.ts].to_pylist(), strict=True):
            mine = [x for x in held.get(k, ()) if x > t - span]
            said.append(len(mine) < self.most)
            if said[-1]:
                mine.append(t)
            held[k] = mine
        left = [(k, t) for k, mine in held.items() for t in mine if t > now - span]
        if len(rest) or left:
            self.write(rest.combine_chunks(), pa.table([[k for k, _ in left], [t for _, t in left]], schema=self.stamps))
            next_ = pc.min(rest[self.ts]).as_py() if len(rest) else max(t for _, t in left) + span
            self.handle.registerTimer(next_ // 1000 + 1)
        else:
            self.state.clear()
        if len(ready):
            yield ready.to_pandas().assign(**{self.ts: pd.to_datetime(ready[self.ts].to_pandas(), unit="us"), "accepted": said})

    def close(self) -> None:
        pass


def stream_throttle(events: DataFrame, key: str, ts: str, seconds: int = 60, most: int = 10, late: str = "10 seconds", tie: tuple[str, ...] = (), buckets: int = 1024) -> DataFrame:
    """Events with ``accepted``, once the watermark has passed them; later ones are dropped. Equal times go by ``tie``, then as they came.

    Keys share ``buckets`` of state. A bucket's state is at most ``most`` stamps
    a key and the events of the last ``late``, and goes when both have run out.
    Needs the RocksDB state store.
    """
    waiting = StructType([StructField(f.name, LongType() if f.name == ts else f.dataType) for f in events.schema])
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in events.schema) + ", accepted boolean"
    dealt = events.withWatermark(ts, late).withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(buckets)))
    return dealt.groupBy("_bucket").transformWithStateInPandas(Throttle(key, ts, seconds, most, waiting, tie), schema, outputMode="Append", timeMode="EventTime")
