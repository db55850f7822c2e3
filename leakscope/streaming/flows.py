"""Structured Streaming forms of the batch operators.

Every stateful step keeps its state in the state store (chunk assembly, identity counts,
rollups, pairing); what a micro-batch has to read as a whole, the values that qualify now, is
a small versioned table next to it. A lost executor or a restarted query goes on from the last
committed batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from leakscope.operators import identity as idn
from leakscope.operators import registry as rg
from leakscope.operators.classify import classify_requests, scan_texts
from leakscope.session import ROCKSDB, is_there, remove_folder

AVAILABLE_NOW = {"availableNow": True}


def read_table_stream(spark: SparkSession, folder: str, name: str,
                      files_per_batch: int = 1000) -> DataFrame:
    """One table as a stream: a single parquet file or a folder of part files."""
    path = f"{folder}/{name}.parquet"
    stream = spark.readStream.schema(spark.read.parquet(path).schema).option(
        "maxFilesPerTrigger", files_per_batch)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory():
        return stream.parquet(path)
    return stream.option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def run_to_end(query: StreamingQuery) -> None:
    query.awaitTermination()


def score_stream(texts: DataFrame, out: str, checkpoint: str, text: str = "text",
                 path: str | None = None, trigger: dict | None = None) -> StreamingQuery:
    """Score a stream with the batch expressions; narrow, so an append sink needs no state."""
    scored = classify_requests(texts, text, path=path)
    return (scored.writeStream.format("parquet").option("path", out)
            .option("checkpointLocation", checkpoint).outputMode("append")
            .trigger(**(trigger or AVAILABLE_NOW)).start())


def keyed_state(spark: SparkSession) -> None:
    """State variables need the on-disk state store; a commit then writes what changed."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


def state_size(query: StreamingQuery) -> dict[str, int]:
    """Rows and bytes that the state store holds after the last micro-batch."""
    parts = query.lastProgress["stateOperators"] if query.lastProgress else []
    return {"rows": sum(p["numRowsTotal"] for p in parts), "bytes": sum(p["memoryUsedBytes"] for p in parts)}


def score_flows(flows: DataFrame, registry: Callable[[int], DataFrame], out: str, checkpoint: str,
                trigger: dict | None = None) -> StreamingQuery:
    """Score flows to monitored hosts; ``registry(batch number)`` is asked in every micro-batch.

    With ``rg.published_for`` each batch takes the newest version and a retry the one it took
    before. A batch is written under its own number and overwritten on a retry, so each flow
    counts once.
    """
    def write(batch: DataFrame, number: int) -> None:
        known = rg.with_provider(batch, registry(number))
        (classify_requests(known, "text", path="path")
         .write.mode("overwrite").parquet(f"{out}/batch={number}"))

    return (flows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or AVAILABLE_NOW)).start())


class _Sightings(StatefulProcessor):
    """Count, first and last sighting of the values of one slot; hands each row on with what was
    known of its value before the micro-batch. Rows pass through, so a busy value is not held."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "who string", "count bigint, first bigint, last bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before, after = {}, {}
        for frame in rows:
            found = frame.groupby("who", sort=False)["at"].agg(["size", "min", "max"])
            for who, n, low, high in zip(found.index, *(found[c].tolist() for c in found)):
                if who not in before:
                    before[who] = after[who] = self.seen.getValue((who,)) or (0, 0, 0)
                count, first, last = after[who]
                after[who] = (n, low, high) if not count else (count + n, min(first, low), max(last, high))
            prior = pd.DataFrame([before[who] for who in found.index], index=found.index,
                                 columns=["prior", "prior_first", "prior_last"])
            yield frame.drop(columns="slot").join(prior, "who").drop(columns="who")
        for who, counts in after.items():
            self.seen.updateValue((who,), counts)

    def close(self) -> None:
        pass


#: Groups that the values of an identity stream are kept in; a checkpoint is bound to it.
SLOTS = 1024


def identity_stream(texts: DataFrame, out: str, state: str, checkpoint: str,
                    trigger: dict | None = None, late_hours: int = idn.DECAY_HOURS) -> StreamingQuery:
    """Running identity exemption over micro-batches.

    The state store keeps the count of each value, in SLOTS maps by hash, and is read and written
    for the values of the batch alone. Which of them are on top also depends on values that the batch does not hold:
    ``state`` has a version per batch of those that qualify, seen ``threshold`` times and in the
    last 24 hours. A value idle for that long, plus the ``late_hours`` by which events may come
    late, leaves it; seen again, it comes back with its count. The last two versions are kept:
    a retry of batch n reads n-1 and writes n. Rows without a time are left out.
    """
    signals = idn.signals(scan_texts(texts.select("tenant_id", "ts", "event_id", "text"),
                                     sensitive=idn.PATTERNS)).where("ts is not null")
    keyed_state(texts.sparkSession)
    kinds = {f.name: f.dataType.simpleString() for f in signals.schema.fields}
    who = F.to_json(F.struct(*idn.KEY))
    prior = signals.select(
        *idn.KEY, "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), who.alias("who"),
        F.pmod(F.xxhash64(*idn.KEY), F.lit(SLOTS)).alias("slot")).groupBy("slot").transformWithStateInPandas(
        _Sightings(), f"tenant_id {kinds['tenant_id']}, kind string, value string, event_id {kinds['event_id']}, "
        "at bigint, prior bigint, prior_first bigint, prior_last bigint", "append", "none")

    def time(column: str):
        return F.timestamp_micros(column).cast(kinds["ts"])

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        came = f"{state}/rows={number}"
        batch.write.mode("overwrite").parquet(came)      # the state is advanced once
        batch = spark.read.schema(batch.schema).parquet(came)
        rows = batch.select(*idn.KEY, time("at").alias("ts"), "event_id")
        known = batch.where("prior > 0").groupBy(*idn.KEY).agg(
            F.max("prior").alias("count"), F.min(time("prior_first")).alias("first_seen"),
            F.max(time("prior_last")).alias("last_seen"))
        before = f"{state}/version={number - 1}"
        if is_there(spark, before):
            strong = spark.read.schema(known.schema).parquet(before)
            known = known.unionByName(strong.join(known, list(idn.KEY), "left_anti"))
        newest = rows.agg(F.max("ts")).first()[0]
        after = idn.merge_counts(known, idn.count_signals(rows)).where(F.col("count") >= idn.THRESHOLD)
        if newest is not None:
            after = after.where(F.col("last_seen") >= F.lit(newest) - F.expr(
                f"INTERVAL {idn.DECAY_HOURS + late_hours} HOURS"))
        after.write.mode("overwrite").parquet(f"{state}/version={number}")
        (idn.running_exemption(rows, known)
         .write.mode("overwrite").parquet(f"{out}/batch={number}"))
        remove_folder(spark, came)
        remove_folder(spark, f"{state}/version={number - 2}")

    return (prior.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or AVAILABLE_NOW)).start())


class _Assembler(StatefulProcessor):
    """Holds the chunks of one flow until the end marker and every chunk before it are there;
    emits in order of their numbers. Idle flows are emitted as far as they came.

    A chunk is an entry of its own in the state, so a micro-batch writes the new chunks only.
    """

    def __init__(self, cap_bytes: int | None, idle_ms: int | None, forget_ms: int | None) -> None:
        self.cap_bytes, self.idle_ms = cap_bytes, idle_ms
        self.forget_ms = forget_ms if idle_ms is not None else None

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getMapState("held", "seq int", "chunk binary")
        self.progress = handle.getValueState("progress", "held int, last int")
        self.done = handle.getValueState("done", "done boolean", self.forget_ms)

    def _emit(self, flow: str) -> pd.DataFrame:
        held = sorted((seq, bytes(part)) for (seq,), (part,) in self.held.iterator())
        self.held.clear()
        self.progress.clear()
        body = b"".join(part for _, part in held)
        return pd.DataFrame({"flow_id": [flow], "chunks": [len(held)],
                             "body": [body if self.cap_bytes is None else body[:self.cap_bytes]]})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if self.done.exists():      # late repeats of a flow that was emitted
            return
        held, last = self.progress.get() or (0, -1)
        for frame in rows:
            for seq, part, end in zip(frame["seq"], frame["chunk"], frame["is_last"]):
                if not self.held.containsKey((int(seq),)):
                    self.held.updateValue((int(seq),), (bytes(part or b""),))
                    held += 1
                if end:
                    last = int(seq)
        if self.idle_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
        if held == last + 1:
            yield self._emit(key[0])
            self.done.update((True,))
            return
        self.progress.update((held, last))
        if self.idle_ms is not None:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.progress.exists():
            yield self._emit(key[0])

    def close(self) -> None:
        pass


def assemble_stream(chunks: DataFrame, cap_bytes: int | None = None,
                    idle_ms: int | None = 600_000, forget_ms: int | None = 86_400_000) -> DataFrame:
    """flow_id, chunks, body of each finished flow; chunks are numbered from 0 and may come in
    any order, over any number of micro-batches. Chunks without a number are left out.

    The state of a flow is its chunks, an entry each, until it is emitted; after that a marker,
    which goes after ``forget_ms``. Flows that stay incomplete are emitted after ``idle_ms``. A
    query that has to wait for that never ends, so a bounded run (``availableNow``) passes None
    for it, and keeps its markers.
    """
    keyed_state(chunks.sparkSession)
    return chunks.where("seq is not null").select("flow_id", "seq", "chunk", "is_last").groupBy(
        "flow_id").transformWithStateInPandas(
        _Assembler(cap_bytes, idle_ms, forget_ms), "flow_id string, chunks int, body binary",
        "append", "none" if idle_ms is None else "processingTime")


def rollup_stream(events: DataFrame) -> DataFrame:
    """Live provider rollup; state is one row per provider."""
    return events.groupBy("provider").agg(
        F.count("*").alias("events"), F.avg("sensitivity").alias("avg_sensitivity"),
        F.max("sensitivity").alias("max_sensitivity"), F.sum("bytes_out").alias("bytes_out"))


def pair_stream(requests: DataFrame, responses: DataFrame, late: str = "10 minutes",
                reply_within: str = "1 hour", keep_unmatched: bool = True) -> DataFrame:
    """Responses with their requests in flight; watermarks let finished pairs leave the state.

    As in the batch form a response without a request is kept, with nulls for the request: it
    comes out once the watermark has passed the time in which its request could have come.
    """
    q = requests.withWatermark("request_ts", late).withColumnRenamed("flow_id", "_asked_flow")
    a = responses.withWatermark("response_ts", late)
    return q.join(a, F.expr(
        f"_asked_flow = flow_id AND response_ts >= request_ts "
        f"AND response_ts <= request_ts + INTERVAL {reply_within}"),
        "rightOuter" if keep_unmatched else "inner").drop("_asked_flow")


def alert_baseline(stored: DataFrame, mark: str) -> int:
    """Highest id among the events stored when alerts were first started: what is history.

    Written to ``mark`` once; every restart reads it there, whatever was stored since.
    """
    spark = stored.sparkSession
    if not is_there(spark, f"{mark}/_SUCCESS"):
        stored.agg(F.coalesce(F.max("id").cast("bigint"), F.lit(-1)).alias("id")).write.mode(
            "overwrite").parquet(mark)
    return spark.read.parquet(mark).first()["id"]


def alert_stream(events: DataFrame, notify: Callable[[DataFrame, int], None], checkpoint: str,
                 after_id: int | None = None, trigger: dict | None = None) -> StreamingQuery:
    """Hand critical responses to ``notify(rows, batch number)``, oldest first.

    The checkpoint remembers what was seen.  A batch that is retried comes again under its
    number, so a sink that overwrites by number reports nothing twice.  Events up to
    ``after_id`` are history and not reported; ``alert_baseline`` gives it.
    """
    critical = events.filter((F.col("direction") == "response")
                             & (F.col("label") == "critical"))
    if after_id is not None:
        critical = critical.filter(F.col("id") > after_id)
    return (critical.writeStream.foreachBatch(lambda batch, n: notify(batch.orderBy("id"), n))
            .option("checkpointLocation", checkpoint)
            .trigger(**(trigger or AVAILABLE_NOW)).start())
