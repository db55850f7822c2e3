"""Values that recur often enough to be the sender's own.

Counting is a plain two-phase aggregation.  The running (as-of) forms never put the whole
history of a value or tenant into one task: time is cut into chunks, chunk totals are
prefix-summed, and only the rows of one chunk are walked in order.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leakscope.functions.catalog import IDENTITY_KIND, SENSITIVE
from leakscope.session import cut_lineage

# --- fixed values ------------------------------------------------------------
THRESHOLD = 5
DECAY_HOURS = 24
CAP = {"email": 1, "ip": 2}
_OTHER_CAP = 1
KEY = ("tenant_id", "kind", "value")
#: The only patterns whose hits are signals; a scan for signals alone asks for no others.
PATTERNS = tuple(p for p in SENSITIVE if p.name in IDENTITY_KIND)


def normalise(kind: Column, value: Column) -> Column:
    bare = F.trim(value)
    return F.when(kind == "email", F.lower(bare)).otherwise(bare)


def kind_of(name: Column) -> Column:
    pairs = [F.lit(x) for item in IDENTITY_KIND.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), name)


def signals(scanned: DataFrame, hits: str = "re_hits", tenant: str = "tenant_id",
            ts: str = "ts", event: str = "event_id") -> DataFrame:
    """One row per identity-kind hit: tenant_id, kind, value, ts, event_id."""
    rows = scanned.select(F.col(tenant).alias("tenant_id"), F.col(ts).alias("ts"),
                          F.col(event).alias("event_id"), F.explode(hits).alias("h"))
    rows = rows.withColumn("kind", kind_of(F.col("h.name"))).filter(
        F.col("kind").isNotNull() & (F.length("h.raw") > 0))
    return rows.select("tenant_id", "kind",
                       normalise(F.col("kind"), F.col("h.raw")).alias("value"),
                       "ts", "event_id")


def count_signals(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*KEY).agg(F.count("*").alias("count"), F.min("ts").alias("first_seen"),
                                  F.max("ts").alias("last_seen"))


def merge_counts(state: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert: counts add up, the first sighting stays, the last one moves."""
    return state.unionByName(new).groupBy(*KEY).agg(
        F.sum("count").alias("count"), F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"))


def forget(state: DataFrame, retracted: DataFrame) -> DataFrame:
    gone = retracted.withColumn("value", normalise(F.col("kind"), F.col("value")))
    return state.join(gone, list(KEY), "left_anti")


def cap_of(kind: Column) -> Column:
    chain = F.lit(_OTHER_CAP)
    for name, cap in CAP.items():
        chain = F.when(kind == name, cap).otherwise(chain)
    return chain


def qualified(state: DataFrame, as_of: Column, threshold: int = THRESHOLD,
              decay_hours: int = DECAY_HOURS) -> DataFrame:
    """Most frequent recent values per tenant and kind, at most the cap of the kind.

    The literal bound lets Spark keep only the first few rows per group before the shuffle.
    """
    recent = state.filter((F.col("count") >= threshold) & (
        F.col("last_seen") >= as_of - F.expr(f"INTERVAL {decay_hours} HOURS")))
    order = Window.partitionBy("tenant_id", "kind").orderBy(
        F.col("count").desc(), F.col("last_seen").desc(), F.col("value"))
    ranked = recent.withColumn("rank", F.row_number().over(order))
    return ranked.filter(F.col("rank") <= max(CAP.values())).filter(
        F.col("rank") <= cap_of(F.col("kind")))


def owned_by(values: DataFrame, owned: DataFrame) -> DataFrame:
    """The (tenant, kind, value) rows whose value is user-owned."""
    asked = values.withColumn("value", normalise(F.col("kind"), F.col("value")))
    return asked.join(owned.select(*KEY), list(KEY), "left_semi")


def shown_value(kind: Column, value: Column) -> Column:
    """Emails show two characters of a longer local part, and the domain."""
    local = F.substring_index(value, "@", 1)
    domain = F.substring(value, F.length(local) + 2, F.length(value))
    masked = F.concat(F.when(F.length(local) > 2, F.concat(F.left(local, F.lit(2)),
                                                          F.lit("***")))
                      .otherwise(F.lit("***")), F.lit("@"), domain)
    return F.when((kind == "email") & F.contains(value, F.lit("@")), masked).otherwise(value)


def _chunk_of(ts: str, seconds: int) -> Column:
    return F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / (seconds * 1_000_000))


def _per_event(rows: DataFrame, chunk_seconds: int) -> DataFrame:
    """Hits per event and value.  Written once: what follows reads it several times, the
    scanned texts below it are read one time."""
    return cut_lineage(rows.groupBy(*KEY, "ts", "event_id").agg(F.count("*").alias("n")).withColumn(
        "chunk", _chunk_of("ts", chunk_seconds)))


def _chunk_state(events: DataFrame) -> DataFrame:
    """Per value and chunk: totals before and after it, and the value's next chunk."""
    totals = events.groupBy(*KEY, "chunk").agg(F.sum("n").alias("n"),
                                               F.max("ts").alias("last"))
    by_chunk = Window.partitionBy(*KEY).orderBy("chunk")
    return totals.select(
        *KEY, "chunk", "last",
        F.sum("n").over(by_chunk.rowsBetween(Window.unboundedPreceding, 0)).alias("after"),
        (F.sum("n").over(by_chunk.rowsBetween(Window.unboundedPreceding, 0))
         - F.col("n")).alias("before"),
        F.lead("chunk").over(by_chunk).alias("next_chunk"))


def running_counts(rows: DataFrame, threshold: int = THRESHOLD,
                   chunk_seconds: int = 3600) -> DataFrame:
    """Per event and value: the count so far, this event included, and whether it qualifies."""
    events = _per_event(rows, chunk_seconds)
    base = _chunk_state(events).select(*KEY, "chunk", "before")
    within = Window.partitionBy(*KEY, "chunk").orderBy("ts", "event_id").rowsBetween(
        Window.unboundedPreceding, 0)
    return (events.withColumn("_in_chunk", F.sum("n").over(within))
            .join(base, [*KEY, "chunk"])
            .withColumn("running", F.col("before") + F.col("_in_chunk"))
            .select(*KEY, "ts", "event_id", "n", "running",
                    (F.col("running") >= threshold).alias("qualifies")))


_WALKED = ["tenant_id", "kind", "value", "at", "event_id", "n", "running", "exempt"]


def _walk(threshold: int, decay_hours: int):
    """Walk rows sorted by tenant, kind, chunk and time; the counts known at the start of a
    chunk come before its events.  Works on whole Arrow batches, so many small groups cost
    no more than a few large ones; what is kept is the counts of one chunk."""
    decay = decay_hours * 3_600_000_000

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # `strong`: the values at or over the threshold, the only ones that can be on top
        group, seen, strong, event = None, {}, {}, []

        def settle() -> list[tuple]:
            """Count every hit of the event, then check them all."""
            if not event:
                return []
            kind, at = event[0][1], event[0][3]
            for row in event:
                seen[row[2]] = (seen.get(row[2], (0, at))[0] + int(row[5]), at)
                if seen[row[2]][0] >= threshold:
                    strong[row[2]] = seen[row[2]]
            for value in [v for v, (_, last) in strong.items() if last < at - decay]:
                del strong[value]     # back in when it is seen again
            best = heapq.nsmallest(CAP.get(kind, _OTHER_CAP), (
                (-count, -last, value) for value, (count, last) in strong.items()))
            top = {value for _, _, value in best}
            done = [(*row, seen[row[2]][0], row[2] in top) for row in event]
            event.clear()
            return done

        for batch in batches:
            out: list[tuple] = []
            columns = (batch[c] for c in ("tenant_id", "kind", "value", "at", "event_id", "n",
                                          "chunk", "is_event"))
            for *row, chunk, is_event in zip(*columns):
                key = (row[0], row[1], chunk)
                if key != group:
                    out += settle()
                    group, seen, strong = key, {}, {}
                if not is_event:
                    seen[row[2]] = (int(row[5]), row[3])
                    if int(row[5]) >= threshold:
                        strong[row[2]] = seen[row[2]]
                    continue
                if event and (event[0][3], event[0][4]) != (row[3], row[4]):
                    out += settle()
                event.append(tuple(row))
            yield pd.DataFrame(out, columns=_WALKED)
        yield pd.DataFrame(settle(), columns=_WALKED)

    return walk


def running_exemption(rows: DataFrame, state: DataFrame | None = None,
                      threshold: int = THRESHOLD, decay_hours: int = DECAY_HOURS,
                      chunk_seconds: int = 3600) -> DataFrame:
    """Per event and value: is it one of the top recent values at that moment?

    Exact and order-dependent: every hit of an event is counted, then all are checked.
    The state at the start of each chunk is computed relationally, so chunks of the same
    tenant are walked independently.  Values that never reach the threshold only count
    their own hits and skip the walk.
    """
    events = _per_event(rows, chunk_seconds)
    if state is not None:
        known = state.select(*KEY, F.lit(None).cast(events.schema["event_id"].dataType)
                             .alias("event_id"),
                             F.col("last_seen").alias("ts"), F.col("count").alias("n"))
        # known counts end before the chunk they were last seen in
        known = known.withColumn("chunk", _chunk_of("ts", chunk_seconds) - 1)
        history = events.unionByName(known)
    else:
        history = events
    frequent = history.groupBy(*KEY).agg(F.sum("n").alias("_total")).filter(
        F.col("_total") >= threshold).select(*KEY)
    walked = events.join(frequent, list(KEY), "left_semi")
    rare = events.join(frequent, list(KEY), "left_anti")
    chunks = _chunk_state(history.join(frequent, list(KEY), "left_semi"))
    reach = (decay_hours * 3600) // chunk_seconds + 1
    upcoming = F.coalesce("next_chunk", F.col("chunk") + reach)
    carried = chunks.select(
        "tenant_id", "kind", "value", F.col("after").alias("count"),
        F.col("last").alias("last_seen"),
        F.explode(F.array_distinct(F.concat(
            F.sequence(F.col("chunk") + 1, F.least(upcoming, F.col("chunk") + reach)),
            F.array(upcoming)))).alias("chunk"))
    active = walked.select("tenant_id", "kind", "chunk").distinct()
    carried = carried.join(active, ["tenant_id", "kind", "chunk"], "left_semi")
    group = ["tenant_id", "kind", "chunk"]
    types = {f.name: f.dataType.simpleString() for f in events.schema.fields}
    at = F.unix_micros(F.col("ts").cast("timestamp")).alias("at")
    event_rows = walked.select("tenant_id", "kind", "value", at, "event_id", "n", "chunk",
                               F.lit(True).alias("is_event"))
    state_rows = carried.select(
        "tenant_id", "kind", "value",
        F.unix_micros(F.col("last_seen").cast("timestamp")).alias("at"),
        F.lit(None).cast(types["event_id"]).alias("event_id"), F.col("count").alias("n"),
        "chunk", F.lit(False).alias("is_event"))
    # by number: a size-based coalesce would leave a small input to one Python worker
    width = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = event_rows.unionByName(state_rows).repartition(width, *group).sortWithinPartitions(
        *group, "is_event", "at", "event_id")
    schema = (f"tenant_id {types['tenant_id']}, kind string, value string, at bigint, "
              f"event_id {types['event_id']}, n bigint, running bigint, exempt boolean")
    exact = ordered.mapInPandas(_walk(threshold, decay_hours), schema).select(
        *KEY, F.timestamp_micros("at").cast(types["ts"]).alias("ts"), "event_id", "n",
        "running", "exempt")
    by_value = Window.partitionBy(*KEY).orderBy("ts", "event_id").rowsBetween(
        Window.unboundedPreceding, 0)   # fewer than `threshold` hits per value by construction
    return exact.unionByName(rare.select(
        *KEY, "ts", "event_id", "n", F.sum("n").over(by_value).alias("running"),
        F.lit(False).alias("exempt")))
