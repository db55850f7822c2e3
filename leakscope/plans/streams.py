"""Streaming queries run to the end over the given tables; results must equal the batch."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from leakscope.functions import scoring
from leakscope.operators import registry as rg
from leakscope.plans import analytics, inputs as inp
from leakscope.plans.flows import _LOOKUP_SQL
from leakscope.plans.registry import ORACLES, query
from leakscope.session import checkpoint_dir
from leakscope.streaming import flows as st


def _folder(spark, name: str) -> str:
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Last document of the first half of the documents, which is stored before a stream starts.
_HALF = "(SELECT max(doc_id) // 2 FROM documents)"


def _in_two(spark, folder):
    """The documents as a folder that holds their first half, and what adds the second."""
    made = _folder(spark, "halves")
    rows = spark.read.parquet(f"{folder}/documents.parquet")
    half = rows.agg(F.expr("max(doc_id) div 2")).first()[0]
    first = F.col("doc_id").isNull() | (F.col("doc_id") <= F.lit(half))
    rows.filter(first).write.parquet(f"{made}/documents.parquet")
    return made, lambda: rows.filter(~first).write.mode("append").parquet(f"{made}/documents.parquet")


def _bodies(spark, folder):
    rows = st.read_table_stream(spark, folder, "documents")
    return rows.select("doc_id", "source", F.expr(inp.TEXT).alias("text"),
                       F.expr(inp.PATH).alias("path"), F.expr(inp.HOST).alias("host"))


_SCORED = f"""WITH bodies AS (SELECT doc_id, source, {inp.TEXT} AS text, {inp.PATH} AS path,
        {inp.HOST} AS host FROM documents), {inp.hits_ctes()}, {inp.scores_ctes()},
    ruled AS (SELECT *, split_part({inp.intent_sql('path', 'text')}, '|', 1) AS intent FROM scored)"""


@query("stream_scores", f"""{_SCORED}
    SELECT doc_id, intent, round(tier1 + 1e-12, 4) AS sensitivity FROM ruled""")
def stream_scores(spark, folder):
    """Documents scored as a stream into an append sink."""
    out = _folder(spark, "scores")
    st.run_to_end(st.score_stream(_bodies(spark, folder), out, _folder(spark, "offsets"),
                                  path="path"))
    return spark.read.parquet(out).select("doc_id", "intent", "sensitivity")


@query("stream_flows", f"""{_SCORED}, flows AS (SELECT DISTINCT host FROM bodies),
    {_LOOKUP_SQL},
    known AS (SELECT r.*, coalesce(doc_id > {_HALF}, false) AS late, p.provider FROM ruled r LEFT JOIN provided p USING (host)),
    monitored AS (SELECT * REPLACE (CASE WHEN late AND host = 'claude.ai' THEN NULL
        WHEN late AND host = 'example.org' THEN 'Example' ELSE provider END AS provider) FROM known),
    eff AS (SELECT *, least(1.0, tier1 * {inp.FACTOR_SQL}) AS effective FROM monitored WHERE provider IS NOT NULL),
    shown AS (SELECT provider, late, {inp.clamp_sql(inp.label_sql('effective'), inp.DEMOTED_SQL)} AS label FROM eff)
    SELECT provider, late, label, count(*) AS events FROM shown GROUP BY provider, late, label""")
def stream_flows(spark, folder):
    """Flows to monitored hosts; between two micro-batches a host is added and one disabled."""
    halves, add_second = _in_two(spark, folder)
    out, offsets = _folder(spark, "flows"), _folder(spark, "offsets")
    versions, pins = _folder(spark, "registry"), _folder(spark, "pins")

    def run():
        st.run_to_end(st.score_flows(
            _bodies(spark, halves), lambda n: rg.published_for(spark, versions, pins, n), out, offsets))

    rg.publish(rg.seed_rows(spark, "2024-01-01 00:00:00"), versions)
    run()
    asked = spark.createDataFrame([("example.org", "Example")], "host string, label string")
    changed = rg.upsert(rg.published(spark, versions), asked, F.lit("2024-01-02").cast("timestamp"))
    rg.publish(rg.set_enabled(changed, "claude.ai", False), versions)
    add_second()
    run()
    late = F.col("batch") > F.lit(0)
    return spark.read.parquet(out).groupBy("provider", late.alias("late"), "label").agg(
        F.count("*").alias("events"))


@query("stream_identity", ORACLES.get("identity_running_exempt"))
def stream_identity(spark, folder):
    """Running identity exemption over micro-batches."""
    rows = st.read_table_stream(spark, folder, "events").select(
        F.col("user_id").alias("tenant_id"), "ts", "event_id", F.expr(
            analytics._SIGNAL_TEXT.replace("user_id ||", "cast(user_id AS string) ||"))
        .alias("text"))
    out = _folder(spark, "identity")
    st.run_to_end(st.identity_stream(rows, out, _folder(spark, "state"),
                                     _folder(spark, "offsets")))
    return spark.read.parquet(out).select("tenant_id", "kind", "value", "event_id", "exempt")


@query("stream_rollup", """
    SELECT event_type AS provider, count(*) AS events, round(avg(value) + 1e-12, 6) AS avg_value,
        max(value) AS max_value, sum(event_id % 1000)::BIGINT AS bytes_out
    FROM events GROUP BY event_type""")
def stream_rollup(spark, folder):
    """Live rollup of the event table by kind of event."""
    rows = st.read_table_stream(spark, folder, "events").select(
        F.col("event_type").alias("provider"), F.col("value").alias("sensitivity"),
        (F.col("event_id") % 1000).alias("bytes_out"))
    out = _folder(spark, "rollup")
    st.run_to_end(st.rollup_stream(rows).writeStream.outputMode("complete").foreachBatch(
        lambda batch, _: batch.write.mode("overwrite").parquet(out))
        .trigger(**st.AVAILABLE_NOW).option("checkpointLocation", _folder(spark, "offsets")).start())
    return spark.read.parquet(out).select(
        "provider", "events", scoring.rounded(F.col("avg_sensitivity"), 6).alias("avg_value"),
        F.col("max_sensitivity").alias("max_value"), "bytes_out")


@query("stream_assemble", """
    SELECT conv_id::VARCHAR AS flow_id, count(*)::INT AS chunks,
        md5(string_agg(text, '' ORDER BY turn)) AS digest
    FROM conversations GROUP BY conv_id""")
def stream_assemble(spark, folder):
    """Bodies put together from streamed chunks: the turns of each conversation."""
    last = spark.read.parquet(f"{folder}/conversations.parquet").groupBy("conv_id").agg(
        F.max("turn").alias("last_turn"))
    chunks = st.read_table_stream(spark, folder, "conversations").join(last, "conv_id").select(
        F.col("conv_id").cast("string").alias("flow_id"), F.col("turn").cast("int").alias("seq"),
        F.col("text").cast("binary").alias("chunk"),
        (F.col("turn") == F.col("last_turn")).alias("is_last"))
    out = _folder(spark, "bodies")
    st.run_to_end(st.assemble_stream(chunks, idle_ms=None).writeStream.format("parquet").option("path", out)
                  .option("checkpointLocation", _folder(spark, "offsets"))
                  .outputMode("append").trigger(**st.AVAILABLE_NOW).start())
    return spark.read.parquet(out).select("flow_id", "chunks", F.md5("body").alias("digest"))


_PAIR_TS = "timestamp_seconds(1704067200 + conv_id * 3600 + turn * 60)"


@query("stream_pairs", """
    SELECT q.conv_id * 1000 + q.turn AS flow_id, length(q.text) AS asked, length(a.text) AS answered
    FROM conversations q JOIN conversations a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1
    WHERE q.role = 'user' AND a.role = 'assistant'""")
def stream_pairs(spark, folder):
    """Requests joined to their responses in flight."""
    turns = st.read_table_stream(spark, folder, "conversations").withColumn(
        "ts", F.expr(_PAIR_TS))
    asked = turns.filter("role = 'user'").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("flow_id"),
        F.col("ts").alias("request_ts"), F.length("text").cast("bigint").alias("asked"))
    answered = turns.filter("role = 'assistant'").select(
        (F.col("conv_id") * 1000 + F.col("turn") - 1).alias("flow_id"),
        F.col("ts").alias("response_ts"), F.length("text").cast("bigint").alias("answered"))
    out = _folder(spark, "pairs")
    st.run_to_end(st.pair_stream(asked, answered).writeStream.format("parquet")
                  .option("path", out).option("checkpointLocation", _folder(spark, "offsets"))
                  .outputMode("append").trigger(**st.AVAILABLE_NOW).start())
    return spark.read.parquet(out).filter("asked IS NOT NULL").select("flow_id", "asked", "answered")


@query("stream_alerts", ORACLES.get("critical_alerts", "").replace(
    "AND id > 100", f"AND id > {_HALF}") or None)
def stream_alerts(spark, folder):
    """Critical responses handed to a sink as they arrive; what was stored before is history."""
    from leakscope.operators.classify import classify_responses
    halves, add_second = _in_two(spark, folder)
    out, offsets, mark = _folder(spark, "alerts"), _folder(spark, "offsets"), _folder(spark, "mark")

    def run():
        stored = spark.read.parquet(f"{halves}/documents.parquet").select(F.col("doc_id").alias("id"))
        rows = _bodies(spark, halves).withColumn("direction", F.expr(inp.DIRECTION)).filter(
            "direction = 'response'")
        scored = classify_responses(rows, path="path").withColumn("id", F.col("doc_id")).withColumn(
            "provider", F.col("source"))
        st.run_to_end(st.alert_stream(
            scored, lambda batch, n: batch.select("id", "provider").write.mode("overwrite").parquet(
                f"{out}/batch={n}"), offsets, st.alert_baseline(stored, mark)))

    run()
    add_second()
    run()
    return spark.read.parquet(out).select("id", "provider")


# --- stored event table ------------------------------------------------------

@query("event_table_roundtrip", f"""WITH {inp.EVENTS_CTE}
    SELECT direction, label, count(*) AS events, round(sum(effective_sensitivity) + 1e-9, 4) AS total
    FROM events_log GROUP BY direction, label""")
def event_table_roundtrip(spark, folder):
    """Events appended to a partitioned table and read back."""
    from leakscope.sources import eventlog
    path = _folder(spark, "events")
    eventlog.append(inp.event_log(spark, folder, True), path)
    return eventlog.read(spark, path).groupBy("direction", "label").agg(
        F.count("*").alias("events"), F.round(
            F.sum("effective_sensitivity") + 1e-9, 4).alias("total"))


@query("purge_audit", """
    SELECT 'events' AS "table", count(*) AS rows FROM documents
    UNION ALL SELECT 'domains', 21""")
def purge_audit(spark, folder):
    """Rows an audited wipe of events and registry takes away."""
    from leakscope.sources import eventlog
    events_path, registry_path = _folder(spark, "events"), _folder(spark, "registry")
    eventlog.append(inp.event_log(spark, folder, True), events_path)
    rg.seed_rows(spark, "2024-01-01 00:00:00").write.parquet(registry_path)
    return eventlog.purge(spark, events_path, registry_path, "events_and_admin",
                          "2024-02-01 00:00:00", confirm=True)
