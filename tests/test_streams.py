"""Streams over folders of part files and several micro-batches give what the batch gives."""

import uuid

from pyspark.sql import functions as F

from leakscope.streaming import flows as st


def run(frame, tmp_path, mode="append"):
    out = f"{tmp_path}/out-{uuid.uuid4().hex}"
    st.run_to_end(frame.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}.ck")
                  .outputMode(mode).trigger(**st.AVAILABLE_NOW).start())
    return frame.sparkSession.read.parquet(out)


def parts(spark, tmp_path, name, batches, schema):
    """A table stored as a folder, one part file per batch, read one file at a time."""
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}.parquet")
    return st.read_table_stream(spark, str(tmp_path), name, files_per_batch=1)


def test_folder_of_parts_is_read_whole(spark, tmp_path):
    rows = parts(spark, tmp_path, "documents", [[(i, "a text"), (i + 10, "run rm -rf / now")] for i in range(3)], "doc_id long, text string")
    out = f"{tmp_path}/scores"
    st.run_to_end(st.score_stream(rows, out, f"{tmp_path}/ck"))
    got = {r["doc_id"]: r["label"] for r in spark.read.parquet(out).collect()}
    assert set(got) == {0, 1, 2, 10, 11, 12} and got[10] != "clean" and got[0] == "clean"


def test_one_file_is_read_alone(spark, tiny):
    assert not st.read_table_stream(spark, tiny, "labels").columns == []


def test_chunks_out_of_order_over_batches(spark, tmp_path):
    big = b"x" * 700_000
    batches = [
        [("a", 2, b"c", True), ("b", 0, b"0", False)],      # the end marker comes first
        [("a", 0, b"a", False), ("b", 1, big, True)],
        [("a", 1, b"b", False), ("b", 1, big, True)],        # and a repeat after the end
        [("c", 1, b"z", True)]]                              # never complete
    rows = parts(spark, tmp_path, "chunks", batches, "flow_id string, seq int, chunk binary, is_last boolean")
    got = {r["flow_id"]: (r["chunks"], bytes(r["body"])) for r in run(st.assemble_stream(rows, idle_ms=None), tmp_path).collect()}
    assert got == {"a": (3, b"abc"), "b": (2, b"0" + big)}


def test_idle_flows_come_as_far_as_they_got_and_markers_go(spark, tmp_path):
    rows = parts(spark, tmp_path, "chunks", [
        [("a", 0, b"a", True), ("b", 1, b"z", False)], [("a", 0, b"a", True)]], "flow_id string, seq int, chunk binary, is_last boolean")
    out = f"{tmp_path}/out"
    query = st.assemble_stream(rows, idle_ms=500, forget_ms=500).writeStream.format("parquet").option("path", out).option(
        "checkpointLocation", f"{out}.ck").trigger(processingTime="200 milliseconds").start()
    try:
        for _ in range(120):
            query.awaitTermination(1)
            done = spark.read.schema("flow_id string, chunks int, body binary").parquet(out) if (tmp_path / "out").exists() else None
            if done is not None and done.where("flow_id = 'b'").count() and st.state_size(query)["rows"] == 0:
                break
        got = sorted((r["flow_id"], r["chunks"], bytes(r["body"])) for r in done.collect())
        assert ("b", 1, b"z") in got and ("a", 1, b"a") in got
        assert st.state_size(query)["rows"] == 0
    finally:
        query.stop()


def identity_batches():
    """Signals of one tenant and another over days: rivals, ties, a value idle for days."""
    import random
    dice, rows, event = random.Random(7), [], 0
    for day in (1, 1, 2, 6, 6, 7):
        batch = []
        for _ in range(30):
            event += 1
            names = "abc" if day < 6 else "cd"
            who = dice.choice(names)
            batch.append((dice.choice([1, 2]), day * 86_400 + event * 60, event, f"from {who}{who}@mail.example.com at 93.184.{ord(who)}.7"))
        rows.append(batch)
    return rows


def test_identity_over_batches_equals_the_batch_form(spark, tmp_path):
    from leakscope.operators import identity as idn
    from leakscope.operators.classify import scan_texts
    batches = [[(t, at, e, text) for t, at, e, text in batch] for batch in identity_batches()]
    kind = "tenant_id long, at long, event_id long, text string"
    whole = spark.createDataFrame([r for b in batches for r in b], kind).withColumn("ts", F.timestamp_seconds("at")).drop("at")
    stream = parts(spark, tmp_path, "events", batches, kind).withColumn("ts", F.timestamp_seconds("at")).drop("at")
    query = st.identity_stream(stream, f"{tmp_path}/out", f"{tmp_path}/state", f"{tmp_path}/ck", late_hours=1)
    st.run_to_end(query)
    shown = ["tenant_id", "kind", "value", "event_id", "n", "running", "exempt"]
    got = {tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").select(*shown).collect()}
    wanted = {tuple(r) for r in idn.running_exemption(idn.signals(scan_texts(whole))).select(*shown).collect()}
    assert got == wanted and any(r[-1] for r in got) and any(not r[-1] for r in got)
    # idle values are gone from what a batch reads; the store keeps a row for each value
    kept = {r["value"] for r in spark.read.parquet(f"{tmp_path}/state/version=5").collect()}
    assert not kept & {"aa@mail.example.com", "bb@mail.example.com"} and "cc@mail.example.com" in kept
    assert st.state_size(query)["rows"] == whole.transform(lambda d: idn.count_signals(idn.signals(scan_texts(d)))).count()
    assert sorted(p.name for p in (tmp_path / "state").iterdir()) == ["version=4", "version=5"]


def test_registry_versions_are_pinned_to_batches(spark, tmp_path):
    from leakscope.operators import registry as rg
    path, pins = f"{tmp_path}/registry", f"{tmp_path}/pins"
    flows = [[("claude.ai", "a"), ("example.org", "b")], [("claude.ai", "c"), ("example.org", "d")]]
    rg.publish(rg.seed_rows(spark, "2024-01-01 00:00:00"), path)
    asked = []

    def registry(number):
        known = rg.published_for(spark, path, pins, number)
        asked.append(number)
        if len(asked) == 1:     # changes while batch 0 runs: seen by batch 1 alone
            new = spark.createDataFrame([("example.org", "Example")], "host string, label string")
            more = rg.upsert(rg.published(spark, path), new, F.lit("2024-01-02").cast("timestamp"))
            assert rg.publish(rg.set_enabled(more, "claude.ai", False), path) == 1
        return known

    rows = parts(spark, tmp_path, "flows", [[(h, t, "/v1/messages") for h, t in b] for b in flows], "host string, text string, path string")
    st.run_to_end(st.score_flows(rows, registry, f"{tmp_path}/out", f"{tmp_path}/ck"))
    got = {(r["batch"], r["text"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {(0, "a"), (1, "d")} and asked == [0, 1]
    assert rg.published_for(spark, path, pins, 0).where("host = 'claude.ai'").first()["enabled"]    # a retry of batch 0


def test_baseline_of_alerts_is_kept_over_restarts(spark, tmp_path):
    stored = spark.range(5)
    assert st.alert_baseline(stored, f"{tmp_path}/mark") == 4
    assert st.alert_baseline(spark.range(9), f"{tmp_path}/mark") == 4
    assert st.alert_baseline(spark.range(0), f"{tmp_path}/none") == -1


def test_unmatched_responses_come_after_the_watermark(spark, tmp_path):
    day = "2024-01-0{} 10:0{}:00".format
    kind = "flow_id string, ts string, text string"
    asked = parts(spark, tmp_path, "asked", [[("a", day(1, 0), "q")], [("z", day(5, 0), "q")], [("y", day(6, 0), "q")]], kind)
    told = parts(spark, tmp_path, "told", [[("a", day(1, 1), "r"), ("b", day(1, 2), "r")], [("w", day(5, 0), "r")], [("v", day(6, 0), "r")]], kind)
    at = lambda df, name, text: df.select("flow_id", F.to_timestamp("ts").alias(name), F.col("text").alias(text))
    pairs = st.pair_stream(at(asked, "request_ts", "asked"), at(told, "response_ts", "answered"))
    got = {r["flow_id"]: r["asked"] for r in run(pairs, tmp_path).collect()}
    assert got["a"] == "q" and "b" in got and got["b"] is None


def test_alerts_come_once_and_not_from_history(spark, tmp_path):
    batches = [[(i, "response", "critical" if i % 2 else "clean") for i in range(n, n + 4)] for n in (0, 4, 8)]
    rows = parts(spark, tmp_path, "events", batches, "id long, direction string, label string")
    seen = {}

    def notify(batch, number):
        seen[number] = [r["id"] for r in batch.collect()]

    st.run_to_end(st.alert_stream(rows, notify, f"{tmp_path}/ck", after_id=3))
    assert sorted(i for ids in seen.values() for i in ids) == [5, 7, 9, 11]


def test_lookup_in_the_row_equals_the_join(spark, monkeypatch):
    from leakscope.operators import registry as rg
    hosts = ["api.openai.com", "EU.api.openai.com:443", "notclaude.ai", "claude.ai", "x.claude.ai", "huggingface.co",
             "api-inference.huggingface.co", "a.api-inference.huggingface.co", "", "localhost", ".claude.ai", "claude.ai."]
    flows = spark.createDataFrame([(i, h) for i, h in enumerate([*hosts, None])], "id int, host string")
    registry = rg.seed_rows(spark, "2024-01-01 00:00:00")
    for strict in (True, False):
        monkeypatch.setattr(rg, "LITERAL_HOSTS", 1000)
        fast = rg.with_provider(flows, registry, strict)
        plan = fast._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Join" not in plan
        here = {(r["id"], r["provider"]) for r in fast.collect()}
        monkeypatch.setattr(rg, "LITERAL_HOSTS", 0)
        assert here == {(r["id"], r["provider"]) for r in rg.with_provider(flows, registry, strict).collect()}
        assert len(here) >= 6
    assert rg.with_provider(flows, registry.filter("false")).count() == 0


def test_long_bodies_stay_whole(spark):
    from leakscope.operators import responses as rs
    from leakscope.sources import capture
    part = b"y" * 200_000
    body = rs.assemble_chunks(spark.createDataFrame([("f", i, part) for i in range(5)], "flow_id string, seq int, chunk binary")).first()["body"]
    assert bytes(body) == part * 5
    hits = "array<struct<name:string,category:string,weight:double,snippet:string>>"
    row = spark.range(1).select(
        F.lit(None).cast("timestamp").alias("ts"), F.col("id").alias("event_id"), *[F.lit("v").alias(c) for c in (
            "tenant_id", "flow_id", "host", "provider", "method", "path", "intent", "label")],
        F.expr("map('Accept', 'x')").alias("headers"), F.expr("cast(repeat('z', 400000) AS binary)").alias("body"),
        *[F.lit(0.0).alias(c) for c in ("intent_conf", "sensitivity", "effective_sensitivity", "tier1_score", "tier2_score")],
        F.array().cast("array<string>").alias("categories"), F.array().cast(hits).alias("hits"))
    made = capture.build_records(row).first()
    assert len(made["body_text"]) == 400_000 and not made["body_truncated"]
    assert len(capture.build_records(row, 1000).first()["body_text"]) == 1000


def test_chat_keys_late_in_the_text(spark):
    from leakscope.functions import text as tx
    late = spark.createDataFrame([("x" * 10_000 + '{"messages": []}',), ("x" * 10_000,)], "t string")
    assert [r[0] for r in late.select(tx.looks_chat("t")).collect()] == [True, False]


def test_json_strings_of_any_length_are_flattened(spark):
    from leakscope.functions import text as tx
    body = spark.range(1).select(F.expr("concat('{\"k\": \"', repeat('x', 21000000), '\", \"n\": [\"y\"]}')").alias("b"), F.lit("application/json").alias("c"))
    flat = body.select(tx.flatten_json("b", "c").alias("t")).select(F.length("t"), F.right("t", F.lit(2))).first()
    assert tuple(flat) == (21_000_002, "\ny")
