"""Identity, registry, events, tokens, evaluation, corpus and registered queries."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from leakscope.functions import tokens as tk
from leakscope.operators import corpus, evaluate, events, identity, registry, tokenizer
from leakscope.sources import capture, eventlog, labelled

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
SIGNAL = "tenant_id string, kind string, value string, ts timestamp, event_id bigint"


def signal(spark, rows):
    return spark.createDataFrame(
        [("t", "email", v, T0 + dt.timedelta(minutes=m), e) for e, (v, m) in enumerate(rows)],
        SIGNAL)


def brute(rows, threshold=5, cap=1):
    seen, out = {}, {}
    for e, (v, m) in enumerate(rows):
        seen[v] = (seen.get(v, (0, 0))[0] + 1, m)
        live = sorted((-c, -last, x) for x, (c, last) in seen.items()
                      if c >= threshold and last >= m - 24 * 60)
        out[e] = v in {x for _, _, x in live[:cap]}
    return out


def test_running_exemption_is_exact(spark):
    rows = [("a", i * 7) for i in range(6)] + [("b", 50 + i * 11) for i in range(9)]
    rows += [("a", 200), ("c", 210), ("a", 1000), ("b", 1700), ("a", 1701), ("a", 4000),
             ("b", 4001), ("b", 4002), ("a", 9000)]
    rows.sort(key=lambda r: r[1])
    got = {r["event_id"]: r["exempt"] for r in
           identity.running_exemption(signal(spark, rows)).collect()}
    assert got == brute(rows)
    first, second = rows[:14], rows[14:]
    state = identity.count_signals(signal(spark, first))
    later = signal(spark, rows).filter(F.col("event_id") >= 14)
    cont = {r["event_id"]: r["exempt"] for r in
            identity.running_exemption(later, state).collect()}
    assert cont == {k: v for k, v in brute(rows).items() if k >= 14} and second


def test_qualified_cap_threshold_and_decay(spark):
    rows = [("five", i) for i in range(5)] + [("four", i) for i in range(4)] + [
        ("six", i) for i in range(6)]
    state = identity.count_signals(signal(spark, rows))
    at = F.lit("2024-01-02 00:04:00").cast("timestamp")
    assert [r["value"] for r in identity.qualified(state, at).collect()] == ["six"]
    late = F.lit("2024-01-02 00:05:01").cast("timestamp")
    assert identity.qualified(state, late).count() == 0


def test_registry(spark):
    seeds = registry.seed_rows(spark, "2024-01-01 00:00:00")
    hosts = ["API.openai.com:443", "eu.api.openai.com", "notchatgpt.com", "claude.ai", "x.org",
             "api-inference.huggingface.co"]
    flows = spark.createDataFrame([(h,) for h in hosts], "host string")
    got = {r["host"]: r["provider"] for r in registry.with_provider(flows, seeds).collect()}
    assert got == {"API.openai.com:443": "OpenAI", "eu.api.openai.com": "OpenAI",
                   "claude.ai": "Claude",
                   "api-inference.huggingface.co": "Hugging Face Inference"}
    loose = registry.with_provider(flows, seeds, strict=False).collect()
    assert "notchatgpt.com" in {r["host"] for r in loose}
    off = registry.set_enabled(seeds, "claude.ai", False)
    asked = spark.createDataFrame([("Claude.ai", "C"), ("bad host.x", "B"), ("new.io", "")],
                                  "host string, label string")
    merged = {r["host"]: r for r in registry.upsert(off, asked, F.current_timestamp()).collect()}
    assert merged["claude.ai"]["enabled"] and merged["claude.ai"]["source"] == "seed"
    assert merged["claude.ai"]["label"] == "C" and merged["new.io"]["label"] == "new.io"
    assert "bad host.x" not in merged and len(merged) == len(registry.SEEDS) + 1


@pytest.mark.parametrize("scope,score,label", [
    ("events", 0.36, "medium"), ("events_and_admin", 0.7379, "high"), ("full", 0.5904, "medium")])
def test_purge_audit_scores(spark, scope, score, label):
    row = events.audit_event(spark, scope, "2024-01-01 00:00:00").first()
    assert (round(row["sensitivity"], 4), row["label"]) == (score, label)


def test_old_event_rows_get_defaults(spark, tmp_path):
    old = spark.createDataFrame([(1, "p", 0.5, T0)],
                                "id bigint, provider string, sensitivity double, ts timestamp")
    row = events.normalise(old).first()
    assert (row["intent"], row["direction"], row["effective_sensitivity"]) == (
        "unknown", "request", 0.0)
    kept = events.filter_events(events.normalise(old), min_sensitivity=0.4)
    assert kept.count() == 1


def test_captures_skip_and_count_bad_lines(spark, tmp_path):
    path = tmp_path / "c.jsonl"
    path.write_text('{"path": "/v1/messages", "body_text": "hi"}\n\n{bad\n')
    rows = capture.read_captures(spark, str(path))
    assert capture.good_records(rows).count() == 1
    assert capture.skip_counts(rows).first()["rows"] == 1


def test_labelled_csv_roundtrip(spark, tmp_path):
    made = corpus.generate(spark, 40)
    labelled.write_labelled(made, str(tmp_path / "csv"))
    back = labelled.read_labelled(spark, str(tmp_path / "csv"))
    assert sorted(r["text"] for r in back.collect()) == sorted(r["text"] for r in made.collect())


def test_corpus_is_stable_and_spans_hold(spark):
    texts = spark.createDataFrame(
        [(i, f"First  thing {i}.\nSecond thing! Third thing? Last") for i in range(60)] + [(60, None)], "id long, text string")
    a = {r["id"]: r for r in corpus.samples(texts).collect()}
    b = {r["id"]: r for r in corpus.samples(texts.repartition(7)).collect()}
    assert a == b
    for i, r in a.items():
        assert 0 <= len(r["spans"]) <= corpus.MOST and bool(r["spans"]) == (r["label"] == 1)
        bare, at = "", 0
        for start, end in sorted(r["spans"]):
            assert start == 0 or r["text"][start - 1] == " "
            assert any(name in r["text"][start:end] for name in corpus.THINGS.values())
            bare, at = bare + r["text"][at:start], end
        bare = (bare + r["text"][at:]).split()
        assert bare == ([] if i == 60 else f"First thing {i}. Second thing! Third thing? Last".split())


def test_written_values_are_found(spark):
    from leakscope.operators import classify as cl
    made = spark.range(400).select("id", *[F.expr(v).alias(k) for k, v in corpus.value_makers("x").items()])
    wanted = {"email": "email", "phone": "phone_us", "ssn": "ssn", "credit_card": "credit_card", "iban": "iban",
              "aws_key": "aws_access_key", "api_key": "openai_key", "github_token": "github_token", "jwt": "jwt",
              "db_url": "db_url", "internal_host": "internal_hostname", "internal_ip": "ip_internal", "private_key": "private_key_block"}
    for kind, pattern in wanted.items():
        rows = cl.scan_texts(made.select("id", F.concat(F.lit("it is "), kind, F.lit(" .")).alias("text")))
        assert rows.filter(~F.expr(f"exists(re_hits, h -> h.name = '{pattern}')")).count() == 0, kind


def test_windows(spark):
    df = spark.createDataFrame([(n,) for n in (0, 1, 200, 201, 350, 351, 401, 4096)], "n int")
    got = [len(r[0]) for r in df.select(tk.window_starts("n")).collect()]
    want = []
    for n in (0, 1, 200, 201, 350, 351, 401, 4096):
        starts, at = [], 0
        while at < n:
            starts.append(at)
            if at + 200 >= n:
                break
            at += 150
        want.append(len(starts))
    assert got == want and got[-1] == 27


def test_tokenizer(spark):
    df = spark.createDataFrame([("low lower lowest low low newer",), ("Low  wide",)],
                               "text string")
    learned = tokenizer.train(tokenizer.word_frequency(df), vocab_size=100, min_freq=2)
    assert learned.merges[:2] == [("l", "o"), ("lo", "w")]
    rows = tokenizer.encode(df, learned).collect()
    for row in rows:
        low = row["text"].lower()
        for t in row["tokens"]:
            assert low[t["start"]:t["end"]] == t["surface"].removesuffix("</w>")
            assert t["id"] == learned.vocab[t["surface"]]


def test_split_is_exact(spark):
    df = spark.range(0, 5003).withColumnRenamed("id", "doc_id")
    counts = {r["split"]: r["count"] for r in
              evaluate.split_three(df).groupBy("split").count().collect()}
    assert counts == {"test": 500, "validation": 500, "train": 4003}


def test_metrics_with_empty_denominators(spark):
    df = spark.createDataFrame([(0, 0), (0, 1)], "prediction int, label int")
    row = evaluate.binary_metrics(df).first()
    assert (row["precision"], row["recall"], row["f1"], row["accuracy"]) == (0.0, 0.0, 0.0, 0.5)


def test_event_table(spark, tmp_path, tiny):
    from leakscope.plans import inputs
    log = inputs.event_log(spark, tiny, True)
    path = str(tmp_path / "events")
    eventlog.append(log, path)
    assert eventlog.read(spark, path).count() == log.count()


def test_registered_queries_match_their_sql(spark, tiny):
    import duckdb

    import check
    from __spark_entry__ import oracle_sql, queries
    con = duckdb.connect()
    for name in check.TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tiny}/{name}.parquet'")
    for name in ("flagship_source_risk", "request_events", "export_rows", "identity_running",
                 "sse_text", "nb_fit", "stream_scores"):
        got = check.normal(queries()[name](spark, tiny).toPandas())
        want = check.normal(con.sql(oracle_sql()[name]).df())
        assert list(got.columns) == list(want.columns) and got.equals(want), name


def test_signals_are_scanned_for_by_their_own_patterns(spark, tmp_path):
    from leakscope.functions.catalog import SENSITIVE
    from leakscope.operators import classify as cl
    from leakscope.plans import analytics as an
    rows = [(i, i % 3, dt.datetime(2024, 1, 1, 0, i)) for i in range(30)] + [(None, 1, None), (40, None, None)]
    folder = str(tmp_path)
    spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp").write.parquet(f"{folder}/events.parquet")
    plan = lambda rows: rows._jdf.queryExecution().optimizedPlan().toString()
    asked, every = an.signal_rows(spark, folder), identity.signals(cl.with_sensitive_hits(cl.with_scan_gates(an.signal_texts(spark, folder))))
    others = [p.category for p in SENSITIVE if p not in identity.PATTERNS and p.category not in {q.category for q in identity.PATTERNS}]
    assert any(c in plan(every) for c in others) and not any(c in plan(asked) for c in others)
    assert sorted(map(str, asked.collect())) == sorted(map(str, every.collect())) and asked.count() > 30
