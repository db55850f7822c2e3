"""Body gates, flattening, scrubbing, event streams, intent."""

import gzip
import json
import zlib

from pyspark.sql import functions as F

from leakscope.functions import intent as it
from leakscope.functions import sse
from leakscope.functions import text as tx
from leakscope.operators import responses as rs


def column(spark, values, make, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["o"] for r in df.select("i", make("v").alias("o")).orderBy("i").collect()]


def test_flatten_keeps_values_in_order(spark):
    body = {"k": 'a "q" \\ é', "n": [1, None, {"x": "y:", "z": ["w\n2", ""]}], "t": True}
    texts = [json.dumps(body), "[1, 2]", "{broken", '"alone"']
    df = spark.createDataFrame([(i, t, "Application/JSON") for i, t in enumerate(texts)],
                               "i int, t string, c string")
    got = [r[0] for r in df.orderBy("i").select(tx.flatten_json("t", "c")).collect()]
    assert got == ['a "q" \\ é\ny:\nw\n2\n', "[1, 2]", "{broken", "alone"]


def test_flatten_long_strings(spark):
    long = "x\\\"" * 200_000
    df = spark.createDataFrame([(json.dumps({"a": long}), "json")], "t string, c string")
    assert df.select(tx.flatten_json("t", "c") == F.lit(long)).first()[0]


def test_scrub_leaves_what_a_person_typed(spark):
    text = "\n".join([
        "next", "0f3c2a91-7d54-4be8-9a06-4f589f8068b2", "user", "text", " hey  ",
        "69f5dc1c-a6c4-83ea-8bf9-08738a723287", "auto", "Asia/Calcutta", "primary_assistant",
        "v1", "2024-01-01T10:00:00.5+05:30", "..", "abcdefghijklmnopqrstuvwxyz0123", "ok",
        "id=" + "0a" * 16 + " stays"])
    got = column(spark, [text, "", "a\r\n\r\nb c"], tx.scrub_metadata)
    assert got == [" hey\nok\nid= stays", "", "a\nb\nc"]


def test_gates(spark):
    kinds = ["application/json; charset=utf-8", " TEXT/plain", "image/png", "", None,
             "text/event-stream"]
    assert column(spark, kinds, tx.request_scorable) == [True, True, False, False, False, True]
    assert column(spark, kinds, tx.response_scorable) == [True, False, False, False, False, True]
    paths = ["/cdn/x", "/a.JS?x=1", "/v1/messages", "/latest-release", "/x?y=.js", None]
    assert column(spark, paths, tx.non_model_path) == [True, True, False, True, False, False]


def test_decode_and_binary(spark):
    bodies = [b"plain text", b"\xff" + b"a" * 50, b"\xff\xfe\xfd" + b"a" * 10, b"", None]
    df = spark.createDataFrame([(i, b, "text/plain") for i, b in enumerate(bodies)],
                               "i int, b binary, c string")
    got = [r[0] for r in df.orderBy("i").select(tx.decode_body("b", "c")).collect()]
    assert got == ["plain text", "�" + "a" * 50, "", "", ""]
    sniffed = [gzip.compress(b"x"), zlib.compress(b"x"), b"\x01" * 4 + b"abcd", b"text", b""]
    assert column(spark, sniffed, tx.looks_binary, "binary") == [True, True, True, False, False]


def test_event_stream_shapes(spark):
    events = [
        {"type": "content_block_delta", "delta": {"text": "A", "thinking": "T"}},
        {"type": "content_block_delta", "delta": {"text": 5}},
        {"type": "content_block_start", "content_block": {
            "name": "Run", "input": {"z": 1, "a": [1, "x: y, z"]}, "text": "B"}},
        {"type": "response.output.delta", "delta": '{"k":1}'},
        {"type": "response.done", "delta": {"arguments": "C"}},
        {"choices": [{"delta": {"content": "D", "tool_calls": [
            {"function": {"name": "f", "arguments": "{}"}}]}},
            {"delta": {}, "message": {"content": "E"}}]},
        {"candidates": [{"content": {"parts": [{"text": "F"}, {"functionCall": {"q": 1}}]}}]},
        {"other": "ignored"},
    ]
    body = "\n\n".join("data: " + json.dumps(e) for e in events)
    body += "\ndata: not json\ndata: [1]\nevent: x\ndata: [DONE]"
    want = ('ATtool:Run{"z": 1, "a": [1, "x: y, z"]}B{"k":1}CDf{}EF{"q": 1}')
    unknown = 'data: {"foo": 1}\r\n\r\ndata:\ndata: [DONE]'
    assert column(spark, [body, unknown], sse.sse_text) == [want, ""]
    assert column(spark, [unknown], sse.sse_fallback) == ['{"foo": 1}']


def test_intent_cascade(spark):
    cases = [
        ("/x/sentinel/y", "", "antiabuse"), ("/ces/v1/rgstr?gz=1", "gAAAAAx", "telemetry"),
        ("/x", "gAAAAAx", "antiabuse"), ("/oauth/authorize", "", "auth"),
        ("/conversation/init", "hi", "handshake"),
        ("/conversation/init", '{"messages": []}', "chat"), ("/v1/messages", "", "chat"),
        ("/backend-api/f/conversation/abc", "", "chat"), ("/v1/messagesx", "", "unknown"),
        ("/y", "a\nUser\nb text c", "chat"), (None, None, "unknown"),
    ]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)],
                               "i int, path string, text string, want string")
    rows = df.select("i", "want", it.classify_intent("path", "text").alias("c")).orderBy("i")
    assert [(r["i"], r["c"]["intent"]) for r in rows.collect()] == [
        (i, c[2]) for i, c in enumerate(cases)]


def test_inflate_and_chunks(spark):
    raw = b"data: hello"
    packed = [(0, gzip.compress(raw), "gzip"), (1, zlib.compress(raw), "deflate"),
              (2, zlib.compress(raw)[2:-4], "Deflate"), (3, raw, None), (4, raw, "gzip")]
    df = spark.createDataFrame(packed, "i int, body binary, content_encoding string")
    assert {bytes(r["body"]) for r in rs.decompress(df).collect()} == {raw}
    chunks = spark.createDataFrame(
        [("f", i, bytes([65 + i % 26]) * 10) for i in reversed(range(600))],
        "flow_id string, seq int, chunk binary")
    whole = b"".join(bytes([65 + i % 26]) * 10 for i in range(600))
    for cap in (None, 5995, 3, 1 << 20):
        got = rs.assemble_chunks(chunks, cap_bytes=cap, block=64).first()
        assert bytes(got["body"]) == whole[:cap]
