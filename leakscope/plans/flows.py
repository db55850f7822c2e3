"""Queries over captured flows: registry, request events, responses, capture records."""

from __future__ import annotations

import gzip
import zlib

import pandas as pd
from pyspark.sql import functions as F

from leakscope.functions import sse
from leakscope.functions import text as tx
from leakscope.operators import classify as cl
from leakscope.operators import events as ev
from leakscope.operators import registry as rg
from leakscope.operators import responses as rs
from leakscope.plans import inputs as inp
from leakscope.plans.registry import query
from leakscope.sources import capture
from leakscope.sources.tables import table

_CREATED = "2024-01-01 00:00:00"
_SEEDS_SQL = "(VALUES " + ", ".join(f"('{h}', '{p}')" for h, p in rg.SEEDS.items()) + \
    ") AS seeds(host, label)"
_BARE_HOST = "lower(split_part(host, ':', 1))"
_LOOKUP_SQL = f"""
    named AS (SELECT DISTINCT host FROM flows),
    provided AS (SELECT n.host, arg_max(s.label, length(s.host)) AS provider FROM named n
        JOIN {_SEEDS_SQL} ON {_BARE_HOST.replace('host', 'n.host')} = s.host
            OR ends_with({_BARE_HOST.replace('host', 'n.host')}, '.' || s.host) GROUP BY n.host)
    """.replace("AS seeds(host, label)", "AS s(host, label)")


# --- registry ----------------------------------------------------------------
# pages.url gives the hosts; every 3rd page's host is registered under its site name.

_PAGE_HOST = "regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)"


def _page_hosts(spark, folder):
    return table(spark, folder, "pages").select(
        "page_id", F.expr(_PAGE_HOST).alias("host"))


@query("provider_lookup", f"""
    WITH flows AS (SELECT doc_id, {inp.HOST} AS host FROM documents), {_LOOKUP_SQL}
    SELECT provider, count(*) AS flows, count(DISTINCT host) AS hosts
    FROM flows JOIN provided USING (host) GROUP BY provider""")
def provider_lookup(spark, folder):
    """Flows per provider by exact host or dotted suffix; others are dropped."""
    flows = table(spark, folder, "documents").select("doc_id", F.expr(inp.HOST).alias("host"))
    known = rg.with_provider(flows, rg.seed_rows(spark, _CREATED))
    per_host = known.groupBy("provider", "host").agg(F.count("*").alias("n"))
    return per_host.groupBy("provider").agg(F.sum("n").alias("flows"),
                                            F.count("*").alias("hosts"))


_SITES_SQL = f"""
    sites AS (SELECT DISTINCT regexp_extract({_PAGE_HOST}, '[^.]+[.][^.]+$') AS host
        FROM pages WHERE length({_PAGE_HOST}) % 2 = 0)"""


@query("provider_lookup_pages", f"""
    WITH flows AS (SELECT page_id, {_PAGE_HOST} AS host FROM pages), {_SITES_SQL}
    SELECT f.page_id, f.host, s.host AS provider FROM flows f JOIN sites s
        ON lower(f.host) = s.host OR ends_with(lower(f.host), '.' || s.host)""")
def provider_lookup_pages(spark, folder):
    """Page hosts matched to a registry of sites taken from the pages themselves."""
    hosts = _page_hosts(spark, folder)
    sites = hosts.filter("length(host) % 2 = 0").select(
        F.regexp_extract("host", "[^.]+[.][^.]+$", 0).alias("host")).distinct()
    registry = sites.select("host", F.col("host").alias("label"), F.lit(True).alias("enabled"))
    return rg.with_provider(hosts, registry).select("page_id", "host", "provider")


@query("registry_seed", f"""
    WITH existing AS (SELECT DISTINCT {_PAGE_HOST} AS host FROM pages
        UNION SELECT 'claude.ai')
    SELECT host, label, 'seed' AS source FROM {_SEEDS_SQL}
        WHERE host NOT IN (SELECT host FROM existing)
    UNION ALL SELECT host, host AS label, 'user' AS source FROM existing""")
def registry_seed(spark, folder):
    """Seeds inserted into a registry that has page hosts and one of the seeds already."""
    hosts = _page_hosts(spark, folder).select("host").distinct()
    hosts = hosts.union(spark.createDataFrame([("claude.ai",)], "host string"))
    existing = hosts.select(
        "host", F.col("host").alias("label"), F.lit(True).alias("enabled"),
        F.lit("user").alias("source"), F.lit(_CREATED).cast("timestamp").alias("created_at"))
    merged = rg.ensure_seeded(existing, rg.seed_rows(spark, _CREATED))
    return merged.select("host", "label", "source")


_UPSERTS = (f"SELECT upper({_PAGE_HOST}) || ':8080' AS host, "
            f"CASE WHEN page_id % 2 = 0 THEN 'Site ' || {_PAGE_HOST} ELSE '  ' END AS label "
            f"FROM pages WHERE length({_PAGE_HOST}) % 3 > 0")


@query("registry_upsert", f"""
    WITH existing AS (SELECT DISTINCT {_PAGE_HOST} AS host FROM pages WHERE length({_PAGE_HOST}) % 2 = 1),
    asked AS ({_UPSERTS}),
    wanted AS (SELECT lower(split_part(host, ':', 1)) AS host,
        coalesce(nullif(trim(max(label)), ''), lower(split_part(host, ':', 1))) AS label
        FROM asked GROUP BY host)
    SELECT coalesce(e.host, w.host) AS host, coalesce(w.label, e.host) AS label,
        w.host IS NOT NULL AS enabled,
        CASE WHEN e.host IS NULL THEN 'user' ELSE 'seed' END AS source
    FROM existing e FULL JOIN wanted w ON e.host = w.host""")
def registry_upsert(spark, folder):
    """Hosts added: known ones are relabelled and enabled again, their source stays."""
    hosts = _page_hosts(spark, folder)
    existing = hosts.filter("length(host) % 2 = 1").select("host").distinct().select(
        "host", F.col("host").alias("label"), F.lit(False).alias("enabled"),
        F.lit("seed").alias("source"), F.lit(_CREATED).cast("timestamp").alias("created_at"))
    asked = table(spark, folder, "pages").filter(F.expr(f"length({_PAGE_HOST}) % 3 > 0")).select(
        F.expr(f"upper({_PAGE_HOST}) || ':8080'").alias("host"),
        F.expr(f"CASE WHEN page_id % 2 = 0 THEN 'Site ' || {_PAGE_HOST} ELSE '  ' END")
        .alias("label"))
    asked = asked.groupBy("host").agg(F.max("label").alias("label"))
    merged = rg.upsert(existing, asked, F.lit(_CREATED).cast("timestamp"))
    return merged.select("host", "label", "enabled", "source")


@query("registry_enabled_listing", f"""
    WITH hosts AS (SELECT DISTINCT {_PAGE_HOST} AS host FROM pages)
    SELECT host, upper(left(host, 3)) AS label FROM hosts
    WHERE length(host) % 2 = 0 AND NOT ends_with(host, '.org')""")
def registry_enabled_listing(spark, folder):
    """Enabled hosts after removals, by label and host."""
    hosts = _page_hosts(spark, folder).select("host").distinct()
    registry = hosts.select(
        "host", F.upper(F.left("host", F.lit(3))).alias("label"),
        (F.length("host") % 2 == 0).alias("enabled"), F.lit("user").alias("source"),
        F.lit(_CREATED).cast("timestamp").alias("created_at"))
    kept = rg.remove(registry, hosts.filter(F.endswith("host", F.lit(".org"))))
    return rg.listing(kept).filter("enabled").select("host", "label")


# --- requests ----------------------------------------------------------------

def request_flows(spark, folder):
    """Flows made of the documents: host, path, declared type and a JSON or plain body."""
    rows = inp.bodies(spark, folder)
    body = F.to_json(F.struct(
        F.lit("model-1").alias("model"), F.array(F.struct(
            F.lit("user").alias("role"), F.col("text").alias("content"))).alias("messages"),
        F.lit("0f3c2a91-7d54-4be8-9a06-c1d27e5b3344").alias("trace")))
    return rows.select(
        "doc_id", "source", F.expr(inp.HOST).alias("host"), F.expr(inp.PATH).alias("path"),
        F.expr(inp.TYPE).alias("content_type"), body.cast("binary").alias("body"))


_SHOWN_TYPES = " OR ".join(
    f"starts_with(lower(trim(split_part(content_type, ';', 1))), '{p}')"
    for p in tx.REQUEST_MEDIA_TYPES)
_QUOTED = "to_json(text)::VARCHAR"
_REQUEST_CTES = f"""
    base AS ({inp.BODIES_SQL}),
    flows AS (SELECT doc_id, text, {inp.HOST} AS host, {inp.PATH} AS path,
        {inp.TYPE} AS content_type FROM base),
    {_LOOKUP_SQL},
    known AS (SELECT f.*, p.provider FROM flows f JOIN provided p USING (host)),
    flat AS (SELECT doc_id, path, provider, CASE WHEN NOT ({_SHOWN_TYPES}) THEN ''
        WHEN contains(lower(content_type), 'json') THEN 'model-1' || chr(10) || 'user' || chr(10)
            || text || chr(10) || '0f3c2a91-7d54-4be8-9a06-c1d27e5b3344'
        ELSE '{{"model":"model-1","messages":[{{"role":"user","content":' || {_QUOTED}
            || '}}],"trace":"0f3c2a91-7d54-4be8-9a06-c1d27e5b3344"}}' END AS raw FROM known),
    bodies AS (SELECT doc_id, path, provider, {inp.scrub_sql('raw')} AS text FROM flat),
    {inp.hits_ctes()}, {inp.scores_ctes()},
    ruled AS (SELECT *, split_part({inp.intent_sql('path', 'text')}, '|', 1) AS intent
        FROM scored),
    eff AS (SELECT *, least(1.0, tier1 * {inp.FACTOR_SQL}) AS effective FROM ruled)"""


def scored_requests(spark, folder, with_sample=False):
    flows = rg.with_provider(request_flows(spark, folder), rg.seed_rows(spark, _CREATED))
    rows = flows.withColumn("text", tx.decode_body("body", "content_type"))
    rows = rows.withColumn("text", tx.flatten_json("text", "content_type"))
    rows = rows.withColumn("text", tx.scrub_metadata("text"))
    return cl.classify_requests(rows, path="path", with_sample=with_sample)


@query("request_events", f"""WITH {_REQUEST_CTES}
    SELECT doc_id, provider, intent, round(tier1 + 1e-12, 4) AS sensitivity,
        round(effective + 1e-12, 4) AS effective_sensitivity,
        {inp.clamp_sql(inp.label_sql('effective'), inp.DEMOTED_SQL)} AS label FROM eff""")
def request_events(spark, folder):
    """Requests to monitored hosts, end to end: decode, flatten, scrub, scan, demote."""
    return scored_requests(spark, folder).select(
        "doc_id", "provider", "intent", "sensitivity", "effective_sensitivity", "label")


@query("request_summaries")
def request_summaries(spark, folder):
    """One-line summary and masked sample of each request."""
    return scored_requests(spark, folder, True).select("doc_id", "label", "summary", "sample")


_SUMMARY_SQL = f"""WITH {inp.EVENTS_CTE},
    named AS (SELECT doc_id, 're' AS part, name, count(*) AS n, min(o * 1000000 + i) AS first
            FROM re_hits GROUP BY doc_id, name
        UNION ALL SELECT doc_id, 'dc', name, count(*), min(o * 1000000 + i) FROM dc_hits
            GROUP BY doc_id, name),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id, part ORDER BY n DESC, first)
        AS rn FROM named),
    listed AS (SELECT doc_id, part, string_agg(replace(name, '_', ' ') || ' ×' || n, ', '
        ORDER BY rn) AS names FROM ranked WHERE rn <= 3 GROUP BY doc_id, part)
    SELECT s.doc_id, CASE WHEN s.re_n + s.dc_n = 0 THEN 'No sensitive content detected.'
        ELSE concat_ws('. ', 'Detected ' || r.names, 'destructive command(s): ' || d.names,
            CASE WHEN {inp.DEMOTED_SQL} THEN 'demoted to low (intent=' || intent || ')' END)
            || '.' END AS summary
    FROM shown s LEFT JOIN listed r ON r.doc_id = s.doc_id AND r.part = 're'
        LEFT JOIN listed d ON d.doc_id = s.doc_id AND d.part = 'dc'"""


@query("event_summaries", _SUMMARY_SQL)
def event_summaries(spark, folder):
    """The one-line summary of every event."""
    return inp.event_log(spark, folder).select(F.col("id").alias("doc_id"), "summary")


# --- responses ---------------------------------------------------------------
# User turns are requests; the assistant turn that follows is their response.

_REPLY = "text || chr(10) || " + inp.pick("conv_id + turn", [
    "''", "'run rm -rf / now'", "'git push --force'", "'rm -rf /tmp/x'", "'drop table t'"])
_REPLY_TYPE = inp.pick("conv_id", [
    "'application/json'", "'text/event-stream'", "'text/html'", "'application/x-ndjson'"])


def paired(spark, folder):
    turns = table(spark, folder, "conversations")
    requests = turns.filter("role = 'user'").select(
        F.col("conv_id"), F.col("turn"), F.expr(
            inp.PATH.replace("doc_id", "conv_id")).alias("path"), "text")
    requests = cl.classify_requests(requests, path="path").select(
        "conv_id", "turn", "path", "intent", "label")
    replies = turns.filter("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.expr(_REPLY).alias("reply"),
        F.expr(_REPLY_TYPE).alias("content_type"))
    return rs.pair_with_requests(
        replies.withColumn("path", F.expr(inp.PATH.replace("doc_id", "conv_id"))),
        requests, ("conv_id", "turn"))


@query("pair_request_response", f"""
    WITH req AS (SELECT conv_id, turn, {inp.PATH.replace('doc_id', 'conv_id')} AS path, text
        FROM conversations WHERE role = 'user'),
    rep AS (SELECT conv_id, turn - 1 AS turn, {_REPLY} AS reply FROM conversations
        WHERE role = 'assistant')
    SELECT rep.conv_id, rep.turn, length(reply) AS chars,
        split_part({inp.intent_sql('req.path', 'req.text')}, '|', 1) AS request_intent
    FROM rep LEFT JOIN req ON rep.conv_id = req.conv_id AND rep.turn = req.turn""".replace(
        "(CASE WHEN regexp_matches(req.path", "(CASE WHEN req.conv_id IS NULL THEN NULL "
        "WHEN regexp_matches(req.path", 1))
def pair_request_response(spark, folder):
    """Assistant turns with the intent of the user turn they answer."""
    return paired(spark, folder).select(
        "conv_id", "turn", F.length("reply").cast("bigint").alias("chars"), "request_intent")


def _response_rows(spark, folder):
    rows = paired(spark, folder)
    plain = F.to_json(F.struct(F.col("reply").alias("answer")))
    events = F.concat(
        F.lit("event: message\ndata: "), F.to_json(F.struct(
            F.lit("content_block_delta").alias("type"),
            F.struct(F.col("reply").alias("text")).alias("delta"))),
        F.lit("\n\ndata: [DONE]\n"))
    streamed = F.col("content_type") == "text/event-stream"
    return rows.withColumn("is_sse", streamed).withColumn("streamed", streamed).withColumn(
        "body", F.when(streamed, events).otherwise(plain).cast("binary"))


_RESPONSE_SQL = f"""
    WITH req AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'user'),
    rep AS (SELECT conv_id, turn - 1 AS turn, {_REPLY} AS reply, {_REPLY_TYPE} AS content_type,
        {inp.PATH.replace('doc_id', 'conv_id')} AS path FROM conversations
        WHERE role = 'assistant'),
    matched AS (SELECT rep.*, CASE WHEN req.conv_id IS NULL THEN NULL ELSE
        split_part({inp.intent_sql('rep.path', 'req.text')}, '|', 1) END AS request_intent
        FROM rep LEFT JOIN req ON rep.conv_id = req.conv_id AND rep.turn = req.turn),
    kept AS (SELECT * FROM matched WHERE coalesce(request_intent, '') NOT IN
        ('auth', 'handshake', 'telemetry', 'antiabuse')
        AND NOT ends_with(path, '.js') AND NOT contains(path, '/assets/')),
    bodies AS (SELECT conv_id * 10000 + turn AS doc_id, conv_id, turn, content_type, path,
        request_intent, CASE WHEN content_type = 'text/html' THEN ''
        ELSE {inp.scrub_sql('reply')} END AS text FROM kept),
    {inp.hits_ctes('bodies', 'false')}, {inp.scores_ctes()},
    final AS (SELECT *, CASE WHEN content_type = 'text/html' THEN 'non-model-ctype'
        WHEN trim(text) = '' THEN 'scrub-empty' END AS skip_reason FROM scored)"""


@query("response_events", f"""{_RESPONSE_SQL}
    SELECT conv_id, turn, skip_reason, CASE WHEN dc_n > 0 THEN 'critical' ELSE 'clean' END AS label,
        round(dc_score + 1e-12, 4) AS sensitivity,
        CASE WHEN skip_reason IS NOT NULL THEN coalesce(nullif(request_intent, ''), 'unknown')
            ELSE split_part({inp.intent_sql('path', 'text')}, '|', 1) END AS intent
    FROM final""")
def response_events(spark, folder):
    """Responses end to end: gates, stream extraction, scan, placeholders for skipped ones."""
    rows = rs.extract_text(rs.scorable(_response_rows(spark, folder)))
    return rs.score_responses(rows).select(
        "conv_id", "turn", "skip_reason", "label", "sensitivity", "intent")


@query("skip_reasons", f"""{_RESPONSE_SQL}
    SELECT coalesce(skip_reason, 'scored') AS outcome, count(*) AS responses FROM final
    GROUP BY 1""")
def skip_reasons(spark, folder):
    """How many responses were scored, and why others were not."""
    rows = rs.extract_text(rs.scorable(_response_rows(spark, folder)))
    return rows.groupBy(F.coalesce("skip_reason", F.lit("scored")).alias("outcome")).agg(
        F.count("*").alias("responses"))


@query("guardrail_redact", f"""{_RESPONSE_SQL}
    SELECT conv_id, turn, dc_n > 0 AS blocked,
        CASE WHEN dc_n > 0 THEN 'critical' END AS blocked_label FROM final""")
def guardrail_redact(spark, folder):
    """Bodies of guarded labels replaced by a stub."""
    rows = rs.score_responses(rs.extract_text(rs.scorable(_response_rows(spark, folder))))
    rows = rs.redact(rows)
    return rows.select("conv_id", "turn", "blocked", F.when(
        F.col("blocked"), F.get_json_object("body", "$.blocked_label")).alias("blocked_label"))


# Each turn becomes a stream of one event shape, one event per line of its text.
_LINE_JSON = "substring(to_json(named_struct('c', l)), 6, length(to_json(named_struct('c', l))) - 6)"
_SHAPES = [
    """concat('{"type":"content_block_delta","delta":{"text":', q, '}}')""",
    """concat('{"type":"content_block_delta","delta":{"partial_json":', q, ',"n":1}}')""",
    """concat('{"type":"response.output_text.delta","delta":', q, '}')""",
    """concat('{"choices":[{"delta":{"content":', q, '}}]}')""",
    """concat('{"candidates":[{"content":{"parts":[{"text":', q, '}]}}]}')""",
    """concat('{"type":"content_block_start","content_block":{"name":"Run","input":{"b":1,"a":"x: y"},"text":', q, '}}')""",
    """concat('{"type":"response.done","delta":{"value":', q, '}}')""",
    """concat('{"choices":[{"delta":{"tool_calls":[{"function":{"name":"f","arguments":', q, '}}]}}]}')""",
]
_SHAPE_TEXT = ["l", "l", "l", "l", "l", """concat('tool:Run{"b": 1, "a": "x: y"}', l)""", "l",
               "concat('f', l)"]


def _event_streams(spark, folder):
    turns = table(spark, folder, "conversations").withColumn(
        "lines", F.split("text", "\n", -1))
    line = inp.pick("(conv_id + turn)", _SHAPES)
    return turns.select("conv_id", "turn", F.expr(
        f"concat(array_join(transform(transform(lines, l -> {_LINE_JSON}), "
        f"q -> concat('event: x', chr(10), 'data: ', {line})), chr(10) || chr(10)), "
        f"chr(10), 'data: not json', chr(10), 'data: [DONE]')").alias("body"))


@query("sse_text", f"""
    WITH lined AS (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS l,
        generate_subscripts(string_split(text, chr(10)), 1) AS i FROM conversations),
    parts AS (SELECT conv_id, turn, i, {inp.pick('(conv_id + turn)', _SHAPE_TEXT)} AS part
        FROM lined),
    joined AS (SELECT conv_id, turn, string_agg(part, '' ORDER BY i) AS t FROM parts GROUP BY ALL)
    SELECT conv_id, turn, length(t) AS chars, md5(t) AS digest FROM joined""")
def sse_text(spark, folder):
    """Text of event streams in eight event shapes."""
    rows = _event_streams(spark, folder).select("conv_id", "turn", sse.sse_text("body").alias("t"))
    return rows.select("conv_id", "turn", F.length("t").cast("bigint").alias("chars"),
                       F.md5("t").alias("digest"))


@query("sse_fallback", """
    WITH lined AS (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS l,
        generate_subscripts(string_split(text, chr(10)), 1) AS i FROM conversations),
    kept AS (SELECT * FROM lined WHERE trim(l) <> '')
    SELECT conv_id, turn, md5(string_agg(trim(l), chr(10) ORDER BY i)) AS digest FROM kept
    GROUP BY conv_id, turn""")
def sse_fallback(spark, folder):
    """Payloads of event streams of unknown shape, as they stand."""
    rows = table(spark, folder, "conversations").select("conv_id", "turn", F.expr(
        "concat('data:', replace(text, chr(10), chr(10) || 'data: '), chr(10), 'id: 1', chr(10), "
        "'data: [DONE]')").alias("body"))
    return rows.select("conv_id", "turn", F.md5(sse.sse_fallback("body")).alias("digest"))


@query("assemble_chunks", """
    SELECT conv_id, count(*) AS chunks, sum(strlen(text))::BIGINT AS bytes,
        md5(string_agg(text, '' ORDER BY turn)) AS digest FROM conversations GROUP BY conv_id""")
def assemble_chunks(spark, folder):
    """Bodies put together from their chunks: the turns of a conversation, in order."""
    chunks = table(spark, folder, "conversations").select(
        F.col("conv_id").alias("flow_id"), F.col("turn").alias("seq"),
        F.col("text").cast("binary").alias("chunk"))
    rows = rs.assemble_chunks(chunks)
    return rows.select(F.col("flow_id").alias("conv_id"), "chunks",
                       F.octet_length("body").cast("bigint").alias("bytes"),
                       F.md5("body").alias("digest"))


@query("decompress_bodies", """
    SELECT doc_id, strlen(text) AS bytes, md5(text) AS digest FROM documents""")
def decompress_bodies(spark, folder):
    """Bodies under three encodings and none, restored."""
    @F.pandas_udf("binary")
    def squeeze(text: pd.Series, kind: pd.Series) -> pd.Series:
        raw = [t.encode() for t in text]
        pack = {"gzip": gzip.compress, "deflate": zlib.compress,
                "x-deflate": lambda b: zlib.compress(b)[2:-4]}
        return pd.Series([pack.get(k, lambda b: b)(r) for r, k in zip(raw, kind)])

    rows = table(spark, folder, "documents").select("doc_id", "text", F.expr(inp.pick(
        "doc_id", ["'gzip'", "'deflate'", "'x-deflate'", "''"])).alias("content_encoding"))
    rows = rows.withColumn("body", squeeze("text", "content_encoding"))
    rows = rs.decompress(rows)
    return rows.select("doc_id", F.octet_length("body").cast("bigint").alias("bytes"),
                       F.md5("body").alias("digest"))


# --- capture records ---------------------------------------------------------

@query("capture_records", f"""
    WITH bodies AS ({inp.BODIES_SQL})
    SELECT doc_id, strlen(text) + CASE WHEN doc_id % 9 = 0 THEN 1 ELSE 0 END AS body_bytes,
        doc_id % 9 <> 0 AS is_text, 'content-type,x-request-id' AS headers,
        CASE WHEN doc_id % 9 <> 0 THEN md5(text) END AS digest FROM bodies""")
def capture_records(spark, folder):
    """Capture records: header allow list, text or base64 body, classifier result."""
    rows = cl.classify_requests(inp.bodies(spark, folder).withColumn("path", F.expr(inp.PATH)),
                                path="path")
    rows = rows.select(
        "*", F.lit(None).cast("timestamp").alias("ts"), F.col("doc_id").alias("event_id"),
        F.col("source").alias("tenant_id"), F.col("doc_id").cast("string").alias("flow_id"),
        F.lit("api.example.com").alias("host"), F.lit("Example").alias("provider"),
        F.lit("POST").alias("method"),
        F.expr("map('Content-Type', 'text/plain', 'Cookie', 'c=1', 'X-Request-ID', '7')")
        .alias("headers"),
        F.expr("CASE WHEN doc_id % 9 = 0 THEN concat(unhex('ff'), cast(text AS binary)) "
               "ELSE cast(text AS binary) END").alias("body"))
    records = capture.build_records(rows)
    return records.select(
        F.col("event_id").alias("doc_id"), "body_bytes",
        F.col("body_text").isNotNull().alias("is_text"),
        F.array_join(F.array_sort(F.map_keys("headers")), ",").alias("headers"),
        F.md5("body_text").alias("digest"))


@query("union_events", f"""WITH {inp.EVENTS_CTE}
    SELECT direction, count(*) AS events, sum(bytes_out)::BIGINT AS bytes_out FROM events_log
    GROUP BY direction""")
def union_events(spark, folder):
    """Request and response rows in one event table."""
    return inp.event_log(spark, folder).groupBy("direction").agg(
        F.count("*").alias("events"), F.sum("bytes_out").alias("bytes_out"))
