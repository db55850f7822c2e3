"""Queries over the pattern scan, scores, labels and text cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from leakscope.functions import catalog as ct
from leakscope.functions import intent as it
from leakscope.functions import scan, scoring
from leakscope.functions import text as tx
from leakscope.operators import classify as cl
from leakscope.plans import inputs as inp
from leakscope.plans.registry import query
from leakscope.sources.tables import table

_HITS = f"WITH bodies AS ({inp.BODIES_SQL}), {inp.hits_ctes()}"
_SCORED = f"{_HITS}, {inp.scores_ctes()}"


def _scanned(spark, folder):
    return cl.scan_texts(inp.bodies(spark, folder))


@query("flagship_source_risk", f"""{_SCORED},
    labelled AS (SELECT source, tier1, {inp.label_sql('tier1')} AS label FROM scored)
    SELECT source, label, count(*) AS documents, round(avg(tier1) + 1e-12, 6) AS avg_score,
        round(max(tier1) + 1e-12, 6) AS max_score FROM labelled GROUP BY source, label""")
def flagship_source_risk(spark, folder):
    """Documents per source and risk label, by the full scan."""
    rows = _scanned(spark, folder).select("source", scoring.combine(
        F.col("re_score"), F.col("dc_score")).alias("tier1"))
    return rows.groupBy("source", scoring.label_for(F.col("tier1")).alias("label")).agg(
        F.count("*").alias("documents"),
        scoring.rounded(F.avg("tier1"), 6).alias("avg_score"),
        scoring.rounded(F.max("tier1"), 6).alias("max_score"))


def _counts(rows, hits):
    named = rows.select("doc_id", F.explode(F.expr(
        f"transform(array_distinct(transform({hits}, h -> h.name)), n -> named_struct('name', n, "
        f"'hits', size(filter({hits}, h -> h.name = n))))")).alias("c"))
    return named.groupBy("c.name").agg(F.count("*").alias("documents"),
                                       F.sum("c.hits").alias("hits"))


@query("scan_counts_by_pattern", f"""{_HITS}
    SELECT name, count(DISTINCT doc_id) AS documents, CAST(count(*) AS BIGINT) AS hits
    FROM re_hits GROUP BY name""")
def scan_counts_by_pattern(spark, folder):
    """Documents and hits per secret or personal-data pattern."""
    rows = cl.with_sensitive_hits(cl.with_scan_gates(inp.bodies(spark, folder)))
    return _counts(rows, "re_hits")


@query("raw_documents_scan", f"""
    WITH bodies AS (SELECT doc_id, source, text FROM documents), {inp.hits_ctes()},
    {inp.scores_ctes()}
    SELECT doc_id, re_n, dc_n, round(tier1 + 1e-12, 6) AS tier1 FROM scored
    WHERE re_n + dc_n > 0""")
def raw_documents_scan(spark, folder):
    """Documents with any finding, as they stand in the table."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    rows = cl.scan_texts(docs)
    return rows.select(
        "doc_id", F.size("re_hits").cast("bigint").alias("re_n"),
        F.size("dc_hits").cast("bigint").alias("dc_n"), scoring.rounded(scoring.combine(
            F.col("re_score"), F.col("dc_score")), 6).alias("tier1")).filter(
        (F.col("re_n") + F.col("dc_n")) > 0)


@query("scan_hits_topk", f"""{_HITS}
    SELECT doc_id, CAST(nth AS INT) AS nth, name, md5(raw) AS value FROM re_hits
    WHERE nth <= 3""")
def scan_hits_topk(spark, folder):
    """The first three findings of each document, in catalog and then text order."""
    rows = cl.with_sensitive_hits(cl.with_scan_gates(inp.bodies(spark, folder)), limit=3)
    return rows.select("doc_id", F.posexplode("re_hits").alias("i", "h")).select(
        "doc_id", (F.col("i") + 1).alias("nth"), F.col("h.name").alias("name"),
        F.md5("h.raw").alias("value"))


@query("pattern_extension", f"""
    WITH bodies AS ({inp.BODIES_SQL})
    SELECT doc_id, len(regexp_extract_all(text, '\\btoken\\s*=\\s*"[0-9a-f]{{40}}"')) AS hits
    FROM bodies WHERE regexp_matches(text, '\\btoken\\s*=\\s*"[0-9a-f]{{40}}"')""")
def pattern_extension(spark, folder):
    """A catalog extended by one pattern of the caller's."""
    extra = ct.Pattern("hex_token", r'\btoken\s*=\s*"[0-9a-f]{40}"', 0.9, "secret",
                       needles=("token",))
    rows = cl.with_sensitive_hits(cl.with_scan_gates(inp.bodies(spark, folder)),
                                  catalog=(extra,))
    return rows.select("doc_id", F.size("re_hits").cast("bigint").alias("hits")).filter("hits > 0")


_CARD = next(p for p in ct.SENSITIVE if p.name == "credit_card")


@query("luhn_cards", f"""{_HITS}
    SELECT doc_id, raw AS card, length(regexp_replace(raw, '[ -]', '', 'g')) AS digits
    FROM re_hits WHERE name = 'credit_card'""")
def luhn_cards(spark, folder):
    """Card numbers with a valid check digit."""
    rows = cl.with_scan_gates(inp.bodies(spark, folder)).select("doc_id", F.explode(F.expr(
        scan.matches_sql(_CARD, "text", "_lower", "_digits"))).alias("card"))
    return rows.select("doc_id", "card", F.length(F.regexp_replace("card", "[ -]", ""))
                       .cast("bigint").alias("digits"))


@query("mask_hits", f"""{_HITS}
    SELECT doc_id, name, CASE WHEN length(raw) <= 6 THEN repeat('*', length(raw))
        ELSE left(raw, 2) || repeat('*', length(raw) - 4) || right(raw, 2) END AS snippet,
        length(raw) AS size FROM re_hits""")
def mask_hits(spark, folder):
    """Masked evidence, as long as what it stands for."""
    rows = cl.with_sensitive_hits(cl.with_scan_gates(inp.bodies(spark, folder)))
    return rows.select("doc_id", F.explode("re_hits").alias("h")).select(
        "doc_id", F.col("h.name").alias("name"), F.col("h.snippet").alias("snippet"),
        F.length("h.raw").cast("bigint").alias("size"))


@query("command_snippets", f"""{_HITS}
    SELECT doc_id, name, CASE WHEN length(trim(raw)) <= 120 THEN trim(raw)
        ELSE left(trim(raw), 80) || '…' || right(trim(raw), 30) END AS snippet FROM dc_hits""")
def command_snippets(spark, folder):
    """Destructive commands as found."""
    rows = cl.with_destructive_hits(cl.with_scan_gates(inp.bodies(spark, folder)))
    return rows.select("doc_id", F.explode("dc_hits").alias("h")).select(
        "doc_id", F.col("h.name").alias("name"), F.col("h.snippet").alias("snippet"))


@query("score_documents", f"""{_SCORED}
    SELECT doc_id, round(re_score + 1e-12, 6) AS re_score, round(dc_score + 1e-12, 6) AS dc_score,
        round(tier1 + 1e-12, 6) AS tier1 FROM scored""")
def score_documents(spark, folder):
    """Both scan scores and their combination per document."""
    rows = _scanned(spark, folder)
    return rows.select("doc_id", scoring.rounded(F.col("re_score"), 6).alias("re_score"),
                       scoring.rounded(F.col("dc_score"), 6).alias("dc_score"),
                       scoring.rounded(scoring.combine(F.col("re_score"), F.col("dc_score")), 6)
                       .alias("tier1"))


@query("label_distribution", f"""{_SCORED}
    SELECT {inp.label_sql('tier1')} AS label, count(*) AS documents FROM scored GROUP BY 1""")
def label_distribution(spark, folder):
    """Documents per label."""
    rows = _scanned(spark, folder)
    return rows.groupBy(scoring.label_for(scoring.combine(
        F.col("re_score"), F.col("dc_score"))).alias("label")).agg(
        F.count("*").alias("documents"))


@query("destructive_counts", f"""{_HITS}
    SELECT name, count(DISTINCT doc_id) AS documents, count(*) AS hits FROM dc_hits
    GROUP BY name""")
def destructive_counts(spark, folder):
    """Documents and hits per destructive command."""
    rows = cl.with_destructive_hits(cl.with_scan_gates(inp.bodies(spark, folder)))
    return _counts(rows, "dc_hits")


@query("destructive_safe_suppressed", f"""{_HITS}
    SELECT name, count(*) AS suppressed FROM dc_spans d WHERE EXISTS (SELECT 1 FROM safe
        WHERE safe.doc_id = d.doc_id AND d.s < safe.e AND safe.s < d.e) GROUP BY name""")
def destructive_safe_suppressed(spark, folder):
    """Command hits that a safe idiom in the same place takes back."""
    rows = cl.with_scan_gates(inp.bodies(spark, folder))
    rows = rows.withColumn("safe", scan.safe_spans("text", "_lower", "_scannable"))
    rows = rows.withColumn("hits", scan.destructive_hits("text", "_lower", "_scannable", None,
                                                         limit=None))
    return rows.select(F.explode(F.expr(
        "filter(hits, h -> exists(safe, q -> h.start < q.end AND q.start < h.end))"))
        .alias("h")).groupBy(F.col("h.name").alias("name")).agg(
        F.count("*").alias("suppressed"))


@query("quick_reject", "WITH bodies AS (" + inp.BODIES_SQL + ") SELECT source, "
       "count(*) AS documents, sum(CASE WHEN "
       + " OR ".join(f"contains(lower(text), {inp._sql_text(k)})" for k in ct.DESTRUCTIVE_KEYWORDS)
       + " THEN 1 ELSE 0 END)::BIGINT AS scannable FROM bodies GROUP BY source")
def quick_reject(spark, folder):
    """How many texts per source pass the keyword test of the command scan."""
    rows = inp.bodies(spark, folder).withColumn("_lower", F.lower("text"))
    return rows.groupBy("source").agg(
        F.count("*").alias("documents"),
        F.sum(scan.may_be_destructive("_lower").cast("bigint")).alias("scannable"))


@query("hit_spans", f"""{_HITS}
    SELECT doc_id, name, s AS start, e AS "end", raw FROM dc_hits""")
def hit_spans(spark, folder):
    """Character spans of the command hits."""
    rows = cl.with_destructive_hits(cl.with_scan_gates(inp.bodies(spark, folder)))
    return rows.select("doc_id", F.explode("dc_hits").alias("h")).select(
        "doc_id", F.col("h.name").alias("name"), F.col("h.start").cast("bigint").alias("start"),
        F.col("h.end").cast("bigint").alias("end"), F.col("h.raw").alias("raw"))


@query("category_sets", f"""{_HITS},
    every AS (SELECT doc_id, category FROM re_hits UNION ALL SELECT doc_id, category FROM dc_hits)
    SELECT doc_id, string_agg(DISTINCT category, ';' ORDER BY category) AS categories
    FROM every GROUP BY doc_id""")
def category_sets(spark, folder):
    """Distinct sorted categories per document with findings."""
    rows = _scanned(spark, folder).withColumn("hits", F.concat("re_hits", "dc_hits")).withColumn(
        "t2", F.lit(0.0)).withColumn("trigger", F.lit(0.5)).filter(F.size("hits") > 0)
    return rows.select("doc_id", F.array_join(scoring.categories("hits", "t2", "trigger"), ";")
                       .alias("categories"))


@query("top_hit_names", f"""{_HITS},
    counted AS (SELECT doc_id, name, count(*) AS n, min(o * 1000000 + i) AS first FROM re_hits
        GROUP BY doc_id, name),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first) AS rn
        FROM counted)
    SELECT doc_id, string_agg(replace(name, '_', ' ') || ' ×' || n, ', ' ORDER BY rn) AS names
    FROM ranked WHERE rn <= 3 GROUP BY doc_id""")
def top_hit_names(spark, folder):
    """Three most frequent findings per document."""
    rows = cl.with_sensitive_hits(cl.with_scan_gates(inp.bodies(spark, folder)))
    return rows.filter(F.size("re_hits") > 0).select(
        "doc_id", scoring.top_names("re_hits").alias("names"))


_T2 = "(CASE WHEN doc_id % 7 = 0 THEN 0.9 WHEN doc_id % 7 = 1 THEN 0.2 ELSE 0.0 END)"
_WINDOWS = "(CASE WHEN doc_id % 2 = 0 THEN 6 ELSE 1 END)"
_BLEND = ("least(1.0, greatest(tier1, t2) + (1 - greatest(tier1, t2)) * least(tier1, t2) * 0.55)")


@query("blend_and_clamp", f"""{_SCORED},
    pathed AS (SELECT s.*, {inp.PATH} AS path, CAST({_T2} AS DOUBLE) AS t2 FROM scored s),
    blended AS (SELECT *, {_BLEND} AS sensitivity,
        split_part({inp.intent_sql('path', 'text')}, '|', 1) AS intent FROM pathed),
    eff AS (SELECT *, least(1.0, sensitivity * {inp.FACTOR_SQL}) AS effective FROM blended)
    SELECT doc_id, round(sensitivity + 1e-12, 4) AS sensitivity, intent,
        round(effective + 1e-12, 4) AS effective_sensitivity,
        {inp.clamp_sql(inp.label_sql('effective'), inp.DEMOTED_SQL)} AS label,
        CASE WHEN re_n + dc_n = 0 AND t2 >= (CASE WHEN {_WINDOWS} >= 5 THEN 0.1 ELSE 0.5 END)
            THEN 1 ELSE 0 END AS semantic FROM eff""")
def blend_and_clamp(spark, folder):
    """Token-model scores blended in, demoted and clamped by intent."""
    rows = inp.bodies(spark, folder).withColumn("path", F.expr(inp.PATH)).withColumn(
        "t2", F.expr(_T2).cast("double")).withColumn("windows", F.expr(_WINDOWS))
    rows = cl.classify_requests(rows, path="path", tier2="t2", windows="windows")
    return rows.select("doc_id", "sensitivity", "intent", "effective_sensitivity", "label",
                       F.array_contains("categories", "semantic").cast("int").alias("semantic"))


@query("critical_floor", f"""{_HITS}, {inp.scores_ctes()}
    SELECT doc_id, CASE WHEN dc_n > 0 THEN 'critical' ELSE 'clean' END AS label,
        CASE WHEN dc_n > 0 THEN 1.0 ELSE 0.0 END AS effective_sensitivity,
        round(dc_score + 1e-12, 4) AS sensitivity FROM scored""")
def critical_floor(spark, folder):
    """Documents taken as responses: any command is critical, nothing else counts."""
    rows = cl.classify_responses(inp.bodies(spark, folder))
    return rows.select("doc_id", "label", "effective_sensitivity", "sensitivity")


@query("mask_sample")
def mask_sample(spark, folder):
    """The first characters of each text with its secrets masked."""
    rows = cl.with_sensitive_hits(cl.with_scan_gates(inp.bodies(spark, folder)))
    return rows.select("doc_id", F.left(scan.masked_text("text", "re_hits"), F.lit(400))
                       .alias("sample"))


# --- text cleaning -----------------------------------------------------------

@query("scrub_metadata", f"""
    WITH scrubbed AS (SELECT doc_id, {inp.scrub_sql('(' + inp.TEXT + ')')} AS clean FROM documents)
    SELECT doc_id, length(clean) AS chars, md5(clean) AS digest FROM scrubbed""")
def scrub_metadata(spark, folder):
    """Texts without machine identifiers and the lines that held nothing else."""
    rows = inp.bodies(spark, folder).select("doc_id", tx.scrub_metadata("text").alias("clean"))
    return rows.select("doc_id", F.length("clean").cast("bigint").alias("chars"),
                       F.md5("clean").alias("digest"))


_CHAT = inp.pick("conv_id + turn", [
    "'next'", "'0f3c2a91-7d54-4be8-9a06-' || lpad(CAST(conv_id AS VARCHAR), 12, '0')",
    "'2024-01-01T10:00:00Z'", "'Asia/Calcutta'", "'abcdefghijklmnopqrstuv' || conv_id",
    "'..'", "'trace_id=' || repeat('0a1b', 9) || ' sent'", "'user'"])


@query("scrub_chat_lines", f"""
    WITH lined AS (SELECT conv_id, turn, {_CHAT} || chr(10) || text || chr(10) || 'v1' AS text
        FROM conversations),
    scrubbed AS (SELECT conv_id, turn, {inp.scrub_sql('text')} AS clean FROM lined)
    SELECT conv_id, turn, length(clean) AS chars, md5(clean) AS digest FROM scrubbed""")
def scrub_chat_lines(spark, folder):
    """Chat turns with routing lines around them, scrubbed."""
    lined = table(spark, folder, "conversations").select(
        "conv_id", "turn", F.expr(_CHAT.replace("VARCHAR", "STRING")
                                  + " || chr(10) || text || chr(10) || 'v1'").alias("text"))
    rows = lined.select("conv_id", "turn", tx.scrub_metadata("text").alias("clean"))
    return rows.select("conv_id", "turn", F.length("clean").cast("bigint").alias("chars"),
                       F.md5("clean").alias("digest"))


_GATE_SQL = f"SELECT doc_id, {inp.TYPE} AS content_type FROM documents"
_MEDIA = "lower(trim(split_part(content_type, ';', 1)))"


@query("ctype_gate", f"""
    WITH typed AS ({_GATE_SQL})
    SELECT content_type, CAST(count(*) AS BIGINT) AS documents,
        bool_or({' OR '.join(f"starts_with({_MEDIA}, '{p}')" for p in tx.REQUEST_MEDIA_TYPES)})
            AS request_ok,
        bool_or({' OR '.join(f"starts_with({_MEDIA}, '{p}')" for p in tx.RESPONSE_MEDIA_TYPES)})
            AS response_ok
    FROM typed GROUP BY content_type""")
def ctype_gate(spark, folder):
    """Which declared content types are scored, per direction."""
    rows = table(spark, folder, "documents").select(F.expr(inp.TYPE).alias("content_type"))
    return rows.groupBy("content_type").agg(
        F.count("*").alias("documents"),
        F.bool_or(tx.request_scorable("content_type")).alias("request_ok"),
        F.bool_or(tx.response_scorable("content_type")).alias("response_ok"))


_URL_PATH = "regexp_replace(url, '^[a-z]+://[^/?#]*', '')"
_ASSET = inp.pick("page_id", ["''", "'/cdn/x'", "'/app.js?v=1'", "'/release-notes'", "'/a.PNG'"])
_BARE = f"split_part(lower({_URL_PATH} || {_ASSET}), '?', 1)"


@query("path_gate", f"""
    SELECT page_id, ({' OR '.join(f"ends_with({_BARE}, '{e}')" for e in tx.NON_MODEL_EXTENSIONS)})
        OR ({' OR '.join(f"contains({_BARE}, '{s}')" for s in tx.NON_MODEL_SUBSTRINGS)})
        AS non_model FROM pages""")
def path_gate(spark, folder):
    """Paths whose bodies are no model output."""
    rows = table(spark, folder, "pages").select(
        "page_id", F.expr(f"{_URL_PATH} || {_ASSET}").alias("path"))
    return rows.select("page_id", tx.non_model_path("path").alias("non_model"))


_MAGIC = inp.pick("doc_id", ["'1f8b08'", "'789c'", "'78da'", "''", "''"])
#: Control bytes behind a whole text: as many as it has, or none.
_CONTROLS = "repeat(chr(1), CASE WHEN doc_id % 5 = 3 THEN octet_length(text) ELSE 0 END)"


@query("binary_body", """
    SELECT doc_id, doc_id % 5 < 3 OR (doc_id % 5 = 3 AND strlen(text) > 0) AS looks_binary FROM documents""")
def binary_body(spark, folder):
    """Bodies that are compressed or full of control bytes; here these come last."""
    rows = table(spark, folder, "documents").select("doc_id", F.expr(
        f"cast(concat(unhex({_MAGIC}), cast(text AS binary), cast({_CONTROLS} AS binary)) AS binary)").alias("body"))
    return rows.select("doc_id", tx.looks_binary("body").alias("looks_binary"))


@query("decode_bodies", f"""
    SELECT doc_id, length(t) AS chars, md5(t) AS digest FROM (SELECT doc_id, CASE
        WHEN NOT ({' OR '.join(f"starts_with({_MEDIA}, '{p}')" for p in tx.REQUEST_MEDIA_TYPES)})
            THEN '' WHEN doc_id % 11 = 5 AND 1.0 / (length(text) + 1) > 0.05 THEN ''
        WHEN doc_id % 11 = 5 THEN chr(65533) || text ELSE text END AS t
        FROM (SELECT doc_id, text, {inp.TYPE} AS content_type FROM documents))""")
def decode_bodies(spark, folder):
    """Binary bodies decoded where their type says text; some start with a broken byte."""
    rows = table(spark, folder, "documents").select(
        "doc_id", F.expr(inp.TYPE).alias("content_type"), F.expr(
            "CASE WHEN doc_id % 11 = 5 THEN concat(unhex('ff'), cast(text AS binary)) "
            "ELSE cast(text AS binary) END").alias("body"))
    rows = rows.select("doc_id", tx.decode_body("body", "content_type").alias("t"))
    return rows.select("doc_id", F.length("t").cast("bigint").alias("chars"),
                       F.md5("t").alias("digest"))


@query("flatten_json", f"""
    WITH bodies AS ({inp.BODIES_SQL}),
    flat AS (SELECT doc_id, 'm"1' || chr(10) || 'user' || chr(10) || text || chr(10) || source
        || chr(10) || 'tail' AS t FROM bodies)
    SELECT doc_id, length(t) AS chars, md5(t) AS digest FROM flat""")
def flatten_json(spark, folder):
    """String leaves of JSON bodies, in document order, keys left out."""
    rows = inp.bodies(spark, folder).select("doc_id", F.lit("application/json").alias("ct"), F.to_json(
        F.struct(F.lit('m"1').alias("model"), F.lit(7).alias("n"),
                 F.array(F.struct(F.lit("user").alias("role"), F.col("text").alias("content")))
                 .alias("messages"),
                 F.struct(F.col("source").alias("key:with colon"), F.lit(None).alias("none"),
                          F.lit("tail").alias("z")).alias("meta"))).alias("body"))
    rows = rows.select("doc_id", tx.flatten_json("body", "ct").alias("t"))
    return rows.select("doc_id", F.length("t").cast("bigint").alias("chars"),
                       F.md5("t").alias("digest"))


@query("collapse_whitespace", """
    SELECT doc_id, md5(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS digest FROM documents""")
def collapse_whitespace(spark, folder):
    """Texts with every run of whitespace as one space."""
    rows = table(spark, folder, "documents")
    return rows.select("doc_id", F.md5(tx.collapse_whitespace("text")).alias("digest"))


# --- intent ------------------------------------------------------------------
_INTENT_TEXT = ("CASE WHEN doc_id % 13 = 4 THEN 'gAAAAA' || text "
                "WHEN doc_id % 13 = 7 THEN '{\"messages\": 1}' || text "
                "WHEN doc_id % 13 = 9 THEN 'x' || chr(10) || 'user' || chr(10) || 'text' "
                "|| chr(10) || text ELSE text END")


@query("intent_rules", f"""
    WITH shaped AS (SELECT doc_id, {inp.PATH} AS path, {_INTENT_TEXT} AS text FROM documents)
    SELECT doc_id, split_part({inp.intent_sql('path', 'text')}, '|', 1) AS intent,
        CAST(split_part({inp.intent_sql('path', 'text')}, '|', 2) AS DOUBLE) AS confidence
    FROM shaped""")
def intent_rules(spark, folder):
    """Intent and confidence of each request by the rule cascade."""
    rows = table(spark, folder, "documents").select(
        "doc_id", F.expr(inp.PATH).alias("path"), F.expr(_INTENT_TEXT).alias("text"))
    return rows.select("doc_id", it.classify_intent("path", "text").alias("i")).select(
        "doc_id", F.col("i.intent").alias("intent"), F.col("i.confidence").alias("confidence"))


@query("intent_by_label", f"""WITH {inp.EVENTS_CTE}
    SELECT intent, label, count(*) AS events FROM events_log GROUP BY intent, label""")
def intent_by_label(spark, folder):
    """Events per intent and label."""
    return inp.event_log(spark, folder).groupBy("intent", "label").agg(
        F.count("*").alias("events"))
