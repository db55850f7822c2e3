"""Queries over the event table, and over identity signals."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from leakscope.functions import scoring
from leakscope.operators import classify as cl
from leakscope.operators import events as ev
from leakscope.operators import identity as idn
from leakscope.plans import inputs as inp
from leakscope.plans.registry import query
from leakscope.session import checkpoint_dir, written
from leakscope.sources.tables import table

_LOG = f"WITH {inp.EVENTS_CTE}"
_SHOWN = "coalesce(nullif(effective_sensitivity, 0), sensitivity)"


@query("event_summary", f"""{_LOG}
    SELECT label, count(*) AS events, CAST(epoch(max(ts)) AS BIGINT) AS last_ts FROM events_log
    GROUP BY label""")
def event_summary(spark, folder):
    """Events per label and the time of the latest."""
    return inp.event_log(spark, folder).groupBy("label").agg(
        F.count("*").alias("events"), F.unix_timestamp(F.max("ts")).alias("last_ts"))


@query("provider_rollup", f"""{_LOG}
    SELECT provider, count(*) AS events, round(avg(sensitivity) + 1e-12, 6) AS avg_sensitivity,
        max(sensitivity) AS max_sensitivity, sum(bytes_out)::BIGINT AS bytes_out
    FROM events_log GROUP BY provider""")
def provider_rollup(spark, folder):
    """Count, average and highest raw score, and bytes per provider."""
    return ev.provider_rollup(inp.event_log(spark, folder)).withColumn(
        "avg_sensitivity", scoring.rounded(F.col("avg_sensitivity"), 6))


@query("hero_stats", f"""{_LOG}
    SELECT count(*) AS total, sum(CASE WHEN label <> 'clean' THEN 1 ELSE 0 END)::BIGINT AS flagged,
        count(DISTINCT provider) AS providers, sum(bytes_out)::BIGINT AS bytes_out,
        CAST(epoch(max(ts)) AS BIGINT) AS last_event FROM events_log""")
def hero_stats(spark, folder):
    """Headline numbers."""
    return ev.totals(inp.event_log(spark, folder)).select(
        "total", "flagged", "providers", "bytes_out",
        F.unix_timestamp("last_event_ts").alias("last_event"))


@query("provider_band", f"""{_LOG},
    rolled AS (SELECT provider, floor(avg(sensitivity) * 100 + 0.5)::BIGINT AS avg_percent,
        floor(max(sensitivity) * 100 + 0.5)::BIGINT AS max_percent FROM events_log GROUP BY provider)
    SELECT *, CASE WHEN avg_percent >= 65 THEN 'high' WHEN avg_percent >= 40 THEN 'medium'
        WHEN avg_percent >= 15 THEN 'low' ELSE 'clean' END AS band FROM rolled""")
def provider_band(spark, folder):
    """Colour band of each provider's average."""
    return ev.provider_bands(inp.event_log(spark, folder)).select(
        "provider", "avg_percent", "max_percent", "band")


@query("event_page", f"""{_LOG}
    SELECT id, provider, label, sensitivity FROM events_log ORDER BY id DESC LIMIT 50 OFFSET 25""")
def event_page(spark, folder):
    """One page of the latest events."""
    return ev.page(inp.event_log(spark, folder), limit=50, offset=25).select(
        "id", "provider", "label", "sensitivity")


@query("event_filter_effective", f"""{_LOG}
    SELECT id, intent, direction, effective_sensitivity FROM events_log
    WHERE {_SHOWN} >= 0.15 AND direction = 'request' AND intent = 'chat'""")
def event_filter_effective(spark, folder):
    """Events over a threshold of the shown score, by intent and direction."""
    rows = ev.filter_events(inp.event_log(spark, folder), min_sensitivity=0.15, intent="chat",
                            direction="request")
    return rows.select("id", "intent", "direction", "effective_sensitivity")


@query("event_lookup", f"""{_LOG}
    SELECT id, provider, label, summary_free FROM (SELECT id, provider, label,
        path AS summary_free FROM events_log) WHERE id = 77""")
def event_lookup(spark, folder):
    """One event by its id."""
    return ev.event_by_id(inp.event_log(spark, folder), 77).select(
        "id", "provider", "label", F.col("path").alias("summary_free"))


@query("flagged_events", f"""{_LOG} SELECT id, label FROM events_log WHERE label <> 'clean'""")
def flagged_events(spark, folder):
    """Every event that is not clean."""
    return ev.flagged(inp.event_log(spark, folder)).select("id", "label")


@query("export_rows", f"""{_LOG},
    page AS (SELECT * FROM events_log WHERE {_SHOWN} >= 0.15 ORDER BY id DESC LIMIT 200),
    named AS (SELECT doc_id, 0 AS part, nth, name, category FROM re_hits
        UNION ALL SELECT doc_id, 1, nth, name, category FROM dc_hits),
    listed AS (SELECT doc_id, string_agg(name, ';' ORDER BY part, nth) AS hit_names,
        string_agg(category, ';' ORDER BY part, nth) AS hit_categories,
        string_agg(DISTINCT category, ';' ORDER BY category) AS categories
        FROM named GROUP BY doc_id)
    SELECT id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS ts, provider, host, method, path, label,
        printf('%.4f', sensitivity) AS sensitivity,
        printf('%.4f', effective_sensitivity) AS effective_sensitivity,
        printf('%.4f', tier1_score) AS tier1_score, '0.0000' AS tier2_score,
        printf('%.3f', intent_conf) AS intent_conf, intent, bytes_out, categories, hit_names,
        hit_categories
    FROM page JOIN listed ON listed.doc_id = page.id
    WHERE label IN ('medium', 'high', 'critical') AND intent IN ('chat', 'unknown')""")
def export_rows(spark, folder):
    """Flat rows of flagged events; label and intent lists apply after the limit."""
    rows = ev.export_rows(inp.event_log(spark, folder, True), label="medium,high,critical",
                          intent="chat, unknown", limit=200)
    return rows.drop("summary", "sample")


@query("export_csv", f"""{_LOG},
    page AS (SELECT * FROM events_log WHERE {_SHOWN} >= 0.15),
    named AS (SELECT doc_id, 0 AS part, nth, name, category FROM re_hits
        UNION ALL SELECT doc_id, 1, nth, name, category FROM dc_hits),
    listed AS (SELECT doc_id, string_agg(name, ';' ORDER BY part, nth) AS hit_names,
        string_agg(category, ';' ORDER BY part, nth) AS hit_categories,
        string_agg(DISTINCT category, ';' ORDER BY category) AS categories
        FROM named GROUP BY doc_id)
    SELECT id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS ts, provider, host, method, path, label,
        printf('%.4f', sensitivity) AS sensitivity,
        printf('%.4f', effective_sensitivity) AS effective_sensitivity,
        printf('%.4f', tier1_score) AS tier1_score, '0.0000' AS tier2_score,
        printf('%.3f', intent_conf) AS intent_conf, intent, bytes_out, categories, hit_names,
        hit_categories
    FROM page JOIN listed ON listed.doc_id = page.id""")
def export_csv(spark, folder):
    """Every event of the export, written as CSV files and read back."""
    path = f"{checkpoint_dir(spark)}/export-{uuid.uuid4().hex}"
    ev.write_csv(ev.export_rows(inp.event_log(spark, folder, True)), path)
    return ev.read_csv(spark, path).drop("summary", "sample")


@query("new_alerts", f"""{_LOG}
    SELECT id, provider FROM events_log WHERE direction = 'response' AND label = 'critical'
        AND id > (SELECT avg(id) FROM events_log)""")
def new_alerts(spark, folder):
    """Alerts of a second look: the first one, at the older half of the events, sets the mark and reports none."""
    events = written(inp.event_log(spark, folder, True), "events")   # both looks read it several times
    last = events.agg(F.avg("id").alias("last"))
    marks = f"{checkpoint_dir(spark)}/marks-{uuid.uuid4().hex}"
    ev.new_alerts(events.join(last, F.col("id") <= F.col("last")).drop("last"), marks)
    return ev.new_alerts(events, marks).select("id", "provider")


@query("critical_alerts", f"""{_LOG}
    SELECT id, provider FROM events_log WHERE direction = 'response' AND label = 'critical'
        AND id > 100""")
def critical_alerts(spark, folder):
    """Critical responses after the last one seen."""
    return ev.critical_alerts(inp.event_log(spark, folder), after_id=100).select("id", "provider")


# --- identity ----------------------------------------------------------------
# Each event is a short text of its user: their own mail often, others' now and then.

_SIGNAL_TEXT = (
    "'signed in as User' || user_id || '@mail.example.com from ' || "
    "CASE WHEN event_id % 3 = 0 THEN '10.0.' || (user_id % 200) || '.' || (event_id % 4) "
    "ELSE '93.184.' || (user_id % 200) || '.7' END || "
    "CASE WHEN event_id % 6 = 0 THEN ' for guest' || (event_id % 5) || '@post.example.org' "
    "ELSE '' END")


def signal_texts(spark, folder):
    return table(spark, folder, "events").select(
        F.col("user_id").alias("tenant_id"), "ts", "event_id",
        F.expr(_SIGNAL_TEXT.replace("user_id ||", "cast(user_id AS string) ||")).alias("text"))


def signal_rows(spark, folder):
    return idn.signals(cl.with_sensitive_hits(cl.with_scan_gates(signal_texts(spark, folder)), "text", idn.PATTERNS))


_SIGNALS = f"""
    texts AS (SELECT user_id AS tenant_id, ts, event_id, {_SIGNAL_TEXT} AS text FROM events),
    found AS (
        SELECT tenant_id, ts, event_id, 'email' AS kind, lower(unnest(regexp_extract_all(text,
            '\\b[A-Za-z0-9._%+\\-]{{2,}}@[A-Za-z0-9.\\-]+\\.[A-Za-z]{{2,}}\\b'))) AS value FROM texts
        UNION ALL SELECT tenant_id, ts, event_id, 'ip', unnest(regexp_extract_all(text,
            '\\b(?:\\d{{1,3}}\\.){{3}}\\d{{1,3}}\\b')) FROM texts
        UNION ALL SELECT tenant_id, ts, event_id, 'ip', unnest(regexp_extract_all(text,
            '\\b(?:10\\.\\d{{1,3}}\\.\\d{{1,3}}\\.\\d{{1,3}})\\b')) FROM texts),
    counted AS (SELECT tenant_id, kind, value, count(*) AS n, min(ts) AS first_seen,
        max(ts) AS last_seen FROM found GROUP BY tenant_id, kind, value)"""
_AS_OF = "TIMESTAMP '2024-01-30 00:00:00'"
_QUALIFIED = f"""
    ranked AS (SELECT *, row_number() OVER (PARTITION BY tenant_id, kind
        ORDER BY n DESC, last_seen DESC, value) AS rank FROM counted
        WHERE n >= 5 AND last_seen >= {_AS_OF} - INTERVAL 24 HOURS),
    owned AS (SELECT * FROM ranked WHERE rank <= CASE kind WHEN 'email' THEN 1 ELSE 2 END)"""


def _owned(spark, folder):
    return idn.qualified(idn.count_signals(signal_rows(spark, folder)), F.expr(_AS_OF))


@query("identity_counts", f"""WITH {_SIGNALS}
    SELECT tenant_id, kind, value, n, CAST(epoch_us(first_seen) AS BIGINT) AS first_us,
        CAST(epoch_us(last_seen) AS BIGINT) AS last_us FROM counted""")
def identity_counts(spark, folder):
    """How often and when each tenant's values were seen."""
    rows = idn.count_signals(signal_rows(spark, folder))
    return rows.select("tenant_id", "kind", "value", F.col("count").alias("n"),
                       F.unix_micros(F.col("first_seen").cast("timestamp")).alias("first_us"),
                       F.unix_micros(F.col("last_seen").cast("timestamp")).alias("last_us"))


@query("identity_merge_forget", f"""WITH {_SIGNALS}
    SELECT tenant_id, kind, value, n FROM counted
    WHERE NOT (kind = 'email' AND contains(value, 'guest3'))""")
def identity_merge_forget(spark, folder):
    """Counts of two halves merged, one value taken back."""
    rows = signal_rows(spark, folder)
    state = idn.merge_counts(idn.count_signals(rows.filter("event_id % 2 = 0")),
                             idn.count_signals(rows.filter("event_id % 2 = 1")))
    gone = state.filter("kind = 'email' AND contains(value, 'guest3')").select(
        "tenant_id", "kind", F.upper("value").alias("value"))
    return idn.forget(state, gone).select("tenant_id", "kind", "value", F.col("count").alias("n"))


@query("identity_qualified", f"""WITH {_SIGNALS}, {_QUALIFIED}
    SELECT tenant_id, kind, value, n, CAST(rank AS INT) AS rank FROM owned""")
def identity_qualified(spark, folder):
    """Values each tenant owns at a point in time."""
    return _owned(spark, folder).select("tenant_id", "kind", "value",
                                        F.col("count").alias("n"), "rank")


@query("identity_masked", f"""WITH {_SIGNALS}, {_QUALIFIED}
    SELECT tenant_id, kind, CASE WHEN kind = 'email' THEN
        CASE WHEN length(split_part(value, '@', 1)) > 2 THEN left(value, 2) || '***' ELSE '***' END
        || '@' || split_part(value, '@', 2) ELSE value END AS shown FROM owned WHERE rank = 1""")
def identity_masked(spark, folder):
    """The top value of each kind, as displayed."""
    rows = _owned(spark, folder).filter("rank = 1")
    return rows.select("tenant_id", "kind",
                       idn.shown_value(F.col("kind"), F.col("value")).alias("shown"))


@query("identity_owned_check", f"""WITH {_SIGNALS}, {_QUALIFIED}
    SELECT DISTINCT c.tenant_id, c.kind, c.value FROM counted c JOIN owned o
        USING (tenant_id, kind, value)""")
def identity_owned_check(spark, folder):
    """Which of the asked values are user-owned."""
    seen = idn.count_signals(signal_rows(spark, folder)).select(
        "tenant_id", "kind", F.when(F.col("kind") == "email", F.upper("value"))
        .otherwise(F.col("value")).alias("value"))
    asked = seen.unionByName(seen.withColumn("value", F.concat(F.lit("not."), F.col("value"))))
    return idn.owned_by(asked, _owned(spark, folder))


@query("identity_exempt_scores", f"""WITH {_SIGNALS}, {_QUALIFIED},
    weighed AS (SELECT f.event_id, CASE WHEN o.value IS NOT NULL THEN 0.05
        WHEN f.kind = 'email' THEN 0.4 ELSE f.w END AS w, o.value IS NOT NULL AS exempt
        FROM (SELECT *, CASE WHEN starts_with(value, '10.') AND row_number() OVER (
            PARTITION BY event_id, kind, value) = 2 THEN 0.55 ELSE 0.25 END AS w FROM found) f
        LEFT JOIN owned o USING (tenant_id, kind, value)),
    hosts AS (SELECT event_id, 0.0 AS w, false AS exempt FROM texts),
    every AS (SELECT * FROM weighed UNION ALL SELECT * FROM hosts)
    SELECT event_id, round(1 - product(1 - w * 0.6) + 1e-12, 6) AS score,
        sum(CASE WHEN exempt THEN 1 ELSE 0 END)::BIGINT AS exempted FROM every GROUP BY event_id""")
def identity_exempt_scores(spark, folder):
    """Scores after the values a tenant owns are demoted."""
    from leakscope.functions import scan
    rows = cl.with_sensitive_hits(cl.with_scan_gates(signal_texts(spark, folder)))
    rows = cl.with_owned_values(rows, _owned(spark, folder))
    return rows.select("event_id", scoring.rounded(scan.hit_score("re_hits"), 6).alias("score"),
                       F.expr("cast(size(filter(re_hits, h -> h.category = 'user_identity')) "
                              "AS bigint)").alias("exempted"))


@query("identity_running", f"""WITH {_SIGNALS},
    per_event AS (SELECT tenant_id, kind, value, ts, event_id, count(*) AS n FROM found
        GROUP BY ALL)
    SELECT tenant_id, kind, value, event_id, n, CAST(sum(n) OVER (PARTITION BY tenant_id, kind,
        value ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running
    FROM per_event""")
def identity_running(spark, folder):
    """Count of each value so far, at every event."""
    return idn.running_counts(signal_rows(spark, folder)).select(
        "tenant_id", "kind", "value", "event_id", "n", "running")


@query("identity_running_exempt", f"""WITH {_SIGNALS},
    per_event AS (SELECT tenant_id, kind, value, ts, event_id, count(*) AS n FROM found
        GROUP BY ALL),
    running AS (SELECT *, sum(n) OVER (PARTITION BY tenant_id, kind, value ORDER BY ts, event_id
        ROWS UNBOUNDED PRECEDING) AS upto, lead(event_id) OVER (PARTITION BY tenant_id, kind,
        value ORDER BY ts, event_id) AS next_id FROM per_event),
    rivals AS (SELECT a.tenant_id, a.kind, a.value, a.event_id, count(b.value) AS better
        FROM running a LEFT JOIN running b ON a.tenant_id = b.tenant_id AND a.kind = b.kind
            AND b.value <> a.value AND b.event_id <= a.event_id
            AND (b.next_id IS NULL OR b.next_id > a.event_id)
            AND b.upto >= 5 AND b.ts >= a.ts - INTERVAL 24 HOURS
            AND (b.upto > a.upto OR (b.upto = a.upto AND (b.ts > a.ts
                OR (b.ts = a.ts AND b.value < a.value))))
        GROUP BY ALL)
    SELECT r.tenant_id, r.kind, r.value, r.event_id, r.upto >= 5
        AND v.better < CASE r.kind WHEN 'email' THEN 1 ELSE 2 END AS exempt
    FROM running r JOIN rivals v USING (tenant_id, kind, value, event_id)""")
def identity_running_exempt(spark, folder):
    """Whether each value was owned at the moment of each event."""
    return idn.running_exemption(signal_rows(spark, folder)).select(
        "tenant_id", "kind", "value", "event_id", "exempt")
