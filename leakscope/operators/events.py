"""The event table: filters, pages, rollups, export rows, alerts, purge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leakscope.functions import scoring
from leakscope.functions.catalog import DESTRUCTIVE
from leakscope.operators.classify import with_destructive_hits, with_scan_gates
from leakscope.functions.scan import hit_score, public_hits

HIT = "array<struct<name:string,category:string,weight:double,snippet:string>>"
FIELDS = {
    "id": "bigint",
    "ts": "timestamp",
    "host": "string",
    "provider": "string",
    "method": "string",
    "path": "string",
    "sensitivity": "double",
    "tier1_score": "double",
    "tier2_score": "double",
    "label": "string",
    "categories": "array<string>",
    "hits": HIT,
    "summary": "string",
    "bytes_out": "bigint",
    "sample": "string",
    "intent": "string",
    "intent_conf": "double",
    "effective_sensitivity": "double",
    "direction": "string",
}
SCHEMA = ", ".join(f"{name} {kind}" for name, kind in FIELDS.items())
COLUMNS = tuple(FIELDS)

# --- fixed values: what older tables lack ------------------------------------
DEFAULTS = {"intent": "unknown", "intent_conf": 0.0, "effective_sensitivity": 0.0,
            "direction": "request"}
EXPORT_COLUMNS = (
    "id", "ts", "provider", "host", "method", "path", "label", "sensitivity",
    "effective_sensitivity", "tier1_score", "tier2_score", "intent", "intent_conf",
    "categories", "hit_names", "hit_categories", "summary", "bytes_out", "sample",
)
EXPORT_FLOOR = 0.15
# --- fixed values: what each purge scope runs --------------------------------
PURGE_SCOPES = {
    "events": ("DELETE FROM events", "DELETE FROM sqlite_sequence WHERE name='events'"),
    "events_and_admin": ("DELETE FROM events", "DELETE FROM domains",
                         "DELETE FROM sqlite_sequence"),
    "full": ("DROP TABLE IF EXISTS events", "DROP TABLE IF EXISTS domains"),
}


def normalise(events: DataFrame) -> DataFrame:
    """Add columns an older table lacks and fill their gaps with the defaults."""
    for name, value in DEFAULTS.items():
        default = F.lit(value)
        events = events.withColumn(
            name, F.coalesce(F.col(name), default) if name in events.columns else default)
    return events


def shown_score(effective: str = "effective_sensitivity", raw: str = "sensitivity") -> Column:
    """The demoted score, or the raw one where no demoted score was kept."""
    return F.coalesce(F.nullif(F.col(effective), F.lit(0.0)), F.col(raw))


def filter_events(events: DataFrame, provider: str | None = None,
                  min_sensitivity: float | None = None, intent: str | None = None,
                  direction: str | None = None) -> DataFrame:
    if provider:
        events = events.filter(F.col("provider") == provider)
    if min_sensitivity is not None:
        # the plain disjunct repeats the filter in a form the file scan can prune with
        events = events.filter((F.col("effective_sensitivity") >= min_sensitivity)
                               | (F.col("sensitivity") >= min_sensitivity))
        events = events.filter(shown_score() >= min_sensitivity)
    if intent:
        events = events.filter(F.col("intent") == intent)
    if direction:
        events = events.filter(F.col("direction") == direction)
    return events


def page(events: DataFrame, limit: int = 100, offset: int = 0, **filters) -> DataFrame:
    """Latest first; a top-n over the id, not a sort of the table."""
    rows = filter_events(events, **filters).orderBy(F.col("id").desc())
    return (rows.offset(offset) if offset else rows).limit(limit)


def event_by_id(events: DataFrame, event_id: int) -> DataFrame:
    return events.filter(F.col("id") == event_id)


def count_by_label(events: DataFrame) -> DataFrame:
    return events.groupBy("label").agg(F.count("*").alias("events"))


def provider_rollup(events: DataFrame) -> DataFrame:
    """Per provider, by the raw score, busiest first."""
    return events.groupBy("provider").agg(
        F.count("*").alias("events"), F.avg("sensitivity").alias("avg_sensitivity"),
        F.max("sensitivity").alias("max_sensitivity"), F.sum("bytes_out").alias("bytes_out"),
    ).orderBy(F.col("events").desc(), "provider")


def totals(events: DataFrame) -> DataFrame:
    """Headline numbers in one pass.  Providers are counted from their per-provider partial
    sums, so no distinct expansion of the event rows takes place."""
    per_provider = events.groupBy("provider").agg(
        F.count("*").alias("n"), F.sum((F.col("label") != "clean").cast("bigint")).alias("f"),
        F.sum("bytes_out").alias("b"), F.max("ts").alias("t"))
    return per_provider.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"),
        F.coalesce(F.sum("f"), F.lit(0)).alias("flagged"),
        F.count("provider").alias("providers"),
        F.coalesce(F.sum("b"), F.lit(0)).alias("bytes_out"), F.max("t").alias("last_event_ts"))


def provider_bands(events: DataFrame) -> DataFrame:
    rows = provider_rollup(events)
    return rows.select("provider", "events",
                       F.floor(F.col("avg_sensitivity") * 100 + 0.5).alias("avg_percent"),
                       F.floor(F.col("max_sensitivity") * 100 + 0.5).alias("max_percent"),
                       scoring.band(F.col("avg_sensitivity")).alias("band"))


def flagged(events: DataFrame) -> DataFrame:
    return events.filter(F.col("label") != "clean")


def export_rows(events: DataFrame, min_sensitivity: float = EXPORT_FLOOR,
                provider: str | None = None, label: str | None = None,
                intent: str | None = None, limit: int | None = None) -> DataFrame:
    """Flat rows for a CSV, all of them or one page of the latest.  Label and intent lists
    apply after the limit of a page."""
    rows = filter_events(events, provider=provider, min_sensitivity=min_sensitivity)
    if limit is not None:
        rows = page(rows, limit)
    for column, wanted in (("label", label), ("intent", intent)):
        names = [x.strip() for x in (wanted or "").split(",") if x.strip()]
        if names:
            rows = rows.filter(F.col(column).isin(*names))

    def fixed(name: str, places: int) -> Column:
        return F.format_string(f"%.{places}f", F.coalesce(F.col(name), F.lit(0.0)))

    shaped = {
        "ts": F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ssXXX"),
        "sensitivity": fixed("sensitivity", 4),
        "effective_sensitivity": fixed("effective_sensitivity", 4),
        "tier1_score": fixed("tier1_score", 4), "tier2_score": fixed("tier2_score", 4),
        "intent_conf": fixed("intent_conf", 3), "categories": F.array_join("categories", ";"),
        "hit_names": F.expr("array_join(transform(hits, h -> h.name), ';')"),
        "hit_categories": F.expr("array_join(transform(hits, h -> h.category), ';')"),
    }
    return rows.select(*[shaped.get(c, F.col(c)).alias(c) for c in EXPORT_COLUMNS])


def critical_alerts(events: DataFrame, after_id: int = 0) -> DataFrame:
    """Critical responses newer than the last one seen, oldest first."""
    return events.filter((F.col("direction") == "response") & (F.col("label") == "critical")
                         & (F.col("id") > after_id)).orderBy("id")


def new_alerts(events: DataFrame, marks: str) -> DataFrame:
    """Critical responses since the last look, oldest first.

    ``marks`` is a folder of looks, one small table each with the highest event id seen. The first
    look reports nothing, as all it sees is history; a restart goes on from the last mark. The
    result is written with the mark's look and read from there, so that a repeated action does
    not look again.
    """
    spark = events.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(marks)
    there = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    done = [f.getPath().getName() for f in there.listStatus(folder)] if there.exists(folder) else []
    looks = sorted(int(name.removeprefix("look=")) for name in done if there.exists(
        spark._jvm.org.apache.hadoop.fs.Path(f"{marks}/{name}/mark/_SUCCESS")))
    last = spark.read.parquet(f"{marks}/look={looks[-1]}/mark").first()["last"] if looks else None
    at = f"{marks}/look={looks[-1] + 1 if looks else 0}"
    found = critical_alerts(events, last) if last is not None else events.limit(0)
    found.write.mode("overwrite").parquet(f"{at}/alerts")
    newest = events.agg(F.max("id").alias("last")).select(F.greatest("last", F.lit(last)).alias("last") if last is not None else F.coalesce("last", F.lit(0)).alias("last"))
    newest.write.mode("overwrite").parquet(f"{at}/mark")   # last: a look without its mark is done again
    return spark.read.schema(found.schema).parquet(f"{at}/alerts").orderBy("id")


CSV = {"header": "true", "escape": '"', "multiLine": "true", "ignoreLeadingWhiteSpace": "false",
       "ignoreTrailingWhiteSpace": "false", "nullValue": "\\N"}


def write_csv(rows: DataFrame, path: str) -> None:
    """The export as CSV files with a header; quotes inside a value are doubled."""
    rows.write.options(**CSV).csv(path)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """An export as it was written: all columns are text but id and bytes_out."""
    types = {"id": "bigint", "bytes_out": "bigint"}
    schema = ", ".join(f"{c} {types.get(c, 'string')}" for c in EXPORT_COLUMNS)
    return spark.read.schema(schema).options(**CSV).csv(path)


def audit_event(spark: SparkSession, scope: str, ts: str) -> DataFrame:
    """The audit row of a purge, scored by the destructive scan of its statements."""
    text = ";\n".join(PURGE_SCOPES[scope]) + ";"
    row = spark.createDataFrame([(text,)], "text string")
    row = with_destructive_hits(with_scan_gates(row), "text", DESTRUCTIVE)
    row = row.withColumn("score", hit_score("dc_hits"))
    score = F.col("score")
    shown = scoring.label_for(score)   # a purge is never shown below medium
    label = F.when(shown.isin("critical", "high"), shown).otherwise("medium")
    return row.select(
        F.lit(ts).cast("timestamp").alias("ts"), F.lit("internal").alias("host"),
        F.lit("Administration").alias("provider"), F.lit("POST").alias("method"),
        F.lit(f"/admin/purge:{scope}").alias("path"), score.alias("sensitivity"),
        score.alias("tier1_score"), F.lit(0.0).alias("tier2_score"), label.alias("label"),
        F.expr("array_sort(array_distinct(transform(dc_hits, h -> h.category)))")
        .alias("categories"), public_hits("dc_hits").alias("hits"),
        F.lit(f"Rows of scope {scope} were purged on request").alias("summary"),
        F.octet_length("text").cast("bigint").alias("bytes_out"), F.col("text").alias("sample"),
        F.lit("admin").alias("intent"), F.lit(1.0).alias("intent_conf"),
        score.alias("effective_sensitivity"), F.lit("admin").alias("direction"))
