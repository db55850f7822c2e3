"""Capture records: one JSON object per request."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_HIT = "array<struct<name:string,category:string,weight:double,snippet:string>>"
FIELDS = {
    "ts": "timestamp",
    "event_id": "bigint",
    "tenant_id": "string",
    "flow_id": "string",
    "host": "string",
    "provider": "string",
    "method": "string",
    "path": "string",
    "headers": "map<string,string>",
    "body_bytes": "bigint",
    "body_truncated": "boolean",
    "body_text": "string",
    "body_base64": "string",
    "classifier": "struct<intent:string,intent_conf:double,label:string,sensitivity:double,"
                  "effective_sensitivity:double,tier1_score:double,tier2_score:double,"
                  f"categories:array<string>,hits:{_HIT}>",
}
SCHEMA = ", ".join(f"{name} {kind}" for name, kind in FIELDS.items())
_CORRUPT = "_corrupt"

# --- fixed values ------------------------------------------------------------
KEPT_HEADERS = (
    "content-type", "accept", "user-agent", "x-stainless-os", "x-stainless-runtime",
    "x-stainless-package-version", "anthropic-version", "openai-version", "x-request-id",
)


def read_captures(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Records with ``_corrupt`` set on lines that are not JSON; blank lines are skipped."""
    reader = spark.readStream if stream else spark.read
    # parsed by a function, as a file reader refuses queries on the corrupt lines alone
    record = F.from_json("value", f"{SCHEMA}, {_CORRUPT} string",
                         {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT})
    return (reader.text(path).filter(F.trim("value") != "")
            .select(record.alias("record")).select("record.*"))


def good_records(records: DataFrame) -> DataFrame:
    return records.filter(F.col(_CORRUPT).isNull()).drop(_CORRUPT)


def skip_counts(records: DataFrame) -> DataFrame:
    """How many lines were skipped, by reason."""
    return (records.filter(F.col(_CORRUPT).isNotNull())
            .groupBy(F.lit("bad-json").alias("reason")).agg(F.count("*").alias("rows")))


def kept_headers(headers: str) -> Column:
    """Allow-listed headers, names in lower case."""
    names = ", ".join(f"'{h}'" for h in KEPT_HEADERS)
    # filtered before the names are folded, so that only wanted names can collide
    return F.expr(f"map_from_entries(filter(transform(map_entries({headers}), "
                  f"e -> struct(lower(e.key) AS key, e.value AS value)), "
                  f"e -> e.key IN ({names})))")


def build_records(flows: DataFrame, body_cap: int | None = None) -> DataFrame:
    """Capture records of classified flows: ``body`` binary in, text or base64 out, whole
    unless a cap is given."""
    piece = F.col("body") if body_cap is None else F.substring(F.col("body"), 1, body_cap)
    cut = F.lit(False) if body_cap is None else F.octet_length("body") > body_cap
    return (flows
            .withColumn("headers", kept_headers("headers"))
            .withColumn("body_bytes", F.octet_length("body").cast("bigint"))
            .withColumn("body_truncated", cut)
            .withColumn("_text", piece.cast("string"))
            .withColumn("body_text", F.when(F.is_valid_utf8("_text"), F.col("_text")))
            .withColumn("body_base64", F.when(F.col("body_text").isNull(), F.base64(piece)))
            .withColumn("classifier", F.struct(
                "intent", "intent_conf", "label", "sensitivity", "effective_sensitivity",
                "tier1_score", "tier2_score", "categories", "hits"))
            .select(*FIELDS))


def write_records(records: DataFrame, path: str) -> None:
    """Append records as JSON lines; `read_captures` reads them back."""
    records.write.mode("append").json(path)
