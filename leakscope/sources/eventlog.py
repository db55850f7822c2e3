"""Event table on files: append, read, purge."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leakscope.operators import events as ev
from leakscope.operators import registry as rg

_PARTITIONS = ["event_date", "direction"]


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def append(events: DataFrame, path: str) -> None:
    """Append rows, partitioned by day and direction; ids continue after the newest."""
    spark = events.sparkSession
    base = 0
    if _exists(spark, path):
        base = (spark.read.parquet(path).agg(F.max("id")).first()[0] or 0) + 1
    rows = ev.normalise(events)
    if "id" not in rows.columns:
        rows = rows.withColumn("id", F.monotonically_increasing_id() + F.lit(base))
    (rows.select(*ev.COLUMNS).withColumn("event_date", F.to_date("ts"))
     .write.mode("append").partitionBy(*_PARTITIONS).parquet(path))


def read(spark: SparkSession, path: str) -> DataFrame:
    """The table with every column; files written before a column existed get its default."""
    rows = spark.read.schema(f"{ev.SCHEMA}, event_date date").parquet(path)
    return ev.normalise(rows)


def union_directions(*parts: DataFrame) -> DataFrame:
    """Request, response, skipped and admin rows as one table."""
    return reduce(lambda a, b: a.unionByName(b),
                  [ev.normalise(p).select(*[c for c in ev.COLUMNS if c in p.columns
                                            or c in ev.DEFAULTS]) for p in parts])


def audit_path(events_path: str) -> str:
    return f"{events_path.rstrip('/')}-audit"


def purge(spark: SparkSession, events_path: str, registry_path: str, scope: str, ts: str,
          confirm: bool = False) -> DataFrame:
    """Audited wipe: the audit row is written first, to the audit log and to the table, and
    stays in both.  Returns affected counts."""
    if scope not in ev.PURGE_SCOPES:
        raise KeyError(scope)
    if confirm is not True:
        raise PermissionError(f"{scope} would be wiped; pass confirm=True to do it")
    before = spark.read.parquet(events_path).count()
    audit = ev.audit_event(spark, scope, ts)
    # the audit log is a table of its own that is only appended to: it outlives the wipe, and a
    # crash at any later point
    append(audit, audit_path(events_path))
    append(audit, events_path)
    kept = read(spark, events_path).filter(
        (F.col("direction") == "admin") & (F.col("path") == f"/admin/purge:{scope}")
        & (F.col("ts") == F.lit(ts).cast("timestamp")))
    kept = spark.createDataFrame(kept.collect(), kept.schema)   # the one audit row
    (kept.select(*ev.COLUMNS).withColumn("event_date", F.to_date("ts"))
     .write.mode("overwrite").partitionBy(*_PARTITIONS).parquet(events_path))
    affected = [("events", before)]
    if scope != "events":
        affected.append(("domains", spark.read.parquet(registry_path).count()))
        rg.seed_rows(spark, ts).coalesce(1).write.mode("overwrite").parquet(registry_path)
    return spark.createDataFrame(affected, "table string, rows bigint")
