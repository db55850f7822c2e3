"""Helpers that several operators share: stored tables, checked broadcasts, row numbers, words, components."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leakscope.session import checkpoint_dir

#: Rows of a narrow table (a key or two) up to which it is broadcast; beyond it is shuffled.
BROADCAST_ROWS = 1_000_000
#: Stands in for a null doc_id inside the operators: such rows are one document that sorts last.
NO_ID = (1 << 63) - 1


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stored(rows: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage and outlives its executors."""
    path = f"{checkpoint_dir(rows.sparkSession)}/{name}-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def small_side(rows: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Marked for broadcast only if it was counted and has at most `limit` rows.

    Give a stored (or otherwise cheap) table of narrow rows: it is read once more to count.
    """
    return F.broadcast(rows) if rows.limit(limit + 1).count() <= limit else rows


def numbered(rows: DataFrame, keys: list[str], run_rows: int = 100_000) -> DataFrame:
    """`rows` with `number`, counting from 0 without gaps among the rows that agree in `keys`.

    The rows of a key are split over runs of about `run_rows`, numbered apart and moved up by
    the runs before them, so that a hot key is never in one task. Which of several equal rows
    gets which number is open; the runs are written first, so a repeated task changes nothing.
    `keys` hold no nulls; `rows` has no columns `run`, `start` and `number`.
    """
    runs = rows.count() // run_rows + 1
    cut = stored(rows.withColumn("run", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(runs)).cast("int")), "runs")
    before = Window.partitionBy(*keys).orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    starts = (cut.groupBy(*keys, "run").agg(F.count(F.lit(1)).alias("start"))
              .withColumn("start", F.coalesce(F.sum("start").over(before), F.lit(0))))
    inside = Window.partitionBy(*keys, "run").orderBy(F.lit(0))
    return (cut.withColumn("number", F.row_number().over(inside) - 1).join(starts, [*keys, "run"])
            .withColumn("number", F.col("number") + F.col("start")).drop("run", "start"))


def row_id(column: str | Column = "doc_id") -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(NO_ID))


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def words(text: Column) -> Column:
    """Lower-case runs of letters, digits and underscores, in order."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}_]+"), lambda w: w != "")


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of `docs` whose doc_id is not among `ids` (one column, doc_id); null ids stay."""
    return docs.join(small_side(ids), "doc_id", "left_anti").select(*docs.columns)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for the nodes of `edges` (a, b): the smallest node reachable.

    Each round takes the smallest label among the neighbours, then jumps to that label's own
    label, so stars and chains shrink by halves. Labels are minima, combined before the
    shuffle; nothing is gathered per node. A node's label of the round before stays beside it, so
    that the end is seen without a join. Empty edges give no rows.
    """
    both = stored(
        edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        .where("a <> b").distinct(), "edges")
    labels = stored(both.groupBy(F.col("a").alias("node"))
                    .agg(F.least(F.min("b"), F.col("node")).alias("component")), "labels")
    for _ in range(rounds):
        seen = (both.join(labels, both["b"] == labels["node"])
                .select(F.col("a").alias("node"), "component")
                .withColumn("was", F.lit(None).cast(labels.schema["component"].dataType))
                .unionByName(labels.withColumn("was", F.col("component")))
                .groupBy("node").agg(F.min("component").alias("component"), F.max("was").alias("was")))
        seen = stored(seen, "seen")
        up = labels_of = seen.select(F.col("node").alias("up"), F.col("component").alias("higher"))
        jumped = stored(seen.join(labels_of, seen["component"] == up["up"])
                        .select("node", F.least("component", "higher").alias("component"), "was"), "labels")
        changed = jumped.where("was <> component").limit(1).count()
        labels = jumped.drop("was")
        if not changed:
            return labels
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def with_edges(grouped: DataFrame, edges: DataFrame) -> DataFrame:
    """`grouped` (node, component), as of `components`, after more `edges` (a, b): these are drawn
    between the components, so that rounds run over them alone."""
    label = lambda x: grouped.select(F.col("node").alias(x), F.col("component").alias(f"c{x}"))
    between = (edges.select("a", "b").join(label("a"), "a", "left").join(label("b"), "b", "left")
               .select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")))
    merged = components(between).toDF("old", "new")
    moved = (grouped.join(merged, grouped["component"] == merged["old"], "left")
             .select("node", F.coalesce("new", "component").alias("component")))
    fresh = merged.toDF("node", "component").join(grouped.select("node"), "node", "left_anti")
    return stored(moved.unionByName(fresh.select("node", "component")), "grouped")
