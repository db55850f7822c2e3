"""Naive-Bayes fallback for the intent of requests no rule knows."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leakscope.functions.intent import INTENTS, classify_intent
from leakscope.functions.tokens import words_sql
from leakscope.operators.classify import pinned
from leakscope.session import cut_lineage

# --- fixed values ------------------------------------------------------------
BUCKETS = 1024
MIN_CONFIDENCE = 0.7
ALPHA = 1.0
CLASSES = tuple(enumerate(INTENTS))


def bucket_sql(token: str, buckets: int = BUCKETS, stable_hash: str = "xxhash64") -> str:
    """Bucket of a token by a stable hash; md5 is the portable choice, xxhash64 the fast one."""
    if stable_hash == "xxhash64":
        return f"cast(pmod(xxhash64({token}), {buckets}) AS int)"
    # the last three of eight hex digits decide where their number is a multiple of the buckets
    digits = f"substring(md5({token}), 6, 3)" if 4096 % buckets == 0 else f"left(md5({token}), 8)"
    return f"cast(pmod(cast(conv({digits}, 16, 10) AS bigint), {buckets}) AS int)"


def features(path: str, body: str, buckets: int = BUCKETS,
             stable_hash: str = "xxhash64") -> Column:
    """Array of buckets: path trigrams and body words of 2 to 40 characters, with repeats."""
    p = f"lower(coalesce({path}, ''))"
    grams = (f"CASE WHEN length({p}) > 2 THEN transform(sequence(1, length({p}) - 2), "
             f"i -> concat('p:', substring({p}, i, 3))) ELSE cast(array() AS array<string>) END")
    terms = (f"transform(filter({words_sql(f'coalesce({body}, {chr(39) * 2})')}, "
             f"w -> length(w) BETWEEN 2 AND 40), w -> concat('b:', w))")
    return F.expr(f"transform(concat({grams}, {terms}), "
                  f"t -> {bucket_sql('t', buckets, stable_hash)})")


def label_by_rules(records: DataFrame, path: str = "path", body: str = "body_text") -> DataFrame:
    """Adds intent, confidence and, for rows not fit for training, a skip reason."""
    rows = pinned(records, _i=classify_intent(path, body))
    unfit = (F.col("_i.intent") == "unknown") | (F.col("_i.confidence") < MIN_CONFIDENCE)
    return (rows.withColumn("intent", F.col("_i.intent"))
            .withColumn("confidence", F.col("_i.confidence"))
            .withColumn("skip_reason", F.when(unfit, F.concat(
                F.lit("unknown-or-low-conf:"), F.col("_i.intent")))).drop("_i"))


def training_stats(labelled: DataFrame) -> DataFrame:
    """Rows per class and skipped rows per reason."""
    return labelled.groupBy(F.col("skip_reason").isNull().alias("usable"),
                            F.coalesce("skip_reason", "intent").alias("name")).agg(
        F.count("*").alias("rows"))


def with_features(rows: DataFrame, path: str, body: str, buckets: int = BUCKETS,
                  stable_hash: str = "xxhash64") -> DataFrame:
    """Adds ``buckets``, hashed once however often it is read."""
    return pinned(rows, buckets=features(path, body, buckets, stable_hash))


ROWS = -1    # in place of a bucket: counts the rows of a class


def bucket_counts(rows: DataFrame, buckets: str = "buckets") -> DataFrame:
    """intent, bucket, n: at most classes x (buckets + 1) rows leave each map task.  The rows
    of a class are counted beside its buckets, so the texts are hashed in one pass."""
    each = F.explode(F.concat(F.array(F.lit(ROWS)), buckets)).alias("bucket")
    return rows.select("intent", each).groupBy("intent", "bucket").agg(F.count("*").alias("n"))


@dataclass
class IntentModel:
    log_prior: list[float]
    log_likelihood: list[list[float]]    # class x bucket
    buckets: int = BUCKETS


def fit_tables(rows: DataFrame, buckets: int = BUCKETS,
               alpha: float = ALPHA) -> tuple[DataFrame, DataFrame]:
    """(priors, likelihoods) as tables; every class has every bucket."""
    spark = rows.sparkSession
    classes = spark.createDataFrame([(i, n) for i, n in CLASSES], "class int, intent string")
    counts = cut_lineage(bucket_counts(rows))
    per_class = counts.filter(F.col("bucket") == ROWS).select("intent", "n")
    priors = classes.join(per_class, "intent", "left").select(
        "class", "intent", F.coalesce("n", F.lit(0)).alias("n"))
    total = per_class.agg(F.sum("n").alias("total"))   # of one row per class
    priors = priors.withColumn("total", F.lit(total.first()["total"])).select(
        "class", "intent", "n", F.ln(F.greatest(F.col("n"), F.lit(1)) / F.col("total"))
        .alias("log_prior"))
    spine = classes.select("class", "intent", F.explode(F.sequence(
        F.lit(0), F.lit(buckets - 1))).alias("bucket"))
    counted = spine.join(counts, ["intent", "bucket"], "left").withColumn(
        "smoothed", F.coalesce("n", F.lit(0)) + F.lit(alpha))
    mass = F.sum("smoothed").over(Window.partitionBy("class"))   # `buckets` rows each
    return priors, counted.select("class", "intent", "bucket",
                                  F.ln(F.col("smoothed") / mass).alias("log_likelihood"))


def fit(rows: DataFrame, buckets: int = BUCKETS, alpha: float = ALPHA) -> IntentModel:
    """The weights on the driver: classes x buckets numbers, whatever the data size."""
    priors, likelihoods = fit_tables(rows, buckets, alpha)
    log_prior = [r["log_prior"] for r in priors.orderBy("class").collect()]
    table = likelihoods.groupBy("class").agg(F.array_sort(F.collect_list(
        F.struct("bucket", "log_likelihood"))).alias("w")).orderBy("class").collect()
    return IntentModel(log_prior, [[x["log_likelihood"] for x in r["w"]] for r in table],
                       buckets)


def predict(rows: DataFrame, model: IntentModel, buckets: str = "buckets") -> DataFrame:
    """Adds guess and guess_prob.  The weights are one constant array, the sums are taken in
    row: scoring neither explodes nor shuffles."""
    weights = f"from_json('{json.dumps(model.log_likelihood)}', 'array<array<double>>')"
    prior = f"from_json('{json.dumps(model.log_prior)}', 'array<double>')"
    n = len(INTENTS)
    scores = (f"transform(sequence(0, {n - 1}), c -> aggregate({buckets}, get({prior}, c), "
              f"(s, b) -> s + get(get({weights}, c), b)))")
    names = ", ".join(f"'{i}'" for i in INTENTS)
    rows = pinned(rows, _scores=F.expr(scores))
    rows = pinned(rows, _top=F.expr("array_max(_scores)"))
    return (rows.withColumn("guess", F.expr(
                f"get(array({names}), cast(array_position(_scores, _top) - 1 AS int))"))
            .withColumn("guess_prob", F.expr(
                "1D / aggregate(_scores, 0D, (s, x) -> s + exp(x - _top))"))
            .drop("_scores", "_top"))


def evaluate(predicted: DataFrame) -> DataFrame:
    """Per class support and recall; the overall accuracy on every row."""
    per_class = predicted.groupBy("intent").agg(
        F.count("*").alias("support"),
        F.sum((F.col("guess") == F.col("intent")).cast("bigint")).alias("correct"))
    overall = per_class.agg(F.sum("support").alias("n"), F.sum("correct").alias("c")).first()
    accuracy = (overall["c"] or 0) / max(overall["n"] or 0, 1)
    return per_class.select("intent", "support",
                            (F.col("correct") / F.col("support")).alias("recall"),
                            F.lit(accuracy).alias("accuracy"))


def save(model: IntentModel, spark: SparkSession, path: str) -> None:
    """The weights as one JSON line."""
    spark.createDataFrame([(json.dumps(asdict(model)),)], "value string").coalesce(1).write.mode(
        "overwrite").text(path)


def load(spark: SparkSession, path: str) -> IntentModel:
    return IntentModel(**json.loads(spark.read.text(path).first()["value"]))
