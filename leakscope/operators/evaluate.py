"""Splits, metrics, threshold sweeps and label reports for scored documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leakscope.functions import scoring
from leakscope.functions.tokens import STRIDE, WINDOW

# --- fixed values ------------------------------------------------------------
THRESHOLDS = (0.50, 0.40, 0.30, 0.25, 0.20, 0.15, 0.10, 0.05)
SCORE_EDGES = (0.0, 0.05, 0.1, 0.2, 0.3, 0.5, 0.8, 1.001)
TEST_SHARE = VALIDATION_SHARE = 0.10
_HASH_DIGITS = 3    # 4096 hash slots in one look
RANKED = 10_000     # rows of a slot that one task may rank


def _slot_of(rows: DataFrame, position: int) -> tuple[str, int]:
    """(prefix, rows before it) of the hash prefix in which the row at `position` lies.

    Counts by the next digits of the hash, and goes into the one slot that holds the position
    until that is small enough to rank, however large the table is.
    """
    prefix, before = "", 0
    while True:
        near = rows.filter(F.startswith("_hash", F.lit(prefix))) if prefix else rows
        slot = F.left("_hash", F.lit(len(prefix) + _HASH_DIGITS)).alias("slot")
        n = 0
        for r in near.groupBy(slot).agg(F.count("*").alias("n")).orderBy("slot").collect():
            prefix, n = r["slot"], r["n"]
            if before + n >= position:
                break
            before += n
        if n <= RANKED or len(prefix) >= 30:
            return prefix, before


def split_three(rows: DataFrame, key: str = "doc_id", seed: str = "7",
                test: float = TEST_SHARE, validation: float = VALIDATION_SHARE) -> DataFrame:
    """Adds ``split``: exactly the first share of a seeded order is test, the next
    validation, the rest train.

    The order is that of a hash.  Only the rows of the two slots in which the cuts fall are
    ranked, at most RANKED each; all others are assigned by their hash alone, so there is no
    global sort.
    """
    digest = F.md5(F.concat(F.col(key).cast("string"), F.lit(":"), F.lit(seed)))
    rows = rows.withColumn("_hash", digest)
    n = rows.count()
    if not n:
        return rows.withColumn("split", F.lit("train")).drop("_hash")
    first = max(1, int(n * test))
    second = min(n, first + max(1, int(n * validation)))
    slots = sorted({_slot_of(rows, first), _slot_of(rows, second)}, key=lambda s: len(s[0]))
    # one slot may lie in the other: the wider one ranks for both
    slots = [s for i, s in enumerate(slots) if not any(s[0].startswith(t[0]) for t in slots[:i])]

    def where_in(value) -> Column:
        inside = F.lit(None).cast("int")
        for prefix, before in slots:
            inside = F.when(F.startswith("_hash", F.lit(prefix)), F.lit(value(prefix, before))).otherwise(inside)
        return inside

    ranked_slot, base = where_in(lambda p, _: slots.index((p, _))), where_in(lambda _, before: before)

    def before_cut(position: int) -> Column:
        prefix = next(p for p, b in reversed(sorted(slots)) if b < position)
        return F.col("_hash") < prefix

    by_hash = F.when(before_cut(first), "test").when(before_cut(second), "validation").otherwise("train")
    rows = rows.withColumn("_slot", ranked_slot)
    assigned = rows.filter(F.col("_slot").isNull()).withColumn("split", by_hash)
    place = base + F.row_number().over(Window.partitionBy("_slot").orderBy("_hash", key))
    ranked = rows.filter(F.col("_slot").isNotNull()).withColumn("_rank", place)
    ranked = ranked.withColumn("split", F.when(F.col("_rank") <= first, "test").when(
        F.col("_rank") <= second, "validation").otherwise("train")).drop("_rank")
    return assigned.unionByName(ranked).drop("_hash", "_slot")


def confusion(prediction: Column, label: Column) -> list[Column]:
    def counted(p: int, y: int, name: str) -> Column:
        return F.coalesce(F.sum(((prediction == p) & (label == y)).cast("bigint")),
                          F.lit(0)).alias(name)
    return [counted(1, 1, "tp"), counted(0, 0, "tn"), counted(1, 0, "fp"), counted(0, 1, "fn"),
            F.count("*").alias("n")]


def with_rates(counts: DataFrame) -> DataFrame:
    """Accuracy, precision, recall and F1; empty denominators count as one."""
    def at_least_one(value: Column) -> Column:
        return F.greatest(value, F.lit(1))

    return (counts
            .withColumn("accuracy", (F.col("tp") + F.col("tn")) / at_least_one(F.col("n")))
            .withColumn("precision", F.col("tp") / at_least_one(F.col("tp") + F.col("fp")))
            .withColumn("recall", F.col("tp") / at_least_one(F.col("tp") + F.col("fn")))
            .withColumn("f1", 2 * F.col("precision") * F.col("recall") / F.greatest(
                F.col("precision") + F.col("recall"), F.lit(1e-9))))


def binary_metrics(rows: DataFrame, prediction: str = "prediction",
                   label: str = "label") -> DataFrame:
    return with_rates(rows.agg(*confusion(F.col(prediction), F.col(label))))


def token_metrics(windowed: DataFrame, width: int = WINDOW, stride: int = STRIDE) -> DataFrame:
    """Token-level confusion and rates over overlapping windows (pos, window, prediction, label).

    A token that lies in two windows counts in the first of them only: in any window but the
    first one, the leading width - stride tokens are masked.
    """
    own = (F.col("window") == 0) | (F.col("pos") >= F.col("window") * stride + (width - stride))
    return binary_metrics(windowed.where(own))


def document_predictions(tokens: DataFrame, key: str = "doc_id",
                         prediction: str = "prediction") -> DataFrame:
    """A document is positive when any of its tokens is."""
    return tokens.groupBy(key).agg(F.max(prediction).alias("prediction"))


def threshold_sweep(scores: DataFrame, thresholds=THRESHOLDS, score: str = "score",
                    label: str = "label") -> DataFrame:
    """Metrics at each threshold, in one pass: conditional sums, no copy per threshold."""
    total = [F.count("*").alias("n"), F.sum((F.col(label) == 1).cast("bigint")).alias("p")]
    for i, t in enumerate(thresholds):
        above = F.col(score) >= t
        total.append(F.sum((above & (F.col(label) == 1)).cast("bigint")).alias(f"tp{i}"))
        total.append(F.sum((above & (F.col(label) == 0)).cast("bigint")).alias(f"fp{i}"))
    rows = ", ".join(
        f"named_struct('position', {i}, 'threshold', {t}D, 'tp', tp{i}, 'tn', n - p - fp{i}, "
        f"'fp', fp{i}, 'fn', p - tp{i}, 'n', n)" for i, t in enumerate(thresholds))
    swept = scores.agg(*total).select(F.expr(f"inline(array({rows}))"))
    return with_rates(swept)


def best_threshold(sweep: DataFrame) -> DataFrame:
    """The best F1; the first of equals wins."""
    return sweep.orderBy(F.col("f1").desc(), "position").limit(1)


def positive_histogram(scores: DataFrame, edges=SCORE_EDGES, score: str = "score",
                       label: str = "label") -> DataFrame:
    """Count of positive documents per half-open score range, empty ranges included."""
    pairs = list(zip(edges, edges[1:]))
    counted = scores.filter(F.col(label) == 1).agg(*[
        F.coalesce(F.sum(((F.col(score) >= lo) & (F.col(score) < hi)).cast("bigint")),
                   F.lit(0)).alias(f"b{i}") for i, (lo, hi) in enumerate(pairs)])
    rows = ", ".join(f"named_struct('low', {lo}D, 'high', {hi}D, 'documents', b{i})"
                     for i, (lo, hi) in enumerate(pairs))
    return counted.select(F.expr(f"inline(array({rows}))"))


def label_report(scores: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """Documents and positives per shown label, every label present; ``recall`` is the share
    of positives with any label but clean, ``false_positives`` the others flagged."""
    rows = scores.select(scoring.label_for(F.col(score)).alias("shown"),
                         F.col(label).alias("y"))
    sums = []
    for name in scoring.LABELS:
        is_label = F.col("shown") == name
        sums.append(F.coalesce(F.sum(is_label.cast("bigint")), F.lit(0)).alias(f"d_{name}"))
        sums.append(F.coalesce(F.sum((is_label & (F.col("y") == 1)).cast("bigint")),
                               F.lit(0)).alias(f"p_{name}"))
    out = ", ".join(f"named_struct('label', '{n}', 'documents', d_{n}, 'positives', p_{n})"
                    for n in scoring.LABELS)
    caught = " + ".join(f"p_{n}" for n in scoring.LABELS if n != "clean")
    flagged = " + ".join(f"d_{n}" for n in scoring.LABELS if n != "clean")
    return rows.agg(*sums).select(
        F.expr(f"({caught}) / greatest({caught} + p_clean, 1)").alias("recall"),
        F.expr(f"({flagged}) - ({caught})").alias("false_positives"),
        F.expr(f"inline(array({out}))"))


def window_scores(tokens: DataFrame, key: str = "doc_id", window: str = "window",
                  p: str = "p") -> DataFrame:
    return tokens.groupBy(key, window).agg(F.max(p).alias("score"))


def document_scores(windows: DataFrame, key: str = "doc_id", k: int = scoring.TOP_WINDOWS,
                    block: int = 256, window: str = "window") -> DataFrame:
    """Mean of the k best windows, and the number of windows.

    Blocks of windows are cut to their k best first, so a document of any length brings a
    bounded list to its final group.
    """
    def best(values: Column) -> Column:
        return F.slice(F.sort_array(values, asc=False), 1, k)

    blocks = windows.groupBy(key, F.floor(F.col(window) / block).alias("_block")).agg(
        best(F.collect_list("score")).alias("top"), F.count("*").alias("n"))
    docs = blocks.groupBy(key).agg(best(F.flatten(F.collect_list("top"))).alias("top"),
                                   F.sum("n").alias("windows"))
    return docs.select(key, F.expr("aggregate(top, 0D, (s, x) -> s + x) / size(top)")
                       .alias("score"), "windows")


def blended(scores: DataFrame, tier1: str = "tier1", tier2: str = "tier2") -> DataFrame:
    return scores.withColumn("score", scoring.blend(F.col(tier1), F.col(tier2)))
