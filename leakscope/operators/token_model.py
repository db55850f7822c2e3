"""Token model: P(sensitive) per token, windows, document score.

A logistic regression over shape features and hashed surfaces of a token and its
neighbours takes the place of a recurrent network; inputs, windows, aggregation and
outputs are the same, and both fit and scoring are distributed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leakscope.functions.tokens import (
    END_OF_WORD,
    N_FEATURES,
    STRIDE,
    WINDOW,
    overlaps_any,
    shape_features,
    window_ids,
)
from leakscope.operators import evaluate as ev
from leakscope.session import written

HASH_SIZE = 1 << 14
N_TERMS = 3                  # a token and its two neighbours
CHUNK = 1 << 20              # tokens of a task whose equal features are counted together
BLOCK = 1 << 16              # distinct features whose gradients are made at once


def token_rows(encoded: DataFrame, key: str = "doc_id", spans: str | None = None,
               max_tokens: int | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per token with its features, hashed context terms and, given spans, its label.

    Neighbours and the length are laid beside each token before the explode, so no window is
    needed and a row does not carry the tokens of its text along.
    """
    cut = "tokens" if max_tokens is None else f"slice(tokens, 1, {max_tokens})"
    encoded = encoded.withColumn("_cut", F.expr(cut)).withColumn("n", F.size("_cut")).withColumn("_each", F.arrays_zip(
        "_cut", F.expr("slice(concat(array(''), _cut.surface), 1, n)").alias("_left"),
        F.expr("slice(concat(_cut.surface, array('')), 2, n)").alias("_right")))
    rows = encoded.select(key, *keep, "n", *([F.col(spans).alias("_spans")] if spans else []), F.explode("_each").alias("_e"))
    rows = rows.select(
        key, *keep, "_e._cut.pos", "n", F.col("_e._cut.id").alias("token_id"), "_e._cut.start", "_e._cut.end", "_e._cut.surface",
        F.expr("concat('-1:', coalesce(_e._left, ''))").alias("_left"), F.expr("concat('+1:', coalesce(_e._right, ''))").alias("_right"),
        *(["_spans"] if spans else []))
    rows = rows.withColumn("shape", F.when(F.col("surface").rlike(_PLAIN), _plain_shape("surface")).otherwise(
        shape_features("surface"))).withColumn("terms", F.array(F.concat(F.lit("0:"), "surface"), "_left", "_right"))
    if spans:
        rows = rows.withColumn("label", F.when(F.size("_spans") == 0, 0.0).otherwise(
            overlaps_any("start", "end", "_spans").cast("double"))).drop("_spans")
    return rows.drop("_left", "_right")


_PLAIN = f"^[a-z]+({END_OF_WORD})?\\z"


def _plain_shape(token: str) -> Column:
    """The shape of a token of lower-case ASCII letters: its length alone."""
    return F.expr(f"array({'0D, ' * (N_FEATURES - 1)}least(length({token}) - if(endswith({token}, '{END_OF_WORD}'), "
                  f"{len(END_OF_WORD)}, 0), 20) / 20D)")


def _prepared(rows: DataFrame) -> DataFrame:
    return rows.withColumn("shape_vector", array_to_vector(F.col("shape")))


def fit(rows: DataFrame, reg: float = 1e-4, max_iter: int = 20) -> PipelineModel:
    pipeline = Pipeline(stages=[
        HashingTF(inputCol="terms", outputCol="term_vector", numFeatures=HASH_SIZE),
        VectorAssembler(inputCols=["shape_vector", "term_vector"], outputCol="features"),
        LogisticRegression(featuresCol="features", labelCol="label", regParam=reg,
                           maxIter=max_iter, standardization=False)])
    return pipeline.fit(_prepared(rows))


def score_tokens(rows: DataFrame, model: PipelineModel) -> DataFrame:
    """Adds p and the 0/1 prediction."""
    scored = model.transform(_prepared(rows))
    return scored.withColumn("p", vector_to_array("probability")[1]).drop(
        "shape_vector", "term_vector", "features", "rawPrediction", "probability").withColumn(
        "prediction", F.col("prediction").cast("int"))


def score_documents(token_scores: DataFrame, key: str = "doc_id", width: int = WINDOW,
                    stride: int = STRIDE) -> DataFrame:
    """Tokens to windows to documents: score (mean of the best windows) and window count."""
    placed = token_scores.select(key, "p", F.explode(window_ids(
        F.col("pos"), F.col("n"), width, stride)).alias("window"))
    return ev.document_scores(ev.window_scores(placed, key), key)


# --- all strengths at once ----------------------------------------------------
# Features of a token: its shapes, the buckets of its three terms, and a constant.

def feature_rows(rows: DataFrame, keep: tuple[str, ...] = ("doc_id", "label")) -> DataFrame:
    """What the solver and the scores of a model path read of token rows: shape, buckets."""
    buckets = [F.pmod(F.xxhash64(F.get("terms", F.lit(i))), F.lit(HASH_SIZE)).cast("int") for i in range(N_TERMS)]
    return rows.select(*keep, "shape", F.array(*buckets).alias("buckets"))


def _margins(batch: pa.RecordBatch, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shapes, buckets and the margin of each token under each column of weights."""
    shape = batch.column("shape").flatten().to_numpy(zero_copy_only=False).reshape(-1, N_FEATURES)
    buckets = batch.column("buckets").flatten().to_numpy(zero_copy_only=False).reshape(len(shape), -1)
    margin = shape @ weights[:N_FEATURES] + weights[-1]
    for i in range(buckets.shape[1]):
        margin += weights[N_FEATURES + buckets[:, i]]
    return shape, buckets, margin


_PACKED = "shapes binary, wide boolean, rows binary, n binary, labelled binary, positive binary, size long, labels double"


_PACKED_SCHEMA = pa.schema([("shapes", pa.binary()), ("wide", pa.bool_()), ("rows", pa.binary()), ("n", pa.binary()), ("labelled", pa.binary()),
                            ("positive", pa.binary()), ("size", pa.int64()), ("labels", pa.float64())])


def _counted(shapes: dict[bytes, int], rows: list[np.ndarray], labels: list[np.ndarray]) -> pa.RecordBatch:
    """One row: the distinct features of many tokens, how many tokens have each, and where their labels have a sum."""
    each, label = np.concatenate(rows), np.concatenate(labels)
    wide = max(len(shapes), HASH_SIZE) > 1 << 16
    each = each if wide else each.astype(np.uint16)
    width = each.shape[1] * each.itemsize
    found = pa.Array.from_buffers(pa.binary(width), len(each), [None, pa.py_buffer(each.tobytes())]).dictionary_encode()
    place = found.indices.to_numpy()
    distinct = b"".join(found.dictionary.to_pylist())
    n, positive = np.bincount(place).astype(np.uint32), np.bincount(place, label)
    at = np.flatnonzero(positive)
    return pa.RecordBatch.from_pylist([{
        "shapes": b"".join(shapes), "wide": wide, "rows": distinct, "n": n.tobytes(), "labelled": at.astype(np.int32).tobytes(),
        "positive": positive[at].tobytes(), "size": len(each), "labels": float(label.sum())}], _PACKED_SCHEMA)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Feature rows, CHUNK at a time: a place in the list of shapes and the buckets, equal ones counted."""
    shapes, rows, labels, size = {}, [], [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        shape = batch.column("shape").flatten().to_numpy(zero_copy_only=False).reshape(-1, N_FEATURES)
        buckets = batch.column("buckets").flatten().to_numpy(zero_copy_only=False).reshape(len(shape), -1)
        coded = pa.Array.from_buffers(pa.binary(shape[0].nbytes), len(shape), [None, pa.py_buffer(shape.tobytes())]).dictionary_encode()
        place = np.array([shapes.setdefault(x, len(shapes)) for x in coded.dictionary.to_pylist()], np.int32)
        rows.append(np.column_stack([place[coded.indices.to_numpy()], buckets.astype(np.int32)]))
        labels.append(batch.column("label").to_numpy(zero_copy_only=False))
        size += len(shape)
        if size >= CHUNK:
            yield _counted(shapes, rows, labels)
            shapes, rows, labels, size = {}, [], [], 0
    if size:
        yield _counted(shapes, rows, labels)


def _gradients(weights: np.ndarray):
    """Loss (at -1) and gradient of each feature, summed over a task, for each column of weights."""
    by_model = np.ascontiguousarray(weights.T)

    def block(at: list[np.ndarray], n: np.ndarray, positive: np.ndarray, margins: np.ndarray, sums: list[np.ndarray]) -> np.ndarray:
        """Adds what features, places in a table of margins and in the buckets, add to the sums of each; their loss."""
        out = []
        for j, w in enumerate(by_model):
            margin = margins[j][at[0]]
            for bucket in at[1:]:
                margin += w[N_FEATURES + bucket]
            low = np.exp(-np.abs(margin))
            whole = 1 + low
            out.append(n @ (np.maximum(margin, 0) + np.log(whole)) - positive @ margin)
            rest = n * np.where(margin >= 0, 1.0, low) / whole - positive
            sums[0][j] += np.bincount(at[0], rest, sums[0].shape[1])
            for bucket in at[1:]:
                sums[1][j] += np.bincount(bucket, rest, HASH_SIZE)
        return np.array(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, loss = np.zeros_like(weights), np.zeros(weights.shape[1])
        hashed = np.zeros((len(by_model), HASH_SIZE))
        for batch in batches:
            for i in range(batch.num_rows):
                def of(column: str, kind: type) -> np.ndarray:
                    return np.frombuffer(batch.column(column)[i].as_buffer(), kind)
                n = of("n", np.uint32).astype(float)
                rows = of("rows", np.int32 if batch.column("wide")[i].as_py() else np.uint16).reshape(len(n), -1)
                shapes, positive = of("shapes", np.float64).reshape(-1, N_FEATURES), np.zeros(len(n))
                positive[of("labelled", np.int32)] = of("positive", np.float64)
                margins = (shapes @ weights[:N_FEATURES] + weights[-1]).T.copy()
                shaped = np.zeros_like(margins)
                for k in range(0, len(n), BLOCK):
                    part = slice(k, k + BLOCK)
                    at = list(rows[part].T.astype(np.intp, order="C"))
                    loss += block(at, n[part], positive[part], margins, [shaped, hashed])
                total[:N_FEATURES] += shapes.T @ shaped.T
                total[-1] += shaped.sum(1)
        total[N_FEATURES:-1] = hashed.T
        at = np.flatnonzero(total.any(1))
        values = np.concatenate([loss[None], total[at]])
        yield pa.record_batch([pa.array(np.r_[-1, at], pa.int32()), *(pa.array(values[:, j]) for j in range(weights.shape[1]))],
                              names=["feature", *(f"g{j}" for j in range(weights.shape[1]))])
    return run


class _Steps:
    """Limited-memory quasi-Newton directions of one strength."""

    def __init__(self, kept: int = 10) -> None:
        self.pairs: list[tuple[np.ndarray, np.ndarray]] = []
        self.kept = kept

    def learn(self, moved: np.ndarray, turned: np.ndarray) -> None:
        if moved @ turned > 1e-12:
            self.pairs = [*self.pairs, (moved, turned)][-self.kept:]

    def direction(self, gradient: np.ndarray) -> np.ndarray:
        q, undo = gradient.copy(), []
        for s, y in reversed(self.pairs):
            undo.append((s @ q) / (s @ y))
            q -= undo[-1] * y
        if self.pairs:
            s, y = self.pairs[-1]
            q *= (s @ y) / (y @ y)
        else:
            q /= max(1.0, float(np.linalg.norm(q)))
        for (s, y), a in zip(self.pairs, reversed(undo)):
            q += (a - (y @ q) / (s @ y)) * s
        return -q


def fit_path(rows: DataFrame, strengths: tuple[float, ...], max_iter: int = 20) -> np.ndarray:
    """Weights (feature x strength) of logistic regressions that share every pass over ``rows``.

    ``rows``: feature rows. They are packed and written once: a row of the files holds the distinct
    features of up to CHUNK tokens and some more, with their counts. A pass is one aggregate: each
    task sums its gradients for all strengths, Spark sums the tasks, and the driver sees as many
    numbers as there are weights.
    The mean loss plus strength / 2 times the squared weights (not of the constant) goes down by
    quasi-Newton steps; a step that does not go down enough is halved, for its strength alone.
    """
    packed = written(rows.select("label", "shape", "buckets").mapInArrow(_packed, _PACKED), "features")
    count, positive = packed.agg(F.sum("size"), F.sum("labels")).first()
    reg = np.array(strengths)
    weights = np.zeros((N_FEATURES + HASH_SIZE + 1, len(reg)))
    if not count:
        return weights
    rate = min(max((positive or 0.0) / count, 1e-9), 1 - 1e-9)
    weights[-1] = np.log(rate / (1 - rate))

    def passed(w: np.ndarray, reg: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        names = [f"g{j}" for j in range(len(reg))]
        schema = "feature int, " + ", ".join(f"{n} double" for n in names)
        told = packed.drop("size", "labels").mapInArrow(_gradients(w), schema).groupBy("feature").agg(
            *[F.sum(n).alias(n) for n in names]).toPandas()
        values, at = told[names].to_numpy() / count, told["feature"].to_numpy()
        slope = np.zeros_like(w)
        slope[at[at >= 0]] = values[at >= 0]
        slope[:-1] += reg * w[:-1]
        return values[at < 0].sum(0) + reg / 2 * (w[:-1] ** 2).sum(0), slope

    steps = [_Steps() for _ in reg]
    loss, slope = passed(weights, reg)
    for _ in range(max_iter):
        go = np.stack([s.direction(slope[:, j]) for j, s in enumerate(steps)], axis=1)
        down = (go * slope).sum(0)
        size = np.where(down < -1e-12, 1.0, 0.0)
        if not size.any():
            break
        there, new_loss, new_slope, tried = weights.copy(), loss.copy(), slope.copy(), np.flatnonzero(size)
        for _ in range(6):
            there[:, tried] += size[tried] * go[:, tried]
            new_loss[tried], new_slope[:, tried] = passed(there[:, tried], reg[tried])
            bad = (new_loss > loss + 1e-4 * size * down) & (size > 0)
            if not bad.any():
                break
            size[bad] /= 2
            tried = np.flatnonzero(bad)   # the others stay where they are
            there[:, tried] = weights[:, tried]
        size[bad] = 0
        for j, s in enumerate(steps):
            if size[j]:
                s.learn(there[:, j] - weights[:, j], new_slope[:, j] - slope[:, j])
                weights[:, j], slope[:, j], loss[j] = there[:, j], new_slope[:, j], new_loss[j]
            elif s.pairs:
                steps[j] = _Steps()   # start again downhill
    return weights


def _path_scores(weights: np.ndarray, keep: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *_, margin = _margins(batch, weights)
            p = 1 / (1 + np.exp(-np.clip(margin, -700, 700)))
            lists = pa.ListArray.from_arrays(np.arange(0, p.size + 1, p.shape[1], dtype=np.int32), p.ravel())
            yield pa.record_batch([*(batch.column(k) for k in keep), lists], names=[*keep, "p"])
    return run


def score_path(rows: DataFrame, weights: np.ndarray, keep: tuple[str, ...] = ("doc_id", "label")) -> DataFrame:
    """P(sensitive) of each token under each column of weights: ``keep`` columns and ``p``."""
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join(f"{k} {types[k]}" for k in keep) + ", p array<double>"
    return rows.select(*keep, "shape", "buckets").mapInArrow(_path_scores(weights, keep), schema)


def path_predictions(scored: DataFrame, strengths: tuple[float, ...], key: str = "doc_id") -> DataFrame:
    """reg, key, prediction: a document is positive when any of its tokens is."""
    best = scored.groupBy(key).agg(*[F.max(F.col("p")[j] >= 0.5).alias(f"b{j}") for j in range(len(strengths))])
    each = ", ".join(f"named_struct('reg', {reg!r}D, 'prediction', cast(b{j} AS int))" for j, reg in enumerate(strengths))
    return best.select(key, F.expr(f"inline(array({each}))")).select("reg", key, "prediction")


def select_model(train: DataFrame, validation: DataFrame, documents: DataFrame,
                 grid: tuple[float, ...] = (1e-4, 1e-2), key: str = "doc_id",
                 max_iter: int = 20) -> tuple[np.ndarray, DataFrame, DataFrame]:
    """Fit all strengths together; keep the best validation document F1, the first of equals.

    ``train``, ``validation``: feature rows; ``documents``: key, label. Returns the weights of the
    best (one column), the table of candidates, and the written validation predictions.
    """
    weights = fit_path(train, grid, max_iter)
    predicted = written(path_predictions(score_path(validation, weights, (key,)), grid, key)
                        .join(documents.select(key, "label"), key), "predictions")
    table = ev.with_rates(predicted.groupBy("reg").agg(*ev.confusion(F.col("prediction"), F.col("label"))))
    f1 = {r["reg"]: r["f1"] for r in table.select("reg", "f1").collect()}   # one row for each strength
    best = max(range(len(grid)), key=lambda j: (f1.get(grid[j], -1.0), -j))
    return weights[:, [best]], table.select("reg", "f1", "precision", "recall"), predicted
