"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

A text is the runs of its letters, in lower case, with one space around each; its n-grams of
one to three characters are hashed to DIM features. Document frequencies are counted over all
training texts. The classifier is fitted on a bounded sample of them with
follow-the-regularised-leader (FTRL-proximal: a learning rate of its own for each weight, L1
and L2 penalties), and a part of the sample that it has not seen calibrates it by one
temperature. Prediction reads whole texts, a batch of a partition at a time.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leakscope.llm.common import small_side, stored, text_of

DIM = 1 << 15
GRAMS = (1, 2, 3)
#: Sampled texts of each language at most (those with the smallest hash), of which this share calibrates.
SAMPLE, CALIBRATE = 1500, 0.25
#: FTRL-proximal: learning rate and its offset, penalties, passes.
ALPHA, BETA, L1, L2, PASSES = 0.5, 1.0, 0.02, 0.1, 2
UNKNOWN = "und"


def _letters() -> np.ndarray:
    """For each code point of the basic plane, whether it is a letter."""
    return np.array([unicodedata.category(chr(c))[0] == "L" if not 0xD800 <= c < 0xE000 else False for c in range(1 << 16)])


class Grams:
    """Hashed n-grams of a text: (features, counts), both sorted by feature."""

    def __init__(self, dim: int = DIM):
        self.dim, self.letter = dim, _letters()

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        is_letter = np.ones(len(points), dtype=bool)
        low = points < (1 << 16)
        is_letter[low] = self.letter[points[low]]
        if not low.all():
            is_letter[~low] = [chr(c).isalpha() for c in points[~low]]
        if not is_letter.any():
            return np.empty(0, np.int64), np.empty(0)
        x = np.where(is_letter, points, 32).astype(np.uint64)
        # one space between runs, one at each end
        x = np.r_[np.uint64(32), x, np.uint64(32)]
        x = x[np.r_[True, (x[1:] != 32) | (x[:-1] != 32)]]
        found = []
        for n in GRAMS:
            if len(x) < n:
                continue
            h = np.full(len(x) - n + 1, n, dtype=np.uint64)
            for i in range(n):
                h = (h * np.uint64(0x9E3779B97F4A7C15)) ^ (x[i:len(x) - n + 1 + i] * np.uint64(0xC2B2AE3D27D4EB4F))
                h ^= h >> np.uint64(29)
            found.append(((h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(40)).astype(np.int64) % self.dim)
        counts = np.bincount(np.concatenate(found), minlength=self.dim)
        at = np.flatnonzero(counts)
        return at, counts[at].astype(np.float64)


def _weighted(at: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF values of length one."""
    v = (1.0 + np.log(counts)) * idf[at]
    size = math.sqrt(float(v @ v))
    return v / size if size else v


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


@dataclass(frozen=True)
class LanguageModel:
    """Languages, idf and weights by feature (rows) and language (columns), bias, temperature."""

    languages: tuple
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def logits(self, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return _weighted(at, counts, self.idf) @ self.weights[at] + self.bias


def _ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias; the bias is a feature that is always 1 and not penalised by L1."""
    z, n = np.zeros((dim + 1, classes)), np.zeros((dim + 1, classes))
    l1 = np.full((dim + 1, 1), L1)
    l1[dim] = 0.0

    def weights(at):
        za, na = z[at], n[at]
        w = -(za - np.sign(za) * l1[at]) / ((BETA + np.sqrt(na)) / ALPHA + L2)
        return np.where(np.abs(za) <= l1[at], 0.0, w)

    for _ in range(PASSES):
        for at, v, label in rows:
            at, v = np.r_[at, dim], np.r_[v.astype(np.float64), 1.0]
            w = weights(at)
            p = _softmax(v @ w)
            p[label] -= 1.0
            g = v[:, None] * p[None, :]
            na = n[at]
            z[at] += g - (np.sqrt(na + g * g) - np.sqrt(na)) / ALPHA * w
            n[at] = na + g * g
    whole = weights(np.arange(dim + 1))
    return whole[:dim], whole[dim]


def _temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least log loss, by golden-section search on its logarithm."""
    if not len(labels):
        return 1.0
    loss = lambda t: -np.log(np.maximum(_softmax(logits / math.exp(t))[np.arange(len(labels)), labels], 1e-12)).mean()
    low, high, ratio = -4.0, 4.0, (math.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return math.exp((low + high) / 2)


def held_out(parts: int = 4, part: int = 2) -> Column:
    """crc32 of the id as text, modulo `parts`, is `part`; a null id is not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts == part, F.lit(False))


def _frequencies(texts: DataFrame, dim: int) -> tuple[int, np.ndarray]:
    """Number of texts with a letter, and in how many each feature occurs: over all of `texts`."""
    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grams, total, df = Grams(dim), 0, np.zeros(dim, dtype=np.int64)
        for frame in frames:
            for text in frame["text"]:
                at, _ = grams(text)
                total += len(at) > 0
                df[at] += 1
        yield pd.DataFrame({"feature": np.r_[np.arange(dim), -1], "df": np.r_[df, total]})

    summed = (texts.select("text").mapInPandas(count, "feature long, df long")
              .groupBy("feature").agg(F.sum("df").alias("df")).toPandas())  # one row per feature
    df = np.zeros(dim + 1)
    df[summed["feature"].to_numpy()] = summed["df"].to_numpy()  # feature -1, the total, is the last place
    return int(df[dim]), df[:dim]


def learn(docs: DataFrame, sample: int = SAMPLE, dim: int = DIM) -> LanguageModel:
    """Model from the texts and non-null lang of `docs` (doc_id, text, lang), held-out rows left out.

    Document frequencies cover all rows; the fit takes at most `sample` texts of each language.
    Of several texts of one id and lang the fit takes the
    smallest. Rows with null text or lang teach nothing. With no such row the model knows no language.
    """
    train = docs.select("doc_id", "text", "lang").where(~held_out()).where("lang is not null and text is not null")
    ids = stored(train.select("doc_id", "lang", F.xxhash64("doc_id", "lang").alias("place")), "train")
    per = ids.groupBy("lang").agg(F.count(F.lit(1)).alias("rows")).toPandas().sort_values("lang")  # one row per language
    languages = tuple(per["lang"])
    if not languages:
        return LanguageModel((), np.zeros(dim), np.zeros((dim, 0)), np.zeros(0), 1.0)
    first = Window.partitionBy("lang").orderBy("place", "doc_id")  # Spark keeps `sample` of each before the shuffle
    picked = ids.distinct().withColumn("at", F.row_number().over(first)).where(F.col("at") <= sample).select("doc_id", "lang")
    total, df = _frequencies(train, dim)
    idf = np.log((1.0 + total) / (1.0 + df)) + 1.0
    # `sample` rows for each language: bounded by the parameter
    chosen = (train.join(small_side(stored(picked, "picked")), ["doc_id", "lang"], "left_semi")
              .groupBy("doc_id", "lang").agg(F.min("text").alias("text")))

    def featurise(frames):
        grams = Grams(dim)
        for frame in frames:
            got = [grams(t) for t in frame["text"]]
            yield pd.DataFrame({"lang": frame["lang"], "place": frame["place"], "at": [a.astype(np.int32).tobytes() for a, _ in got],
                                "value": [_weighted(a, c, idf).astype(np.float32).tobytes() for a, c in got]})

    rows = (chosen.select("text", "lang", F.xxhash64("doc_id", "text").alias("place"))
            .mapInPandas(featurise, "lang string, place long, at binary, value binary")  # 8 bytes a feature on the driver
            .where(F.octet_length("at") > 0).toPandas().sort_values(["place", "lang"]))
    code = {lang: i for i, lang in enumerate(languages)}
    every = [(np.frombuffer(a, np.int32), np.frombuffer(v, np.float32), code[x]) for a, v, x in zip(rows["at"], rows["value"], rows["lang"])]
    cut = int(len(every) * (1 - CALIBRATE)) if len(every) >= 8 else len(every)
    weights, bias = _ftrl(every[:cut], len(languages), dim)
    logits = np.array([v.astype(np.float64) @ weights[a] + bias for a, v, _ in every[cut:]]).reshape(-1, len(languages))
    return LanguageModel(languages, idf, weights, bias, _temperature(logits, np.array([y for *_, y in every[cut:]], dtype=int)))


def language(text: Column, model: LanguageModel) -> Column:
    """struct(lang_pred, score) of a text column: `und` with score 0 without a letter or a model."""

    @F.pandas_udf("lang_pred string, score double")
    def predicted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        grams = Grams(len(model.idf))
        for texts in batches:
            names, scores = [], []
            for text in texts:
                at, counts = grams(text)
                if not len(at) or not model.languages:
                    names.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                p = _softmax(model.logits(at, counts) / model.temperature)
                names.append(model.languages[int(p.argmax())])
                scores.append(float(p.max()))
            yield pd.DataFrame({"lang_pred": names, "score": scores})

    return predicted(text)


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of `docs` (doc_id, text).

    Whole texts are read, nothing else is. Null, empty and letterless texts are `und` with score
    0. Ties go to the language that sorts first. Repeated rows are repeated.
    """
    return (docs.select("doc_id", language(text_of(), model).alias("p"))
            .select("doc_id", held_out().alias("held_out"), "p.lang_pred", "p.score"))
