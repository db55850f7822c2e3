"""Toxicity by a weighted finite-state pattern grammar.

Words and punctuation become symbol classes. Five transducers read the classes, each a table of
(state, class) -> (state, outputs, weight): insult and threat begin or lengthen a match,
negation and reported speech mark it from the left (a quotation after a verb of speech stays
reported until it closes), target marks it from either side. An insult is aimed at any person
beside it, a threat only at its object: a word that can be one after it, or an object form on
either side. `compose` makes one machine of them that steps all at once, with the outputs of
all and the sum of the weights. A match comes out as a clause, from the first word that marks
it to the last. Clauses are counted by kind and marks; the weights of the counts give the score.

The insult words are learned: a word, or a beginning that many words share, belongs to them if
the contexts it occurs in (the word before it) are far likelier in texts labelled toxic.
Counting contexts, not texts, keeps copies of one text from teaching their own words. The
weights are a logistic regression drawn towards the weights of the machine's paths, so that a combination that
the labels never show keeps a sensible weight.
"""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leakscope.llm.common import stored, text_of, words

#: Labelled rows of each class that the fit looks at, at most (those with the smallest hash).
SAMPLE = {1: 3000, 0: 6000}
#: A learned word needs so many contexts in toxic texts, and so much likelier ones (log odds).
MIN_CONTEXTS, MIN_LIFT = 8, 3.0
PREFIXES = (4, 5, 6, 7)
#: Words over which a mark reaches.
REACH = {"negated": 3, "reported": 8, "targeted": 4}
#: Weights that the transducers give to a match and to its marks.
WEIGHT = {"insult": 3.0, "threat": 0.5, "negated": -1.8, "reported": -0.9,
          "targeted": {"insult": 0.5, "threat": 2.5}}

# Fixed words of the transducers, in the languages of the corpus.
NEGATION = frozenset("not never no isn't aren't nicht kein keine nie pas jamais no nunca ni".split())
REPORTED = frozenset("said says quoted wrote claimed called sagte sagt schrieb dit disait écrit dijo dice escribió".split())
ADDRESS = frozenset("you your you're sie ihr tu vous votre tú usted".split())
SUBJECT = frozenset("he she they du dein il elle él ella".split())
OBJECT = frozenset("him her them dich euch ihn te toi ti lui eux".split())
INSULT = frozenset("idiot moron stupid pathetic worthless disgusting scum trash loser".split())
THREAT = frozenset("kill murder hurt destroy töten umbringen tuer frapper matar golpear".split())

TOKEN = re.compile(r"[^\W_]+(?:'[^\W_]+)?|[.!?;:\n\"“”„«»]")
FLAGS = tuple(REACH)
KINDS = ("insult", "threat")
#: Symbol classes; `word` is any other word.
PERSONS = ("address", "subject", "object")
CLASSES = ("word", *KINDS, "negation", "speech", *PERSONS, "stop", "line", "colon", "quote")
MARKS = ("stop", "line", "colon", "quote")
CLASS = {w: name for name, among in (("negation", NEGATION), ("speech", REPORTED), ("address", ADDRESS),
                                     ("subject", SUBJECT), ("object", OBJECT)) for w in among}
CLASS |= dict.fromkeys(".!?;", "stop") | {"\n": "line", ":": "colon"} | dict.fromkeys('"“”„«»', "quote")
#: Features: log(1 + clauses) by kind and flags, then matched words per 100 words.
FEATURES = [(k, n, r, t) for k in KINDS for n in (0, 1) for r in (0, 1) for t in (0, 1)]


def match_table(kind: str) -> dict:
    """A match begins a clause; the same kind again right after it lengthens the clause."""
    table = {(s, c): (s if c in ("colon", "quote") else 0, (), 0.0) for s in (0, 1) for c in CLASSES}
    table[0, kind] = (1, (kind,), WEIGHT[kind])
    table[1, kind] = (1, ("more",), 0.0)
    return table


def negation_table() -> dict:
    """State: words over which a negation still reaches."""
    table = {}
    for left in range(REACH["negated"] + 1):
        for c in CLASSES:
            after = left if c in ("colon", "quote") else 0 if c in MARKS else max(0, left - 1)
            marks = left and c in KINDS
            table[left, c] = (after, ("negated",) if marks else (), WEIGHT["negated"] if marks else 0.0)
        table[left, "negation"] = (REACH["negated"], (), 0.0)
    return table


def speech_table() -> dict:
    """State: words over which a verb of speech reaches, or that its quotation is open."""
    table = {}
    for left in (*range(REACH["reported"] + 1), "quoted"):
        for c in CLASSES:
            if left == "quoted":
                after = 0 if c in ("quote", "line") else left
            elif c in MARKS:
                after = 0 if c in ("stop", "line") else "quoted" if c == "quote" and left else left
            else:
                after = REACH["reported"] if c == "speech" else max(0, left - 1)
            marks = left and c in KINDS
            table[left, c] = (after, ("reported",) if marks else (), WEIGHT["reported"] if marks else 0.0)
    return table


def target_table() -> dict:
    """State: (what was read last, words over which it reaches): a person, or a match not yet aimed."""
    reach, nothing, table = REACH["targeted"], ("", 0), {}
    aims = {(k, p) for k in KINDS for p in PERSONS} - {("threat", "subject")}
    before = aims - {("threat", "address")}
    for seen, left in [nothing, *[(x, n) for x in (*PERSONS, *KINDS) for n in range(1, reach + 1)]]:
        less = (seen, left - 1) if left > 1 else nothing
        for c in CLASSES:
            after, kind = less, None
            if c in MARKS:
                after = nothing if c in ("stop", "line") else (seen, left)
            elif c in PERSONS:
                after, kind = (c, reach), seen if (seen, c) in aims else None
            elif c in KINDS:
                kind = c if (c, seen) in before else None
                after = less if kind else (c, reach)
            table[(seen, left), c] = (after, ("targeted",) if kind else (), WEIGHT["targeted"][kind] if kind else 0.0)
    return table


#: The five transducers, each with its first state.
TRANSDUCERS = ((match_table("insult"), 0), (match_table("threat"), 0), (negation_table(), 0), (speech_table(), 0),
               (target_table(), ("", 0)))


def compose(one: tuple, two: tuple) -> tuple:
    """(table, first state) that steps both on the same symbol, over the states that can be reached."""
    (left, a), (right, b) = one, two
    table, todo = {}, [(a, b)]
    seen = set(todo)
    while todo:
        state = todo.pop()
        for c in CLASSES:
            (x, out_x, w_x), (y, out_y, w_y) = left[state[0], c], right[state[1], c]
            table[state, c] = ((x, y), out_x + out_y, w_x + w_y)
            if (x, y) not in seen:
                seen.add((x, y))
                todo.append((x, y))
    return table, (a, b)


@functools.cache
def machine() -> list[dict]:
    """The composition of all five: for each numbered state, class -> (next state, outputs, weight)."""
    table, first = functools.reduce(compose, TRANSDUCERS)
    number = {first: 0}
    for state, _ in table:
        number.setdefault(state, len(number))
    rows: list[dict] = [{} for _ in number]
    for (state, c), (after, out, weight) in table.items():
        rows[number[state]][c] = (number[after], out, weight)
    return rows


def path_weight(classes: list[str]) -> float:
    """Sum of the weights along the path of a sequence of classes."""
    state, total = 0, 0.0
    for c in classes:
        state, _, weight = machine()[state][c]
        total += weight
    return total


def _prior() -> np.ndarray:
    """Each kind of clause at the weight of its shortest path, never below 0.1."""
    weights = []
    for k, n, r, t in FEATURES:
        path = ["speech"] * r + ["negation"] * n + (["object"] * t + [k] if k == "insult" else [k] + ["object"] * t)
        weights.append(max(0.1, path_weight(path)))
    return np.array([*weights, 0.2, -3.0])


@dataclass(frozen=True)
class ToxicModel:
    """Learned words (exact, and beginnings) and the weights of the features, bias last."""

    exact: frozenset = INSULT
    starts: frozenset = frozenset()
    weights: tuple = field(default_factory=lambda: tuple(_prior()))

    def kind(self, word: str) -> str | None:
        if word in self.exact or any(word[:n] in self.starts for n in PREFIXES if len(word) > n):
            return "insult"
        if word in THREAT:
            return "threat"
        return None


#: Mark that a class of words can set on a match, for the span of the clause.
SETS = {"negation": "negated", "speech": "reported"} | dict.fromkeys(PERSONS, "targeted")


def clauses(text: str, kind_of) -> tuple[list[tuple], int, int]:
    """Clauses (start, end, kind, negated, reported, targeted), the matched words and all words.

    A clause spans its match and the words that set its marks.
    """
    rows, state, seen, matched, out, last = machine(), 0, 0, 0, [], {}
    for m in TOKEN.finditer(text.lower()):
        word = m[0]
        kind = None
        if word[0].isalnum():
            seen += 1
            kind = kind_of(word)
        c = kind or CLASS.get(word, "word")
        state, marks, _ = rows[state][c]
        if c in SETS:
            last[SETS[c]] = m.start()
        if kind:
            matched += 1
        for mark in marks:
            if mark in KINDS:
                out.append([m.start(), m.end(), mark, 0, 0, 0])
                continue
            clause = out[-1]
            clause[1] = m.end()
            if mark != "more":
                clause[3 + FLAGS.index(mark)] = 1
                clause[0] = min(clause[0], last.get(mark, clause[0]))
    return [tuple(clause) for clause in out], matched, seen


def features(found: list[tuple], matched: int, seen: int) -> np.ndarray:
    x = np.zeros(len(FEATURES) + 2)
    for clause in found:
        x[FEATURES.index(clause[2:])] += 1
    x[:len(FEATURES)] = np.log1p(x[:len(FEATURES)])
    x[-2] = min(10.0, 100.0 * matched / max(seen, 1))
    x[-1] = 1.0
    return x


class _Scorer:
    """Scores texts with one model; remembers the kind of words already seen."""

    MEMORY = 300_000
    WORD = re.compile(r"[^\W_]+(?:'[^\W_]+)?")

    def __init__(self, model: ToxicModel):
        self.model, self.known, self.weights = model, {}, np.array(model.weights)

    def kind(self, word: str) -> str | None:
        found = self.known.get(word, 0)
        if found == 0:
            if len(self.known) > self.MEMORY:
                self.known.clear()
            found = self.known[word] = self.model.kind(word)
        return found

    def read(self, text: str | None) -> tuple[list[tuple], np.ndarray]:
        low = (text or "").lower()
        tokens = self.WORD.findall(low)
        # most texts hold no word of the grammar: their words are only looked up
        if not any(self.kind(word) for word in set(tokens)):
            return [], features([], 0, len(tokens))
        found, matched, seen = clauses(low, self.kind)
        return found, features(found, matched, seen)

    def score(self, x: np.ndarray) -> float:
        return 1.0 / (1.0 + math.exp(-float(np.clip(x @ self.weights, -30, 30))))


CLAUSE = "struct<start:int,end:int,kind:string,negated:boolean,reported:boolean,targeted:boolean>"


def toxicity(text: Column, model: ToxicModel, with_clauses: bool = True) -> Column:
    """struct(score, clauses) of a text column; null and empty texts score as texts without a match."""

    @F.pandas_udf(f"score double, clauses array<{CLAUSE}>")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = _Scorer(model)
        for texts in batches:
            rows = [scorer.read(t) for t in texts]
            spans = [[(s, e, k, bool(n), bool(r), bool(t)) for s, e, k, n, r, t in found] if with_clauses else []
                     for found, _ in rows]
            yield pd.DataFrame({"score": [scorer.score(x) for _, x in rows],
                                "clauses": [[dict(zip(("start", "end", "kind", *FLAGS), c)) for c in s] for s in spans]})

    return scored(text)


def remainder(parts: int, column: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo `parts`; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % parts


def _sample(docs: DataFrame, labels: DataFrame, held: int, bounds: dict) -> DataFrame:
    """(text, toxic) of a bounded choice of labelled documents outside the held-out part."""
    known = (labels.where("toxic in (0, 1) and doc_id is not null").where(remainder(held) != 0)
             .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")))
    picked = None
    for value, most in sorted(bounds.items()):
        part = known.where(F.col("toxic") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        picked = part if picked is None else picked.unionByName(part)
    # at most sum(bounds) rows of two numbers: bounded by the parameter
    return (docs.select("doc_id", "text").join(F.broadcast(stored(picked, "picked")), "doc_id")
            .groupBy("doc_id", "toxic").agg(F.min(text_of()).alias("text"))
            .select("text", "toxic").dropDuplicates(["text", "toxic"]))


def _lexicon(rows: DataFrame, contexts: int, lift: float) -> tuple[frozenset, frozenset]:
    w = rows.select("toxic", words(F.col("text")).alias("w"))
    # a column of its own, so that the words are not split once for each use
    each = w.select("toxic", F.explode(F.zip_with(
        "w", F.concat(F.array(F.lit("")), F.col("w")), lambda x, before: F.struct(x.alias("word"), before.alias("before")))).alias("p"))
    seen = (each.where("p.word is not null").select("toxic", "p.word", F.xxhash64("p.before").alias("before")).distinct()
            .groupBy("word").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("n")))
    seen = stored(seen, "contexts")
    total = seen.agg(F.sum("t").alias("t"), F.sum("n").alias("n")).first()
    if not total or not total["t"] or not total["n"]:
        return INSULT, frozenset()
    units = F.concat(
        F.array(F.struct(F.lit(0).alias("size"), F.col("word").alias("unit"))),
        *[F.when(F.length("word") > size, F.array(F.struct(F.lit(size).alias("size"), F.substring("word", 1, size).alias("unit"))))
          .otherwise(F.array().cast("array<struct<size:int,unit:string>>")) for size in PREFIXES])
    odds = F.log((F.col("t") + 0.5) / (F.col("n") + 0.5)) - F.lit(math.log(total["t"] / total["n"]))
    kept = (seen.select(F.explode(units).alias("u"), "t", "n").groupBy("u.size", "u.unit")
            .agg(F.sum("t").alias("t"), F.sum("n").alias("n"))
            .where(F.col("t") >= contexts).where(odds >= lift).select("size", "unit").collect())  # words of the sample
    starts = frozenset(r["unit"] for r in kept if r["size"])
    exact = frozenset(r["unit"] for r in kept if not r["size"]) | INSULT
    return exact, starts


def _fit(x: np.ndarray, y: np.ndarray, prior: np.ndarray, pull: float = 1.0) -> np.ndarray:
    """Newton steps of logistic regression with a Gaussian prior around `prior`."""
    w = prior.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (y - p) - pull * (w - prior)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + pull * np.eye(len(w)), slope)
        size = np.abs(step).max()
        w += step * min(1.0, 2.0 / max(size, 1e-9))
        if size < 1e-7:
            break
    return w


def learn(docs: DataFrame, labels: DataFrame, held: int = 5, bounds: dict | None = None,
          contexts: int = MIN_CONTEXTS, lift: float = MIN_LIFT) -> ToxicModel:
    """Model from `docs` (doc_id, text) and `labels` (doc_id, toxic) outside the held-out part.

    The fit reads at most `bounds[c]` labelled rows of class c. Rows without id or label are
    left out; of several labels of one id the largest counts, of several texts the smallest. Without labels of both classes
    the fixed words and the prior weights are the model.
    """
    rows = stored(_sample(docs, labels, held, bounds or SAMPLE), "labelled")
    exact, starts = _lexicon(rows, contexts, lift)
    model = ToxicModel(exact, starts)

    def read(batches):
        scorer = _Scorer(model)
        for frame in batches:
            xs = [scorer.read(t)[1] for t in frame["text"]]
            yield pd.DataFrame({"x": [x.tolist() for x in xs], "y": frame["toxic"].astype("float64")})

    got = rows.mapInPandas(read, "x array<double>, y double").toPandas()  # at most sum(bounds) short rows
    if got["y"].nunique() < 2:
        return model
    x, y = np.array(got["x"].tolist()), got["y"].to_numpy()
    order = np.lexsort(np.c_[x, y].T)  # the same sums in every run
    return ToxicModel(exact, starts, tuple(_fit(x[order], y[order], _prior()).tolist()))


def score_documents(docs: DataFrame, model: ToxicModel, held: int = 5, with_clauses: bool = True) -> DataFrame:
    """doc_id, held_out, score, predicted, clauses for every row of `docs` (doc_id, text).

    Whole texts are read. Null and empty texts get the score of a text without matches. A null
    doc_id is not held out. Repeated rows are repeated; other columns are not looked at.
    """
    return (docs.select("doc_id", toxicity(F.col("text"), model, with_clauses).alias("t"))
            .select("doc_id", F.coalesce(remainder(held) == 0, F.lit(False)).alias("held_out"),
                    F.col("t.score").alias("score"), (F.col("t.score") >= 0.5).cast("int").alias("predicted"),
                    F.col("t.clauses").alias("clauses")))


def drop_toxic(docs: DataFrame, model: ToxicModel) -> DataFrame:
    """`docs` without the rows that score 0.5 or more; all columns stay as they are."""
    mark = "__toxic_" + "_".join(sorted(docs.columns))[:40]
    return docs.withColumn(mark, toxicity(F.col("text"), model, False)["score"]).where(F.col(mark) < 0.5).drop(mark)
