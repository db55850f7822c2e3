"""Byte-pair tokenizer: corpus statistics, training, encoding.

Training goes in phases over the table of distinct words, which stays spread out. A phase counts
all pairs of neighbouring symbols and takes the most frequent ones as open. No pair below them
can become as frequent during the phase: a merge only lowers the counts of pairs that exist, and
a pair born from it is at most as frequent as one it replaces. So words are cut wherever a pair
is not open; equal runs of all words are one run with their summed weight, and a bounded number
of runs tells which merges come next, as all words would. The phase ends before a round that
would need a pair that is not open, or after one that makes a symbol there already is; then its
merges are applied to the words. The driver holds the leading pairs and the merges, a task the
runs of one phase.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leakscope.functions.tokens import END_OF_WORD, words
from leakscope.operators.classify import pinned
from leakscope.session import written

# --- fixed values ------------------------------------------------------------
RESERVED = {"<pad>": 0, "<unk>": 1, "<bos>": 2, "<eos>": 3}
UNKNOWN = RESERVED["<unk>"]
OPEN_PAIRS = 256             # leading pairs a first phase opens; later ones as WORDS_PER_TASK allows
WORDS_PER_TASK = 100_000     # runs of words a phase hands to its task, some hundred bytes each
SHORT = 64                   # characters of a word that is spelled one place at a time
SLICE = 1 << 20              # characters whose words or tokens are made at once
TOKEN_TYPE = "array<struct<pos:int,id:int,start:int,end:int,surface:string>>"
WORD_TYPE = "array<struct<start:int,end:int,word:string>>"


def word_frequency(texts: DataFrame, text: str = "text") -> DataFrame:
    """word, n: counted in the map tasks first, so frequent words do not pile up."""
    found = pinned(texts.select(text), words=words(text))
    return found.select(F.explode("words").alias("word")).groupBy("word").agg(
        F.count("*").alias("n"))


def as_symbols(frequency: DataFrame) -> DataFrame:
    """word, n, symbols: characters and the end marker, separated by spaces."""
    spelled = F.concat(F.regexp_replace("word", r"(?s)(.)", "$1 "), F.lit(END_OF_WORD))
    return frequency.withColumn("symbols", spelled)


def pair_frequency(symbols: DataFrame) -> DataFrame:
    """a, b, n over all adjacent symbols, weighted by word frequency."""
    parts = F.split("symbols", " ")
    split = symbols.select("n", parts.alias("s")).filter(F.size("s") > 1)
    pairs = pinned(split, pairs=F.expr(
        "transform(sequence(0, size(s) - 2), i -> named_struct('a', s[i], 'b', s[i + 1]))"))
    pairs = pairs.select("n", F.explode("pairs").alias("p"))
    return pairs.groupBy("p.a", "p.b").agg(F.sum("n").alias("n"))


def ranked_pairs(symbols: DataFrame) -> DataFrame:
    return pair_frequency(symbols).orderBy(F.col("n").desc(), "a", "b")


@dataclass
class Tokenizer:
    vocab: dict[str, int]
    merges: list[tuple[str, str]]

    def save(self, spark: SparkSession, path: str) -> None:
        """Symbols with their ids and merges with their ranks, as rows of one table."""
        rows = [("symbol", i, s, None) for s, i in self.vocab.items()]
        rows += [("merge", i, a, b) for i, (a, b) in enumerate(self.merges)]
        spark.createDataFrame(rows, "part string, nth int, a string, b string").coalesce(1).write.mode(
            "overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Tokenizer:
        rows = spark.read.parquet(path).orderBy("part", "nth").collect()   # a vocabulary
        return cls({r["a"]: r["nth"] for r in rows if r["part"] == "symbol"},
                   [(r["a"], r["b"]) for r in rows if r["part"] == "merge"])


def merged(parts: list[str], a: str, b: str) -> list[str]:
    """`parts` with each a b made one symbol, from left to right without overlap."""
    out, at, last = [], 0, len(parts) - 1
    while at <= last:
        if parts[at] == a and at < last and parts[at + 1] == b:
            out.append(a + b)
            at += 2
        else:
            out.append(parts[at])
            at += 1
    return out


class Shard:
    """The words of one task and where each symbol pair stands, or stood, in them."""

    def __init__(self, words: list[tuple[list[str], int]]) -> None:
        self.words = words
        self.where: dict[tuple[str, str], list[int]] = defaultdict(list)
        self.changed: Counter = Counter()
        for i, (parts, n) in enumerate(words):
            for pair in zip(parts, parts[1:]):
                self.changed[pair] += n
                self.where[pair].append(i)

    def merge(self, pairs: list[tuple[str, str]]) -> None:
        for a, b in pairs:
            new = a + b
            for i in dict.fromkeys(self.where.pop((a, b), ())):
                old, n = self.words[i]
                parts = merged(old, a, b)
                if len(parts) == len(old):
                    continue   # another merge has taken the pair since
                self.words[i] = parts, n
                for pair in zip(old, old[1:]):
                    self.changed[pair] -= n
                for pair in zip(parts, parts[1:]):
                    self.changed[pair] += n
                    if new in pair:
                        self.where[pair].append(i)

    def changes(self) -> Counter:
        """By how much the counts changed since this was last asked."""
        out, self.changed = self.changed, Counter()
        return out


class Leaders:
    """Counts of all pairs, most frequent first, of equals by name."""

    def __init__(self) -> None:
        self.counts: Counter = Counter()
        self.queue: list[tuple[int, str, str]] = []

    def add(self, changes: dict[tuple[str, str], int]) -> None:
        for pair, n in changes.items():
            if n:
                self.counts[pair] += n
                if self.counts[pair]:
                    heapq.heappush(self.queue, (-self.counts[pair], *pair))
                else:
                    del self.counts[pair]

    def independent(self, most: int, min_freq: int, known: set[str], floor: int = 0) -> list[tuple[str, str]] | None:
        """Leading pairs that share no symbol: merging them one by one takes a most frequent pair
        at every step. None where a pair less frequent than `floor` would have to be known.

        A pair born from a merge is at most as frequent as an older pair it shares a symbol with,
        and that one ranks behind these. Among equals the older pair goes first. A pair that
        grows a symbol there already is ends the run, as its other pairs need a new count.
        """
        out, used = [], set()
        while len(out) < most:
            while self.queue and -self.queue[0][0] != self.counts.get(self.queue[0][1:], 0):
                heapq.heappop(self.queue)   # counted anew since
            n, a, b = self.queue[0] if self.queue else (0, "", "")
            if -n < floor and floor > min_freq:
                return None
            if -n < min_freq or not n or a in used or b in used:
                break
            heapq.heappop(self.queue)       # its new count comes back as a change
            out.append((a, b))
            used.update((a, b))
            if a + b in known:
                break
            known.add(a + b)
        return out


def learn_merges(shard: Shard, known: set[str], target: int, min_freq: int, most_merges: int | None = None,
                 floor: int = 0) -> list[tuple[str, str]]:
    """Merges until `known` has `target` symbols, no pair occurs often enough, or the phase ends."""
    known, leaders, merges = set(known), Leaders(), []
    while len(known) < target and (most_merges is None or len(merges) < most_merges):
        leaders.add(shard.changes())
        most, before = target - len(known), len(known)
        batch = leaders.independent(most if most_merges is None else min(most, most_merges - len(merges)), min_freq, known, floor)
        if not batch:
            break
        shard.merge(batch)
        merges += batch
        if len(known) - before < len(batch):
            break   # a symbol grew: pairs that are not open may have become more frequent
    return merges


# --- words as symbol numbers, spread out ---------------------------------------

_WORD_TYPE = "s array<int>, n long"


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of all words of a batch, the word of each, and the words' weights."""
    lists = batch.column(0)
    owner = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    return lists.flatten().to_numpy(), owner, batch.column(1).to_numpy()


def _listed(symbols: np.ndarray, owner: np.ndarray, weights: np.ndarray) -> pa.RecordBatch:
    """Words of two symbols and more; no merge reads others."""
    size = np.bincount(owner, minlength=len(weights))
    long = size > 1
    lists = pa.ListArray.from_arrays(np.r_[0, np.cumsum(size[long])].astype(np.int32), pa.array(symbols[long[owner]], pa.int32()))
    return pa.record_batch([lists, pa.array(weights[long], pa.int64())], names=["s", "n"])


def _numbered(ids: dict[str, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            split = [x.split(" ") for x in batch.column(0).to_pylist()]
            owner = np.repeat(np.arange(len(split)), [len(x) for x in split])
            yield _listed(np.array([ids[c] for x in split for c in x], np.int32), owner, batch.column(1).to_numpy())
    return run


def _groups(merges: list[tuple[str, str]]) -> list[list[tuple[str, str]]]:
    """Merges in order, those together that share no symbol and may be made at once."""
    out, used = [], set()
    for a, b in merges:
        if not out or used & {a, b, a + b}:
            out.append([])
            used = set()
        out[-1].append((a, b))
        used |= {a, b, a + b}
    return out


def _applied(merges: list[tuple[str, str]], ids: dict[str, int]):
    steps = []
    for group in _groups(merges):
        other, made = np.full(len(ids), -1, np.int32), np.zeros(len(ids), np.int32)
        for a, b in group:
            other[ids[a]], made[ids[a]] = ids[b], ids[a + b]
        steps.append((other, made))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s, owner, weights = _flat(batch)
            s = s.copy()
            for other, made in steps:
                hit = np.flatnonzero((other[s[:-1]] == s[1:]) & (owner[:-1] == owner[1:]))
                if not len(hit):
                    continue
                fresh = np.r_[True, np.diff(hit) != 1]   # a a a: from the left, without overlap
                at = np.arange(len(hit))
                hit = hit[(at - np.maximum.accumulate(np.where(fresh, at, 0))) % 2 == 0]
                s[hit] = made[s[hit]]
                rest = np.ones(len(s), bool)
                rest[hit + 1] = False
                s, owner = s[rest], owner[rest]
            yield _listed(s, owner, weights)
    return run


def _pairs(s: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for each pair of neighbours, and whether both are of one word."""
    return (s[:-1].astype(np.int64) << 32) | s[1:], owner[:-1] == owner[1:]


def _pair_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        s, owner, weights = _flat(batch)
        pair, inside = _pairs(s, owner)
        names, at = np.unique(pair[inside], return_inverse=True)
        total = np.zeros(len(names), np.int64)
        np.add.at(total, at, weights[owner[:-1][inside]])
        yield pa.record_batch([pa.array(names), pa.array(total)], names=["pair", "n"])


def _cut_runs(pairs: np.ndarray):
    """Runs of open pairs in the words, as the bytes of their symbols, and their weights."""
    def told(found: Counter) -> pa.RecordBatch:
        return pa.record_batch([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], names=["run", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            s, owner, weights = _flat(batch)
            pair, inside = _pairs(s, owner)
            at = np.minimum(np.searchsorted(pairs, pair), len(pairs) - 1)
            opened = np.r_[False, inside & (pairs[at] == pair), False].astype(np.int8)
            turn = np.diff(opened)
            low, high = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1) + 1
            data = s.tobytes()
            for lo, hi, n in zip((low * 4).tolist(), (high * 4).tolist(), weights[owner[low]].tolist()):
                found[data[lo:hi]] += n
            if len(found) > WORDS_PER_TASK:
                yield told(found)
                found = Counter()
        yield told(found)
    return run


def _phase(names: list[str], known: set[str], target: int, min_freq: int, most_merges: int | None, floor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = [([names[i] for i in np.frombuffer(x, np.int32).tolist()], n) for batch in batches
                 for x, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
        learned = learn_merges(Shard(words), known, target, min_freq, most_merges, floor)
        yield pa.record_batch([pa.array(range(len(learned)), pa.int32()), pa.array([a for a, _ in learned], pa.string()),
                               pa.array([b for _, b in learned], pa.string())], names=["rank", "a", "b"])
    return run


def train(frequency: DataFrame, vocab_size: int = 4000, min_freq: int = 2,
          max_merges: int | None = None) -> Tokenizer:
    """Learn merges until the vocabulary is full or no pair occurs often enough.

    A phase reads the words three times, side by side; one task merges its runs, of which there
    are at most WORDS_PER_TASK unless its first round needs more.
    """
    symbols = written(as_symbols(frequency).select("symbols", "n"), "symbols")
    alphabet = [r[0] for r in symbols.select(F.explode(F.split("symbols", " ")).alias("s"))
                .distinct().orderBy("s").collect()]   # the characters that occur
    names, merges = list(dict.fromkeys([*RESERVED, *alphabet])), []
    ids = {name: i for i, name in enumerate(names)}
    target = max(vocab_size, len(names) + 1)
    words = written(symbols.mapInArrow(_numbered(ids), _WORD_TYPE), "words")
    most_pairs, top, fewest = OPEN_PAIRS, None, 1   # fewest: a phase gets nowhere with fewer pairs
    while len(names) < target and (max_merges is None or len(merges) < max_merges):
        if top is None or len(top) <= most_pairs:
            counted = words.mapInArrow(_pair_counts, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
            top = [tuple(r) for r in counted.filter(F.col("n") >= max(min_freq, 1)).orderBy(
                F.col("n").desc()).limit(2 * most_pairs + 1).collect()]
        whole = len(top) <= most_pairs
        floor = max(min_freq, 1) if whole else top[most_pairs][1] + 1
        pairs = np.sort(np.array([pair for pair, n in top if n >= floor], np.int64))
        if not len(pairs):
            if whole:
                break               # no pair occurs often enough
            fewest = most_pairs = most_pairs * 2   # so many are equally frequent
            continue
        runs = written(words.mapInArrow(_cut_runs(pairs), "run binary, n long").groupBy("run").agg(F.sum("n").alias("n")), "runs")
        size = runs.count()
        if size > WORDS_PER_TASK and min(most_pairs, len(pairs)) // 2 >= fewest:
            most_pairs = min(most_pairs, len(pairs)) // 2
            continue
        left = None if max_merges is None else max_merges - len(merges)
        learned = [(r["a"], r["b"]) for r in runs.repartition(1).mapInArrow(
            _phase(names, set(names), target, min_freq, left, floor), "rank int, a string, b string").orderBy("rank").collect()]
        if not learned:
            if whole:
                break
            fewest = most_pairs = most_pairs * 2   # the first round reaches further
            continue
        merges += learned
        for a, b in learned:
            if a + b not in ids:
                ids[a + b] = len(names)
                names.append(a + b)
        words = written(words.mapInArrow(_applied(learned, ids), _WORD_TYPE), "words")
        top, fewest = None, 1
        if size < WORDS_PER_TASK // 3:
            most_pairs *= 2
    return Tokenizer(ids, merges)


def _spell(word: str, rank: dict[tuple[str, str], int]) -> list[str]:
    """Symbols of one word, merging the earliest learned pair first."""
    if len(word) > SHORT:
        return _spell_long(word, rank)
    parts = [*word, END_OF_WORD]
    find, never = rank.get, len(rank)
    ranks = [find(pair, never) for pair in zip(parts, parts[1:])]
    while ranks and (r := min(ranks)) < never:
        i = ranks.index(r)
        del ranks[i]
        parts[i:i + 2] = [new := parts[i] + parts[i + 1]]
        if i:   # only the pairs beside a merge are new; one learned before it is not merged any more
            ranks[i - 1] = later if (later := find((parts[i - 1], new), never)) > r else never
        if i < len(ranks):
            ranks[i] = later if (later := find((new, parts[i + 1]), never)) > r else never
    return parts


def _spell_long(word: str, rank: dict[tuple[str, str], int]) -> list[str]:
    """The same, all places of a pair in one round."""
    parts, done = [*word, END_OF_WORD], -1
    while True:
        later = [(r, pair) for pair in zip(parts, parts[1:]) if (r := rank.get(pair, -1)) > done]
        if not later:
            return parts
        done, pair = min(later)
        parts = merged(parts, *pair)


def _with_lists(text: str, made: Callable[[list[tuple[int, str]], np.ndarray], pa.ListArray]):
    """Adds to each row the list that `made` makes of the words of its text, some rows at a
    time: what a task makes at once is bounded by SLICE and the characters of one text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, at = batch.column(text), 0
            while at < batch.num_rows:
                found, ends, size, first = [], [0], 0, at
                while at < batch.num_rows and size < SLICE:
                    value = (texts[at].as_py() or "").lower()
                    found += [(m.start(), m.group()) for m in _ANY_WORD.finditer(value)]
                    ends.append(len(found))
                    size += len(value) + 1
                    at += 1
                part = batch.slice(first, at - first)
                yield pa.record_batch([*part.columns, made(found, np.array(ends))], names=[*part.schema.names, "_made"])
    return run


_ANY_WORD = re.compile(r"\S+")


def _made(texts: DataFrame, text: str, output: str, kind: str, made) -> DataFrame:
    """`texts` with the column `output`; a column of that name is replaced."""
    rows = texts.drop(output) if output != text and output in texts.columns else texts
    schema = T.StructType([*rows.schema.fields, T.StructField("_made", T.DataType.fromDDL(kind))])
    rows = rows.mapInArrow(_with_lists(text, made), schema)
    return (rows.drop(output) if output == text else rows).withColumnRenamed("_made", output)


def _struct_lists(ends: np.ndarray, **columns: pa.Array) -> pa.ListArray:
    rows = pa.StructArray.from_arrays(list(columns.values()), names=list(columns))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows)


def _word_ranges(found: list[tuple[int, str]], ends: np.ndarray) -> pa.ListArray:
    start = np.array([at for at, _ in found], np.int32)
    end = start + np.array([len(w) for _, w in found], np.int32)
    return _struct_lists(ends, start=pa.array(start), end=pa.array(end), word=pa.array([w for _, w in found], pa.string()))


def word_offsets(texts: DataFrame, text: str = "text", output: str = "words") -> DataFrame:
    """Adds the words with their character ranges, in one pass over each text."""
    return _made(texts, text, output, WORD_TYPE, _word_ranges)


def encode(texts: DataFrame, tokenizer: Tokenizer, text: str = "text",
           output: str = "tokens") -> DataFrame:
    """Adds tokens with ids, character offsets and surfaces.

    Runs over Arrow batches without a shuffle; a word is spelled once per Python worker.
    """
    rank = {pair: i for i, pair in enumerate(tokenizer.merges)}
    vocab = tokenizer.vocab
    spelled: dict[str, list[tuple[int, int, str]]] = {}

    def pieces(word: str) -> list[tuple[int, int, str]]:
        known = spelled.get(word)
        if known is None:
            if len(spelled) > 200_000:
                spelled.clear()
            known = [(vocab.get(s, UNKNOWN), len(s.removesuffix(END_OF_WORD)), s)
                     for s in _spell(word, rank)]
            spelled[word] = known
        return known

    def tokens(found: list[tuple[int, str]], ends: np.ndarray) -> pa.ListArray:
        place: dict[str, int] = {}
        word = np.array([place.setdefault(w, len(place)) for _, w in found], np.int64)
        each = [pieces(w) for w in place]
        flat = [p for x in each for p in x]             # the pieces of all distinct words
        low = np.r_[0, np.cumsum([len(x) for x in each], dtype=np.int64)]
        chars = np.array([p[1] for p in flat], np.int64)
        before = np.r_[0, np.cumsum(chars)]
        counts = low[word + 1] - low[word]
        upto = np.r_[0, np.cumsum(counts)]
        of = np.repeat(np.arange(len(word)), counts)    # the word of each token
        pick = low[word][of] + np.arange(len(of)) - upto[of]
        start = np.array([at for at, _ in found], np.int64)[of] + before[pick] - before[low[word][of]]
        ends = upto[ends]
        return _struct_lists(
            ends, pos=pa.array(np.arange(len(of)) - np.repeat(ends[:-1], np.diff(ends)), pa.int32()),
            id=pa.array([p[0] for p in flat], pa.int32()).take(pa.array(pick)), start=pa.array(start, pa.int32()),
            end=pa.array(start + chars[pick], pa.int32()), surface=pa.array([p[2] for p in flat], pa.string()).take(pa.array(pick)))

    return _made(texts, text, output, TOKEN_TYPE, tokens)
