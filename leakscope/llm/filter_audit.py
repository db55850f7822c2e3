"""How filters act on each other in every order, by counting paths through the subset lattice.

A state is the set of filters applied so far, an edge applies one more. What an edge removes
depends on its state only, not on the order in which the state was reached: the documents that
fail its filter and none of the state's. So documents are counted by the set of filters they
fail (32 numbers for five filters), `left` gives the documents that pass every filter of a state,
and an edge removes the difference of its ends. Forward counts say how many orders reach a state,
backward counts how many lead on from it; their product weighs an edge in the sum over all
orders. The steps of a single order are the edges along its path.

Documents are shuffled as narrow rows of digests and flags; texts are read once and stay put.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leakscope.llm.common import row_id, stored, text_of

#: Names of the filters in bit order; the last is the one on equal texts.
FILTERS = "ABCDE"
WORDS_LEAST, DISTINCT_PERCENT, CAPITALS_PERCENT = 200, 50, 2
EQUAL = 1 << FILTERS.index("E")
STATES = 1 << len(FILTERS)


def failed_alone(text: Column, words: Column) -> Column:
    """Bits of the filters that a text fails by itself: too few words, too few distinct ones, too
    many capitals, marks of markup."""
    n, different = F.size(words), F.size(F.array_distinct(words))
    capitals = F.regexp_count(text, F.lit("[A-Z]"))
    tests = (n < WORDS_LEAST, 100 * different < DISTINCT_PERCENT * n,
             100 * capitals.cast("long") > CAPITALS_PERCENT * F.char_length(text), text.rlike(r"[#$%&*|]"))
    return sum((F.when(t, 1 << i).otherwise(0) for i, t in enumerate(tests)), F.lit(0))


def paths() -> tuple[np.ndarray, np.ndarray]:
    """Orders that reach each state from the empty one, and orders that lead from it to the full one."""
    forward, backward = np.zeros(STATES, np.int64), np.zeros(STATES, np.int64)
    forward[0] = backward[-1] = 1
    for state in range(STATES):
        for f in range(len(FILTERS)):
            if not state >> f & 1:
                forward[state | 1 << f] += forward[state]
    for state in reversed(range(STATES)):
        for f in range(len(FILTERS)):
            if not state >> f & 1:
                backward[state] += backward[state | 1 << f]
    return forward, backward


def passing(failed: np.ndarray) -> np.ndarray:
    """For each state, how many pass all its filters, from counts by the set of failed filters."""
    sets = np.arange(STATES)
    return np.array([failed[sets & state == 0].sum() for state in sets])


def _orders(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    forward, backward = paths()
    for frame in frames:
        for part, cells in zip(frame["part"], frame["cells"]):
            counts = np.zeros((3, STATES), np.int64)
            for c in cells:
                counts[:, c["failed"]] = c["n"], c["good"], c["toxic"]
            left, good, toxic = (passing(c) for c in counts)
            fails = [int(counts[0][np.arange(STATES) >> f & 1 == 1].sum()) for f in range(len(FILTERS))]
            states = [[s for s in range(STATES) if not s >> f & 1] for f in range(len(FILTERS))]
            shapley = [int(sum(forward[s] * backward[s | 1 << f] * (left[s] - left[s | 1 << f]) for s in states[f]))
                       for f in range(len(FILTERS))]
            rows = []
            for order in permutations(range(len(FILTERS))):
                state, name = 0, "".join(FILTERS[f] for f in order)
                for step, f in enumerate(order, 1):
                    to = state | 1 << f
                    removed = left[state] - left[to]
                    rows.append((part, name, step, left[to], removed, fails[f] - removed, counts[0][1 << f],
                                 good[state] - good[to], toxic[state] - toxic[to], shapley[f]))
                    state = to
            yield pd.DataFrame(rows, columns=["part", "filter_order", "step", "kept", "removed", "redundant",
                                              "unique_fails", "good_lost", "toxic_lost", "shapley"])


def failures(docs: DataFrame) -> DataFrame:
    """(part, rid, failed, n): how many rows of a source and doc_id fail which set of filters."""
    each = docs.select(F.coalesce("source", F.lit("")).alias("part"), row_id().alias("rid"), text_of().alias("text"))
    each = each.withColumn("words", F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    alone = stored(each.select("part", "rid", F.unhex(F.sha2("text", 256)).alias("digest"),
                               failed_alone(F.col("text"), F.col("words")).alias("failed")), "alone")
    # equal rows are counted before they meet, so that no key of the joins is hot by repeats
    rows = stored(alone.groupBy("part", "rid", "digest", "failed").agg(F.count(F.lit(1)).alias("n")), "rows")
    first = stored(rows.groupBy("digest").agg(F.min("rid").alias("rid")).withColumn("first", F.lit(True)), "first")
    failed = F.col("failed") + F.when(F.col("first").isNull(), EQUAL).otherwise(0)
    return rows.join(first, ["digest", "rid"], "left").select("part", "rid", failed.alias("failed"), "n")


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per source of `docs` (doc_id, text, source), order of the filters and step: part,
    filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    Null texts are empty, a null source is the part ''. Rows of one doc_id count one by one and do
    not fail the filter on equal texts against each other; rows without doc_id come after all
    others. `labels` (doc_id, quality, toxic) may lack documents or repeat them: one row with 1
    marks the document. Empty documents give no rows. Other columns are not looked at.
    """
    marks = stored(labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("rid")).agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"),
        F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic")), "marks")
    counted = (failures(docs.select("doc_id", "text", "source")).join(marks, "rid", "left")
               .groupBy("part", "failed").agg(
                   F.sum("n").alias("n"), F.sum(F.col("n") * F.coalesce("good", F.lit(0))).alias("good"),
                   F.sum(F.col("n") * F.coalesce("toxic", F.lit(0))).alias("toxic")))
    # at most a row for each set of filters
    cells = counted.groupBy("part").agg(F.collect_list(F.struct("failed", "n", "good", "toxic")).alias("cells"))
    return cells.mapInPandas(_orders, "part string, filter_order string, step int, kept long, removed long, redundant long, "
                             "unique_fails long, good_lost long, toxic_lost long, shapley long")
