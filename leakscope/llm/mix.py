"""Mixing sources to target weights by hash-threshold histograms.

Every document has a fixed place: the md5 of its id. A source that gives a fraction of its
words gives the documents whose place lies below a threshold, one that gives more than once
its words gives all of them, and those below the threshold once more. Raising a target only
adds documents (nested budgets), and the choice is the same in every run. Where the rows of one
id, or those without any, weigh much in their source, each has a place of its own: the md5 of
its id, its text and a running number among rows equal in both.

The threshold is found without sorting: sum the words by source and leading hex digits of the
place, find the bucket in which the budget ends, and look only into that bucket with the next
digits, until it holds one place. DataFrame functions only; texts are read once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leakscope.llm.common import numbered, small_side, stored, text_of

#: Weights dealt to the sources in order, repeating; share of all words in the mix; most passes.
WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2
#: Hex digits of a place that one pass looks at.
DIGITS = 3
PLACE = 32
#: Share of its source's words above which rows of one doc_id are placed one by one.
HEAVY = 0.001


def size_in_words(text: Column) -> Column:
    r"""Runs of characters other than space and \t to \r."""
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size): one row for each source.

    Shares of `share` times all words go by weight, dealt to the sources by code point, null
    last; what a target exceeds `most` times its source by is dealt again by weight. With the
    sources in order of limit / weight, the first ones stop at their limit, and the rest share
    what is left by weight. Rows here are sources, not documents.
    """
    every = Window.orderBy(F.col("source").isNull(), F.col("source"))
    ranked = sources.withColumn("rank", F.row_number().over(every) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    limited = (ranked.withColumn("weight", weight).withColumn("limit", F.col("source_size") * float(most))
               .withColumn("ratio", F.col("limit") / F.col("weight")))
    before = Window.orderBy("ratio", "rank").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy("ratio", "rank").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy()
    level = ((F.sum("source_size").over(whole) * float(share) - F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
             / F.sum("weight").over(after))
    # the first source whose limit lies above the level that it and those after it would get
    open_from = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "rank", "level"))).over(whole)
    return (limited.withColumn("level", level).withColumn("stop", open_from)
            .select("source", "source_size",
                    F.when(F.col("stop").isNull() | (F.struct("ratio", "rank") < F.struct("stop.ratio", "stop.rank")), F.col("limit"))
                    .otherwise(F.col("weight") * F.col("stop.level")).alias("target")))


def thresholds(sized: DataFrame, budgets: DataFrame) -> DataFrame:
    """(source, cut): a source's documents with place < cut have words as near to its budget
    as whole places allow. `sized` (source, size, place) is stored; `budgets` (source, budget)."""
    open_ = stored(budgets.select("source", F.lit("").alias("prefix"), F.col("budget").cast("double").alias("left")), "budgets")
    closed = None
    for depth in range(0, PLACE, DIGITS):
        near = sized.join(small_side(open_), sized["source"].eqNullSafe(open_["source"])).where(
            F.substring("place", 1, depth) == F.col("prefix")).select(
            sized["source"], "size", "place", "left", F.substring("place", 1, depth + DIGITS).alias("bucket"))
        sums = near.groupBy("source", "left", "bucket").agg(
            F.sum("size").alias("size"), F.min("place").alias("first"), F.max("place").alias("last"))
        # at most 16 ** DIGITS rows of one source
        run = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        ends = (sums.withColumn("through", F.sum("size").over(run))
                .where(F.col("through") > F.col("left")).groupBy("source").agg(F.min_by(F.struct(
                    "bucket", "first", "last", "left", "through", "size"), "bucket").alias("b")))
        at = stored(open_.join(ends.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left")
                    .select("source", "b"), "ends")
        one = F.col("b.first") == F.col("b.last")
        over, short = F.col("b.through") - F.col("b.left"), F.col("b.left") - (F.col("b.through") - F.col("b.size"))
        # no bucket crosses: every document; a bucket of one place: in if that lands nearer
        cut = F.when(F.col("b").isNull(), F.lit("g")).otherwise(
            F.when(over < short, F.concat("b.last", F.lit("g"))).otherwise(F.col("b.first")))
        done = at.where(F.col("b").isNull() | one).select("source", cut.alias("cut"))
        closed = done if closed is None else closed.unionByName(done)
        open_ = stored(at.where(F.col("b").isNotNull() & ~one).select(
            "source", F.col("b.bucket").alias("prefix"),
            (F.col("b.left") - (F.col("b.through") - F.col("b.size"))).alias("left")), "budgets")
        if not open_.limit(1).count():
            break
    return stored(closed, "cuts")


def _marks() -> list[Column]:
    """doc_id, source, their hash, the hash of the text, and the place of a row that is not placed by itself."""
    return [F.col("doc_id"), F.col("source"),
            F.xxhash64(F.col("source").isNull(), "source", F.col("doc_id").isNull(), "doc_id").alias("key"),
            F.xxhash64(text_of()).alias("content"),
            F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("place")]


def _placed(rows: DataFrame, heavy: DataFrame) -> DataFrame:
    """`rows` (key, content, place, ...), those of the keys in `heavy` each with a place of its own."""
    if not heavy.limit(1).count():
        return rows
    side = small_side(heavy)
    own = F.md5(F.concat_ws(":", "key", "content", "number").cast("binary"))
    apart = numbered(rows.join(side, "key", "left_semi"), ["key", "content"]).withColumn("place", own).drop("number")
    return rows.join(side, "key", "left_anti").unionByName(apart)


def _plan(docs: DataFrame, weights, share: float, most: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sized and placed rows, the heavy keys, and one row for each source (target, whole passes, cut)."""
    sized = stored(docs.select(*_marks(), size_in_words(text_of()).alias("size")), "sized")
    goals = stored(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most), "targets")
    groups = (sized.groupBy("key").agg(F.sum("size").alias("w"), F.count(F.lit(1)).alias("rows"), F.min("source").alias("of"))
              .where("rows > 1"))
    # a source has at most 1 / HEAVY of them
    heavy = stored(groups.join(small_side(goals), F.col("of").eqNullSafe(F.col("source")))
                   .where(F.col("w") > HEAVY * F.col("source_size")).select("key"), "heavy")
    if heavy.limit(1).count():
        sized = stored(_placed(sized, heavy), "placed")
    whole = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(most))).otherwise(0)
    goals = goals.withColumn("whole", whole.cast("int"))
    budgets = goals.select("source", (F.col("target") - F.col("whole") * F.col("source_size")).alias("budget"))
    cuts = thresholds(sized, budgets)
    plan = goals.join(cuts.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    return sized, heavy, stored(plan.withColumnRenamed("source", "of"), "plan")


def _taken(rows: DataFrame, plan: DataFrame, most: int) -> DataFrame:
    """`rows` (source, place, ...) with their source's plan and `passes`."""
    passes = F.when(F.col("whole") >= most, F.lit(most)).otherwise(
        F.col("whole") + F.when(F.col("place") < F.col("cut"), 1).otherwise(0)).cast("int")
    return rows.join(small_side(plan), F.col("source").eqNullSafe(F.col("of"))).withColumn("passes", passes)


def mixed(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """doc_id, source, size, source_size, target, passes, taken for every row of `docs`.

    `docs` has doc_id, text, source; `passes` is how often the mix takes the document (0 to
    `most`), `taken` its words in the mix. Null text: no words. Null is a source of its own,
    last in order. Rows of one doc_id and source share a place, as do rows without doc_id, and
    are taken or left together, unless they hold more than HEAVY of their source's words: then
    each is placed by itself. Empty tables give no rows; other columns are not looked at.
    """
    sized, _, plan = _plan(docs, weights, share, most)
    return (_taken(sized, plan, most).select("doc_id", "source", "size", "source_size", "target", "passes")
            .withColumn("taken", F.col("size") * F.col("passes")))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """The mix itself: rows of `docs` as often as `mixed` says, all columns as they are.

    The passes of a row follow from its place and its source's plan, so texts are not joined
    with a table of documents; only rows that are placed one by one are shuffled. Of rows equal
    in doc_id, source and text, which one is taken more often is open.
    """
    _, heavy, plan = _plan(docs, weights, share, most)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    kept = _taken(_placed(docs.select(row, *_marks()), heavy), plan, most)
    return kept.select("row", F.explode(F.array_repeat(F.lit(1), F.col("passes"))).alias("pass")).select("row.*")
