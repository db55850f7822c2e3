"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly.

Items are short, documents may be very long, so a sketch of whole documents would say nothing
about an item inside. The sketch is therefore taken of the items: the smallest shingle hashes
of each (MinHash by bottom values). A document that contains a share c of an item's shingles
holds each sketch value with probability c, however long it is.

Both sides are partitioned by size. The size of an item sets the size of its sketch; the size
of a document, a power of four of its shingles, sets which items can be in it at all and how
many sketch values it must hold, as chance hits grow with its length. Candidates are verified
by the exact share of the item's shingles that the document holds.

DataFrame functions only. Documents are read twice: all for the search, the candidates again
to verify. Only shingles that hit a sketch leave the task that made them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leakscope.llm.common import row_id, small_side, stored, text_of, without, words

K = 5
CONTAINMENT = 0.8
#: Sketch values of an item: all of a small one, more of a larger one.
SKETCH_LEAST, SKETCH_SHARE = 12, 0.25


def shingles(word_list: Column, k: Column | int = K) -> Column:
    """Hashes of all runs of k words, in text order; none if the text is shorter."""
    return F.when(F.size(word_list) >= k, F.transform(
        F.sequence(F.lit(1), F.size(word_list) - F.lit(k) + 1),
        lambda at: F.xxhash64(F.slice(word_list, at, F.lit(k))))).otherwise(F.array().cast("array<bigint>"))


def size_class(count: Column) -> Column:
    """Partition of a document: the power of four of its number of shingles."""
    return F.floor(F.log(F.greatest(count, F.lit(1)).cast("double")) / F.log(F.lit(4.0)) + 1e-9).cast("int")


def item_shingles(items: DataFrame, k: int = K) -> DataFrame:
    """(item_id, k, n, hash): distinct shingles of each item; an item of fewer words than k is
    one shingle of all its words, one without words has none."""
    worded = items.select("item_id", words(text_of()).alias("w")).where(F.size("w") > 0)
    cut = stored(worded.select("item_id", F.least(F.size("w"), F.lit(k)).alias("k"), "w"), "items")
    sizes = sorted(r["k"] for r in cut.select("k").distinct().collect())  # at most k values
    parts = [cut.where(F.col("k") == size).select(
        "item_id", F.lit(size).alias("k"), F.array_distinct(shingles(F.col("w"), size)).alias("h")) for size in sizes]
    if not parts:
        return cut.select("item_id", "k", F.lit(0).alias("n"), F.lit(0).cast("bigint").alias("hash")).limit(0)
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    # rows that share an item_id are read as one item of all their shingles
    return (whole.select("item_id", "k", F.explode("h").alias("hash")).distinct()
            .join(whole.select("item_id", "k", F.explode("h").alias("hash")).distinct()
                  .groupBy("item_id", "k").agg(F.count(F.lit(1)).cast("int").alias("n")), ["item_id", "k"])
            .select("item_id", "k", "n", "hash"))


def sketch(shingled: DataFrame) -> DataFrame:
    """The smallest hashes of each item, as many as its size class takes: (item_id, k, n, m, hash)."""
    least = F.greatest(F.lit(SKETCH_LEAST), F.ceil(F.col("n") * SKETCH_SHARE)).cast("int")
    return (shingled.groupBy("item_id", "k", "n").agg(F.array_sort(F.collect_list("hash")).alias("h"))
            .withColumn("m", F.least(F.col("n"), least))
            .select("item_id", "k", "n", "m", F.explode(F.slice("h", F.lit(1), F.col("m"))).alias("hash")))


def _hits(docs: DataFrame, values: DataFrame, sizes: list[int]) -> DataFrame:
    """(rid, n_doc, item_id, k, n, m, hash) where a document's shingle is among `values`."""
    worded = docs.select(row_id().alias("rid"), words(text_of()).alias("w"))
    out = None
    for size in sizes:
        each = (worded.where(F.size("w") >= size)
                .select("rid", (F.size("w") - size + 1).alias("n_doc"), F.explode(shingles(F.col("w"), size)).alias("hash")))
        part = each.join(values.where(F.col("k") == size), "hash")
        out = part if out is None else out.unionByName(part)
    return out


def contaminated(docs: DataFrame, items: DataFrame, containment: float = CONTAINMENT, k: int = K) -> DataFrame:
    """doc_id, item_id, n_item, n_found, containment of every document that holds an item.

    `docs` (doc_id, text), `items` (item_id, text). An item counts as held if at least the
    share `containment` of its distinct word shingles occurs in the document. Null, empty and
    wordless texts hold nothing and are held by nothing. Rows that share a doc_id are one
    document, rows that share an item_id one item; a row without doc_id or item_id is not reported,
    as it cannot be named. One row per pair; other columns are not looked at.
    """
    items = stored(item_shingles(items.where("item_id is not null"), k), "shingles")
    sizes = sorted(r["k"] for r in items.select("k").distinct().collect())  # at most k values
    docs = docs.select("doc_id", "text").where("doc_id is not null")
    if not sizes:
        return docs.select("doc_id", F.lit(None).cast("bigint").alias("item_id"), F.lit(0).alias("n_item"),
                           F.lit(0).alias("n_found"), F.lit(0.0).alias("containment")).limit(0)
    values = small_side(stored(sketch(items), "sketch"))
    found = (_hits(docs, values, sizes).groupBy("rid", "item_id", "k")
             .agg(F.max("n_doc").alias("n_doc"), F.max("n").alias("n"), F.max("m").alias("m"),
                  F.count_distinct("hash").alias("hits")))
    # a held item shows containment * m sketch values on average; five deviations less is still a
    # candidate, and in longer documents at least one value more for each size class above the sixth
    spread = F.sqrt(F.col("m") * containment * (1 - containment))
    certain = F.col("m") * containment - 5 * spread
    need = F.greatest(F.lit(1.0), F.least(certain, 1.0 + F.greatest(size_class(F.col("n_doc")) - 6, F.lit(0))))
    pairs = stored(found.where(F.col("n_doc") >= F.ceil(F.col("n") * containment - 1e-9))
                   .where(F.col("hits") >= need).select("rid", "item_id", "k"), "pairs")
    ids = small_side(stored(pairs.select("rid").distinct(), "suspects"))
    again = docs.withColumn("rid", row_id()).join(ids, "rid", "left_semi").select("doc_id", "text")
    exact = (_hits(again, small_side(items.withColumn("m", F.col("n"))), sizes)
             .select("rid", "item_id", "k", "n", "hash").distinct()
             .join(pairs, ["rid", "item_id", "k"], "left_semi")
             .groupBy("rid", "item_id", "n").agg(F.count(F.lit(1)).cast("int").alias("n_found")))
    return (exact.where(F.col("n_found") >= F.ceil(F.col("n") * containment - 1e-9))
            .select(F.col("rid").alias("doc_id"), "item_id", F.col("n").alias("n_item"), "n_found",
                    (F.col("n_found") / F.col("n")).alias("containment")))


def drop_contaminated(docs: DataFrame, items: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """`docs` without those that hold an item; rows without doc_id stay."""
    held = contaminated(docs, items, containment).select("doc_id").distinct()
    return without(docs, stored(held, "contaminated"))


def drop_contaminated_rows(docs: DataFrame, items: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """As `drop_contaminated`, but rows without an id count too: each of `docs` by its own text,
    and each of `items` as an item of its own."""
    key = F.coalesce(F.concat(F.lit("i"), F.col("item_id").cast("string")), F.concat(F.lit("t"), F.xxhash64(text_of()).cast("string")))
    items = items.select(key.alias("item_id"), "text")
    named = drop_contaminated(docs.where("doc_id is not null"), items, containment)
    nameless = docs.where("doc_id is null")
    if not nameless.limit(1).count():
        return named
    by_text = F.xxhash64(text_of())
    held = small_side(stored(contaminated(nameless.select(by_text.alias("doc_id"), "text"), items, containment)
                             .select(F.col("doc_id").alias("held")).distinct(), "contaminated"))
    return named.unionByName(nameless.join(held, by_text == held["held"], "left_anti").select(*docs.columns))
