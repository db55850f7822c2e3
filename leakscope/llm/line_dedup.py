"""Removal of lines that several documents share.

Lines are exploded as hashes with their positions; a first aggregation finds for each hash the
smallest and the largest document that holds it, so a line in a third of all documents is one
row per task before the shuffle. Only lines of shared hashes are joined back, only positions
to drop travel to the documents, and the kept lines of a text are put together in its row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leakscope.llm.common import row_id, stored, text_of

#: Code points from which a line counts, and documents from which it is shared.
LEAST_CHARS, LEAST_DOCS = 10, 2
BLANK = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line without ASCII white space at both ends, A to Z in lower case."""
    bare = F.btrim(line, F.lit(BLANK))
    ascii_only = F.char_length(line) == F.octet_length(line)
    return F.when(ascii_only, F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _without(text: Column, dropped: Column) -> Column:
    """The lines of a text but for the sorted positions `dropped`, joined again."""
    edges = F.concat(F.array(F.lit(-1)), dropped)
    # bound once in a struct, so that the text is not split again for each run of lines
    made = F.transform(F.array(F.struct(_lines(text).alias("l"), edges.alias("e"))), lambda s: F.flatten(F.transform(
        s["e"], lambda at, i: F.slice(
            s["l"], at + 2, F.greatest(F.lit(0), F.coalesce(F.get(s["e"], i + 1), F.size(s["l"])) - at - 1)))))
    return F.array_join(made[0], "\n")


def shared_lines(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(rid, name, drop): sorted positions of the lines each text loses; texts that lose none are absent."""
    keyed = (docs.select(row_id().alias("rid"), F.xxhash64(text_of()).alias("name"),
                         F.posexplode(_lines(text_of())).alias("pos", "line"))
             .select("rid", "name", "pos", line_key(F.col("line")).alias("key"))
             .where(F.char_length("key") >= least_chars)
             .select("rid", "name", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), F.col("key")).alias("h2")))
    if least_docs == 2:
        held = F.when(F.min("rid") < F.max("rid"), 2).otherwise(1)
    else:
        held = F.count_distinct("rid")
    shared = (keyed.groupBy("h1", "h2").agg(F.min("rid").alias("first"), held.alias("held"))
              .where(F.col("held") >= least_docs).select("h1", "h2", "first"))
    # stored, so that its join is one of two shuffled sides and a very common line can be split
    return (keyed.join(stored(shared, "shared"), ["h1", "h2"]).where("rid <> first")
            .groupBy("rid", "name").agg(F.array_sort(F.collect_set("pos")).alias("drop")))


def drop_shared_lines(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """doc_id, text, n_lines, n_dropped: every text without the lines that others had first.

    Texts are split at line feeds (null or empty: one empty line). Lines whose key has at least
    `least_chars` code points and occurs in at least `least_docs` documents stay only in the
    document of the smallest doc_id, with all their repeats there. Rows that share a doc_id are
    one document; rows without doc_id are one that sorts last. Other columns are not looked at.
    """
    drops = stored(shared_lines(docs.select("doc_id", "text"), least_chars, least_docs), "drops")
    each = docs.select("doc_id", row_id().alias("rid"), text_of().alias("text"), F.xxhash64(text_of()).alias("name"))
    joined = each.join(drops, ["rid", "name"], "left")
    return joined.select("doc_id", F.when(F.col("drop").isNull(), F.col("text")).otherwise(_without(F.col("text"), F.col("drop"))).alias("text"),
                         F.size(_lines(F.col("text"))).cast("long").alias("n_lines"),
                         F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias("n_dropped"))
