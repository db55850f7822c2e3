"""Near-duplicate documents by Order MinHash, verified by banded alignment of word 5-grams.

A document is the sequence of its k-mers (five words), each labelled with its occurrence
number, so that the labelled k-mers of a text are distinct. A sketch takes the few smallest
of them under a seeded hash and keeps them in text order; two texts are candidates if one of
their sketches is equal. A candidate pair is verified by the longest common order-preserving
chain of labelled k-mers inside the band that the threshold allows: with m k-mers on the
chain, similarity = m / (A + B - m).

Texts with equal words form one class first, so copies are sketched and compared once. In
each bucket all members are compared to its first member; members of one bucket that are then
still in different components are compared with each other, and where a bucket is too large
for that, all its pairs that can reach the threshold are found by their rarest k-mers
(prefix filter, exact). So the number of compared pairs does not grow with the square of a
group of copies, and no pair of a bucket is left out.
"""

from __future__ import annotations

import bisect
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leakscope.llm.common import (
    NO_ID, components, row_id, small_side, stored, text_of, with_edges, without, words,
)

K = 5
THRESHOLD = 0.8
#: Sketches and k-mers in each: a pair at 0.8 shares none with probability (1 - 0.64) ** 10 = 4e-5.
TABLES, PICKED = 10, 2
#: Pairs per member up to which a bucket's open pairs are listed; beyond, the prefix filter.
OPEN_PAIRS = 16
#: Members of such a bucket that all others are first compared with, besides its first.
HEADS = 8
#: Bins of the histogram by which k-mers are told to be rare.
BINS = 1 << 18
#: Words of 64 bits in the parity sketch of a text.
PARITY = 8

_M1, _M2, _M3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_S30, _S27, _S31 = np.uint64(30), np.uint64(27), np.uint64(31)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; wraps around on purpose."""
    x = (x ^ (x >> _S30)) * _M1
    x = (x ^ (x >> _S27)) * _M2
    return x ^ (x >> _S31)


def labelled_kmers(hashed: np.ndarray, k: int = K) -> np.ndarray:
    """Occurrence-labelled k-mers of a sequence of word hashes, in text order.

    A text of fewer than k words is one k-mer of all its words; no words, no k-mers.
    """
    w = hashed.astype(np.uint64)
    if not len(w):
        return w
    size = min(k, len(w))
    grams = np.full(len(w) - size + 1, size, dtype=np.uint64)
    for i in range(size):
        grams = mix(grams * _M3 + w[i:len(w) - size + 1 + i])
    order = np.argsort(grams, kind="stable")
    ranked = grams[order]
    fresh = np.r_[True, ranked[1:] != ranked[:-1]]
    if fresh.all():
        return grams
    first = np.maximum.accumulate(np.where(fresh, np.arange(len(grams)), 0))
    label = np.empty(len(grams), dtype=np.uint64)
    label[order] = (np.arange(len(grams)) - first).astype(np.uint64)
    return np.where(label > 0, mix(grams ^ (label * _M3)), grams)


def sketches(kmers: np.ndarray, tables: int = TABLES, picked: int = PICKED) -> np.ndarray:
    """One key per table: its `picked` smallest k-mers hashed together in text order."""
    seeds = np.arange(1, tables + 1, dtype=np.uint64) * _M3
    take = min(picked, len(kmers))
    value = mix(kmers[None, :] ^ seeds[:, None])
    if take < len(kmers):
        at = np.sort(np.argpartition(value, take - 1, axis=1)[:, :take], axis=1)
        value = np.take_along_axis(value, at, axis=1)
    keys = seeds.copy()
    for i in range(take):
        keys = mix(keys * _M3 + value[:, i])
    return keys


def chain_similarity(a: np.ndarray, b: np.ndarray, threshold: float = THRESHOLD) -> float:
    """Similarity of two labelled k-mer sequences by their longest chain in the band.

    0.0 as soon as the threshold is out of reach. A chain that reaches it leaves at most
    A + B - 2m k-mers unmatched, so none of its points lies further off the diagonal.
    """
    total = len(a) + len(b)
    need = math.ceil(threshold * total / (1 + threshold) - 1e-9)
    if not len(a) or not len(b) or min(len(a), len(b)) < need:
        return 0.0
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if len(i) < need:
        return 0.0
    inside = np.abs(i - j) <= total - 2 * need
    i, j = i[inside], j[inside]
    j = j[np.argsort(i)]
    if len(j) and (np.diff(j) > 0).all():
        m = len(j)
    else:
        tails: list[int] = []
        for x in j.tolist():
            at = bisect.bisect_left(tails, x)
            if at == len(tails):
                tails.append(x)
            else:
                tails[at] = x
        m = len(tails)
    return m / (total - m) if m >= need else 0.0


def _digest(hashed: np.ndarray) -> int:
    """One 64-bit name of a word sequence."""
    if not len(hashed):
        return 0
    place = mix(np.arange(1, len(hashed) + 1, dtype=np.uint64) * _M3)
    total = (mix(hashed.astype(np.uint64) ^ place)).sum(dtype=np.uint64)
    return int(mix(np.atleast_1d(total ^ np.uint64(len(hashed))))[0].astype(np.int64))


def _lists(column) -> tuple[np.ndarray, np.ndarray]:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)


def _hashed_docs(docs: DataFrame) -> DataFrame:
    return docs.select(row_id().alias("rid"),
                       F.transform(words(text_of()), lambda w: F.xxhash64(w)).alias("w"))


def _sketch_batches(k, tables, picked):
    def run(batches):
        for batch in batches:
            at, flat = _lists(batch.column(1))
            units, sizes, keys = [], [], []
            for lo, hi in zip(at[:-1], at[1:]):
                grams = labelled_kmers(flat[lo:hi], k)
                units.append(_digest(flat[lo:hi]))
                sizes.append(len(grams))
                keys.append(sketches(grams, tables, picked).astype(np.int64) if len(grams) else [])
            yield pa.record_batch([batch.column(0), pa.array(units, pa.int64()), pa.array(sizes, pa.int32()),
                                   pa.array(keys, pa.list_(pa.int64()))], names=["rid", "unit", "n", "keys"])
    return run


def _kmer_batches(k):
    def run(batches):
        for batch in batches:
            at, flat = _lists(batch.column(1))
            units, grams = [], []
            for lo, hi in zip(at[:-1], at[1:]):
                units.append(_digest(flat[lo:hi]))
                grams.append(labelled_kmers(flat[lo:hi], k).astype(np.int64))
            yield pa.record_batch([batch.column(0), pa.array(units, pa.int64()),
                                   pa.array(grams, pa.list_(pa.int64()))], names=["rid", "unit", "grams"])
    return run


def _verify_batches(threshold):
    def run(batches):
        for batch in batches:
            at_a, flat_a = _lists(batch.column(2))
            at_b, flat_b = _lists(batch.column(3))
            sims = [chain_similarity(flat_a[at_a[i]:at_a[i + 1]], flat_b[at_b[i]:at_b[i + 1]], threshold)
                    for i in range(batch.num_rows)]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(sims, pa.float64())],
                                  names=["a", "b", "similarity"])
    return run


def _kmers_of(docs: DataFrame, units: DataFrame, k: int) -> DataFrame:
    """(unit, grams) of the named units, from the one document that stands for each."""
    ids = small_side(stored(units.select("rep").distinct().withColumnRenamed("rep", "rid"), "named"))
    hashed = (docs.withColumn("rid", row_id()).join(ids, "rid", "left_semi")
              .transform(_hashed_docs))
    grams = hashed.mapInArrow(_kmer_batches(k), "rid long, unit long, grams array<long>")
    if ids.where(F.col("rid") == NO_ID).limit(1).count():
        grams = grams.dropDuplicates(["rid", "unit"])  # rows without id may come with many copies
    # a doc_id may come with several texts: only those named; equal rows count once
    return (grams.join(units.select(F.col("rep").alias("rid"), "unit").distinct(), ["rid", "unit"], "left_semi")
            .select("unit", "grams"))


def _verified(docs: DataFrame, pairs: DataFrame, units: DataFrame, k: int, threshold: float) -> DataFrame:
    """Those of `pairs` (a, b: units) that reach the threshold, with their similarity."""
    # stored, as it is read twice: for the documents to read and for the texts of theirs to take
    named = stored(units.join(pairs.select(F.explode(F.array("a", "b")).alias("unit")).distinct(), "unit")
                   .select("unit", "rep"), "pending")
    grams = stored(_kmers_of(docs, named, k), "kmers")
    left, right = grams.toDF("a", "left"), grams.toDF("b", "right")
    lined = pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right")
    return (lined.mapInArrow(_verify_batches(threshold), "a long, b long, similarity double")
            .where(F.col("similarity") >= threshold).dropDuplicates(["a", "b"]))


def _can_match(threshold: float, a: str = "na", b: str = "nb"):
    return F.least(a, b) >= F.lit(threshold) * F.greatest(a, b)


def _load_batches(bins):
    def run(batches):
        load = np.zeros(bins, dtype=np.int64)
        for batch in batches:
            _, flat = _lists(batch.column(0))
            load += np.bincount(flat.astype(np.uint64) % np.uint64(bins), minlength=bins)
        at = np.flatnonzero(load)
        yield pa.record_batch([pa.array(at, pa.int64()), pa.array(load[at], pa.int64())], names=["bin", "load"])
    return run


def parity(grams: np.ndarray, size: int = PARITY) -> np.ndarray:
    """Whether an odd number of `grams` fall on each of 64 * size bits. Two sets differ in at least
    as many elements as their sketches in bits."""
    odd = np.bincount(mix(grams.astype(np.uint64)) % np.uint64(64 * size), minlength=64 * size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _prefix_batches(load, threshold):
    def run(batches):
        for batch in batches:
            at, flat = _lists(batch.column(3))
            rows, grams, places, odd = [], [], [], []
            for row, (lo, hi) in enumerate(zip(at[:-1], at[1:])):
                own = flat[lo:hi]
                odd.append(parity(own))
                keep = len(own) - math.ceil(len(own) * threshold - 1e-9) + 1
                first = np.lexsort((own, load[own.astype(np.uint64) % np.uint64(len(load))]))[:keep]
                rows.append(np.full(len(first), row))
                grams.append(own[first])
                places.append(np.arange(len(first)))
            row, gram, place = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (rows, grams, places))
            columns = [*(batch.column(i) for i in range(3)), pa.array(odd, pa.list_(pa.int64()))]
            own = [column.take(pa.array(row, pa.int64())) for column in columns]
            yield pa.record_batch([*own, pa.array(gram, pa.int64()), pa.array(place, pa.int32())],
                                  names=["unit", "component", "n", "odd", "gram", "i"])
    return run


def _rare_pairs(docs, members: DataFrame, units: DataFrame, k: int, threshold: float) -> DataFrame:
    """All pairs of `members` (unit, component, n) in different components that can reach the
    threshold: in any common order of k-mers, such pairs share one of their first
    n - ceil(threshold * n) + 1, and the shorter text of a pair has it among still fewer. The
    order puts k-mers in rarely filled bins of a hash first.

    A unit's component and size are joined to it before its k-mers are listed, and k-mers of one
    component alone, or of no text that could be the shorter one, are left out before any join.
    Texts of a group share most of their k-mers though few of them are near enough: the join
    leaves out pairs whose parity sketches differ in more bits than the threshold allows k-mers."""
    members = stored(members.select("unit", "component", "n").distinct(), "members")
    named = units.join(members.select("unit"), "unit").select("unit", "rep")
    grams = stored(_kmers_of(docs, named, k).join(members, "unit").select("unit", "component", "n", "grams"), "postings")
    counted = (grams.select("grams").mapInArrow(_load_batches(BINS), "bin long, load long")
               .groupBy("bin").agg(F.sum("load").alias("load")).toArrow())  # at most BINS rows, as two arrays
    load = np.zeros(BINS, dtype=np.int64)
    load[counted["bin"].to_numpy()] = counted["load"].to_numpy()
    # so many k-mers a text shares at least with one that is not shorter
    least = F.ceil(F.col("n") * F.lit(2 * threshold / (1 + threshold)) - 1e-9)
    rare = stored(grams.mapInArrow(_prefix_batches(load, threshold), "unit long, component long, n int, odd array<long>, gram long, i int")
                  .withColumn("shorter", F.col("n") - F.col("i") >= least), "rare")
    mixed = stored(rare.groupBy("gram").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.max("shorter").alias("some"))
                   .where("lo <> hi and some").select("gram"), "mixed")
    rare = stored(rare.join(mixed, "gram", "left_semi"), "shared")
    left = rare.where("shorter").select("gram", *[F.col(c).alias(x) for c, x in (("unit", "a"), ("i", "ia"), ("component", "ca"), ("n", "na"), ("odd", "oa"))])
    right = rare.select("gram", *[F.col(c).alias(x) for c, x in (("unit", "b"), ("i", "ib"), ("component", "cb"), ("n", "nb"), ("odd", "ob"))])
    # the first k-mer that two texts share, by rarity, leaves at most so many more to share
    need = F.ceil((F.col("na") + F.col("nb")) * F.lit(threshold / (1 + threshold)) - 1e-9)
    enough = F.least(F.col("na") - F.col("ia"), F.col("nb") - F.col("ib")) >= need
    differ = sum((F.bit_count(F.col("oa")[i].bitwiseXOR(F.col("ob")[i])) for i in range(PARITY)), F.lit(0))
    return (left.join(right, "gram").where("ca <> cb and (na < nb or na = nb and a < b)").where(_can_match(threshold))
            .where(enough).where(differ <= F.col("na") + F.col("nb") - 2 * need)
            .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())


def _open(shared: DataFrame, grouped: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members of buckets that span several components, labelled: those of buckets whose open
    pairs can be listed, and the rest."""
    labelled = (shared.join(grouped, shared["unit"] == grouped["node"], "left")
                .select("t", "key", "unit", "n", F.coalesce("component", "unit").alias("component")))
    sizes = labelled.groupBy("t", "key", "component").agg(F.count(F.lit(1)).alias("m"))
    pending = (sizes.groupBy("t", "key")
               .agg(F.sum("m").alias("m"), F.sum(F.col("m") * F.col("m")).alias("same"), F.count(F.lit(1)).alias("parts"))
               .where("parts > 1").withColumn("open", (F.col("m") * F.col("m") - F.col("same")) / 2))
    pending = stored(pending, "pending")
    left = stored(labelled.join(pending, ["t", "key"]), "open")
    listable = F.col("open") <= OPEN_PAIRS * F.col("m")
    return left.where(listable), left.where(~listable)


def _more_heads(members: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) of each member with HEADS members of its largest bucket, drawn by hash, that lie
    in another component: most parts of a large group meet here, in at most HEADS pairs a member
    however many buckets it is in. What they leave open is compared after it, bucket by bucket."""
    largest = F.max(F.struct("m", "t", "key"))
    members = stored(members.join(members.groupBy("unit").agg(largest.alias("own")).select(
        "unit", F.col("own.t").alias("t"), F.col("own.key").alias("key")), ["unit", "t", "key"]), "members")
    head = lambda i: F.min(F.struct(F.xxhash64("unit", F.lit(i)).alias("place"), "unit", "component", "n"))
    heads = (members.groupBy("t", "key").agg(*[head(i).alias(f"h{i}") for i in range(HEADS)])
             .select("t", "key", F.explode(F.array_distinct(F.array(*[f"h{i}" for i in range(HEADS)]))).alias("h")))
    met = members.join(stored(heads, "heads"), ["t", "key"]).where("component <> h.component").withColumn("hn", F.col("h.n"))
    return met.where(_can_match(threshold, "n", "hn")).select(
        F.least("unit", "h.unit").alias("a"), F.greatest("unit", "h.unit").alias("b")).distinct()


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, k: int = K,
                    tables: int = TABLES, picked: int = PICKED) -> dict[str, DataFrame]:
    """Classes of near-duplicate documents over `docs` (doc_id, text).

    Returns `classes`: doc_id, class_id (smallest doc_id of the class), kept (one doc_id of each
    class); and `links`: a, b, similarity of the verified pairs of texts that hold the classes
    together, named by the smallest doc_ids with their words.

    Null or wordless texts resemble nothing and are kept. Rows that share a doc_id are one
    document: they share a class. A row without a doc_id is a document of its own text that sorts
    last (class_id null where no row of the class has one); copies of it are kept or not together.
    `nameless` has unit, kept of such rows. Repeated rows are repeated in the result. Other columns are
    not looked at.
    """
    docs = docs.select("doc_id", "text")
    found = stored(_hashed_docs(docs).mapInArrow(
        _sketch_batches(k, tables, picked), "rid long, unit long, n int, keys array<long>"), "sketches")
    worded = found.where("n > 0")
    units = stored(worded.groupBy("unit").agg(
        F.min("rid").alias("rep"), F.first("n").alias("n"), F.first("keys").alias("keys")), "units")
    buckets = units.select("unit", "rep", "n", F.posexplode("keys").alias("t", "key"))
    # stored, so that its join is one of two shuffled sides and a hot bucket can be split
    heads = stored(buckets.groupBy("t", "key").agg(F.count(F.lit(1)).alias("members"),
                                                   F.min(F.struct("rep", "unit", "n")).alias("head"))
                   .where("members > 1"), "heads")
    shared = stored(buckets.join(heads, ["t", "key"])
                    .select("t", "key", "unit", "rep", "n", "members", F.col("head.unit").alias("head"),
                            F.col("head.n").alias("head_n")), "shared")
    stars = stored(shared.where("unit <> head").where(_can_match(threshold, "n", "head_n"))
                   .select(F.least("unit", "head").alias("a"), F.greatest("unit", "head").alias("b"))
                   .distinct(), "stars")
    links = stored(_verified(docs, stars, units, k, threshold), "links")
    grouped = components(links)
    few, many = _open(shared, grouped)
    if many.limit(1).count():
        heads = stored(_more_heads(many, threshold).join(stars, ["a", "b"], "left_anti"), "heads")
        stars = stored(stars.unionByName(heads), "stars")
        more = stored(_verified(docs, heads, units, k, threshold), "more")
        links, grouped = links.unionByName(more), with_edges(grouped, more)
        few, many = _open(shared, grouped)
    x = few.select("t", "key", F.col("unit").alias("a"), F.col("component").alias("ca"), F.col("n").alias("na"))
    y = few.select("t", "key", F.col("unit").alias("b"), F.col("component").alias("cb"), F.col("n").alias("nb"))
    listed = x.join(y, ["t", "key"]).where("a < b and ca <> cb").where(_can_match(threshold)).select("a", "b")
    if many.limit(1).count():
        listed = listed.unionByName(_rare_pairs(docs, many, units, k, threshold))
    rest = stored(listed.distinct().join(stars, ["a", "b"], "left_anti"), "rest")
    if rest.limit(1).count():
        more = stored(_verified(docs, rest, units, k, threshold), "more")
        links, grouped = links.unionByName(more), with_edges(grouped, more)

    names = units.select("unit", "rep")
    named = stored(links.join(names.toDF("a", "ra"), "a").join(names.toDF("b", "rb"), "b")
                   .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"), "similarity"), "named")
    nameless = stored(found.where(F.col("rid") == NO_ID), "nameless")
    if nameless.limit(1).count():
        classes, kept = _classes_without_ids(found, worded, units, grouped, nameless)
        return {"classes": classes, "links": named, "nameless": kept}
    # texts that share a doc_id meet there
    several = worded.groupBy("rid").agg(F.min("unit").alias("b"), F.max("unit").alias("last")).where("b <> last").select("rid", "b")
    met = stored(worded.select("rid", F.col("unit").alias("a")).join(several, "rid").where("a <> b").select("a", "b").distinct(), "met")
    if met.limit(1).count():
        grouped = with_edges(grouped, met)
    parts = stored(grouped.join(names, grouped["node"] == names["unit"]).select("unit", "component", "rep"), "parts")
    least = stored(parts.groupBy("component").agg(F.min("rep").alias("least")), "least")
    moved = stored(parts.join(least, "component").select("unit", "least"), "moved")
    whole = (worded.select("rid", "unit").distinct().join(names, "unit").join(moved, "unit", "left")
             .select("rid", F.coalesce("least", "rep").alias("component")).where("rid <> component").distinct())
    whole = whole.withColumnRenamed("rid", "node")
    one = stored(
        found.select("rid")
        .join(whole, F.col("rid") == whole["node"], "left")
        .select("rid", F.coalesce("component", "rid").alias("class_id")), "classes")
    none = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    classes = one.select(
        none("rid").alias("doc_id"), none("class_id").alias("class_id"),
        (F.col("rid") == F.col("class_id")).alias("kept"))
    return {"classes": classes, "links": named, "nameless": nameless.select("unit", F.lit(True).alias("kept"))}


def _classes_without_ids(found: DataFrame, worded: DataFrame, units: DataFrame, grouped: DataFrame,
                         nameless: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Classes where rows lack a doc_id, and (unit, kept) of the worded ones among them.

    A node is (last, id): a doc_id, or behind all of those the unit of a text that only rows
    without doc_id have.
    """
    key = lambda rid: F.struct((F.col(rid) == NO_ID).alias("last"), F.when(F.col(rid) == NO_ID, F.col("unit")).otherwise(F.col(rid)).alias("id"))
    reps = stored(units.select("unit", key("rep").alias("key")), "reps")
    named = found.where(F.col("rid") != NO_ID)
    met = worded.where(F.col("rid") != NO_ID).select("unit", key("rid").alias("a")).distinct()
    links = grouped.where("node <> component").toDF("a", "b")
    edges = (links.join(reps.toDF("a", "ka"), "a").join(reps.toDF("b", "kb"), "b").select(F.col("ka").alias("a"), F.col("kb").alias("b"))
             .unionByName(met.join(reps, "unit").where(F.col("a") != F.col("key")).select("a", F.col("key").alias("b"))))
    whole = components(edges)
    rows = (named.select("rid", "n", "unit", key("rid").alias("key"))
            .unionByName(nameless.join(reps, "unit", "left").select("rid", "n", "unit", "key")))
    one = stored(rows.join(whole, rows["key"] == whole["node"], "left")
                 .select("rid", "n", "unit", "key", F.coalesce("component", "key").alias("class")), "classes")
    alone = (F.col("rid") == NO_ID) & (F.col("n") == 0)
    # a text that also stands under a doc_id is not kept a second time
    kept = alone | ((F.col("class") == F.col("key")) & ((F.col("rid") != NO_ID) | F.col("key.last")))
    classes = one.select(
        F.when(F.col("rid") != NO_ID, F.col("rid")).alias("doc_id"),
        F.when(~alone & ~F.col("class.last"), F.col("class.id")).alias("class_id"),
        F.coalesce(kept, F.lit(False)).alias("kept"))
    return classes, one.where((F.col("rid") == NO_ID) & (F.col("n") > 0)).select("unit", kept.alias("kept")).distinct()


def drop_near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """`docs` with one row of each class: the smallest doc_id, and of repeated rows one. Rows
    without doc_id are dropped by their texts; of a class of such rows alone, one stays."""
    found = near_duplicates(docs, threshold)
    classes = stored(found["classes"], "classes")
    whole, docs = docs, docs.where("doc_id is not null")
    out = without(docs, classes.where(~F.col("kept") & F.col("doc_id").isNotNull()).select("doc_id").distinct())
    twice = classes.where("kept and doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    twice = stored(twice, "repeated")
    if twice.limit(1).count():
        again = docs.join(small_side(twice), "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id"])
        out = without(out, twice).unionByName(again)
    rest = whole.where("doc_id is null")
    if rest.limit(1).count():
        out = out.unionByName(_one_of_each_text(rest, stored(found["nameless"], "kept")))
    return out


def _one_of_each_text(rows: DataFrame, kept: DataFrame) -> DataFrame:
    """Rows without doc_id: one of each kept unit, and all without words."""
    by_text = F.xxhash64(text_of())
    units = stored(_hashed_docs(rows.select(by_text.alias("doc_id"), "text")).mapInArrow(
        _sketch_batches(K, TABLES, PICKED), "rid long, unit long, n int, keys array<long>").select("rid", "unit", "n"), "texts")
    wordless = units.where("n = 0").select("rid").distinct()
    chosen = units.where("n > 0").join(kept.where("kept").select("unit").distinct(), "unit", "left_semi").groupBy("unit").agg(F.min("rid").alias("rid"))
    name = rows.withColumn("__text", by_text)
    pick = lambda ids: name.join(small_side(stored(ids.select(F.col("rid").alias("__text")), "chosen")), "__text", "left_semi")
    return (pick(chosen).dropDuplicates(["__text"]).unionByName(pick(wordless))).select(*rows.columns)
