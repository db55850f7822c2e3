"""Sharding by K-d tree partitioning: weighted medians along the widest metadata dimension.

Texts that are equal form one unit with one place in the space of metadata (source, kind of
text, length, order of arrival), so copies stay together, unless they outweigh a part of a
shard; then each row is a unit of its own, dealt by a hash of its id, its text and, among rows
equal in both, a running number, so that a hot group spreads.

The tree is grown from the top: a node that must still become n shards is cut along its widest
dimension where its bytes divide as floor(n / 2) to the rest. All nodes of a level are cut at
once. A cut is found by histograms: sum the bytes by node and range of the coordinate, find
the range in which the median falls, and look into it with finer ranges, until what it holds
is too little to matter. The driver sees one row per node. DataFrame functions only; texts are
read once.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leakscope.llm.common import numbered, stored, text_of

SHARDS = 40
#: A row costs its UTF-8 bytes and this much besides.
ROW_BYTES = 16
#: Share of a shard above which equal texts are not kept together, and by which a cut may be off.
HEAVY, SLACK = 0.05, 0.002
#: Ranges of one histogram, and bits of a coordinate and of the hash that breaks its ties.
RANGES, BITS, TIE_BITS = 1024, 31, 31
#: Rows numbered by one task within a shard.
RUN_ROWS = 100_000


def _scaled(column: Column) -> Column:
    return F.coalesce(column.cast("long"), F.lit(0)) % (1 << BITS)


def _units(docs: DataFrame, shards: int) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, size, text_crc32, unit), and units (unit, w, tie, d0...)."""
    text = text_of()
    bytes_ = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    rows = stored(docs.select(
        "doc_id", (bytes_ + ROW_BYTES).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("name"), F.xxhash64(F.col("doc_id"), text).alias("own"),
        F.xxhash64("source").alias("from"), F.xxhash64("lang").alias("kind")), "rows")
    total = rows.agg(F.sum("size").alias("bytes")).first()["bytes"] or 0
    heavy = rows.groupBy("name").agg(F.sum("size").alias("w")).where(F.col("w") > HEAVY * total / shards).select("name")
    heavy = stored(heavy, "heavy")  # at most shards / HEAVY rows
    if heavy.limit(1).count():
        hot = numbered(rows.join(F.broadcast(heavy), "name", "left_semi"), ["name", "own"])
        rows = (rows.join(F.broadcast(heavy), "name", "left_anti").withColumn("own", F.lit(0).cast("bigint"))
                .unionByName(hot.withColumn("own", F.xxhash64("own", "number")).drop("number")))
    else:
        rows = rows.withColumn("own", F.lit(0).cast("bigint"))
    rows = stored(rows.withColumn("unit", F.struct("name", "own")).drop("name", "own"), "rows")
    units = (rows.groupBy("unit").agg(
        F.sum("size").alias("w"), F.max("size").alias("each"), F.min("from").alias("from"),
        F.min("kind").alias("kind"), F.min("doc_id").alias("doc_id"))
        .select("unit", "w", F.pmod(F.xxhash64("unit.own", "unit.name"), F.lit(1 << TIE_BITS)).alias("tie"),
                _scaled(F.pmod("from", F.lit(1 << BITS))).alias("d0"), _scaled(F.pmod("kind", F.lit(1 << BITS))).alias("d1"),
                _scaled(F.log2(F.col("each").cast("double")) * (1 << 24)).alias("d2"), _scaled(F.abs("doc_id")).alias("d3")))
    return rows, stored(units, "units")


DIMENSIONS = ("d0", "d1", "d2", "d3")


def _path(tree: dict) -> Column:
    """Node of a unit: the literal tree as nested conditions, as deep as the tree."""
    def at(node: int) -> Column:
        cut = tree.get(node)
        if cut is None:
            return F.lit(node)
        return F.when(_key(cut[0]) < F.lit(cut[1]), at(2 * node)).otherwise(at(2 * node + 1))
    return at(1)


def _key(dimension: str) -> Column:
    """Coordinate with its tie-breaking hash behind it: one long, ordered, hardly ever equal."""
    return F.col(dimension) * F.lit(1 << TIE_BITS) + F.col("tie")


def _by_node(values: dict, kind: str) -> Column:
    """A per-node literal; nodes are at most as many as shards."""
    pairs = [x for node, value in values.items() for x in (F.lit(node), F.lit(value).cast(kind))]
    return F.element_at(F.create_map(*pairs), F.col("node"))


def _cuts(units: DataFrame, tree: dict, leaves: dict[int, int], spans: dict) -> dict:
    """Cut (dimension, key) for each node of `leaves` that must become more than one shard."""
    todo = [n for n, shards in leaves.items() if shards > 1]
    here = units.withColumn("node", _path(tree)).where(F.col("node").isin(todo))
    ends = [f(d).alias(f"{name}_{d}") for d in DIMENSIONS for name, f in (("lo", F.min), ("hi", F.max))]
    found = here.groupBy("node").agg(F.sum("w").alias("w"), *ends).collect()  # one row per node
    cuts, state = {}, {}
    for r in found:
        wide = max(DIMENSIONS, key=lambda d: ((r[f"hi_{d}"] - r[f"lo_{d}"]) / max(1, spans[d]), d))
        low, high = r[f"lo_{wide}"] << TIE_BITS, ((r[f"hi_{wide}"] + 1) << TIE_BITS) - 1
        n = leaves[r["node"]]
        state[r["node"]] = {"d": wide, "lo": low, "hi": high, "goal": r["w"] * (n // 2) / n, "slack": SLACK * r["w"] / n}
    while state:
        step = {n: (s["hi"] - s["lo"]) // RANGES + 1 for n, s in state.items()}
        dims = _by_node({n: s["d"] for n, s in state.items()}, "string")
        key = F.coalesce(*[F.when(F.col("dim") == d, _key(d)) for d in DIMENSIONS])
        low = F.col("key") - _by_node({n: s["lo"] for n, s in state.items()}, "long")
        near = (units.withColumn("node", _path(tree)).where(F.col("node").isin(list(state)))
                .withColumn("dim", dims).withColumn("key", key)
                .where(F.col("key").between(_by_node({n: s["lo"] for n, s in state.items()}, "long"),
                                            _by_node({n: s["hi"] for n, s in state.items()}, "long"))))
        sums = (near.withColumn("range", F.floor(low / _by_node(step, "long")).cast("int"))
                .groupBy("node", "range").agg(F.sum("w").alias("w"), F.min("key").alias("first"), F.max("key").alias("last")))
        goal = _by_node({n: s["goal"] for n, s in state.items()}, "double")
        run = Window.partitionBy("node").orderBy("range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        ends = (sums.withColumn("through", F.sum("w").over(run)).where(F.col("through") >= goal - 1e-6)
                .groupBy("node").agg(F.min_by(F.struct("w", "first", "last", "through"), "range").alias("b")).collect())
        for r in ends:  # one row per node
            node, b = r["node"], r["b"]
            s = state[node]
            before = b["through"] - b["w"]
            if b["first"] == b["last"] or b["w"] <= s["slack"]:
                take = b["through"] - s["goal"] < s["goal"] - before
                cuts[node] = (s["d"], (b["last"] + 1) if take else b["first"])
                del state[node]
            else:
                s |= {"lo": b["first"], "hi": b["last"], "goal": s["goal"] - before}
    return cuts


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law ('bytes'), shard, slot, grown_shard for every row of `docs`.

    `docs` has doc_id, text, source, lang. The sizes (UTF-8 bytes and ROW_BYTES) of the shards
    come out near equal. Equal texts share a shard, unless they outweigh HEAVY of one: then
    their rows are dealt out one by one, also rows that share a doc_id or have none. Slots count from 0 without gaps within a shard.
    grown_shard is null: under this law one more shard moves other rows too. Null text has no
    bytes; null metadata is a place of its own; repeated rows each get a slot. Fewer units than
    shards leave some shards empty, an empty table gives no rows. Other columns are not looked at.
    """
    rows, units = _units(docs.select("doc_id", "text", "source", "lang"), shards)
    bounds = units.agg(*[f(d).alias(f"{n}_{d}") for d in DIMENSIONS for n, f in (("lo", F.min), ("hi", F.max))]).first()
    tree: dict = {}
    leaves = {1: shards}
    if bounds[0] is not None:
        spans = {d: bounds[f"hi_{d}"] - bounds[f"lo_{d}"] for d in DIMENSIONS}
        while cuts := _cuts(units, tree, leaves, spans):
            tree |= cuts
            leaves = {child: n for node, shards_of in leaves.items() for child, n in (
                ((2 * node, shards_of // 2), (2 * node + 1, shards_of - shards_of // 2)) if node in cuts else ((node, shards_of),))}
    number = {node: at for at, node in enumerate(sorted(leaves, key=lambda n: format(n, "b")))}
    placed = units.select("unit", _path(tree).alias("node")).withColumn("shard", _by_node(number, "int")).select("unit", "shard")
    # a unit of many rows is no heavier than HEAVY of a shard, so no key of this join is hot
    dealt = stored(rows.join(placed, "unit").select("doc_id", "size", "text_crc32", "unit.own", "shard"), "dealt")
    return _slots(dealt, shards).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                                        F.lit(None).cast("int").alias("grown_shard"))


def _slots(dealt: DataFrame, shards: int) -> DataFrame:
    """Gapless numbers within each shard: runs of a shard are numbered apart and moved up by
    the rows of the runs before them. Runs grow in number with the rows, not in size."""
    runs = math.ceil(dealt.count() / shards / RUN_ROWS) + 1
    cut = dealt.withColumn("run", F.pmod(F.xxhash64("doc_id", "text_crc32", "own"), F.lit(runs)).cast("int"))
    counts = cut.groupBy("shard", "run").agg(F.count(F.lit(1)).alias("rows"))
    before = Window.partitionBy("shard").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "run", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("shard", "run").orderBy("doc_id", "text_crc32", "own")
    return (cut.withColumn("at", F.row_number().over(inside) - 1).join(starts, ["shard", "run"])
            .withColumn("slot", (F.col("start") + F.col("at")).cast("long")))
