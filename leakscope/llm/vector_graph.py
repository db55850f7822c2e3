"""Near-duplicate vectors, exactly: shards with a proven border, compared block by block.

1. Equal vectors become one point. Each length of vectors is linked among itself. Where a length
   has many points, a bounded sample gives cluster centres, none within reach of another, so a
   dense cluster has one; the home of a point is the shard of its nearest centre.
2. Shards are packed into blocks of bounded size; a shard above it is split into several.
3. A point is dealt to each block of a shard that can hold a linked point: it lies beyond the
   plane between both centres by no more than the reach of a link, and within the reach of the
   shard's outermost point. Both tests follow from the triangle inequality and lose no link.
4. A pair of blocks is one group of rows; its cosines are taken tile by tile, and those near the
   threshold again in double precision.
5. Points within half a link's angle of their centre, the core of a shard, are all linked with
   each other: they are counted, not compared.

A group reports counts and, for components, one edge per point to the smallest point of its
part of the group, never pairs. Where centres separate nothing, all blocks meet all blocks: the
work then grows with the square of the points, and no link is left out for it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leakscope.llm.common import components, small_side, stored

COSINE = 0.95
#: Points a shard should hold, bound on the number of shards, vectors that the centres are fitted on.
SHARD, MOST_SHARDS, SAMPLE = 2000, 16_384, 20_000
#: Vector components in a block, and the least points of one.
BLOCK_VALUES, LEAST_BLOCK = 1 << 20, 256
#: Points dealt or compared in one piece.
TILE = 256
#: Points whose links the audit counts against all points.
AUDIT = 64
#: Slack of the geometric tests, far above their rounding: a doubtful point is dealt and compared.
SLACK = 1e-6


def _settled(vectors: np.ndarray, c: np.ndarray, rounds: int) -> np.ndarray:
    """Unit centres after rounds of spherical k-means."""
    for _ in range(rounds):
        near = np.concatenate([(vectors[lo:lo + TILE] @ c.T).argmax(1) for lo in range(0, len(vectors), TILE)])
        sums = np.zeros_like(c)
        np.add.at(sums, near, vectors)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(size > 0, sums / np.maximum(size, 1e-12), c)
    return c


def centres(vectors: np.ndarray, count: int, cosine: float = COSINE, rounds: int = 8) -> np.ndarray:
    """Unit centres of spherical k-means, from evenly spaced starts; of centres within `cosine` of
    each other one stays. Neighbours in the result are similar."""
    c = _settled(vectors, vectors[np.linspace(0, len(vectors) - 1, count).astype(int)], rounds)
    alive, kept = np.ones(len(c), bool), []
    for i in range(len(c)):
        if alive[i]:
            kept.append(i)
            alive &= c @ c[i] < cosine
    c = _settled(vectors, c[kept], 1)
    return c[np.argsort(c @ np.linalg.svd(c - c.mean(0), full_matrices=False)[2][0], kind="stable")]


def _dots(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of pairs of rows, a bounded piece at a time."""
    out = np.empty(len(a))
    for lo in range(0, len(a), 1 << 14):
        out[lo:lo + (1 << 14)] = np.einsum("ij,ij->i", x[a[lo:lo + (1 << 14)]], x[b[lo:lo + (1 << 14)]])
    return out


def _unit(vectors) -> np.ndarray:
    x = np.array(list(vectors), dtype=np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _angle(cosines):
    return np.arccos(np.clip(cosines, -1.0, 1.0))


def layout(sizes: pd.DataFrame, count: int, most: int) -> dict[str, np.ndarray]:
    """Blocks of the shards of one length: first block and number of blocks of the rim and of the
    core of each shard, and its radius. `sizes` has shard, points, core, least (own cosine).

    Small shards share a block, rim and core together; a shard above `most` points has blocks of
    its own, apart for rim and core.
    """
    out = {k: np.zeros(count, np.int64) for k in ("rim", "rims", "inner", "inners")} | {"radius": np.full(count, -np.inf)}
    block, filled = 0, 0
    for shard, points, core, least in sizes.sort_values("shard")[["shard", "points", "core", "least"]].itertuples(index=False):
        out["radius"][shard] = _angle(least)
        if points > most:
            if filled:
                block, filled = block + 1, 0
            out["rim"][shard], out["rims"][shard] = block, math.ceil((points - core) / most)
            block += out["rims"][shard]
            out["inner"][shard], out["inners"][shard] = block, math.ceil(core / most)
            block += out["inners"][shard]
            continue
        if filled + points > most:
            block, filled = block + 1, 0
        out["rim"][shard], out["rims"][shard] = block, 1
        filled += points
    return out


def _place(middle: dict[int, np.ndarray], cosine: float):
    """Home shard of each point, its cosine to the centre, and whether it is in the core."""
    inner = math.sqrt((1 + cosine) / 2) + SLACK

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            shard, own = np.zeros(len(frame), np.int32), np.full(len(frame), -1.0)
            for width, at in frame.groupby("width").indices.items():
                if width in middle:
                    for lo in range(0, len(at), TILE):
                        here = at[lo:lo + TILE]
                        s = _unit(frame["vector"].iloc[here]) @ middle[width].T
                        shard[here], own[here] = s.argmax(1), s.max(1)
            yield frame.assign(shard=shard, own=own, core=own >= inner)
    return run


def _ranges(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, value) of all values first[i] ... first[i] + count[i] - 1."""
    index = np.repeat(np.arange(len(first)), count)
    return index, first[index] + np.arange(len(index)) - np.repeat(np.cumsum(count) - count, count)


def _deal(middle: dict[int, np.ndarray], plans: dict[int, dict], cosine: float):
    """A row for each pair of blocks (a, b) that a point has to be compared in; `mine` if its own is a."""
    reach, angle = math.sqrt(max(0.0, 2 - 2 * cosine)), math.acos(cosine)

    def blocks(part: pd.DataFrame, c: np.ndarray | None, plan: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        home, core = part["shard"].to_numpy(), part["core"].to_numpy()
        if c is None:
            may = np.ones((len(part), 1), bool)
        else:
            s = _unit(part["vector"]) @ c.T
            own = s[np.arange(len(part)), home]
            gap = np.sqrt(np.maximum(0.0, 2 - 2 * (c[home] @ c.T)))
            may = (own[:, None] - s <= reach * gap + SLACK) & (_angle(s) <= plan["radius"] + angle + SLACK)
            may[np.arange(len(part)), home] = True
        row, to = np.nonzero(may)
        # the core of the own shard is counted, if it has blocks of its own
        known = core[row] & (home[row] == to)
        i, rim = _ranges(plan["rim"][to], plan["rims"][to])
        j, inner = _ranges(plan["inner"][to], np.where(known, 0, plan["inners"][to]))
        met = np.unique(np.stack([np.r_[row[i], row[j]], np.r_[rim, inner]]), axis=1)
        apart = core & (plan["inners"][home] > 0)
        salt = part["point"].to_numpy() >> 20
        mine = np.where(apart, plan["inner"][home] + salt % np.maximum(plan["inners"][home], 1),
                        plan["rim"][home] + salt % np.maximum(plan["rims"][home], 1))
        return met[0], met[1], mine

    one = {"rim": np.zeros(1, np.int64), "rims": np.ones(1, np.int64), "inner": np.zeros(1, np.int64), "inners": np.zeros(1, np.int64)}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for width, at in frame.groupby("width").indices.items():
                for lo in range(0, len(at), TILE):
                    part = frame.iloc[at[lo:lo + TILE]]
                    row, block, mine = blocks(part, middle.get(width), plans.get(width, one))
                    own = mine[row]
                    out = part.iloc[row].reset_index(drop=True)
                    yield out.assign(a=np.minimum(own, block), b=np.maximum(own, block), mine=own <= block)[
                        ["width", "a", "b", "mine", "shard", "core", "point", "vector", "copies"]]
    return run


def _joined(label: np.ndarray, i: int, others: np.ndarray) -> None:
    """Give `i` and `others`, and all that share a label with them, the smallest of their labels."""
    theirs = label[others]
    low = min(theirs.min(), label[i])
    if label[i] != low or (theirs != low).any():
        label[np.isin(label, np.unique(np.r_[theirs, label[i]]))] = low


def _compare(cosine: float):
    """Linked copies of each point of a group that has some, and the smallest point of its part."""
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("point").reset_index(drop=True)
        point, copies, core, shard = (frame[c].to_numpy() for c in ("point", "copies", "core", "shard"))
        n, same, mine = len(frame), frame["a"].iloc[0] == frame["b"].iloc[0], frame["mine"].to_numpy()
        links, label = np.zeros(n), np.arange(n)
        left, right = (np.arange(n), np.arange(n)) if same else (np.flatnonzero(mine), np.flatnonzero(~mine))
        if len(left) and len(right):
            x = _unit(frame["vector"])
            rough, doubt = x.astype(np.float32), 1e-6 + 2.5e-7 * x.shape[1]
            for lo in range(0, len(left), TILE):
                l, r = left[lo:lo + TILE], right[lo:] if same else right
                s = rough[l] @ rough[r].T
                hit = s >= cosine
                i, j = np.nonzero(np.abs(s - np.float32(cosine)) <= doubt)
                hit[i, j] = _dots(x, l[i], r[j]) >= cosine
                if same:
                    hit &= l[:, None] < r
                for k in np.flatnonzero(hit.any(1) & core[l]):
                    hit[k] &= ~(core[r] & (shard[r] == shard[l[k]]))
                found = np.flatnonzero(hit.any(1))
                if len(found):
                    l, hit = l[found], hit[found]
                    links[l] += hit @ copies[r].astype(np.float64)
                    links[r] += copies[l].astype(np.float64) @ hit
                    for k in range(len(l)):
                        _joined(label, l[k], r[hit[k]])
        keep = links > 0
        return pd.DataFrame({"point": point[keep], "links": links[keep].astype(np.int64), "root": point[label][keep]})
    return run


def _audited(cosine: float):
    """Linked copies of the sampled points, a row for each pair."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            near = [float(np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w)) >= cosine for v, w in zip(
                (np.asarray(v, float) for v in frame["vector"]), (np.asarray(w, float) for w in frame["other"]))]
            yield pd.DataFrame({"point": frame["asked"], "there": frame["copies"]})[near]
    return run


def link_vectors(embeddings: DataFrame, cosine: float = COSINE, shard: int = SHARD) -> dict[str, DataFrame]:
    """Links at `cosine` or more among the vectors of `embeddings` (vec_id, embedding).

    Returns `vectors`: vec_id, n_links (other vectors linked directly), component_id (smallest
    vec_id reachable), kept (vec_id = component_id), one row for each given row; and `audit`:
    links found and links there are, of sampled points, counted against all points.

    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing;
    the others link with those of their own length. Repeated rows of one vec_id are copies and
    link with each other; rows without vec_id link like others, with null ids. Labels and other
    columns are not looked at. Centres are fitted on at most SAMPLE vectors; all are compared.
    """
    usable = (F.size("embedding") > 0) & F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))) \
        & F.exists("embedding", lambda c: c != 0)
    kind = embeddings.schema["embedding"].dataType
    kind = kind if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType) else T.ArrayType(T.DoubleType())
    vector = F.when(F.col("embedding").isNotNull() & usable, F.col("embedding").cast(kind))
    rows = stored(embeddings.select(F.coalesce("vec_id", F.lit((1 << 63) - 1)).alias("vec_id"), vector.alias("vector"))
                  .withColumn("point", F.when(F.col("vector").isNotNull(), F.xxhash64("vector"))), "vectors")
    equal = rows.where("vector is not null").groupBy("vector").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("copies"))
    # one vec_id may come with several vectors: places are numbered by their vector
    points = stored(equal.select(F.xxhash64("vector").alias("point"), F.size("vector").alias("width"), "vector", "copies", "first"), "points")

    many = {r["width"]: r["count"] for r in points.groupBy("width").count().where(F.col("count") > shard).collect()}
    total, middle = sum(many.values()), {}
    if many:
        share = math.ceil(min(1.0, SAMPLE / total) * (1 << 20))
        picked = (points.where(F.col("width").isin(list(many))).where(F.pmod(F.col("point"), F.lit(1 << 20)) < share)
                  .orderBy("point").limit(SAMPLE).select("width", "vector").toPandas())
        for width, part in picked.groupby("width"):
            count = min(math.ceil(many[width] / shard), math.ceil(MOST_SHARDS * many[width] / total), len(part))
            middle[width] = centres(_unit(part["vector"]), count, cosine)
    base = "point long, width int, vector {0}, copies long".format(kind.simpleString())
    placed = stored(points.select("point", "width", "vector", "copies").mapInPandas(
        _place(middle, cosine), base + ", shard int, own double, core boolean"), "placed")
    sizes = placed.where(F.col("width").isin(list(many))).groupBy("width", "shard").agg(
        F.count(F.lit(1)).alias("points"), F.sum(F.col("core").cast("int")).alias("core"), F.min("own").alias("least")).toPandas()
    plans = {width: layout(part, len(middle.get(width, [0])), max(LEAST_BLOCK, BLOCK_VALUES // width))
             for width, part in sizes.groupby("width")}
    dealt = placed.drop("own").mapInPandas(
        _deal(middle, plans, cosine), f"width int, a long, b long, mine boolean, shard int, core boolean, point long, vector {kind.simpleString()}, copies long")
    part = "point long, links long, root long"
    compared = dealt.groupBy("width", "a", "b").applyInPandas(_compare(cosine), part)
    cores = small_side(stored(placed.where("core").groupBy("width", "shard").agg(
        F.sum("copies").alias("all"), F.min("point").alias("root")), "cores"))
    inner = placed.where("core").select("width", "shard", "point", "copies").join(cores, ["width", "shard"])
    seen = stored(compared.unionByName(inner.select("point", (F.col("all") - F.col("copies")).alias("links"), "root")), "seen")

    # components over first ids, so that labels are the smallest vec_id
    ids = points.select("point", "first")
    edges = (seen.where("point <> root").select("point", "root").distinct().join(ids.toDF("point", "a"), "point")
             .join(ids.toDF("root", "b"), "root").select("a", "b"))
    own = rows.where("point is not null").select("point", "vec_id").join(ids, "point").where("vec_id <> first")
    whole = components(edges.unionByName(own.select(F.col("vec_id").alias("a"), F.col("first").alias("b"))))
    more = seen.groupBy("point").agg(F.sum("links").alias("links"))
    links = points.join(more, "point", "left").select(
        "point", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    null_id = lambda c: F.expr(f"nullif({c}, {(1 << 63) - 1})")
    ended = (rows.join(links, "point", "left").join(whole, F.col("vec_id") == whole["node"], "left")
             .withColumn("component", F.when(F.col("point").isNull(), F.col("vec_id")).otherwise(F.coalesce("component", "vec_id"))))
    vectors = ended.select(null_id("vec_id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"),
                           null_id("component").alias("component_id"), (F.col("vec_id") == F.col("component")).alias("kept"))

    asked = points.orderBy(F.xxhash64("point"), "point").limit(AUDIT).select(F.col("point").alias("asked"), "width", F.col("vector").alias("other"))
    there = (points.join(F.broadcast(asked), "width").where("point <> asked").select("asked", "other", "vector", "copies")
             .mapInPandas(_audited(cosine), "point long, there long").groupBy("point").agg(F.sum("there").alias("there")))
    found = asked.select(F.col("asked").alias("point")).join(more, "point", "left").join(there, "point", "left")
    audit = found.agg(F.coalesce(F.sum("links"), F.lit(0)).alias("found"), F.coalesce(F.sum("there"), F.lit(0)).alias("there"))
    return {"vectors": vectors, "audit": audit}
