import random
import zlib

from helpers import awkward, documents, empty

from leakscope.llm import kd_shards as kd
from leakscope.llm import mix as mx
from leakscope.llm.common import numbered


def brute_targets(sizes, share=1.5, most=2):
    """Deal by weight, cut what exceeds, deal the rest again, until nothing exceeds."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, goal = share * sum(sizes.values()), {}
    open_ = set(order)
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level > most * sizes[s]}
        if not full:
            return goal | {s: weight[s] * level for s in open_}
        for s in full:
            goal[s] = most * sizes[s]
            left -= goal[s]
        open_ -= full
    return goal


def test_targets_and_taken(spark):
    rnd = random.Random(2)
    rows = [(i, " ".join(["w"] * rnd.randint(0, 60)), "en", rnd.choice(["a", "b", "B", "é", None, "hot", "hot", "hot"])) for i in range(800)]
    got = mx.mixed(documents(spark, rows)).collect()
    sizes = {}
    for _, t, _, s in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    want, taken, most = brute_targets(sizes), {}, {}
    for r in got:
        assert abs(r["target"] - want[r["source"]]) < 1e-6 and r["source_size"] == sizes[r["source"]]
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        most[r["source"]] = max(most.get(r["source"], 0), r["size"])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= most[s] / 2 + 1e-6


def test_cuts_equal_a_sorted_walk(spark, monkeypatch):
    monkeypatch.setattr(mx, "DIGITS", 1)  # many refinements
    rows = [(i, "x y z", "en", "ab"[i % 2]) for i in range(500)]
    first = {r["doc_id"]: r["taken"] for r in mx.mixed(documents(spark, rows)).collect()}
    monkeypatch.setattr(mx, "DIGITS", 3)
    again = {r["doc_id"]: r["taken"] for r in mx.mixed(documents(spark, rows)).collect()}
    assert first == again and sum(first.values()) > 0


def test_mix_awkward_rows(spark):
    docs = awkward(spark)
    got = mx.mixed(docs).collect()
    assert len(got) == 12 and all(r["taken"] <= 2 * r["size"] for r in got)
    assert mx.mix(docs).columns == docs.columns
    assert mx.mixed(empty(spark)).count() == 0 and mx.mix(empty(spark)).count() == 0


def test_sources_reach_targets_without_ids(spark):
    """A third of the rows without id, a third equal rows of one id: off by one document at most."""
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, "ten words " * 5 if i % 3 == 1 else f"t{i} " * 10, "en", "ab"[i % 5 == 0])
            for i in range(3000)]
    docs = documents(spark, rows)
    got = mx.mixed(docs).collect()
    goal, taken = {}, {}
    for r in got:
        goal[r["source"]] = r["target"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    assert all(abs(taken[s] - goal[s]) <= 10 for s in goal) and len(got) == 3000
    count = lambda ids: sorted(ids, key=lambda d: (d is None, d))
    assert count(r["doc_id"] for r in mx.mix(docs).collect()) == count(r["doc_id"] for r in got for _ in range(r["passes"]))


def test_numbers_of_a_hot_key(spark):
    rows = spark.range(5000).selectExpr("if(id % 3 = 0, id, -1) AS k")
    found = {}
    for r in numbered(rows, ["k"], 100).collect():
        found.setdefault(r["k"], []).append(r["number"])
    assert all(sorted(v) == list(range(len(v))) for v in found.values()) and sum(map(len, found.values())) == 5000


def test_mix_repeats_rows_as_planned(spark):
    rows = [(i, "a b c d", "en", "a" if i % 5 else "b") for i in range(100)]
    docs = documents(spark, rows)
    plan = {r["doc_id"]: r["passes"] for r in mx.mixed(docs).collect()}
    seen = {}
    for r in mx.mix(docs).collect():
        seen[r["doc_id"]] = seen.get(r["doc_id"], 0) + 1
    assert seen == {d: p for d, p in plan.items() if p}


def test_shards_are_near_equal_and_slots_gapless(spark):
    rnd = random.Random(4)
    rows = [(i, " ".join(rnd.choice(["ä", "bb", "ccc"]) + str(i) for _ in range(rnd.randint(1, 80))), rnd.choice(["en", None]), rnd.choice("xxxyz")) for i in range(3000)]
    rows += [(10_000 + i, "copy of a text that is everywhere " * 6, "en", rnd.choice("xyz")) for i in range(1500)]
    rows += [(20_000 + i, f"pair {i // 3} of copies", "en", rnd.choice("xyz")) for i in range(90)]
    got = kd.shard(documents(spark, rows), 40).collect()
    text = {i: t for i, t, *_ in rows}
    shards, homes = {}, {}
    for r in got:
        data = text[r["doc_id"]].encode()
        assert r["size"] == len(data) + 16 and r["text_crc32"] == zlib.crc32(data) and r["law"] == "bytes" and r["grown_shard"] is None
        shards.setdefault(r["shard"], []).append((r["slot"], r["size"]))
        homes.setdefault(text[r["doc_id"]], set()).add(r["shard"])
    assert sorted(shards) == list(range(40)) and len(got) == len(rows)
    assert all(sorted(s for s, _ in v) == list(range(len(v))) for v in shards.values())
    sizes = [sum(b for _, b in v) for v in shards.values()]
    assert max(sizes) < 1.1 * sum(sizes) / 40 and min(sizes) > 0.9 * sum(sizes) / 40
    assert all(len(h) == 1 for t, h in homes.items() if t.startswith("pair"))
    again = kd.shard(documents(spark, rows), 40).collect()
    key = lambda r: (r["doc_id"], r["shard"], r["slot"])
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_shards_of_equal_rows(spark):
    """Half of the rows equal in id and text, or without id: the shards stay near equal."""
    rows = [(i, f"text number {i} of many", "en", "x") for i in range(3000)]
    for same in (None, 5):
        got = kd.shard(documents(spark, rows + [(same, "a row that is everywhere", "en", "x")] * 3000), 40).collect()
        sums, slots = {}, {}
        for r in got:
            sums[r["shard"]] = sums.get(r["shard"], 0) + r["size"]
            slots.setdefault(r["shard"], []).append(r["slot"])
        mean = sum(sums.values()) / 40
        assert len(got) == 6000 and len(sums) == 40 and max(sums.values()) < 1.1 * mean and min(sums.values()) > 0.9 * mean
        assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_shards_awkward_rows(spark):
    got = kd.shard(awkward(spark), 4).collect()
    assert len(got) == 12 and {r["size"] for r in got if r["doc_id"] == 3} == {16}
    assert all(0 <= r["shard"] < 4 for r in got)
    assert kd.shard(empty(spark), 4).count() == 0
