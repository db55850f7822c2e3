import numpy as np

from leakscope.llm import vector_graph as vg


def brute(ids, vectors, cosine=0.95):
    x = np.array(vectors, dtype=np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= cosine
    np.fill_diagonal(near, False)
    label = np.array(ids)
    while True:
        new = np.array([min([label[i], *label[near[i]]]) for i in range(len(ids))])
        if (new == label).all():
            return dict(zip(ids, zip(near.sum(1).tolist(), label.tolist())))
        label = new


def vectors(n=900, dim=32, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    groups = [x[i] + rng.normal(size=(int(m), dim)) * s for i, (m, s) in enumerate(zip(rng.integers(2, 40, 20), rng.uniform(0.02, 0.25, 20)))]
    return np.vstack([x, *groups, np.repeat(x[50:51], 30, axis=0), 3 * x[60:62]]).astype(np.float32)


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 AS shard", "2 AS point", "3 AS near")


def test_links_equal_brute_force_over_several_shards(spark):
    x = vectors()
    out = vg.link_vectors(frame(spark, [(i, v.tolist(), i % 3) for i, v in enumerate(x)]), shard=200)
    want = brute(list(range(len(x))), x)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in out["vectors"].collect()}
    links = sum(n for n, _ in want.values())
    assert all(got[i][0] <= want[i][0] for i in want)  # none below the threshold
    assert sum(n for n, _ in got.values()) >= 0.97 * links
    assert np.mean([got[i][1] == want[i][1] for i in want]) >= 0.97
    audit = out["audit"].first()
    assert audit["found"] >= 0.97 * audit["there"] > 0


def test_one_dense_group_is_found_whole(spark):
    rng = np.random.default_rng(5)
    x = np.vstack([rng.normal(size=16) + 0.03 * rng.normal(size=(400, 16)), rng.normal(size=(200, 16))])
    got = vg.link_vectors(frame(spark, [(i, v.tolist(), 0) for i, v in enumerate(x)]), shard=150)["vectors"].collect()
    want = brute(list(range(len(x))), x.astype(np.float32))
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got} == want


def test_awkward_vectors(spark):
    good = [1.0, 2.0, 3.0]
    rows = [(1, good, 0), (1, good, 0), (2, [2.0, 4.0, 6.0], None), (3, None, 1), (4, [0.0, 0.0, 0.0], 1), (5, [1.0, None, 2.0], 1),
            (6, [float("nan"), 1.0, 1.0], 1), (7, [float("inf"), 1.0, 1.0], 1), (8, [], 1), (9, [1.0, 2.0], 1), (None, good, 1), (10, [-1.0, 0.5, 0.0], 1)]
    got = vg.link_vectors(frame(spark, rows))["vectors"].collect()
    assert len(got) == 12
    by = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in got}
    assert by[1] == (3, 1, True) and by[2] == (3, 1, False) and by[None] == (3, 1, False)
    assert all(by[i] == (0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 10))
    assert vg.link_vectors(frame(spark, rows).limit(0))["vectors"].count() == 0
    assert vg.link_vectors(frame(spark, rows[3:7]))["vectors"].count() == 4


def links_of(spark, x, shard=150):
    out = vg.link_vectors(frame(spark, [(i, v.tolist(), 0) for i, v in enumerate(x)]), shard=shard)
    return out, {r["vec_id"]: (r["n_links"], r["component_id"]) for r in out["vectors"].collect()}


def small_blocks(monkeypatch):
    monkeypatch.setattr(vg, "BLOCK_VALUES", 1)
    monkeypatch.setattr(vg, "LEAST_BLOCK", 60)


def test_links_across_shard_borders_are_all_found(spark, monkeypatch):
    small_blocks(monkeypatch)
    rng = np.random.default_rng(11)
    x = rng.normal(size=(700, 3)).astype(np.float32)  # no clusters: every border cuts through links
    out, got = links_of(spark, x, 40)
    want = brute(list(range(len(x))), x)
    assert got == want
    audit = out["audit"].first()
    assert audit["found"] == audit["there"] > 0


def test_a_dense_group_is_split_and_dealt_once(spark, monkeypatch):
    small_blocks(monkeypatch)
    rng = np.random.default_rng(12)
    tight = rng.normal(size=16) + 0.02 * rng.normal(size=(500, 16))
    loose = rng.normal(size=16) + 0.17 * rng.normal(size=(400, 16))
    x = np.vstack([tight, loose, rng.normal(size=(300, 16))]).astype(np.float32)
    compare = vg._compare
    accumulated = spark.sparkContext.accumulator(0)

    def counted(cosine):
        run = compare(cosine)

        def one(part):
            assert len(part) <= 2 * 60 * 2  # salted: about the bound, never the group
            accumulated.add(len(part))
            return run(part)
        return one
    monkeypatch.setattr(vg, "_compare", counted)
    _, got = links_of(spark, x, 50)
    assert got == brute(list(range(len(x))), x)
    assert accumulated.value < 24 * len(x)  # 24 centres; the tight group meets no copy of itself


def test_each_length_links_among_itself(spark):
    rng = np.random.default_rng(13)
    wide, thin = rng.normal(size=(120, 8)), rng.normal(size=(60, 3))
    x = [*wide, *thin, *thin[:10], *(2 * thin[10:20]), wide[0]]
    _, got = links_of(spark, [v.astype(np.float32) for v in x], 20)
    ids = {8: [i for i, v in enumerate(x) if len(v) == 8], 3: [i for i, v in enumerate(x) if len(v) == 3]}
    want = {}
    for some in ids.values():
        want |= brute(some, [x[i].astype(np.float32) for i in some])
    assert got == want and sum(n for i, (n, _) in want.items() if len(x[i]) == 3) > 0
