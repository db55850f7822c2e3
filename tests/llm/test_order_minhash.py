import random
import zlib

import numpy as np
from helpers import awkward, documents, empty

from leakscope.llm import common
from leakscope.llm import order_minhash as om


def brute_sim(a, b, k=5):
    """Aligned k-mers by the full longest-common-subsequence table, labels as tuples."""
    def grams(t):
        w, seen, out = t.lower().split(), {}, []
        for i in range(max(1, len(w) - k + 1)):
            g = tuple(w[i:i + k])
            seen[g] = seen.get(g, 0) + 1
            out.append((g, seen[g]))
        return out
    x, y = grams(a), grams(b)
    row = [0] * (len(y) + 1)
    for p in x:
        new = [0]
        for j, q in enumerate(y):
            new.append(row[j] + 1 if p == q else max(row[j + 1], new[j]))
        row = new
    return row[-1] / (len(x) + len(y) - row[-1])


def corpus(seed=3):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(12):
        base = [rnd.choice(vocabulary) for _ in range(rnd.randint(40, 120))]
        texts.append(" ".join(base))
        for _ in range(rnd.randint(0, 6)):
            copy = list(base)
            for _ in range(rnd.randint(0, 4)):
                copy[rnd.randrange(len(copy))] = rnd.choice(vocabulary)
            texts.append(" ".join(copy))
    shared = " ".join(rnd.choice(vocabulary) for _ in range(60))
    texts += [shared + " " + " ".join(rnd.choice(vocabulary) for _ in range(50)) for _ in range(60)]
    half = [rnd.choice(vocabulary) for _ in range(80)]
    texts += [" ".join(half), " ".join(half[40:] + half[:40])]  # the same words in another order
    return texts


def brute_classes(texts, threshold=0.8):
    parent = list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i
    links = set()
    for i in range(len(texts)):
        for j in range(i):
            if brute_sim(texts[i], texts[j]) >= threshold:
                if texts[i] != texts[j]:
                    links.add((j, i))
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return [find(i) for i in range(len(texts))], links


def test_classes_equal_brute_force(spark):
    texts = corpus()
    want, _ = brute_classes(texts)
    got = om.near_duplicates(documents(spark, [(i, t, "en", "s") for i, t in enumerate(texts)]))["classes"].collect()
    assert {r["doc_id"]: r["class_id"] for r in got} == dict(enumerate(want))
    assert {r["doc_id"] for r in got if r["kept"]} == set(want)


def test_large_bucket_goes_by_rare_kmers(spark, monkeypatch):
    monkeypatch.setattr(om, "OPEN_PAIRS", 0)
    texts = corpus(5)
    want, _ = brute_classes(texts)
    got = om.near_duplicates(documents(spark, [(i, t, "en", "s") for i, t in enumerate(texts)]))["classes"].collect()
    assert {r["doc_id"]: r["class_id"] for r in got} == dict(enumerate(want))


def test_a_member_of_many_buckets_meets_heads_of_one(spark):
    own = {t: [*range(40), *range(1000 * t + 100, 1000 * t + 130)] for t in range(10)}
    members = spark.createDataFrame([(t, 7, unit, 50, unit, 70) for t in own for unit in own[t]],
                                    "t int, key long, unit long, n int, component long, m long")
    pairs = om._more_heads(members, 0.8).count()
    assert 340 < pairs <= om.HEADS * 340


def test_components_run_over_each_link_once(spark, monkeypatch):
    seen, old = [], common.components

    def counted(edges):
        seen.append(edges.count())
        return old(edges)
    monkeypatch.setattr(common, "components", counted)
    monkeypatch.setattr(om, "components", counted)
    monkeypatch.setattr(om, "OPEN_PAIRS", 0)
    texts = corpus(5)
    texts += texts[:1] * 200
    found = om.near_duplicates(documents(spark, [(i, t, "en", "s") for i, t in enumerate(texts)]))
    links = found["links"].count()
    assert found["classes"].count() == len(texts) and 0 < sum(seen) <= links


def test_components_after_more_edges_equal_those_of_all(spark):
    rnd = random.Random(4)
    edges = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(45)]
    frame = lambda rows: spark.createDataFrame(rows, "a long, b long")
    apart = lambda rows: {r["node"]: r["component"] for r in rows.collect()}
    first, more = [e for e in edges[:25] if e[0] != e[1]], [e for e in edges[25:] if e[0] != e[1]]
    got = common.with_edges(common.components(frame(first)), frame(more))
    assert apart(got) == apart(common.components(frame(first + more))) and got.count() == len(apart(got))
    assert apart(common.with_edges(common.components(frame([])), frame(more))) == apart(common.components(frame(more)))
    assert apart(common.with_edges(common.components(frame(first)), frame([]))) == apart(common.components(frame(first)))


def test_texts_that_share_a_doc_id_join_their_classes(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(40)) for x in "abcd")
    rows = [(7, a), (7, b), (3, b), (5, a + " tail"), (9, c), (4, c), (8, d), (8, None), (2, d)]
    got = om.near_duplicates(documents(spark, [(i, t, "en", "s") for i, t in rows]))["classes"].collect()
    assert len(got) == len(rows)
    assert {(r["doc_id"], r["class_id"]) for r in got} == {(7, 3), (3, 3), (5, 3), (9, 4), (4, 4), (8, 2), (2, 2)}
    assert {r["doc_id"] for r in got if r["kept"]} == {3, 4, 2}


def varied(count, seed=9):
    """Texts of 120 words: half of them a common one with two words of their own each, which are
    not near each other; the others with one such word, all near each other."""
    rnd = random.Random(seed)
    base = [f"w{i}" for i in range(120)]
    for i in range(count):
        copy = list(base)
        for at in rnd.sample(range(120), 1 + i % 2):
            copy[at] = f"x{i}y{at}"
        yield " ".join(copy)


def test_rare_kmers_pair_no_texts_that_differ_too_much(spark):
    docs = documents(spark, [(i, t, "en", "s") for i, t in enumerate(varied(40))])
    units = common.stored(om._hashed_docs(docs).mapInArrow(om._sketch_batches(5, 10, 2), "rid long, unit long, n int, keys array<long>")
                          .selectExpr("unit", "rid as rep", "n"), "units")
    rep = {r["unit"]: r["rep"] for r in units.collect()}
    pairs = om._rare_pairs(docs, units.selectExpr("unit", "unit as component", "n"), units, 5, 0.8).collect()
    got = {tuple(sorted((rep[r["a"]], rep[r["b"]]))) for r in pairs}
    codes = [om.labelled_kmers(np.array([zlib.crc32(w.encode()) for w in t.split()])) for t in varied(40)]
    near = {(i, j) for j in range(40) for i in range(j) if om.chain_similarity(codes[i], codes[j]) > 0}
    assert near and near <= got and len(got - near) <= 40


def test_parity_sketches_differ_in_no_more_bits_than_the_sets():
    rnd = np.random.default_rng(2)
    for _ in range(100):
        a, b = (set(rnd.integers(0, 900, 300).tolist()) for _ in range(2))
        x, y = (om.parity(np.array(sorted(s))) for s in (a, b))
        bits = sum(bin(int(v) & (1 << 64) - 1).count("1") for v in x ^ y)
        assert len(x) == om.PARITY and 0 < bits <= len(a ^ b)


def test_chain_is_the_longest_in_order():
    rnd = random.Random(1)
    for _ in range(200):
        a = [f"v{rnd.randrange(30)}" for _ in range(rnd.randint(1, 40))]
        b = list(a)
        for _ in range(rnd.randint(0, 5)):
            b[rnd.randrange(len(b))] = f"v{rnd.randrange(30)}"
        if rnd.random() < 0.3:
            b = b[len(b) // 2:] + b[:len(b) // 2]
        code = lambda t: np.array([int(x[1:]) + 1 for x in t])
        want = brute_sim(" ".join(a), " ".join(b))
        got = om.chain_similarity(om.labelled_kmers(code(a)), om.labelled_kmers(code(b)))
        assert got == (want if want >= 0.8 else 0.0)


def test_awkward_rows(spark):
    got = om.near_duplicates(awkward(spark))["classes"].collect()
    assert len(got) == 12
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    assert [r["class_id"] for r in by[1]] == [1, 1] and by[2][0]["class_id"] == 1 and not by[2][0]["kept"]
    assert all(by[i][0]["kept"] and by[i][0]["class_id"] == i for i in (3, 4, 5, 6, 7))
    assert om.near_duplicates(empty(spark))["classes"].count() == 0


def test_one_row_of_each_class_stays(spark):
    docs = awkward(spark)
    left = om.drop_near_duplicates(docs)
    assert left.columns == docs.columns
    ids = sorted((r["doc_id"] for r in left.collect() if r["doc_id"] is not None))
    assert ids == [1, 3, 4, 5, 6, 7, 8, 9]
    assert om.drop_near_duplicates(empty(spark)).count() == 0


def test_rows_without_id_are_documents_of_their_own(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    docs = documents(spark, [(5, a, "en", "s"), (9, b, "en", "s"), (None, a, "en", "s"), (None, b, "en", "s"),
                             (None, c, "en", "s"), (None, c, "en", "s"), (None, c + " tail", "en", "s"), (None, None, "en", "s"), (None, "", "en", "s")])
    got = om.near_duplicates(docs)["classes"].collect()
    assert {(r["doc_id"], r["class_id"], r["kept"]) for r in got if r["doc_id"]} == {(5, 5, True), (9, 9, True)}
    assert sorted(r["class_id"] for r in got if r["doc_id"] is None and r["class_id"]) == [5, 9] and len(got) == 9
    left = om.drop_near_duplicates(docs)
    texts = [(r["doc_id"], r["text"]) for r in left.collect()]
    assert left.columns == docs.columns and len(texts) == 5 and {(5, a), (9, b), (None, None), (None, "")} < set(texts)
    assert len([t for _, t in texts if t and t.startswith("c0")]) == 1
