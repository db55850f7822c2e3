import hashlib
import math
import random
import re
from itertools import permutations

import numpy as np
import public_tokenizers
import sentencepiece
from helpers import awkward, documents, empty

from leakscope.llm import filter_audit as fa
from leakscope.llm import piece_codec as pc
from leakscope.llm import simplex_clusters as sc

MODEL = public_tokenizers.path("piece_bpe_32k.model")
VECTORS = "vec_id long, embedding array<double>, label int, cluster string, v string, distances string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, "clash", "clash", "clash") for i, v in rows], VECTORS)


def brute_clusters(rows, clusters=16, rounds=3):
    kept = [(i, [max(-2**63, min(2**63 - 1, math.floor(64 * x) if abs(x) < 1e300 else int(math.copysign(2**63, x)))) for x in v]) for i, v in rows
            if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    name = lambda i: (i is None, hashlib.sha256(f"1:{i}".encode()).hexdigest())
    c = [v for _, v in sorted(kept, key=lambda r: (name(r[0]), r[1]))[:clusters]]
    far = lambda v, m: sum((x - y) ** 2 for x, y in zip(v, m))
    near = lambda v: min(range(len(c)), key=lambda k: (far(v, c[k]), k))
    for _ in range(rounds):
        mine = [[v for _, v in kept if near(v) == k] for k in range(len(c))]
        c = [[sum(x) // len(x) for x in zip(*m)] if m else c[k] for k, m in enumerate(mine)]
    told = [(i, near(v), min(far(v, c[near(v)]), 2**63 - 1)) for i, v in kept]
    total = {k: min(sum(d for _, q, d in told if q == k), 2**63 - 1) for k in range(len(c))}
    every = min(sum(d for *_, d in told), 2**63 - 1)
    return [(i, k, d, total[k], every, hashlib.sha256(",".join(map(str, c[k])).encode()).hexdigest()) for i, k, d in told]


def same(got, want):
    key = lambda r: tuple((x is None, x) for x in r)
    return sorted(map(tuple, got), key=key) == sorted(want, key=key)


def some_vectors(n, seed=1):
    rnd = random.Random(seed)
    middles = [[rnd.uniform(-1, 1) for _ in range(64)] for _ in range(5)]
    rows = [(i, [x + rnd.gauss(0, 0.1) for x in rnd.choice(middles)]) for i in range(n)]
    return rows + [(n + i, middles[0]) for i in range(n // 3)]


def test_clusters_equal_brute_force(spark):
    rows = some_vectors(300) + [(None, [0.5] * 64), (None, [0.5] * 64), (7, [0.25] * 64), (900, None), (901, [0.1] * 63),
                                (902, [0.1] * 63 + [None]), (903, [math.nan] * 64), (904, [math.inf] * 64), (905, []), (906, [0.0] * 64)]
    assert same(sc.cluster_vectors(vectors(spark, rows)).collect(), brute_clusters(rows))


def test_clusters_of_huge_and_few_vectors(spark):
    rows = some_vectors(20) + [(50, [1e9] * 64), (51, [-1e9] * 64), (52, [1e308] * 64), (53, [1e25] * 63 + [-1e25])]
    assert same(sc.cluster_vectors(vectors(spark, rows)).collect(), brute_clusters(rows))
    few = some_vectors(3)
    assert same(sc.cluster_vectors(vectors(spark, few)).collect(), brute_clusters(few))
    equal = [(i, [0.3] * 64) for i in range(40)]
    assert same(sc.cluster_vectors(vectors(spark, equal)).collect(), brute_clusters(equal))
    assert sc.cluster_vectors(vectors(spark, [])).collect() == []


def test_apex_bounds_hold_and_filter():
    rnd = np.random.default_rng(3)
    middles = rnd.integers(-80, 80, (16, 64))
    v = middles[rnd.integers(0, 16, 500)] + rnd.integers(-5, 6, (500, 64))
    simplex = sc.Simplex(middles)
    d = simplex.distances(v)
    low, high = sc.bounds(simplex.apexes(d), simplex.apexes(simplex.distances(middles)))
    true = ((v[:, None] - middles[None]) ** 2).sum(2)
    assert (low <= true + 1e-6 * true.max()).all() and (high >= true - 1e-6 * true.max()).all()
    cluster, best, compared = sc.nearest(v, d, middles, simplex)
    assert (cluster == true.argmin(1)).all() and best == true.min(1).tolist() and compared < 16 * 500


ODD = ["", None, " ", "  a", "▁a ▁▁ b", "日本語 x \x00\n\t <s> </s> <0x41> <unk> ", "a" * 3000, "ab" * 400 + " c", "é é ﬁ 😀 a😀😀b", "▁", "▁▁ ", "x\r\n y"]


def test_pieces_equal_the_library(spark):
    rnd = random.Random(5)
    texts = ODD + ["".join(rnd.choice("abcdeèé ▁\n.日😀") for _ in range(rnd.randint(1, 200))) for _ in range(300)]
    got = {r["doc_id"]: r for r in pc.encode_documents(documents(spark, [(i, t, "en", "a") for i, t in enumerate(texts)]), MODEL).collect()}
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for i, t in enumerate(texts):
        ids = library.encode(t or "")
        assert got[i]["ids"] == ids and got[i]["decoded"] == library.decode(ids) and got[i]["agrees"]


def test_both_agendas_merge_alike_and_disagreement_shows(monkeypatch):
    with open(MODEL, "rb") as file:
        codec = pc.Codec(file.read())
    rnd = random.Random(6)
    parts = ["▁" + "".join(rnd.choice("theaino,.") for _ in range(rnd.randint(1, 40))) for _ in range(500)]
    short = [codec.merge(p) for p in parts]
    monkeypatch.setattr(pc, "SHORT", 0)
    assert [codec.merge(p) for p in parts] == short
    assert codec.encode(["the cat"])[1] == [True]
    mixed = ["▁" + "".join(rnd.choice("then,.\n日#😀") for _ in range(rnd.randint(1, 12))) for _ in range(500)]
    assert [codec._worked_out(p) for p in mixed] == [codec.merge(p) for p in mixed] and not all("," not in p for p in mixed)
    monkeypatch.setattr(pc, "REMEMBERED", 0)
    assert codec.encode(["a cat"])[0] == codec.encode(["a cat"])[0] and "▁cat" in codec
    codec.clear()
    codec.old = {}
    codec.rank.pop("▁the")
    assert codec.encode(["the cat", "a cat"])[1] == [False, True]


def test_pieces_of_awkward_rows(spark):
    got = pc.encode_documents(awkward(spark), MODEL).collect()
    assert len(got) == 12 and all(r["agrees"] for r in got)
    assert [r["ids"] for r in got if r["doc_id"] in (3, 4)] == [[], []]
    assert pc.encode_documents(empty(spark), MODEL).count() == 0


def brute_audit(rows, labels):
    first, parts = {}, {}
    for i, t, _, s in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    for i, t, _, s in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        failed = {"A"} if len(words) < 200 else set()
        failed |= {"B"} if 100 * len(set(words)) < 50 * len(words) else set()
        failed |= {"C"} if 100 * len(re.findall("[A-Z]", t)) > 2 * len(t) else set()
        failed |= {"D"} if re.search(r"[#$%&*|]", t) else set()
        failed |= {"E"} if t in first and (i is None or first[t] < i) else set()
        marks = [(q, x) for j, q, x in labels if j == i and i is not None]
        parts.setdefault(s or "", []).append((failed, any(q == 1 for q, _ in marks), any(x == 1 for _, x in marks)))
    out, shapley = [], {}
    for part, docs in parts.items():
        for order in permutations("ABCDE"):
            left = list(docs)
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[0]]
                fails = sum(f in d[0] for d in docs)
                left = [d for d in left if f not in d[0]]
                shapley[part, f] = shapley.get((part, f), 0) + len(gone)
                out.append((part, "".join(order), step, len(left), len(gone), fails - len(gone), sum(d[0] == {f} for d in docs),
                            sum(d[1] for d in gone), sum(d[2] for d in gone)))
    return [(*r, shapley[r[0], r[1][r[2] - 1]]) for r in out]


def test_audit_equals_every_order_walked(spark):
    rnd = random.Random(8)
    body = " ".join(f"w{i}" for i in range(250))
    texts = [body, body.upper(), body + " #", "a b " * 200, "short", "Short & Sweet", "", None, "same words here"]
    rows = [(rnd.choice([*range(60), None]), rnd.choice(texts), "en", rnd.choice(["a", "a", "a", "b", None, ""])) for _ in range(300)]
    labels = [(i, rnd.choice([0, 1, None]), rnd.choice([0, 1, None])) for i in range(0, 60, 2)] + [(4, 1, 1), (None, 1, 1)]
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = fa.audit_filters(documents(spark, rows), marks).collect()
    assert sorted(map(tuple, got)) == sorted(brute_audit(rows, labels))


def test_audit_of_awkward_rows(spark):
    marks = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = fa.audit_filters(awkward(spark), marks).collect()
    assert len(got) == 4 * 600 and all(r["good_lost"] == 0 for r in got)
    assert fa.audit_filters(empty(spark), marks).count() == 0
