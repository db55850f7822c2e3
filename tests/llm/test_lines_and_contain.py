import random
import re

from helpers import awkward, documents, empty

from leakscope.llm import contain as ct
from leakscope.llm import line_dedup as ld

ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_lines(rows):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(ASCII)
    first, docs = {}, {}
    for i, t in rows:
        for x in (t or "").split("\n"):
            k = key(x)
            if len(k) >= 10:
                docs.setdefault(k, set()).add(i)
                first[k] = min(first.get(k, i), i)
    out = {}
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(docs.get(key(x), ())) < 2 or first[key(x)] == i]
        out[i] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def test_lines_equal_brute_force(spark):
    rnd = random.Random(6)
    pool = ["short", "a line of some words", "A Line of some words ", "\tÉTÉ is not été here", "été is not été here", "Été IS not été here",
            "", "x" * 10, "x" * 9, " a line of some words", "the very common line of all"]
    rows = [(i, "\n".join(rnd.choice([*pool, f"own line number {i}"]) for _ in range(rnd.randint(1, 12))) + rnd.choice(["", "\n"])) for i in range(200)]
    rows += [(900, None), (901, ""), (902, "the very common line of all"), (903, "\n".join(["the very common line of all"] * 5000))]
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["text"]) for r in ld.drop_shared_lines(documents(spark, [(i, t, "en", "s") for i, t in rows])).collect()}
    assert got == brute_lines(rows)


def test_lines_awkward_rows(spark):
    got = ld.drop_shared_lines(awkward(spark)).collect()
    assert len(got) == 12
    by = {r["doc_id"]: r for r in got}
    assert by[3]["n_lines"] == 1 and by[3]["text"] == "" and by[9]["text"] == "other" and by[8]["n_dropped"] == 0
    assert by[2]["text"] == "" and by[1]["n_dropped"] == 0
    assert ld.drop_shared_lines(empty(spark)).count() == 0


def test_more_documents_than_two(spark):
    rows = [(i, "three of us hold this line", "en", "s") for i in range(3)] + [(i, "two of us hold this line", "en", "s") for i in (5, 6)]
    got = {r["doc_id"]: r["n_dropped"] for r in ld.drop_shared_lines(documents(spark, rows), least_docs=3).collect()}
    assert got == {0: 0, 1: 1, 2: 1, 5: 0, 6: 0}


def brute_contained(docs, items, share=0.8):
    def grams(t, k):
        w = re.findall(r"\w+", (t or "").lower())
        return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)}
    out = {}
    for item, t in items:
        k = min(5, len(re.findall(r"\w+", (t or "").lower())))
        want = grams(t, k) if k else set()
        for i, d in docs:
            if want and len(want & grams(d, k)) >= share * len(want) - 1e-9:
                out[i, item] = (len(want), len(want & grams(d, k)))
    return out


def test_contained_equals_brute_force(spark):
    rnd = random.Random(8)
    word = lambda: f"t{rnd.randrange(3000)}"
    items = [(n, " ".join(word() for _ in range(rnd.choice([6, 12, 30, 70])))) for n in range(25)] + [(50, "just three words"), (51, None), (52, "...")]
    docs = []
    for i in range(120):
        w = [word() for _ in range(rnd.choice([3, 40, 400, 5000]))]
        for _ in range(rnd.randint(0, 2)):
            cut = rnd.choice(items[:26])[1].split()
            for _ in range(rnd.randint(0, 3)):
                cut[rnd.randrange(len(cut))] = word()
            at = rnd.randrange(len(w) + 1)
            w[at:at] = [x.upper() + rnd.choice(["", ",", "###"]) for x in cut]
        docs.append((i, " ".join(w)))
    got = ct.contaminated(documents(spark, [(i, t, "en", "s") for i, t in docs]), spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS k", "2 AS hash"))
    assert {(r["doc_id"], r["item_id"]): (r["n_item"], r["n_found"]) for r in got.collect()} == brute_contained(docs, items)


def test_contained_awkward_rows(spark):
    items = spark.createDataFrame([(1, "one two three four five six"), (2, None), (None, "one two three four five six"), (3, "")], "item_id long, text string")
    got = ct.contaminated(awkward(spark), items)
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == {(1, 1), (2, 1)} and got.count() == 2
    assert ct.contaminated(empty(spark), items).count() == 0 and ct.contaminated(awkward(spark), items.limit(0)).count() == 0
    left = ct.drop_contaminated(awkward(spark), items)
    assert left.columns == awkward(spark).columns and left.count() == 9


def test_rows_without_id_are_filtered(spark):
    items = spark.createDataFrame([(1, "one two three four five six"), (None, "red green blue black white grey")], "item_id long, text string")
    docs = documents(spark, [(1, "say one two three four five six", "en", "s"), (2, "a red green blue black white grey b", "en", "s"), (3, "fine", "en", "s"),
                             (None, "one two three four five six", "en", "s"), (None, "red green blue black white grey", "en", "s"), (None, "fine too", "en", "s"), (None, None, "en", "s")])
    left = ct.drop_contaminated_rows(docs, items)
    assert left.columns == docs.columns
    assert sorted(((r["doc_id"] or 0, r["text"] or "") for r in left.collect())) == [(0, ""), (0, "fine too"), (3, "fine")]
