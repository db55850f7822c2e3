import random
import zlib

from helpers import LONG, awkward, documents, empty

from leakscope.llm import lang_id as li
from leakscope.llm import toxic_grammar as tg


def tongues(n=400, seed=1):
    rnd = random.Random(seed)
    parts = {"en": ["the", "th", "ing", "er", "on", "wh"], "de": ["sch", "ung", "ei", "ü", "ch", "der"], "fr": ["é", "eau", "oi", "le", "que", "ai"]}
    rows = []
    for i in range(n):
        lang = rnd.choice(list(parts))
        rows.append((i, " ".join("".join(rnd.choice(parts[lang]) for _ in range(rnd.randint(1, 4))) for _ in range(rnd.randint(2, 60))), lang, "s"))
    return rows


def test_language_of_held_out_texts(spark):
    rows = tongues()
    docs = documents(spark, rows)
    got = li.identify(docs, li.learn(docs)).collect()
    lang = {i: x for i, _, x, _ in rows}
    held = [r for r in got if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i in lang if zlib.crc32(str(i).encode()) % 4 == 2}
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_ignores_held_out_labels(spark):
    rows = tongues(200)
    wrong = [(i, t, "en" if zlib.crc32(str(i).encode()) % 4 == 2 else x, s) for i, t, x, s in rows]
    one, two = (li.learn(documents(spark, r)) for r in (rows, wrong))
    assert one.temperature == two.temperature and (one.weights == two.weights).all()


def test_language_awkward_rows(spark):
    docs = documents(spark, tongues(100))
    model = li.learn(docs.unionByName(awkward(spark)))
    got = li.identify(awkward(spark), model).collect()
    assert len(got) == 12 and all(r["lang_pred"] == "und" and r["score"] == 0 for r in got if r["doc_id"] in (3, 4, 6))
    assert li.identify(empty(spark), model).count() == 0
    nothing = li.learn(empty(spark))
    assert {r["lang_pred"] for r in li.identify(awkward(spark), nothing).collect()} == {"und"}


def toxic_rows(n=600, seed=2):
    rnd = random.Random(seed)
    plain = [f"{a}{b}" for a in "abcdefghij" for b in ("re", "on", "ti", "ou", "nicht")]
    rows, labels = [], []
    for i in range(n):
        words = [rnd.choice(plain) for _ in range(rnd.randint(20, 80))]
        toxic = int(rnd.random() < 0.3)
        for _ in range(rnd.randint(3, 8) * toxic):
            words.insert(rnd.randrange(len(words)), "grunz" + rnd.choice(plain) if i % 2 else rnd.choice(["idiot", "moron"]))
        rows.append((i, " ".join(words), "en", "s"))
        labels.append((i, 1, toxic))
    return rows, labels


def test_toxic_held_out(spark):
    rows, labels = toxic_rows()
    docs, marks = documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = tg.score_documents(docs, tg.learn(docs, marks)).collect()
    truth = {i: t for i, _, t in labels}
    held = [r for r in got if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0}
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= 0.97 * len(held)
    assert all(r["clauses"] for r in got if r["predicted"])


def test_grammar_flags():
    model = tg.ToxicModel()
    read = lambda t: [c[2:] for c in tg.clauses(t, model.kind)[0]]
    assert read("you are an idiot") == [("insult", 0, 0, 1)]
    assert read("this is not stupid") == [("insult", 1, 0, 0)]
    assert read("not now. stupid") == [("insult", 0, 0, 0)]
    assert read('somebody said that the clown is a moron') == [("insult", 0, 1, 0)]
    assert read("they will kill it") == [("threat", 0, 0, 0)]
    assert read("I will kill you") == read("kill you all") == [("threat", 0, 0, 1)]
    assert read("ich werde dich töten") == [("threat", 0, 0, 1)]
    assert read("he said: you idiot") == [("insult", 0, 1, 1)]
    assert read('she wrote "what a day. you idiot" and left. a moron') == [("insult", 0, 1, 1), ("insult", 0, 0, 0)]
    assert read("stupid worthless idiot") == [("insult", 0, 0, 0)]
    spans = lambda t: [t[c[0]:c[1]] for c in tg.clauses(t, model.kind)[0]]
    assert spans("well, i will kill all of you now") == ["kill all of you"]
    assert spans("so you are not an idiot today") == ["you are not an idiot"]
    score = lambda t: (lambda s: s.score(s.read(t)[1]))(tg._Scorer(model))
    assert score("you idiot") > score("not an idiot") > score("a word")


def test_composed_machine_steps_like_its_parts():
    """All five tables stepped side by side give the outputs and weights of the one machine."""
    rnd = random.Random(5)
    for _ in range(300):
        states, state = [first for _, first in tg.TRANSDUCERS], 0
        for c in rnd.choices(tg.CLASSES, k=60):
            outs, total = (), 0.0
            for i, (rows, _) in enumerate(tg.TRANSDUCERS):
                states[i], out, weight = rows[states[i], c]
                outs, total = outs + out, total + weight
            state, out, weight = tg.machine()[state][c]
            assert out == outs and abs(weight - total) < 1e-12


def brute_marks(classes):
    """(kind, negated, reported, targeted) of each match, by looking around its place."""
    words = [i for i, c in enumerate(classes) if c not in tg.MARKS]
    rank = {i: n for n, i in enumerate(words)}
    out = []

    def free(a, b, ends=("stop", "line")):
        return not any(classes[i] in ends for i in range(a, b))

    def reported(at):
        opened = None  # place of the open quotation, if a verb of speech reaches it
        for i in range(at):
            c = classes[i]
            if opened is not None:
                opened = None if c in ("quote", "line") else opened
                continue
            if c == "quote":
                verbs = [j for j in range(i) if classes[j] == "speech" and j > closed(i) and free(j, i) and sum(k in rank for k in range(j + 1, i)) < 8]
                opened = i if verbs else None
        if opened is not None:
            return 1
        return int(any(classes[j] == "speech" and j > closed(at) and free(j, at) and rank[at] - rank[j] <= 8 for j in range(at)))

    def closed(at):
        """Place of the last end of a reported quotation before `at`: verbs up to it do not count."""
        end, opened = -1, None
        for i in range(at):
            c = classes[i]
            if opened is not None:
                if c in ("quote", "line"):
                    end, opened = i, None
            elif c == "quote" and any(classes[j] == "speech" and j > end and free(j, i) and sum(k in rank for k in range(j + 1, i)) < 8 for j in range(i)):
                opened = i
        return end

    for at in words:
        if classes[at] not in tg.KINDS:
            continue
        negated = int(any(classes[j] == "negation" and free(j, at) and rank[at] - rank[j] <= 3 for j in range(at)))
        out.append((classes[at], negated, reported(at), at))
    return out


def test_left_marks_by_looking_around():
    rnd = random.Random(6)
    for _ in range(400):
        classes = rnd.choices(tg.CLASSES, [8, 2, 2, 2, 2, 1, 1, 1, 1, 1, 1, 2], k=40)
        want = {at: (n, r) for _, n, r, at in brute_marks(classes)}
        state = 0
        for at, c in enumerate(classes):
            state, out, _ = tg.machine()[state][c]
            if c in tg.KINDS:
                assert (int("negated" in out), int("reported" in out)) == want[at], (classes, at)


def test_sample_keeps_one_text_of_an_id(spark):
    rows = [(1, f"text {i}", "en", "s") for i in range(50)]
    marks = spark.createDataFrame([(1, 0, 1)], "doc_id long, quality int, toxic int")
    assert tg._sample(documents(spark, rows), marks, 5, {1: 10, 0: 10}).count() == 1


def test_toxic_awkward_rows(spark):
    marks = spark.createDataFrame([(1, 0, 1), (1, 0, 0), (2, None, None), (None, 1, 1), (77, 1, 1)], "doc_id long, quality int, toxic int")
    model = tg.learn(awkward(spark), marks)
    got = tg.score_documents(awkward(spark), model).collect()
    assert len(got) == 12 and all(0 <= r["score"] <= 1 and r["predicted"] == 0 for r in got)
    assert tg.learn(empty(spark), marks.limit(0)) == tg.ToxicModel()
    assert tg.score_documents(empty(spark), model).count() == 0
    left = tg.drop_toxic(awkward(spark), model)
    assert left.columns == awkward(spark).columns and left.count() == 12
    assert len(LONG) > 100_000
