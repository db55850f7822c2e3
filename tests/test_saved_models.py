"""Saved models come back the same; SQL functions say what the DataFrame scan says."""

from pyspark.sql import functions as F

from leakscope.functions import scan, sqlfunctions
from leakscope.operators import classify as cl
from leakscope.operators import intent_model, tokenizer
from leakscope.sources import capture, labelled


def test_intent_model_is_saved_and_loaded(spark, tmp_path):
    rows = spark.createDataFrame([(f"/v1/messages/{i}", f"words of {i % 3}", "chat" if i % 3 else "auth") for i in range(30)],
                                 "path string, body string, intent string")
    made = intent_model.fit(intent_model.with_features(rows, "path", "body"))
    intent_model.save(made, spark, f"{tmp_path}/m")
    assert intent_model.load(spark, f"{tmp_path}/m") == made


def test_tokenizer_is_saved_and_loaded(spark, tmp_path):
    texts = spark.createDataFrame([("low lower lowest newer newest wider",)] * 5, "text string")
    made = tokenizer.train(tokenizer.word_frequency(texts), vocab_size=40)
    made.save(spark, f"{tmp_path}/t")
    back = tokenizer.Tokenizer.load(spark, f"{tmp_path}/t")
    assert back == made
    a, b = (tokenizer.encode(texts, t).select(F.to_json("tokens")).collect() for t in (made, back))
    assert a == b


def test_spelling_merges_runs_from_the_left():
    rank = {("a", "a"): 0, ("aa", "a"): 1}
    assert tokenizer._spell("aaaaa", rank) == ["aa", "aaa", "</w>"]
    assert tokenizer._spell("aaaaa", {("a", "a"): 0}) == ["aa", "aa", "a", "</w>"]


def test_metrics_and_records_are_written(spark, tmp_path):
    labelled.write_metrics(spark.createDataFrame([(0.5, 3)], "f1 double, n int"), f"{tmp_path}/metrics")
    assert spark.read.json(f"{tmp_path}/metrics").first()["n"] == 3
    rows = spark.createDataFrame([("/v1/messages", 7)], "path string, event_id long")
    capture.write_records(rows, f"{tmp_path}/records")
    back = capture.good_records(capture.read_captures(spark, f"{tmp_path}/records"))
    assert back.select("path", "event_id").first() == rows.first()


def test_sql_functions(spark):
    sqlfunctions.register(spark)
    df = spark.createDataFrame([("mail jane.roe@mail.example.com and ssn 123-45-6789",), ("nothing here",), (None,)], "text string")
    df.createOrReplaceTempView("texts_of_sql")
    got = spark.sql("SELECT leak_score(text) AS s, leak_label(text) AS l, leak_hits(text) AS h FROM texts_of_sql").collect()
    want = cl.scan_texts(df).select(F.col("re_score").alias("s"), scan.public_hits("re_hits").alias("h")).collect()
    assert [(r["s"], r["h"]) for r in got] == [(r["s"], r["h"]) for r in want]
    assert [r["l"] for r in got][1:] == ["clean", "clean"] and got[0]["l"] != "clean"


def recount(words):
    counts = {}
    for parts, n in words:
        for pair in zip(parts, parts[1:]):
            counts[pair] = counts.get(pair, 0) + n
    return counts


def assert_greedy(learned, frequency):
    """Every merge took a pair that no other exceeded, by a plain count of all words; nothing is left that occurs often enough."""
    words = [([*word, "</w>"], n) for word, n in frequency]
    for a, b in learned.merges:
        counts = recount(words)
        assert counts[a, b] == max(counts.values())
        words = [(tokenizer.merged(parts, a, b), n) for parts, n in words]
    return recount(words)


def test_merges_equal_a_plain_recount(spark, monkeypatch):
    texts = spark.createDataFrame([("banana bandana aaaaa aaaa a.b a.b $x$x (c)(c) Éé éé",), ("banana aaaaa ana an 日本 日本語 日本",)], "text string")
    frequency = tokenizer.word_frequency(texts)
    learned = tokenizer.train(frequency)
    left = assert_greedy(learned, [tuple(r) for r in frequency.collect()])
    assert len(learned.merges) > 8 and max(left.values(), default=0) < 2
    monkeypatch.setattr(tokenizer, "WORDS_PER_TASK", 6)   # three tasks
    assert tokenizer.train(frequency, max_merges=6).merges == learned.merges[:6]
    none = tokenizer.train(frequency.limit(0))
    assert none.merges == [] and none.vocab == tokenizer.RESERVED


def test_the_query_trains_a_full_vocabulary(spark, tiny):
    from leakscope.plans.models import trained_tokenizer
    learned = trained_tokenizer(spark, tiny)
    frequency = [tuple(r) for r in tokenizer.word_frequency(spark.read.parquet(f"{tiny}/documents.parquet")).collect()]
    left = assert_greedy(tokenizer.Tokenizer(learned.vocab, learned.merges[:120]), frequency)
    assert left and (len(learned.vocab) == 4000 or len(learned.merges) > 120)


def feature_rows(spark, n=1500, seed=3):
    """Tokens whose label hangs on one bucket and one shape, with some noise."""
    import random
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        bucket, digit = rnd.randrange(40), rnd.random() < 0.3
        label = float(rnd.random() < (0.9 if bucket < 8 or digit and bucket < 20 else 0.05))
        rows.append((i // 10, "train" if i < n * 0.7 else "validation", label, [float(digit)] + [0.0] * 8, [bucket, 100 + rnd.randrange(50), 500]))
    return spark.createDataFrame(rows, "doc_id long, split string, label double, shape array<double>, buckets array<int>")


def test_fitted_path_is_the_optimum_of_each_strength(spark):
    import numpy as np

    from leakscope.operators import token_model as tm
    rows = feature_rows(spark).repartition(3)
    strengths = (1e-3, 1e-1)
    weights = tm.fit_path(rows, strengths, max_iter=60)
    x = np.zeros((1500, weights.shape[0]))
    y = np.zeros(1500)
    for k, r in enumerate(rows.collect()):
        x[k, :9], x[k, -1], y[k] = r["shape"], 1, r["label"]
        for b in r["buckets"]:
            x[k, 9 + b] += 1
    for j, reg in enumerate(strengths):
        p = 1 / (1 + np.exp(-x @ weights[:, j]))
        slope = x.T @ (p - y) / len(y) + reg * np.r_[weights[:-1, j], 0]
        assert np.abs(slope).max() < 1e-4   # convex: no slope, no better weights
    assert (tm.fit_path(rows.limit(0), strengths) == 0).all()


def test_chosen_model_is_the_best_of_its_written_predictions(spark):
    import duckdb

    from leakscope.operators import token_model as tm
    rows = feature_rows(spark, 3000)
    documents = rows.groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    grid = (1e-4, 1e-1, 10.0)
    weights, table, predicted = tm.select_model(rows.where("split = 'train'"), rows.where("split = 'validation'"), documents, grid)
    told = predicted.toPandas()
    want = duckdb.sql("""SELECT reg, 2.0 * sum(prediction * label) / greatest(sum(prediction) + sum(label), 1) AS f1 FROM told GROUP BY reg""").fetchall()
    got = {r["reg"]: r["f1"] for r in table.collect()}
    assert len(want) == 3 and all(abs(got[reg] - f1) < 1e-9 for reg, f1 in want)
    best = max(got.values())
    again = tm.fit_path(rows.where("split = 'train'"), (next(r for r in grid if got[r] == best),))
    assert abs(again - weights).max() < 1e-6


def test_merges_do_not_depend_on_how_many_pairs_and_runs_a_phase_takes(spark, monkeypatch):
    texts = spark.createDataFrame([("banana bandana aaaaa aaaa a.b a.b newer newest lower lowest",), ("banana aaaaa ana an 日本 日本語 日本",)], "text string")
    frequency = tokenizer.word_frequency(texts).coalesce(1).cache()
    whole = tokenizer.train(frequency, max_merges=7)
    for pairs, runs in ((4, 100), (64, 4)):
        monkeypatch.setattr(tokenizer, "OPEN_PAIRS", pairs)
        monkeypatch.setattr(tokenizer, "WORDS_PER_TASK", runs)
        assert tokenizer.train(frequency, max_merges=7) == whole


def test_words_and_tokens_are_made_some_rows_at_a_time(spark, monkeypatch):
    import re

    import pyarrow as pa
    texts = ["Ab  cd\tef", None, "", " İx yz ", "日本 语", "one two three"] * 3
    monkeypatch.setattr(tokenizer, "SLICE", 8)
    batch = pa.record_batch([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    made = list(tokenizer._with_lists("text", tokenizer._word_ranges)([batch]))
    assert len(made) > 3 and sum(b.num_rows for b in made) == len(texts)
    want = [[{"start": m.start(), "end": m.end(), "word": m.group()} for m in re.finditer(r"\S+", (t or "").lower())] for t in texts]
    assert [x for b in made for x in b.column("_made").to_pylist()] == want
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    learned = tokenizer.train(tokenizer.word_frequency(rows), vocab_size=30)
    for r in tokenizer.encode(rows, learned).collect():
        low = (r["text"] or "").lower()
        rank = {pair: i for i, pair in enumerate(learned.merges)}
        spelled = [s for w in re.findall(r"\S+", low) for s in tokenizer._spell(w, rank)]
        assert [t["surface"] for t in r["tokens"]] == spelled and [t["pos"] for t in r["tokens"]] == list(range(len(spelled)))
        assert all(low[t["start"]:t["end"]] == t["surface"].removesuffix("</w>") and t["id"] == learned.vocab[t["surface"]] for t in r["tokens"])


def test_offsets_of_texts_without_words_are_those_of_the_sql(spark, tmp_path):
    import duckdb

    from leakscope.plans import load
    queries, sql = load()
    texts = ["Ab  cd\tef", None, "", "   ", " \n ", " one", "日本 语 "]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries["token_offsets"](spark, str(tmp_path))
    assert [c for _, c in got.dtypes] == ["bigint"] * 4
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(sql["token_offsets"]).fetchall()
    assert {tuple(r) for r in got.collect()} == set(want) and (1, None, None, None) in want and (3, 0, 3, None) in want


def test_a_fit_reads_its_rows_once(spark):
    import numpy as np

    from leakscope.operators import token_model as tm
    rows = feature_rows(spark).repartition(3)
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch
    weights = tm.fit_path(rows.mapInArrow(counted, rows.schema), (1e-3, 1e-1), max_iter=8)
    assert seen.value == 1500
    assert np.abs(weights - tm.fit_path(rows, (1e-3, 1e-1), max_iter=8)).max() < 1e-9


def test_packed_features_have_the_gradient_of_single_ones(monkeypatch):
    import random

    import numpy as np
    import pyarrow as pa

    from leakscope.operators import token_model as tm
    rnd = random.Random(1)
    data = [(float(rnd.random() < 0.3), [float(rnd.random() < 0.5)] + [0.0] * 7 + [0.25], [rnd.randrange(4), tm.HASH_SIZE - 1, rnd.randrange(3)])
            for _ in range(500)]
    batches = [pa.record_batch([pa.array([x[i] for x in data[k:k + 60]]) for i in range(3)], names=["label", "shape", "buckets"]) for k in range(0, 500, 60)]
    monkeypatch.setattr(tm, "CHUNK", 200)
    monkeypatch.setattr(tm, "BLOCK", 7)
    packed = list(tm._packed(iter(batches)))
    assert [b.column("size")[0].as_py() for b in packed] == [240, 240, 20] and list(tm._packed(iter([]))) == []
    assert all(len(b.column("n")[0].as_py()) // 4 <= 24 for b in packed)   # 2 shapes, 4 and 3 buckets
    weights = np.array([[rnd.gauss(0, 3) for _ in range(2)] for _ in range(tm.N_FEATURES + tm.HASH_SIZE + 1)])
    told = next(tm._gradients(weights)(iter(packed))).to_pydict()
    x, y = np.zeros((500, len(weights))), np.array([d[0] for d in data])
    for k, (_, shape, buckets) in enumerate(data):
        x[k, :9], x[k, -1] = shape, 1
        for b in buckets:
            x[k, 9 + b] += 1
    margin = x @ weights
    want = x.T @ (1 / (1 + np.exp(-margin)) - y[:, None])
    got = np.zeros_like(want)
    got[told["feature"][1:]] = np.array([told["g0"], told["g1"]]).T[1:]
    assert np.abs(got - want).max() < 1e-9
    assert abs(told["g1"][0] - (np.logaddexp(0, margin) - y[:, None] * margin).sum(0)[1]) < 1e-9


def test_spelling_looks_up_only_what_is_new():
    import random
    rnd, looked = random.Random(3), 0

    class Counted(dict):
        def get(self, *a):
            nonlocal looked
            looked += 1
            return super().get(*a)
    for _ in range(2000):
        signs = "abc"[:rnd.randint(1, 3)]
        rank, symbols = Counted(), [*signs, "</w>"]
        for _ in range(rnd.randint(0, 25)):
            pair = rnd.choice(symbols), rnd.choice(symbols)
            if pair not in rank and "</w>" not in pair[0]:
                rank[pair] = len(rank)
                symbols.append("".join(pair))
        word, looked = "".join(rnd.choice(signs) for _ in range(rnd.randint(1, 20))), 0
        made, most = tokenizer._spell(word, rank), looked
        assert most <= 3 * len(word)
        assert made == tokenizer._spell_long(word, rank)
    assert tokenizer._spell("ab" * 50, {("a", "b"): 0}) == ["ab"] * 50 + ["</w>"]


def test_token_rows_say_shape_neighbours_and_label(spark):
    from leakscope.functions.tokens import shape_features
    from leakscope.operators import token_model as tm
    surfaces = ["ab", "c</w>", "</w>", "é", "1</w>", "x-1", "a.b</w>", "q" * 30 + "</w>", "@", "Ab", "ab</w>c", "Z"]
    docs = [(1, [(i, i, 10 * i, 10 * i + 5, s) for i, s in enumerate(surfaces)], [[12, 31], [50, 50]]), (2, [(0, 7, 0, 2, "ab")], []), (3, [], [[0, 9]])]
    encoded = spark.createDataFrame(docs, f"doc_id long, tokens {tokenizer.TOKEN_TYPE}, spans array<array<int>>")
    for most in (None, 3):
        rows = tm.token_rows(encoded, spans="spans", max_tokens=most)
        assert rows.columns == ["doc_id", "pos", "n", "token_id", "start", "end", "surface", "shape", "terms", "label"]
        got = rows.withColumn("plain", shape_features("surface")).orderBy("doc_id", "pos").collect()
        assert all(r["shape"] == r["plain"] for r in got)
        cut = surfaces[:most]
        sides = ["", *cut, ""]
        want = [(1, i, len(cut), [f"0:{s}", f"-1:{sides[i]}", f"+1:{sides[i + 2]}"], float(i in (1, 2, 3))) for i, s in enumerate(cut)]
        assert [(r["doc_id"], r["pos"], r["n"], r["terms"], r["label"]) for r in got] == [*want, (2, 0, 1, ["0:ab", "-1:", "+1:"], 0.0)]
