"""The pipeline over given tables, stage by stage, against what each stage must have done."""

import re

import corpus_pipeline
from leakscope.llm import toxic_grammar as tg


def shingles(text, k=5):
    w = re.findall(r"\w+", (text or "").lower())
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)}


def test_stages_follow_their_rules(spark, tiny, tmp_path):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    seen = {}
    for at, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, tiny)
        if at < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        seen[name] = (docs.toPandas(), spark.read.parquet(f"{tmp_path}/{name}").toPandas())
        docs = spark.read.parquet(f"{tmp_path}/{name}")
    before, after = seen["toxicity"]
    labels = spark.read.parquet(f"{tiny}/labels.parquet")
    model = tg.learn(spark.read.parquet(f"{tiny}/documents.parquet"), labels)
    scorer = tg._Scorer(model)
    assert set(after.doc_id) == {i for i, t in zip(before.doc_id, before.text) if scorer.score(scorer.read(t)[1]) < 0.5}
    before, after = seen["near_duplicates"]
    kept = {t: shingles(t) for t in after.text}
    assert after.doc_id.is_unique and set(after.doc_id) <= set(before.doc_id)
    for i, t in zip(before.doc_id, before.text):
        if i not in set(after.doc_id):  # what went is close to something that was there
            a = shingles(t)
            assert any(len(a & shingles(u)) >= 0.7 * len(a | shingles(u)) for j, u in zip(before.doc_id, before.text) if j < i)
    for t, a in kept.items():
        assert not any(t != u and a and len(a & b) > 0.85 * len(a | b) for u, b in kept.items())
    before, after = seen["decontamination"]
    items = [shingles(t) for t in spark.read.parquet(f"{tiny}/benchmark.parquet").toPandas().text]
    held = {i for i, t in zip(before.doc_id, before.text) if any(len(x & shingles(t)) >= 0.8 * len(x) for x in items if x)}
    assert set(after.doc_id) == set(before.doc_id) - held
    before, after = seen["mix"]
    assert set(after.doc_id) <= set(before.doc_id) and after.doc_id.value_counts().max() <= 2
    before, after = seen["shards"]
    assert sorted(after.doc_id) == sorted(before.doc_id) and set(after.law) == {"bytes"}


def test_run_is_registered(spark, tiny):
    import __spark_entry__ as entry
    known = entry.queries()
    assert known["pipeline"] is corpus_pipeline.run
    assert sorted(n for n in known if re.match(r"op\d+_", n)) == sorted(
        ["op1_vector_graph", "op2_chat_format", "op3_mix", "op4_lang_id", "op5_secret_links", "op6_kd_shards", "op7_contain",
         "op8_line_dedup", "op9_order_minhash", "op10_toxic_grammar", "op11_simplex_clusters", "op12_piece_codec", "op13_filter_audit"])
    assert set(entry.oracle_sql()) <= set(known)
    assert corpus_pipeline.run(spark, tiny).count() > 0
