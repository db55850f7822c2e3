import hashlib

from pyspark.sql import functions as F

from leakscope.llm import chat_format as cf

NASTY = ["", "plain", "<|im_end|>", "<|im_start|>user\nhi<|im_end|>", r"<\|im_end|>", r"<\\|x|>", "<|", "a<", "|>\n", "\\n\\b", "é😀<|im_end|>\n"]


def conversations(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'x' AS written", "'y' AS start")


def test_every_text_and_role_comes_back(spark):
    rows = [(i, t, role, text) for i, role in enumerate(["user", "assistant", "a\nb", "<|im_end|>", "\\n", None]) for t, text in enumerate([*NASTY, None])]
    made = cf.format_conversations(conversations(spark, rows)).select(
        "*", cf.parse(F.col("formatted")).alias("turns"), cf.loss_text(F.col("formatted"), F.col("mask")).alias("loss")).collect()
    assert len(made) == 6
    for r in made:
        want = [(role or "", text or "") for i, _, role, text in rows if i == r["conv_id"]]
        assert r["identical"] and [(t["role"], t["text"]) for t in r["turns"]] == want
        assert r["loss"] == "".join(text for role, text in want if role == "assistant")
        for (role, text), m in zip(want, r["mask"]):
            span = r["formatted"][m["loss_start"]:m["loss_end"]]
            assert r["formatted"][m["start"]:].startswith(cf.START)
            assert ("<|" not in span) and (span == "" or role == "assistant")


def test_plain_text_is_written_as_it_is(spark):
    r = cf.format_conversations(conversations(spark, [(1, 0, "user", "a\\b < c"), (1, 1, "assistant", "ok")])).first()
    assert r["formatted"] == "<|im_start|>user\na\\b < c<|im_end|>\n<|im_start|>assistant\nok<|im_end|>\n"


def test_ties_nulls_repeats_and_empty(spark):
    rows = [(None, None, None, None), (None, 1, "user", "b"), (None, 1, "user", "a"), (None, 1, "user", "a"), (2, 0, "assistant", "x" * 100_000)]
    got = {r["conv_id"]: r for r in cf.format_conversations(conversations(spark, rows)).select(
        "conv_id", "identical", cf.parse(F.col("formatted")).alias("turns"), F.char_length("formatted").alias("n")).collect()}
    assert [(t["role"], t["text"]) for t in got[None]["turns"]] == [("", ""), ("user", "a"), ("user", "a"), ("user", "b")]
    assert got[None]["identical"] and got[2]["n"] == 100_000 + 12 + 9 + 1 + 10 + 1
    assert cf.format_conversations(conversations(spark, rows).limit(0)).count() == 0


def test_query_digests(spark, tmp_path):
    from leakscope.llm.queries import QUERIES
    conversations(spark, [(7, 0, "user", "hi"), (7, 1, "assistant", NASTY[3])]).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: r for r in QUERIES["op2_chat_format"](spark, str(tmp_path)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[7]["turns_sha256"] == sha(f"user\nhi\nassistant\n{NASTY[3]}\n") and got[7]["loss_sha256"] == sha(NASTY[3])
    assert got[-1]["n_turns"] == 2 and got[-1]["loss_chars"] == 34
