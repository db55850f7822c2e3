"""Forms that cost less find the same."""

import random
import re

from pyspark.sql import functions as F

from leakscope.functions import scan
from leakscope.functions.catalog import SENSITIVE
from leakscope.functions.dialect import NOT_SPACE, SPACE, jvm_regex
from leakscope.functions.tokens import shape_features
from leakscope.operators import intent_model


def test_a_look_at_the_first_character_changes_no_match(spark):
    rnd = random.Random(5)
    seeds = ["4111 1111 1111 1111", "123-45-6789", "+1 (415) 555-0123", "(415)5550123", "8.8.8.8", "GB82WEST12345698765432",
             "C12345678", "192.168.0.7", "10.1.2.3", "jane.roe@mail.example.com", "٣٤٥-١٢-٦٧٨٩", "é", "_", "x", " "]
    texts = ["".join(rnd.choice(seeds) if rnd.random() < 0.6 else rnd.choice("a1-. (+é_Z٣") for _ in range(12)) for _ in range(200)]
    led = [p for p in SENSITIVE if p.first]
    assert len(led) >= 7
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", *[F.expr(
        f"array({', '.join(f'regexp_extract_all(text, {scan.regex_literal(jvm_regex(x))}, 0)' for x in (p.regex, p.scanned))})").alias(p.name) for p in led])
    got = rows.collect()
    assert all(r[p.name][0] == r[p.name][1] for r in got for p in led)
    assert all(any(r[p.name][0] for r in got) for p in led)


def test_not_space_is_all_but_space(spark):
    chars = spark.createDataFrame([(chr(i),) for i in range(1, 0x10000) if not 0xD800 <= i < 0xE000] + [("😀",)], "c string")
    assert chars.filter(F.col("c").rlike(f"^{NOT_SPACE}$") != F.col("c").rlike(f"^[^{SPACE}]$")).count() == 0
    assert NOT_SPACE.startswith("[!-~")


def test_the_marker_is_taken_off_once(spark):
    rows = spark.createDataFrame([("Ab-1</w>",), ("x@y.z",), ("</w>",), ("12",), ("ÉA",), ("a</w>b",)], "t string")
    plan = rows.select(shape_features("t").alias("f"))
    assert plan._jdf.queryExecution().analyzed().toString().count("regexp_replace") == 1
    got = [r["f"] for r in plan.collect()]
    for (t,), f in zip(rows.collect(), got):
        s = re.sub("</w>$", "", t)
        assert f[8] == min(len(s), 20) / 20 and f[1] == float(any(c.isdigit() for c in s)) and f[5] == float("@" in s) and f[0] == float(s.isdigit())


def test_a_cut_sample_reads_no_more_than_it_shows(spark):
    text = "call 415-555-0123 " + "x" * 30 + " or 415-555-0199 " + "y" * 5000
    rows = spark.createDataFrame([(text,), ("",), ("short",)], "text string").withColumn(
        "hits", F.expr("filter(array(named_struct('start', 5, 'end', 17, 'snippet', '41********23'), named_struct('start', 52, 'end', 64, 'snippet', '-')), h -> length(text) > 99)"))
    for chars in (0, 5, 10, 53, 60, 400):
        shown = rows.select(scan.masked_text("text", "hits").alias("whole"), scan.masked_text("text", "hits", chars).alias("cut"))
        assert all(r["cut"] == r["whole"][:chars] or chars <= 53 for r in shown.collect())
    cut = rows.select(scan.masked_text("text", "hits", 40).alias("c"))
    assert "left(text" in cut._jdf.queryExecution().analyzed().toString().replace("left(text#", "left(text")


def test_buckets_need_three_digits_of_the_hash(spark):
    words = spark.createDataFrame([(f"w{i}",) for i in range(300)], "w string")
    for buckets in (1024, 4096, 1000):
        short = F.expr(intent_model.bucket_sql("w", buckets, "md5"))
        whole = F.expr(f"cast(pmod(cast(conv(left(md5(w), 8), 16, 10) AS bigint), {buckets}) AS int)")
        assert words.filter(short != whole).count() == 0
    assert "substring" in intent_model.bucket_sql("w", 1024, "md5")
