"""Written exports come back the same; a look reports what came after the last one."""

from pyspark.sql import functions as F

from leakscope.operators import events as ev


def test_csv_keeps_quotes_line_feeds_and_nulls(spark, tmp_path):
    values = ["plain", 'say "x", then', "two\nlines", "", None, "back\\slash", " spaced "]
    rows = [(i, *[v] * 16, i * 10, v) for i, v in enumerate(values)]
    schema = ", ".join(f"{c} {'bigint' if c in ('id', 'bytes_out') else 'string'}" for c in ev.EXPORT_COLUMNS)
    made = spark.createDataFrame(rows, schema)
    ev.write_csv(made, f"{tmp_path}/csv")
    assert sorted(map(tuple, ev.read_csv(spark, f"{tmp_path}/csv").collect())) == sorted(map(tuple, made.collect()))


def events(spark, ids, label="critical"):
    return spark.createDataFrame([(i, "response", label) for i in ids], "id long, direction string, label string")


def test_looks_report_each_alert_once(spark, tmp_path):
    marks = f"{tmp_path}/marks"
    ids = lambda found: [r["id"] for r in found.collect()]
    assert ids(ev.new_alerts(events(spark, [1, 2, 3]), marks)) == []
    assert ids(ev.new_alerts(events(spark, [1, 2, 3, 5, 4]), marks)) == [4, 5]
    assert ids(ev.new_alerts(events(spark, [1, 2, 3, 5, 4]), marks)) == []
    assert ids(ev.new_alerts(events(spark, []), marks)) == []
    assert ids(ev.new_alerts(events(spark, [6], "high").union(events(spark, [7])), marks)) == [7]


def test_a_look_that_was_cut_off_is_done_again(spark, tmp_path):
    marks = f"{tmp_path}/marks"
    ev.new_alerts(events(spark, [1]), marks)
    events(spark, [9]).write.parquet(f"{marks}/look=1/alerts")   # no mark was written
    assert [r["id"] for r in ev.new_alerts(events(spark, [1, 2]), marks).collect()] == [2]


def test_first_look_at_nothing(spark, tmp_path):
    assert ev.new_alerts(events(spark, []), f"{tmp_path}/m").count() == 0
    assert ev.new_alerts(events(spark, [1]), f"{tmp_path}/m").select(F.max("id")).first()[0] == 1


def test_masked_windows_count_each_token_once(spark):
    from leakscope.functions import tokens as tk
    from leakscope.operators import evaluate
    rows = spark.range(730).select(F.col("id").alias("pos"), F.lit(730).alias("n"))
    placed = rows.select("pos", F.explode(tk.window_ids(F.col("pos"), F.col("n"))).alias("window"),
                         (F.col("pos") % 3 == 0).cast("int").alias("prediction"), (F.col("pos") % 2 == 0).cast("int").alias("label"))
    assert placed.count() > 730
    got = evaluate.token_metrics(placed).first()
    assert (got["n"], got["tp"], got["fp"], got["fn"]) == (730, 122, 122, 243)
