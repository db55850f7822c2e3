"""SQL functions for ad-hoc use: `SELECT leak_score(text) FROM ...`."""

from __future__ import annotations

from pyspark.sql import SparkSession

from leakscope.functions import scan
from leakscope.functions.catalog import HIT_GAIN
from leakscope.functions.scoring import LABEL_FLOORS


def register(spark: SparkSession) -> None:
    """Temporary functions of the session, native expressions all of them:

    `leak_hits(text)`: sensitive values as name, category, weight and masked snippet;
    `leak_score(text)`: their score between 0 and 1; `leak_label(text)`: its label.
    A null text counts as an empty one.
    """
    hits = scan.sensitive_hits_sql("t", "lower(t)", f"t rlike r'{scan.DIGIT_GATE}'")
    bound = f"transform(array(coalesce(value, '')), t -> {hits})[0]"
    shown = (f"transform({bound}, h -> named_struct('name', h.name, 'category', h.category, "
             f"'weight', h.weight, 'snippet', h.snippet))")
    kind = "ARRAY<STRUCT<name: STRING, category: STRING, weight: DOUBLE, snippet: STRING>>"
    score = (f"least(1D, aggregate(transform({bound}, h -> h.weight), 0D, "
             f"(s, w) -> s + w * (1D - s) * {HIT_GAIN}D))")
    floors = " ".join(f"WHEN x >= {floor}D THEN '{name}'" for name, floor in LABEL_FLOORS)
    label = f"transform(array({score}), x -> CASE {floors} ELSE 'clean' END)[0]"
    for name, returns, body in (("leak_hits", kind, shown), ("leak_score", "DOUBLE", score), ("leak_label", "STRING", label)):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(value STRING) RETURNS {returns} RETURN {body}")
