"""Small tables with the awkward cases, shared by the tests."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i} again" for i in range(30_000))


def documents(spark, rows):
    """Documents from (doc_id, text, lang, source), with columns named like inner ones beside them."""
    frame = spark.createDataFrame([(*r, 0) for r in rows], DOCS)
    for name in ("rid", "unit", "name", "size", "w", "n", "place", "hash", "key", "component", "shard", "node", "passes", "h1"):
        frame = frame.selectExpr("*", f"'clash' AS {name}")
    return frame


def awkward(spark):
    """Null and empty texts, null ids and columns, repeated rows, a very long text."""
    same = "one two three four five six seven eight nine ten"
    return documents(spark, [
        (1, same, "en", "a"), (1, same, "en", "a"), (2, same, None, None), (3, None, "en", "a"), (4, "", "de", "b"),
        (5, LONG, "en", "b"), (6, "...", None, "a"), (None, same + " x", "en", "a"), (None, None, None, None), (7, "one", "en", "c"),
        (8, "line one is here\nline two is here\n\nline one is here", "en", "c"), (9, "Line One is here \nother", "en", "c")])


def empty(spark):
    return awkward(spark).limit(0)
