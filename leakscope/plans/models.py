"""Queries over tokens, the intent model, the token model and its evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from leakscope.functions import intent as it
from leakscope.functions import scoring
from leakscope.functions import tokens as tk
from leakscope.operators import corpus, evaluate, intent_model, token_model, tokenizer
from leakscope.operators import classify as cl
from leakscope.plans import inputs as inp
from leakscope.plans.registry import query
from leakscope.session import written
from leakscope.sources.tables import table

_WORDS = "regexp_extract_all(lower(text), '\\S+')"
_WORD_ROWS = f"""
    listed AS MATERIALIZED (SELECT doc_id, {_WORDS} AS w, len({_WORDS}) AS n FROM documents),
    words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS pos, n
        FROM listed)"""


def _documents(spark, folder):
    return table(spark, folder, "documents")


@query("word_freq", f"""WITH {_WORD_ROWS}
    SELECT word, count(*) AS n FROM words GROUP BY word""")
def word_freq(spark, folder):
    """How often each word occurs."""
    return tokenizer.word_frequency(_documents(spark, folder))


@query("pair_freq", f"""WITH {_WORD_ROWS},
    spelled AS (SELECT list_append(string_split(word, ''), '</w>') AS s, count(*) AS n
        FROM words GROUP BY word),
    pairs AS (SELECT s, n, unnest(range(1, len(s))) AS i FROM spelled)
    SELECT s[i] AS a, s[i + 1] AS b, sum(n)::BIGINT AS n FROM pairs GROUP BY 1, 2""")
def pair_freq(spark, folder):
    """How often two symbols stand side by side, by word frequency."""
    frequency = tokenizer.word_frequency(_documents(spark, folder))
    return tokenizer.pair_frequency(tokenizer.as_symbols(frequency))


@query("most_frequent_pair", f"""WITH {_WORD_ROWS},
    spelled AS (SELECT list_append(string_split(word, ''), '</w>') AS s, count(*) AS n
        FROM words GROUP BY word),
    pairs AS (SELECT s, n, unnest(range(1, len(s))) AS i FROM spelled)
    SELECT s[i] AS a, s[i + 1] AS b, sum(n)::BIGINT AS n FROM pairs GROUP BY 1, 2
    ORDER BY n DESC, a, b LIMIT 1""")
def most_frequent_pair(spark, folder):
    """The pair a first merge takes."""
    frequency = tokenizer.word_frequency(_documents(spark, folder))
    return tokenizer.ranked_pairs(tokenizer.as_symbols(frequency)).limit(1)


def trained_tokenizer(spark, folder):
    return tokenizer.train(tokenizer.word_frequency(_documents(spark, folder)))


@query("bpe_merges")
def bpe_merges(spark, folder):
    """All merges of a full vocabulary, learned from all documents."""
    learned = trained_tokenizer(spark, folder)
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(learned.merges)],
                                 "rank int, a string, b string")


@query("bpe_encode")
def bpe_encode(spark, folder):
    """Token and unknown counts of each document under a full vocabulary."""
    rows = tokenizer.encode(_documents(spark, folder).select("doc_id", "text"),
                            trained_tokenizer(spark, folder))
    return rows.select("doc_id", F.size("tokens").alias("tokens"), F.expr(
        "size(filter(tokens, t -> t.id = 1))").alias("unknown"))


@query("token_offsets", """
    WITH pieces AS (SELECT doc_id, regexp_extract_all(lower(text), '\\S+') AS w,
        string_split_regex(lower(text), '\\S+') AS g FROM documents),
    sums AS (SELECT doc_id, len(w) AS words, length(g[1]) AS first_start,
        list_sum(list_transform(g[:len(w)], lambda x: length(x)))
        + list_sum(list_transform(w, lambda x: length(x))) AS last_end FROM pieces)
    SELECT doc_id, words, first_start, CAST(last_end AS BIGINT) AS last_end FROM sums""")
def token_offsets(spark, folder):
    """Character range from the first to the last word; without a word, where the text ends and no last one."""
    rows = tokenizer.word_offsets(_documents(spark, folder).select("doc_id", "text"))
    return rows.select(
        "doc_id", F.expr("if(text IS NULL, NULL, cast(size(words) AS bigint))").alias("words"),
        F.expr("cast(coalesce(get(words, 0).start, length(text)) AS bigint)").alias("first_start"),
        F.expr("cast(get(words, size(words) - 1).end AS bigint)").alias("last_end"))


@query("token_labels", """
    WITH pieces AS (SELECT doc_id, regexp_extract_all(lower(text), '\\S+') AS w,
        string_split_regex(lower(text), '\\S+') AS g, doc_id % 50 AS a, 30 + doc_id % 50 AS b
        FROM documents),
    placed AS (SELECT doc_id, a, b, w, g, unnest(range(1, len(w) + 1)) AS i FROM pieces
        WHERE length(array_to_string(w, ' ')) > 0),
    head AS (SELECT * FROM placed WHERE i <= 90),
    ranged AS (SELECT doc_id, a, b, list_sum(list_transform(g[1:i], lambda x: length(x)))
        + coalesce(list_sum(list_transform(w[1:i - 1], lambda x: length(x))), 0) AS s,
        length(w[i]) AS size FROM head)
    SELECT doc_id, sum(CASE WHEN s < b AND a < s + size THEN 1 ELSE 0 END)::BIGINT AS positive
    FROM ranged GROUP BY doc_id""")
def token_labels(spark, folder):
    """Words that touch a span, per document (the spans lie near the start of the text)."""
    rows = tokenizer.word_offsets(_documents(spark, folder).select("doc_id", "text"))
    rows = rows.withColumn("spans", F.expr(
        "array(array(cast(doc_id % 50 AS int), cast(30 + doc_id % 50 AS int)))"))
    tokens = rows.select("doc_id", "spans", F.explode("words").alias("w")).select(
        "doc_id", "spans", F.col("w.start").alias("start"), F.col("w.end").alias("end"))
    return tokens.groupBy("doc_id").agg(F.sum(
        tk.overlaps_any("start", "end", "spans")).alias("positive"))


_FEATURES = ["all_digit", "has_digit", "all_upper", "has_upper", "has_punct", "has_at",
             "has_dash", "has_dot", "length"]


@query("token_features", """
    WITH words AS (SELECT doc_id, unnest(regexp_extract_all(text, '\\S+')) AS w FROM documents),
    shaped AS (SELECT doc_id, regexp_matches(w, '^\\p{Nd}+$') AS all_digit,
        regexp_matches(w, '\\p{Nd}') AS has_digit,
        regexp_matches(w, '\\p{Lu}') AND NOT regexp_matches(w, '[\\p{Ll}\\p{Lt}]') AS all_upper,
        regexp_matches(w, '\\p{Lu}') AS has_upper,
        regexp_matches(w, '[^\\p{L}\\p{N}\\s]') AS has_punct, contains(w, '@') AS has_at,
        contains(w, '-') AS has_dash, contains(w, '.') AS has_dot,
        least(length(w), 20) / 20.0 AS length FROM words)
    SELECT doc_id, """ + ", ".join(
    f"sum({c}::INT)::DOUBLE AS {c}" for c in _FEATURES[:-1])
    + ", round(sum(length) + 1e-12, 4) AS length FROM shaped GROUP BY doc_id")
def token_features(spark, folder):
    """Shape features summed over the words of each document."""
    words = tk.words_sql("text").replace("lower(text)", "text")
    total = (f"aggregate({words}, array_repeat(0D, {tk.N_FEATURES}), (s, w) -> "
             f"zip_with(s, {tk.shape_features_sql('w')}, (x, y) -> x + y))")
    summed = cl.pinned(_documents(spark, folder), f=F.expr(total))   # in the row: no shuffle
    return summed.filter("text rlike r'\\S'").select("doc_id", *[F.col("f")[i].alias(name) for i, name in enumerate(
        _FEATURES)]).withColumn("length", scoring.rounded(F.col("length"), 4))


@query("token_windows", f"""
    WITH counted AS (SELECT doc_id, len({_WORDS}) AS n FROM documents),
    sized AS (SELECT *, CASE WHEN n = 0 THEN 0 WHEN n <= 200 THEN 1
        ELSE 1 + CAST(ceil((n - 200) / 150.0) AS BIGINT) END AS windows FROM counted)
    SELECT doc_id, n, windows, CASE WHEN windows > 0 THEN (windows - 1) * 150 END AS last_start
    FROM sized""")
def token_windows(spark, folder):
    """Overlapping windows over the words of each document."""
    rows = _documents(spark, folder).select("doc_id", F.size(tk.words("text")).alias("n"))
    rows = rows.withColumn("starts", tk.window_starts("n"))
    return rows.select("doc_id", F.col("n").cast("bigint").alias("n"),
                       F.size("starts").cast("bigint").alias("windows"),
                       F.array_max("starts").cast("bigint").alias("last_start"))


@query("doc_score_topk", f"""WITH {_WORD_ROWS},
    counts AS (SELECT doc_id, max(n) AS n, CASE WHEN max(n) <= 200 THEN 1
        ELSE 1 + CAST(ceil((max(n) - 200) / 150.0) AS BIGINT) END AS windows
        FROM words GROUP BY doc_id),
    placed AS (SELECT w.doc_id, c.windows, (length(w.word) % 20) / 20.0 AS p,
        unnest(range(greatest(0, (w.pos - 50) // 150), least(w.pos // 150, c.windows - 1) + 1))
        AS win FROM words w JOIN counts c USING (doc_id)),
    peaks AS (SELECT doc_id, win, windows, max(p) AS p FROM placed GROUP BY ALL),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY p DESC) AS rn FROM peaks)
    SELECT doc_id, round(avg(p) + 1e-12, 6) AS score, max(windows) AS windows FROM ranked
    WHERE rn <= 5 GROUP BY doc_id""")
def doc_score_topk(spark, folder):
    """Mean of the five best windows; a token's score here is a function of its length."""
    tokens = cl.pinned(_documents(spark, folder), w=tk.words("text")).select(
        "doc_id", F.size("w").alias("n"), F.posexplode("w").alias("pos", "word"))
    tokens = tokens.withColumn("p", (F.length("word") % 20) / F.lit(20.0))
    return token_model.score_documents(tokens).withColumn(
        "score", scoring.rounded(F.col("score"), 6))


# --- intent model ------------------------------------------------------------
_GRAMS = (f"list_transform(range(1, length(lower({inp.PATH})) - 1), "
          f"lambda i: 'p:' || substring(lower({inp.PATH}), i, 3))")
_TERMS = (f"list_transform(list_filter({_WORDS}, lambda w: length(w) BETWEEN 2 AND 40), "
          "lambda w: 'b:' || w)")
_BAGS = f"""
    bags AS (SELECT doc_id, unnest(list_transform(list_concat({_GRAMS}, {_TERMS}),
        lambda t: CAST('0x' || left(md5(t), 8) AS BIGINT) % 1024)) AS bucket FROM documents),
    ruled AS (SELECT doc_id, split_part({inp.intent_sql(inp.PATH, 'text')}, '|', 1) AS intent,
        CAST(split_part({inp.intent_sql(inp.PATH, 'text')}, '|', 2) AS DOUBLE) AS confidence
        FROM documents),
    train AS (SELECT doc_id, intent FROM ruled WHERE intent <> 'unknown' AND confidence >= 0.7),
    classes AS (SELECT * FROM (VALUES {', '.join(f"({i}, '{n}')" for i, n in enumerate(it.INTENTS))})
        AS c(class, intent)),
    priors AS (SELECT c.class, c.intent, count(t.doc_id) AS n,
        ln(greatest(count(t.doc_id), 1) / (SELECT count(*) FROM train)::DOUBLE) AS log_prior
        FROM classes c LEFT JOIN train t USING (intent) GROUP BY c.class, c.intent),
    mass AS (SELECT c.class, c.intent, b.bucket, coalesce(x.n, 0) + 1.0 AS smoothed
        FROM classes c CROSS JOIN (SELECT unnest(range(0, 1024)) AS bucket) b LEFT JOIN
        (SELECT intent, bucket, count(*) AS n FROM bags JOIN train USING (doc_id)
            GROUP BY intent, bucket) x ON x.intent = c.intent AND x.bucket = b.bucket),
    likelihood AS (SELECT *, ln(smoothed / sum(smoothed) OVER (PARTITION BY class)) AS ll FROM mass),
    scored AS (SELECT b.doc_id, p.class, p.intent, any_value(p.log_prior) + sum(l.ll) AS score
        FROM bags b JOIN likelihood l USING (bucket) JOIN priors p ON p.class = l.class
        GROUP BY b.doc_id, p.class, p.intent),
    soft AS (SELECT *, exp(score - max(score) OVER (PARTITION BY doc_id)) AS e FROM scored),
    best AS (SELECT doc_id, arg_max(intent, score) AS guess, max(e) / sum(e) AS prob
        FROM soft GROUP BY doc_id)"""


def _bagged(spark, folder):
    rows = _documents(spark, folder).select("doc_id", "text", F.expr(inp.PATH).alias("path"))
    rows = intent_model.label_by_rules(rows, "path", "text")
    return intent_model.with_features(rows, "path", "text", stable_hash="md5")


def _training(rows):
    return rows.filter("skip_reason IS NULL")


@query("hash_bag", f"""WITH {_BAGS}
    SELECT doc_id, bucket, count(*) AS n FROM bags GROUP BY doc_id, bucket""")
def hash_bag(spark, folder):
    """Hashed bag of path trigrams and body words."""
    rows = intent_model.with_features(_documents(spark, folder), inp.PATH, "text",
                                      stable_hash="md5")
    rows = rows.select("doc_id", F.explode("buckets").alias("bucket"))
    return rows.groupBy("doc_id", F.col("bucket").cast("bigint").alias("bucket")).agg(
        F.count("*").alias("n"))


@query("training_stats", f"""WITH {_BAGS}
    SELECT intent <> 'unknown' AND confidence >= 0.7 AS usable, CASE WHEN intent <> 'unknown'
        AND confidence >= 0.7 THEN intent ELSE 'unknown-or-low-conf:' || intent END AS name,
        count(*) AS rows FROM ruled GROUP BY 1, 2""")
def training_stats(spark, folder):
    """Training rows per class, and rows left out by reason."""
    rows = _documents(spark, folder).select("doc_id", "text", F.expr(inp.PATH).alias("path"))
    return intent_model.training_stats(intent_model.label_by_rules(rows, "path", "text"))


@query("nb_fit", f"""WITH {_BAGS}
    SELECT class, bucket, round(ll + 1e-12, 6) AS log_likelihood FROM likelihood""")
def nb_fit(spark, folder):
    """Smoothed log-likelihood of every class and bucket."""
    _, likelihoods = intent_model.fit_tables(_training(_bagged(spark, folder)))
    return likelihoods.select("class", F.col("bucket").cast("bigint").alias("bucket"),
                              scoring.rounded(F.col("log_likelihood"), 6).alias("log_likelihood"))


@query("nb_priors", f"""WITH {_BAGS}
    SELECT class, intent, n, round(log_prior + 1e-12, 6) AS log_prior FROM priors""")
def nb_priors(spark, folder):
    """Class priors; a class without rows counts as one."""
    priors, _ = intent_model.fit_tables(_training(_bagged(spark, folder)))
    return priors.withColumn("log_prior", scoring.rounded(F.col("log_prior"), 6))


def _predicted(spark, folder, *keep):
    """Rows with their guesses; labels and buckets are worked out once and written."""
    rows = written(_bagged(spark, folder).select(
        "doc_id", "intent", "skip_reason", "buckets", *keep), "bagged")
    return intent_model.predict(rows, intent_model.fit(_training(rows)))


@query("nb_score", f"""WITH {_BAGS}
    SELECT doc_id, guess, round(prob + 1e-12, 5) AS prob FROM best""")
def nb_score(spark, folder):
    """Most likely intent of every document and its probability."""
    return _predicted(spark, folder).select(
        "doc_id", "guess", scoring.rounded(F.col("guess_prob"), 5).alias("prob"))


@query("nb_eval", f"""WITH {_BAGS},
    checked AS (SELECT t.intent, b.guess FROM train t JOIN best b USING (doc_id))
    SELECT intent, count(*) AS support, round(avg(CAST(guess = intent AS INT)) + 1e-12, 6) AS recall,
        round((SELECT avg(CAST(guess = intent AS INT)) FROM checked) + 1e-12, 6) AS accuracy
    FROM checked GROUP BY intent""")
def nb_eval(spark, folder):
    """Support, recall and accuracy on the training rows."""
    rows = intent_model.evaluate(_training(_predicted(spark, folder)))
    return rows.select("intent", "support", scoring.rounded(F.col("recall"), 6).alias("recall"),
                       scoring.rounded(F.col("accuracy"), 6).alias("accuracy"))


@query("intent_with_fallback", f"""WITH {_BAGS}
    SELECT r.doc_id, CASE WHEN r.intent = 'unknown' AND b.prob >= 0.55 THEN b.guess
        ELSE r.intent END AS intent, round(CASE WHEN r.intent = 'unknown' AND b.prob >= 0.55
        THEN least(b.prob, 0.85) ELSE r.confidence END + 1e-12, 3) AS confidence
    FROM ruled r JOIN best b USING (doc_id)""")
def intent_with_fallback(spark, folder):
    """The rule cascade with the trained model behind it."""
    rows = _predicted(spark, folder, "path", "text")
    rows = rows.select("doc_id", it.classify_intent(
        "path", "text", guess="guess", guess_prob="guess_prob").alias("i"))
    return rows.select("doc_id", F.col("i.intent").alias("intent"),
                       scoring.rounded(F.col("i.confidence"), 3).alias("confidence"))


# --- evaluation --------------------------------------------------------------
# Scores are those of the scan over whole texts, the truth is the quality label.
_SCORES = f"""
    bodies AS ({inp.BODIES_SQL}), {inp.hits_ctes()}, {inp.scores_ctes()},
    scores AS (SELECT doc_id, round(s.tier1 + 1e-12, 6) AS score,
        round(s.re_score + 1e-12, 6) AS tier1, l.quality AS label
        FROM scored s JOIN labels l USING (doc_id))"""


def _scores(spark, folder):
    scanned = cl.scan_texts(inp.bodies(spark, folder)).select(
        "doc_id", scoring.rounded(scoring.combine(F.col("re_score"), F.col("dc_score")), 6).alias("score"),
        scoring.rounded(F.col("re_score"), 6).alias("tier1"))
    truth = table(spark, folder, "labels").select("doc_id", F.col("quality").alias("label"))
    return scanned.join(truth, "doc_id")


_RATES = """accuracy, precision, recall, round(2 * precision * recall
        / greatest(precision + recall, 1e-9) + 1e-12, 6) AS f1"""


def _sweep_sql(thresholds) -> str:
    values = ", ".join(f"({i}, {t}::DOUBLE)" for i, t in enumerate(thresholds))
    return f"""{_SCORES},
    thresholds AS (SELECT * FROM (VALUES {values}) AS t(position, threshold)),
    counts AS (SELECT position, threshold,
        sum(CASE WHEN score >= threshold AND label = 1 THEN 1 ELSE 0 END)::BIGINT AS tp,
        sum(CASE WHEN score < threshold AND label = 0 THEN 1 ELSE 0 END)::BIGINT AS tn,
        sum(CASE WHEN score >= threshold AND label = 0 THEN 1 ELSE 0 END)::BIGINT AS fp,
        sum(CASE WHEN score < threshold AND label = 1 THEN 1 ELSE 0 END)::BIGINT AS fn,
        count(*) AS n FROM thresholds CROSS JOIN scores GROUP BY position, threshold),
    rates AS (SELECT *, (tp + tn) / greatest(n, 1)::DOUBLE AS accuracy,
        tp / greatest(tp + fp, 1)::DOUBLE AS precision,
        tp / greatest(tp + fn, 1)::DOUBLE AS recall FROM counts),
    swept AS (SELECT position, threshold, tp, tn, fp, fn, n, {_RATES} FROM rates)"""


def _round_f1(rows):
    return rows.withColumn("f1", scoring.rounded(F.col("f1"), 6))


@query("confusion", f"WITH {_sweep_sql([0.5])} SELECT tp, tn, fp, fn, n, accuracy, "
       "precision, recall, f1 FROM swept")
def confusion(spark, folder):
    """Confusion counts and rates at one threshold."""
    rows = _scores(spark, folder).withColumn("prediction", (F.col("score") >= 0.5).cast("int"))
    return _round_f1(evaluate.binary_metrics(rows))


@query("threshold_sweep", f"WITH {_sweep_sql(evaluate.THRESHOLDS)} SELECT * FROM swept")
def threshold_sweep(spark, folder):
    """Metrics at eight thresholds."""
    return _round_f1(evaluate.threshold_sweep(_scores(spark, folder)))


@query("best_threshold", f"""WITH {_sweep_sql(evaluate.THRESHOLDS)}
    SELECT threshold, f1 FROM swept ORDER BY f1 DESC, position LIMIT 1""")
def best_threshold(spark, folder):
    """The threshold of the best F1."""
    sweep = _round_f1(evaluate.threshold_sweep(_scores(spark, folder)))
    return evaluate.best_threshold(sweep).select("threshold", "f1")


_EDGES = ", ".join(f"({lo}::DOUBLE, {hi}::DOUBLE)" for lo, hi in zip(
    evaluate.SCORE_EDGES, evaluate.SCORE_EDGES[1:]))


@query("score_histogram", f"""WITH {_SCORES}
    SELECT low, high, count(s.doc_id) AS documents FROM (VALUES {_EDGES}) AS e(low, high)
        LEFT JOIN scores s ON s.label = 1 AND s.score >= low AND s.score < high
    GROUP BY low, high""")
def score_histogram(spark, folder):
    """Scores of positive documents in uneven ranges."""
    return evaluate.positive_histogram(_scores(spark, folder))


def _label_sql(score: str) -> str:
    names = ", ".join(f"('{n}')" for n in scoring.LABELS)
    return f"""WITH {_SCORES},
    shown AS (SELECT {inp.label_sql(score)} AS label, label AS y FROM scores),
    spine AS (SELECT * FROM (VALUES {names}) AS s(label))
    SELECT p.label, count(h.y) AS documents,
        coalesce(sum(h.y), 0)::BIGINT AS positives,
        (SELECT avg(CAST(label <> 'clean' AS INT)) FROM shown WHERE y = 1) AS recall,
        (SELECT count(*) FROM shown WHERE y = 0 AND label <> 'clean') AS false_positives
    FROM spine p LEFT JOIN shown h USING (label) GROUP BY p.label"""


@query("label_recall", _label_sql("score"))
def label_recall(spark, folder):
    """Documents and positives per label, and the recall of any label but clean."""
    return evaluate.label_report(_scores(spark, folder))


@query("blend_eval", _label_sql(
    "least(1.0, greatest(tier1, score) + (1 - greatest(tier1, score)) "
    "* least(tier1, score) * 0.55)"))
def blend_eval(spark, folder):
    """The same after both scores are blended."""
    rows = evaluate.blended(_scores(spark, folder), "tier1", "score")
    return evaluate.label_report(rows)


@query("split_80_10_10", """
    WITH ordered AS (SELECT doc_id, row_number() OVER (ORDER BY md5(doc_id || ':7'), doc_id) AS r,
        count(*) OVER () AS n FROM documents)
    SELECT doc_id, CASE WHEN r <= greatest(1, floor(n * 0.1)) THEN 'test'
        WHEN r <= 2 * greatest(1, floor(n * 0.1)) THEN 'validation' ELSE 'train' END AS split
    FROM ordered""")
def split_80_10_10(spark, folder):
    """Exact split of the documents in a seeded order."""
    return evaluate.split_three(_documents(spark, folder).select("doc_id"))


# --- corpus and token model --------------------------------------------------

def synthetic(spark, folder, spread=False):
    """Every document with its label and the sensitive clauses written into it. ``spread``: the
    documents are dealt out first, as one file may be one task."""
    rows = _documents(spark, folder).select("doc_id", "text")
    return corpus.samples(rows.repartition("doc_id") if spread else rows, "doc_id")


@query("synth_corpus")
def synth_corpus(spark, folder):
    """Labelled samples: words, label and sensitive ranges."""
    return synthetic(spark, folder).select(
        "doc_id", "label", F.size(F.split("text", " ")).alias("words"),
        F.to_json("spans").alias("spans"), F.md5("text").alias("digest"))


@query("synth_corpus_scan")
def synth_corpus_scan(spark, folder):
    """What the scan finds in the samples, per label."""
    rows = cl.with_sensitive_hits(cl.with_scan_gates(synthetic(spark, folder)))
    return rows.groupBy("label").agg(
        F.count("*").alias("samples"),
        F.sum((F.size("re_hits") > 0).cast("bigint")).alias("with_hits"))


def _model_rows(spark, folder):
    """Documents and their feature rows, tokenised once and written."""
    samples = evaluate.split_three(synthetic(spark, folder, spread=True))
    encoded = tokenizer.encode(samples, trained_tokenizer(spark, folder))
    rows = token_model.token_rows(encoded, spans="spans", keep=("split",))
    rows = token_model.feature_rows(rows, ("doc_id", "split", "pos", "n", "label"))
    return samples.select("doc_id", "label"), written(rows, "tokens")


#: Regularisation of the candidates, in powers of ten around the default.
STRENGTHS = (1e-6, 1e-5, 1e-4, 1e-3, 1e-2, 1e-1)


@query("model_select")
def model_select(spark, folder):
    """Token models of six strengths and their validation F1."""
    documents, rows = _model_rows(spark, folder)
    _, table_of_fits, _ = token_model.select_model(
        rows.filter("split = 'train'"), rows.filter("split = 'validation'"), documents,
        grid=STRENGTHS)
    return table_of_fits


@query("token_model_scores")
def token_model_scores(spark, folder):
    """Score of every document under a token model fitted on the training part, blended with the scan."""
    _, rows = _model_rows(spark, folder)
    weights = token_model.fit_path(rows.filter("split = 'train'"), (1e-4,))
    scored = token_model.score_path(rows, weights, ("doc_id", "pos", "n")).withColumn("p", F.col("p")[0])
    tier2 = token_model.score_documents(scored)
    texts = synthetic(spark, folder).join(tier2.withColumnRenamed("score", "t2"), "doc_id")
    scored = cl.classify_requests(texts.drop("label"), tier2="t2", windows="windows")
    return scored.select("doc_id", "label", "tier2_score", "sensitivity")


_SHAPE = "regexp_matches(word, '\\p{Nd}')"


@query("token_metrics", f"""WITH {_WORD_ROWS},
    judged AS (SELECT (contains(word, '.') OR {_SHAPE})::INT AS prediction,
        (contains(word, '@') OR contains(word, '://'))::INT AS label FROM words),
    counts AS (SELECT count(*) FILTER (prediction = 1 AND label = 1) AS tp,
        count(*) FILTER (prediction = 0 AND label = 0) AS tn,
        count(*) FILTER (prediction = 1 AND label = 0) AS fp,
        count(*) FILTER (prediction = 0 AND label = 1) AS fn, count(*) AS n FROM judged),
    rates AS (SELECT *, (tp + tn) / greatest(n, 1)::DOUBLE AS accuracy, tp / greatest(tp + fp, 1)::DOUBLE AS precision,
        tp / greatest(tp + fn, 1)::DOUBLE AS recall FROM counts)
    SELECT tp, tn, fp, fn, n, {_RATES} FROM rates""")
def token_metrics(spark, folder):
    """Confusion over the words of overlapping windows, each word counted in one of them."""
    words = cl.pinned(_documents(spark, folder), w=tk.words("text")).select(
        "doc_id", F.size("w").alias("n"), F.posexplode("w").alias("pos", "word"))
    placed = words.select("pos", F.explode(tk.window_ids(F.col("pos"), F.col("n"))).alias("window"),
                          (F.contains("word", F.lit(".")) | F.col("word").rlike(r"\p{Nd}")).cast("int").alias("prediction"),
                          (F.contains("word", F.lit("@")) | F.contains("word", F.lit("://"))).cast("int").alias("label"))
    return _round_f1(evaluate.token_metrics(placed))
