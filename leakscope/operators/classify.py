"""Score a table of texts: one chain of narrow projections per direction.

Requests run the sensitive and the destructive scan, may have values exempted that
the sender owns, blend in a token-model score and are demoted by intent.  Responses
run the destructive scan only, and any command found makes them critical.

The only shuffle is the join with owned values, one row per tenant.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leakscope.functions import scan, scoring
from leakscope.functions.catalog import (
    DESTRUCTIVE,
    IDENTITY_KIND,
    SENSITIVE,
)
from leakscope.functions.intent import classify_intent, intent_factor, is_demoted

SCAN_COLUMNS = ("_lower", "_digits", "_scannable", "_safe")
RESULT_COLUMNS = ("sensitivity", "tier1_score", "tier2_score", "label", "categories", "hits",
                  "summary", "intent", "intent_conf", "effective_sensitivity")
SAMPLE_CHARS = 400      # length of the masked excerpt kept with an event


def pinned(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that later steps refer to by value.

    A filter or an explode above a projection is rewritten in terms of the projection's
    input, which would repeat a scan of fifty patterns once per mention.  Nothing that refers
    to the output of a generator is pushed below it, so the columns are made by one, from an
    array of a single struct.  Filters on other columns still reach the file scan.
    """
    row = F.struct(*[column.alias(name) for name, column in columns.items()])
    return df.select("*", F.inline_outer(F.array(row)))


def with_scan_gates(df: DataFrame, text: str = "text") -> DataFrame:
    df = df.withColumn("_lower", F.lower(F.col(text)))
    return pinned(df, _digits=scan.digit_gate(text),
                  _scannable=scan.may_be_destructive("_lower"))


def with_sensitive_hits(df: DataFrame, text: str = "text", catalog=SENSITIVE,
                        limit: int | None = None) -> DataFrame:
    return pinned(df, re_hits=scan.sensitive_hits(text, "_lower", "_digits", catalog, limit))


def with_destructive_hits(df: DataFrame, text: str = "text", catalog=DESTRUCTIVE,
                          limit: int | None = None) -> DataFrame:
    df = pinned(df, _safe=scan.safe_spans(text, "_lower", "_scannable"))
    return pinned(df, dc_hits=scan.destructive_hits(text, "_lower", "_scannable", "_safe",
                                                    catalog, limit))


def scan_texts(df: DataFrame, text: str = "text", sensitive=SENSITIVE, destructive=DESTRUCTIVE,
               limit: int | None = None) -> DataFrame:
    """Adds ``re_hits``, ``dc_hits``, ``re_score`` and ``dc_score``."""
    df = with_scan_gates(df.withColumn(text, F.coalesce(F.col(text), F.lit(""))), text)
    df = with_sensitive_hits(df, text, sensitive, limit)
    df = with_destructive_hits(df, text, destructive, limit)
    return pinned(df, re_score=scan.hit_score("re_hits"),
                  dc_score=scan.hit_score("dc_hits")).drop(*SCAN_COLUMNS)


def exempt_owned(hits: str, owned_email: str, owned_ip: str) -> Column:
    """Hits whose value the sender owns keep their place at a token weight."""
    ip_names = ", ".join(f"'{n}'" for n, k in IDENTITY_KIND.items() if k == "ip")
    owned = (f"(h.name = 'email' AND array_contains({owned_email}, lower(trim(h.raw)))) OR "
             f"(h.name IN ({ip_names}) AND array_contains({owned_ip}, trim(h.raw)))")
    return F.expr(
        f"transform({hits}, h -> if(coalesce({owned}, false), named_struct('name', h.name, "
        f"'category', '{scoring.OWNED_CATEGORY}', 'weight', {scoring.OWNED_WEIGHT}D, "
        f"'snippet', h.snippet, 'start', h.start, 'end', h.end, 'raw', h.raw), h))")


def with_owned_values(df: DataFrame, owned: DataFrame, tenant: str = "tenant_id") -> DataFrame:
    """``owned``: tenant, kind, value rows (a few per tenant).

    Folded to one row per tenant first; the join strategy is left to the size statistics
    and to adaptive skew handling, since the number of tenants is not bounded.
    """
    def values(kind: str) -> Column:
        return F.collect_list(F.when(F.col("kind") == kind, F.col("value")))

    per_tenant = owned.groupBy(tenant).agg(values("email").alias("_owned_email"),
                                           values("ip").alias("_owned_ip"))
    joined = df.join(per_tenant, tenant, "left")
    joined = pinned(joined, _exempted=exempt_owned("re_hits", "_owned_email", "_owned_ip"))
    return joined.drop("_owned_email", "_owned_ip", "re_hits").withColumnRenamed(
        "_exempted", "re_hits")


def classify_requests(df: DataFrame, text: str = "text", path: str | None = None,
                      owned: DataFrame | None = None, tenant: str = "tenant_id",
                      tier2: str | None = None, windows: str | None = None,
                      guess: str | None = None, guess_prob: str | None = None,
                      sensitive=SENSITIVE, destructive=DESTRUCTIVE, with_sample: bool = False,
                      sample_chars: int | None = SAMPLE_CHARS,
                      limit: int | None = None) -> DataFrame:
    """Adds the result columns for request texts.  ``limit`` caps the hits of each catalog.

    ``tier2``/``windows`` name the token-model score and its window count, absent means the
    patterns alone decide; ``guess``/``guess_prob`` name a trained intent fallback.
    """
    df = scan_texts(df, text, sensitive, destructive, limit)
    if with_sample:
        df = df.withColumn("sample", scan.masked_text(text, "re_hits", sample_chars))
    if owned is not None:
        df = with_owned_values(df.drop("re_score"), owned, tenant)
        df = pinned(df, re_score=scan.hit_score("re_hits"))
    df = pinned(df, _hits=F.concat("re_hits", "dc_hits"),
                _t1=scoring.combine(F.col("re_score"), F.col("dc_score")),
                _t2=F.col(tier2).cast("double") if tier2 else F.lit(0.0),
                _trigger=scoring.trigger(F.col(windows) if windows else F.lit(0)))
    return _finish(df, text, path, guess, guess_prob, force_critical=False)


def classify_responses(df: DataFrame, text: str = "text", path: str | None = None,
                       destructive=DESTRUCTIVE, force_critical: bool = True,
                       with_sample: bool = False, sample_chars: int | None = SAMPLE_CHARS,
                       limit: int | None = None) -> DataFrame:
    """Adds the result columns for response texts: commands only, categorical."""
    df = with_scan_gates(df.withColumn(text, F.coalesce(F.col(text), F.lit(""))), text)
    if with_sample:
        df = with_sensitive_hits(df, text)
        df = df.withColumn("sample", scan.masked_text(text, "re_hits", sample_chars)).drop("re_hits")
    df = with_destructive_hits(df, text, destructive, limit).drop(*SCAN_COLUMNS)
    df = pinned(df, _hits=F.col("dc_hits"), _t1=scan.hit_score("dc_hits"), _t2=F.lit(0.0),
                _trigger=F.lit(scoring.HARD_TRIGGER))
    return _finish(df, text, path, None, None, force_critical)


def _finish(df: DataFrame, text: str, path: str | None, guess: str | None,
            guess_prob: str | None, force_critical: bool) -> DataFrame:
    if path is None:
        path, df = "_path", df.withColumn("_path", F.lit(""))
    df = pinned(df, _s=scoring.blend(F.col("_t1"), F.col("_t2")),
                _i=classify_intent(path, text, guess=guess, guess_prob=guess_prob))
    intent = F.col("_i.intent")
    effective = F.least(F.lit(1.0), F.col("_s") * intent_factor(intent))
    critical = F.size("dc_hits") > 0 if force_critical else F.lit(False)
    df = pinned(df, _demoted=is_demoted(intent), _critical=critical,
                _effective=F.when(critical, F.lit(1.0)).otherwise(effective))
    df = pinned(df, label=F.when(F.col("_critical"), F.lit("critical")).otherwise(
        scoring.clamp_label(scoring.label_for(F.col("_effective")), F.col("_demoted"))))
    df = df.withColumns({   # one projection; what a caller does not select is never computed
        "intent": intent,
        "intent_conf": scoring.rounded(F.col("_i.confidence"), 3),
        "effective_sensitivity": scoring.rounded(F.col("_effective"), 4),
        "sensitivity": scoring.rounded(F.col("_s"), 4),
        "tier1_score": scoring.rounded(F.col("_t1"), 4),
        "tier2_score": scoring.rounded(F.col("_t2"), 4),
        "categories": scoring.categories("_hits", "_t2", "_trigger"),
        "summary": scoring.summary("_hits", "_t2", "_s", "_trigger", "_i.intent", "_demoted"),
        "hits": scan.public_hits("_hits"),
    })
    return df.drop("_s", "_i", "_t1", "_t2", "_trigger", "_demoted", "_critical", "_effective",
                   "_hits", "_path", "re_hits", "dc_hits", "re_score", "dc_score")
