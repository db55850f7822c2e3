"""Labels, blending and the one-line summary."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values ------------------------------------------------------------
LABEL_FLOORS = (("critical", 0.85), ("high", 0.65), ("medium", 0.40), ("low", 0.15))
LABELS = ("clean", "low", "medium", "high", "critical")
TIER2_WEIGHT = 0.55
TOP_WINDOWS = 5
SOFT_TRIGGER, HARD_TRIGGER = 0.1, 0.5
OWNED_CATEGORY, OWNED_WEIGHT = "user_identity", 0.05
BANDS = (("high", 65), ("medium", 40), ("low", 15))


def label_for(score: Column) -> Column:
    chain = F
    for name, floor in LABEL_FLOORS:
        chain = chain.when(score >= floor, F.lit(name))
    return chain.otherwise(F.lit("clean"))


def label_rank(label: Column) -> Column:
    return F.array_position(F.array(*[F.lit(x) for x in LABELS]), label) - 1


def clamp_label(label: Column, demoted: Column) -> Column:
    """A demoted request shows as low at most."""
    return F.when(demoted & (label_rank(label) > 1), F.lit("low")).otherwise(label)


def combine(first: Column, second: Column) -> Column:
    """Two independent saturating signals."""
    return first + (F.lit(1.0) - first) * second


def blend(tier1: Column, tier2: Column) -> Column:
    """The stronger signal, amplified by the weaker one."""
    base = F.greatest(tier1, tier2)
    return F.least(F.lit(1.0),
                   base + (F.lit(1.0) - base) * F.least(tier1, tier2) * TIER2_WEIGHT)


def trigger(windows: Column) -> Column:
    """A mean over many windows runs lower, so it is held to a lower threshold."""
    return F.when(windows >= TOP_WINDOWS, SOFT_TRIGGER).otherwise(HARD_TRIGGER)


def rounded(value: Column, places: int) -> Column:
    """Round with ties going up, whichever way the last bit of a product fell."""
    return F.round(value + F.lit(1e-12), places)


def band(average: Column) -> Column:
    """Colour band of an average score in whole per cent."""
    percent = F.floor(average * 100 + 0.5)
    chain = F
    for name, floor in BANDS:
        chain = chain.when(percent >= floor, F.lit(name))
    return chain.otherwise(F.lit("clean"))


def categories(hits: str, tier2: str, threshold: str) -> Column:
    """Distinct sorted categories; ``semantic`` where only the token model fired."""
    found = f"array_sort(array_distinct(transform({hits}, h -> h.category)))"
    return F.expr(f"CASE WHEN size({hits}) > 0 THEN {found} "
                  f"WHEN {tier2} >= {threshold} THEN array('semantic') "
                  f"ELSE cast(array() AS array<string>) END")


def top_names_sql(hits: str, k: int = 3) -> str:
    """Most frequent hit names with counts, ties by first appearance."""
    names = f"transform({hits}, h -> h.name)"
    counted = (f"transform(array_distinct({names}), (n, i) -> named_struct("
               f"'less', -size(filter({names}, x -> x = n)), 'nth', i, 'name', n))")
    return (f"array_join(transform(slice(array_sort({counted}), 1, {k}), "
            f"t -> concat(replace(t.name, '_', ' '), ' ×', cast(-t.less AS string))), ', ')")


def top_names(hits: str, k: int = 3) -> Column:
    return F.expr(top_names_sql(hits, k))


def summary(hits: str, tier2: str, sensitivity: str, threshold: str, intent: str,
            demoted: str) -> Column:
    """One sentence per finding, in a fixed order."""
    other = (f"filter({hits}, h -> NOT startswith(h.category, 'destructive:') "
             f"AND h.category <> '{OWNED_CATEGORY}')")
    commands = f"filter({hits}, h -> startswith(h.category, 'destructive:'))"
    owned = f"filter({hits}, h -> h.category = '{OWNED_CATEGORY}')"
    shown = f"format_string('%.2f', {tier2})"
    findings = (
        f"concat_ws('. ', "
        f"CASE WHEN size({other}) > 0 THEN concat('Detected ', {top_names_sql(other)}) END, "
        f"CASE WHEN size({commands}) > 0 THEN "
        f"concat('destructive command(s): ', {top_names_sql(commands)}) END, "
        f"CASE WHEN size({owned}) > 0 THEN concat('recognised user identity ×', "
        f"cast(size({owned}) AS string), ' (exempt)') END, "
        f"CASE WHEN {tier2} >= {threshold} THEN "
        f"concat('semantic model flagged sensitive content (p=', {shown}, ')') END, "
        f"CASE WHEN size({hits}) = 0 AND {tier2} < {threshold} THEN "
        f"concat('low-confidence semantic signal (p=', {shown}, ')') END, "
        f"CASE WHEN {demoted} THEN concat('demoted to low (intent=', {intent}, ')') END)")
    return F.expr(
        f"CASE WHEN size({hits}) = 0 AND {sensitivity} < 0.15D THEN "
        f"'No sensitive content detected.' ELSE concat({findings}, '.') END")
