"""Words, token shape features, windows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leakscope.functions.dialect import NOT_SPACE, SPACE
from leakscope.functions.scan import regex_literal

# --- fixed values ------------------------------------------------------------
END_OF_WORD = "</w>"
WINDOW, STRIDE = 200, 150
N_FEATURES = 9
_WORD = f"{NOT_SPACE}+"
_UPPER, _NOT_UPPER = r"\p{Lu}", r"[\p{Ll}\p{Lt}]"
LETTER_OR_NUMBER = r"\p{L}\p{N}"


def words_sql(text: str) -> str:
    return f"regexp_extract_all(lower({text}), {regex_literal(_WORD)}, 0)"


def words(text: str) -> Column:
    return F.expr(words_sql(text))


def shape_features_sql(token: str) -> str:
    """Nine shape features of a token; the end-of-word marker does not count."""
    bare = f"if(contains({token}, '{END_OF_WORD}'), regexp_replace({token}, '{END_OF_WORD}$', ''), {token})"
    s = "_bare"

    def flag(test: str) -> str:
        return f"cast({test} AS double)"

    def has(regex: str) -> str:
        return f"({s} rlike {regex_literal(regex)})"

    features = (
        flag(has(r"^\p{Nd}+$")),
        flag(has(r"\p{Nd}")),
        flag(f"{has(_UPPER)} AND NOT {has(_NOT_UPPER)}"),
        flag(has(_UPPER)),
        flag(has(f"[^{LETTER_OR_NUMBER}{SPACE}]")),
        flag(f"contains({s}, '@')"),
        flag(f"contains({s}, '-')"),
        flag(f"contains({s}, '.')"),
        f"least(length({s}), 20) / 20D",
    )
    shapes = (f"CASE WHEN length({s}) = 0 THEN array_repeat(0D, {N_FEATURES}) "
              f"ELSE array({', '.join(features)}) END")
    return f"transform(array({bare}), {s} -> {shapes})[0]"   # the marker is taken off once


def shape_features(token: str) -> Column:
    return F.expr(shape_features_sql(token))


def window_starts_sql(n: str, width: int = WINDOW, stride: int = STRIDE,
                      max_tokens: int | None = None) -> str:
    """Start of every window over n tokens; the last one reaches the end of the text."""
    size = f"least({n}, {max_tokens})" if max_tokens is not None else n
    last = f"cast(greatest({size} - {width} + {stride - 1}, 0) div {stride} AS int) * {stride}"
    return (f"CASE WHEN {n} > 0 THEN sequence(0, {last}, {stride}) "
            f"ELSE cast(array() AS array<int>) END")


def window_starts(n: str, width: int = WINDOW, stride: int = STRIDE,
                  max_tokens: int | None = None) -> Column:
    return F.expr(window_starts_sql(n, width, stride, max_tokens))


def window_ids(pos: Column, n: Column, width: int = WINDOW, stride: int = STRIDE) -> Column:
    """The one or two windows that token ``pos`` of ``n`` lies in, by arithmetic."""
    last = F.floor(F.greatest(n - width + (stride - 1), F.lit(0)) / stride)
    first = F.floor(F.greatest(pos - width + stride, F.lit(0)) / stride)
    return F.sequence(F.least(first, last).cast("int"),
                      F.least(F.floor(pos / stride), last).cast("int"))


def overlaps_any(start: str, end: str, spans: str) -> Column:
    """1 where the token [start, end) touches one of the spans."""
    return F.expr(f"cast({end} > {start} AND exists({spans}, "
                  f"s -> {start} < s[1] AND s[0] < {end}) AS int)")
