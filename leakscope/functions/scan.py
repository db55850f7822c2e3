"""Pattern scan as native column expressions.

``sensitive_hits`` / ``destructive_hits`` give one array of hit structs per text:

    name, category, weight, snippet, start, end, raw

Character positions come from ``split``: the pieces between the matches and the
matches themselves alternate, so a running length over both is the span of every
match.  One ``aggregate`` per scan walks all patterns; per pattern only the
literal regex and its cheap needle test are unrolled.  The expressions are written
as SQL text because a catalog of fifty patterns is one parse that way.

All builders take column *names*.  ``lowered`` is ``lower(text)`` and ``digits`` is
``digit_gate(text)``; callers keep them as columns so that they are computed once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from leakscope.functions.catalog import (
    DESTRUCTIVE,
    DESTRUCTIVE_KEYWORDS,
    HIT_GAIN,
    SAFE,
    SENSITIVE,
    Pattern,
)
from leakscope.functions.dialect import SPACE_CHARS, jvm_regex

HIT_TYPE = ("array<struct<name:string,category:string,weight:double,snippet:string,"
            "start:int,end:int,raw:string>>")
_SPAN_TYPE = "array<struct<start:int,end:int,raw:string>>"
DIGIT_GATE = r"\p{Nd}[\p{Nd}.]"


def regex_literal(regex: str) -> str:
    """A regex as a raw SQL string literal."""
    return "r'" + regex.replace("'", r"\x27") + "'"


def text_literal(text: str) -> str:
    """Any text as a SQL string literal that needs no escapes."""
    return "'" + "".join(c if c.isalnum() or c in " -_:./@(){}=,*;" else f"\\u{ord(c):04x}"
                         for c in text) + "'"


def contains_any(text: str, needles: Sequence[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, {text_literal(n)})" for n in needles) + ")"


def gate_sql(pattern: Pattern, text: str, lowered: str, digits: str) -> str:
    tests = []
    if pattern.digits:
        tests.append(digits)
    if pattern.needles:
        tests.append(contains_any(text, pattern.needles))
    if pattern.needles_lower:
        tests.append(contains_any(lowered, pattern.needles_lower))
    return " AND ".join(tests) if tests else "true"


def digit_gate(text: str) -> Column:
    """Two digits in a row or digit-dot: no numeric pattern can match without."""
    return F.expr(f"{text} rlike r'{DIGIT_GATE}'")


def luhn_sql(value: str) -> str:
    """13 to 19 digits, spaces and dashes aside, with a valid check digit."""
    bare = f"regexp_replace({value}, '[ -]', '')"
    return f"(length({bare}) BETWEEN 13 AND 19 AND coalesce(luhn_check({bare}), false))"


def matches_sql(pattern: Pattern, text: str, lowered: str, digits: str) -> str:
    """All accepted matches of one pattern in order; NULL where its needles are missing."""
    found = f"regexp_extract_all({text}, {regex_literal(jvm_regex(pattern.scanned))}, 0)"
    if pattern.luhn:
        found = f"filter({found}, v -> {luhn_sql('v')})"
    return f"CASE WHEN {gate_sql(pattern, text, lowered, digits)} THEN {found} END"


def mask_sql(value: str) -> str:
    """Keep two characters at each end; up to six characters vanish altogether."""
    return (f"CASE WHEN length({value}) <= 6 THEN repeat('*', length({value})) ELSE "
            f"concat(left({value}, 2), repeat('*', length({value}) - 4), right({value}, 2)) END")


def snippet_sql(value: str) -> str:
    """A command as written, its middle elided beyond 120 characters."""
    body = f"trim(BOTH {text_literal(SPACE_CHARS)} FROM {value})"
    return (f"CASE WHEN length({body}) <= 120 THEN {body} ELSE "
            f"concat(left({body}, 80), '…', right({body}, 30)) END")


def _pieces(catalog: Sequence[Pattern], text: str, lowered: str, digits: str) -> str:
    """Per pattern its matches and the text between them; patterns without any are left out.

    Both are cut out by a literal regex, and the second only where the first found something.
    """
    rows = []
    for p in catalog:
        regex = regex_literal(jvm_regex(p.scanned))
        gate = gate_sql(p, text, lowered, digits)
        rows.append(
            f"transform(array(CASE WHEN {gate} THEN regexp_extract_all({text}, {regex}, 0) END), f -> "
            f"named_struct('name', '{p.name}', 'category', '{p.category}', "
            f"'weight', {p.weight}D, 'luhn', {str(p.luhn).lower()}, 'found', f, "
            f"'gaps', CASE WHEN size(f) > 0 THEN split({text}, {regex}, -1) END))[0]")
    return f"filter(array({', '.join(rows)}), p -> size(p.found) > 0)"


def _spans(pattern: str, accept: str, limit: int | None) -> str:
    """Accepted matches of one pattern with their character spans, in one pass."""
    start, end = "(s.at + length(m.gaps))", "(s.at + length(m.gaps) + length(m.found))"
    keep = accept.format(start=start, end=end, raw="m.found", pattern=pattern)
    if limit is not None:
        keep = f"size(s.spans) < {limit} AND {keep}"
    return (
        f"aggregate(slice(arrays_zip({pattern}.found, {pattern}.gaps), "
        f"1, size({pattern}.found)), "
        f"named_struct('at', 0, 'spans', cast(array() AS {_SPAN_TYPE})), "
        f"(s, m) -> named_struct('at', {end}, 'spans', if({keep}, concat(s.spans, "
        f"array(named_struct('start', {start}, 'end', {end}, 'raw', m.found))), s.spans)), "
        f"s -> s.spans)")


def _hits(pieces: str, accept: str, snippet, limit: int | None) -> str:
    hits = (
        f"flatten(transform({pieces}, p -> transform({_spans('p', accept, limit)}, "
        f"h -> named_struct('name', p.name, 'category', p.category, 'weight', p.weight, "
        f"'snippet', {snippet('h.raw')}, 'start', h.start, 'end', h.end, 'raw', h.raw))))")
    return f"slice({hits}, 1, {limit})" if limit is not None else hits


def sensitive_hits(text: str, lowered: str, digits: str,
                   catalog: Sequence[Pattern] = SENSITIVE,
                   limit: int | None = None) -> Column:
    """Every accepted match, or the first `limit` in catalog order."""
    return F.expr(sensitive_hits_sql(text, lowered, digits, catalog, limit))


def sensitive_hits_sql(text: str, lowered: str, digits: str,
                       catalog: Sequence[Pattern] = SENSITIVE, limit: int | None = None) -> str:
    accept = f"(NOT {{pattern}}.luhn OR {luhn_sql('{raw}')})"
    hits = _hits(_pieces(catalog, text, lowered, digits), accept, mask_sql, limit)
    return f"coalesce({hits}, cast(array() AS {HIT_TYPE}))"


def may_be_destructive(lowered: str) -> Column:
    """Cheap reject: without any of the keywords there is nothing to scan for."""
    return F.expr(contains_any(lowered, DESTRUCTIVE_KEYWORDS))


def safe_spans(text: str, lowered: str, scannable: str,
               catalog: Sequence[Pattern] = SAFE) -> Column:
    """Spans of the safe idioms, where the text is to be scanned for commands at all."""
    pieces = _pieces(catalog, text, lowered, "true")
    spans = f"flatten(transform({pieces}, p -> {_spans('p', 'true', None)}))"
    return F.expr(f"CASE WHEN {scannable} THEN {spans} END")


def destructive_hits(text: str, lowered: str, scannable: str, safe: str | None,
                     catalog: Sequence[Pattern] = DESTRUCTIVE,
                     limit: int | None = None) -> Column:
    """Command hits; one that overlaps a safe span is dropped (``safe=None`` keeps all)."""
    accept = "true" if safe is None else (
        f"NOT exists({safe}, q -> {{start}} < q.end AND q.start < {{end}})")
    hits = _hits(_pieces(catalog, text, lowered, "true"), accept, snippet_sql, limit)
    return F.expr(f"CASE WHEN {scannable} THEN {hits} "
                  f"ELSE cast(array() AS {HIT_TYPE}) END")


def saturating_score(weights: str) -> Column:
    """Every hit takes a share of the headroom the earlier ones left; order does not matter."""
    return F.expr(f"least(1D, aggregate({weights}, 0D, "
                  f"(s, w) -> s + w * (1D - s) * {HIT_GAIN}D))")


def hit_score(hits: str) -> Column:
    return saturating_score(f"transform({hits}, h -> h.weight)")


def masked_text(text: str, hits: str, chars: int | None = None) -> Column:
    """Replace hits by their snippets, last one first; a hit reaching into one already
    replaced is left out.  Snippets are as long as what they replace.  With ``chars`` the
    result is cut there, and every hit that reaches into it is masked."""
    body, edge = text, f"length({text}) + 1"
    if chars is not None:
        hits = f"filter({hits}, h -> h.start < {chars})"
        # what is cut off cannot come back, however much shorter than its match a snippet is
        body = f"left({text}, {chars} + aggregate({hits}, 0, (s, h) -> s + h.end - h.start))"
        edge = "2147483647"
    masked = f"""
        aggregate(
          array_sort(transform({hits}, (h, i) -> named_struct(
              'key', -h.start, 'nth', i, 'start', h.start, 'end', h.end,
              'snippet', h.snippet))),
          named_struct('body', {body}, 'edge', {edge}),
          (s, h) -> if(h.end <= s.edge,
              named_struct('body',
                  overlay(s.body PLACING h.snippet FROM h.start + 1 FOR h.end - h.start),
                  'edge', h.start),
              s),
          s -> s.body)"""
    return F.expr(masked if chars is None else f"left({masked}, {chars})")


def public_hits(hits: str) -> Column:
    """Hits as stored: without positions and without the matched value."""
    return F.expr(f"transform({hits}, h -> named_struct('name', h.name, "
                  f"'category', h.category, 'weight', h.weight, 'snippet', h.snippet))")
