"""Secret scan with multipart credential linking.

Three strong patterns are reported wherever they match. A credential often comes in parts, of
which each alone proves nothing: an identifier, a secret of no known form, the endpoint it is
for. Such weak parts are collected as intervals of their document and joined within scopes: a
weak part is reported only if a complementary part stands within RADIUS characters of it.

The join does not list pairs. Intervals fall into bins of RADIUS characters; each bin keeps,
for each role, where its parts begin and end, and a part looks into the bins its scope meets.
So a text of a million parts yields as many rows, and no bin is larger than its extremes.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leakscope.llm.common import row_id, stored, text_of

RADIUS = 200

# Fixed patterns of the strong kinds: (kind, pattern, group that is measured, least characters).
STRONG = (
    ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]+", 0, 16),
)
#: Weak parts: (kind, role, pattern, group). They count only beside a complementary role.
WEAK = (
    ("ident", "identifier", r"\b(?:user(?:name)?|login|client_?id|account)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9_.@-]{3,})", 0),
    ("weakpass", "secret", r"\b(?:password|passwd|pwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]{4,})", 0),
    ("opaque", "secret", r"(?<![A-Za-z0-9+/=_-])(?=[A-Za-z+/_-]*[0-9])(?=[A-Z0-9+/_-]*[a-z])(?=[a-z0-9+/_-]*[A-Z])[A-Za-z0-9+/_-]{24,}={0,2}(?![A-Za-z0-9+/=_-])", 0),
    ("endpoint", "endpoint", r"\b(?:https?|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp|s3)://[^\s\"'<>]{3,}", 0),
)
KINDS = tuple(k for k, *_ in STRONG) + tuple(k for k, *_ in WEAK)
ROLE = {kind: role for kind, role, *_ in WEAK} | {"assign": "secret", "access": "identifier", "hex": "secret"}
#: Roles of which one must stand near a weak part of the role.
COMPLEMENTS = {"identifier": ("secret",), "secret": ("identifier", "endpoint"), "endpoint": ("secret",)}

_ASSIGN = re.compile(STRONG[0][1], re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(STRONG[1][1])
# runs are maximal, so the least length can stand in the pattern
_HEX = re.compile(r"[0-9a-f]{16,}")
_WEAK = tuple((kind, re.compile(pattern, re.ASCII | (re.IGNORECASE if kind != "opaque" else 0))) for kind, _, pattern, _ in WEAK)
_CUES = re.compile(r"pass|pwd|secret|token|api_?key|user|login|client|account|://|AKIA", re.IGNORECASE | re.ASCII)
_OPAQUE_CUE = re.compile(r"[A-Za-z0-9+/_-]{24,}")


def strong_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the strong kinds, code points, end exclusive; each kind leftmost
    first without overlaps, its matches that are too short dropped after they are taken."""
    out = [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def weak_spans(text: str, strong: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Weak parts that do not touch a strong span."""
    out = []
    if not _CUES.search(text) and not _OPAQUE_CUE.search(text):
        return out
    starts, ends = [s for s, *_ in strong], list(accumulate((e for _, e, _ in strong), max))
    for start, end, kind in sorted((m.start(), m.end(), kind) for kind, p in _WEAK for m in p.finditer(text)):
        before = bisect_left(starts, end)  # strong spans that begin before this one ends
        if not before or ends[before - 1] <= start:
            out.append((start, end, kind))
    return out


def _joined(spans) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


PART = "array<struct<start:int,end:int,kind:string>>"


def _scan(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in texts:
        strong = [strong_spans(t) for t in batch]
        weak = [weak_spans(t, s) for t, s in zip(batch, strong)]
        as_rows = lambda spans: [{"start": s, "end": e, "kind": k} for s, e, k in spans]
        yield pd.DataFrame({"strong": [as_rows(s) for s in strong], "weak": [as_rows(w) for w in weak],
                            "base": [_joined(s) for s in strong]})


def _linked(parts: DataFrame, radius: int) -> DataFrame:
    """Weak parts with a complementary part in scope: (rid, name, start, end, kind)."""
    role = F.element_at(F.create_map(*[F.lit(x) for pair in ROLE.items() for x in pair]), F.col("kind"))
    parts = parts.withColumn("role", role)
    # a part begins in one bin and ends in another: it is known in each bin it meets
    bins = (parts.select("rid", "name", "role", "start", "end",
                         F.explode(F.sequence(F.floor(F.col("start") / radius), F.floor((F.col("end") - 1) / radius))).alias("bin"))
            .groupBy("rid", "name", "bin", "role").agg(F.min("start").alias("first"), F.max("end").alias("last")))
    wanted = F.element_at(F.create_map(*[x for r, c in COMPLEMENTS.items() for x in (F.lit(r), F.array(*map(F.lit, c)))]), F.col("role"))
    seek = (parts.where(F.col("kind").isin([k for k, *_ in WEAK]))
            .select("rid", "name", "start", "end", "kind", F.explode(wanted).alias("role"))
            .withColumn("lo", F.col("start") - radius).withColumn("hi", F.col("end") + radius)
            .withColumn("bin", F.explode(F.sequence(F.floor(F.greatest(F.col("lo"), F.lit(0)) / radius), F.floor(F.col("hi") / radius)))))
    return (seek.join(bins, ["rid", "name", "bin", "role"]).where("first < hi and last > lo")
            .select("rid", "name", "start", "end", "kind").distinct())


def find_secrets(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, strong, linked, base for every row of `docs` (doc_id, text).

    `strong` and `linked` are arrays of (start, end, kind) by start, then kind as listed, in
    code points, end exclusive; `base` is the strong ones as text. Whole texts are read; null
    and empty texts hold nothing. Rows that share doc_id and text share their spans and are
    repeated in the result. Other columns are not looked at.
    """
    scan = F.pandas_udf(_scan, f"strong {PART}, weak {PART}, base string")
    found = stored(docs.select("doc_id", row_id().alias("rid"), F.xxhash64(text_of()).alias("name"), scan(text_of()).alias("s"))
                   .select("doc_id", "rid", "name", "s.strong", "s.weak", "s.base"), "spans")
    parts = (found.where(F.size("weak") > 0).select("rid", "name", F.explode(F.concat("strong", "weak")).alias("p"))
             .select("rid", "name", "p.start", "p.end", "p.kind").distinct())
    place = F.element_at(F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))]), F.col("kind"))
    linked = (_linked(parts, radius).groupBy("rid", "name")
              .agg(F.array_sort(F.collect_list(F.struct("start", place.alias("place"), "end", "kind"))).alias("l")))
    linked = stored(linked, "linked")
    as_span = F.transform("l", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind")))
    return (found.join(linked, ["rid", "name"], "left")
            .select("doc_id", "strong", F.coalesce(as_span, F.array().cast(PART)).alias("linked"), "base"))


def all_spans(strong, linked):
    """All spans as text: by start, then kind as listed, joined by commas."""
    order = {k: i for i, k in enumerate(KINDS)}
    place = F.create_map(*[x for k, i in order.items() for x in (F.lit(k), F.lit(i))])
    keyed = F.array_sort(F.transform(F.concat(strong, linked), lambda x: F.struct(
        x["start"].alias("start"), place[x["kind"]].alias("place"), x["end"].alias("end"), x["kind"].alias("kind"))))
    return F.array_join(F.transform(keyed, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
