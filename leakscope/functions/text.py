"""Body handling: gates, decoding, JSON flattening, metadata scrubbing.

Everything is a native column expression over one row.  Byte, character and token
caps are parameters and default to the whole text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leakscope.functions.dialect import LINE_BREAK, SPACE_CHARS, jvm_regex
from leakscope.functions.scan import contains_any, regex_literal, text_literal

# --- fixed values: what counts as a scorable body ----------------------------
REQUEST_MEDIA_TYPES = (
    "application/json",
    "application/x-ndjson",
    "application/x-www-form-urlencoded",
    "application/xml",
    "application/javascript",
    "application/graphql",
    "text/",
)
RESPONSE_MEDIA_TYPES = (
    "application/json",
    "application/x-ndjson",
    "application/graphql",
    "text/event-stream",
)
NON_MODEL_SUBSTRINGS = (
    "release", "version",
    "/health", "/ping", "/livez", "/readyz", "/status",
    "/static/", "/assets/", "/cdn/", "/dist/", "/build/",
    "favicon", "robots.txt", "manifest", "sitemap",
)
NON_MODEL_EXTENSIONS = (
    ".js", ".mjs", ".css", ".map",
    ".woff", ".woff2", ".ttf", ".otf", ".eot",
    ".png", ".jpg", ".jpeg", ".gif", ".svg", ".ico", ".webp", ".avif",
    ".pdf", ".zip", ".gz", ".br",
    ".html", ".htm",
)
REPLACEMENT_SHARE = 0.05
BINARY_MAGIC = ("1F8B", "789C", "78DA")
BINARY_SHARE = 0.30
CHAT_KEYS = ('"messages"', '"prompt"', '"input"', '"contents"')

# --- fixed values: machine identifiers removed before scoring ----------------
UUID = r"(?i)\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b"
HEX_ID = r"(?i)\b[0-9a-f]{32,}\b"
ISO_TIME = (r"\b\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?"
            r"(?:Z|[+-]\d{2}:?\d{2})?\b")
ZONE_AREAS = ("Africa", "America", "Antarctica", "Asia", "Atlantic", "Australia", "Europe",
              "Indian", "Pacific")
ZONE = rf"\b(?:{'|'.join(ZONE_AREAS)})/[A-Za-z_]+(?:/[A-Za-z_]+)?\b"
LONE_ID = r"\b[A-Za-z0-9_-]{22,}={0,2}\b"
NOISE_LINES = (
    "next", "auto", "success", "true", "false", "null",
    "primary_assistant", "v1", "v2", "v3", "allow", "deny",
    "user", "assistant", "system", "text",
)


def media_type(content_type: str) -> Column:
    return F.expr(f"lower(trim(BOTH {text_literal(SPACE_CHARS)} FROM "
                  f"substring_index(coalesce({content_type}, ''), ';', 1)))")


def _starts_with_any(value: Column, prefixes: tuple[str, ...]) -> Column:
    test = F.lit(False)
    for prefix in prefixes:
        test = test | F.startswith(value, F.lit(prefix))
    return test


def request_scorable(content_type: str) -> Column:
    """Only text-shaped request bodies are scored; an undeclared type is not."""
    return _starts_with_any(media_type(content_type), REQUEST_MEDIA_TYPES)


def response_scorable(content_type: str) -> Column:
    return _starts_with_any(media_type(content_type), RESPONSE_MEDIA_TYPES)


def non_model_path(path: str) -> Column:
    """Static assets, probes and release metadata: the body is no model output."""
    bare = f"substring_index(lower(coalesce({path}, '')), '?', 1)"
    ends = " OR ".join(f"endswith({bare}, '{e}')" for e in NON_MODEL_EXTENSIONS)
    return F.expr(f"({ends}) OR {contains_any(bare, NON_MODEL_SUBSTRINGS)}")


def decode_body(body: str, content_type: str, max_bytes: int | None = None) -> Column:
    """UTF-8 text of a binary body, '' where it is absent, not text by type, or more than
    a twentieth replacement characters."""
    raw = F.col(body) if max_bytes is None else F.substring(F.col(body), 1, max_bytes)
    text = F.make_valid_utf8(raw.cast("string"))
    bad = F.length(text) - F.length(F.replace(text, F.lit("�"), F.lit("")))
    share = bad / F.greatest(F.length(text), F.lit(1))
    return F.when(F.col(body).isNull() | ~request_scorable(content_type)
                  | (share > REPLACEMENT_SHARE), F.lit("")).otherwise(text)


def looks_binary(body: str) -> Column:
    """Compressed by magic number, or many control bytes in the body."""
    head = f"decode({body}, 'ISO-8859-1')"
    control = f"length(regexp_replace({head}, r'[ -~\\x80-\\xff\\t-\\r]+', ''))"
    magic = ", ".join(f"'{m}'" for m in BINARY_MAGIC)
    return F.expr(
        f"coalesce(octet_length({body}) > 0 AND (hex(substring({body}, 1, 2)) IN ({magic}) "
        f"OR {control} / greatest(length({head}), 1) > {BINARY_SHARE}D), false)")


def looks_chat(text: str) -> Column:
    """A chat payload by its quoted keys, or a flattened one by its role and type words."""
    head = f"coalesce({text}, '')"
    words = []
    for word in ("user", "text"):
        words.append(contains_any(f"lower({head})", (f"\n{word}\n", f" {word} ")))
    return F.expr(f"{contains_any(head, CHAT_KEYS)} OR ({' AND '.join(words)})")


_JSON_STRING = r'"(?:[^"\\]++|\\.)*+"(?:[ \t\r\n]*+:)?'


def json_leaves(text: str) -> Column:
    """String values of a JSON text in document order; NULL if it is not JSON.

    The string literals are cut out by one regex (possessive, so it neither backtracks nor
    recurses); a literal followed by a colon is a key.  One parse unescapes the rest.
    """
    literals = (f"filter(regexp_extract_all({text}, {regex_literal(_JSON_STRING)}, 0), "
                f"v -> NOT endswith(v, ':'))")
    return F.expr(
        f"CASE WHEN from_json({text}, 'variant', map('maxStringLen', '2147483647')) IS NOT NULL THEN "
        f"from_json(concat('[', array_join({literals}, ','), ']'), 'array<string>', "
        f"map('maxStringLen', '2147483647')) END")


def flatten_json(text: str, content_type: str) -> Column:
    """String leaves joined by newline for JSON bodies, the text itself otherwise."""
    leaves = json_leaves(text)
    return F.when(
        F.contains(F.lower(F.coalesce(F.col(content_type), F.lit(""))), F.lit("json")),
        F.coalesce(F.when(F.size(leaves) > 0, F.array_join(leaves, "\n")), F.col(text)),
    ).otherwise(F.col(text))


def scrub_metadata(text: str) -> Column:
    """Remove machine identifiers; drop lines that hold nothing else.

    Each replacement is guarded by a cheap test of what its pattern must contain.
    """
    def removed(value: str, pattern: str, guard: str) -> str:
        regex = regex_literal(jvm_regex(pattern))
        return f"CASE WHEN {guard} THEN regexp_replace({value}, {regex}, '') ELSE {value} END"

    hexes = f"{text} rlike r'[0-9a-fA-F]{{8}}'"
    areas = contains_any(text, [a + "/" for a in ZONE_AREAS])
    body = removed(text, UUID, hexes)
    body = removed(f"({body})", HEX_ID, hexes)
    body = removed(f"({body})", ISO_TIME, rf"{text} rlike r'\p{{Nd}}T\p{{Nd}}'")
    body = removed(f"({body})", ZONE, areas)
    spaces = text_literal(SPACE_CHARS)
    noise = ", ".join(f"'{t}'" for t in NOISE_LINES)
    lone = regex_literal(jvm_regex(r"\A" + LONE_ID + r"\z"))
    line = f"trim(BOTH {spaces} FROM l)"
    keep = (f"length({line}) > 0 AND lower({line}) NOT IN ({noise}) "
            f"AND NOT ({line} rlike {lone}) "
            f"AND (length({line}) > 2 OR {line} rlike r'\\p{{L}}')")
    return F.expr(
        f"array_join(filter(transform(split({body}, {regex_literal(LINE_BREAK)}, -1), "
        f"l -> trim(TRAILING {spaces} FROM l)), l -> {keep}), chr(10))")


def collapse_whitespace(text: str) -> Column:
    spaces = text_literal(SPACE_CHARS)
    gaps = regex_literal(jvm_regex(r"\s+"))
    return F.expr(f"trim(BOTH {spaces} FROM regexp_replace({text}, {gaps}, ' '))")
