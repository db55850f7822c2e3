"""Text of server-sent-event bodies, in row.

A body is split into its ``data:`` payloads; each payload that is a JSON object gives
the text of whichever event shape it has.  No explode and no regrouping is needed, so
extraction stays a narrow projection whatever the number of events per body.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leakscope.functions.dialect import LINE_BREAK, SPACE_CHARS
from leakscope.functions.scan import regex_literal, text_literal

_SPACES = text_literal(SPACE_CHARS)
_RAW = ("content_block struct<input:string>, candidates array<struct<content:struct<"
        "parts:array<struct<functionCall:string>>>>>")
_STRING = r'"(?:[^"\\]++|\\.)*+"'


def payloads_sql(text: str) -> str:
    """Payloads of the ``data:`` lines in order, without blanks and the end marker."""
    return (f"filter(transform(filter(split({text}, {regex_literal(LINE_BREAK)}, -1), "
            f"l -> startswith(l, 'data:')), "
            f"l -> trim(BOTH {_SPACES} FROM substring(l, 6))), "
            f"p -> length(p) > 0 AND p <> '[DONE]')")


def _get(value: str, path: str) -> str:
    return f"try_variant_get({value}, '{path}', 'variant')"


def _is(value: str, kind: str) -> str:
    return f"coalesce(startswith(schema_of_variant({value}), '{kind}'), false)"


def _text(value: str, path: str) -> str:
    """The string at a path; NULL for any other type."""
    return (f"CASE WHEN {_is(_get(value, path), 'STRING')} "
            f"THEN try_variant_get({value}, '{path}', 'string') END")


def _texts(value: str, *paths: str) -> str:
    return f"concat_ws('', {', '.join(_text(value, p) for p in paths)})"


def _items(value: str, path: str) -> str:
    """Elements of the array at a path; empty for any other type."""
    return (f"CASE WHEN {_is(_get(value, path), 'ARRAY')} "
            f"THEN try_variant_get({value}, '{path}', 'array<variant>') "
            f"ELSE cast(array() AS array<variant>) END")


def spaced_json(raw: str) -> str:
    """JSON text with one space after each comma and colon and none elsewhere."""
    compact = f"regexp_replace({raw}, {regex_literal('(' + _STRING + r')|[ \t\r\n]+')}, '$1')"
    parts = regex_literal(r'\G((?:[^",:]++|' + _STRING + r')*+[,:])')
    return f"regexp_replace({compact}, {parts}, '$1 ')"


def _truthy_object(value: str) -> str:
    return f"({_is(value, 'OBJECT')} AND to_json({value}) <> '{{}}')"


def _event_text(event: str, payload: str) -> str:
    kind = _text(event, "$.type")
    block_delta = _texts(event, "$.delta.text", "$.delta.partial_json", "$.delta.thinking")
    name = _text(event, "$.content_block.name")
    raw = f"from_json({payload}, '{_RAW}')"
    block_input = _get(event, "$.content_block.input")
    block_start = (
        f"concat_ws('', CASE WHEN length({name}) > 0 THEN concat('tool:', {name}) END, "
        f"CASE WHEN {_is(block_input, 'OBJECT')} OR {_is(block_input, 'ARRAY')} "
        f"THEN {spaced_json(raw + '.content_block.input')} END, "
        f"{_text(event, '$.content_block.text')})")
    typed = (f"coalesce({_text(event, '$.delta')}, "
             f"{_texts(event, '$.delta.text', '$.delta.value', '$.delta.arguments')})")

    def choice(body: str) -> str:
        calls = (f"transform({_items(body, '$.tool_calls')}, "
                 f"t -> {_texts('t', '$.function.name', '$.function.arguments')})")
        return f"concat({_texts(body, '$.content', '$.reasoning')}, array_join({calls}, ''))"

    choices = (f"array_join(transform({_items(event, '$.choices')}, c -> "
               f"CASE WHEN {_truthy_object(_get('c', '$.delta'))} "
               f"THEN {choice(_get('c', '$.delta'))} "
               f"ELSE {choice(_get('c', '$.message'))} END), '')")
    call = (f"CASE WHEN {_is(_get('p', '$.functionCall'), 'OBJECT')} THEN "
            f"{spaced_json(f'get(get({raw}.candidates, i).content.parts, j).functionCall')} END")
    parts = (f"transform({_items('c', '$.content.parts')}, "
             f"(p, j) -> concat_ws('', {_text('p', '$.text')}, {call}))")
    candidates = (f"array_join(transform({_items(event, '$.candidates')}, "
                  f"(c, i) -> array_join({parts}, '')), '')")
    return (f"CASE WHEN {kind} = 'content_block_delta' THEN {block_delta} "
            f"WHEN {kind} = 'content_block_start' THEN {block_start} "
            f"WHEN startswith({kind}, 'response.') THEN {typed} "
            f"WHEN {_is(_get(event, '$.choices'), 'ARRAY')} THEN {choices} "
            f"WHEN {_is(_get(event, '$.candidates'), 'ARRAY')} THEN {candidates} "
            f"ELSE '' END")


def sse_text(text: str) -> Column:
    """Assistant text and tool-call payloads of all known event shapes, concatenated."""
    events = (f"transform({payloads_sql(text)}, "
              f"p -> named_struct('raw', p, 'event', try_parse_json(p)))")
    pieces = (f"transform(filter({events}, e -> {_is('e.event', 'OBJECT')}), "
              f"e -> {_event_text('e.event', 'e.raw')})")
    return F.expr(f"array_join({pieces}, '')")


def sse_fallback(text: str) -> Column:
    """Every payload as it stands, for bodies of no known shape."""
    return F.expr(f"array_join({payloads_sql(text)}, chr(10))")
