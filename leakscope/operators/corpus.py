"""Labelled corpus: given texts with sensitive values written into some of them.

Every choice is a hash of the row id and a salt. A row depends on its id and its text alone,
so the corpus is the same however it is partitioned, and a lost task rebuilds the same rows.

A sensitive clause is a frame around the name of a thing and a fresh value of it. Frames and
things are drawn apart from each other, so each value kind is seen in every frame.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leakscope.functions.text import collapse_whitespace

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
DIGITS = "0123456789"
WORD = UPPER + LOWER + DIGITS

#: Half of the rows are labelled; a labelled row holds one to MOST clauses.
MOST = 3
#: Before the name, between name and value, after the value.
FRAMES = (
    ("", ": ", "."),
    ("for the record, the ", " is ", " until further notice."),
    ("(", " = ", ")"),
    ("somebody pasted the ", " '", "' into the ticket."),
    ("does ", " ", " still work?"),
)
#: Each kind of value and what a clause calls it.
THINGS = {
    "email": "mail address",
    "phone": "call back number",
    "ssn": "social security number",
    "credit_card": "card",
    "iban": "bank account",
    "aws_key": "cloud key id",
    "aws_secret": "aws secret access key",
    "api_key": "api key",
    "github_token": "repository token",
    "jwt": "session cookie",
    "password": "root password",
    "db_url": "database",
    "internal_host": "build machine",
    "internal_ip": "gateway",
    "private_key": "signing key",
}
NAMES = ("orla", "pavel", "quentin", "rania", "sten", "tamsin", "ugo")
SITES = ("lantern.example", "orchard.example", "pebble.example")


def draw(salt: str, choices: int, ident: str = "id") -> str:
    """A number in [0, choices) that depends on the id and the salt."""
    return f"cast(pmod(xxhash64({ident}, '{salt}'), {choices}) AS int)"


def one_of(salt: str, values, ident: str = "id") -> str:
    listed = ", ".join("'" + v.replace("'", "\\'") + "'" for v in values)
    return f"get(array({listed}), {draw(salt, len(values), ident)})"


def run_of(salt: str, alphabet: str, size: int, ident: str = "id") -> str:
    """A string of `size` characters, each drawn on its own."""
    return (f"array_join(transform(sequence(1, {size}), k -> substr('{alphabet}', "
            f"cast(pmod(xxhash64({ident}, '{salt}', k), {len(alphabet)}) AS int) + 1, 1)), '')")


def _card(salt: str, ident: str) -> str:
    """Fifteen drawn digits after a 4 and the digit that makes their weighted sum a ten."""
    body = f"concat('4', {run_of(salt, DIGITS, 14, ident)})"
    twice = "(int(substr(c, k, 1)) * 2)"
    total = (f"aggregate(sequence(1, 15), 0, (t, k) -> t + if(k % 2 = 1, "
             f"cast({twice} div 10 + {twice} % 10 AS int), int(substr(c, k, 1))))")
    return f"transform(array({body}), c -> concat(c, cast(pmod(-{total}, 10) AS string)))[0]"


def value_makers(salt: str, ident: str = "id") -> dict[str, str]:
    """The kinds of sensitive value as SQL expressions over the id; lengths and first
    characters are those the patterns ask for."""
    def run(part: str, alphabet: str, size: int) -> str:
        return run_of(f"{salt}/{part}", alphabet, size, ident)

    def pick(part: str, values) -> str:
        return one_of(f"{salt}/{part}", values, ident)

    return {
        "email": f"concat({pick('name', NAMES)}, '_', {run('mail', LOWER, 5)}, '@', {pick('site', SITES)})",
        "phone": f"concat('(4', {run('area', DIGITS, 2)}, ') ', {run('mid', DIGITS[2:], 3)}, '-', {run('line', DIGITS, 4)})",
        "ssn": f"concat('4', {run('a', DIGITS, 2)}, '-', {run('b', DIGITS, 2)}, '-', {run('c', DIGITS, 4)})",
        "credit_card": _card(f"{salt}/card", ident),
        "iban": f"concat({pick('land', ('DE', 'FR', 'ES', 'NL'))}, {run('iban', DIGITS, 18)})",
        "aws_key": f"concat('AK', 'IA', {run('aws', UPPER + DIGITS, 16)})",
        "aws_secret": run("secret", WORD + "/+", 40),
        "api_key": f"concat('sk', '-', {run('api', WORD, 32)})",
        "github_token": f"concat('gh', 's_', {run('gh', WORD, 34)})",
        "jwt": f"concat('ey', 'J', {run('head', WORD, 18)}, '.', {run('claims', WORD, 30)}, '.', {run('sign', WORD, 24)})",
        "password": run("password", WORD + "-_.:", 16),
        "db_url": f"concat({pick('engine', ('mysql', 'redis', 'postgres'))}, '://', {pick('user', NAMES)}, ':', "
                  f"{run('dbpass', WORD, 9)}, '@', {pick('dbsite', SITES)}, '/main')",
        "internal_host": f"concat('n', {run('node', DIGITS, 2)}, '.', {pick('zone', ('corp', 'dev', 'staging'))}, '.', {pick('home', SITES)})",
        "internal_ip": f"concat('192.168.', {draw(salt + '/x', 256, ident)}, '.', {draw(salt + '/y', 256, ident)})",
        "private_key": "concat('-----BEGIN OPENSSH ', 'PRIVATE KEY-----')",
    }


def sensitive_clause(slot: int, ident: str = "id") -> str:
    """A frame around a thing and its value, all drawn."""
    salt = f"clause{slot}"
    values = value_makers(salt, ident)
    kinds = tuple(THINGS)
    made = " ".join(f"WHEN {i} THEN named_struct('name', '{THINGS[k]}', 'value', {values[k]})" for i, k in enumerate(kinds))
    frames = ", ".join("named_struct('a', '{}', 'b', '{}', 'c', '{}')".format(*(x.replace("'", "\\'") for x in f)) for f in FRAMES)
    thing = f"CASE {draw(salt + '/kind', len(kinds), ident)} {made} END"
    frame = f"get(array({frames}), {draw(salt + '/frame', len(FRAMES), ident)})"
    return f"transform(array(named_struct('t', {thing}, 'f', {frame})), x -> concat(x.f.a, x.t.name, x.f.b, x.t.value, x.f.c))[0]"


def samples(rows: DataFrame, ident: str = "id", text: str = "text") -> DataFrame:
    """`rows` with text, label and spans (character ranges of the sensitive clauses).

    The text is the given one with its white space collapsed, whole; clauses stand between its
    sentences, at drawn places. A null text is an empty one.
    """
    df = (rows.withColumn("label", F.expr(draw("label", 2, ident)))
          .withColumn("_count", F.expr(f"if(label = 1, 1 + {draw('count', MOST, ident)}, 0)"))
          .withColumn("_text", F.coalesce(F.col(text), F.lit(""))).withColumn("_text", collapse_whitespace("_text"))
          .withColumn("_sentences", F.expr(r"filter(split(_text, r'(?<=[.!?]) '), s -> s <> '')")))
    clauses = ", ".join(sensitive_clause(slot, ident) for slot in range(MOST))
    df = df.withColumn("_clauses", F.expr(f"slice(array({clauses}), 1, _count)"))
    # a sentence sorts at an odd key, a clause at the even one before a drawn sentence
    df = df.withColumn("_parts", F.expr(
        f"array_sort(concat(transform(_sentences, (s, i) -> named_struct('key', 2 * i + 1, 'nth', 0, 'text', s, 'hot', false)), "
        f"transform(_clauses, (c, i) -> named_struct('key', 2 * cast(pmod(xxhash64({ident}, 'place', i), size(_sentences) + 1) AS int), "
        f"'nth', i, 'text', c, 'hot', true))))"))
    # where a clause begins: the parts before it and a space for each
    df = df.withColumn("_hot", F.expr("filter(transform(_parts, (p, i) -> named_struct('i', i, 'hot', p.hot, 'size', length(p.text))), h -> h.hot)"))
    before = "aggregate(slice(_parts, 1, h.i), 0, (n, p) -> n + length(p.text) + 1)"
    df = df.withColumn("spans", F.expr(f"transform(transform(_hot, h -> named_struct('at', {before}, 'size', h.size)), s -> array(s.at, s.at + s.size))"))
    kept = [c for c in rows.columns if c not in (text, "label", "spans")]
    return df.select(*kept, F.expr("array_join(transform(_parts, p -> p.text), ' ')").alias("text"), "label", "spans")


def generate(spark: SparkSession, n: int) -> DataFrame:
    """`n` samples of clauses alone, by number; `samples` writes them into given texts."""
    return samples(spark.range(n).withColumn("text", F.lit("")))
