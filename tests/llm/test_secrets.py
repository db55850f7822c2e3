import re

from helpers import awkward, documents, empty

from leakscope.llm import secret_links as sl
from leakscope.llm.queries import QUERIES


def test_strong_spans_are_leftmost_and_drop_short_ones():
    text = "Password: 'abcdefghijkl' token=short secret = password: abcdefghijklmnop AKIA12345678901234 é deadbeefdeadbeef feed"
    got = [(text[s:e], k) for s, e, k in sl.strong_spans(text)]
    assert got == [("Password: 'abcdefghijkl", "assign"), ("AKIA12345678901234", "access"), ("deadbeefdeadbeef", "hex")]
    assert sl.strong_spans("ſecret=abcdefghijklmnop") == []  # only ASCII letters in either case


def test_weak_parts_need_a_complement(spark):
    far = "x " * 300
    docs = documents(spark, [
        (1, "username: alice pw " + "https://db.example.org/x password=hunter2", "en", "s"),
        (2, "password=hunter2 " + far + " https://db.example.org/x", "en", "s"),
        (3, "username: alice", "en", "s"),
        (4, "AKIA12345678901234 and wJalrXUtnFEMIK7MDENGbPxRfiCYEXAMPLEKEY", "en", "s")])
    got = {r["doc_id"]: [(x["kind"], x["start"]) for x in r["linked"]] for r in sl.find_secrets(docs).collect()}
    assert [k for k, _ in got[1]] == ["ident", "endpoint", "weakpass"] and got[2] == [] and got[3] == []
    assert [k for k, _ in got[4]] == ["opaque"]


def brute_links(parts, radius):
    """Every pair of one document, both ways."""
    out = set()
    for s, e, k in parts:
        if k in {w for w, *_ in sl.WEAK} and any(sl.ROLE[k2] in sl.COMPLEMENTS[sl.ROLE[k]] and s2 < e + radius and e2 > s - radius for s2, e2, k2 in parts):
            out.add((s, e, k))
    return out


def test_bins_equal_all_pairs(spark):
    import random
    rnd = random.Random(11)
    bits = ["user=alice ", "password=abc123 ", "https://h.example/p ", "AKIA12345678901234 ", "word " * 7, "word " * 60, "token=abcdefghijklmn "]
    rows = [(i, "".join(rnd.choice(bits) for _ in range(40))) for i in range(30)]
    got = {r["doc_id"]: {(x["start"], x["end"], x["kind"]) for x in r["linked"]} for r in sl.find_secrets(documents(spark, [(i, t, "en", "s") for i, t in rows])).collect()}
    for i, t in rows:
        strong = sl.strong_spans(t)
        assert got[i] == brute_links([*strong, *sl.weak_spans(t, strong)], sl.RADIUS)


def test_query_and_awkward_rows(spark, tmp_path):
    awkward(spark).write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op5_secret_links"](spark, str(tmp_path)).collect()
    assert len(got) == 12 and all(r["spans"] == "" for r in got)
    assert {r["base_sha256"] for r in got} == {"e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"}
    assert sl.find_secrets(empty(spark)).count() == 0
    assert re.fullmatch(r"[0-9a-f]{64}", got[0]["base_sha256"])


def test_weak_parts_of_any_length(spark):
    key, url = "aB3" + "xY7z" * 40, "https://h.example/" + "p" * 600
    docs = documents(spark, [
        (1, "user=alice pwd=CorrectHorse1", "en", "s"), (2, "AKIA12345678901234 " + key, "en", "s"),
        (3, url + " " + "y " * 60 + "pwd=hunter2", "en", "s"), (4, "user=alice password=abcdefghijklmnop", "en", "s")])
    got = {r["doc_id"]: [(x["kind"], x["start"], x["end"]) for x in r["linked"]] for r in sl.find_secrets(docs).collect()}
    assert got[1] == [("ident", 0, 10), ("weakpass", 11, 28)]
    assert got[2] == [("opaque", 19, 19 + len(key))]
    assert got[3] == [("endpoint", 0, len(url)), ("weakpass", len(url) + 121, len(url) + 132)]
    assert got[4] == [("ident", 0, 10)]  # the long value is the strong kind's


def test_a_weak_part_deep_in_a_long_strong_span_is_dropped():
    text = "token=" + ".".join(["deadbeefdeadbeef"] * 12) + ".aB3" + "xY7z" * 8 + ".end"
    assert not any(k == "opaque" for *_, k in sl.weak_spans(text, sl.strong_spans(text)))


def test_identifiers_have_no_upper_length(spark):
    name = "z" * 500
    docs = documents(spark, [(1, f"user={name} " + "y " * 60 + "pwd=hunter2", "en", "s")])
    got = [(x["kind"], x["start"], x["end"]) for x in sl.find_secrets(docs).first()["linked"]]
    assert got == [("ident", 0, 505), ("weakpass", 626, 637)]


def walked(text):
    """The strong kinds by walking the characters."""
    out, hexes, caps = [], "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    value = caps + caps.lower() + "+/_.=-"
    at = 0
    while at < len(text):
        end = at
        while end < len(text) and text[end] in hexes:
            end += 1
        if end - at >= 16:
            out.append((at, end, "hex"))
        at = max(end, at + 1)
    at = 0
    while (at := text.find("AKIA", at)) >= 0:
        end = at + 4
        while end < len(text) and text[end] in caps:
            end += 1
        if end - at >= 18:
            out.append((at, end, "access"))
        at = end if end > at + 4 else at + 1
    at = 0
    while at < len(text):
        key = next((k for k in ("password", "passwd", "secret", "token", "api_key", "apikey") if text[at:at + len(k)].lower() == k), None)
        if key is None:
            at += 1
            continue
        to = at + len(key)
        to += text[to:to + 1] in ("'", '"') and to < len(text)
        while text[to:to + 1] == " ":
            to += 1
        if text[to:to + 1] not in (":", "=") or to >= len(text):
            at += 1
            continue
        to += 1
        while text[to:to + 1] == " ":
            to += 1
        to += text[to:to + 1] in ("'", '"') and to < len(text)
        end = to
        while end < len(text) and text[end] in value:
            end += 1
        if end == to:
            at += 1
            continue
        if end - to >= 12:
            out.append((at, end, "assign"))
        at = end
    order = {"assign": 0, "access": 1, "hex": 2}
    return sorted(out, key=lambda s: (s[0], order[s[2]]))


def test_strong_spans_equal_a_walk_over_characters():
    import random
    rnd = random.Random(13)
    bits = ["password", "Passwd", "TOKEN", "api_key", "apikey", "secret", ":", "=", " ", "'", '"', "AKIA", "AKIAAKIA", "0123456789ABCDEF",
            "deadbeef", "cafe", "0123456789abcdef", "x", "é", "\n", "a.b/c+d", "ſecret", "="]
    for _ in range(3000):
        text = "".join(rnd.choice(bits) for _ in range(rnd.randint(1, 25)))
        order = {"assign": 0, "access": 1, "hex": 2}
        assert sorted(sl.strong_spans(text), key=lambda s: (s[0], order[s[2]])) == walked(text), text
