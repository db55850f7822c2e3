"""Turn portable pattern text into the JVM regex dialect.

Differences that matter: the JVM's ``\\d \\w \\s`` are ASCII by default, its ``.``
and ``$`` know more line ends than ``\\n``, its ASCII-only ``(?i)`` and the meaning
of ``\\b`` (which changed between JDK releases).  All are written out explicitly so
that results do not depend on the JDK.
"""

from __future__ import annotations

WORD = r"\p{L}\p{N}_"
SPACE = (r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000")
DIGIT = r"\p{Nd}"

_START = f"(?<![{WORD}])"
_ANY_EDGE = f"(?:(?<![{WORD}])(?=[{WORD}])|(?<=[{WORD}])(?![{WORD}]))"

# One character that is not in SPACE; the common ranges stand first, as a class is tested in order.
NOT_SPACE = rf"[!-~\xa1-\u167f[^{SPACE}]]"

# Whitespace characters of SPACE as text, for trim().
SPACE_CHARS = "".join(
    chr(c) for c in (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680,
                     *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
)
# Where a text breaks into lines.
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def jvm_regex(pattern: str) -> str:
    """Portable pattern text -> JVM regex with the same matches."""
    flags = "(?d)"
    for head, jvm in (("(?im)", "(?dium)"), ("(?i)", "(?diu)")):
        if pattern.startswith(head):
            pattern, flags = pattern[len(head):], jvm
            break
    out: list[str] = []
    in_class = False
    i = 0
    while i < len(pattern):
        two = pattern[i:i + 2]
        if two == r"\b" and not in_class:
            following = pattern[i + 2:i + 4]
            starts_word = following[:1].isalnum() or following == r"\d"
            out.append(_START if starts_word else _ANY_EDGE)
        elif two == r"\d":
            out.append(DIGIT)
        elif two == r"\w":
            out.append(WORD if in_class else f"[{WORD}]")
        elif two == r"\s":
            out.append(SPACE if in_class else f"[{SPACE}]")
        elif two == r"\S" and not in_class:
            out.append(NOT_SPACE)
        elif two.startswith("\\"):
            out.append(two)
        else:
            char = pattern[i]
            if char == "[" and not in_class:
                in_class = True
            elif char == "]" and in_class:
                in_class = False
            out.append(char)
            i += 1
            continue
        i += 2
    return flags + "".join(out)
