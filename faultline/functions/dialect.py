"""Regular-expression notation -> the dialect of the engine that runs it.

The rules are stated once (``fixed.py``) with explicit ASCII word boundaries.
Java's ``\\b`` is Unicode-aware, which would miss ``éAKIA…``; ASCII look-arounds
keep multilingual text right.
"""

from __future__ import annotations

WORD = "A-Za-z0-9_"
# tab..CR, space, and the Unicode spaces and line separators
SPACES = r"\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
SPACE_CHARS = (
    "\t\n\x0b\f\r \u00a0\u1680"
    + "".join(chr(c) for c in range(0x2000, 0x200B))
    + "\u2028\u2029\u202f\u205f\u3000\ufeff"
)


def _expand(pattern: str, boundaries: dict[str, str]) -> str:
    out, i, in_class = [], 0, False
    while i < len(pattern):
        two = pattern[i:i + 2]
        if pattern.startswith(r"\A!", i):
            out.append("(?s:.)")
            i += 3
        elif not in_class and two in boundaries:
            out.append(boundaries[two])
            i += 2
        elif two == r"\s":
            out.append(SPACES if in_class else f"[{SPACES}]")
            i += 2
        elif two == r"\S":
            out.append(f"[^{SPACES}]")
            i += 2
        elif two.startswith("\\"):
            out.append(two)
            i += 2
        else:
            if pattern[i] == "[":
                in_class = True
            elif pattern[i] == "]":
                in_class = False
            out.append(pattern[i])
            i += 1
    return "".join(out)


def java(pattern: str, ignore_case: bool = False) -> str:
    """Pattern for Spark's ``rlike`` / ``regexp_*`` functions."""
    body = _expand(pattern, {
        r"\<": f"(?<![{WORD}])",
        r"\>": f"(?![{WORD}])",
        r"\b": f"(?:(?<=[{WORD}])(?![{WORD}])|(?<![{WORD}])(?=[{WORD}]))",
    })
    return ("(?i)" if ignore_case else "") + body


def java_any(patterns: list[tuple[str, bool]]) -> str:
    """One alternation that matches where any of the patterns matches."""
    return "|".join(
        f"(?i:{java(p)})" if ignore_case else f"(?:{java(p)})"
        for p, ignore_case in patterns
    )


def re2(pattern: str, ignore_case: bool = False) -> str:
    """Pattern for the SQL oracle (RE2 has ASCII ``\\b`` and no look-around)."""
    body = _expand(pattern, {r"\<": r"\b", r"\>": r"\b", r"\b": r"\b"})
    return ("(?i)" if ignore_case else "") + body


def text(value: str) -> str:
    """Spark SQL string literal.

    Long expressions are built as SQL text and parsed in one call: thousands of
    single Column calls cost more than the query they describe.
    """
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
