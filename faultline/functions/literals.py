"""Literals that a text must contain for a regular expression to match it."""

from __future__ import annotations

import re
from re import _constants as ops
from re import _parser as parser

SIZE = 3

# notation the parser reads otherwise than the engine that runs the pattern:
# octal and back references, quantifiers without a lower bound, Unicode case
_UNSAFE = re.compile(r"\\\d|\{,|\(\?[a-zA-Z-]*[uU]")
_BOUNDARY = {r"\<": r"\b", r"\>": r"\b", r"\A!": "."}


def required_literals(pattern: str) -> list[str]:
    """Lower-case ASCII literals, of which every matching text, lower-cased, has at least one.

    The longest literal that no alternative can avoid; where alternatives each
    need their own, one of each. Empty where a text may match without any
    literal of ``SIZE`` characters, or where the pattern cannot be read.
    """
    if _UNSAFE.search(pattern):
        return []
    plain = re.sub(r"\\A!|\\.", lambda m: _BOUNDARY.get(m[0], m[0]), pattern, flags=re.S)
    try:
        tree = parser.parse(plain)
    except (re.error, RecursionError, OverflowError):
        return []
    return sorted(set(_needed(tree) or []))


def _needed(tree) -> list[str] | None:
    found: list[list[str]] = []
    run: list[str] = []

    def flush() -> None:
        if len(run) >= SIZE:
            found.append(["".join(run)])
        run.clear()

    for op, value in tree:
        if op is ops.LITERAL and " " <= chr(value) <= "~":
            run.append(chr(value).lower())
            continue
        if op is ops.AT:  # no width: neighbours stay neighbours
            continue
        flush()
        if op is ops.SUBPATTERN:
            inner = _needed(value[3])
        elif op is ops.ATOMIC_GROUP:
            inner = _needed(value)
        elif op in (ops.MAX_REPEAT, ops.MIN_REPEAT, ops.POSSESSIVE_REPEAT) and value[0] > 0:
            inner = _needed(value[2])
        elif op is ops.BRANCH:
            each = [_needed(branch) for branch in value[1]]
            inner = [x for options in each for x in options] if all(each) else None
        else:
            inner = None
        if inner:
            found.append(inner)
    flush()
    return max(found, key=lambda options: (min(map(len, options)), -len(options)), default=None)
