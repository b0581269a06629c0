"""Spell a pattern so that the JVM matches exactly what the pattern's author meant.

The registry patterns assume Unicode-aware ``\\b \\d \\w \\s`` in which a word character is a
letter, a number or ``_``. The JVM's own shorthand classes differ (ASCII by default; combining
marks count as word characters with ``(?U)``; ``\\b`` changed in Java 19), so every shorthand is
written out as an explicit class and results do not depend on the Java version.
"""

from __future__ import annotations

import re

DIGIT = r"\p{Nd}"
WORD = r"\p{L}\p{N}_"
SPACE = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# Java steps back by whole characters instead of UTF-16 halves only if the lookbehind holds a
# character beyond U+FFFF. This one is a letter, so it changes nothing else.
_WIDE_LETTER = "\U00010000"
_BEFORE = f"[{WORD}{_WIDE_LETTER}]"
BOUNDARY = rf"(?:(?<={_BEFORE})(?![{WORD}])|(?<!{_BEFORE})(?=[{WORD}]))"

_CLASSES = {"d": DIGIT, "w": WORD, "s": SPACE}
_TOKEN = re.compile(r"\\.|\[|\]", re.DOTALL)


_RUN_BEFORE_AT = re.compile(r"\\b(\[[^\]]*\])\+@(.*)", re.DOTALL)


def replacing(pattern: str, ignore_case: bool = False, lead: str = "") -> tuple[str, str, str]:
    """(Java regex, what to write before a match, the match itself) for ``regexp_replace``.

    A pattern ``\\b[run]+@...`` searched plainly tries every boundary of a run that no ``@`` follows,
    each time to the run's end. Whether it matches does not depend on where in the run it begins, so
    each run is tried once: from its first boundary, or from where the match before ended.
    """
    found = _RUN_BEFORE_AT.fullmatch(pattern)
    if not found:
        return jvm_regex(pattern, ignore_case, lead), "", "$0"
    run, rest = found.groups()
    start = rf"(?:\G|(?<!{run}))(?={run})"
    regex = f"{start}((?>{run}*?{BOUNDARY}))({run}++@{jvm_regex(rest)})"
    return (f"(?iu){regex}" if ignore_case else regex), "$1", "$2"


def jvm_regex(pattern: str, ignore_case: bool = False, lead: str = "") -> str:
    """Java regex for ``pattern``; ``lead`` is a class every match is known to start with."""
    inside = False

    def spell(token: re.Match) -> str:
        nonlocal inside
        text = token.group()
        if text in "[]":
            inside = text == "["
            return text
        if text == r"\b":
            return BOUNDARY
        members = _CLASSES.get(text[1])
        if members is None:
            return text
        return members if inside else f"[{members}]"

    body = _TOKEN.sub(spell, pattern)
    if ignore_case:
        body = f"(?iu){body}"
    return f"(?={jvm_regex(lead)}){body}" if lead else body
