"""Recognizer rows: which spans of a text count as personal or business data.

A recognizer is data, not code.  Add rows to ``RECOGNIZERS`` (or pass your own list to
``detect``) to extend detection; row order is the tie-break order of overlap resolution.
"""

from __future__ import annotations

from dataclasses import dataclass

CUSTOM = "pattern"
BUSINESS = "business"
EXTERNAL = "external"

# --- Fixed values: entity labels, regular expressions and context keywords, in declaration
# order. Results depend on every character of them.
CUSTOM_PATTERNS = {
    "EMAIL": [r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"],
    "PHONE_NUMBER": [
        r"\b(?:\+?1[-.\s]?)?\(?[0-9]{3}\)?[-.\s]?[0-9]{3}[-.\s]?[0-9]{4}\b",
        r"\b\d{3}-\d{3}-\d{4}\b",
        r"\(\d{3}\)\s?\d{3}-\d{4}",
    ],
    "US_SSN": [r"\b\d{3}-\d{2}-\d{4}\b", r"\b\d{3}\s\d{2}\s\d{4}\b", r"\b\d{9}\b"],
    "CREDIT_CARD": [
        r"\b(?:4[0-9]{12}(?:[0-9]{3})?|5[1-5][0-9]{14}|3[47][0-9]{13}|3[0-9]{13}|6(?:011|5[0-9]{2})[0-9]{12})\b",
        r"\b(?:\d{4}[- ]?){3}\d{4}\b",
    ],
    "IP_ADDRESS": [
        r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b",
        r"\b(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}\b",
    ],
    "URL": [r"https?://(?:[-\w.])+(?:[:\d]+)?(?:/(?:[\w/_.])*(?:\?(?:[\w&=%.])*)?(?:#(?:[\w.])*)?)?"],
    "AWS_ACCESS_KEY": [r"\bAKIA[0-9A-Z]{16}\b"],
    "API_KEY": [r"\b[A-Za-z0-9]{32,}\b", r"sk-[A-Za-z0-9]{48}", r"pk_[a-z]+_[A-Za-z0-9]{24}"],
    "BANK_ACCOUNT": [r"\b\d{8,17}\b"],
    "PASSPORT": [r"\b[A-Z]{1,2}\d{6,9}\b"],
    "DRIVER_LICENSE": [r"\b[A-Z]\d{7,8}\b", r"\b\d{8,9}\b"],
}
BUSINESS_PATTERNS = {
    "BUSINESS_INTERNAL_EMAIL": [r"\b[A-Za-z0-9._%+-]+@(?:company|internal|corp)\.com\b"],
    "BUSINESS_EMPLOYEE_ID": [r"\bEMP\d{4,8}\b", r"\b\d{6,8}\b"],
    "BUSINESS_PROJECT_CODE": [r"\b[A-Z]{2,4}-\d{4}\b"],
    "BUSINESS_CONFIDENTIAL_MARKERS": [r"\b(?:CONFIDENTIAL|RESTRICTED|PROPRIETARY|INTERNAL ONLY)\b"],
}
IGNORE_CASE_TYPES = {"BUSINESS_CONFIDENTIAL_MARKERS"}
CONTEXT_KEYWORDS = {
    "EMAIL": ["email", "e-mail", "mail", "contact"],
    "PHONE_NUMBER": ["phone", "tel", "mobile", "cell", "number"],
    "US_SSN": ["ssn", "social security", "social"],
    "CREDIT_CARD": ["card", "credit", "visa", "mastercard", "payment"],
    "BANK_ACCOUNT": ["account", "bank", "routing", "iban"],
    "PASSWORD": ["password", "pwd", "pass", "secret", "key"],
    "API_KEY": ["api", "key", "token", "secret", "auth"],
}
CONFIDENCE_WITH_KEYWORD = 0.9
CONFIDENCE_WITHOUT_KEYWORD = 0.7
CONFIDENCE_BUSINESS = 0.8
HIGH_RISK_TYPES = ["US_SSN", "CREDIT_CARD", "AWS_ACCESS_KEY", "API_KEY", "PASSWORD"]
MEDIUM_RISK_TYPES = ["EMAIL", "PHONE_NUMBER", "PERSON", "BANK_ACCOUNT"]
RISK_INDICATOR_TYPES = ["US_SSN", "CREDIT_CARD", "API_KEY", "PASSWORD"]
EXTERNAL_LABEL_RENAMES = {"EMAIL_ADDRESS": "EMAIL"}
EXTERNAL_DEFAULT_CONFIDENCE = 0.8
# --- end of fixed values

# Cheap tests a text must pass before the pattern in the same position is worth running, from left
# to right, and the class the first character of a match belongs to. All are implied by the
# pattern: they only save work. A test is text to search for, or a regex when it starts with "re:".
_FOUR = r"re:\d{4}"
# Parts of the markers without letters that other letters than their two cases stand for (I, S).
_MARKER = "re:(?=[FfTtOoLl])(?:[Ff].[Dd][Ee][Nn]|[Tt][Rr].[Cc][Tt]|[Oo][Pp][Rr].[Ee]|[Ll] [Oo][Nn][Ll])"
_GATES = {
    "EMAIL": [(["@"], "")],
    "PHONE_NUMBER": [
        ([_FOUR], "[0-9+(]"),
        ([_FOUR, r"re:\d{3}-\d{4}"], r"\d"),
        ([_FOUR, r"re:\)\s?\d{3}-\d{4}"], ""),
    ],
    "US_SSN": [([_FOUR, r"re:\d{2}-\d{4}"], r"\d"), ([_FOUR, r"re:\d{2}\s\d{4}"], r"\d"), ([_FOUR, r"re:\d{9}"], r"\d")],
    "CREDIT_CARD": [([_FOUR, r"re:\d{13}"], "[3-6]"), ([_FOUR, r"re:\d{4}[- ]?\d{4}"], r"\d")],
    "IP_ADDRESS": [([r"re:[0-9]\.[0-9]"], "[0-9]"), ([r"re::[0-9a-fA-F]{1,4}:"], "[0-9a-fA-F]")],
    "URL": [(["://"], "")],
    "AWS_ACCESS_KEY": [(["AKIA"], "")],
    "API_KEY": [([r"re:(?<![A-Za-z0-9])[A-Za-z0-9]{32}"], "[A-Za-z0-9]"), (["sk-"], ""), (["pk_"], "")],
    "BANK_ACCOUNT": [([_FOUR, r"re:\d{8}"], r"\d")],
    "PASSPORT": [([_FOUR, r"re:[A-Z]\d{6}"], "[A-Z]")],
    "DRIVER_LICENSE": [([_FOUR, r"re:[A-Z]\d{6}"], "[A-Z]"), ([_FOUR, r"re:\d{8}"], r"\d")],
    "BUSINESS_INTERNAL_EMAIL": [(["@"], "")],
    "BUSINESS_EMPLOYEE_ID": [(["EMP"], ""), ([_FOUR, r"re:\d{6}"], r"\d")],
    "BUSINESS_PROJECT_CODE": [([_FOUR, r"re:[A-Z]-\d{4}"], "[A-Z]")],
    "BUSINESS_CONFIDENTIAL_MARKERS": [([_MARKER], "[CcRrPpIi\u0130\u0131]")],
}


@dataclass(frozen=True)
class Recognizer:
    entity_type: str
    pattern: str
    source: str = CUSTOM
    keywords: tuple[str, ...] = ()
    ignore_case: bool = False
    gate: tuple[str, ...] = ()
    lead: str = ""


def _rows(patterns: dict[str, list[str]], source: str) -> list[Recognizer]:
    return [
        Recognizer(
            entity_type=entity_type,
            pattern=pattern,
            source=source,
            keywords=tuple(CONTEXT_KEYWORDS.get(entity_type, ())) if source == CUSTOM else (),
            ignore_case=entity_type in IGNORE_CASE_TYPES,
            gate=tuple(gate),
            lead=lead,
        )
        for entity_type, regexes in patterns.items()
        for pattern, (gate, lead) in zip(regexes, _GATES[entity_type], strict=True)
    ]


RECOGNIZERS: list[Recognizer] = _rows(CUSTOM_PATTERNS, CUSTOM) + _rows(BUSINESS_PATTERNS, BUSINESS)


def recognizers(types: list[str] | None = None, custom: bool = True) -> list[Recognizer]:
    """Registry rows for the given labels; ``custom=False`` leaves only the business rows."""
    return [
        r
        for r in RECOGNIZERS
        if (custom or r.source == BUSINESS) and (types is None or r.entity_type in types)
    ]
