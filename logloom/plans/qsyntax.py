"""The search box: words, phrases, exclusions and ``field:value`` filters, parsed without ever failing."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from typing import Any

from logloom.functions.ip import hex_range

#: The longest box in tokens, the fields and what they mean.
MOST_TOKENS = 64
NAMES = {
    "status": "status", "method": "method", "ip": "ip", "path": "path", "ua": "ua", "user_agent": "ua", "referer": "referer", "referrer": "referer",
    "browser": "browser", "os": "os", "device": "device", "country": "country", "region": "region", "city": "city",
    "bytes": "bytes", "rt": "rt", "request_time": "rt", "time": "rt", "level": "level",
}
KEYWORDS = ("method", "browser", "os", "device", "country", "region", "city")
LEVEL_ALIASES = {"warning": "warn", "err": "error", "critical": "crit", "emergency": "emerg"}
LEVEL_NAMES = ("debug", "info", "notice", "warn", "error", "crit", "alert", "emerg")


@dataclass(frozen=True)
class Span:
    """A numeric interval; None is an open end, the flags say whether an end belongs to it."""

    low: float | int | None = None
    high: float | int | None = None
    with_low: bool = True
    with_high: bool = True


@dataclass(frozen=True)
class Item:
    kind: str
    value: Any
    exclude: bool = False


@dataclass(frozen=True)
class Warning:  # noqa: A001
    reason: str
    text: str


_TOKEN = re.compile(r'(?:[^\s"]|"[^"]*")+')


def split_tokens(text: str) -> tuple[list[str], list[Warning], int]:
    """Tokens between white space, which quotes keep; where a quote stays open it is text like any other. Also where reading stopped."""
    tokens, warnings, at = [], [], 0
    while (start := re.compile(r"\S").search(text, at)) and len(tokens) < MOST_TOKENS:
        at = start.start()
        token = _TOKEN.match(text, at)
        if token and (token.end() == len(text) or text[token.end()].isspace()):
            tokens.append(token[0])
        else:
            tokens.append(re.compile(r"\S+").match(text, at)[0])
            warnings.append(Warning("unterminated_quote", tokens[-1]))
        at += len(tokens[-1])
    return tokens, warnings, start.start() if start else len(text)


def _quoted(s: str) -> bool:
    return len(s) > 2 and s[0] == s[-1] == '"' and '"' not in s[1:-1]


def level_of(value: str) -> str | None:
    low = value.lower()
    low = LEVEL_ALIASES.get(low, low)
    return low if low in LEVEL_NAMES else None


def _number(text: str, real: bool) -> float | int | None:
    text = text.strip()  # a quoted value may have blanks
    if real:
        try:
            v = float(text) if re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", text) else None
        except ValueError:
            return None
        return v if v is not None and math.isfinite(v) and v >= 0 else None
    return int(text) if re.fullmatch(r"\+?\d+", text) and int(text) < 1 << 63 else None


def span_of(value: str, real: bool = False) -> Span | None:
    """``>= > <= <`` with a number, ``a..b`` with open ends, or a number alone."""
    for sign in (">=", "<=", ">", "<"):
        if value.startswith(sign):
            n = _number(value[len(sign) :], real)
            if n is None:
                return None
            return Span(low=n, with_low="=" in sign) if sign[0] == ">" else Span(high=n, with_high="=" in sign)
    if ".." in value:
        a, _, b = value.partition("..")
        low, high = (_number(x, real) if x else None for x in (a, b))
        if (a and low is None) or (b and high is None) or not (a or b) or (a and b and low > high):
            return None
        return Span(low, high)
    n = _number(value, real)
    return None if n is None else Span(n, n)


def status_span(value: str) -> Span | None:
    """Also ``Nxx`` and ``a-b``; the dash is looked for first."""
    if m := re.fullmatch(r"([1-9])[xX]{2}", value):
        return Span(int(m[1]) * 100, int(m[1]) * 100 + 99)
    if "-" in value:
        a, _, b = value.partition("-")
        low, high = _number(a, False), _number(b, False)
        return Span(low, high) if low is not None and high is not None and low <= high else None
    return span_of(value)


def _typed(kind: str, value: str) -> Any:
    if kind == "status":
        return status_span(value)
    if kind == "ip":
        return hex_range(value)
    if kind in ("bytes", "rt"):
        return span_of(value, kind == "rt")
    return level_of(value) if kind == "level" else value


def parse(text: str) -> tuple[list[Item], list[Warning]]:
    """Items of a search box, plain words as one last text item, and warnings; every text is a box."""
    tokens, warnings, stopped = split_tokens(text)
    if stopped < len(text):
        warnings.append(Warning("too_many_terms", text[stopped : stopped + 32]))
    items: list[Item] = []
    words: list[str] = []

    def text_item(body: str, exclude: bool) -> None:
        if exclude:
            items.append(Item("text", body, True))
        else:
            words.append(body)

    for token in tokens:
        exclude = len(token) > 1 and token[0] == "-"
        body = token[1:] if exclude else token
        if _quoted(body):
            items.append(Item("phrase", body[1:-1], exclude))
            continue
        name, colon, value = body.partition(":")
        kind = NAMES.get(name.lower())
        if colon and kind and value:
            typed = _typed(kind, value[1:-1] if _quoted(value) else value)
            if typed is not None:
                items.append(Item(kind, typed, exclude))
                continue
            warnings.append(Warning("invalid_value", token))
        elif colon and not kind and re.fullmatch(r"[A-Za-z_]{2,}", name) and value and value[0] not in "/:":
            warnings.append(Warning("unknown_field", token))
        text_item(body, exclude)
    if words:
        items.append(Item("text", " ".join(words)))
    return items, warnings
