"""Fixed patterns of the base kinds, found in one text; offsets are code points, ends exclusive.

Each function gives the leftmost non-overlapping matches of its pattern, then drops those that fail the kind's test.
The patterns are written so that a failing run is read once: a match can only start where a run of its first class
starts (or where the last match ended), which finds the same matches in linear time."""

from __future__ import annotations

import re

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*+[:=]\x20*+[\"']?([A-Za-z0-9+/_.=-]++)", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]++")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}+")

Span = tuple[int, int]


def emails(text: str) -> list[Span]:
    """A run of local characters up to an @, then a domain with a dot."""
    found, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        match = DOMAIN.match(text, at + 1) if start < at else None
        if match:
            done = match.end()
            found.append((start, done))
        at = text.find("@", max(at + 1, done))
    return found


def ips(text: str) -> list[Span]:
    return [m.span() for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]


def luhn(digits: str) -> bool:
    values = [int(d) for d in reversed(digits)]
    return (sum(values[::2]) + sum(sum(divmod(2 * v, 10)) for v in values[1::2])) % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def cards(text: str) -> list[Span]:
    return [m.span() for m in CARD.finditer(text) if 16 <= len(d := digits_of(m[0])) <= 19 and luhn(d)]


def phones(text: str) -> list[Span]:
    return [m.span() for m in PHONE.finditer(text) if 8 <= len(digits_of(m[0])) <= 15]


def assigns(text: str) -> list[Span]:
    return [m.span() for m in ASSIGN.finditer(text) if len(m[2]) >= 12]


def accesses(text: str) -> list[Span]:
    return [m.span() for m in ACCESS.finditer(text) if len(m[0]) >= 18]


def hexes(text: str) -> list[Span]:
    return [m.span() for m in HEX.finditer(text)]
