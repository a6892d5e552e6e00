"""Linear sweeps over texts: many patterns in one pass by their literal anchors, and spans between markers.

A pattern's matches are what a leftmost search without overlap gives. `Scanner` finds the literal anchors of all patterns
with one Aho-Corasick pass over the text (ASCII letters folded) and checks each pattern around its own hits only.
`spans` pairs openers with closers, and `elements` reads loose XML properties; both remember the next place of every
marker, so a text of openers without closers is read once."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass

Span = tuple[int, int]
#: Value span and end of a match around the anchor at a place, given the end of the last match; None for no match.
Check = Callable[[int, int], tuple[int, int, int] | None]
FOLD = {c: c + 32 for c in range(0x41, 0x5B)}


class _Words(dict):
    """Whether a character belongs to words: letters, marks, digits and connectors."""

    def __missing__(self, c: str) -> bool:
        kind = unicodedata.category(c)
        value = self[c] = kind[0] == "L" or kind in ("Mn", "Nd", "Pc")
        return value


def _letters(text: str, at: int, stop: int) -> int:
    """End of the run of ASCII letters at a place."""
    while at < stop and text[at].isascii() and text[at].isalpha():
        at += 1
    return at


@dataclass(frozen=True)
class Pattern:
    """Literal anchors, one of which each match holds, and the check of a text's hits."""

    anchors: tuple[str, ...]
    on: Callable[[str], Check]


def anchored(pattern: str, *anchors: str, back: int = 0, group: int = 0) -> Pattern:
    """A pattern whose every match starts `back` characters before one of its anchors; its value is a group (or empty)."""
    compiled = re.compile(pattern, re.ASCII)

    def on(text: str) -> Check:
        def check(at: int, done: int) -> tuple[int, int, int] | None:
            match = compiled.match(text, at - back) if at - back >= done else None
            return match and (max(match.start(group), 0), max(match.end(group), 0), match.end())

        return check

    return Pattern(anchors, on)


def email(guarded: bool) -> Pattern:
    """Local characters, an at-sign, a domain that ends in a dot and two or more ASCII letters. Guarded: the match takes
    the whole run on both sides; else it may start where the last one ended and stop inside the domain's run."""
    words = _Words()

    def on(text: str) -> Check:
        n, is_word = len(text), words.__getitem__

        def check(at: int, done: int) -> tuple[int, int, int] | None:
            start = at
            while start > (0 if guarded else done) and (text[start - 1] in ".+-" or is_word(text[start - 1])):
                start -= 1
            if start == at or start < done:
                return None
            stop = at + 1
            while stop < n and (text[stop] in ".-" or is_word(text[stop])):
                stop += 1
            dot = text.rfind(".", at + 2, stop)
            while dot > 0:
                end = _letters(text, dot + 1, stop)
                if end - dot > 2 and (end == stop or not guarded):
                    return start, end, end
                dot = -1 if guarded else text.rfind(".", at + 2, dot)
            return None

        return check

    return Pattern(("@",), on)


class NextOf:
    """The next place of a marker, looked for once per place."""

    def __init__(self, text, marker):
        self.text, self.marker, self.place = text, marker, -1

    def seek(self, at: int) -> int | None:
        """The first place from `at` on; calls must not go back."""
        if self.place is not None and (self.place < at or self.place == -1):
            self.place = self.text.find(self.marker, at)
            if self.place < 0:
                self.place = None
        return self.place


def loose_element(*prefixes: str) -> Pattern:
    """`<prefix:name...>value<`, up to the first `>` and the next `<`."""
    opener = re.compile(rf"(?i)<(?:{'|'.join(prefixes)}):[A-Za-z][A-Za-z0-9_-]*", re.ASCII)

    def on(text: str) -> Check:
        closes, ends = NextOf(text, ">"), NextOf(text, "<")

        def check(at: int, done: int) -> tuple[int, int, int] | None:
            match = opener.match(text, at) if at >= done else None
            close = closes.seek(match.end()) if match else None
            end = None if close is None else ends.seek(close + 1)
            return (at, end + 1, end + 1) if end is not None and end > close + 1 else None

        return check

    return Pattern(tuple(f"<{p}:" for p in prefixes), on)


class Scanner:
    """All patterns over a text in one pass."""

    def __init__(self, patterns: list[Pattern], fold: bool = True):
        import ahocorasick

        self.patterns, self.fold, self.machine = patterns, fold, ahocorasick.Automaton()
        uses: dict[str, list[int]] = {}
        for number, pattern in enumerate(patterns):
            for anchor in pattern.anchors:
                uses.setdefault(anchor, []).append(number)
        for anchor, numbers in uses.items():
            self.machine.add_word(anchor, (len(anchor), numbers))
        self.machine.make_automaton()

    def matches(self, text: str, folded: str | None = None) -> list[list[Span]]:
        """Value spans by pattern, in order."""
        found: list[list[Span]] = [[] for _ in self.patterns]
        done, checks = [0] * len(self.patterns), [p.on(text) for p in self.patterns]
        folded = (text.translate(FOLD) if self.fold else text) if folded is None else folded
        for last, (size, numbers) in self.machine.iter(folded):
            for number in numbers:
                match = checks[number](last - size + 1, done[number])
                if match is not None:
                    found[number].append(match[:2])
                    done[number] = match[2]
        return found


def spans(data: bytes, pairs: list[tuple[bytes, bytes]]) -> list[Span]:
    """Leftmost spans from an opener to the next closer of its pair, without overlap."""
    openers, closers = [NextOf(data, o) for o, _ in pairs], [NextOf(data, c) for _, c in pairs]
    found, at, alive = [], 0, set(range(len(pairs)))
    while alive:
        starts = [(place, k) for k in alive if (place := openers[k].seek(at)) is not None]
        if not starts:
            break
        place, k = min(starts)
        close = closers[k].seek(place + len(pairs[k][0]))
        if close is None:
            alive.discard(k)      # no closer is left for any later opener either
            continue
        at = close + len(pairs[k][1])
        found.append((place, at))
    return found


IMAGES = [(b"\xff\xd8\xff", b"\xff\xd9"), (b"\x89PNG\r\n\x1a\n", b"IEND\xae\x42\x60\x82")]
PACKETS = [(b"<x:xmpmeta", b"</x:xmpmeta>"), (b"<rdf:rdf", b"</rdf:rdf>")]
