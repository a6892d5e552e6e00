"""Licence scan: one Aho-Corasick automaton over normalized words, and a shunting-yard evaluator for licence expressions.

A text becomes its words (ASCII letters lower-cased; everything but ASCII letters, digits and non-ASCII characters parts
words), joined by single spaces; the automaton holds licence names, notice phrases and identifier tags as whole words and
finds all places of all of them in one pass. Behind an identifier tag the rest of the line is a licence expression:
infix operators WITH, AND, OR (binding in this order) and brackets are turned into postfix by two stacks and evaluated.

An expression's value is how much it restricts a user, from 0 (permissive) to 1 (unknown or closed): OR takes the milder
side, AND the stricter one, WITH a known exception makes strong copyleft weak. An expression that does not parse has no
value and adds no label. What follows the last character that can belong to an expression (a comment's end) is not read.

The score is the evidence that the text states a licence: 1 minus the product of (1 - weight) over the distinct names,
phrases and well-formed expressions found.

Cases: a null text has no words; rows are scanned one by one, so repeated rows, null ids and empty tables need no rule; a
text of any length is scanned whole and every place is given; columns other than id and text are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from casegraph.llm.common import batches_by_bytes, id_and_text, texts_of

#: Phrases whose places are counted, with their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Names and notices that the method adds.
NAMES = {
    "gnu lesser general public license": "lgpl", "gnu library general public license": "lgpl", "gnu affero general public license": "agpl",
    "gnu free documentation license": "gfdl", "mozilla public license": "mpl", "eclipse public license": "epl", "bsd license": "bsd",
    "isc license": "isc", "boost software license": "bsl", "zlib license": "zlib", "artistic license": "artistic", "open font license": "ofl",
    "cc by nc": "cc-by-nc", "cc by sa": "cc-by-sa", "cc by nd": "cc-by-nd", "cc by nc sa": "cc-by-nc-sa", "cc by nc nd": "cc-by-nc-nd",
    "creative commons attribution": "cc-by", "creative commons attribution noncommercial": "cc-by-nc", "creative commons attribution sharealike": "cc-by-sa",
    "creative commons zero": "cc0", "the unlicense": "unlicense",
}
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "permission to use copy modify and or distribute this software for any purpose": "isc",
    "redistribution and use in source and binary forms": "bsd",
    "under the terms of the gnu general public license": "gpl",
    "under the terms of the gnu lesser general public license": "lgpl",
    "under the terms of the gnu affero general public license": "agpl",
    "licensed under the apache license": "apache",
    "released under the mit license": "mit",
    "subject to the terms of the mozilla public license": "mpl",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "to the extent possible under law the author has waived all copyright": "cc0",
    "all rights reserved": "all-rights-reserved",
}
TAGS = ("spdx license identifier", "license expression")
WEIGHT = {"base": 0.6, "name": 0.6, "notice": 0.8, "tag": 0.95}

#: Families by the beginning of an identifier, and how much each restricts; the longest beginning counts.
FAMILIES = {
    "mit": ("mit", 0.0), "apache": ("apache", 0.0), "bsd": ("bsd", 0.0), "isc": ("isc", 0.0), "zlib": ("zlib", 0.0), "bsl-1": ("bsl", 0.0),
    "unlicense": ("unlicense", 0.0), "cc0": ("cc0", 0.0), "cc-by": ("cc-by", 0.1), "ofl": ("ofl", 0.2), "artistic": ("artistic", 0.3),
    "mpl": ("mpl", 0.4), "epl": ("epl", 0.4), "lgpl": ("lgpl", 0.4), "cc-by-sa": ("cc-by-sa", 0.5), "gpl": ("gpl", 0.7), "gfdl": ("gfdl", 0.7),
    "agpl": ("agpl", 0.8), "cc-by-nc": ("cc-by-nc", 0.9), "cc-by-nd": ("cc-by-nd", 0.9), "cc-by-nc-sa": ("cc-by-nc-sa", 0.9), "cc-by-nc-nd": ("cc-by-nc-nd", 0.9),
}
#: WITH one of these, strong copyleft (0.7) restricts as weak copyleft (0.4) does.
EXCEPTION = re.compile(r"(classpath|gcc|font|linking|autoconf|bison|openssl|llvm|linux-syscall|wxwindows|universal-foss)[a-z0-9.+-]*|[a-z0-9.+-]*exception[a-z0-9.+-]*")

FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 32 for b in range(256))
TAG = re.compile(rb"(?<![0-9A-Za-z\x80-\xff])(?:spdx-license-identifier|license-expression)[\x20\t]*:([^\r\n]*)", re.IGNORECASE)
TOKEN = re.compile(r"[\x20\t]*(?:([()])|([A-Za-z0-9][A-Za-z0-9.:+-]*))")
BINDS = {"or": 1, "and": 2, "with": 3}


def family(identifier: str) -> tuple[str, float]:
    """Label and restriction of a licence identifier; an unknown one is its own label and restricts fully."""
    name = identifier.lower().rstrip("+")
    known = [k for k in FAMILIES if name == k or name.startswith(k + "-") or k == "bsl-1" and name.startswith(k)]
    return FAMILIES[max(known, key=len)] if known else (name, 1.0)


def postfix(text: str) -> list[str] | None:
    """Shunting-yard: operands in order, each operator behind its operands; None for an expression that is not one."""
    output: list[str] = []
    waiting: list[str] = []
    operand, at = True, 0       # whether an operand must come next
    while m := TOKEN.match(text, at):
        at, token = m.end(), m[0].strip()
        word = token.lower()
        if word in BINDS:
            if operand:
                return None
            while waiting and waiting[-1] != "(" and BINDS[waiting[-1]] >= BINDS[word]:
                output.append(waiting.pop())
            waiting.append(word)
            operand = True
        elif token == "(":
            if not operand:
                return None
            waiting.append(token)
        elif token == ")":
            while waiting and waiting[-1] != "(":
                output.append(waiting.pop())
            if operand or not waiting:
                return None
            waiting.pop()
        else:
            if not operand:
                return None
            output.append(token)
            operand = False
    if operand or "(" in waiting:
        return None
    return output + waiting[::-1]


def evaluated(text: str) -> tuple[float, list[str]] | None:
    """(restriction, labels) of a licence expression; None when it does not parse."""
    order = postfix(text)
    if order is None:
        return None
    stack: list[tuple[float, str | None]] = []    # value, and the identifier while it is a bare one
    labels: list[str] = []
    for token in order:
        if token not in BINDS:
            stack.append((family(token)[1], token))
            continue
        (right, name), (left, base) = stack.pop(), stack.pop()
        if token == "with":
            if name is None or base is None:      # an exception belongs to one licence
                return None
            labels.append(family(base)[0])
            stack.append((0.4 if left == 0.7 and EXCEPTION.fullmatch(name.lower()) else left, None))
        else:
            labels += [family(n)[0] for n in (base, name) if n is not None]
            stack.append((min(left, right) if token == "or" else max(left, right), None))
    value, name = stack.pop()
    if name is not None:
        labels.append(family(name)[0])
    return value, sorted(set(labels))


def automaton():
    import ahocorasick

    machine = ahocorasick.Automaton()
    meaning: dict[str, list[tuple[str, str]]] = {}
    for kind, phrases in (("base", BASE), ("name", NAMES), ("notice", NOTICES), ("tag", dict.fromkeys(TAGS, ""))):
        for phrase, label in phrases.items():
            meaning.setdefault(phrase, []).append((kind, label))
    for phrase, known in meaning.items():
        machine.add_word(f" {phrase} ", (phrase.count(" ") + 1, phrase, known))
    machine.make_automaton()
    return machine


Place = tuple[int, int, str, str]


def scanned(text: bytes, machine) -> tuple[int, list[Place], list[tuple[str, float | None]], float]:
    """(words, places as (first word, last word, kind, label), expressions as (text, restriction), score)."""
    words = text.translate(FOLD).split()
    flat = b" " + b" ".join(words) + b" " if words else b""
    places: list[Place] = []
    evidence: set[tuple[str, str]] = set()
    at = spaces = 0
    tagged = False
    for end, (size, phrase, known) in machine.iter(flat.decode("latin-1")):
        spaces += flat.count(b" ", at, end + 1)
        at, last = end + 1, spaces - 2
        for kind, label in known:
            if kind == "tag":
                tagged = True
            else:
                places.append((last - size + 1, last, kind, label))
                evidence.add((phrase, kind))
    expressions: list[tuple[str, float | None]] = []
    if tagged:
        read = before = 0
        for m in TAG.finditer(text):
            expression = m[1].decode().strip()
            found = evaluated(expression)
            expressions.append((expression, found[0] if found else None))
            before += len(text[read: m.start()].translate(FOLD).split())
            read = m.start()
            if found:
                last = before + len(m[0].translate(FOLD).split()) - 1
                places += [(before, last, "tag", label) for label in found[1]]
                evidence.add((expression, "tag"))
    doubt = 1.0
    for _, kind in sorted(evidence):
        doubt *= 1.0 - WEIGHT[kind]
    return len(words), sorted(places), expressions, 1.0 - doubt


PLACE = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("kind", pa.string()), ("label", pa.string())]))
EXPRESSION = pa.list_(pa.struct([("text", pa.string()), ("restriction", pa.float64())]))
SCHEMA = "doc_id long, n_words long, places array<struct<first:bigint,last:bigint,kind:string,label:string>>, expressions array<struct<text:string,restriction:double>>, score double"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, places, expressions, score): places by first word, kinds base, name, notice and tag; the
    restriction of an expression that does not parse is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton()
        for batch in batches_by_bytes(batches, "text"):
            found = [scanned(t or b"", machine) for t in texts_of(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array([f[0] for f in found], pa.int64()),
                pa.array([[dict(zip(("first", "last", "kind", "label"), p)) for p in f[1]] for f in found], PLACE),
                pa.array([[{"text": t, "restriction": r} for t, r in f[2]] for f in found], EXPRESSION),
                pa.array([f[3] for f in found], pa.float64()),
            ], ["doc_id", "n_words", "places", "expressions", "score"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, SCHEMA)
