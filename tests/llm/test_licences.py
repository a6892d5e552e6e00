"""Licence expressions against a recursive evaluator, places against a plain word scan."""

import re

import pytest
from hypothesis import given
from hypothesis import strategies as st

from casegraph.llm import licences
from casegraph.llm.queries import QUERIES

MACHINE = licences.automaton()
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain(text):
    """Base columns by looking at every word."""
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    found = [(k, label) for phrase, label in licences.BASE.items() for k in range(len(words)) if words[k: k + len(phrase.split())] == phrase.split()]
    return len(words), len(found), min(found, default=(None,))[0], max(found, default=(None,))[0], ",".join(sorted({x for _, x in found}))


@pytest.mark.parametrize("text,value,labels", [
    ("MIT", 0.0, ["mit"]),
    ("MIT OR GPL-3.0-only", 0.0, ["gpl", "mit"]),
    ("MIT AND GPL-3.0-only", 0.7, ["gpl", "mit"]),
    ("MIT OR GPL-2.0 AND AGPL-3.0", 0.0, ["agpl", "gpl", "mit"]),
    ("(MIT OR GPL-2.0) AND LGPL-2.1+", 0.4, ["gpl", "lgpl", "mit"]),
    ("GPL-2.0-or-later WITH Classpath-exception-2.0", 0.4, ["gpl"]),
    ("gpl-2.0 with Classpath-exception-2.0 and MPL-2.0 */", 0.4, ["gpl", "mpl"]),
    ("GPL-2.0 WITH nonsense", 0.7, ["gpl"]),
    ("LicenseRef-own", 1.0, ["licenseref-own"]),
    ("CC-BY-NC-SA-4.0", 0.9, ["cc-by-nc-sa"]),
    ("((BSD-3-Clause))", 0.0, ["bsd"]),
])
def test_expressions(text, value, labels):
    assert licences.evaluated(text) == (value, labels)


@pytest.mark.parametrize("text", ["", "OR", "MIT OR", "MIT GPL-2.0", "(MIT", "MIT)", "()", "(MIT OR GPL-2.0) WITH x-exception", "MIT WITH", "*/", "MIT WITH a-exception WITH b-exception"])
def test_what_does_not_parse(text):
    assert licences.evaluated(text) is None


TREE = st.recursive(st.sampled_from(["MIT", "GPL-2.0", "MPL-2.0", "AGPL-3.0", "X"]), lambda t: st.tuples(st.sampled_from(["OR", "AND"]), t, t), max_leaves=12)


@given(TREE)
def test_random_trees(tree):
    def shown(t, least=0):
        if isinstance(t, str):
            return t
        level = {"OR": 1, "AND": 2}[t[0]]
        text = f"{shown(t[1], level)} {t[0]} {shown(t[2], level + 1)}"
        return f"({text})" if level < least else text

    def value(t):
        return licences.family(t)[1] if isinstance(t, str) else (min if t[0] == "OR" else max)(value(t[1]), value(t[2]))

    assert licences.evaluated(shown(tree))[0] == value(tree)


@given(st.lists(st.sampled_from(["gnu", "General", "public", "LICENSE", "apache", "cc", "by", "nc", "mit", "é", "1", "x", ".", "-", "\n"]), max_size=40), st.sampled_from([" ", "-", "", "\t,"]))
def test_places_equal_a_plain_scan(words, gap):
    text = gap.join(words)
    n_words, places, _, _ = licences.scanned(text.encode(), MACHINE)
    base = [p for p in places if p[2] == "base"]
    assert (n_words, len(base), min((p[0] for p in base), default=None), max((p[0] for p in base), default=None), ",".join(sorted({p[3] for p in base}))) == plain(text)
    every = WORD.findall(text.lower())
    for first, last, kind, label in places:
        phrase = " ".join(every[first: last + 1])
        assert {"base": licences.BASE, "name": licences.NAMES, "notice": licences.NOTICES}[kind][phrase] == label


def test_scan_cases(spark):
    texts = [None, "", "Cc by. CC-BY, cc  BY x", "// SPDX-License-Identifier: (MIT OR GPL-2.0-only) AND Apache-2.0 */\nx", "SPDX-License-Identifier: MIT GPL", "cc by " * 5000,
             "Permission is hereby granted, free of charge, to any person obtaining a copy", "xSPDX-License-Identifier: MIT", "é SPDX-License-Identifier:MIT\nLicense-Expression: ISC"]
    docs = spark.createDataFrame([(None if k == 1 else k, t, "clash") for k, t in enumerate(texts)], "doc_id long, text string, score string")
    got = {r.doc_id: r for r in licences.scan(docs).collect()}
    assert len(got) == len(texts) and (got[0].n_words, got[0].places, got[0].score) == (0, [], 0.0) and got[None].n_words == 0
    assert [(p.first, p.label) for p in got[2].places] == [(0, "cc-by"), (2, "cc-by"), (4, "cc-by")]
    assert {p.label for p in got[3].places} == {"mit", "gpl", "apache"} and [tuple(e) for e in got[3].expressions] == [("(MIT OR GPL-2.0-only) AND Apache-2.0 */", 0.0)]
    assert got[4].places == [] and got[4].score == 0.0 and got[4].expressions[0].restriction is None
    assert len(got[5].places) == 5000 and abs(got[5].score - 0.6) < 1e-12
    assert [(p.first, p.last, p.kind, p.label) for p in got[6].places] == [(0, 12, "notice", "mit")]
    assert got[7].places == [] and got[7].expressions == []
    assert [(p.first, p.last, p.label) for p in got[8].places] == [(1, 4, "mit"), (4, 5, "mit"), (5, 7, "isc")]
    assert licences.scan(docs.limit(0)).collect() == []


def test_query_equals_brute_force(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in QUERIES["op13_licences"](spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == len(rows)
    for r in rows:
        g = got[r.doc_id]
        assert (g.n_words, g.n_base, g.first_word, g.last_word, g.base_labels) == plain(r.text)
        assert set(filter(None, g.base_labels.split(","))) <= set(filter(None, g.labels.split(","))) and 0 <= g.score <= 1
        assert g.labels == ",".join(sorted(set(filter(None, g.labels.split(",")))))
