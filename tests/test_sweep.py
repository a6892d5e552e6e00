"""One-pass sweeps against one regular expression after another in the JVM, and their speed on hostile texts."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from casegraph import fixed_values as fv
from casegraph.operators import artifacts, sweep, swept, text_extract

PARTS = ["a", "Bc", "9", "_", ".", "..", "+", "-", "@", "x@y.zz", "a.b@c-d.org", "é", "Ω", "\\", "\\\\", "\\\\srv\\share", "C:\\", "c:\\dir\\", "Users\\ann\\", ":", "/",
         "http://", "HTTPS://h.test/x", "ftp://", "ldap://z/y", "://", " ", "\t", "\n", "\0", "=", "\"", "'", "<", ">", "<dc:", "<DC:creator>Ann<", "<pdf:x y='1'>v</",
         "<xmp:", "xap:k = \"v\"", "photoshop:a='b'", "printer", "PrintTo: ", "winspool", "Adobe", "Microsoft Word", "corel wordperfect", "DDEAUTO", "&amp;"]


def texts(seed, n=300):
    rng = random.Random(seed)
    return ["".join(rng.choices(PARTS, k=rng.randrange(1, 40))) for _ in range(n)]


def jvm(spark, rows, patterns):
    """Matches of each pattern by Spark's own function."""
    df = spark.createDataFrame(list(enumerate(rows)), "i int, text string")
    found = df.select("i", *[F.regexp_extract_all("text", F.lit(p), F.lit(0)).alias(f"p{k}") for k, p in enumerate(patterns)]).collect()
    return {r.i: [r[f"p{k}"] for k in range(len(patterns))] for r in found}


@pytest.mark.parametrize("patterns,expressions", [
    (text_extract._string_patterns, [fv.EMAIL, fv.UNC_PATH, fv.URL, fv.WINDOWS_PATH, fv.XMP_STRING]),
    (text_extract._indicator_patterns, [fv.EMAIL_UNGUARDED, fv.INDICATOR_URL, fv.INDICATOR_PATH, fv.INDICATOR_PRINTER, fv.INDICATOR_APPLICATION]),
])
def test_one_pass_equals_separate_patterns(spark, patterns, expressions):
    rows = texts(1)
    scanner, expected = sweep.Scanner(patterns()), jvm(spark, rows, expressions)
    for k, text in enumerate(rows):
        assert [[text[a:b] for a, b in own] for own in scanner.matches(text)] == expected[k]


def test_loose_properties_equal_separate_patterns(spark):
    rows = texts(2)
    expected = jvm(spark, rows, [fv.LOOSE_XMP_ELEMENT, fv.LOOSE_XMP_ATTRIBUTE])
    df = spark.createDataFrame(list(enumerate(rows)) + [(len(rows), rows[0])] * 2, "i int, text string").coalesce(1)
    for r in df.select("i", swept.loose_properties("text").alias("found")).collect():
        assert [[h.value for h in r.found if h.pattern_no == k] for k in (0, 1)] == expected[r.i % len(rows)]


def test_spans_equal_a_lazy_pattern():
    rng = random.Random(3)
    pairs = [(b"<a", b"</a>"), (b"<b>", b"/b"), (b"xx", b"x")]
    lazy = re.compile(b"|".join(re.escape(o) + b".*?" + re.escape(c) for o, c in pairs), re.S)
    for _ in range(3000):
        data = b"".join(rng.choices([b"<a", b"</a>", b"<b>", b"/b", b"x", b"xx", b"-", b"<", b">"], k=rng.randrange(14)))
        found = sweep.spans(data, pairs)
        # the pattern takes the first pair in order at one place; openers here differ at every place
        assert found == [m.span() for m in lazy.finditer(data)]


def test_hostile_texts_are_read_once(spark):
    """A million openers without closers, at-signs, brackets and quotes."""
    many = 1_000_000
    began = time.perf_counter()
    assert sweep.spans(b"\xff\xd8\xff" * many, sweep.IMAGES) == [] and sweep.spans(b"<rdf:rdf" * many + b"<x:xmpmeta", sweep.PACKETS) == []
    assert sweep.Scanner(text_extract._string_patterns()).matches("<dc:a" * many) == [[]] * 5
    assert sweep.Scanner(text_extract._string_patterns()).matches("<dc:a" * many + ">")[4] == []
    assert sweep.Scanner(text_extract._indicator_patterns()).matches("a@" * many)[0] == []
    assert len(sweep.Scanner(text_extract._indicator_patterns()).matches("a" * many + "@b.cc")[0]) == 1
    df = spark.createDataFrame([("t", "dc:a=\"" * many)], "artifact_id string, text string")
    assert text_extract.loose_xmp(df).count() >= 0
    assert time.perf_counter() - began < 60


def test_pdf_keys_in_one_sweep(spark):
    """Keys inside strings and comments of other keys, as one pattern after another reads them."""
    rng = random.Random(4)
    parts = ["/Author", "/Title", "/F", "/UF", "(", ")", "a", "\\(", "\\", "%c", "\n", " ", "<41", ">", "/Authors", "(x /Author (y))", "[", "\0"]
    rows = ["%PDF-1.4 " + "".join(rng.choices(parts, k=rng.randrange(30))) for _ in range(300)]
    expressions = [f"/{k}{guard}{artifacts._PDF_GAP}{artifacts._PDF_STRING}" for k, _, _, guard, _ in artifacts._PDF_KEYS]
    df = spark.createDataFrame(list(enumerate(rows)), "i int, text string")
    expected = df.select("i", *[F.regexp_extract_all("text", F.lit(p), F.lit(1)).alias(f"p{k}") for k, p in enumerate(expressions)]).collect()
    scanner = sweep.Scanner(artifacts._pdf_patterns(), fold=False)
    for r in expected:
        assert [[rows[r.i][a:b] for a, b in own] for own in scanner.matches(rows[r.i])] == [r[f"p{k}"] for k in range(len(expressions))]
