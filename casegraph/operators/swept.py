"""Column functions over the linear sweeps. They stand apart from `sweep`, which travels to the workers whole."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casegraph.operators.sweep import IMAGES, PACKETS, Pattern, Scanner, anchored, loose_element, spans

_NUMBERS = [T.StructField(name, T.IntegerType()) for name in ("pass_no", "pattern_no", "match_no")]
HITS = T.ArrayType(T.StructType([*_NUMBERS, T.StructField("value", T.StringType())]))
PROPERTIES = T.ArrayType(T.StructType([*_NUMBERS[1:], T.StructField("value", T.StringType())]))
SIZES = T.ArrayType(T.StructType([T.StructField("format", T.StringType()), T.StructField("size", T.LongType())]))


def binary_hits(patterns: Callable[[], list[Pattern]], limit: int | None = None, wide: bool = True, fold: bool = True) -> Callable[[Column], Column]:
    """content -> all matches of all patterns in its Latin-1 reading and, when `wide`, in its UTF-16LE reading (broken
    units become the replacement character), or the first `limit` of each pattern and reading."""

    @F.pandas_udf(HITS)
    def hits(contents: pd.Series) -> pd.Series:
        scanner = Scanner(patterns(), fold)

        def one(content) -> list[dict]:
            rows: list[dict] = []
            if content is None:
                return rows
            content = bytes(content)
            readings = [(content.decode("latin-1"), content.lower().decode("latin-1") if fold else None)]
            if wide:
                # folding bytes changes other characters too, but none into an ASCII one, and no length
                readings.append((content.decode("utf-16-le", errors="replace"), content.lower().decode("utf-16-le", errors="replace") if fold else None))
            for pass_no, (text, folded) in enumerate(readings):
                for pattern_no, spans_of in enumerate(scanner.matches(text, folded)):
                    rows += [{"pass_no": pass_no, "pattern_no": pattern_no, "match_no": n, "value": text[a:b]}
                             for n, (a, b) in enumerate(spans_of if limit is None else spans_of[:limit])]
            return rows

        return contents.map(one)

    return hits


@F.pandas_udf(PROPERTIES)
def loose_properties(texts: pd.Series) -> pd.Series:
    """Loose XML properties of a text: elements (pattern 0) and attributes (pattern 1)."""
    prefixes = ("dc", "xmp", "xap", "pdf", "photoshop")
    attribute = anchored(
        rf"""(?i)(?:{'|'.join(prefixes)}):[A-Za-z][A-Za-z0-9_-]*\s*=\s*["'][^"']+["']""", *[f"{p}:" for p in prefixes])
    scanner = Scanner([loose_element(*prefixes), attribute])

    def one(text) -> list[dict]:
        found = [] if text is None else scanner.matches(text)
        return [{"pattern_no": k, "match_no": n, "value": text[a:b]} for k, own in enumerate(found) for n, (a, b) in enumerate(own)]

    return texts.map(one)


@F.pandas_udf(SIZES)
def image_spans(contents: pd.Series) -> pd.Series:
    """Complete JPEG and PNG images inside a content."""

    def one(content) -> list[dict]:
        data = bytes(content or b"")
        return [{"format": "jpeg" if data[a] == 0xFF else "png", "size": b - a} for a, b in spans(data, IMAGES)]

    return contents.map(one)


@F.pandas_udf(T.ArrayType(T.StringType()))
def packet_spans(texts: pd.Series) -> pd.Series:
    """Complete XMP packets of a text, ASCII letters of the markers in either case."""

    def one(text) -> list[str]:
        data = (text or "").encode("utf-8", "surrogatepass")
        return [data[a:b].decode("utf-8", "replace") for a, b in spans(data.lower(), PACKETS)]

    return texts.map(one)
