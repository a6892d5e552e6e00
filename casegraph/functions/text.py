"""Text functions: trimming, normalization, character references, dates, category maps."""

from __future__ import annotations

import unicodedata
from html.entities import html5
from itertools import chain

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casegraph import fixed_values as fv
from casegraph.functions.binding import let


def literal_map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for x in chain(*values.items())])


def trim_ws(value: Column) -> Column:
    """Trim every whitespace character, not only spaces."""
    return F.btrim(value, F.lit(fv.WHITESPACE))


def is_ascii(value: Column) -> Column:
    return F.octet_length(value) == F.char_length(value)


def not_blank(value: Column) -> Column:
    return value.isNotNull() & (trim_ws(value) != "")


@F.pandas_udf(T.StringType())
def _nfkc(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v))


def nfkc(value: Column) -> Column:
    """Compatibility composition. Only non-ASCII values travel to Python; ASCII is already composed."""
    return F.coalesce(_nfkc(F.when(~is_ascii(value), value)), value)


def date_text(value: Column) -> Column:
    """What `date_of` reads: the trimmed value, NULL below ten characters, the shortest accepted spelling. Trimming is
    dear beside the rest, so values that begin and end with a visible ASCII character go without it."""
    visible = lambda at: F.substring(value, at, 1).between("!", "~")
    return F.when(F.char_length(value) >= 10, F.when(visible(1) & visible(-1), value).otherwise(trim_ws(value)))


def date_of(text: Column) -> Column:
    """Timestamp of a trimmed text in an accepted spelling, else NULL. One character that only one spelling has there
    picks the spelling, so one pattern at most is tried. `text` is named many times: give a column, not an expression."""
    part = lambda at, n: F.substring(text, at, n)
    pdf = F.regexp_replace(text, fv.DATE_PDF, "$1-$2-$3T$4:$5:$6$7:$8")
    exif = F.concat(part(1, 4), F.lit("-"), part(6, 2), F.lit("-"), part(9, 2), F.lit("T"), part(12, 8))
    rfc1123 = F.regexp_extract(text, fv.DATE_RFC1123, 1)
    return (
        F.when(part(5, 1) == "-", F.when(text.rlike(fv.DATE_ISO), text.try_cast("timestamp")))
        .when(part(5, 1) == ":", F.when(text.rlike(fv.DATE_EXIF), exif.try_cast("timestamp")))
        .when(part(2, 1) == ":", F.when(text.rlike(fv.DATE_PDF), F.rtrim(pdf, F.lit(":")).try_cast("timestamp")))
        .when(part(4, 1) == ",", F.when(text.rlike(fv.DATE_RFC1123), F.try_to_timestamp(rfc1123, F.lit("dd MMM yyyy HH:mm:ss"))))
        .when(part(3, 1) == "/", F.when(text.rlike(fv.DATE_SLASHED), F.try_to_timestamp(text, F.lit("MM/dd/yyyy[ HH:mm:ss]"))))
    )


def parse_date(value: Column) -> Column:
    """Timestamp of an accepted spelling, else NULL, as one expression."""
    return let(date_text(value), date_of)


def iso_date(ts: Column) -> Column:
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("0+00:00"))


def normalize_value(category: Column, value: Column, ascii_only: bool = False) -> Column:
    """Trim, compose, lower-case identifiers, rewrite dates. `ascii_only` skips the Python step."""
    base = trim_ws(value)
    composed = base if ascii_only else nfkc(base)
    return let(composed, lambda c: (
        F.when(category.isin(fv.LOWERED_CATEGORIES), F.lower(c))
        .when(category == "date", F.coalesce(iso_date(parse_date(c)), c))
        .otherwise(c)
    ))


# The named character references of HTML, from the standard library; `amp` is decoded last.
_ENTITIES = {name[:-1]: char for name, char in html5.items() if name.endswith(";") and name != "amp;"}


def html_decode(value: Column) -> Column:
    """Named references, then numeric ones, then `&amp;`, so nothing is decoded twice."""
    entities = F.map_from_arrays(F.split(F.lit(" ".join(_ENTITIES)), " "), F.split(F.lit("\x1f".join(_ENTITIES.values())), "\x1f"))
    out = F.aggregate(
        F.array_distinct(F.regexp_extract_all(value, F.lit(r"&([A-Za-z][A-Za-z0-9]*);"), F.lit(1))), value,
        lambda acc, name: F.coalesce(F.replace(acc, F.concat(F.lit("&"), name, F.lit(";")), entities[name]), acc),
    )
    out = _numeric(out, r"&#(\d{1,7});", lambda n: F.concat(F.lit("&#"), n, F.lit(";")), 10)
    out = _numeric(out, r"&#[xX]([0-9A-Fa-f]{1,6});", lambda n: F.concat(F.lit("&#x"), n, F.lit(";")), 16)
    out = F.replace(out, F.lit("&amp;"), F.lit("&"))
    return F.when(F.contains(value, F.lit("&")), out).otherwise(value)


def _numeric(value: Column, pattern: str, spell, base: int) -> Column:
    def char(digits: Column) -> Column:
        code = F.conv(digits, base, 10).cast("long")
        valid = ((code > 0) & (code < 0xD800)) | ((code > 0xDFFF) & (code <= 0x10FFFF))
        text = F.decode(F.unhex(F.lpad(F.hex(F.when(valid, code).otherwise(F.lit(0xFFFD))), 8, "0")), "UTF-32")
        return F.when(valid, text).otherwise(F.lit("�"))

    spelled = F.replace(value, F.lit("&#X"), F.lit("&#x")) if base == 16 else value
    return F.when(
        F.contains(value, F.lit("&#")),
        F.aggregate(
            F.array_distinct(F.regexp_extract_all(value, F.lit(pattern), F.lit(1))),
            spelled,
            lambda acc, digits: F.replace(acc, spell(digits), char(digits)),
        ),
    ).otherwise(value)


def slug_property(name: Column) -> Column:
    """Letters and digits kept in lower case, everything else `_`, with the `custom.` prefix."""
    return F.concat(F.lit("custom."), F.regexp_replace(F.lower(trim_ws(name)), r"[^\p{L}\p{Nd}]", "_"))


def map_custom_property(name: Column) -> Column:
    slug = F.btrim(F.regexp_replace(F.lower(trim_ws(name)), r"[^a-z0-9]", "_"), F.lit("_"))
    return F.coalesce(literal_map(fv.CUSTOM_PROPERTIES)[slug], F.concat(F.lit("custom."), slug))


def map_text_key(key: Column) -> Column:
    k = F.lower(key)
    return (
        F.when(literal_map(fv.TEXT_KEYS)[k].isNotNull(), literal_map(fv.TEXT_KEYS)[k])
        .when(F.contains(k, F.lit("printer")), F.lit("printer"))
        .otherwise(F.concat(F.lit("config."), F.replace(k, F.lit(" "), F.lit("_"))))
    )


def map_office_element(name: Column) -> Column:
    return literal_map({k.lower(): v for k, v in fv.OFFICE_ELEMENTS.items()})[F.lower(name)]


def map_xmp_property(name: Column, table: dict[str, str] | None = None) -> Column:
    k = F.lower(name)
    return F.coalesce(literal_map(table or fv.XMP_PROPERTIES)[k], F.concat(F.lit("xmp."), k))


def map_image_tag(tag: Column) -> Column:
    k = F.lower(tag)
    out = F
    for needle, category in fv.IMAGE_TAG_RULES:
        out = out.when(F.contains(k, F.lit(needle)), F.lit(category))
    return out.otherwise(F.concat(F.lit("image."), F.replace(k, F.lit(" "), F.lit("_"))))


def classify_reference(target: Column) -> Column:
    """Absolute URI -> url; UNC, drive, parent or rooted path -> path; else external_relationship."""
    return (
        F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]+:"), "url")
        .when(target.rlike(r"^(\\\\|[A-Za-z]:.|\.\./|/)"), "path")
        .otherwise("external_relationship")
    )


def user_from_path(path: Column) -> Column:
    user = F.regexp_extract(F.replace(path, F.lit("/"), F.lit("\\")), fv.USER_IN_PROFILE_PATH, 1)
    return F.when(user != "", user)


def safe_entry_path(name: Column) -> Column:
    unix = F.replace(name, F.lit("\\"), F.lit("/"))
    rooted = F.startswith(unix, F.lit("/")) | unix.rlike("^[A-Za-z]:")
    return ~rooted & ~F.array_contains(F.split(unix, "/"), "..")


def valid_hash_id(value: Column) -> Column:
    return value.rlike(r"^(?:[0-9A-Fa-f]{32}|[0-9A-Fa-f]{40}|[0-9A-Fa-f]{64})$")


def extension_of(path: Column) -> Column:
    name = F.regexp_extract(path, r"[^/\\]*$", 0)
    return F.when(F.contains(name, F.lit(".")), F.lower(F.substring_index(name, ".", -1))).otherwise(F.lit(""))


def extension_kind(path: Column) -> Column:
    return literal_map(fv.EXTENSION_KINDS)[extension_of(path)]


def rank_of(value: Column, ranks: dict[str, int]) -> Column:
    return F.create_map(*[F.lit(x) for x in chain(*ranks.items())])[value]


def stable_id(*parts: Column) -> Column:
    """Deterministic row key: re-runs write the same id."""
    return F.substring(F.sha2(F.concat_ws("\x01", *parts), 256), 1, 32)
