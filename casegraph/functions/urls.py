"""URL functions built from string built-ins. They never raise; unusable input gives NULL."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casegraph.functions.binding import let, with_bound
from casegraph.functions.text import html_decode, is_ascii, trim_ws

HTTP = r"(?i)^https?://[^/?#\s]"
# What an HTML reader does not show as links: comments, scripts and styles; unclosed ones reach to the end.
HIDDEN = r"(?is)<!--.*?(?:-->|\z)|<(script|style)\b.*?(?:</\1\s*>|\z)"
_VALUE = r"""(?:\s*=\s*(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+))?+"""
ANCHOR = rf"""(?is)<a(?=[\s/])(?:[\s/]+[^\s=>/"']+{_VALUE})*+[\s/]*+>.*?(?=</a|<a\b|$)"""
HREF = rf"""(?is)^<a(?:[\s/]+(?!href[\s=])[^\s=>/"']+{_VALUE})*+[\s/]+href\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"'][^\s>]*))"""
TAG = r"""<(?:[^>"']++|"[^"]*+"|'[^']*+')*+>|<[^>]*>"""


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))


def _after_scheme(url: Column) -> Column:
    return F.substr(url, F.instr(url, F.lit("://")) + F.lit(3))


def authority(url: Column) -> Column:
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0)


def user_info(url: Column) -> Column:
    return F.regexp_extract(authority(url), r"^(.*)@", 1)


def host_port(url: Column) -> Column:
    return F.substring_index(authority(url), "@", -1)


def raw_host(url: Column) -> Column:
    return F.lower(F.regexp_replace(host_port(url), r":\d*$", ""))


def host(url: Column) -> Column:
    """Lower-case host without port, brackets or trailing dots."""
    return F.rtrim(F.btrim(raw_host(url), F.lit("[]")), F.lit("."))


def default_port(scheme_col: Column) -> Column:
    return F.when(scheme_col == "http", 80).when(scheme_col == "https", 443)


def port(url: Column) -> Column:
    given = F.regexp_extract(host_port(url), r":(\d{1,5})$", 1)
    return F.coalesce(F.when(given != "", given.cast("int")), default_port(scheme(url)))


def _no_fragment(url: Column) -> Column:
    return F.substring_index(url, "#", 1)


def raw_path(url: Column) -> Column:
    rest = F.substr(_after_scheme(url), F.length(authority(url)) + F.lit(1))
    return F.substring_index(F.substring_index(rest, "#", 1), "?", 1)


def path(url: Column) -> Column:
    """Escaped path with dot segments removed, never empty."""
    return let(raw_path(url), clean_path)


def clean_path(raw: Column) -> Column:
    escaped = let(F.when(raw.rlike(r"[^\x21-\x7e]"), escape_non_ascii(raw)).otherwise(raw), remove_dot_segments)
    return F.when(raw == "", F.lit("/")).when(raw.rlike(r"[^\x21-\x7e]|/\."), escaped).otherwise(raw)


def query(url: Column) -> Column:
    """Query with its `?`, or the empty string."""
    clean = _no_fragment(url)
    return F.when(F.contains(clean, F.lit("?")), F.substr(clean, F.instr(clean, F.lit("?")))).otherwise(F.lit(""))


def fragment(url: Column) -> Column:
    return F.when(F.contains(url, F.lit("#")), F.substr(url, F.instr(url, F.lit("#")))).otherwise(F.lit(""))


def escape_non_ascii(value: Column) -> Column:
    """UTF-8 percent-encoding of every character outside printable ASCII."""
    runs = F.regexp_extract_all(value, F.lit(r"[^\x21-\x7e]+|[\x21-\x7e]+"), F.lit(0))
    escaped = F.array_join(
        F.transform(
            runs,
            lambda run: F.when(
                run.rlike(r"^[^\x21-\x7e]"), F.regexp_replace(F.hex(F.encode(run, "UTF-8")), "(..)", "%$1")
            ).otherwise(run),
        ),
        "",
    )
    return F.when(value.rlike(r"[^\x21-\x7e]"), escaped).otherwise(value)


def remove_dot_segments(url_path: Column) -> Column:
    """RFC 3986 dot segments; the fold runs only on rows that contain one."""
    segments = F.split(url_path, "/")
    folded = F.aggregate(
        F.slice(segments, 2, F.size(segments)),
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        .when(s == ".", acc)
        .otherwise(F.array_append(acc, s)),
    )
    tail = F.when(url_path.rlike(r"/\.\.?$"), F.lit("/")).otherwise(F.lit(""))
    joined = F.concat(F.lit("/"), F.array_join(folded, "/"))
    return F.when(
        url_path.rlike(r"/\.\.?(/|$)"),
        F.when(F.endswith(joined, F.lit("/")), joined).otherwise(F.concat(joined, tail)),
    ).otherwise(url_path)


def is_http(url: Column) -> Column:
    return url.rlike(HTTP)


def _parts(url: Column) -> Column:
    """Pieces of a URL, cut once."""
    rest = _after_scheme(F.substring_index(url, "#", 1))
    return let(
        F.struct(scheme(url).alias("scheme"), rest.alias("rest"), F.regexp_extract(rest, r"^[^/?]*", 0).alias("authority"),
                 fragment(url).alias("fragment")),
        lambda p: let(F.substr(p["rest"], F.length(p["authority"]) + F.lit(1)), lambda tail: F.struct(
            p["scheme"].alias("scheme"),
            escape_non_ascii(F.regexp_extract(p["authority"], r"^(.*@)", 1)).alias("user"),
            F.lower(F.regexp_replace(F.substring_index(p["authority"], "@", -1), r":\d*$", "")).alias("host"),
            F.regexp_extract(F.substring_index(p["authority"], "@", -1), r":(\d+)$", 1).alias("port"),
            F.substring_index(tail, "?", 1).alias("path"),
            F.when(F.contains(tail, F.lit("?")), F.substr(tail, F.instr(tail, F.lit("?")))).otherwise(F.lit("")).alias("query"),
            p["fragment"].alias("fragment"),
        )),
    )


def _assemble(url: Column, *, host_col: Column | None = None, user: bool, query: bool, fragment: bool) -> Column:
    """Rebuild a URL: lower-case scheme and host (or `host_col` where it is given), default port dropped, clean path."""
    empty = F.lit("")

    def build(p: Column) -> Column:
        default = ((p["scheme"] == "http") & (p["port"] == "80")) | ((p["scheme"] == "https") & (p["port"] == "443"))
        pieces = [
            p["scheme"], F.lit("://"), p["user"] if user else empty, p["host"] if host_col is None else F.coalesce(host_col, p["host"]),
            F.when((p["port"] == "") | default, empty).otherwise(F.concat(F.lit(":"), p["port"])),
            clean_path(p["path"]),
        ]
        if query:
            pieces.append(escape_non_ascii(p["query"]))
        if fragment:
            pieces.append(escape_non_ascii(p["fragment"]))
        return F.concat(*pieces)

    return let(let(url, _parts), build)


def canonical_url(url: Column) -> Column:
    """Canonical form of an http(s) URL with an ASCII host; other URLs give NULL.

    Non-ASCII hosts need IDNA: use `with_canonical_url`, which sends only those rows to Python.
    """
    return let(trim_ws(url), lambda u: F.when(
        is_http(u) & is_ascii(raw_host(u)), _assemble(u, user=True, query=True, fragment=False)))


def absolute_uri(url: Column) -> Column:
    """Cleaned absolute http(s) URL that keeps its fragment."""
    return let(url, lambda u: F.when(is_http(u), _assemble(u, user=True, query=True, fragment=True)))


@F.pandas_udf(T.StringType())
def _punycode(hosts: pd.Series) -> pd.Series:
    def one(name):
        try:
            return None if name is None else name.encode("idna").decode("ascii")
        except UnicodeError:
            return None

    return hosts.map(one)


def ascii_host(name: Column) -> Column:
    """IDNA form of a host name; only non-ASCII names travel to Python."""
    return F.coalesce(_punycode(F.when(~is_ascii(name), name)), name)


def with_canonical_url(df: DataFrame, source: str, target: str) -> DataFrame:
    """Add the canonical URL, non-ASCII hosts in their IDNA form, in one pass: only those hosts travel to Python."""
    u = trim_ws(F.col(source))
    host = raw_host(u)
    named = df.withColumn("__host", _punycode(F.when(is_http(u) & ~is_ascii(host), host)))
    sound = is_http(u) & (is_ascii(host) | F.col("__host").isNotNull())
    return with_bound(named, **{target: F.when(sound, _assemble(u, host_col=F.lower("__host"), user=True, query=True, fragment=False))}).drop("__host")


def redact_uri(url: Column) -> Column:
    """Without user, password, query and fragment. NULL stays NULL, other text becomes a pseudonym."""
    from casegraph.functions.redact import pseudonymize

    return F.when(url.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#\s]"), bare_uri(url)).otherwise(pseudonymize(url))


def bare_uri(url: Column) -> Column:
    return _assemble(url, user=False, query=False, fragment=False)


def redact_destination(url: Column) -> Column:
    return F.when(is_http(url), bare_uri(url))


def resolve_link(base: Column, href: Column) -> Column:
    """Resolve a reference against a page URL (before cleaning)."""

    def against(p: Column) -> Column:
        root = F.concat(p["scheme"], F.lit("://"), p["authority"])
        return (
            F.when(F.startswith(href, F.lit("//")), F.concat(p["scheme"], F.lit(":"), href))
            .when(F.startswith(href, F.lit("/")), F.concat(root, href))
            .when(F.startswith(href, F.lit("?")), F.concat(root, p["path"], href))
            .when((href == "") | F.startswith(href, F.lit("#")), F.concat(root, p["path"], query(base), href))
            .otherwise(F.concat(root, F.regexp_extract(p["path"], r"^.*/", 0), href))
        )

    cut = F.struct(
        scheme(base).alias("scheme"), authority(base).alias("authority"),
        F.when(raw_path(base) == "", F.lit("/")).otherwise(raw_path(base)).alias("path"),
    )
    return F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), href).otherwise(let(cut, against))


def anchors(html: Column) -> Column:
    """array<struct<position, href, text>> of the anchors of a page."""
    shown = F.when(html.rlike("(?i)<!--|<script|<style"), F.regexp_replace(html, HIDDEN, "")).otherwise(html)
    return F.transform(
        F.filter(F.regexp_extract_all(shown, F.lit(ANCHOR), F.lit(0)), lambda tag: tag.rlike(HREF)),
        lambda tag, i: F.struct(
            i.alias("position"),
            let(
                F.concat(F.regexp_extract(tag, HREF, 1), F.regexp_extract(tag, HREF, 2), F.regexp_extract(tag, HREF, 3)),
                lambda raw: trim_ws(html_decode(raw)),
            ).alias("href"),
            let(F.regexp_replace(tag, TAG, ""), lambda raw: trim_ws(html_decode(raw))).alias("text"),
        ),
    )


def host_suffixes(host_col: Column) -> Column:
    """The host and every parent domain, for an equi-join on domain scopes."""
    labels = F.split(host_col, r"\.")
    return F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )


def below_host(host_col: Column, target: Column) -> Column:
    t = F.lower(target)
    return (host_col == t) | F.endswith(host_col, F.concat(F.lit("."), t))


def has_file_type(url_path: Column, types: list[str]) -> Column:
    lowered = F.lower(url_path)
    out = F.lit(False)
    for file_type in types:
        out = out | F.endswith(lowered, F.lit("." + file_type.lower()))
    return out
