"""Registries: artifact kind -> extractor, provider id -> source. First registered entry wins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casegraph import fixed_values as fv
from casegraph.operators import artifacts as art
from casegraph.operators import containers, text_extract, xml_extract
from casegraph.operators.observations import COLUMNS, diagnostics

Extractor = Callable[[DataFrame], tuple[DataFrame, DataFrame]]


def _text_of(df: DataFrame) -> DataFrame:
    """Text as a text reader shows it: a byte order mark decides the encoding and is dropped, else UTF-8; broken
    sequences become the replacement character."""
    lead, content = F.hex(F.substring("content", 1, 4)), F.col("content")
    wide = F.startswith(lead, F.lit("FFFE")) | F.startswith(lead, F.lit("FEFF")) | (lead == "0000FEFF")
    body = F.when(F.startswith(lead, F.lit("EFBBBF")), F.substring(content, 4, F.length(content))).otherwise(content)
    # only wide texts travel to Python
    text = F.when(wide, text_extract.wide_text(F.when(wide, content))).otherwise(F.make_valid_utf8(body.cast("string")))
    return df.select("artifact_id", text.alias("text"))


def extract_containers(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    entries = containers.container_entries(df)
    return containers.office_properties(entries), containers.container_diagnostics(entries)


def extract_svg(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    xml = df.select("artifact_id", F.col("content").alias("xml"))  # bytes: the parser follows their declaration
    bad = xml_extract.xml_nodes(xml).filter(F.col("name") == xml_extract.ERROR)
    return xml_extract.svg_metadata(xml), diagnostics(bad, "svg.invalid", F.col("value"), True)


def extract_pdf(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    text = _text_of(df)
    rows = (
        art.pdf_info(df)
        .unionByName(xml_extract.xmp_packets(text)).unionByName(text_extract.loose_xmp(text))
        .unionByName(text_extract.legacy_indicators(df, "builtin.pdf", "pdf/raw"))
    )
    return rows, xml_extract.xmp_diagnostics(text)


def extract_indesign(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    text = _text_of(df)
    rows = (
        text_extract.legacy_indicators(df, "builtin.indesign", "indesign/binary")
        .unionByName(xml_extract.xmp_packets(text, "builtin.indesign", "indesign"))
        .unionByName(art.embedded_images(df))
    )
    return rows, xml_extract.xmp_diagnostics(text, "indesign")


def extract_text(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    text = _text_of(df)
    return text_extract.text_key_values(text).unionByName(text_extract.text_emails(text)), _none(df)


def extract_word_perfect(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return text_extract.legacy_indicators(df, "builtin.wordperfect", "wordperfect/binary"), _none(df)


def extract_strings(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return text_extract.binary_strings(df), _none(df)


def _none(df: DataFrame) -> DataFrame:
    return diagnostics(df.limit(0), "none", F.lit(""), False)


class ExtractorRegistry:
    """Routes artifacts by kind; an unsupported kind yields a diagnostic, not an error."""

    def __init__(self) -> None:
        self._entries: list[tuple[str, list[str], Extractor]] = []

    def register(self, name: str, kinds: list[str], extractor: Extractor) -> "ExtractorRegistry":
        self._entries.append((name, kinds, extractor))
        return self

    def select(self, kind: str) -> str | None:
        return next((name for name, kinds, _ in self._entries if kind in kinds), None)

    def extract(self, artifacts: DataFrame) -> tuple[DataFrame, DataFrame]:
        """artifacts(artifact_id, kind, size, content, ..) -> (observations, diagnostics)."""
        taken: list[str] = []
        observations = found = None
        for _, kinds, extractor in self._entries:
            mine = [k for k in kinds if k not in taken]
            taken += mine
            if not mine:
                continue
            rows, notes = extractor(artifacts.filter(F.col("kind").isin(mine)))
            observations = rows.select(*COLUMNS) if observations is None else observations.unionByName(rows.select(*COLUMNS))
            found = notes if found is None else found.unionByName(notes)
        unsupported = diagnostics(
            artifacts.filter(~F.col("kind").isin(taken)), "extractor.unsupported",
            F.concat(F.lit("No extractor for kind "), F.col("kind")), True)
        return observations, unsupported if found is None else found.unionByName(unsupported)


def default_extractors() -> ExtractorRegistry:
    return (
        ExtractorRegistry()
        .register("builtin.zip-xml", ["open_xml", "open_document", "zip"], extract_containers)
        .register("builtin.svg", ["svg"], extract_svg)
        .register("builtin.pdf", ["pdf"], extract_pdf)
        .register("builtin.indesign", ["in_design"], extract_indesign)
        .register("builtin.wordperfect", ["word_perfect"], extract_word_perfect)
        .register("builtin.text", ["text", "rdp", "ica"], extract_text)
        .register("builtin.binary-strings", ["unknown"], extract_strings)
    )


class SearchProviderRegistry:
    """Provider id -> zero-argument reader of (url, title, snippet) rows. Unknown ids become failed requests."""

    def __init__(self) -> None:
        self._sources: dict[str, Callable[[], DataFrame]] = {}

    def register(self, provider_id: str, source: Callable[[], DataFrame]) -> "SearchProviderRegistry":
        self._sources.setdefault(provider_id.lower(), source)
        return self

    def discover(self, spark, requested: list[str]) -> tuple[DataFrame, DataFrame]:
        """(results with provider_id and provider_no, journal rows)."""
        results, journal = None, []
        for number, provider_id in enumerate(dict.fromkeys(p.lower() for p in requested)):
            source = self._sources.get(provider_id)
            if source is None:
                journal.append((provider_id, "failed", 1, fv.UNKNOWN_PROVIDER))
                continue
            rows = source().select("url", "title", "snippet").withColumns(
                {"provider_id": F.lit(provider_id), "provider_no": F.lit(number)})
            results = rows if results is None else results.unionByName(rows)
            journal.append((provider_id, "completed", 0, None))
        schema = "provider_id string, status string, attempt_count int, last_error string"
        if results is None:
            results = spark.createDataFrame(
                [], "url string, title string, snippet string, provider_id string, provider_no int")
        return results, spark.createDataFrame(journal, schema)
