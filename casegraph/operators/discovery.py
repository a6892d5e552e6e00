"""Links, candidates, site maps, DNS name filtering and saved-response flattening."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casegraph import fixed_values as fv
from casegraph import schemas
from casegraph.functions import net, urls
from casegraph.functions.binding import explode_rows, with_bound
from casegraph.functions.ordered import first_wins, ranked
from casegraph.session import scratch_path, shared_folder


def extract_links(pages: DataFrame, url: str = "url", html: str = "html", keep: tuple[str, ...] = ()) -> DataFrame:
    """(source_url, position, url, text) of the http(s) links of each page, resolved against the page URL, after the
    columns of the page to `keep`."""
    links = explode_rows(pages, urls.anchors(F.col(html)), "a", *keep, F.col(url).alias("source_url"))
    resolved = with_bound(
        links, url=urls.absolute_uri(urls.resolve_link(F.col("source_url"), F.col("a.href"))))
    return resolved.filter(F.col("url").isNotNull()).select(
        *keep, "source_url", F.col("a.position").alias("position"), "url", F.col("a.text").alias("text"))


BLOCK = 1024


def expand_cidr(prefixes: DataFrame, cidr: str = "cidr", budget: int | None = None) -> DataFrame:
    """(cidr, address): addresses from the masked network upward, all of them or at most `budget` (up to 2^62) per prefix.

    An address is eight groups of 16 bits (a v4 address is the last two); each group is counted up by its own host bits,
    so neither an array nor a number grows with the range, whatever its prefix length. A budget is the index of the last
    address in the same groups: a group is cut short while all groups before it stand at their last value.

    The last group is counted in blocks of `BLOCK` addresses that are dealt out evenly first, so a task's work follows the
    addresses, not the prefixes it was given; an address's leading text is made once per block."""
    spread = int(prefixes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parsed = with_bound(
        prefixes.select(F.col(cidr).alias("cidr")).repartition(spread), hex=net.cidr_network(F.col("cidr")), prefix=net.cidr_prefix(F.col("cidr")))
    masked = with_bound(parsed, net=net.masked_hex(F.col("hex"), F.col("prefix"))).filter(F.col("net").isNotNull())
    rows = masked.select(
        "cidr", F.lpad("net", 32, "0").alias("digits"), (F.length("net") == 8).alias("v4"),
        (F.length("net") * 4 - F.col("prefix")).alias("host_bits"), F.lit(True).alias("tight"), F.lit("").alias("done"))
    group_value = lambda group: F.conv(F.substring("digits", 4 * group + 1, 4), 16, 10).cast("int")

    def last_of(group: int) -> Column:
        ones = F.least(F.greatest(F.col("host_bits") - 16 * (7 - group), F.lit(0)), F.lit(16))
        top = F.call_function("shiftleft", F.lit(1), ones) - 1
        if budget is None:
            return top.cast("int")
        end = (max(1, budget) - 1) >> 16 * (7 - group)
        above = F.lit(end) if group == 0 else F.when(F.col("tight"), F.least(top, F.lit(end & 0xFFFF))).otherwise(top)
        # a budget beyond the range leaves a higher group above its own last value: nothing is cut then
        beyond = F.col("host_bits") < F.lit((max(1, budget) - 1).bit_length())
        return F.when(beyond, top).otherwise(F.least(above, top)).cast("int")

    for group in range(7):
        counted = rows.withColumn("last", last_of(group)).withColumn("n", F.explode(F.sequence(F.lit(0), F.col("last"))))
        rows = counted.select(
            "cidr", "digits", "v4", "host_bits", (F.col("tight") & (F.col("n") == F.col("last"))).alias("tight"),
            F.concat("done", F.lower(F.lpad(F.hex(group_value(group) + F.col("n")), 4, "0"))).alias("done"))
    blocks = rows.select("cidr", "v4", "done", group_value(7).alias("base"), last_of(7).alias("last")).select(
        "*", F.explode(F.sequence(F.lit(0), F.col("last"), F.lit(BLOCK))).alias("low")).repartition(spread)
    high = F.conv(F.substring("done", 25, 4), 16, 10).cast("int")
    after = net.v6_text(F.concat("done", F.lit("ffff")))  # any group but zero leaves the text before it the same
    headed = with_bound(
        blocks, head=F.when(F.col("v4"), F.concat(F.floor(high / 256).cast("string"), F.lit("."), (high % 256).cast("string"), F.lit(".")))
        .otherwise(F.substr(after, F.lit(1), F.length(after) - 4)),
        zero=F.when(~F.col("v4") & (F.col("base") + F.col("low") == 0), net.v6_text(F.concat("done", F.lit("0000")))))
    numbers = F.sequence(F.col("base") + F.col("low"), F.col("base") + F.least(F.col("last"), F.col("low") + BLOCK - 1))
    n = F.col("n")
    v4 = F.concat("head", F.shiftright(n, 8).cast("string"), F.lit("."), n.bitwiseAND(F.lit(255)).cast("string"))
    v6 = F.when(n == 0, F.col("zero")).otherwise(F.concat("head", F.lower(F.hex(n))))
    return headed.select("cidr", "v4", "head", "zero", F.explode(numbers).alias("n")).select(
        "cidr", F.when(F.col("v4"), v4).otherwise(v6).alias("address"))


def non_public_ranges(prefixes: DataFrame, cidr: str = "cidr") -> DataFrame:
    """Prefixes that hold any non-public address, by their first and last address: nothing is expanded."""
    parsed = with_bound(
        prefixes.select(F.col(cidr).alias("cidr")), hex=net.cidr_network(F.col("cidr")), prefix=net.cidr_prefix(F.col("cidr")))
    edges = with_bound(parsed, low=net.masked_hex(F.col("hex"), F.col("prefix")), high=net.last_hex(F.col("hex"), F.col("prefix")))
    return edges.filter(net.overlaps_non_public(F.col("low"), F.col("high"))).select("cidr").distinct()


def candidate_names(labels: DataFrame, domains: DataFrame, order: list[str], budget: int | None = None,
                    block: int = 1024, salts: int = 8) -> DataFrame:
    """label.domain names: trim, lower, distinct, with a `budget` the first so many labels in `order`, then the label rule
    (labels that break it use the budget).

    A product by definition, dealt out in parts: labels by rank into blocks of `block`, domains into `salts` shares; each
    task joins one block with one share. No side is gathered or broadcast, and a share is as large as its domains make it."""
    cleaned = labels.withColumn("label", F.lower(F.trim("label"))).filter(F.col("label") != "")
    numbered = ranked(first_wins(cleaned.select("label", *order), ["label"], order), [], [*map(F.col, order), F.col("label")], "rank")
    if budget is not None:
        numbered = numbered.filter(F.col("rank") <= max(1, budget))
    blocks = (
        numbered.filter(F.col("label").rlike(fv.LABEL_PATTERN))
        .groupBy(F.floor((F.col("rank") - 1) / block).alias("block")).agg(F.collect_list("label").alias("labels")))
    blocks = blocks.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).checkpoint()
    numbers = blocks.filter("salt = 0").agg(F.max("block")).first()[0]
    if numbers is None:
        return domains.limit(0).select(F.lit("").alias("name"), "domain", F.lit("").alias("label"))
    shares = domains.select("domain", F.pmod(F.xxhash64("domain"), F.lit(salts)).cast("int").alias("salt"),
                            F.explode(F.sequence(F.lit(0).cast("long"), F.lit(numbers).cast("long"))).alias("block"))
    return (
        shares.join(blocks, ["block", "salt"]).select("domain", F.explode("labels").alias("label"))
        .select(F.concat_ws(".", "label", F.rtrim("domain", F.lit("."))).alias("name"), "domain", "label")
    )


def backup_candidates(resources: DataFrame, url: str = "url") -> DataFrame:
    """(url, candidate): file path plus each backup suffix, query and fragment dropped."""
    u = F.col(url)
    suffixes = F.array(*[F.lit(s) for s in fv.BACKUP_SUFFIXES])
    return (
        resources.filter(urls.is_http(u) & ~F.endswith(urls.path(u), F.lit("/")))
        .select(u.alias("url"), F.posexplode(suffixes).alias("suffix_no", "suffix"))
        .select("url", "suffix_no", F.concat(urls.bare_uri(F.col("url")), F.col("suffix")).alias("candidate"))
    )


def union_candidates(resources: DataFrame, roots: DataFrame, limit: int | None, order: str, url: str = "url") -> DataFrame:
    """Generated candidates, then the fixed root files, distinct; with a `limit` the first in that order."""
    generated = backup_candidates(resources, url).join(
        resources.select(F.col(url).alias("url"), F.col(order).alias("__o")), "url"
    ).select("candidate", F.lit(0).alias("part"), F.col("__o").cast("long").alias("o"), "suffix_no")
    fixed = roots.select(
        F.posexplode(F.array(*[
            urls.absolute_uri(urls.resolve_link(F.col("root"), F.lit(name))) for name in fv.BACKUP_ROOT_FILES
        ])).alias("suffix_no", "candidate"), F.lit(1).alias("part"), F.lit(0).cast("long").alias("o"),
    ).select("candidate", "part", "o", "suffix_no")
    keys = ["part", "o", "suffix_no"]
    distinct = first_wins(generated.unionByName(fixed), ["candidate"], keys)
    return (distinct if limit is None else distinct.orderBy(*keys, "candidate").limit(limit)).select("candidate")


def exposed_backups(candidates: DataFrame, responses: DataFrame) -> DataFrame:
    """Findings for candidates that answered 2xx in a captured response log (canonical_url, status_code)."""
    hits = responses.filter(F.col("status_code").between(200, 299)).select("canonical_url").distinct()
    return (
        urls.with_canonical_url(candidates.select("candidate").distinct(), "candidate", "canonical_url")
        .join(hits, "canonical_url", "left_semi")
        .select(
            F.lit("web.backup.exposed").alias("rule_id"), F.lit(fv.BACKUP_TITLE).alias("title"),
            F.col("candidate").alias("description"), F.lit("high").alias("severity"), F.lit(0.85).alias("confidence"),
        )
    )


def wildcard_suppressed_names(answers: DataFrame, probes: DataFrame) -> DataFrame:
    """Names (name, domain) whose address set differs from the wildcard probe of their domain.

    Set equality by counting: a name equals the probe when it has as many distinct addresses as the probe and all of
    them are probe addresses. Nothing is collected per name."""
    names = answers.select("domain", "name", "address").filter(F.col("address").isNotNull()).distinct()
    probe = probes.select("domain", "address").filter(F.col("address").isNotNull()).distinct()
    probe_size = probe.groupBy("domain").agg(F.count(F.lit(1)).alias("probe_n"))
    marked = names.join(probe.withColumn("in_probe", F.lit(1)), ["domain", "address"], "left")
    sizes = marked.groupBy("domain", "name").agg(F.count(F.lit(1)).alias("n"), F.count("in_probe").alias("shared"))
    return (
        sizes.join(probe_size, "domain", "left")
        .filter(F.col("probe_n").isNull() | (F.col("n") != F.col("probe_n")) | (F.col("shared") != F.col("probe_n")))
        .select("domain", "name", F.col("n").alias("addresses"))
    )


def target_filetype_filter(resources: DataFrame, target: str, types: list[str], url: str = "url") -> DataFrame:
    u = F.col(url)
    return resources.filter(urls.below_host(urls.host(u), F.lit(target)) & urls.has_file_type(urls.path(u), types))


def site_map(
    links: DataFrame, roots: DataFrame, max_depth: int, max_pages: int | None = None, canonical: bool = True
) -> DataFrame:
    """Breadth-first walk of captured links, all roots in parallel.

    links: (source_url, position, url, text); roots: (root). Output: (root, url, text, depth) for every same-host link
    on a visited page, first sighting wins; links found at `max_depth` are recorded but not followed. With `max_pages` at
    most so many pages are visited per root, in queue order; without, all, and no root's pages are ranked.

    The edges are written once, bucketed by page, so a level moves its frontier and what it finds, never the edges. What a
    level finds for the first time is one checkpoint: the level's part of the result and the next frontier."""
    shared_folder(links.sparkSession)
    same_host = urls.raw_host(F.col("source_url")) == urls.raw_host(F.col("url"))
    keyed = urls.with_canonical_url(urls.with_canonical_url(links.filter(same_host), "source_url", "__page"), "url", "__target")
    edges = _bucketed(keyed.filter(F.col("__target").isNotNull() & F.col("__page").isNotNull()).select(
        F.lower("__page").alias("page"), "position", F.col("url").alias("target_url"), F.lower("__target").alias("target"), "text"), "page")
    # order: the queue order as a sortable string, parent's key then link position
    start = urls.with_canonical_url(roots.select("root"), "root", "__page").select("root", F.lower("__page").alias("page")).checkpoint()
    frontier = start.select("root", "page", F.lit("").alias("order"))
    visited, found = None, None
    for depth in range(max_depth + 1):
        if max_pages is not None:
            frontier = _within_budget(frontier, visited, max_pages).checkpoint()
            visited = frontier.select("root", "page") if visited is None else visited.unionByName(frontier.select("root", "page"))
        level = frontier.join(edges, "page").select(
            "root", F.col("target").alias("page"), F.col("target_url").alias("url"), "text",
            F.concat("order", F.lpad(F.col("position").cast("string"), 8, "0")).alias("order"),
            F.lit(depth + 1).alias("depth"),
        )
        level = first_wins(level, ["root", "page"], ["order"])
        if found is not None:
            level = level.join(found.select("root", "page"), ["root", "page"], "left_anti")
        level = level.checkpoint()
        found = level if found is None else found.unionByName(level)
        frontier = level.join(start, ["root", "page"], "left_anti").select("root", "page", "order")  # a root was visited first
        if frontier.isEmpty():
            break
    return found.select("root", "url", "text", "depth")


def _bucketed(df: DataFrame, key: str) -> DataFrame:
    """`df` as a table of hash buckets in the shared folder: joins on `key` read it without a shuffle."""
    spark = df.sparkSession
    path = scratch_path(spark, "bucketed")
    name = os.path.basename(path).replace("-", "_")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(name)
    return spark.table(name)


def _within_budget(frontier: DataFrame, visited: DataFrame | None, max_pages: int) -> DataFrame:
    """Keep a root's first pages while its budget lasts. The rank limit is a constant, so it is applied before the
    shuffle and a root with a huge frontier sends at most `max_pages` rows per task."""
    from pyspark.sql import Window as W

    rank = F.row_number().over(W.partitionBy("root").orderBy("order", "page"))
    ranked = frontier.withColumn("__rank", rank).filter(F.col("__rank") <= max_pages)
    if visited is not None:
        used = visited.groupBy("root").agg(F.count(F.lit(1)).alias("__used"))
        ranked = ranked.join(used, "root", "left").filter(
            F.col("__rank") <= max_pages - F.coalesce("__used", F.lit(0))
        )
    return ranked.select("root", "page", "order")


def host_intel_flatten(responses: DataFrame, body: str = "body") -> tuple[DataFrame, DataFrame]:
    """(requested_ip, body) -> host rows and service rows of saved host documents."""
    doc = responses.select("requested_ip", F.from_json(body, schemas.HOST_DOCUMENT).alias("d")).filter(
        F.col("d").isNotNull())
    lists = ["ports", "hostnames", "domains", "tags", "cpe"]
    plain = ["ip_str", "org", "isp", "asn", "os", "last_update", "country_code", "country_name", "city", "region_code",
             "latitude", "longitude"]
    hosts = doc.select(
        "requested_ip", *[F.col(f"d.{c}").alias(c) for c in plain],
        *[F.col(f"d.{c}").alias(c) for c in lists], F.size("d.data").alias("service_count"),
    )
    services = explode_rows(
        doc, F.col("d.data"), "s", "requested_ip", position="service_no"
    ).select(
        "requested_ip", "service_no", F.col("s.port").alias("port"), F.col("s.transport").alias("transport"),
        F.col("s.product").alias("product"), F.col("s.version").alias("version"),
        F.col("s.hostnames").alias("hostnames"), F.col("s.cpe").alias("cpe"), F.col("s.data").alias("banner"),
    )
    return hosts, services


def file_reputation_flatten(responses: DataFrame, body: str = "body") -> DataFrame:
    """(requested_hash, body) -> one reputation row per saved file document."""
    a = "d.data.attributes."
    names = ["sha256", "sha1", "md5", "size", "type_description", "meaningful_name", "reputation",
             "last_analysis_date", "last_submission_date", "times_submitted"]
    return (
        responses.select("requested_hash", F.from_json(body, schemas.FILE_DOCUMENT).alias("d"))
        .filter(F.col("d.data").isNotNull())
        .select(
            "requested_hash", F.col("d.data.id").alias("id"), F.col("d.data.type").alias("object_type"),
            *[F.col(a + n).alias(n) for n in names],
            *[F.col(f"{a}last_analysis_stats.{s}").alias(s) for s in ("malicious", "suspicious", "undetected", "harmless")],
        )
    )


def merge_headers(headers: DataFrame, order: str) -> DataFrame:
    """(response_id, name, value, <order>) -> values per header name, case ignored, in arrival order.

    One response's header is a bounded group: it is the header block of a single HTTP message."""
    return (
        headers.groupBy("response_id", F.lower("name").alias("name"))
        .agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("value").alias("v")))).alias("items"))
        .select("response_id", "name", F.transform("items", lambda x: x["v"]).alias("values"))
    )
