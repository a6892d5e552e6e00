"""Scope decisions over tables of URLs and scope entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casegraph import fixed_values as fv
from casegraph.functions import net, urls
from casegraph.functions.binding import with_bound
from casegraph.functions.text import rank_of, trim_ws


def scope_entries_clean(entries: DataFrame) -> DataFrame:
    return entries.select(
        "kind", F.lower(F.rtrim(trim_ws(F.col("value")), F.lit("."))).alias("value"), F.col("value").alias("raw_value"),
        rank_of(F.lower("maximum_mode"), fv.ACTIVITY_MODES).alias("max_rank"),
    )


def _requests(url_rows: DataFrame, url: str) -> DataFrame:
    u = F.col(url)
    return with_bound(url_rows, __scheme=urls.scheme(u), __host=urls.host(u))


def _by_mode(entries: DataFrame, mode: str) -> DataFrame:
    return scope_entries_clean(entries).filter(F.col("max_rank") >= fv.ACTIVITY_MODES[mode])


def allowed_hosts(requests: DataFrame, allowed: DataFrame) -> DataFrame:
    """Distinct hosts matched by a domain, host, ip or cidr entry. The decision depends on the host alone, so it is
    taken once per host: a popular host costs one row here, not one per URL. Domain suffixes are exploded to an
    equi-join; CIDR entries use the masked-address join."""
    hosts = requests.select("__host").distinct()
    names = allowed.filter(F.col("kind").isin("domain", "host", "ip")).select("kind", "value").distinct()
    key = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("value"))
    by_name = (
        hosts.select("__host", F.explode(F.concat(
            F.transform(urls.host_suffixes(F.col("__host")), lambda s: key("domain", s)),
            F.array(key("host", F.col("__host")), key("ip", F.col("__host"))),
        )).alias("k")).select("__host", "k.*")
        .join(names, ["kind", "value"], "left_semi").select("__host")
    )
    networks = allowed.filter(F.col("kind") == "cidr").select("value")
    by_cidr = cidr_match(hosts, networks, "__host", "value").select("__host")
    return by_name.unionByName(by_cidr).distinct()


def _below_prefix(requests: DataFrame, allowed: DataFrame, url: str) -> DataFrame:
    """Rows under an allowed URL: equal scheme, host and port, and a path equal or below."""
    u, value = F.col(url), trim_ws(F.col("raw_value"))
    prefix = with_bound(
        allowed.filter(F.col("kind") == "url"), __s=urls.scheme(value), __h=urls.host(value), __p=urls.port(value),
        __base=F.rtrim(urls.path(value), F.lit("/")),
    ).select("__s", "__h", "__p", "__base").distinct()
    keyed = with_bound(requests, __port=urls.port(u), __path=urls.path(u))
    condition = (
        (F.col("__scheme") == F.col("__s")) & (F.col("__host") == F.col("__h")) & (F.col("__port") == F.col("__p"))
        & ((F.col("__base") == "") | (F.col("__path") == F.col("__base"))
           | F.startswith("__path", F.concat(F.col("__base"), F.lit("/"))))
    )
    return keyed.join(prefix, condition, "left_semi").drop("__port", "__path")


def scope_filter(
    url_rows: DataFrame, entries: DataFrame, mode: str = "active", url: str = "url", allow_private: bool = False
) -> DataFrame:
    """Rows whose URL is http(s), not a literal private address, and matched by any entry of a sufficient mode."""
    requests = _requests(url_rows, url).filter(F.col("__scheme").isin("http", "https"))
    if not allow_private:
        requests = requests.filter(~F.coalesce(net.non_public_address(F.col("__host")), F.lit(False)))
    allowed = _by_mode(entries, mode)
    hosts = allowed_hosts(requests, allowed)
    by_host = requests.join(hosts, "__host", "left_semi").select(requests.columns)
    others = requests.join(hosts, "__host", "left_anti").select(requests.columns)
    return by_host.unionByName(_below_prefix(others, allowed, url)).select(url_rows.columns)


def scope_url_prefix(url_rows: DataFrame, entries: DataFrame, mode: str = "passive", url: str = "url") -> DataFrame:
    """Only the `url` kind."""
    return _below_prefix(_requests(url_rows, url), _by_mode(entries, mode), url).select(url_rows.columns)


BLOCK, SHARES = 64, 32


def cidr_match(rows: DataFrame, networks: DataFrame, address: str, cidr: str) -> DataFrame:
    """Rows joined to every network that contains their address: an equi-join on the address masked to each prefix length
    in use (at most 33 for v4, 129 for v6), so no pair is made that is not a result.

    A short prefix may hold most addresses and be given many times over (`10.1.0.0/4` is `0.0.0.0/4`). Its networks are
    dealt into blocks of about `BLOCK`, and the rows that meet more than one block into `SHARES` shares; each share meets
    each block once, so no task makes all pairs of such a prefix."""
    spread = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = ["__width", "__prefix", "__net"]
    given = networks.columns
    nets = with_bound(networks, __prefix=net.cidr_prefix(F.col(cidr)), __hex=net.cidr_network(F.col(cidr)))
    nets = with_bound(nets, __net=net.masked_hex(F.col("__hex"), F.col("__prefix"))).filter(F.col("__net").isNotNull())
    nets = nets.withColumn("__width", F.length("__net")).drop("__hex")
    blocks = nets.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("__blocks"))
    shares = F.when(F.col("__blocks") > 1, SHARES).otherwise(1)
    pick = lambda columns, n: F.pmod(F.xxhash64(*columns), n).cast("int")
    dealt = nets.join(blocks, key).select(
        *given, *key, pick(given, F.col("__blocks")).alias("__block"), F.explode(F.sequence(F.lit(0), shares - 1)).alias("__share"))
    lengths = nets.select("__width", "__prefix").distinct()
    hexed = with_bound(rows.repartition(spread), __hex=net.address_hex(F.col(address))).filter(F.col("__hex").isNotNull())
    keyed = hexed.withColumn("__width", F.length("__hex")).join(F.broadcast(lengths), "__width")  # at most 33 + 129 rows by construction
    keyed = with_bound(keyed, __net=net.masked_hex(F.col("__hex"), F.col("__prefix"))).drop("__hex")
    met = keyed.join(blocks, key).select(
        *rows.columns, *key, pick(rows.columns, shares).alias("__share"), F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1)).alias("__block"))
    return met.join(dealt, [*key, "__share", "__block"]).drop(*key, "__share", "__block")


def longest_prefix(rows: DataFrame, networks: DataFrame, address: str, cidr: str) -> DataFrame:
    """Rows with the narrowest network that contains their address (null for none); of several, the least text. Decided
    once per distinct address."""
    addresses = rows.select(F.col(address).alias("__address")).distinct()
    narrowest = F.struct((-net.cidr_prefix(F.col("__cidr"))).alias("length"), F.col("__cidr").alias("cidr"))
    best = (
        cidr_match(addresses, networks.select(F.col(cidr).alias("__cidr")).distinct(), "__address", "__cidr")
        .groupBy("__address").agg(F.min(narrowest).alias("__best"))
    )
    return rows.join(best, F.col(address) == F.col("__address"), "left").withColumn(cidr, F.col("__best.cidr")).drop("__address", "__best")


def resolved_scope(
    url_rows: DataFrame, dns: DataFrame, entries: DataFrame | None = None, mode: str = "active", url: str = "url",
    allow_private: bool = False,
) -> DataFrame:
    """Rows that may be requested: http(s) without user-info, matched by an entry of a sufficient mode (where entries are
    given), and with a public address. A named host needs at least one answer and only public ones; names are compared
    without case and trailing dots."""
    safe = url_rows.filter(urls.user_info(F.col(url)) == "")
    if entries is not None:
        safe = scope_filter(safe, entries, mode, url, allow_private)
    bare = lambda name: F.lower(F.rtrim(name, F.lit(".")))
    answers = dns.filter(F.col("record_type").isin("A", "AAAA"))
    hosts = (
        answers.groupBy(bare(F.col("name")).alias("__host"))
        .agg(F.bool_and(~F.coalesce(net.non_public_address(F.col("value")), F.lit(True))).alias("public"))
        .filter(F.lit(allow_private) | F.col("public"))
    )
    requests = with_bound(safe, __scheme=urls.scheme(F.col(url)), __host=bare(urls.host(F.col(url)))).filter(F.col("__scheme").isin("http", "https"))
    named = requests.filter(net.address_hex(F.col("__host")).isNull()).join(hosts, "__host", "left_semi")
    literal = requests.filter(F.coalesce(F.lit(allow_private) | ~net.non_public_address(F.col("__host")), F.lit(False)) & net.address_hex(F.col("__host")).isNotNull())
    return named.select(url_rows.columns).unionByName(literal.select(url_rows.columns))


def infer_scope_kind(value):
    """Addresses first (an IPv6 address looks like a scheme), then anything with a scheme."""
    return (
        F.when(net.address_hex(value).isNotNull(), "ip")
        .when(F.contains(value, F.lit("/")) & net.address_hex(F.substring_index(value, "/", 1)).isNotNull(), "cidr")
        .when(value.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]+:"), "url")
        .when(F.contains(value, F.lit(".")), "domain")
        .otherwise("host")
    )


def normalize_scope_value(kind, value):
    v = trim_ws(value)
    server = F.concat(
        urls.scheme(v), F.lit("://"), urls.raw_host(v),
        F.when(urls.port(v) != urls.default_port(urls.scheme(v)), F.concat(F.lit(":"), urls.port(v).cast("string")))
        .otherwise(F.lit("")),
        urls.path(v),
    )
    return (
        F.when((kind == "url") & urls.is_http(v), F.rtrim(server, F.lit("/")))
        .when(kind.isin("domain", "host"), urls.ascii_host(F.lower(F.rtrim(v, F.lit(".")))))
        .when(kind == "ip", net.address_text(v))
        .when(kind == "cidr", net.normalize_cidr(v))
    )


def scope_normalize(entries: DataFrame, order: list[str]) -> DataFrame:
    """Infer kinds, normalize values, keep the last mode per (project, kind, value). Invalid values are dropped
    (the caller reads them from the anti side)."""
    v = trim_ws(F.col("value"))
    kinds = with_bound(entries.withColumnRenamed("kind", "__given"), kind=F.coalesce("__given", infer_scope_kind(v)))
    cleaned = with_bound(
        kinds.withColumnRenamed("value", "__raw"), value=normalize_scope_value(F.col("kind"), F.col("__raw"))
    ).filter(F.col("value").isNotNull())
    return cleaned.groupBy("project_id", "kind", "value").agg(
        F.max_by("maximum_mode", F.struct(*order)).alias("maximum_mode")
    )
