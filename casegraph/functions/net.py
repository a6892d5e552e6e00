"""Address functions. An address is held as a hex string (8 digits for v4, 32 for v6),
so prefix tests and CIDR joins are plain string equality on a masked value."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column
from pyspark.sql import functions as F

from casegraph import fixed_values as fv
from casegraph.functions.binding import let

V4 = r"^(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)$"
V6 = r"^[0-9A-Fa-f:]*:[0-9A-Fa-f:.]*$"


def is_v4(address: Column) -> Column:
    return address.rlike(V4)


def is_v6(address: Column) -> Column:
    return address.rlike(V6) & v6_hex(address).isNotNull()


def v4_number(address: Column) -> Column:
    fold = lambda parts: F.aggregate(parts, F.lit(0).cast("long"), lambda acc, p: acc * 256 + p.try_cast("long"))
    return F.when(is_v4(address), fold(F.split(address, r"\.")))


def v4_text(number: Column) -> Column:
    byte = lambda shift: F.shiftright(number, shift).bitwiseAND(F.lit(255)).cast("string")
    return F.concat_ws(".", byte(24), byte(16), byte(8), byte(0))


def v4_hex(address: Column) -> Column:
    return F.lower(F.lpad(F.hex(v4_number(address)), 8, "0"))


def v6_hex(address: Column) -> Column:
    """32 hex digits, or NULL for malformed text. A dotted tail counts as two groups."""
    return F.when(address.rlike(V6), let(_flat_v6(address), _expand_v6))


def _flat_v6(address: Column) -> Column:
    """The text with a dotted tail rewritten as two groups."""
    tail = F.regexp_extract(address, r"(\d+\.\d+\.\d+\.\d+)$", 1)
    rewritten = let(v4_hex(tail), lambda h: F.concat(
        F.regexp_replace(address, r"\d+\.\d+\.\d+\.\d+$", ""), F.substring(h, 1, 4), F.lit(":"), F.substring(h, 5, 4)))
    return F.when(F.contains(address, F.lit(".")), rewritten).otherwise(address)


def _expand_v6(flat: Column) -> Column:
    gap = F.contains(flat, F.lit("::"))
    groups = lambda text: F.filter(F.split(text, ":"), lambda g: g != "")
    sides = F.struct(
        groups(F.when(gap, F.substring_index(flat, "::", 1)).otherwise(flat)).alias("left"),
        groups(F.when(gap, F.substr(flat, F.instr(flat, F.lit("::")) + F.lit(2))).otherwise(F.lit(""))).alias("right"),
        gap.alias("gap"),
    )
    pad = lambda items: F.array_join(F.transform(items, lambda g: F.lpad(g, 4, "0")), "")

    def join(s: Column) -> Column:
        used = F.size(s["left"]) + F.size(s["right"])
        sound = F.forall(F.concat(s["left"], s["right"]), lambda g: g.rlike("^[0-9A-Fa-f]{1,4}$"))
        fits = F.when(s["gap"], used <= 7).otherwise(used == 8)
        digits = F.concat(pad(s["left"]), F.repeat(F.lit("0000"), F.greatest(8 - used, F.lit(0))), pad(s["right"]))
        return F.when(sound & fits, F.lower(digits))

    return F.when(~flat.rlike(":::|::.*::|^:[^:]|[^:]:$"), let(sides, join))


def address_hex(address: Column) -> Column:
    return F.coalesce(v4_hex(address), v6_hex(address))


def v6_text(hex32: Column) -> Column:
    """Shortest text form: leading zeros dropped, the first longest zero run becomes `::`."""
    groups = F.transform(
        F.regexp_extract_all(hex32, F.lit("(.{4})"), F.lit(1)), lambda g: F.regexp_replace(g, "^0{1,3}", "")
    )
    return let(F.array_join(groups, ":"), _compress_v6)


def _compress_v6(text: Column) -> Column:
    out = F
    for run in range(8, 1, -1):
        zeros = r"0" + r"(?::0){%d}" % (run - 1)
        pattern = rf"^((?:.*?:)??){zeros}((?::.*)?)$"
        head = F.rtrim(F.regexp_extract(text, pattern, 1), F.lit(":"))
        rest = F.ltrim(F.regexp_extract(text, pattern, 2), F.lit(":"))
        out = out.when(text.rlike(pattern), F.concat(head, F.lit("::"), rest))
    return out.otherwise(text)


def address_text(address: Column) -> Column:
    return F.when(is_v4(address), v4_text(v4_number(address))).otherwise(v6_text(v6_hex(address)))


def masked_hex(hex_digits: Column, prefix: Column) -> Column:
    """Hex digits with every bit after `prefix` cleared: equal values lie in the same network."""

    def mask(h: Column) -> Column:
        whole = F.floor(prefix / 4).cast("int")
        bits = prefix - whole * 4
        nibble = F.conv(F.substr(h, whole + 1, F.lit(1)), 16, 10).cast("int")
        keep = F.when(bits == 1, 8).when(bits == 2, 12).when(bits == 3, 14).otherwise(0)
        partial = F.when(whole < F.length(h), F.lower(F.hex(nibble.bitwiseAND(keep)))).otherwise(F.lit(""))
        return F.rpad(F.concat(F.substr(h, F.lit(1), whole), partial), F.length(h), F.lit("0"))

    return let(hex_digits, mask)


def network_key(hex_digits: Column, prefix: Column) -> Column:
    """Join key of a network inside one (width, prefix) class: a shifted number for v4, masked digits for v6."""
    number = F.conv(hex_digits, 16, 10).cast("long")
    shifted = F.call_function("shiftright", number, (F.lit(32) - prefix).cast("int")).cast("string")
    return F.when(F.length(hex_digits) == 8, shifted).otherwise(masked_hex(hex_digits, prefix))


def cidr_network(cidr: Column) -> Column:
    """Address part of a CIDR as hex digits."""
    return address_hex(F.substring_index(cidr, "/", 1))


def cidr_prefix(cidr: Column) -> Column:
    """Prefix length, NULL when missing, malformed or too long."""
    text = F.when(F.contains(cidr, F.lit("/")), F.substr(cidr, F.instr(cidr, F.lit("/")) + F.lit(1)))
    value = F.when(text.rlike(r"^\d{1,3}$"), text.try_cast("int"))
    return let(cidr_network(cidr), lambda n: F.when(value <= F.length(n) * 4, value))


def normalize_cidr(cidr: Column) -> Column:
    def text(n: Column) -> Column:
        address = F.when(F.length(n["net"]) == 8, v4_text(F.conv(n["net"], 16, 10).cast("long"))).otherwise(v6_text(n["net"]))
        return F.concat(address, F.lit("/"), n["prefix"].cast("string"))

    parsed = F.struct(cidr_network(cidr).alias("hex"), cidr_prefix(cidr).alias("prefix"))
    masked = let(parsed, lambda n: F.struct(masked_hex(n["hex"], n["prefix"]).alias("net"), n["prefix"].alias("prefix")))
    return let(masked, text)


def _in_fixed_prefixes(hex_digits: Column, prefixes: list[str]) -> Column:
    out = F.lit(False)
    for prefix in prefixes:
        net = ipaddress.ip_network(prefix)
        width = net.max_prefixlen // 4
        low = format(int(net.network_address), f"0{width}x")
        high = format(int(net.broadcast_address), f"0{width}x")
        out = out | hex_digits.between(low, high)
    return out


def last_hex(hex_digits: Column, prefix: Column) -> Column:
    """Hex digits with every bit after `prefix` set."""

    def fill(h: Column) -> Column:
        whole = F.floor(prefix / 4).cast("int")
        bits = prefix - whole * 4
        nibble = F.conv(F.substr(h, whole + 1, F.lit(1)), 16, 10).cast("int")
        ones = F.when(bits == 1, 7).when(bits == 2, 3).when(bits == 3, 1).otherwise(15)
        partial = F.when(whole < F.length(h), F.lower(F.hex(nibble.bitwiseOR(ones)))).otherwise(F.lit(""))
        return F.rpad(F.concat(F.substr(h, F.lit(1), whole), partial), F.length(h), F.lit("f"))

    return let(hex_digits, fill)


def overlaps_non_public(low: Column, high: Column) -> Column:
    """Whether an interval of addresses (hex digits of one width) meets a non-public prefix."""

    def meets(prefixes: list[str], lead: str = "") -> Column:
        out = F.lit(False)
        for prefix in prefixes:
            block = ipaddress.ip_network(prefix)
            width = block.max_prefixlen // 4
            first, last = (lead + format(int(a), f"0{width}x") for a in (block.network_address, block.broadcast_address))
            out = out | ((low <= last) & (high >= first))
        return out

    return F.when(F.length(low) == 8, meets(fv.NON_PUBLIC_V4)).otherwise(
        meets(fv.NON_PUBLIC_V6) | meets(fv.NON_PUBLIC_V4, "0" * 20 + "ffff"))


def non_public_address(address: Column) -> Column:
    """TRUE for loopback, private, link-local, documentation, multicast, reserved; NULL if not an address."""
    def judge(h: Column) -> Column:
        mapped = F.startswith(h, F.lit("0" * 20 + "ffff")) & (F.length(h) == 32)
        return F.when(F.length(h) == 8, _in_fixed_prefixes(h, fv.NON_PUBLIC_V4)).when(
            mapped, let(F.substring(h, 25, 8), lambda four: _in_fixed_prefixes(four, fv.NON_PUBLIC_V4))
        ).otherwise(_in_fixed_prefixes(h, fv.NON_PUBLIC_V6))

    return let(address_hex(address), judge)


def reverse_dns_name(address: Column) -> Column:
    v4 = F.concat(F.array_join(F.reverse(F.split(address, r"\.")), "."), F.lit(".in-addr.arpa"))
    digits = F.regexp_extract_all(F.reverse(v6_hex(address)), F.lit("(.)"), F.lit(1))
    return F.when(is_v4(address), v4).otherwise(F.concat(F.array_join(digits, "."), F.lit(".ip6.arpa")))


def normalize_dns(record_type: Column, value: Column) -> Column:
    """Trailing dot removed from names; MX as `preference exchange`."""
    bare = F.rtrim(value, F.lit("."))
    mx = F.regexp_replace(bare, r"\s+", " ")
    return F.when(record_type == "MX", mx).when(record_type.isin("NS", "CNAME", "PTR"), bare).otherwise(value)
