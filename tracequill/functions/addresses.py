"""URLs that reach inside: addresses as numbers, held against ranges of networks by expressions alone."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracequill.functions.text_scans import let

#: Networks that are private or reserved, and hosts that hand out a machine's credentials.
NETWORKS = (
    "0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "240.0.0.0/4", "255.255.255.255/32",
    "::1/128", "fc00::/7", "fe80::/10", "::ffff:0:0/96", "64:ff9b::/96",
)
METADATA_HOSTS = ("169.254.169.254", "metadata.google.internal", "169.254.170.2", "fd00:ec2::254", "metadata.internal")
#: Schemes of URLs that are looked at, categories from the worst down, and how sure each is.
SCHEMES = ("http", "https", "ftp", "ftps", "sftp", "file", "gopher", "dict", "ldap", "ldaps", "tftp")
CATEGORIES = (("cloud_metadata", 1.0), ("not_in_allowlist", 0.70), ("private_ip", 0.95), ("resolves_to_private", 0.88))
#: Names that always lead to an address. No other name is resolved.
RESOLVED = {"localhost": "127.0.0.1", "localhost.localdomain": "127.0.0.1", "ip6-localhost": "::1"}
URL = rf"(?i)(?:{'|'.join(SCHEMES)})://[^\s'\"<>(){{}},;\\]+"
BARE = r"(?<![\w:])//[^/\s'\"<>()]+"
_HEX = {4: 8, 6: 32}


def urls(text: Column) -> Column:
    """URLs of a text in their order, then those that leave their scheme out."""
    return F.concat(F.regexp_extract_all(text, F.lit(URL), F.lit(0)), F.regexp_extract_all(text, F.lit(BARE), F.lit(0)))


def host(url: Column) -> Column:
    """The host of a URL, percent signs decoded, in lower case, without user, port, brackets and outer dots; empty if there is none."""
    plain = F.when(F.contains(url, F.lit("%")), F.coalesce(F.try_url_decode(F.replace(url, F.lit("+"), F.lit("%2B"))), url)).otherwise(url)
    authority = F.regexp_extract(plain, r"^[^/?#]*//([^/?#]*)", 1)
    name = F.regexp_extract(F.regexp_replace(authority, "^.*@", ""), r"^(\[[^\]]*\]|[^:]*)", 1)
    return F.lower(F.regexp_replace(name, r"^[\[.]+|[\].]+$", ""))


def _number(text: Column, base: int) -> Column:
    """A whole number as hex digits: 8 for 32 bits, 32 for more, null for over 128 bits."""
    digits = F.regexp_replace(F.lower(text if base == 16 else F.conv(text, base, 16)), "^0+", "")
    return F.when(F.length(digits) <= 8, F.lpad(digits, 8, "0")).when(F.length(digits) <= 32, F.lpad(digits, 32, "0"))


def _dotted(text: Column) -> Column:
    parts = F.split(text, r"\.")
    fine = F.regexp_like(text, F.lit(r"^(?:0|[1-9][0-9]{0,2})(?:\.(?:0|[1-9][0-9]{0,2})){3}$")) & F.forall(parts, lambda p: p.try_cast("int") <= 255)
    return F.when(fine, F.array_join(F.transform(parts, lambda p: F.lpad(F.lower(F.hex(p.try_cast("long"))), 2, "0")), ""))


def _colons(text: Column) -> Column:
    """An address of eight groups as 32 hex digits: `::` stands for the zeros left out once, and a dotted end for two groups."""
    text = F.regexp_replace(text, "%.*$", "")  # the zone says nothing of the network
    end = F.regexp_extract(text, r"([0-9.]+\.[0-9]+)$", 1)
    quad = _dotted(end)
    flat = F.when(end == "", text).when(quad.isNotNull(), F.concat(F.regexp_replace(text, r"[0-9.]+\.[0-9]+$", ""), F.substring(quad, 1, 4), F.lit(":"), F.substring(quad, 5, 4)))
    groups = lambda t: F.filter(F.split(t, ":"), lambda g: g != "")
    hexed = lambda gs: F.array_join(F.transform(gs, lambda g: F.lpad(g, 4, "0")), "")

    def joined(t: Column) -> Column:
        sides = F.split(t, "::")
        head, tail = groups(sides[0]), groups(F.coalesce(F.try_element_at(sides, F.lit(2)), F.lit("")))
        n, gap = F.size(head) + F.size(tail), F.size(sides) == 2
        fine = F.forall(F.concat(head, tail), lambda g: F.regexp_like(g, F.lit("^[0-9a-f]{1,4}$"))) & F.when(gap, n <= 7).otherwise((F.size(sides) == 1) & (n == 8))
        return F.when(fine, F.concat(hexed(head), F.repeat(F.lit("0000"), F.when(gap, 8 - n).otherwise(0)), hexed(tail)))

    return F.when(F.contains(text, F.lit(":")), let(flat, joined))


def address(name: Column) -> Column:
    """The address that a host stands for, as 8 or 32 hex digits: dotted, with colons, one hex, decimal or octal number. Null for names."""
    one = F.when(F.regexp_like(name, F.lit(r"^0x[0-9a-f]+$")), _number(F.substring(name, 3, 64), 16)).when(F.regexp_like(name, F.lit("^[0-9]{7,10}$")) & (name.try_cast("long") <= 0xFFFFFFFF), _number(name, 10)).when(F.regexp_like(name, F.lit("^0[0-7]{1,21}$")), _number(name, 8))
    return F.coalesce(_dotted(name), _colons(name), one)


def ranges(networks: tuple[str, ...]) -> list[tuple[str, str]]:
    """The first and last address of each network, as hex digits of its family's length."""
    found = [ipaddress.ip_network(n) for n in networks]
    return [tuple(format(int(a), f"0{_HEX[n.version]}x") for a in (n[0], n[-1])) for n in found]


def is_private(number: Column, networks: tuple[str, ...] = NETWORKS) -> Column:
    """Whether an address, as hex digits, lies in a network. Families differ in length, so their digits never compare."""
    table = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ranges(networks)])
    return F.coalesce(F.exists(table, lambda r: (F.length(r["a"]) == F.length(number)) & number.between(r["a"], r["b"])), F.lit(False))


def ssrf(text: Column, allowed: tuple[str, ...] = (), networks: tuple[str, ...] = NETWORKS, resolved: dict[str, str] | None = None) -> Column:
    """A struct of detected, category, confidence, url and urls_scanned: the worst category of the URLs in a text, and the first URL of it.

    The order is that of CATEGORIES, so a host that is not allowed counts before a private address. resolved: names whose address is known.
    """
    rank = {name: i for i, (name, _) in enumerate(CATEGORIES)}
    names = RESOLVED if resolved is None else resolved
    known = F.create_map(*[F.lit(x) for pair in names.items() for x in pair]) if names else F.lit(None).cast("map<string,string>")

    def of(url: Column) -> Column:
        def seen(h: Column) -> Column:
            ok = F.lit(not allowed)
            for a in allowed:
                ok = ok | (h == a) | F.endswith(h, F.lit(f".{a}"))
            number = address(h)
            inside = F.when(is_private(number, networks), rank["private_ip"]).when(number.isNull() & is_private(address(F.try_element_at(known, h)), networks), rank["resolves_to_private"])
            return F.when(h == "", None).when(h.isin(*METADATA_HOSTS), rank["cloud_metadata"]).when(~ok, rank["not_in_allowlist"]).otherwise(inside)

        return let(host(url), seen)

    def worst(us: Column) -> Column:
        found = F.filter(F.transform(us, lambda u, i: F.struct(of(u).alias("rank"), i.alias("i"), u.alias("url"))), lambda x: x["rank"].isNotNull())
        pick = lambda w, values, none: F.when(w.isNull(), none).otherwise(F.element_at(F.array(*[F.lit(v) for v in values]), F.coalesce(w["rank"], F.lit(0)) + 1))
        return let(F.try_element_at(F.array_sort(found), F.lit(1)), lambda w: F.struct(
            w.isNotNull().alias("detected"), pick(w, [n for n, _ in CATEGORIES], F.lit("none")).alias("category"), pick(w, [c for _, c in CATEGORIES], F.lit(0.0)).alias("confidence"),
            F.when(w.isNull(), "").otherwise(w["url"]).alias("url"), F.size(us).alias("urls_scanned"),
        ))

    return let(urls(F.coalesce(text, F.lit(""))), worst)
