"""Hosts of addresses as browsers read them, and a guard against internal ones, as Column expressions.

An IPv4 host may be written as one number, in hexadecimal or octal, or with fewer
parts; an IPv6 host with or without its zeros. All are brought to one form before
anything is compared. Names are not resolved, and international names stay as they
are written.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftgrid.functions.text import bound

#: Scheme, and what stands up to the path, of an http(s) address; browsers take any number of either slash.
ADDRESS = r"(?is)^(https?):[/\\]*([^/\\?#]*)"
LITERAL6 = r"^\[([0-9a-fA-F:.]*)\]$"


def cleaned(url: Column) -> Column:
    """Without control characters and blanks around it, and without line ends and tabs inside."""
    return F.regexp_replace(F.regexp_replace(url, r"^[\x00-\x20]+|[\x00-\x20]+$", ""), r"[\t\n\r]", "")


def number4(part: Column) -> Column:
    """The value of a part of an IPv4 host: decimal, octal after a 0, hexadecimal after 0x; null for another text."""
    low = F.lower(part)
    hexa, octal = F.regexp_replace(low, "^0x0*", ""), F.regexp_replace(low, "^0+", "")
    within = lambda digits, base: F.when(F.length(digits) > 14, F.lit(1 << 40)).when(digits == "", F.lit(0)).otherwise(F.conv(digits, base, 10).cast("long"))
    return F.when(low.rlike(r"^0x[0-9a-f]*$"), within(hexa, 16)).when(low.rlike(r"^0[0-7]+$"), within(octal, 8)).when(low.rlike(r"^(?:0|[1-9][0-9]*)$"), F.when(F.length(low) > 14, F.lit(1 << 40)).otherwise(low.cast("long")))


def parts4(host: Column) -> Column:
    parts = F.split(host, r"\.", -1)
    return F.when((F.size(parts) > 1) & (F.element_at(parts, -1) == ""), F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def is4(host: Column) -> Column:
    """Whether a host ends in a number, which makes it an IPv4 address or nothing."""
    return F.element_at(parts4(host), -1).rlike(r"^(?:[0-9]+|0[xX][0-9a-fA-F]*)$")


def address4(host: Column) -> Column:
    """The 32 bits of an IPv4 host as a long; null if it is none."""

    power = lambda k: F.try_element_at(F.array(*(F.lit(256**i).cast("long") for i in range(5))), k + 1)

    def of(values: Column) -> Column:
        n = F.size(values)
        last = F.element_at(values, -1)
        head = F.slice(values, 1, n - 1)
        fine = (n <= 4) & ~F.exists(values, lambda v: v.isNull()) & ~F.exists(head, lambda v: v > 255) & (last < power(5 - n))
        high = F.aggregate(F.transform(head, lambda v, i: v * power(3 - i)), F.lit(0).cast("long"), lambda a, v: a + v)
        return F.when(F.coalesce(fine, F.lit(False)), last + high)

    return F.when(is4(host), bound(F.transform(parts4(host), number4), of))


def text4(bits: Column) -> Column:
    return F.concat_ws(".", *(F.shiftrightunsigned(bits, s).bitwiseAND(F.lit(255).cast("long")).cast("string") for s in (24, 16, 8, 0)))


TAIL4 = r"^(.*:)(0|[1-9][0-9]{0,2})\.(0|[1-9][0-9]{0,2})\.(0|[1-9][0-9]{0,2})\.(0|[1-9][0-9]{0,2})$"


def groups6(text: Column) -> Column:
    """The eight groups of an IPv6 address without brackets; null if it is none."""
    octet = lambda i: F.regexp_extract(text, TAIL4, i).cast("int")
    pair = lambda a, b: F.lower(F.hex(octet(a) * 256 + octet(b)))
    short = ~F.exists(F.array(*map(octet, (2, 3, 4, 5))), lambda v: v > 255)
    plain = F.when(~text.contains("."), text).when(text.rlike(TAIL4) & short, F.concat(F.regexp_extract(text, TAIL4, 1), pair(2, 3), F.lit(":"), pair(4, 5)))

    def of(halves: Column) -> Column:
        each = F.transform(halves, lambda h: F.when(h == "", F.array().cast("array<string>")).otherwise(F.split(h, ":", -1)))
        both = F.flatten(each)
        fine = ~F.exists(both, lambda g: ~g.rlike("^[0-9a-fA-F]{1,4}$"))
        zeros = F.array_repeat(F.lit(0), 8 - F.size(both))
        numbers = F.transform(each, lambda gs: F.transform(gs, lambda g: F.conv(g, 16, 10).cast("int")))
        whole = F.when(F.size(halves) == 1, F.when(F.size(both) == 8, numbers[0])).when((F.size(halves) == 2) & (F.size(both) <= 7), F.concat(numbers[0], zeros, numbers[1]))
        return F.when(fine, whole)

    return F.when(plain.isNotNull(), bound(F.split(plain, "::", -1), of))


def address6(host: Column) -> Column:
    """struct<hi, lo>: the 128 bits of an IPv6 host, with or without brackets; null if it is none."""
    bare = F.regexp_replace(host, r"^\[|\]$", "")
    word = lambda gs, k: F.conv(F.array_join(F.transform(F.slice(gs, k, 4), lambda g: F.lpad(F.hex(g), 4, "0")), ""), 16, -10).cast("long")
    return F.when(bare.contains(":"), bound(groups6(bare), lambda gs: F.when(gs.isNotNull(), F.struct(word(gs, 1).alias("hi"), word(gs, 5).alias("lo")))))


def text6(address: Column) -> Column:
    """The one text of an address: lower case, without leading zeros, the first longest run of zero groups left out."""
    group = lambda half, s: F.lower(F.hex(F.shiftrightunsigned(address[half], s).bitwiseAND(F.lit(0xFFFF).cast("long"))))
    full = F.concat_ws(":", *(group(half, s) for half in ("hi", "lo") for s in (48, 32, 16, 0)))

    def shortened(text: Column) -> Column:
        out = F.when(F.lit(False), text)
        for n in range(8, 1, -1):
            run = rf"^(.*?)(?:^|:)0(?::0){{{n - 1}}}(?::|$)(.*)$"
            out = out.when(text.rlike(run), F.concat(F.regexp_extract(text, run, 1), F.lit("::"), F.regexp_extract(text, run, 2)))
        return out.otherwise(text)

    return bound(full, shortened)


def canonical(host: Column) -> Column:
    """The host in its one form: lower case, addresses as four decimal parts or without brackets and needless zeros; null if it is no host."""

    def of(h: Column) -> Column:
        decoded = F.when(h.contains("%"), F.try_url_decode(F.replace(h, F.lit("+"), F.lit("%2B")))).otherwise(h)
        name = F.lower(decoded)
        fine = (name != "") & ~name.rlike(r"[\x00-\x20\x7f#/:<>?@\[\\\]^|%]")
        return F.when(h.startswith("["), F.when(h.rlike(LITERAL6), bound(address6(h), lambda a: F.when(a.isNotNull(), text6(a))))).when(is4(name), bound(address4(name), lambda b: F.when(b.isNotNull(), text4(b)))).when(fine, name)

    return bound(host, of)


def authority(url: Column) -> Column:
    """struct<scheme, host, port> of an http(s) address, the host in its one form, the port that is meant; null if it is none."""

    def of(u: Column) -> Column:
        scheme = F.lower(F.regexp_extract(u, ADDRESS, 1))
        place = F.regexp_replace(F.regexp_extract(u, ADDRESS, 2), r"(?s)^.*@", "")
        host = F.regexp_extract(place, r"(?s)^(\[[^\]]*\]|[^:]*)(?::[0-9]*)?$", 1)
        given = F.regexp_extract(place, r":([0-9]*)$", 1)
        digits = F.regexp_replace(given, "^0+(?=.)", "")
        port = F.when(given == "", F.when(scheme == "https", 443).otherwise(80)).when(F.length(digits) <= 5, digits.cast("int"))
        return F.when((scheme != "") & (host != ""), F.struct(scheme.alias("scheme"), canonical(host).alias("host"), port.alias("port")))

    return bound(bound(cleaned(url), of), lambda a: F.when(a["host"].isNotNull() & (a["port"] <= 65535), a))


#: Blocked IPv4 networks: address and length of the prefix.
BLOCKED4 = [("127.0.0.0", 8), ("10.0.0.0", 8), ("0.0.0.0", 8), ("169.254.0.0", 16), ("192.168.0.0", 16), ("172.16.0.0", 12), ("100.64.0.0", 10)]


def blocked4(bits: Column) -> Column:
    out = F.lit(False)
    for text, length in BLOCKED4:
        network = sum(int(p) << s for p, s in zip(text.split("."), (24, 16, 8, 0), strict=True))
        out = out | (F.shiftright(bits, 32 - length) == network >> (32 - length))
    return out


def internal(host: Column) -> Column:
    """Whether a host is none that a scan of pages may be led to: empty, localhost, a loopback, private, link-local, shared or zero address.

    The host is an address or name by itself, with or without brackets. IPv6 addresses that carry an IPv4 address
    (mapped, translated or for NAT64) are judged by that.
    """

    def of(h: Column) -> Column:
        six = h.contains(":")
        quad = r"^([0-9]{1,3})\.([0-9]{1,3})\.([0-9]{1,3})\.([0-9]{1,3})$"

        def four(text: Column, pattern: str) -> Column:
            a, b, c, d = (F.regexp_extract(text, pattern, i).cast("long") for i in (1, 2, 3, 4))
            return (F.greatest(a, b, c, d) > 255) | blocked4(((a * 256 + b) * 256 + c) * 256 + d)

        pair = r":([0-9a-f]{1,4}):([0-9a-f]{1,4})$"
        low = F.conv(F.regexp_extract(h, pair, 1), 16, 10).cast("long") * 65536 + F.conv(F.regexp_extract(h, pair, 2), 16, 10).cast("long")
        carried = (h.contains("ffff:") | h.startswith("64:ff9b")) & (
            F.when(h.rlike(":" + quad[1:]), four(h, "^.*:" + quad[1:])).otherwise(False) | F.when(h.rlike(pair), blocked4(low)).otherwise(False)
        )
        own = h.isin("::1", "::") | h.startswith("fe80:") | h.startswith("fc") | h.startswith("fd")
        return (h == "") | (h == "localhost") | h.endswith(".localhost") | (six & (own | carried)) | F.when(h.rlike(quad), four(h, quad)).otherwise(False)

    return F.coalesce(bound(F.regexp_replace(F.lower(host), r"^\[|\]$", ""), of), F.lit(True))


def allowed(url: Column, page: Column | None = None) -> Column:
    """Whether an address may be fetched: http(s), and not internal unless it has the page's own scheme, host and port."""
    page = F.lit(None).cast("string") if page is None else page
    return bound(F.struct(authority(url).alias("a"), authority(page).alias("p")), lambda x: F.coalesce(x["a"].isNotNull() & (~internal(x["a"]["host"]) | F.coalesce(x["a"] == x["p"], F.lit(False))), F.lit(False)))


def unread(url: Column) -> Column:
    """Whether an http(s) address has a host that ends in a number but is no IPv4 address, and that isn't internal as it is written.

    Browsers don't open such an address, so `allowed` says no; a guard that takes hosts by their text alone lets it pass.
    """

    def of(u: Column) -> Column:
        host = F.regexp_extract(F.regexp_replace(F.regexp_extract(u, ADDRESS, 2), r"(?s)^.*@", ""), r"(?s)^([^:\[]*)(?::[0-9]*)?$", 1)
        return bound(host, lambda h: is4(h) & address4(h).isNull() & ~internal(h))

    return F.coalesce(bound(cleaned(url), of), F.lit(False))
