"""Column expressions: parsing, addresses, number handling. All stay in JVM codegen."""

from __future__ import annotations

import ipaddress
from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from netloom import vocab


def lenient_double(c: Column) -> Column:
    """Text to double: null tokens and malformed cells become NULL."""
    text = F.trim(c)
    return F.when(~c.isin(*vocab.NULL_TOKENS), text.try_cast("double"))


def parse_time(c: Column) -> Column:
    """Any known timestamp layout, else a plain number, to epoch seconds (UTC)."""
    text = F.trim(c)
    parsed = [
        F.when(text.rlike(shape), F.try_to_timestamp(text, F.lit(pattern)))
        for shape, pattern in vocab.TIME_LAYOUTS
    ]
    return F.coalesce(F.unix_micros(F.coalesce(*parsed)) / F.lit(1e6), text.try_cast("double"))


def protocol_number(c: Column) -> Column:
    name = F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9]", "")
    table = F.create_map(*[F.lit(x) for kv in vocab.PROTOCOLS.items() for x in kv])
    return F.coalesce(c.try_cast("smallint"), table[name].cast("smallint"), F.lit(0).cast("smallint"))


def port_number(c: Column) -> Column:
    """Decimal or 0x-hex port; anything else, or out of range, is -1."""
    text = F.trim(c)
    hexa = F.when(text.rlike("^0x[0-9A-Fa-f]{1,7}$"), F.conv(F.substring(text, 3, 16), 16, 10).try_cast("int"))
    port = F.coalesce(text.try_cast("int"), hexa)
    return F.when(port.between(0, 65535), port).otherwise(F.lit(-1))


def normalise_label(c: Column) -> Column:
    """Comparison key of a raw label: dashes, blanks and case folded; NULL is the empty key.

    Compatibility characters outside dashes and blanks (full-width forms, U+FF01..U+FF5E) fold
    to ASCII; other compatibility decompositions do not occur in the label vocabularies.
    """
    wide = "".join(chr(0xFF01 + i) for i in range(94))
    ascii_ = "".join(chr(0x21 + i) for i in range(94))
    odd_blanks = "".join(map(chr, (0xA0, 0x2002, 0x2003, 0x2009, 0x202F, 0x3000)))
    dashes = "".join(map(chr, (0x2010, 0x2011, 0x2013, 0x2014, 0x2212)))
    folded = F.translate(F.coalesce(c, F.lit("")), wide + odd_blanks + dashes,
                         ascii_ + " " * len(odd_blanks) + "-" * len(dashes))
    spaced = F.lower(F.trim(F.regexp_replace(folded, r"\s+", " ")))
    return F.regexp_replace(spaced, r"\s*-\s*", "-")


def is_attempted(c: Column) -> Column:
    return normalise_label(c).endswith("-attempted")


def label_tokens(c: Column) -> Column:
    text = F.regexp_replace(normalise_label(c), "^flow=", "")
    return F.filter(F.split(text, r"[-\s]+"), lambda t: t != "")


def flow_key_ip(c: Column, index: int) -> Column:
    """Source (0) or destination (1) address of a dash-joined flow id."""
    return F.try_element_at(F.split(c, "-"), F.lit(index + 1))


def ipv4_number(c: Column) -> Column:
    parts = F.split(c, r"\.")
    octets = [F.try_element_at(parts, F.lit(i)).try_cast("bigint") for i in (1, 2, 3, 4)]
    value = reduce(lambda acc, o: acc * 256 + o, octets)
    return F.when(F.size(parts) == 4, value)


def in_networks(c: Column, cidrs: Sequence[str]) -> Column:
    """IPv4 membership in any network; IPv6, malformed and NULL addresses are outside."""
    if not cidrs:
        return F.lit(False)
    ip = ipv4_number(c)
    ranges = [ipaddress.ip_network(x, strict=False) for x in cidrs]
    hits = [ip.between(int(n.network_address), int(n.broadcast_address)) for n in ranges]
    return F.coalesce(reduce(Column.__or__, hits), F.lit(False))


def window_index(ts: Column, seconds: float) -> Column:
    return F.floor(ts / F.lit(float(seconds))).cast("bigint")


def window_time(window: Column, seconds: float) -> Column:
    return window.cast("double") * F.lit(float(seconds))


def stage_index(stage: Column) -> Column:
    table = F.create_map(*[F.lit(x) for i, s in enumerate(vocab.STAGES) for x in (s, i)])
    return table[stage].cast("int")


def stage_name(index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in vocab.STAGES]), index.cast("int") + 1)


def is_compromise(stage: Column) -> Column:
    return stage >= vocab.FIRST_COMPROMISE_STAGE


def share(condition: Column) -> Column:
    """Mean of a boolean over the rows where it is known."""
    return F.avg(condition.cast("double"))


def finite_or_zero(c: Column) -> Column:
    bad = c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf")))
    return F.when(bad, F.lit(0.0)).otherwise(c)


def compress(c: Column, is_log: Column | bool) -> Column:
    """Signed log1p for heavy-tailed features; missing and infinite values count as 0."""
    x = finite_or_zero(c)
    logged = F.signum(x) * F.log1p(F.abs(x))
    if isinstance(is_log, bool):
        return logged if is_log else x
    return F.when(is_log, logged).otherwise(x)


def clip(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(float(low))), F.lit(float(high)))


def logit(c: Column) -> Column:
    p = clip(c, 1e-4, 1 - 1e-4)
    return F.log(p / (1 - p))


def sigmoid(c: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-c))


def bin_index(value: Column, edges: Column) -> Column:
    """Number of edges at or below the value (edges ascending)."""
    return F.size(F.filter(edges, lambda e: e <= value))


def interpolate(value: Column, xs: Column, ys: Column) -> Column:
    """Piecewise-linear through the knots, flat outside them."""
    at = F.size(F.filter(xs, lambda x: x <= value))
    last = F.size(xs)
    x0, x1 = F.try_element_at(xs, at), F.try_element_at(xs, at + 1)
    y0, y1 = F.try_element_at(ys, at), F.try_element_at(ys, at + 1)
    inner = y0 + (y1 - y0) * (value - x0) / (x1 - x0)
    return (F.when(value.isNull(), F.lit(None).cast("double"))
            .when(at <= 0, F.element_at(ys, 1)).when(at >= last, F.element_at(ys, -1)).otherwise(inner))


def stable_uniform(keys: Iterable[Column], seed: int) -> Column:
    """Uniform in [0, 1) fixed by the key values, so any layout or retry draws the same."""
    text = F.concat_ws("|", *[k.cast("string") for k in keys], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def arg_max(values: Column) -> Column:
    """Zero-based position of the first largest element."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")
