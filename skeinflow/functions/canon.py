"""Canonical forms of hosts, flow ids, labels and times, as JVM-side expressions.

Every function takes a Column (or a name) and returns a Column. The SQL twins,
for DuckDB oracles, are in :mod:`skeinflow.plans.sqlkit`.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Blanks to strip, and the written forms of an IPv4 address.
BLANKS = r"[\s\x{00a0}\x{200b}\x{feff}]+"
DOTTED = r"^\[?(?:(?:::|(?:0{1,4}:){5})ffff:)?(\d+\.\d+\.\d+\.\d+)\]?(?::\d{1,5})?(?:/\d{1,3})?$"
PLAIN = r"^(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\z"
OCTETS = r"^(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)$"
MAPPED_HEX = r"^\[?(?:::|(?:0{1,4}:){5})ffff:([0-9a-f]{1,4}):([0-9a-f]{1,4})\]?(?:/\d{1,3})?$"
INTEGER = r"^\d{7,10}$"
#: Seconds beyond this are really milliseconds.
MILLIS_FROM = 1e11


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _quad(number: Column) -> Column:
    """Dotted quad of an unsigned 32-bit number. Kept out of generated code, where four copies of ``number`` would crowd out the common case."""
    shifts = F.array(*[F.lit(s) for s in (24, 16, 8, 0)])
    return F.array_join(F.transform(shifts, lambda s: F.call_function("shiftright", number, s).bitwiseAND(F.lit(255).cast("long")).cast("string")), ".")


def host(c: Column | str) -> Column:
    """Canonical dotted quad, or null where the text names no IPv4 address.

    Accepted: dotted quads with leading zeros (always decimal), blanks around,
    brackets, a port, a prefix length, an IPv4-mapped IPv6 prefix with dotted or
    hexadecimal tail, and plain integers. Everything else - null, empty, "-",
    "N/A", "unknown", octets above 255 - is no host.
    """
    raw = _col(c)
    s = F.lower(F.regexp_replace(raw, BLANKS, ""))
    dotted = F.regexp_replace(F.regexp_extract(s, DOTTED, 1), r"(^|\.)0+([0-9])", "$1$2")
    digits = F.concat(*[F.lpad(F.regexp_extract(s, MAPPED_HEX, i), 4, "0") for i in (1, 2)])
    number = F.when(s.rlike(MAPPED_HEX), F.conv(digits, 16, 10)).when(s.rlike(INTEGER), s).cast("long")
    # Most addresses are canonical already: one match settles them.
    return F.when(raw.rlike(PLAIN), raw).when(dotted.rlike(OCTETS), dotted).when(number <= 4294967295, _quad(number))


def flow_id(c: Column | str) -> Column:
    """Lower case without surrounding blanks; null where nothing is left."""
    s = F.lower(F.regexp_replace(_col(c), rf"^{BLANKS}|{BLANKS}$", ""))
    return F.when(s != "", s)


def label(c: Column | str, missing: str | None = None) -> Column:
    """Trimmed lower-case label; null (or ``missing``) where there is none."""
    s = F.lower(F.trim(_col(c)))
    s = F.when(s != "", s)
    return F.coalesce(s, F.lit(missing)) if missing is not None else s


def millis(c: Column | str) -> Column:
    """Unix time in whole milliseconds; values given in milliseconds already are kept. NaN and infinity are null."""
    v = _col(c).cast("double")
    ok = v.isNotNull() & ~F.isnan(v) & (F.abs(v) < 1e15)
    return F.when(ok, F.round(F.when(F.abs(v) >= MILLIS_FROM, v).otherwise(v * 1000.0)).cast("long"))


def interval(first: Column | str, last: Column | str) -> tuple[Column, Column]:
    """Start and end in ms of a flow record: exchanged ends are put right, a missing end is the start, no start means no time."""
    a, b = millis(first), millis(last)
    return F.when(a.isNotNull(), F.least(a, b)), F.when(a.isNotNull(), F.greatest(a, b))


def port(c: Column | str) -> Column:
    """The port, or null where it is null or below 1."""
    p = _col(c).cast("int")
    return F.when(p >= 1, p)


def measured(c: Column | str) -> Column:
    """A double that was measured: null, NaN, infinities and -1 mean it was not."""
    v = _col(c).cast("double")
    ok = v.isNotNull() & ~F.isnan(v) & (v != float("inf")) & (v != float("-inf")) & (v != -1.0)
    return F.when(ok, v)
