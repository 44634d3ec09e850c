"""Scalar functions as Column expressions: scores, identifiers, times and rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bands of a probability, highest first (fixed values).
BANDS = ((0.80, "HIGH"), (0.50, "MODERATE"))


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def band(p: Column) -> Column:
    out = F.when(p >= BANDS[0][0], BANDS[0][1]).when(p >= BANDS[1][0], BANDS[1][1])
    return out.when(p > 0, "LOW").otherwise("NONE")


def noisy_or(weights: Column) -> Column:
    """1 minus the product of complements, of an array of weights; multiplied in sorted order, so that it is reproducible."""
    return F.lit(1.0) - F.aggregate(F.array_sort(weights), F.lit(1.0), lambda acc, w: acc * (F.lit(1.0) - clamp(w)))


def make_id(kind: str | Column, value: Column) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.concat(kind, F.lit("--"), F.substring(F.sha1(F.encode(F.concat(kind, F.lit(":"), value), "UTF-8")), 1, 16))


def finding_id(typology: Column, entities: Column) -> Column:
    """Identifier of a finding: its typology and its set of entities, whatever their order."""
    names = F.array_sort(F.transform(entities, lambda e: F.coalesce(e, F.lit("None"))))
    return F.concat(F.lit("finding--"), F.substring(F.sha1(F.encode(F.concat(typology, F.lit("|"), F.array_join(names, "|")), "UTF-8")), 1, 16))


def uuid5(namespace: str, name: Column) -> Column:
    """Name-based UUID (version 5) in the namespace with that hexadecimal value."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4) + 1, F.lit(1))
    part = lambda a, n: F.substring(h, a, n)
    return F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("5"), part(14, 3)), F.concat(variant, part(18, 3)), part(21, 12))


def ntz_micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp without time zone, whatever the session's zone."""
    seconds = F.unix_date(ts.cast("date")).cast("long") * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60
    return seconds * 1000000 + (F.extract(F.lit("SECOND"), ts) * 1000000).cast("long")


_DAY, _TIME = r"\d{4}-\d{2}-\d{2}", r"\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?"


def parse_micros(text: Column) -> Column:
    """Microseconds since 1970 of an ISO date or time; no zone means UTC, and text after a whole date or time is
    ignored. Null where the text doesn't start with a date. Week dates and compact forms aren't read."""
    s = F.trim(text)
    full = F.regexp_extract(s, rf"^({_DAY}[T ]{_TIME})\s*(Z|[+-]\d{{2}}:?\d{{2}})?", 1)
    zone = F.regexp_extract(s, rf"^{_DAY}[T ]{_TIME}\s*(Z|[+-]\d{{2}}:?\d{{2}})?", 3)
    day = F.regexp_extract(s, rf"^({_DAY})", 1)
    local = F.coalesce(F.try_to_timestamp(F.when(full != "", F.concat(F.regexp_replace(full, " ", "T"), F.lit("Z")))), F.try_to_timestamp(F.when(day != "", F.concat(day, F.lit("T00:00:00Z")))))
    hours = F.regexp_extract(zone, r"^[+-](\d{2}):?(\d{2})", 1)
    minutes = F.regexp_extract(zone, r"^[+-](\d{2}):?(\d{2})", 2)
    offset = F.when(hours != "", (F.try_to_number(hours, F.lit("99")).cast("long") * 60 + F.try_to_number(minutes, F.lit("99")).cast("long")) * F.when(zone.startswith("-"), -60000000).otherwise(60000000)).otherwise(0)
    return F.unix_micros(local) - offset


def epoch_micros(text: Column) -> Column:
    """As :func:`parse_micros`, 0 where there is no time."""
    return F.coalesce(parse_micros(text), F.lit(0).cast("long"))
