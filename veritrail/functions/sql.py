"""The scalar functions for use from SQL text: definitions in SQL, which Spark inlines into plans."""

from __future__ import annotations

from pyspark.sql import SparkSession

from veritrail.functions.names import SUFFIXES
from veritrail.functions.scalars import BANDS

_BAND = " ".join(f"WHEN p >= {least}D THEN '{name}'" for least, name in BANDS)
_STRIPPED = "regexp_replace(lower(coalesce(name, '')), '[^a-z0-9 ]+', ' ')"
_WORDS = rf"regexp_replace({_STRIPPED}, '\\b({'|'.join(SUFFIXES)})\\b', ' ')"
#: Name, parameters, type and body of each function, in an order in which they may use each other.
FUNCTIONS = [
    ("vt_clamp", "x DOUBLE, low DOUBLE DEFAULT 0D, high DOUBLE DEFAULT 1D", "DOUBLE", "greatest(low, least(high, x))"),
    ("vt_band", "p DOUBLE", "STRING", f"CASE {_BAND} WHEN p > 0 THEN 'LOW' ELSE 'NONE' END"),
    ("vt_noisy_or", "weights ARRAY<DOUBLE>", "DOUBLE", "1D - aggregate(array_sort(weights), 1D, (acc, w) -> acc * (1D - greatest(0D, least(1D, w))))"),
    ("vt_normalize_name", "name STRING", "STRING", rf"trim(regexp_replace({_WORDS}, '\\s+', ' '))"),
    ("vt_squeeze", "name STRING", "STRING", r"trim(regexp_replace(lower(coalesce(name, '')), '\\s+', ' '))"),
    ("vt_bigrams", "normal STRING", "ARRAY<STRING>", "CASE WHEN length(replace(normal, ' ', '')) < 2 THEN array(replace(normal, ' ', '')) ELSE array_distinct(transform(sequence(1, greatest(length(replace(normal, ' ', '')) - 1, 1)), i -> substring(replace(normal, ' ', ''), i, 2))) END"),
    ("vt_numbered_apart", "a STRING, b STRING", "BOOLEAN", "regexp_replace(a, '[^0-9]', '') <> regexp_replace(b, '[^0-9]', '') AND regexp_replace(a, '[0-9]', '') = regexp_replace(b, '[0-9]', '')"),
    (
        "vt_normal_similarity", "a STRING, b STRING", "DOUBLE",
        "CASE WHEN a = '' OR b = '' THEN 0D WHEN a = b THEN 1D WHEN vt_numbered_apart(a, b) THEN 0D "
        "ELSE round(2D * size(array_intersect(vt_bigrams(a), vt_bigrams(b))) / (size(vt_bigrams(a)) + size(vt_bigrams(b))), 4) END",
    ),
    ("vt_name_similarity", "a STRING, b STRING", "DOUBLE", "vt_normal_similarity(vt_normalize_name(a), vt_normalize_name(b))"),
    ("vt_make_id", "kind STRING, value STRING", "STRING", "concat(kind, '--', substring(sha1(encode(concat(kind, ':', value), 'UTF-8')), 1, 16))"),
    (
        "vt_uuid_of_hash", "h STRING", "STRING",
        "concat_ws('-', substring(h, 1, 8), substring(h, 9, 4), concat('5', substring(h, 14, 3)), concat(substring('89ab', CAST(conv(substring(h, 17, 1), 16, 10) AS INT) % 4 + 1, 1), substring(h, 18, 3)), substring(h, 21, 12))",
    ),
    ("vt_uuid5", "namespace STRING, name STRING", "STRING", "vt_uuid_of_hash(sha1(concat(unhex(replace(namespace, '-', '')), encode(name, 'UTF-8'))))"),
]


def register(spark: SparkSession) -> list[str]:
    """Make the functions known to the session, for as long as it lives; their names."""
    for name, parameters, kind, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    return [f[0] for f in FUNCTIONS]
