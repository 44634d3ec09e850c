"""The SQL functions over whole tables, with DuckDB macros as oracles."""

from __future__ import annotations

from veritrail.functions import sql
from veritrail.functions.names import SUFFIXES
from veritrail.plans.views import table


def _over(text: str, **tables: str):
    def query(s, d):
        sql.register(s)
        return s.sql(text, **{view: table(s, d, name) for view, name in tables.items()})

    return query


QUERIES = {
    "sql_scores": _over(
        """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice,
                  vt_clamp(l_extendedprice / 100000D - 0.2D) AS share, vt_clamp(l_quantity, 10D, high => 40D) AS held,
                  vt_band(l_discount * 10D) AS band, vt_noisy_or(array(l_discount, l_tax, l_quantity / 100D)) AS either FROM {lines}""",
        lines="lineitem",
    ),
    "sql_names": _over(
        """SELECT p.p_partkey, vt_normalize_name(concat(p.p_brand, ' Ltd., ', p.p_name)) AS normal, vt_squeeze(concat('  ', p.p_type, '   ', p.p_name)) AS squeezed,
                  vt_name_similarity(p.p_name, q.p_name) AS similarity, vt_name_similarity(p.p_name, concat(upper(p.p_name), ' inc.')) AS same
           FROM {parts} p LEFT JOIN {others} q ON p.p_partkey + 1 = q.p_partkey""",
        parts="part", others="part",
    ),
    "sql_ids": _over(
        """SELECT o_orderkey, vt_make_id('order', o_orderpriority) AS priority_id, vt_uuid5('6ba7b812-9dad-11d1-80b4-00c04fd430c8', concat('order:', CAST(o_orderkey AS STRING))) AS uid FROM {orders}""",
        orders="orders",
    ),
}

_MACRO_BAND = "CASE WHEN {0} >= 0.8e0 THEN 'HIGH' WHEN {0} >= 0.5e0 THEN 'MODERATE' WHEN {0} > 0 THEN 'LOW' ELSE 'NONE' END"
_NORMAL = rf"trim(regexp_replace(regexp_replace(regexp_replace(lower(coalesce({{0}}, '')), '[^a-z0-9 ]+', ' ', 'g'), '\b({'|'.join(SUFFIXES)})\b', ' ', 'g'), '\s+', ' ', 'g'))"
_GRAMS = "CASE WHEN length({0}) < 2 THEN [{0}] ELSE list_distinct(list_transform(range(1, length({0})), lambda i: substr({0}, i, 2))) END"
ORACLES = {
    "sql_scores": f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice,
       greatest(0e0, least(1e0, l_extendedprice / 100000e0 - 0.2e0)) AS share, greatest(10e0, least(40e0, l_quantity)) AS held, {_MACRO_BAND.format('(l_discount * 10e0)')} AS band,
       1e0 - list_reduce(list_prepend(1e0, list_transform(list_sort([l_discount, l_tax, l_quantity / 100e0]), lambda w: 1e0 - greatest(0e0, least(1e0, w)))), lambda a, b: a * b) AS either FROM lineitem""",
    "sql_names": rf"""WITH n AS (
  SELECT p.p_partkey, {_NORMAL.format("(p.p_brand || ' Ltd., ' || p.p_name)")} AS normal, trim(regexp_replace(lower('  ' || p.p_type || '   ' || p.p_name), '\s+', ' ', 'g')) AS squeezed, {_NORMAL.format('p.p_name')} AS x, {_NORMAL.format('q.p_name')} AS y
  FROM part p LEFT JOIN part q ON p.p_partkey + 1 = q.p_partkey),
g AS (SELECT *, {_GRAMS.format("replace(x, ' ', '')")} AS gx, {_GRAMS.format("replace(y, ' ', '')")} AS gy FROM n)
SELECT p_partkey, normal, squeezed,
       CASE WHEN x = '' OR y = '' THEN 0e0 WHEN x = y THEN 1e0
            WHEN regexp_replace(x, '[^0-9]', '', 'g') <> regexp_replace(y, '[^0-9]', '', 'g') AND regexp_replace(x, '[0-9]', '', 'g') = regexp_replace(y, '[0-9]', '', 'g') THEN 0e0
            ELSE round(2e0 * len(list_intersect(gx, gy)) / (len(gx) + len(gy)), 4) END AS similarity,
       CASE WHEN x = '' THEN 0e0 ELSE 1e0 END AS same FROM g""",
    "sql_ids": """WITH h AS (SELECT o_orderkey, o_orderpriority, sha1(unhex('6ba7b8129dad11d180b400c04fd430c8') || encode('order:' || o_orderkey)) AS h FROM orders)
SELECT o_orderkey, 'order--' || substr(sha1('order:' || o_orderpriority), 1, 16) AS priority_id,
       concat_ws('-', substr(h, 1, 8), substr(h, 9, 4), '5' || substr(h, 14, 3), substr('89ab', CAST(('0x' || substr(h, 17, 1)) AS INTEGER) % 4 + 1, 1) || substr(h, 18, 3), substr(h, 21, 12)) AS uid FROM h""",
}
