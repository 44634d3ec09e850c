"""Entity resolution: fuzzy groups of names, and rewriting transfers to them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritrail.functions.names import SIMILAR, bigrams, dice, normalize_name
from veritrail.operators.components import connected_components
from veritrail.storage import materialize


#: Names that differ in their digits alone are a series from this many on: they meet names of other letters only.
SERIES = 100


def similar_pairs(names: DataFrame, threshold: float = SIMILAR, series: int = SERIES) -> DataFrame:
    """(a, b, similarity) of distinct ``names`` (name), a < b, at least ``threshold`` (above 0) alike.

    Names with equal normal forms meet through the least of them; the others through shared bigrams, of which
    a name's rarest are enough: with a similarity of t, two sets overlap in t / (2 - t) of the larger one. Where they meet, sets
    as 256 bits tell apart what can't be alike, since each bit that differs is a bigram of one name only; so few pairs leave the join.
    Members of a numbered series are never alike and don't meet: series meet other series by their letters first.
    """
    known = names.where("name is not null and name <> ''").select("name").distinct().withColumn("normal", normalize_name(F.col("name"))).where("normal <> ''")
    forms = known.groupBy("normal").agg(F.min("name").alias("first"))
    same = known.join(forms, "normal").where("name <> first").select(F.col("first").alias("a"), F.col("name").alias("b"), F.lit(1.0).alias("similarity"))
    grams = materialize(forms.withColumn("grams", bigrams(F.col("normal")))).withColumn("n", F.size("grams"))
    each = grams.select("normal", "first", "n", F.explode("grams").alias("gram"))
    counts = each.groupBy("gram").agg(F.count("*").alias("df"))
    place = F.pmod(F.xxhash64("gram"), F.lit(256)).cast("int")
    each = each.withColumns({"word": F.shiftright(place, 6), "bit": F.expr("shiftleft(1L, pmod(xxhash64(gram), 64L))")})
    words = [F.bit_or(F.when(F.col("word") == k, F.col("bit")).otherwise(F.lit(0).cast("long"))).alias(f"s{k}") for k in range(4)]
    ranked = each.join(counts, "gram").groupBy("normal", "first", "n").agg(F.array_sort(F.collect_list(F.struct("df", "gram"))).alias("order"), *words)
    need = F.ceil(F.lit(threshold - 0.0001) / F.lit(2.0 - threshold) * F.col("n")).cast("int")
    letters, digits = F.regexp_replace("normal", "[0-9]", "").alias("letters"), F.regexp_replace("normal", "[^0-9]", "").alias("digits")
    held = ["first", "n", "s0", "s1", "s2", "s3", "letters", "digits"]
    rare = F.slice("order", F.lit(1), F.greatest(F.col("n") - need + 1, F.lit(1)))
    placed = materialize(ranked.select("first", "n", "s0", "s1", "s2", "s3", letters, digits, F.transform(rare, lambda g: g["gram"]).alias("rare")))
    # At most one of as many names as a series has.
    long = placed.groupBy("letters").agg(F.count("*").alias("members")).where(F.col("members") >= series).select("letters", F.lit(True).alias("long"))
    prefix = materialize(placed.join(long, "letters", "left").select(*held, F.coalesce("long", F.lit(False)).alias("long"), F.explode("rare").alias("gram")))
    x, y = prefix.alias("x"), prefix.alias("y")
    both = F.col("x.n") + F.col("y.n")
    differ = F.bit_count(F.col("x.s0").bitwiseXOR(F.col("y.s0")))
    for k in range(1, 4):
        differ = differ + F.bit_count(F.col(f"x.s{k}").bitwiseXOR(F.col(f"y.s{k}")))
    fits = (F.lit(threshold - 0.0001) * both <= 2 * F.least("x.n", "y.n")) & (differ <= F.lit(1.0 - threshold + 0.0001) * both)
    ordered, apart, alike = F.col("x.first") < F.col("y.first"), F.col("x.letters") != F.col("y.letters"), F.col("x.digits") == F.col("y.digits")
    ends = [F.least("x.first", "y.first").alias("a"), F.greatest("x.first", "y.first").alias("b")]
    gram, single = F.col("x.gram") == F.col("y.gram"), ~F.col("x.long")
    met = x.where(single).join(y, gram & (ordered | F.col("y.long")) & fits & (apart | alike)).select(*ends)
    # Members of one series with the same digits, which are at other places.
    met = met.union(x.where(~single).join(y.where("y.long"), gram & (F.col("x.letters") == F.col("y.letters")) & alike & ordered & fits).select(*ends))
    # Two series.
    kinds = prefix.where("long").select("gram", "letters").distinct()
    two = kinds.join(kinds.select("gram", F.col("letters").alias("others")), "gram").where("letters < others")
    x, y = two.join(prefix.where("long"), ["gram", "letters"]).alias("x"), prefix.where("long").alias("y")
    met = met.union(x.join(y, gram & (F.col("x.others") == F.col("y.letters")) & fits).select(*ends))
    met = materialize(met.distinct())
    side = lambda c: grams.select(F.col("first").alias(c), F.col("grams").alias(f"g{c}"))
    scored = met.join(side("a"), "a").join(side("b"), "b").withColumn("similarity", dice(F.size(F.array_intersect("ga", "gb")), F.size("ga"), F.size("gb")))
    return same.unionByName(scored.where(F.col("similarity") >= threshold).select("a", "b", "similarity"))


def resolve_entities(names: DataFrame, threshold: float = SIMILAR) -> DataFrame:
    """(name, canonical) with the least name of each fuzzy group."""
    known = names.where("name is not null and name <> ''").select(F.col("name").alias("node"))
    return connected_components(similar_pairs(names, threshold), known).select(F.col("node").alias("name"), F.col("component").alias("canonical"))


def apply_resolution(transfers: DataFrame, mapping: DataFrame) -> DataFrame:
    """Transfers with src and dst replaced by their canonical names; others stay."""
    changed = mapping.where("name <> canonical")
    out = transfers
    for side in ("src", "dst"):
        out = out.join(changed.select(F.col("name").alias(side), F.col("canonical").alias("__to")), side, "left").withColumn(side, F.coalesce("__to", side)).drop("__to")
    return out.select(transfers.columns)


def merges(mapping: DataFrame) -> DataFrame:
    """(canonical, members) of groups of several names."""
    return mapping.groupBy("canonical").agg(F.array_sort(F.collect_list("name")).alias("members")).where(F.size("members") > 1)
