"""Names of entities: normalisation and bigram similarity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Corporate suffix words that do not tell names apart (fixed values).
SUFFIXES = "inc incorporated ltd limited llc llp corp corporation co company gmbh sa ag plc pte bv nv".split()
SIMILAR = 0.82


def normalize_name(name: Column) -> Column:
    """Lower case, marks to spaces, corporate suffixes out, one space between words."""
    s = F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), "[^a-z0-9 ]+", " ")
    s = F.regexp_replace(s, rf"\b({'|'.join(SUFFIXES)})\b", " ")
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def squeeze(name: Column) -> Column:
    """Lower case and one space between words, as sanctions lists are matched."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"\s+", " "))


def bigrams(normal: Column) -> Column:
    s = F.replace(normal, F.lit(" "), F.lit(""))
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.length(s) - 1, F.lit(1))), lambda i: F.substring(s, i, F.lit(2)))
    return F.when(F.length(s) < 2, F.array(s)).otherwise(F.array_distinct(pairs))


def dice(shared: Column, a: Column, b: Column) -> Column:
    """Dice coefficient from the sizes of the overlap and of both sets, to four places."""
    return F.round(F.lit(2.0) * shared / (a + b), 4)


def numbered_apart(a: Column, b: Column) -> Column:
    """Two normalised names that differ in their digits alone: members of a numbered series."""
    digits, letters = (lambda s: F.regexp_replace(s, "[^0-9]", "")), (lambda s: F.regexp_replace(s, "[0-9]", ""))
    return (digits(a) != digits(b)) & (letters(a) == letters(b))


def similarity(a: Column, b: Column) -> Column:
    """0 to 1 for two raw names."""
    na, nb = normalize_name(a), normalize_name(b)
    ga, gb = bigrams(na), bigrams(nb)
    out = F.when((na == "") | (nb == ""), 0.0).when(na == nb, 1.0).when(numbered_apart(na, nb), 0.0)
    return out.otherwise(dice(F.size(F.array_intersect(ga, gb)), F.size(ga), F.size(gb)))
