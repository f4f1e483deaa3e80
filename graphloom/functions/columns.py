"""Column expressions: identifiers, text folding, clamps.  All stay inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import FAMILIES, HIGH, MEDIUM, SYMMETRIC, TIER_WEIGHT

#: Latin letters with marks and what they fold to (fixed values).
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöøùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝ"
PLAIN = "aaaaaaceeeeiiiinoooooouuuuyyAAAAAACEEEEIIIINOOOOOOUUUUY"
QUOTES, STRAIGHT = "‘’“”–— ", "''\"\"-- "


def clamp(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def tier_weight(tier: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in TIER_WEIGHT.items() for x in pair])[tier]


def family(relation: Column) -> Column:
    return reduce(lambda c, kv: c.when(relation.isin(kv[1]), kv[0]), FAMILIES.items(), F.when(F.lit(False), F.lit("")))


def evidence_weight(tier: Column, origin: Column, weight: Column) -> Column:
    """The tier's weight; inferred rows count their own weight up to it."""
    top = tier_weight(tier)
    return F.when((origin == "inferred") & weight.isNotNull(), F.greatest(F.lit(0.0), F.least(top, weight))).otherwise(top)


def confidence_level(c: Column) -> Column:
    return F.when(c >= HIGH, "high").when(c >= MEDIUM, "medium").otherwise("low")


def canonical(source: Column, relation: Column, target: Column) -> tuple[Column, Column]:
    swap = relation.isin(SYMMETRIC) & (source > target)
    return F.when(swap, target).otherwise(source), F.when(swap, source).otherwise(target)


def edge_id(source: Column, relation: Column, target: Column) -> Column:
    a, b = canonical(source, relation, target)
    return F.concat(F.lit("e_"), F.substring(F.sha1(F.concat_ws("|", a, relation, b)), 1, 12))


def path_id(ids: Column) -> Column:
    return F.concat(F.lit("p_"), F.substring(F.sha1(F.array_join(ids, ">")), 1, 16))


def short_hash(n: int, *columns: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws("|", *columns)), 1, n)


def fold(text: Column) -> Column:
    """Lower case without marks, other signs as single spaces."""
    return F.trim(F.regexp_replace(F.lower(F.translate(text, ACCENTED, PLAIN)), "[^a-z0-9]+", " "))


def normal_text(text: Column) -> Column:
    """Typographic signs made plain, zero-width signs dropped, white space collapsed; case stays."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.translate(text, QUOTES, STRAIGHT), "[​‌‍﻿]", ""), r"[ \t\n\r]+", " "))


def quote_in_text(quote: Column, text: Column) -> Column:
    q = normal_text(quote)
    return (q != "") & F.contains(normal_text(text), q)


def slug(text: Column, most: int = 40) -> Column:
    return F.regexp_replace(F.substring(F.regexp_replace(fold(text), " ", "-"), 1, most), "-+$", "")


def scrub_contacts(text: Column) -> Column:
    mail = F.regexp_replace(text, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[email]")
    return F.regexp_replace(mail, r"\+?[0-9][0-9 ()/-]{7,}[0-9]", "[phone]")


def trigrams(text: Column) -> Column:
    """Distinct three-letter windows of the folded text with two spaces before and one after."""
    padded = F.concat(F.lit("  "), fold(text), F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substring(padded, i, F.lit(3))))


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return F.try_divide(both.cast("double"), (F.size(a) + F.size(b) - both).cast("double"))


def parsed_frequency(text: Column) -> Column:
    """'n/m', 'p%' or a plain number as a share; null if it is none of these or m is 0."""
    part = r"^\s*(\d+)\s*/\s*(\d+)\s*$"
    n, m = F.regexp_extract(text, part, 1), F.regexp_extract(text, part, 2)
    ratio = F.try_divide(F.try_to_number(n, F.lit("999999999")).cast("double"), F.try_to_number(m, F.lit("999999999")).cast("double"))
    percent = F.regexp_extract(text, r"^\s*(\d+(?:\.\d+)?)\s*%\s*$", 1)
    return F.when(text.rlike(part), ratio).when(percent != "", percent.cast("double") / 100)


def sentences(text: Column) -> Column:
    return F.filter(F.split(text, r"(?<=[.!?])\s+"), lambda s: F.trim(s) != "")
