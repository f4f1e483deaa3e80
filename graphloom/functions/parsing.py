"""Column expressions that read identifiers, positions, variants, names and frequencies out of text."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .columns import fold

# Names, codes and labels of the public databases.
FREQUENCY_CODES = {"HP:0040280": 1.0, "HP:0040281": 0.9, "HP:0040282": 0.55, "HP:0040283": 0.17, "HP:0040284": 0.025, "HP:0040285": 0.0}
CLASSES = {
    "pathogenic/likely pathogenic": "likely_pathogenic",
    "likely pathogenic": "likely_pathogenic",
    "pathogenic": "pathogenic",
    "uncertain significance": "uncertain_significance",
    "conflicting classifications of pathogenicity": "conflicting",
    "conflicting interpretations of pathogenicity": "conflicting",
    "likely benign": "likely_benign",
    "benign/likely benign": "likely_benign",
    "benign": "benign",
}
STARS = {
    "practice guideline": 4,
    "reviewed by expert panel": 3,
    "criteria provided, multiple submitters, no conflicts": 2,
    "criteria provided, conflicting classifications": 1,
    "criteria provided, conflicting interpretations": 1,
    "criteria provided, single submitter": 1,
}


def looked_up(key: Column, table: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[key]


def taken(text: Column, pattern: str) -> Column:
    """Group 1 of the first match, null if there is none."""
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def curie(iri: Column) -> Column:
    """The last part of an IRI with its first underscore as a colon."""
    return F.regexp_replace(F.substring_index(iri, "/", -1), "^([^_]*)_", "$1:")


def exact_xref(iri: Column) -> Column:
    prefixes = {"OMIM:": r"^https?://omim\.org/entry/(\d+)", "ORPHA:": r"^https?://www\.orpha\.net/ORDO/Orphanet_(\d+)", "MEDGEN:": r"^https?://identifiers\.org/medgen/(\w+)"}
    return F.coalesce(*[F.concat(F.lit(p), taken(iri, r)) for p, r in prefixes.items()])


#: Chromosomes in the order of their reference sequences NC_000001 to NC_000024.
CHROMOSOMES = [*map(str, range(1, 23)), "X", "Y"]
MITOCHONDRION = "NC_012920"


def refseq_chromosome(accession: Column) -> Column:
    """The chromosome of a versioned reference sequence; null for other sequences."""
    names = {f"NC_{i:06d}": c for i, c in enumerate(CHROMOSOMES, 1)} | {MITOCHONDRION: "MT"}
    versioned = F.regexp_count(accession, F.lit(r"\.\d+$")) == 1
    return F.when(versioned, looked_up(F.substring_index(accession, ".", 1), names))


def cytoband_chromosome(location: Column) -> Column:
    """The chromosome of a band: what stands before its arm (p, q) or centromere in the first word."""
    word = F.lower(F.regexp_extract(location, r"(\S+)", 1))
    head = F.upper(F.regexp_extract(word, "^(.*?)(?:cen|p|q|$)", 1))
    return F.when(F.startswith(word, F.lit("mito")), "MT").when(head.isin(CHROMOSOMES), head)


def coded_frequency(text: Column) -> Column:
    """A frequency code, n/m or p%; anything else, and m of 0, is null."""
    part = r"^(\d+)/(\d+)$"
    ratio = F.try_divide(taken(text, part).cast("double"), F.nullif(F.regexp_extract(text, part, 2), F.lit("")).cast("double"))
    percent = taken(text, r"^([\d.]+)%$")
    return F.coalesce(looked_up(text, FREQUENCY_CODES), ratio, percent.cast("double") / 100)


def classification(text: Column) -> Column:
    """The class before the first semicolon and comma."""
    return looked_up(F.trim(F.substring_index(F.substring_index(F.lower(text), ";", 1), ",", 1)), CLASSES)


def review_stars(status: Column) -> Column:
    return F.coalesce(looked_up(F.lower(F.trim(status)), STARS), F.lit(0))


def protein_change(description: Column) -> tuple[Column, Column, Column]:
    """(residue, position, change) of a protein description such as Arg97ProfsTer23 or Lys2_Met3del."""
    form = r"^([A-Z][a-z]{2}|\*)(\d+)(?:_[A-Z][a-z]{2}\d+)?(.*)$"
    part = lambda i: F.regexp_extract(description, form, i)
    return part(1), part(2), part(3)


def consequence(name: Column, kind: Column) -> Column:
    """Coarse molecular consequence of a variant by its name (HGVS) and kind of variant.

    The protein description decides where the name has one.  Else a change at the first or second base of an
    intron (offset +1, +2, -1 or -2 from a coding position) is a splice change, and the kind tells the rest.
    """
    p = F.nullif(F.regexp_extract(name, r"\(p\.([^)]+)\)", 1), F.lit(""))
    residue, position, change = protein_change(p)
    stops = {"Ter": True, "*": True}
    of_change = {"=": "synonymous"}
    start = (residue == "Met") & (position == "1")
    lengthened = F.contains(change, F.lit("ext"))
    protein = F.coalesce(
        looked_up(change, of_change),
        F.when(F.contains(change, F.lit("fs")), "frameshift"),
        F.when(~lengthened & (F.coalesce(looked_up(change, stops), F.lit(False)) | F.endswith(change, F.lit("Ter"))), "nonsense"),
        F.when(change.rlike("^[A-Z][a-z]{2}$"), "missense"),
        F.when(F.regexp_count(change, F.lit("del|ins|dup")) > 0, "inframe_indel"),
        F.when(start, "start_lost"),
        F.lit("other"),
    )
    offset = F.regexp_extract(name, r"c\.[-*]?\d+([+-]\d+)(?:[ACGT]>|>|del|dup)", 1)
    kinds = {"copy number loss": "copy_number", "copy number gain": "copy_number", "deletion": "indel", "duplication": "indel"}
    genomic = F.when(offset.isin("+1", "+2", "-1", "-2"), "splice").otherwise(F.coalesce(looked_up(F.lower(kind), kinds), F.lit("other")))
    return F.when(p.isNotNull(), protein).otherwise(genomic)


def accession(variation_id: Column) -> Column:
    return F.concat(F.lit("VCV"), F.lpad(variation_id.cast("string"), 9, "0"))


def person_key(last: Column, first: Column) -> tuple[Column, Column]:
    """(first given name and last name, folded; whether the given name is an initial or missing)."""
    given = F.coalesce(F.try_element_at(F.split(fold(F.coalesce(first, F.lit(""))), " "), F.lit(1)), F.lit(""))
    return F.trim(F.concat_ws(" ", given, fold(F.coalesce(last, F.lit(""))))), F.length(given) <= 1


def orcid(text: Column) -> Column:
    digits = F.upper(F.regexp_replace(taken(text, r"(\d{4}-?\d{4}-?\d{4}-?\d{3}[\dXx])"), "-", ""))
    return F.regexp_replace(digits, r"(.{4})(.{4})(.{4})(.{4})", "$1-$2-$3-$4")


def cited_edges(text: Column) -> Column:
    """Edge ids in a text, each once, in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit("(e_[0-9a-f]{12})"), F.lit(1)))


def reading_grade(text: Column) -> Column:
    """Flesch-Kincaid grade with groups of vowels as syllables; null without words."""
    words, ends = F.regexp_count(text, F.lit("[A-Za-z']+")), F.greatest(F.lit(1), F.regexp_count(text, F.lit("[.!?]+")))
    syllables = F.regexp_count(F.lower(text), F.lit("[aeiouy]+"))
    # Rounded as tenths: the digits of 7.45 are 7.4499999..., its tenths are 74.5, which SQL rounds up.
    return F.when(words > 0, F.round((0.39 * words / ends + 11.8 * syllables / words - 15.59) * 10) / 10)


@F.pandas_udf(StringType())
def _unmarked(text: pd.Series) -> pd.Series:
    strip = lambda t: "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c))
    return text.map(strip, na_action="ignore")


@F.pandas_udf(StringType())
def _composed(text: pd.Series) -> pd.Series:
    return text.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def unmarked(text: Column) -> Column:
    """Compatibility decomposition without combining marks; Spark has no such function, so texts go through Arrow."""
    return _unmarked(text)


def normal_name(text: Column) -> Column:
    """Lower case without marks; signs other than letters, digits and plus as single spaces."""
    return F.trim(F.regexp_replace(F.lower(unmarked(text)), "[^0-9a-z+]+", " "))


def composed_text(text: Column) -> Column:
    """Compatibility composition, straight quotes and dashes, no zero-width signs, single spaces; case stays."""
    from .columns import normal_text

    return normal_text(_composed(text))


def first_reason(rules: list[tuple[str, Column]], passed: str = "qualified") -> Column:
    """The name of the first rule whose condition holds."""
    return reduce(lambda c, rule: c.when(rule[1], rule[0]), rules[1:], F.when(rules[0][1], rules[0][0])).otherwise(passed)


def joined(names: Column) -> Column:
    """'a', 'a and b', 'a, b and c'."""
    n = F.size(names)
    return F.when(n < 2, F.array_join(names, "")).otherwise(F.concat_ws(" and ", F.array_join(F.slice(names, 1, F.greatest(n - 1, F.lit(1))), ", "), F.try_element_at(names, F.lit(-1))))


#: Digits of the numbers of padded id kinds (fixed values).
PADDED = {"MONDO": 7, "HP": 7}


def is_id_query(query: Column) -> Column:
    """Whether a query is a prefixed id, as MONDO:0007606, hp_1263 or PMID: 2317429."""
    return F.coalesce(F.upper(F.trim(query)).rlike(r"^[A-Z][A-Z0-9.-]*[:_]\s*[A-Z0-9][A-Z0-9._-]*$"), F.lit(False))


def id_candidates(query: Column, padded: dict[str, int] = PADDED) -> Column:
    """The ids that an id query may mean: as written, with a colon, and with its number without or with the right leading zeros."""
    raw = F.upper(F.trim(query))
    form = r"^([A-Z]+)[:_ ]+0*(\d+)$"
    prefix, number = F.regexp_extract(raw, form, 1), F.regexp_extract(raw, form, 2)
    filled = number
    for p, n in padded.items():
        filled = F.when((prefix == p) & (F.length(number) < n), F.lpad(number, n, "0")).otherwise(filled)
    colon = F.regexp_replace(raw, "^([^_]*)_", "$1:")
    return F.array_distinct(F.array_compact(F.array(raw, colon, F.when(prefix != "", F.concat(prefix, F.lit(":"), filled)))))
