"""What a graph takes in: links of several sources, qualification of ids, choice of genes and of pathways."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import staged

#: Labels that keep an id out, and those that do unless a registry of rare diseases has it (fixed values).
NOT_A_DISEASE, NOT_ALONE = ("susceptibility", "protection against"), ("cancer", "carcinoma")


def first_values(df: DataFrame, key: list[str], value: str, n: int, salts: int = 64) -> DataFrame:
    """(key, firsts): the n least different values of each key, in order; a key of many values lies in many tasks."""
    rows = df.select(*key, value).where(F.col(value).isNotNull()).distinct().withColumn("_salt", F.pmod(F.xxhash64(value), F.lit(salts)))
    w = Window.partitionBy(*key, "_salt").orderBy(value)
    few = rows.withColumn("_at", F.row_number().over(w)).where(F.col("_at") <= n)
    return few.groupBy(*key).agg(F.slice(F.array_sort(F.collect_list(value)), 1, n).alias("firsts"))


def resolved(rows: DataFrame, ids: DataFrame, genes: DataFrame) -> DataFrame:
    """Rows (source, raw, gene, symbol, ref, polarity, detail) with `id` for raw and gene, or its symbol's; null where unknown.

    ids (raw, id), genes (symbol, gene): of several the least counts.  A given gene goes before its symbol.
    """
    of = ids.where("raw IS NOT NULL").groupBy("raw").agg(F.min("id").alias("id"))
    by = genes.where("symbol IS NOT NULL").groupBy("symbol").agg(F.min("gene").alias("_by"))
    j = rows.select("source", "raw", "gene", "symbol", "ref", "polarity", "detail").join(of, "raw", "left").join(by, "symbol", "left")
    return j.select("source", "id", F.coalesce("gene", "_by").alias("gene"), "ref", "polarity", "detail")


def links(known: DataFrame) -> DataFrame:
    """Resolved rows, one for each id, gene, source and reference; of unlike ones `contradicts` goes before `supports`."""
    whole = known.where("id IS NOT NULL AND gene IS NOT NULL AND polarity IS NOT NULL")
    return whole.groupBy("id", "gene", "source", "ref").agg(F.min(F.struct("polarity", "detail")).alias("r")).select("id", "gene", "source", "ref", "r.polarity", "r.detail")


def unlinked(known: DataFrame) -> DataFrame:
    """(source, n_rows, n_unmapped) of resolved rows; those without polarity are not meant as links."""
    meant = known.where("polarity IS NOT NULL")
    return meant.groupBy("source").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("id").isNull() | F.col("gene").isNull()).alias("n_unmapped"))


def variant_links(variants: DataFrame, within: DataFrame, least: int = 2, shown: int = 5) -> DataFrame:
    """(id, gene, n, firsts): pairs that at least `least` variants (gene, ids, variant) bear out, with the first few.

    within (id): ids in scope; the ids of a variant may repeat.
    """
    each = variants.select("gene", F.explode(F.array_distinct("ids")).alias("id"), "variant").where("gene IS NOT NULL AND variant IS NOT NULL")
    rows = staged(each.join(within.select("id").distinct(), "id", "left_semi").distinct(), "variant-pairs")
    n = rows.groupBy("id", "gene").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return n.join(first_values(rows, ["id", "gene"], "variant", shown), ["id", "gene"])


def holds_any(text: Column, words: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | F.contains(F.coalesce(F.lower(text), F.lit("")), F.lit(w))
    return found


def qualify(terms: DataFrame, below: DataFrame, source_genes: DataFrame, source_keys: DataFrame, phenotypes: DataFrame, approved: DataFrame, most_below: int = 30, not_a_disease=NOT_A_DISEASE, not_alone=NOT_ALONE) -> DataFrame:
    """(id, kind, n_genes, n_phenotypes, reason): every live term that a source keys, reason null if it qualifies, else the first that fails.

    terms (id, label, rare, matches: array of keys, deprecated), below (term, n: descendants), source_genes (id,
    gene, key), source_keys (id, key), phenotypes (id, term), approved (gene).  A key of a rare-disease registry
    starts with ORPHA:, one of the catalogue with OMIM:.
    """
    rows = source_genes.select("id", "gene", "key").unionByName(source_keys.select("id", F.lit(None).cast(source_genes.schema["gene"].dataType).alias("gene"), "key")).where("key IS NOT NULL")
    of_key = lambda p: F.coalesce(F.bool_or(F.startswith("key", F.lit(p))), F.lit(False))
    keyed = rows.groupBy("id").agg(of_key("ORPHA:").alias("orpha"), of_key("OMIM:").alias("omim"))
    good = approved.select("gene").distinct()
    genes = rows.select("id", "gene").distinct().join(good, "gene", "left_semi").groupBy("id").agg(F.count(F.lit(1)).alias("n_genes"))
    seen = phenotypes.select("id", "term").where("term IS NOT NULL").distinct().groupBy("id").agg(F.count(F.lit(1)).alias("n_phenotypes"))
    live = terms.where(~F.coalesce("deprecated", F.lit(False))).select("id", "label", F.coalesce("rare", F.lit(False)).alias("rare"), F.coalesce(F.exists("matches", lambda m: F.startswith(m, F.lit("ORPHA:"))), F.lit(False)).alias("matched"))
    j = live.join(keyed, "id").join(genes, "id", "left").join(seen, "id", "left").join(below.select(F.col("term").alias("id"), "n"), "id", "left")
    j = j.withColumns({"n_genes": F.coalesce("n_genes", F.lit(0)), "n_phenotypes": F.coalesce("n_phenotypes", F.lit(0))})
    registered = F.col("orpha") | F.col("matched")
    reason = (
        F.when(F.col("n_genes") == 0, "no approved gene")
        .when(F.col("n_phenotypes") == 0, "no phenotype")
        .when(holds_any(F.col("label"), not_a_disease), "label is no disease")
        .when(F.coalesce("n", F.lit(0)) > most_below, "too many descendants")
        .when(~registered & holds_any(F.col("label"), not_alone), "label needs a registry")
        .when(~(F.col("rare") | registered | F.col("omim")), "not rare")
    )
    kind = F.when(F.col("omim") & F.col("orpha"), "omim_and_orpha").when(F.col("omim"), "omim_only").otherwise("orpha_only")
    return j.select("id", kind.alias("kind"), "n_genes", "n_phenotypes", reason.alias("reason"))


def qualified_report(verdicts: DataFrame, source_genes: DataFrame, phenotypes: DataFrame, approved: DataFrame, shown: int = 5) -> DataFrame:
    """(section, name, n, firsts): counts of those in by kind and of those out by reason with the first few ids, and totals.

    verdicts: result of `qualify`; read several times, so written once.
    """
    v = staged(verdicts, "verdicts")
    name = F.coalesce("reason", "kind")
    rows = v.select(F.when(F.col("reason").isNull(), "in").otherwise("out").alias("section"), name.alias("name"), F.col("id").cast("string").alias("id"))
    counts = rows.groupBy("section", "name").agg(F.count(F.lit(1)).alias("n")).join(first_values(rows.where("section = 'out'"), ["section", "name"], "id", shown), ["section", "name"], "left")
    kept, good = v.where("reason IS NULL").select("id"), approved.select("gene").distinct()
    pairs = source_genes.where("key IS NOT NULL").select("id", "gene").distinct().join(good, "gene", "left_semi").join(kept, "id", "left_semi").groupBy("gene").agg(F.count(F.lit(1)).alias("n"))
    total = lambda df, n, c: df.agg(F.lit("total").alias("section"), F.lit(n).alias("name"), c.cast("long").alias("n"))
    gone = source_genes.where("gene IS NOT NULL").join(good, "gene", "left_anti")
    totals = total(pairs, "genes", F.count(F.lit(1))).unionByName(total(pairs, "most ids of a gene", F.coalesce(F.max("n"), F.lit(0))))
    totals = totals.unionByName(total(phenotypes.join(kept, "id", "left_semi").select("term").distinct(), "phenotypes", F.count("term"))).unionByName(total(gone, "links of withdrawn genes", F.count(F.lit(1))))
    return counts.unionByName(totals.withColumn("firsts", F.lit(None).cast("array<string>")))


def eligible(terms: DataFrame, below: DataFrame, seeds: DataFrame, require_rare: bool = True, most_below: int = 30) -> DataFrame:
    """(id, seed): live terms that are rare and no broad groups; seeds in any case."""
    live = terms.where(~F.coalesce("deprecated", F.lit(False)))
    rare = F.coalesce("rare", F.lit(False)) | F.coalesce(F.exists("matches", lambda m: F.startswith(m, F.lit("ORPHA:"))), F.lit(False))
    j = live.join(below.select(F.col("term").alias("id"), "n"), "id", "left").join(seeds.select("id", F.lit(True).alias("seed")).distinct(), "id", "left")
    fits = (F.coalesce("n", F.lit(0)) <= most_below) & (rare if require_rare else F.lit(True))
    return j.where(F.coalesce("seed", F.lit(False)) | fits).select("id", F.coalesce("seed", F.lit(False)).alias("seed"))


def select_genes(ids: DataFrame, seed_genes: DataFrame, pairs: DataFrame, most_own: int = 8, most: int = 150) -> DataFrame:
    """(gene, seed, n): all seed genes, then up to `most` in all those of most ids, ties to the lesser gene.

    pairs (id, gene); ids of more than most_own genes do not count.  What is chosen is at most `most` rows, so no
    large sort is needed.
    """
    own = staged(pairs.select("id", "gene").where("gene IS NOT NULL").distinct().join(ids.select("id").distinct(), "id", "left_semi"), "own-genes")
    few = own.groupBy("id").agg(F.count(F.lit(1)).alias("own")).where(F.col("own") <= most_own).select("id")
    counts = own.join(few, "id", "left_semi").groupBy("gene").agg(F.count(F.lit(1)).alias("n"))
    seeds = staged(seed_genes.select("gene").where("gene IS NOT NULL").distinct(), "seed-genes")
    more = counts.join(seeds, "gene", "left_anti").orderBy(F.desc("n"), "gene").limit(max(0, most - seeds.count()))
    return seeds.join(counts, "gene", "left").select("gene", F.lit(True).alias("seed"), F.coalesce("n", F.lit(0)).alias("n")).unionByName(more.select("gene", F.lit(False).alias("seed"), "n"))


def focus_genes(added: DataFrame, qualified: DataFrame, pairs: DataFrame, most_own: int = 8) -> DataFrame:
    """(gene): of added ids the qualifying genes, else all their genes if they are at most most_own.  qualified, pairs (id, gene)."""
    asked = added.select("id").distinct()
    first = qualified.select("id", "gene").where("gene IS NOT NULL").join(asked, "id", "left_semi")
    rest = asked.join(qualified.where("gene IS NOT NULL").select("id"), "id", "left_anti")
    other = pairs.select("id", "gene").where("gene IS NOT NULL").distinct().join(rest, "id", "left_semi")
    few = other.groupBy("id").agg(F.count(F.lit(1)).alias("own")).where(F.col("own") <= most_own)
    return first.select("gene").unionByName(other.join(few, "id", "left_semi").select("gene")).distinct()


def scoped_pathways(members: DataFrame, scope: DataFrame, focus: DataFrame, most_focus: int = 300, most_core: int = 60, least_scope: int = 2) -> DataFrame:
    """(pathway, gene, n_genes, tier): memberships of genes in scope that are worth a link, and the tier of their pathway.

    A focus gene keeps pathways of at most most_focus genes; the others those of at most most_core with at least
    least_scope genes in scope.  A pathway that a kept focus gene is in is of tier focus, else core.
    """
    m = members.select("pathway", "gene").where("pathway IS NOT NULL AND gene IS NOT NULL").distinct()
    inside = m.join(scope.select("gene", F.lit(1).alias("_in")).distinct(), "gene", "left")
    sizes = inside.groupBy("pathway").agg(F.count(F.lit(1)).alias("n_genes"), F.count("_in").alias("_n_scope"))
    at = inside.where("_in = 1").join(focus.select("gene", F.lit(True).alias("_focus")).distinct(), "gene", "left").join(sizes, "pathway")
    mine = F.coalesce("_focus", F.lit(False))
    kept = at.where((mine & (F.col("n_genes") <= most_focus)) | ((F.col("n_genes") <= most_core) & (F.col("_n_scope") >= least_scope)))
    kept = staged(kept.select("pathway", "gene", "n_genes", mine.alias("_focus")), "memberships")
    tiers = kept.groupBy("pathway").agg(F.when(F.bool_or("_focus"), "focus").otherwise("core").alias("tier"))
    return kept.join(tiers, "pathway").select("pathway", "gene", "n_genes", "tier")
