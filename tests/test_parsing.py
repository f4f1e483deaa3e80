"""Names of variants, sequences and bands as they stand in public records."""

from pyspark.sql import functions as F

from graphloom.functions import parsing as P

VARIANTS = [
    ("NM_001165963.4(SCN1A):c.2134C>T (p.Arg712Ter)", "single nucleotide variant", "nonsense"),
    ("NM_000059.4(BRCA2):c.5946del (p.Ser1982fs)", "Deletion", "frameshift"),
    ("NM_000059.4(BRCA2):c.1813dup (p.Ile605AsnfsTer11)", "Duplication", "frameshift"),
    ("NM_000546.6(TP53):c.743G>A (p.Arg248Gln)", "single nucleotide variant", "missense"),
    ("NM_000546.6(TP53):c.639A>G (p.Arg213=)", "single nucleotide variant", "synonymous"),
    ("NM_000492.4(CFTR):c.1521_1523del (p.Phe508del)", "Microsatellite", "inframe_indel"),
    ("NM_004333.6(BRAF):c.1799_1800delinsAA (p.Val600_Lys601delinsGlu)", "Indel", "inframe_indel"),
    ("NM_007294.4(BRCA1):c.1A>G (p.Met1Val)", "single nucleotide variant", "missense"),
    ("NM_007294.4(BRCA1):c.3G>A (p.Met1?)", "single nucleotide variant", "start_lost"),
    ("NM_000518.5(HBB):c.443A>G (p.Ter148TrpextTer30)", "single nucleotide variant", "other"),
    ("NM_000051.4(ATM):c.2250+1G>A", "single nucleotide variant", "splice"),
    ("NM_000051.4(ATM):c.3994-2A>G", "single nucleotide variant", "splice"),
    ("NM_000051.4(ATM):c.496+12A>G", "single nucleotide variant", "other"),
    ("NM_000051.4(ATM):c.72+2del", "Deletion", "splice"),
    ("GRCh38/hg38 15q11.2-13.1(chr15:23123715-28193120)x1", "copy number loss", "copy_number"),
    ("NC_000002.12:g.(?_47403192)_(47410374_?)del", "Deletion", "indel"),
    (None, None, "other"),
]
PLACES = [("NC_000001.11", "1"), ("NC_000023.11", "X"), ("NC_000024.10", "Y"), ("NC_012920.1", "MT"), ("NC_000025.1", None), ("NC_000001", None), ("NM_000546.6", None), (None, None)]
BANDS = [("17p13.1", "17"), ("Xq28", "X"), ("Yp11.2", "Y"), ("1q21-q22", "1"), ("9cen", "9"), ("6", "6"), ("Xp22.33 and Yp11.2", "X"), ("mitochondria", "MT"), ("23q1", None), ("unplaced", None), ("", None), (None, None)]


def test_variant_names(spark):
    df = spark.createDataFrame(VARIANTS, "name string, kind string, want string")
    wrong = df.withColumn("got", P.consequence(F.col("name"), F.col("kind"))).where("got IS DISTINCT FROM want").collect()
    assert wrong == []


def test_chromosomes(spark):
    for cases, f in ((PLACES, P.refseq_chromosome), (BANDS, P.cytoband_chromosome)):
        df = spark.createDataFrame(cases, "x string, want string")
        assert df.withColumn("got", f(F.col("x"))).where("got IS DISTINCT FROM want").collect() == []
