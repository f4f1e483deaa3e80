"""Readers on files written here: several splits, records over their borders, broken records counted."""

import gzip
import json

from pyspark.sql import functions as F

from graphloom.sources import files as R
from graphloom.sources import normal as N


def stanzas(n):
    out = ["format-version: 1.2\n\n"]
    for i in range(n):
        lines = ["[Term]", f"id: T:{i:04d}", f"name: term {i}", f'def: "a \\"d\\" {i}" [ref]', f'synonym: "s {i}" EXACT []', f"is_a: T:{max(0, i - 1):04d} {{x=1}} ! up", f"xref: MESH:{i} \"x\"", f"relationship: part_of T:{i // 2:04d} ! p"]
        out.append("\n".join(lines + ["x: " + "y" * (i % 97)]) + "\n\n")
    return "".join(out) + "[Term]\nname: no id\n\n[Term]\nid: A:1\nid: A:2\n\n[Typedef]\nid: part_of\n\n[Term]\nid: T:old\nis_obsolete: true\n"


def test_obo_over_split_borders(spark, tmp_path):
    """Splits of 1 KB over records of about 200 bytes: each is read once."""
    (tmp_path / "a.obo").write_text(stanzas(300))
    (tmp_path / "crlf.obo").write_bytes(b"[Term]\r\nid: C:1\r\nname: one\r\n\r\n[Term]\r\nid: C:2\r\n")
    (tmp_path / "z.obo.gz").write_bytes(gzip.compress(b"[Term]\nid: Z:1\n"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1024")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        df = R.obo(spark, f"file://{tmp_path}")
        assert spark.read.option("lineSep", "\n[").text(f"file://{tmp_path}").rdd.getNumPartitions() > 20
        rows = {r["id"]: r for r in df.where("NOT bad").collect()}
        told = R.faults(df).first()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert (told["rows"], told["bad"]) == (306, 2) and len(rows) == 304
    one = rows["T:0123"]
    assert (one["name"], one["definition"], one["parents"], one["synonyms"], one["xrefs"], one["part_of"], one["obsolete"]) == ("term 123", 'a "d" 123', ["T:0122"], ["s 123"], ["MESH:123"], ["T:0061"], False)
    assert rows["T:old"]["obsolete"] and rows["C:1"]["name"] == "one" and rows["C:2"]["name"] is None and "Z:1" in rows


def test_normalized_terms(spark, tmp_path):
    (tmp_path / "a.obo").write_text(stanzas(5))
    parsed = R.obo(spark, f"file://{tmp_path}")
    out = N.terms(parsed, "phenotype", "T")
    assert out["nodes"].count() == 5 and out["synonyms"].count() == 5
    assert sorted((r["source_id"], r["target_id"]) for r in out["assertions"].collect())[:2] == [("T:0000", "T:0000"), ("T:0001", "T:0000")]
    some = N.terms(parsed, "phenotype", "T", spark.createDataFrame([("T:0001",), ("T:0002",)], "id string"))
    assert [(r["source_id"], r["target_id"]) for r in some["assertions"].collect()] == [("T:0002", "T:0001")]
    assert N.terms(parsed.limit(0), "x", "y")["nodes"].collect() == []


def test_gaf(spark, tmp_path):
    good = ["DB", "P1", "S", "NOT|enables", "GO:1", "PMID:1|PMID:2", "IEA", "", "P", "name", "a|b", "protein", "taxon:9606", "20200101", "X"]
    (tmp_path / "a.gaf").write_text("!c\n" + "\t".join(good) + "\n" + "\t".join(good + ["", ""]) + "\n" + "\t".join(good[:9]) + "\n" + "\t".join([*good[:1], "", *good[2:]]) + "\n\n")
    df = R.gaf(spark, f"file://{tmp_path}")
    assert tuple(R.faults(df).first()) == (4, 2)
    r = df.where("NOT bad").first()
    assert r["negated"] and r["references"] == ["PMID:1", "PMID:2"] and r["synonyms"] == ["a", "b"] and r["symbol"] == "S"
    claims = N.annotations(df, "UP:", "GO").collect()
    assert sorted((c["source_id"], c["source_ref"], c["polarity"], c["origin"]) for c in claims) == [("UP:P1", "PMID:1", "contradicts", "inferred"), ("UP:P1", "PMID:2", "contradicts", "inferred")]


def test_delimited_and_comma_separated(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.tsv").write_text("##meta\n#id\tname\tat\n1\tx\t a |b||\"c\"\r\n2\t\t\n3\ttoo few\n\n")
    df = R.delimited(spark, f"file://{tmp_path}/t", ["id", "name", "at"], comment="##", header=True)
    rows = sorted((r["id"], r["name"], r["bad"]) for r in df.select("id", F.coalesce("name", F.lit("-")).alias("name"), "bad").collect())
    assert rows == [("1", "x", False), ("2", "-", False), ("3", "too few", True)]
    assert df.where("id = '1'").select(R.several(F.col("at"))).first()[0] == ["a", "b", '"c']  # one pair of outer quotes belongs to the field
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "a.csv").write_text('"REPORT","","of today"\n"GENE","ID","DATE"\n"+++++","+++","++"\n"A, B","HGNC:1","2020"\n"x ""y""","HGNC:2",""\n')
    got = R.comma_separated(spark, f"file://{tmp_path}/c", ["GENE", "ID", "DATE"], "ID")
    assert [(r["GENE"], r["ID"], r["bad"]) for r in got.orderBy("ID").collect()] == [("A, B", "HGNC:1", False), ('x "y"', "HGNC:2", False)]


def test_xml_and_graph(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "a.xml").write_text("<JDBOR><DisorderList count='2'>" + "".join(f"<Disorder id='{i}'><OrphaCode>{i}</OrphaCode><Name lang='en'>n {i} &amp; co</Name></Disorder>" for i in range(200)) + "<Disorder id='bad'><OrphaCode>x</OrphaCode></Disorder></DisorderList></JDBOR>")
    df = R.xml(spark, f"file://{tmp_path}/x", "Disorder", "_id string, OrphaCode long, Name struct<_VALUE:string,_lang:string>")
    told = R.faults(df).first()
    assert (told["rows"], told["bad"]) == (201, 1)
    assert df.where("OrphaCode = 7").first()["Name"]["_VALUE"] == "n 7 & co"
    (tmp_path / "j").mkdir()
    graph = {"graphs": [{"nodes": [{"id": "http://x.org/obo/A_1", "lbl": "one", "meta": {"synonyms": [{"pred": "p", "val": "uno"}], "deprecated": True}}, {"lbl": "no id"}], "edges": [{"sub": "http://x.org/obo/A_1", "pred": "http://y.org/r#is_a", "obj": "http://x.org/obo/A_2"}]}]}
    (tmp_path / "j" / "a.json").write_text(json.dumps(graph, indent=2))
    nodes, edges = R.ontology_graph(spark, f"file://{tmp_path}/j")
    assert [(r["id"], r["name"], r["synonyms"], r["obsolete"], r["bad"]) for r in nodes.orderBy(F.desc("id")).collect()] == [("A:1", "one", ["uno"], True, False), (None, "no id", [], False, True)]
    assert [tuple(r) for r in edges.collect()] == [("A:1", "is_a", "A:2")]
