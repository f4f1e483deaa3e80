"""Redaction: values by kind, things to leave alone, check digits, offsets by brute force."""

import random

import pytest
from pyspark.sql import functions as F

import pyarrow as pa

from graphloom.operators import redaction as R

GONE = [
    ("Mail jane.doe+x@mail.example.org now", "EMAIL_ADDRESS", "jane.doe+x@mail.example.org"),
    ("call +43 660 123 45 67 today", "PHONE_NUMBER", "+43 660 123 45 67"),
    ("call (212) 555-0123.", "PHONE_NUMBER", "(212) 555-0123"),
    ("Tel.: 01 / 234 56 78", "PHONE_NUMBER", "01 / 234 56 78"),
    ("ssn 123-45-6789", "US_SSN", "123-45-6789"),
    ("IBAN AT61 1904 3002 3457 3201", "IBAN_CODE", "AT61 1904 3002 3457 3201"),
    ("card 4111 1111 1111 1111,", "CREDIT_CARD", "4111 1111 1111 1111"),
    ("from 192.168.1.20 port", "IP_ADDRESS", "192.168.1.20"),
    ("from 2001:db8::ff00:42:8329", "IP_ADDRESS", "2001:db8::ff00:42:8329"),
    ("DOB: 03/04/1999", "DATE_OF_BIRTH", "03/04/1999"),
    ("geboren am 3. März 2001", "DATE_OF_BIRTH", "3. März 2001"),
    ("Patient: Anna-Maria Huber", "PERSON", "Anna-Maria Huber"),
    ("Dear Mrs. Smith", "PERSON", "Smith"),
    ("MRN: 00123-A", "PATIENT_ID", "00123-A"),
    ("SV 1237 010180", "PATIENT_ID", "1237 010180"),
    ("passport no 12345678", "PATIENT_ID", "12345678"),
    ("lives at 12 Old Mill Road, Unit 4", "STREET_ADDRESS", "12 Old Mill Road, Unit 4"),
    ("wohnt Hauptstraße 12/3", "STREET_ADDRESS", "Hauptstraße 12/3"),
    ("Via Roma 14", "STREET_ADDRESS", "Via Roma 14"),
    ("12 rue de la Paix", "STREET_ADDRESS", "12 rue de la Paix"),
    ("Springfield, IL 62704", "STREET_ADDRESS", "Springfield, IL 62704"),
    ("P.O. Box 77", "STREET_ADDRESS", "P.O. Box 77"),
]
STAYS = ["card 4111 1111 1111 1112", "IBAN AT61 1904 3002 3457 3202", "ssn 666-45-6789", "from 192.168.1.299 port", "SV 1238 010180", "NM_001130987.2:c.1234+5G>A", "p.Arg1234Ter in HP:0001250", "seen at 14 months on 2020-01-02", "12345678 cells", "acts via Notch", "West syndrome", "rs123456789", "", " ", "12:30:45"]


@pytest.mark.parametrize("text,kind,value", GONE)
def test_values_go(text, kind, value):
    clean, spans = R.redacted(text)
    assert [(k, text[a:b]) for k, a, b, *_ in spans] == [(kind, value)]
    assert clean == text.replace(value, R.PLACEHOLDERS[kind])


@pytest.mark.parametrize("text", STAYS)
def test_other_numbers_stay(text):
    assert R.redacted(text) == (text, [])


def test_overlaps_become_one():
    assert R.resolved([(5, 9, 0.5, "B"), (0, 6, 0.9, "A"), (12, 15, 0.4, "C"), (12, 14, 0.9, "D")]) == [(0, 9, 0.9, "A"), (12, 15, 0.9, "C")]
    assert R.resolved([(0, 6, 0.4, "A"), (5, 9, 0.5, "B")]) == [(0, 9, 0.5, "B")]


def test_offsets_map_back(spark):
    """Every position of redacted texts against a map built sign by sign."""
    rnd = random.Random(3)
    texts = ["\n".join(rnd.choice([g[0] for g in GONE] + STAYS + ["é語 word"]) for _ in range(9)) for _ in range(25)] + [None, "", "x" * 200_000 + " a@b.cd"]
    docs = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)] + [(None, "a@b.cd", "k")], "doc_id long, text string, spans string").repartition(3)
    rows = R.redact(docs, "doc_id", "text")
    assert rows.where("doc_id is null").first()["text"] == "<EMAIL>"
    pos = rows.where("doc_id < 25").select("doc_id", "text", "spans", F.explode(F.sequence(F.lit(0), F.length("text"))).alias("p"))
    got = pos.select("doc_id", "p", R.to_original(F.col("spans"), F.col("p"), False).alias("a"), R.to_original(F.col("spans"), F.col("p"), True).alias("b"))
    want, whole = {}, {r["doc_id"]: r for r in rows.collect()}
    for i in range(25):
        edge, at, built = [], 0, ""
        for s in whole[i]["spans"]:
            edge += [(p, p) for p in range(at, s["start"])] + [(s["start"], s["start"])] + [(s["start"], s["end"])] * (s["redacted_end"] - s["redacted_start"] - 1)
            built += texts[i][at : s["start"]] + R.PLACEHOLDERS[s["kind"]]
            at = s["end"]
        edge += [(p, p) for p in range(at, len(texts[i]) + 1)]
        assert built + texts[i][at:] == whole[i]["text"]
        want |= {(i, p): e for p, e in enumerate(edge)}
    assert {(r["doc_id"], r["p"]): (r["a"], r["b"]) for r in got.collect()} == want
    assert whole[25]["text"] is None and whole[26]["text"] == "" and whole[27]["text"].endswith(" <EMAIL>")


def test_workers_hold_little_at_once(spark):
    texts = ["Mail a.b@example.org now. " * 2000, None, "", *(f"Tel: +49 30 12345{i:03d} " * 1000 for i in range(90)), "x" * (3 << 20)]
    batch = pa.RecordBatch.from_pydict({"text": texts})
    parts = list(R._sliced([batch, batch.slice(0, 0)]))
    assert [t for p in parts for t in p["text"].to_pylist()] == texts
    assert all(p.num_rows <= 1 or sum(len(t or "") for t in p["text"].to_pylist()) <= R.SLICE_BYTES for p in parts) and len(parts) > 3
    docs = spark.createDataFrame(list(enumerate(texts[:8])), "id long, text string")
    want = {}
    for r in R.redact(docs, "id", "text").collect():
        for x in r["spans"]:
            n, size = want.get(x["kind"], (0, 0))
            want[x["kind"]] = (n + 1, size + x["end"] - x["start"])
    assert want and {r["kind"]: (r["n"], r["code_points"]) for r in R.counted(docs, "text").collect()} == want
