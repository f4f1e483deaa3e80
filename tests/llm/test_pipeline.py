"""The whole pipeline over the smallest tables with planted cases: each stage's decisions take effect, clean documents stay."""

import random
import zlib

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from graphloom.llm.queries import tokenizer_path

SF = "/root/testdata/sf0.001"
FIRST = 1_000_000


def test_planted_cases_through_all_stages(spark, tmp_path):
    rnd = random.Random(8)
    real, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    good = [r["text"] for r in real.where("lang = 'en'").join(labels.where("quality = 1"), "doc_id").orderBy("doc_id").collect() if r["text"]]
    # Words as often as good documents have them: all different words alike would be longer than any real text's.
    words = [w for t in good for w in t.split()]
    lines = lambda n: [" ".join(rnd.choice(words) for _ in range(9)) + "." for _ in range(n)]
    clean = {FIRST + i: lines(12) for i in range(30)}
    clean[FIRST + 5] = [" ".join(clean[FIRST + 5])]  # of one line, so that line dedup leaves its near copy to the next stage
    shared = lines(1)
    clean[FIRST + 8].append(shared[0])
    texts = {k: "\n".join(v) for k, v in clean.items()}
    whole = dict(texts)
    texts[FIRST + 9] += "\n" + shared[0]  # this line goes, since 8 has it
    item = spark.read.parquet(f"{SF}/benchmark.parquet").where("length(text) > 80").orderBy("item_id").first()["text"]
    bad = {FIRST + 100: texts[FIRST + 3], FIRST + 101: texts[FIRST + 5] + " end", FIRST + 102: "\n".join([*lines(10), item, *lines(3)]), FIRST + 103: "too few words", FIRST + 104: None}
    rows = [(k, t, "en", "planted", len(t or "")) for k, t in {**texts, **bad}.items()]
    real.unionByName(spark.createDataFrame(rows, real.schema)).write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    planted = {}
    for r in found:
        if r["doc_id"] >= FIRST:
            planted.setdefault(r["doc_id"], []).append(r)
    assert sorted(planted) == sorted(clean)
    tokenizer = Tokenizer.from_file(tokenizer_path())
    for k, pieces in planted.items():
        ids = np.array([*tokenizer.encode(whole[k], add_special_tokens=False).ids, 1], "<u4")
        assert [(r["start"], r["length"], r["ids_crc32"]) for r in pieces] == [(0, len(ids), zlib.crc32(ids.tobytes()))], k
    # Sequences are gapless and hold no more than they may.
    at = {}
    for r in sorted(found, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == at.get(r["sequence_id"], 0)
        at[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(at.values()) <= 4096
