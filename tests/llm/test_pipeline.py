"""The pipeline stage by stage on planted rows, and on empty tables."""

import re

from pyspark.sql import functions as F

import corpus_pipeline as CP

SF = "/root/testdata/sf0.001"


def _groups(rows, k=5, percent=80):
    """Least id that links reach, by comparing all pairs."""
    sets = {}
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r.text or ""))
        sets[r.doc_id] = {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: find(d) for d in ids}


def _planted(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    long = docs.where("n_chars > 400").orderBy("doc_id").limit(4)
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy(F.length("text").desc(), "item_id").first().text
    row = lambda i, t: spark.createDataFrame([(i, t, "en", "planted", len(t or ""))], docs.schema)
    more = (row(900001, "a few words before it " + item + " and a few after it").unionByName(row(900002, None)).unionByName(row(900003, ""))
            .unionByName(row(900004, "".join(chr(0x4E00 + i % 900) for i in range(5000)))))
    copies = long.withColumn("doc_id", F.col("doc_id") + 800000)
    near = long.withColumn("doc_id", F.col("doc_id") + 700000).withColumn("text", F.concat("text", F.lit(" tailword")))
    out = docs.unionByName(copies).unionByName(near).unionByName(more)
    return out.withColumn("node", F.lit("clash")).withColumn("label", F.lit(1)).withColumn("gram", F.lit(0))


def test_stages_on_planted_rows(spark, tmp_path):
    docs = _planted(spark)
    docs.write.parquet(str(tmp_path / "0"))
    docs = spark.read.parquet(str(tmp_path / "0"))
    columns = docs.columns
    for i, (name, stage) in enumerate(CP.STAGES, 1):
        before = docs.collect()
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        if name == "packing":
            break
        after = docs.collect()
        assert docs.columns == columns
        old, kept = {r.doc_id for r in before}, {r.doc_id for r in after}
        assert kept <= old and len(after) == len(kept)
        if name == "ngram_jaccard_join":
            assert kept == {d for d, least in _groups(before).items() if d == least}
            assert len(kept) < len(old)
        if name == "benchmark_decontamination":
            assert 900001 in old and 900001 not in kept
        if name != "line_dedup":
            assert all(r in before for r in after)
    pieces = docs.collect()
    held = {}
    for p in sorted(pieces, key=lambda p: (p.doc_id, p.start)):
        assert p.start == held.get(p.doc_id, 0)
        held[p.doc_id] = p.start + p.length
    assert held == {p.doc_id: p.doc_tokens for p in pieces} and set(held) == {r.doc_id for r in before}


def test_pipeline_of_empty_tables(spark, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert CP.run(spark, str(tmp_path)).count() == 0
