import re

import corpus_pipeline as cp
from pyspark.sql import functions as F

from veriform.llm import decontaminate, quality_model, simhash
from veriform.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0d]+")


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels, bench = spark.read.parquet(f"{SF}/labels.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    kept = [docs]
    for name, stage in cp.STAGES:
        out = stage(spark, kept[-1], SF)
        if name != cp.STAGES[-1][0]:
            assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        kept.append(spark.createDataFrame(out.collect(), out.schema))
    start, good, single, cut, clean, mixed = kept
    low = {r["id"] for r in quality_model.quality_scores(start, labels).where("score < 0.3").collect()}
    assert {r["doc_id"] for r in good.collect()} == {r["doc_id"] for r in start.collect()} - low and low
    comp = {r["id"]: r["component"] for r in simhash.simhash_components(good).collect()}
    left = [comp[r["doc_id"]] for r in single.collect()]
    assert sorted(left) == sorted(set(comp.values()))
    before = {r["doc_id"]: r["text"] for r in single.collect()}
    for r in cut.collect():
        assert r["n_chars"] == len(r["text"]) if r["text"] != before[r["doc_id"]] else True
        assert set(WORD.findall(r["text"])) <= set(WORD.findall(before[r["doc_id"]])) or r["text"] != before[r["doc_id"]]
    assert decontaminate.contamination(clean, bench).where("n_hit > 0").count() == 0
    hit = {r["id"] for r in decontaminate.contamination(cut, bench).where("n_hit > 0").collect()}
    assert {r["doc_id"] for r in clean.collect()} == {r["doc_id"] for r in cut.collect()} - hit
    assert mixed.where("copies < 1 or copies > 3").count() == 0
    assert {r["doc_id"] for r in mixed.collect()} <= {r["doc_id"] for r in clean.collect()}


def test_run_is_the_stages_in_order(spark):
    assert [n for n, _ in cp.STAGES] == ["quality", "near_duplicates", "substrings", "benchmark", "mixture"]
    out = cp.run(spark, SF)
    assert out.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"] and out.count() > 20


def test_queries_return_every_row(spark):
    n = {t: spark.read.parquet(f"{SF}/{t}.parquet").count() for t in ("documents", "pages", "embeddings")}
    rows = {"op5_url_filter": n["pages"], "op8_html_text": n["pages"], "op11_embedding_whitening": 16 * n["embeddings"]}
    keys = {"op5_url_filter": "page_id", "op8_html_text": "page_id", "op11_embedding_whitening": "vec_id", "op12_collocations": "lang"}
    for name, q in QUERIES.items():
        out = q(spark, SF)
        if name not in ("op1_substring_dedup", "op12_collocations"):  # these return passages and phrases
            assert out.count() == rows.get(name, n["documents"]), name
        assert out.columns[0] == keys.get(name, "doc_id")
        if name == "op10_simhash":
            assert out.where(~F.col("fingerprint").rlike("^[0-9a-f]{16}$")).count() == 0
