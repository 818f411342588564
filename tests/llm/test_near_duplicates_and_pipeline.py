"""The near-duplicate query and the pipeline over whole test tables."""

import os
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cairn.llm import jaccard, mixing

SF = "/root/testdata/sf0.01"
SMALL_SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {65 + i: 97 + i for i in range(26)}


def shingles(text):
    words = WORD.findall((text or "").translate(LOWER))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)}


def expected(rows):
    """doc_id -> (n_shingles, component_id) by an inverted index and exact counts of shared shingles."""
    sets = {r["doc_id"]: shingles(r["text"]) for r in rows}
    holders, parent = defaultdict(list), {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in sorted(sets):
        shared = Counter(j for e in sets[i] for j in holders[e])
        for j, n in shared.items():
            if 100 * n >= 75 * (len(sets[i]) + len(sets[j]) - n):
                low, high = sorted((root(i), root(j)))
                parent[high] = low
        for e in sets[i]:
            holders[e].append(i)
    return {i: (len(s), root(i)) for i, s in sets.items()}


def test_near_duplicate_query_equals_brute_force(spark):
    df = jaccard.op4_near_duplicates(spark, SF)
    assert df.dtypes[:3] == [("doc_id", "bigint"), ("n_shingles", "bigint"), ("component_id", "bigint")]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}
    want = expected(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    assert got == want and sum(i != c for i, (_, c) in want.items()) > 10


def test_near_duplicate_stage_keeps_one_of_each(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 300")
    again = docs.where("doc_id % 50 = 0")
    planted = again.withColumn("doc_id", F.col("doc_id") + 1_000_000).unionByName(again)
    kept = corpus_pipeline.keep_one_of_each(spark, docs.unionByName(planted), SF)
    assert kept.columns == docs.columns
    want = expected(docs.collect())
    assert sorted(r["doc_id"] for r in kept.select("doc_id").collect()) == sorted(i for i, (n, c) in want.items() if i == c)


def test_pipeline_runs_its_stages_in_order(spark):
    docs = spark.read.parquet(f"{SMALL_SF}/documents.parquet")
    out = corpus_pipeline.run(spark, SMALL_SF)
    got = [r["doc_id"] for r in out.select("doc_id").collect()]
    ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "n-gram Jaccard join", "benchmark decontamination", "secret scans", "mixing sources"]
    assert out.columns == mixing.mix_sources(docs).columns
    assert len(got) == len(set(got)) and set(got) <= ids and 0 < len(got) < len(ids)
