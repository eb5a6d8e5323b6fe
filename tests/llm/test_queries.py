"""Registered corpus queries next to their SQL, and the pipeline next to a plain run."""

import hashlib
import re
from collections import Counter

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from oracle_compare import differences, duck
from tidepanel.llm import catalog, mixing, ngram_join, quality

ROOT = "/root/testdata/sf0.001"


def test_all_operators_and_the_pipeline_are_registered():
    names = set(entry.queries())
    assert {int(n[2:].split("_")[0]) for n in names if n.startswith("op") and n[2].isdigit()} == set(range(1, 14)) and "pipeline" in names
    assert len(corpus_pipeline.STAGES) == 4


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_matches_sql(spark, name):
    assert differences(catalog.queries()[name](spark, ROOT), duck(ROOT), catalog.oracle_sql()[name]) == []


def test_pipeline_against_a_plain_run(spark):
    docs = spark.read.parquet(f"{ROOT}/documents.parquet")
    labels = spark.read.parquet(f"{ROOT}/labels.parquet")
    model = quality.fit(docs, labels)
    good = {r["doc_id"] for r in quality.classify(docs, model).where("predicted = 1").collect()}
    rows = sorted((r for r in docs.collect() if r["doc_id"] in good), key=lambda r: r["doc_id"])
    sets = [set(ngram_join.shingle_sets([r["text"]])[0].tolist()) for r in rows]
    head = list(range(len(rows)))
    for _ in rows:  # smallest place reachable
        for i, a in enumerate(sets):
            for j, b in enumerate(sets[:i]):
                if head[i] != head[j] and (a or b) and 100 * len(a & b) >= 80 * len(a | b):
                    head = [min(head[i], head[j]) if h in (head[i], head[j]) else h for h in head]
        break
    kept = spark.createDataFrame([rows[i] for i in range(len(rows)) if head[i] == i], docs.schema)
    taken = {r["doc_id"]: r for r in mixing.mix(kept).collect()}
    want = Counter()
    for r in kept.collect():
        left = taken[r["doc_id"]]["taken"]
        while left > 0:
            pieces = re.findall("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+", r["text"])
            text = r["text"] if left >= len(pieces) else "".join(pieces[:left])
            want[(r["doc_id"], hashlib.sha256(text.encode()).hexdigest())] += 1
            left -= min(left, len(pieces))
    got = Counter((r["doc_id"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, ROOT).collect())
    assert got == want


def test_stages_return_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{ROOT}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, ROOT).dtypes == docs.dtypes
        assert stage(spark, docs.limit(0), ROOT).count() == 0
