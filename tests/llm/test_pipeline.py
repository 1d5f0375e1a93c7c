"""The pipeline and its stages against brute force."""

from __future__ import annotations

import re
from collections import defaultdict
from pathlib import Path

import duckdb
import pytest

import corpus_pipeline
from inkgate.llm import queries, stages

FOLDER = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string"


def without_copies(docs):
    groups = defaultdict(list)
    for i, t in docs.items():
        groups[re.sub(r"[ \t-\r]", "", t)].append((-len(t), i))
    kept = {min(g)[1] for g in groups.values()}
    return {i: t for i, t in docs.items() if i in kept}


def without_near_copies(docs, width=5, percent=80):
    sets = {}
    for i, t in docs.items():
        w = t.encode().lower().split()
        n = min(width, len(w))
        sets[i] = {tuple(w[at : at + n]) for at in range(len(w) - n + 1)} if w else set()
    label = {i: i for i in sets}
    for i, a in sets.items():
        for j, b in sets.items():
            if j < i and a and b and 100 * len(a & b) >= percent * len(a | b) and label[i] != label[j]:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = {k: new if x == old else x for k, x in label.items()}
    return {i: t for i, t in docs.items() if label[i] == i}


def without_benchmark(docs, items):
    def words(t):
        return re.findall(rb"[0-9a-z\x80-\xff]+", t.encode().lower())

    windows = defaultdict(set)
    for t in items:
        w = words(t)
        n = min(10, len(w))
        windows[n] |= {tuple(w[at : at + n]) for at in range(len(w) - n + 1)} if w else set()

    def clean(t):
        w = words(t)
        return not any(tuple(w[at : at + n]) in held for n, held in windows.items() for at in range(len(w) - n + 1))

    return {i: t for i, t in docs.items() if clean(t)}


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables here")
def test_pipeline_keeps_and_loses_what_brute_force_does(spark):
    rows = duckdb.sql(f"SELECT doc_id, coalesce(text, '') FROM '{FOLDER}/documents.parquet' ORDER BY 1").fetchall()
    items = duckdb.sql(f"SELECT coalesce(text, '') FROM '{FOLDER}/benchmark.parquet'").fetchall()
    # a trained score has no brute force: the query's own decisions stand for the first stage
    accepted = {r.doc_id for r in queries.op7_quality(spark, FOLDER).where("predicted = 1").collect()}
    single = without_copies({i: t for i, t in rows if i in accepted})
    assert set(without_near_copies(single)) < set(without_near_copies(single, 3, 90))
    want = set(without_benchmark(without_near_copies(single), [t for (t,) in items]))
    got = {r.doc_id for r in corpus_pipeline.run(spark, FOLDER).collect()}
    assert (got - want, want - got) == (set(), set())


def test_one_changed_word_of_fifty_is_a_near_copy(spark):
    words = [f"w{i}" for i in range(50)]
    near = [*words[:25], "other", *words[26:]]
    far = [*near[:10], "more", *near[11:]]
    docs = spark.createDataFrame([(3, " ".join(words)), (1, " ".join(near)), (2, " ".join(far[::-1]))], DOCS)
    assert {r.doc_id for r in stages.keep_one_of_each_group(spark, docs, FOLDER).collect()} == {1, 2}
