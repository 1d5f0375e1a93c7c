"""The registered training-data queries on the smallest tables."""

from __future__ import annotations

import zlib
from pathlib import Path

import duckdb
import numpy as np
import pytest

from inkgate.llm.queries import ORACLES, QUERIES
from inkgate.llm.tokens import Encoder, tokenizer_path
from oracle import connect, spark_rows, sql_rows

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables here")


def documents():
    rows = duckdb.sql(f"SELECT doc_id, coalesce(text, '') FROM '{FOLDER}/documents.parquet' ORDER BY 1").fetchall()
    return [i for i, _ in rows], [t for _, t in rows]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_its_sql(spark, name):
    columns, got = spark_rows(QUERIES[name](spark, FOLDER))
    want_columns, want = sql_rows(connect(FOLDER), ORACLES[name])
    assert columns == want_columns and got == want


def test_id_files_query(spark):
    ids, texts = documents()
    got = QUERIES["op4_id_files"](spark, FOLDER).orderBy("start").collect()
    whole = [np.append(np.frombuffer(x, "<u4"), 2).astype("<u4") for x in Encoder(tokenizer_path("word_bpe_49k.json"))._ids(texts)]
    starts = np.cumsum([0, *map(len, whole)])[:-1].tolist()
    want = [(i, s, len(w), zlib.crc32(w.tobytes())) for i, s, w in zip(ids, starts, whole, strict=True)]
    assert [tuple(r) for r in got] == want


def test_packing_query(spark):
    ids, texts = documents()
    whole = dict(zip(ids, Encoder(tokenizer_path("byte_bpe_50k.json"))._ids(texts), strict=True))
    seen = {}
    for r in QUERIES["op1_packing"](spark, FOLDER).collect():
        doc = np.append(np.frombuffer(whole[r.doc_id], "<u4"), 1).astype("<u4")
        assert zlib.crc32(doc[r.start : r.start + r.length].tobytes()) == r.ids_crc32 and r.doc_tokens == len(doc)
        seen[r.doc_id] = seen.get(r.doc_id, 0) + r.length
    assert seen == {i: len(x) // 4 + 1 for i, x in whole.items()}


def test_token_count_query(spark):
    ids, texts = documents()
    want = {i: len(x) // 4 for i, x in zip(ids, Encoder(tokenizer_path("byte_bpe_50k.json"))._ids(texts), strict=True)}
    assert {r.doc_id: r.n_tokens for r in QUERIES["op2_token_counts"](spark, FOLDER).collect()} == want


def test_page_text_query(spark):
    import html
    import re

    want = {}
    for page, body in duckdb.sql(f"SELECT page_id, html FROM '{FOLDER}/pages.parquet'").fetchall():
        inner = re.search(r"(?s)<article>(.*)</article>", body)[1]
        blocks = re.split(r"</?(?:p|h1)>", re.sub(r"</?b>|<br>", " ", inner))
        want[page] = "\n".join(t for b in blocks if (t := " ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split())))
    assert {r.page_id: r.text for r in QUERIES["op9_page_text"](spark, FOLDER).collect()} == want


def test_quality_query_on_held_out_labels(spark):
    got = {r.doc_id: r for r in QUERIES["op7_quality"](spark, "/root/testdata/sf0.01").collect()}
    labels = duckdb.sql("SELECT doc_id, quality FROM '/root/testdata/sf0.01/labels.parquet'").fetchall()
    held = [(got[i].predicted, y) for i, y in labels if got[i].held_out]
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    assert np.mean([p == y for p, y in held]) > 0.95


def test_pipeline_keeps_clean_documents_only(spark):
    import corpus_pipeline
    from inkgate.session import cut
    from inkgate.llm import queries

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, cut(stage(spark, docs, FOLDER), name)
        assert docs.columns == columns
        assert docs.select("doc_id").subtract(before.select("doc_id")).count() == 0
    kept = {r.doc_id for r in docs.select("doc_id").collect()}
    packed = {r.doc_id for r in corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).collect()}
    assert packed == kept and packed == {r.doc_id for r in corpus_pipeline.run(spark, FOLDER).collect()}
    quality = {r.doc_id: r.predicted for r in queries.op7_quality(spark, FOLDER).collect()}
    dirty = {r.doc_id for r in queries.op5_decontamination(spark, FOLDER).where("contaminated").collect()}
    assert all(quality[i] == 1 and i not in dirty for i in kept)
    copies = {r.doc_id: r.component_id for r in queries.op6_jaccard_join(spark, FOLDER).collect()}
    clean = {copies[i] for i, p in quality.items() if p == 1 and i not in dirty}
    assert clean >= {copies[i] for i in kept} and len({copies[i] for i in kept}) == len(kept)
