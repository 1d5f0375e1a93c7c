"""Ids beyond the whole numbers of a double, next to a null: they stay what they are."""

from __future__ import annotations

import zlib

import numpy as np
import pytest

from inkgate.llm import exact_copies, id_files, packing, page_text, phrase_index, shingle_join, web_archive
from inkgate.llm.common import scratch_path
from inkgate.llm.tokens import Encoder, tokenizer_path

IDS = [2**60 + 1, 2**60 + 3, None]
TEXTS = ["one two three", "four five six seven", "eight nine"]
BYTE_BPE, WORD_BPE = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("word_bpe_49k.json")


@pytest.fixture
def table(spark):
    return spark.createDataFrame(list(zip(IDS, TEXTS)), "job_id long, cleaned_text string").coalesce(1)


def ids_of(frame):
    return sorted((r.job_id for r in frame.collect()), key=str)


def test_ids_stay_exact(spark, table):
    want = sorted(IDS, key=str)
    items = spark.createDataFrame([(2**60 + 5, "four five"), (None, "eight nine")], "item_id long, text string")
    assert ids_of(packing.pack(table, BYTE_BPE)) == want
    assert ids_of(exact_copies.exact_copies(table)) == want
    found = phrase_index.contamination(table, items)
    assert ids_of(found) == want
    assert {r.job_id: r.item_ids for r in found.collect()} == {IDS[0]: [], IDS[1]: [2**60 + 5], None: [None]}
    assert ids_of(shingle_join.jaccard_components(table)) == want
    pages = table.withColumnsRenamed({"cleaned_text": "content"}).selectExpr("*", "'http://h/' AS filename")
    assert ids_of(page_text.main_text(pages)) == want


def test_id_files_keep_ids(spark, table):
    path = scratch_path(spark, "test-large")
    id_files.write_id_files(table, WORD_BPE, path)
    assert ids_of(id_files.read_id_files(spark, path)) == sorted(IDS, key=str)


def test_revisits_name_the_right_response(spark):
    body = b"x" * 2000
    rows = [(2**60 + 1, "u", body), (2**60 + 3, "v", body), (7, "w", b"y" * 2000)]
    path = scratch_path(spark, "test-revisit")
    web_archive.write_archives(spark.createDataFrame(rows, "job_id long, filename string, content binary").coalesce(1), path)
    got = {int(r.job_id): (r.record_type, r.refers_to) for r in web_archive.read_archives(spark, path).collect()}
    assert got == {2**60 + 1: ("revisit", str(2**60 + 3)), 2**60 + 3: ("response", None), 7: ("response", None)}


@pytest.mark.parametrize("path", [BYTE_BPE, WORD_BPE])
def test_random_texts_encode_like_whole_ones(path):
    """Capital dotted I before marks among them: its small form ends in a mark of its own."""
    draw = np.random.default_rng(zlib.crc32(path.encode()))
    signs = list("İIıiaÅéÉſßΣς.,'-! \n\t0٣½'sḂǅ̇́_<|") + ["İ-", "İ'", "don't", "  ", "ﬁ"]
    texts = ["İ-", "İ,", "İ'", "İ.", "xİ-İ. İ"] + ["".join(draw.choice(signs, draw.integers(1, 12))) for _ in range(20_000)]
    encode = Encoder(path)
    assert encode.in_pieces and encode(texts) == encode._ids(texts)
