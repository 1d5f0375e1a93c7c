"""Importance resampling against plain Python."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from inkgate.llm import queries, resampling as rs

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text):
    words = WORD.findall((text or "").translate(LOWER))
    return len(words), [zlib.crc32(" ".join(words[i : i + n]).encode()) % 10000 for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def drawn(docs, targets, percent=5, least=20, seed=42):
    """(id, text) rows, in any order -> sorted (id, n_words, n_features, weight, score, rank)."""
    held = [(i, *features(t)) for i, t in docs]
    s, t = np.zeros(10000), np.zeros(10000)
    for _, _, found in held:
        np.add.at(s, found, 1)
    for text in targets:
        np.add.at(t, features(text)[1], 1)
    gain = [math.floor(1000 * math.log((y + 1) * (s.sum() + 10000) / ((x + 1) * (t.sum() + 10000)))) for x, y in zip(s, t)]
    rows = []
    for i, n, found in held:
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in found)
        rows.append([i, n, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for rank, row in enumerate(able[: percent * len(able) // 100], 1):
        row[5] = rank
    return sorted(map(tuple, rows), key=str)


def test_checksums_of_ngrams(monkeypatch):
    draw = np.random.default_rng(1)
    texts = ["Hello World x", "", "é A1 b" * 60, "x" * 300 + " y " + "z" * 65 + " q", "A b", "\x00\x7f日本語  ½"]
    texts += [" ".join("".join(chr(draw.choice([97, 66, 233, 20013, 48])) for _ in range(draw.integers(1, 9))) for _ in range(30)) for _ in range(20)]
    want = [sorted(features(t)[1]) for t in texts]
    for words, size in ((300_000, 2_000_000), (7, 100), (1, 1), (2, 1)):
        monkeypatch.setattr(rs, "SLICE_WORDS", words)
        monkeypatch.setattr(rs, "SLICE_BYTES", size)
        got = [[] for _ in texts]
        for first, _, data, offsets in rs._slices(pa.array(["cut off", *texts])[1:]):
            for owner, bucket in rs._ngrams(data, offsets):
                for o, b in zip(owner.tolist(), bucket.tolist(), strict=True):
                    got[first + o].append(b)
        assert [sorted(g) for g in got] == want


def test_radix_places_sort_like_python(spark, monkeypatch):
    monkeypatch.setattr(rs, "BLOCK_BITS", 4)
    draw = np.random.default_rng(2)
    ids = [None, None, -(2**63), 2**63 - 1, 2**60 + 1, 2**60 + 3, 0, -1, *draw.integers(-(2**40), 2**40, 300).tolist()]
    scores = draw.integers(-50, 50, len(ids)).tolist()
    rows = spark.createDataFrame([(1000 - r, i, s) for r, (i, s) in enumerate(zip(ids, scores))], "row long, id long, score long")
    got = {r.row: r.pos for r in rs.radix_places(rows.repartition(5)).collect()}
    want = sorted(range(len(ids)), key=lambda r: (-scores[r], ids[r] is None, ids[r] or 0))
    held = lambda order: [(scores[r], ids[r]) for r in order]
    assert sorted(got.values()) == list(range(len(ids)))
    assert held(sorted(range(len(ids)), key=lambda r: got[1000 - r])) == held(want)
    assert rs.radix_places(rows.limit(0)).count() == 0
    assert [r.pos for r in rs.radix_places(rows.limit(1)).collect()] == [0]


def test_resample_matches_brute_force(spark):
    draw = np.random.default_rng(3)
    words = [f"Wört{i}" for i in range(60)]
    texts = [" ".join(words[j] for j in draw.integers(0, 60, draw.integers(0, 60))) for _ in range(150)]
    docs = [(2**60 + 2 * i, t) for i, t in enumerate(texts)]
    # nulls, empty texts, ties by repeated rows, ids beyond the whole numbers of a double, long texts
    docs += [(None, texts[7]), (None, None), (1, None), (2, ""), (3, "., "), docs[9], docs[9], (5, "lang " * 30_000), (2**60 + 1, texts[1])]
    targets = [texts[7], texts[8] + " " + texts[20], None, ""]
    table = spark.createDataFrame([(i, t, 1, "r") for i, t in docs], "job_id long, cleaned_text string, score int, rank string")
    items = spark.createDataFrame([(t, 1) for t in targets], "text string, bucket int")
    got = rs.resample(table.repartition(3), items, draw_percent=40).collect()
    assert sorted((tuple(r) for r in got), key=str) == drawn(docs, targets, 40)


def test_resample_without_rows_targets_or_long_ids(spark):
    table = spark.createDataFrame([("b", "x " * 20), ("a", "x " * 20), (None, "y " * 25)], "job_id string, cleaned_text string")
    none = spark.createDataFrame([], "text string")
    assert rs.resample(table.limit(0), none).count() == 0
    got = {r.job_id: r for r in rs.resample(table, none, draw_percent=100).collect()}
    assert sorted(r.rank for r in got.values()) == [1, 2, 3]
    assert rs.resample(table, none, draw_percent=0).where("rank IS NOT NULL").count() == 0


FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables here")
def test_query_matches_brute_force(spark):
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{FOLDER}/documents.parquet'").fetchall()
    items = [t for (t,) in duckdb.sql(f"SELECT text FROM '{FOLDER}/benchmark.parquet'").fetchall()]
    want = [(r[0], *r[2:]) for r in drawn(docs, items)]
    got = queries.op13_importance_resampling(spark, FOLDER).collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted(want, key=str)
