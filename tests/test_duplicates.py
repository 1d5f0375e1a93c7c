from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkgate.operators import duplicates, first_wins
from inkgate.operators import token_similarity as ts
from inkgate.operators import vector_similarity as vs
from inkgate.session import cut


def word_cosine(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    return len(x & y) / math.sqrt(len(x) * len(y)) if x and y else 0.0


def one_by_one(docs, threshold):
    """docs(id, sha, text) in arrival order -> id -> (type, score), judged as they come."""
    hashes, kept, verdicts = set(), [], {}
    for doc_id, sha, text in docs:
        if sha in hashes:
            verdicts[doc_id] = ("exact", 1.0)
            continue
        best = max((word_cosine(text, other) for other in kept), default=0.0)
        if best >= threshold:
            verdicts[doc_id] = ("semantic", best)
            continue
        hashes.add(sha)
        kept.append(text)
        verdicts[doc_id] = ("", 0.0)
    return verdicts


def corpus(rng, n, *, hot=0.0):
    words = [f"w{i}" for i in range(60)]
    base = rng.sample(words, 20)
    docs = []
    for i in range(n):
        kind = rng.random()
        if kind < hot:
            text = list(base)
            for _ in range(rng.randrange(3)):
                text[rng.randrange(20)] = rng.choice(words)
        elif docs and kind < hot + 0.3:
            text = docs[rng.randrange(len(docs))][2].split()
            for _ in range(rng.randrange(4)):
                if text:
                    text[rng.randrange(len(text))] = rng.choice(words)
        else:
            text = rng.choices(words, k=rng.randrange(0, 25))
        text = " ".join(text)
        docs.append((i, str(hash(text)), text))
    return docs


def run(spark, docs, **options):
    df = spark.createDataFrame(
        [(i, i, s, t) for i, s, t in docs], "id long, arrival long, sha256 string, text string"
    )
    verdicts = duplicates.duplicate_control(df, df, **options).verdicts
    return {
        r.id: (r.duplicate_control.duplicate_type, r.duplicate_control.similarity_score)
        for r in verdicts.collect()
    }


@pytest.mark.parametrize(
    ("seed", "hot", "front"), [(1, 0.0, 256), (2, 0.4, 256), (3, 0.4, 5), (4, 0.6, 2), (5, 0.0, 1)]
)
def test_same_as_one_by_one(spark, seed, hot, front):
    docs = corpus(random.Random(seed), 150, hot=hot)
    got = run(spark, docs, first_wave=front)
    want = one_by_one(docs, 0.85)
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    for key, (_, score) in want.items():
        assert got[key][1] == pytest.approx(score, abs=1e-12)


def test_chain_keeps_both_ends(spark):
    a = [f"w{i}" for i in range(20)]
    b = a[:-2] + ["x1", "x2"]
    c = b[2:] + ["y1", "y2"]
    docs = [(i, str(i), " ".join(t)) for i, t in enumerate((a, b, c))]
    got = run(spark, docs)
    assert [got[i][0] for i in range(3)] == ["", "semantic", ""]


def test_store_of_earlier_runs(spark):
    docs = corpus(random.Random(9), 120, hot=0.3)
    whole = one_by_one(docs, 0.85)
    first, second = docs[:50], docs[50:]
    schema = "id long, arrival long, sha256 string, text string"
    df1 = spark.createDataFrame([(i, i, s, t) for i, s, t in first], schema)
    df2 = spark.createDataFrame([(i, i, s, t) for i, s, t in second], schema)
    first_run = duplicates.duplicate_control(df1, df1)
    # a later run uses the word order its store was written with
    words = df1.select(ts.distinct_words(F.col("text")).alias("words"))
    order = ts.slot_frequencies(ts.slot_counts(words))
    stored = cut(first_run.documents, "store")
    members = cut(ts.word_members(stored, 0.85, order), "members")
    second_run = duplicates.duplicate_control(
        df2, df2, store=duplicates.Store(stored, members, order)
    )
    v1, v2 = first_run.verdicts, second_run.verdicts
    got = {r.id: r.duplicate_control for r in v1.unionByName(v2).collect()}
    assert {k: v.duplicate_type for k, v in got.items()} == {k: v[0] for k, v in whole.items()}
    for key, (_, score) in whole.items():
        assert got[key].similarity_score == pytest.approx(score, abs=1e-12)


def unit_rows(rng, n, dim, centres):
    points = []
    for i in range(n):
        v = centres[rng.integers(len(centres))] + rng.normal(0, 0.35, dim)
        points.append((i, [float(x) for x in v]))
    return points


def greedy(vectors, threshold):
    kept = []
    for i, v in enumerate(vectors):
        if not any(float(v @ vectors[k]) >= threshold for k in kept):
            kept.append(i)
    return kept


def in_cells(df, cells=None):
    units = vs.unit_vectors(df)
    pivots = vs.choose_pivots(units, cells=cells)
    placed = cut(vs.in_cells(units, pivots), "vectors")
    return placed, vs.measure(placed, pivots)


@pytest.mark.parametrize(
    ("cells", "wave", "block", "small"), [(1, 1000, 4096, 4096), (7, 1000, 16, 0), (7, 4, 16, 64), (40, 50, 3, 0)]
)
def test_vectors_over_cells_blocks_and_waves(spark, monkeypatch, cells, wave, block, small):
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 1, (9, 12))
    rows = unit_rows(rng, 160, 12, centres)
    monkeypatch.setattr(vs, "BLOCK_ROWS", block)
    monkeypatch.setattr(first_wins, "SMALL_WAVE", small)
    df = spark.createDataFrame(rows, "id long, vec array<float>")
    placed, measured = in_cells(df, cells)
    outcome = first_wins.keep_first(placed, vs.vector_matcher(measured, 0.85), first_wave=wave)
    matrix = np.array([r.vec for r in placed.orderBy("id").collect()])
    assert sorted(r.id for r in outcome.kept.collect()) == greedy(matrix, 0.85)
    assert (outcome.pairs is None) == (wave < 160)

    similar = matrix @ matrix.T
    np.fill_diagonal(similar, -2)
    for k in (1, 4):
        found = {(r.id, r["rank"]): (r.neighbour_id, r.cosine) for r in vs.nearest(placed, placed, measured, k=k).collect()}
        assert len(found) == k * len(matrix)
        for i in range(len(matrix)):
            order = np.argsort(-similar[i], kind="stable")
            for rank in range(1, k + 1):
                assert found[i, rank][0] == order[rank - 1]
                assert found[i, rank][1] == pytest.approx(similar[i, order[rank - 1]], abs=1e-12)


def test_waves_hardly_grow_with_the_rows(spark):
    """As many waves for four times the members of every group, also where one holds a third."""
    rng = np.random.default_rng(8)
    centres = rng.normal(0, 1, (40, 16))
    waves = []
    for n in (300, 1200):
        points = [(i, (centres[0 if i % 3 == 0 else i % 40] + rng.normal(0, 0.05, 16)).tolist()) for i in range(n)]
        placed, cells = in_cells(spark.createDataFrame(points, "id long, vec array<float>"))
        outcome = first_wins.keep_first(placed, vs.vector_matcher(cells, 0.85), first_wave=100)
        matrix = np.array([r.vec for r in placed.orderBy("id").collect()])
        assert sorted(r.id for r in outcome.kept.collect()) == greedy(matrix, 0.85)
        waves.append(outcome.waves)
    assert waves[0] == waves[1] == 2


def test_cells_that_lie_apart_never_meet(spark):
    """With groups of copies the pairs of blocks compared grow with the rows, not their square."""
    rng = np.random.default_rng(6)
    centres = np.eye(30, 60) * 5
    meetings = []
    for groups in (10, 30):
        points = [(i, (centres[i % groups] + rng.normal(0, 0.05, 60)).tolist()) for i in range(groups * 10)]
        placed, cells = in_cells(spark.createDataFrame(points, "id long, vec array<float>"), groups)
        meetings.append(len(cells.meeting(math.acos(0.85))))
    assert meetings[0] < 100 and meetings[1] < 4 * meetings[0]


def test_rows_are_sent_a_few_times_however_many_cells(spark, monkeypatch):
    """Vectors without groups, so that all cells meet: the copies of a row depend on the tasks."""
    monkeypatch.setattr(vs, "PART_ROWS", 8)
    rng = np.random.default_rng(3)
    copies = []
    for n, cells in ((200, 5), (800, 40)):
        rows = [(i, rng.normal(0, 1, 8).tolist()) for i in range(n)]
        rows += [(n + i, rows[7][1]) for i in range(n // 4)]
        placed, measured = in_cells(spark.createDataFrame(rows, "id long, vec array<float>"), cells)
        layout = vs._lay_out(placed, placed, measured)
        copies.append(layout.parts + layout.streams)
        assert layout.parts > 1 and layout.streams > 1
        matrix = np.array([r.vec for r in placed.orderBy("id").collect()])
        similar = np.einsum("ik,jk->ij", matrix, matrix)
        found = vs.vector_matcher(measured, 0.6)(placed, placed).collect()
        want = {(a, b) for a, b in zip(*np.nonzero(similar >= 0.6), strict=True) if a < b}
        assert len(found) == len(want) and {(r.a, r.b) for r in found} == want
        np.fill_diagonal(similar, -2)
        near = {(r.id, r["rank"]): r.neighbour_id for r in vs.nearest(placed, placed, measured, k=3).collect()}
        for i in (7, n, n + 1, 11):
            if i == 11:
                want = np.argsort(-similar[i], kind="stable")[:3].tolist()
            else:
                want = [j for j in (7, n, n + 1, n + 2, n + 3) if j != i][:3]
            assert [near[i, rank] for rank in (1, 2, 3)] == want
    assert copies[1] <= copies[0]


def test_equal_neighbours_by_the_lower_id(spark):
    rows = [(i, [1.0, 0.0] if i % 2 else [1.0, 1.0]) for i in range(30)] + [(99, [0.0, 0.0])]
    placed, cells = in_cells(spark.createDataFrame(rows, "id long, vec array<float>"))
    got = vs.nearest(placed, placed, cells, k=3).where("id = 5").orderBy("rank").collect()
    assert [r.neighbour_id for r in got] == [1, 3, 7]
    few, cells = in_cells(spark.createDataFrame(rows[:3], "id long, vec array<float>"))
    assert vs.nearest(few, few, cells, k=9).count() == 6
    none, cells = in_cells(spark.createDataFrame(rows[30:], "id long, vec array<float>"))
    assert vs.nearest(none, none, cells, k=2).count() == 0
    assert vs.vector_matcher(cells, 0.85)(none, none).count() == 0


def test_zero_vectors_have_no_neighbours(spark):
    df = spark.createDataFrame(
        [(0, [0.0, 0.0]), (1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [2.0, 0.0])],
        "id long, vec array<float>",
    )
    placed, cells = in_cells(df)
    verdicts = duplicates.near_duplicates(placed, df.select("id"), vs.vector_matcher(cells, 0.85))
    got = {r.id: (r.kept, round(r.score, 9)) for r in verdicts.collect()}
    assert got == {0: (True, 0.0), 1: (True, 0.0), 2: (True, 0.0), 3: (False, 1.0)}


def vector_one_by_one(docs, threshold):
    """docs(id, sha, vector or None) in arrival order -> id -> (type, score)."""
    hashes, kept, out = set(), [], {}
    for i, sha, v in docs:
        if sha in hashes:
            out[i] = ("exact", 1.0)
            continue
        u = None if v is None or not np.any(v) else np.asarray(v) / np.linalg.norm(v)
        best = max((float(u @ w) for w in kept if w is not None), default=0.0) if u is not None else 0.0
        if best >= threshold:
            out[i] = ("semantic", best)
        else:
            hashes.add(sha)
            kept.append(u)
            out[i] = ("", 0.0)
    return out


@pytest.mark.parametrize("wave", [16_384, 10])
def test_vector_control_equals_one_by_one(spark, wave):
    rng = np.random.default_rng(2)
    centres = rng.normal(0, 1, (12, 8))
    docs = []
    for i in range(120):
        v = None if i % 17 == 0 else np.zeros(8) if i % 23 == 0 else centres[i * i % 12] + rng.normal(0, 0.3, 8)
        sha, v = (docs[i // 2][1], docs[i // 2][2]) if i % 7 == 3 else (f"h{i}", v)
        docs.append((i, sha, v))
    df = spark.createDataFrame([(i, i, s) for i, s, _ in docs], "id long, arrival long, sha256 string")
    rows = [(i, None if v is None else [float(x) for x in v]) for i, _, v in docs if i != 34]
    vectors = spark.createDataFrame(rows, "id long, vec array<double>")
    verdicts = duplicates.duplicate_control(df, vectors=vectors, threshold=0.85, first_wave=wave).verdicts
    got = {r.id: (r.duplicate_control.duplicate_type, r.duplicate_control.similarity_score) for r in verdicts.collect()}
    want = vector_one_by_one([(i, s, None if i == 34 else v) for i, s, v in docs], 0.85)
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert all(got[k][1] == pytest.approx(want[k][1], abs=1e-9) for k in want)


@pytest.mark.parametrize("spread", [0.02, 0.25])
def test_topic_that_comes_late_writes_few_pairs(spark, monkeypatch, spread):
    """Many documents that resemble each other and none of the first wave: no pairs by their square."""
    monkeypatch.setattr(first_wins, "SAMPLE", 40, raising=False)
    monkeypatch.setattr(first_wins, "CROWDED", 4, raising=False)
    monkeypatch.setattr(vs, "PART_ROWS", 64)
    monkeypatch.setattr(vs, "BLOCK_ROWS", 32)
    monkeypatch.setattr(vs, "PAIRS_AT_ONCE", 50, raising=False)
    written = []
    monkeypatch.setattr(
        first_wins, "cut", lambda df, label: written.append((label, out := cut(df, label))) or out
    )
    rng = np.random.default_rng(4)
    topic = np.full(16, 1.0)
    docs = [(i, f"h{i}", rng.normal(0, 1, 16) if i < 80 else topic + rng.normal(0, spread * 4, 16)) for i in range(600)]
    df = spark.createDataFrame([(i, i, s) for i, s, _ in docs], "id long, arrival long, sha256 string")
    vectors = spark.createDataFrame([(i, v.tolist()) for i, _, v in docs], "id long, vec array<double>")
    verdicts = duplicates.duplicate_control(df, vectors=vectors, threshold=0.6, first_wave=60).verdicts
    got = {r.id: (r.duplicate_control.duplicate_type, r.duplicate_control.similarity_score) for r in verdicts.collect()}
    want = vector_one_by_one(docs, 0.6)
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert all(got[k][1] == pytest.approx(want[k][1], abs=1e-9) for k in want)
    assert sum(t.count() for label, t in written if label in ("edges", "peel")) < 10 * len(docs)


@pytest.mark.parametrize("cells", [1, 6])
def test_follower_tells_the_later_ones_of_all_pairs(spark, monkeypatch, cells):
    monkeypatch.setattr(vs, "PART_ROWS", 16)
    monkeypatch.setattr(vs, "BLOCK_ROWS", 8)
    rng = np.random.default_rng(5)
    rows = unit_rows(rng, 150, 6, rng.normal(0, 1, (9, 6)))
    # equal vectors, and an id that repeats
    rows += [(150 + i, np.eye(6)[i % 5].tolist()) for i in range(12)] + [(41, rows[3][1])]
    df = spark.createDataFrame(rows, "id long, vec array<double>")
    placed, measured = in_cells(df, cells)
    odd, even = placed.where("id % 2 = 1"), placed.where("id % 2 = 0")
    for threshold in (0.3, 0.85, 1.0):
        match, follow = vs.vector_matcher(measured, threshold), vs.vector_follower(measured, threshold)
        for left, right in ((placed, placed), (odd, even)):
            want = {r.b for r in match(left, right).select("b").collect()}
            assert {r.id for r in follow(left, right).collect()} == want and want


def test_signatures_never_part_similar_texts(spark):
    """The bits are a lower bound on the words that one text has and the other lacks."""
    docs = corpus(random.Random(3), 40)
    df = spark.createDataFrame([(i, t) for i, _, t in docs], "id long, text string")
    both = df.select(F.col("id").alias("a"), ts.distinct_words(F.col("text")).alias("x")).crossJoin(
        df.select(F.col("id").alias("b"), ts.distinct_words(F.col("text")).alias("y"))
    )
    lacking = ts._lacking(ts.signature(F.col("x")), ts.signature(F.col("y")))
    least, most = both.select(
        F.min(F.size(F.array_except("x", "y")) - lacking).alias("least"), F.max(lacking).alias("most")
    ).first()
    assert least >= 0 and most > 5


def test_exact_duplicates_and_store(spark):
    df = spark.createDataFrame(
        [(1, 1, "a"), (2, 2, "b"), (3, 3, "a"), (4, 4, "c")], "id long, arrival long, sha256 string"
    )
    store = spark.createDataFrame([("c",)], "sha256 string")
    got = {r.id: (r.is_duplicate, r.first_id) for r in duplicates.exact_duplicates(df, store).collect()}
    assert got == {1: (False, 1), 2: (False, 2), 3: (True, 1), 4: (True, None)}


def test_prefix_words_meet_for_every_similar_pair(spark):
    docs = corpus(random.Random(11), 80, hot=0.3)
    df = spark.createDataFrame([(i, t) for i, _, t in docs], "id long, text string")
    features = cut(ts.word_features(df), "features")
    members = cut(ts.word_members(features, 0.85), "members")
    pairs = ts.word_matcher(features, 0.85)(members, members)
    got = {(r.a, r.b) for r in pairs.collect()}
    want = {
        (a[0], b[0])
        for i, a in enumerate(docs)
        for b in docs[i + 1 :]
        if word_cosine(a[2], b[2]) >= 0.85
    }
    assert got == want


def test_word_lists_are_sent_once_to_a_task(spark, monkeypatch):
    """Pairs of one group lie in one task, where the words of each text come once for all of them."""
    sent = []
    frame = type(spark.range(1))
    repartition = frame.repartitionById
    monkeypatch.setattr(frame, "repartitionById", lambda df, *a: sent.append(df.count()) or repartition(df, *a))
    words = [[f"g{g}w{i}" for i in range(40)] for g in range(3)]
    docs = [(i, " ".join([*words[i % 3], f"own{i}"])) for i in range(60)] + [(5, " ".join(words[2][:36]))]
    df = spark.createDataFrame(docs, "id long, text string")
    features = cut(ts.word_features(df), "features")
    members = cut(ts.word_members(features, 0.85), "members")
    pairs = ts.word_matcher(features, 0.85)(members, members).collect()
    want = sorted(
        (a, b, round(word_cosine(x, y), 12)) for a, x in docs for b, y in docs if a < b and word_cosine(x, y) >= 0.85
    )
    assert sorted((r.a, r.b, round(r.cosine, 12)) for r in pairs) == want and len(want) > 500
    assert sent[0] <= 2 * len(docs)


def test_rare_words_lead(spark):
    texts = ["the cat", "the dog", "the emu"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    features = cut(ts.word_features(df), "features")
    members = ts.word_members(features, 0.85).where(F.col("place") == 0)
    assert members.select("bucket").distinct().count() == 3


def grown(rng, n):
    """Texts of 1 to 900 words, some of them changed copies, and some as long as others."""
    texts = []
    for i in range(n):
        if i % 3 == 2:
            words = list(texts[rng.randrange(len(texts))])
            for _ in range(rng.randrange(1 + len(words) // 5)):
                words[rng.randrange(len(words))] = f"w{rng.randrange(3000)}"
            words = words[: rng.choice([len(words), max(1, len(words) * 4 // 5)])]
        else:
            words = [f"w{int(3000 * rng.random() ** 3)}" for _ in range(rng.choice([1, 5, 30, 31, 200, 900]))]
        texts.append(words)
    return [" ".join(w) for w in texts]


def near_pairs(left, right, threshold=0.85):
    found = ((a, b, word_cosine(x, y)) for a, x in left for b, y in right)
    return {(a, b): round(c, 12) for a, b, c in found if c >= threshold}


@pytest.mark.parametrize(("held", "passing", "meetings"), [(10**7, 10**5, 10**6), (2500, 12, 50), (300, 5, 1)])
def test_words_over_sizes_tasks_and_goes(spark, monkeypatch, held, passing, meetings):
    monkeypatch.setattr(ts, "HELD_WORDS", held)
    monkeypatch.setattr(ts, "LEAST_HELD", min(held, ts.LEAST_HELD))
    monkeypatch.setattr(ts, "PASSING_TEXTS", passing)
    monkeypatch.setattr(ts, "MEETINGS", meetings)
    docs = list(enumerate(grown(random.Random(held), 150)))
    df = spark.createDataFrame([*docs, (None, docs[0][1]), (3, docs[3][1])], "id long, text string")
    features = cut(ts.word_features(df), "features")
    sketches = cut(ts.word_sketches(features, 0.85), "sketches")
    found = lambda pairs: {(r.a, r.b): round(r.cosine, 12) for r in pairs.collect()}
    match = ts.word_matcher(features, 0.85)
    alone = match(sketches, sketches)
    assert found(alone) == {k: c for k, c in near_pairs(docs, docs).items() if k[0] < k[1]}
    few, many = sketches.where("id % 5 = 0"), sketches.where("id % 5 <> 0")
    some, others = [d for d in docs if d[0] % 5 == 0], [d for d in docs if d[0] % 5]
    for x, y, left, right in ((few, many, some, others), (many, few, others, some)):
        assert found(match(x, y)) == {k: c for k, c in near_pairs(left, right).items() if k[0] < k[1]}
    # a store names its documents otherwise
    named = features.where("id IS NOT NULL").withColumn("id", F.concat(F.lit("d"), F.col("id").cast("string")))
    either = ts.word_matcher(features, 0.85, left_features=named, any_order=True)
    got = either(few.withColumn("id", F.concat(F.lit("d"), F.col("id").cast("string"))), many)
    assert found(got) == {(f"d{a}", b): c for (a, b), c in near_pairs(some, others).items()}


def test_a_text_is_one_row_that_grows_with_it(spark):
    """A row for each prefix word, with 64 bytes of bits, was many times the text, and moved in every wave."""
    docs = [(i, str(i), " ".join(f"w{i}x{k}" for k in range(4 ** (i % 6)))) for i in range(60)]
    df = spark.createDataFrame([(i, i, s, t) for i, s, t in docs], "id long, arrival long, sha256 string, text string")
    control = duplicates.duplicate_control(df, df)
    rows = control.members.collect()
    assert len(rows) == control.documents.count() == 60
    for r in rows:
        assert 4 * len(r.prefix) <= 1.2 * r.n_words + 4 and len(r.bits) <= max(64, r.n_words / 2)


def test_long_texts_that_differ_are_told_apart_where_they_meet(spark, monkeypatch):
    """512 bits say nothing of texts of a thousand words: each two of them met again over their words."""
    met = []
    cosines = ts._cosines
    monkeypatch.setattr(ts, "_cosines", lambda c, *a, **b: met.append(c.count()) or cosines(c, *a, **b))
    rng = random.Random(8)
    # rare words differ but for one that comes first: all else could be common
    lines = [[f"r{i // 2}", *rng.sample([f"c{k}" for k in range(4000)], 1800)] for i in range(40)]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(lines)], "id long, text string")
    features = cut(ts.word_features(df), "features")
    frequencies = ts.slot_frequencies(ts.slot_counts(features))
    members = cut(ts.word_sketches(features, 0.85, frequencies), "members")
    assert ts.word_matcher(features, 0.85)(members, members).count() == 0
    assert met == [0]
