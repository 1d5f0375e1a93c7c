"""The training-data operators against brute force, and their defined results in odd cases."""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from inkgate.llm import (
    dialogue,
    exact_copies,
    id_files,
    packing,
    page_text,
    phrase_index,
    quality,
    separators,
    shingle_join,
    web_archive,
)
from inkgate.llm.common import components, scratch_path
from inkgate.llm.tokens import Encoder, tokenizer_path
from inkgate.session import cut

BYTE_BPE, WORD_BPE = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("word_bpe_49k.json")
WORDS = [f"w{i}" for i in range(400)]
RECORDS = "job_id long, cleaned_text string, token string, count long, maybe string, text string"
ODD = ["", None, " \n\t", "one", "one two", "Äpfel & Bäume ½ 'tis don't", "x" * 5000, "a b c " * 3000]


def text_of(*numbers):
    return " ".join(WORDS[i % 400] for i in numbers)


def records(spark, texts):
    """Records with further columns whose names operators use inside."""
    rows = [(i, t, "t", 1, "m", "other") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, RECORDS)


@pytest.fixture(scope="module")
def texts():
    draw = np.random.default_rng(3)
    out = list(ODD)
    for _ in range(30):
        base = draw.integers(0, 400, draw.integers(20, 150)).tolist()
        out.append(text_of(*base))
        for _ in range(draw.integers(0, 6)):
            near = list(base)
            for at in draw.integers(0, len(near), draw.integers(0, 3)):
                near[at] = int(draw.integers(0, 400))
            out.append(text_of(*near))
        out.append(text_of(*base).replace(" ", "  ").upper())
    return out


# ---- exact copies ----------------------------------------------------------------------------


def test_exact_copies_match_brute_force(spark, texts):
    table = records(spark, texts + texts[:5])
    groups = defaultdict(list)
    for i, t in enumerate(texts + texts[:5]):
        groups["".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r")].append((-len(t or ""), i))
    want = {i: (min(g)[1], len(g)) for g in groups.values() for _, i in g}
    # a tiny filter raises false alarms only
    for most in (1 << 27, 64):
        got = exact_copies.exact_copies(table, max_filter_bits=most).collect()
        assert {r.job_id: (r.first_job_id, r.group_size) for r in got} == want
        assert all(r.is_duplicate == (r.job_id != r.first_job_id) for r in got)
    kept = exact_copies.without_copies(table)
    assert kept.columns == table.columns
    assert {r.job_id for r in kept.collect()} == {first for first, _ in want.values()}


def test_exact_copies_with_null_and_repeated_ids(spark):
    rows = [(None, "a"), (5, "a "), (5, "a "), (None, "b"), (7, None), (6, "")]
    got = exact_copies.exact_copies(spark.createDataFrame(rows, "job_id long, cleaned_text string")).collect()
    found = sorted(((r.job_id or -1, r.first_job_id, r.group_size, r.is_duplicate) for r in got), key=str)
    assert found == [(-1, 5, 3, True), (-1, None, 1, False), (5, 5, 3, False), (5, 5, 3, False), (6, 6, 2, False), (7, 6, 2, True)]


def test_without_copies_with_null_and_repeated_ids(spark):
    rows = [(None, "A"), (1, "A"), (None, "B"), (None, "B"), (5, "C"), (2, "C"), (5, "D"), (9, "D"), (5, "D "), (7, "E"), (None, None)]
    table = spark.createDataFrame(rows, "job_id long, cleaned_text string")
    for most in (1 << 27, 64):
        copies = exact_copies.exact_copies(table, max_filter_bits=most).where("NOT is_duplicate")
        kept = exact_copies.without_copies(table, max_filter_bits=most)
        found = sorted(map(str, kept.collect()))
        want = [(1, "A"), (None, "B"), (None, "B"), (2, "C"), (5, "D"), (5, "D "), (7, "E"), (None, None)]
        assert found == sorted(map(str, spark.createDataFrame(want, kept.schema).collect())) and copies.count() == len(want)


# ---- n-gram Jaccard join ---------------------------------------------------------------------


def component_of(texts, percent=90):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) > 2 else {tuple(w)} if w else set())
    label = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b) and label[i] != label[j]:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    return [(len(s), x) for s, x in zip(sets, label, strict=True)]


@pytest.mark.parametrize("small", [24, 1])
def test_jaccard_components_match_brute_force(spark, texts, monkeypatch, small):
    monkeypatch.setattr(shingle_join, "SMALL", small)
    monkeypatch.setattr(shingle_join, "BLOCK", 4)
    got = shingle_join.jaccard_components(records(spark, texts)).collect()
    assert sorted((r.job_id, r.n_shingles, r.component_id) for r in got) == [
        (i, n, c) for i, (n, c) in enumerate(component_of(texts))
    ]


def test_jaccard_shared_least_is_safe():
    for n in range(1, 400):
        for m in range(shingle_join.least_overlap(n, 90), n + 1):
            k = shingle_join.least_overlap(n, 90)
            least = k - shingle_join.least_overlap(k, 90) + 1
            assert least <= m - shingle_join.least_overlap(m, 90) + 1


def test_long_sets_right_at_the_threshold_are_near():
    j = 74_569  # 9 j shared of 10 j tokens; 900 j is no float32
    both = np.arange(9 * j)
    for more, want in ((j, True), (j + 1, False)):
        tokens = [np.append(both, np.arange(j // 2) + 10**7), np.append(both, np.arange(more - j // 2) + 10**8)]
        near = shingle_join._near(tokens, np.array([len(t) for t in tokens]), 90)
        assert near.tolist() == [[True, want], [want, True]]


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 90), (7, 7)], "a long, b long")
    got = {r.id: r.component for r in components(links, cut).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 90, 90: 90}


# ---- decontamination -------------------------------------------------------------------------


def test_contamination_matches_brute_force(spark, texts, monkeypatch):
    monkeypatch.setattr(phrase_index, "SEGMENT_WORDS", 300)
    monkeypatch.setattr(phrase_index, "PASS_WORDS", 30)
    docs = [t for t in texts if t is None or len(t) < 3000] + [text_of(*range(50, 90)).upper() + "."]
    items = [text_of(*range(60, 75)), "one TWO", "", None, text_of(5, 6, 7), docs[9], text_of(*range(60, 75))]
    words = [[w.decode() for w in phrase_index.words_of(t or "")] for t in docs]
    tests = [[w.decode() for w in phrase_index.words_of(t or "")] for t in items]
    got = phrase_index.contamination(
        records(spark, docs), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    ).collect()
    assert len(got) == len(docs)
    for r in got:
        w, hit, found = words[r.job_id], set(), set()
        for item, test in enumerate(tests):
            width = min(10, len(test))
            for at in range(len(test) - width + 1 if test else 0):
                for s in range(len(w) - width + 1):
                    if w[s : s + width] == test[at : at + width]:
                        hit.update(range(s, s + width))
                        found.add(item)
        assert (r.n_words, r.n_hit, set(r.item_ids)) == (len(w), len(hit), found)
        assert len(r.item_ids) == len(set(r.item_ids))


def test_proximity_finds_words_near_their_places(spark):
    docs = records(spark, ["a b x c d", "a b x x x c d", "a b c d"])
    items = spark.createDataFrame([(1, "a b c d")], "item_id long, text string")
    for slop, want in ((0, {2}), (1, {0, 2})):
        got = phrase_index.contamination(docs, items, slop=slop)
        assert {r.job_id for r in got.where("n_hit > 0").collect()} == want


# ---- quality ---------------------------------------------------------------------------------


def test_quality_learns_held_out_decisions(spark):
    draw = np.random.default_rng(1)
    texts, labels = [], []
    for i in range(400):
        words = [WORDS[j] for j in draw.integers(0, 400, 60)]
        good = i % 4 > 0
        texts.append(" ".join(words) if good else " ".join(f"{w}$$$" for w in words))
        labels.append("accept" if good else "reject")
    table = records(spark, [*texts, None, ""])
    decided = spark.createDataFrame([(i, x, "n") for i, x in enumerate(labels) if i % 5], "job_id long, decision string, label string")
    model = quality.fit(table, decided, fit_rows=250)
    got = {r.job_id: r.score for r in quality.quality_scores(table, model).collect()}
    assert len(got) == 402 and all(0 <= s <= 1 for s in got.values())
    assert np.mean([(got[i] >= 0.3) == (labels[i] == "accept") for i in range(0, 400, 5)]) > 0.97


def test_shape_of_a_long_word_covers_all_of_it():
    words = quality._Words()
    long = "ab1" * 40
    shapes = [words.shapes[words.shape[words[w]]] for w in (long, long + "$", long + "$$$$", "xy7" * 40 + "$$$")]
    assert len(set(shapes)) == 3 and shapes[2] == shapes[3]
    assert shapes[0] == xxhash.xxh3_64_intdigest(b"a0" * 40, 7)


def test_quality_without_both_decisions(spark):
    table = records(spark, ["a", None])
    none = spark.createDataFrame([], "job_id long, decision string")
    one = spark.createDataFrame([(0, "accept"), (None, "reject"), (1, "escalate")], "job_id long, decision string")
    assert {r.score for r in quality.quality_scores(table, quality.fit(table, none)).collect()} == {0.5}
    assert all(r.score > 0.99 for r in quality.quality_scores(table, quality.fit(table, one)).collect())


# ---- tokens, packing, id files, separators ---------------------------------------------------


@pytest.mark.parametrize("path", [BYTE_BPE, WORD_BPE])
def test_pieces_encode_like_whole_texts(path):
    odd = ["don't stop, it's 'tis", "a  b\n\n c\t\td  ", "½x² 12,3 <|endoftext|>", "éa, é. \x1c\x1f\x85\xa0z", "ΟΔΟΣ. Σ'", ""]
    encode = Encoder(path)
    assert encode.in_pieces and encode(odd) == encode._ids(odd)


def test_words_are_encoded_once_whatever_their_marks_and_capitals():
    encode, asked = Encoder(WORD_BPE), []
    words, rest = encode._ids_of_words, encode._ids
    encode._ids_of_words = lambda some: asked.extend(some) or words(some)
    encode._ids = lambda some: asked.extend(some) or rest(some)
    texts = ["Hend, hend\nHEND (hend) hend&&& été, ÉTÉ", "été. the hend; The Hend!", "", "hend"]
    assert encode(texts) == rest(texts)
    assert sorted(w.strip() for w in asked if w.strip().isalpha()) == ["hend", "the", "été"]


def test_lumps_encode_like_whole_texts():
    draw, encode = np.random.default_rng(5), Encoder(WORD_BPE, 400)
    parts = [*"abstABST'.,-_$&<>012²éÉ×÷µÞİıŁĿǆσΣЖ中 \n\t\r\x0b", "J\u030c", "e\u0301", "\u0307", "\ufb01", "\u3000", "\xa0",
             "\x85", "\x1c", "\x1f", "\x00", "'s", "'LL ", "don't, ", " <|endoftext|> ", "  "]
    for _ in range(200):
        texts = ["".join(draw.choice(parts, draw.integers(0, 30))) for _ in range(3)]
        assert encode(texts) == encode._ids(texts)
    assert encode([]) == [] and encode(["", " \n"]) == [b"", b""]


def test_packing_keeps_every_id_once(spark, texts):
    texts = [*texts, "word " * 5000]
    rows = packing.pack(records(spark, texts), BYTE_BPE, max_length=256).collect()
    whole = [np.append(np.frombuffer(x, "<u4"), 1) for x in Encoder(BYTE_BPE)([t or "" for t in texts])]
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.job_id].append((r.start, bytes(r.ids)))
        by_sequence[r.sequence_id].append((r.offset, r.length))
        assert r.length * 4 == len(r.ids) and r.tokens == len(whole[r.job_id])
    for i, ids in enumerate(whole):
        assert b"".join(x for _, x in sorted(by_doc[i])) == ids.astype("<u4").tobytes()
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 256
    assert sum(r.length for r in rows) / 256 / len(by_sequence) > 0.95


def test_pack_lengths_uses_every_piece():
    draw = np.random.default_rng(2)
    for _ in range(30):
        counts = {int(x): int(draw.integers(1, 50)) for x in draw.integers(1, 65, 20)}
        patterns = packing.pack_lengths(counts, 64)
        used = defaultdict(int)
        for pattern, count in patterns:
            assert sum(pattern) <= 64 and count > 0
            for x in pattern:
                used[x] += count
        assert dict(used) == counts


def test_code_lengths_are_optimal_and_limited():
    import heapq

    counts = np.array([0, 1, 1, 2, 3, 5, 8, 13, 21, 0, 34])
    heap = [(int(c), 0) for c in counts if c]
    cost = 0
    heapq.heapify(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[0], heapq.heappop(heap)[0]
        cost += a + b
        heapq.heappush(heap, (a + b, 0))
    free = id_files.code_lengths(counts, 16)
    assert int(free.astype(int) @ counts) == cost and not free[counts == 0].any()
    tight = id_files.code_lengths(counts, 4)
    assert tight.max() <= 4 and sum(2.0 ** -int(x) for x in tight if x) <= 1


def test_id_files_round_trip(spark, texts):
    path = scratch_path(spark, "test-ids")
    table = records(spark, texts).unionByName(records(spark, ["again", "again"]))
    id_files.write_id_files(table, WORD_BPE, path, end_id=2)
    got = sorted((r.start, r.job_id, bytes(r.ids)) for r in id_files.read_id_files(spark, path).collect())
    rows = sorted(enumerate([*texts, "again", "again"]), key=lambda r: (r[0] if r[0] < len(texts) else r[0] - len(texts)))
    assert [k for _, k, _ in got] == [i if i < len(texts) else i - len(texts) for i, _ in rows]
    want = [np.append(np.frombuffer(x, "<u4"), 2) for x in Encoder(WORD_BPE)([t or "" for _, t in rows])]
    assert [s for s, _, _ in got] == np.cumsum([0, *map(len, want)])[:-1].tolist()
    assert sorted(x for _, _, x in got) == sorted(w.astype("<u4").tobytes() for w in want)


def test_separator_scan_joins_blocks_and_files(spark, tmp_path):
    parts = [[5, 6, 9, 7], [8], [], [3, 9, 9, 4], [2, 2, 9, 1]]
    for i, ids in enumerate(parts):
        (tmp_path / f"part-{i:05d}.txt").write_bytes(np.array(ids, "<u2").tobytes())
    got = separators.token_counts(spark, str(tmp_path), separator=9, width="<u2").collect()
    found = sorted((r.start, r.n_tokens, r.closed) for r in got)
    assert found == [(0, 2, True), (3, 3, True), (7, 0, True), (8, 3, True), (12, 1, False)]
    assert separators.block_ends(np.array([9, 1, 9, 9, 2]), 9, 2).tolist() == [0, 2, 3]


def test_token_files_hold_every_record(spark, texts):
    path = scratch_path(spark, "test-tokens")
    separators.write_token_files(records(spark, texts), BYTE_BPE, path)
    got = separators.token_counts(spark, path).orderBy("start").collect()
    want = [len(x) // 4 for x in Encoder(BYTE_BPE)([t or "" for t in texts])]
    assert sorted(r.n_tokens for r in got) == sorted(want) and all(r.closed for r in got)
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens + 1 for r in got)])[:-1].tolist()


# ---- archives, pages -------------------------------------------------------------------------


def test_archives_round_trip(spark):
    big = ("<p>Zürich\r\n\r\nWARC/1.1\r\n" * 4000).encode()
    bodies = [b"", None, b"x" * 999, b"x" * 999, b"y" * 1000, b"y" * 1000, b"y" * 1000, big, big, b"\xff\x00\n"]
    rows = [(i, f"http://h/{i} ü", b, "kind") for i, b in enumerate(bodies)]
    path = scratch_path(spark, "test-warc")
    web_archive.write_archives(spark.createDataFrame(rows, "job_id long, filename string, content binary, type string"), path)
    got = {int(r.job_id): r for r in web_archive.read_archives(spark, path).collect()}
    assert sorted(got) == list(range(len(bodies)))
    refers = {4: 6, 5: 6, 7: 8}
    import hashlib

    for i, body in enumerate(bodies):
        body, r = body or b"", got[i]
        assert (r.payload_bytes, r.payload_digest) == (len(body), hashlib.sha1(body).hexdigest())
        assert r.record_type == ("revisit" if i in refers else "response")
        assert r.refers_to == (str(refers[i]) if i in refers else None)
        assert (r.content is None) if i in refers else bytes(r.content) == body


def test_missing_segments_fail(spark):
    records = web_archive._page_records(1, "u", b"z" * 50_000, None, 16_384)
    assert len(records) == 4
    for lost in (0, 1, 3):
        path = scratch_path(spark, "test-lost")
        rows = [(bytearray(x),) for i, x in enumerate(records) if i != lost]
        web_archive.write_bytes(spark.createDataFrame(rows, "content binary"), path, b"\n")
        with pytest.raises(Exception, match="segments are missing"):
            web_archive.read_archives(spark, path).collect()


def test_chunked_framing():
    for size in (1, 7, 100):
        assert web_archive.unframe_chunks(web_archive.frame_chunks(b"abc\r\n0\r\n" * 9, size)) == b"abc\r\n0\r\n" * 9
    assert web_archive.unframe_chunks(b"3;x=1\r\nabc\r\n0\r\nT: v\r\n\r\n") == b"abc"


def test_common_lines_is_a_longest_common_subsequence():
    draw = np.random.default_rng(4)
    for _ in range(200):
        a, b = draw.integers(0, 5, draw.integers(0, 14)), draw.integers(0, 5, draw.integers(0, 14))
        best = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                best[i + 1, j + 1] = best[i, j] + 1 if a[i] == b[j] else max(best[i, j + 1], best[i + 1, j])
        used = page_text.common_lines(a, b)
        rest = iter(b.tolist())
        assert used.sum() == best[-1, -1] and all(x in rest for x in a[used].tolist())


def test_page_text_by_markup_and_by_neighbour(spark):
    side = "<nav><ul><li>Menu</li></ul></nav><div class='ad'>Buy<p>now</div>"
    marked = f"<html><head><title>T</title></head><body>{side}<article><h1>H &amp; é</h1><p><b>One\n two<br><p>Three<div class=comments><p>no</div><script>var t='</p>'</script></article><footer>f</footer>"
    plain = "<body><div>Site name</div><div>{}</div><div>{}</div><div>All rights</div></body>"
    rows = [
        (1, "http://a.x/n/1", marked, None),
        (2, "http://b.x/n/1", plain.format("first", "passage"), None),
        (3, "http://b.x/n/2?q=1", plain.format("second", "words"), None),
        (4, "http://c.x/", plain.format("alone", "here"), None),
        (5, None, None, None),
        (6, "http://a.x/n/2", marked, None),
        (7, "http://[bad", "", None),
    ]
    table = spark.createDataFrame(rows, "job_id long, filename string, content string, lines string")
    got = {r.job_id: r.text for r in page_text.main_text(table).collect()}
    assert got[1] == got[6] == "H & é\nOne two\nThree"
    assert (got[2], got[3]) == ("first\npassage", "second\nwords")
    assert got[4] == "Site name\nalone\nhere\nAll rights" and got[5] == got[7] == ""


# ---- dialogues -------------------------------------------------------------------------------


def test_perspectives_tile_each_dialogue(spark):
    rows = [("c", 0, "ann", "hi", 1), ("c", 1, "bob", None, 1), ("c", 700, "ann", "x", 1), ("c", 700, "ann", "x", 1), (None, None, None, "q", 1)]
    turns = spark.createDataFrame(rows, "conv_id string, turn long, role string, text string, n_chars long")
    got = dialogue.perspectives(turns).collect()
    assert len(got) == 9
    views = defaultdict(list)
    for r in got:
        views[r.conv_id, r.perspective].append(r)
    for (_, name), told in views.items():
        told.sort(key=lambda r: r.start)
        whole = "".join(r.piece for r in told)
        at = 0
        for r in told:
            assert r.start == at and r.n_chars == len(r.piece)
            at += r.n_chars
            assert (r.role == "assistant") == (r.name == name) == (r.loss_start is not None)
            if r.loss_start is not None:
                assert whole[r.loss_start : r.loss_end].endswith("<|end|>\n") and "<|assistant|>" not in whole[r.loss_start : r.loss_end]


def test_no_rows_in_no_rows_out(spark):
    empty = spark.createDataFrame([], RECORDS)
    files = spark.createDataFrame([], "job_id long, filename string, content string")
    items = spark.createDataFrame([], "item_id long, text string")
    path = scratch_path(spark, "test-empty")
    id_files.write_id_files(empty, WORD_BPE, f"{path}/ids")
    for frame in (
        exact_copies.exact_copies(empty),
        exact_copies.without_copies(empty),
        shingle_join.jaccard_components(empty),
        phrase_index.contamination(empty, items),
        packing.pack(empty, BYTE_BPE),
        page_text.main_text(files),
        dialogue.perspectives(spark.createDataFrame([], "conv_id long, turn long, role string, text string")),
    ):
        assert frame.count() == 0
    assert phrase_index.contamination(records(spark, ["a"]), items).select(F.sum("n_hit")).first()[0] == 0


def test_ids_wider_than_the_files_are_refused(spark):
    with pytest.raises(ValueError, match="cannot be written"):
        separators.write_token_files(records(spark, ["a"]), BYTE_BPE, scratch_path(spark, "test-narrow"), separator=10, width="u1")


def test_scratch_removes_paths_too(spark):
    from inkgate.session import scratch

    with scratch(spark):
        path = scratch_path(spark, "test-gone")
        spark.range(2).write.parquet(path)
        assert spark.read.parquet(path).count() == 2
    with pytest.raises(Exception):
        spark.read.parquet(path).count()


def test_token_files_without_records(spark):
    path = scratch_path(spark, "test-none")
    separators.write_token_files(records(spark, ["a"]).limit(0), BYTE_BPE, path)
    assert separators.token_counts(spark, path).count() == 0
