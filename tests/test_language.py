"""Language identification against brute force, with all trigrams and many languages."""

from __future__ import annotations

import math
import random
from collections import Counter

from inkgate.operators import language

LABELLED = "doc_id long, lang string, text string"


def grams(text):
    text = (text or "").lower()
    return [text[i : i + 3] for i in range(len(text) - 2)]


def by_brute_force(labelled, texts):
    counts = {}
    for _, lang, text in labelled:
        if lang is not None:
            counts.setdefault(lang, Counter()).update(grams(text))
    counts = {lang: c for lang, c in counts.items() if c}
    known = set().union(*counts.values()) if counts else set()

    def weight(lang, gram):
        return round(math.log((counts[lang][gram] + 1) / (counts[lang].total() + len(known))) * language.WEIGHT_SCALE)

    out = {}
    for i, text in texts:
        found = Counter(g for g in grams(text) if g in known)
        scores = {lang: sum(n * weight(lang, g) for g, n in found.items()) for lang in counts}
        out[i] = min(scores, key=lambda x: (-scores[x], x)) if found else language.UNKNOWN
    return out


def detected(spark, labelled, texts):
    profiles = language.learn_profiles(spark.createDataFrame(labelled, LABELLED))
    rows = language.detect_language(spark.createDataFrame(texts, "doc_id long, text string"), profiles).collect()
    assert len(rows) == len(texts)
    return {r.doc_id: r.language for r in rows}


def test_rare_trigrams_count(spark):
    draw = random.Random(5)
    common = ["".join(draw.choices("abcdefghijklmno", k=3)) for _ in range(1500)]
    labelled = [(0, "aa", " ".join(common * 3) + " zqx"), (1, "bb", " ".join(common[:700] * 4) + " wvy"), (2, None, "uuu")]
    texts = [(0, "zqx"), (1, "WVY"), (2, "uuu"), (3, ""), (4, None), (5, "zqx wvy")]
    got = detected(spark, labelled, texts)
    assert (got[0], got[1], got[2], got[3], got[4]) == ("aa", "bb", "unknown", "unknown", "unknown")
    assert got == by_brute_force(labelled, texts)


def test_seventy_languages_of_unequal_size(spark):
    draw = random.Random(6)
    letters = "abcdefghijklmnopqrstuvwxyzäöüéñß \n"
    labelled = []
    for i in range(70):
        own = draw.sample(letters, 12)
        labelled += [(i, f"l{i:02}", "".join(draw.choices(own, k=draw.choice([4, 60, 2000]))))]
    labelled += [(70, "l70", "twin"), (71, "l69", "twin"), (72, "l7", "no")]
    texts = [(i, "".join(draw.choices(letters, k=draw.randrange(0, 60)))) for i in range(60)]
    texts += [(60 + i, labelled[i][2][:50]) for i in range(70)] + [(200, "twin"), (201, "xx")]
    got = detected(spark, labelled, texts)
    assert got == by_brute_force(labelled, texts)


def test_no_labels(spark):
    assert detected(spark, [], [(1, "some text")]) == {1: "unknown"}
