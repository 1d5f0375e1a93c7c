from __future__ import annotations

import random
import re
import unicodedata
from collections import Counter
from dataclasses import replace

import pytest

from inkgate import fixed_values as fv
from inkgate.config import EnrichmentRules
from inkgate.operators import cleaning

RULES = EnrichmentRules()


def clean(spark, texts, rules=RULES):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = cleaning.clean_text(df, rules).select("doc_id", "cleaned_text").collect()
    return [text for _, text in sorted(map(tuple, rows))]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        # a running head on three lines goes, one on two lines stays
        ("Boletín\nprimera parte\nBoletín\nsegunda parte\nBoletín", "primera parte\nsegunda parte"),
        ("Tapa\nla nota del día\nTapa", "Tapa\nla nota del día\nTapa"),
        # page marks
        ("El texto sigue\npágina 12\n7\n2/9", "El texto sigue"),
        ("El texto sigue\nPAGINA 4 / 8", "El texto sigue"),
        ("", ""),
        # a line of symbols keeps only those that are allowed
        ("antes\n&=%+~\ndespués", "antes\n%\ndespués"),
        ("arriba\n -----   ---  ----- \nabajo", "arriba\nabajo"),
        ("norte     sur    este oeste", "norte sur este oeste"),
        # scanning noise needs enough short tokens
        ("Una línea cualquiera\n7 k  m . 2  3 3 3 3", "Una línea cualquiera"),
        ("Inc. 4º.-", "Inc. 4º.-"),
        ("# *", " "),
        ("　padded\x85", "padded"),
        ("nin\u0303o", "ni\u00f1o"),
        ("x\n\n\ny", "x\ny"),
    ],
)
def test_cleaning_cases(spark, text, want):
    assert clean(spark, [text]) == [want]


def test_gibberish_can_be_switched_off(spark):
    off = replace(RULES, gibberish_detection_enabled=False)
    assert clean(spark, ["7 k m . 2 3 3 3"], off) == ["7 k m . 2 3 3 3"]


def test_symbols_beside_text_are_removed(spark):
    [got] = clean(spark, ["Cuota 3° • total $12,50 ~=^|resto"])
    assert "3°" in got and "$12,50" in got and not set("•~=^|") & set(got)


def _expected(text: str) -> str:
    """The rules said again in plain Python, for random texts."""
    lines = [line.strip() for line in unicodedata.normalize("NFC", text).split("\n")]
    seen = Counter(lines)
    out = []
    for line in lines:
        words = line.split()
        short = sum(len(w) <= fv.GIBBERISH_MAX_SHORT_TOKEN_LEN for w in words)
        if (
            not line
            or seen[line] >= RULES.repeated_line_min_count
            or re.fullmatch(r"(?i)(p[aá]gina\s+)?\d+(\s*/\s*\d+)?", line)
            or not line.strip("- \t\xa0")
            or (len(words) >= 4 and short / len(words) >= 0.6)
        ):
            continue
        allowed = [c for c in line if c.isalnum() or c in "_ \t\xa0" or c in ".,;:()-\"'ºª/%°$¿¡?!"]
        line = re.sub(" {2,}", " ", "".join(allowed))
        if line:
            out.append(line)
    return "\n".join(out)


def test_random_texts(spark):
    rng = random.Random(3)
    pieces = ["abc", "ñandú", "1", "12", "página 2", "--", "#", "é", "\xa0", "  ", "%", "Z", "\t", "½", "§"]
    texts = [
        "\n".join(" ".join(rng.choices(pieces, k=rng.randrange(6))) for _ in range(rng.randrange(14)))
        for _ in range(400)
    ]
    assert clean(spark, texts) == [_expected(t) for t in texts]


def test_repeat_count_follows_the_rule(spark):
    text = "\n".join(["b", "a"] * 4 + ["c"] * 3 + ["d"] * 5 + ["long line here"])
    for n in (2, 3, 4, 5, 6):
        rules = replace(RULES, repeated_line_min_count=n)
        counts = Counter(text.split("\n"))
        want = "\n".join(line for line in text.split("\n") if counts[line] < n)
        assert clean(spark, [text], rules) == [want]


def test_no_shuffle_in_cleaning(spark, capsys):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    cleaning.clean_text(df).explain()
    assert "Exchange" not in capsys.readouterr().out
