"""Quality classifier: naive Bayes support vectors learned from reviewers' decisions.

N-gram indicators of a text are scaled by the log-count ratio of the two classes, counted over
all decided records; a linear hinge-loss model is then fitted by dual coordinate descent on a
bounded sample of them, and its margins are turned into probabilities by a logistic curve fitted
on rows of the sample that the descent did not see.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkgate.llm.common import filter_bits, member_filter, records, slices, with_flag

BUCKETS = 1 << 18
# Bound of the sample that the hinge-loss model is fitted on.
FIT_ROWS = 6000
# Words whose hashes a task keeps; past it the memory starts anew.
KNOWN_WORDS = 200_000

_K = np.uint64(0x9E3779B97F4A7C15)
_RUN = re.compile(r"[^\W\d_]+|\d+|_+|(\W)\1*")


def _run_shape(run: re.Match) -> str:
    s = run.group()
    if s[0].isdigit():
        return "0"
    if s[0].isalpha():
        return "a" if s.islower() else "Aa" if s[1:].islower() or len(s) == 1 else "A"
    return s[0] * min(len(s), 3)


class _Words(dict):
    """word -> place of its hash and of its shape's number."""

    def __init__(self):
        super().__init__()
        self.word, self.shape = array("Q"), array("q")
        self.names, self.shapes = {}, array("Q")

    def __missing__(self, word: str) -> int:
        if word.isalpha():
            shape = "a" if word.islower() else "Aa" if word[1:].islower() or len(word) == 1 else "A"
        else:
            shape = "".join(map(_run_shape, _RUN.finditer(word)))
        # by its hash: the shape of a long word is long too
        shape = xxhash.xxh3_64_intdigest(shape.encode("utf-8", "surrogatepass"), 7)
        name = self.names.get(shape)
        if name is None:
            name = self.names[shape] = len(self.names)
            self.shapes.append(shape)
        self.word.append(xxhash.xxh3_64_intdigest(word.lower().encode("utf-8", "surrogatepass")))
        self.shape.append(name)
        place = self[word] = len(self.word) - 1
        return place

    def trim(self):
        if len(self) > KNOWN_WORDS:
            self.clear()
            self.__init__()


def _mixed(values: list[np.ndarray], kind: int) -> np.ndarray:
    out = np.full(len(values[0]), kind, np.uint64)
    for v in values:
        out = (out ^ v.astype(np.uint64)) * _K
        out ^= out >> np.uint64(29)
    return (out % np.uint64(BUCKETS)).astype(np.int64)


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and how often each occurs."""
    keys = np.sort(keys)
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[first], np.diff(first, append=len(keys))


def features(texts: list[str], words: _Words) -> list[np.ndarray]:
    """Sorted distinct buckets of each text: its word, shape and repetition n-grams.

    Shapes say how a word is written (case, digits, symbols); repetition marks say whether a
    word is that one or two places before. How often a shape or mark occurs counts by the power
    of two of its share, so that one odd word does not look like many.
    """
    words.trim()
    split = [t.split() for t in texts]
    size = np.fromiter(map(len, split), np.int64, len(split))
    total = int(size.sum())
    at = np.fromiter(map(words.__getitem__, chain.from_iterable(split)), np.int64, total)
    doc = np.repeat(np.arange(len(texts)), size)
    # indexing copies: the arrays can grow again
    word = np.frombuffer(words.word, np.uint64)[at] if total else np.zeros(0, np.uint64)
    number = np.frombuffer(words.shape, np.int64)[at] if total else np.zeros(0, np.int64)
    # shapes by their hash: numbers differ from task to task
    shape = np.frombuffer(words.shapes, np.uint64)[number] if total else np.zeros(0, np.uint64)
    again = np.zeros(total, np.int64)
    for back in (1, 2):
        again[back:] += back * ((word[back:] == word[:-back]) & (doc[back:] == doc[:-back]))
    keys = []

    def grams(values: np.ndarray, n: int, kind: int) -> None:
        count = max(0, total - n + 1)
        whole = doc[:count] == doc[n - 1 :]
        bucket = _mixed([values[i : i + count] for i in range(n)], kind * 31 + n)
        keys.append((doc[:count][whole] * BUCKETS) + bucket[whole])

    def levels(values: np.ndarray, names: np.ndarray, kind: int) -> None:
        found, count = _distinct(doc * len(names) + values)
        of = found // len(names)
        level = np.floor(2 * np.log2(count / np.maximum(1, size[of]))).astype(np.int64)
        keys.append(of * BUCKETS + _mixed([names[found % len(names)], level.view(np.uint64)], kind))

    for n in (1, 2):
        grams(word, n, 1)
    for n in (1, 2, 3):
        grams(shape, n, 2)
    for n in (3, 5):
        grams(again, n, 3)
    if total:
        levels(number, np.frombuffer(words.shapes, np.uint64).copy(), 4)
        levels(again, np.arange(4, dtype=np.uint64), 5)
    used, _ = _distinct(doc * (len(words) + 1) + at)
    vary = np.bincount(used // (len(words) + 1), minlength=len(texts))
    lines = [[x for x in t.split("\n") if x.strip()] for t in texts]
    same = np.array([8 * (len(x) - len(set(x))) // len(x) if x else 9 for x in lines])
    every = np.arange(len(texts)) * BUCKETS
    keys.append(every + _mixed([same], 6))
    keys.append(every + _mixed([16 * vary // np.maximum(1, size)], 7))
    keys.append(every + _mixed([np.ceil(np.log2(size + 1))], 8))
    keys.append(every + _mixed([np.array([min(len(x), 16) for x in lines]), np.minimum(size, 32) // 2], 9))
    found, _ = _distinct(np.concatenate(keys))
    ends = np.searchsorted(found, np.arange(1, len(texts)) * BUCKETS)
    return np.split((found % BUCKETS).astype(np.int32), ends) if texts else []


def _parts(texts: list[str]) -> Iterator[list[str]]:
    return slices(texts, len, 500_000)


@dataclass(frozen=True)
class Model:
    """``weights`` of the buckets (ratio times fitted weight), and the logistic curve."""

    weights: np.ndarray
    ratio: np.ndarray
    bias: float
    slope: float
    shift: float

    def scores(self, texts: list[str], words: _Words) -> np.ndarray:
        margins = []
        for part in _parts(texts):
            for x in features(part, words):
                norm = float(np.sqrt(np.sum(self.ratio[x] ** 2))) or 1.0
                margins.append(float(np.sum(self.weights[x])) / norm + self.bias)
        at = self.slope * np.array(margins, float) + self.shift
        return 1 / (1 + np.exp(-np.clip(at, -30, 30)))


def _decided(table: DataFrame, human_decisions: DataFrame) -> DataFrame:
    """(job_id, cleaned_text, label) of decided records; only those that may be move."""
    label = F.when(F.col("decision") == "accept", 1.0).when(F.col("decision") == "reject", 0.0)
    known = (
        human_decisions.select("job_id", label.alias("y"))
        .where("y IS NOT NULL AND job_id IS NOT NULL")
        .groupBy("job_id")
        .agg((F.avg("y") >= 0.5).cast("int").alias("label"))
    )
    bits = filter_bits(human_decisions.count(), 8)
    words = member_filter(known, "job_id", bits)
    maybe = with_flag(table, words, F.col("job_id"), bits, "maybe").where("maybe").drop("maybe")
    # the same plan at every size: what moves then grows with the input
    return maybe.join(known.hint("merge"), "job_id")


def _class_counts(decided: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Records of either class, and in how many of them each bucket occurs."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, sums = _Words(), np.zeros((2, BUCKETS + 1), np.int64)
        for frame in frames:
            labels = iter(frame["label"])
            for part in _parts(list(frame["cleaned_text"])):
                for x in features(part, words):
                    label = next(labels)
                    sums[label, x] += 1
                    sums[label, BUCKETS] += 1
        used = np.flatnonzero(sums.any(0))
        yield pd.DataFrame({"bucket": used, "no": sums[0, used], "yes": sums[1, used]})

    parts = decided.mapInPandas(count, "bucket long, no long, yes long")
    # at most BUCKETS + 1 rows
    total = parts.groupBy("bucket").agg(F.sum("no").alias("no"), F.sum("yes").alias("yes")).toPandas()
    sums = np.zeros((2, BUCKETS + 1), np.int64)
    sums[:, total["bucket"]] = total[["no", "yes"]].to_numpy().T
    return sums[:, BUCKETS], sums[:, :BUCKETS]


def _sample(decided: DataFrame, rows: int, most: int) -> list[tuple[int, np.ndarray]]:
    """About ``most`` decided records by a hash of their id: label and buckets."""
    share = int((1 << 30) * min(1.0, most / max(1, rows)))
    chosen = decided.where(F.pmod(F.xxhash64("job_id", F.lit(5)), F.lit(1 << 30)) < share)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = _Words()
        for frame in frames:
            parts = _parts(list(frame["cleaned_text"]))
            found = [f.tobytes() for part in parts for f in features(part, words)]
            yield pd.DataFrame({"label": frame["label"], "o": frame["o"], "buckets": found})

    got = chosen.select("label", "cleaned_text", F.xxhash64("job_id", F.lit(6)).alias("o")).mapInPandas(
        run, "label int, o long, buckets binary"
    )
    found = sorted(got.collect(), key=lambda r: (r["o"], r["buckets"]))
    return [(r["label"], np.frombuffer(r["buckets"], np.int32)) for r in found]


def hinge_fit(rows: list, values: list, signs: np.ndarray, costs: np.ndarray, epochs: int = 30) -> np.ndarray:
    """Dual coordinate descent for the L2-regularised hinge loss; the last weight is the bias.

    ``rows`` are bucket lists, ``values`` their feature values; each row also has a feature 1.
    """
    weight, bias = np.zeros(BUCKETS), 0.0
    alpha = np.zeros(len(rows))
    square = np.array([float(v @ v) + 1.0 for v in values])
    draw = np.random.default_rng(7)
    for _ in range(epochs):
        moved = 0.0
        for i in draw.permutation(len(rows)):
            x, v = rows[i], values[i]
            slope = signs[i] * (weight[x] @ v + bias) - 1
            new = min(max(alpha[i] - slope / square[i], 0.0), costs[i])
            step = (new - alpha[i]) * signs[i]
            if step:
                weight[x] += step * v
                bias += step
                alpha[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return np.append(weight, bias)


def _logistic(margin: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the curve through held-back margins, with smoothed targets."""
    yes, no = label.sum(), len(label) - label.sum()
    target = np.where(label > 0, (yes + 1) / (yes + 2), 1 / (no + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        w, g = p * (1 - p), p - target
        h = np.array([[w @ margin**2 + 1e-3, w @ margin], [w @ margin, w.sum() + 1e-3]])
        step = np.linalg.solve(h, [g @ margin + 1e-3 * a, g.sum()])
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return float(a), float(b)


def fit(
    enriched_records: DataFrame,
    human_decisions: DataFrame,
    *,
    job_id: str = "job_id",
    cleaned_text: str = "cleaned_text",
    fit_rows: int = FIT_ROWS,
    cost: float = 1.0,
) -> Model:
    """Learn from records with a decision (``accept`` or ``reject``; the majority of a job's).

    Ratios count every decided record; the descent sees about ``fit_rows`` of them at most.
    Without decisions of both kinds the model gives 1 where nothing was rejected, else 0, and
    0.5 where nothing was decided.
    """
    table = records(enriched_records, job_id, cleaned_text)
    decided = _decided(table, human_decisions)
    size, counts = _class_counts(decided)
    if not size.all():
        shift = 0.0 if not size.any() else 30.0 if size[1] else -30.0
        return Model(np.zeros(BUCKETS), np.zeros(BUCKETS), 0.0, 0.0, shift)
    no, yes = 1.0 + counts
    ratio = np.log(yes / yes.sum()) - np.log(no / no.sum())
    sample = _sample(decided, int(size.sum()), fit_rows)
    labels = np.array([y for y, _ in sample])
    rows = [x for _, x in sample]
    values = [ratio[x] / (np.sqrt(np.sum(ratio[x] ** 2)) or 1.0) for x in rows]
    held = np.arange(len(sample)) % 4 == 0
    share = np.bincount(labels, minlength=2) / max(1, len(labels))
    costs = cost * 0.5 / np.maximum(share[labels], 1e-6)

    def margins(model, which):
        return np.array([model[rows[i]] @ values[i] + model[-1] for i in which])

    first = np.flatnonzero(~held)
    part = hinge_fit([rows[i] for i in first], [values[i] for i in first], 2.0 * labels[first] - 1, costs[first])
    slope, shift = _logistic(margins(part, np.flatnonzero(held)), labels[held])
    return Model(part[:-1] * ratio, ratio, float(part[-1]), slope, shift)


def score(model: Model, text: Column) -> Column:
    """Probability that a reviewer would accept the text; null counts as empty."""
    spark_model = {k: getattr(model, k) for k in ("weights", "ratio", "bias", "slope", "shift")}
    known: list[_Words] = []

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        if not known:
            known.append(_Words())
        return pd.Series(Model(**spark_model).scores([t or "" for t in texts], known[0]))

    return run(F.coalesce(text.cast("string"), F.lit("")))


def quality_scores(
    enriched_records: DataFrame, model: Model, *, job_id: str = "job_id", cleaned_text: str = "cleaned_text"
) -> DataFrame:
    """One row per record: job_id, score (0 to 1, higher: acceptance likelier).

    Every whole text is scored, null and empty ones as empty. Repeated rows and job ids each
    get a row; no rows in, no rows out; other columns are ignored.
    """
    table = records(enriched_records, job_id, cleaned_text)
    return table.select("job_id", score(model, F.col("cleaned_text")).alias("score"))
