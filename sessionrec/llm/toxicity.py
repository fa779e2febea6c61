"""Severity of toxicity by cumulative-link ordinal regression on sparse text features."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace
from math import log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionrec.llm.common import Scratch, packed, read_documents, small_batches, texts_of

#: At most so many labelled documents are fitted on: those with the least hash of their doc_id.
SAMPLE = 20_000
#: A feature is kept if its log-odds between toxic and clean documents are so many standard errors from 0.
#: So what counts as evidence follows from the labels' number, and few labels give no feature.
EVIDENCE = 3.0
#: Word starts of these lengths are features beside the words, so forms of a word share weights.
STARTS = (4, 5, 6)
#: Parts of the sample that are each scored by a model of the others, to find the cut-off.
FOLDS = 3

_STRIP = ".,!?;:\"'()[]*#$%&|<>"


def features_of_word(word: str) -> list[str]:
    word = word.strip(_STRIP).lower()
    return [word, *(f"{word[:n]}-" for n in STARTS if len(word) > n)] if len(word) > 2 else []


class Hits(dict):
    """A word's selected features by number; most words have none. Emptied when it gets large."""

    LIMIT = 150_000

    def __init__(self, numbers: dict[str, int]) -> None:
        self.numbers = numbers

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = tuple(self.numbers[f] for f in features_of_word(word) if f in self.numbers)
        return value


@dataclass(frozen=True)
class Ordinal:
    """P(grade > j) = sigmoid(x . weights - thresholds[j]): one weight for a feature, whatever the threshold.

    A document is rejected when the chance of a grade above 0 is more than cut.
    """

    names: tuple[str, ...]
    weights: np.ndarray
    thresholds: np.ndarray
    cut: float = 1.0

    def above(self, score: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(score[:, None] - self.thresholds[None, :], -40, 40)))


class Rows:
    """Documents as (feature numbers, values), flat."""

    def __init__(self, rows: list[tuple[list[int], list[float]]]) -> None:
        self.n = len(rows)
        self.index = np.repeat(np.arange(self.n), [len(r[0]) for r in rows])
        self.feature = np.fromiter((f for r in rows for f in r[0]), dtype=np.int64, count=len(self.index))
        self.value = np.fromiter((v for r in rows for v in r[1]), dtype=np.float64, count=len(self.index))

    def score(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.index, weights=self.value * weights[self.feature], minlength=self.n)


def in_order(steps: np.ndarray) -> np.ndarray:
    """Thresholds by a first one and the logarithms of the steps after it, so they stay in order."""
    return steps[0] + np.concatenate([[0.0], np.cumsum(np.exp(steps[1:]))])


def ordinal_loss(rows: Rows, grades: np.ndarray, d: int, levels: int, penalty: float):
    """The negative log-likelihood of the grades (0 to levels) with a ridge penalty on the d weights,
    and its gradient, as a function of d weights, a first threshold and levels - 1 log steps."""
    here = np.arange(rows.n)

    def loss(at: np.ndarray) -> tuple[float, np.ndarray]:
        thresholds = in_order(at[d:])
        score = rows.score(at[:d])
        tail = 1 / (1 + np.exp(-np.clip(score[:, None] - thresholds[None, :], -35, 35)))  # P(grade > j)
        edge = np.concatenate([np.ones((rows.n, 1)), tail, np.zeros((rows.n, 1))], axis=1)
        slope = edge * (1 - edge)
        likely = np.maximum(edge[here, grades] - edge[here, grades + 1], 1e-12)
        low, high = slope[here, grades] / likely, slope[here, grades + 1] / likely
        by_edge = np.bincount(grades + 1, weights=high, minlength=levels + 2) - np.bincount(grades, weights=low, minlength=levels + 2)
        by_threshold = by_edge[1:-1]
        g = np.empty_like(at)
        g[:d] = np.bincount(rows.feature, weights=rows.value * (low - high)[rows.index], minlength=d) - penalty * at[:d]
        g[d] = by_threshold.sum()
        g[d + 1 :] = np.cumsum(by_threshold[::-1])[::-1][1:] * np.exp(at[d + 1 :])
        return float(0.5 * penalty * at[:d] @ at[:d] - np.log(likely).sum()), -g

    return loss


def fit_ordinal(names: tuple[str, ...], rows: list[tuple[list[int], list[float]]], grades: np.ndarray, levels: int, penalty: float = 0.05, rounds: int = 200) -> Ordinal:
    """Maximum likelihood with a ridge penalty. What is fitted on is bounded by SAMPLE, so this runs on the driver."""
    d = len(names)
    at = np.zeros(d + levels)
    at[d] = 2.0
    at = descended(ordinal_loss(Rows(rows), grades, d, levels, penalty), at, rounds)
    return Ordinal(names, at[:d], in_order(at[d:]))


def cut_off(chance: np.ndarray, toxic: np.ndarray) -> float | None:
    """The cut between held-out chances with the best F1 for toxic ones, in the middle of its gap; None if toxic
    documents are not above it more often than clean ones."""
    order = np.argsort(-chance, kind="stable")
    chance, toxic = chance[order], toxic[order].astype(np.int64)
    ends = np.flatnonzero(np.diff(chance, append=-1.0) < 0)  # after a run of equal chances
    hit = np.cumsum(toxic)[ends]
    f1 = 2 * hit / (ends + 1 + toxic.sum())
    best = int(f1.argmax())
    missed = ends[best] + 1 - hit[best]
    if hit[best] * (len(toxic) - toxic.sum()) <= missed * toxic.sum():
        return None
    after = chance[ends[best] + 1] if ends[best] + 1 < len(chance) else 0.0
    return float((chance[ends[best]] + after) / 2)


def fit_with_cut(names: tuple[str, ...], rows: list[tuple[list[int], list[float]]], grades: np.ndarray, folds: np.ndarray) -> Ordinal | None:
    """The model on all rows, with the cut-off by models that have not seen the rows they score."""
    levels, chance = int(grades.max()), np.zeros(len(rows))
    for fold in np.unique(folds):
        held = folds == fold
        if len(np.unique(grades[~held])) <= levels:
            return None  # too few labels: a grade is missing
        part = fit_ordinal(names, [r for r, h in zip(rows, held) if not h], grades[~held], levels)
        chance[held] = part.above(Rows([r for r, h in zip(rows, held) if h]).score(part.weights))[:, 0]
    cut = cut_off(chance, grades > 0)
    return None if cut is None else replace(fit_ordinal(names, rows, grades, levels), cut=cut)


def descended(loss, at: np.ndarray, rounds: int, memory: int = 10) -> np.ndarray:
    """Limited-memory quasi-Newton steps with halving until the loss falls enough."""
    value, g = loss(at)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        q, alphas = g.copy(), []
        for s, y in reversed(pairs):
            alphas.append((s @ q) / (s @ y))
            q -= alphas[-1] * y
        q *= (pairs[-1][0] @ pairs[-1][1]) / (pairs[-1][1] @ pairs[-1][1]) if pairs else 1 / max(1.0, np.linalg.norm(g))
        for (s, y), alpha in zip(pairs, reversed(alphas)):
            q += (alpha - (y @ q) / (s @ y)) * s
        step = 1.0
        while step > 1e-10:
            after = at - step * q
            new_value, new_g = loss(after)
            if new_value <= value - 1e-4 * step * (g @ q):
                break
            step /= 2
        else:
            return at
        if (after - at) @ (new_g - g) > 1e-12:
            pairs = [*pairs[1 - memory :], (after - at, new_g - g)]
        done = value - new_value < 1e-7 * abs(value)
        at, value, g = after, new_value, new_g
        if done:
            break
    return at


def feature_counts(batches: Iterator) -> Iterator:
    """(feature, toxic, clean): in how many toxic and clean documents it is, summed up over parts of a task."""
    schema = pa.schema([("feature", pa.string()), ("toxic", pa.int64()), ("clean", pa.int64())])
    counts: tuple[Counter, Counter] = (Counter(), Counter())

    def flushed() -> pa.RecordBatch:
        names = list(counts[0].keys() | counts[1].keys())
        columns = [names, [counts[1][f] for f in names], [counts[0][f] for f in names]]
        for c in counts:
            c.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)

    for batch, texts in texts_of(batches):
        for toxic, text in zip(batch.column("toxic").to_pylist(), texts):
            counts[int(toxic > 0)].update({f for word in set((text or "").split()) for f in features_of_word(word)})
        if len(counts[0]) + len(counts[1]) > 500_000:
            yield flushed()
    yield flushed()


def graded(toxic: np.ndarray, amount: np.ndarray) -> np.ndarray:
    """Grades from 0 (not toxic) up. Labels with several grades are taken as they are, without gaps.

    Labels of one bit say nothing on severity; then toxic documents are mild (1) or severe (2) by how
    much of the features that mark toxic documents is in them, at the median: a severity by amount.
    """
    if toxic.max() > 1:
        return np.unique(toxic, return_inverse=True)[1].astype(np.int64)
    grades = np.zeros(len(toxic), dtype=np.int64)
    bad = toxic == 1
    grades[bad] = np.where(amount[bad] > np.median(amount[bad]), 2, 1) if bad.any() else 0
    return grades


def fit_toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Ordinal | None:
    """Fits on at most `sample` labelled documents. None, so nothing is rejected, where labels give no
    evidence: they are all of one kind, no feature passes EVIDENCE, or a held-out cut-off tells nothing.

    Labels without toxic or doc_id are left out; of several labels of a document the greatest counts;
    below 0 counts as 0. Every feature of the sample that passes is kept.
    """
    spark = docs.sparkSession
    small_batches(spark)
    chosen = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.greatest(F.max("toxic").cast("long"), F.lit(0).cast("long")).alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # `sample` rows at most
    texts = Scratch(spark, "toxicity").write(texts, "sample")
    clean, bad = texts.agg(F.count_if(F.col("toxic") == 0), F.count_if(F.col("toxic") > 0)).first()
    if not clean or not bad:
        return None
    by_feature = texts.select("toxic", "text").mapInArrow(feature_counts, "feature string, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"))
    log_odds = F.log((F.col("t") + 0.5) / (bad + 1.0)) - F.log((F.col("c") + 0.5) / (clean + 1.0))
    error = F.sqrt(1 / (F.col("t") + 0.5) + 1 / (F.col("c") + 0.5))
    # Of `sample` documents, those that few toxic ones share don't pass: their number is bounded by the sample's.
    best = by_feature.withColumn("log_odds", log_odds).where(F.abs("log_odds") > EVIDENCE * error).orderBy("feature").select("feature", "log_odds").collect()
    if not best:
        return None
    names = tuple(r[0] for r in best)
    numbers = {f: i for i, f in enumerate(names)}

    def found_in(batches: Iterator) -> Iterator:
        hits = Hits(numbers)
        for batch, sampled in texts_of(batches):
            found = [Counter(f for x in filter(None, map(hits.__getitem__, (t or "").split())) for f in x) for t in sampled]
            columns = [batch.column("doc_id"), batch.column("toxic"), pa.array([list(c) for c in found], pa.list_(pa.int32())), pa.array([list(c.values()) for c in found], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "toxic", "numbers", "times"])

    rows = texts.select("doc_id", "toxic", "text").mapInArrow(found_in, "doc_id long, toxic long, numbers array<int>, times array<int>")
    rows = rows.withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(FOLDS)), F.lit(FOLDS))).orderBy("doc_id", "numbers", "times").collect()  # documents of the sample
    marks = np.array([r[1] > 2.0 for r in best])
    toxic = np.array([r["toxic"] for r in rows], dtype=np.int64)
    amount = np.array([sum(np.log1p(n) for f, n in zip(r["numbers"], r["times"]) if marks[f]) for r in rows])
    data = [(r["numbers"], np.log1p(r["times"]).tolist()) for r in rows]
    return fit_with_cut(names, data, graded(toxic, amount), np.array([r["fold"] for r in rows]))


def scored(rows: DataFrame, model: Ordinal | None, text: str = "text") -> DataFrame:
    """Adds p_mild, p_severe (chances of a grade above 0 and of the highest one), expected_severity and rejected to (key, row with a text)."""
    small_batches(rows.sparkSession)
    schema = T.StructType(list(rows.schema)).add("p_mild", "double").add("p_severe", "double").add("expected_severity", "double").add("rejected", "boolean")

    def run(batches: Iterator) -> Iterator:
        hits = Hits({f: i for i, f in enumerate(model.names)}) if model else None
        weights = model.weights.tolist() if model else []
        for batch in batches:
            score = np.zeros(len(batch))
            if hits is not None:
                for i, value in enumerate(batch.column("row").field(text).to_pylist()):
                    found = Counter(f for x in filter(None, map(hits.__getitem__, (value or "").split())) for f in x)
                    score[i] = sum(weights[f] * log1p(n) for f, n in found.items())
            above = model.above(score) if model else np.zeros((len(batch), 2))
            columns = [*batch.columns, pa.array(above[:, 0]), pa.array(above[:, -1]), pa.array(above.sum(axis=1)), pa.array(above[:, 0] > (model.cut if model else 1.0))]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.mapInArrow(run, schema)


def severity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, p_mild, p_severe, expected_severity (0 to the highest grade), rejected: a row for each document, over its whole text.

    Null and empty texts have no features, so the thresholds alone decide; repeated rows, and rows
    of one doc_id, stay and are each scored by their text; a null doc_id has no label and is scored
    like others; a very long text is one row, scored word by word; other columns are not used;
    without evidence in the labels (see fit_toxicity) all chances are 0 and nothing is rejected;
    an empty table gives no rows.
    """
    rows = docs.select("doc_id", F.struct("text").alias("row"))
    return scored(rows, fit_toxicity(docs, labels)).drop("row")


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not rejected, with all their columns, whatever those are called.

    Rows are judged one by one by their text: repeated rows stay or go together, null texts and ids
    are scored like others, a very long text is scored whole, a chance of exactly the cut-off stays, and
    an empty table, or labels without evidence, change nothing.
    """
    return scored(docs.select(packed(docs).alias("row")), fit_toxicity(docs, labels)).where(~F.col("rejected")).select("row.*")


def read_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return severity(read_documents(spark, sf_dir), read_labels(spark, sf_dir))


QUERIES = {"op3_toxicity": op3_toxicity}
SQL: dict[str, str] = {}
