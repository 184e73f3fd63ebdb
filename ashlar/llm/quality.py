"""Quality scores: random Fourier features of document statistics, ridge from summed normal equations, isotonic calibration."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, held_out, stage, table
from .line_rules import repeated_words

#: Random features, their kernel width in standard deviations, and the ridge penalty for each training row.
FEATURES, WIDTH, RIDGE = 96, 4.0, 1e-3
#: Bins of raw scores on which calibration is fitted, over LOWEST to HIGHEST.
BINS, LOWEST, HIGHEST = 400, -0.5, 1.5
WHITE = " \t\n\x0b\x0c\r"
_CLOSING = (".", "!", "?", ":", ";", "…", '"', "”", "»", ")")
NAMES = (
    "log_chars", "log_words", "word_length", "upper", "digits", "symbols", "marks", "bars", "stops", "non_ascii", "distinct_words", "top_word",
    "twin_words", "repeated", "repeated_lines", "log_lines", "line_words", "closed_lines", "symbol_tails", "byte_entropy",
)


def statistics(text: str | None) -> list[float]:
    """The figures named in NAMES of one whole text; null counts as empty."""
    text = text or ""
    raw = np.frombuffer(text.encode(), np.uint8)
    counts = np.bincount(raw, minlength=256)
    size = max(1, len(raw))
    words = text.split()
    n = len(words)
    seen: dict[str, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    lines = [line for line in text.split("\n") if line.strip(WHITE)]
    shares = counts[counts > 0] / size
    return [
        np.log1p(len(text)),
        np.log1p(n),
        sum(map(len, words)) / max(1, n) if n else 0.0,
        counts[65:91].sum() / size,
        counts[48:58].sum() / size,
        counts[[35, 42, 36, 37, 38, 60, 62]].sum() / size,
        counts[[33, 63]].sum() / size,
        counts[124] / size,
        counts[[44, 46]].sum() / size,
        counts[128:].sum() / size,
        len(seen) / max(1, n),
        max(seen.values(), default=0) / max(1, n),
        sum(map(str.__eq__, words, words[1:])) / max(1, n),
        repeated_words(words) / max(1, n),
        1 - len(set(lines)) / max(1, len(lines)) if lines else 0.0,
        np.log1p(len(lines)),
        np.log1p(n / max(1, len(lines))),
        sum(line.rstrip(WHITE).endswith(_CLOSING) for line in lines) / max(1, len(lines)),
        sum(not w[-1].isalnum() and not w[-2:-1].isalnum() for w in words) / max(1, n),
        float(-(shares * np.log(shares)).sum()) if len(raw) else 0.0,
    ]


def statistics_table(docs: DataFrame) -> DataFrame:
    """(doc_id, stats) of every row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = [statistics(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(stats, pa.list_(pa.float32()))], names=["doc_id", "stats"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, stats array<float>")


class Fourier:
    """Features whose products approximate a Gaussian kernel on standardised statistics, and a constant."""

    def __init__(self, mean: np.ndarray, deviation: np.ndarray, features: int = FEATURES, width: float = WIDTH, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.mean, self.deviation = mean, np.where(deviation > 1e-6, deviation, 1.0)
        self.turns, self.shifts = rng.normal(0, 1 / width, (len(mean), features)), rng.uniform(0, 2 * np.pi, features)

    def __call__(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.deviation, -8, 8)
        return np.hstack([np.sqrt(2 / len(self.shifts)) * np.cos(x @ self.turns + self.shifts), np.ones((len(x), 1))])


def normal_equations(rows: DataFrame, fourier: Fourier) -> dict[int, np.ndarray]:
    """By part, the matrix of summed products of (features, y), from rows(part, stats, y).

    Each partition sums its own; the sums are added row by row of the matrix, in two levels, so that
    no task receives a matrix for every partition.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for frame in frames:
            for part, own in frame.groupby("part"):
                x = np.hstack([fourier(np.stack(own["stats"]).astype(np.float64)), own[["y"]].to_numpy(np.float64)])
                sums[part] = sums.get(part, 0) + x.T @ x
        task = TaskContext.get().partitionId() % 64
        for part, m in sums.items():
            yield pd.DataFrame({"part": part, "row": np.arange(len(m)), "task": task, "line": list(m)})

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        return frame.iloc[:1].assign(line=[np.sum(np.stack(frame["line"]), axis=0)])

    kind = "part int, row int, task int, line array<double>"
    first = rows.select("part", "stats", "y").mapInPandas(run, kind).groupBy("part", "row", "task").applyInPandas(add, kind)
    whole = first.groupBy("part", "row").applyInPandas(add, kind).collect()  # FEATURES + 2 rows for each part
    out: dict[int, np.ndarray] = {}
    for r in whole:
        out.setdefault(r.part, np.zeros((len(r.line), len(r.line))))[r.row] = r.line
    return out


def ridge(products: np.ndarray, penalty: float = RIDGE) -> np.ndarray:
    """Weights from summed products whose last row and column are those of y."""
    a, b = products[:-1, :-1], products[:-1, -1]
    n = max(1.0, a[-1, -1])
    hold = np.full(len(a), penalty * n)
    hold[-1] = 1e-9 * n
    return np.linalg.solve(a + np.diag(hold), b)


def isotonic(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The closest non-decreasing sequence, by pooling adjacent violators."""
    blocks: list[list[float]] = []
    for v, w in zip(values, weights, strict=True):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v2, w2, n2 = blocks.pop()
            v1, w1, n1 = blocks.pop()
            blocks.append([(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2])
    return np.repeat([b[0] for b in blocks], [int(b[2]) for b in blocks])


class Scorer:
    """Raw ridge scores and their calibration."""

    def __init__(self, fourier: Fourier, weights: dict[int, np.ndarray], knots: np.ndarray, levels: np.ndarray):
        self.fourier, self.weights, self.knots, self.levels = fourier, weights, knots, levels

    def raw(self, stats: np.ndarray, part: int = -1) -> np.ndarray:
        return self.fourier(stats) @ self.weights[part]

    def __call__(self, stats: np.ndarray) -> np.ndarray:
        raw = self.raw(stats)
        # A hundredth of the raw score orders the rows of one step of the calibration.
        return np.clip(0.99 * np.interp(raw, self.knots, self.levels) + 0.01 * np.clip(raw, 0, 1), 0, 1)


def _with_scores(rows: DataFrame, score: callable, keep: str) -> DataFrame:
    names = [f.split()[0] for f in keep.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                yield frame[names].assign(score=score(frame))

    return rows.mapInPandas(run, f"{keep}, score double")


def fit(stats: DataFrame, labels: DataFrame) -> Scorer | None:
    """A scorer from stats(doc_id, stats) and labels(doc_id, quality), held-out rows aside.

    All labelled rows count. A doc_id with several labels has their mean. Calibration uses scores of
    each of two folds by the weights of the other one. None if there is no labelled row.
    """
    marks = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.avg("quality").alias("y"))
    known = stats.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).join(marks, "doc_id")
    rows = stage(known.select(F.when(fold(F.col("doc_id")) == 0, 0).otherwise(1).cast("int").alias("part"), "stats", "y"), "quality-rows")
    moments = rows.select(F.posexplode("stats").alias("i", "v")).groupBy("i").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).collect()  # one row a statistic
    if not moments:
        return None
    moments.sort(key=lambda r: r.i)
    fourier = Fourier(np.array([r.m for r in moments]), np.array([r.s for r in moments]))
    sums = normal_equations(rows, fourier)
    whole = sum(sums.values())
    weights = {-1: ridge(whole), **{part: ridge(whole - own if len(sums) > 1 else whole) for part, own in sums.items()}}
    scorer = Scorer(fourier, weights, np.zeros(1), np.zeros(1))

    def crossed(frame: pd.DataFrame) -> np.ndarray:
        return np.where(frame["part"] == 0, *(scorer.raw(np.stack(frame["stats"]).astype(np.float64), p if p in weights else -1) for p in (0, 1)))

    place = F.floor((F.col("score") - LOWEST) / (HIGHEST - LOWEST) * BINS)
    bins = _with_scores(rows, crossed, "part int, y double").groupBy(F.greatest(F.lit(0), F.least(F.lit(BINS - 1), place)).alias("bin")).agg(F.avg("score").alias("x"), F.avg("y").alias("y"), F.count("*").alias("n")).collect()
    bins.sort(key=lambda r: r.bin)
    levels = isotonic(np.array([r.y for r in bins]), np.array([r.n for r in bins], float))
    return Scorer(fourier, weights, np.array([r.x for r in bins]), levels)


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, score) for every row of docs: the calibrated chance that labels call it good.

    Only statistics of the whole text enter a score. Null and empty texts have a score like any
    other; without labelled rows all scores are 0.5. Repeated rows come back repeated, rows without
    doc_id are scored but not learned from, an empty table gives an empty result, other columns are ignored.
    """
    stats = stage(statistics_table(docs), "quality-stats")
    scorer = fit(stats, labels)
    if scorer is None:
        return stats.select("doc_id", F.lit(0.5).alias("score"))
    return _with_scores(stats, lambda frame: scorer(np.stack(frame["stats"]).astype(np.float64)), f"doc_id {dict(docs.dtypes)['doc_id']}")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learned from labels of the rows that are not held out."""
    scores = score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scores.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).cast("int").alias("predicted"))


QUERIES = {"op2_quality_classifier": op2_quality_classifier}
SQL: dict[str, str] = {}
