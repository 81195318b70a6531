"""Quality classifier: a sparse ensemble of rules.

1. Statistics of every whole text: shares of character classes, word and line measures.
2. Small trees are boosted on the statistics of labelled rows; every path from a root
   to a node is a rule, a conjunction of comparisons.
3. Lasso logistic regression over the rules drops most of them and weighs the rest.
4. What is left is compiled into one Spark column expression.

The learner sees at most ``SAMPLE_ROWS`` labelled rows (those of the smallest hash
draws), never held-out ones.  Only statistics of the text enter a score.

Cases: null and empty texts have statistics 0 and get a score like any other; rows
whose label is null, neither 0 nor 1, or of another document are not learned from; with no labels at
all, or of one kind only, the score is the smoothed share of label 1; repeated rows
are scored alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellarium.llm.common import bounded_batches, documents, held_out, unit, written

SAMPLE_ROWS = 20_000
TREES, DEPTH, CUTS, LEAST_LEAF = 30, 3, 24, 10
LASSO, STEPS = 0.001, 1000
THRESHOLD = 0.3

STATISTICS = [
    "length", "words", "letters", "upper", "digits", "marks", "symbols", "bangs", "wide", "word_length", "distinct_words",
    "top_word", "long_words", "upper_words", "lines", "distinct_lines", "short_lines", "symbol_words",
]

_CLASS = np.zeros(256, dtype=np.int64)  # 0: else, 1: lower, 2: upper, 3: digit, 4: usual marks, 5: symbols, 6: wide
_CLASS[ord("a") : ord("z") + 1] = 1
_CLASS[ord("A") : ord("Z") + 1] = 2
_CLASS[ord("0") : ord("9") + 1] = 3
_CLASS[list(b".,;:'\"-()?")] = 4
_CLASS[list(b"!#$%&*+/<=>@[\\]^_`{|}~")] = 5
_CLASS[128:] = 6


def text_statistics(text: str | None) -> list[float]:
    """One value for each of STATISTICS."""
    data = (text or "").encode()
    words = data.split()
    if not words:
        return [float(len(data))] + [0.0] * (len(STATISTICS) - 1)
    counts = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256)
    kinds = np.bincount(_CLASS, weights=counts, minlength=7)
    n, w = len(data), len(words)
    letters = kinds[1] + kinds[2] + kinds[6]
    seen: dict[bytes, int] = {}
    for x in words:
        seen[x] = seen.get(x, 0) + 1
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=w)
    lines = [x for x in data.split(b"\n") if x.strip()]
    symbol_words = sum(c for x, c in seen.items() if not x[-1:].isalnum() and x[-1] < 128 and x[-1] not in b".,;:?)'\"")
    upper_words = sum(c for x, c in seen.items() if len(x) > 1 and x.isupper())
    return [
        float(n), float(w), letters / n, kinds[2] / max(1, letters), kinds[3] / n, kinds[4] / n, kinds[5] / n, counts[ord("!")] / n, kinds[6] / n,
        float(lengths.mean()), len(seen) / w, max(seen.values()) / w, float((lengths > 20).mean()), upper_words / w,
        float(len(lines)), len(set(lines)) / len(lines), sum(len(x) < 30 for x in lines) / len(lines), symbol_words / w,
    ]


def with_statistics(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out and the statistics of every row."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = np.array([text_statistics(t.as_py()) for t in batch.column(2)], dtype=np.float64).reshape(batch.num_rows, len(STATISTICS))
            columns = [batch.column(0), batch.column(1)] + [pa.array(table[:, i]) for i in range(len(STATISTICS))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", *STATISTICS])

    rows = docs.select(F.col(doc_id).alias("doc_id"), held_out(F.col(doc_id)).alias("held_out"), F.col(text).alias("_text"))
    schema = rows.drop("_text").schema
    for name in STATISTICS:
        schema = schema.add(name, "double")
    return rows.mapInArrow(run, schema)


Condition = tuple[int, bool, float]  # statistic, above (else at most), cut


@dataclass(frozen=True)
class Ensemble:
    """``weights[i]`` is added to the log odds where all conditions of ``rules[i]`` hold."""

    intercept: float
    rules: tuple[tuple[Condition, ...], ...]
    weights: tuple[float, ...]

    def column(self) -> Column:
        """The score as a Spark column over the statistics."""
        odds = F.lit(float(self.intercept))
        for rule, weight in zip(self.rules, self.weights, strict=True):
            holds = F.lit(True)
            for k, above, cut in rule:
                side = F.col(STATISTICS[k])
                holds = holds & ((side > cut) if above else (side <= cut))
            odds = odds + F.when(holds, F.lit(float(weight))).otherwise(0.0)
        return 1.0 / (1.0 + F.exp(-odds))

    def scores(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.intercept + rule_matrix(x, self.rules) @ np.array(self.weights, dtype=float))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def rule_matrix(x: np.ndarray, rules: tuple[tuple[Condition, ...], ...]) -> np.ndarray:
    out = np.ones((len(x), len(rules)))
    for i, rule in enumerate(rules):
        for k, above, cut in rule:
            out[:, i] *= (x[:, k] > cut) if above else (x[:, k] <= cut)
    return out


def grow_rules(x: np.ndarray, y: np.ndarray) -> tuple[tuple[Condition, ...], ...]:
    """The paths of boosted trees of DEPTH; cuts are quantiles of the statistics."""
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0.02, 0.98, CUTS))) for k in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, k], side="left") for k, c in enumerate(cuts)], axis=1)
    odds = np.full(len(y), np.log(y.mean() / (1 - y.mean())))
    rules: dict[tuple[Condition, ...], None] = {}
    for _ in range(TREES):
        p = _sigmoid(odds)
        gradient, weight = y - p, np.maximum(p * (1 - p), 1e-6)
        step = np.zeros(len(y))
        nodes: list[tuple[np.ndarray, tuple[Condition, ...]]] = [(np.arange(len(y)), ())]
        for depth in range(DEPTH + 1):
            below = []
            for rows, path in nodes:
                if path:
                    rules[tuple(sorted(path))] = None
                step[rows] = gradient[rows].sum() / (weight[rows].sum() + 1.0)
                best = (1e-3, -1, -1)
                if depth < DEPTH and len(rows) >= 2 * LEAST_LEAF:
                    g, h = gradient[rows], weight[rows]
                    total_g, total_h = g.sum(), h.sum()
                    for k, c in enumerate(cuts):
                        b = binned[rows, k]
                        left_g = np.bincount(b, g, minlength=len(c) + 1).cumsum()[:-1]
                        left_h = np.bincount(b, h, minlength=len(c) + 1).cumsum()[:-1]
                        left_n = np.bincount(b, minlength=len(c) + 1).cumsum()[:-1]
                        gain = left_g**2 / (left_h + 1) + (total_g - left_g) ** 2 / (total_h - left_h + 1) - total_g**2 / (total_h + 1)
                        gain[(left_n < LEAST_LEAF) | (len(rows) - left_n < LEAST_LEAF)] = 0
                        at = int(gain.argmax())
                        if gain[at] > best[0]:
                            best = (float(gain[at]), k, at)
                if best[1] >= 0:
                    _, k, at = best
                    low = binned[rows, k] <= at
                    cut = float(cuts[k][at])
                    below += [(rows[low], (*path, (k, False, cut))), (rows[~low], (*path, (k, True, cut)))]
            nodes = below
        odds += 0.3 * step
    return tuple(rules)


def fit(x: np.ndarray, y: np.ndarray) -> Ensemble:
    """Grow rules, then weigh them by lasso logistic regression (accelerated proximal gradient)."""
    share = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(share / (1 - share)))
    if len(y) < 4 * LEAST_LEAF or y.min() == y.max():
        return Ensemble(base, (), ())
    rules = grow_rules(x, y)
    r = rule_matrix(x, rules)
    n = len(y)
    bound = 0.25 * (np.linalg.norm(np.hstack([r, np.ones((n, 1))]), 2) ** 2) / n
    w, b = np.zeros(len(rules)), base
    vw, vb, t = w.copy(), b, 1.0
    for _ in range(STEPS):
        error = _sigmoid(vb + r @ vw) - y
        new = vw - r.T @ error / n / bound
        new = np.sign(new) * np.maximum(np.abs(new) - LASSO / bound, 0)
        new_b = vb - error.mean() / bound
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        vw, vb = new + (t - 1) / t2 * (new - w), new_b + (t - 1) / t2 * (new_b - b)
        w, b, t = new, new_b, t2
    kept = np.flatnonzero(np.abs(w) > 1e-6)
    return Ensemble(float(b), tuple(rules[i] for i in kept), tuple(float(w[i]) for i in kept))


def learn(statistics: DataFrame, labels: DataFrame, label: str = "quality") -> Ensemble:
    """Fit on the labelled rows that are not held out; at most SAMPLE_ROWS of them reach the driver."""
    marked = labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("_y")).filter("_y IN (0, 1)")
    rows = statistics.filter(~F.col("held_out")).join(marked, F.col("doc_id") == F.col("_id"))
    total = marked.count()
    draw = unit(F.col("doc_id"), F.lit("quality"))
    if total > 2 * SAMPLE_ROWS:
        rows = rows.filter(draw < 2 * SAMPLE_ROWS / total)
    # However often a doc_id is repeated, no more rows than these arrive.
    rows = rows.select("_y", "doc_id", *STATISTICS, draw.alias("_draw")).orderBy("_draw", "doc_id", "_y", *STATISTICS).limit(SAMPLE_ROWS)
    table = rows.drop("_draw").toPandas().sort_values("doc_id", kind="stable")
    if table.empty:
        return Ensemble(0.0, (), ())
    return fit(table[STATISTICS].to_numpy(dtype=float), table["_y"].to_numpy(dtype=float))


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted and the statistics of every row."""
    statistics = written(with_statistics(docs), "quality-statistics")
    score = learn(statistics, labels).column()
    return statistics.withColumn("score", score).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op2_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score_documents(documents(spark, sf_dir), labels).select("doc_id", "held_out", "score", "predicted")


QUERIES = {"op2_rule_ensemble": op2_rule_ensemble}
ORACLE_SQL: dict[str, str] = {}
