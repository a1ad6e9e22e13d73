"""Quality classifier: histogram gradient-boosted trees over document statistics.

Executors compute the statistics of whole texts. The trees are fitted on a
bounded sample of labelled rows and flattened into arrays, one row a tree, which
numpy walks for a whole batch at once.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinweave.llm.words import unused

STATISTICS = (
    "bytes", "words", "word_bytes", "lines", "line_bytes", "distinct_words", "top_word", "same_as_before", "repeat_pairs",
    "repeat_lines", "upper", "digits", "marks", "exclaim", "stops", "bar_words", "high_bytes", "capital_words",
)


def _table(chars: bytes) -> np.ndarray:
    t = np.zeros(256)
    t[list(chars)] = 1
    return t


_CLASSES = np.stack(
    [
        _table(bytes(range(65, 91))),
        _table(b"0123456789"),
        _table(b"#*$%&|<>{}[]\\^~=+@_"),
        _table(b"!?"),
        _table(b".,;:"),
        _table(bytes(range(128, 256))),
        _table(bytes(range(97, 123))),
    ],
    axis=1,
)


def statistics(text: bytes | None) -> list[float]:
    """Statistics of one text, in the order of ``STATISTICS``; all 0 without words."""
    text = text or b""
    words = text.split()
    if not words:
        return [0.0] * len(STATISTICS)
    n, size = len(words), len(text)
    upper, digits, marks, exclaim, stops, high, lower = np.bincount(np.frombuffer(text, np.uint8), minlength=256) @ _CLASSES
    counts = Counter(words)
    pairs = Counter(zip(words, words[1:], strict=False))
    lines = [x for x in text.split(b"\n") if x.strip()]
    letters = max(1.0, upper + lower)
    return [
        np.log1p(size),
        np.log1p(n),
        (size - n) / n,
        np.log1p(len(lines)),
        np.log1p(size / len(lines)),
        len(counts) / n,
        max(counts.values()) / n,
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / n,
        sum(c for c in pairs.values() if c > 1) / n,
        1 - len(set(lines)) / len(lines),
        upper / letters,
        digits / size,
        marks / size,
        exclaim / n,
        stops / n,
        sum(c for w, c in counts.items() if w == b"|") / n,
        high / size,
        sum(c for w, c in counts.items() if 65 <= w[0] <= 90) / n,
    ]


@dataclass(frozen=True)
class Trees:
    """Complete trees of one depth as arrays: feature and threshold of inner nodes, value of leaves; ``base`` is the log-odds to start from."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of ``x``."""
        trees, inner = self.feature.shape
        at = np.zeros((len(x), trees), np.int64)
        tree = np.arange(trees)
        row = np.arange(len(x))[:, None]
        for _ in range(int(np.log2(inner + 1))):
            at = 2 * at + 1 + (x[row, self.feature[tree, at]] > self.threshold[tree, at])
        return 1 / (1 + np.exp(-(self.base + self.leaf[tree, at - inner].sum(1))))


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, ridge: float = 1.0) -> Trees:
    """Second-order boosting of the logistic loss on feature histograms; level-wise complete trees.

    With one class only, or no rows, there are no splits and the score is constant.
    """
    n, width = x.shape if len(x) else (0, len(STATISTICS))
    share = (y.sum() + 0.5) / (n + 1)
    inner = 2**depth - 1
    feature, threshold, leaf = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    base = float(np.log(share / (1 - share)))
    if n == 0 or y.min() == y.max():
        return Trees(base, feature, threshold, leaf)
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
    binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], 1)
    margin = np.full(n, base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            k = 2**level
            gain, best_f, best_b = np.full(k, 1e-9), np.zeros(k, np.int64), np.full(k, -1)
            for f in range(width):
                cell = node * bins + binned[:, f]
                g = np.bincount(cell, grad, k * bins).reshape(k, bins)
                h = np.bincount(cell, hess, k * bins).reshape(k, bins)
                gl, hl = g.cumsum(1), h.cumsum(1)
                gt, ht = gl[:, -1:], hl[:, -1:]
                ok = (hl > 1e-3) & (ht - hl > 1e-3)
                gains = np.where(ok, gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge), 0)
                top = gains.argmax(1)
                better = gains[np.arange(k), top] > gain
                gain, best_f, best_b = np.where(better, gains[np.arange(k), top], gain), np.where(better, f, best_f), np.where(better, top, best_b)
            first = k - 1
            for j in np.flatnonzero(best_b >= 0):
                feature[t, first + j] = best_f[j]
                e = edges[best_f[j]]
                threshold[t, first + j] = e[best_b[j]] if best_b[j] < len(e) else np.inf
            node = 2 * node + (x[np.arange(n), feature[t, first + node]] > threshold[t, first + node])
        g, h = np.bincount(node, grad, inner + 1), np.bincount(node, hess, inner + 1)
        leaf[t] = -rate * g / (h + ridge)
        margin += leaf[t][node]
    return Trees(base, feature, threshold, leaf)


def held_out(id_col: str | Column) -> Column:
    """crc32 of the id as text, mod 5, is 0. A null id is held out."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.pmod(F.crc32(c.cast("string")), F.lit(5)) == 0, F.lit(True))


def _batch_statistics(texts: pa.Array) -> np.ndarray:
    rows = [statistics(t.as_py()) for t in texts.cast(pa.binary())]
    return np.array(rows).reshape(len(rows), len(STATISTICS))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = 20_000) -> Trees:
    """Trees from labelled documents that aren't held out.

    At most about ``sample_rows`` labelled ids are used, picked by a hash of the
    id; their statistics are what reaches the driver, one row an id: of documents
    that repeat an id, the one whose text has the least hash counts. An id with
    several labels counts with the least. Null ids and labels are left out. Null
    and empty texts count as texts without words. Without labelled rows the score
    is one half.
    """
    known = labels.filter(F.col(label_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).cast("double").alias("y"))
    share = min(1.0, sample_rows / max(1, known.count()))
    picked = known.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 60)) < int(share * (1 << 60)))

    @F.arrow_udf("array<double>")
    def stats(texts: pa.Array) -> pa.Array:
        return pa.array(list(_batch_statistics(texts)), pa.list_(pa.float64()))

    # the sample is bounded by sample_rows, so it may go to every executor
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(picked), "id")
    rows = rows.groupBy("id").agg(F.min("y").alias("y"), F.min_by(F.struct("text"), F.xxhash64("text")).alias("t")).select("id", "y", F.col("t.text").alias("text"))
    got = rows.select("id", "y", stats("text").alias("x")).toPandas().sort_values("id", kind="stable")
    x = np.array(got["x"].tolist(), dtype=float).reshape(len(got), len(STATISTICS))
    return fit_trees(x, got["y"].to_numpy(float))


def scorer(model: Trees):
    """Column function: text to score."""

    def score(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for t in texts:
            yield pa.array(model.score(_batch_statistics(t)), pa.float64())

    return F.arrow_udf(score, "double")


def with_quality(docs: DataFrame, model: Trees, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """``docs`` plus ``score`` (0 to 1) and ``predicted`` (1 if the score reaches ``threshold``).

    Only the text counts, the whole of it at any length; null text is scored as
    empty. Columns of those names are replaced. Equal texts have equal scores, so
    repeated rows agree. An empty table gives an empty result.
    """
    kept = [c for c in docs.columns if c not in ("score", "predicted")]
    out = docs.select(*kept, scorer(model)(F.col(text_col)).alias("score"))
    return out.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))


def accepted(docs: DataFrame, model: Trees, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` whose score reaches ``threshold``, with their columns only."""
    (score,) = unused(docs, "quality_score")
    return docs.withColumn(score, scorer(model)(F.col(text_col))).filter(F.col(score) >= threshold).drop(score)


def op5_quality_model(spark, sf_dir: str) -> DataFrame:
    """Scores of all documents, learned from ``labels.quality``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return with_quality(docs, model).select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")
