"""Quality classifier (operator 3): histogram gradient-boosted trees over document statistics.

Statistics come from whole texts, in Arrow batches. The trees are grown on the driver from a bounded, hash-chosen
sample of labelled rows, with 64 quantile bins per statistic, and flattened into arrays (statistic, threshold, value)
of complete binary trees, so that scoring walks all rows of a batch down a tree at once in numpy.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.llm.shared import bounded, fold, pieces, received, send, table, text_batches

#: The bound of the training sample, in labelled rows.
SAMPLE_ROWS = 20_000
STATISTICS = (
    "log_chars", "log_words", "word_length", "upper", "digits", "stops", "bangs", "bars", "signs", "other_marks", "spaces", "breaks",
    "non_ascii", "distinct_words", "top_word", "echoed_words", "marked_words", "bare_marks", "distinct_lines", "log_line", "closed_lines", "compressed",
)
_LETTER_END = re.compile(r"[^\W\d_][.,;:?]?$")


def _bytes_in(chars: str) -> np.ndarray:
    hit = np.zeros(256, bool)
    hit[list(chars.encode())] = True
    return hit


_CLASSES = [
    _bytes_in("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _bytes_in("0123456789"), _bytes_in(".,"), _bytes_in("!"), _bytes_in("|"), _bytes_in("#$%&*"),
    _bytes_in("\"'()-/:;<=>?@[]^_`{}~+\\"), _bytes_in(" \t"), _bytes_in("\n\r\x0b\x0c"), np.arange(256) >= 128,
]


def statistics(text: str | None) -> list[float]:
    """The STATISTICS of one whole text; zeros for an empty or null one. Long texts are read in pieces."""
    if not text:
        return [0.0] * len(STATISTICS)
    hist = np.zeros(256, np.int64)
    words = letters = echoed = marked = bare = packed = size = 0
    seen: Counter[str] = Counter()
    distinct = top = 0.0
    n_pieces = 0
    last = ""
    for part in pieces(text):
        raw = part.encode("utf-8", "replace")
        size += len(raw)
        hist += np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
        packed += len(zlib.compress(raw, 1))
        found = part.split()
        words += len(found)
        letters += sum(map(len, found))
        echoed += sum(map(str.__eq__, [last, *found], found))
        last = found[-1] if found else last
        seen = Counter(found)
        for w, n in seen.items():
            if not _LETTER_END.search(w):
                marked += n
                if not any(map(str.isalnum, w)):
                    bare += n
        distinct += len(seen) / max(1, len(found)) ** 0.8  # types grow more slowly than tokens
        top += max(seen.values(), default=0) / max(1, len(found))
        n_pieces += 1
    lines = [x for x in text.split("\n") if x.strip()]
    shares = [hist[c].sum() / size for c in _CLASSES]
    return [
        np.log1p(len(text)), np.log1p(words), letters / max(1, words), *shares, distinct / n_pieces, top / n_pieces, echoed / max(1, words), marked / max(1, words),
        bare / max(1, words), len(set(lines)) / max(1, len(lines)), np.log1p(len(text) / max(1, len(lines))), sum(x.rstrip().endswith((".", "!", "?")) for x in lines) / max(1, len(lines)), packed / size,
    ]


class Trees:
    """Boosted complete binary trees of one depth, as arrays: tree x node."""

    def __init__(self, base: float, feature: np.ndarray, threshold: np.ndarray, value: np.ndarray):
        self.base, self.feature, self.threshold, self.value = base, feature, threshold, value

    def margin(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        inner = self.feature.shape[1]
        for feature, threshold, value in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            while len(node) and node[0] < inner:
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            out += value[node - inner]
        return out

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def grow(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.12, bins: int = 64, ridge: float = 1.0, least: float = 2.0) -> Trees:
    """Fit boosted trees to 0/1 labels by logistic loss: level by level, gradient histograms per node and bin."""
    n, k = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for j in range(k)]
    codes = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)  # code > c  <=>  x > edges[c]
    offset = np.arange(k) * bins
    p = min(max(float(y.mean()), 1e-4), 1 - 1e-4)
    base = float(np.log(p / (1 - p)))
    inner, leaves = 2**depth - 1, 2**depth
    feature, threshold, value = np.zeros((trees, inner), np.int32), np.full((trees, inner), np.inf), np.zeros((trees, leaves))
    margin = np.full(n, base)
    for t in range(trees):
        q = 1 / (1 + np.exp(-margin))
        g, h = q - y, np.maximum(q * (1 - q), 1e-9)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            width, first = 2**level, 2**level - 1
            flat = ((node - first)[:, None] * (k * bins) + codes + offset).ravel()
            gs = np.bincount(flat, np.repeat(g, k), width * k * bins).reshape(width, k, bins).cumsum(axis=2)
            hs = np.bincount(flat, np.repeat(h, k), width * k * bins).reshape(width, k, bins).cumsum(axis=2)
            gt, ht = gs[:, :, -1:], hs[:, :, -1:]
            gain = gs**2 / (hs + ridge) + (gt - gs) ** 2 / (ht - hs + ridge) - gt**2 / (ht + ridge)
            gain[(hs < least) | (ht - hs < least)] = 0
            best = gain.reshape(width, -1).argmax(axis=1)
            f, c = best // bins, best % bins
            for i in range(width):
                if gain[i, f[i], c[i]] > 1e-9 and c[i] < len(edges[f[i]]):
                    feature[t, first + i], threshold[t, first + i] = f[i], edges[f[i]][c[i]]
            node = 2 * node + 1 + (x[np.arange(n), feature[t, node]] > threshold[t, node])
        leaf = node - inner
        value[t] = -rate * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + ridge)
        margin += value[t][leaf]
    return Trees(base, feature, threshold, value)


def _statistics_table(docs: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """Rows (id, more..., x): the statistics of each whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_batches(batch):
                xs = [statistics(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), *part.columns[2:], pa.array(xs, pa.list_(pa.float64()))], ["id", *more, "x"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), *[F.col(c).cast("double") for c in more])
    return rows.mapInArrow(run, ", ".join(["id long", *[f"{c} double" for c in more], "x array<double>"]))


def train_quality(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Trees:
    """Trees fitted to at most ``sample_rows`` rows of ``labels``, chosen by hash of their id; null labels are left out."""
    chosen = bounded(labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(id_col, F.col(label_col).alias("__label")), sample_rows, id_col)
    known = docs.select(id_col, text_col).join(F.broadcast(chosen), id_col)
    rows = sorted(_statistics_table(known, id_col, text_col, "__label").collect())
    if not rows:
        return Trees(0.0, np.zeros((0, 1), np.int32), np.zeros((0, 1)), np.zeros((0, 2)))
    return grow(np.array([r["x"] for r in rows]), np.array([r["__label"] for r in rows]))


def score_quality(docs: DataFrame, model: Trees, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, score) for every row of ``docs``; null and empty texts are scored by their zero statistics."""
    sent = send(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_batches(batch):
                x = np.array([statistics(t) for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(received(sent).predict(x))], ["id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, score double")


def op3_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train_quality(docs, labels.where(fold(F.col("doc_id"), 5) != 0))
    return score_quality(docs, model).select(
        F.col("id").alias("doc_id"), (fold(F.col("id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )
