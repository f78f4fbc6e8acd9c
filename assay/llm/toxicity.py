"""Toxicity (operator 5): class-conditional Kneser-Ney models.

Toxic and ordinary texts each get a Kneser-Ney model of the characters of an expression (a word) given up to five
before it. Both back off to one shared model of shorter contexts, counted over the word types of both classes together,
so that an expression that neither class has seen gets the same likelihood from both and rare ones lean on common
parts: inflected forms of a known stem are recognised. The counts a class's model interpolates are numbers of
documents that hold the word; the shared ones are numbers of word types, Kneser-Ney's continuation counts.

A text's two log-likelihoods are compared per expression, so that length doesn't count: over all its expressions, and
over the one, three and eight that the toxic model favours most, since a few insults make a long text toxic. A logistic
curve over these four normalised log ratios (and the text's length, which says how large the largest of so many are by
chance) turns them into a score. It is fitted by cross-fitting: words counted in one half of the sample score the other
half's texts. The mean over the whole text alone leaves most toxic texts among the ordinary ones (README).

Training takes a bounded sample of labelled rows. All its word types count; they are turned into counts of character
sequences on the executors, and only these reach the driver.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.llm.shared import bounded, cut, fold, give_back, pieces, received, send, table, text_batches

#: Bound of the training sample (labelled rows).
SAMPLE_ROWS = 20_000
ORDER, DISCOUNT = 6, 0.75
START, END = "\x02", "\x03"
_WORDS = re.compile(r"[^\W\d_]+")
CACHE = 100_000
#: Sequences summed at a time on an executor.
PART = 200_000


def _sequences(word: str, start: int = 1, n: int | None = None) -> list[str]:
    """Each character of a word, its end included, with up to five before it; of ``n`` places from ``start`` on."""
    w = f"{START}{word}{END}"
    return [w[max(0, i - ORDER + 1) : i + 1] for i in range(start, len(w) if n is None else min(len(w), start + n))]


def _mixed(x: np.ndarray) -> np.ndarray:
    """64 random-looking bits per number."""
    x = (x + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class KneserNey:
    """log P(word | toxic) - log P(word | ordinary) from document counts per word type."""

    def __init__(self, words: list[str], toxic: list[float], ordinary: list[float]):
        found: dict[str, list[float]] = {}
        for word, a, b in zip(words, toxic, ordinary, strict=True):
            for g in _sequences(word):
                n = found.setdefault(g, [0.0, 0.0, 0.0])
                n[0], n[1], n[2] = n[0] + 1, n[1] + a, n[2] + b
        self._fit(list(found), np.array(list(found.values()) or np.zeros((0, 3))))

    @classmethod
    def of_sequences(cls, grams: list[str], counts: np.ndarray) -> KneserNey:
        """The same from distinct sequences of a character and up to five before it, with numbers of word types and of
        toxic and ordinary documents."""
        out = cls.__new__(cls)
        out._fit(grams, counts)
        return out

    def _fit(self, grams: list[str], counts: np.ndarray) -> None:
        self.seen: dict[str, float] = {}
        self.missing: dict[str, float] = {}
        if not grams:
            return
        lengths = np.fromiter(map(len, grams), np.int64, len(grams))
        row = np.repeat(np.arange(len(grams)), lengths)
        column = ORDER - lengths[row] + np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        codes = np.zeros((len(grams), ORDER), np.uint64)  # right-aligned code points; a gram's last k columns are its last k characters
        codes[row, column] = np.frombuffer("".join(grams).encode("utf-32-le", "surrogatepass"), np.uint32)
        parts = _mixed(codes + (np.arange(ORDER, dtype=np.uint64) << np.uint64(32)))
        # The shared model from the empty context up; back[k] is the probability of the last character after k - 1 others.
        back = np.empty((ORDER + 1, len(grams)))
        for k in range(1, ORDER + 1):
            some = np.flatnonzero(lengths >= k)
            context = parts[some, ORDER - k : ORDER - 1].sum(axis=1, dtype=np.uint64)
            first, of = np.unique(context + parts[some, ORDER - 1], return_index=True, return_inverse=True)[1:]
            n = np.bincount(of, counts[some, 0])
            group = np.unique(context[first], return_inverse=True)[1]
            total, kinds = np.bincount(group, n), np.bincount(group)
            if k == 1:
                back[0] = 1 / (len(n) + 1)
            at = group[of]
            back[k, some] = (np.maximum(n[of] - DISCOUNT, 0) + DISCOUNT * kinds[at] * back[k - 1, some]) / total[at]
        lower = back[lengths - 1, np.arange(len(grams))]
        first, of = np.unique(parts[:, : ORDER - 1].sum(axis=1, dtype=np.uint64), return_index=True, return_inverse=True)[1:]
        chances, backoffs = [], []
        for n in counts[:, 1:].T:
            total, after = np.bincount(of, n), np.bincount(of, np.minimum(n, DISCOUNT))
            whole = np.where(total > 0, total, 1.0)
            backoffs.append(np.where(total > 0, after / whole, 1.0))
            chances.append(np.where(total[of] > 0, (np.maximum(n - DISCOUNT, 0) + after[of] * lower) / whole[of], lower))
        # What neither class has seen in a context costs both the same shared likelihood: only the weights of backing off differ.
        seen = counts[:, 1:].any(axis=1)
        known = np.bincount(of, seen) > 0
        ratios, missing = np.log(chances[0]) - np.log(chances[1]), np.log(backoffs[0]) - np.log(backoffs[1])
        self.seen = {grams[i]: float(ratios[i]) for i in np.flatnonzero(seen)}
        self.missing = {grams[first[i]][:-1]: float(missing[i]) for i in np.flatnonzero(known)}

    def ratio(self, word: str) -> float:
        w, out = f"{START}{word}{END}", 0.0
        for i in range(1, len(w)):
            h = w[max(0, i - ORDER + 1) : i]
            got = self.seen.get(w[max(0, i - ORDER + 1) : i + 1])
            out += self.missing.get(h, 0.0) if got is None else got
        return out


#: Numbers of the most telling expressions whose mean log ratios are compared, beside that of all.
TOP = (1, 3, 8)


def _features(texts: list[str | None], model: KneserNey, cache: dict[str, float]) -> list[list[float]]:
    """Per text: mean log ratio of its words and of the TOP largest ones, log of their number."""
    out = []
    for text in texts:
        total, n, top = 0.0, 0, np.zeros(0)
        for part in pieces(text or ""):
            words = _WORDS.findall(part.lower())
            if not words:
                continue
            for w in {*words}.difference(cache):
                cache[w] = model.ratio(w)
            values = np.fromiter(map(cache.__getitem__, words), float, len(words))
            total, n = total + values.sum(), n + len(words)
            top = np.concatenate([top, np.partition(values, -TOP[-1])[-TOP[-1] :] if len(values) > TOP[-1] else values])
            top = np.sort(top)[::-1][: TOP[-1]]
            if len(cache) > CACHE:
                cache.clear()
        out.append([total / max(1, n), *[float(top[:k].mean()) if n else 0.0 for k in TOP], np.log1p(n)])
    return out


class Toxicity:
    def __init__(self, model: KneserNey | None, weights: np.ndarray):
        self.model, self.weights = model, weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[1:] + self.weights[0], -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weights (constant first) by Newton's method."""
    a, w = np.column_stack([np.ones(len(x)), x]), np.zeros(x.shape[1] + 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(w)), a.T @ (y - p) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _placed(w: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """``w`` with its constant moved so that a score of one half is where the sample's F1 is largest.

    Toxic texts are few; the curve alone would ask for odds that leave out many of them.
    """
    margin = x @ w[1:] + w[0]
    order = np.argsort(-margin, kind="stable")
    hits, taken = np.cumsum(y[order]), np.arange(1, len(y) + 1)
    last = np.append(np.diff(margin[order]) < 0, True)  # equal margins are taken together
    f1 = np.where(last, 2 * hits / (taken + max(1.0, y.sum())), 0.0)
    k = int(f1.argmax())
    if not 0 < y.sum() < len(y) or k + 1 == len(y):
        return w
    return np.concatenate([[w[0] - (margin[order[k]] + margin[order[k + 1]]) / 2], w[1:]])


def train_toxicity(
    docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic"
) -> Toxicity:
    """Fit to at most ``sample_rows`` rows of ``labels``, chosen by hash of their id; null labels are left out.

    All word types of the sample count, those of one document too; they are counted in Spark.
    """
    chosen = bounded(labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(id_col, F.col(label_col).cast("int").alias("y")), sample_rows, id_col)
    known = cut(
        docs.select(F.col(id_col), F.col(text_col).alias("text")).join(F.broadcast(chosen), id_col).select(F.col(id_col).cast("long").alias("id"), "text", "y"), "toxicity-sample"
    )
    half = F.pmod(F.xxhash64(F.lit("half"), "id"), F.lit(2)).cast("int")
    words = _word_types(known.select("text", "y", half.alias("half")))
    got = _sequence_counts(words.groupBy("w").agg(*[F.sum(c).alias(c) for c in COUNTS[3:]])).toArrow().sort_by("g")
    grams, ns = got.column("g").to_pylist(), np.array([got.column(c).to_numpy() for c in COUNTS[3:]], dtype=float).reshape(2, 2, -1)

    def model(types: str, halves: list[int]) -> KneserNey:
        t, n = got.column(types).to_numpy(), ns[halves].sum(axis=0)
        use = np.flatnonzero(t)
        return KneserNey.of_sequences([grams[i] for i in use], np.column_stack([t[use], n[1][use], n[0][use]]).astype(float))

    if not grams:
        return Toxicity(KneserNey([], [], []), np.zeros(len(TOP) + 3))
    fitted = []
    for h in (0, 1):  # each half is scored by the other one's words
        fitted += _scored(known.where(half == h), model(f"t{1 - h}", [1 - h]), lambda x: x.tolist(), "x array<double>", "y").collect()
    fitted.sort(key=lambda r: (r["id"], r["y"], r["x"]))
    x, y = np.array([r["x"] for r in fitted]), np.array([r["y"] for r in fitted], dtype=float)
    return Toxicity(model("t", [0, 1]), _placed(_logistic(x, y), x, y))


#: Word types in half 0, half 1 and both together; documents per half and label.
COUNTS = ["t0", "t1", "t", "n00", "n01", "n10", "n11"]


def _word_types(texts: DataFrame) -> DataFrame:
    """Rows (w, n00, n01, n10, n11): numbers of documents per half and label that hold a word type, summed per batch.

    Words are found as they are when texts are scored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_batches(pa.RecordBatch.from_arrays([batch.column(1), batch.column(0), batch.column(2)], ["y", "text", "half"])):
                found: dict[str, list[int]] = {}
                for y, text, h in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    for w in {w for piece in pieces(text or "") for w in _WORDS.findall(piece.lower())}:
                        found.setdefault(w, [0, 0, 0, 0])[2 * h + y] += 1
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), *[pa.array([n[i] for n in found.values()], pa.int64()) for i in range(4)]], ["w", *COUNTS[3:]])

    return texts.mapInArrow(run, ", ".join(["w string", *[f"{c} long" for c in COUNTS[3:]]]))


def _sequence_counts(counted: DataFrame) -> DataFrame:
    """Rows (g, COUNTS) of the character sequences of word types (w, n00, n01, n10, n11)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def summed() -> pa.RecordBatch:
            rows = values[np.array(at, dtype=np.int64)]
            t = pa.table([pa.array(grams, pa.string()), *[pa.array(c) for c in rows.T]], ["g", *COUNTS])
            t = t.group_by("g").aggregate([(c, "sum") for c in COUNTS]).combine_chunks()
            return pa.RecordBatch.from_arrays([t.column(c).combine_chunks() for c in ["g", *[f"{c}_sum" for c in COUNTS]]], ["g", *COUNTS])

        for batch in batches:
            n = np.column_stack([batch.column(c).to_numpy() for c in COUNTS[3:]]).astype(np.int64)
            halves = np.column_stack([n[:, :2].sum(axis=1) > 0, n[:, 2:].sum(axis=1) > 0]).astype(np.int64)
            values = np.column_stack([halves, halves.max(axis=1), n])
            grams, at = [], []
            for i, word in enumerate(batch.column("w").to_pylist()):
                for start in range(1, len(word) + 2, PART):
                    more = _sequences(word, start, PART)
                    grams += more
                    at += [i] * len(more)
                    if len(grams) > PART:
                        yield summed()
                        grams, at = [], []
            if grams:
                yield summed()

    rows = counted.select("w", *COUNTS[3:]).mapInArrow(run, ", ".join(["g string", *[f"{c} long" for c in COUNTS]]))
    return rows.groupBy("g").agg(*[F.sum(c).alias(c) for c in COUNTS])


def _scored(docs: DataFrame, model: KneserNey, finish, field: str, *more: str) -> DataFrame:
    sent, kind = send(docs.sparkSession, model), pa.list_(pa.float64()) if "array" in field else pa.float64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, float] = {}
        for batch in batches:
            for part in text_batches(batch):
                x = np.array(_features(part.column(1).to_pylist(), received(sent), cache))
                yield pa.RecordBatch.from_arrays([part.column(0), *part.columns[2:], pa.array(finish(x), kind)], ["id", *more, field.split()[0]])

    return docs.select("id", "text", *more).mapInArrow(run, ", ".join(["id long", *[f"{c} int" for c in more], field]))


def score_toxicity(docs: DataFrame, fitted: Toxicity, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, score) for every row of ``docs``; a null text is scored as an empty one."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return _scored(rows, fitted.model, Toxicity(None, fitted.weights).score, "score double")


def drop_toxic(docs: DataFrame, fitted: Toxicity, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose score reaches ``threshold``: one pass, each row judged by its own text."""
    sent, at = send(docs.sparkSession, fitted), docs.columns.index(text_col)
    give_back()  # what training took; the driver's Python lives on beside its JVM

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, float] = {}
        for batch in batches:
            places = pa.array(range(batch.num_rows), pa.int32())
            for part in text_batches(pa.RecordBatch.from_arrays([places, batch.column(at)], ["place", "text"])):
                score = received(sent).score(np.array(_features(part.column(1).to_pylist(), received(sent).model, cache)))
                yield batch.take(part.column(0).filter(pa.array(score < threshold)))

    return docs.mapInArrow(run, docs.schema)


def op5_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    fitted = train_toxicity(docs, labels.where(fold(F.col("doc_id"), 5) != 0))
    return score_toxicity(docs, fitted).select(
        F.col("id").alias("doc_id"), (fold(F.col("id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
