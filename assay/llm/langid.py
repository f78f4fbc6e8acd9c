"""Language identification (operator 2): a linear-chain conditional random field over words.

Every word of a text is a position of the chain and every learned language a state. Emission weights are sums over
the word's affixes, character n-grams and lexicon entry (the whole word), transitions are learned, and forward-backward
gives each word's language probabilities, so that code-switched text is labelled word by word. A document's language is
the one with the largest expected number of words. A text is one chain, however long: runs of ``CHAIN`` words are
computed side by side, each from the messages that the runs before and after it pass on.

Texts are handled as flat arrays of code points: letters, word limits, feature hashes and the recursions run over all
words of a batch at once in numpy. Features live in hash tables of fixed size, so the model's size doesn't depend on
the vocabulary.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.llm.shared import bounded, fold, pieces, received, send, table, text_batches

#: Bounds of the training sample, chosen by hash: documents, and characters of their whole texts together.
SAMPLE_DOCS, SAMPLE_CHARS = 4_000, 12_000_000
#: Words of a run.
CHAIN = 64
BITS = 18
UNDETERMINED = "und"

_SALT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53], np.uint64)


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Which code points of the first plane are letters, and their lower case where that is one code point."""
    letter = np.fromiter((chr(i).isalpha() for i in range(0x10000)), bool, 0x10000)
    lower = np.arange(0x10000, dtype=np.uint32)
    for i in np.flatnonzero(letter):
        x = chr(i).lower()
        if len(x) == 1:
            lower[i] = min(ord(x), 0xFFFF)
    return letter, lower


_TABLES: list[tuple[np.ndarray, np.ndarray]] = []


def words_of(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The letters of ``text``, lower-cased, and the length of each word (maximal run of letters)."""
    if not _TABLES:
        _TABLES.append(_tables())
    letter, lower = _TABLES[0]
    cp = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    low = cp < 0x10000
    is_letter = np.where(low, letter[np.where(low, cp, 0)], False)
    for i in np.flatnonzero(~low):
        is_letter[i] = chr(cp[i]).isalpha()
    edge = np.diff(np.concatenate([[0], is_letter.view(np.int8), [0]]))
    lengths = np.flatnonzero(edge == -1) - np.flatnonzero(edge == 1)
    kept = cp[is_letter]
    return np.where(kept < 0x10000, lower[np.minimum(kept, 0xFFFF)], kept), lengths


def _slot(h: np.ndarray, kind: int) -> np.ndarray:
    h = (h ^ _SALT[kind]) * np.uint64(0xFF51AFD7ED558CCD)
    return ((h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - BITS)).astype(np.int64)


def features(letters: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash slots of all features of all words, and the index of the word of each.

    Kinds: character trigrams over the word between two boundary marks (they hold the affixes of two letters),
    prefixes and suffixes of three and four letters, the whole word, and a constant.
    """
    m = np.uint64(1_000_003)
    n, word = len(lengths), np.repeat(np.arange(len(lengths)), lengths)
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
    padded = np.ones(len(letters) + 2 * n, np.uint64)
    padded[np.arange(len(letters)) + 2 * word + 1] = letters
    at = np.arange(len(letters)) + 2 * word
    slots, owners = [_slot((padded[at] * m + padded[at + 1]) * m + padded[at + 2], 0)], [word]
    off = first + 2 * np.arange(n)
    for kind, k in ((1, 3), (3, 4)):
        some = np.flatnonzero(lengths >= k)
        pre, suf = off[some] + 1, off[some] + 1 + lengths[some] - k
        hp, hs = np.zeros(len(some), np.uint64), np.zeros(len(some), np.uint64)
        for i in range(k):
            hp, hs = hp * m + padded[pre + i], hs * m + padded[suf + i]
        slots += [_slot(hp, kind), _slot(hs, kind + 1)]
        owners += [some, some]
    place = (np.arange(len(letters)) - np.repeat(first, lengths)).astype(np.uint64)
    mixed = (letters.astype(np.uint64) + place * np.uint64(0x9E3779B1)) * _SALT[5]
    whole = np.add.reduceat(mixed ^ (mixed >> np.uint64(31)), first) if n else np.zeros(0, np.uint64)
    slots += [_slot(whole, 5), np.zeros(n, np.int64)]
    owners += [np.arange(n), np.arange(n)]
    return np.concatenate(slots), np.concatenate(owners)


class Chain:
    """The random field: emission weights by slot and state, transition scores, the languages."""

    def __init__(self, langs: list[str]):
        k = len(langs)
        self.langs, self.weights, self.moves = langs, np.zeros((1 << BITS, k), np.float32), np.zeros((k, k))

    def emissions(self, slots: np.ndarray, owners: np.ndarray, n: int) -> np.ndarray:
        picked = self.weights[slots]
        return np.stack([np.bincount(owners, picked[:, j], n) for j in range(len(self.langs))], axis=1)

    def marginals(self, e: np.ndarray, texts: np.ndarray, moves: np.ndarray, pairs: bool = False):
        """Forward-backward. e: words x states; texts: numbers of words of consecutive texts, each one chain.

        Returns word probabilities and, if asked, the expected number of each transition.
        """
        chains, first = runs_of(texts)
        k, n, width = e.shape[1], len(chains), int(chains.max(initial=0))
        if not width:
            return np.zeros((0, k)), np.zeros((k, k))
        row = np.repeat(np.arange(n), chains)
        col = np.arange(len(e)) - np.repeat(np.cumsum(chains) - chains, chains)
        b = np.ones((width, n, k))
        b[col, row] = np.exp(np.clip(e - e.max(axis=1, keepdims=True), -60, 0))
        here, t = np.arange(width)[:, None] < chains, np.exp(moves - moves.max())
        before, after, ends = self._messages(b, chains, first, t)
        alpha, beta = np.empty((width, n, k)), np.broadcast_to(after, (width, n, k)).copy()
        alpha[0] = before * b[0]
        alpha[0] /= alpha[0].sum(axis=1, keepdims=True) + 1e-300
        for i in range(1, width):
            a = (alpha[i - 1] @ t) * b[i]
            alpha[i] = a / (a.sum(axis=1, keepdims=True) + 1e-300)
        for i in range(width - 2, -1, -1):
            x = (b[i + 1] * beta[i + 1]) @ t.T
            beta[i] = np.where(here[i + 1][:, None], x / (x.sum(axis=1, keepdims=True) + 1e-300), after)
        g = alpha * beta
        g /= g.sum(axis=2, keepdims=True) + 1e-300
        moved = np.zeros((k, k))
        if pairs:
            use = np.flatnonzero(~first)
            x = ends[use][:, :, None] * t * (b[0] * beta[0])[use][:, None, :]
            moved += (x / (x.sum(axis=(1, 2), keepdims=True) + 1e-300)).sum(axis=0)
            for i in range(1, width):
                use = here[i]
                x = alpha[i - 1][use][:, :, None] * t * (b[i] * beta[i])[use][:, None, :]
                moved += (x / (x.sum(axis=(1, 2), keepdims=True) + 1e-300)).sum(axis=0)
        return g[col, row], moved

    @staticmethod
    def _messages(b: np.ndarray, chains: np.ndarray, first: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per run what comes in from the left before its first word, from the right after its last one, and the
        left neighbour's forward weights at its end. b: places x runs x states; first: whether a run begins a text.

        A run's words act on a message as one matrix; with these, messages go from run to run.
        """
        k, n = b.shape[2], len(chains)
        before, after, ends = np.ones((n, k)), np.ones((n, k)), np.ones((n, k))
        if first.all():
            return before, after, ends
        text = np.cumsum(first) - 1
        place = np.arange(n) - np.flatnonzero(first)[text]
        long = np.flatnonzero(np.bincount(text)[text] > 1)  # runs of texts of several runs
        act = np.zeros((len(long), k, k))
        act[:, range(k), range(k)] = b[0, long]
        for i in range(1, b.shape[0]):
            some = np.flatnonzero(chains[long] > i)
            if not len(some):
                break
            x = (act[some] @ t) * b[i, long[some]][:, None, :]
            act[some] = x / (x.sum(axis=(1, 2), keepdims=True) + 1e-300)
        at = np.full(n, -1)
        at[long] = np.arange(len(long))
        order = np.argsort(place[long], kind="stable")
        groups = np.split(long[order], np.flatnonzero(np.diff(place[long][order])) + 1)
        for runs in groups:  # the first runs of all texts, then the second ones, ...
            after_it = runs + 1
            after_it = after_it[(after_it < n)]
            after_it = after_it[~first[after_it]]
            x = np.einsum("ni,nij->nj", before[after_it - 1], act[at[after_it - 1]])
            ends[after_it] = x / (x.sum(axis=1, keepdims=True) + 1e-300)
            x = ends[after_it] @ t
            before[after_it] = x / (x.sum(axis=1, keepdims=True) + 1e-300)
        for runs in reversed(groups):
            runs = runs[~first[runs]]
            x = np.einsum("nij,nj->ni", act[at[runs]], after[runs]) @ t.T
            after[runs - 1] = x / (x.sum(axis=1, keepdims=True) + 1e-300)
        return before, after, ends


def runs_of(texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of the runs of at most CHAIN words of consecutive texts, and whether each begins a text."""
    number = -(-texts // CHAIN)
    lengths = np.full(int(number.sum()), CHAIN, np.int64)
    some = np.flatnonzero(number)
    last = np.cumsum(number)[some] - 1
    lengths[last] = texts[some] - (number[some] - 1) * CHAIN
    first = np.zeros(len(lengths), bool)
    first[last - number[some] + 1] = True
    return lengths, first


def fit(samples: list[tuple[str, str]], epochs: int = 4, batch: int = 64, rate: float = 0.4) -> Chain:
    """Learn from (language, words) samples that carry a language per text only.

    First pass: emissions alone, every word labelled with its text's language. Then the words are labelled anew by
    forward-backward with transitions that rarely switch, which finds the passages in another language, and emissions
    and transitions are learned together from these labels by gradient steps on the chain's likelihood.
    """
    langs = sorted({lang for lang, _ in samples})
    chain, index = Chain(langs), {x: i for i, x in enumerate(langs)}
    k, data = len(langs), []
    for at in range(0, len(samples), batch):
        got = [(index[lang], *words_of(text)) for lang, text in samples[at : at + batch]]
        got = [x for x in got if len(x[2])]
        if not got:
            continue
        lengths = np.concatenate([x[2] for x in got])
        slots, owners = features(np.concatenate([x[1] for x in got]), lengths)
        labels = np.concatenate([np.full(len(x[2]), x[0]) for x in got])
        data.append((slots.astype(np.int32), owners.astype(np.int32), labels, np.array([len(x[2]) for x in got])))
    squares = np.full((1 << BITS, k), 1e-6)
    move_squares = np.full((k, k), 1e-2)

    def epoch(field: bool) -> None:
        for slots, owners, labels, texts in data:
            e = chain.emissions(slots, owners, len(labels))
            target = np.eye(k)[labels]
            if field:
                p, moved = chain.marginals(e, texts, chain.moves, pairs=True)
                starts = np.zeros(len(labels), bool)
                starts[np.cumsum(texts) - texts] = True
                follow = np.flatnonzero(~starts)
                seen = np.bincount(labels[follow - 1] * k + labels[follow], minlength=k * k).reshape(k, k)
                g = (seen - moved) / max(1, len(labels)) * 10
                move_squares[:] += g**2
                chain.moves += 0.5 * g / np.sqrt(move_squares)
            else:
                p = np.exp(e - e.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
            d = (target - p)[owners]
            used, where = np.unique(slots, return_inverse=True)
            g = np.stack([np.bincount(where, d[:, j], len(used)) for j in range(k)], axis=1) / batch
            squares[used] += g**2
            chain.weights[used] += (rate * 0.25 * g / np.sqrt(squares[used])).astype(np.float32)

    for _ in range(2):
        epoch(False)
    sticky = np.log(np.full((k, k), 0.02 / max(1, k - 1)) + np.eye(k) * 0.98)
    for i, (slots, owners, labels, texts) in enumerate(data):
        p, _ = chain.marginals(chain.emissions(slots, owners, len(labels)), texts, sticky)
        p[np.arange(len(labels)), labels] *= 3  # the text's own language is likelier
        data[i] = (slots, owners, p.argmax(axis=1), texts)
    for _ in range(max(1, epochs - 2)):
        epoch(True)
    return chain


def label_texts(texts: list[str | None], chain: Chain) -> tuple[list[str], list[float], list[int]]:
    """Language, its share of the expected words, and the number of words of each text; ``und``, 0.0 and 0 without letters."""
    got, owner = [], []
    for i, text in enumerate(texts):
        for part in pieces(text or ""):
            got.append(words_of(part))
            owner.append(i)
    k, counts = len(chain.langs), np.array([len(x[1]) for x in got], np.int64)
    totals, numbers = np.zeros((len(texts), max(1, k))), np.zeros(len(texts), np.int64)
    if k and counts.sum():
        np.add.at(numbers, np.array(owner), counts)
        lengths = np.concatenate([x[1] for x in got])
        slots, owners = features(np.concatenate([x[0] for x in got]), lengths)
        p, _ = chain.marginals(chain.emissions(slots, owners, len(lengths)), numbers, chain.moves)
        doc = np.repeat(np.array(owner), counts)
        totals = np.stack([np.bincount(doc, p[:, j], len(texts)) for j in range(k)], axis=1)
    best = totals.argmax(axis=1)
    langs = [chain.langs[b] if n else UNDETERMINED for b, n in zip(best, numbers, strict=True)]
    scores = np.clip(totals[np.arange(len(texts)), best] / np.maximum(numbers, 1), 0, 1)
    return langs, scores.tolist(), numbers.tolist()


def train_langid(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Chain:
    """Learn from the whole texts of at most ``sample_docs`` documents with text and language, chosen by hash.

    Should these hold more than ``sample_chars`` characters together, those of them that come last by hash are left out
    (never the first one, and never a part of a text).
    """
    known = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    keys = bounded(known.select("id", F.xxhash64("text").alias("h"), F.length("text").alias("n")), sample_docs, "id", "h").withColumn("place", F.xxhash64(F.lit("place"), "id", "h"))
    keys = sorted(keys.distinct().collect(), key=lambda r: (r["place"], r["h"]))
    size = np.cumsum([r["n"] for r in keys])
    keys = [(r["id"], r["h"]) for r, total in zip(keys, size, strict=True) if total <= max(sample_chars, int(size[0]))]
    if not keys:
        return fit([])
    chosen = docs.sparkSession.createDataFrame(keys, f"i {dict(known.dtypes)['id']}, g long")
    rows = known.join(F.broadcast(chosen), (F.col("id").eqNullSafe(F.col("i"))) & (F.xxhash64("text") == F.col("g"))).select("id", "lang", "text")
    picked = sorted({(r["id"] or 0, r["lang"], r["text"]) for r in rows.collect()})
    order = np.random.default_rng(7).permutation(len(picked))
    return fit([(picked[i][1], picked[i][2]) for i in order])


def identify(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, lang_pred, score, n_words) for every row of ``docs``."""
    sent = send(docs.sparkSession, chain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_batches(batch, chars=1 << 20):
                langs, scores, numbers = label_texts(part.column(1).to_pylist(), received(sent))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(numbers, pa.int64())], ["id", "lang_pred", "score", "n_words"]
                )

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, lang_pred string, score double, n_words long")


def op2_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    chain = train_langid(docs.where(fold(F.col("doc_id"), 4) != 2))
    return identify(docs.select("doc_id", "text"), chain).select(F.col("id").alias("doc_id"), (fold(F.col("id"), 4) == 2).alias("held_out"), "lang_pred", "score", "n_words")
