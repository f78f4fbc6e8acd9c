"""SentencePiece sampling and lossless decoding (operator 7).

A text's lattice has a node per character and an edge per piece of the vocabulary, or per UTF-8 byte where a character
has no piece. Forward filtering sums the weights of all segmentations up to each node, backward sampling then draws
one segmentation, each with probability proportional to its weight. The random numbers are a hash of the seed, the
row's key and the place in the text, so any rerun, on any executor, samples the same pieces.

No piece goes on from a word into the space after it, so that the lattice of a text is the chain of the lattices of its
words, each with all the spaces before it; what lies between two cuts is told from the vocabulary (``units``), so every
piece, runs of spaces included, has its edges. Forward weights are computed once per distinct word and kept as
cumulative edge probabilities; backward sampling then walks all words of a batch at once, in numpy. A word of any
length is one lattice: time is linear in it, some 50 microseconds a character where it is far longer than others.

The vocabulary is read from the model file with the public library, on the driver, and broadcast (some MB).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from assay.llm.shared import pieces as parts_of
from assay.llm.shared import received, send, table, text_batches

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Words sampled, and characters of new words learned, at a time.
WORDS, FRESH = 50_000, 100_000
CACHE_NODES = 1_000_000
SLOT_BITS = 18
_BASE, _SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95)


def _rolled(points: np.ndarray) -> int:
    h = 0
    for c in points.tolist():
        h = (h * int(_BASE) + c + 1) % (1 << 64)
    return h


def _units(pieces) -> re.Pattern:
    """What a text is cut into: stretches whose limits no piece crosses, since each piece is one stretch or part of one.

    A word with all the spaces before it, or a single white space of another kind; kinds of white space that occur
    within pieces (such as the carriage return after a semicolon) count as letters. A vocabulary with pieces that go on
    into a space after a word has the whole text as one stretch.
    """
    glue = "".join(sorted({c for p in pieces if len(p) > 1 for c in p if c.isspace() and c != " "}))
    units = re.compile(rf" *[\S{re.escape(glue)}]+| +|[^\S {re.escape(glue)}]")
    return units if all(units.fullmatch(p) for p in pieces if len(p) > 1) else re.compile(r".+", re.S)


class Vocabulary:
    """Pieces with their log-weights.

    A merge-ordered vocabulary has ranks and no probabilities; the weight of the piece of rank r is then that of
    Zipf's law, -log(r + 2.7), times ``alpha``: below 1 flatter and more varied, above 1 closer to the likeliest.
    """

    def __init__(self, model: bytes, alpha: float = 1.0):
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.size, self.byte, self.piece_id, self.weight, self.raw = sp.get_piece_size(), [0] * 256, {}, {}, []
        ranked = []
        for i in range(self.size):
            p = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte[int(p[3:5], 16)] = i
                self.raw.append(bytes([int(p[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.raw.append(b"")
            else:
                self.raw.append(p.replace(MARK, " ").encode())
                ranked.append((-sp.get_score(i), i, p.replace(MARK, " ")))
        ranked.sort()
        for rank, (_, i, p) in enumerate(ranked):
            self.piece_id[p] = i
            self.weight[p] = -alpha * float(np.log(rank + 2.7))
        self.longest = max(map(len, self.piece_id), default=1)
        self.units = _units(self.piece_id)
        self.byte_weight = -alpha * float(np.log(len(ranked) + 2.7))
        # Pieces by a hash of their code points, in an open table probed in place.
        names = list(self.piece_id)
        points = [np.frombuffer(p.encode("utf-32-le"), np.uint32) for p in names]
        self.hashes = np.array([_rolled(p) for p in points] + [0], np.uint64)
        self.ids_by_slot = np.array([*self.piece_id.values(), -1], np.int64)
        self.weights_by_slot = np.array([self.weight[p] for p in names] + [0.0])
        assert len(np.unique(self.hashes[:-1])) == len(names)
        self.slots, self.probes = np.full(1 << SLOT_BITS, len(names), np.int32), 1
        for k, h in enumerate((self.hashes[:-1] * _SPREAD >> np.uint64(64 - SLOT_BITS)).tolist()):
            n = 1
            while self.slots[h] != len(names):
                h, n = (h + 1) % (1 << SLOT_BITS), n + 1
            self.slots[h], self.probes = k, max(self.probes, n)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Index of the piece of each hash, or the number of pieces where there is none."""
        none = len(self.hashes) - 1
        at = (hashes * _SPREAD >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        k = self.slots[at].astype(np.int64)
        wrong = np.flatnonzero((self.hashes[k] != hashes) & (k != none))
        for step in range(1, self.probes):
            if not len(wrong):
                break
            k[wrong] = self.slots[(at[wrong] + step) % (1 << SLOT_BITS)]
            wrong = wrong[(self.hashes[k[wrong]] != hashes[wrong]) & (k[wrong] != none)]
        k[wrong] = none
        return k

    def lattices(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The lattices of ``words``, their nodes (one after each character) and edges in one row.

        Returns the lengths of the words; the number of edges that end at each node; and per edge, grouped by that
        node: the place in the word it starts at, its id (or -1 - code point for a character spelled in bytes) and
        the cumulative probability of the node's edges up to it.
        """
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths)
        first = np.repeat(ends - lengths, lengths)  # of each character's word
        left = np.repeat(ends, lengths) - np.arange(len(points))  # characters from here to the word's end
        place = np.arange(len(points)) - first
        starts, nodes, ids, weights = [], [], [], []
        at, h, none = np.arange(len(points)), np.zeros(len(points), np.uint64), len(self.hashes) - 1
        for size in range(1, self.longest + 1):
            if size > 1:
                alive = left[at] >= size
                at, h = at[alive], h[alive]
                if not len(at):
                    break
            h = h * _BASE + (points[at + size - 1].astype(np.uint64) + np.uint64(1))
            k = self.find(h)
            hit = np.flatnonzero(k != none)
            k, from_ = k[hit], at[hit]
            starts.append(from_)
            nodes.append(from_ + size - 1)
            ids.append(self.ids_by_slot[k])
            weights.append(self.weights_by_slot[k])
            if size == 1:
                spelled = np.ones(len(points), bool)
                spelled[from_] = False
                spelled = np.flatnonzero(spelled)
                c = points[spelled].astype(np.int64)
                starts.append(spelled)
                nodes.append(spelled)
                ids.append(-1 - c)
                weights.append((1 + (c >= 0x80) + (c >= 0x800) + (c >= 0x10000)) * self.byte_weight)
        start, node, ids_, weight = (np.concatenate(x) for x in (starts, nodes, ids, weights))
        order = np.argsort(node * (self.longest + 1) + (node - start), kind="stable")
        start, node, ids_, weight = start[order], node[order], ids_[order], weight[order]
        counts = np.bincount(node, minlength=len(points))
        before = np.cumsum(counts) - counts
        alpha, cumulative = np.zeros(len(points) + 1), np.empty(len(node))  # alpha[-1]: before a word's first character
        by_place = np.argsort(place, kind="stable")
        limits = np.searchsorted(place[by_place], np.arange(int(lengths.max(initial=0)) + 1))
        from_node = np.where(start == first[start], -1, start - 1) if len(start) else start
        for t in range(len(limits) - 1):  # forward filtering: all nodes at place t of their words
            here = by_place[limits[t] : limits[t + 1]]
            n = counts[here]
            head = np.cumsum(n) - n
            e = np.repeat(before[here] - head, n) + np.arange(n.sum())
            v = alpha[from_node[e]] + weight[e]
            top = np.maximum.reduceat(v, head)
            x = np.exp(v - np.repeat(top, n))
            total = np.add.reduceat(x, head)
            run = np.cumsum(x)
            run = (run - np.repeat(run[head] - x[head], n)) / np.repeat(total, n)
            run[head + n - 1] = 1.0
            cumulative[e] = run
            alpha[here] = top + np.log(total)
        return lengths, counts, place[start] if len(start) else start, ids_, cumulative


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit mixing of counters to random words."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Grown:
    """An array that grows at its end."""

    def __init__(self, kind, values=()):
        self.array, self.n = np.zeros(1 << 16, kind), 0
        self.add(np.array(values, kind))

    def add(self, values: np.ndarray) -> None:
        if self.n + len(values) > len(self.array):
            grown = np.zeros(max(2 * len(self.array), self.n + len(values)), self.array.dtype)
            grown[: self.n] = self.array[: self.n]
            self.array = grown
        self.array[self.n : self.n + len(values)] = values
        self.n += len(values)

    def last(self):
        return self.array[self.n - 1]


class Sampler:
    """Keeps the lattices of the words met so far as flat arrays."""

    def __init__(self, vocabulary: Vocabulary, seed: int = 1):
        self.vocabulary, self.seed = vocabulary, np.uint64(seed)
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        # Word -> first node, node -> first edge; edge -> place it starts at, id, cumulative probability.
        self.first, self.edge = _Grown(np.int64, [0]), _Grown(np.int64, [0])
        self.starts, self.ids, self.cumulative = _Grown(np.int32), _Grown(np.int32), _Grown(np.float64)

    def learn(self, words) -> None:
        fresh = sorted({*words}.difference(self.index))
        if fresh and self.edge.n > CACHE_NODES:
            self.clear()
            fresh = sorted({*words})
        ends = np.cumsum([len(w) for w in fresh]) // FRESH
        for part in np.split(np.array(fresh, object), np.flatnonzero(np.diff(ends)) + 1) if fresh else []:
            part = part.tolist()
            self.index.update(zip(part, range(len(self.index), len(self.index) + len(part)), strict=True))
            lengths, counts, starts, ids, cumulative = self.vocabulary.lattices(part)
            self.first.add(self.first.last() + np.cumsum(lengths))
            self.edge.add(self.edge.last() + np.cumsum(counts))
            self.starts.add(starts)
            self.ids.add(ids)
            self.cumulative.add(cumulative)

    def sample(self, words: list[str], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sampled edge ids of all words in order, and their number per word. keys: a random word for each."""
        self.learn(words)
        first, edge_of, starts, ids, cumulative = (x.array for x in (self.first, self.edge, self.starts, self.ids, self.cumulative))
        w = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        base, at = first[w], first[w + 1] - first[w]
        alive = np.flatnonzero(at > 0)
        who, got, step = [], [], 0
        while len(alive):
            node = base[alive] + at[alive] - 1
            low, high = edge_of[node], edge_of[node + 1] - 1
            u = (_mix(keys[alive] + np.uint64(step * 0xD1342543DE82EF95 % (1 << 64))) >> np.uint64(11)) / float(1 << 53)
            while True:  # bisection among the node's edges
                open_ = low < high
                if not open_.any():
                    break
                mid = (low + high) // 2
                right = open_ & (cumulative[mid] < u)
                low = np.where(right, mid + 1, low)
                high = np.where(open_ & ~right, mid, high)
            who.append(alive)
            got.append(ids[low])
            at[alive] = starts[low]
            alive, step = alive[at[alive] > 0], step + 1
        if not who:
            return np.zeros(0, np.int64), np.zeros(len(words), np.int64)
        owner, out = np.concatenate(who)[::-1], np.concatenate(got)[::-1]  # drawn from the end of each word
        order = np.argsort(owner, kind="stable")
        return out[order], np.bincount(owner, minlength=len(words))

    def encode(self, keys: list[int], texts: list[str | None], copies: list[int] | None = None) -> list[np.ndarray]:
        """Piece ids of each text, sampled by its key and, above 0, the number of its copy."""
        words: list[str] = []
        counts = np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            n = 0
            for k, part in enumerate(parts_of(text or "", only=" ")):
                found = self.vocabulary.units.findall(part if k else " " + part)  # the space that encoders put before a text
                words += found
                n += len(found)
            counts[i] = n
        if not words:
            return [np.zeros(0, np.int32) for _ in texts]
        own = np.repeat(np.arange(len(texts)), counts)
        place = np.arange(len(words)) - np.repeat(np.cumsum(counts) - counts, counts)
        with np.errstate(over="ignore"):
            rows = _mix(np.array(keys, np.int64).astype(np.uint64) ^ _mix(np.array([self.seed])))
            if copies is not None:
                rows = np.where(np.array(copies) > 0, _mix(rows + np.array(copies, np.uint64)), rows)
            random = _mix(rows[own] + place.astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
            drawn = [self.sample(words[at : at + WORDS], random[at : at + WORDS]) for at in range(0, len(words), WORDS)]
            ids, per_word = (np.concatenate(x) for x in zip(*drawn, strict=True))
        doc = np.repeat(own, per_word)
        spelled = np.flatnonzero(ids < 0)
        if len(spelled):  # characters spelled in bytes
            bytes_ = [[self.vocabulary.byte[b] for b in chr(-1 - i).encode()] for i in ids[spelled].tolist()]
            n = np.ones(len(ids), np.int64)
            n[spelled] = [len(b) for b in bytes_]
            ids, doc, is_byte = np.repeat(ids, n), np.repeat(doc, n), np.repeat(ids < 0, n)
            ids[is_byte] = [x for b in bytes_ for x in b]
        limits = np.searchsorted(doc, np.arange(len(texts) + 1))
        return [ids[a:b].astype(np.int32) for a, b in zip(limits[:-1], limits[1:], strict=True)]


def decode_ids(ids, raw: list[bytes]) -> str:
    """The text of a sequence of ids: their bytes in a row, without the space put before the text."""
    return b"".join(map(raw.__getitem__, ids)).decode("utf-8", "replace").removeprefix(" ")


def read_model(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode_pieces(docs: DataFrame, model_path: str = MODEL, alpha: float = 1.0, seed: int = 1, id_col: str = "doc_id", text_col: str = "text", number_copies: bool = False) -> DataFrame:
    """``docs`` with its columns and ids (array<int>), n_pieces and lossless (whether decoding gives the text again).

    Columns that have these names already are replaced. Null and empty texts have no pieces and are lossless, for null
    counts as empty. A null key counts as -1, and a key that isn't a whole number by a hash of its text; rows with equal
    keys and texts are sampled alike. With ``number_copies`` rows with equal keys and texts that follow one another, as a
    mix emits its repetitions, are numbered and each is sampled by its number too. ``model_path`` is read on the driver
    only.
    """
    docs = docs.drop("ids", "n_pieces", "lossless")
    vocabulary = send(docs.sparkSession, Vocabulary(read_model(model_path), alpha))
    names = docs.columns
    key_at, text_at = names.index(id_col), names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(received(vocabulary), seed)
        raw, last, copy = sampler.vocabulary.raw, None, 0
        for batch in batches:
            places = pa.array(range(batch.num_rows), pa.int32())
            for part in text_batches(pa.RecordBatch.from_arrays([places, batch.column(text_at)], ["place", "text"]), chars=1 << 18):
                rows, texts = batch.take(part.column(0)), part.column(1).to_pylist()
                keys = [-1 if k is None else k if isinstance(k, int) else xxhash.xxh64_intdigest(str(k)) - (1 << 63) for k in rows.column(key_at).to_pylist()]
                copies: list[int] | None = [] if number_copies else None
                for row in zip(keys, texts, strict=True) if number_copies else ():
                    copy = copy + 1 if row == last else 0
                    last = row
                    copies.append(copy)
                ids = sampler.encode(keys, texts, copies)
                ok = [decode_ids(x.tolist(), raw) == (t or "") for x, t in zip(ids, texts, strict=True)]
                limits = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(limits), pa.array(np.concatenate(ids)))
                yield pa.RecordBatch.from_arrays([*rows.columns, lists, pa.array(np.diff(limits).astype(np.int32)), pa.array(ok)], [*names, "ids", "n_pieces", "lossless"])

    schema = T.StructType([*docs.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_pieces", T.IntegerType()), T.StructField("lossless", T.BooleanType())])
    return docs.mapInArrow(run, schema)


def decode_pieces(docs: DataFrame, model_path: str = MODEL, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """``docs`` with ``ids_col`` replaced by the text it spells; null ids give the empty text."""
    vocabulary = send(docs.sparkSession, Vocabulary(read_model(model_path)))
    at, others = docs.columns.index(ids_col), [c for c in docs.columns if c not in (ids_col, text_col)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = received(vocabulary).raw
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                texts = [decode_ids(x or [], raw) for x in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*[part.column(part.schema.get_field_index(c)) for c in others], pa.array(texts, pa.string())], [*others, text_col])

    return docs.mapInArrow(run, T.StructType([*[docs.schema[c] for c in others], T.StructField(text_col, T.StringType())]))


def op7_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_pieces(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
