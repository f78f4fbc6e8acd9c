"""SimHash near-deduplication (operator 10).

Fingerprints are made in Arrow batches. Distinct fingerprints are then embedded by segment popcount: 64 bits in 16
segments of 4, each replaced by its number of set bits. The Manhattan distance of two embeddings never exceeds the
Hamming distance of the fingerprints, so fingerprints within ``max_bits`` <= 2 have embeddings within 2, and embeddings
within 2 share a grid point at distance at most 1 from both. Every fingerprint is dealt to its grid point and those
next to it, the range join is an equi-join on grid points, and each pair is verified by the exact Hamming distance.

A grid point with more than ``CROWD`` fingerprints isn't paired off. Its fingerprints meet at one-bit neighbours
instead: two of them within 2 bits share a 64-bit word at most one bit from either, a word has at most 65 such
neighbours, and each is linked with the smallest. That is exact, and its cost is 65 rows per fingerprint, whatever
the size of the group. Components come from contraction rounds; no pair of copies is ever written out.

``near_groups`` links whole documents by their fingerprints. ``similar_groups`` links documents whose word shingles are
similar (Jaccard), which 64 bits can't tell: texts at 0.8 differ in some nine bits, far beyond the grid. There the grid's
links of whole texts are joined by ``SEEDS`` further fingerprints of each, of windows of its shingles around the one that a
seeded hash puts first. Two texts at 0.8 have each such window in common with a probability of about two in three, and
at least one of eight in 99.98 of 100 cases. A window that is edited differs in many bits, so these are joined where they
are equal, and every pair of documents found, by grid or window, is verified exactly on its shingles.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.llm.shared import components, cut, perhaps_in, send, table

SEGMENTS, WIDTH = 16, 4
CROWD = 64


def fingerprints(texts: list[bytes | None], shingle: int = 3, seed: int = 42) -> list[int]:
    """SimHash of each text (UTF-8 bytes) as a signed 64-bit integer.

    A-Z are lower-cased; words are runs of anything but ASCII white space (bytes.split has the same set); shingles
    count as often as they occur; a shorter text is one shingle; a text without words, or null, gets zero. A bit is
    set if it is set in more than half of the hashes. Long texts are hashed in blocks, so memory stays bounded.
    """
    out = []
    h = xxhash.xxh64_intdigest
    for text in texts:
        words = text.lower().split() if text else []
        if not words:
            out.append(0)
            continue
        n = max(1, len(words) - shingle + 1)
        counts = np.zeros(64, dtype=np.int64)
        for at in range(0, n, 65536):
            block = words[at : at + 65536 + shingle - 1] if n > 1 else words
            grams = map(b" ".join, zip(*(block[i:] for i in range(shingle)), strict=False)) if n > 1 or len(words) >= shingle else [b" ".join(words)]
            hashes = np.array([h(g, seed) for g in grams], dtype=">u8")
            counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        out.append(int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big", signed=True))
    return out


def fingerprint_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """Rows (id, fp) for every row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):  # few texts as Python objects at a time
                part = batch.slice(at, 256)
                fps = fingerprints(part.column(1).to_pylist(), shingle, seed)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fps, pa.int64())], ["id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, "id long, fp long")


def _grid(fps: DataFrame) -> DataFrame:
    """Rows (cell, fp): each fingerprint at its own grid point and those one step away within the grid."""
    counts = [F.bit_count(F.shiftrightunsigned("fp", WIDTH * i).bitwiseAND(F.lit((1 << WIDTH) - 1))) for i in range(SEGMENTS)]
    base = sum((F.shiftleft(c.cast("long"), 3 * i) for i, c in enumerate(counts)), F.lit(0).cast("long"))
    steps = [F.lit(0).cast("long")]
    for i, c in enumerate(counts):
        steps += [F.when(c < WIDTH, F.lit(1 << (3 * i)).cast("long")), F.when(c > 0, F.lit(-(1 << (3 * i))).cast("long"))]
    return fps.select("fp", base.alias("base"), F.array_compact(F.array(*steps)).alias("steps")).select("fp", "base", F.explode("steps").alias("step")).select((F.col("base") + F.col("step")).alias("cell"), "fp")


def links(fps: DataFrame, max_bits: int = 2) -> DataFrame:
    """Edges (a, b) that connect exactly the distinct fingerprints (column fp) within ``max_bits`` <= 2 bits."""
    if not 0 <= max_bits <= 2:
        raise ValueError("the grid of unit steps covers distances up to 2")
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits
    grid = _grid(fps)
    crowds = cut(grid.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "simhash-cells")
    shared = cut(grid.join(crowds, "cell"), "simhash-grid")
    few = shared.where(F.col("n") <= CROWD)
    pairs = few.select("cell", F.col("fp").alias("a")).join(few.select("cell", F.col("fp").alias("b")), "cell").where((F.col("a") < F.col("b")) & close).select("a", "b").distinct()
    many = shared.where(F.col("n") > CROWD).select("fp").distinct()
    flips = F.array(F.lit(0).cast("long"), *[F.lit((1 << i) - (1 << 64 if i == 63 else 0)).cast("long") for i in range(64)])
    near = cut(many.select("fp", F.explode(flips).alias("flip")).select(F.col("fp").bitwiseXOR(F.col("flip")).alias("word"), "fp"), "simhash-words")
    centre = near.groupBy("word").agg(F.min("fp").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1").select("word", "b")
    if max_bits == 2:
        stars = near.join(centre, "word").select(F.col("fp").alias("a"), "b")
    else:  # words are shared at distance 2; closer links meet at one of the two themselves
        stars = near.join(many.select(F.col("fp").alias("word")), "word", "left_semi").select(F.col("fp").alias("a"), F.col("word").alias("b"))
    return pairs.union(stars.where((F.col("a") != F.col("b")) & close).distinct())


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_bits: int = 2, seed: int = 42) -> DataFrame:
    """Rows (id, fp, component): every row of ``docs`` with its fingerprint and the smallest id of its component.

    Texts that are null or hold no word share fingerprint zero and so one component. A null id keeps its row and
    never becomes a component's id; a component without any id has a null one. An empty table gives no rows.
    """
    prints = cut(fingerprint_table(docs, id_col, text_col, shingle, seed), "simhash-prints")
    distinct = cut(prints.groupBy("fp").agg(F.min("id").alias("least")), "simhash-distinct")
    labels = components(links(distinct.select("fp"), max_bits))
    grouped = labels.select(F.col("node").alias("fp"), "label").join(distinct, "fp")
    least = grouped.groupBy("label").agg(F.min("least").alias("group_least"))
    named = cut(grouped.select("fp", "label").join(least, "label").select("fp", "group_least"), "simhash-named")
    known = distinct.join(named, "fp", "left").select("fp", F.coalesce("group_least", "least").alias("component"))
    return prints.join(cut(known, "simhash-known"), "fp").select("id", "fp", "component")


#: Windows of a document and shingles on either side of a window's middle; documents of a bucket that are paired off.
SEEDS, REACH, CROWD_DOCS = 8, 4, 24
#: Pivots of a crowd, about: most families of near copies hang together after them.
PIVOTS = 4
#: Documents on either side that one task compares of a crowd that doesn't.
BLOCK = 4096
#: Documents whose shingles are counted to order all others', and the shingles that are sent as common ones.
COUNTED, COMMON = 10_000, 200_000
_SPREAD = np.array([0x9E3779B97F4A7C15 * (2 * i + 1) % (1 << 64) for i in range(64)], np.uint64)


def _grams(text: bytes | None, shingle: int, seed: int) -> np.ndarray:
    """The hashes of a text's shingles in order, of the words of ``fingerprints``; a text without words has that of none."""
    words = text.lower().split() if text else []
    n = max(1, len(words) - shingle + 1)
    h = xxhash.xxh64_intdigest
    found = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)) if len(words) >= shingle else [b" ".join(words)]
    return np.fromiter((h(g, seed) for g in found), np.uint64, n)


def _prints(grams: np.ndarray, seeds: int = SEEDS, reach: int = REACH) -> np.ndarray:
    """SimHashes of the whole text and, after it, of the windows around each seed's first shingle."""
    mixed = grams[:, None] ^ _SPREAD[None, :seeds]
    mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    middle = (mixed ^ (mixed >> np.uint64(29))).argmin(axis=0)
    at = np.clip(middle[:, None] + np.arange(-reach, reach + 1), 0, len(grams) - 1)
    bits = np.unpackbits(grams[at].astype(">u8").view(np.uint8).reshape(seeds, 2 * reach + 1, 8), axis=2).sum(axis=1, dtype=np.int64)
    counts = sum((np.unpackbits(grams[k : k + 65536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64) for k in range(0, len(grams), 65536)), np.zeros(64, np.int64))
    packed = np.packbits(np.concatenate([2 * counts[None] > len(grams), 2 * bits > 2 * reach + 1]), axis=1)
    return packed.view(">u8").ravel().astype(np.uint64).view(np.int64)


def _signature(grams: np.ndarray) -> np.ndarray:
    """One byte of the least hash under each of 64 seeds, as eight longs: bytes agree as often as sets overlap, or a little more."""
    least = np.full(64, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(grams), 4096):
        mixed = (grams[k : k + 4096, None] ^ _SPREAD[None, :]) * np.uint64(0xBF58476D1CE4E5B9)
        np.minimum(least, (mixed ^ (mixed >> np.uint64(32))).min(axis=0), out=least)
    least = least * np.uint64(0x9E3779B97F4A7C15)
    return (least >> np.uint64(56)).astype(np.uint8).view(np.int64)


def _by_text(rows: DataFrame, of, kind: str) -> DataFrame:
    """Rows (row, values) where ``of`` makes an array of longs of each text; rows: row and text as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                values = [of(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(values, pa.list_(pa.int64()))], ["row", kind])
            pa.default_memory_pool().release_unused()

    return rows.mapInArrow(run, f"row long, {kind} array<long>")


#: Bytes of two signatures that must agree for the texts to be compared, as a share of the similarity asked for.
AGREE = 0.55


def _verified(pairs: DataFrame, grams: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets of shingles have a Jaccard similarity of at least ``similarity``.

    grams: row, n, sig and grams. Sizes and signatures of 64 bytes, which travel first, rule out pairs that are far from
    similar (a pair at 0.8 agrees in fewer than 28 of 64 bytes once in ten billion cases); the rest is decided exactly, and
    only shingles of documents in a pair that is left are shuffled.
    """
    near = pairs.distinct()
    for c in ("a", "b"):
        near = near.join(grams.select(F.col("row").alias(c), F.col("n").alias(f"n{c}"), F.col("sig").alias(f"s{c}")), c)
    near = near.where(F.least("na", "nb") >= F.greatest("na", "nb") * (similarity - 1e-12))
    same = lambda x, y: sum((F.shiftrightunsigned(x.bitwiseXOR(y), 8 * i).bitwiseAND(F.lit(255)) == 0).cast("int") for i in range(8))
    agree = F.aggregate(F.zip_with("sa", "sb", same), F.lit(0), lambda s, x: s + x)
    near = cut(near.where(agree >= int(64 * similarity * AGREE)).select("a", "b"), "near-pairs")
    sides = [perhaps_in(grams, "row", near.select(F.col(c).alias("row")).distinct()).select(F.col("row").alias(c), F.col("grams").alias(f"g{c}")) for c in ("a", "b")]
    both = near.join(sides[0], "a").join(sides[1], "b")
    na, nb = F.size("ga"), F.size("gb")
    common = F.size(F.array_intersect("ga", "gb"))
    return both.where(common >= (na + nb - common) * (similarity - 1e-12)).select("a", "b")


def similar_groups(rows: DataFrame, shingle: int = 5, similarity: float = 0.8, seed: int = 42) -> DataFrame:
    """Rows (row, label) of the documents that are similar to another one; label is the smallest row of their group.

    rows: row (long, distinct) and text. Groups are the components of the pairs whose sets of ``shingle``-word shingles
    have a Jaccard similarity of at least ``similarity``; texts without words are alike. Every pair reported is exact;
    pairs are found with the probability above, by fingerprints within two bits or windows they share.

    Documents of a bucket of up to ``CROWD_DOCS`` are paired off. In a larger one all are compared with a few pivots, after
    which a family of near copies hangs together. Documents of buckets that are still apart then (texts that share a
    passage and little else) are dealt anew by prefixes: with all shingles in one order, common ones last, two similar
    texts share one of the first n - ceil(similarity n) + 1 of either. The order is that of a bounded sample's counts; it
    decides how many meet and never which pairs are found. Pairs settle these buckets, and in crowds the documents outside
    the largest group are compared with all others, in blocks; documents that hang together aren't, and none is left out.
    """
    texts = rows.select("row", F.col("text").cast("binary").alias("text"))
    prints = cut(_by_text(texts, lambda t: _prints(_grams(t, shingle, seed)), "fps"), "prints")
    whole = cut(prints.select("row", F.col("fps")[0].alias("fp")), "whole-prints")
    near = components(links(cut(whole.select("fp").distinct(), "distinct-prints")))
    of_whole = whole.join(near.select(F.col("node").alias("fp"), "label"), "fp", "left").select("row", F.xxhash64(F.lit("whole"), F.coalesce("label", "fp")).alias("key"))
    windows = F.array_distinct(F.slice("fps", 2, SEEDS))
    of_window = prints.select("row", F.explode(windows).alias("fp")).select("row", F.xxhash64(F.lit("window"), "fp").alias("key"))
    shared = _shared(of_whole.union(of_window).withColumn("label", F.col("row")))

    def signed(text: bytes | None) -> np.ndarray:
        found = np.unique(_grams(text, shingle, seed))
        return np.concatenate([_signature(found), found.view(np.int64)])

    grams = _by_text(perhaps_in(texts, "row", shared.select("row").distinct()), signed, "values")
    grams = cut(grams.select("row", (F.size("values") - 8).alias("n"), F.slice("values", 1, 8).alias("sig"), F.slice("values", F.lit(9), F.size("values")).alias("grams")), "grams")
    crowd = shared.where(F.col("n") > CROWD_DOCS)
    pivots = crowd.where(_share("row") * F.col("n") < PIVOTS).select("key", F.col("row").alias("p"))
    met = crowd.join(pivots, "key").where("row <> p").select(F.least("row", "p").alias("a"), F.greatest("row", "p").alias("b"))
    edges = cut(_verified(_pairs(shared).union(met), grams, similarity), "similar")
    labels = components(edges)
    if crowd.isEmpty():
        return labels.select(F.col("node").alias("row"), "label")
    labels = cut(labels.select(F.col("node").alias("row"), "label"), "similar-labels")
    apart = cut(_apart(crowd.select("row", "key"), labels).select("row", "label").distinct(), "apart")
    n = apart.count()
    if not n:
        return labels
    sets = perhaps_in(grams, "row", apart.select("row")).select("row", "grams")
    prefixes = _prefixes(sets, _common(sets.where(_share("row") * n < COUNTED)), similarity)
    shared = _shared(prefixes.join(apart, "row").select("row", "label", F.explode("prefix").alias("key")))
    found = _verified(_pairs(shared), grams, similarity)
    crowd = _apart(shared.where(F.col("n") > CROWD_DOCS).select("row", "key"), labels)
    edges = edges.union(found).union(_outside(crowd, sets, similarity))
    return components(edges).select(F.col("node").alias("row"), "label")


def _share(column: str):
    """A number in [0, 1) by hash, the same wherever the value occurs."""
    return F.shiftrightunsigned(F.xxhash64(F.col(column), F.lit("share")), 11) / F.lit(float(1 << 53))


def _shared(keys: DataFrame) -> DataFrame:
    """Rows (row, label, key, n) of the keys, of rows (row, label, key), that n rows of more than one label share."""
    keys = cut(keys, "keys")
    several = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("key", "n")
    return cut(keys.join(several, "key"), "shared-keys")


def _pairs(shared: DataFrame) -> DataFrame:
    """The pairs (a, b) of two labels in keys of few rows."""
    few = shared.where(F.col("n") <= CROWD_DOCS)
    one, other = (few.select("key", F.col("row").alias(c), F.col("label").alias(f"l{c}")) for c in "ab")
    return one.join(other, "key").where("a < b and la <> lb").select("a", "b")


def _common(sets: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The commonest shingles of ``sets``, ascending, and the number of sets that hold each."""
    counts = sets.select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    found = counts.orderBy(F.desc("n"), "gram").limit(COMMON).toArrow()
    gram, n = (found.column(c).to_numpy() for c in ("gram", "n"))
    order = np.argsort(gram)
    return gram[order], n[order]


def _prefixes(sets: DataFrame, common: tuple[np.ndarray, np.ndarray], similarity: float) -> DataFrame:
    """Rows (row, prefix): the first shingles of each set by count and hash; two sets as similar as asked share one."""
    sent = send(sets.sparkSession, common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = pickle.loads(sent.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part, found = batch.slice(at, 256), []
                for value in part.column(1):
                    grams = value.values.to_numpy()
                    n = np.zeros(len(grams), np.int64)
                    if len(known):
                        spot = np.minimum(np.searchsorted(known, grams), len(known) - 1)
                        n = np.where(known[spot] == grams, counts[spot], 0)
                    most = len(grams) - int(np.ceil(len(grams) * similarity - 1e-9)) + 1
                    found.append(grams[np.lexsort((grams, n))[:most]])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.list_(pa.int64()))], ["row", "prefix"])

    return sets.mapInArrow(run, "row long, prefix array<long>")


def _apart(crowd: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (row, key, label, largest, all, others) of the crowds, of rows (row, key), that aren't one group by labels (row, label)."""
    at = cut(crowd.join(labels, "row", "left").withColumn("label", F.coalesce("label", "row")), "crowd-labels")
    sizes = at.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"))
    top = sizes.groupBy("key").agg(F.max(F.struct("n", "label")).alias("top"), F.sum("n").alias("all")).where(F.col("all") > F.col("top.n"))
    return cut(at.join(top.select("key", F.col("top.label").alias("largest"), "all", (F.col("all") - F.col("top.n")).alias("others")), "key"), "crowd-open")


def _outside(crowd: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Edges (a, b) between the documents of each crowd that are outside its largest group and similar ones of other groups.

    crowd: as ``_apart`` has it. Of a document's similar ones in a block each group gives one. A crowd of n documents is
    dealt over n / BLOCK tasks, times as many as those outside need; a task holds at most some 2 BLOCK documents.
    """
    blocks = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    here = lambda n: F.pmod(F.xxhash64("row", F.lit(n)), blocks(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), blocks(n) - 1))
    home = crowd.select("row", "key", "label", F.lit(False).alias("guest"), here("all").alias("i"), every("others").alias("j"))
    guests = crowd.where("label <> largest").select("row", "key", "label", F.lit(True).alias("guest"), every("all").alias("i"), here("others").alias("j"))
    least = similarity - 1e-12

    def run(met: pa.Table) -> pa.Table:
        guest = met.column("guest").to_numpy()
        row, label = met.column("row").to_numpy(), met.column("label").to_numpy()
        grams = met.column("grams").combine_chunks()
        starts = np.concatenate([[0], np.cumsum([len(g) for g in grams])])
        words, ids = np.unique(grams.flatten().to_numpy(), return_inverse=True)
        at = np.flatnonzero(~guest)
        a, b = [], []
        if len(at):
            sizes = starts[at + 1] - starts[at]
            own = np.concatenate([ids[starts[k] : starts[k + 1]] for k in at])
            ends = np.cumsum(sizes) - sizes
            for k in np.flatnonzero(guest):
                mine = np.zeros(len(words), np.int32)
                mine[ids[starts[k] : starts[k + 1]]] = 1
                common = np.add.reduceat(mine[own], ends)
                hits = at[(common >= (sizes + (starts[k + 1] - starts[k]) - common) * least) & (label[at] != label[k])]
                one = hits[np.unique(label[hits], return_index=True)[1]]
                a += [row[k]] * len(one)
                b += row[one].tolist()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    dealt = home.union(guests).join(sets, "row").select("key", "i", "j", "row", "label", "guest", "grams")
    return dealt.groupBy("key", "i", "j").applyInArrow(run, "a long, b long")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, seed: int = 42) -> DataFrame:
    """``docs`` with one document of each of ``similar_groups``: the one with the smallest id; columns unchanged.

    Ids may be of any type that has an order; a null id comes last. Of rows that share the smallest id the first one as
    the table is written stays. An empty table stays empty; columns may have any names.
    """
    names = docs.columns
    named = cut(docs.toDF(*[f"c{i}" for i in range(len(names))]).withColumn("row", F.monotonically_increasing_id()), "simhash-rows")
    key = F.col(f"c{names.index(id_col)}")
    labels = cut(similar_groups(named.select("row", F.col(f"c{names.index(text_col)}").alias("text")), shingle, similarity, seed), "groups")
    ids = perhaps_in(named.select("row", key.alias("id")), "row", labels.select("row"))
    members = cut(labels.join(ids, "row").withColumn("order", F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("row").alias("row"))), "members")
    gone = members.join(members.groupBy("label").agg(F.min("order").alias("first")), "label").where(F.col("row") != F.col("first.row")).select("row")
    return named.join(gone, "row", "left_anti").select(*[F.col(f"c{i}") for i in range(len(names))]).toDF(*names)


def op10_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_groups(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))
