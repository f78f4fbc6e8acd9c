"""Helpers that the corpus operators share: shared folders, lineage cuts, folds, connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.plans.storage import cut, shared_dir  # noqa: F401

#: A word, as the contracts define it: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, mod: int) -> Column:
    """crc32(doc_id as text) mod ``mod``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % mod


def bounded(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """At most ``rows`` rows, chosen by hash of ``keys``: the documented bound of a training sample.

    A hash threshold thins the table in the scan, so that the final top-k sorts only about twice the bound.
    """
    n = df.count()
    if n <= rows:
        return df
    h = F.xxhash64(F.lit("training sample"), *keys)
    share = min(1.0, 1.5 * rows / n + 1e-3)
    return df.where(F.pmod(h, F.lit(1 << 20)) < int(share * (1 << 20))).orderBy(h, *keys).limit(rows)


#: Edges that one task may hold: components of so few are found at once instead of by rounds.
ONE_TASK = 20_000


def _joined(batches):
    """Rows (node, to) of the edges (a, b) of one task: every node points at the smallest one it reaches."""
    import pyarrow as pa

    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    nodes = list(parent)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())], ["node", "to"])


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """Connected components of an edge list of longs: rows (node, label), label = smallest node reachable.

    Every node first points at its smallest neighbour, two pointer jumps shorten the paths, and the edges are
    contracted onto the pointers; this repeats until at most ``ONE_TASK`` edges are left, which one task settles. Each
    round is aggregates and equi-joins over what is left, written to the shared folder; nothing is collected. Self-loops and repeated edges
    are allowed; edges with a null end are dropped; a node without edges doesn't appear.
    """
    spark = edges.sparkSession
    edges = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a is not null and b is not null")
    left = cut(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    loops = edges.where("a = b").select(F.col("a").alias("node")).distinct()
    labels: DataFrame | None = None
    for _ in range(rounds):
        n = left.count()
        if not n:
            break
        if n <= ONE_TASK:
            step = cut(left.coalesce(1).mapInArrow(_joined, "node long, to long"), "step")
        else:
            both = left.union(left.select(F.col("b"), F.col("a")))
            step = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("to"))
            step = cut(step, "step")
            for _ in range(2):
                up = step.select(F.col("node").alias("to"), F.col("to").alias("up"))
                step = step.join(up, "to").select("node", F.col("up").alias("to"))
            step = cut(step, "step")
        if labels is None:
            labels = step.select("node", F.col("to").alias("label"))
        else:
            up = step.select(F.col("node").alias("label"), "to")
            labels = cut(labels.join(up, "label", "left").select("node", F.coalesce("to", "label").alias("label")), "labels")
        if n <= ONE_TASK:
            break
        ends = step.select(F.col("node").alias("a"), F.col("to").alias("pa"))
        other = step.select(F.col("node").alias("b"), F.col("to").alias("pb"))
        left = left.join(ends, "a").join(other, "b").where("pa <> pb")
        left = cut(left.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "edges")
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    alone = loops.select("node", F.col("node").alias("label"))
    if labels is None:
        return alone
    return labels.union(alone.join(labels.select("node"), "node", "left_anti"))


def perhaps_in(df: DataFrame, key: str, keys: DataFrame, least: int = 1 << 20, most: int = 1 << 28) -> DataFrame:
    """The rows of ``df`` whose ``key`` is in ``keys`` (column ``key``), and a few others: no such row is missing.

    A broadcast bitmap of eight bits or more per key, at most ``most`` bits (32 MB), keeps wide rows that an equi-join
    would throw away out of its shuffle. The join itself still has to follow.
    """
    per = 32768  # bits of one bitmap of bitmap_construct_agg
    bits = min(most, max(least, 1 << (8 * keys.count()).bit_length()))
    bit = F.pmod(F.xxhash64(key), F.lit(bits))
    bitmap = keys.groupBy((bit / per).cast("int").alias("__part")).agg(F.bitmap_construct_agg(F.pmod(bit, F.lit(per))).alias("__bits"))
    byte = F.conv(F.hex(F.substring("__bits", F.floor(F.col("__at") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    marked = df.withColumn("__part", (bit / per).cast("int")).withColumn("__at", F.pmod(bit, F.lit(per))).join(F.broadcast(bitmap), "__part")
    return marked.withColumn("__byte", byte).where(F.expr("shiftright(__byte, cast(__at % 8 as int)) & 1 = 1")).select(*[df[c] for c in df.columns])


def pieces(text: str, size: int = 1 << 20, only: str = ""):
    """``text`` in parts of about ``size`` characters, cut between a word and the white space (or ``only`` character) after it.

    No word and no run of white space is cut. Memory for one text's words then stays bounded however long it is.
    """
    at = 0
    while len(text) - at > size:
        end = at + size
        while end < len(text) and (not (text[end] in only if only else text[end].isspace()) or text[end - 1].isspace()):
            end += 1
        yield text[at:end]
        at = end
    if at < len(text):
        yield text[at:] if at else text


def text_batches(batch, rows: int = 256, chars: int = 4 << 20):
    """Slices of an Arrow batch whose column 1 is text: at most ``rows`` rows and, but for single rows, ``chars`` bytes."""
    import pyarrow as pa
    import pyarrow.compute as pc

    lengths = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist()
    start = total = 0
    for i, n in enumerate(lengths):
        if i > start and (total + n > chars or i - start >= rows):
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield batch.slice(start)
    pa.default_memory_pool().release_unused()  # workers live on beside those of the stages that follow


def give_back() -> None:
    """Return this process's freed memory to the system: Arrow's and, where the C library can, that of its heap."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def send(spark: SparkSession, value):
    """Broadcast a model, with its classes, as bytes: executors need no copy of this package."""
    from pyspark import cloudpickle

    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def received(sent):
    """What ``send`` sent, unpickled once in each Python worker."""
    import pickle

    if not hasattr(sent, "unpickled"):
        sent.unpickled = pickle.loads(sent.value)
    return sent.unpickled
