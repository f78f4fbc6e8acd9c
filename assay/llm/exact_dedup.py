"""Exact deduplication with disk-backed streaming state (operator 6, DataFrame operations only).

A Structured Streaming query reads the table in micro-batches and keeps, per SHA-256 digest, the stable identifier
and content locator (file, row index) of the row that stays, and the number of rows seen. The state lies in RocksDB
on the executors' disks with changelogs in the shared folder, has no watermark and so never expires: a copy that
arrives any number of batches later is still a hit. Digests that were hit more than once are then checked byte by
byte: the keeper's text is fetched by its locator and compared with each copy's full text. Should two different texts
share a digest, that digest's rows are grouped again by their full text, so that the result never rests on the hash.

Only texts of digests that were hit are shuffled. A bitmap of digest bits, eight or more per such digest and at most
2**28 (32 MB, so its broadcast has a proven bound), tells them apart in the scan; a false positive costs a shuffled row
and changes nothing. Beyond some 30 million digests that were hit more and more false positives are shuffled with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.functions.exprs import ident
from assay.llm.shared import cut, shared_dir

#: Bits of the bitmap, at least and at most.
BITMAP_BITS = 1 << 20, 1 << 28
#: A table is read in about so many micro-batches, none below the least size in bytes.
BATCHES, LEAST_BATCH = 4, 64 << 20
PER_BITMAP = 32768  # bits of one bitmap of bitmap_construct_agg


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _rows(df: DataFrame, id_col: str, text_col: str, digest) -> DataFrame:
    """id, text, locator and digest of each row; a null text counts as empty."""
    text, place = F.coalesce(ident(text_col), F.lit("")), df.metadataColumn("_metadata")  # also beside a column of that name
    return df.select(ident(id_col).alias("id"), text.alias("text"), place["file_path"].alias("file"), place["row_index"].alias("row"), digest(text).alias("digest"))


def _located(spark: SparkSession, path: str) -> tuple[str, dict[str, str], int]:
    """What a stream reads for the table at ``path``: a folder, options, and the table's size in bytes.

    A streaming source takes folders only; a table of one file is its folder, filtered by the file's name.
    """
    p = spark._jvm.org.apache.hadoop.fs.Path(path.rstrip("/") or "/")
    files = p.getFileSystem(spark._jsc.hadoopConfiguration())
    size = files.getContentSummary(p).getLength()
    if files.getFileStatus(p).isDirectory():
        return path, {}, size
    name = "".join(f"\\{c}" if c in "\\[]{}*?" else c for c in p.getName())
    return p.getParent().toString(), {"pathGlobFilter": name}, size


def _stream_state(spark: SparkSession, path: str, id_col: str, text_col: str, digest, max_bytes: int | None, max_files: int | None) -> DataFrame:
    """Run the stateful query over all files; returns digest, keep (id, file, row) and n as they stand at its end."""
    session = spark.newSession()
    for k, v in {
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
        "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # else every partition reserves megabytes of disk
        "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
        "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "64",
        "spark.sql.streaming.stateStore.maintenanceInterval": "5s",  # stores of a query that has ended are closed so soon
        "spark.sql.shuffle.partitions": spark.conf.get("spark.sql.shuffle.partitions"),
        "spark.sql.session.timeZone": spark.conf.get("spark.sql.session.timeZone"),
    }.items():
        session.conf.set(k, v)
    out = shared_dir(spark, "dedup-updates")
    folder, options, size = _located(spark, path)
    trigger = {"maxFilesPerTrigger": max_files} if max_files else {"maxBytesPerTrigger": max_bytes or max(LEAST_BATCH, -(-size // BATCHES))}
    reader = session.readStream.schema(spark.read.parquet(path).schema).options(**trigger, **options)
    rows = _rows(reader.parquet(folder), id_col, text_col, digest).select("digest", F.struct("id", "file", "row").alias("keep"))
    state = rows.groupBy("digest").agg(F.max("keep").alias("keep"), F.count(F.lit(1)).alias("n"))
    empty = state.schema

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")  # a repeated batch overwrites itself

    query = (
        state.writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", shared_dir(spark, "dedup-state")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    spark.createDataFrame([], empty).write.mode("overwrite").parquet(f"{out}/batch=-1")
    # Both values only grow from batch to batch, so the last state is the largest.
    return spark.read.schema(empty).option("basePath", out).parquet(out).groupBy("digest").agg(F.max("keep").alias("keep"), F.max("n").alias("n"))


def exact_dedup(spark: SparkSession, path: str, id_col: str = "doc_id", text_col: str = "text", digest=sha256, max_bytes_per_trigger: int | None = None, max_files_per_trigger: int | None = None) -> DataFrame:
    """Groups of rows of the Parquet table at ``path`` whose texts are equal byte for byte.

    One row per input row: id, file and row (its locator), keep_id, group_size, kept, digest. Of equal texts the row
    with the largest id stays; among rows with equal ids the one with the largest locator, so exactly one row stays
    per text. Null texts count as empty; a null id is smaller than any other; an empty table gives no rows; other
    columns, whatever their names, aren't read. ``digest`` may be any column function: equal bytes are what decides.
    By default the stream takes a quarter of the table at a time, so that later batches find the state of earlier ones.
    """
    groups = _stream_state(spark, path, id_col, text_col, digest, max_bytes_per_trigger, max_files_per_trigger)
    multi = cut(groups.where("n > 1").select("digest", "keep", "n"), "dedup-multi")
    least, most = BITMAP_BITS
    bits = min(most, max(least, 1 << (8 * multi.count()).bit_length()))
    _bit = lambda digest: F.pmod(F.xxhash64(digest), F.lit(bits))
    bitmap = multi.groupBy((_bit(F.col("digest")) / PER_BITMAP).cast("int").alias("part")).agg(
        F.bitmap_construct_agg(F.pmod(_bit(F.col("digest")), F.lit(PER_BITMAP))).alias("bits")
    )
    rows = _rows(spark.read.parquet(path), id_col, text_col, digest)
    at = F.pmod(F.col("bit"), F.lit(PER_BITMAP))
    byte = F.conv(F.hex(F.substring("bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    marked = (
        rows.withColumn("bit", _bit(F.col("digest")))
        .withColumn("part", (F.col("bit") / PER_BITMAP).cast("int"))
        .join(F.broadcast(bitmap), "part", "left")
        .withColumn("byte", byte)
        .withColumn("hit", F.expr("coalesce(shiftright(byte, cast(bit % 8 as int)) & 1, 0) = 1"))
        .select("id", "file", "row", "digest", F.when(F.col("hit"), F.col("text")).alias("text"))
    )
    keepers = marked.where("text is not null").join(
        multi.select(F.col("digest"), F.col("keep.file").alias("file"), F.col("keep.row").alias("row")), ["digest", "file", "row"]
    ).select("digest", F.col("text").alias("keep_text"))
    known = cut(multi.join(keepers, "digest", "left"), "dedup-keepers")
    checked = cut(
        marked.join(known, "digest", "left").select(
            "id", "file", "row", "digest",
            F.coalesce(F.col("text") == F.col("keep_text"), F.col("n").isNull()).alias("same"),
            F.when(F.col("n").isNull(), F.struct("id", "file", "row")).otherwise(F.col("keep")).alias("keep"),
            F.coalesce("n", F.lit(1)).alias("n"),
        ),
        "dedup-checked",
    )
    clash = cut(checked.where("not same").select("digest").distinct(), "dedup-clash")
    if not clash.isEmpty():  # different texts under one digest: those digests are grouped by their bytes
        texts = rows.join(clash, "digest", "left_semi")
        exact = texts.groupBy("digest", "text").agg(F.max(F.struct("id", "file", "row")).alias("keep"), F.count(F.lit(1)).alias("n"))
        again = texts.join(exact, ["digest", "text"]).select("id", "file", "row", "digest", F.lit(True).alias("same"), "keep", "n")
        checked = checked.join(clash, "digest", "left_anti").unionByName(again)
    mine = (F.col("keep.file") == F.col("file")) & (F.col("keep.row") == F.col("row"))
    return checked.select("id", "file", "row", F.col("keep.id").alias("keep_id"), F.col("n").alias("group_size"), mine.alias("kept"), "digest")


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that ``exact_dedup`` drops; the columns stay as they are, whatever their names.

    The frame is written to the shared folder first, for a stream reads files, under names of its own.
    """
    spark, names = docs.sparkSession, docs.columns
    path = shared_dir(spark, "dedup-input")
    docs.toDF(*[f"c{i}" for i in range(len(names))]).write.parquet(path)
    dropped = exact_dedup(spark, path, f"c{names.index(id_col)}", f"c{names.index(text_col)}").where("not kept").select("file", "row")
    rows = spark.read.parquet(path)
    place = rows.metadataColumn("_metadata")
    kept = rows.select("*", place["file_path"].alias("file"), place["row_index"].alias("row")).join(dropped, ["file", "row"], "left_anti")
    return kept.select(*[F.col(f"c{i}") for i in range(len(names))]).toDF(*names)


def op6_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup(spark, f"{sf_dir}/documents.parquet")
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP6_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
