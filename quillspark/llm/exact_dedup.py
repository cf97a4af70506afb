"""Exact deduplication as a stateful stream.

Texts are equal when they are the same after deleting ``[ \\t-\\r]``.  Of equal
texts the row with the most code points in the original text stays, then the
one with the smallest id.

1. A digest table (row number, id, code points, SHA-256 of the normalised text)
   is written to the shared folder.  A row's number is the same on every reading
   (see ``shared.numbered``), so later steps find rows by it.
2. A Structured Streaming query reads it and keeps keyed state in RocksDB, on
   disk, without a watermark, so nothing expires: per digest the number of rows,
   the stable identifier of the row to keep, and its locator (row number and
   length).  Spark's stateful aggregation combines rows within each task before
   the shuffle, so a text with any number of copies sends one row per task.
   ``deduplicate_stream`` keeps the state between calls: new files that appear
   in the digest table's folder are all that a later run reads.
3. On hits (groups of several rows) the bytes are compared: each row's
   normalised text against that of the row its group keeps.  Rows that differ
   although their digests agree are put in groups of their own, by full text.

Defined cases: null text counts as empty, and empty texts equal each other;
null ids order after all others; of repeated rows (same id, same text) exactly
one is kept; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

#: Digests of groups with several rows are shipped to all tasks up to this many (about 10 MB); beyond, a shuffle finds them.
SHIPPED = 100_000
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "64",
    "spark.sql.streaming.stateStore.maintenanceInterval": "10s",  # an executor lets go of its stores this long after the query
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "4",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}
#: Digests of a state store, where there are few and where there are many; a store of the latter takes about 300 MB of disk.
FEW, MANY = 50_000, 2_000_000


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[ \\t-\\r]+", "")


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _digests(rows: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    return rows.select("uid", "doc_id", F.coalesce(F.char_length("text"), F.lit(0)).alias("n_cp"), digest(normalised(F.col("text"))).alias("digest"))


def _best() -> Column:
    """The row to keep: most code points, then the smallest id, then the smallest row number."""
    return F.max(F.struct("n_cp", F.col("doc_id").isNotNull().alias("known"), (-F.col("doc_id")).alias("order"), (-F.col("uid")).alias("late")))


def state_stores(rows: int, tasks: int) -> int:
    """How many stores the state of a table of so many rows is dealt to: as many as tasks usually are, but fewer for few rows and more for very many."""
    return max(1, min(tasks, -(-rows // FEW)), -(-rows // MANY))


def deduplicate_stream(digests: DataFrame, path: str, folder: str) -> DataFrame:
    """Bring the state below ``folder`` up to date with the digest table at ``path``; the state of all digests.

    Each micro-batch appends the groups that it changed; the state is their last version.
    The first run settles the number of stores by the rows that it sees.
    """
    spark = digests.sparkSession
    own = spark.newSession()
    for k, v in STATE_CONF.items():
        own.conf.set(k, v)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    own.conf.set("spark.sql.shuffle.partitions", str(state_stores(spark.read.schema(digests.schema).parquet(path).count(), tasks)))

    def append(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("version", F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(f"{folder}/state/batch={batch_id}")

    grouped = own.readStream.schema(digests.schema).parquet(path).groupBy("digest").agg(F.count("*").alias("group_size"), _best().alias("best"))
    query = grouped.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/stream").trigger(availableNow=True).foreachBatch(append).start()
    query.awaitTermination()
    schema = f"digest string, group_size long, best struct<n_cp:int,known:boolean,order:bigint,late:bigint>, version long"
    state = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{folder}/state")
    if query.lastProgress is not None and query.lastProgress["batchId"] > 0:
        state = state.groupBy("digest").agg(F.max_by(F.struct("group_size", "best"), "version").alias("s")).select("digest", "s.*")
    return state.select("digest", "group_size", (-F.col("best.order")).alias("keep_id"), (-F.col("best.late")).alias("keep_uid"))


def deduplicate(docs: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """uid, doc_id, digest, keep_id, keep_uid, group_size, kept of every row.

    ``digest`` may be a weaker one (tests use such); the result is exact with any.
    """
    folder = shared.fresh_dir(docs.sparkSession, "dedup")
    return groups_of(shared.numbered(shared.id_text(docs), folder), folder, digest)


def groups_of(rows: DataFrame, folder: str, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """The same for rows (uid, doc_id, text); only the result's table stays below ``folder``."""
    spark = rows.sparkSession
    d = shared.stored(_digests(rows, digest), f"{folder}/digests")
    if d.isEmpty():
        return d.select("uid", "doc_id", "digest", F.col("doc_id").alias("keep_id"), F.col("uid").alias("keep_uid"), F.lit(0).cast("long").alias("group_size"), F.lit(False).alias("kept"))
    state = deduplicate_stream(d, f"{folder}/digests", folder)
    several = shared.stored(state.where("group_size > 1"), f"{folder}/groups")
    n = several.count()
    collided = _compare(rows, d, several, n, digest, folder) if n else None
    # a row whose digest is in no group of several keeps itself, so only the few groups are joined
    named = d.join(F.broadcast(several) if n <= SHIPPED else several, "digest", "left")
    alone = F.col("group_size").isNull()
    found = named.select("uid", "doc_id", "digest", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("keep_uid", "uid").alias("keep_uid"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"))
    if collided is not None:
        found = found.join(collided.select("digest").distinct(), "digest", "left_anti").unionByName(collided)
    out = shared.stored(found.withColumn("kept", F.col("uid") == F.col("keep_uid")), f"{folder}/result")
    for part in ("digests", "stream", "state", "groups", "asked", "collided", "regrouped"):
        shared.remove(spark, f"{folder}/{part}")
    return out


def _compare(rows: DataFrame, digests: DataFrame, several: DataFrame, n: int, digest: Callable[[Column], Column], folder: str) -> DataFrame | None:
    """Full bytes on hits; None if all agree, else the rows of the digests where texts differ, grouped by text.

    The rows in question are found by number, so digests are not made again.
    """
    small = several.select("digest", "keep_uid")
    asked = digests.select("uid", "digest").join(F.broadcast(small) if n <= SHIPPED else small, "digest")
    asked = shared.stored(asked, f"{folder}/asked")
    m = asked.count()
    texts = rows.join(F.broadcast(asked) if m <= 3 * SHIPPED else asked, "uid").withColumn("norm", normalised(F.col("text")))
    # equal texts meet within a task first, so a large group sends one row per task and distinct text
    differing = texts.select("digest", "norm").distinct().groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest")
    bad = shared.stored(differing, f"{folder}/collided")
    if bad.isEmpty():
        return None
    wide = texts.join(bad, "digest").select("uid", "doc_id", F.coalesce(F.char_length("text"), F.lit(0)).alias("n_cp"), "digest", "norm")
    best = wide.groupBy("digest", "norm").agg(F.count("*").alias("group_size"), _best().alias("best"))
    return shared.stored(wide.join(best, ["digest", "norm"]).select("uid", "doc_id", "digest", (-F.col("best.order")).alias("keep_id"), (-F.col("best.late")).alias("keep_uid"), "group_size"), f"{folder}/regrouped")


def report(docs: DataFrame) -> DataFrame:
    return deduplicate(docs).select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def distinct_documents(docs: DataFrame) -> DataFrame:
    """``docs``, all columns, without the rows that are not kept."""
    folder, name = shared.fresh_dir(docs.sparkSession, "dedup"), shared.row_name()
    rows = shared.numbered(docs, folder, name)
    found = groups_of(rows.select(F.col(name).alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), folder)
    return shared.without(rows, name, found.where("not kept").select("uid"), f"{folder}/gone")
