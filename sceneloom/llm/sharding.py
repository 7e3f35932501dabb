"""Sharding: a two-pass external shuffle into equal shards.

Pass 1 scatters the rows by a seeded hash into buckets that fit in memory, one bucket to a
partition. Pass 2 puts each bucket in a canonical order, applies a Fisher-Yates shuffle to it
and writes it. The buckets laid end to end are one long random order, which is cut into shards whose row
counts differ by one at most (law `rows`), each numbered without gaps from 0. Where there would be more
buckets than one shuffle can have partitions, a scatter into folders comes before, and each is shuffled alone.

DataFrame functions only. Nothing but the row count of each bucket is summed over the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .common import free_name, work_dir

#: Bytes of rows that a task holds at once in pass 2. Tasks need a few times that.
BUCKET_BYTES = 16 << 20
#: Partitions of one shuffle at most. More buckets take one more scatter.
MAX_BUCKETS = 100_000


def row_size(text) -> F.Column:
    """What a row counts for: the UTF-8 bytes of its text (none for null) plus 16."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long")


def shard(docs: DataFrame, shards: int = 40, seed: int = 17, bucket_bytes: int = BUCKET_BYTES, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """All rows of docs with two new columns, shard (int, from 0) and slot (long, from 0 in each shard).

    The counts of any two shards differ by one at most; with fewer rows than shards, some shards
    are empty. The hash that scatters takes in the id and the text, so neither many rows of one
    id (or of a null id) nor many copies of one text meet in a bucket; rows equal in both meet,
    and come out as separate rows. Null and empty texts are rows like others. An empty table
    gives an empty result. Columns of docs named shard or slot make the new ones _shard or _slot.
    The result depends on the rows, the seed and the bucket size, not on how docs is laid out; but of rows equal in id and text, which
    differ in other columns only, any may have the place of the other.
    """
    shard_name, slot_name = free_name(docs, "shard"), free_name(docs, "slot")
    key = F.xxhash64(F.lit(seed), F.col(id_column), F.col(text_column))
    row = F.struct(*[F.col(c) for c in docs.columns])
    n_rows, n_bytes = docs.select(F.count(F.lit(1)), F.sum(row_size(F.col(text_column)))).first()
    buckets = max(1, -(-(n_bytes or 0) // bucket_bytes))
    scatters = -(-buckets // MAX_BUCKETS)
    bucket = F.pmod(key, F.lit(buckets))
    n_rows = max(1, n_rows)

    # Where each bucket begins in the one long order: a running sum over one row a bucket, within a scatter and over those.
    counts = docs.select(bucket.alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).withColumn("scatter", F.expr(f"bucket div {MAX_BUCKETS}"))
    within = Window.partitionBy("scatter").orderBy("bucket")
    counts = counts.select("scatter", (F.col("bucket") - F.col("scatter") * MAX_BUCKETS).cast("int").alias("bucket"), "n", (F.sum("n").over(within) - F.col("n")).alias("start"))

    def placed(own: DataFrame, scatter: int, before: int) -> DataFrame:
        starts = counts.filter(F.col("scatter") == scatter).select("bucket", "start")  # MAX_BUCKETS rows of 12 bytes at most
        here = min(MAX_BUCKETS, buckets - scatter * MAX_BUCKETS)
        inside = (bucket - scatter * MAX_BUCKETS).cast("int")
        scattered = own.select(inside.alias("bucket"), key.alias("key"), row.alias("row")).repartitionById(here, "bucket")
        shuffled = (
            scattered.sortWithinPartitions("bucket", "key", F.col(f"row.{id_column}"))
            .groupBy("bucket")
            .agg(F.collect_list("row").alias("rows"))
            .select("bucket", F.posexplode(F.shuffle("rows", seed + scatter)).alias("at", "row"))
        )
        rank = F.lit(before) + F.col("start") + F.col("at")
        found = shuffled.join(F.broadcast(starts), "bucket").select("row", (rank * shards).alias("scaled"), rank.alias("rank"))
        to = F.expr(f"scaled div {n_rows}")
        first = F.expr(f"((scaled div {n_rows}) * {n_rows} + {shards - 1}) div {shards}")
        return found.select("row.*", to.cast("int").alias(shard_name), (F.col("rank") - first).cast("long").alias(slot_name))

    if scatters == 1:
        return placed(docs, 0, 0)
    at, folder = work_dir(docs.sparkSession, "scatter"), free_name(docs, "_scatter")
    apart = docs.withColumn(folder, F.floor(bucket / MAX_BUCKETS).cast("int"))
    apart.repartition(folder, F.pmod(F.shiftright(key, 20), F.lit(64))).write.partitionBy(folder).parquet(at)
    sums = {r.scatter: r.n for r in counts.groupBy("scatter").agg(F.sum("n").alias("n")).collect()}  # a row a scatter
    found, before = None, 0
    for scatter in range(scatters):
        if scatter in sums:
            own = docs.sparkSession.read.schema(docs.schema).parquet(f"{at}/{folder}={scatter}")
            more = placed(own, scatter, before)
            found, before = more if found is None else found.unionAll(more), before + sums[scatter]
    return found


def write_shards(sharded: DataFrame, path: str, shard_column: str = "shard", slot_column: str = "slot") -> None:
    """Writes the result of shard() as it comes: one folder a shard, <shard_column>=<number>.

    A task has the rows of one bucket, which follow each other in one shard, or in few. So nothing is shuffled again; each file
    holds a run of slots in their order, and a shard's files in the order of their names hold its slots in theirs.
    """
    sharded.sortWithinPartitions(shard_column, slot_column).write.partitionBy(shard_column).parquet(path)
