"""A change feed verified batch by batch, and the status fold on a stream."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from claimgrid.operators import extract, normalize, pairing
from claimgrid.session import prepare

BUCKETS = 64
# Rows of a bucket that one task writes.
ROWS_PER_FILE = 250_000
# Rows that one task writes, whichever buckets they are in.
ROWS_AT_ONCE = 20_000


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("session_id"), F.lit(buckets)).cast("int")


def _bucketed(rows: DataFrame, buckets: int) -> DataFrame:
    return rows.withColumn("bucket", _bucket(buckets))


def _sizes(rows: DataFrame) -> dict[int, int]:
    """Rows of each bucket; at most one row a bucket comes to the driver."""
    return {r["bucket"]: r["count"] for r in rows.groupBy("bucket").count().collect()}


def _file(sizes: dict[int, int], bucket: Column, key: list[str], per_file: int) -> Column:
    """Which of the files of its bucket a row goes to: as many as the counted rows need, dealt by ``key``."""
    if not sizes:
        return F.lit(0)
    files = F.create_map(*[F.lit(x) for b, n in sizes.items() for x in (b, -(-n // per_file))])
    return F.pmod(F.xxhash64(*key), F.element_at(files, bucket)).cast("int")


def _table(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at ``path``, None while nothing has been written there."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def _folder(spark: SparkSession, path: str):
    """``path`` and its file system."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def _replace(rows: DataFrame, path: str, numbers: list[int], per_file: int = ROWS_PER_FILE) -> None:
    """Replace the buckets ``numbers`` by those of ``rows`` and leave all others.

    A bucket is written by as many tasks as its counted rows need, so a hot session is
    not one task. A bucket without rows loses its folder, because the dynamic
    overwrite only touches folders that it writes to.
    """
    spark = rows.sparkSession
    sizes = _sizes(rows)
    if sizes:
        dealt = rows.withColumn("_file", _file(sizes, F.col("bucket"), rows.columns, per_file))
        (
            dealt.repartition(sum(-(-n // per_file) for n in sizes.values()), "bucket", "_file").drop("_file")
            .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("bucket").parquet(path)
        )
    for number in set(numbers) - set(sizes):
        place, system = _folder(spark, f"{path}/bucket={number}")
        system.delete(place, True)


def _publish(spark: SparkSession, work: str, path: str, numbers: list[int]) -> None:
    """Put the bucket folders that were written under ``work`` in place of those under ``path``, as a dynamic overwrite does."""
    top, system = _folder(spark, path)
    system.mkdirs(top)
    for number in numbers:
        old, new = (_folder(spark, f"{at}/bucket={number}")[0] for at in (path, work))
        system.delete(old, True)
        if system.exists(new) and not system.rename(new, old):
            raise OSError(f"{new} could not be moved to {old}")


def _written(rows: DataFrame, path: str, *folders: str) -> DataFrame:
    rows.write.mode("overwrite").option("compression", "zstd").partitionBy(*folders).parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def verify_batch(
    units: DataFrame, batch_id: int, root: str, source_type: str = "CODE_DIFF", buckets: int = BUCKETS
) -> None:
    """Add a batch of units to the claim table and bring the conflicts up to date.

    Claims and pairs are one table each, stored by session bucket; a batch reads and
    replaces the buckets of its sessions only. Claims carry their batch, so a repeated
    batch replaces itself. A new claim opens a value of its group or joins one, whose
    first claim and number of claims may change with it. So the values that the batch
    names are the changed ones: their old pairs are taken back, and they are paired
    anew with each other and with the other values of their groups. Pairs of all
    other values stay as they are, and what is formed grows with the batch.
    ``buckets`` is fixed for a feed.

    The shuffle of the extraction brings the claims of a bucket together, so they are
    written once, as they are kept. Pairs carry no texts; ``current_conflicts`` reads
    these from the claims.
    """
    spark = prepare(units.sparkSession)
    work = f"{root}/_work"
    sizes = _sizes(_bucketed(units.select("session_id"), buckets))
    numbers = list(sizes)
    place = _file(sizes, _bucket(buckets), extract.UNIT_KEY, ROWS_PER_FILE)
    found = extract.claims(units, source_type, deal={"bucket": _bucket(buckets), "_file": place})
    new = normalize.normalize(found).drop("_file").withColumn("batch_id", F.lit(batch_id).cast("long"))
    before = _table(spark, f"{root}/claims")
    kept, n = new, sum(sizes.values())
    if before is not None:
        old = before.filter(F.col("bucket").isin(numbers)).select(new.columns)
        others = old.filter(F.col("batch_id") != batch_id)
        held = _sizes(others)
        kept, n = new.unionByName(others.repartition("bucket", _file(held, F.col("bucket"), extract.UNIT_KEY, ROWS_PER_FILE))), n + sum(held.values())
    kept = _written(kept.coalesce(1) if n <= ROWS_AT_ONCE else kept, f"{work}/claims", "bucket")
    if before is None:  # every value is a changed one, and there is no pair yet
        merged = pairing.pairable(pairing.merge_claims(kept, texts=False))
        pairs = pairing.contradicting_pairs(_written(merged, f"{work}/marked"), stored=True)
    else:
        new, repeated = kept.filter(F.col("batch_id") == batch_id), old.filter(F.col("batch_id") == batch_id)
        renewed = new.unionByName(repeated.select(new.columns))
        changed = _written(renewed.select(*pairing.MERGE_KEY).distinct(), f"{work}/changed")
        groups = renewed.select(*pairing.GROUP_KEY).distinct()
        # The groups of new claims are all wanted, so only older ones are looked up.
        older = kept.filter(F.col("batch_id") != batch_id).join(groups, pairing.GROUP_KEY, "left_semi")
        merged = pairing.pairable(pairing.merge_claims(new.unionByName(older.select(new.columns)), texts=False))
        mark = changed.withColumn("changed", F.lit(True))
        marked = merged.join(mark, pairing.MERGE_KEY, "left").withColumn("changed", F.coalesce("changed", F.lit(False)))
        pairs = pairing.changed_pairs(_written(marked, f"{work}/marked"), stored=True)
    pairs = _bucketed(pairing.ruled(pairs), buckets)
    shown = None if before is None else _table(spark, f"{root}/pairs")
    if shown is not None:
        stays = shown.filter(F.col("bucket").isin(numbers)).select(pairs.columns)
        for side in ("l", "r"):
            gone = changed.withColumnRenamed("canonical_predicate", f"{side}_predicate")
            stays = stays.join(gone, ["session_id", "canonical_subject", f"{side}_predicate"], "left_anti")
        pairs = pairs.unionByName(stays.select(pairs.columns))
    pairs = _written(pairs, f"{work}/pairs")
    _publish(spark, f"{work}/claims", f"{root}/claims", numbers)
    _replace(pairs, f"{root}/pairs", numbers)


def verify_stream(
    units: DataFrame, root: str, checkpoint: str, available_now: bool = False
) -> StreamingQuery:
    """Start the feed. ``units`` has the columns of ``extract.build_units``."""
    writer = (
        units.writeStream.foreachBatch(lambda df, batch_id: verify_batch(df, batch_id, root))
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
    )
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def current_conflicts(spark: SparkSession, root: str, texts: bool = True) -> DataFrame:
    """Conflicts of each session as of the last batch that touched it, with the texts of their claims if ``texts``."""
    pairs = _table(spark, f"{root}/pairs")
    if pairs is None:  # no bucket has a pair; the last batch's empty table has the columns
        pairs = spark.read.parquet(f"{root}/_work/pairs").limit(0)
    found = pairing.first_per_id(pairs.drop("bucket"), stored=True)
    claims = _table(spark, f"{root}/claims") if texts else None
    return found if claims is None else pairing.with_texts(found, claims)


def _folded(rows: DataFrame) -> DataFrame:
    """One row a session from partial folds: the status with the last (time, event id), and all events."""
    place = F.struct("updated_at", "event_id")
    return rows.groupBy("session_id").agg(
        F.max_by("status", place).alias("status"), F.max(place).alias("place"), F.sum("n_events").alias("n_events")
    ).select("session_id", "status", "place.*", "n_events")


def fold_status(events: DataFrame, batch_id: int, table: str) -> None:
    """Add a batch of ``events(session_id, event_id, ts, status)`` to the status log, folded to one row a session.

    A batch replaces its own part when it is repeated. Parts say which time and event
    id their status has, so batches may come in any order and late events never win.
    """
    part = events.select("session_id", "status", F.col("ts").alias("updated_at"), "event_id", F.lit(1).cast("long").alias("n_events"))
    _folded(part).write.mode("overwrite").parquet(f"{table}/log/batch_id={batch_id}")


def _log_parts(spark: SparkSession, table: str) -> tuple[list[int], list[int]]:
    """Batches up to which compacted tables reach, and the batches in the log."""
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()

    def numbers(folder: str, mark: str) -> list[int]:
        place = jvm.org.apache.hadoop.fs.Path(folder)
        system = place.getFileSystem(conf)
        if not system.exists(place):
            return []
        done = [s.getPath() for s in system.listStatus(place) if s.getPath().getName().startswith(mark)]
        # A part counts once its job has committed.
        return sorted(int(p.getName().removeprefix(mark)) for p in done if system.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    return numbers(f"{table}/compact", "upto="), numbers(f"{table}/log", "batch_id=")


def current_status(spark: SparkSession, table: str) -> DataFrame:
    """One row a session: the last compacted table, and the log parts after it."""
    compacted, log = _log_parts(spark, table)
    upto = compacted[-1] if compacted else -1
    paths = [*([f"{table}/compact/upto={upto}"] if compacted else []), *(f"{table}/log/batch_id={b}" for b in log if b > upto)]
    if not paths:
        raise FileNotFoundError(f"no status has been written to {table}")
    return _folded(spark.read.parquet(*paths))


def compact_status(spark: SparkSession, table: str) -> None:
    """Fold the log into one table and delete what it covers.

    The new table is committed before anything is deleted, and readers take the last
    committed one with the parts after it, so a lost compaction loses and repeats nothing.
    Parts of a batch are complete when the next batch begins, as a stream's are.
    """
    compacted, log = _log_parts(spark, table)
    upto = compacted[-1] if compacted else -1
    if not log or log[-1] <= upto:
        return
    current_status(spark, table).write.mode("overwrite").parquet(f"{table}/compact/upto={log[-1]}")
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    for path in [*(f"{table}/log/batch_id={b}" for b in log), *(f"{table}/compact/upto={c}" for c in compacted)]:
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(conf).delete(place, True)


def status_stream(events: DataFrame, checkpoint: str, table: str, compact_every: int = 16) -> StreamingQuery:
    """The status log of a stream of events; every ``compact_every`` batches the log is folded.

    The stream keeps no state of its own: a batch costs its own events, and sessions
    live in the table that ``current_status`` reads.
    """

    def add(batch: DataFrame, batch_id: int) -> None:
        fold_status(batch, batch_id, table)
        if (batch_id + 1) % compact_every == 0:
            compact_status(batch.sparkSession, table)

    writer = events.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()
