"""Structured Streaming re-aim of the reference's polling.

The reference polls batch tables every 60 s; here feedback arrives as files in
a landing folder and is processed incrementally:

* T1 `feedback_stream` — schema-fixed file stream, event-time watermark, and
  `dropDuplicatesWithinWatermark` on the review id (late duplicates dropped,
  state bounded by the watermark).
* T2 `daily_counts` — tumbling 1-day windows per category (month windows are
  not allowed on streams; months are rolled up in batch from the days).
* T3 `ticker_sink` — newest-n reviews maintained by `foreachBatch`.
* T4 `weekly_counts` — 7-day windows sliding by 1 day, the input of streaming
  velocity / share alerts.

Sinks are Parquet folders of one epoch each, written inside `foreachBatch`:
an epoch reads only older folders than its own, so running it again after a
failure rewrites the same rows. Checkpoints and sinks live in the shared
checkpoint folder under stable names, so a stopped stream resumes.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vocspark.session import checkpoint_dir

EVENT_SCHEMA = T.StructType([
    T.StructField("reviewId", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("at", T.TimestampType()),
    T.StructField("severity", T.DoubleType()),
    T.StructField("content", T.StringType()),
])


def feedback_stream(spark: SparkSession, landing_dir: str, schema: T.StructType = EVENT_SCHEMA, ts: str = "at",
                    watermark: str = "2 days", key: str = "reviewId", fmt: str = "parquet",
                    max_files_per_trigger: int | None = None) -> DataFrame:
    """Incremental file source with watermark and in-watermark de-duplication."""
    r = spark.readStream.schema(schema).format(fmt)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    s = r.load(landing_dir)
    return s.withWatermark(ts, watermark).dropDuplicatesWithinWatermark([key])


def daily_counts(stream: DataFrame, ts: str = "at", category: str = "category", severity: str = "severity") -> DataFrame:
    """Per (day, category): reviews and severity sum (exact 2-dp decimal sum, order-free)."""
    g = stream.groupBy(F.window(ts, "1 day").alias("w"), F.col(category).alias("category")).agg(
        F.count(F.lit(1)).alias("reviews"), F.sum(F.col(severity).cast("decimal(20,2)")).alias("severity_sum"))
    return g.select(F.col("w.start").alias("day"), "category", "reviews", "severity_sum")


def weekly_counts(stream: DataFrame, ts: str = "at", category: str = "category") -> DataFrame:
    """T4: 7-day windows sliding by one day, per category."""
    g = stream.groupBy(F.window(ts, "7 days", "1 day").alias("w"), F.col(category).alias("category")).agg(
        F.count(F.lit(1)).alias("reviews"))
    return g.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "category", "reviews")


def _children(spark: SparkSession, path: str, prefix: str) -> dict[int, str]:
    """Complete folders `<prefix><number>` below path, by number."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return {}
    found = {}
    for st in fs.listStatus(p):
        name = st.getPath().getName()
        if name.startswith(prefix) and name[len(prefix):].isdigit() and fs.exists(
                jvm.org.apache.hadoop.fs.Path(st.getPath(), "_SUCCESS")):
            found[int(name[len(prefix):])] = st.getPath().toString()
    return found


def _drop(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def latest(spark: SparkSession, path: str) -> str | None:
    """The newest complete version folder of a top-n or landing table."""
    v = _children(spark, path, "v")
    return v[max(v)] if v else None


def _newest_per_key(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """Rows of several (epoch-tagged) frames, the one of the last epoch for each key."""
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    values = [c for c in rows.columns if c not in (*keys, "_epoch")]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "_epoch").alias("_v"))
    return best.select(*keys, "_v.*")


def read_upserts(spark: SparkSession, out: str, keys: list[str], below: int | None = None) -> DataFrame | None:
    """The table that `upsert_sink` keeps: the last written row of each key (of epochs < `below`)."""
    merged = {e: p for e, p in _children(spark, out, "merged-").items() if below is None or e <= below}
    start = max(merged) if merged else 0
    epochs = {e: p for e, p in _children(spark, out, "epoch-").items() if e >= start and (below is None or e < below)}
    parts = [spark.read.parquet(merged[start]).withColumn("_epoch", F.lit(start - 1))] if merged else []
    parts += [spark.read.parquet(p).withColumn("_epoch", F.lit(e)) for e, p in sorted(epochs.items())]
    return _newest_per_key(parts, keys) if parts else None


def upsert_sink(out: str, keys: list[str], merge_every: int = 20):
    """foreachBatch writer: each epoch writes only its own changed rows, to a folder of its own.

    Nothing is read to write an epoch, so a replayed epoch just rewrites its folder. Every
    `merge_every` epochs the rows before the epoch are merged into one folder; the folders it
    replaces go at the next merge, so that a replay finds what it read.
    """
    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{out}/epoch-{epoch:09d}")
        if epoch and epoch % merge_every == 0:
            table = read_upserts(spark, out, keys, below=epoch) if not _children(spark, out, "merged-").get(epoch) else None
            if table is not None:
                table.write.mode("overwrite").parquet(f"{out}/merged-{epoch:09d}")
            horizon = epoch - merge_every
            for prefix in ("epoch-", "merged-"):
                for e, p in _children(spark, out, prefix).items():
                    if e < horizon:
                        _drop(spark, p)
    return write


def topn_sink(out: str, n: int, order):
    """foreachBatch writer keeping only the newest n rows (T3 live ticker): version e is the top n of
    version e - 1 or before and the batch, so a replay reads what the first run read. One older
    version is kept for that; the rest are dropped."""
    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        older = {e: p for e, p in _children(spark, out, "v").items() if e < epoch}
        merged = batch if not older else spark.read.parquet(older[max(older)]).unionByName(batch)
        merged.orderBy(*order).limit(n).write.mode("overwrite").parquet(f"{out}/v{epoch:09d}")
        for e in sorted(older)[:-1]:
            _drop(spark, older[e])
    return write


def run_available(df: DataFrame, writer, checkpoint: str, output_mode: str = "update") -> None:
    """Process everything new (trigger availableNow) and stop; the checkpoint makes the next run resume."""
    q = (df.writeStream.outputMode(output_mode).foreachBatch(writer)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()


def land_events(spark: SparkSession, events: DataFrame, landing: str) -> str:
    """Write a batch of events into a landing folder, by event day (arrival simulation)."""
    if latest(spark, landing) is None:
        events.repartitionByRange(F.to_date("at")).write.mode("overwrite").parquet(f"{landing}/v000000000")
    return latest(spark, landing)


def stream_table(spark: SparkSession, landing: str, kind: str = "daily", n: int = 15,
                 max_files_per_trigger: int | None = None) -> DataFrame:
    """Run one streaming pipeline over a landing folder and return its sink as a batch DataFrame.

    Checkpoint and sink belong to (landing folder, kind): a further call reads only files that have
    arrived since."""
    own = hashlib.sha1(landing.encode()).hexdigest()[:16]
    base = f"{checkpoint_dir(spark).rstrip('/')}/vocspark-stream/{kind}-{own}-{n}"
    out, checkpoint = f"{base}/out", f"{base}/checkpoint"
    s = feedback_stream(spark, landing, max_files_per_trigger=max_files_per_trigger)
    if kind in ("daily", "monthly"):
        keys = ["day", "category"]
        run_available(daily_counts(s), upsert_sink(out, keys), checkpoint)
    elif kind == "weekly":
        keys = ["window_start", "category"]
        run_available(weekly_counts(s), upsert_sink(out, keys), checkpoint)
    elif kind == "ticker":
        order = [F.col("at").desc(), F.col("reviewId").asc()]
        run_available(s.select("reviewId", "category", "at", "content"), topn_sink(out, n, order), checkpoint, "append")
    else:
        raise ValueError(kind)
    if kind == "ticker":
        path = latest(spark, out)
        df = None if path is None else spark.read.parquet(path)
    else:
        df = read_upserts(spark, out, keys)
    if df is None:
        raise RuntimeError("stream produced no output")
    if kind == "daily":
        df = df.withColumn("severity_sum", F.col("severity_sum").cast("double"))
    if kind == "ticker":
        df = df.withColumn("rank", F.row_number().over(W.orderBy(F.col("at").desc(), F.col("reviewId").asc())).cast("long"))
    return df


def monthly_rollup(daily: DataFrame) -> DataFrame:
    """Batch roll-up of the daily stream table to months (what T2 cannot do in append mode)."""
    return daily.groupBy(F.date_format("day", "yyyy-MM").alias("month"), "category").agg(
        F.sum("reviews").alias("reviews"), F.sum("severity_sum").cast("double").alias("severity_sum"))


def weekly_velocity(weekly: DataFrame, alerts_only: bool = False) -> DataFrame:
    """T4 rules on the sliding-window table: the latest *complete* 7-day window per category
    (ending at the end of the last event day) against the non-overlapping window that ended
    7 days earlier; >= 10 / 20 / 40 % -> WATCH / HIGH / CRITICAL (previous 0 skipped), as in
    the batch velocity alerts. `alerts_only` keeps the rows with a severity."""
    last_end = F.max("window_start").over(W.partitionBy()) + F.expr("interval 1 day")
    w = weekly.withColumn("_last", last_end)
    cur = w.filter(F.col("window_end") == F.col("_last")).select("category", F.col("reviews").alias("c"), "window_end")
    prev = w.filter(F.col("window_end") == F.col("_last") - F.expr("interval 7 days")) \
            .select("category", F.col("reviews").alias("p"))
    j = cur.join(prev, "category").filter(F.col("p") > 0)
    pct = F.round((F.col("c") - F.col("p")) / F.col("p") * 100, 1)
    j = j.withColumn("velocity_pct", pct)
    sev = F.when(F.col("velocity_pct") >= 40, "CRITICAL").when(F.col("velocity_pct") >= 20, "HIGH") \
           .when(F.col("velocity_pct") >= 10, "WATCH")
    out = j.withColumn("severity", sev)
    if alerts_only:
        out = out.filter(F.col("severity").isNotNull())
    return out.select("category", "window_end", F.col("c").alias("curr_reviews"), F.col("p").alias("prev_reviews"),
                      "velocity_pct", "severity")
