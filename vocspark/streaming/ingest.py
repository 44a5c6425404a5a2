"""Ingest that scores (S6, S7, E22): reviews land as files, every epoch scores what is new and brings
all derived tables up to date.

An epoch is one `foreachBatch` call. It writes its own reviews and their scores under its own number,
so that a replay writes the same folders again; a review that lands again replaces its older self
(newest epoch, and within an epoch the newest timestamp). Scoring, the work that grows with the text,
is done once for each review that lands. The derived tables are then built from the scores of all
reviews into the epoch's version folder, as the reference builds them after each upload; readers see a
version only once its marker is written, last. Two versions are kept. Tables that follow row by row from
the scores (`views`) are made when they are read: an epoch does not write every review's text again.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vocspark.sources.tables import append_sync
from vocspark.streaming.feed import _children, _drop, read_upserts, run_available, upsert_sink

SCORED = "_scored"


@dataclass(frozen=True)
class Ingest:
    """What an ingest needs: a shared folder, the scoring of reviews (which may drop rows, and keeps the
    key), the derived tables of all scored reviews, and `views` of the scores, by name."""

    out: str
    score: Callable[[DataFrame], DataFrame]
    tables: Callable[[DataFrame], dict[str, DataFrame]]
    key: str = "reviewId"
    ts: str = "at"
    dataset: str = "reviews"
    views: dict[str, Callable[[DataFrame], DataFrame]] = field(default_factory=dict)

    def write(self, batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        values = [c for c in batch.columns if c != self.key]
        # ties of the timestamp are settled by the values, so that a replay keeps the same row
        newest = batch.where(F.col(self.key).isNotNull()).groupBy(self.key).agg(
            F.max_by(F.struct(*values), F.struct(self.ts, F.xxhash64(*values))).alias("_v")).select(self.key, "_v.*")
        upsert_sink(f"{self.out}/reviews", [self.key])(newest, epoch)
        landed = spark.read.parquet(f"{self.out}/reviews/epoch-{epoch:09d}")
        scored = self.score(landed).withColumn(SCORED, F.lit(True))
        # reviews that are not scored are written too: they replace an older self that was
        rows = landed.select(self.key).join(scored, self.key, "left")
        upsert_sink(f"{self.out}/scored", [self.key])(rows, epoch)
        version = f"{self.out}/version-{epoch:09d}"
        everything = read_upserts(spark, f"{self.out}/scored", [self.key], below=epoch + 1)
        everything.where(SCORED).drop(SCORED).write.mode("overwrite").parquet(f"{version}/scored")
        for name, table in self.tables(spark.read.parquet(f"{version}/scored")).items():
            table.write.mode("overwrite").parquet(f"{version}/{name}")
        append_sync(spark, f"{self.out}/log", f"{epoch:09d}", landed.agg(F.max(self.ts)).first()[0], dataset=self.dataset)
        spark.range(1).write.mode("overwrite").parquet(f"{self.out}/complete-{epoch:09d}")
        for prefix in ("version-", "complete-"):
            for e, path in _folders(spark, self.out, prefix).items():
                if e < epoch - 1:
                    _drop(spark, path)

    def run(self, landing: DataFrame, checkpoint: str | None = None) -> None:
        """Takes everything that has landed and stops; the checkpoint makes the next run resume."""
        run_available(landing, self.write, checkpoint or f"{self.out}/checkpoint", "append")

    def table(self, spark: SparkSession, name: str) -> DataFrame:
        """A derived table (or `scored`) of the newest complete version."""
        done = _children(spark, self.out, "complete-")
        if not done:
            raise ValueError(f"nothing has been ingested into {self.out}")
        version = f"{self.out}/version-{max(done):09d}"
        return self.views[name](spark.read.parquet(f"{version}/scored")) if name in self.views else spark.read.parquet(f"{version}/{name}")

    def reviews(self, spark: SparkSession) -> DataFrame:
        """All reviews landed so far, each in its newest form."""
        return read_upserts(spark, f"{self.out}/reviews", [self.key])


def _folders(spark: SparkSession, path: str, prefix: str) -> dict[int, str]:
    """Folders `<prefix><number>` below path, complete or not."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    names = {s.getPath().getName(): s.getPath().toString() for s in p.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(p)}
    return {int(n[len(prefix):]): at for n, at in names.items() if n.startswith(prefix) and n[len(prefix):].isdigit()}


def review_stream(spark: SparkSession, landing: str, schema, max_files_per_trigger: int | None = None) -> DataFrame:
    """The landing folder as an incremental source of reviews."""
    r = spark.readStream.schema(schema).format("parquet")
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.load(landing)
