"""Scans and sinks.

Reads are lazy Parquet scans: Catalyst prunes columns and pushes filters into
the scan, so callers never `select` everything up front.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DRIVER_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
                 "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet scan of one driver table (`<sf_dir>/<name>.parquet`)."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def _exists(spark: SparkSession, path: str) -> bool:
    """Path test through the Hadoop FileSystem (works for hdfs://, s3a://, file:)."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(p)


# FIXED VALUES — column names that input files may use.
TEXT_ALIASES = ["content", "review", "text", "comment"]
DATE_ALIASES = ["at", "date"]


def resolve_alias(columns, aliases, case_insensitive: bool = False):
    """First alias present in `columns` (driver-side, no data touched)."""
    if case_insensitive:
        low = {c.lower(): c for c in columns}
        for a in aliases:
            if a.lower() in low:
                return low[a.lower()]
        return None
    for a in aliases:
        if a in columns:
            return a
    return None


def read_reviews(spark: SparkSession, path: str, fmt: str = "csv", schema: T.StructType | str | None = None,
                 ts: str = "at") -> DataFrame:
    """Scan a reviews file; the first of content/review/text/comment becomes `content`.
    A text column `ts` becomes a timestamp, null where it is none (F34)."""
    r = spark.read.format(fmt)
    if fmt == "csv":
        r = r.option("header", True).option("multiLine", True).option("escape", '"')
    if schema is not None:
        r = r.schema(schema)
    df = r.load(path)
    col = resolve_alias(df.columns, TEXT_ALIASES)
    if col is None:
        raise ValueError(f"no text column among {TEXT_ALIASES}: {df.columns}")
    if col != "content":
        df = df.withColumn("content", F.col(col))
    if dict(df.dtypes).get(ts) == "string":
        df = df.withColumn(ts, F.col(ts).try_cast("timestamp"))
    return df


def load_table(spark: SparkSession, base_dir: str, name: str, fmt: str = "parquet") -> DataFrame | None:
    """S3: optional scan — a missing table is None instead of an error."""
    path = os.path.join(base_dir, name)
    if not _exists(spark, path):
        return None
    return spark.read.format(fmt).load(path)


def load_reviews(spark: SparkSession, base_dir: str, empty_schema: T.StructType | None = None,
                 skip_empty: bool = False) -> DataFrame:
    """Prefer `uploaded_reviews`, else `cleaned_reviews`, else a typed empty frame. `skip_empty` is
    the report's variant: a table without rows counts as missing."""
    for name in ("uploaded_reviews", "cleaned_reviews"):
        df = load_table(spark, base_dir, name)
        if df is not None and not (skip_empty and df.isEmpty()):
            return df
    from vocspark.schemas import REVIEWS
    return spark.createDataFrame([], empty_schema or REVIEWS)


def write_table(df: DataFrame, base_dir: str, name: str, partition_by=None, fmt: str = "parquet") -> str:
    """Overwrite one derived table (optionally partitioned, e.g. by month)."""
    path = os.path.join(base_dir, name)
    w = df.write.mode("overwrite").format(fmt)
    if partition_by:
        w = w.partitionBy(*([partition_by] if isinstance(partition_by, str) else partition_by))
    if fmt == "csv":
        w = w.option("header", True)
    w.save(path)
    return path


# ---------------------------------------------------------------------------
# Training inputs
# ---------------------------------------------------------------------------

# FIXED VALUES — names of the tables that scoring writes.
INFERENCE_OUTPUTS = ["uploaded_reviews", "review_classifications", "topic_analysis", "topic_timeseries",
                     "aspect_analysis", "emerging_issues", "semantic_drift", "classification_quality"]


def load_training(spark: SparkSession, path: str, fmt: str = "csv", text: str = "cleaned_content") -> DataFrame:
    """Training data; inference outputs are refused by name; null text dropped."""
    name = os.path.basename(path.rstrip("/")).lower()
    if any(name.startswith(x) for x in INFERENCE_OUTPUTS):
        raise ValueError(f"refusing to train on an inference output: {path}")
    r = spark.read.format(fmt)
    if fmt == "csv":
        r = r.option("header", True).option("multiLine", True).option("escape", '"')
    return r.load(path).dropna(subset=[text])


# FIXED VALUES — column names that labelled files may use.
TEXT_LABEL_ALIASES = ["review", "text", "content"]
LABEL_ALIASES = ["category", "label", "issue_label"]


def load_labeled(df: DataFrame, min_per_class: int = 2, min_rows: int = 0, min_classes: int = 2) -> DataFrame:
    """S5 + A19: (review, category) with case-insensitive alias resolution, trimmed, blanks
    dropped, classes with fewer than `min_per_class` rows dropped. Fewer than `min_classes` classes, or
    fewer than `min_rows` rows in them, are an error."""
    t = resolve_alias(df.columns, TEXT_LABEL_ALIASES, case_insensitive=True)
    c = resolve_alias(df.columns, LABEL_ALIASES, case_insensitive=True)
    if t is None or c is None:
        raise ValueError(f"need a text column {TEXT_LABEL_ALIASES} and a label column {LABEL_ALIASES}")
    d = df.select(F.trim(F.col(t).cast("string")).alias("review"), F.trim(F.col(c).cast("string")).alias("category"))
    d = d.filter(F.col("review").isNotNull() & (F.col("review") != "") &
                 F.col("category").isNotNull() & (F.col("category") != ""))
    keep = d.groupBy("category").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_per_class)
    n_classes, n_rows = keep.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    if n_classes < min_classes:
        raise ValueError(f"need at least {min_classes} classes with >= {min_per_class} rows, got {n_classes}")
    if n_rows < min_rows:
        raise ValueError(f"need at least {min_rows} labelled rows, got {n_rows}")
    return d.join(F.broadcast(keep.select("category")), "category", "left_semi").select("review", "category")


# ---------------------------------------------------------------------------
# Sync log (S7), alert registry (S9), small sinks
# ---------------------------------------------------------------------------

def sync_log(spark: SparkSession, last_sync: str | None, status: str = "success", dataset: str = "") -> DataFrame:
    """One-row sync metadata frame (last_sync TIMESTAMP, last_sync_date DATE, status, dataset)."""
    from vocspark.schemas import SYNC_LOG
    if last_sync is None:
        return spark.createDataFrame([], SYNC_LOG)
    df = spark.createDataFrame([(last_sync, status, dataset)], "ts string, status string, dataset string")
    return df.select(F.to_timestamp("ts").alias("last_sync"), F.to_date(F.to_timestamp("ts")).alias("last_sync_date"),
                     "status", "dataset")


def append_sync(spark: SparkSession, base: str, run: str, last_sync, status: str = "success", dataset: str = "") -> str:
    """Appends one run to the stored sync log. Each run has a folder of its own name, so a run that
    is written again, as after a failure, still counts once."""
    row = spark.createDataFrame([(run, None if last_sync is None else str(last_sync), status, dataset)],
                                "run string, ts string, status string, dataset string")
    path = os.path.join(base, f"run-{run}")
    row.select("run", F.to_timestamp("ts").alias("last_sync"), F.to_date(F.to_timestamp("ts")).alias("last_sync_date"),
               "status", "dataset").coalesce(1).write.mode("overwrite").parquet(path)
    return path


def read_sync_log(spark: SparkSession, base: str, dataset: str | None = None) -> DataFrame:
    """All runs of the stored log (run, last_sync, last_sync_date, status, dataset); none if missing."""
    from vocspark.schemas import SYNC_LOG
    if not _exists(spark, base):
        return spark.createDataFrame([], T.StructType([T.StructField("run", T.StringType()), *SYNC_LOG.fields]))
    log = spark.read.parquet(os.path.join(base, "run-*"))
    return log if dataset is None else log.where(F.col("dataset") == dataset)


def last_sync(log: DataFrame) -> DataFrame:
    """The newest run of each dataset (by last_sync, then run)."""
    values = [c for c in log.columns if c != "dataset"]
    newest = log.groupBy("dataset").agg(F.max_by(F.struct(*values), F.struct("last_sync", "run")).alias("v"))
    return newest.select("dataset", "v.*")


def needs_sync(log: DataFrame, as_of_date: str) -> DataFrame:
    """One row `due` — true when there is no log or the last sync date differs from as_of."""
    last = log.select(F.max("last_sync_date")).scalar()
    return log.sparkSession.range(1).select(
        F.coalesce(last != F.to_date(F.lit(as_of_date)), F.lit(True)).alias("due"))


def write_alerts(alerts: DataFrame, path: str, as_of: str) -> str:
    """JSON registry {alerts: [...], last_check}. Alerts are bounded by #aspects/#labels."""
    doc = alerts.agg(F.collect_list(F.struct(*alerts.columns)).alias("alerts")) \
                .withColumn("last_check", F.lit(as_of).cast("timestamp"))
    doc.coalesce(1).write.mode("overwrite").json(path)
    return path


def read_alerts(spark: SparkSession, path: str) -> DataFrame:
    """The alert rows of a registry written by `write_alerts` (empty if missing)."""
    from vocspark.schemas import ALERTS
    if not _exists(spark, path):
        return spark.createDataFrame([], ALERTS)
    doc = spark.read.schema(T.StructType([T.StructField("alerts", T.ArrayType(ALERTS)),
                                          T.StructField("last_check", T.TimestampType())])).json(path)
    return doc.select(F.explode("alerts").alias("a")).select("a.*")


def write_labels_csv(labels: DataFrame, path: str) -> str:
    """(review, category) CSV with header."""
    labels.select("review", "category").write.mode("overwrite").option("header", True).csv(path)
    return path


def write_metrics_json(metrics: DataFrame, path: str) -> str:
    """Evaluation report / training metadata as JSON (one file)."""
    metrics.coalesce(1).write.mode("overwrite").json(path)
    return path
