"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir

#: Words are maximal runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unit_hash(*parts: Column) -> Column:
    """A draw in (0, 1) from the md5 of the parts joined by a colon: 52 bits, never 0 or 1.

    md5 rather than Spark's own hashes, so that any SQL engine repeats the draw."""
    digest = F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(2.0 ** 52)


def word_count(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def map_rows(docs: DataFrame, keep: tuple[str, ...], inputs: list[Column],
             run: Callable[[list[pa.Array]], Iterator[tuple[int, int, list[pa.Array]]]], results: dict[str, str]) -> DataFrame:
    """The columns `keep` of docs (all by default, less those named as a result) and the results of run.

    run gets the input columns of a batch and yields (first row, rows, result columns) piece by piece.
    Kept columns travel by place, so that they may have any names."""
    keep = [c for c in (keep or docs.columns) if c not in results]
    types = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    schema = ", ".join([f"k{i} {types[c]}" for i, c in enumerate(keep)] + [f"r{i} {t}" for i, t in enumerate(results.values())])
    n_keep, n_inputs = len(keep), len(inputs)
    names = [f"k{i}" for i in range(n_keep)] + [f"r{i}" for i in range(len(results))]

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, n, made in run([batch.column(n_keep + i) for i in range(n_inputs)]):
                kept = [batch.column(i).slice(at, n) for i in range(n_keep)]
                yield pa.RecordBatch.from_arrays([*kept, *made], names=names)

    source = docs.select(*[docs[f"`{c}`"].alias(f"k{i}") for i, c in enumerate(keep)],
                         *[x.alias(f"i{i}") for i, x in enumerate(inputs)])
    return source.mapInArrow(step, schema).toDF(*keep, *results)


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """df written as Parquet in the shared folder and read again, and where. Unlike a checkpoint it can be
    dropped (`drop`) once what needs it has been written in turn."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/written-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path), path


def drop(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def release(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of steps that nothing refers to any more. It does so when the
    driver's garbage is collected, which may otherwise be long after a checkpoint made them useless."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
