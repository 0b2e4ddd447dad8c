"""Writers: partitioned results, escaped CSV, run directories, release manifests."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator, Mapping, Sequence
from typing import Any
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quotaloom.functions.text import escape_formulas


def save_predictions(df: DataFrame, root: str, keys: Sequence[str] = ("seed", "split", "model")) -> None:
    """One directory per key combination; re-running a run replaces only its own directories."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(root)


def save_metrics(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def export_csv(df: DataFrame, path: str) -> None:
    """CSV whose text cells cannot be evaluated by a spreadsheet; numbers stay as they are."""
    escape_formulas(df).write.mode("overwrite").option("header", True).csv(path)


def export_run(tables: Mapping[str, DataFrame], manifest: Mapping[str, Any], root: str) -> None:
    """One CSV dataset per table plus manifest.json, written by the cluster's file system."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        export_csv(df, f"{root}/{name}")
    write_json(spark, dict(manifest), f"{root}/manifest")


def write_json(spark: SparkSession, content: Mapping[str, Any], path: str) -> None:
    line = json.dumps(content, sort_keys=True, default=str)
    spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_json(spark: SparkSession, path: str) -> dict[str, Any]:
    return json.loads(spark.read.text(path).first()[0])


def export_columns(df: DataFrame, known: Sequence[str], renames: Mapping[str, str], stamps: Mapping[str, Any]) -> DataFrame:
    """Known columns that exist, renamed, with the key stamps."""
    kept = df.select(*[c for c in known if c in df.columns]).withColumnsRenamed(dict(renames))
    return kept.withColumns({k: F.lit(v) for k, v in stamps.items()})


def rename_legacy(df: DataFrame, columns: Mapping[str, str], values: Mapping[str, str],
                  value_columns: Sequence[str] = ()) -> DataFrame:
    """Legacy headers and values to current ones; where both headers exist the current one wins."""
    keep, seen = [], set(df.columns)
    for c in df.columns:
        new = columns.get(c, c)
        if new != c and new in seen:
            continue
        keep.append((c, new))
    def value(c: Column) -> Column:
        out = c
        for old, new in values.items():
            out = F.when(c == old, F.lit(new)).otherwise(out)
        return out
    return df.select(*[(value(F.col(c)) if new in value_columns else F.col(c)).alias(new) for c, new in keep])


#: bytes of a file that a task holds while it digests it
DIGEST_BLOCK = 8 << 20


def release_manifest(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """(path, bytes, sha256) of the files under a directory.

    Only names and sizes are listed; each file is read as a stream of blocks by one task, so files of any size can be digested.
    Empty files, and those whose names start with _ or a dot, aren't listed by Spark's readers and aren't here.
    """
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", True)
             .option("pathGlobFilter", glob).load(root)).select("path", F.col("length").alias("bytes"))

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for path in batch.column("path").to_pylist():
                # listed paths are not encoded, and local ones have one slash after the scheme
                system, name = ((pa.fs.LocalFileSystem(), "/" + path[len("file:"):].lstrip("/")) if path.startswith("file:")
                                else pa.fs.FileSystem.from_uri(quote(path, safe=":/@")))
                digest = hashlib.sha256()
                with system.open_input_stream(name) as stream:
                    while block := stream.read(DIGEST_BLOCK):
                        digest.update(block)
                out.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("bytes"), pa.array(out, pa.string())], ["path", "bytes", "sha256"])
    # small listings, large files: dealt anew, so that one task doesn't get many neighbours
    width = spark.sparkContext.defaultParallelism
    return files.repartition(width, "path").mapInArrow(digests, "path string, bytes long, sha256 string")


def assert_counts(df: DataFrame, entity: str, rows: int, entities: int) -> None:
    n, e = df.agg(F.count("*"), F.count_distinct(entity)).first()
    if (n, e) != (rows, entities):
        raise ValueError(f"expected {rows} rows and {entities} entities, found {n} and {e}")
