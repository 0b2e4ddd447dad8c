"""Readers: string-only CSV, aliased catalogs, partitioned result trees, HTML tables of rows."""

from __future__ import annotations

import csv
from collections.abc import Iterator, Mapping, Sequence
from html.parser import HTMLParser
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quotaloom.functions.text import blank_to_null
from quotaloom.operators.scan import first_rows


def header_of(spark: SparkSession, path: str, sep: str = ",") -> list[str]:
    """Column names of a delimited file, read as one line; duplicates are an error."""
    line = spark.read.option("sep", sep).option("header", False).option("inferSchema", False).csv(path).limit(1).first()
    if line is None:
        raise ValueError("Use a UTF-8 CSV with one header row.")
    return _names(line)


def _names(cells: Sequence[str]) -> list[str]:
    names = [str(v).lstrip("\ufeff") for v in cells]
    if len(names) != len(set(names)):
        raise ValueError("Column names must be unique.")
    return names


def _strings(spark: SparkSession, paths: str | list[str], names: Sequence[str], sep: str) -> DataFrame:
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    return (spark.read.schema(schema).option("header", True).option("sep", sep).option("mode", "FAILFAST")
            .option("multiLine", False).option("enforceSchema", False).csv(paths))


def read_strings(
    spark: SparkSession, path: str, columns: Sequence[str] | None = None, sep: str = ",",
    max_records: int | None = None,
) -> DataFrame:
    """Delimited text with every column a string, so identifiers keep leading zeros.

    Unused columns are pruned by the reader.  ``max_records`` is a guard that raises,
    not a cap that drops rows.
    """
    df = _strings(spark, path, header_of(spark, path, sep), sep)
    if max_records is not None:
        seen = df.limit(max_records + 1).count()
        if seen == 0:
            raise ValueError("The CSV contains no records.")
        if seen > max_records:
            raise ValueError(f"Use at most {max_records:,} records per run.")
    return df.select(*columns) if columns else df


def read_catalog(
    spark: SparkSession, paths: Sequence[str], aliases: Mapping[str, Sequence[str]], required: str,
    keys: Sequence[str], upper: Sequence[str] = (), sep: str = ",",
) -> DataFrame:
    """Files with differing headers onto canonical columns; files lacking ``required`` are skipped.

    One job finds the first line of every file; files of one header are then read together, so neither jobs nor the plan
    grow with the number of files, only with that of different headers.  Values are trimmed, ids upper-cased and rows
    without any key dropped.
    """
    out = spark.createDataFrame([], T.StructType([T.StructField(c, T.StringType()) for c in aliases]))
    for header, files in headers_of(spark, paths):
        names = _names(next(csv.reader([header], delimiter=sep), []))
        found = {c: next((a for a in (c, *aliases.get(c, ())) if a in names), None) for c in aliases}
        if found.get(required) is None:
            continue
        df = _strings(spark, files, names, sep)
        out = out.unionByName(df.select(*[
            (F.trim(F.coalesce(F.col(a), F.lit(""))) if a else F.lit("")).alias(c) for c, a in found.items()]))
    out = out.select(*[F.upper(F.col(c)).alias(c) if c in upper else F.col(c) for c in out.columns])
    return out.where(F.coalesce(*[blank_to_null(F.col(k)) for k in keys]).isNotNull())


def headers_of(spark: SparkSession, paths: Sequence[str]) -> list[tuple[str, list[str]]]:
    """(first line, files that start with it) for all files under the paths, from one distributed pass over their first blocks."""
    lines = spark.read.text(list(paths)).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    firsts = lines.where("start = 0").withColumn("no", F.monotonically_increasing_id()).groupBy("file").agg(F.min_by("value", "no").alias("header"))
    rows = firsts.groupBy("header").agg(F.sort_array(F.collect_list("file")).alias("files")).orderBy("header").collect()
    return [(r["header"], [unquote(f) for f in r["files"]]) for r in rows]


def read_results(spark: SparkSession, root: str, **keys: str | int) -> DataFrame:
    """Partitioned result tree ``seed=/split=/model=``; key filters prune directories."""
    df = spark.read.parquet(root)
    for k, v in keys.items():
        df = df.where(F.col(k) == v)
    return df


def load_candidates(df: DataFrame, columns: Mapping[str, str], key: str, normalise, limit: int | None = None) -> DataFrame:
    """Select and rename, normalise the key, drop blank keys and repeats; the limit is the caller's."""
    out = df.select(*[F.col(src).alias(dst) for dst, src in columns.items()]).distinct()
    out = out.withColumn("key_normalised", normalise(F.col(key))).where(F.col("key_normalised") != "")
    return out.orderBy(key).limit(limit) if limit else out


def merge_cache(
    cache: DataFrame, updates: DataFrame, key: str, columns: Sequence[str], renames: Mapping[str, str],
    version: str, resolved: str = "resolved", source: str = "resolution_source", default_source: str = "legacy",
) -> DataFrame:
    """Legacy headers renamed, absent columns added blank, blank sources defaulted, newest row per key kept."""
    def shaped(df: DataFrame) -> DataFrame:
        df = df.withColumnsRenamed({k: v for k, v in renames.items() if k in df.columns and v not in df.columns})
        df = df.select(*[F.col(c) if c in df.columns else F.lit("").alias(c) for c in [*columns, version]])
        done = F.lower(F.coalesce(F.col(resolved).cast("string"), F.lit(""))) == "true"
        blank = blank_to_null(F.col(source)).isNull()
        return df.withColumn(source, F.when(done & blank, default_source).otherwise(F.col(source)))
    both = shaped(cache).unionByName(shaped(updates))
    return first_rows(both, [key], [-F.col(version)]).select(*columns)


def anchors(df: DataFrame, doc: str, html: str) -> DataFrame:
    """(doc, pos, href, label) of every link, in built-in functions only."""
    # an anchor without nested anchors; tags inside its label are removed afterwards
    pattern = r'(?is)<a\s[^>]*?href="([^"]*)"[^>]*>(.*?)</a>'
    hrefs = F.regexp_extract_all(F.col(html), F.lit(pattern), 1)
    labels = F.regexp_extract_all(F.col(html), F.lit(pattern), 2)
    rows = df.select(doc, F.posexplode(F.arrays_zip(hrefs.alias("href"), labels.alias("label"))).alias("pos", "_a"))
    text = F.trim(F.regexp_replace(F.regexp_replace(F.col("_a.label"), "<[^>]*>", " "), r"\s+", " "))
    return rows.select(doc, F.col("pos").cast("long").alias("pos"), F.trim(F.col("_a.href")).alias("href"), text.alias("label"))


def study_record_flag(icon: str, label: str):
    """A leaf is a study record by its icon, or without one by a leading record number."""
    marker = F.coalesce(F.col(icon), F.lit(""))
    return marker.contains("icon-ENDPOINT_STUDY_RECORD") | ((marker == "") & F.col(label).rlike(r"^\d+\s*\|"))


class _NestedFields(HTMLParser):
    """Text of label and value elements inside field elements, tracked by nesting depth."""

    def __init__(self, field: str, label: str, value: str) -> None:
        super().__init__(convert_charrefs=True)
        self.wanted = {"field": field, "label": label, "value": value}
        self.stack: list[tuple[str, str | None]] = []
        self.pair: dict[str, list[str]] | None = None
        self.pairs: list[tuple[str, str]] = []

    def handle_starttag(self, tag, attrs):
        if tag in ("br", "img", "hr", "input", "meta", "link"):
            return
        classes = (dict(attrs).get("class") or "").split()
        role = next((r for r, c in self.wanted.items() if c in classes or c == tag), None)
        if role == "field" and self.pair is None:
            self.pair = {}
        elif role in ("label", "value") and self.pair is not None and role not in self.pair:
            self.pair[role] = []
        else:
            role = None
        self.stack.append((tag, role))

    def handle_endtag(self, tag):
        while self.stack:
            open_tag, role = self.stack.pop()
            if role == "field" and self.pair is not None:
                if "label" in self.pair and "value" in self.pair:
                    label, value = (" ".join(" ".join(self.pair[k]).split()) for k in ("label", "value"))
                    if label:
                        self.pairs.append((label, value))
                self.pair = None
            if open_tag == tag:
                break

    def handle_data(self, data):
        if self.pair is None:
            return
        for _, role in reversed(self.stack):
            if role in ("label", "value"):
                self.pair[role].append(data)
                return


def field_pairs(
    df: DataFrame, doc: str, html: str, field: str = "das-field", label: str = "das-field_label",
    value: str = "das-field_value",
) -> DataFrame:
    """(doc, pos, label, value) of nested field elements; class or tag names select them.

    Nesting is beyond a regular expression, so whole documents pass through the
    standard-library parser in Arrow batches; everything after is relational.
    """
    doc_type = df.schema[doc].dataType
    schema = T.StructType([T.StructField(doc, doc_type), T.StructField("pos", T.LongType()),
                           T.StructField("label", T.StringType()), T.StructField("value", T.StringType())])

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, text in zip(batch[doc], batch[html]):
                parser = _NestedFields(field, label, value)
                parser.feed(text or "")
                parser.close()
                out += [(key, i, k, v) for i, (k, v) in enumerate(parser.pairs)]
            yield pd.DataFrame(out, columns=[doc, "pos", "label", "value"])

    return df.select(doc, html).mapInPandas(parse, schema)


def zip_listing(df: DataFrame, doc: str, text: str, pattern: str) -> DataFrame:
    """Distinct archive members named in a listing, in order of first appearance."""
    found = df.select(doc, F.posexplode(F.regexp_extract_all(F.col(text), F.lit(pattern), 1)).alias("pos", "raw"))
    path = F.trim(F.replace(F.col("raw"), F.lit("&amp;"), F.lit("&")))
    per = found.groupBy(doc, path.alias("path")).agg(F.min("pos").cast("long").alias("pos"))
    bare = F.regexp_replace(F.col("path"), "/+$", "")
    return per.select(doc, "pos", "path", F.element_at(F.split(bare, "/"), -1).alias("basename"),
                      F.endswith(F.col("path"), F.lit("/")).alias("is_directory"))
