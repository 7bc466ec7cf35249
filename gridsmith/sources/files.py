"""Scans of CSV, JSON, Parquet and binary files (S9 to S13, S19 to S24) and their sinks."""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Iterator
from pathlib import PurePosixPath

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridsmith.catalogs import MAGIC
from gridsmith.functions import html
from gridsmith.session import written


def semicolon_csv(spark: SparkSession, path: str, key: str, name: str) -> DataFrame:
    """A CSV with semicolons, a mark at its start and rows without a key; by name."""
    df = spark.read.csv(path, sep=";", header=True, encoding="UTF-8")
    df = df.toDF(*[c.lstrip("﻿").strip() for c in df.columns])
    return df.filter(F.length(F.trim(key)) > 0).orderBy(F.lower(name))


def names_csv(spark: SparkSession, path: str, wanted: tuple[str, ...] = ("name", "firma", "netzbetreiber")) -> DataFrame:
    """The column whose header is one of those wanted, else the first."""
    df = spark.read.csv(path, header=True)
    c = next((x for x in df.columns if x.strip().lower() in wanted), df.columns[0])
    return df.select(F.trim(F.col(f"`{c}`")).alias("name")).filter("name != ''")


def seed(spark: SparkSession, candidates: list[str]) -> DataFrame:
    """The first folder that exists, NaN as null."""
    for path in candidates:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
            df = spark.read.parquet(path)
            return df.select(*(F.when(~F.isnan(c), F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes))
    raise FileNotFoundError(", ".join(candidates))


def stats_json(spark: SparkSession, path: str, fields: str) -> DataFrame:
    """{metadata, dnos: {key: {...}}} as one row for each key."""
    df = spark.read.schema(f"metadata map<string,string>, dnos map<string,struct<{fields}>>").json(path, multiLine=True)
    return df.select(F.explode("dnos").alias("key", "v")).select("key", "v.*")


def listing(spark: SparkSession, path: str) -> DataFrame:
    """Slug, type, year and format of files named {slug}-{type}-{year}.{ext}; contents aren't read."""
    df = spark.read.format("binaryFile").load(path).select("path", "length", "modificationTime")
    g = lambda i: F.regexp_extract("path", r"([^/]+)-(netzentgelte|hlzf)-([0-9]{4})\.([a-z]+)$", i)
    return df.select("path", "length", "modificationTime", g(1).alias("slug"), g(2).alias("kind"), g(3).try_cast("int").alias("year"), g(4).alias("format")).filter("slug != ''")


def export_date(spark: SparkSession, path: str) -> DataFrame:
    """The newest modification time of a folder's files."""
    return spark.read.format("binaryFile").load(path).agg(F.max("modificationTime").alias("exported_at"))


def format_by_name(path: Column) -> Column:
    """By the ending of a path or address without its query; pages have none."""
    bare = F.split(F.lower(F.coalesce(path, F.lit(""))), r"\?")[0]
    kinds = [(".pdf", "pdf"), (".xlsx", "xlsx"), (".xls", "xls"), (".docx", "docx"), (".zip", "zip")]
    return F.coalesce(*[F.when(F.endswith(bare, F.lit(e)), F.lit(k)) for e, k in kinds], F.lit("html"))


def file_format(content: Column, content_type: Column, url: Column) -> Column:
    """By first bytes, then by content type, then by address. An archive is what its first members tell,
    and a workbook unless its address says zip."""
    head, kind = F.hex(F.substring(content, 1, 16)), F.lower(F.coalesce(content_type, F.lit("")))
    holds = lambda word: F.contains(F.substring(content, 1, 10_000), F.lit(word).cast("binary"))
    archive = F.when(holds("workbook.xml"), "xlsx").when(holds("word/"), "docx").when(format_by_name(url) == "zip", "zip").otherwise("xlsx")
    said = F.when(kind.contains("pdf"), "pdf").when(kind.contains("spreadsheet") | kind.contains("excel"), "xlsx").when(kind.contains("zip"), "zip").when(kind.contains("text/html") | kind.contains("application/xhtml"), "html")
    magic = [F.when(F.startswith(head, F.lit(m)), F.lit(k)) for m, k in MAGIC.items()]
    return F.coalesce(*magic, F.when(F.startswith(head, F.lit("504B0304")), archive), said, format_by_name(url))


def kept_downloads(files: DataFrame, job: str, order: Column, most: int = 50 << 20, total: int = 300 << 20, count: int = 50) -> DataFrame:
    """Of (job, url, content, content_type) the files that a job keeps, with format, size and SHA-256. Its first
    `count` candidates are looked at, in order; those above a size, and repeated contents, are left out; once `total` bytes
    are kept no more is. A job has few candidates, so its windows are small; contents aren't in them."""
    seen = files.select(job, "url", order.alias("_o"), F.length("content").alias("size"), F.sha2("content", 256).alias("file_hash"), file_format(F.col("content"), F.col("content_type"), F.col("url")).alias("format"))
    w = Window.partitionBy(job).orderBy("_o", "url")
    near = seen.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= count).filter(F.col("size") <= most)
    first = near.withColumn("_again", F.row_number().over(Window.partitionBy(job, "file_hash").orderBy("_k"))).filter("_again = 1")
    before = F.coalesce(F.sum("size").over(Window.partitionBy(job).orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return first.withColumn("_sum", before).filter(F.col("_sum") < total).drop("_k", "_again", "_sum", "_o")


def checked_pdfs(files: DataFrame) -> DataFrame:
    """Of (name, kind, year, content) those that are PDFs, with the path under which each is kept."""
    path = F.concat(F.regexp_replace(F.lower("name"), "[^a-zA-Z0-9]", "-"), F.lit("/"), F.col("kind"), F.lit("-"), F.col("year"), F.lit(".pdf"))
    return files.filter(F.startswith("content", F.lit("%PDF").cast("binary"))).withColumn("path", path)


def documents(spark: SparkSession, path: str, most: int = 50 << 20) -> DataFrame:
    """Files with their format and SHA-256; the first path of equal contents."""
    df = spark.read.format("binaryFile").load(path).filter(F.col("length") <= most)
    found = df.select("path", "length", file_format(F.col("content"), F.lit(""), F.col("path")).alias("format"), F.sha2("content", 256).alias("file_hash"))
    return found.groupBy("file_hash").agg(F.min_by(F.struct("path", "length", "format"), "path").alias("f")).select("f.*", "file_hash")


def unzip(df: DataFrame, allowed: tuple[str, ...] = (".pdf", ".xlsx", ".xls", ".docx", ".doc"), most: int = 50 << 20) -> DataFrame:
    """(path, name, content) of the allowed members, below a size, of (path, content) rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        out += [(path, i.filename, z.read(i)) for i in z.infolist() if not i.is_dir() and i.filename.lower().endswith(allowed) and i.file_size < most]
                except (zipfile.BadZipFile, TypeError):
                    continue
            yield pd.DataFrame(out, columns=["path", "name", "content"])

    return df.select("path", "content").mapInPandas(run, "path string, name string, content binary")


#: Endings of members of an archive that are taken.
MEMBERS = (".pdf", ".xlsx", ".xls", ".html", ".htm", ".csv")

#: Bytes of unpacked members that a task holds.
HELD = 8 << 20


def members(archives: DataFrame, keys: list[str], allowed: tuple[str, ...] = MEMBERS, most: int = 50 << 20) -> DataFrame:
    """(keys, no, member, content) of the members with an allowed ending, below a size and not empty; a row without a
    member for an archive that can't be opened. Members are sent on as soon as they hold HELD bytes together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple[int, int | None, str | None, bytes | None]] = []  # of a row of the batch
            size = 0

            def out(found: list[tuple], batch: pa.RecordBatch = batch) -> pa.RecordBatch:
                of, no, name, data = zip(*found, strict=True)
                kept = batch.select(keys).take(pa.array(of))
                return pa.RecordBatch.from_arrays([*kept.columns, pa.array(no, pa.int32()), pa.array(name, pa.string()), pa.array(data, pa.binary())], names=[*keys, "no", "member", "content"])

            for i in range(batch.num_rows):
                try:
                    with zipfile.ZipFile(io.BytesIO(batch.column(len(keys))[i].as_py() or b"")) as z:
                        for no, info in enumerate(z.infolist()):
                            if not info.is_dir() and PurePosixPath(info.filename).suffix.lower() in allowed and info.file_size < most:
                                try:
                                    data = z.read(info)
                                except (zipfile.BadZipFile, RuntimeError, NotImplementedError, zlib.error, EOFError):
                                    continue  # this member alone
                                if data:
                                    found.append((i, no, info.filename, data))
                                    size += len(data)
                                    if size >= HELD:
                                        yield out(found)
                                        found, size = [], 0
                except zipfile.BadZipFile:
                    found.append((i, None, None, None))
            if found:
                yield out(found)

    kinds = ", ".join(f"{k} {archives.schema[k].dataType.simpleString()}" for k in keys)
    return archives.select(*keys, F.col("content").cast("binary")).mapInArrow(run, f"{kinds}, no int, member string, content binary")


def expanded(files: DataFrame, job: str, slug: str) -> DataFrame:
    """A job's files (job, slug, k, path, format, url, content), k their order, with each archive (format zip) replaced by its
    members: path {slug}_zip_{count}_{name}, format by name, the archive's url, member, SHA-256; pages among them cleaned for
    storage. Archives that can't be opened stay, as do all files of a job from whose archives nothing came."""
    key = [job, slug, "k", "url"]
    found = written(members(files.filter("format = 'zip'"), key))
    got = found.filter("member is not null")
    name = F.replace(F.element_at(F.split("member", "/"), -1), F.lit(" "), F.lit("_"))
    count = F.row_number().over(Window.partitionBy(job).orderBy("k", "no")) - 1
    page = format_by_name(F.col("member")) == "html"
    clean = F.when(page, F.encode(html.cleaned(F.when(page, html.decoded(F.col("content")))), "UTF-8")).otherwise(F.col("content"))
    numbered = got.select(*key, "no", "member", count.alias("n"))
    rows = numbered.join(got.select(job, "k", "no", clean.alias("content"), format_by_name(F.col("member")).alias("format")), [job, "k", "no"])
    out = rows.select(job, slug, "k", F.concat(slug, F.lit("_zip_"), F.when(F.length(F.col("n").cast("string")) < 2, F.lpad(F.col("n").cast("string"), 2, "0")).otherwise(F.col("n").cast("string")), F.lit("_"), name).alias("path"), "format", "url", "content", "member", F.sha2("content", 256).alias("file_hash"))
    some = got.select(job).distinct().withColumn("_some", F.lit(True))
    bad = found.filter("member is null").select(job, "k").withColumn("_bad", F.lit(True))
    marked = files.join(some, job, "left").join(bad, [job, "k"], "left")
    stay = marked.filter(F.col("_some").isNull() | (F.col("format") != "zip") | F.col("_bad").isNotNull())
    return stay.select(job, slug, "k", "path", "format", "url", "content", F.lit(None).cast("string").alias("member"), F.lit(None).cast("string").alias("file_hash")).unionByName(out)


def sheet_text(df: DataFrame, sheets: int = 2, rows: int = 50) -> DataFrame:
    """(path, text) of the first rows of the first sheets of (path, sheet, row, cells) rows."""
    near = df.filter((F.col("sheet") < sheets) & (F.col("row") < rows))
    return near.groupBy("path").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("sheet", "row", "cells"))), lambda r: F.array_join(r["cells"], " ")), "\n").alias("text"))


def write_by_name(df: DataFrame, path: str) -> None:
    """K8: rows in folders by slug, type and year."""
    df.write.mode("overwrite").partitionBy("slug", "kind", "year").parquet(path)


def canonical_name(slug: Column, key: Column, detected: Column, year: Column, path: Column, format_: Column) -> Column:
    """K8: `{slug}-{kind}-{year}{ending}` of a file that won a kind; key is the kind, or kind:year of another year. The ending is
    the path's own, or else the format."""
    parts = F.split(key, ":", 2)
    when = F.coalesce(F.try_element_at(parts, F.lit(2)).try_cast("int"), detected, year)
    ending = F.nullif(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1), F.lit(""))
    return F.concat(slug, F.lit("-"), parts[0], F.lit("-"), when, F.coalesce(ending, F.concat(F.lit("."), format_)))


def write_html_years(df: DataFrame, path: str) -> None:
    """K9: (slug, year, html) rows as text files in folders by slug and year."""
    df.select("slug", "year", F.col("html").alias("value")).write.mode("overwrite").partitionBy("slug", "year").text(path)
