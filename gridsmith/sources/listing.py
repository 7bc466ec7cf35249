"""A listing that is asked for page by page, as a data source with a partition for each page.

A page is the JSON object {Result, Records, TotalRecordCount}; Records have Id, CompanyUId and
Company. `path` is an address (pages are posted for, with jtStartIndex and jtPageSize) or a folder
that all executors share, with a file or folder of files `start=<index>` for each page. The first page tells how
many there are. A page that can't be read, or whose Result isn't OK, is a row with an error; the
listing ends before the first of those. `start` begins at a later page.

As a stream the offset is the number of records taken, so a run goes on from the last one's
checkpoint, within a page too that has grown since."""

from __future__ import annotations

import json
import re
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from gridsmith.catalogs import WANTED_FUNCTIONS

SIZE = 500


def fetch(path: str, start: int, size: int) -> dict:
    """One page; ValueError says what is wrong with it."""
    if re.match("https?://", path):
        request = urllib.request.Request(f"{path}?jtStartIndex={start}&jtPageSize={size}", data=b"", method="POST")
        with urllib.request.urlopen(request, timeout=30) as reply:
            text = reply.read().decode()
    else:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(path) if re.match("[a-z0-9+.-]+:/", path) else (fs.LocalFileSystem(), path)
        at = store.get_file_info(f"{base}/start={start}")
        if at.type == fs.FileType.NotFound:
            raise ValueError("no such page")
        found = [at] if at.type == fs.FileType.File else [f for f in store.get_file_info(fs.FileSelector(at.path)) if not f.base_name.startswith(("_", "."))]
        text = ""
        for f in sorted(found, key=lambda f: f.path):
            with store.open_input_stream(f.path, compression=None) as file:
                text += file.read().decode()
    page = json.loads(text)
    if not isinstance(page, dict) or page.get("Result") != "OK":
        raise ValueError(f"Result is {page.get('Result') if isinstance(page, dict) else type(page).__name__}")
    return page


@dataclass
class Page(InputPartition):
    start: int
    #: Records of the page before this one are left out, and those from `to` on.
    skip: int = 0
    to: int | None = None


class _Pages:
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.size, self.start = options["path"], int(options.get("size", SIZE)), int(options.get("start", 0))

    def total(self) -> int:
        return int(fetch(self.path, self.start, self.size).get("TotalRecordCount") or 0)

    def read(self, page: Page) -> Iterator[tuple]:
        number = page.start // self.size
        try:
            records = fetch(self.path, page.start, self.size).get("Records") or []
        except (ValueError, OSError) as e:
            yield number, None, None, None, str(e)
            return
        for r in records[page.skip : page.to]:
            yield number, int(r.get("Id") or 0), int(r.get("CompanyUId") or 0), (r.get("Company") or "").strip(), None


class _Reader(_Pages, DataSourceReader):
    def partitions(self) -> list[Page]:
        try:
            total = self.total()
        except (ValueError, OSError):
            total = 0  # the first page's row says why
        return [Page(s) for s in range(self.start, max(total, self.start + 1), self.size)]


class _Stream(_Pages, DataSourceStreamReader):
    def initialOffset(self) -> dict:  # noqa: N802
        return {"records": self.start}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"records": max(self.total(), self.start)}

    def partitions(self, start: dict, end: dict) -> list[Page]:
        a, b = start["records"], end["records"]
        return [Page(s, max(0, a - s), min(self.size, b - s)) for s in range(a // self.size * self.size, b, self.size)]

    def commit(self, end: dict) -> None:
        pass


class PagedListing(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged_listing"

    def schema(self) -> str:
        return "page long, id long, company_uid long, name string, error string"

    def reader(self, schema: object) -> _Reader:
        return _Reader(self.options)

    def streamReader(self, schema: object) -> _Stream:  # noqa: N802
        return _Stream(self.options)


def pages(spark: SparkSession, path: str, size: int = SIZE, start: int = 0) -> DataFrame:
    """All pages at once, errors as rows."""
    spark.dataSource.register(PagedListing)
    return spark.read.format("paged_listing").options(path=path, size=size, start=start).load()


def companies(spark: SparkSession, path: str, to: str, size: int = SIZE, start: int = 0) -> DataFrame:
    """(page, id, company_uid, name) up to the first page in error. Each page is asked for once: what comes is kept in the folder `to`."""
    pages(spark, path, size, start).write.parquet(to)
    got = spark.read.parquet(to)
    bad = got.agg(F.min(F.when(F.col("error").isNotNull(), F.col("page"))).alias("_bad"))  # one row
    return got.join(F.broadcast(bad)).filter(F.col("error").isNull() & F.coalesce(F.col("page") < F.col("_bad"), F.lit(True))).drop("error", "_bad")


def stream(spark: SparkSession, path: str, size: int = SIZE, start: int = 0) -> DataFrame:
    spark.dataSource.register(PagedListing)
    return spark.readStream.format("paged_listing").options(path=path, size=size, start=start).load()


def details(answers: DataFrame) -> DataFrame:
    """(id, company_uid, company_name, bdew_code, market_function, contact_name) of the answers (id, company_uid, company_name,
    content_type, body): of each company's records that of the most wanted function, the first of it, else the
    first record. Answers that aren't JSON, aren't OK or are empty, and codes that are empty, give none."""
    kind = "Result string, Records array<struct<BdewCode:string,MarketFunctionName:string,ContactName:string>>"
    said = answers.filter(F.contains(F.lower("content_type"), F.lit("json"))).withColumn("a", F.from_json("body", kind)).filter("a.Result = 'OK' and size(a.Records) > 0")
    of = lambda name: F.try_element_at(F.filter("a.Records", lambda r: r["MarketFunctionName"] == name), F.lit(1))
    best = said.withColumn("b", F.coalesce(*map(of, WANTED_FUNCTIONS), F.col("a.Records")[0]))
    return best.select("id", "company_uid", "company_name", F.col("b.BdewCode").alias("bdew_code"), F.col("b.MarketFunctionName").alias("market_function"), F.col("b.ContactName").alias("contact_name")).filter("bdew_code != ''")
