"""The citation database over REST: paged search and lookups, as a Spark data source.

``fetch`` is any function from a URL and parameters to status, headers and
body, so tests need no network.  Requests are repeated on network errors, on
429 and on server errors, with the waiting time the server names or doubled
each time; other errors are the row's result and are cached as such.
"""

from __future__ import annotations

import json
import os
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..config import ApiSettings

Response = tuple[int, dict[str, str], str]
Fetch = Callable[[str, dict[str, str]], Response]


class ApiError(RuntimeError):
    def __init__(self, status: int, body: str):
        super().__init__(f"HTTP {status}: {body[:200]}")
        self.status = status


def http_fetch(url: str, params: dict[str, str]) -> Response:
    """The key is read where the request is made and goes into a header, never into a plan or a log."""
    request = urllib.request.Request(f"{url}?{urllib.parse.urlencode(params)}", headers={"Accept": "application/json", os.environ.get("CITATION_API_HEADER", "X-API-Key"): os.environ["CITATION_API_KEY"]})
    try:
        with urllib.request.urlopen(request, timeout=ApiSettings().timeout_s) as r:
            return r.status, dict(r.headers), r.read().decode()
    except urllib.error.HTTPError as e:
        return e.code, dict(e.headers), e.read().decode(errors="replace")


def get(url: str, params: dict[str, str], fetch: Fetch = http_fetch, settings: ApiSettings = ApiSettings(), sleep: Callable[[float], None] = time.sleep) -> dict:
    """One polite GET with retries, parsed."""
    last: Exception | None = None
    for n in range(settings.attempts):
        try:
            status, headers, body = fetch(url, params)
        except OSError as e:
            last = e
            sleep(2**n)
            continue
        if status == 200:
            sleep(settings.pause_s)
            return json.loads(body)
        last = ApiError(status, body)
        if status != 429 and status < 500:
            raise last
        sleep(float(headers.get("Retry-After", 2**n)))
    raise last or RuntimeError("no attempt was made")


def page(url: str, query: str, start: int, count: int, fetch: Fetch, settings: ApiSettings = ApiSettings(), sleep: Callable[[float], None] = time.sleep) -> tuple[int, list[dict]]:
    """The total and one page's entries; a page whose first entry is an error is empty."""
    found = get(url, {"query": query, "start": str(start), "count": str(count)}, fetch, settings, sleep).get("search-results", {})
    entries = found.get("entry") or []
    entries = [entries] if isinstance(entries, dict) else entries
    return int(found.get("opensearch:totalResults") or 0), [] if entries and "error" in entries[0] else entries


def search(url: str, query: str, fetch: Fetch = http_fetch, count: int = 25, max_results: int | None = None, settings: ApiSettings = ApiSettings(), sleep: Callable[[float], None] = time.sleep) -> Iterator[dict]:
    """All entries in order, page by page, until the total, an empty page, or ``max_results``."""
    start = given = 0
    while True:
        total, entries = page(url, query, start, count, fetch, settings, sleep)
        for e in entries:
            if max_results is not None and given >= max_results:
                return
            given += 1
            yield e
        start += count
        if not entries or start >= total:
            return


class _Page(InputPartition):
    def __init__(self, start: int):
        super().__init__(start)
        self.start = start


class SearchReader(DataSourceReader):
    """A partition for each page: the first request on the driver tells how many there are."""

    def __init__(self, options: dict[str, str], fetch: Fetch):
        self.url, self.query, self.count = options["url"], options["query"], int(options.get("pagesize", 25))
        self.most = int(options["maxresults"]) if "maxresults" in options else None
        self.fetch = fetch

    def partitions(self) -> list[_Page]:
        total, _ = page(self.url, self.query, 0, 1, self.fetch)
        total = total if self.most is None else min(total, self.most)
        return [_Page(s) for s in range(0, total, self.count)] or [_Page(0)]

    def read(self, partition: _Page) -> Iterator[tuple[int, str]]:
        _, entries = page(self.url, self.query, partition.start, self.count, self.fetch)
        for i, e in enumerate(entries):
            if self.most is None or partition.start + i < self.most:
                yield partition.start + i, json.dumps(e)


class CitationSearch(DataSource):
    """``spark.read.format("citation_search").option("url", ...).option("query", ...)``: rows ``(ord, payload)``."""

    fetch: Fetch = staticmethod(http_fetch)

    @classmethod
    def name(cls) -> str:
        return "citation_search"

    def schema(self) -> str:
        return "ord bigint, payload string"

    def reader(self, schema: StructType) -> SearchReader:
        return SearchReader({k.lower(): v for k, v in self.options.items()}, type(self).fetch)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(CitationSearch)


def look_up(wanted: DataFrame, url: str, fetch: Fetch = http_fetch) -> DataFrame:
    """``wanted(key, scopus_id)`` to ``(key, value)``: payloads, or an error marker that keeps the id from being asked again."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i in b["scopus_id"]:
                try:
                    out.append(json.dumps(get(f"{url}/{i}", {"view": "FULL"}, fetch)))
                except (ApiError, OSError, ValueError) as e:
                    out.append(json.dumps({"_error": str(e)}))
            yield pd.DataFrame({"key": b["key"], "value": out})

    return wanted.select("key", "scopus_id").mapInPandas(run, "key string, value string")


def captured(spark: SparkSession, path: str) -> DataFrame:
    """Search pages saved as JSON files, one page each, in the order of their names: rows ``(ord, payload)``, ord being file and place."""
    pages = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("f"), F.try_parse_json("value").alias("v"))
    entry = F.try_variant_get("v", "$['search-results'].entry", "array<variant>")
    rows = pages.select("f", F.posexplode(entry).alias("i", "payload")).where(F.try_variant_get("payload", "$.error", "string").isNull())
    return rows.select(F.struct("f", "i").alias("ord"), F.to_json("payload").alias("payload"))
