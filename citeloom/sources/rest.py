"""Paged search and point fetches: a Spark data source over pages, and rate-limited adapters."""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from citeloom.sources import schemas


def fetch_with_retry(url: str, get: Callable[[str], tuple[int, str]], attempts: int = 3, sleep: Callable[[float], None] = time.sleep) -> dict | None:
    """JSON of a page: 429 waits a minute, connection errors wait ten seconds more each time; None when attempts are used up."""
    for i in range(attempts):
        try:
            status, body = get(url)
        except (OSError, TimeoutError):
            sleep(10 * (i + 1))
            continue
        if status == 429:
            sleep(60)
        elif status == 200:
            return json.loads(body)
        else:
            return None
    return None


def http_get(url: str, headers: dict | None = None, timeout: float = 30) -> tuple[int, str]:
    from urllib.error import HTTPError
    from urllib.request import Request, urlopen

    try:
        with urlopen(Request(url, headers=headers or {}), timeout=timeout) as r:  # noqa: S310
            return r.status, r.read().decode("utf-8")
    except HTTPError as e:
        return e.code, ""


class _Page(InputPartition):
    def __init__(self, at: str):
        self.at = at


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        """One partition per page: landed page files of `pages`, or page numbers of `url` up to `limit` / `page_size`."""
        if "pages" in self.options:
            d = self.options["pages"]
            return [_Page(os.path.join(d, f)) for f in sorted(os.listdir(d)) if f.endswith(".json")]
        size, limit = int(self.options.get("page_size", 100)), int(self.options.get("limit", 500))
        return [_Page(f"{self.options['url']}&page_size={size}&page={i + 1}") for i in range(-(-limit // size))]

    def read(self, page: _Page) -> Iterator[tuple]:
        if "pages" in self.options:
            with open(page.at, encoding="utf-8") as f:
                got = json.load(f)
        else:
            got = fetch_with_retry(page.at, http_get) or {"results": []}
        for hit in got.get("results", []):
            yield (json.dumps(hit),)


class PagedSearch(DataSource):
    """Rows (hit string) of a paged search; give `pages` (a folder of landed pages) or `url`, `page_size` and `limit`."""

    @classmethod
    def name(cls) -> str:
        return "paged_search"

    def schema(self) -> str:
        return "hit string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def search(spark: SparkSession, limit: int = 500, **options: str) -> DataFrame:
    """Search hits with the fixed schema, `limit` at most."""
    from pyspark.sql import functions as F

    spark.dataSource.register(PagedSearch)
    df = spark.read.format("paged_search").options(limit=str(limit), **options).load()
    return df.select(F.from_json("hit", schemas.RAW_HIT).alias("h")).select("h.*").limit(limit)


def looked_up(df: DataFrame, key: str, schema: str, fetch: Callable[[str], dict | None], delay: float = 0.5) -> DataFrame:
    """df's distinct keys with what `fetch` says of each (a dict of the schema's other fields, or None for nothing), `delay` seconds apart in each task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k in b[key]:
                if (got := fetch(k)) is not None:
                    rows.append({key: k, **got})
                time.sleep(delay)
            yield pd.DataFrame(rows, columns=[f.split()[0] for f in schema.split(", ")])

    return df.select(key).distinct().mapInPandas(run, schema)
