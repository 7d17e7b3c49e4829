"""A data source of landed pages: one partition per page, so that a pull of many cursor pages is read by as many tasks.

    register(spark)
    spark.read.format("landed_pages").load("hdfs://host/pages")

Pages are files named ``<pull>-<number>.json``; each holds its text and the cursor of the next. Files are reached by
pyarrow's file systems, so a path may be local or in any store that these know.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from ..session import put_on_path

_NAME = re.compile(r"(.+)-(\d+)\.json$")


class Page(InputPartition):
    def __init__(self, path: str, pull: str, number: int):
        self.path, self.pull, self.number = path, pull, number


def _file_system(path: str) -> tuple[Any, str]:
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


class PageReader(DataSourceReader):
    """Conditions on ``pull`` and ``number`` leave out pages before any is opened."""

    def __init__(self, path: str):
        self.path, self.kept = path, []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        ways = {EqualTo: lambda a, b: a == b, In: lambda a, b: a in b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b}
        for f in filters:
            if type(f) in ways and f.attribute in (("pull",), ("number",)):
                self.kept.append((f.attribute[0], ways[type(f)], f.value))
            else:
                yield f

    def partitions(self) -> list[Page]:
        from pyarrow import fs

        system, root = _file_system(self.path)
        found = [(x.path, m) for x in system.get_file_info(fs.FileSelector(root)) if (m := _NAME.search(x.base_name))]
        pages = [Page(path, m[1], int(m[2])) for path, m in found]
        return sorted((p for p in pages if all(way(getattr(p, name), value) for name, way, value in self.kept)), key=lambda p: (p.pull, p.number)) or [Page("", "", -1)]

    def read(self, page: Page) -> Iterator[tuple[str, int, str | None, str]]:
        if not page.path:
            return
        system, _ = _file_system(self.path)
        with system.open_input_stream(page.path) as file:
            body = file.read().decode("utf-8", "replace")
        try:
            cursor = json.loads(body).get("cursor")
        except (ValueError, AttributeError):
            cursor = None
        yield page.pull, page.number, cursor if isinstance(cursor, str) else None, body


class PageSource(DataSource):
    """(pull, number, cursor, body) of each page; a page that is no JSON has no cursor and keeps its text."""

    @classmethod
    def name(cls) -> str:
        return "landed_pages"

    def schema(self) -> str:
        return "pull string, number int, cursor string, body string"

    def reader(self, schema: Any) -> DataSourceReader:
        return PageReader(self.options["path"])


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, whose conditions then reach it."""
    put_on_path(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PageSource)


def pull_states(pages: DataFrame) -> DataFrame:
    """(pull, pages, state) of each pull: complete, or what is wrong: its first page or one between is missing, the last one names another, or one before the last names none."""
    by = pages.groupBy("pull").agg(F.count("*").alias("pages"), F.min("number").alias("low"), F.max("number").alias("high"), F.max_by("cursor", "number").alias("last"), F.count(F.when(F.coalesce("cursor", F.lit("")) != "", 1)).alias("named"))
    ends = F.coalesce("last", F.lit("")) == ""
    state = F.when((F.col("low") != 0) | (F.col("high") - F.col("low") + 1 != F.col("pages")), "page_missing").when(~ends, "cut_short").when(F.col("named") != F.col("pages") - 1, "ends_before_last").otherwise("complete")
    return by.select("pull", "pages", state.alias("state"))
