"""A paged HTTP-like source as a Python data source: one partition walks the pages.

The fetcher is any callable `start -> (rows, next start or None)`, given by import path, so that
executors can load it: format("paged").option("fetcher", "module:function").
"""

from __future__ import annotations

import importlib

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class PagedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "id string, title string, version long, body string"

    def reader(self, schema):
        return _PagedReader(self.options)


class _PagedReader(DataSourceReader):
    def __init__(self, options):
        self.target, self.start = options["fetcher"], int(options.get("start", 0))

    def partitions(self):
        return [InputPartition(self.start)]

    def read(self, partition):
        module, _, name = self.target.partition(":")
        fetch = getattr(importlib.import_module(module), name)
        start = partition.value
        while start is not None:
            rows, start = fetch(start)
            for r in rows:
                yield (r["id"], r["title"], int(r["version"]), r["body"])
