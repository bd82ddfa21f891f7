"""A cursor-paginated register as a Python data source: a partition a page, one edition for the whole load."""

from __future__ import annotations

import csv
import io

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class PagedSource(DataSource):
    """format("paged") over `fetch`, the name "module:function" of a function cursor -> (edition, csv text, next cursor).

    Cursors are followed on the driver without keeping the pages, from option `cursor` on; a change of edition on the way
    raises, so no load mixes two.  Each task fetches its own page and checks the edition again.  If there are more than
    `pages` pages, the load raises and names the cursor to go on from, unless option `partial` is true.
    """

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return self.options["columns"]

    def reader(self, schema):
        return PagedReader(schema, self.options)


class PagedReader(DataSourceReader):
    def __init__(self, schema, options):
        self.names, self.options = schema.names, dict(options)

    def _fetch(self, cursor):
        from importlib import import_module

        module, _, function = self.options["fetch"].partition(":")
        return getattr(import_module(module), function)(cursor)

    def partitions(self):
        cursor, edition, out = self.options.get("cursor", ""), None, []
        while cursor is not None and len(out) < int(self.options.get("pages", 17)):
            found, _, following = self._fetch(cursor)
            if edition is not None and found != edition:
                raise ValueError("the source changed its edition during the load")
            edition = found
            out.append(InputPartition((cursor, edition)))
            cursor = following
        if cursor is not None and self.options.get("partial", "false").lower() != "true":
            raise ValueError(f"the source has more than {len(out)} pages: the next one is at cursor {cursor}")
        return out

    def read(self, partition):
        cursor, edition = partition.value
        found, text, _ = self._fetch(cursor)
        if found != edition:
            raise ValueError("the source changed its edition during the load")
        for row in csv.DictReader(io.StringIO(text)):
            yield tuple(row.get(n) or None for n in self.names)
