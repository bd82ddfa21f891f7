"""A cursor-paginated register as a stream: the cursor is the offset, and each page is fetched once.

A page that comes in is kept in the shared folder `spool` before its offset is told, so tasks, retries and restarts read the
same text and the register isn't asked again.  The next page is that after the newest one kept.  Pages of batches that are
done go.  A new edition of the register on the way stops the stream and names the cursor.
"""

from __future__ import annotations

import csv
import io
import json

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..sinks.staged import file_system


class PagedStream(DataSource):
    """format("paged_stream") over `fetch`, "module:function" of cursor -> (edition, csv text, next cursor or None).

    Options: columns (DDL), spool (a folder that all see), cursor (to begin from) and pages (at most for a batch, 1).
    """

    @classmethod
    def name(cls) -> str:
        return "paged_stream"

    def schema(self) -> str:
        return self.options["columns"]

    def streamReader(self, schema) -> DataSourceStreamReader:
        return PagedStreamReader(schema, dict(self.options))


class PagedStreamReader(DataSourceStreamReader):
    def __init__(self, schema, options: dict[str, str]):
        self.names, self.options = schema.names, options

    def _at(self, name: str = ""):
        files, root = file_system(self.options["spool"])
        return files, f"{root}/{name}" if name else root

    def _kept(self) -> list[int]:
        from pyarrow import fs

        files, root = self._at()
        found = files.get_file_info(fs.FileSelector(root, allow_not_found=True))
        return sorted(int(x.base_name[:-5]) for x in found if x.base_name.endswith(".json") and x.base_name[0].isdigit())

    def _page(self, number: int) -> dict:
        files, path = self._at(f"{number:09}.json")
        with files.open_input_stream(path) as f:
            return json.loads(f.read())

    def _keep(self, number: int, page: dict) -> None:
        files, path = self._at(f"{number:09}.json")
        files.create_dir(self._at()[1], recursive=True)
        with files.open_output_stream(path + ".part") as f:
            f.write(json.dumps(page).encode())
        files.move(path + ".part", path)

    def _fetch(self, cursor: str):
        from importlib import import_module

        module, _, function = self.options["fetch"].partition(":")
        return getattr(import_module(module), function)(cursor)

    def initialOffset(self) -> dict:
        return {"page": 0, "cursor": self.options.get("cursor", "")}

    def latestOffset(self) -> dict:
        kept = self._kept()
        number = kept[-1] if kept else 0
        last = self._page(number) if kept else {"next": self.options.get("cursor", ""), "edition": None}
        for _ in range(int(self.options.get("pages", 1))):
            if last["next"] is None:
                break
            edition, text, following = self._fetch(last["next"])
            if last["edition"] is not None and edition != last["edition"]:
                raise ValueError(f"the source changed its edition: go on from cursor {last['next']!r} with a new stream")
            number, last = number + 1, {"edition": edition, "text": text, "next": following}
            self._keep(number, last)
        return {"page": number, "cursor": last["next"] or ""}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [InputPartition(k) for k in range(start["page"] + 1, end["page"] + 1)]

    def read(self, partition: InputPartition):
        for row in csv.DictReader(io.StringIO(self._page(partition.value)["text"])):
            yield tuple(row.get(n) or None for n in self.names)

    def commit(self, end: dict) -> None:
        """Pages before `end` go; the last one stays, as it knows the next cursor."""
        files, _ = self._at()
        for k in self._kept():
            if k < end["page"]:
                files.delete_file(self._at(f"{k:09}.json")[1])
