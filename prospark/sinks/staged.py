"""A Python data source that writes rows of a keyed table as staged files, of which nothing counts before an action does.

format("staged") writes below `path` in folders of `table` and `action`, one file a task and bucket, and leaves a receipt of
the files of the tasks that Spark committed.  A task that dies or runs twice leaves a file that no receipt names.  Receipts
are read by prospark.sinks.store, which makes all tables of an action count at once.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

BUCKET = "_bucket"


def file_system(path: str):
    """(file system, path in it) of a path or URI, on the driver as in tasks."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Written(WriterCommitMessage):
    """What a task wrote: the bucket, the name and the rows of each file."""

    files: list[tuple[int, str, int]] = field(default_factory=list)


class StagedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "staged"

    def schema(self) -> str:
        raise ValueError("staged files are read through their store")

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return StagedWriter(dict(self.options))


class StagedWriter(DataSourceArrowWriter):
    """Rows (columns, _bucket) into <path>/data/<table>/<action>; a task holds one batch and the open files of its buckets."""

    def __init__(self, options: dict[str, str]):
        self.path, self.table, self.action = options["path"], options["table"], options["action"]
        self.folder = f"data/{self.table}/{self.action}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, root = file_system(self.path)
        files.create_dir(f"{root}/{self.folder}", recursive=True)
        task, writers, rows = uuid.uuid4().hex, {}, {}
        try:
            for batch in iterator:
                table = pa.Table.from_batches([batch])
                plain = table.drop_columns([BUCKET])
                for b in pc.unique(table.column(BUCKET)).to_pylist():
                    part = plain.filter(pc.equal(table.column(BUCKET), b))
                    if b not in writers:
                        writers[b] = pq.ParquetWriter(f"{root}/{self.folder}/b{b}-{task}.parquet", part.schema, filesystem=files, compression="zstd")
                    writers[b].write_table(part)
                    rows[b] = rows.get(b, 0) + len(part)
        finally:
            for w in writers.values():
                w.close()
        return Written([(b, f"{self.folder}/b{b}-{task}.parquet", n) for b, n in rows.items()])

    def commit(self, messages: list[Written | None]) -> None:
        files, root = file_system(self.path)
        files.create_dir(f"{root}/receipts", recursive=True)
        with files.open_output_stream(f"{root}/receipts/{self.action}-{self.table}.json") as out:
            out.write(json.dumps([f for m in messages if m for f in m.files]).encode())

    def abort(self, messages: list[Written | None]) -> None:
        files, root = file_system(self.path)
        for m in messages:
            for _, name, _ in m.files if m else ():
                files.delete_file(f"{root}/{name}")
