"""Token-id files with a shared zstandard dictionary: every document is a frame of its own, found by an offset index.

A dataset is a folder of `dictionary.bin`, `manifest.json` and one `shard-NNNNN.ids` per range of doc_id:

    b"IDSHARD1" | 8 bytes: start of the dictionary's sha256 | frames | index | footer
    index: n times (doc_id int64, flags int64: 1 where doc_id is null, offset int64, bytes int64, ids int64)
    footer: index offset int64, n int64, total ids int64, crc32 of the index int64, b"IDSHARD1"

A frame holds the ids as little-endian uint16 where the vocabulary fits, else uint32.  Readers refuse another dictionary.
The dictionary is trained on a bounded, documented sample of serialized documents (hash-spread over the whole table); it
is a codec setting: every document is written whole whatever the sample holds.  Tasks write under a temporary name and
rename, so retried or speculative tasks leave one complete shard.
"""

from __future__ import annotations

import hashlib
import json
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._tokens import TOKENIZER, encoder

MAGIC = b"IDSHARD1"
FOOTER = "<qqqq8s"


def _fs(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def _put(path: str, name: str, data: bytes) -> None:
    fs, base = _fs(path)
    with fs.open_output_stream(f"{base}/{name}") as out:
        out.write(data)


def _get(path: str, name: str) -> bytes:
    fs, base = _fs(path)
    with fs.open_input_stream(f"{base}/{name}") as source:
        return source.read()


def train_dictionary(docs: DataFrame, tokenizer: str, end_id: int, sample_docs: int = 2000, dictionary_bytes: int = 64 << 10) -> bytes:
    """zstandard dictionary of about sample_docs documents, those of the smallest hashes of doc_id over all rows.

    Samples are whole documents, serialized, in parts of 4 kB.  Tables too small to train on give an empty dictionary.
    """
    import zstandard

    n = docs.count()
    keep = docs if n <= sample_docs else docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * sample_docs / n))

    def run(batches):
        for batch in batches:
            for ids in encoder(tokenizer).encode(batch.column(0), end_id):
                yield pa.RecordBatch.from_arrays([pa.array([ids.astype(np.uint16 if encoder(tokenizer).tokenizer.get_vocab_size() <= 65536 else np.uint32).tobytes()], pa.binary())], ["ids"])

    rows = keep.select(F.col("text").cast("string")).mapInArrow(run, "ids binary").select(F.explode(F.transform(F.sequence(F.lit(0), F.floor((F.length("ids") - 1) / 4096).cast("int")), lambda i: F.substring("ids", i * 4096 + 1, F.lit(4096)))).alias("part"))
    total, samples = 0, []
    for r in rows.toLocalIterator():
        total += len(r.part)
        samples.append(bytes(r.part))
        if total > 1000 * dictionary_bytes:  # far beyond what sample_docs documents hold unless they are huge
            break
    try:
        return zstandard.train_dictionary(dictionary_bytes, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def _codec(dictionary: bytes):
    import zstandard

    data = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    return zstandard.ZstdCompressor(level=3, dict_data=data, write_checksum=True), zstandard.ZstdDecompressor(dict_data=data)


def write(docs: DataFrame, path: str, tokenizer: str = TOKENIZER, end_id: int = 1, sample_docs: int = 2000) -> None:
    """Encode all of docs and write a dataset to `path` (a URI all executors reach), in ascending doc_id order.

    Null texts are empty (the end id alone); null doc_ids come first; rows of equal doc_id go by text.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    fs, base = _fs(path)
    fs.create_dir(base, recursive=True)
    dictionary = train_dictionary(docs, tokenizer, end_id, sample_docs)
    _put(path, "dictionary.bin", dictionary)
    digest = hashlib.sha256(dictionary).digest()

    def run(batches):
        from pyspark import TaskContext

        context = TaskContext.get()
        shard = context.partitionId()
        name, temporary = f"shard-{shard:05d}.ids", f"_writing-{shard:05d}-{context.taskAttemptId()}"
        fs, base = _fs(path)
        compress = _codec(_get(path, "dictionary.bin"))[0].compress
        kind = np.uint16 if encoder(tokenizer).tokenizer.get_vocab_size() <= 65536 else np.uint32
        index, at, total = [], 16, 0
        with fs.open_output_stream(f"{base}/{temporary}") as out:
            out.write(MAGIC + digest[:8])
            for batch in batches:
                for k in range(0, batch.num_rows, 1024):
                    part = batch.slice(k, 1024)
                    for doc, ids in zip(part.column(0).to_pylist(), encoder(tokenizer).encode(part.column(1), end_id)):
                        frame = compress(ids.astype(kind).tobytes())
                        out.write(frame)
                        index.append((doc or 0, doc is None, at, len(frame), len(ids)))
                        at += len(frame)
                        total += len(ids)
            table = np.asarray(index, "<i8").reshape(-1, 5).tobytes()
            out.write(table + struct.pack(FOOTER, at, len(index), total, zlib.crc32(table), MAGIC))
        if index:
            fs.move(f"{base}/{temporary}", f"{base}/{name}")
        else:
            fs.delete_file(f"{base}/{temporary}")
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (shard, len(index), total, kind().itemsize)], ["shard", "docs", "tokens", "width"])

    ordered = docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    shards = sorted(r for r in ordered.mapInArrow(run, "shard long, docs long, tokens long, width long").collect() if r.docs)
    start, manifest = 0, []
    for r in shards:
        manifest.append({"shard": r.shard, "docs": r.docs, "tokens": r.tokens, "start": start})
        start += r.tokens
    _put(path, "manifest.json", json.dumps({"tokenizer": tokenizer, "end_id": end_id, "width": shards[0].width if shards else 2, "dictionary": digest.hex(), "shards": manifest}).encode())


class Shard:
    """One open shard: its index, and the ids of any document by one ranged read."""

    def __init__(self, path: str, shard: int, manifest: dict, decompressor):
        fs, base = _fs(path)
        self.file = fs.open_input_file(f"{base}/shard-{shard:05d}.ids")
        size = self.file.size()
        if self.file.read_at(16, 0) != MAGIC + bytes.fromhex(manifest["dictionary"])[:8]:
            raise ValueError(f"shard {shard} isn't of this dictionary")
        at, n, self.tokens, crc, magic = struct.unpack(FOOTER, self.file.read_at(40, size - 40))
        table = self.file.read_at(n * 40, at)
        if magic != MAGIC or zlib.crc32(table) != crc:
            raise ValueError(f"shard {shard} is damaged")
        self.index = np.frombuffer(table, "<i8").reshape(-1, 5)
        self.kind = np.dtype("<u2" if manifest["width"] == 2 else "<u4")
        self.decompress = decompressor.decompress

    def ids(self, k: int) -> np.ndarray:
        _, _, at, size, n = self.index[k].tolist()
        return np.frombuffer(self.decompress(self.file.read_at(size, at), max_output_size=n * self.kind.itemsize), self.kind)


def _open(path: str):
    manifest, dictionary = json.loads(_get(path, "manifest.json")), _get(path, "dictionary.bin")
    if hashlib.sha256(dictionary).hexdigest() != manifest["dictionary"]:
        raise ValueError("the dictionary isn't that of the manifest")
    return manifest, _codec(dictionary)[1]


def read(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """One row per document, from the files: doc_id, start (ids before it), n_tokens, ids_crc32 and its ids if asked."""
    count = len(json.loads(_get(path, "manifest.json"))["shards"])
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids

    def run(batches):
        manifest, decompressor = _open(path)
        for batch in batches:
            for k in batch.column(0).to_pylist():
                entry = manifest["shards"][k]
                shard, start = Shard(path, entry["shard"], manifest, decompressor), entry["start"]
                for begin in range(0, len(shard.index), 2000):
                    part, ids = shard.index[begin : begin + 2000], [shard.ids(i) for i in range(begin, min(begin + 2000, len(shard.index)))]
                    columns = [
                        pa.array(part[:, 0], mask=part[:, 1] > 0),
                        pa.array(start + np.cumsum(part[:, 4]) - part[:, 4]),
                        pa.array([len(x) for x in ids], pa.int64()),
                        pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()),
                    ]
                    start += int(part[:, 4].sum())
                    if with_ids:
                        columns.append(pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())))
                    yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in schema.split(", ")])

    return spark.range(0, count, 1, max(1, count)).mapInArrow(run, schema)


def lookup(path: str, doc_id: int) -> np.ndarray | None:
    """The ids of one document, by the index of each shard that may hold it and a single frame."""
    manifest, decompressor = _open(path)
    for entry in manifest["shards"]:
        shard = Shard(path, entry["shard"], manifest, decompressor)
        hits = np.flatnonzero((shard.index[:, 0] == doc_id) & (shard.index[:, 1] == 0))
        if len(hits):
            return shard.ids(int(hits[0]))
    return None
