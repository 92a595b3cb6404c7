"""Blocks of documents, and an exchange of hashed keys between them in packed form.

Some operators need, for every distinct key of a block of documents (an n-gram, a window), a value
that depends on all blocks.  A row for each key and block would make the shuffle many times the
text.  Here a block sends its distinct keys sorted, cut by their high bits into buckets and packed
(differences, bytes transposed, zstd): a few bytes a key.  A bucket merges what all blocks sent and
replies to each block with one value for each of its keys, in the same order, so that keys need
not travel back.  Keys are 64-bit hashes, thus buckets are even, and a key that a third of all rows
share is one entry of each block.

Blocks are row groups of a copy of (key, text) in the shared folder: later passes read the same
rows in the same order whatever happens to executors, and nothing of the text is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import shared
from tessera.llm.kernel import U64

#: Bytes of a block as the Parquet writer counts them (compressed pages), and bytes of text for each bucket.
BLOCK_BYTES, BUCKET_BYTES = 4 << 20, 16 << 20
ROWS = "kind string, block bigint, bucket int, payload binary"


def pack(values: np.ndarray, sorted_keys: bool = False, few: bool = False) -> bytes:
    """Fixed-width integers or floats, compressed; sorted keys as differences; values of which few differ as codes."""
    v = np.ascontiguousarray(values)
    if sorted_keys and len(v):
        v = np.diff(v, prepend=v.dtype.type(0))
    if few and len(v):
        distinct, code = np.unique(v, return_inverse=True)
        if len(distinct) <= 1 << 16:
            known = _squeeze(distinct)
            return (_CODED | len(known)).to_bytes(8, "little") + known + _squeeze(code.astype("<u2"))
    return _squeeze(v)


#: Marks a header: the length of the packed distinct values follows in it, then these, then the codes.
_CODED = 1 << 63


def _squeeze(v: np.ndarray) -> bytes:
    raw = v.view(np.uint8).reshape(len(v), v.itemsize).T.tobytes() if len(v) else b""
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(data: bytes, kind: str, sorted_keys: bool = False) -> np.ndarray:
    size = int.from_bytes(data[:8], "little")
    if size & _CODED:
        at = 8 + (size ^ _CODED)
        return unpack(data[8:at], kind)[unpack(data[at:], "<u2")]
    raw = np.frombuffer(pa.decompress(data[8:], decompressed_size=size, codec="zstd", asbytes=True), np.uint8) if size else np.zeros(0, np.uint8)
    item = np.dtype(kind).itemsize
    v = np.ascontiguousarray(raw.reshape(item, -1).T).reshape(-1).view(kind) if size else np.zeros(0, kind)
    return np.cumsum(v, dtype=kind) if sorted_keys and len(v) else v


def join_parts(parts: list[bytes]) -> bytes:
    return b"".join(len(p).to_bytes(8, "little") + p for p in parts)


def split_parts(data: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(data):
        n = int.from_bytes(data[at : at + 8], "little")
        out.append(data[at + 8 : at + 8 + n])
        at += 8 + n
    return out


class Blocks:
    """A copy of (doc_id, text) in the shared folder, read block by block on executors."""

    def __init__(self, docs: DataFrame, key: str = "doc_id", text: str = "text", n_buckets: int | None = None):
        self.spark = docs.sparkSession
        self.uri = shared.new_dir(self.spark, "blocks")
        src = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
        src.write.option("compression", "zstd").option("parquet.block.size", BLOCK_BYTES).parquet(f"{self.uri}/rows")
        files = sorted(self.spark.read.parquet(f"{self.uri}/rows").inputFiles())
        # Only the names of files are listed here; their row groups are counted by the executors.
        names = self.spark.createDataFrame([(i, f) for i, f in enumerate(files)], "file bigint, path string").repartitionById(max(1, len(files)), F.col("file").cast("int"))
        names.mapInArrow(_row_groups, "block bigint, path string, part int, bytes bigint").write.parquet(f"{self.uri}/blocks")
        self.table = self.spark.read.parquet(f"{self.uri}/blocks")
        size = self.table.agg(F.count("*").alias("n"), F.sum("bytes").alias("b")).first()
        self.table = self.table.drop("bytes")
        # Buckets follow the size of the text, not the number of files it happens to lie in.
        self.n, self.n_buckets = size.n, n_buckets or 1 << max(3, (-(-int(size.b or 0) // BUCKET_BYTES)).bit_length())

    def rows(self) -> DataFrame:
        """One row per block, each in a partition of its own as far as these go."""
        return self.table.repartition(max(1, self.n), "block")


def _row_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i, path in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            fs, p = shared.open_fs(path)
            with fs.open_input_file(p) as f:
                meta = pq.ParquetFile(f).metadata
                n = [k for k in range(meta.num_row_groups) if meta.row_group(k).num_rows]
                sizes = [meta.row_group(k).total_byte_size for k in n]
            yield pa.RecordBatch.from_arrays([pa.array([i << 20 | k for k in n], pa.int64()), pa.array([path] * len(n), pa.string()), pa.array(n, pa.int32()), pa.array(sizes, pa.int64())], names=["block", "path", "part", "bytes"])


def read_block(path: str, part: int) -> pa.RecordBatch:
    fs, p = shared.open_fs(path)
    with fs.open_input_file(p) as f:
        t = pq.ParquetFile(f).read_row_group(part, columns=["doc_id", "text"]).combine_chunks()
    return t.to_batches()[0]


def bucket_edges(keys: np.ndarray, n_buckets: int) -> np.ndarray:
    """Where each bucket of sorted keys begins (and the last ends)."""
    bits = n_buckets.bit_length() - 1
    lows = np.arange(n_buckets, dtype=U64) << U64(64 - bits)
    return np.append(np.searchsorted(keys, lows), len(keys))


def requests(kind: str, block: int, keys: np.ndarray, n_buckets: int, *values: np.ndarray) -> Iterator[tuple[str, int, int, bytes]]:
    """A block's request to each bucket: sorted distinct keys, and arrays of values that go with them."""
    at = bucket_edges(keys, n_buckets)
    for b in range(n_buckets):
        if at[b] < at[b + 1]:
            s = slice(at[b], at[b + 1])
            yield kind, block, b, join_parts([pack(keys[s], True), *[pack(v[s], few=v.dtype.kind == "f") for v in values]])


def arrow_rows(rows: list[tuple[str, int, int, bytes]]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.string(), pa.int64(), pa.int32(), pa.binary()], strict=True)], names=["kind", "block", "bucket", "payload"])


def merge(sent: DataFrame, fold) -> DataFrame:
    """Replies to requests: fold(kind, keys, index, values, bucket, block of each entry) gives a value for each entry.

    keys: distinct keys of the bucket, sorted; index: the key of each entry; entries are those of
    all blocks, one after the other.  fold may return a second item: rows to pass on as they are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tessera.llm.neardup import runs

        coded = (pa.RecordBatch.from_arrays([b.column("bucket"), b.column("tag"), b.column("kind"), b.column("block"), b.column("payload")], names=["bucket", "tag", "kind", "block", "payload"]) for b in batches)
        for t in runs(coded, 2):
            kind, bucket = t.column("kind")[0].as_py(), t.column("bucket")[0].as_py()
            blocks = t.column("block").to_pylist()
            got = [split_parts(p) for p in t.column("payload").to_pylist()]
            keys = [unpack(g[0], "<u8", True) for g in got]
            sizes = [len(k) for k in keys]
            values = [np.concatenate([unpack(g[i], fold.kinds[i - 1]) for g in got]) for i in range(1, len(got[0]))]
            distinct, index = np.unique(np.concatenate(keys), return_inverse=True)
            del keys
            answer, extra = fold(kind, distinct, index, values, bucket, np.repeat(np.array(blocks), sizes))
            ends = np.cumsum(sizes)
            rows = [(kind, blk, bucket, join_parts([pack(a[e - n : e], few=a.dtype.kind == "f") for a in answer])) for blk, n, e in zip(blocks, sizes, ends.tolist(), strict=True)]
            yield arrow_rows(rows + extra)

    tagged = sent.withColumn("tag", F.crc32("kind").cast("bigint"))
    return tagged.repartition("bucket", "tag").sortWithinPartitions("bucket", "tag", "block").mapInArrow(run, ROWS)


def by_block(rows: DataFrame, blocks: Blocks, only: DataFrame | None = None) -> DataFrame:
    """All rows of a block side by side, with the block's path and part, in order of block, kind and bucket (kind is null for a block without rows); of the blocks in `only`, if given."""
    return (blocks.table if only is None else only).join(rows, "block", "left").select("block", "path", "part", "kind", "bucket", "payload").repartition(max(1, blocks.n), "block").sortWithinPartitions("block", "kind", "bucket")


def block_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, str, int, dict[str, list[bytes]]]]:
    """block, path, part and, by kind, the payloads in order of buckets."""
    from tessera.llm.neardup import runs

    for t in runs(batches, 1):
        got: dict[str, list[bytes]] = {}
        for k, p in zip(t.column("kind").to_pylist(), t.column("payload").to_pylist(), strict=True):
            if k is not None:
                got.setdefault(k, []).append(p)
        yield t.column("block")[0].as_py(), t.column("path")[0].as_py(), t.column("part")[0].as_py(), got


def answers(payloads: list[bytes] | None, i: int, kind: str) -> np.ndarray:
    """The i-th value of all replies of one kind: aligned with the sorted keys that were asked for."""
    return np.concatenate([unpack(split_parts(p)[i], kind) for p in payloads]) if payloads else np.zeros(0, kind)


