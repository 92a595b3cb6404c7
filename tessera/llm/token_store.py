"""Token-id store: raw id payloads on shared storage, with a minimal perfect hash index over document keys.

Layout of a store (all integers little-endian):

    payload/<shard>.ids     the ids of all documents of the shard, end to end, 2 or 4 bytes each
    docs/<shard>.pos        int64 positions: where each document starts in the shard, and the shard's end
    index/<bucket>.mph      minimal perfect hash of the bucket's keys with, per slot, a 32-bit fingerprint,
                            shard, row within the shard, first id, number of ids and number of equal keys

Shards hold contiguous ranges of keys in ascending order, so that shard after shard is the whole
corpus in key order.  A key hashes to one index bucket; there, levels of bit arrays (each key sits
at the first level where it collides with no other key) and a rank over the set bits give its slot
without storing keys.  Looking a key up costs one bucket, one or two bit probes, one fingerprint
comparison and one read of the payload, whatever the size of the store.  A key that is not in the
store fails its fingerprint with probability 1 - 2**-32.

Null texts count as empty.  A null key sorts first and its document is stored; it is found under
no key but is returned by `scan`.  Rows that share a key are stored side by side, and the index
gives the first and their number.  An empty table gives a store without shards.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import shared
from tessera.llm.kernel import U64, mix

#: Bits per key of a level of the hash; 2 keeps lookups near 1.6 probes.
GAMMA = 2.0
SHARD_BYTES = 32 << 20
BUCKET_KEYS = 1 << 17
#: A letters-only word with punctuation behind it; both parts are pre-tokens of their own.
_PLAIN = re.compile("([A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+)([.,!?;:#$%&*|\"()]*)\\Z")
CACHE = 500_000


class WordEncoder:
    """Ids of whole texts by the tokenizers library, remembered word by word.

    For vocabularies whose pre-tokenizer drops white space a text's ids are its words' ids, so that
    each distinct word goes through the library once per worker (until the cache is full and starts
    anew).  Other vocabularies are encoded text by text.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        size = self.lib.get_vocab_size(with_added_tokens=True)
        self.kind = np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")
        probe = [self.lib.encode(x, add_special_tokens=False).ids for x in ("ab cd", "ab", "cd", " ", "\n", "\t")]
        self.by_word = probe[0] == probe[1] + probe[2] and not any(probe[3:])
        self.lower = self.by_word and self.lib.encode("AB", add_special_tokens=False).ids == probe[1]
        self.words: dict[str, bytes] = {"": b""}
        self.stems: dict[str, bytes] = {}
        from tessera.llm.bpe import byte_chars

        self.stand_in = {b: c for c, b in byte_chars().items()}
        self.model = self.lib.model

    def _pack(self, ids: list[int]) -> bytes:
        return np.asarray(ids, self.kind).tobytes()

    def _stem(self, s: str) -> bytes:
        """Ids of one pre-token of letters: straight to the library's model."""
        got = self.stems.get(s)
        if got is None:
            if len(self.stems) > CACHE:
                self.stems.clear()
            got = self._pack([t.id for t in self.model.tokenize(s if s.isascii() else s.encode().decode("latin-1").translate(self.stand_in))])
            self.stems[s] = got
        return got

    def _word(self, w: str) -> bytes:
        if self.lower and len(w) <= 64 and (m := _PLAIN.match(w)):
            return self._stem(m[1].lower()) + (self._stem(m[2]) if m[2] else b"")
        return self._pack(self.lib.encode(w, add_special_tokens=False).ids)

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.by_word:
            return self._pack(self.lib.encode(text, add_special_tokens=False).ids)
        known = self.words
        words = text.replace("\n", " ").split(" ")
        try:
            return b"".join([known[w] for w in words])
        except KeyError:
            if len(known) > CACHE:
                known.clear()
                known[""] = b""
            fresh = {}
            for w in words:
                if w not in known and w not in fresh:
                    fresh[w] = self._word(w)
            known.update((w, ids) for w, ids in fresh.items() if len(w) <= 64)
            return b"".join([known[w] if w in known else fresh[w] for w in words])


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def key_hash(keys: np.ndarray, seed: int) -> np.ndarray:
    return mix(mix(keys.astype(np.int64).view(U64)) + U64(seed))


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys: n keys -> 0..n-1 without storing the keys."""

    def __init__(self, levels: list[np.ndarray], n: int):
        self.levels, self.n = levels, n
        self.sizes = [len(x) * 64 for x in levels]
        words = np.concatenate(levels) if levels else np.zeros(0, U64)
        self.words = words
        self.rank = np.zeros(len(words) + 1, np.int64)
        np.cumsum(np.bitwise_count(words), out=self.rank[1:])
        self.base = np.cumsum([0, *[len(x) for x in levels]])

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels, left, n = [], np.unique(keys.astype(np.int64)), 0
        n = len(left)
        while len(left):
            size = max(64, -(-int(GAMMA * len(left)) // 64) * 64)
            at = (key_hash(left, len(levels)) % U64(size)).astype(np.int64)
            hits = np.bincount(at, minlength=size)
            alone = hits[at] == 1
            bits = np.zeros(size, np.uint8)
            bits[at[alone]] = 1
            levels.append(np.packbits(bits, bitorder="little").view("<u8").astype(U64))
            left = left[~alone]
        return cls(levels, n)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key; a key that was not built in gets an arbitrary slot or -1."""
        out = np.full(len(keys), -1, np.int64)
        todo = np.arange(len(keys))
        for level, size in enumerate(self.sizes):
            if not len(todo):
                break
            at = (key_hash(keys[todo], level) % U64(size)).astype(np.int64)
            word = self.words[self.base[level] + (at >> 6)]
            bit = (at & 63).astype(U64)
            hit = (word >> bit) & U64(1) == 1
            below = np.bitwise_count(word & ((U64(1) << bit) - U64(1))).astype(np.int64)
            got = todo[hit]
            out[got] = self.rank[self.base[level] + (at[hit] >> 6)] + below[hit]
            todo = todo[~hit]
        return out

    def to_bytes(self) -> bytes:
        return np.array([self.n, len(self.levels), *[len(x) for x in self.levels]], "<i8").tobytes() + self.words.astype("<u8").tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> tuple[PerfectHash, int]:
        n, k = np.frombuffer(raw, "<i8", 2)
        sizes = np.frombuffer(raw, "<i8", int(k), 16)
        at, levels = 16 + 8 * int(k), []
        for s in sizes:
            levels.append(np.frombuffer(raw, "<u8", int(s), at).astype(U64))
            at += 8 * int(s)
        return cls(levels, int(n)), at


SLOT = np.dtype([("mark", "<u4"), ("shard", "<i4"), ("row", "<i8"), ("first", "<i8"), ("n_ids", "<i8"), ("rows", "<i4")])
_MARK_SEED = 0x5F0C_A11B


def index_bucket(keys: np.ndarray, n_buckets: int) -> np.ndarray:
    return (key_hash(keys, 0x0B0C_4E75) % U64(n_buckets)).astype(np.int64)


def _arrow(schema: dict[str, tuple[pa.DataType, object]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, t) for t, v in schema.values()], names=list(schema))


class TokenStore:
    """A written store: where it lies, how many shards and index buckets it has, and the ids before each shard."""

    def __init__(self, uri: str, n_buckets: int, kind: str, shards: list[tuple[int, int, int]]):
        #: shards: (shard, documents, ids), by shard.
        self.uri, self.n_buckets, self.kind = uri, n_buckets, np.dtype(kind)
        self.shards = sorted(shards)
        ids = [n for _, _, n in self.shards]
        self.before = dict(zip([s for s, _, _ in self.shards], np.cumsum([0, *ids]).tolist(), strict=False))
        self.n_docs, self.n_ids = sum(d for _, d, _ in self.shards), sum(ids)

    # Access to one key, on the driver or in any worker.
    def get(self, key: int) -> list[np.ndarray]:
        """The ids of each document with this key; empty if there is none."""
        keys = np.array([key], np.int64)
        slot = self.find(int(index_bucket(keys, self.n_buckets)[0]), keys)[0]
        if slot["rows"] == 0:
            return []
        fs, root = shared.open_fs(self.uri)
        with fs.open_input_file(f"{root}/docs/{slot['shard']}.pos") as f:
            pos = np.frombuffer(f.read_at(8 * (int(slot["rows"]) + 1), 8 * int(slot["row"])), "<i8")
        with fs.open_input_file(f"{root}/payload/{slot['shard']}.ids") as f:
            raw = np.frombuffer(f.read_at(int(pos[-1] - pos[0]) * self.kind.itemsize, int(pos[0]) * self.kind.itemsize), self.kind)
        return [raw[a - pos[0] : b - pos[0]] for a, b in zip(pos[:-1], pos[1:], strict=True)]

    def find(self, bucket: int, keys: np.ndarray) -> np.ndarray:
        """Index entries of keys of one bucket; entries with rows = 0 for keys that are not in the store."""
        fs, root = shared.open_fs(self.uri)
        with fs.open_input_file(f"{root}/index/{bucket}.mph") as f:
            raw = f.read()
        mph, at = PerfectHash.from_bytes(raw)
        table = np.frombuffer(raw, SLOT, mph.n, at)
        out = np.zeros(len(keys), SLOT)
        slots = mph.slots(keys)
        there = np.flatnonzero(slots >= 0)
        got = table[slots[there]]
        ok = got["mark"] == key_hash(keys[there], _MARK_SEED).astype(np.uint32)
        out[there[ok]] = got[ok]
        return out


def shard_bounds(docs: DataFrame, key: str, text: str, shard_bytes: int) -> list[int]:
    """Upper keys of all shards but the last, from approximate quantiles of the keys: any choice is right, only sizes vary."""
    row = docs.agg(F.count("*").alias("n"), F.sum(F.octet_length(text)).alias("b")).first()
    n = max(1, min(-(-int(row.b or 0) // shard_bytes), int(row.n)))
    if n == 1:
        return []
    quantiles = docs.agg(F.percentile_approx(key, [i / n for i in range(1, n)], 100 * n)).first()[0]
    return sorted(set(quantiles or []))


def write_store(docs: DataFrame, path: str, uri: str, key: str = "doc_id", text: str = "text", end_id: int | None = 2, shard_bytes: int = SHARD_BYTES) -> TokenStore:
    """Encodes `text` with the tokenizer file `path`, appends `end_id` to each document and writes a store under `uri`.

    Encoding runs where the rows lie; only ids are shuffled, to the shard of their key's range.  A
    shard is one sequential write of one task, and the index is built from 40 bytes per document.
    """
    spark = docs.sparkSession
    bounds = shard_bounds(docs, key, text, shard_bytes)
    kind = word_encoder(path).kind

    def run_encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, cuts = word_encoder(path), np.array(bounds, np.int64)
        tail = b"" if end_id is None else np.array([end_id], enc.kind).tobytes()
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                keys = part.column(0)
                shards = np.searchsorted(cuts, keys.fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False), side="left").astype(np.int32)
                ids = [enc.encode(t) + tail for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([keys, pa.array(shards), pa.array(ids, pa.binary())], names=["key", "shard", "ids"])

    encoded = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).mapInArrow(run_encode, "key bigint, shard int, ids binary")
    placed = encoded.repartitionById(len(bounds) + 1, F.col("shard")).sortWithinPartitions(F.col("shard"), F.col("key").asc_nulls_first(), F.crc32("ids"), "ids")

    def run_write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        payload: list[bytes] = []
        keys: list[np.ndarray] = []
        nulls: list[np.ndarray] = []
        number = None
        for b in batches:
            if not b.num_rows:
                continue
            number = b.column(1)[0].as_py()
            payload += b.column(2).to_pylist()
            keys.append(b.column(0).fill_null(0).to_numpy(zero_copy_only=False))
            nulls.append(b.column(0).is_null().to_numpy(zero_copy_only=False))
        if number is None:
            return
        k, void = np.concatenate(keys), np.concatenate(nulls)
        size = np.array([len(x) // kind.itemsize for x in payload], np.int64)
        pos = np.zeros(len(k) + 1, np.int64)
        np.cumsum(size, out=pos[1:])
        shared.write_file(f"{uri}/payload/{number}.ids", b"".join(payload))
        shared.write_file(f"{uri}/docs/{number}.pos", pos.astype("<i8").tobytes())
        payload.clear()
        opens = np.ones(len(k), bool)
        opens[1:] = (k[1:] != k[:-1]) | (void[1:] != void[:-1])
        at = np.flatnonzero(opens)
        rows = np.diff([*at, len(k)]).astype(np.int32)
        n = len(at)
        yield _arrow({"key": (pa.int64(), pa.array(k[at], mask=void[at])), "shard": (pa.int32(), np.full(n, number, np.int32)), "row": (pa.int64(), at), "first": (pa.int64(), pos[at]), "n_ids": (pa.int64(), size[at]), "rows": (pa.int32(), rows)})

    entries_uri = shared.new_dir(spark, "entries")
    placed.mapInArrow(run_write, "key bigint, shard int, row bigint, first bigint, n_ids bigint, rows int").write.parquet(entries_uri)
    entries = spark.read.parquet(entries_uri)
    shards = [tuple(r) for r in entries.groupBy("shard").agg(F.sum("rows")).collect()]
    sizes = {s: 0 for s, _ in shards}
    fs, root = shared.open_fs(uri)
    for info in fs.get_file_info([f"{root}/payload/{s}.ids" for s in sizes]):
        sizes[int(info.base_name.removesuffix(".ids"))] = info.size // kind.itemsize
    n_keys = entries.filter("key is not null").count()
    n_buckets = max(1, -(-n_keys // BUCKET_KEYS))
    build_index(entries.filter("key is not null"), uri, n_buckets)
    shared.drop(entries_uri)
    return TokenStore(uri, n_buckets, kind.str, [(s, int(d), sizes[s]) for s, d in shards])


def _with_bucket(df: DataFrame, n_buckets: int, schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = index_bucket(b.column("key").to_numpy(zero_copy_only=False), n_buckets).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at)], names=[*b.schema.names, "bucket"])

    return df.mapInArrow(run, schema + ", bucket int")


def build_index(entries: DataFrame, uri: str, n_buckets: int) -> None:
    """One perfect hash per bucket of keys; each bucket has about BUCKET_KEYS keys, whatever their number."""
    held = _with_bucket(entries, n_buckets, "key bigint, shard int, row bigint, first bigint, n_ids bigint, rows int").repartitionById(n_buckets, F.col("bucket"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got)
        col = {c: t.column(c).to_numpy() for c in t.column_names}
        mph = PerfectHash.build(col["key"])
        table = np.zeros(mph.n, SLOT)
        at = mph.slots(col["key"])
        for c in ("shard", "row", "first", "n_ids", "rows"):
            table[c][at] = col[c]
        table["mark"][at] = key_hash(col["key"], _MARK_SEED).astype(np.uint32)
        bucket = int(col["bucket"][0])
        shared.write_file(f"{uri}/index/{bucket}.mph", mph.to_bytes() + table.tobytes())
        yield _arrow({"bucket": (pa.int32(), [bucket]), "keys": (pa.int64(), [mph.n])})

    held.mapInArrow(run, "bucket int, keys bigint").agg(F.sum("keys")).collect()


def lookup(keys: DataFrame, store: TokenStore, key: str = "doc_id") -> DataFrame:
    """Index entries of all distinct keys of a table: key, shard, row, first, n_ids, rows.  Unknown keys give no row."""
    n = store.n_buckets
    if not store.shards:
        return keys.sparkSession.createDataFrame([], "key bigint, shard int, row bigint, first bigint, n_ids bigint, rows int")
    asked = _with_bucket(keys.select(F.col(key).cast("long").alias("key")).filter("key is not null").distinct(), n, "key bigint").repartitionById(n, F.col("bucket"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            k = b.column("key").to_numpy(zero_copy_only=False)
            got = store.find(int(b.column("bucket")[0].as_py()), k)
            ok = got["rows"] > 0
            g = got[ok]
            yield _arrow({"key": (pa.int64(), k[ok]), "shard": (pa.int32(), g["shard"]), "row": (pa.int64(), g["row"]), "first": (pa.int64(), g["first"]), "n_ids": (pa.int64(), g["n_ids"]), "rows": (pa.int32(), g["rows"])})

    return asked.mapInArrow(run, "key bigint, shard int, row bigint, first bigint, n_ids bigint, rows int")


def read_docs(entries: DataFrame, store: TokenStore, with_ids: bool = False) -> DataFrame:
    """The documents behind index entries, read from the payload files: key, start, n_tokens, ids_crc32 (and ids).

    Entries are sorted by place, so that each shard's payload is read once, from front to back.
    start is the number of ids of all documents before, in the order of the store.
    """
    schema = "key bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids
    if not store.shards:
        return entries.sparkSession.createDataFrame([], schema)
    n = max(s for s, _, _ in store.shards) + 1
    placed = entries.repartitionById(n, F.col("shard")).sortWithinPartitions("shard", "row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = shared.open_fs(store.uri)
        shard, pos, f = None, np.zeros(0, np.int64), None
        for b in batches:
            if not b.num_rows:
                continue
            if b.column("shard")[0].as_py() != shard:
                shard = b.column("shard")[0].as_py()
                with fs.open_input_file(f"{root}/docs/{shard}.pos") as p:
                    pos = np.frombuffer(p.read(), "<i8")
                f = fs.open_input_file(f"{root}/payload/{shard}.ids")
            rows, many = b.column("row").to_numpy(zero_copy_only=False), b.column("rows").to_numpy(zero_copy_only=False)
            keys = np.repeat(b.column("key").to_numpy(zero_copy_only=False), many)
            each = np.repeat(rows - np.cumsum(many) + many, many) + np.arange(int(many.sum()))
            for at in range(0, len(each), 2000):
                r = each[at : at + 2000]
                lo, hi = int(pos[r[0]]), int(pos[r[-1] + 1])
                raw = np.frombuffer(f.read_at((hi - lo) * store.kind.itemsize, lo * store.kind.itemsize), store.kind).astype("<u4")
                parts = [raw[pos[i] - lo : pos[i + 1] - lo] for i in r]
                cols = {"key": (pa.int64(), keys[at : at + 2000]), "start": (pa.int64(), pos[r] + store.before[shard]), "n_tokens": (pa.int64(), pos[r + 1] - pos[r]), "ids_crc32": (pa.int64(), [zlib.crc32(p.tobytes()) for p in parts])}
                if with_ids:
                    cols["ids"] = (pa.list_(pa.int32()), [p.astype(np.int32) for p in parts])
                yield _arrow(cols)

    return placed.mapInArrow(run, schema)


def scan(store: TokenStore, spark: SparkSession) -> DataFrame:
    """Every document of the store in order, without the index: shard, row, start, n_tokens."""
    rows = spark.createDataFrame([(s, store.before[s]) for s, _, _ in store.shards] or [], "shard int, before bigint").repartition(max(1, len(store.shards)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = shared.open_fs(store.uri)
        for b in batches:
            for s, before in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with fs.open_input_file(f"{root}/docs/{s}.pos") as p:
                    pos = np.frombuffer(p.read(), "<i8")
                m = len(pos) - 1
                yield _arrow({"shard": (pa.int32(), np.full(m, s, np.int32)), "row": (pa.int64(), np.arange(m)), "start": (pa.int64(), pos[:-1] + before), "n_tokens": (pa.int64(), np.diff(pos))})

    return rows.mapInArrow(run, "shard int, row bigint, start bigint, n_tokens bigint")


__all__ = ["PerfectHash", "TokenStore", "WordEncoder", "build_index", "lookup", "read_docs", "scan", "write_store"]
