"""Substring deduplication by level-wise doubling of repeated windows.

A window is a run of consecutive words of one document.  Windows that occur in one document only
can't be part of a longer repeat, so that only windows repeated at one length are extended to
twice that length, until no candidates survive:

* 25 words: of the 26 windows of 25 words in each run of 50, the one with the smallest hash stands
  for the run.  It depends on the run's words alone, so that equal runs have equal ones; about
  one window in 13 is looked up.
* 50 words: the runs whose 25 words are repeated.  A word is removed if it is covered by a window
  of 50 whose words also start in a document with a smaller id.
* 100, 200, ... words: windows whose two halves are both repeated, as long as there are any.  They
  give each document's longest repeat.

Keys travel packed between blocks of documents (see exchange.py); a window that thousands of
documents share is one entry per block.  Windows are judged on the input.  Null and empty texts
have no words: 0, 0 and the SHA-256 of nothing.  Rows with the same id are not copies of each
other for removal.  Rows with a null id are never before others.  Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm import exchange as ex
from tessera.llm.kernel import U64, doc_of, span_hashes, text_buffer, window_hashes, window_starts, word_spans

WINDOW = 50
_LAST = np.iinfo(np.int64).max


class Words:
    """Word hashes of a block, and the windows of its documents."""

    def __init__(self, batch: pa.RecordBatch):
        self.ids = batch.column("doc_id").fill_null(_LAST).to_numpy(zero_copy_only=False)
        self.raw, self.offs = text_buffer(batch.column("text"))
        starts, ends, self.first = word_spans(self.raw, self.offs)
        self.h = span_hashes(self.raw, starts, ends)

    def anchors(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts of all windows of `size` words, and the smallest hash of a window of half as many words in each."""
        half = size // 2
        at = window_starts(self.first, size)
        low = window_hashes(self.h, half)
        span, n = 1, size - half + 1  # windows of half size in one of full size
        while span * 2 <= n:
            low = np.minimum(low[: len(low) - span], low[span:])
            span *= 2
        if span < n:
            low = np.minimum(low[: len(low) - (n - span)], low[n - span :])
        return at, low[at] if len(at) else np.zeros(0, U64)


def _by_doc(keys: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys, and 1 or 2 (or more): the number of documents of the block that have each."""
    if len(keys):
        change = np.ones(len(keys), bool)
        change[1:] = (keys[1:] != keys[:-1]) | (doc[1:] != doc[:-1])
        keys, doc = keys[change], doc[change]
    order = np.lexsort((doc, keys))
    keys, doc = keys[order], doc[order]
    new_key = np.ones(len(keys), bool)
    new_key[1:] = keys[1:] != keys[:-1]
    new = new_key.copy()
    new[1:] |= doc[1:] != doc[:-1]
    index = np.cumsum(new_key) - 1
    return keys[new_key], np.minimum(np.bincount(index, new, int(new_key.sum())), 2).astype(np.uint8)


class _Repeated:
    """1 for keys that at least two documents have."""

    kinds = ("u1",)

    def __call__(self, kind, keys, index, values, bucket, blocks):
        return [(np.bincount(index, values[0], len(keys)) >= 2).astype(np.uint8)[index]], []


class _First:
    """For each entry: 1 if a document before all of the block's has the key, plus 2 if at least two documents have it."""

    kinds = ("u1", "<i8")

    def __call__(self, kind, keys, index, values, bucket, blocks):
        low = np.full(len(keys), _LAST)
        np.minimum.at(low, index, values[1])
        many = np.bincount(index, values[0], len(keys)) >= 2
        return [(low[index] < values[1]).astype(np.uint8) | many[index].astype(np.uint8) << 1], []


def _marked(keys: np.ndarray, asked: np.ndarray, reply: np.ndarray) -> np.ndarray:
    """The reply of each key, 0 for keys that were not asked for."""
    if not len(asked):
        return np.zeros(len(keys), reply.dtype)
    at = np.minimum(np.searchsorted(asked, keys), len(asked) - 1)
    return np.where(asked[at] == keys, reply[at], 0).astype(reply.dtype)


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256, removed (runs of word places) and max_repeat (words of its longest repeated window, by doubling)."""
    spark = docs.sparkSession
    blocks = ex.Blocks(docs, key, text)
    buckets, root = blocks.n_buckets, blocks.uri

    def halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, path, part in zip(*[b.column(c).to_pylist() for c in ("block", "path", "part")], strict=True):
                w = Words(ex.read_block(path, part))
                at, low = w.anchors(window)
                keys, n = _by_doc(low, doc_of(w.first)[at])
                yield ex.arrow_rows(list(ex.requests("half", block, keys, buckets, n)))

    ex.merge(blocks.rows().mapInArrow(halves, ex.ROWS), _Repeated()).write.parquet(f"{root}/half")
    half = spark.read.parquet(f"{root}/half")

    def candidates(w: Words, got: dict[str, list[bytes]]) -> np.ndarray:
        at, low = w.anchors(window)
        asked = np.unique(low)
        return at[_marked(low, asked, ex.answers(got.get("half"), 0, "u1")) > 0]

    def ask(kind: str, block: int, w: Words, at: np.ndarray, size: int) -> pa.RecordBatch:
        keys, doc = window_hashes(w.h, size)[at], doc_of(w.first)[at]
        distinct, n = _by_doc(keys, doc)
        low = np.full(len(distinct), _LAST)
        np.minimum.at(low, np.searchsorted(distinct, keys), w.ids[doc])
        return ex.arrow_rows(list(ex.requests(kind, block, distinct, buckets, n, low)))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, path, part, got in ex.block_groups(batches):
            w = Words(ex.read_block(path, part))
            at = candidates(w, got)
            if len(at):
                yield ask(f"w{window}", block, w, at, window)

    ex.merge(ex.by_block(half, blocks).mapInArrow(windows, ex.ROWS), _First()).write.parquet(f"{root}/whole")
    both = half.unionByName(spark.read.parquet(f"{root}/whole"))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Kinds: doc (a result, packed as Arrow) and state (starts of windows that are repeated)."""
        for block, path, part, got in ex.block_groups(batches):
            batch = ex.read_block(path, part)
            w = Words(batch)
            at = candidates(w, got)
            keys = window_hashes(w.h, window)[at] if len(at) else np.zeros(0, U64)
            doc = doc_of(w.first)[at] if len(at) else np.zeros(0, np.int64)
            asked, index = np.unique(keys, return_inverse=True)
            reply = ex.answers(got.get(f"w{window}"), 0, "u1")[index] if len(at) else np.zeros(0, np.uint8)
            low = np.full(len(asked), _LAST)
            np.minimum.at(low, index, w.ids[doc])
            gone = at[(w.ids[doc] > low[index]) | (reply & 1 > 0)]
            cover = np.zeros(len(w.h) + 1, np.int64)
            np.add.at(cover, gone, 1)
            np.add.at(cover, gone + window, -1)
            cut = np.cumsum(cover[:-1]) > 0
            n, removed, sha, spans = np.diff(w.first), [], [], []
            raw = w.raw.tobytes()
            for d in range(len(n)):
                words = raw[w.offs[d] : w.offs[d + 1]].split()
                mask = cut[w.first[d] : w.first[d + 1]]
                k = int(mask.sum())
                if k:
                    words = list(compress(words, (~mask).tolist()))
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
                    spans.append([{"start": int(a), "end": int(b)} for a, b in edge.reshape(-1, 2)])
                else:
                    spans.append([])
                removed.append(k)
                sha.append(hashlib.sha256(b" ".join(words)).hexdigest())
            t = pa.table({"doc_id": batch.column("doc_id"), "row": pa.array(np.arange(len(n))), "n_words": pa.array(n.astype(np.int64)), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(sha), "removed": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))})
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, t.schema) as out:
                out.write_table(t)
            rows = [("doc", block, 0, sink.getvalue().to_pybytes())]
            repeated = at[reply & 2 > 0]
            if len(repeated):
                rows.append(("state", block, window, ex.pack(repeated, True)))
            yield ex.arrow_rows(rows)

    ex.by_block(both, blocks).mapInArrow(apply, ex.ROWS).write.parquet(f"{root}/applied")
    applied = spark.read.parquet(f"{root}/applied")
    states = [applied.filter("kind = 'state'")]
    size = window
    while not states[-1].isEmpty():
        size *= 2

        def extend(batches: Iterator[pa.RecordBatch], size: int = size) -> Iterator[pa.RecordBatch]:
            for block, path, part, got in ex.block_groups(batches):
                w = Words(ex.read_block(path, part))
                at = doubled(w, ex.unpack(got["state"][0], "<i8", True), size)
                if len(at):
                    yield ask(f"w{size}", block, w, at, size)

        def survive(batches: Iterator[pa.RecordBatch], size: int = size) -> Iterator[pa.RecordBatch]:
            for block, path, part, got in ex.block_groups(batches):
                if f"w{size}" not in got:
                    continue
                w = Words(ex.read_block(path, part))
                at = doubled(w, ex.unpack(got["state"][0], "<i8", True), size)
                _, index = np.unique(window_hashes(w.h, size)[at], return_inverse=True)
                at = at[ex.answers(got[f"w{size}"], 0, "u1")[index] & 2 > 0]
                if len(at):
                    yield ex.arrow_rows([("state", block, size, ex.pack(at, True))])

        live = blocks.table.join(states[-1].select("block").distinct(), "block", "left_semi")
        step = ex.by_block(states[-1], blocks, live).mapInArrow(extend, ex.ROWS)
        ex.merge(step, _First()).write.parquet(f"{root}/w{size}")
        replies = states[-1].unionByName(spark.read.parquet(f"{root}/w{size}"))
        ex.by_block(replies, blocks, live).mapInArrow(survive, ex.ROWS).write.parquet(f"{root}/state{size}")
        states.append(spark.read.parquet(f"{root}/state{size}"))
    rows = applied.filter("kind = 'doc'")
    for s in states:
        rows = rows.unionByName(s)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, path, part, got in ex.block_groups(batches):
            t = pa.ipc.open_stream(got["doc"][0]).read_all().combine_chunks()
            first = np.concatenate([[0], np.cumsum(t.column("n_words").to_numpy())])
            longest = np.zeros(t.num_rows, np.int64)
            for k, payload in enumerate(got.get("state", [])):
                doc = np.searchsorted(first, ex.unpack(payload, "<i8", True), side="right") - 1
                longest[doc] = window << k
            yield from t.drop_columns("row").append_column("max_repeat", pa.array(longest)).combine_chunks().to_batches()

    schema = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, removed array<struct<start:bigint,end:bigint>>, max_repeat bigint"
    return ex.by_block(rows, blocks).mapInArrow(finish, schema)


def doubled(w: Words, at: np.ndarray, size: int) -> np.ndarray:
    """Starts of windows of `size` words whose halves are both among the repeated windows that start at `at`."""
    half = size // 2
    pair = np.intersect1d(at, at - half, assume_unique=True)
    return pair[pair + size <= w.first[np.searchsorted(w.first, pair, side="right")]] if len(pair) else pair


__all__ = ["doubled", "remove_repeats"]
