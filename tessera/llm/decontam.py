"""Benchmark decontamination: item-sized windows of documents against the items of a benchmark.

Every item, and every window of as many words, has a 64-bit SimHash of its weighted five-word
shingles.  Fingerprints are looked up in a multi-index, one for each size of items: they are cut
into 8 blocks of 8 bits, and two fingerprints within RADIUS = 23 bits have a block that differs in
at most 2 (pigeonhole), so that probing each block with all values within 2 bits finds every item
within the radius.  What is found is verified by the exact weighted similarity: sum of min over sum
of max of the shingles' weights, at least 0.75.

Windows without any shingle of any item are not fingerprinted: their similarity to each item is 0.
A document of fewer words than the item is one window as a whole.  An item of fewer than five words
has its whole sequence as its only shingle, so that it is found, in documents of any length, where
a window of as many words is the same.

Items are a stated query set.  They are read in blocks of at most ITEMS items and ITEM_BYTES bytes
of text, each of which is sent to the executors and meets all documents.  Null or empty texts match
nothing; repeated documents and repeated items each give their rows (a null id gives rows with a
null id); of windows with the same similarity the first counts.  Empty tables give an empty result;
other columns are not read by `matches` and are kept by `clean`.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.kernel import ALNUM_WORDS, LOWER, U64, pieces, span_hashes, text_buffer, window_hashes, window_starts, word_spans

SHINGLE, SIMILAR, RADIUS, BLOCKS, ITEMS, ITEM_BYTES = 5, 0.75, 23, 8, 20_000, 8 << 20
#: Shingles whose running sums are held at once.
SPAN = 1 << 14
_FLIPS = np.array([sum(1 << b for b in c) for k in range(RADIUS // BLOCKS + 1) for c in combinations(range(8), k)], np.uint8)
SCHEMA = "doc_id bigint, item_id bigint, start_word bigint, n_words bigint, distance int, similarity double"


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    raw, offs = text_buffer(texts)
    low = LOWER[raw]
    starts, ends, first = word_spans(low, offs, ALNUM_WORDS)
    return span_hashes(low, starts, ends), first


def _shingles(h: np.ndarray) -> np.ndarray:
    """Hashes of the shingles of one text's words; of the whole text if it has fewer than five."""
    return window_hashes(h, min(SHINGLE, len(h))) if len(h) else h


def simhash(shingles: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Running sums of the signed weights of each bit: fingerprints of all windows are differences of them."""
    bits = ((shingles[:, None] >> np.arange(64, dtype=U64)) & U64(1)).astype(np.float64) * 2 - 1
    sums = np.zeros((len(shingles) + 1, 64))
    np.cumsum(bits * weights[:, None], axis=0, out=sums[1:])
    return sums


def fingerprint(sums: np.ndarray) -> np.ndarray:
    # Sums that rounding alone keeps from 0 count as 0.
    return np.packbits(sums > 1e-6, axis=-1, bitorder="little").view("<u8").astype(U64).reshape(sums.shape[:-1])


class MultiIndex:
    """Fingerprints by the values of each of their blocks, and all values within RADIUS // BLOCKS bits of these; those of different groups never meet."""

    def __init__(self, prints: np.ndarray, groups: np.ndarray):
        self.prints = prints
        n_groups = int(groups.max(initial=-1)) + 1
        self.owners, self.at = [], []
        values = prints.astype("<u8").view(np.uint8).reshape(-1, BLOCKS)
        for b in range(BLOCKS):
            near = (groups[:, None] * 256 + (values[:, b, None] ^ _FLIPS[None, :])).reshape(-1)
            order = np.argsort(near, kind="stable")
            self.owners.append(order // len(_FLIPS))
            self.at.append(np.searchsorted(near[order], np.arange(n_groups * 256 + 1)))

    def within(self, prints: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All pairs within the radius: places in prints, places in the index, distances."""
        k, found = len(self.prints), [np.zeros(0, np.int64)]
        values = prints.astype("<u8").view(np.uint8).reshape(-1, BLOCKS)
        for lo in range(0, len(prints), 4096):
            part = [np.zeros(0, np.int64)]
            for b in range(BLOCKS):
                v = groups[lo : lo + 4096] * 256 + values[lo : lo + 4096, b]
                n = self.at[b][v + 1] - self.at[b][v]
                spots = np.repeat(self.at[b][v] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
                part.append(np.repeat(np.arange(lo, lo + len(v)), n) * k + self.owners[b][spots])
            found.append(np.unique(np.concatenate(part)))
        pair = np.concatenate(found)
        row, item = pair // max(k, 1), pair % max(k, 1)
        d = np.bitwise_count(prints[row] ^ self.prints[item]).astype(np.int64)
        near = d <= RADIUS
        return row[near], item[near], d[near]


class ItemIndex:
    """Items with their shingles, weights, fingerprints and the multi-index of these by size."""

    def __init__(self, ids: list[int], texts: list[str | None]):
        h, first = _words(pa.array(texts, pa.string()))
        self.ids, self.size = ids, np.diff(first)
        self.shingles = [_shingles(h[first[i] : first[i + 1]]) for i in range(len(ids))]
        distinct = [np.unique(s) for s in self.shingles]
        self.known, df = np.unique(np.concatenate([*distinct, np.zeros(0, U64)]), return_counts=True)
        # A shingle that many items share says little about any of them.
        self.known_weight = 1 + np.log((1 + len(ids)) / df) if len(df) else np.zeros(0)
        self.new_weight = 1 + np.log(1 + len(ids))
        self.prints = np.array([self.print_of(s) if len(s) else 0 for s in self.shingles], U64)
        sizes = {int(m): np.flatnonzero(self.size == m) for m in np.unique(self.size) if m}
        self.sizes = np.array([m for m in sizes if m >= SHINGLE], np.int64)
        self.items = np.flatnonzero(self.size >= SHINGLE)
        self.table = MultiIndex(self.prints[self.items], np.searchsorted(self.sizes, self.size[self.items]))
        self.total = np.array([self.weight(s).sum() for s in self.shingles])
        #: Items of fewer words than a shingle, by size and by their only shingle.
        self.short: dict[int, dict[int, list[int]]] = {}
        for m, items in sizes.items():
            if m < SHINGLE:
                for i in items.tolist():
                    self.short.setdefault(m, {}).setdefault(int(self.shingles[i][0]), []).append(i)
        self.coarse = np.zeros(1 << 20, bool)
        self.coarse[(self.known >> U64(44)).astype(np.int64)] = True

    def print_of(self, shingles: np.ndarray) -> np.uint64:
        return fingerprint(simhash(shingles, self.weight(shingles))[-1][None])[0]

    def weight(self, shingles: np.ndarray) -> np.ndarray:
        if not len(self.known):
            return np.full(len(shingles), self.new_weight)
        at = np.minimum(np.searchsorted(self.known, shingles), len(self.known) - 1)
        return np.where(self.known[at] == shingles, self.known_weight[at], self.new_weight)

    def similarity(self, item: int, shingles: np.ndarray) -> float:
        keys, n = np.unique(np.concatenate([self.shingles[item], shingles]), return_counts=True)
        mine, k = np.unique(self.shingles[item], return_counts=True)
        a = np.zeros(len(keys))
        a[np.searchsorted(keys, mine)] = k
        b, w = n - a, self.weight(keys)
        return float((w * np.minimum(a, b)).sum() / (w * np.maximum(a, b)).sum())

    def hits(self, shingles: np.ndarray) -> np.ndarray:
        """Places of shingles that some item has."""
        at = np.flatnonzero(self.coarse[(shingles >> U64(44)).astype(np.int64)])
        if not len(at):
            return at
        s = shingles[at]
        k = np.minimum(np.searchsorted(self.known, s), len(self.known) - 1)
        return at[self.known[k] == s]

    def candidates(self, s: np.ndarray, places: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(item, first and last shingle, distance) of the windows of one document's shingles that lie within the radius of an item of their size.

        places: shingles that some item has; windows without one are left out.
        """
        # Weight of shingles that any item has: an item's window holds at least SIMILAR of the item's weight in them.
        known = np.zeros(len(s) + 1)
        known[places + 1] = self.weight(s[places])
        known = np.cumsum(known)
        ready: list[tuple[np.ndarray, ...]] = []

        def found() -> Iterator[tuple[int, int, int, int]]:
            prints, groups, first, stop = (np.concatenate(x) for x in zip(*ready, strict=True))
            row, item, d = self.table.within(prints, groups)
            item, a, z = self.items[item], first[row], stop[row]
            ok = known[z] - known[a] >= SIMILAR * self.total[item] * 0.999
            yield from zip(*[x[ok].tolist() for x in (item, a, z, d)], strict=True)
            ready.clear()

        for group, m in enumerate(self.sizes.tolist()):
            width = m - SHINGLE + 1
            last = max(0, len(s) - width)
            cover = np.zeros(last + 2, np.int64)
            np.add.at(cover, np.clip(places - width + 1, 0, last), 1)
            np.add.at(cover, np.minimum(places, last) + 1, -1)
            starts = np.flatnonzero(np.cumsum(cover[:-1]) > 0)
            while len(starts):
                part = starts[: np.searchsorted(starts, starts[0] + SPAN)]
                starts = starts[len(part) :]
                lo, stop = int(part[0]), np.minimum(part + width, len(s))
                run = s[lo : int(stop[-1])]
                sums = simhash(run, self.weight(run))
                ready.append((fingerprint(sums[stop - lo] - sums[part - lo]), np.full(len(part), group), part, stop))
                if sum(len(x[0]) for x in ready) > SPAN:
                    yield from found()
        if ready:
            yield from found()

    def match(self, words: np.ndarray, places: np.ndarray) -> list[tuple[int, int, int, int, float]]:
        """(item, start word, words, distance, similarity) of the best window of each item in one document."""
        s, best = _shingles(words), {}
        for item, a, z, d in self.candidates(s, places):
            sim = self.similarity(item, s[a:z])
            if sim >= SIMILAR and sim > best.get(item, (0, 0, 0, 0.0))[3]:
                best[item] = (a, min(int(self.size[item]), len(words)), d, sim)
        return [(i, *b) for i, b in best.items()]


@lru_cache(maxsize=4)
def _index(ids: tuple, texts: tuple) -> ItemIndex:
    return ItemIndex(list(ids), list(texts))


def _found(index: ItemIndex, texts: pa.Array) -> dict[int, list[tuple[int, int, int, int, float]]]:
    """For each row of a column with matches: (item, start word, words, distance, similarity)."""
    h, first = _words(texts)
    starts = window_starts(first, SHINGLE)
    at = starts[index.hits(window_hashes(h, SHINGLE)[starts])] if len(starts) else starts
    doc = np.searchsorted(first, at, side="right") - 1
    edges = np.flatnonzero(np.diff(doc, prepend=-1, append=-1))
    places = {int(doc[a]): at[a:z] - first[doc[a]] for a, z in zip(edges[:-1], edges[1:], strict=True)} if len(at) else {}
    got = {d: index.match(h[first[d] : first[d + 1]], p) for d, p in places.items()}
    # An item of fewer than five words is one shingle: its windows are equal to it or have nothing of it.
    for m, owners in index.short.items():
        starts = window_starts(first, m)
        w = window_hashes(h, m)[starts] if len(starts) else np.zeros(0, U64)
        at = index.hits(w)
        seen = set()
        for k, d in zip(at.tolist(), (np.searchsorted(first, starts[at], side="right") - 1).tolist(), strict=True):
            for i in owners.get(int(w[k]), ()):
                if (d, i) not in seen:
                    seen.add((d, i))
                    got.setdefault(d, []).append((i, int(starts[k] - first[d]), m, 0, 1.0))
    return {d: got[d] for d in sorted(got) if got[d]}


def _one_block(docs: DataFrame, rows: list[tuple[int, str | None]]) -> DataFrame:
    ids, texts = tuple(r[0] for r in rows), tuple(r[1] for r in rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index(ids, texts)
        for whole in batches:
            for b in pieces(whole, "text"):
                keys = b.column("doc_id")
                out = [(keys[d].as_py(), ids[i], *rest) for d, found in _found(index, b.column("text")).items() for i, *rest in found]
                cols = list(zip(*out, strict=True)) if out else [[]] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 4 + [pa.int32(), pa.float64()], strict=True)], names=["doc_id", "item_id", "start_word", "n_words", "distance", "similarity"])

    return docs.mapInArrow(run, SCHEMA)


def item_blocks(items: DataFrame, key: str, text: str) -> Iterator[list[tuple[int, str | None]]]:
    """Items in blocks of at most ITEMS items and ITEM_BYTES bytes (or one longer item): the bound of what is sent to executors at once."""
    block: list[tuple[int, str | None]] = []
    size = 0
    for row in items.select(F.col(key).cast("bigint"), F.col(text)).toLocalIterator():
        more = len((row[1] or "").encode())
        if block and (len(block) == ITEMS or size + more > ITEM_BYTES):
            yield block
            block, size = [], 0
        block.append((row[0], row[1]))
        size += more
    yield block


def matches(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """The best window of each document for each item that it holds: doc_id, item_id, start_word, n_words, distance, similarity."""
    d = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    parts = [_one_block(d, block) for block in item_blocks(items, item_key, item_text)]
    return reduce(DataFrame.unionByName, parts)


def clean(docs: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows that hold no item, with all their columns; one pass for each block of items, no join."""
    for block in item_blocks(items, item_key, item_text):
        ids, texts = tuple(r[0] for r in block), tuple(r[1] for r in block)

        def run(batches: Iterator[pa.RecordBatch], ids: tuple = ids, texts: tuple = texts) -> Iterator[pa.RecordBatch]:
            index = _index(ids, texts)
            for whole in batches:
                for b in pieces(whole, text):
                    keep = np.ones(b.num_rows, bool)
                    keep[list(_found(index, b.column(text)))] = False
                    yield b.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
