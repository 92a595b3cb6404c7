"""Katz backoff language model: Good-Turing discounted n-gram counts with exactly normalised backoff weights.

P(w | h) = d(c) c(h w) / (c(h) + RESERVED) if the n-gram h w was seen in training, else
b(h) P(w | h'), with h' one word shorter.  d(c) is the Good-Turing discount of counts up to 5, of
each order; no n-gram is left out.  RESERVED, 0.02 of a count, leaves mass for backing off even
where no count is discounted (Katz's own form would give such a context's unseen words none).  b(h) is (1 - sum of P(w | h)) / (1 - sum of P(w | h')) over the w
seen after h, so that each distribution sums to 1 over the V known tokens and one unknown token;
the unknown token gets the mass that single words leave.  A context never seen has b = 1.

Counting and scoring go over blocks of documents and an exchange of packed keys (see exchange.py),
order by order, so that the files of one order are gone before the next:

1. each block sends its distinct n-grams with their counts in training texts; a bucket of the count
   table sums them and replies with the corpus counts;
2. each block sends, for the contexts of n-grams that it owns, the sums that their backoff weights
   need; the table of weights replies with them;
3. each block scores its documents, token by token from the longest context down.

A training text never backs off, as all its n-grams were seen.  `score`, which learns from a table
and scores it, therefore asks for the weights of contexts in held-out texts only; `train` makes the
tables of all counts and all weights and keeps them, partitioned by order and bucket of the hash,
and `Katz.score` looks other texts up in them.  Nothing of the corpus is ever on one machine.

Null texts are empty: one token, the end.  Rows whose ids are null are training rows.  Repeated
rows count and are scored each.  An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import exchange as ex
from tessera.llm import shared
from tessera.llm.kernel import LOWER, U64, mix, per_doc, span_hashes, text_buffer, window_hashes, window_starts, word_spans

ORDER, MAX_DISCOUNTED, RESERVED = 3, 5, 0.02
BEGIN, END = U64(0x1B873593CC9E2D51), U64(0x85EBCA6B27D4EB2F)
_STATS = MAX_DISCOUNTED + 3  # n_1 .. n_6, distinct n-grams, tokens
_KEY = ~U64(3)  # keys leave two bits for marks, so that one sort brings keys and marks in order
SCHEMA = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def is_held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


class Grams:
    """The n-grams of a block: all windows of `begin, words, end` of each document."""

    def __init__(self, batch: pa.RecordBatch):
        self.held = np.array([is_held_out(i) for i in batch.column("doc_id").to_pylist()], bool)
        raw, offs = text_buffer(batch.column("text"))
        low = LOWER[raw]
        starts, ends, first = word_spans(low, offs)
        n = np.diff(first)
        self.first = np.concatenate([[0], np.cumsum(n + 2)])
        self.tokens = np.empty(int(self.first[-1]), U64)
        self.begins, self.ends = np.zeros(len(self.tokens), bool), np.zeros(len(self.tokens), bool)
        self.begins[self.first[:-1]] = True
        self.ends[self.first[1:] - 1] = True
        self.tokens[~(self.begins | self.ends)] = span_hashes(low, starts, ends)
        self.tokens[self.begins], self.tokens[self.ends] = BEGIN, END
        self.train = np.repeat(~self.held, n + 2)
        self.starts, self.keys, self.at, self.one, self.place = {}, {}, {}, {}, {}

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts and keys of all k-grams."""
        s = window_starts(self.first, k)
        return s, mix(window_hashes(self.tokens, k)[s] ^ U64(k)) & _KEY if len(s) else np.zeros(0, U64)

    def counts(self, k: int, contexts: bool, everyone: bool) -> tuple[np.ndarray, np.ndarray]:
        """Distinct k-grams, and for each twice its training count, plus 1 if its backoff weight is asked for."""
        s, w = self.windows(k)
        mark = self.train[s].astype(U64) << U64(1)
        if contexts:
            mark |= ((everyone | ~self.train[s]) & ~self.ends[s + k - 1]).astype(U64)
        x = np.sort(w | mark)
        if not len(x):
            return x, np.zeros(0, "<u4")
        at = np.flatnonzero(np.concatenate([[True], (x[1:] ^ x[:-1]) > U64(3)]))
        n = np.add.reduceat(x >> U64(1) & U64(1), at) << U64(1) | np.bitwise_or.reduceat(x & U64(1), at)
        return x[at] & _KEY, n.astype("<u4")

    def index(self, order: int) -> None:
        """For each order: distinct k-grams, the one of each window, a window of each, and the window at each token."""
        for k in range(1, order + 1):
            s, w = self.windows(k)
            by = np.argsort(w)
            x = w[by]
            new = np.ones(len(x), bool)
            np.not_equal(x[1:], x[:-1], out=new[1:])
            self.starts[k], self.keys[k], self.one[k] = s, x[new], by[new]
            self.at[k] = np.empty(len(w), np.int32)
            self.at[k][by] = np.cumsum(new, dtype=np.int32) - 1
            self.place[k] = np.zeros(len(self.tokens), np.int32)
            self.place[k][s] = np.arange(len(s), dtype=np.int32)

    def asking(self, k: int, everyone: bool) -> np.ndarray:
        """Whether texts that may back off have each distinct k-gram as a context."""
        out = np.zeros(len(self.keys[k]), bool)
        s = self.starts[k]
        out[self.at[k][(everyone | ~self.train[s]) & ~self.ends[s + k - 1]]] = True
        return out

    def entry(self, k: int, start: np.ndarray) -> np.ndarray:
        """The distinct k-gram of windows that start at given tokens (each has one)."""
        return self.at[k][self.place[k][start]]


BEGIN_KEY = (mix(window_hashes(np.array([BEGIN], U64), 1) ^ U64(1)) & _KEY)[0]


class _Count:
    """Replies with 4 * corpus count + 2 * (weight asked for) + 1 * (the block owns the n-gram); adds the statistics, and the table if it is kept."""

    kinds = ("<u4",)

    def __init__(self, keep: bool):
        self.keep = keep

    def __call__(self, kind, keys, index, values, bucket, blocks):
        count = (values[0] >> 1).astype(np.float64)
        total = np.bincount(index, count, len(keys)).astype(np.uint64)
        asked = (np.bincount(index, values[0] & 1, len(keys)) > 0) & (total > 0)
        owned = np.zeros(len(index), np.uint64)
        # The first block with a training count owns the n-gram.
        seen = np.flatnonzero(count > 0)
        owned[seen[np.unique(index[seen], return_index=True)[1]]] = 1
        t = total[keys != BEGIN_KEY] if kind == "n1" else total
        stats = np.array([*[(t == r).sum() for r in range(1, MAX_DISCOUNTED + 2)], (t > 0).sum(), t.sum()], np.float64)
        more = [(f"stats{kind}", -1, 0, ex.pack(stats))]
        if self.keep:
            there = total > 0
            more.append((f"t{kind[1:]}", -1, bucket, ex.join_parts([ex.pack(keys[there], True), ex.pack(total[there].astype("<f8"))])))
        return [total[index] << np.uint64(2) | asked[index].astype(np.uint64) << np.uint64(1) | owned], more


class _Backoff:
    """Replies with log10 of the backoff weight to entries that ask for it, and 0 to those that only add to its sums."""

    kinds = ("<f8", "<f8", "u1")

    def __init__(self, keep: bool):
        self.keep = keep

    def __call__(self, kind, keys, index, values, bucket, blocks):
        seen, lower = (np.bincount(index, v, len(keys)) for v in values[:2])
        b = np.log10(np.maximum(1 - seen, 1e-300) / np.maximum(1 - lower, 1e-300))
        more = [(f"v{kind[1:]}", -1, bucket, ex.join_parts([ex.pack(keys, True), ex.pack(b, few=True)]))] if self.keep else []
        return [b[index] * values[2]], more


class _Lookup:
    """Replies with the table's value of each key, 0 for others; the table's own entries come as block -1."""

    kinds = ("<f8",)

    def __call__(self, kind, keys, index, values, bucket, blocks):
        mine = blocks < 0
        table = np.zeros(len(keys))
        table[index[mine]] = values[0][mine]
        return [table[index]], []


def discounts(n: np.ndarray) -> np.ndarray:
    """d(r) for r = 0..5 from the counts of counts n_1..n_6; 1 where Good-Turing's estimate is not between 0 and 1."""
    d = np.ones(MAX_DISCOUNTED + 1)
    if n[0] > 0:
        common = (MAX_DISCOUNTED + 1) * n[MAX_DISCOUNTED] / n[0]
        for r in range(1, MAX_DISCOUNTED + 1):
            if n[r - 1] > 0 and common < 1:
                x = ((r + 1) * n[r] / (r * n[r - 1]) - common) / (1 - common)
                d[r] = x if 0 < x < 1 else 1.0
    return d


class Model:
    """What all blocks share: discounts of each order, number of training tokens, of distinct ones, and the unknown token's mass."""

    def __init__(self, stats: dict[int, np.ndarray], order: int):
        self.order = order
        self.discount = {k: discounts(stats[k]) for k in range(1, order + 1)}
        self.n, self.v = float(stats[1][-1]), float(stats[1][-2])
        low = stats[1][:MAX_DISCOUNTED] * np.arange(1, MAX_DISCOUNTED + 1)
        known = self.n - float((low * (1 - self.discount[1][1:])).sum())
        self.unknown = (self.n + RESERVED - known) / (self.n + RESERVED)

    def share(self, k: int, c: np.ndarray, context: np.ndarray | float) -> np.ndarray:
        """Discounted probability of k-grams with counts c after contexts with given counts."""
        d = self.discount[k][np.minimum(c, MAX_DISCOUNTED).astype(np.int64)]
        return np.where(c <= MAX_DISCOUNTED, d, 1.0) * c / (context + RESERVED)

    def judge(self, batch: pa.RecordBatch, g: Grams, c: dict[int, np.ndarray], weight: dict[int, np.ndarray]) -> pa.RecordBatch:
        """Scores of a block's documents from the counts of its k-grams and the log weights of its contexts."""
        lp, done = np.zeros(len(g.tokens)), np.zeros(len(g.tokens), bool)
        for k in range(self.order, 1, -1):
            s = g.starts[k]
            end = s + k - 1
            n, context = c[k][g.at[k]], g.entry(k - 1, s)
            left = ~done[end]
            hit, miss = left & (n > 0), left & (n == 0)
            lp[end[hit]] += np.log10(self.share(k, n[hit], c[k - 1][context[hit]]))
            lp[end[miss]] += weight[k - 1][context[miss]]
            done[end[hit]] = True
        n1 = c[1][g.at[1]]
        single = np.log10(np.where(n1 > 0, self.share(1, n1, self.n), self.unknown))
        lp += np.where(done, 0.0, single)
        base = np.log10((n1 + 1) / (self.n + self.v + 1))
        real = ~g.begins
        out = {
            "doc_id": batch.column("doc_id"),
            "held_out": pa.array(g.held),
            "n_tokens": pa.array(np.diff(g.first) - 1),
            "n_known": pa.array(per_doc(real & (n1 > 0), g.first)),
            "train_tokens": pa.array(np.full(len(g.held), int(self.n))),
            "base_score": pa.array(per_doc(np.where(real, base, 0.0), g.first)),
            "score": pa.array(per_doc(np.where(real, lp, 0.0), g.first)),
        }
        return pa.RecordBatch.from_arrays(list(out.values()), names=list(out))


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, str, int]]:
    for b in batches:
        yield from zip(*[b.column(c).to_pylist() for c in ("block", "path", "part")], strict=True)


def _replies(got: dict[str, list[bytes]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts, whether the weight was asked for, whether the block owns the n-gram."""
    v = ex.answers(got.get(f"n{k}"), 0, "<u8")
    return (v >> U64(2)).astype(np.float64), (v & U64(2)) > 0, (v & U64(1)) > 0


def _fit(blocks: ex.Blocks, order: int, keep: bool) -> tuple[Model, DataFrame]:
    """The model's common figures, and all replies to blocks; with keep, all weights are made and the tables are rows of block -1 beside."""
    spark, buckets, root = blocks.spark, blocks.n_buckets, blocks.uri
    stats = {k: np.zeros(_STATS) for k in range(1, order + 1)}
    parts = []
    for k in range(order, 0, -1):

        def count(batches: Iterator[pa.RecordBatch], k: int = k) -> Iterator[pa.RecordBatch]:
            for block, path, part in _each(batches):
                keys, n = Grams(ex.read_block(path, part)).counts(k, k < order, keep)
                yield ex.arrow_rows(list(ex.requests(f"n{k}", block, keys, buckets, n)))

        shared.write(ex.merge(blocks.rows().mapInArrow(count, ex.ROWS), _Count(keep)), f"{root}/n{k}")
        parts.append(spark.read.schema(ex.ROWS).parquet(f"{root}/n{k}"))
        # One short row per bucket.
        for r in parts[-1].filter(f"kind = 'statsn{k}'").select("payload").toLocalIterator():
            stats[k] += ex.unpack(bytes(r.payload), "<f8")
    model = Model(stats, order)
    replies = parts[0]
    for p in parts[1:]:
        replies = replies.unionByName(p)
    answered = replies.filter("block >= 0")

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, path, part, got in ex.block_groups(batches):
            g = Grams(ex.read_block(path, part))
            g.index(order)
            c, asked, own = ({k: x for k, x in enumerate(y, 1)} for y in zip(*[_replies(got, k) for k in range(1, order + 1)], strict=True))
            for k in range(2, order + 1):
                mine = np.flatnonzero(own[k])
                start = g.starts[k][g.one[k][mine]]
                context = g.entry(k - 1, start)
                some = asked[k - 1][context]
                mine, start, context = mine[some], start[some], context[some]
                shorter = g.entry(k - 1, start + 1)
                p = model.share(k, c[k][mine], c[k - 1][context])
                q = model.share(1, c[1][shorter], model.n) if k == 2 else model.share(k - 1, c[k - 1][shorter], c[k - 2][g.entry(k - 2, start + 1)])
                size, ask = len(g.keys[k - 1]), np.flatnonzero(asked[k - 1])
                sums = [np.bincount(context, x, size)[ask] for x in (p, q)]
                yield ex.arrow_rows(list(ex.requests(f"b{k - 1}", block, g.keys[k - 1][ask], buckets, *sums, g.asking(k - 1, keep)[ask].astype(np.uint8))))

    shared.write(ex.merge(ex.by_block(answered, blocks).mapInArrow(weigh, ex.ROWS), _Backoff(keep)), f"{root}/weights")
    return model, replies.unionByName(spark.read.schema(ex.ROWS).parquet(f"{root}/weights"))


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", order: int = ORDER) -> DataFrame:
    """Learns from the rows that are not held out and scores all: doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10 of its probability)."""
    blocks = ex.Blocks(docs, key, text)
    model, replies = _fit(blocks, order, keep=False)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, path, part, got in ex.block_groups(batches):
            batch = ex.read_block(path, part)
            g = Grams(batch)
            g.index(order)
            c, weight = {}, {}
            for k in range(1, order + 1):
                c[k], asked, _ = _replies(got, k)
                weight[k] = np.zeros(len(g.keys[k]))
                weight[k][asked] = ex.answers(got.get(f"b{k}"), 0, "<f8") if k < order else 0.0
            yield model.judge(batch, g, c, weight)

    return ex.by_block(replies.filter("block >= 0"), blocks).mapInArrow(judge, SCHEMA)


@dataclass
class Katz:
    """A stored model: tables of counts (kinds t1, t2, ...) and of log10 backoff weights (v1, ...) under `uri`, each in n_buckets buckets of the n-gram's hash."""

    uri: str
    n_buckets: int
    model: Model

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(ex.ROWS).parquet(f"{self.uri}/tables")

    def score(self, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
        """As `score`, for any documents, from the stored tables alone."""
        blocks, order, model = ex.Blocks(docs, key, text, n_buckets=self.n_buckets), self.model.order, self.model
        buckets = self.n_buckets

        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block, path, part in _each(batches):
                g = Grams(ex.read_block(path, part))
                for k in range(1, order + 1):
                    keys, _ = g.counts(k, False, False)
                    none = np.zeros(len(keys), "<f8")
                    for kind in (f"t{k}", f"v{k}") if k < order else (f"t{k}",):
                        yield ex.arrow_rows(list(ex.requests(kind, block, keys, buckets, none)))

        found = ex.merge(self.table(blocks.spark).unionByName(blocks.rows().mapInArrow(ask, ex.ROWS)), _Lookup())
        shared.write(found.filter("block >= 0"), f"{blocks.uri}/found")

        def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _, path, part, got in ex.block_groups(batches):
                batch = ex.read_block(path, part)
                g = Grams(batch)
                g.index(order)
                values = {x: {k: ex.answers(got.get(f"{x}{k}"), 0, "<f8") for k in range(1, order + (x == "t"))} for x in "tv"}
                yield model.judge(batch, g, values["t"], values["v"])

        found = blocks.spark.read.schema(ex.ROWS).parquet(f"{blocks.uri}/found")
        return ex.by_block(found, blocks).mapInArrow(judge, SCHEMA)


def train(docs: DataFrame, uri: str, key: str = "doc_id", text: str = "text", order: int = ORDER) -> Katz:
    """Learns from the rows that are not held out and stores the tables of all counts and weights under `uri`."""
    blocks = ex.Blocks(docs, key, text)
    model, replies = _fit(blocks, order, keep=True)
    own = replies.filter("block = -1 and (kind like 't%' or kind like 'v%')").repartition(blocks.n_buckets, "kind", "bucket").sortWithinPartitions("kind", "bucket")
    shared.write(own, f"{uri}/tables")
    shared.drop(blocks.uri)
    return Katz(uri, blocks.n_buckets, model)


__all__ = ["Grams", "Katz", "Model", "discounts", "score", "train"]
