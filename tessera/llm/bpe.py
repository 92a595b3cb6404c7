"""Byte-level BPE encoding and decoding by dynamic programming over prefixes.

Merging pair after pair needs a priority queue over the whole text.  Here every prefix of a
pre-token has one unique last token: the token that a BPE encoding of that prefix ends with.
A suffix automaton of the vocabulary, fed byte by byte, lists the tokens that are suffixes of
the prefix, longest first.  The first one that is compatible with the unique last token of the
shorter prefix (no merge rule would have crossed the border between the two) is the answer.
Back-pointers from the end then give exactly the ids that merging in rank order gives, in
linear time even for one word of a million bytes.

Null texts count as empty; an empty text has no ids and decodes to "".  A special token's
string inside a text becomes its id, as in the tokenizers library, and decodes back to its
string.  Repeated rows are encoded one by one; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space as the tokenizers library sees it (fixed value: Unicode's White_Space).
_S = r"\t-\r \x85\xa0" + "".join(map(chr, [0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
#: Pre-tokens of the byte-level scheme (fixed value).
PRETOKEN = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_S}\p{{L}}\p{{N}}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
#: A word of Latin letters and punctuation behind it, with or without a space before: two pre-tokens without the general pattern.
_PLAIN = re.compile("( ?[A-Za-z\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\xff]+)([.,!?;:#$%&*|\"()]*)\\Z")
_RUN = re.compile(r"\s\s")
#: Entries that a worker keeps at most in each of its caches; beyond, it starts anew.
CACHE = 250_000
#: Characters of the longest chunk that is kept in a cache, so that entries bound the bytes.
LONGEST = 64


def byte_chars() -> dict[str, int]:
    """The printable stand-in of every byte in byte-level vocabulary files, as char -> byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class SuffixAutomaton:
    """Generalised suffix automaton of a set of byte strings, with links to the strings that end at a state.

    `step` follows one byte; state and length then describe the longest suffix of what was read
    that is a substring of any string.  Whole strings among its suffixes are found along `up`.
    """

    def __init__(self, strings: list[bytes]):
        self.length, self.link, self.whole = [0], [-1], [-1]
        self.next: dict[int, int] = {}
        out: list[bytearray] = [bytearray()]
        nxt, length, link = self.next, self.length, self.link

        def state(n: int, to: int) -> int:
            length.append(n)
            link.append(to)
            self.whole.append(-1)
            out.append(bytearray())
            return len(length) - 1

        def clone_for(p: int, c: int, q: int) -> int:
            new = state(length[p] + 1, link[q])
            for x in out[q]:
                nxt[new << 8 | x] = nxt[q << 8 | x]
            out[new] += out[q]
            while p != -1 and nxt.get(p << 8 | c) == q:
                nxt[p << 8 | c] = new
                p = link[p]
            link[q] = new
            return new

        for k, s in enumerate(strings):
            last = 0
            for c in s:
                q = nxt.get(last << 8 | c)
                if q is not None:
                    last = q if length[q] == length[last] + 1 else clone_for(last, c, q)
                    continue
                cur = state(length[last] + 1, 0)
                p = last
                while p != -1 and (p << 8 | c) not in nxt:
                    nxt[p << 8 | c] = cur
                    out[p].append(c)
                    p = link[p]
                if p != -1:
                    q = nxt[p << 8 | c]
                    link[cur] = q if length[q] == length[p] + 1 else clone_for(p, c, q)
                last = cur
            if s:
                self.whole[last] = k
        # The nearest state at or above which a whole string ends, from short states to long ones.
        self.up = [-1] * len(length)
        for v in sorted(range(1, len(length)), key=length.__getitem__):
            p = link[v]
            self.up[v] = p if p > 0 and self.whole[p] >= 0 else self.up[p] if p > 0 else -1


class BpeCodec:
    """Encoder and decoder of one byte-level vocabulary file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        chars = byte_chars()
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of: dict[int, bytes] = {i: s.encode() for s, i in self.special.items()}
        ids = {}
        for s, i in vocab.items():
            if s not in self.special:
                ids[s] = i
                self.bytes_of[i] = bytes(chars[c] for c in s)
        self.pair_rank: dict[tuple[int, int], int] = {}
        self.rank, self.left, self.right = {i: -1 for i in ids.values()}, {}, {}
        for r, m in enumerate(merges):
            a, b = m if isinstance(m, list) else m.split(" ")
            i, j, whole = ids[a], ids[b], ids[a + b]
            self.pair_rank[i, j] = r
            if self.rank[whole] < 0:
                self.rank[whole], self.left[whole], self.right[whole] = r, i, j
        tokens = [i for i in ids.values() if len(self.bytes_of[i]) == 1 or self.rank[i] >= 0]
        self.automaton = SuffixAutomaton([self.bytes_of[i] for i in tokens])
        self.token = [tokens[k] if k >= 0 else -1 for k in self.automaton.whole]
        #: Where the longest token ends that is a whole match of a state, or else of the states above it.
        self.whole = [u if t >= 0 else self.automaton.up[u] for u, t in enumerate(self.token)]
        self._fit: dict[int, bool] = {}
        self._pretokens: dict[str, tuple[bytes, bytes]] = {}
        self._spaced: dict[str, tuple[bytes, bytes]] = {}
        self._bare: dict[str, tuple[bytes, bytes]] = {}
        self._cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def compatible(self, a: int, b: int) -> bool:
        """Whether tokens a and b can stand side by side: replays the merges at their border backwards in time."""
        key = a << 20 | b
        if (known := self._fit.get(key)) is not None:
            return known
        rank, pair_rank = self.rank, self.pair_rank
        a_ends = b_ends = len(pair_rank)  # ranks of the merges that take a and b up
        fits = True
        while True:
            r = pair_rank.get((a, b))
            if r is not None and r < a_ends and r <= b_ends:
                fits = False
                break
            if rank[a] < 0 and rank[b] < 0:
                break
            if rank[a] > rank[b]:
                a_ends, a = rank[a], self.right[a]
            else:
                b_ends, b = rank[b], self.left[b]
        if len(self._fit) > CACHE:
            self._fit.clear()
        self._fit[key] = fits
        return fits

    def encode_pretoken(self, data: bytes) -> list[int]:
        return self.encode_pretokens([data])[0]

    def encode_pretokens(self, many: list[bytes]) -> list[list[int]]:
        """Ids of pre-tokens.  In sorted order neighbours share prefixes, whose rows of the dynamic program are kept."""
        sam, token, fit, known = self.automaton, self.token, self.compatible, self._fit
        nxt, link, length, up = sam.next, sam.link, sam.length, sam.up
        whole = self.whole
        last, back, at, run = [0], [0], [0], [0]  # by prefix: last token and its length; state and length of the match
        out, before = [], b""
        for data in many:
            i, most = 0, min(len(data), len(before))
            while i < most and data[i] == before[i]:
                i += 1
            del last[i + 1 :], back[i + 1 :], at[i + 1 :], run[i + 1 :]
            v, n = at[i], run[i]
            for c in data[i:]:
                i += 1
                while (to := nxt.get(v << 8 | c)) is None:
                    v = link[v]
                    n = length[v]
                v, n = to, n + 1
                u = whole[v] if length[v] == n else up[v]
                while (size := length[u]) < i:
                    key = last[i - size] << 20 | token[u]
                    ok = known.get(key)
                    if ok is None:
                        ok = fit(last[i - size], token[u])
                    if ok:
                        break
                    u = up[u]
                last.append(token[u])
                back.append(size)
                at.append(v)
                run.append(n)
            before = data
            ids, i = [], len(data)
            while i:
                ids.append(last[i])
                i -= back[i]
            ids.reverse()
            out.append(ids)
        return out

    def _pretoken_list(self, s: str) -> list[str]:
        if m := _PLAIN.match(s):
            return [m[1], m[2]] if m[2] else [m[1]]
        return PRETOKEN.findall(s)

    def _learn(self, chunks: list[str]) -> dict[str, tuple[bytes, bytes]]:
        """Of texts that are cut at pre-tokens: decimal ids joined by commas, and the bytes that they decode to."""
        cut = [self._pretoken_list(s) for s in chunks]
        known = self._pretokens
        if len(known) > CACHE:
            known.clear()
        fresh = sorted({p.encode("utf-8", "surrogatepass") for ps in cut for p in ps if p not in known})
        local = {}
        for p, ids in zip(fresh, self.encode_pretokens(fresh), strict=True):
            entry = (",".join(map(str, ids)).encode(), self.decode_ids(ids))
            (known if len(p) <= LONGEST else local)[p.decode("utf-8", "surrogatepass")] = entry
        got = [[known[p] if p in known else local[p] for p in ps] for ps in cut]
        return {s: (b",".join([x for x, _ in g]), b"".join([y for _, y in g])) for s, g in zip(chunks, got, strict=True)}

    def _chunk(self, s: str) -> tuple[bytes, bytes]:
        return self._learn([s])[s]

    def prime(self, texts: list[str | None]) -> None:
        """Encodes the words of a batch that are not known yet, in sorted order; results do not depend on it."""
        spaced = self._spaced
        if len(spaced) > CACHE:
            spaced.clear()
        fresh: set[str] = set()
        for t in texts:
            if t:
                for line in t.split("\n"):
                    fresh.update(line.split(" ")[1:])
        fresh = [w for w in fresh if w not in spaced and len(w) <= LONGEST]
        got = self._learn([" " + w for w in fresh])
        spaced.update((s[1:], e) for s, e in got.items())

    def _segment(self, s: str) -> tuple[list[bytes], list[bytes]]:
        if _RUN.search(s):
            # Runs of white space are shared between pre-tokens; here the text is cut as a whole.
            a, b = self._chunk(s)
            return ([a] if a else []), [b]
        spaced, bare = self._spaced, self._bare
        got: list[tuple[bytes, bytes]] = []
        for k, line in enumerate(s.split("\n")):
            head, *words = line.split(" ")
            if k:
                head_key = "\n"
                if head_key not in bare:
                    bare[head_key] = self._chunk("\n")
                got.append(bare[head_key])
            if head:
                entry = bare.get(head)
                if entry is None:
                    entry = self._chunk(head)
                    if len(head) <= LONGEST:
                        if len(bare) > CACHE:
                            bare.clear()
                        bare[head] = entry
                got.append(entry)
            try:
                got += [spaced[w] for w in words]
            except KeyError:
                if len(spaced) > CACHE:
                    spaced.clear()
                fresh = {s[1:]: e for s, e in self._learn([" " + w for w in set(words) if w not in spaced]).items()}
                spaced.update((w, e) for w, e in fresh.items() if len(w) <= LONGEST)
                got += [fresh[w] if w in fresh else spaced[w] for w in words]
        return [x for x, _ in got], [y for _, y in got]

    def encode_parts(self, text: str | None) -> tuple[bytes, bytes]:
        """Decimal ids joined by commas, and the bytes that these ids decode to."""
        if not text:
            return b"", b""
        if self._cut is None or not any(s in text for s in self.special):
            ids, raw = self._segment(text)
        else:
            ids, raw = [], []
            for part in self._cut.split(text):
                if part in self.special:
                    ids.append(b"%d" % self.special[part])
                    raw.append(self.decode_ids([self.special[part]]))
                elif part:
                    a, b = self._segment(part)
                    ids += a
                    raw += b
        return b",".join(ids), b"".join(raw)

    def encode(self, text: str | None) -> list[int]:
        ids, _ = self.encode_parts(text)
        return [int(x) for x in ids.split(b",")] if ids else []

    def decode_ids(self, ids: list[int]) -> bytes:
        return b"".join([self.bytes_of[i] for i in ids])

    def decode(self, ids: list[int] | None) -> str:
        """Text of ids; bytes that are not UTF-8 become U+FFFD."""
        return self.decode_ids(ids or []).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(path: str) -> BpeCodec:
    """One codec per worker process and file."""
    return BpeCodec(path)


def encode(docs: DataFrame, path: str, text: str = "text", into: str = "ids") -> DataFrame:
    """Adds array<int> column `into` with the ids of column `text`, in place of one of that name; all other columns stay as they are."""
    docs = docs.drop(into)
    schema = T.StructType([*docs.schema.fields, T.StructField(into, T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        c = codec(path)
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                texts = part.column(text).to_pylist()
                c.prime(texts)
                rows = [np.fromstring(c.encode_parts(t)[0].decode(), dtype=np.int32, sep=",") if t else np.zeros(0, np.int32) for t in texts]
                offs = np.zeros(len(rows) + 1, np.int32)
                np.cumsum([len(r) for r in rows], out=offs[1:])
                ids = pa.ListArray.from_arrays(pa.array(offs), pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int32)))
                yield pa.RecordBatch.from_arrays([*part.columns, ids], names=[*part.schema.names, into])

    return docs.mapInArrow(run, schema)


def decode(docs: DataFrame, path: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """Adds string column `into` with the text of array column `ids` (null: ""), in place of one of that name."""
    docs = docs.drop(into)
    schema = T.StructType([*docs.schema.fields, T.StructField(into, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            texts = [c.decode(x) for x in b.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=[*b.schema.names, into])

    return docs.mapInArrow(run, schema)


def roundtrip(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, number of ids, ids as decimals joined by commas (binary), and the text that these ids decode to, in one pass.

    Ids and decoded text go to the JVM packed, not as boxed lists; the digest of a query is a
    projection over them.
    """
    schema = f"{key} {docs.schema[key].dataType.simpleString()}, n_tokens bigint, id_text binary, decoded string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000)
                texts = part.column(text).to_pylist()
                c.prime(texts)
                got = [c.encode_parts(t) for t in texts]
                ids = pa.array([x for x, _ in got], pa.binary())
                n = pa.array([x.count(b",") + 1 if x else 0 for x, _ in got], pa.int64())
                out = pa.array([y.decode("utf-8", "replace") for _, y in got], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(key), n, ids, out], names=[key, "n_tokens", "id_text", "decoded"])

    return docs.select(key, text).mapInArrow(run, schema)


def digest(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of a round trip of every document."""
    return roundtrip(docs, path).select("doc_id", "n_tokens", F.sha2("id_text", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


__all__ = ["BpeCodec", "SuffixAutomaton", "codec", "decode", "digest", "encode", "roundtrip"]
