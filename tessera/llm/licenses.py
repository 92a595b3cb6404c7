"""License notices in running text: exact phrases, and short notices with a bounded number of edits.

A notice of m characters that occurs with at most k edits, cut into k + 1 parts, has at least one
part without an edit (pigeonhole).  All parts of all notices go into one Aho-Corasick automaton;
its exact hits give the only places where a notice can start, give or take k characters, and the
regex library's bounded-error matching (`{e<=k}`) verifies each such place and reports its span.
Nothing else is searched, so that cost follows the number of seed hits, not notices times text.

Texts are lower-cased A-Z; words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`, and matching runs over
the words joined by single spaces, so that punctuation and line breaks don't hide a notice.  Null
and empty texts have no words, no labels, score 0 and null positions.  Repeated rows, also with a
null id, each get their result, an empty table an empty one; other columns are not read.  Of
notices that overlap all are reported; of one notice's alignments in a place the best.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.kernel import ALNUM_WORDS, LOWER, pieces, text_buffer, word_spans

#: Phrases of the base and their labels (fixed values).
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Short notices searched with errors: words joined by spaces, label, edits allowed (fixed values).
NOTICES = (
    ("gnu general public license", "gpl", 3),
    ("gnu lesser general public license", "lgpl", 3),
    ("gnu affero general public license", "agpl", 3),
    ("licensed under the apache license version 2 0", "apache", 4),
    ("apache license version 2 0", "apache", 2),
    ("released under the mit license", "mit", 3),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit", 6),
    ("redistribution and use in source and binary forms with or without modification", "bsd", 6),
    ("mozilla public license", "mpl", 2),
    ("creative commons attribution", "cc-by", 2),
    ("licensed under cc by", "cc-by", 1),
    ("all rights reserved", "proprietary", 1),
    ("this is free and unencumbered software released into the public domain", "unlicense", 5),
)


def split_seeds(notice: str, k: int) -> list[tuple[int, str]]:
    """k + 1 parts of the notice, as (offset, part): with at most k edits one of them is untouched."""
    cuts = [round(i * len(notice) / (k + 1)) for i in range(k + 2)]
    return [(a, notice[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


class NoticeFinder:
    def __init__(self, notices=NOTICES, phrases=PHRASES):
        import ahocorasick

        self.notices = notices
        self.patterns = [regex.compile(f"(?b)(?<= )(?:{regex.escape(n, literal_spaces=True)}){{e<={k}}}(?= )") for n, _, k in notices]
        seeds: dict[str, list[tuple[int, int]]] = {}
        for i, (n, _, k) in enumerate(notices):
            for at, part in split_seeds(n, k):
                seeds.setdefault(part, []).append((i, at))
        self.seeds = ahocorasick.Automaton()
        for part, owners in seeds.items():
            self.seeds.add_word(part, (len(part), owners))
        self.seeds.make_automaton()
        self.phrases = [(p, label) for p, label in phrases.items()]

    def base(self, joined: str) -> list[tuple[int, str, str]]:
        """All places of phrases, at word borders, as (character, phrase, label)."""
        out, padded = [], f" {joined} "
        for phrase, label in self.phrases:
            at = padded.find(f" {phrase} ")
            while at >= 0:
                out.append((at, phrase, label))
                at = padded.find(f" {phrase} ", at + 1)
        return out

    def fuzzy(self, joined: str) -> list[tuple[int, int, str, int, int]]:
        """Verified notices as (start, end, label, notice, edits), the best run of whole words of each notice once per place."""
        padded = f" {joined} "
        starts: dict[int, set[int]] = {}
        for end, (size, owners) in self.seeds.iter(joined):
            for i, at in owners:
                starts.setdefault(i, set()).add(end - size + 1 - at)
        found = []
        for i, places in starts.items():
            notice, label, k = self.notices[i]
            done = -len(notice)  # an edit before the seed can put the start before the text's
            for s in sorted(places):
                if s < done:
                    continue
                lo, hi = max(0, s - k), min(len(joined), s + len(notice) + 2 * k)
                if hi - lo < len(notice) - k:
                    continue
                # Borders belong to the pattern: a word's end with an edit is matched as a whole word, or not at all.
                m = self.patterns[i].search(padded[lo : hi + 2])
                if m:
                    a, b = lo + m.start() - 1, lo + m.end() - 1
                    found.append((a, b, label, i, sum(m.fuzzy_counts)))
                    done = b
        return found


@lru_cache(maxsize=1)
def finder() -> NoticeFinder:
    return NoticeFinder()


SCHEMA = "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, spans array<struct<start_word:bigint,end_word:bigint,label:string,edits:int>>"


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: counts and places of base phrases, labels, score and the verified spans in words.

    score is 1 for an exact phrase, else 1 - edits / characters of the best notice, else 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = finder()
        for whole in batches:
            for b in pieces(whole, "text"):
                raw, offs = text_buffer(b.column("text"))
                low = LOWER[raw]
                starts, ends, first = word_spans(low, offs, ALNUM_WORDS)
                rows: dict[str, list] = {k: [] for k in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")}
                low = np.where(ALNUM_WORDS[low], low, np.uint8(32))
                for d in range(len(offs) - 1):
                    lo, hi = int(offs[d]), int(offs[d + 1])
                    n = int(first[d + 1] - first[d])
                    data = low[lo:hi]
                    # Words joined by one space: their bytes and the byte after each.
                    k = ALNUM_WORDS[data]
                    e = ends[first[d] : first[d + 1]] - lo
                    k[e[e < hi - lo]] = True
                    joined = data[k].tobytes().decode("utf-8", "replace").rstrip(" ")
                    base, fuzzy = (f.base(joined), f.fuzzy(joined)) if n else ([], [])
                    if not base and not fuzzy:
                        vals = (n, 0, None, None, "", "", 0.0, [])
                    else:
                        flat = np.frombuffer(joined.encode(), np.uint8)
                        gaps = np.cumsum((flat & 0xC0) != 0x80)[flat == 32] - 1  # characters that are spaces
                        word_at = lambda c, g=gaps: int(np.searchsorted(g, c))
                        at = sorted(word_at(c) for c, _, _ in base)
                        spans = [(word_at(c), word_at(c) + p.count(" ") + 1, label, 0) for c, p, label in base]
                        spans += [(word_at(a), word_at(z - 1) + 1, label, edits) for a, z, label, _, edits in fuzzy]
                        score = 1.0 if base else max(1 - edits / len(f.notices[i][0]) for _, _, _, i, edits in fuzzy)
                        vals = (n, len(base), at[0] if at else None, at[-1] if at else None, ",".join(sorted({x for _, _, x in base})), ",".join(sorted({s[2] for s in spans})), score, [dict(zip(("start_word", "end_word", "label", "edits"), s, strict=True)) for s in sorted(set(spans))])
                    for c, v in zip(rows, vals, strict=True):
                        rows[c].append(v)
                kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.struct([("start_word", pa.int64()), ("end_word", pa.int64()), ("label", pa.string()), ("edits", pa.int32())]))]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(v, t) for v, t in zip(rows.values(), kinds, strict=True)]], names=["doc_id", *rows])

    return docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, SCHEMA)
