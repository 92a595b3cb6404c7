"""run() against the stages done plainly on a small folder, and each stage's promises."""

import re
from collections import defaultdict


import corpus_pipeline as cp
from tessera.llm import queries, toxicity

SF = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, pattern=WORDS):
    w = pattern.findall((text or "").translate(LOW))
    return [tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else []


def test_run_equals_plain_stages(spark):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    crf = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    score = {r.doc_id: r.score for r in toxicity.score(docs, crf).collect()}
    left = {r.doc_id: r.text for r in docs.collect() if score[r.doc_id] < 0.5}
    # Near-duplicates: the smallest id of each component stays.
    sets = {i: set(shingles(t)) for i, t in left.items()}
    up = {i: i for i in left}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in left:
        for b in left:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    left = {i: t for i, t in left.items() if root(i) == i}
    # Benchmark items: any window of an item's size with similar shingles (all weights alike for whole copies).
    items = [shingles(r.text, ALNUM) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    index = defaultdict(set)
    for k, s in enumerate(items):
        for x in s:
            index[x].add(k)
    clean = {}
    for i, t in left.items():
        s = shingles(t, ALNUM)
        near = {k for x in s for k in index.get(x, ())}
        if not any(len(set(s[j : j + len(items[k])]) & set(items[k])) >= 0.75 * len(set(s[j : j + len(items[k])]) | set(items[k])) for k in near for j in range(max(1, len(s) - len(items[k]) + 1))):
            clean[i] = t
    clean = {i: re.sub(r'(?i)(token = ")[0-9a-f]{40}(?=")', r"\1[SECRET]", t) for i, t in clean.items()}
    lib = Tokenizer.from_file(queries.BYTE_BPE)
    want = {i: lib.encode(t, add_special_tokens=False).ids for i, t in clean.items()}
    got = {r.doc_id: r for r in cp.run(spark, SF).collect()}
    assert set(got) == set(want)
    assert all(got[i].ids == want[i] and got[i].n_tokens == len(want[i]) for i in want)
    assert 0 < len(want) < docs.count()


def test_stages_keep_the_columns_and_odd_rows(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "fine words here", None, "s", 15), (3, "fine words here", None, "s", 15), (4, "x " * 4000, "de", None, 8000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and {r.doc_id for r in out.select("doc_id").collect()} == {1, 2, 3, 4}
        assert stage(spark, docs.limit(0), SF).count() == 0
    last = cp.STAGES[-1][1](spark, docs, SF)
    assert last.count() == 5 and {r.doc_id: r.n_tokens for r in last.collect()}[1] == 0
