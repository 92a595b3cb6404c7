"""Near-duplicate documents by an inverted join over MinHash signature coordinates.

1. Each text is the set of its distinct five-word shingles.  Equal sets meet by a 128-bit hash of
   the set, and one representative of each goes on.
2. A representative has a signature of 64 MinHash coordinates and is posted under each pair of
   (coordinate, value).  Two signatures match if they agree in at least MATCHES = 33 coordinates.
   Prefix: with the lists ordered from short to long, such a pair meets in the first 64 - 33 + 1 =
   32 lists of both, so that only these are merged; lists with one member count among the 32, so that
   a representative without 33 shared values goes at once, and long lists (of a passage that very
   many documents share) are seldom among them.
   Skip: in a list, collisions of a pair are counted over all coordinates, unless the pair has met in
   a list of a lower coordinate, or its two are tied already.
   At similarity 0.75 a pair has 48 matches on average; fewer than 33 have odds of 1.46e-5.
3. Documents that are tied by such pairs form groups.  Within a group links are confirmed on the
   full shingle sets: 100 * |A and B| >= 75 * |A or B|, counted exactly by inverted lists.
4. Components of the confirmed links, by large-star / small-star rounds on tables.

Only connections count, so that pairs whose two are tied already need no comparison.  Lists and
groups of more than BLOCK members are dealt over tasks of BLOCK members, each with the smallest
member too (`link`); look-alikes tie to it at once.  What is then still apart from the largest part
of its list meets all other members, again in blocks.  No member and no pair of parts is left out,
no task holds an unbounded group, and a group of look-alikes costs in proportion to its size.

Null and empty texts (and texts without words) have an empty set, n_shingles 0, and are linked
with nothing: each is its own component and kept.  So is a row with a null id (component_id null).
Fewer than five words make one shingle.  Repeated rows all get the same result; rows that share an
id and differ in text are documents of their own, judged each by its own text, and the id then
counts for both of their components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import shared
from tessera.llm.kernel import LOWER, U64, mix, pieces, span_hashes, text_buffer, window_hashes, word_spans

COORDINATES, MATCHES, BLOCK, SHINGLE, SIMILAR = 64, 33, 1000, 5, 75
_A = mix(np.arange(1, COORDINATES + 1, dtype=U64)) | U64(1)
_B = mix(np.arange(1001, COORDINATES + 1001, dtype=U64))


def shingle_sets(texts: pa.Array, k: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    raw, offs = text_buffer(texts)
    low = LOWER[raw]
    starts, ends, first = word_spans(low, offs)
    h = span_hashes(low, starts, ends)
    w = window_hashes(h, k)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        n = b - a
        out.append(np.unique(w[a : b - k + 1]) if n >= k else window_hashes(h[a:b], n) if n else np.zeros(0, U64))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash signatures (one row of uint32 each) of non-empty sets."""
    out = np.zeros((len(sets), COORDINATES), np.uint32)
    if sets:
        u, at = np.concatenate(sets), np.cumsum([0, *[len(s) for s in sets[:-1]]])
        for j in range(COORDINATES):
            out[:, j] = np.minimum.reduceat(((u ^ _B[j]) * _A[j]) >> U64(32), at)
    return out


def set_hash(s: np.ndarray) -> tuple[int, int]:
    lo, hi = mix(s).sum(dtype=U64), mix(s ^ _B[0]).sum(dtype=U64)
    return int(lo.view(np.int64)), int(hi.view(np.int64))


def describe(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """doc_id, mark, n_shingles, set_lo, set_hi (hash of the set) and sig (signature; null for empty sets)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in pieces(whole, "text"):
                sets = shingle_sets(b.column("text"), k)
                full = [i for i, s in enumerate(sets) if len(s)]
                sigs = signatures([sets[i] for i in full])
                sig: list[bytes | None] = [None] * len(sets)
                for i, row in zip(full, sigs, strict=True):
                    sig[i] = row.tobytes()
                lo, hi = np.array([set_hash(s) for s in sets], np.int64).reshape(-1, 2).T
                n = np.array([len(s) for s in sets], np.int64)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("mark"), pa.array(n), pa.array(lo), pa.array(hi), pa.array(sig, pa.binary())], names=["doc_id", "mark", "n_shingles", "set_lo", "set_hi", "sig"])

    return docs.mapInArrow(run, "doc_id bigint, mark bigint, n_shingles bigint, set_lo bigint, set_hi bigint, sig binary")


def runs(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[pa.Table]:
    """Groups of neighbouring rows with equal first n_keys columns, across batches."""
    rest: list[pa.RecordBatch] = []

    def cuts(t: pa.Table) -> np.ndarray:
        same = np.ones(max(0, t.num_rows - 1), bool)
        for c in range(n_keys):
            v = t.column(c).to_numpy()
            same &= v[1:] == v[:-1]
        return np.flatnonzero(~same) + 1

    for b in batches:
        if not b.num_rows:
            continue
        if rest and not all(rest[-1].column(c)[-1] == b.column(c)[0] for c in range(n_keys)):
            yield from _split(pa.Table.from_batches(rest), cuts)
            rest = []
        t = pa.Table.from_batches([b])
        at = cuts(t)
        if len(at):
            yield from _split(pa.Table.from_batches([*rest, b.slice(0, int(at[-1]))]), cuts)
            rest = [b.slice(int(at[-1]))]
        else:
            rest.append(b)
    if rest:
        yield from _split(pa.Table.from_batches(rest), cuts)


def _split(t: pa.Table, cuts) -> Iterator[pa.Table]:
    t = t.combine_chunks()
    edges = [0, *cuts(t).tolist(), t.num_rows]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        yield t.slice(a, b - a)


class Parts:
    """Which members of one task are tied: `of` has a number for each part."""

    def __init__(self, of: np.ndarray):
        self.of = of.copy()

    def tie(self, x: int, ys: np.ndarray) -> np.ndarray:
        """Ties x to ys; those that were in parts of their own until then."""
        new = ys[np.unique(self.of[ys], return_index=True)[1]]
        self.of[np.isin(self.of, self.of[new])] = self.of[x]
        return new


def _edges(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    a = np.array(pairs, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(a[:, 0]), pa.array(a[:, 1])], names=["a", "b"])


def link(members: DataFrame, attach, finder, at: str) -> DataFrame:
    """Edges that tie all members of a group that are linked, directly or through others: a table a, b.

    members: grp, n (of the group's members), pivot (its smallest), rep; attach adds to a table with
    rep the column data, and finder(data of a task) gives ties(x, ys): which of the members ys
    are linked to member x.
    """
    spark = members.sparkSession
    shared.write(members, f"{at}/members")
    members = spark.read.parquet(f"{at}/members")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int]] = []
        for t in runs(batches, 3):
            rep, part, asks = (t.column(c).to_numpy() for c in ("rep", "part", "asks"))
            ties, parts = finder(t.column("grp")[0].as_py(), t.column("data").to_pylist()), Parts(part)
            late = np.flatnonzero(asks) if asks.any() else np.arange(len(rep))
            for x in late.tolist():
                ys = np.flatnonzero(parts.of != parts.of[x])
                ys = ys[~asks[ys]] if asks.any() else ys[ys > x]
                if len(ys):
                    ys = ys[ties(x, ys)]
                    out += [(int(rep[x]), int(rep[y])) for y in parts.tie(x, ys).tolist()] if len(ys) else []
            if len(out) > 5000:
                yield _edges(out)
                out = []
        yield _edges(out)

    def dealt(df: DataFrame) -> DataFrame:
        rows = attach(df).repartition("grp", "block", "other").sortWithinPartitions("grp", "block", "other", "asks", "rep")
        return rows.select("grp", "block", "other", "rep", "part", "asks", "data").mapInArrow(run, "a bigint, b bigint")

    zero, no = F.lit(0), F.lit(False).alias("asks")
    home = F.pmod(F.xxhash64("rep"), blocks).cast("int")
    own = members.select("grp", "rep", home.alias("block"), zero.alias("other"), F.col("rep").alias("part"), no)
    every = F.explode(F.sequence(zero, blocks - 1))
    pivots = members.filter((F.col("n") > BLOCK) & (F.col("rep") == F.col("pivot"))).select("grp", "rep", every.alias("block"), zero.alias("other"), F.col("rep").alias("part"), no, home.alias("home"))
    shared.write(dealt(own.unionByName(pivots.filter("block != home").drop("home"))), f"{at}/near")
    edges = spark.read.parquet(f"{at}/near")
    large = members.filter(F.col("n") > BLOCK)
    if large.isEmpty():
        return edges
    # Large groups: what is apart from a group's largest part meets the others.
    parts = components(edges)
    named = large.join(parts, F.col("rep") == F.col("node"), "left").select("grp", "n", "rep", F.coalesce("root", "rep").alias("part"))
    sizes = named.groupBy("grp", "part").agg(F.count("*").alias("c")).groupBy("grp").agg(F.max(F.struct("c", "part"))["part"].alias("main"), (F.sum("c") - F.max("c")).alias("apart")).filter("apart > 0")
    named = named.join(sizes, "grp")
    shared.write(named, f"{at}/apart")
    named = spark.read.parquet(f"{at}/apart")
    others = F.ceil(F.col("apart") / BLOCK).cast("int")
    meet = named.select("grp", "rep", home.alias("block"), F.explode(F.sequence(zero, others - 1)).alias("other"), "part", no)
    ask = named.filter("part != main").select("grp", "rep", every.alias("block"), F.pmod(F.xxhash64(F.lit(1), "rep"), others).cast("int").alias("other"), "part", F.lit(True).alias("asks"))
    shared.write(dealt(meet.unionByName(ask)), f"{at}/far")
    return edges.unionByName(spark.read.parquet(f"{at}/far"))


def post_keys(sig: np.ndarray) -> np.ndarray:
    """Hashes of (coordinate, value) of signatures."""
    return mix(sig.astype(U64) ^ _B[None, :])


def candidate_edges(reps: DataFrame, at: str) -> DataFrame:
    """Edges (a, b) between representatives with at least MATCHES equal coordinates, enough to tie all such.  reps: rep, sig."""
    spark = reps.sparkSession

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                sig = np.frombuffer(b"".join(b.column("sig").to_pylist()), np.uint32).reshape(-1, COORDINATES)
                yield pa.RecordBatch.from_arrays([pa.array(post_keys(sig).reshape(-1).view(np.int64)), pa.array(np.repeat(b.column("rep").to_numpy(), COORDINATES))], names=["key", "rep"])

    posts = reps.mapInArrow(post, "key bigint, rep bigint")
    many = posts.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    mine = posts.join(many, "key").groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("n", "key"))).alias("lists")).filter(F.size("lists") >= MATCHES)
    prefix = mine.select("rep", F.transform(F.slice("lists", 1, F.size("lists") - (MATCHES - 1)), lambda x: x["key"]).alias("prefix"))
    shared.write(prefix, f"{at}/prefix")
    prefix = spark.read.parquet(f"{at}/prefix")
    each = prefix.select("rep", F.explode("prefix").alias("grp"))
    lists = each.groupBy("grp").agg(F.count("*").alias("n"), F.min("rep").alias("pivot")).filter("n > 1")
    data = reps.join(prefix, "rep").select(F.col("rep").alias("_rep"), F.struct("sig", "prefix").alias("data"))

    def finder(key: int, rows: list[dict]):
        sig = np.frombuffer(b"".join([r["sig"] for r in rows]), np.uint32).reshape(-1, COORDINATES)
        keys = post_keys(sig)
        listed = np.stack([np.isin(k, np.array(r["prefix"], np.int64).view(U64)) for k, r in zip(keys, rows, strict=True)])
        here = int(np.flatnonzero(keys[0].view(np.int64) == key)[0])  # the list's own coordinate

        def ties(x: int, ys: np.ndarray) -> np.ndarray:
            same = sig[ys] == sig[x]
            ok = same.sum(axis=1) >= MATCHES
            return ok & ~(same[:, :here] & listed[ys, :here] & listed[x, :here]).any(axis=1)

        return ties

    return link(each.join(lists, "grp").select("grp", "n", "pivot", "rep"), lambda df: df.join(data, F.col("rep") == F.col("_rep")), finder, at)


def confirmed_edges(members: DataFrame, texts: DataFrame, at: str, k: int = SHINGLE, similar: int = SIMILAR) -> DataFrame:
    """Edges of links confirmed on full sets.  members: grp, n, pivot, rep, set_lo, set_hi; texts: doc_id, text, mark."""
    spark = members.sparkSession

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in pieces(whole, "text"):
                sh = shingle_sets(b.column("text"), k)
                # A repeated id has other texts too.
                ok = [i for i, (s, want) in enumerate(zip(sh, zip(b.column("set_lo").to_pylist(), b.column("set_hi").to_pylist(), strict=True), strict=True)) if set_hash(s) == want]
                yield pa.RecordBatch.from_arrays([b.column("rep").take(pa.array(ok, pa.int64())), pa.array([sh[i].tobytes() for i in ok], pa.binary())], names=["_rep", "data"])

    # The members have no bound, so that the join is a merge join at every size.
    wanted = members.select("rep", "doc", "set_lo", "set_hi")
    found = texts.join(wanted.hint("merge"), F.col("doc_id") == F.col("doc")).dropDuplicates(["rep", "mark"]).select("rep", "set_lo", "set_hi", "text")
    shared.write(found.mapInArrow(sets, "_rep bigint, data binary"), f"{at}/sets")
    data = spark.read.parquet(f"{at}/sets")

    def finder(grp: int, rows: list[bytes]):
        sh = [np.frombuffer(x, U64) for x in rows]
        size = np.array([len(s) for s in sh])
        first = np.cumsum([0, *size])
        _, ids = np.unique(np.concatenate(sh), return_inverse=True)
        order = np.argsort(ids, kind="stable")
        doc = np.repeat(np.arange(len(sh)), size)[order]
        start = np.searchsorted(ids[order], np.arange(int(ids.max()) + 2))

        def ties(x: int, ys: np.ndarray) -> np.ndarray:
            if len(ys) < 4:
                both = np.array([len(np.intersect1d(sh[x], sh[y], assume_unique=True)) for y in ys])
            else:
                mine = ids[first[x] : first[x + 1]]
                lens = start[mine + 1] - start[mine]
                spots = np.repeat(start[mine] - np.cumsum(lens) + lens, lens) + np.arange(int(lens.sum()))
                both = np.bincount(doc[spots], minlength=len(sh))[ys]
            return 100 * both >= similar * (size[ys] + size[x] - both)

        return ties

    return link(members.select("grp", "n", "pivot", "rep"), lambda df: df.join(data.hint("merge"), F.col("rep") == F.col("_rep")), finder, at)


def components(edges: DataFrame) -> DataFrame:
    """node, root (smallest node reachable) of the nodes of a graph, by large-star and small-star rounds."""
    spark = edges.sparkSession
    at = shared.new_dir(spark, "edges")

    def put(df: DataFrame, step: int) -> DataFrame:
        shared.write(df, f"{at}/{step}")
        return spark.read.parquet(f"{at}/{step}")

    def star(e: DataFrame, large: bool) -> DataFrame:
        """Ties the larger (or smaller) neighbours of each node to the smallest of it and its neighbours."""
        n = e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = n.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        if large:
            made = n.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            made = n.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(low.select("a", F.col("m").alias("b")))
        return made.filter("a != b").distinct()

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    e = put(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct(), 0)
    seen, step = mark(e), 0
    while seen[0]:
        step += 1
        e = put(star(star(e, True), False), step)
        shared.drop(f"{at}/{step - 1}")  # nothing reads the round before any more
        now = mark(e)
        if now == seen:
            break
        seen = now
    # Stars now: each node is tied to its root.
    return e.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _judged(docs: DataFrame, key: str, text: str, k: int, similar: int) -> DataFrame:
    """doc_id, mark (hash of the text), n_shingles, component_id, kept."""
    spark = docs.sparkSession
    at = shared.new_dir(spark, "neardup")
    src = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("mark"))
    describe(src, k).write.parquet(f"{at}/described")
    sets = spark.read.parquet(f"{at}/described")
    full = sets.filter("n_shingles > 0 and doc_id is not null")
    on = ["set_lo", "set_hi", "n_shingles"]
    shared.write(full.groupBy(*on).agg(F.min("doc_id").alias("doc"), F.first("sig").alias("sig")), f"{at}/reps")
    reps = spark.read.parquet(f"{at}/reps").withColumn("rep", F.col("doc"))
    # Of texts that share their smallest id one goes by that id, the others by a hash of their own.
    twice = reps.groupBy("doc").agg(F.count("*").alias("c"), F.min("set_lo").alias("least")).filter("c > 1").drop("c")
    odd = not twice.isEmpty()
    if odd:
        named = F.when(F.col("least").isNull() | (F.col("least") == F.col("set_lo")), F.col("doc")).otherwise(-1 - (F.xxhash64("doc", *on).bitwiseAND(F.lit((1 << 62) - 1))))
        shared.write(reps.join(twice, "doc", "left").withColumn("rep", named).drop("least"), f"{at}/named")
        reps = spark.read.parquet(f"{at}/named")
    groups = components(candidate_edges(reps.select("rep", "sig"), f"{at}/lists"))
    tied = groups.select(F.col("node").alias("rep"), F.col("root").alias("grp")).unionAll(groups.select(F.col("root").alias("rep"), F.col("root").alias("grp")).distinct())
    sized = tied.join(tied.groupBy("grp").agg(F.count("*").alias("n")), "grp")
    members = sized.join(reps.drop("sig", "n_shingles"), "rep").select("grp", "n", F.col("grp").alias("pivot"), "rep", "doc", "set_lo", "set_hi")
    shared.write(members, f"{at}/groups")
    roots = components(confirmed_edges(spark.read.parquet(f"{at}/groups"), src, f"{at}/links", k, similar))
    moved = reps.select(*on, "rep", "doc").join(roots, F.col("rep") == F.col("node"), "left").withColumn("root", F.coalesce("root", "rep"))
    if odd:
        moved = moved.join(moved.groupBy("root").agg(F.min("doc").alias("component_id")), "root")
    else:
        moved = moved.withColumn("component_id", F.col("root"))
    named = full.select("doc_id", "mark", *on).join(moved.select(*on, "component_id"), on).select("doc_id", "mark", "n_shingles", "component_id")
    alone = sets.filter("n_shingles = 0 or doc_id is null").select("doc_id", "mark", "n_shingles", F.col("doc_id").alias("component_id"))
    return named.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = SHINGLE, similar: int = SIMILAR) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable over links) and kept (doc_id = component_id)."""
    return _judged(docs, key, text, k, similar).drop("mark")


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The table without documents that are near-duplicates of one with a smaller id."""
    gone = _judged(docs, key, text, SHINGLE, SIMILAR).filter("not kept").select(F.col("doc_id").alias("_gone"), F.col("mark").alias("_mark")).distinct()
    return docs.join(gone, (docs[key] == gone["_gone"]) & (F.xxhash64(docs[text]) == gone["_mark"]), "left_anti")
