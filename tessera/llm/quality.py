"""Quality rules: base counts of each text, and lines that too many documents of one host share.

Everything runs as DataFrame expressions in the JVM.  Lines are normalised (case folded, white
space collapsed, digits as 0) and hashed; each document counts a line once, so that the number of
rows per (host, line) is its number of documents, which partial aggregation sums before the
shuffle.  Lines above the limit of their host are removed and a document that loses more than
`max_removed` of its words, or keeps fewer than `min_kept` words, is depleted and rejected.

Null texts count as empty: no words, base_failed is true.  A null host counts as the empty one, also
in the SQL.  A row with a null id is judged as any other.  Empty tables give empty results; repeated
rows are documents of their own; of columns with clashing names only the three named are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space that separates words (fixed value).
_BLANK = r"[\x20\x09-\x0D]+"


#: Ways in which uses of one line are dealt out.
SALTS = 16


def _words(c: Column) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+`: the text is trimmed of separators, so that a split gives no empty word but for no words."""
    flat = F.translate(c, "\t\n\x0b\x0c\r", "     ")
    return F.filter(F.split(flat, " "), lambda w: w != "")


def _barrier(df: DataFrame, **cols: Column) -> DataFrame:
    """Adds computed columns behind a generator, so that later expressions read them and don't repeat their work."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(k) for k, c in cols.items()]))))


def base_rules(docs: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed to a table with `_text`.

    A window of three words is known by its 64-bit hash and its place in one sorted array of
    (hash, place) pairs: equal hashes are neighbours there, so that the cost is n log n however
    repetitive the text is.
    """
    d = _barrier(docs, _w=_words(F.col("_text")))
    n = F.size("_w")
    blank_lines = F.filter(F.split("_text", "\n"), lambda x: F.rtrim(F.translate(x, "\t\x0b\x0c\r", "    ")) != "")
    three = F.when(n >= 3, F.zip_with(F.zip_with(F.slice("_w", 1, n - 2), F.slice("_w", 2, n - 2), lambda a, b: F.struct(a.alias("a"), b.alias("b"))), F.slice("_w", 3, n - 2), lambda p, c: F.xxhash64(p["a"], p["b"], c))).otherwise(F.array().cast("array<bigint>"))
    d = _barrier(d, _h=three, _lines=blank_lines)
    # Most texts repeat no window; only the others sort (hash, place) pairs.
    d = _barrier(d, _some=F.size(F.array_distinct("_h")) < F.size("_h"))
    placed = F.array_sort(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    d = _barrier(d, _s=F.when(F.col("_some"), placed))
    m = F.size("_s")
    left = F.concat(F.array(F.lit(None).cast("struct<h:bigint,i:int>")), F.slice("_s", 1, m - 1))
    right = F.concat(F.slice("_s", 2, m - 1), F.array(F.lit(None).cast("struct<h:bigint,i:int>")))
    near = F.arrays_zip(left.alias("l"), F.col("_s").alias("s"), right.alias("r"))
    twice = F.filter(near, lambda z: F.coalesce(z["l"]["h"] == z["s"]["h"], F.lit(False)) | F.coalesce(z["r"]["h"] == z["s"]["h"], F.lit(False)))
    d = _barrier(d, _p=F.when(F.col("_some"), F.array_sort(F.transform(twice, lambda z: z["s"]["i"]))))
    k = F.size("_p")
    gaps = F.zip_with(F.slice("_p", 2, F.greatest(k - 1, F.lit(0))), F.slice("_p", 1, F.greatest(k - 1, F.lit(0))), lambda b, a: F.least(b - a, F.lit(3)))
    covered = F.when(F.col("_some") & (k > 0), F.aggregate(gaps, F.lit(3), lambda s, g: s + g)).otherwise(0)
    d = d.select(
        *docs.columns,
        n.cast("long").alias("n_words"),
        F.char_length(F.translate("_text", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.char_length("_text") - F.char_length(F.translate("_text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        covered.cast("long").alias("n_repeat_words"),
    )
    return d.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def normalised(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(F.lower(line), "123456789", "000000000"), _BLANK, " "))


def line_uses(src: DataFrame) -> DataFrame:
    """A row for each use of a line: _id, _mark (hash of the text), _host, place, line (hash), words, first (of its kind in the document)."""
    lines = F.filter(F.transform(F.split("_text", "\n"), normalised), lambda x: x != "")
    hashed = F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("line"), (F.char_length(x) - F.char_length(F.translate(x, " ", "")) + 1).alias("words")))
    d = _barrier(src, _l=hashed)
    # Sorted, a line's first use in the document is the one that differs from its neighbour.
    d = _barrier(d, _l2=F.array_sort("_l"))
    n = F.size("_l2")
    before = F.concat(F.array(F.lit(None).cast("bigint")), F.slice(F.transform("_l2", lambda x: x["line"]), 1, F.greatest(n - 1, F.lit(0))))
    both = F.filter(F.arrays_zip(F.col("_l2").alias("l"), before.alias("b")), lambda z: z["l"].isNotNull())
    return d.select("_id", "_mark", "_host", F.posexplode(both).alias("place", "z")).select("_id", "_mark", "_host", "place", "z.l.line", "z.l.words", F.coalesce(F.col("z.l.line") != F.col("z.b"), F.lit(True)).alias("first"))


def common_lines(uses: DataFrame, max_docs: int) -> DataFrame:
    """Lines that more than max_docs documents of one host use, however large the host: _host, line, docs."""
    return uses.filter("first").groupBy("_host", "line").agg(F.count("*").alias("docs")).filter(F.col("docs") > max_docs)


def of_common_lines(uses: DataFrame, max_docs: int) -> DataFrame:
    """The uses of common lines.  Few lines are common, but one of them may have a third of all uses: both sides are dealt over salts."""
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt")
    common = common_lines(uses, max_docs).select("_host", "line", salts)
    return uses.withColumn("_salt", F.pmod(F.xxhash64("_id", "place"), F.lit(SALTS)).cast("int")).join(common, ["_host", "line", "_salt"]).drop("_salt")


def quality(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", max_docs: int = 20, max_removed: float = 0.5, min_kept: int = 30) -> DataFrame:
    """Per document: base counts, base_failed, n_removed_words, depleted and kept.

    A line may be shared by max_docs documents of a host.  kept is false if the base rules fail or the document is
    depleted.
    """
    src = docs.select(F.col(key).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"), F.coalesce(F.col(host), F.lit("")).alias("_host")).withColumn("_mark", F.xxhash64("_text"))
    base = base_rules(src).drop("_text")
    uses = line_uses(src)
    hit = of_common_lines(uses, max_docs)
    # Repeated rows use the same places; each row loses them once.
    lost = hit.dropDuplicates(["_id", "_mark", "_host", "place"]).groupBy("_id", "_mark", "_host").agg(F.sum("words").alias("lost"))
    on = [base[c].eqNullSafe(lost[c]) for c in ("_id", "_mark", "_host")]
    n = F.col("n_words")
    removed = F.coalesce(F.col("lost"), F.lit(0)).cast("long")
    depleted = (removed > max_removed * n) | ((removed > 0) & (n - removed < min_kept))
    return base.join(lost, on, "left").select(
        base["_id"].alias(key), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        removed.alias("n_removed_words"), depleted.alias("depleted"), (~F.col("base_failed") & ~depleted).alias("kept"),
    )


def without_common_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", max_docs: int = 20) -> DataFrame:
    """Adds `cleaned`: the text without its common lines.  Rows whose lines are all rare keep their text as it is."""
    src = docs.select(F.col(key).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"), F.coalesce(F.col(host), F.lit("")).alias("_host")).withColumn("_mark", F.xxhash64("_text"))
    uses = line_uses(src)
    bad = of_common_lines(uses, max_docs).groupBy("_id", "_mark", "_host").agg(F.collect_set("line").alias("_bad"))
    t, h = F.coalesce(docs[text], F.lit("")), F.coalesce(docs[host], F.lit(""))
    on = docs[key].eqNullSafe(bad["_id"]) & (F.xxhash64(t) == bad["_mark"]) & (h == bad["_host"])
    keep = F.concat_ws("\n", F.filter(F.split(t, "\n"), lambda x: ~F.array_contains(bad["_bad"], F.xxhash64(normalised(x)))))
    return docs.join(bad, on, "left").select(*[docs[c] for c in docs.columns], F.when(bad["_bad"].isNull(), docs[text]).otherwise(keep).alias("cleaned"))
