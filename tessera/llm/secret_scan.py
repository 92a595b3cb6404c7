"""Secret scan: wide candidate search, then a random forest that removes false positives.

Candidates are runs of 16 or more token characters with a digit in them or the beginning of an issued
key (`AKIA`, `ghp_`, ...), and, behind a word such as
`password` or `token` with `=` or `:`, runs of 8 or more characters of any kind but white space and
quotes.  `=`, `:`, `@` and quotes end the first kind, so that `API_KEY=<secret>` and
`https://user:<secret>@host` are seen without their names.  A forest, trained from labelled
findings, judges each by its length, its character transitions, the share of it that dictionary
words cover, whether it is part of a path, address or name, and the words on both sides.

Search, features, forest and redaction are DataFrame expressions: trees are compiled to nested
CASE expressions, so that scoring needs no Python.  Training works on a few hundred labelled
findings on the driver (at most TRAIN_FINDINGS, a parameter); their features come from the same
expressions.

Null and empty texts have no findings; redaction leaves null texts null.  Two equal secrets in one
text are two findings, ties included.  Repeated rows and rows with a null id each give theirs; other
columns, whatever their names, are not read by `findings` and are kept by `redact`.  Empty tables
give empty results.
"""

from __future__ import annotations

import json
import random
import string
import uuid
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Names that a secret is assigned to, and candidates behind them or of themselves (fixed values).
NAMES = "token|secret|passwd|password|passphrase|pwd|api[_-]?key|access[_-]?key|private[_-]?key|secret[_-]?key|credentials?|auth"
#: Beginnings that issuers give to their keys, which need no digit behind them (fixed values).
ISSUED = "AKIA|ASIA|gh[oprsu]_|[rs]k_live_|xox[abprs]-|eyJ"
CANDIDATE = (
    r"(?<=[=:][ ]{0,2}[\"']?)(?<=(?i:" + NAMES + r")[\"']?[ ]{0,2}[=:][ ]{0,2}[\"']?)[^\s\"'`,;<>()\[\]{}]{8,}"
    r"|(?<![A-Za-z0-9+/_.\-])(?=[A-Za-z+/_.\-]*[0-9]|" + ISSUED + r")[A-Za-z0-9+/_.\-]{16,}={0,2}"
)
TRAIN_FINDINGS, TREES, DEPTH, LEFT, RIGHT = 5000, 15, 6, 48, 24
#: Words that speak for and against a secret near by (fixed values).
FOR = "token|secret|api.?key|apikey|access.?key|private.?key|passw|credential|auth|bearer|client.?secret"
AGAINST = "commit|sha1|sha256|md5|checksum|digest|uuid|guid|revision|etag|example|sample|placeholder|isbn|phone|order|version"
#: Dictionary whose words a generated secret doesn't hold (fixed value).
DICTIONARY = "key|token|secret|your|here|test|user|name|config|setting|version|release|build|file|path|image|report|data|index|page|number|value|string|service|example|mail|com|www|http|html|home|usr|var|lib|src|main|node|item|order|client|server|project|document|table|change|session|the|and|ing|tion|ment|ent|est|ver|der|que|los"
FEATURES = ("length", "transitions", "digits", "distinct", "dictionary", "path", "address", "hex", "dashes", "word_for", "word_against", "assigned", "upper", "after_at", "before_at", "quoted", "right_for", "right_against", "punctuation")


def _share(c: Column, kept: Column) -> Column:
    return F.char_length(kept) / F.greatest(F.char_length(c), F.lit(1))


def features(secret: Column, left: Column, right: Column) -> list[Column]:
    """The forest's features of a candidate with the text before and behind it, as doubles."""
    n = F.greatest(F.char_length(secret), F.lit(1)).cast("double")
    classes = F.regexp_replace(F.translate(F.translate(F.translate(secret, string.ascii_lowercase, "a" * 26), string.ascii_uppercase, "A" * 26), string.digits, "0" * 10), r"(.)\1+", "$1")
    low, near, behind = F.lower(secret), F.lower(F.right(F.substring_index(left, "\n", -1), F.lit(28))), F.lower(F.substring_index(right, "\n", 1))
    yes = lambda c: F.when(c, 1.0).otherwise(0.0)
    return [
        n,
        F.char_length(classes) / n,
        F.char_length(F.regexp_replace(secret, "[^0-9]", "")) / n,
        F.size(F.array_distinct(F.split(secret, ""))) / n,
        1.0 - F.char_length(F.regexp_replace(low, DICTIONARY, "")) / n,
        (F.char_length(secret) - F.char_length(F.translate(secret, "/.", ""))) / n,
        yes(F.contains(secret, F.lit("@")) | F.contains(low, F.lit("http")) | F.contains(low, F.lit("www."))),
        F.char_length(F.regexp_replace(low, "[^0-9a-f]", "")) / n,
        (F.char_length(secret) - F.char_length(F.translate(secret, "-_", ""))) / n,
        yes(near.rlike(FOR)),
        yes(near.rlike(AGAINST)),
        yes(left.rlike(r"[=:]\s*[\"']?$")),
        F.char_length(F.regexp_replace(secret, "[^A-Z]", "")) / n,
        yes(F.endswith(left, F.lit("@"))),
        yes(F.startswith(right, F.lit("@"))),
        yes(left.rlike(r"[\"']$") & right.rlike(r"^[\"']")),
        yes(behind.rlike(FOR)),
        yes(behind.rlike(AGAINST)),
        F.char_length(F.regexp_replace(secret, "[A-Za-z0-9]", "")) / n,
    ]


def labelled_findings(n: int = 1200, seed: int = 7) -> list[tuple[str, str, str, int]]:
    """Findings (text before, candidate, text behind, 1 if a secret), drawn from common forms of secrets and look-alikes.

    A row has the shape that the search gives: the candidate ends at `=`, `:`, `@` and quotes.
    """
    r = random.Random(seed)
    word = lambda k=1: " ".join("".join(r.choice(["th", "er", "on", "an", "re", "he", "ci", "de", "la", "ou", "ver", "st"]) for _ in range(r.randint(1, 5))) for _ in range(k))
    pick = lambda chars, a, b=None: "".join(r.choice(chars) for _ in range(r.randint(a, b or a)))
    hexes, alnum = string.hexdigits[:16], string.ascii_letters + string.digits
    names = ["token", "api_key", "secret", "apikey", "access_key", "password", "auth_token", "client_secret", "AWS_SECRET_ACCESS_KEY", "export API_KEY", "db_passwd", "passphrase"]
    quotes = [' = "', "=", ": ", ' = ', ': "', "='", ":"]
    one = lambda x: x if any(c.isdigit() for c in x) else x[:-1] + r.choice(string.digits)
    long_one = [lambda: one(pick(hexes, 40)), lambda: one(pick(hexes, 32)), lambda: one(pick(hexes, 64)), lambda: one(pick(alnum + "+/", 24, 44)), lambda: one("AKIA" + pick(string.ascii_uppercase + string.digits, 16)), lambda: r.choice(["AKIA", "ASIA", "ghp_", "sk_live_"]) + pick(string.ascii_uppercase, 16, 24), lambda: one("ghp_" + pick(alnum, 36)), lambda: one("sk_live_" + pick(alnum, 24)), lambda: one(pick(alnum + "-_", 20, 40)), lambda: one("eyJ" + pick(alnum, 30) + "." + pick(alnum, 40) + "." + pick(alnum, 30))]
    short_one = [lambda: pick(alnum, 8, 15), lambda: pick(alnum + "!#$%&*-_", 9, 15), lambda: pick(string.ascii_letters, 10, 15), lambda: pick(hexes, 8, 15), lambda: pick(hexes, 14, 28)]
    alike = [
        lambda: (word(5) + " ", f"mail{r.randint(1, 9)}.example.{word()}.com"),
        lambda: (word(2) + "@", f"mail{r.randint(10, 99)}.{word()}.example.com"),
        lambda: ("see https:", f"//www.{word()}.com/{word()}/{r.randint(1, 9999)}.html"),
        lambda: ("in ", f"/usr/lib/{word()}/{word()}-{r.randint(1, 9)}.{r.randint(0, 20)}/{word()}.so"),
        lambda: ("commit ", pick(hexes, 40)),
        lambda: (r.choice(["sha256: ", "sha256=", "digest:"]), pick(hexes, 64)),
        lambda: ("md5 checksum ", pick(hexes, 32)),
        lambda: (r.choice(["uuid ", "id=", "request: "]), str(uuid.UUID(int=r.getrandbits(128)))),
        lambda: (r.choice(["id = ", "at ", "on "]), f"20{r.randint(10, 30)}-0{r.randint(1, 9)}-1{r.randint(0, 9)}T1{r.randint(0, 9)}.{r.randint(10, 59)}.{r.randint(10, 59)}"),
        lambda: (word(2) + " ", str(r.randint(10**16, 10**22))),
        lambda: ('api_key = "', r.choice(["your-api-key-here-", "example_token_value_", "test-secret-key-file-"]) + str(r.randint(1, 9999))),
        lambda: (word(2) + " ", f"{r.choice(['report', 'build', 'image', 'release'])}_{word()}_version_{r.randint(1, 9)}.{r.randint(1, 99)}"),
        lambda: (word(4) + " ", word() * 3 + str(r.randint(1, 9)) + "." + word()),
        lambda: ("auth token lost, call ", pick(string.digits, 16)),
        lambda: ("token = ", "x" * r.randint(15, 30) + "1"),
        lambda: (word(3) + " ", "0" * r.randint(10, 20) + "1" * 8),
        lambda: (r.choice(["password: ", "your password: ", "token = ", "secret: ", "auth: ", "pwd="]), r.choice(["required", "incorrect", "changeme", "undefined", "password", "none-given", "optional.", "*" * r.randint(8, 12), "<redacted>", "${" + word() + "}", "os.environ", "process.env", word() + word() + word(), word().title() + word() + word() + r.choice([".", "!", ""])])),
        lambda: (r.choice(["secret: ", "token: ", "password = "]), "".join(word().title() for _ in range(3)) + "ing"),
    ]
    out = []
    for k in range(n):
        if k % 2 == 0:
            short = r.random() < 0.3
            secret = r.choice(short_one if short else long_one)()
            secret = secret.upper() if r.random() < 0.1 else secret
            name = r.choice(names)
            name = name.upper() if r.random() < 0.2 else name
            left, right = name + r.choice(quotes), " " + word(3)
            if not short and r.random() < 0.4:
                left, right = r.choice([("Authorization: Bearer ", "\n"), (name + " ", " " + word()), (f"https://{word()}:", "@host." + word()), ("aws key ", ", " + word()), ("", "")])
            out.append((word(4) + " " + left, secret, ('"' if left.endswith('"') else "'" if left.endswith("'") else "") + right, 1))
        else:
            left, secret = r.choice(alike)()
            secret = secret.replace(" ", "")
            if len(secret) < 16 and not any(left.rstrip(" =:").lower().endswith(x) for x in ("password", "token", "secret", "auth", "pwd")):
                secret += "_" * 3 + "number_00001"
            out.append((word(4) + " " + left, secret if len(secret) >= 8 else secret + "required", ('"' if left.endswith('"') else "") + " " + word(3), 0))
    return out


def _relation(spark: SparkSession, rows: list[tuple[str, str, str, int]]) -> DataFrame:
    data = json.dumps([dict(zip(("left", "secret", "right", "label"), r, strict=True)) for r in rows])
    return spark.range(1).select(F.inline(F.from_json(F.lit(data), "array<struct<left:string,secret:string,right:string,label:int>>")))


class Forest:
    """Random forest of axis-parallel trees: nested (feature, threshold, low, high) or a leaf's share of secrets."""

    def __init__(self, trees: list):
        self.trees = trees

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = 1) -> Forest:
        rng = np.random.default_rng(seed)
        tries = max(1, round(np.sqrt(x.shape[1]) * 1.5))

        def grow(at: np.ndarray, left: int):
            p = float(y[at].mean()) if len(at) else 0.5
            if left == 0 or len(at) < 6 or p in (0.0, 1.0):
                return p
            best = None
            for f in rng.choice(x.shape[1], tries, replace=False):
                values = np.unique(x[at, f])
                for t in np.unique(np.quantile(values, np.linspace(0.05, 0.95, 16), method="lower")) if len(values) > 1 else []:
                    low = x[at, f] <= t
                    k = int(low.sum())
                    if 0 < k < len(at):
                        a, b = y[at][low].mean(), y[at][~low].mean()
                        cost = k * a * (1 - a) + (len(at) - k) * b * (1 - b)
                        if best is None or cost < best[0]:
                            best = (cost, int(f), float(t), low)
            if best is None:
                return p
            _, f, t, low = best
            return (f, t, grow(at[low], left - 1), grow(at[~low], left - 1))

        return cls([grow(rng.integers(0, len(y), len(y)), depth) for _ in range(trees)])

    def column(self, f) -> Column:
        """Mean vote of the trees as an expression; f gives the column of a feature's number."""

        def node(t) -> Column:
            return F.lit(float(t)) if not isinstance(t, tuple) else F.when(f(t[0]) <= t[1], node(t[2])).otherwise(node(t[3]))

        return reduce(lambda a, b: a + b, [node(t) for t in self.trees]) / len(self.trees)

    def predict(self, x: np.ndarray) -> np.ndarray:
        def walk(t, row) -> float:
            while isinstance(t, tuple):
                t = t[2] if row[t[0]] <= t[1] else t[3]
            return t

        return np.array([np.mean([walk(t, row) for t in self.trees]) for row in x])


def train(spark: SparkSession, findings: list[tuple[str, str, str, int]] | None = None) -> Forest:
    """Fits the forest on labelled findings: (text before, candidate, text behind, label)."""
    rows = (labelled_findings() if findings is None else findings)[:TRAIN_FINDINGS]
    cols = [c.alias(k) for k, c in zip(FEATURES, features(F.col("secret"), F.col("left"), F.col("right")), strict=True)]
    got = np.array([tuple(r) for r in _relation(spark, rows).select(*cols, F.col("label").cast("double")).collect()], dtype=float)
    return Forest.fit(got[:, :-1], got[:, -1])


def _barrier(df: DataFrame, **cols: Column) -> DataFrame:
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(k) for k, c in cols.items()]))))


def judged(docs: DataFrame, forest: Forest, text: str = "text") -> DataFrame:
    """Adds _parts (text between candidates) and _found (candidates with score); both null where there is no candidate.

    Candidates cut the text into parts, so that text = part, candidate, part, ..., part.
    """
    d = _barrier(docs, _c=F.regexp_extract_all(F.col(text), F.lit(CANDIDATE), F.lit(0)))
    some = F.size("_c") > 0
    d = _barrier(d, _parts=F.when(some, F.split(F.col(text), CANDIDATE, -1)))
    n = F.size("_c")
    three = F.arrays_zip(F.slice("_parts", 1, n).alias("l"), F.col("_c").alias("c"), F.slice("_parts", 2, n).alias("r"))
    d = _barrier(d, _z=F.when(some, F.transform(three, lambda z: F.struct(z["c"].alias("c"), F.right(z["l"], F.lit(LEFT)).alias("l"), F.left(z["r"], F.lit(RIGHT)).alias("r")))))
    d = _barrier(d, _v=F.when(some, F.transform("_z", lambda z: F.array(*features(z["c"], z["l"], z["r"])))))
    scores = F.transform("_v", lambda v: forest.column(lambda k: v[k]))
    d = _barrier(d, _found=F.when(some, F.arrays_zip(F.col("_c").alias("secret"), scores.alias("score"))))
    return d.drop("_c", "_z", "_v")


def findings(docs: DataFrame, forest: Forest, key: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """A row per secret: key, start_char, end_char, secret, score."""
    d = judged(docs.select(key, text), forest, text).filter("_found is not null").withColumn("_row", F.monotonically_increasing_id())
    n = F.size("_found")
    # Lengths go along, not the text; a candidate starts behind all parts and candidates before it.
    skip = F.concat(F.array(F.lit(0)), F.transform("_found", lambda f: F.char_length(f["secret"])))
    steps = F.zip_with(F.transform(F.slice("_parts", 1, n), F.char_length), F.slice(skip, 1, n), lambda p, s: p + s)
    each = d.select(F.col(key).alias("_key"), "_row", F.posexplode(F.arrays_zip(steps.alias("step"), F.transform("_found", lambda f: f["secret"]).alias("secret"), F.transform("_found", lambda f: f["score"]).alias("score"))).alias("_i", "_z"))
    each = each.select("_key", "_row", "_i", F.col("_z.step").alias("_step"), F.col("_z.secret").alias("secret"), F.col("_z.score").alias("score"))
    start = F.sum("_step").over(Window.partitionBy("_row").orderBy("_i")).cast("long")
    each = each.withColumn("start_char", start).filter(F.col("score") >= threshold)
    return each.select(F.col("_key").alias(key), "start_char", (F.col("start_char") + F.char_length("secret")).alias("end_char"), "secret", "score")


def redact(docs: DataFrame, forest: Forest, text: str = "text", threshold: float = 0.5, mark: str = "[SECRET]") -> DataFrame:
    """The table with each secret in `text` replaced by `mark`; all other text and columns stay as they are."""
    # Columns go by their places meanwhile, so that none can clash.
    names = docs.columns
    t = f"__{names.index(text)}"
    d = judged(docs.toDF(*[f"__{i}" for i in range(len(names))]), forest, t)
    swapped = F.transform("_found", lambda f: F.when(f["score"] >= threshold, F.lit(mark)).otherwise(f["secret"]))
    whole = F.concat(F.array_join(F.zip_with(F.slice("_parts", 1, F.size("_found")), swapped, lambda a, b: F.concat(a, b)), ""), F.element_at("_parts", -1))
    hit = F.coalesce(F.exists("_found", lambda f: f["score"] >= threshold), F.lit(False))
    return d.select(*[F.when(hit, whole).otherwise(F.col(t)).alias(c) if c == text else F.col(f"__{i}").alias(c) for i, c in enumerate(names)])
