"""Secret scans: fixed patterns, and tokens that a Markov model of random strings explains better than one of identifiers.

DataFrame expressions only. The models of random strings, one for each alphabet that secrets are written in, are trained
on drawn strings. The model of ordinary identifiers is trained on the words of all documents: their transitions are counted
by Spark, and the ways in which names are made of words (capitals, joins, numbers) are derived from these counts. The margin
of the log-likelihood ratio follows a token's alphabet and length, so short tokens and letters alone are judged as well.
"""

from __future__ import annotations

import math
import string
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.common import text_of

# The patterns of each kind, which group is measured, and its least length.
KINDS = {
    "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),  # a shorter run fails whole, so asking for its length here finds the same
}
ALPHABET = string.ascii_letters + string.digits + "+/_=-"
#: A candidate is a maximal run of so many letters of ALPHABET; its parts of letters and digits are judged as well.
LEAST_LENGTH = 16
CANDIDATE, PART = rf"[A-Za-z0-9+/_=-]{{{LEAST_LENGTH},}}", rf"[A-Za-z0-9]{{{LEAST_LENGTH},}}"
#: A token with fewer different characters is a line or a filling, not a random string.
LEAST_DIFFERENT = 6
#: The alphabets of random strings, a token's being the first that has all its letters.
CLASSES = {
    "hex": "0123456789abcdef", "upper hex": "0123456789ABCDEF", "lower": string.ascii_lowercase,
    "upper": string.ascii_uppercase, "mixed hex": "0123456789abcdefABCDEF", "letters": string.ascii_letters,
    "base32": string.ascii_uppercase + "234567", "lower and digits": string.ascii_lowercase + string.digits,
    "upper and digits": string.ascii_uppercase + string.digits, "base62": string.ascii_letters + string.digits,
    "base64": string.ascii_letters + string.digits + "+/=", "url": string.ascii_letters + string.digits + "-_",
    "all": ALPHABET,
}
#: Drawn strings of each class, and their length.
RANDOM_STRINGS, RANDOM_LENGTH = 2000, 60
#: The margin of a class is so many standard deviations below the mean of its random strings, for the token's length, but
#: never under LEAST_MARGIN, which names made of foreign words stay below.
BELOW_MEAN, LEAST_MARGIN = 3.0, 1.2
#: Words up to this length teach what is ordinary; a longer one may be a secret.
ORDINARY_LENGTH = LEAST_LENGTH - 1
_N = len(ALPHABET)
_EDGES = ALPHABET + "^$"


class Model(NamedTuple):
    """Log-likelihoods: of ordinary transitions, and of the letters of each class, whose next letter does not depend on the
    one before; and mean and spread of the ratio over a class's own transitions. Short lists, as they become part of plans."""

    ordinary: list[float]
    letters: list[float]
    means: list[float]
    spreads: list[float]


def find(text: Column, pattern: str, group: int = 0, least: int = 0) -> Column:
    """Array of (start, end, value) of the leftmost matches whose `group` has `least` characters; code points, end open.

    Spark gives no positions, but the parts between the matches do: each match starts where all before it end.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = found if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    lengths = F.zip_with(
        F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)), F.arrays_zip(found.alias("m"), values.alias("v")),
        lambda gap, m: F.struct(F.length(gap).alias("gap"), F.length(m["m"]).alias("n"), m["v"].alias("v")))
    kind = "array<struct<start:int,end:int,value:string>>"

    def add(done: Column, x: Column) -> Column:
        at = F.coalesce(F.get(done, F.size(done) - 1)["end"], F.lit(0)) + x["gap"]
        return F.concat(done, F.array(F.struct(at.alias("start"), (at + x["n"]).alias("end"),
                                               x["v"].alias("value")))).cast(kind)

    none = F.array().cast(kind)
    spans = F.when(F.size(found) > 0, F.aggregate(lengths, none, add)).otherwise(none)
    return F.filter(spans, lambda s: F.length(s["value"]) >= least) if least else spans


def _transitions(tokens: DataFrame, letters: str) -> DataFrame:
    """(kind, pair, n) over neighbouring letters of `token`, each `n` times; a pair is first * letters + second."""
    codes = tokens.select("kind", "n", F.transform(
        F.split("token", ""), lambda c: F.instr(F.lit(letters), c) - 1).alias("c"))
    pairs = codes.select("kind", "n", F.explode(F.zip_with(
        F.slice("c", F.lit(1), F.greatest(F.size("c") - 1, F.lit(0))),
        F.slice("c", F.lit(2), F.greatest(F.size("c") - 1, F.lit(0))), lambda a, b: a * len(letters) + b)).alias("pair"))
    return pairs.groupBy("kind", "pair").agg(F.sum("n").alias("n"))


def drawn(spark: SparkSession) -> DataFrame:
    """(kind, token, n): random strings of each class, the same in every run."""
    kinds = F.array(*[F.struct(F.lit(i).alias("kind"), F.lit(a).alias("letters")) for i, a in enumerate(CLASSES.values())])
    rows = spark.range(RANDOM_STRINGS).select("id", F.explode(kinds).alias("k")).select("id", "k.*")
    letter = lambda j: F.substring(F.col("letters"), F.pmod(
        F.xxhash64("id", "kind", j), F.length("letters")).cast("int") + 1, F.lit(1))
    return rows.select("kind", F.array_join(F.transform(
        F.sequence(F.lit(1), F.lit(RANDOM_LENGTH)), letter), "").alias("token"), F.lit(1).cast("long").alias("n"))


def ordinary(docs: DataFrame) -> DataFrame:
    """(kind, token, n): the different words of all documents, between marks of their start and end, and how often.
    Mere numbers are no identifiers."""
    tokens = docs.select(F.explode(F.split(text_of(), r"[^A-Za-z0-9+/_=-]+")).alias("token"))
    tokens = tokens.where(F.length("token").between(2, ORDINARY_LENGTH) & F.col("token").rlike("[A-Za-z]"))
    return tokens.groupBy("token").agg(F.count("*").alias("n")).select(
        F.lit(0).alias("kind"), F.concat(F.lit("^"), "token", F.lit("$")).alias("token"), "n")


def _identifiers(counts: list[list[float]]) -> list[list[float]]:
    """Transitions of identifiers, from those of words: also in capitals, joined by marks or capitals, with numbers."""
    at = {c: i for i, c in enumerate(_EDGES)}
    small, capital, digits = ([at[c] for c in a] for a in (string.ascii_lowercase, string.ascii_uppercase, string.digits))
    table = [row[:_N] for row in counts[:_N]]
    first = [counts[at["^"]][i] for i in range(_N)]
    last = [counts[i][at["$"]] for i in range(_N)]
    first_letter = [first[a] + first[b] for a, b in zip(small, capital)]
    words, letters = max(sum(first), 1.0), max(sum(first_letter), 1.0)
    for a, x in zip(small, capital):
        for b, y in zip(small, capital):
            table[x][y] += 0.3 * counts[a][b]
            table[a][y] += 0.1 * last[a] * first_letter[small.index(b)] / letters
        for z in digits:
            table[a][z] += 0.002 * last[a]
            table[x][z] += 0.002 * last[a]
    for mark in (at[c] for c in "_-/=+"):
        for i in range(_N):
            table[i][mark] += 0.1 * last[i]
            table[mark][i] += 0.1 * first[i]
        for a, x in zip(small, capital):
            table[x][mark] += 0.1 * last[a]
            table[mark][x] += 0.1 * first_letter[small.index(a)]
    for z in digits:
        for y in digits:
            table[z][y] += 0.0002 * words
        for a in small:
            table[z][a] += 0.002 * first[a]
        for mark in "_-/=":
            table[z][at[mark]] += 0.0004 * words
    return table


def train(spark: SparkSession, docs: DataFrame) -> Model:
    """Log-likelihoods of ordinary transitions and of the letters of each class, one added to every count.

    The driver gets one number for each transition, whatever the number of documents.
    """
    words = [[0.0] * len(_EDGES) for _ in _EDGES]
    for r in _transitions(ordinary(docs), _EDGES).collect():
        words[r["pair"] // len(_EDGES)][r["pair"] % len(_EDGES)] += r["n"]
    plain = [[round(math.log((x + 1) / (sum(row) + len(row))), 3) for x in row] for row in _identifiers(words)]
    counts = [[0] * _N for _ in CLASSES]
    for r in drawn(spark).select("kind", F.explode(F.split("token", "")).alias("c")).groupBy("kind", "c").count().collect():
        counts[r["kind"]][ALPHABET.index(r["c"])] += r["count"]
    letters, means, spreads = [], [], []
    for row, alphabet in zip(counts, CLASSES.values()):
        own = [ALPHABET.index(c) for c in alphabet]
        known = {a: round(math.log((row[a] + 1) / (sum(row) + len(own))), 3) for a in own}
        letters += [known.get(a, 0.0) for a in range(_N)]
        ratios = [(known[b] - plain[a][b], math.exp(known[a] + known[b])) for a in own for b in own]
        mean = sum(x * w for x, w in ratios) / sum(w for _, w in ratios)
        means.append(mean)
        spreads.append(math.sqrt(sum((x - mean) ** 2 * w for x, w in ratios) / sum(w for _, w in ratios)))
    return Model([x for row in plain for x in row], letters, means, spreads)


def _literal(numbers: list[float]) -> Column:
    """A constant array written as one text, as one expression for each number would be slow to plan."""
    return F.split(F.lit(",".join(map(str, numbers))), ",").cast("array<double>")


def _class_of(token: Column) -> Column:
    """Number of the first alphabet that has all letters of a token; null for digits only and for too few letters."""
    out = F.lit(len(CLASSES) - 1)
    for i, letters in reversed(list(enumerate(CLASSES.values()))):
        out = F.when(token.rlike("^[" + letters.replace("-", "\\-") + "]+$"), i).otherwise(out)
    varied = F.size(F.array_distinct(F.split(token, ""))) >= LEAST_DIFFERENT
    return F.when(varied & ~token.rlike("^[0-9]+$"), out)


def excess(token: Column, model: Model) -> Column:
    """Mean log-likelihood ratio of the token's transitions, less the margin of its alphabet and length; null where
    a token is of no alphabet."""
    kind = _class_of(token)
    n = F.greatest(F.length(token) - 1, F.lit(1))
    codes = F.transform(F.split(token, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    steps = F.zip_with(F.slice(codes, F.lit(1), n), F.slice(codes, F.lit(2), n),
                       lambda a, b: F.struct((a * _N + b).alias("pair"), b.alias("b")))
    start = F.struct((kind * _N).alias("at"), F.lit(0.0).alias("sum"))
    mean = F.aggregate(steps, start, lambda t, x: F.struct(t["at"].alias("at"), (
        t["sum"] + F.get(_literal(model.letters), t["at"] + x["b"]) - F.get(_literal(model.ordinary), x["pair"])
    ).alias("sum")), lambda t: t["sum"]) / n
    usual = F.get(_literal(model.means), kind) - F.get(_literal(model.spreads), kind) * BELOW_MEAN / F.sqrt(n)
    return mean - F.greatest(usual, F.lit(LEAST_MARGIN))


def _is_random(token: Column, model: Model) -> Column:
    parts = F.concat(F.array(token), F.regexp_extract_all(token, F.lit(PART), F.lit(0)))
    return F.exists(parts, lambda p: F.coalesce(excess(p, model) >= 0, F.lit(False)))


def scan(docs: DataFrame, table: Model) -> DataFrame:
    """All columns of `docs` plus `spans`: an array of (start, rank, end, kind) in order of start, then of kind.

    Positions are code points, ends open. A null text has no spans. A candidate that overlaps a span of the fixed
    patterns adds none. A column named spans is replaced.
    """
    kinds = list(KINDS)
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    rows = docs.drop("spans").select(F.struct("*").alias("row"), text_of().alias("text"))
    for k, (pattern, group, least) in KINDS.items():
        rows = rows.withColumn(k, find(F.col("text"), pattern, group, least))
    rows = rows.withColumn("candidates", F.when(
        F.col("text").rlike(CANDIDATE), find(F.col("text"), CANDIDATE)).otherwise(none))

    def named(column: str, rank: int, kind: str) -> Column:
        return F.transform(column, lambda s: F.struct(
            s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind")))

    rows = rows.withColumn("base", F.array_sort(F.concat(*[named(k, i, k) for i, k in enumerate(kinds)])))
    fresh = F.filter("candidates", lambda s: ~F.exists(
        "base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])) & _is_random(s["value"], table))
    rows = rows.withColumn("random", F.when(F.size("candidates") > 0, fresh).otherwise(F.col("candidates")))
    return rows.select("row.*", F.array_sort(F.concat("base", named("random", len(kinds), "random"))).alias("spans"))


def written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, table: Model, mark: str = "[secret]", length: str | None = None) -> DataFrame:
    """`docs` with every span of its texts replaced by `mark`; overlapping spans become one. Nulls stay null.

    Of changed texts the code points are counted anew in the column `length`, if one is named.
    """
    kind = "array<struct<start:int,end:int>>"

    def join(done: Column, s: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        wider = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))
        return F.when((F.size(done) > 0) & (last["end"] >= s["start"]), F.concat(
            F.slice(done, F.lit(1), F.size(done) - 1), F.array(wider))).otherwise(F.concat(
                done, F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"))))).cast(kind)

    found = scan(docs, table).select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text").cast("string").alias("old"),
        F.aggregate("spans", F.array().cast(kind), join).alias("cuts"))

    def end(i: Column) -> Column:
        return F.coalesce(F.get("cuts", i)["end"], F.lit(0))

    parts = F.transform("cuts", lambda c, i: F.concat(
        F.substring("old", end(i - 1) + 1, c["start"] - end(i - 1)), F.lit(mark)))
    tail = F.substring("old", end(F.size("cuts") - 1) + 1, F.length("old"))
    changed = F.size("cuts") > 0
    found = found.withColumn("new", F.when(changed, F.concat(F.array_join(parts, ""), tail)).otherwise(F.col("old")))
    new = {"text": F.col("new")}
    if length:
        new[length] = F.when(changed, F.length("new").cast("long")).otherwise(F.col(f"row.`{length}`"))
    return found.select(*[new[c].alias(c) if c in new else F.col(f"row.`{c}`") for c in docs.columns])


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the fixed kinds, hash of their spans and all spans as text."""
    found = scan(docs.select("doc_id", "text"), train(docs.sparkSession, docs))
    base = F.filter("spans", lambda s: s["rank"] < len(KINDS))
    kinds = F.transform("spans", lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), *counts,
                        F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
