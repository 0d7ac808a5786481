"""Quality rules: counts with fixed limits, and the Jensen-Shannon distance of a text's histograms to language references.

All of it is DataFrame expressions; one pass over the texts, whose counts are stored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import store, text_of, words

#: Common words of each language that has a reference.
COMMON_WORDS = {
    "en": "the of and to in is that a for on are with as was be this".split(),
    "de": "der die und in den das von zu mit sich auf ist im ein nicht eine".split(),
    "fr": "de la le et les des en un du une que est pour dans qui par".split(),
    "es": "de la que el en y a los se del las un por con no una".split(),
}
#: Character classes as members of a regular expression, each counted. White space and the rest (small ASCII letters,
#: mainly) are two more classes.
CHARACTER_CLASSES = {
    "upper": r"\p{Lu}", "other_lower": r"\p{L}&&[^\p{Lu}a-z]", "digit": r"\p{Nd}", "stop": r".,;:?'\"()\-",
    "symbol": r"^\p{L}\p{Nd}\x20\x09-\x0D.,;:?'\"()\-",
}
#: A text is judged by its characters (by its words) only if it has so many of them.
MIN_CHARS, MIN_WORDS = 300, 200
#: Greatest distance to the nearest reference, from 0 (equal) to 1 (nothing shared).
MAX_CHAR_DISTANCE, MAX_WORD_DISTANCE = 0.3, 0.25
#: A window of so many words that comes twice in a text is a repetition.
WINDOW = 8
MIN_TOTAL_WORDS, MAX_REPEAT_PERCENT = 20, 30
_LISTED = sorted({w for ws in COMMON_WORDS.values() for w in ws})


#: One letter for each listed word, so that the hits of a text are a short string.
_LETTERS = [chr(33 + i) for i in range(len(_LISTED))]


def _literals(values: list) -> Column:
    return F.array(*map(F.lit, values))


def _joined(hashes: Column, step: int) -> Column:
    """Hash of each run made of the run at its place and the one `step` later."""
    n = F.greatest(F.size(hashes) - step, F.lit(0))
    return F.zip_with(
        F.slice(hashes, F.lit(1), n), F.slice(hashes, F.lit(step + 1), n), lambda a, b: F.xxhash64(a, b))


def _counts(docs: DataFrame) -> DataFrame:
    """One narrow row of counts for each document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"),
                       text_of().alias("t"))
    rows = rows.withColumn("w", words(F.col("t"))).withColumn("n_words", F.size("w"))
    rows = rows.withColumn("h1", F.transform("w", lambda x: F.xxhash64(x)))
    for k in (1, 2, 4):  # runs of 2, 4 and 8 words: WINDOW
        rows = rows.withColumn(f"h{2 * k}", _joined(F.col(f"h{k}"), k))
    rows = rows.withColumnRenamed(f"h{WINDOW}", "grams")
    rows = rows.withColumn("twice", F.size(F.array_distinct("grams")) < F.size("grams"))
    rows = rows.withColumn("pairs", F.when(F.col("twice"), F.array_sort(F.transform(
        "grams", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    rows = rows.withColumn("again", F.array_sort(F.array_compact(F.transform("pairs", lambda x, k: F.when(
        (x["h"] == F.get("pairs", k - 1)["h"]) | (x["h"] == F.get("pairs", k + 1)["h"]), x["i"])))))
    covered = F.aggregate(
        F.transform("again", lambda i, k: F.least(F.lit(WINDOW), F.coalesce(F.get("again", k + 1) - i, F.lit(WINDOW)))),
        F.lit(0), lambda a, b: a + b)
    rows = rows.withColumn("lines", F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    rows = rows.withColumn("hits", F.filter("w", lambda x: x.isin(_LISTED)))
    letter = F.transform("hits", lambda x: F.get(
        _literals(_LETTERS), (F.array_position(_literals(_LISTED), x) - 1).cast("int")))
    rows = rows.withColumn("letters", F.array_join(letter, ""))
    per_word = F.transform(
        _literals(_LETTERS), lambda c: F.length("letters") - F.length(F.replace("letters", c, F.lit(""))))
    counted = rows.select(
        "doc_id", "lang", "n_words", F.length("t").alias("n_chars"),
        F.length(F.array_join("w", "")).alias("word_chars"),
        F.regexp_count("t", F.lit("[#*$%&|<>]")).alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).alias("n_repeat_words"),
        F.array(*[F.regexp_count("t", F.lit(f"[{m}]")) for m in CHARACTER_CLASSES.values()]).alias("classes"),
        per_word.alias("common"))
    return counted.withColumn("classes", F.concat("classes", F.array(F.col("n_chars") - F.col("word_chars"))))


def _histograms(rows: DataFrame) -> DataFrame:
    """Both histograms with their last class: the other characters, words in no list."""
    rest = lambda c, n: F.concat(c, F.array(F.col(n) - F.aggregate(c, F.lit(0), lambda a, b: a + b)))
    return rows.withColumns({"classes": rest(F.col("classes"), "n_chars"), "common": rest(F.col("common"), "n_words")})


def references(rows: DataFrame) -> dict[str, tuple[list[float], list[float]]]:
    """For each listed language the shares of character classes and of common words over its passing documents.

    A language without such documents has no reference. The driver gets one row for each listed language.
    """
    good = rows.where(F.col("lang").isin(list(COMMON_WORDS)) & ~_failed())
    sizes = {"classes": len(CHARACTER_CLASSES) + 2, "common": len(_LISTED) + 1}
    sums = [F.sum(F.col(c)[i].cast("long")).alias(f"{c}{i}") for c, n in sizes.items() for i in range(n)]
    out = {}
    for r in good.groupBy("lang").agg(*sums).collect():
        both = [[r[f"{c}{i}"] for i in range(n)] for c, n in sizes.items()]
        out[r["lang"]] = tuple([x / max(math.fsum(v), 1) for x in v] for v in both)
    return dict(sorted(out.items()))


def distance(shares: Column, reference: list[float]) -> Column:
    """Jensen-Shannon distance (base 2) of a histogram's shares to reference shares; null if there are no shares.

    With p the text's and q the reference's share of a class, it sums p log p + q log q - (p + q) log((p + q) / 2);
    the reference's part is a constant.
    """
    known = F.array(*[F.struct(F.lit(q).alias("q"), F.lit(q * math.log2(q) if q > 0 else 0.0).alias("own"))
                      for q in reference])

    def part(p: Column, r: Column) -> Column:
        both = p + r["q"]
        own = F.when(p > 0, p * F.log2(p)).otherwise(F.lit(0.0)) + r["own"]
        return F.when(both > 0, own - both * F.log2(both / 2)).otherwise(F.lit(0.0))

    total = F.aggregate(F.zip_with(shares, known, part), F.lit(0.0), lambda a, b: a + b)
    return F.sqrt(F.greatest(total / 2, F.lit(0.0)))


def _failed() -> Column:
    return (F.col("n_words") < MIN_TOTAL_WORDS) | (
        F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)


def rate(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed, the two distances and kept for every row of `docs` (doc_id, text, lang).

    Null and empty texts have no words and fail. A text too short for a histogram is not judged by it. The language
    column only says which texts make a reference: a text is compared with all and has the distance to the nearest.
    Without any reference (no listed language in the corpus), distances are null and the base rules decide. Repeated
    rows are judged alike; other columns are ignored.
    """
    counted = store(_counts(docs), "counts")
    rows = _histograms(counted)
    known = references(rows).values()
    # narrow rows come back in few tasks; the distances are dealt over all cores, and the shares are made once
    rows = rows.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    for c, n in (("classes", "n_chars"), ("common", "n_words")):
        rows = rows.withColumn(c, F.when(F.col(n) > 0, F.transform(c, lambda x: x / F.col(n))))
    nearest = {
        "char_distance": F.array_min(F.array(*[distance(F.col("classes"), r[0]) for r in known])) if known else None,
        "word_distance": F.array_min(F.array(*[distance(F.col("common"), r[1]) for r in known])) if known else None,
    }
    rows = rows.withColumns({c: F.lit(None).cast("double") if d is None else d for c, d in nearest.items()})
    far = ((F.col("n_chars") >= MIN_CHARS) & (F.col("char_distance") > MAX_CHAR_DISTANCE)) | (
        (F.col("n_words") >= MIN_WORDS) & (F.col("word_distance") > MAX_WORD_DISTANCE))
    longs = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return rows.select(
        "doc_id", *[F.col(c).cast("long").alias(c) for c in longs], _failed().alias("base_failed"),
        (~_failed() & ~F.coalesce(far, F.lit(False))).alias("kept"), "char_distance", "word_distance")
