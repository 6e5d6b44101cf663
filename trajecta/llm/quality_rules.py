"""Quality rules in DataFrame functions alone: counting rules, and a log-likelihood ratio of hashed n-grams.

Runs of letters and digits, and runs of other visible characters, are a text's units; units and pairs of neighbours hash
to buckets. Two multinomials over the buckets, each with add-one smoothing, are counted: one over the documents labelled good (the trusted target), one over
the whole corpus. A document's score is the mean over its n-grams of log(target / corpus); it is kept if that is at least
`threshold` and no counting rule fails. Everything about one document is computed in its own row, so nothing of it is shuffled;
only bucket counts are, and at most `buckets` rows of them go over the driver.

Defined results: null text counts as empty: no words, and base_failed; a text without units scores 0; without good labels all
weights are 0, and the counting rules decide alone. A text of any length is taken whole. Each repeated row gets its result again. `annotate` keeps other columns, but for
those with a new name, which it replaces; `passing` keeps all. The target is counted on at most `sample` labelled documents, those with the least hashed ids; the corpus counts are of all documents.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajecta.llm.tables import numbered, replaced

SPACES = " \t\n\x0b\f\r"
UNITS = r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]+"
COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "llr", "base_failed", "kept")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def repeat_words(w: Column, size: int = 3) -> Column:
    """Number of words inside windows of `size` words that are found twice or more in the array."""
    positions = F.sequence(F.lit(0), F.size(w) - size)
    windows = F.array_sort(F.transform(positions, lambda i: F.struct(F.xxhash64(*(F.get(w, i + k) for k in range(size))).alias("h"), i.alias("i"))))

    def repeated(s: Column) -> Column:
        same = lambda x, j: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
        return F.array_sort(F.transform(F.filter(s, lambda x, j: same(x, j - 1) | same(x, j + 1)), lambda x: x["i"]))

    def covered(p: Column) -> Column:
        steps = F.aggregate(F.sequence(F.lit(1), F.size(p) - 1), F.lit(0), lambda total, j: total + F.least(F.lit(size), F.get(p, j) - F.get(p, j - 1)))
        return F.when(F.size(p) == 0, 0).when(F.size(p) == 1, size).otherwise(size + steps)

    return F.when(F.size(w) < size, F.lit(0)).otherwise(let(let(windows, repeated), covered)).cast("long")


def duplicate_lines(text: Column) -> Column:
    """Number of lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, SPACES, "") != "")
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def ngram_buckets(text: Column, buckets: int) -> Column:
    """Buckets of all units and of all pairs of neighbouring units."""

    def both(u: Column) -> Column:
        pairs = F.when(F.size(u) > 1, F.transform(F.sequence(F.lit(0), F.size(u) - 2), lambda i: F.pmod(F.xxhash64(F.get(u, i), F.get(u, i + 1)), F.lit(buckets)).cast("int"))).otherwise(F.array().cast("array<int>"))
        return F.concat(F.transform(u, lambda x: F.pmod(F.xxhash64(x), F.lit(buckets)).cast("int")), pairs)

    return let(F.regexp_extract_all(text, F.lit(UNITS), F.lit(0)), both)


def ratio_weights(docs: DataFrame, labels: DataFrame, *, buckets: int = 8192, sample: int = 4000, key: str = "doc_id", column: str = "text", label: str = "quality") -> list[float]:
    """log(target / corpus) of each bucket."""
    spark = docs.sparkSession
    good = labels.where((F.col(label) == 1) & F.col(key).isNotNull()).select(key).distinct().orderBy(F.xxhash64(key), key).limit(sample).collect()
    target = F.broadcast(spark.createDataFrame([(r[0], 1) for r in good], "trusted_key long, trusted int"))
    grams = docs.select(F.col(key).alias("trusted_key"), F.coalesce(F.col(column), F.lit("")).alias("text")).join(target, "trusted_key", "left")
    grams = grams.select("trusted", F.explode(ngram_buckets(F.col("text"), buckets)).alias("bucket"))
    counts = grams.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.count("trusted").alias("m")).collect()
    raw, trusted = [1] * buckets, [1] * buckets
    for r in counts:
        raw[r.bucket] += r.n
        trusted[r.bucket] += r.m
    if sum(trusted) == buckets:
        return [0.0] * buckets
    shift = math.log(sum(raw)) - math.log(sum(trusted))
    return [math.log(m) - math.log(n) + shift for n, m in zip(raw, trusted)]


def annotate(docs: DataFrame, weights: list[float], *, column: str = "text", threshold: float = -0.25, least_words: int = 50, most_repeated: int = 50) -> DataFrame:
    """docs with the counts, llr, base_failed and kept."""
    docs = replaced(docs, list(COLUMNS), column)
    text = F.coalesce(F.col(f"`{column}`"), F.lit(""))
    weight = F.split(F.lit(",".join(f"{x:.9g}" for x in weights)), ",").cast("array<double>")
    mean = lambda b: F.when(F.size(b) == 0, 0.0).otherwise(F.aggregate(b, F.lit(0.0), lambda total, x: total + F.get(weight, x)) / F.size(b))
    of_words = lambda w: F.struct(F.size(w).cast("long").alias("n"), repeat_words(w).alias("repeated"))
    out = docs.withColumn("n_words", let(words(text), of_words))
    counted = out.withColumns(
        {
            "n_words": F.col("n_words")["n"],
            "word_chars": F.char_length(F.translate(text, SPACES, "")).cast("long"),
            "n_symbols": (F.char_length(text) - F.char_length(F.translate(text, "#*$%&|<>", ""))).cast("long"),
            "n_dup_lines": duplicate_lines(text),
            "n_repeat_words": F.col("n_words")["repeated"],
            "llr": let(ngram_buckets(text, len(weights)), mean),
        }
    )
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))
    return counted.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= threshold))


def passing(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", column: str = "text", buckets: int = 8192, threshold: float = -0.25) -> DataFrame:
    """The documents that are kept, with exactly their own columns."""
    plain, names = numbered(docs)
    weights = ratio_weights(docs.select(F.col(f"`{key}`"), F.col(f"`{column}`").alias("text")), labels, buckets=buckets, key=key)
    found = annotate(plain, weights, column=names[column], threshold=threshold).where("kept")
    return found.select(*(F.col(new).alias(old) for old, new in names.items()))


def score(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", column: str = "text", buckets: int = 8192, threshold: float = -0.25) -> DataFrame:
    """key and all counts and verdicts of every document."""
    only = docs.select(F.col(key), F.col(column).alias("text"))
    return annotate(only, ratio_weights(only, labels, buckets=buckets, key=key), threshold=threshold).select(key, *COLUMNS)
