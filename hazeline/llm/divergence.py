"""Quality rules by distribution divergence (operator 1), DataFrame functions only.

Two histograms of a text are compared with those of its language by the Jensen-Shannon distance (square root of the
divergence in bits, 0 to 1): characters by class, and words by the ``COMMON`` most frequent words of the language plus
one bin for all others. The references are counted over all documents of the language. Minimum-length guards keep
short texts, whose histograms say little, and languages with little text from being judged.

Languages are told apart by the whole lower-cased primary subtag of their code: what stands before the first "-" or "_",
without spaces around it. Null and empty codes are the language "und". Few references are broadcast; many, as odd codes
may make, are joined by language and salt.

Base rules: a text fails with fewer than 20 words, or if more than 30 in 100 of its words lie in 8-word windows that
occur twice or more in the text (windows are compared by a 64-bit hash).

Defined results: null and empty texts have zero counts and fail the base rules. Repeated rows are judged alike, each by
its own text. A language's words of equal frequency are ranked by the words themselves. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window

from hazeline.operators.joins import attach
from hazeline.session import materialized

COMMON = 24
MIN_WORDS, MIN_CHARS = 50, 200
MIN_LANGUAGE_WORDS = 2_000
MAX_CLASS_DISTANCE, MAX_WORD_DISTANCE = 0.29, 0.48
REPEATED = 8
SPACE = r"[\x20\x09-\x0D]+"
CLASSES = ("lower", "upper", "digit", "space", "symbol", "other")


def _body() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


def _language() -> Column:
    code = F.trim(F.lower(F.regexp_extract(F.coalesce(F.col("lang"), F.lit("")), "^[^_-]*", 0)))
    return F.when(code != "", code).otherwise("und")


def _without(text: Column, form: str) -> Column:
    return F.char_length(F.regexp_replace(text, form, "")).cast("long")


def _bound(value: Column, use) -> Column:
    """``use`` of a value that is computed once, also where ``use`` names it inside a lambda."""
    return F.transform(F.array(value), use)[0]


def _repeats(words: Column) -> Column:
    """How many words lie in windows that occur twice or more."""
    def covered(hashes: Column) -> Column:
        marked = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = _bound(marked, lambda s: F.filter(s, lambda x, i: (
            x["h"].eqNullSafe(F.get(s, i - 1)["h"]) | x["h"].eqNullSafe(F.get(s, i + 1)["h"]))))
        places = F.sort_array(F.transform(twice, lambda x: x["i"]))
        start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        return F.aggregate(places, start, lambda a, p: F.struct(
            (a["n"] + p + REPEATED - F.greatest(a["end"], p)).alias("n"), (p + REPEATED).alias("end")))["n"]

    def counted(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(1), F.size(w) - (REPEATED - 1)), lambda i: F.xxhash64(F.slice(w, i, REPEATED)))
        return _bound(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(covered(h)))

    return F.when(F.size(words) > REPEATED, _bound(words, counted)).otherwise(0).cast("long")


def measured(docs: DataFrame) -> DataFrame:
    """The base counts, the class counts and the words of each row."""
    text = _body()
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    rows = docs.select("doc_id", _language().alias("language"), text.alias("text")).select(
        "doc_id", "language", F.array_remove(F.split("text", SPACE), "").alias("words"),
        F.array_remove(F.split(F.lower("text"), SPACE), "").alias("lower_words"),
        F.char_length("text").cast("long").alias("chars"),
        _without(F.col("text"), r"[\x20\x09-\x0D]+").alias("word_chars"),
        _without(F.col("text"), r"[^#*$%&|<>]+").alias("symbol"),
        _without(F.col("text"), r"[^a-z]+").alias("plain_lower"), _without(F.col("text"), r"[^\p{L}]+").alias("letters"),
        _without(F.col("text"), r"[^\p{Lu}]+").alias("upper"), _without(F.col("text"), r"[^\p{Nd}]+").alias("digit"),
        F.when(F.instr("text", "\n") > 0, _bound(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))).otherwise(0)
        .cast("long").alias("n_dup_lines"))
    return rows.select("doc_id", "language", "words", "lower_words", "word_chars", F.col("symbol").alias("n_symbols"), "n_dup_lines",
                       F.size("words").cast("long").alias("n_words"),
                       (F.col("letters") - F.col("upper")).alias("lower"), "upper", "digit",
                       (F.col("chars") - F.col("word_chars")).alias("space"), "symbol",
                       (F.col("word_chars") - F.col("letters") - F.col("digit") - F.col("symbol")).alias("other"))


def common_words(docs: DataFrame, most: int = COMMON) -> DataFrame:
    """The most frequent words of each language, in order, with their counts: language, n, words, times."""
    text = _body()
    counts = (docs.select(_language().alias("language"), F.explode(F.array_remove(F.split(F.lower(text), SPACE), "")).alias("word"))
              .groupBy("language", "word").agg(F.count("*").alias("times")))
    counts = materialized(counts.where("times > 1"), "word-counts")
    ranked = counts.withColumn("rank", F.row_number().over(Window.partitionBy("language").orderBy(F.desc("times"), "word")))
    return ranked.where(F.col("rank") <= most).groupBy("language").agg(
        F.sort_array(F.collect_list(F.struct("rank", "word", "times"))).alias("top")).select(
        "language", F.col("top.word").alias("common"), F.col("top.times").alias("times"))


def _counted(docs: DataFrame, common: DataFrame) -> DataFrame:
    """Everything that is counted in a text, written once: base counts, class counts, and how often each common word of
    its language is in it. References and distances come from these rows; texts are not read again."""
    rows = attach(measured(docs), common.select("language", "common"), "language")
    none = F.array().cast("array<bigint>")
    hits = F.coalesce(_hits(F.col("lower_words"), F.col("common")), none)
    return materialized(rows.withColumn("n_repeat_words", _repeats(F.col("words"))).withColumn("hits", hits)
                        .drop("words", "lower_words", "common"), "measured")


def _hits(words: Column, common: Column) -> Column:
    """How often each common word is among the lower-cased words."""
    return F.transform(common, lambda w: (F.size(words) - F.size(F.array_remove(words, w))).cast("long"))


def references(docs: DataFrame) -> DataFrame:
    """One row for each language: shares of the character classes, the common words and their shares."""
    common = materialized(common_words(docs), "common")
    return _references(_counted(docs, common), common)


def _references(rows: DataFrame, common: DataFrame) -> DataFrame:
    sums = rows.groupBy("language").agg(F.sum("n_words").alias("words"), *[F.sum(c).alias(c) for c in CLASSES])
    chars = sum((F.col(c) for c in CLASSES[1:]), F.col(CLASSES[0]))
    both = sums.join(common, "language", "left")
    return both.select("language", F.col("words").alias("language_words"),
                       F.array(*[F.try_divide(c, chars) for c in CLASSES]).alias("class_share"),
                       F.coalesce("common", F.array().cast("array<string>")).alias("common"),
                       F.coalesce(F.transform("times", lambda t: F.try_divide(t, "words")), F.array().cast("array<double>")).alias("word_share"))


def _distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two arrays of shares of equal length."""
    terms = F.zip_with(p, q, lambda a, b: (F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(0.0)
                                           + F.when(b > 0, b * F.log2(2 * b / (a + b))).otherwise(0.0)) / 2)
    return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda s, x: s + x), F.lit(0.0)))


def quality(docs: DataFrame, max_class: float = MAX_CLASS_DISTANCE, max_word: float = MAX_WORD_DISTANCE) -> DataFrame:
    """doc_id, the base counts, both distances, base_failed and kept for each row of docs (doc_id, text, lang)."""
    common = materialized(common_words(docs), "common")
    counted = _counted(docs, common)
    rows = attach(counted, materialized(_references(counted, common), "references"), "language")
    n_chars = sum((F.col(c) for c in CLASSES[1:]), F.col(CLASSES[0]))
    enough = (F.col("n_words") >= MIN_WORDS) & (n_chars >= MIN_CHARS) & (F.col("language_words") >= MIN_LANGUAGE_WORDS)
    class_distance = F.when(enough, _distance(F.array(*[F.col(c) / n_chars for c in CLASSES]), F.col("class_share")))
    whole = F.concat("word_share", F.array(1.0 - F.aggregate("word_share", F.lit(0.0), lambda s, x: s + x)))
    found = F.aggregate("hits", F.lit(0).cast("long"), lambda s, n: s + n)
    shares = F.concat(F.transform("hits", lambda n: n / F.col("n_words")), F.array(1.0 - found / F.col("n_words")))
    word_distance = F.when(enough & (F.size("common") > 0), _distance(shares, whole))
    out = rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", class_distance.alias("class_distance"),
                      word_distance.alias("word_distance"))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    near = (F.coalesce("class_distance", F.lit(0.0)) <= max_class) & (F.coalesce("word_distance", F.lit(0.0)) <= max_word)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                      failed.alias("base_failed"), (~failed & near).alias("kept"), "class_distance", "word_distance")
