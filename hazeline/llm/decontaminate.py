"""Benchmark decontamination as a prefix-filtered set join of word windows (operator 4), DataFrame functions only.

1. Words of the items give windows of ``WINDOW`` words (a shorter item is one window) and shingles of ``SHINGLE`` words.
2. The occurrences of the items' shingles are counted over all documents. A window can only occur where all its
   shingles occur, so its one necessary prefix token is the shingle that is rarest in the corpus.
3. Document positions that hold a chosen shingle are joined with the windows' items; each gives an alignment of item
   and document. Length and positional bounds drop alignments that leave no room for a window.
4. Alignments are verified word by word, over windows of the item's size.

A fixed-size bit table, whatever the size of the benchmark, keeps positions out of the join that hold none of the
shingles; its false positives are dropped by the join. Results hang on the text alone, so equal texts are judged once
(by two 64-bit hashes) and joined back to their rows.

Defined results: null texts, empty texts and texts without words have zeros, the digest of no items and are not
contaminated. Items without words have no window. Items with a null id count for hits but are not listed. Other columns
are not read, whatever their names.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, functions as F

from hazeline.llm.bits import bit_table, in_table
from hazeline.llm.names import unused
from hazeline.session import materialized

WINDOW, SHINGLE = 13, 3
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lowered(text: Column) -> Column:
    """A-Z lower-cased and nothing else; null as the empty text."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, ascii_uppercase, ascii_lowercase))


def words(text: Column) -> Column:
    return F.array_remove(F.split(lowered(text), NO_WORD), "")


def text_keys() -> list[Column]:
    text = F.coalesce(F.col("text"), F.lit(""))
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2")]


def _shingles(df: DataFrame, *keep: str) -> DataFrame:
    """Each position of ``words`` with the words from there: pos, w0 to w2, null beyond the end."""
    rest = [F.slice("words", i + 1, F.greatest(F.size("words") - i, F.lit(0))) for i in range(1, SHINGLE)]
    zipped = F.arrays_zip(F.col("words").alias("w0"), *[c.alias(f"w{i + 1}") for i, c in enumerate(rest)])
    return df.select(*keep, F.posexplode(zipped).alias("pos", "w")).select(
        *keep, "pos", *[F.col("w").getField(f"w{i}").alias(f"w{i}") for i in range(SHINGLE)])


def _key(size: int) -> Column:
    """Key of the shingle of this many words; null if the text ends before."""
    return F.when(F.col(f"w{size - 1}").isNotNull(), F.xxhash64(F.lit(size), *[f"w{i}" for i in range(size)]))


def _positions(docs: DataFrame, keys: DataFrame, sizes: list[int], *keep: str) -> DataFrame:
    """(keep, pos, key) of document positions whose shingle may be one of the keys."""
    table = materialized(bit_table(keys, "key"), "bits").scalar()
    placed = _shingles(docs, *keep)
    hit = F.filter(F.array(*[_key(s) for s in sizes]), lambda k: k.isNotNull())
    if len(sizes) == 1:
        return placed.select(*keep, "pos", _key(sizes[0]).alias("key")).where(in_table(F.col("key"), table))
    any_ = None
    for s in sizes:
        one = in_table(_key(s), table)
        any_ = one if any_ is None else any_ | one
    return placed.where(any_).select(*keep, "pos", F.explode(hit).alias("key"))


def items_of(benchmark: DataFrame) -> DataFrame:
    """Distinct word sequences of the items with their ids: item (words joined), n and ids."""
    return (benchmark.select(F.col("item_id").cast("string").alias("id"), words(F.col("text")).alias("words"))
            .where(F.size("words") > 0).groupBy(F.array_join("words", " ").alias("item"))
            .agg(F.collect_set("id").alias("ids"), F.max(F.size("words")).alias("n")))


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated for each row of docs (doc_id, text)."""
    items = materialized(items_of(benchmark).withColumn("words", F.split("item", " "))
                         .withColumn("window", F.least("n", F.lit(WINDOW)))
                         .withColumn("size", F.least("n", F.lit(SHINGLE))), "items")
    sizes = sorted(r["size"] for r in items.select("size").distinct().collect())  # 1 to SHINGLE
    rows = docs.select("doc_id", *text_keys(), words(F.col("text")).alias("words"))
    counted = rows.select("doc_id", "k1", "k2", F.size("words").cast("long").alias("n_words"))
    nothing = (F.lit(0).cast("long").alias("n_hit"), F.lit(0).cast("long").alias("n_items"),
               F.sha2(F.lit(""), 256).alias("items_sha256"), F.lit(False).alias("contaminated"))
    if not sizes:
        return counted.select("doc_id", "n_words", *nothing)
    key = F.lit(None).cast("long")
    for s in sizes:
        key = F.when(F.col("size") == s, _key(s)).otherwise(key)
    grams = materialized(_shingles(items, "item", "n", "window", "size").select(
        "item", "n", "window", "size", F.col("pos").alias("at"), key.alias("key")).where("key is not null"), "grams")
    known = grams.select("key").distinct()
    seen = _positions(rows.select("words"), known, sizes).groupBy("key").agg(F.count("*").alias("times"))
    ranked = grams.join(seen, "key", "left").withColumn("times", F.coalesce("times", F.lit(0)))
    # the shingles of the window that starts at s are those at s to s + window - size
    chosen = (ranked.withColumn("start", F.explode(F.sequence(
        F.greatest(F.col("at") - F.col("window") + F.col("size"), F.lit(0)),
        F.least(F.col("at"), F.col("n") - F.col("window")))))
        .groupBy("item", "start").agg(F.min(F.struct("times", "at", "key")).alias("rarest"))
        .select("item", F.col("rarest.at").alias("at"), F.col("rarest.key").alias("key"), F.col("rarest.times").alias("times"))
        .where("times > 0").distinct().drop("times"))
    chosen = materialized(chosen.join(items.select("item", "n", "window"), "item"), "chosen")
    placed = _positions(rows.select("k1", "k2", F.size("words").alias("n_words"), "words"),
                        chosen.select("key").distinct(), sizes, "k1", "k2", "n_words")
    start = (F.col("pos") - F.col("at")).alias("start")
    room = F.least(F.col("n"), F.col("n_words") - start) - F.greatest(F.lit(0), -start)
    aligned = (placed.join(chosen, "key").where(room >= F.col("window"))
               .select("k1", "k2", "item", "window", start).distinct())
    aligned = materialized(aligned, "aligned")
    table = materialized(bit_table(aligned.select("k1").distinct(), "k1"), "bits").scalar()
    texts = (docs.select(*text_keys(), F.col("text")).where(in_table(F.col("k1"), table))
             .groupBy("k1", "k2").agg(F.min("text").alias("text")))
    both = (aligned.join(texts, ["k1", "k2"])
            .select("k1", "k2", "item", "window", "start", words(F.col("text")).alias("d"), F.split("item", " ").alias("i")))
    low = F.greatest(F.lit(0), -F.col("start"))
    high = F.least(F.size("i"), F.size("d") - F.col("start")) - F.col("window")
    hits = F.filter(F.sequence(low, high), lambda s: F.slice("d", F.col("start") + s + 1, F.col("window")) == F.slice(
        "i", s + 1, F.col("window")))
    found = materialized(both.select("k1", "k2", "item", "window", F.transform(hits, lambda s: s + F.col("start")).alias("at"))
                         .where(F.size("at") > 0), "found")
    covered = F.flatten(F.transform("at", lambda s: F.sequence(s, s + F.col("window") - 1)))
    per_text = (found.select("k1", "k2", "item", F.array_distinct(covered).alias("hit"))
                .join(items.select("item", "ids"), "item").groupBy("k1", "k2")
                .agg(F.size(F.array_distinct(F.flatten(F.collect_list("hit")))).cast("long").alias("n_hit"),
                     F.sort_array(F.array_distinct(F.flatten(F.collect_set("ids")))).alias("ids")))
    listed = per_text.select("k1", "k2", "n_hit", F.size("ids").cast("long").alias("n_items"),
                             F.sha2(F.array_join("ids", ","), 256).alias("items_sha256"))
    judged = counted.join(listed, ["k1", "k2"], "left")
    hit = F.coalesce("n_hit", F.lit(0))
    return judged.select("doc_id", "n_words", hit.cast("long").alias("n_hit"),
                         F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
                         F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
                         ((hit > 0) & (20 * hit >= F.col("n_words"))).alias("contaminated"))


def without_benchmark(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that are not contaminated, with their own columns."""
    rows = docs.select(F.struct(*text_keys()).alias("doc_id"), "text")
    a, b, bad_a, bad_b = unused(docs.columns, "__a", "__b", "__k1", "__k2")
    bad = contamination(rows, benchmark).where("contaminated").select(
        F.col("doc_id.k1").alias(bad_a), F.col("doc_id.k2").alias(bad_b)).distinct()
    k1, k2 = text_keys()
    return (docs.withColumns({a: k1, b: k2})
            .join(bad, (F.col(a) == F.col(bad_a)) & (F.col(b) == F.col(bad_b)), "left_anti").select(docs.columns))
