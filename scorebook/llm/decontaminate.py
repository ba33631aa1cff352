"""Benchmark decontamination by winnowing, in DataFrame functions only.

Words are runs of digits, letters a-z (A-Z lowered) and characters beyond ASCII. A window is ``length`` consecutive words of an item; an item of
fewer words, but not none, is one window. The steps:

1. Every text keeps the least of each ``length - k + 1`` neighbouring hashes of k words (winnowing). Two texts that share ``length``
   words so share a fingerprint, whatever surrounds them. For short items, if there are any, documents also keep the
   hashes of all windows of those lengths.
2. Documents and items join on fingerprints; documents without a common one are settled.
3. In the others the hits are extended: their windows join the items' windows on 128 bits of hash, and overlapping
   windows are united to count the words inside.

Fingerprints are distinct per document, and the items' side is distinct, so a passage that a third of all documents share adds one row
per document. No side has a broadcast hint: Spark broadcasts the items while they are small.

Null and empty texts have no words. Repeated rows get equal results; ids may be null (a null item counts as the item ''). Empty tables
are fine on either side. Other columns are not read by the query and pass through ``drop_contaminated``.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorebook.llm.common import NO_ID, doc_key, public_id, stored

_UPPER = "".join(map(chr, range(0x41, 0x5B)))
_OTHER = "".join(map(chr, [*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))


def words(text: Column) -> Column:
    """Words of a text, in order. The text starts with a space, so the first part of the split is always empty."""
    plain = F.translate(F.concat(F.lit(" "), text), _UPPER + _OTHER, _UPPER.lower() + " " * len(_OTHER))
    return F.filter(F.split(plain, " +"), lambda w: w != "")


def _shifted(values: Column, by: int) -> Column:
    return F.slice(values, F.lit(by + 1), F.greatest(F.size(values) - by, F.lit(0)))


def _pairs(a: Column, b: Column, fn) -> Column:
    """fn over the places that both arrays have; b is the shorter."""
    return F.zip_with(F.slice(a, F.lit(1), F.size(b)), b, fn)


def with_grams(df: DataFrame, k: int, out: str, hashes: str = "h") -> DataFrame:
    """``out``: hashes of all k consecutive entries of ``hashes``, put together from powers of two."""
    df = df.withColumn("_g1", F.col(hashes))
    size, at, made = 1, 0, None
    while size <= k:
        if k & size:
            part = F.col(f"_g{size}")
            df = df.withColumn("_sum", part if made is None else _pairs(F.col("_sum"), _shifted(part, at), lambda a, b: F.xxhash64(a, b)))
            made = True
            at += size
        if size * 2 <= k:
            g = F.col(f"_g{size}")
            df = df.withColumn(f"_g{size * 2}", _pairs(g, _shifted(g, size), lambda a, b: F.xxhash64(a, b)))
        size *= 2
    return df.withColumn(out, F.col("_sum")).drop("_sum", *(f"_g{1 << i}" for i in range(k.bit_length())))


def with_least(df: DataFrame, width: int, column: str) -> DataFrame:
    """``column`` replaced by the least of each ``width`` neighbouring entries; a shorter array keeps its least entry."""
    df = df.withColumn("_m", F.col(column))
    size = 1
    while size * 2 <= width:
        m = F.col("_m")
        df = df.withColumn("_m", _pairs(m, _shifted(m, size), lambda a, b: F.least(a, b)))
        size *= 2
    if size < width:
        m = F.col("_m")
        df = df.withColumn("_m", _pairs(m, _shifted(m, width - size), lambda a, b: F.least(a, b)))
    few = F.size(column) < width
    return df.withColumn(column, F.when(few & (F.size(column) > 0), F.array(F.array_min(column))).otherwise(F.col("_m"))).drop("_m")


def exploded(df: DataFrame, array: Column, name: str) -> DataFrame:
    """A row per entry. The outer form keeps the optimizer from testing the array's size below, once for each of its uses there."""
    return df.withColumn(name, F.explode_outer(array)).where(F.col(name).isNotNull())


def windows(df: DataFrame, lengths: list[int]) -> DataFrame:
    """A row for each window of the given lengths of ``w``: ``start`` (from 0), ``len``, and two hashes."""
    each = None
    for n in lengths:
        at = F.when(F.size("w") >= n, F.sequence(F.lit(1), F.size("w") - n + 1))
        rows = (exploded(df, at, "start")
                .withColumn("_s", F.slice("w", F.col("start"), F.lit(n)))
                .withColumn("a", F.xxhash64("_s")).withColumn("b", F.xxhash64(F.lit(n), F.lit("b"), "_s"))
                .withColumn("len", F.lit(n)).withColumn("start", F.col("start") - 1).drop("_s", "w"))
        each = rows if each is None else each.unionByName(rows)
    return each


def contamination(docs: DataFrame, benchmark: DataFrame, length: int = 13, k: int = 6) -> DataFrame:
    """``did, th, n_words, n_hit, n_items, items_sha256``: one row per row of ``docs``; ``th`` is a hash of the text."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"),
                             words(F.coalesce(F.col("text"), F.lit(""))).alias("w")).where(F.size("w") > 0)
    short = sorted(r["n"] for r in items.where(F.size("w") < length).select(F.size("w").alias("n")).distinct().collect())
    # A long item has all its windows of the full length, a short one a single window of its own.
    parts = [windows(items, [length]), *(windows(items.where(F.size("w") == n), [n]) for n in short)]
    grams = stored(functools.reduce(DataFrame.unionByName, parts).select("a", "b", "len", "item").distinct(), "decontaminate-items")

    def printed(df: DataFrame, *keep: str) -> DataFrame:
        df = df.withColumn("h", F.transform("w", lambda x: F.xxhash64(x)))
        df = with_least(with_grams(df, k, "prints"), length - k + 1, "prints")
        for n in short:
            df = with_grams(df, n, f"prints_{n}")
        each = [F.col("prints"), *(F.transform(f"prints_{n}", lambda x, n=n: F.xxhash64(F.lit(n), x)) for n in short)]
        return df.select(*keep, F.array_distinct(F.concat(*each)).alias("prints"))

    body = doc_key(docs)
    seen = stored(printed(body.select("did", F.xxhash64("body").alias("th"), words(F.col("body")).alias("w"))
                          .withColumn("n_words", F.size("w").cast("long")), "did", "th", "n_words"), "decontaminate-prints")
    item_prints = exploded(printed(items, "item"), F.col("prints"), "p").select("p").distinct()
    shared = (exploded(seen.select("did", "th", "prints"), F.col("prints"), "p").join(item_prints, "p", "left_semi")
              .select("did", "th").distinct())
    suspects = (body.withColumn("th", F.xxhash64("body")).join(shared, ["did", "th"], "left_semi")
                .dropDuplicates(["did", "th"]).select("did", "th", words(F.col("body")).alias("w")))
    found = windows(suspects, [length, *short])
    inside = found.join(grams.select("a", "b", "len").distinct(), ["a", "b", "len"], "left_semi")
    spans = F.array_sort(F.collect_list(F.struct("start", (F.col("start") + F.col("len")).alias("end"))))
    nothing = F.struct(F.lit(0).alias("n"), F.lit(0).alias("reach"))
    covered = F.aggregate(spans, nothing, lambda acc, s: F.struct(
        (acc["n"] + F.greatest(s["end"] - F.greatest(s["start"], acc["reach"]), F.lit(0))).alias("n"),
        F.greatest(acc["reach"], s["end"]).alias("reach")), lambda acc: acc["n"].cast("long"))
    hits = inside.groupBy("did", "th").agg(covered.alias("n_hit"))
    named = (inside.select("did", "th", "a", "b", "len").distinct().join(grams, ["a", "b", "len"]).groupBy("did", "th")
             .agg(F.array_sort(F.collect_set("item")).alias("items")))
    none = F.array().cast("array<string>")
    return (seen.select("did", "th", "n_words").join(hits, ["did", "th"], "left").join(named, ["did", "th"], "left")
            .withColumn("n_hit", F.coalesce("n_hit", F.lit(0).cast("long"))).withColumn("items", F.coalesce("items", none))
            .select("did", "th", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                    F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256")))


def is_contaminated() -> Column:
    """Hit, and by at least a twentieth of the words."""
    return (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words"))


def report(docs: DataFrame, benchmark: DataFrame, length: int = 13, k: int = 6) -> DataFrame:
    """One row per document: its words, hit words, items, and whether it is contaminated."""
    return contamination(docs, benchmark, length, k).select(
        public_id().alias("doc_id"), "n_words", "n_hit", "n_items", "items_sha256", is_contaminated().alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, length: int = 13, k: int = 6) -> DataFrame:
    """``docs`` without contaminated documents; all columns stay."""
    bad = contamination(docs, benchmark, length, k).where(is_contaminated()).select(F.col("did").alias("__bad_did"), F.col("th").alias("__bad_th")).distinct()
    keyed = (docs.withColumn("__did", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)))
             .withColumn("__th", F.xxhash64(F.coalesce("text", F.lit("")))))
    return (keyed.join(bad, (F.col("__did") == F.col("__bad_did")) & (F.col("__th") == F.col("__bad_th")), "left_anti")
            .select(*(F.col(f"`{c}`") for c in docs.columns)))
