"""Mixing sources to target weights by a low-discrepancy schedule.

Sources are put in order of their names (by code point, null last) and weigh ``weights``, repeating. They share ``share`` of all words by weight;
a target stops at ``most`` times its source's size, and the excess goes to the sources below their stop, by weight, until none is above.

* Each source's documents are shuffled by a keyed hash and laid end to end; every ``block_words`` words of that stream are a block. A source
  takes its blocks in order, again from the first one after the last, until its target is met: its last slot ends at the exact word.
  So the words a source gives are its target, rounded down, and no document is taken more than ``most`` times (rounded up).
* The mix has one slot for each of these blocks. Slot ``i`` stands at the golden-ratio point ``i * g mod n``: ``g`` is the number nearest to
  ``n`` divided by the golden ratio that has no divisor in common with ``n``, so each of the ``n`` points is met once, and any stretch of the mix
  has each source close to its share. The point's place among the cumulative numbers of slots names the source; the
  slot's rank among the source's slots names the block.

Streams and ranks are running sums: a source's rows are cut into chunks by the hash, or slots by their number, windows run inside a chunk, and
only one row per chunk is ordered for a whole source. So a source may hold any part of the rows.

A null text has no words; documents without words are reported and take no part. A null ``doc_id`` is an id like others. Rows equal in source,
id and text are copies that follow each other in the stream. A table without words, or without rows, gives an empty mix. Other columns are not read.
All choices follow from the rows themselves, so reruns, also over other partitions, agree.
"""

from __future__ import annotations

from math import gcd

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorebook.functions.ordered import number_rows
from scorebook.llm.common import stored

WORD = r"[^\x20\x09-\x0D]+"
#: Rows of a chunk, about.
CHUNK_ROWS = 2_000
#: Copies that one row of the first expansion stands for.
COPY_STEP = 10_000


def sum_before(df: DataFrame, value: Column, keys: list[str], chunk: Column, order: list[Column], out: str) -> DataFrame:
    """The sum of ``value`` over the rows before each row, per ``keys`` in ``order``; ``chunk`` rises with the order. No key is null."""
    rows = df.withColumn("_chunk", chunk).withColumn("_value", value)
    earlier = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*keys, "_chunk").agg(F.sum("_value").alias("_sum"))
    sums = sums.select(*keys, "_chunk", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_inside", F.coalesce(F.sum("_value").over(inside), F.lit(0)))
    return rows.join(sums, [*keys, "_chunk"]).withColumn(out, F.col("_before") + F.col("_inside")).drop("_chunk", "_value", "_before", "_inside")


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``source, doc_id, size, copies, key`` of every different row; ``key`` orders the shuffle."""
    text = F.col(f"`{text_col}`").cast("string")
    rows = docs.select(F.col(f"`{source_col}`").cast("string").alias("source"), F.col(f"`{id_col}`").cast("long").alias("doc_id"),
                       F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
                       F.md5(F.coalesce(text, F.lit("")).cast("binary")).alias("th"))
    key = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("th")).cast("binary"))
    return rows.groupBy("source", "doc_id", "size", "th").agg(F.count("*").alias("copies")).withColumn("key", key)


def fill(sources: DataFrame, share: tuple[int, int], most: int) -> tuple[int, int]:
    """The level, a fraction: a source's target is its weight times it, or ``most`` times its size if that is less.

    Each round holds the sources above their stop at it and raises the level for the others. The level is Newton's for a concave
    piecewise linear function of whole numbers, so rounds are few however many sources there are.
    """
    total, weight = (sources.agg(F.sum("source_size").alias("s"), F.sum("weight").alias("w")).first() or (0, 0))
    if not total:
        return 0, 1
    up, down = share[0] * total, share[1] * weight
    while True:
        above = F.lit(most).cast("decimal(3,0)") * F.col("source_size").cast("decimal(17,0)") * F.lit(down).cast("decimal(17,0)") \
            < F.col("weight").cast("decimal(5,0)") * F.lit(up).cast("decimal(30,0)")
        held = sources.where(above).agg(F.sum("source_size").alias("s"), F.sum("weight").alias("w")).first()
        size, part = held["s"] or 0, held["w"] or 0
        if part == weight:
            return up, down
        level = share[0] * total - share[1] * most * size, share[1] * (weight - part)
        if level == (up, down):
            return level
        up, down = level


def targets(rows: DataFrame, weights: tuple[int, ...], share: tuple[int, int], most: int, block_words: int) -> DataFrame:
    """One row per source: number, name, weight, size, documents, target, words to take, blocks and slots."""
    sums = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"), F.count("*").alias("n_rows"))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("src") % len(weights) + 1).cast("int"))
    numbered = number_rows(sums, [F.col("source").asc_nulls_last()], out="src").withColumn("src", F.col("src") - 1)
    sources = stored(numbered.withColumn("weight", weight), "mix-sources")
    up, down = fill(sources, share, most)
    stop, level = most * F.col("source_size"), F.col("weight").cast("double") * F.lit(up).cast("double") / F.lit(down).cast("double")
    size, quota = F.col("source_size"), F.col("quota")
    laps, rest = F.floor(quota / F.greatest(size, F.lit(1))), quota % F.greatest(size, F.lit(1))
    blocks = F.ceil(size / F.lit(block_words))
    return stored(sources.withColumn("target", F.least(stop.cast("double"), level)).withColumn("quota", F.floor("target").cast("long"))
                  .withColumn("blocks", blocks).withColumn("slots", laps * blocks + F.ceil(rest / F.lit(block_words))), "mix-targets")


def streams(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """``start``: where in its source's shuffled stream each row's copies begin."""
    info = sources.select(F.col("source").alias("s"), "src", "n_rows")
    high = F.conv(F.substring("key", 1, 8), 16, 10).cast("long")
    chunk = F.floor(high * F.ceil(F.col("n_rows") / F.lit(CHUNK_ROWS)) / F.lit(2.0**32))
    placed = rows.join(info, rows["source"].eqNullSafe(F.col("s"))).withColumn("chunk", chunk).drop("s", "n_rows")
    order = [F.col("key"), F.col("doc_id").asc_nulls_first(), F.col("size"), F.col("th")]
    return sum_before(placed, F.col("size") * F.col("copies"), ["src"], F.col("chunk"), order, "start").drop("chunk")


def each_copy(placed: DataFrame) -> DataFrame:
    """Every row as often as the table holds it, with the number of the ``copy``."""
    last = F.col("copies") - 1
    return (placed.withColumn("_from", F.explode(F.sequence(F.lit(0).cast("long"), last, F.lit(COPY_STEP).cast("long"))))
            .withColumn("copy", F.explode(F.sequence("_from", F.least(last, F.col("_from") + COPY_STEP - 1)))).drop("_from"))


def pieces(placed: DataFrame, block_words: int) -> DataFrame:
    """One row for each part of a document that lies in one block: its ``first`` word and ``words``, and ``at``, its place in the block."""
    copies = each_copy(placed.where("size > 0")).withColumn("begin", F.col("start") + F.col("copy") * F.col("size"))
    copies = copies.withColumn("end", F.col("begin") + F.col("size"))
    cut = copies.withColumn("block", F.explode(F.sequence(F.floor(F.col("begin") / block_words), F.floor((F.col("end") - 1) / block_words))))
    low = F.greatest(F.col("begin"), F.col("block") * block_words)
    high = F.least(F.col("end"), (F.col("block") + 1) * block_words)
    return cut.select("src", "block", "doc_id", "th", "size", "copy", (low - F.col("begin")).alias("first"), (high - low).alias("words"),
                      (low - F.col("block") * block_words).alias("at"))


def golden(n: int) -> int:
    """The number nearest to n divided by the golden ratio without a divisor in common with n."""
    near = round(n * 0.6180339887498949)
    return next(g for d in range(n + 1) for g in (near - d, near + d) if 0 < g <= max(1, n) and gcd(g, n) == 1)


def times(i: Column, g: int, n: int) -> Column:
    """``i * g mod n`` for n below 2 ** 40, in 64 bits."""
    high, low = F.shiftright(i, 20), i.bitwiseAND(F.lit(2**20 - 1))
    return ((high * F.lit(g) % F.lit(n)) * F.lit(2**20) + low * F.lit(g)) % F.lit(n)


def schedule(sources: DataFrame, block_words: int, cells: int = 4096) -> DataFrame:
    """The mix: ``slot, src, lap, block, words``, the source and block that each slot takes, how often the source began anew, and its words."""
    spark = sources.sparkSession
    used = sources.where("slots > 0")
    lanes = stored(sum_before(used, F.col("slots"), [], F.floor(F.col("src") / CHUNK_ROWS), [F.col("src")], "low"), "mix-lanes")
    n, n_lanes = lanes.agg(F.coalesce(F.sum("slots"), F.lit(0)), F.count("*")).first()
    if n >= 2**40:
        raise ValueError("more than 2 ** 40 slots: take larger blocks")
    cells = max(cells, n_lanes)
    width = max(1, -(-n // cells))
    # A point meets the sources of its cell only; a source is in every cell that its slots touch.
    spans = lanes.withColumn("cell", F.explode(F.sequence(F.floor(F.col("low") / width), F.floor((F.col("low") + F.col("slots") - 1) / width))))
    point = F.lit(0).cast("long") if n < 2 else times(F.col("id"), golden(n), n)
    points = spark.range(n).select(F.col("id").alias("slot"), point.alias("point")).withColumn("cell", F.floor(F.col("point") / width))
    dealt = points.join(spans, "cell").where("point >= low AND point < low + slots")
    ranked = sum_before(dealt, F.lit(1).cast("long"), ["src"], F.floor(F.col("slot") / CHUNK_ROWS), [F.col("slot")], "rank")
    lap, block = F.floor(F.col("rank") / F.col("blocks")), F.col("rank") % F.col("blocks")
    taken = F.col("lap") * F.col("source_size") + F.col("block") * block_words
    length = F.least(F.lit(block_words), F.col("source_size") - F.col("block") * block_words, F.col("quota") - taken)
    return (ranked.withColumn("lap", lap).withColumn("block", block)
            .select("slot", "src", "lap", "block", length.cast("long").alias("words")))


class Mix:
    """Targets, streams and schedule of one table, each stored once."""

    def __init__(self, docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: tuple[int, int] = (3, 2), most: int = 2,
                 block_words: int = 512, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"):
        rows = stored(sized(docs, id_col, text_col, source_col), "mix-rows")
        self.docs, self.id_col, self.text_col = docs, id_col, text_col
        self.sources = targets(rows, weights, share, most, block_words)
        self.placed = stored(streams(rows, self.sources), "mix-streams")
        self.slots = stored(schedule(self.sources, block_words), "mix-slots")
        self.parts = pieces(self.placed, block_words)

    def met(self, how: str) -> DataFrame:
        """Parts of documents with the slots that take their block; ``took`` is null or 0 where the slot ends before the part."""
        slots = self.slots.withColumnRenamed("words", "room")
        return self.parts.join(slots, ["src", "block"], how).withColumn("took", F.greatest(F.lit(0), F.least(F.col("words"), F.col("room") - F.col("at"))))

    def plan(self) -> DataFrame:
        """What stands where in the mix; ``first`` counts the document's words from 0, ``lap`` the turns of its source."""
        return self.met("inner").where("took > 0").select(
            "slot", F.col("at").alias("offset"), "src", "doc_id", "th", "size", "copy", "first", F.col("took").alias("words"), "lap")

    def texts(self) -> DataFrame:
        """``slot, offset, doc_id, text``: the mix itself; reading it by slot and offset gives the mixed corpus."""
        text = F.coalesce(F.col(f"`{self.text_col}`").cast("string"), F.lit(""))
        bodies = (self.docs.select(F.col(f"`{self.id_col}`").cast("long").alias("i"), F.md5(text.cast("binary")).alias("h"), text.alias("body"))
                  .dropDuplicates(["i", "h"]))
        words = F.slice(F.regexp_extract_all("body", F.lit(WORD), F.lit(0)), F.col("first").cast("int") + 1, F.col("words").cast("int"))
        joined = self.plan().join(bodies, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("th") == F.col("h")))
        return joined.select("slot", "offset", "doc_id", F.array_join(words, " ").alias("text"))

    def report(self) -> DataFrame:
        """``doc_id, size, source_size, target, taken`` of every row of the table."""
        took = F.coalesce(F.sum(F.when(F.col("room").isNotNull(), F.col("took"))), F.lit(0)).cast("long")
        some = self.met("left").groupBy("src", "doc_id", "th", "size", "copy").agg(took.alias("taken")).select("src", "doc_id", "size", "taken")
        none = each_copy(self.placed.where("size = 0")).select("src", "doc_id", "size", F.lit(0).cast("long").alias("taken"))
        return some.union(none).join(self.sources.select("src", "source_size", "target"), "src").select(
            "doc_id", "size", "source_size", "target", "taken")
