"""The schedule that mixes sources to target weights."""

import re
from collections import Counter, defaultdict
from math import floor, gcd

import pytest
from pyspark.sql import functions as F

from scorebook.llm import source_mix

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def level_targets(sizes, weights, share=1.5, most=2):
    """Hold what is above its stop, share the rest by weight, until none is above."""
    held, left = {}, dict(sizes)
    while True:
        rest = share * sum(sizes.values()) - sum(held.values())
        level = {s: rest * weights[s] / sum(weights[x] for x in left) for s in left} if left else {}
        above = [s for s in left if level[s] > most * left[s]]
        if not above:
            return {**held, **level}
        for s in above:
            held[s] = most * left.pop(s)


def brute(rows):
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    return sizes, level_targets(sizes, {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)})


@pytest.fixture(scope="module")
def mixed(spark, corpus):
    rows = [(i, t, ["web", "books", "Zine", None, "é", "tiny"][k % 5 if k % 11 else 5]) for k, (i, t) in enumerate(corpus)]
    rows += [(7, "same text over and over", "hot")] * 300 + [(None, None, "hot")] * 40 + [(1000 + i, "a b c d", "hot") for i in range(200)]
    docs = spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], "doc_id long, text string, source string, src int, size int, slot int, th int")
    return rows, source_mix.Mix(docs.repartition(5), block_words=16)


def test_targets_and_words_taken(mixed):
    rows, mix = mixed
    sizes, want = brute(rows)
    got = mix.report().collect()
    assert Counter((r.doc_id, r["size"]) for r in got) == Counter((i, len(WORD.findall(t or ""))) for i, t, _ in rows)
    by = defaultdict(int)
    for r in mix.sources.collect():
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6
        by[r.source] = r.quota
    assert all(0 <= r.taken <= 2 * r["size"] for r in got)
    assert sum(r.taken for r in got) == sum(by.values()) == sum(floor(t + 1e-9) for t in want.values())
    # Laps: every document at least the whole laps, at most one more.
    laps = {(r.source_size, r.target): int(r.target // r.source_size) if r.source_size else 0 for r in got}
    assert all(laps[r.source_size, r.target] * r["size"] <= r.taken for r in got)


def test_schedule_spreads_every_source(mixed):
    _, mix = mixed
    slots, n = mix.slots.orderBy("slot").collect(), mix.slots.count()
    assert [r.slot for r in slots] == list(range(n))
    share = {r.src: r.slots / n for r in mix.sources.collect()}
    seen = Counter()
    for i, r in enumerate(slots, 1):
        seen[r.src] += 1
        assert all(abs(seen[s] - i * p) <= 5 for s, p in share.items())
    order = defaultdict(list)
    for r in slots:
        order[r.src].append((r.lap, r.block))
    assert all(o == sorted(o) and len(o) == len(set(o)) for o in order.values())


def test_plan_is_the_texts(mixed):
    rows, mix = mixed
    texts = {i: WORD.findall(t) for i, t, _ in rows if t and i not in (None, 14)}
    at = defaultdict(list)
    for r in mix.plan().collect():
        at[r.slot].append((r.offset, r.words))
    for r in mix.texts().collect():
        if r.doc_id in texts:
            assert r.text in " ".join(texts[r.doc_id])
    for room in mix.slots.collect():
        end = 0
        for offset, words in sorted(at[room.slot]):
            assert offset == end
            end += words
        assert end == room.words
    total = mix.texts().agg(F.sum(F.size(F.split("text", " ")))).first()[0]
    assert total == sum(r.words for r in mix.slots.collect())


def test_reruns_agree_over_other_partitions(spark, mixed, rows):
    given, mix = mixed
    docs = spark.createDataFrame([r[:3] for r in reversed(given)], "doc_id long, text string, source string").repartition(3)
    again = source_mix.Mix(docs, block_words=16)
    assert rows(again.report()) == rows(mix.report()) and rows(again.slots) == rows(mix.slots)


def test_nothing_to_mix(spark):
    schema = "doc_id long, text string, source string"
    assert source_mix.Mix(spark.createDataFrame([], schema)).report().count() == 0
    only = source_mix.Mix(spark.createDataFrame([(1, None, "a"), (None, " \t", None)], schema))
    assert [(r.taken, r.target) for r in only.report().collect()] == [(0, 0.0)] * 2 and only.texts().count() == 0


def test_golden_points_meet_every_slot_once(spark):
    for n in (1, 2, 3, 10, 144, 1000, 4097):
        g = source_mix.golden(n)
        assert gcd(g, n) == 1
        assert sorted(i * g % n for i in range(n)) == list(range(n))
    n = 2**40 - 87
    g = source_mix.golden(n)
    ids = [0, 1, 12345, 2**20, 2**33 + 7, n - 1]
    got = [r.p for r in spark.createDataFrame([(i,) for i in ids], "id long").select(source_mix.times(F.col("id"), g, n).alias("p")).collect()]
    assert got == [i * g % n for i in ids]
