"""Spelling variants against all pairs."""

import random
import re
import zlib
from collections import Counter

import pytest

from scorebook.llm import spelling

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_near(words):
    """Near words by listing every string at one edit, letters taken from the words themselves."""
    letters, known = sorted({c for w in words for c in w}), set(words)
    out = {}
    for w in words:
        cuts = [(w[:i], w[i:]) for i in range(len(w) + 1)]
        edits = {a + b[1:] for a, b in cuts if b} | {a + c + b for a, b in cuts for c in letters} | {a + c + b[1:] for a, b in cuts if b for c in letters}
        out[w] = (edits & known) - {w}
    return out


def brute(rows, ratio=5):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 199 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1:]
            n[w] += 1
    n = {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}
    near, form = brute_near(n), {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= ratio * n[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])
    return sorted((w, form[w], root(w), c, len(near[w]), n[form[w]] if form[w] else None) for w, c in n.items())


@pytest.fixture(scope="module")
def typed():
    """Common words, their slips, and words that differ from these by one letter more or less."""
    r, rows = random.Random(4), []
    base = ["colour", "Colour", "analyse", "naïveté", "STRASSE", "øresund", "grammar", "banana", "ananas", "ß×÷ßab", "kettle" * 30]
    for i in range(400):
        words = []
        for w in r.choices(base, k=40):
            for _ in range(r.choice([0] * 9 + [1, 1, 2])):
                k = r.randrange(len(w))
                w = r.choice([w[:k] + w[k + 1:], w[:k] + "ae"[k % 2] + w[k:], w[:k] + "xé"[k % 2] + w[k + 1:]])
            words.append(w)
        rows.append((i % 390, r.choice([" ", "\n", "1", "_"]).join(words)))
    return rows + [(None, "colour " * 50), (None, None), (3, ""), (5, "anagram nagaram margana " * 6), (6, "x" * 100_000), (7, ("ab" * 5000 + " ") * 6)]


@pytest.mark.parametrize("node_words", [20_000, 20])
def test_variants(spark, frame, typed, node_words):
    got = sorted(tuple(r) for r in spelling.variants(frame(typed), node_words=node_words).select("word", "form", "root", "n", "n_near", "form_n").collect())
    assert got == brute(typed)
    assert any(w != root and form != root for w, form, root, *_ in got) and max(r[4] for r in got) > 3


def test_full_leaves(spark):
    """Very many words of one vector."""
    r = random.Random(5)
    words = sorted({"".join(r.sample("aamyzámm", 8)) for _ in range(250)} | {"".join(r.choices("amy", k=r.randint(6, 7))) for _ in range(150)})
    df = spark.createDataFrame([(w, 5) for w in words], "word string, n long")
    want = sorted((w, x) for w, near in brute_near(words).items() for x in near)
    assert sorted(tuple(x) for x in spelling.near_words(df, 3).collect()) == want and len(want) > 100


def test_search_agrees_with_all_pairs():
    r = random.Random(6)
    words = sorted({"".join(r.choices("abcdefé", k=r.randint(3, 6))) for _ in range(800)} | {"ab" * 11 + "".join(r.choices("abc", k=r.randint(1, 6))) for _ in range(200)})
    rows = spelling.Words(words, [spelling.vector(w) for w in words])
    got = sorted((words[v], words[m]) for v, m in spelling.search(rows, rows, 0))
    assert len(got) == len(set(got)) and sorted(got + [(b, a) for a, b in got]) == sorted((w, x) for w, near in brute_near(words).items() for x in near)
    assert all(spelling.one_edit(a, b) == (b in brute_near([a, b])[a]) for a in words[:60] for b in words[:60])


def test_chains_of_forms(spark):
    links = [(f"w{i}", f"w{i + 1}") for i in range(37)] + [("x", "w5"), ("y", "z")]
    got = {r.word: r.root for r in spelling.roots(spark.createDataFrame(links, "word string, form string")).collect()}
    assert got == {**{a: "w37" for a, _ in links}, "y": "z"}


def test_no_words(spark, frame):
    assert spelling.variants(frame([])).count() == 0
    assert spelling.variants(frame([(1, None), (2, "short run of words"), (None, "lonely")])).count() == 0
