"""Spelling variants: words at one edit, found by a frequency-vector trie.

Words are maximal runs of letters of the texts, counted over the whole corpus; those of at least ``min_length`` code points and ``min_count``
occurrences enter the trie. Two words are near if one inserted, deleted or replaced code point turns one into the other.

* **Vectors.** The letters fall into ``GROUPS`` groups; a word's vector holds how many of its letters each group has. One edit raises at
  most one count by one (a surplus) and lowers at most one by one (a deficit). The trie arranges words by their counts, group after group.
* **Nodes.** Spark grows the trie from its root: a node with more than ``node_words`` words is split by the next count. Each word then lives in
  exactly one node, and visits every node whose counts its budget of one surplus, and one deficit after it, can reach. That is the top of the
  search, done as joins on the nodes' paths, for all words at once.
* **Search.** Inside a node the residents form the rest of the trie, and the visitors go through it depth first with what is left of their
  budgets; the words of the leaves they reach are verified by their letters. Visitors of one node come in sets of about four times ``node_words``.
* **Full leaves.** Words with the same vector (anagrams, or nearly) cannot be told apart by counts. A leaf with over ``node_words`` words is
  dealt by what words at one edit share: the word itself or the word less one letter. Such a part holds at most one word for each letter of the
  alphabet and place.

So no group grows with the corpus, and each pair of near words is met once, in the resident's node.
A word's form is its near word with the largest count (ties: the first in code-point order) if that is at least ``ratio`` times its own. A form's
count is ``ratio`` times as large at each step, so forms make no circles, and the root, the end of that chain, is found by doubling: each round
takes the root of the root, until none changes.

A null text has no words; a null ``doc_id`` is written as nothing where ids enter the rule below. Repeated rows count each. Very long texts and
runs need no care; a table without such words gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorebook.llm.common import stored
from scorebook.session import ship_package

RUN = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GROUPS = 12
#: Code points of a word that are compared as an array; the rest of a longer word letter by letter.
WIDTH = 24
#: Residents of a node below which the trie need not be followed further, and pairs that are verified at once.
LEAF, PAIRS = 6, 200_000


def slipped(doc_id: Column, word: Column, every: int) -> Column:
    """The word, or in about one of ``every`` places of the corpus the word less one letter: slips that the place itself decides."""
    h = F.crc32(F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("")), word).cast("binary"))
    at = (h % F.length(word)).cast("int")
    return F.when(h % every == 0, F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.length(word)))).otherwise(word)


def counted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 6, min_count: int = 5, every: int = 199) -> DataFrame:
    """``word, n`` of all words that enter the trie."""
    runs = docs.select(F.col(f"`{id_col}`").alias("doc"), F.explode(F.regexp_extract_all(F.col(f"`{text_col}`").cast("string"), F.lit(RUN), F.lit(0))).alias("run"))
    runs = runs.where(F.length("run") >= min_length).withColumn("run", F.translate("run", UPPER, LOWER))
    words = runs.select(slipped(F.col("doc"), F.col("run"), every).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return words.where((F.col("n") >= min_count) & (F.length("word") >= min_length))


def vector(word: str) -> bytes:
    counts = [0] * GROUPS
    for c in word:
        counts[ord(c) % GROUPS] += 1
    return bytes(min(v, 255) for v in counts)


def one_edit(a: str, b: str) -> bool:
    """Whether one inserted, deleted or replaced code point makes a into b."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i:] == b[i + 1:] if len(a) < len(b) else a[i + 1:] == b[i + 1:]


def letters(words: list[str]) -> np.ndarray:
    """The first and the last ``WIDTH`` code points of each word, from the left and from the right, filled up with zeros."""
    out = np.zeros((len(words), 2 * WIDTH), np.uint8)
    for i, w in enumerate(words):
        code = np.frombuffer(w[:WIDTH].encode("utf-16-le"), np.uint16)
        out[i, : len(code)] = code  # all letters lie below 256
        code = np.frombuffer(w[-WIDTH:].encode("utf-16-le"), np.uint16)
        out[i, WIDTH: WIDTH + len(code)] = code[::-1]
    return out


def verified(v: np.ndarray, m: np.ndarray, visitors: Words, residents: Words) -> np.ndarray:
    """Which of the pairs are at one edit, the resident longer or as long: what they share at both ends leaves at most one letter."""
    short, long_ = visitors.lengths[v], residents.lengths[m]
    ok = (long_ - short == 1) | (long_ == short)
    v, m, short, long_ = v[ok], m[ok], short[ok], long_[ok]
    same = visitors.letters[v] == residents.letters[m]
    head, tail = (np.where(part.all(1), WIDTH, part.argmin(1)) for part in (same[:, :WIDTH], same[:, WIDTH:]))
    head, tail = np.minimum(head, short), np.minimum(tail, short)
    near = head + tail >= short - (long_ == short)
    wide = short > WIDTH  # beyond the stored letters: letter by letter
    for i in np.flatnonzero(wide):
        near[i] = one_edit(visitors.words[v[i]], residents.words[m[i]])
    out = np.zeros(len(ok), bool)
    out[np.flatnonzero(ok)[near]] = True
    return out


class Words:
    """Words as arrays."""

    def __init__(self, words: list[str], vectors: list[bytes]):
        self.words, self.vectors = words, vectors
        self.counts = np.frombuffer(b"".join(vectors), np.uint8).reshape(len(words), GROUPS).astype(np.int16)
        self.lengths = np.fromiter(map(len, words), np.int64, len(words))
        self.letters = letters(words)


def search(residents: Words, visitors: Words, depth: int) -> Iterator[tuple[int, int]]:
    """Numbers of visitor and resident for each near pair, once, where all residents share a node ``depth`` counts below the root.

    All visitors go depth first through the trie together. ``whole`` have spent nothing so far, ``up`` a surplus, ``done`` also a deficit. A deficit
    is spent after the surplus only: of two words the one whose vector comes first, or the shorter one, finds the other.
    """
    order = np.lexsort(residents.counts.T[::-1])
    counts, path = residents.counts[order], residents.counts[order[0], :depth]
    gap = path - visitors.counts[:, :depth]
    plus, minus = np.maximum(gap, 0).sum(1), np.maximum(-gap, 0).sum(1)
    stack = [(0, len(order), depth, np.flatnonzero((plus == 0) & (minus == 0)), np.flatnonzero((plus == 1) & (minus == 0)),
              np.flatnonzero((plus == 1) & (minus == 1)))]
    waiting: list[tuple[np.ndarray, np.ndarray]] = []
    held = 0

    def settle() -> Iterator[tuple[int, int]]:
        v, m = np.concatenate([p[0] for p in waiting]), np.concatenate([p[1] for p in waiting])
        good = verified(v, m, visitors, residents)
        for i, j in zip(v[good].tolist(), m[good].tolist()):
            a, b = visitors.words[i], residents.words[j]
            if a != b and (len(a) < len(b) or (visitors.vectors[i], a) < (residents.vectors[j], b)):
                yield i, j

    while stack:
        low, high, level, whole, up, done = stack.pop()
        if not len(whole) + len(up) + len(done):
            continue
        if level == GROUPS or high - low <= LEAF:
            some, here = np.concatenate([whole, up, done]), order[low:high]
            step = max(1, PAIRS // len(here))
            for a in range(0, len(some), step):
                part = some[a: a + step]
                waiting.append((np.repeat(part, len(here)), np.tile(here, len(part))))
                held += len(part) * len(here)
                if held >= PAIRS:
                    yield from settle()
                    waiting, held = [], 0
            continue
        column = counts[low:high, level]
        cuts = np.flatnonzero(np.diff(column)) + 1
        of = [visitors.counts[s, level] for s in (whole, up, done)]
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), high - low]):
            k = column[a]
            stack.append((low + a, low + b, level + 1, whole[of[0] == k], np.concatenate([up[of[1] == k], whole[of[0] == k - 1]]),
                          np.concatenate([done[of[2] == k], up[of[1] == k + 1]])))
    if waiting:
        yield from settle()


def nodes(words: DataFrame, node_words: int) -> DataFrame:
    """``path, full``: the nodes of the trie in which words live, as the counts that lead there; ``full`` leaves are dealt further."""
    found, open_words = None, words.select("vec")
    for depth in range(GROUPS + 1):
        level = open_words.groupBy(F.substring("vec", 1, depth).alias("path")).agg(F.count("*").alias("members"))
        level = stored(level, "trie-level")
        small = F.col("members") <= node_words
        here = level.where(small | F.lit(depth == GROUPS)).select("path", (~small).alias("full"))
        found = here if found is None else found.union(here)
        crowded = level.where(~small)
        if depth == GROUPS or crowded.isEmpty():
            return stored(found, "trie-nodes")
        open_words = open_words.join(crowded.select("path"), F.substring("vec", 1, depth) == F.col("path"), "left_semi")


def reachable(vec: bytes, depths: list[int]) -> list[bytes]:
    """All paths of these depths that a word finds: its own, with one surplus, and with one deficit after that."""
    out = []
    for depth in depths:
        path = vec[:depth]
        out.append(path)
        for i in (i for i in range(depth) if path[i] < 255):
            more = path[:i] + bytes([path[i] + 1])
            out.append(more + path[i + 1:])
            out += [more + path[i + 1: j] + bytes([path[j] - 1]) + path[j + 1:] for j in range(i + 1, depth) if path[j] > 0]
    return out


def shared_parts(word: str) -> list[str]:
    """What words at one edit have in common: the word, and the word less one letter."""
    return sorted({word, *(word[:i] + word[i + 1:] for i in range(len(word)))})


def near_words(words: DataFrame, node_words: int = 20_000) -> DataFrame:
    """``word, near_word``: each ordered pair at one edit, once."""
    ship_package(words.sparkSession)

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(vec=[vector(w) for w in batch.word])

    words = stored(words.select("word").mapInPandas(vectors, "word string, vec binary"), "trie-words")
    tree = nodes(words, node_words)
    depths = sorted(r["d"] for r in tree.select(F.length("path").alias("d")).distinct().collect())  # at most one per group of letters

    def visits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for a in range(0, len(batch), 1000):
                part = batch.iloc[a: a + 1000]
                rows = [(w, v, p, v.startswith(p)) for w, v in zip(part.word, map(bytes, part.vec)) for p in reachable(v, depths)]
                yield pd.DataFrame(rows, columns=["word", "vec", "path", "home"])

    met = words.mapInPandas(visits, "word string, vec binary, path binary, home boolean").join(tree, "path")
    parts = F.when(F.col("full"), F.udf(shared_parts, "array<string>")("word")).otherwise(F.array(F.lit("")))
    met = stored(met.select("path", "full", "word", "vec", "home", F.explode(parts).alias("part")), "trie-visits")
    # A small node beside a crowded part of the trie has many visitors: they come in sets, and its residents to each of these.
    sets = met.groupBy("path", "part").agg(F.ceil(F.count("*") / F.lit(4 * node_words)).cast("int").alias("sets"))
    own = F.pmod(F.xxhash64("word"), F.col("sets")).cast("int")
    met = (met.join(sets, ["path", "part"]).withColumn("own", own)
           .withColumn("set", F.explode(F.when(F.col("home"), F.sequence(F.lit(0), F.col("sets") - 1)).otherwise(F.array("own")))))

    def pairs(group: pd.DataFrame) -> pd.DataFrame:
        home, visits = group[group.home], group[group.own == group.set]
        if not len(home) or not len(visits):
            return pd.DataFrame({"word": [], "near_word": []}, dtype=object)
        residents, visitors = (Words(list(g.word), list(map(bytes, g.vec))) for g in (home, visits))
        rows = [(visitors.words[v], residents.words[m]) for v, m in search(residents, visitors, len(group.path.iloc[0]))]
        if group.full.iloc[0]:  # two words may share several parts: the first of them counts
            part = group.part.iloc[0]
            rows = [(a, b) for a, b in rows if part == min(set(shared_parts(a)) & set(shared_parts(b)))]
        return pd.DataFrame(rows + [(b, a) for a, b in rows], columns=["word", "near_word"], dtype=object)

    # Spark would leave the sets of a node together, as the join before deals by node.
    return met.repartition("path", "part", "set").groupBy("path", "part", "set").applyInPandas(pairs, "word string, near_word string")


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of every word with a form."""
    links = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        after = stored(links.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        if after.where("moved").isEmpty():
            return after.drop("moved")
        links = after.drop("moved")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 6, min_count: int = 5, ratio: int = 5,
             every: int = 199, node_words: int = 20_000) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word that enters the trie."""
    words = stored(counted(docs, id_col, text_col, min_length, min_count, every), "spelling-words")
    pairs = near_words(words, node_words)
    with_n = pairs.join(words.select(F.col("word").alias("near_word"), F.col("n").alias("near_n")), "near_word")
    best = with_n.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct(-F.col("near_n"), F.col("near_word"))).alias("best"))
    best = best.select("word", "n_near", (-F.col("best.col1")).alias("best_n"), F.col("best.near_word").alias("best"))
    chosen = F.col("best_n") >= ratio * F.col("n")
    rows = stored(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(chosen, F.col("best")).alias("form"),
        F.when(chosen, F.col("best_n")).alias("form_n")), "spelling-forms")
    ends = roots(rows.where("form IS NOT NULL"))
    return rows.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
