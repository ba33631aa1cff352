"""Suffix-array and substring dedup against definitions applied to every window."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest

from scorebook.llm import substring_dedup, suffix_dedup


def order(rows):
    """Documents in the operators' order: null ids first; rows that repeat id and text are one."""
    return sorted({(float("-inf") if i is None else i, i, t or "") for i, t in rows}, key=lambda r: r[0])


def brute_bytes(rows, length):
    """Ids that repeat with different texts are ordered by a hash; the fixture gives them nothing in common."""
    seen, out = set(), {}
    for _, i, text in order(rows):
        data = text.encode()
        gone = np.zeros(len(data), bool)
        for j in range(len(data) - length + 1):
            if data[j: j + length] in seen:
                gone[j: j + length] = True
            seen.add(data[j: j + length])
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out[i, hashlib.sha256(data).hexdigest()] = (len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return Counter((i, *out[i, hashlib.sha256((t or "").encode()).hexdigest()]) for i, t in rows)


def brute_words(rows, length):
    first = {}
    cut = re.compile(r"[^\x20\x09-\x0D]+")
    for rank, _, text in order(rows):
        w = cut.findall(text)
        for j in range(len(w) - length + 1):
            first.setdefault(tuple(w[j: j + length]), rank)
    out = Counter()
    for i, text in rows:
        w = cut.findall(text or "")
        gone = [False] * len(w)
        for j in range(len(w) - length + 1):
            if first[tuple(w[j: j + length])] < (float("-inf") if i is None else i):
                gone[j: j + length] = [True] * length
        kept = " ".join(a for a, g in zip(w, gone) if not g)
        out[i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()] += 1
    return out


@pytest.mark.parametrize("options", [{}, {"hot": 0}, {"hot": 3, "block_bytes": 20_000, "bucket_bytes": 5_000}])
def test_suffix_dedup(frame, corpus, options):
    got = suffix_dedup.dedup(frame(corpus), 100, **options).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute_bytes(corpus, 100)
    assert all(hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256 for r in got)


def test_suffix_dedup_short_strings(frame):
    rows = [(1, "abcabcabcabc"), (2, "xxabcabcyy"), (3, "aaaaaaaaaaaaaaaa"), (4, "b" * 7)]
    got = suffix_dedup.dedup(frame(rows), 6).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute_bytes(rows, 6)


def test_interval_expansion_finds_all_short_prefixes():
    r = np.random.default_rng(1)
    text = np.concatenate([r.integers(97, 100, 3000), r.integers(97, 99, 300), [97] * 200, [suffix_dedup.SEPARATOR]]).astype(np.uint8)
    raw = text.tobytes()
    for depth in (1, 5, 12, 60):
        suffixes, boundary = suffix_dedup.repeats(text, depth)
        prefix = [raw[s: s + depth] for s in suffixes.tolist()]
        assert sorted(suffixes.tolist()) == list(range(len(text)))
        whole = [len(p) == depth and suffix_dedup.SEPARATOR not in p for p in prefix]
        for j in range(1, len(prefix)):
            if whole[j] and whole[j - 1]:
                assert bool(boundary[j]) == (prefix[j] != prefix[j - 1])


@pytest.mark.parametrize("options", [{}, {"block_bytes": 20_000}])
def test_substring_dedup(frame, corpus, options):
    got = substring_dedup.dedup(frame(corpus), 50, **options).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == brute_words(corpus, 50)
    assert all(hashlib.sha256(r.kept.encode()).hexdigest() == r.kept_sha256 for r in got)


@pytest.mark.parametrize("length", [10, 13, 25])
def test_substring_dedup_other_lengths(frame, corpus, length):
    rows = [r for r in corpus if r[0] != 13]
    got = substring_dedup.dedup(frame(rows), length).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == brute_words(rows, length)


def test_covers_are_difference_covers():
    for period, cover in substring_dedup.COVERS.items():
        assert {(a - b) % period for a in cover for b in cover} == set(range(period))


def test_empty_tables(frame):
    assert suffix_dedup.dedup(frame([]), 100).count() == 0
    assert substring_dedup.dedup(frame([]), 50).count() == 0
