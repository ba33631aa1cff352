"""Substring dedup with difference-cover anchors.

A word of a document goes if it lies in a window of ``length`` words whose sequence also starts in a document with a smaller id.
Anchors of ``length - period + 1`` words are hashed only where the word's number in its document, modulo ``period``, lies in a difference
cover: any two places have a common shift, smaller than the period, that takes both to covered places. So two equal windows, wherever
they stand, contain a common anchor. The steps, between blocks of documents and buckets of hashes:

1. Blocks send the hashes of their anchors; buckets answer which occur in more than one document.
2. Each such anchor is extended to all windows that contain it: blocks send these windows' hashes (128 bits) with their smallest and
   greatest document; buckets answer with the smallest document of all.
3. Blocks remove the words of the windows that a smaller document has, and hash what is kept.

Everything is judged on the input. Null and empty texts have no words. Rows that repeat an id are documents of their own; equal ids
are not smaller than each other, so such rows do not remove from each other. A null id counts as the smallest. An empty table gives
no rows; other columns are not read. A passage that a third of all documents share is sent once per block and step.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from scorebook.llm.blocks import Block, answer, blocked, dealt, finish, found_in, gathered, runs, send, send_with
from scorebook.llm.wordarrays import Words, chunks, mix, window_hashes

# Perfect difference sets, by their period.
COVERS = {7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (3, 6, 7, 12, 14), 31: (1, 5, 11, 24, 25, 27)}

ANCHOR = np.dtype("<u8")
WINDOW = np.dtype([("a", "<u8"), ("b", "<u8"), ("low", "<i8"), ("high", "<i8")])
FIRST = np.dtype([("key", "<u8"), ("low", "<i8")])


def covered_period(length: int) -> int:
    """The longest period whose anchors still are a third of a window."""
    return max([p for p in COVERS if length - p + 1 >= max(1, length // 3)], default=0)


class Layout:
    """Where a chunk's windows and anchors begin, as numbers of words."""

    def __init__(self, words: Words, length: int, period: int):
        size = np.diff(words.doc)
        self.windows = np.maximum(size - length + 1, 0)
        place, owner = words.place(), words.owner()
        self.owner = owner
        self.last = words.doc[:-1] + self.windows  # behind the last window of each document
        span = length - period + 1
        in_cover = np.zeros(period, bool)
        in_cover[list(COVERS[period])] = True
        self.anchors = np.flatnonzero(in_cover[place % period] & (place + span <= size[owner]) & (size[owner] >= length)) if len(place) else place
        self.is_window = place < self.windows[owner] if len(place) else np.zeros(0, bool)
        self.span = span


def _keys(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a) + b


def dedup(docs: DataFrame, length: int = 50, block_bytes: int = 8 << 20) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256, kept`` per row; ``kept`` is the text that stays, words joined by one space."""
    period = covered_period(length)
    if not period:
        raise ValueError("windows must have at least 10 words")
    x, size = blocked(docs, block_bytes)
    n_buckets = max(1, -(-size // block_bytes))
    bucket = lambda h: (h >> np.uint64(40)).astype(np.int64) % n_buckets
    low_bit = np.uint64(1)

    def anchors(block: Block) -> Iterator[tuple[int, bytes]]:
        """Distinct anchors; the lowest bit tells whether more than one id of the block has it."""
        hashes, ids = [], []
        for chunk in chunks(block.texts):
            words = chunk.words()
            layout = Layout(words, length, period)
            hashes.append(window_hashes(words.hashes(), layout.anchors, layout.span))
            ids.append(block.ids[chunk.first: chunk.first + chunk.n][layout.owner[layout.anchors]])
        h, d = np.concatenate(hashes) | low_bit, np.concatenate(ids)
        order = np.lexsort((d, h))
        h, d = h[order], d[order]
        first, _ = runs(h)
        if len(first):
            several = d[first] != d[np.append(first[1:], len(d)) - 1]
            out = np.where(several, h[first], h[first] ^ low_bit)
            yield from dealt(bucket(out), out.astype(ANCHOR))

    def shared(_: int, blocks: list[int], parts: list[bytes]) -> Iterator[tuple[int, bytes]]:
        h, part = gathered(parts, ANCHOR)
        key = h | low_bit
        order = np.argsort(key, kind="stable")
        first, run = runs(key[order])
        several = np.diff(np.append(first, len(order))) > 1
        several |= np.maximum.reduceat((h[order] & low_bit).astype(np.uint8), first) > 0
        keep = order[several[run]]
        keep.sort()
        for k, data in dealt(part[keep], key[keep]):
            yield blocks[k], data

    def windows(block: Block, said: list[bytes]) -> Iterator[tuple[int, bytes]]:
        known = np.sort(gathered(said, ANCHOR)[0])
        parts = []
        for chunk in chunks(block.texts) if len(known) else ():
            words = chunk.words()
            layout = Layout(words, length, period)
            h = words.hashes()
            at = layout.anchors[found_in(window_hashes(h, layout.anchors, layout.span) | low_bit, known) >= 0]
            # An anchor lies in the windows that begin up to period - 1 words before it.
            doc = layout.owner[at]
            edge = np.zeros(len(h) + 1, np.int64)
            np.add.at(edge, np.maximum(at - period + 1, words.doc[:-1][doc]), 1)
            np.add.at(edge, np.minimum(at + 1, layout.last[doc]), -1)
            begin = np.flatnonzero((np.cumsum(edge[:-1]) > 0) & layout.is_window)
            rows = np.zeros(len(begin), WINDOW)
            rows["a"], rows["b"] = window_hashes(h, begin, length), window_hashes(words.hashes(1), begin, length, 1)
            rows["low"] = block.ids[chunk.first: chunk.first + chunk.n][layout.owner[begin]]
            parts.append(rows)
        if parts:
            rows = np.concatenate(parts)
            rows = rows[np.lexsort((rows["low"], rows["b"], rows["a"]))]
            first, _ = runs(_keys(rows["a"], rows["b"]))
            out = rows[first]
            if len(out):
                out["high"] = rows["low"][np.append(first[1:], len(rows)) - 1]
                yield from dealt(bucket(out["a"]), out)

    def smallest(_: int, blocks: list[int], parts: list[bytes]) -> Iterator[tuple[int, bytes]]:
        rows, part = gathered(parts, WINDOW)
        order = np.lexsort((rows["low"], rows["b"], rows["a"]))
        rows, part = rows[order], part[order]
        key = _keys(rows["a"], rows["b"])
        first, run = runs(key)
        low = rows["low"][first][run]
        out = np.zeros(len(rows), FIRST)
        out["key"], out["low"] = key, low
        more = rows["high"] > low
        for k, data in dealt(part[more], out[more]):
            yield blocks[k], data

    def kept(block: Block, said: list[bytes]) -> pa.Table:
        known = np.sort(gathered(said, FIRST)[0], order="key")
        n_words, n_removed, digests, texts = [], [], [], []
        for chunk in chunks(block.texts):
            words = chunk.words()
            gone = np.zeros(len(words.starts), bool)
            if len(known):
                layout = Layout(words, length, period)
                begin = np.flatnonzero(layout.is_window)
                at = found_in(_keys(window_hashes(words.hashes(), begin, length), window_hashes(words.hashes(1), begin, length, 1)), known["key"])
                ids = block.ids[chunk.first: chunk.first + chunk.n][layout.owner[begin]]
                hit = begin[(at >= 0) & (known["low"][at] < ids)]
                edge = np.zeros(len(gone) + 1, np.int32)
                edge[hit] += 1
                np.add.at(edge, hit + length, -1)
                gone = np.cumsum(edge[:-1]) > 0
            data, offs = joined(words, ~gone)
            removed = np.concatenate([[0], np.cumsum(gone)])
            n_words.append(np.diff(words.doc))
            n_removed.append(removed[words.doc[1:]] - removed[words.doc[:-1]])
            texts += [data[a:b] for a, b in zip(offs[:-1].tolist(), offs[1:].tolist())]
        digests = [hashlib.sha256(t).hexdigest() for t in texts]
        which = np.repeat(np.arange(len(block.ids)), block.rows)
        return pa.table({"doc_id": block.public_ids(which), "n_words": pa.array(np.concatenate(n_words)).take(pa.array(which)),
                         "n_removed": pa.array(np.concatenate(n_removed)).take(pa.array(which)),
                         "kept_sha256": pa.array(digests, pa.string()).take(pa.array(which)),
                         "kept": pa.array(texts, pa.large_binary()).cast(pa.large_string()).cast(pa.string()).take(pa.array(which))})

    common = answer(send(x, anchors), shared)
    lowest = answer(send_with(x, common, windows), smallest)
    return finish(x, lowest, kept, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")


def joined(words: Words, keep: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The kept words of each document joined by one space, and where each document's text begins."""
    data = words.chunk.data.copy()
    edge = np.zeros(len(data) + 1, np.int8)
    edge[words.starts[keep]] += 1
    edge[words.ends[keep]] -= 1
    stay = np.cumsum(edge[:-1], dtype=np.int8) > 0
    # A kept word behind another one of its document brings the white space before it, as one space.
    kept = np.flatnonzero(keep)
    owner = words.owner()[kept]
    later = np.zeros(len(kept), bool)
    later[1:] = owner[1:] == owner[:-1]
    before = words.starts[kept[later]] - 1
    data[before] = 0x20
    stay[before] = True
    at = np.concatenate([[0], np.cumsum(stay)])
    return data[stay].tobytes(), at[words.chunk.offsets]
