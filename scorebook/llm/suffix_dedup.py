"""Suffix-array dedup: bytes covered by a string of ``length`` bytes that also starts earlier.

Two equal strings of ``length`` bytes have the same minimizer: the k bytes inside them with the least hash, leftmost first. So every
document is cut into segments, each the strings that share one occurrence of a minimizer (at most ``length - k + 1`` strings, fewer than
``2 * length`` bytes), and equal strings can only meet in segments with equal minimizers. The steps, between blocks of documents and
buckets of minimizers:

1. Blocks send the hashes of their minimizers; buckets answer which occur more than once.
2. Blocks send the segments with those minimizers, equal segments once. A bucket concatenates its segments, builds their suffix
   order and Burrows-Wheeler transform, and expands intervals breadth first by backward extension (``repeats``): level l finds all
   boundaries between suffixes whose common prefix has l bytes. It stops at ``length``; the intervals that are left are the classes of equal
   strings. A bucket answers each block with the runs of its strings that are not the first of their class.
3. Blocks remove the bytes of those strings, and of all strings in repeated segments of their own.

A minimizer with over ``hot`` segments would make one bucket large. Its segments are sent string by string instead, to buckets of
the strings' own hashes (128 bits), each once per block; that is as exact, and no bucket holds more than its share.

Texts are UTF-8 bytes; the transform ends segments with byte 255, which UTF-8 never has. Strings do not cross documents. Everything is judged
on the input. Null and empty texts have no bytes. Documents are ordered by id (null first), rows that repeat an id with another text by
a hash of the text; rows that repeat id and text are one document, given once per row. An empty table gives no rows; other columns
are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from scorebook.llm.blocks import Block, answer, blocked, dealt, finish, found_in, gathered, runs, send, send_with
from scorebook.llm.wordarrays import _BYTE, Chunk, chunks, mix, powers, ragged, span_hashes

K = 32
SEPARATOR = 255
LOW = np.uint64(255)

HEAD = np.dtype([("id", "<i8"), ("doc", "<i4"), ("count", "<i4"), ("start", "<i8")])
STRING = np.dtype([("a", "<u8"), ("b", "<u8"), ("id", "<i8"), ("doc", "<i4"), ("start", "<i8")])
RUN = np.dtype([("doc", "<i4"), ("count", "<i4"), ("start", "<i8")])


def kgram_hashes(values: np.ndarray, k: int, lane: int = 0) -> np.ndarray:
    """Hash of each k consecutive values."""
    n = len(values) - k + 1
    up, down = powers(len(values) + 1, lane)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return mix((total[k:] - total[:n]) * down[:n])


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours."""
    size = 1
    while size * 2 <= width:
        x = np.minimum(x[: len(x) - size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (width - size)], x[width - size:]) if size < width else x


class Segments:
    """Segments of a chunk: document, first string, number of strings, hash of the minimizer, hash of the bytes."""

    def __init__(self, chunk: Chunk, length: int, k: int):
        data, offs = chunk.data, chunk.offsets
        n = len(data) - length + 1
        if n <= 0:
            self.doc = self.start = self.count = np.zeros(0, np.int64)
            self.minimizer = self.content = np.zeros(0, np.uint64)
            return
        values = _BYTE[0][data]
        h = kgram_hashes(values, k)
        order = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
        at = (sliding_least(order, length - k + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        valid = np.zeros(n + 1, np.int32)
        size = np.diff(offs) - length + 1
        ok = size > 0
        valid[offs[:-1][ok]] += 1
        np.add.at(valid, offs[:-1][ok] + size[ok], -1)
        valid = np.cumsum(valid[:-1]) > 0
        begins = valid.copy()
        begins[1:] &= (at[1:] != at[:-1]) | ~valid[:-1]
        begins[offs[:-1][ok]] = True
        first = np.flatnonzero(begins)
        ends = valid.copy()
        ends[:-1] &= begins[1:] | ~valid[1:]
        self.start = first
        self.count = np.flatnonzero(ends) + 1 - first
        self.doc = np.searchsorted(offs, first, "right") - 1
        self.minimizer = h[at[first]] & ~LOW
        self.content = span_hashes(values, first, first + self.count + length - 1)


def repeats(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffix order of ``text`` (as far as ``depth`` bytes tell), and for each place in it whether a new class of equal prefixes of
    ``depth`` bytes begins there. The text must end with ``SEPARATOR``; prefixes that hold it are not told apart."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for i in range(8):
        key = (key << np.uint64(8)) | padded[i: i + n]
    size = 8
    while True:  # orders by 8, 16, 32, … bytes
        suffixes = np.argsort(key, kind="stable")
        ordered = key[suffixes]
        new = np.ones(n, bool)
        new[1:] = ordered[1:] != ordered[:-1]
        if size >= depth or new.all():
            break
        rank = np.empty(n, np.uint64)
        rank[suffixes] = np.cumsum(new, dtype=np.uint64)
        after = np.zeros(n, np.uint64)
        after[: n - size] = rank[size:] if size < n else 0
        key = (rank << np.uint64(32)) | after
        size *= 2
    before = text[suffixes - 1]  # the Burrows-Wheeler transform
    step = np.empty(n, np.int64)  # from a suffix's place to the place of the suffix one byte longer
    step[np.argsort(before, kind="stable")] = np.arange(n)
    front = np.sort(before)
    boundary = np.zeros(n + 1, bool)
    boundary[[0, n]] = True
    owner = np.full(n + 1, -1, np.int64)
    low, high = np.array([0]), np.array([n])
    for _ in range(depth):
        if not len(low):
            break
        # Every queued interval of prefixes w splits into the intervals of all cw; each is one run of places with one owner and one c.
        width = high - low
        places = step[ragged(low, width)]
        owner[places] = np.repeat(np.arange(len(low)), width)
        places.sort()
        mine, letter = owner[places], front[places]
        behind, ahead = places + 1, places - 1
        last = (owner[behind] != mine) | (front[np.minimum(behind, n - 1)] != letter)
        first = (owner[ahead] != mine) | (front[ahead] != letter) | (places == 0)
        starts, ends = places[first], behind[last]
        owner[places] = -1
        fresh = ~boundary[ends]
        boundary[ends[fresh]] = True
        low, high = starts[fresh], ends[fresh]
    return suffixes, boundary[:n]


def first_of_class(heads: np.ndarray, text: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """For each string of each segment, one segment after the other, whether an equal string stands in an earlier place."""
    suffixes, boundary = repeats(text, length)
    cls = np.empty(len(text), np.int64)
    cls[suffixes] = np.cumsum(boundary)
    count = heads["count"].astype(np.int64)
    own = np.repeat(np.arange(len(heads)), count)
    string = ragged(at, count)
    within = string - at[own]
    c = cls[string]
    order = np.lexsort((heads["start"][own] + within, heads["doc"][own], heads["id"][own], c))
    later = np.empty(len(string), bool)
    sorted_c = c[order]
    later[order] = np.concatenate([[False], sorted_c[1:] == sorted_c[:-1]])
    return later


def dedup(docs: DataFrame, length: int = 100, block_bytes: int = 8 << 20, bucket_bytes: int = 2 << 20, hot: int = 20_000,
          with_text: bool = True) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept`` per row; ``kept`` (binary) is what stays, null without ``with_text``."""
    k = max(1, min(K, length // 2))
    x, size = blocked(docs, block_bytes)
    n_buckets = max(1, -(-size // bucket_bytes))
    bucket = lambda h: (mix(h) >> np.uint64(20)).astype(np.int64) % n_buckets

    def minimizers(block: Block) -> Iterator[tuple[int, bytes]]:
        """Each minimizer once, with the number of its segments, up to 255, in the lowest byte."""
        h = np.concatenate([Segments(c, length, k).minimizer for c in chunks(block.texts)])
        kinds, n = np.unique(h, return_counts=True)
        if len(kinds):
            yield from dealt(bucket(kinds), (kinds | np.minimum(n, 255).astype(np.uint64)).astype("<u8"))

    def shared(_: int, blocks: list[int], parts: list[bytes]) -> Iterator[tuple[int, bytes]]:
        """Minimizers with more than one segment; the lowest bit marks those with many."""
        h, part = gathered(parts, "<u8")
        key, n = h & ~LOW, (h & LOW).astype(np.int64)
        order = np.argsort(key, kind="stable")
        first, run = runs(key[order])
        total = np.add.reduceat(n[order], first)[run]
        said = key[order] | (total > hot).astype(np.uint64)
        keep = total > 1
        for b, data in dealt(part[order][keep], said[keep]):
            yield blocks[b], data

    def segments(block: Block, said: list[bytes]) -> Iterator[tuple[int, bytes]]:
        known = np.sort(gathered(said, "<u8")[0])
        seen: list[np.ndarray] = []
        for chunk in chunks(block.texts) if len(known) else ():
            s = Segments(chunk, length, k)
            at = found_in(s.minimizer, known & ~LOW)
            pick = np.flatnonzero(at >= 0)
            # Equal segments go once per block: the first one, as documents and places come in order.
            both = mix(s.content[pick]) + s.minimizer[pick]
            _, first = np.unique(both, return_index=True)
            first.sort()
            if seen:
                first = first[found_in(both[first], seen[-1]) < 0]
            seen = [np.union1d(seen[-1], both[first]) if seen else np.sort(both[first])]
            pick = pick[first]
            many = (known[at[pick]] & np.uint64(1)) > 0
            heads = np.zeros(len(pick), HEAD)
            doc = s.doc[pick]
            heads["id"], heads["doc"], heads["count"] = block.ids[chunk.first + doc], chunk.first + doc, s.count[pick]
            heads["start"] = s.start[pick] - chunk.offsets[doc]
            yield from _whole(chunk, s.start[pick[~many]], heads[~many], bucket(s.minimizer[pick[~many]]))
            yield from _strings(chunk, s.start[pick[many]], heads[many])

    def _whole(chunk: Chunk, start: np.ndarray, heads: np.ndarray, to: np.ndarray) -> Iterator[tuple[int, bytes]]:
        order = np.argsort(to, kind="stable")
        start, heads, to = start[order], heads[order], to[order]
        span = heads["count"].astype(np.int64) + length - 1
        raw = chunk.data[ragged(start, span)].tobytes()
        ends = np.concatenate([[0], np.cumsum(span)])
        kinds, first = np.unique(to, return_index=True)
        for b, a, z in zip(kinds.tolist(), first.tolist(), [*first[1:].tolist(), len(to)]):
            yield 2 * b, np.int64(z - a).tobytes() + heads[a:z].tobytes() + raw[ends[a]: ends[z]]

    def _strings(chunk: Chunk, start: np.ndarray, heads: np.ndarray) -> Iterator[tuple[int, bytes]]:
        count = heads["count"].astype(np.int64)
        own, place = np.repeat(np.arange(len(heads)), count), ragged(start, count)
        if len(place):
            rows = np.zeros(len(place), STRING)
            for lane, name in enumerate("ab"):
                rows[name] = span_hashes(_BYTE[lane][chunk.data], place, place + length, lane)
            rows["id"], rows["doc"] = heads["id"][own], heads["doc"][own]
            rows["start"] = heads["start"][own] + place - start[own]
            for b, data in dealt(bucket(rows["a"]), rows):
                yield 2 * b + 1, data

    def judge(bucket: int, blocks: list[int], parts: list[bytes]) -> Iterator[tuple[int, bytes]]:
        if bucket % 2:  # strings of hot minimizers
            rows, part = gathered(parts, STRING)
            order = np.lexsort((rows["start"], rows["doc"], rows["id"], rows["b"], rows["a"]))
            _, run = runs(mix(rows["a"][order]) + rows["b"][order])
            later = order[np.concatenate([[False], run[1:] == run[:-1]])]
            out = np.zeros(len(later), RUN)
            out["doc"], out["count"], out["start"] = rows["doc"][later], 1, rows["start"][later]
            for b, data in dealt(part[later], out):
                yield blocks[b], data
            return
        heads_of, bodies, part = [], [], []
        for i, raw in enumerate(parts):
            n = int(np.frombuffer(raw, "<i8", 1)[0])
            heads_of.append(np.frombuffer(raw, HEAD, n, 8))
            bodies.append(np.frombuffer(raw, np.uint8, offset=8 + n * HEAD.itemsize))
            part += [i] * n
        heads, body, part = np.concatenate(heads_of), np.concatenate(bodies), np.array(part)
        span = heads["count"].astype(np.int64) + length - 1
        at = np.cumsum(span) - span
        content = span_hashes(_BYTE[0][body], at, at + span)
        order = np.lexsort((heads["start"], heads["doc"], heads["id"], content))
        first, _ = runs(content[order])
        again = np.ones(len(heads), bool)
        again[order[first]] = False  # equal segments: all but the first are repeated whole
        out = np.zeros(len(heads), RUN)
        for name in RUN.names:
            out[name] = heads[name]
        for b, data in dealt(part[again], out[again]):
            yield blocks[b], data
        # A segment whose minimizer no other content has cannot share a string with any other.
        own = np.flatnonzero(~again)
        lead = minimizer_of(body, at[own], length, k)
        kinds, which, n = np.unique(lead, return_inverse=True, return_counts=True)
        own = own[n[which] > 1]
        if not len(own):
            return
        ends = np.cumsum(span[own] + 1)
        text = np.full(ends[-1], SEPARATOR, np.uint8)
        begin = ends - span[own] - 1
        text[ragged(begin, span[own])] = body[ragged(at[own], span[own])]
        later = first_of_class(heads[own], text, begin, length)
        count = heads["count"][own].astype(np.int64)
        seg = np.repeat(np.arange(len(own)), count)
        place = ragged(np.zeros(len(own), np.int64), count)
        begins, ends_ = later.copy(), later.copy()
        same = seg[1:] == seg[:-1]
        begins[1:] &= ~(later[:-1] & same)
        ends_[:-1] &= ~(later[1:] & same)
        a, z = np.flatnonzero(begins), np.flatnonzero(ends_)
        out = np.zeros(len(a), RUN)
        out["doc"], out["start"], out["count"] = heads["doc"][own][seg[a]], heads["start"][own][seg[a]] + place[a], z - a + 1
        for b, data in dealt(part[own][seg[a]], out):
            yield blocks[b], data

    def kept(block: Block, said: list[bytes]) -> pa.Table:
        runs_, _ = gathered(said, RUN)
        runs_ = runs_[np.argsort(runs_["doc"], kind="stable")]
        seen = np.zeros(0, np.uint64)
        n_bytes, n_removed, n_spans, digests, texts = [], [], [], [], []
        for chunk in chunks(block.texts):
            s = Segments(chunk, length, k)
            both = mix(s.content) + s.minimizer
            _, first = np.unique(both, return_index=True)
            again = np.ones(len(both), bool)
            again[first] = False
            again |= found_in(both, seen) >= 0
            seen = np.union1d(seen, both)
            mine = runs_[np.searchsorted(runs_["doc"], chunk.first): np.searchsorted(runs_["doc"], chunk.first + chunk.n)]
            start = np.concatenate([s.start[again], chunk.offsets[mine["doc"] - chunk.first] + mine["start"]])
            count = np.concatenate([s.count[again], mine["count"].astype(np.int64)])
            edge = np.zeros(len(chunk.data) + 1, np.int32)
            np.add.at(edge, start, 1)
            np.add.at(edge, start + count + length - 1, -1)
            gone = np.cumsum(edge[:-1]) > 0
            begins = gone.copy()
            begins[1:] &= ~gone[:-1]
            full = chunk.offsets[:-1][chunk.offsets[:-1] < chunk.offsets[1:]]
            begins[full] = gone[full]
            for out, mask in ((n_removed, gone), (n_spans, begins)):
                total = np.concatenate([[0], np.cumsum(mask)])
                out.append(total[chunk.offsets[1:]] - total[chunk.offsets[:-1]])
            n_bytes.append(np.diff(chunk.offsets))
            data = chunk.data[~gone].tobytes()
            at = chunk.offsets - np.concatenate([[0], np.cumsum(gone)])[chunk.offsets]
            each = [data[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
            digests += [hashlib.sha256(t).hexdigest() for t in each]
            texts += each if with_text else [None] * len(each)
        which = pa.array(np.repeat(np.arange(len(block.ids)), block.rows))
        counts = [pa.array(np.concatenate(c).astype(np.int64)).take(which) for c in (n_bytes, n_removed, n_spans)]
        return pa.table([block.public_ids(which.to_numpy()), *counts, pa.array(digests, pa.string()).take(which),
                         pa.array(texts, pa.binary()).take(which)],
                        ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    common = answer(send(x, minimizers), shared)
    later = answer(send_with(x, common, segments), judge)
    return finish(x, later, kept, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def minimizer_of(body: np.ndarray, at: np.ndarray, length: int, k: int) -> np.ndarray:
    """The minimizer of each segment, from the segment alone: its first string's, which all its strings share."""
    h = kgram_hashes(_BYTE[0][body], k)
    order = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    least = sliding_least(order, length - k + 1)
    return h[(least[at] & np.uint64(0xFFFFFFFF)).astype(np.int64)] & ~LOW
