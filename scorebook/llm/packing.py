"""Packing of documents into sequences of fixed length: patterns of few lengths fitted to the length histogram.

Tokens come first: every document becomes ids, only those longer than a sequence are cut, and each piece is a row.
The histogram of piece lengths (at most ``capacity`` numbers, whatever the corpus) goes to the driver, where

1. lengths fall into ``bins`` equal classes, and all patterns of at most ``parts`` classes that fill a sequence are listed,
2. non-negative least squares fit how often each pattern is used to the histogram of classes,
3. the counts are rounded, each pattern is filled with actual lengths (the last place by best fit), and
4. what is left goes best-fit into the open sequences, longest first.

Steps 3 and 4 work on runs of equal sequences, so the plan grows with the number of lengths, not of documents. A piece finds
its place by its rank among the pieces of its length; ranks come from counts per task, so a length that a third
of all pieces share is no one's bottleneck.

Null and empty texts have no ids but the end mark; repeated rows are packed as often as they occur; ``doc_id`` may be
null or repeat. An empty table gives no rows. Other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

import bisect
import re
import unicodedata
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scorebook.llm.common import map_batches, stored
from scorebook.llm.wordarrays import SPACE, Chunk, Words, chunks, ragged

END = 1
#: Parts that a worker remembers, and ids of them; beyond either it forgets them all.
REMEMBERED, REMEMBERED_IDS = 400_000, 4_000_000
#: New parts that are merged in one call.
MERGED = 20_000

#: Characters that neither compose, nor count as white space, nor lower to several characters.
PLAIN = re.compile("[!-~¡-įı-ſ]*")

BLANK, LETTER, NUMBER, OTHER, ODD = range(5)
_CODES = range(0x180)
#: For each code point up to U+017F, all of them one or two bytes: its kind, and its lower-case form, which has as many bytes.
KIND = np.array([BLANK if c < 0x80 and SPACE[c] else {"L": LETTER, "N": NUMBER}.get(unicodedata.category(chr(c))[0], OTHER) if PLAIN.fullmatch(chr(c)) else ODD
                 for c in _CODES], np.uint8)
LOWER = np.array([ord(chr(c).lower()) if PLAIN.fullmatch(chr(c)) else c for c in _CODES], np.uint16)
#: The same for single bytes; those of longer characters are odd.
BYTE_KIND = np.where(np.arange(256) < 0x80, KIND[:256], ODD).astype(np.uint8)
BYTE_LOWER = np.where(np.arange(256) < 0x80, LOWER[:256], np.arange(256)).astype(np.uint8)


def parts(chunk: Chunk) -> tuple[Words, np.ndarray, np.ndarray]:
    """What `'s|'t|'re|'ve|'m|'ll|'d|\\p{L}+|\\p{N}|[^\\s\\p{L}\\p{N}]+` finds in the lower-cased text, these bytes, and whether a part is odd.

    An odd part is a whole word, in its own bytes, that holds other than plain characters or may hold a special token.
    """
    words, raw = chunk.words(), chunk.data
    data, kind = BYTE_LOWER[raw], BYTE_KIND[raw]
    cut = np.zeros(len(raw) + 1, bool)  # where a document begins or ends
    cut[chunk.offsets] = True
    lead = np.flatnonzero((raw >= 0xC2) & (raw <= 0xC5))
    lead = lead[~cut[lead + 1]]
    lead = lead[raw[lead + 1] & 0xC0 == 0x80]
    code = (raw[lead].astype(np.uint16) & 0x1F) << 6 | raw[lead + 1] & 0x3F
    kind[lead] = kind[lead + 1] = KIND[code]
    data[lead], data[lead + 1] = 0xC0 | LOWER[code] >> 6, 0x80 | LOWER[code] & 0x3F

    begin = np.ones(len(raw) + 1, bool)
    begin[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER) & (raw[1:] & 0xC0 != 0x80)
    begin[words.starts] = True
    at = np.flatnonzero(data == ord("'"))
    at = at[begin[at]]
    at = at[~cut[at + 1]]
    one = np.isin(data[at + 1], np.frombuffer(b"stmd", np.uint8))
    longer = at[~cut[at + 2] & ~one]
    pair = data[longer + 1].astype(np.uint16) << 8 | data[longer + 2]
    longer = longer[np.isin(pair, np.frombuffer(b"revell", ">u2"))]
    at = at[one]
    begin[at + 1] = begin[longer + 1] = False
    begin[at + 2] = begin[longer + 3] = True

    odd = kind == ODD
    special = np.flatnonzero(data == ord("<"))
    special = special[~cut[special + 1]]
    odd[special[data[special + 1] == ord("|")]] = True
    if odd.any():
        total = np.concatenate([[0], np.cumsum(odd)])
        which = np.flatnonzero(total[words.ends] > total[words.starts])
        inside = ragged(words.starts[which], words.ends[which] - words.starts[which])
        begin[inside], data[inside], odd[inside] = False, raw[inside], True
        begin[words.starts[which]] = True
    edges = np.flatnonzero(begin)
    starts, ends = edges[:-1], edges[1:]
    full = kind[starts] != BLANK
    starts, ends = starts[full], ends[full]
    return Words(chunk, starts, ends, np.searchsorted(starts, chunk.offsets)), data, odd[starts]


class WordTokenizer:
    """Ids of whole texts by a tokenizer of the ``tokenizers`` library that drops white space.

    Nothing in such a tokenizer looks across white space, nor its merges across parts of words, so each distinct part is
    merged once and remembered, new parts many at a time. Words with other than plain characters are encoded whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.whole = Tokenizer.from_file(path)
        self.merges = Tokenizer(self.whole.model)
        spell = ByteLevel(add_prefix_space=False, use_regex=False)
        plain = [chr(c) for c in _CODES if c > 0x20 and PLAIN.fullmatch(chr(c))]
        self.letters = {b: ord(s) for c in plain for b, s in zip(c.encode(), spell.pre_tokenize_str(c)[0][0], strict=True)}
        self.forget()

    def forget(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.pool = np.zeros(0, np.uint32)
        self.begins = np.zeros(1, np.int64)

    def merged(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of plain parts, one part after the other, and how many each has."""
        size = ends - starts
        spelled = np.full(size.sum() + len(size), ord("\n"), np.uint8)
        spelled[ragged(np.cumsum(size + 1) - size - 1, size)] = data[ragged(starts, size)]
        texts = spelled.tobytes().decode("latin-1").translate(self.letters).split("\n")[:-1]
        got = self.merges.encode(texts, is_pretokenized=True, add_special_tokens=False)
        return np.array(got.ids, np.uint32), np.bincount(np.array(got.word_ids, np.int64), minlength=len(texts))

    def learn(self, keys: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, odd: np.ndarray) -> None:
        """Parts that are not known yet; the odd ones come last."""
        ids, sizes, plain = [self.pool], [], int(np.count_nonzero(~odd))
        for i in range(0, plain, MERGED):
            j = min(plain, i + MERGED)
            got, size = self.merged(data, starts[i:j], ends[i:j])
            ids.append(got)
            sizes.append(size)
        for s, e in zip(starts[plain:].tolist(), ends[plain:].tolist()):
            got = self.whole.encode(data[s:e].tobytes().decode("utf-8", "replace"), add_special_tokens=False).ids
            ids.append(np.array(got, np.uint32))
            sizes.append(np.array([len(got)]))
        self.known = np.concatenate([self.known, keys])
        self.pool = np.concatenate(ids)
        self.begins = np.concatenate([self.begins, self.begins[-1] + np.cumsum(np.concatenate(sizes))])

    def encode(self, chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the chunk, each document followed by the end mark, and where each document begins."""
        if len(self.known) > REMEMBERED or len(self.pool) > REMEMBERED_IDS:
            self.forget()
        found, data, odd = parts(chunk)
        keys = found.hashes(data=data)
        entry = pc.index_in(pa.array(keys), value_set=pa.array(self.known)).fill_null(-1).to_numpy().astype(np.int64)
        new = np.flatnonzero(entry < 0)
        if len(new):
            fresh, first, which = np.unique(keys[new], return_index=True, return_inverse=True)
            first = new[first]
            order = np.argsort(odd[first], kind="stable")
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order)) + len(self.known)
            entry[new] = place[which]
            first = first[order]
            self.learn(fresh[order], data, found.starts[first], found.ends[first], odd[first])
        size = self.begins[entry + 1] - self.begins[entry]
        doc = np.concatenate([[0], np.cumsum(size)])[found.doc] + np.arange(chunk.n + 1)
        out = np.full(doc[-1], END, np.uint32)
        text = np.ones(len(out), bool)
        text[doc[1:] - 1] = False
        out[text] = self.pool[ragged(self.begins[entry], size)]
        return out, doc


_tokenizers: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """One per worker process, so that parts stay known from task to task."""
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long, task int, nth long"


def tokenized(docs: DataFrame, path: str, capacity: int = 4096) -> DataFrame:
    """A row per piece; ``nth`` counts the pieces of equal length within the task that made them."""

    def make():
        task = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        tok = tokenizer(path)

        def step(batch: pa.RecordBatch):
            for chunk in chunks(batch.column("text"), 2 << 20):
                ids, doc = tok.encode(chunk)
                size = np.diff(doc)
                pieces = -(-size // capacity)
                owner = np.repeat(np.arange(chunk.n), pieces)
                number = ragged(np.zeros(chunk.n, np.int64), pieces)
                start = number * capacity
                length = np.minimum(capacity, size[owner] - start)
                at = (doc[:-1][owner] + start).tolist()
                raw = memoryview(ids.astype("<u4").view(np.uint8))
                crc = [zlib.crc32(raw[4 * a: 4 * (a + n)]) for a, n in zip(at, length.tolist())]
                order = np.argsort(length, kind="stable")
                kinds, counts = np.unique(length, return_counts=True)
                nth = np.empty(len(length), np.int64)
                nth[order] = ragged(seen[kinds], counts)
                seen[kinds] += counts
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").take(pa.array(owner + chunk.first)).cast(pa.int64()), pa.array(number, pa.int32()),
                    pa.array(start), pa.array(length, pa.int32()), pa.array(crc, pa.int64()),
                    pa.array(np.full(len(owner), task), pa.int32()), pa.array(nth)],
                    ["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"])

        return step

    return map_batches(docs.select("doc_id", F.col("text").cast("string").alias("text")), make, PIECES)


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 400) -> np.ndarray:
    """x >= 0 that makes a @ x close to b in the sense of least squares, by an active set of columns."""
    x = np.zeros(a.shape[1])
    free = np.zeros(a.shape[1], bool)
    scale = 1e-9 * max(1.0, float(np.abs(a.T @ b).max(initial=0)))
    for _ in range(rounds):
        slope = np.where(free, -np.inf, a.T @ (b - a @ x))
        best = int(np.argmax(slope))
        if slope[best] <= scale:
            break
        free[best] = True
        while True:
            cols = np.flatnonzero(free)
            z = np.linalg.lstsq(a[:, cols], b, rcond=None)[0]
            if (z > 0).all():
                x[:] = 0
                x[cols] = z
                break
            bad = z <= 0
            old = x[cols]
            ratio = np.full(len(cols), np.inf)
            ratio[bad] = old[bad] / np.maximum(old[bad] - z[bad], 1e-300)
            step = ratio.min()
            x[cols] = np.maximum(0, old + step * (z - old))
            drop = cols[bad & (ratio <= step)]
            x[drop] = 0
            free[drop] = False
    return x


def patterns(bins: int, parts: int) -> list[tuple[int, ...]]:
    """All non-increasing tuples of at most ``parts`` classes 1 .. bins that add up to ``bins``."""
    out: list[tuple[int, ...]] = []

    def extend(prefix: tuple[int, ...], left: int) -> None:
        if left == 0:
            out.append(prefix)
        elif len(prefix) < parts:
            for c in range(min(left, prefix[-1] if prefix else left), 0, -1):
                if c * (parts - len(prefix)) >= left:
                    extend((*prefix, c), left - c)

    extend((), bins)
    return out


class _Lengths:
    """How many pieces of each length are still to be packed; the longest one that fits is found by bisection."""

    def __init__(self, counts: dict[int, int]):
        self.left = dict(counts)
        self.order = sorted(k for k, v in counts.items() if v)

    def longest(self, at_most: int, above: int = 0) -> int | None:
        i = bisect.bisect_right(self.order, at_most) - 1
        return self.order[i] if i >= 0 and self.order[i] > above else None

    def take(self, length: int, n: int) -> None:
        self.left[length] -= n
        if not self.left[length]:
            self.order.pop(bisect.bisect_left(self.order, length))


def plan(histogram: dict[int, int], capacity: int = 4096, bins: int = 64, parts: int = 4) -> list[tuple[tuple[int, ...], int]]:
    """Kinds of sequences (the lengths in them) and how many there are of each; uses up the histogram exactly."""
    lengths = _Lengths(histogram)
    width = capacity / bins
    cls = lambda n: max(1, int(np.ceil(n / width)))
    target = np.zeros(bins)
    for n, c in histogram.items():
        target[cls(n) - 1] += c
    listed = patterns(bins, parts)
    use = np.zeros((bins, len(listed)))
    for j, p in enumerate(listed):
        for c in p:
            use[c - 1, j] += 1
    # A class of long pieces weighs more: short ones still fit in anywhere afterwards.
    weight = np.sqrt(np.arange(1, bins + 1) / bins) / np.sqrt(np.maximum(target, 1))
    counts = np.rint(nnls(use * weight[:, None], target * weight)).astype(int)
    rows: list[tuple[tuple[int, ...], int]] = []
    for j in np.argsort(-counts, kind="stable"):
        todo = int(counts[j])
        while todo > 0:
            chosen: dict[int, int] = defaultdict(int)
            filled: list[int] = []
            for i, c in enumerate(listed[j]):
                room = capacity - sum(filled)
                last = i == len(listed[j]) - 1 and i > 0
                got = lengths.longest(room if last else min(room, int(c * width)), 0 if last else int((c - 1) * width))
                while got is not None and lengths.left[got] <= chosen[got]:
                    got = lengths.longest(got - 1, 0 if last else int((c - 1) * width))
                if got is None:
                    break
                filled.append(got)
                chosen[got] += 1
            if len(filled) < len(listed[j]):
                break
            n = min([todo, *(lengths.left[k] // v for k, v in chosen.items())])
            for k, v in chosen.items():
                lengths.take(k, n * v)
            rows.append((tuple(filled), n))
            todo -= n
    return _best_fit(rows, lengths, capacity)


def _best_fit(rows: list[tuple[tuple[int, ...], int]], rest: _Lengths, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """The remaining lengths, longest first, each into the fullest open sequences that take it, else into new ones."""
    open_at: dict[int, list[list]] = defaultdict(list)
    rooms: list[int] = []
    done: list[tuple[tuple[int, ...], int]] = []

    def put(kind: tuple[int, ...], n: int) -> None:
        room = capacity - sum(kind)
        if not room:
            done.append((kind, n))
            return
        if not open_at[room]:
            bisect.insort(rooms, room)
        open_at[room].append([kind, n])

    for kind, n in rows:
        put(kind, n)
    for length in reversed(rest.order):
        todo = rest.left[length]
        while todo:
            i = bisect.bisect_left(rooms, length)
            if i == len(rooms):
                each = capacity // length
                if todo >= each:
                    put((length,) * each, todo // each)
                    todo %= each
                else:
                    put((length,) * todo, 1)
                    todo = 0
                continue
            room = rooms[i]
            kind, n = open_at[room].pop()
            if not open_at[room]:
                rooms.pop(i)
            each = min(room // length, todo)
            m = min(n, todo // each)
            if n > m:
                put(kind, n - m)
            put((*kind, *(length,) * each), m)
            todo -= m * each
    done += [(kind, n) for room in rooms for kind, n in open_at[room]]
    return done


def _slots(kinds: list[tuple[tuple[int, ...], int]], capacity: int) -> dict[str, np.ndarray]:
    """For each length, in ranks' order: which ranks go to which sequences, and where in them."""
    taken: dict[int, int] = defaultdict(int)
    rows, base = [], 0
    for kind, n in kinds:
        offset = 0
        for length in kind:
            rows.append((length, taken[length], base, offset))
            taken[length] += n
            offset += length
        base += n
    rows.sort()
    length, rank, sequence, offset = (np.array(x, np.int64) for x in zip(*rows)) if rows else (np.zeros(0, np.int64),) * 4
    return {"length": length, "rank": rank, "sequence": sequence, "offset": offset}


PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def best_fit_packing(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, bins: int = 64, parts: int = 4) -> DataFrame:
    """Each piece of each document with its sequence and its place there; sequences have no gaps."""
    pieces = stored(tokenized(docs, tokenizer_path, capacity), "packing-pieces")
    per_task = stored(pieces.groupBy("task", "length").agg(F.count("*").alias("n")), "packing-counts")
    histogram = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = _slots(plan(histogram, capacity, bins, parts), capacity)
    # Counts of tasks are few rows; within one length they stand in the tasks' order.
    first = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    begins = per_task.select(F.col("task").alias("t"), F.col("length").alias("l"), F.coalesce(first, F.lit(0)).alias("before"))
    ranked = pieces.join(begins, (F.col("task") == F.col("t")) & (F.col("length") == F.col("l")))
    held = docs.sparkSession.sparkContext.broadcast(slots)

    def make():
        s = held.value
        starts = np.searchsorted(s["length"], np.arange(capacity + 2))

        def step(batch: pa.RecordBatch):
            length = batch.column("length").to_numpy().astype(np.int64)
            rank = batch.column("rank").to_numpy()
            wide = int(max(rank.max(), s["rank"].max())) + 1
            i = np.searchsorted(s["length"] * wide + s["rank"], length * wide + rank, "right") - 1
            assert (i >= starts[length]).all()
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "piece", "start")), pa.array(length), batch.column("ids_crc32"),
                 pa.array(s["sequence"][i] + rank - s["rank"][i]), pa.array(s["offset"][i])],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

        return step

    return map_batches(ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("nth") + F.col("before")).alias("rank")),
                       make, PLACED)
