"""Blocks of documents that ask buckets of hashes, and get answers back.

Documents are dealt to blocks by a hash of their id, so a block holds some megabytes of text and all rows with the same id. A step
sends packed arrays from blocks to buckets (by hash values), and another sends answers from buckets to the blocks that asked.
Every block sends each value once, so a value that a third of all documents hold reaches its bucket once per block. Blocks are read
several times, through one exchange of the texts that Spark reuses.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorebook.llm.common import NO_ID, doc_key
from scorebook.session import ship_package

SENT = "bucket long, block long, data binary"
ANSWER = "block long, data binary"


@dataclass
class Block:
    """Distinct documents of a block in the order of id and text hash, and how many rows each stands for."""

    number: int
    ids: np.ndarray
    texts: pa.Array
    rows: np.ndarray

    @staticmethod
    def of(table: pa.Table) -> Block:
        ids, hashes = table.column("did").to_numpy(), table.column("th").to_numpy()
        order = np.lexsort((hashes, ids))
        ids, hashes = ids[order], hashes[order]
        new = np.ones(len(order), bool)
        new[1:] = (ids[1:] != ids[:-1]) | (hashes[1:] != hashes[:-1])
        first = np.flatnonzero(new)
        texts = table.column("body").cast(pa.large_binary()).combine_chunks()
        texts = texts.chunk(0) if isinstance(texts, pa.ChunkedArray) else texts
        return Block(table.column("block")[0].as_py(), ids[first], texts.take(pa.array(order[first])), np.diff(np.append(first, len(order))))

    def public_ids(self, which: np.ndarray) -> pa.Array:
        ids = self.ids[which]
        return pa.array(ids, mask=ids == NO_ID)


def blocked(docs: DataFrame, block_bytes: int) -> tuple[DataFrame, int]:
    """``did, th, body, block`` of every row, and the bytes of all texts; ``th`` is a hash of the text."""
    ship_package(docs.sparkSession)
    body = doc_key(docs)
    size = body.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    n = max(1, -(-size // block_bytes))
    return body.select("did", F.xxhash64("body").alias("th"), "body", F.pmod(F.xxhash64("did"), F.lit(n)).alias("block")), size


def send(x: DataFrame, step: Callable[[Block], Iterator[tuple[int, bytes]]]) -> DataFrame:
    """Rows ``bucket, block, data`` from each block."""
    def run(table: pa.Table) -> pa.Table:
        block = Block.of(table)
        return _sent(block.number, list(step(block)))

    return x.groupBy("block").applyInArrow(run, SENT)


def send_with(x: DataFrame, answers: DataFrame, step: Callable[[Block, list[bytes]], Iterator[tuple[int, bytes]]]) -> DataFrame:
    """Like ``send``; the step also gets the answers to its block."""
    def run(table: pa.Table, said: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _sent(0, [])
        block = Block.of(table)
        return _sent(block.number, list(step(block, said.column("data").to_pylist())))

    return x.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, SENT)


def finish(x: DataFrame, answers: DataFrame, step: Callable[[Block, list[bytes]], pa.Table], schema: str) -> DataFrame:
    """The result of each block from its documents and the answers to it."""
    def run(table: pa.Table, said: pa.Table) -> pa.Table:
        return step(Block.of(table), said.column("data").to_pylist())

    return x.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, schema)


def answer(sent: DataFrame, step: Callable[[int, list[int], list[bytes]], Iterator[tuple[int, bytes]]]) -> DataFrame:
    """Rows ``block, data`` from each bucket, which sees what all blocks sent, in the blocks' order."""
    def run(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table.column("block")))
        out = list(step(table.column("bucket")[0].as_py(), table.column("block").to_pylist(), table.column("data").to_pylist()))
        return pa.table({"block": pa.array([o[0] for o in out], pa.int64()), "data": pa.array([o[1] for o in out], pa.binary())})

    return sent.groupBy("bucket").applyInArrow(run, ANSWER)


def _sent(number: int, out: list[tuple[int, bytes]]) -> pa.Table:
    return pa.table({"bucket": pa.array([o[0] for o in out], pa.int64()), "block": pa.array([number] * len(out), pa.int64()),
                     "data": pa.array([o[1] for o in out], pa.binary())})


def dealt(bucket: np.ndarray, records: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """The records of each bucket, packed."""
    order = np.argsort(bucket, kind="stable")
    kinds, at = np.unique(bucket[order], return_index=True)
    records = records[order]
    for k, a, b in zip(kinds.tolist(), at.tolist(), [*at[1:].tolist(), len(records)]):
        yield k, records[a:b].tobytes()


def gathered(parts: list[bytes], dtype) -> tuple[np.ndarray, np.ndarray]:
    """All records, and for each the number of the part that it came in."""
    arrays = [np.frombuffer(p, dtype) for p in parts]
    if not arrays:
        return np.zeros(0, dtype), np.zeros(0, np.int64)
    return np.concatenate(arrays), np.repeat(np.arange(len(arrays)), [len(a) for a in arrays])


def runs(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each run of equal keys begins, and for each entry the number of its run."""
    new = np.ones(len(sorted_keys), bool)
    new[1:] = sorted_keys[1:] != sorted_keys[:-1]
    return np.flatnonzero(new), np.cumsum(new) - 1


def found_in(values: np.ndarray, sorted_of: np.ndarray) -> np.ndarray:
    """For each value its place in the sorted array, or -1."""
    if not len(sorted_of):
        return np.full(len(values), -1)
    at = np.minimum(np.searchsorted(sorted_of, values), len(sorted_of) - 1)
    return np.where(sorted_of[at] == values, at, -1)
