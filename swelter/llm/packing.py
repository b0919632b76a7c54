"""Token ids, packed best-fit-decreasing into rows of a fixed length.

Documents are dealt over shards of a bounded size by a hash. A task tokenises its shard,
splits documents longer than a row, and packs the pieces with a segment tree over the free
lengths of open rows. Ids, cumulative segment lengths and positions leave as binary columns.
"""

from __future__ import annotations

import base64
import os
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swelter.llm.common import pick
from swelter.session import ship_package

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Ends every document; the first id that the vocabulary leaves free.
END_OF_TEXT = 50256
#: Split of a text before merges; fixed by the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
ROW_TOKENS = 2048
#: Characters of text a shard aims at, and tokens a task packs at once.
SHARD_CHARS = 32_000_000
BLOCK_TOKENS = 16_000_000
ID = np.dtype("<u4")

SCHEMA = (
    "shard int, block int, row int, n_tokens int, doc_ids array<bigint>, pieces array<int>, "
    "cu_seqlens array<int>, position_resets array<int>, ids binary"
)


@lru_cache(maxsize=2)
def _encoding(vocabulary: str) -> tiktoken.Encoding:
    with open(vocabulary, "rb") as lines:
        ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_ids(text: str, vocabulary: str = VOCABULARY) -> np.ndarray:
    """Ids of the whole text and END_OF_TEXT behind them."""
    return np.frombuffer(array("I", [*_encoding(vocabulary).encode_ordinary(text), END_OF_TEXT]), ID)


class FreeLengths:
    """Open rows by free length: a segment tree of counts, searched for the smallest that fits."""

    def __init__(self, longest: int) -> None:
        self.size = 1 << longest.bit_length()
        self.count = [0] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(longest + 1)]

    def put(self, free: int, row: int) -> None:
        self.rows[free].append(row)
        at = free + self.size
        while at:
            self.count[at] += 1
            at >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """The row with the least free length of ``need`` or more, removed; None if there is none."""
        at = need + self.size
        if not self.count[at]:
            while at > 1 and (at & 1 or not self.count[at + 1]):
                at >>= 1
            if at == 1:
                return None
            at += 1
            while at < self.size:
                at = 2 * at if self.count[2 * at] else 2 * at + 1
        free = at - self.size
        while at:
            self.count[at] -= 1
            at >>= 1
        return free, self.rows[free].pop()


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Rows of piece numbers; longest pieces first, each into the fullest row that takes it."""
    rows: list[list[int]] = []
    open_rows = FreeLengths(capacity)
    for piece in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        found = open_rows.take(lengths[piece])
        if found is None:
            found = (capacity, len(rows))
            rows.append([])
        free, row = found
        rows[row].append(piece)
        if free > lengths[piece]:
            open_rows.put(free - lengths[piece], row)
    return rows


def _pack(pieces: list[tuple[int | None, int, np.ndarray]], shard: int, block: int, capacity: int) -> Iterator[pa.RecordBatch]:
    pieces.sort(key=lambda p: (p[0] is None, p[0] or 0, p[1]))
    made: list[tuple] = []
    for number, row in enumerate(best_fit_decreasing([len(p[2]) for p in pieces], capacity)):
        cu = np.concatenate([[0], np.cumsum([len(pieces[i][2]) for i in row])]).astype(np.int32)
        ids = np.full(capacity, END_OF_TEXT, ID)
        ids[: cu[-1]] = np.concatenate([pieces[i][2] for i in row])
        made.append((shard, block, number, int(cu[-1]), [pieces[i][0] for i in row], [pieces[i][1] for i in row], cu, cu[:-1], ids.tobytes()))
        if len(made) == 1000:
            yield _batch(made)
            made = []
    if made:
        yield _batch(made)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary()]
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names=names)


def pack_documents(
    docs: DataFrame, vocabulary: str = VOCABULARY, row_tokens: int = ROW_TOKENS, shard_chars: int = SHARD_CHARS
) -> DataFrame:
    """Packed rows of ``row_tokens`` ids over all documents.

    Every document, empty and NULL texts included, is its ids and END_OF_TEXT; one that is
    longer than a row is split into whole rows and a rest, none of it lost: pieces of
    ``doc_ids[i]`` are numbered by ``pieces[i]`` and hold ids ``cu_seqlens[i]`` to
    ``cu_seqlens[i + 1]``. Positions start at 0 again at every one of ``position_resets``.
    ``ids`` are little-endian uint32, padded with END_OF_TEXT behind ``n_tokens``. Repeated
    rows are packed each; other columns are ignored; no documents give no rows.

    Shards follow a hash of id and text, so a task that runs again makes the same rows. One
    that gets more than its share packs it in blocks of ``BLOCK_TOKENS``.
    """
    ship_package(docs.sparkSession)
    docs = pick(docs, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    chars = docs.agg((F.sum(F.length("text")) + 16 * F.count(F.lit(1))).alias("n")).first()["n"] or 0
    shards = max(1, -(-chars // shard_chars))
    # the partition is the shard: one more hash from shard numbers to partitions would double some up
    dealt = docs.repartition(int(shards), F.xxhash64("doc_id", "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, block, pieces, tokens = TaskContext.get().partitionId(), 0, [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = token_ids(text, vocabulary)
                pieces.extend((doc_id, k, ids[at : at + row_tokens]) for k, at in enumerate(range(0, len(ids), row_tokens)))
                tokens += len(ids)
                if tokens >= BLOCK_TOKENS:
                    yield from _pack(pieces, shard, block, row_tokens)
                    block, pieces, tokens = block + 1, [], 0
        if pieces:
            yield from _pack(pieces, shard, block, row_tokens)

    return dealt.mapInArrow(run, SCHEMA)


def position_ids(cu_seqlens: list[int]) -> np.ndarray:
    """Position of every token in its segment."""
    cu = np.asarray(cu_seqlens)
    return (np.arange(cu[-1]) - np.repeat(cu[:-1], np.diff(cu))).astype(np.int32)


def write_binary(packed: DataFrame, folder: str) -> DataFrame:
    """Files of raw ids in ``folder``, which all executors must share: for every shard and block
    ``ids-<shard>-<block>.bin`` (a matrix of uint32), ``.cu.npy`` (segment ends, all rows in a
    line), ``.rows.npy`` (segments per row). Returns the list of files with their rows.

    A file appears under its name when it is complete, so a task that runs again, or twice,
    leaves the same files.
    """
    ship_package(packed.sparkSession)
    os.makedirs(folder, exist_ok=True)

    def save(key, rows):
        import pandas as pd

        rows = rows.sort_values("row")
        name = f"{folder}/ids-{key[0]:06d}-{key[1]:04d}"
        parts = {
            ".bin": b"".join(rows["ids"]),
            ".cu.npy": np.concatenate([np.asarray(c, np.int32) for c in rows["cu_seqlens"]]),
            ".rows.npy": np.asarray([len(c) for c in rows["cu_seqlens"]], np.int32),
        }
        for end, data in parts.items():
            part = f"{name}{end}.{os.getpid()}.part"
            with open(part, "wb") as out:
                out.write(data) if isinstance(data, bytes) else np.save(out, data)
            os.replace(part, name + end)
        return pd.DataFrame({"file": [name + ".bin"], "n_rows": [len(rows)]})

    rows = packed.select("shard", "block", "row", "cu_seqlens", "ids")
    return rows.groupBy("shard", "block").applyInPandas(save, "file string, n_rows long")
