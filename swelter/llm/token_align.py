"""Alignment of the tokens of two tokenizers over the same bytes.

Both sides cut the same bytes, so a token is a byte range. Per batch, keyed by document, an as-of
join finds for every token start the covering token of the other side; both directions together
are all overlaps. Overlapping tokens that end together are linked, and their ends cut a document
into groups, the smallest parts that both sides tokenise on their own.

How often a pair of ids is linked is counted over the whole corpus. Tasks count their own pairs
first. The ``HEAD`` most frequent pairs are sent to the tasks that score the documents; the
others, which a document holds few of, are joined.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swelter.llm.common import flat, lists, map_arrays, pick, store
from swelter.llm.packing import PATTERN
from swelter.session import ship_package

#: Vocabulary files: A is a byte-level BPE, B one of pieces with byte fallback that puts a space before the text.
VOCABULARY_A = "/opt/tokenizers/byte_bpe_50k.json"
VOCABULARY_B = "/opt/tokenizers/piece_bpe_32k.model"
#: Characters of the texts a task aligns at a time; a longer text is aligned alone.
ALIGNED = 1 << 17
#: Pair codes a task holds before it counts them.
FLUSH_CODES = 4_000_000
#: Pairs that are sent to all tasks, at 17 bytes each.
HEAD = 1 << 18
#: A pair of ids as one number.
SIDE = 1 << 31


def _byte_of_char() -> dict[str, int]:
    """How byte-level vocabularies spell bytes: those with a visible character by it, the others from U+0100 on."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(seen)]
    return {chr(b): b for b in seen} | {chr(0x100 + i): b for i, b in enumerate(rest)}


@dataclass(frozen=True)
class Pair:
    """Both tokenizers, the bytes of their tokens and the lengths of these."""

    a: tiktoken.Encoding
    b: sentencepiece.SentencePieceProcessor
    bytes_a: list[bytes]
    bytes_b: list[bytes]
    len_a: np.ndarray
    len_b: np.ndarray


@lru_cache(maxsize=2)
def load_pair(path_a: str = VOCABULARY_A, path_b: str = VOCABULARY_B) -> Pair:
    with open(path_a, encoding="utf-8") as f:
        found = json.load(f)
    special = {t["id"] for t in found.get("added_tokens", ())}
    spelled = _byte_of_char()
    vocabulary = {bytes(spelled[c] for c in t): i for t, i in found["model"]["vocab"].items() if i not in special}
    # merges are tried in the order of the ids they make, so the ids are the ranks
    a = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=vocabulary, special_tokens={})
    bytes_a = [b""] * (max(vocabulary.values()) + 1)
    for token, i in vocabulary.items():
        bytes_a[i] = token
    b = sentencepiece.SentencePieceProcessor(model_file=path_b)
    bytes_b = [
        bytes([int(p[3:5], 16)]) if b.IsByte(i) else p.replace("▁", " ").encode()
        for i, p in ((i, b.IdToPiece(i)) for i in range(b.GetPieceSize()))
    ]
    return Pair(a, b, bytes_a, bytes_b, *(np.array([len(t) for t in side], np.int64) for side in (bytes_a, bytes_b)))


def encode(texts: list, pair: Pair) -> tuple[list[list[int]], list[list[int]]]:
    """Ids of both sides; none where the text is NULL or empty, or where a side does not give back its bytes."""
    sides_b = pair.b.encode([t or "" for t in texts], num_threads=1)
    out_a, out_b = [], []
    for text, ids_b in zip(texts, sides_b):
        ids_a = pair.a.encode_ordinary(" " + text) if text else []
        data = (" " + text).encode() if text else b""
        same = all(b"".join(map(t.__getitem__, ids)) == data for t, ids in ((pair.bytes_a, ids_a), (pair.bytes_b, ids_b)))
        out_a.append(ids_a if same else [])
        out_b.append(ids_b if same else [])
    return out_a, out_b


def overlaps(key_a: np.ndarray, key_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (a, b) of all tokens that overlap, in order.

    Keys are the document (high bits) and the byte offset in it where a token starts, in order.
    Both sides of a document start at 0, so no token finds one of another document.
    """
    a = pd.DataFrame({"key": key_a, "a": np.arange(len(key_a))})
    b = pd.DataFrame({"key": key_b, "b": np.arange(len(key_b))})
    both = [pd.merge_asof(a, b, on="key"), pd.merge_asof(b, a, on="key")]
    # two sorted runs; a pair that starts together is in both
    code = np.sort(np.concatenate([d["a"].to_numpy() * len(b) + d["b"].to_numpy() for d in both]), kind="stable")
    code = code[np.diff(code, prepend=-1) > 0]
    return code // max(1, len(b)), code % max(1, len(b))


def _align_chunk(texts: list, pair: Pair) -> list[tuple[np.ndarray, np.ndarray]]:
    """ids of A and B, places of overlapping tokens and of linked ones (each a pair of arrays): values and sizes per text."""
    ids, doc, key, end, first = [], [], [], [], []
    for side, lengths in zip(encode(texts, pair), (pair.len_a, pair.len_b)):
        sizes = np.array([len(x) for x in side], np.int64)
        flat_ids = np.fromiter(chain.from_iterable(side), np.int32, int(sizes.sum()))
        stop = np.cumsum(lengths[flat_ids])
        ids.append((flat_ids, sizes))
        doc.append(np.repeat(np.arange(len(texts)), sizes))
        first.append(np.concatenate([[0], np.cumsum(sizes)]))
        # offsets count on from text to text, equally on both sides
        end.append(stop)
        begin = stop - lengths[flat_ids]
        key.append((doc[-1] << 40) + begin - np.repeat(begin[first[-1][:-1][sizes > 0]], sizes[sizes > 0]))
    a, b = overlaps(*key)
    linked = end[0][a] == end[1][b]
    out = list(ids)
    for keep in (slice(None), linked):
        x, y = a[keep], b[keep]
        of = doc[0][x]
        sizes = np.bincount(of, minlength=len(texts))
        out += [((x - first[0][of]).astype(np.int32), sizes), ((y - first[1][of]).astype(np.int32), sizes)]
    return out


def align_tokens(
    docs: DataFrame, path_a: str = VOCABULARY_A, path_b: str = VOCABULARY_B, keep: tuple[str, ...] = ("doc_id",),
    then: Callable[..., list[pa.Array]] | None = None, out: str | None = None,
) -> DataFrame:
    """``keep`` columns and, for every document, arrays of int:

    a_ids, b_ids: tokens of a space and the text; over_a, over_b: places (from 0) of tokens that
    overlap, pair by pair; link_a, link_b: those that also end together. NULL and empty texts, and
    texts that a side does not spell byte by byte (it normalises them), have empty arrays. Repeated
    rows are aligned each; an empty table gives an empty result; other columns are ignored.

    Strings of special tokens are plain text. A text is aligned whole, so memory follows the longest.
    With ``then``, the columns ``out`` that it makes of these six arrays in the same task take their place.
    """

    def align(column: pa.Array) -> list[pa.Array]:
        pair = load_pair(path_a, path_b)
        made = [lists(*m) for m in _align_chunk(column.to_pylist(), pair)]
        return then(*made) if then else made

    names = ("a_ids", "b_ids", "over_a", "over_b", "link_a", "link_b")
    out = out or ", ".join(f"{n} array<int>" for n in names)
    return map_arrays(pick(docs, *keep, "text"), align, out, ("text",), most=ALIGNED)


@lru_cache(maxsize=1)
def _spellings(ids: int) -> np.ndarray:
    """Every id followed by ',', by '|' and by ';'."""
    return np.array([b"%d%c" % (i, mark) for mark in b",|;" for i in range(ids)], object)


def _group_texts(values: list[np.ndarray], last: list[np.ndarray], sizes: list[np.ndarray]) -> list[bytes]:
    """The groups of every document, spelled. ``last`` marks the tokens that end a group."""
    # every token of a document lies in a group, so groups count on alike on both sides
    group = [np.cumsum(x) - x for x in last]
    order = np.argsort(np.concatenate([2 * group[0], 2 * group[1] + 1]), kind="stable")
    many = 1 << max(16, int(max((v.max(initial=0) for v in values))).bit_length())
    mark = np.concatenate([last[0], 2 * last[1]])
    words = _spellings(many)[(mark * many + np.concatenate(values))[order]].tolist()
    ends = np.concatenate([[0], np.cumsum(sizes[0] + sizes[1])]).tolist()
    return [b"".join(words[i:j])[:-1] for i, j in zip(ends, ends[1:])]


def _digest(a_ids: pa.Array, b_ids: pa.Array, over_a: pa.Array, over_b: pa.Array, link_a: pa.Array, link_b: pa.Array) -> list[pa.Array]:
    values, sizes = (list(x) for x in zip(*(flat(c) for c in (a_ids, b_ids, link_a, link_b))))
    n = len(sizes[0])
    of = np.repeat(np.arange(n), sizes[2])
    ids, last = [], []
    for side in (0, 1):
        at = values[2 + side] + (np.cumsum(sizes[side]) - sizes[side])[of]
        ids.append(values[side][at].astype(np.int64))
        last.append(np.zeros(len(values[side]), np.int64))
        last[side][at] = 1
    shas = [hashlib.sha256(t).hexdigest() if t else "" for t in _group_texts(values[:2], last, sizes[:2])]
    # the pairs of every document, each once
    wide = [int(i.max(initial=0)) + 1 for i in ids]
    key = np.sort((of * wide[0] + ids[0]) * wide[1] + ids[1])
    at = np.flatnonzero(np.diff(key, prepend=-1))
    times = np.diff(np.append(at, len(key))).astype(np.int32)
    pair, b = key[at] // wide[1], key[at] % wide[1]
    per_doc = np.bincount(pair // wide[0], minlength=n)
    counts = [pa.array(s.astype(np.int64)) for s in (sizes[0], sizes[1], sizes[2], sizes[2])]
    return [*counts, pa.array(shas, pa.string()), lists(pair % wide[0] * SIDE + b, per_doc), lists(times, per_doc)]


def pair_counts(digests: DataFrame) -> DataFrame:
    """pair and n, the number of links of the corpus that hold it, from the columns pairs and times."""

    def run(batches):
        codes, times, held = [], [], 0

        def out():
            code = np.concatenate(codes)
            order = np.argsort(code)
            code, at = code[order], np.flatnonzero(np.diff(code[order], prepend=-1))
            found, n = code[at], np.add.reduceat(np.concatenate(times)[order].astype(np.int64), at)
            return pa.RecordBatch.from_arrays([pa.array(found), pa.array(n)], names=["pair", "n"])

        for batch in batches:
            codes.append(flat(batch.column("pairs"))[0])
            times.append(flat(batch.column("times"))[0])
            held += len(codes[-1])
            if held > FLUSH_CODES:
                yield out()
                codes, times, held = [], [], 0
        if held:  # rows without pairs alone give none
            yield out()

    ship_package(digests.sparkSession)
    return digests.select("pairs", "times").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def alignment_digest(docs: DataFrame, path_a: str = VOCABULARY_A, path_b: str = VOCABULARY_B, head: int = HEAD) -> DataFrame:
    """Per document the numbers of its alignment, and how its links stand in the corpus.

    doc_id, n_a, n_b, n_groups, n_links; n_best: links whose pair is the most frequent one of its B
    id; count_sum: over the links, how often the corpus holds their pair; groups_sha256. Texts
    without an alignment have zeros and ''.
    """
    made = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<bigint>, times array<int>"
    # one worker per core, and no arrays of tokens between two
    digests = align_tokens(docs, path_a, path_b, then=_digest, out=made)
    digests = store(digests.withColumn("_row", F.monotonically_increasing_id()))

    counts = store(pair_counts(digests)).withColumn("b", F.col("pair") % SIDE)
    highest = counts.groupBy("b").agg(F.max("n").alias("most"))
    stats = store(counts.join(highest, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best")))
    top = stats.orderBy(F.desc("n"), "pair").limit(head).toArrow()
    order = np.argsort(top.column("pair").to_numpy())
    known = [top.column(c).to_numpy()[order] for c in ("pair", "n", "best")]
    sent = docs.sparkSession.sparkContext.broadcast(known)

    def score(pairs: pa.Array, times: pa.Array) -> list[pa.Array]:
        (code, sizes), (often, _) = flat(pairs), flat(times)
        known, n, best = sent.value
        of = np.repeat(np.arange(len(sizes)), sizes)
        at = np.minimum(np.searchsorted(known, code), max(0, len(known) - 1))
        hit = known[at] == code if len(known) else np.zeros(len(code), bool)
        sums = [np.zeros(len(sizes), np.int64) for _ in range(2)]
        np.add.at(sums[0], of[hit], often[hit] * best[at[hit]])
        np.add.at(sums[1], of[hit], often[hit] * n[at[hit]])
        rest = np.bincount(of[~hit], minlength=len(sizes))
        return [*map(pa.array, sums), lists(code[~hit], rest), lists(often[~hit], rest)]

    scored = map_arrays(digests, score, "n_best long, count_sum long, rare array<bigint>, often array<int>", ("pairs", "times"))
    scored = store(scored)
    rare = scored.select("_row", F.explode(F.arrays_zip("rare", "often")).alias("x")).select("_row", F.col("x.rare").alias("pair"), "x.often")
    more = rare.join(stats, "pair").groupBy("_row").agg(
        F.sum(F.col("often") * F.col("best").cast("long")).alias("more_best"), F.sum(F.col("often") * F.col("n")).alias("more_sum")
    )
    whole = scored.join(more, "_row", "left")
    total = lambda a, b: (F.col(a) + F.coalesce(b, F.lit(0))).alias(a)
    return whole.select("doc_id", "n_a", "n_b", "n_groups", "n_links", total("n_best", "more_best"), total("count_sum", "more_sum"), "groups_sha256")
