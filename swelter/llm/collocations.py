"""Phrase collocations by direct-address tiling.

Frequent words get ids by their rank, so pairs of frequent words lie in few tiles of the square of
ids. A task counts its pairs tile by tile: crowded tiles by one dense count over the addresses of
the tile, the others by sorting their coordinates. Frequent pairs are ranked again and take the
place of the first word, which counts runs of three words, and once more for four. A run is counted
only where both its parts without the last and without the first word are frequent.

Ranks reach the tasks as a table of at most ``HEAD`` entries. What is frequent beyond it is marked
in a bit table of a fixed size; it gets ids behind the ranks in each task, and lies in the sparse
tiles. Neither limit decides what is counted: the totals are exact and added up by Spark.

A word is known by a 64-bit hash of its language and itself, a longer run by one of its words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from swelter.llm.common import flat, lists, map_arrays, pick, slices, store
from swelter.session import ship_package

#: Least number of occurrences of a phrase, most words of it, phrases reported per language.
LEAST = 30
LONGEST = 4
REPORTED = 2000
#: A phrase goes when a longer one holds this share (in hundredths) of its occurrences.
INSIDE = 80
#: Score of a phrase whose parts never occur without each other is half of this.
SCALE = 2_000_000
NO_LANG = "und"
#: Ranked entries sent to the tasks; bits of the table of the others.
HEAD = 1 << 18
BITS = 1 << 24
#: Ids on a side of a tile; a tile with this share of its addresses met is counted densely.
TILE = 1024
DENSE = 1 / 64
#: Runs, and different words, a task holds before it hands on their counts.
FLUSH = 2_000_000
WORDS_HELD = 200_000
#: Counted runs a task adds up before it hands them on; parts of the table a task of the last step
#: reads at most, where there are more than enough of them for all cores.
COUNTED = 250_000
PARTS = 4

_CUTS = bytes.maketrans(b".,;:!?\x0b\x0c\r\t", b"\n" * 9 + b" ")


def tokens(text: str | None) -> list[bytes]:
    """Lower-case words of a text, with a line feed wherever a piece ends."""
    data = (text or "").encode("utf-8", "surrogatepass").lower().translate(_CUTS)
    return [t for t in data.replace(b"\n", b" \n ").split(b" ") if t]


def word_hash(lang: bytes, word: bytes) -> int:
    return xxhash.xxh64_intdigest(b"%d:%b%b" % (len(lang), lang, word))


def run_hash(words: np.ndarray) -> np.ndarray:
    """Hash of every row of word hashes (uint64); of one word it is the word's."""
    out = words[:, 0].copy()
    for k in range(1, words.shape[1]):
        out = (out ^ (out >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + words[:, k]
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return out


# --- ranks ---


@dataclass
class Ranks:
    """Ids of frequent runs: the rank of those in ``known`` (sorted hashes), a bit for the others."""

    known: np.ndarray
    rank: np.ndarray
    bits: np.ndarray

    def of(self, hashes: np.ndarray) -> np.ndarray:
        """Rank; -1 for a hash that may be frequent, -2 for one that is not."""
        out = np.where(self.bits[(hashes >> np.uint64(6)) % np.uint64(len(self.bits))] >> (hashes & np.uint64(63)) & np.uint64(1), -1, -2)
        if len(self.known):
            at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
            out = np.where(self.known[at] == hashes, self.rank[at], out)
        return out


def ranks(frequent: DataFrame, head: int, bits: int) -> Ranks:
    """``frequent``: h (long) and n. The head is ranked by n; of all others only a bit is sent."""
    first = frequent.orderBy(F.desc("n"), "h").limit(head).select("h", "n").toArrow()
    hashes = first.column("h").to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    table = np.zeros(bits // 64, np.uint64)
    if len(hashes) == head:
        least = first.column("n").to_numpy()[-1]
        rest = frequent.where(F.col("n") <= F.lit(int(least)))
        slot = F.pmod(F.shiftrightunsigned("h", 6), F.lit(len(table)))
        words = rest.select(slot.alias("slot"), F.expr("shiftleft(1L, cast(h & 63 as int))").alias("bit")).groupBy("slot").agg(F.expr("bit_or(bit)").alias("bits"))
        found = words.toArrow()
        table[found.column("slot").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return Ranks(hashes[order], order.astype(np.int64), table)


# --- words ---


def word_counts(docs: DataFrame) -> DataFrame:
    """lang, word, h and n of every word of ``docs`` (lang and text, no NULL)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from collections import Counter

        held: dict[str, Counter] = {}

        def out() -> pa.RecordBatch:
            rows = [(lang, w, word_hash(lang.encode(), w), n) for lang, c in held.items() for w, n in c.items() if w != b"\n"]
            lang, word, h, n = zip(*rows) if rows else ((),) * 4
            hashes = np.array(h, np.uint64).view(np.int64)
            words = pa.array([w.decode("utf-8", "replace") for w in word], pa.string())
            return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), words, pa.array(hashes), pa.array(n, pa.int64())], names=["lang", "word", "h", "n"])

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                held.setdefault(lang, Counter()).update(tokens(text))
            if sum(map(len, held.values())) > WORDS_HELD:
                yield out()
                held = {}
        if held:
            yield out()

    ship_package(docs.sparkSession)
    counted = docs.select("lang", "text").mapInArrow(run, "lang string, word string, h long, n long")
    return counted.groupBy("lang", "word", "h").agg(F.sum("n").alias("n"))


def encode(docs: DataFrame, words: Ranks) -> DataFrame:
    """Every document as ids: ranks of frequent words, -1 where a run must end, and -2 - k for the
    k-th hash of ``rare``, the words beyond the ranks that may be frequent. Columns ids, rare."""
    sent = docs.sparkSession.sparkContext.broadcast(words)

    def run(texts: pa.Array, langs: pa.Array) -> list[pa.Array]:
        seen: dict[str, dict[bytes, int]] = {}
        ids, rare, sizes, rare_sizes = [], [], [], []
        for lang, text in zip(langs.to_pylist(), texts.to_pylist()):
            found, known = tokens(text), seen.setdefault(lang, {b"\n": -(1 << 62)})
            new = [w for w in set(found) if w not in known]
            if new:
                hashes = np.array([word_hash(lang.encode(), w) for w in new], np.uint64)
                known.update(zip(new, sent.value.of(hashes).tolist()))
            own = np.fromiter(map(known.__getitem__, found), np.int64, len(found))
            if (own == -1).any():
                at = np.flatnonzero(own == -1)
                hashes, place = np.unique(np.array([word_hash(lang.encode(), found[i]) for i in at.tolist()], np.uint64), return_inverse=True)
                own = np.where(own < 0, -1, own)
                own[at] = -2 - place
            else:
                hashes = np.empty(0, np.uint64)
                own = np.where(own < 0, -1, own)
            ids.append(own.astype(np.int32))
            rare.append(hashes.view(np.int64))
            sizes.append(len(own))
            rare_sizes.append(len(hashes))
        return [lists(np.concatenate([*ids, np.empty(0, np.int32)]), np.array(sizes)), lists(np.concatenate([*rare, np.empty(0, np.int64)]), np.array(rare_sizes))]

    return map_arrays(docs.select("lang", "text"), run, "ids array<int>, rare array<bigint>", ("text", "lang"))


# --- tiles ---


def count_tiles(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """left, right and count of the different pairs of ids, tile by tile."""
    rows, columns = left // TILE, right // TILE
    tile = rows * (columns.max(initial=0) + 1) + columns
    order = np.argsort(tile, kind="stable")
    left, right, tile = left[order], right[order], tile[order]
    cuts = np.flatnonzero(np.diff(tile)) + 1
    starts, ends = np.append(0, cuts), np.append(cuts, len(tile))
    crowded = (ends - starts) >= DENSE * TILE * TILE
    out = []
    for lo, hi in zip(starts[crowded].tolist(), ends[crowded].tolist()):
        base_l, base_r = left[lo] // TILE * TILE, right[lo] // TILE * TILE
        n = np.bincount((left[lo:hi] - base_l) * TILE + right[lo:hi] - base_r, minlength=TILE * TILE)
        at = np.flatnonzero(n)
        out.append((at // TILE + base_l, at % TILE + base_r, n[at]))
    sparse = np.repeat(~crowded, ends - starts)
    if sparse.any():
        x, y = left[sparse], right[sparse]
        wide = int(y.max()) + 1
        code = np.sort(x * wide + y)
        at = np.flatnonzero(np.diff(code, prepend=-1))
        out.append((code[at] // wide, code[at] % wide, np.diff(np.append(at, len(code)))))
    return tuple(np.concatenate(c) for c in zip(*out)) if out else (np.empty(0, np.int64),) * 3


def _ids(hashes: np.ndarray, rank: np.ndarray, head: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of runs that may be frequent: their rank, or one behind all ranks; and the hashes of the latter."""
    tail = rank < 0
    others, place = np.unique(hashes[tail], return_inverse=True)
    ids = rank.copy()
    ids[tail] = head + place
    return ids, others


def add_up(rows: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different rows and the sums of their counts. Rows are compared as a whole; should hashes be
    equal, a row may come twice, each time with a part of its count."""
    order = np.argsort(run_hash(rows), kind="stable")
    rows, n = rows[order], n[order]
    at = np.flatnonzero(np.append(True, (rows[1:] != rows[:-1]).any(axis=1))[: len(rows)])
    return rows[at], np.add.reduceat(n, at) if len(at) else n


def longer_tasks(encoded: DataFrame) -> DataFrame:
    """The documents in tasks of up to ``PARTS`` parts, as long as two are left for every core."""
    parts = encoded.rdd.getNumPartitions()
    return encoded.coalesce(max(2 * encoded.sparkSession.sparkContext.defaultParallelism, -(-parts // PARTS)))


def task_counts(encoded: DataFrame, words: Ranks, shorter: Ranks, size: int, flush: int = FLUSH) -> DataFrame:
    """``run_counts`` as the tasks hand them on, before Spark adds them up.

    A task that reads more gives fewer rows if its runs repeat. Those of the last size lie in
    frequent runs only and do so most: there a task reads several parts of the table. Of shorter
    runs most are met once in a task, and longer tasks would only fill memory.
    """
    names = [f"w{k}" for k in range(size)]
    sent = encoded.sparkSession.sparkContext.broadcast((words, shorter))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, shorter = sent.value
        by_rank = np.empty(len(words.known), np.uint64)
        by_rank[words.rank] = words.known
        held: list[tuple] = []
        counted: list[tuple] = []

        def tally() -> None:
            rows, rank_l, rank_r = (np.concatenate(x) for x in zip(*held))
            held.clear()
            left, others_l = _ids(run_hash(rows[:, :-1]), rank_l, len(shorter.known))
            right, others_r = _ids(rows[:, -1], rank_r, len(words.known))
            del rank_l, rank_r
            l, r, n = count_tiles(left, right)
            # words of a run: those of any occurrence of its first part, and its last word
            first = np.full(len(shorter.known) + len(others_l), -1)
            first[left] = np.arange(len(left))
            lasts = np.concatenate([by_rank, others_r])
            counted.append((np.column_stack([rows[first[l], :-1], lasts[r]]), n.astype(np.int64)))
            if len(counted) > 1:
                del rows, left, right, first
                counted[:] = [add_up(*(np.concatenate(x) for x in zip(*counted)))]

        def out() -> pa.RecordBatch:
            whole, n = counted.pop()
            return pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)) for c in whole.T.copy()] + [pa.array(n)], names=[*names, "n"])

        count = 0
        for batch in (part for whole in batches for part in slices(whole, whole.column("ids"))):
            (ids, sizes), (rare, rare_sizes) = flat(batch.column("ids")), flat(batch.column("rare"))
            if not len(ids):
                continue
            of = np.repeat(np.arange(len(sizes)), sizes)
            ids = ids.astype(np.int64)
            begin = np.cumsum(rare_sizes) - rare_sizes
            h = np.zeros(len(ids), np.uint64)
            head, tail = ids >= 0, ids < -1
            h[head] = by_rank[ids[head]]
            h[tail] = rare.view(np.uint64)[begin[of[tail]] - 2 - ids[tail]]
            end = len(ids) - size + 1
            if end <= 0:
                continue
            whole = np.ones(end, bool)
            for k in range(size):
                whole &= ids[k : end + k] != -1
            whole &= of[:end] == of[size - 1 :]
            at = np.flatnonzero(whole)
            rows = np.column_stack([h[at + k] for k in range(size)])
            rank_l = shorter.of(run_hash(rows[:, :-1]))
            keep = (rank_l > -2) & (shorter.of(run_hash(rows[:, 1:])) > -2)
            rank_r = np.where(ids[at + size - 1] >= 0, ids[at + size - 1], -1)
            held.append((rows[keep], rank_l[keep], rank_r[keep]))
            count += int(keep.sum())
            if count > flush // size:
                tally()
                count = 0
                if len(counted[0][1]) > COUNTED:
                    yield out()
        if count:
            tally()
        if counted:
            yield out()

    ship_package(encoded.sparkSession)
    read = longer_tasks(encoded) if size == LONGEST else encoded
    return read.mapInArrow(run, ", ".join(f"{c} long" for c in (*names, "n")))


def run_counts(encoded: DataFrame, words: Ranks, shorter: Ranks, size: int) -> DataFrame:
    """The hashes of the words of runs of ``size`` words, a column each, and n, the exact number
    of occurrences of every run whose two parts of ``size - 1`` words are frequent."""
    names = [f"w{k}" for k in range(size)]
    return task_counts(encoded, words, shorter, size).groupBy(*names).agg(F.sum("n").alias("n"))


def _named(runs: DataFrame) -> DataFrame:
    """h, words and n of runs whose words are columns of their own."""
    names = tuple(c for c in runs.columns if c != "n")

    def run(*words: pa.Array) -> list[pa.Array]:
        whole = np.column_stack([w.to_numpy() for w in words])
        return [pa.array(run_hash(whole.view(np.uint64)).view(np.int64)), lists(whole.ravel(), np.full(len(whole), len(names)))]

    return map_arrays(runs, run, "h long, words array<bigint>", names).select("h", "words", "n")


# --- phrases ---


def frequent_runs(docs: DataFrame, head: int = HEAD, bits: int = BITS, least: int = LEAST) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Runs of one to ``LONGEST`` words with ``least`` occurrences or more (h, words, n), the
    spelling of their words (h, lang, word), and the number of words per language (lang, total)."""
    own = pick(docs, "lang", "text").select(F.coalesce("lang", F.lit(NO_LANG)).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    counted = store(word_counts(own))
    doubled = counted.groupBy("h").count().where("count > 1")
    if not doubled.isEmpty():
        raise ValueError("two words have one hash")
    totals = counted.groupBy("lang").agg(F.sum("n").alias("total"))
    often = counted.where(F.col("n") >= least)
    spelled = store(often.select("h", "lang", "word", "n"))
    words = ranks(spelled, head, bits)
    encoded = store(encode(own, words))
    runs = spelled.select("h", F.array("h").alias("words"), "n")
    shorter = words
    for size in range(2, LONGEST + 1):
        found = store(_named(run_counts(encoded, words, shorter, size).where(F.col("n") >= least)))
        runs = runs.unionByName(found)
        if size < LONGEST:
            shorter = ranks(found, head, bits)
    return runs, spelled.select("h", "lang", "word"), store(totals)


def _scored(runs: DataFrame) -> DataFrame:
    """The phrases among the runs with a, and l, r and score of the cut that counts."""
    candidates = runs.where(F.size("words") > 1)
    cuts = candidates.select("words", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    cuts = cuts.withColumn("first", F.slice("words", F.lit(1), F.col("k"))).withColumn("rest", F.slice("words", F.col("k") + 1, F.size("words")))
    known = runs.select("words", "n")
    cuts = cuts.join(known.toDF("first", "l"), "first").join(known.toDF("rest", "r"), "rest")
    exact = f"(cast({SCALE} as decimal(8,0)) * cast(a as decimal(19,0))) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))"
    lowest = F.min(F.struct(F.expr(exact).alias("score"), "k", "l", "r")).alias("cut")
    return cuts.groupBy("words", "a").agg(lowest).select("words", "a", "cut.l", "cut.r", "cut.score")


def _covered(candidates: DataFrame) -> DataFrame:
    """words of the phrases of which a longer candidate holds nearly all occurrences."""
    longer = candidates.where(F.size("words") > 2).select(F.col("words").alias("long"), F.col("a").alias("most"))
    parts = [
        F.slice("long", at, size)
        for size in range(2, LONGEST) for at in range(1, LONGEST - size + 2)
    ]
    inner = longer.select("most", F.size("long").alias("size"), F.explode(F.array(*parts)).alias("words"))
    inner = inner.where((F.size("words") > 1) & (F.size("words") < F.col("size"))).groupBy("words").agg(F.max("most").alias("most"))
    return candidates.join(inner, "words").where(F.expr(f"100 * cast(most as decimal(19,0)) >= {INSIDE} * cast(a as decimal(19,0))")).select("words")


def collocations(docs: DataFrame, head: int = HEAD, bits: int = BITS, least: int = LEAST) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of the ``REPORTED`` best phrases of every language.

    A is the number of occurrences of the phrase, l and r those of the parts of the cut that counts,
    n the words of the language, score SCALE * a / (l + r) rounded down. NULL texts are empty, a
    NULL language is ``NO_LANG``. Repeated rows count each; tables without phrases give no rows;
    other columns are ignored.
    """
    runs, spelled, totals = frequent_runs(docs, head, bits, least)
    scored = store(_scored(runs))
    kept = scored.join(_covered(scored.select("words", "a")), "words", "left_anti")
    # texts of the words; a phrase is its words in order
    each = kept.select("words", F.posexplode("words").alias("at", "h")).join(spelled, "h")
    texts = each.groupBy("words").agg(F.min("lang").alias("lang"), F.sort_array(F.collect_list(F.struct("at", "word"))).alias("w"))
    phrase = F.array_join(F.col("w.word"), " ")
    named = kept.join(texts.select("words", "lang", phrase.alias("phrase")), "words").join(totals, "lang")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = named.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= REPORTED)
    return best.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("total").alias("n"), F.col("score").cast("long").alias("score"))
