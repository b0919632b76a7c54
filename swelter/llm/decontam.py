"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

The windows of an item are all its runs of ``WINDOW`` characters, or the whole item if it is
shorter. A window of length m that occurs in a text with at most k edits shares
m + 1 - q (k + 1) of its q-grams with it, all on diagonals (place in the text minus place in
the item) at most k to either side of one. So shared q-grams are counted in overlapping
diagonal bands, a sum along the band gives the count of every window, windows that reach the
bound are aligned within the band, and those within the budget count.

The benchmark is a stated query set: it goes over all documents in blocks of bounded size. Long
items are cut into overlapping pieces, equal pieces of an item kept once. Where texts and pieces
share very many q-grams (runs of one character, say), pieces and text are halved until the places
shared are few enough to be held at once.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swelter.llm.common import map_text, pick

Q = 12
WINDOW = 96
EDIT_RATE = 0.05
#: Characters of benchmark items that are sent to the tasks at once.
BLOCK_CHARS = 2_000_000
#: Characters of a text that are looked at at once.
CHUNK = 1 << 20
#: Characters of a piece of a longer item, and shared places that are held at once.
PIECE = 1024
MOST_PLACES = 2_000_000
#: Windows that are aligned at once.
_ALIGNED = 256
_BITS = 22
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SPREAD = np.uint64(0xD6E8FEB86659FD93)


def _letters() -> np.ndarray:
    """Lower-case letter or digit for every character below 65536, a space for all others."""
    out = np.full(1 << 16, 32, np.uint32)
    for c in range(1 << 16):
        if chr(c).isalnum():
            low = chr(c).lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


_TABLE = _letters()


def normal(text: str | None) -> np.ndarray:
    """Codes of a text: letters and digits in lower case, one space for whatever lies between."""
    codes = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.where(codes < 1 << 16, _TABLE[np.minimum(codes, (1 << 16) - 1)], codes)
    gap = codes == 32
    keep = ~gap
    keep[1:] |= gap[1:] & ~gap[:-1]
    codes = codes[keep]
    if len(codes) and codes[-1] == 32:
        codes = codes[:-1]
    return codes


def grams(codes: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every run of Q codes; wraps around like any unsigned product."""
    if len(codes) < Q:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        h, size = codes.astype(np.uint64) * _SPREAD, 1
        h ^= h >> np.uint64(29)
        out, done, power = None, 0, _BASE
        while True:
            if Q & size:
                out = h if out is None else out[: len(h) - done] * power + h[done:] if done + size <= Q else out
                out = out[: len(codes) - done - size + 1]
                done += size
            if done == Q:
                return out
            h, power = h[: len(h) - size] * power + h[size:], power * power
            size *= 2


@dataclass
class Block:
    """Items of one block in pieces: their codes, where their q-grams lie, and a bit table of the hashes.

    ``order`` sorts by q-gram and piece at once. ``short`` are items without a q-gram, by all their codes."""

    window: int
    ids: list[int]
    codes: list[np.ndarray]
    whole: list[int]
    keys: np.ndarray
    order: np.ndarray
    pieces: np.ndarray
    places: np.ndarray
    bits: np.ndarray
    short: dict[bytes, list[int]]
    _firsts: dict[int, np.ndarray] = field(default_factory=dict)

    def firsts(self, piece: int) -> np.ndarray:
        """Starts of the windows of a piece, of equal ones the first: whatever equals it lies on other diagonals of that one."""
        if piece not in self._firsts:
            views = np.lib.stride_tricks.sliding_window_view(self.codes[piece], self.whole[piece])
            self._firsts[piece] = np.sort(np.unique(views, axis=0, return_index=True)[1])
        return self._firsts[piece]

    @classmethod
    def of(cls, rows: list[tuple[int, str]], window: int = WINDOW) -> Block:
        ids, codes, whole, short = [], [], [], {}
        for i, text in rows:
            own, seen = normal(text), set()
            if 0 < len(own) < Q:
                short.setdefault(own.tobytes(), []).append(i)
            step = max(1, PIECE - window)
            for at in range(0, max(1, len(own) - window), step) if len(own) > PIECE else [0]:
                piece = own[at : at + PIECE]
                if len(piece) >= Q and piece.tobytes() not in seen:
                    seen.add(piece.tobytes())
                    ids.append(i)
                    codes.append(piece)
                    whole.append(min(window, len(own)))
        hashes = [grams(c) for c in codes]
        flat = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        pieces = np.repeat(np.arange(len(codes)), [len(h) for h in hashes])
        places = np.concatenate([np.arange(len(h)) for h in hashes]) if hashes else np.empty(0, np.int64)
        order = np.argsort(flat, kind="stable")
        keys, number = np.unique(flat[order], return_inverse=True)
        bits = np.zeros(1 << _BITS, bool)
        bits[_slot(keys)] = True
        return cls(window, ids, codes, whole, keys, number * max(1, len(codes)) + pieces[order], pieces[order], places[order], bits, short)


def _slot(hashes: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((hashes * _SPREAD) >> np.uint64(64 - _BITS)).astype(np.int64)


def windows(length: int, window: int = WINDOW) -> list[tuple[int, int]]:
    """Start and end of the windows of an item, one at every place."""
    m = min(window, length)
    return [(s, s + m) for s in range(length - m + 1)]


def budget(m: int) -> int:
    """Edits allowed in a window; fewer where the lemma would ask for no shared q-gram."""
    return max(0, min(int(EDIT_RATE * m), (m - Q) // Q))


def least_edits(pattern: np.ndarray, starts: np.ndarray, m: int, text: np.ndarray, diagonals: tuple[int, int], k: int) -> int:
    """Fewest edits of a window of ``m`` at one of the ``starts`` against any part of the text, aligned within the band; k + 1 if over k."""
    lo, hi = diagonals[0] - k, diagonals[1] + k
    width, big = hi - lo + 1, k + 1
    if not len(text):
        return big
    # one row per window; a column is a diagonal
    at = starts[:, None] + np.arange(lo, hi + 1)
    row = np.where((at >= 0) & (at <= len(text)), 0, big)
    steps = np.arange(width)
    for i in range(m):
        inside = (at >= 0) & (at < len(text))
        differ = text[np.clip(at, 0, len(text) - 1)] != pattern[starts + i][:, None]
        step = np.where(inside, row + differ, big)
        step[:, :-1] = np.minimum(step[:, :-1], row[:, 1:] + 1)
        at = at + 1
        step[(at < 0) | (at > len(text))] = big
        # a gap in the pattern costs one per column: smallest of what stands to the left plus the distance
        row = np.minimum(np.minimum.accumulate(step - steps, axis=1) + steps, big)
        alive = (row <= k).any(axis=1)
        if not alive.all():
            if not alive.any():
                return big
            row, at, starts = row[alive], at[alive], starts[alive]
    return int(row.min())


def _found(codes: np.ndarray, block: Block, done: set[int]) -> set[int]:
    """Items of the block with a window in these codes within its budget; those ``done`` are not looked for."""
    hashes = grams(codes)
    at = np.flatnonzero(block.bits[_slot(hashes)])
    if not len(at) or not len(block.keys):
        return set()
    key = np.minimum(np.searchsorted(block.keys, hashes[at]), len(block.keys) - 1)
    real = block.keys[key] == hashes[at]
    out = set(done)
    _search(codes, at[real], key[real], block, 0, len(block.codes), out)
    return out - done


def _search(codes: np.ndarray, at: np.ndarray, key: np.ndarray, block: Block, first: int, last: int, out: set[int]) -> None:
    """Add to ``out`` the items of the pieces ``first`` to ``last`` (exclusive) that occur; ``at``: places of the text whose q-gram is ``key``."""
    if not len(at) or all(block.ids[i] in out for i in range(first, last)):
        return
    n = len(block.codes)
    start, stop = (np.searchsorted(block.order, key * n + end) for end in (first, last))
    many = stop - start
    held = int(many.sum())
    lap = 2 * block.window
    if held > MOST_PLACES and last - first > 1:
        middle = (first + last) // 2
        _search(codes, at, key, block, first, middle, out)
        _search(codes, at, key, block, middle, last, out)
        return
    if held > MOST_PLACES and len(codes) > 4 * lap:
        half = len(codes) // 2
        early, late = at < half + lap, at >= half - lap
        _search(codes[: half + lap + Q], at[early], key[early], block, first, last, out)
        _search(codes[half - lap :], at[late] - (half - lap), key[late], block, first, last, out)
        return
    entry = np.repeat(start - np.append(0, np.cumsum(many)[:-1]), many) + np.arange(held)
    piece, place = block.pieces[entry], block.places[entry]
    diagonal = np.repeat(at, many) - place
    # a piece needs at least the bound of a window, whatever the diagonal
    total = np.bincount(piece - first, minlength=last - first)
    order = np.argsort(piece, kind="stable")
    ends = np.searchsorted(piece[order], np.arange(first, last + 1))
    for i in range(first, last):
        m = block.whole[i]
        if not total[i - first] or block.ids[i] in out or total[i - first] < _bound(m):
            continue
        mine = order[ends[i - first] : ends[i - first + 1]]
        if _window_occurs(codes, block, i, place[mine], diagonal[mine]):
            out.add(block.ids[i])


def _bound(m: int) -> int:
    return max(1, m + 1 - Q * (budget(m) + 1))


def _window_occurs(codes: np.ndarray, block: Block, piece: int, p: np.ndarray, d: np.ndarray) -> bool:
    """True when a window of the piece occurs within its budget, given the places and diagonals of all shared q-grams."""
    pattern, m = block.codes[piece], block.whole[piece]
    k, bound = budget(m), _bound(m)
    reach = 2 * k + 1
    # bands 2 * reach wide, one every reach: any 2k + 1 neighbouring diagonals lie in one of them
    order = np.argsort(d, kind="stable")
    p, d = p[order], d[order]
    band = np.floor_divide(d, reach)
    names, counts = np.unique(np.concatenate([band, band - 1]), return_counts=True)
    for name in names[counts >= bound]:
        low, high = int(name) * reach, int(name) * reach + 2 * reach - 1
        own = p[np.searchsorted(d, low) : np.searchsorted(d, high, "right")]
        here = np.zeros(len(pattern) + 1, np.int64)
        here[own + 1] = 1
        sums = np.cumsum(here)
        shared = sums[m - Q + 1 : len(pattern) - Q + 2] - sums[: len(pattern) - m + 1]
        starts = np.flatnonzero(shared >= bound)
        if len(starts):
            starts = np.intersect1d(starts, block.firsts(piece), assume_unique=True)
        if not len(starts):
            continue
        best = starts[np.argmax(shared[starts]) :][:1]
        if least_edits(pattern, best, m, codes, (low, high), k) <= k:
            return True
        for at in range(0, len(starts), _ALIGNED):
            if least_edits(pattern, starts[at : at + _ALIGNED], m, codes, (low, high), k) <= k:
                return True
    return False


def matched_items(text: str | None, blocks: list[Block]) -> list[int]:
    """Ids of the items of which a window occurs in the text within its edit budget, in order."""
    codes = normal(text)
    out: set[int] = set()
    for block in blocks:
        lap = 2 * block.window
        for s in range(0, max(1, len(codes)), CHUNK):
            out |= _found(codes[max(0, s - lap) : s + CHUNK + lap], block, out)
        if 0 < len(codes) < Q:
            out |= set(block.short.get(codes.tobytes(), ()))
    return sorted(out)


def _blocks(benchmark: DataFrame) -> list[list[tuple[int, str]]]:
    """Benchmark rows in blocks of at most ``BLOCK_CHARS`` (or one item), read one partition at a time."""
    out, size = [[]], 0
    rows = pick(benchmark, "item_id", "text").where("item_id is not null and text is not null").distinct()
    for row in rows.toLocalIterator():
        if out[-1] and size + len(row["text"]) > BLOCK_CHARS:
            out, size = [*out, []], 0
        out[-1].append((row["item_id"], row["text"]))
        size += len(row["text"])
    return out


def mark_contaminated(docs: DataFrame, benchmark: DataFrame, *keep: str, keep_text: bool = False, window: int = WINDOW) -> DataFrame:
    """``keep`` columns and ``item_ids``, the benchmark items found in every document.

    All documents are returned, repeated rows too, with an empty list where nothing is found:
    for NULL and empty texts, and for an empty benchmark. An item is found where ``window``
    characters of it (all, if it is shorter) occur with few edits (``budget``); 50 finds passages
    of about 13 words (a run of common words too, so it is not the default). Items of fewer than Q
    letters are found where they are the whole text, letter by letter; items without letters and
    NULL ones never. Whole texts are searched, in overlapping chunks. Every block of the benchmark is one more pass in the same task, and
    only that block is sent to it.
    """
    out = pick(docs, *keep, "text").withColumn("_found", F.array().cast("array<bigint>"))
    context = docs.sparkSession.sparkContext
    for rows in _blocks(benchmark):
        sent = context.broadcast(rows)
        built: list[Block] = []

        def search(texts: list, sent=sent, built=built) -> list:
            if not built:
                built.append(Block.of(sent.value, window))
            return [[matched_items(t, built) for t in texts]]

        out = map_text(out, search, "_more array<bigint>", keep_inputs=True)
        out = out.withColumn("_found", F.concat("_found", "_more")).drop("_more")
    found = F.array_sort(F.array_distinct("_found")).alias("item_ids")
    return out.select(*keep, *(["text"] if keep_text and "text" not in keep else []), found)


def clean_documents(docs: DataFrame, benchmark: DataFrame, columns: list[str]) -> DataFrame:
    """The documents in which no benchmark item is found."""
    others = [c for c in columns if c != "text"]
    marked = mark_contaminated(docs, benchmark, *others, keep_text=True)
    return marked.where(F.size("item_ids") == 0).select(*columns)
