"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints at most two bits apart have a common point at most one bit from either, so
every distinct fingerprint is sent to its 65 points and those that meet are linked. Points
within one bit of a point are within two of each other: the fingerprints of a point are all
neighbours, and a chain through them keeps what is reachable without listing pairs.

``near_duplicates`` links by such a fingerprint of 64 bits alone. ``near_copies`` links texts whose
shingle sets are alike, without exception. Several shorter fingerprints of word pairs find most
candidates (one word changed alters two pairs, so near copies stay close). What they leave is
found by a prefix filter: in any one order of all shingles, two sets with a similarity of
``ALIKE`` share one of their first n - ceil(ALIKE n) + 1.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from swelter.llm.common import lists, map_arrays, map_text, pick, slices, store
from swelter.operators.graph import connected_components
from swelter.session import ship_package

SHINGLE = 3
SEED = 42
RADIUS = 2
#: Near copies: the shingles compared, and the least Jaccard similarity of two sets of them.
COPY_SHINGLE = 5
ALIKE = 0.8
#: Candidates for near copies: fingerprints per text, bits of each, words per feature.
TABLES = 8
BITS = 32
COPY_FEATURE = 2
#: Common shingles stand last in the order of the prefix filter: those seen this often in one of so many texts, and no more than so many.
SAMPLED = 16
COMMON = 4
MOST_COMMON = 1 << 18
#: Rounds in which every shingle has one text compared with the others, before all that is left is.
LEADER_ROUNDS = 2
#: Bits of the parities of a set, 64 to a number; sets with more shingles also have as many bits as shingles.
PARITIES = 1024
#: Shared shingles right before a row's own by which a pair is known to have met.
LOOK_BACK = 16
#: Bits of the table that picks the rows some keys belong to.
KEY_BITS = 1 << 25
_CHUNK = 1 << 16


def _words(text: str | None) -> list[bytes]:
    """bytes.lower and bytes.split touch ASCII alone, as the definition of words asks."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _hashes(words: list[bytes], size: int) -> Iterator[np.ndarray]:
    """XXH64 of every run of ``size`` words, or of all if there are fewer; in chunks, so a very
    long text needs no more memory than its words."""
    n = max(1, len(words) - size + 1) if words else 0
    digest = xxhash.xxh64_intdigest
    for lo in range(0, n, _CHUNK):
        yield np.fromiter((digest(b" ".join(words[i : i + size]), SEED) for i in range(lo, min(n, lo + _CHUNK))), np.uint64)


def _ones(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64 majority bits of the hashed shingles, as a signed number."""
    n, ones = 0, np.zeros(64, np.int64)
    for hashes in _hashes(_words(text), shingle):
        n, ones = n + len(hashes), ones + _ones(hashes)
    return int(np.packbits((2 * ones > n).astype(np.uint8), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, *keep: str) -> DataFrame:
    """``keep`` columns and fp (64 bits as a signed long) of every document; 0 where there is no word."""
    return map_text(pick(docs, *keep, "text"), lambda texts: [[fingerprint(t) for t in texts]], "fp long")


def links(distinct: DataFrame) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints at most ``RADIUS`` bits apart that keep all that is reachable."""
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << k if k < 63 else -(1 << 63)).cast("long") for k in range(64)])
    points = distinct.select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("point"))
    near = Window.partitionBy("point").orderBy("fp")
    pairs = points.withColumn("other", F.lag("fp").over(near)).where("other is not null")
    pairs = pairs.select(F.col("other").alias("a"), F.col("fp").alias("b")).distinct()
    return pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS)


def components(marked: DataFrame) -> DataFrame:
    """fp and comp (a fingerprint of the component) for every distinct fingerprint of ``marked``."""
    distinct = store(marked.select("fp").distinct())
    labels = connected_components(links(distinct), []).select(F.col("node").alias("fp"), "comp")
    return distinct.join(labels, "fp", "left").select("fp", F.coalesce("comp", "fp").alias("comp"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every document.

    component_id is the smallest doc_id that links lead to, NULL where all ids are NULL.
    Texts without words share fingerprint zero and are linked like any others. Repeated rows
    are all returned. An empty table gives an empty result; other columns are ignored.
    Copies are one fingerprint, so a group of any size is one row in the search for links;
    only the join back meets its rows, and there Spark splits them.
    """
    marked = store(fingerprints(docs, "doc_id"))
    first = marked.groupBy("fp").agg(F.min("doc_id").alias("first"))
    named = store(components(marked).join(first, "fp"))
    smallest = named.groupBy("comp").agg(F.min("first").alias("component_id"))
    named = store(named.select("fp", "comp").join(smallest, "comp").select("fp", "component_id"))
    return marked.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def copy_prints(words: list[bytes]) -> list[int]:
    """``TABLES`` fingerprints of ``BITS`` bits: majority bits of the word pairs, hashed anew for every 64 bits."""
    rounds = -(-TABLES * BITS // 64)
    n, ones = 0, np.zeros((rounds, 64), np.int64)
    for hashes in _hashes(words, COPY_FEATURE):
        n += len(hashes)
        for k in range(rounds):
            ones[k] += _ones(hashes)
            hashes = (hashes ^ (hashes >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
            hashes = (hashes ^ (hashes >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    bits = (2 * ones.ravel() > n)[: TABLES * BITS].reshape(TABLES, BITS)
    return (bits @ (1 << np.arange(BITS, dtype=np.int64))).tolist()


def shingle_set(words: list[bytes]) -> np.ndarray:
    """The different hashes of the shingles of a text, in order."""
    parts = list(_hashes(words, COPY_SHINGLE))
    return np.unique(np.concatenate(parts)).view(np.int64) if parts else np.empty(0, np.int64)


def parities(found: np.ndarray, classes: int = PARITIES) -> np.ndarray:
    """For every class of shingles whether a set has an odd number of it, as bits. Two sets
    differ in at least as many shingles as their parities differ in bits."""
    odd = np.bincount((found.view(np.uint64) >> np.uint64(7)).astype(np.int64) % classes, minlength=classes) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def wide_parities(found: np.ndarray) -> np.ndarray:
    """The parities of a set of more than ``PARITIES`` shingles: as many classes as shingles, rounded
    up to a power of two. A large set has about half of few bits, whatever its shingles."""
    return parities(found, 1 << (len(found) - 1).bit_length()) if len(found) > PARITIES else np.empty(0, np.int64)


def _differ(x: str, y: str) -> Column:
    """In how many bits two parities differ, of which one may have twice as many as the other."""

    def halved(own: str, other: str) -> Column:
        half = F.size(other)
        low, high = F.slice(own, F.lit(1), half), F.slice(own, half + 1, half)
        return F.when(F.size(own) > half, F.zip_with(low, high, lambda a, b: a.bitwiseXOR(b))).otherwise(F.col(own))

    bits = F.zip_with(halved(x, y), halved(y, x), lambda a, b: F.bit_count(a.bitwiseXOR(b)))
    return F.aggregate(bits, F.lit(0), lambda total, n: total + n)


def _set_id(found: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(found.tobytes(), SEED)).astype(np.int64))


def prefix(found: np.ndarray, common: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The shingles of a set of which every set alike has one among its own: rare ones first, ``common`` (sorted) by their counts."""
    often = np.zeros(len(found), np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, found), len(common) - 1)
        often = np.where(common[at] == found, counts[at], 0)
    return found[np.lexsort((found, often))][: len(found) - (4 * len(found) + 4) // 5 + 1] if len(found) else found


def common_shingles(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles of a sample of the texts and their counts. They only set the order, so any will do."""
    sample = docs.where(F.pmod(F.xxhash64("_row"), F.lit(SAMPLED)) == 0).select("text")
    each = map_text(sample, lambda texts: [[shingle_set(_words(t)) for t in texts]], "hashes array<bigint>")
    seen = each.select(F.explode("hashes").alias("h")).groupBy("h").count().where(F.col("count") >= COMMON)
    found = seen.orderBy(F.desc("count"), "h").limit(MOST_COMMON).toArrow()
    hashes, counts = found.column("h").to_numpy(), found.column("count").to_numpy()
    order = np.argsort(hashes)
    return hashes[order], counts[order]


def copy_marks(docs: DataFrame) -> DataFrame:
    """``docs`` with sid, prints, the number of shingles, the prefix and both parities in place of the text."""
    sent = docs.sparkSession.sparkContext.broadcast(common_shingles(docs))

    def marks(column: pa.Array) -> list[pa.Array]:
        split = [_words(t) for t in column.to_pylist()]
        sets = [shingle_set(w) for w in split]
        long = pa.list_(pa.int64())
        return [
            pa.array([_set_id(f) for f in sets], pa.int64()), pa.array([copy_prints(w) if w else [] for w in split], long),
            pa.array([len(f) for f in sets], pa.int64()), pa.array([prefix(f, *sent.value) for f in sets], long),
            pa.array([parities(f) for f in sets], long), pa.array([wide_parities(f) for f in sets], long),
        ]

    return map_arrays(docs, marks, "sid long, prints array<bigint>, n long, prefix array<bigint>, odd array<bigint>, wide array<bigint>", ("text",))


def _copy_sets(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """sid and hashes of the texts of a batch, a slice at a time."""
    for part in slices(batch, batch.column("text")):
        found = [shingle_set(_words(t)) for t in part.column("text").to_pylist()]
        sids = pa.array([_set_id(f) for f in found], pa.int64())
        hashes = lists(np.concatenate([*found, np.empty(0, np.int64)]), np.array([len(f) for f in found], np.int64))
        yield pa.RecordBatch.from_arrays([sids, hashes], names=["sid", "hashes"])


def copy_candidates(distinct: DataFrame) -> DataFrame:
    """Pairs (a, b) of sets of which some fingerprint is at most two bits apart.

    ``distinct``: sid (unique) and prints. Sets with the same fingerprint are compared with
    the first and the last of them, however many there are. Every different fingerprint then
    goes to its ball of ``BITS + 1`` points on behalf of its first set. A point is met by
    ``BITS + 1`` fingerprints at most, so those that meet there can be paired.
    """
    own = distinct.select("sid", F.posexplode("prints").alias("t", "p"))
    own = own.select("sid", (F.col("t").cast("long") * F.lit(1 << BITS) + F.col("p")).alias("print"))
    ends = store(own.groupBy("print").agg(F.min("sid").alias("low"), F.max("sid").alias("high")))
    same = own.join(ends.where("low < high"), "print").select("sid", F.explode(F.array("low", "high")).alias("other"))
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << k).cast("long") for k in range(BITS)])
    ball = ends.select("low", "print", F.explode(flips).alias("flip")).select("low", F.col("print").bitwiseXOR(F.col("flip")).alias("point"))
    met = ball.withColumn("met", F.collect_list("low").over(Window.partitionBy("point"))).where(F.size("met") > 1)
    pairs = same.unionByName(met.select(F.col("low").alias("sid"), F.explode("met").alias("other"))).where("sid <> other")
    return pairs.select(F.least("sid", "other").alias("a"), F.greatest("sid", "other").alias("b")).distinct()


def _rows_of(
    df: DataFrame, key: str, keys: DataFrame, then: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]] | None = None, out: str | None = None
) -> DataFrame:
    """Rows of ``df`` whose ``key`` (long) is one of ``keys``, and a few others; or what ``then``
    makes of them in the same task (columns ``out``).

    What is sent to the tasks is a bit table of a fixed size, so a large table is not shuffled
    for the sake of few of its rows. Where there are more keys than bits all rows stay, and the
    join that follows does the work.
    """
    slot = F.pmod(F.col(key), F.lit(KEY_BITS))
    word = F.floor(slot / 64).cast("int")
    bits = keys.select(word.alias("word"), F.expr(f"shiftleft(1L, cast(pmod({key}, 64) as int))").alias("bit")).groupBy("word").agg(F.expr("bit_or(bit)").alias("bits")).toArrow()
    table = np.zeros(KEY_BITS // 64, np.uint64)
    table[bits.column("word").to_numpy()] = bits.column("bits").to_numpy().view(np.uint64)
    sent = df.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(key).to_numpy() % KEY_BITS
            hit = batch.filter(pa.array((sent.value[at // 64] >> (at % 64).astype(np.uint64) & np.uint64(1)) > 0))
            yield from then(hit) if then else (hit,)

    ship_package(df.sparkSession)
    return df.mapInArrow(run, out or df.schema)


def _could_be_alike(x: str, y: str) -> Column:
    """False where two sets that share the shingle at these places of their orders cannot be alike."""
    n, m, i, j = (F.col(f"{t}.{c}") for c in ("n", "at") for t in (x, y))
    most = F.least(i, j) + F.least(n - i, m - j)
    return (5 * F.least(n, m) >= 4 * F.greatest(n, m)) & (9 * most >= 4 * (n + m))


def _pairs(left: DataFrame, right: DataFrame, meet_once: bool = False) -> DataFrame:
    """Pairs (a, b) of sets of different components that share a shingle of ``left`` and ``right``.
    With ``meet_once`` rows have ``before`` and the parities: a pair meets at the first shingle it
    shares, if its parities allow."""
    both = left.alias("x").join(right.alias("y"), "h").where(F.col("x.comp") != F.col("y.comp")).where(_could_be_alike("x", "y"))
    if meet_once:
        differ = sum((F.bit_count(F.col(f"x.odd{k}").bitwiseXOR(F.col(f"y.odd{k}"))) for k in range(PARITIES // 64)), F.lit(0))
        both = both.where("x.sid < y.sid").where(9 * differ <= F.col("x.n") + F.col("y.n")).where(~F.arrays_overlap("x.before", "y.before"))
    return both.select(F.least("x.sid", "y.sid").alias("a"), F.greatest("x.sid", "y.sid").alias("b")).distinct()


def _open(rows: DataFrame) -> DataFrame:
    """The rows of shingles that several components share."""
    several = rows.groupBy("h").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high")
    return store(rows.join(several.select("h"), "h"))


def _with_before(rows: DataFrame, distinct: DataFrame) -> DataFrame:
    """Add ``before``, the last ``LOOK_BACK`` shingles of a set among ``rows`` that stand before the
    row's own, and the parities of the set, a column each.

    All sets have their shingles in one order, so pairs that share one of ``before`` have met at
    an earlier shingle, and at the first one they share nothing stands before.
    """
    earlier = Window.partitionBy("sid").orderBy("at").rowsBetween(-LOOK_BACK, -1)
    odd = _rows_of(distinct.select("sid", "odd"), "sid", rows.select("sid").distinct())
    odd = odd.select("sid", *[F.col("odd")[k].alias(f"odd{k}") for k in range(PARITIES // 64)])
    return rows.select("sid", "n", "comp", "at", "h", F.collect_list("h").over(earlier).alias("before")).join(odd, "sid")


def _with_comp(rows: DataFrame, labels: DataFrame) -> DataFrame:
    mapped = labels.select(F.col("node").alias("sid"), F.col("comp").alias("_comp"))
    return rows.join(mapped, "sid", "left").withColumn("comp", F.coalesce("_comp", "sid")).drop("_comp")


def _alike(docs: DataFrame, distinct: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of the pairs of which the whole sets are alike.

    Sets that are alike differ in a ninth of their shingles at most, and in no fewer than their
    parities do; only texts in a pair that can be alike by that are read. The parities of a pair
    are a small part of its sets, which are what is sent to every pair that is left.
    """
    paired = store(pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct())
    finest = F.when(F.size("wide") > 0, F.col("wide")).otherwise(F.col("odd")).alias("odd")
    own = _rows_of(distinct.select("sid", "n", finest), "sid", paired)
    known = pairs.join(own.toDF("a", "n", "p"), "a").join(own.toDF("b", "m", "q"), "b")
    near = known.where(5 * F.least("n", "m") >= 4 * F.greatest("n", "m")).where(9 * _differ("p", "q") <= F.col("n") + F.col("m"))
    pairs = store(near.select("a", "b"))
    paired = pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct()
    wanted = distinct.select("sid", F.xxhash64("first._row").alias("key")).join(paired, "sid", "left_semi").select("key")
    # texts are picked where they lie; equal ones and strangers go when their sets are known
    texts = docs.select(F.xxhash64("_row").alias("key"), "text")
    found = store(_rows_of(texts, "key", wanted, _copy_sets, "sid long, hashes array<bigint>"))
    sets = found.join(paired, "sid", "left_semi").dropDuplicates(["sid"])
    both = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b").withColumn("shared", F.size(F.array_intersect("x", "y")))
    alike = F.col("shared") >= F.lit(ALIKE) * (F.size("x") + F.size("y") - F.col("shared"))
    return store(both.where(alike).select("a", "b"))


def copy_links(docs: DataFrame, distinct: DataFrame) -> DataFrame:
    """node and comp of all sets that are alike to another, by way of others too.

    Pairs by fingerprint come first. Then the sets that share a shingle of their prefixes are
    compared if they are not connected yet: in every round one of each shingle, the one that
    shares most of its prefix (an original, more than its variants), with all others; it then
    leaves that shingle. After the rounds all pairs left are compared.
    """
    links = _alike(docs, distinct, store(copy_candidates(distinct)))
    labels = store(connected_components(links, []))
    rows = _with_comp(distinct.select("sid", "n", "prefix"), labels)
    rows = _open(rows.select("sid", "n", "comp", F.posexplode("prefix").alias("at", "h")))
    size = F.col("n") - F.ceil(F.lit(4) * F.col("n") / 5) + 1
    shared = rows.groupBy("sid").agg((F.count(F.lit(1)) / F.max(size)).alias("central"))
    rows = store(rows.join(shared, "sid"))
    for k in range(LEADER_ROUNDS + 1):
        if rows.isEmpty():
            break
        first = rows.groupBy("h").agg(F.max(F.struct("central", "sid", "n", "at", "comp")).alias("lead"))
        first = store(first.select("h", "lead.*"))
        if k < LEADER_ROUNDS:
            pairs = _pairs(first, rows)
        else:
            rows = _with_before(rows, distinct)
            pairs = _pairs(rows, rows, meet_once=True)
        more = _alike(docs, distinct, store(pairs))
        if not more.isEmpty():
            links = store(links.unionByName(more))
            labels = store(connected_components(links, []))
        if k < LEADER_ROUNDS:
            left = rows.join(first.select("h", "sid"), ["h", "sid"], "left_anti")
            rows = _open(_with_comp(left.drop("comp"), labels))
    return labels


def near_copies(docs: DataFrame) -> DataFrame:
    """first (one struct of none, doc_id and _row per set of shingles), sid and comp of all ``docs``.

    ``docs``: doc_id, text and _row (equal for equal rows). Texts with the same set of shingles
    are one set, those without words too. Sets are linked when their Jaccard similarity is
    ``ALIKE`` or more; a component is what links lead to.
    """
    marked = copy_marks(docs)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row")).alias("first")
    alike = [F.min(c).alias(c) for c in ("prints", "n", "prefix", "odd", "wide")]
    distinct = store(marked.groupBy("sid").agg(first, *alike))
    labels = copy_links(docs, distinct).select(F.col("node").alias("sid"), "comp")
    return distinct.join(labels, "sid", "left").select("first", "sid", F.coalesce("comp", "sid").alias("comp"))


def one_of_each(docs: DataFrame, columns: list[str]) -> DataFrame:
    """One row of every group of near copies: the smallest id, ids before NULL, then the smallest
    digest of the text; of rows equal in both the smallest in the order of ``columns``."""
    own = pick(docs, *columns).withColumn("_row", F.concat_ws("|", F.col("doc_id").cast("string"), F.md5(F.coalesce("text", F.lit("")))))
    stay = near_copies(own.select("doc_id", "text", "_row")).groupBy("comp").agg(F.min("first").alias("first")).select("first._row")
    return own.join(stay, "_row", "left_semi").groupBy("_row").agg(F.min(F.struct(*columns)).alias("row")).select("row.*")
