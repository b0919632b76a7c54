"""Line dedup: repeated runs of lines found with a suffix array built by distributed prefix doubling.

The corpus is a sequence of line ids. Lines that occur once, like the ends of documents, end
a segment: no repeated run crosses them, and only segments with enough words stay. Suffixes
of the segments are ranked by their first line, then by 1 + 1, 2 + 2, 4 + 4 ... lines. A
rank class at depth L is an interval of the suffix array whose common prefix is L lines or
more; the members of a class other than its earliest are later copies.

A line is deleted when it lies in a run of ``MIN_WORDS`` words or more of which an identical
run begins earlier in the corpus. Every such line lies in a run that is the shortest to
reach the words from its start, or the shortest from its end: these two families are the
intervals that are looked up, each at the depth that half covers it (two overlapping
prefixes of 2^j lines name a run of 2^j to 2^(j+1) lines). The doubling stops when no run
is longer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from swelter.llm.common import WORD, map_text, pick, store
from swelter.session import ship_package

MIN_WORDS = 50


def _numbered(docs: DataFrame) -> DataFrame:
    """row (in corpus order: id, NULL last, then digest of the text), key of id and text, and lines with their digests.

    Stored, so the numbers stay whatever is computed again.
    """
    own = pick(docs, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    lines = F.transform(
        F.split("text", "\n"),
        lambda x: F.struct(F.unhex(F.md5(x)).alias("id"), F.regexp_count(x, F.lit(WORD)).alias("words")),
    )
    own = own.select("doc_id", _key().alias("key"), lines.alias("lines"))
    order = [F.asc_nulls_last("doc_id"), F.col("key").asc()]
    return store(own.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("row", F.monotonically_increasing_id()))


def _key() -> Column:
    return F.concat_ws("|", F.col("doc_id").cast("string"), F.md5("text"))


def _ranked(groups: DataFrame, within: list[str], bucket: Column, order: str) -> DataFrame:
    """``start``: members of the groups before each one, within ``within`` and in order.

    In two steps, over buckets and inside them, so no task orders all groups of a frequent rank.
    """
    groups = groups.withColumn("bucket", bucket)
    before = (Window.unboundedPreceding, -1)
    per = groups.groupBy(*within, "bucket").agg(F.sum("n").alias("all"))
    outer = F.sum("all").over(Window.partitionBy(*within).orderBy("bucket").rowsBetween(*before))
    per = per.select(*within, "bucket", F.coalesce(outer, F.lit(0)).alias("outer"))
    inner = F.sum("n").over(Window.partitionBy(*within, "bucket").orderBy(order).rowsBetween(*before))
    groups = groups.withColumn("inner", F.coalesce(inner, F.lit(0)))
    return groups.join(per, [*within, "bucket"]).withColumn("start", F.col("outer") + F.col("inner")).drop("bucket", "inner", "outer")


def _windows(batches: Iterator[pa.RecordBatch], min_words: int) -> Iterator[pa.RecordBatch]:
    """Rows of segments that reach the words: line, rank, and the lengths of the shortest runs from and up to it (0: none)."""
    for batch in batches:
        out: list[list] = [[], [], [], [], []]
        for row, lines in zip(batch.column("row").to_pylist(), batch.column("lines").to_pylist()):
            line = np.array([x["line"] for x in lines])
            total = np.concatenate([[0], np.cumsum([x["words"] for x in lines])])
            edges = np.flatnonzero(np.diff(line) != 1) + 1
            for a, b in zip([0, *edges], [*edges, len(line)]):
                own = total[a : b + 1] - total[a]
                if own[-1] < min_words:
                    continue
                n = b - a
                ends = np.searchsorted(own, own[:-1] + min_words)  # first line end with the words
                ahead = np.where(ends <= n, ends - np.arange(n), 0)
                starts = np.searchsorted(own, own[1:] - min_words, side="right") - 1  # last start with the words
                back = np.where(own[1:] >= min_words, np.arange(1, n + 1) - starts, 0)
                out[0] += [row] * n
                out[1] += line[a:b].tolist()
                out[2] += [x["rank"] for x in lines[a:b]]
                out[3] += np.maximum(ahead, 0).tolist()
                out[4] += np.maximum(back, 0).tolist()
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=["row", "line", "rank", "ahead", "back"])


def _first_ranks(numbered: DataFrame, min_words: int) -> DataFrame:
    """The suffixes of the segments, ranked by their first line."""
    lines = numbered.select("row", F.posexplode("lines").alias("line", "x")).select("row", "line", "x.id", "x.words")
    repeated = store(lines.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    digits = max(1, (repeated.count().bit_length() + 1) // 8)
    ranks = _ranked(repeated, [], F.substring(F.hex("id"), 1, digits), "id").select("id", F.col("start").alias("rank"))
    found = lines.join(ranks, "id").groupBy("row").agg(F.sort_array(F.collect_list(F.struct("line", "rank", "words"))).alias("lines"))
    ship_package(found.sparkSession)
    return found.mapInArrow(lambda batches: _windows(batches, min_words), "row long, line int, rank long, ahead int, back int")


def _doubled(ranks: DataFrame, depth: int) -> DataFrame:
    """Ranks at twice the depth; stored."""
    total = ranks.count()
    wide = max(1, int(total**0.5))
    pairs = ranks.select("*", F.col("next").alias("second"))
    groups = pairs.groupBy("rank", "second").agg(F.count(F.lit(1)).alias("n"))
    groups = _ranked(groups, ["rank"], F.floor(F.col("second") / wide), "second")
    groups = groups.select("rank", "second", (F.col("rank") + F.col("start")).alias("finer"))
    return pairs.join(groups, ["rank", "second"]).select("row", "line", F.col("finer").alias("rank"), "ahead", "back")


def _looked_up(ranks: DataFrame, depth: int) -> DataFrame:
    """Beside every suffix: the rank ``depth`` lines on (-1 behind the segment) and the names of its runs of this depth.

    A run of k lines, depth <= k < 2 * depth, is named by k and the ranks at its start and
    ``depth`` lines before its end.
    """
    docs = ranks.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("line", "rank", "ahead", "back"))).alias("a"))
    run = "if({k} >= {d} and {k} < 2 * {d}, named_struct('start', get(a, {s}).line, 'k', {k}, 'one', get(a, {s}).rank, 'two', get(a, {s} + {k} - {d}).rank), null)"
    return store(
        docs.select(
            "row",
            F.explode(
                F.expr(f"""transform(a, (x, i) -> named_struct(
                    'line', x.line, 'rank', x.rank, 'ahead', x.ahead, 'back', x.back,
                    'next', if(coalesce(get(a, i + {depth}).line = x.line + {depth}, false), get(a, i + {depth}).rank, -1L),
                    'forth', {run.format(k='x.ahead', d=depth, s='i')},
                    'up', {run.format(k='x.back', d=depth, s='(i - x.back + 1)')}))""")
            ).alias("x"),
        ).select("row", "x.*")
    )


def later_copies(docs: DataFrame, min_words: int = MIN_WORDS) -> tuple[DataFrame, DataFrame]:
    """The numbered documents, and for rows with deletions the deleted lines as (start, k) runs that may overlap."""
    numbered = _numbered(docs)
    ranks, depth, cuts = store(_first_ranks(numbered, min_words)), 1, None
    longest = ranks.agg(F.max(F.greatest("ahead", "back")).alias("k")).first()["k"] or 0
    while True:
        looked = _looked_up(ranks, depth)
        runs = looked.select("row", F.explode(F.array("forth", "up")).alias("w")).where("w is not null").select("row", "w.*").distinct()
        classes = runs.groupBy("k", "one", "two").agg(F.min(F.struct("row", "start")).alias("earliest"), F.count(F.lit(1)).alias("n"))
        later = runs.join(classes.where("n > 1"), ["k", "one", "two"]).where(F.struct("row", "start") > F.col("earliest"))
        later = later.select("row", "start", "k")
        cuts = later if cuts is None else cuts.unionByName(later)
        depth *= 2
        if depth > longest:
            break
        ranks = store(_doubled(looked, depth // 2))
    return numbered, cuts.groupBy("row").agg(F.collect_list(F.struct("start", "k")).alias("cuts"))


def _without(texts: list, cuts: list) -> list:
    out: list[list] = [[], [], []]
    for text, runs in zip(texts, cuts):
        lines = text.split("\n")
        gone = np.zeros(len(lines), bool)
        for r in runs or []:
            gone[r["start"] : r["start"] + r["k"]] = True
        out[0].append("\n".join(x for x, g in zip(lines, gone) if not g))
        out[1].append(len(lines))
        out[2].append(int(gone.sum()))
    return out


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, kept (the text without deleted lines), n_lines and n_removed of every document.

    Earlier means: smaller id (NULL ids last), of equal ids the smaller digest of the text,
    then the line. Of rows equal in id and text one counts as the first and keeps its lines;
    all are returned. A NULL text counts as an empty one: one line without words. Runs may
    overlap their earlier copy. An empty table gives an empty result; other columns are
    ignored.
    """
    numbered, cuts = later_copies(docs, min_words)
    rows = numbered.select("row", "key").join(cuts, "row", "left")
    texts = pick(docs, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    texts = texts.withColumn("key", _key()).dropDuplicates(["key"])
    both = texts.join(rows, "key").select("doc_id", "text", "cuts")
    return map_text(both, _without, "kept string, n_lines long, n_removed long", ("text", "cuts"))


SQL = f"""
WITH d AS (
  SELECT row_number() OVER (ORDER BY doc_id NULLS LAST, concat_ws('|', doc_id::VARCHAR, md5(coalesce(text, '')))) AS rid,
         doc_id, string_split(coalesce(text, ''), chr(10)) AS ls
  FROM documents),
l AS (
  SELECT rid, i, ls, len(regexp_extract_all(ls[i], '[^\\x20\\x09-\\x0D]+')) AS words
  FROM (SELECT rid, ls, unnest(range(1, len(ls) + 1)) AS i FROM d)),
c AS (SELECT *, sum(words) OVER (PARTITION BY rid ORDER BY i) AS upto FROM l),
w AS (
  SELECT a.rid, a.i AS first, min(b.i) AS last FROM c a JOIN c b ON a.rid = b.rid AND b.i >= a.i
  WHERE b.upto - a.upto + a.words >= {MIN_WORDS} GROUP BY a.rid, a.i
  UNION
  SELECT b.rid, max(a.i), b.i FROM c a JOIN c b ON a.rid = b.rid AND b.i >= a.i
  WHERE b.upto - a.upto + a.words >= {MIN_WORDS} GROUP BY b.rid, b.i),
g AS (SELECT w.*, array_to_string(list_slice(ls, first, last), chr(10)) AS run FROM w JOIN d USING (rid)),
cuts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY rid, first) AS place FROM g) WHERE place > 1),
gone AS (SELECT DISTINCT l.rid, l.i FROM l JOIN cuts ON l.rid = cuts.rid AND l.i BETWEEN first AND last),
k AS (
  SELECT l.rid, count(*)::BIGINT AS n_lines, count(gone.i)::BIGINT AS n_removed,
         coalesce(string_agg(l.ls[l.i], chr(10) ORDER BY l.i) FILTER (gone.i IS NULL), '') AS kept
  FROM l LEFT JOIN gone ON l.rid = gone.rid AND l.i = gone.i GROUP BY l.rid)
SELECT doc_id, n_lines, n_removed, length(kept)::BIGINT AS n_kept_chars, md5(kept) AS kept_md5 FROM d JOIN k USING (rid)
"""
