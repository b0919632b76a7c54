"""Mixing sources to target weights: Sainte-Lague quotas of equal-token blocks, per shard.

Built-in functions only. Documents fall into shards by a hash of id and text; a shard holds
a bounded number of words, so no window ever sees a whole source. Within a shard every
source gets an integer number of blocks by the highest quotients target / (2k + 1). The
documents of a source stand in a seeded order, end to end; the mix takes whole rounds of
them and then consecutive blocks from a seeded block on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from swelter.llm.common import WORD, pick, store

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_REPEAT = 2
BLOCK_WORDS = 64
SHARD_WORDS = 500_000
#: Words that a row counts as beside its own, so shards of empty rows stay bounded too.
ROW_WORDS = 64
SEED = 20


def _hash_int(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def row_key() -> Column:
    """Equal for rows with the same id, source and text only."""
    text = F.md5(F.coalesce("text", F.lit("")))
    # parts that are NULL are left out, so they are named at the end
    absent = [F.when(F.col(c).isNull(), F.lit(f"no {c}")) for c in ("doc_id", "source")]
    return F.md5(F.concat_ws("|", F.lit(str(SEED)), F.col("doc_id").cast("string"), "source", text, *absent))


def source_targets(sizes: DataFrame) -> DataFrame:
    """One row per source: source_size and target in words.

    Weights go round in order of the source's name, NULL last. With the sources sorted by
    cap over weight, the level left for the others rises with every source that reaches its
    cap and falls from the first one on that does not, so its maximum is the water level.
    """
    per = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"))
    everything = Window.partitionBy()
    place = (F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1) % len(WEIGHTS)
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (place + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("cap", MAX_REPEAT * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.asc_nulls_last("source"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn(
        "level",
        (F.lit(SHARE) * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
        / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))),
    )
    per = per.withColumn("water", F.max("level").over(everything))
    target = F.least(F.col("cap").cast("double"), F.col("water") * F.col("weight"))
    return per.select("source", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def shard_quotas(cells: DataFrame) -> DataFrame:
    """Blocks for every (shard, source) by the highest quotients.

    Only quotients near the cut are listed: rounding target / block gives a start that is
    off by less than one per source in all, so the divisor that meets the shard's number of
    blocks moves a source by at most its share of 1.5 times the number of sources.
    """
    shard = Window.partitionBy("shard")
    cells = (
        cells.withColumn("goal", F.when(F.col("source_size") > 0, F.col("target") * F.col("cell_size") / F.col("source_size")).otherwise(0.0))
        .withColumn("goals", F.sum("goal").over(shard))
        .withColumn("sources", F.count(F.lit(1)).over(shard))
        .withColumn("near", F.floor(F.col("goal") / BLOCK_WORDS + 0.5))
        .withColumn("span", F.ceil(1.5 * F.col("sources") * F.coalesce(F.col("goal") / F.nullif("goals", F.lit(0.0)), F.lit(0.0))) + 2)
        .withColumn("sure", F.greatest(F.lit(0), F.col("near") - F.col("span")))
    )
    cells = cells.withColumn("left", F.floor(F.col("goals") / BLOCK_WORDS + 0.5) - F.sum("sure").over(shard))
    tried = cells.where("goal > 0").withColumn("k", F.explode(F.sequence(F.col("sure"), F.col("near") + F.col("span"))))
    best = Window.partitionBy("shard").orderBy((F.col("goal") / (2 * F.col("k") + 1)).desc(), F.asc_nulls_last("source"), "k")
    won = tried.withColumn("place", F.row_number().over(best))
    return won.groupBy("shard", "source", "cell_size", "source_size", "target").agg(
        (F.first("sure") + F.sum((F.col("place") <= F.col("left")).cast("long"))).alias("quota")
    )


def plan_mix(docs: DataFrame) -> DataFrame:
    """What the mix takes, one row per group of equal rows.

    Columns: key, doc_id, size, copies (equal rows), source_size, target, first (word offset
    in the round of its source and shard), rounds, lo, hi, wrap: the mix takes ``rounds``
    whole rounds, the words from ``lo`` to ``hi`` and those before ``wrap``.
    """
    sizes = pick(docs, "doc_id", "text", "source").select(
        row_key().alias("key"), "doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size")
    )
    sizes = store(sizes.groupBy("key", "doc_id", "source", "size").agg(F.count(F.lit(1)).alias("copies")))
    total = sizes.agg(F.sum((F.col("size") + ROW_WORDS) * F.col("copies")).alias("n")).first()["n"] or 0
    shards = max(1, -(-total // SHARD_WORDS))
    sizes = sizes.withColumn("shard", F.conv(F.substring("key", 1, 8), 16, 10).cast("long") % shards)
    cells = sizes.groupBy("shard", "source").agg(F.sum(F.col("size") * F.col("copies")).alias("cell_size"))
    tag, none = F.coalesce("source", F.lit("")).alias("tag"), F.col("source").isNull().alias("none")
    targets = source_targets(sizes).select(tag, none, "source_size", "target")
    cells = store(cells.select("*", tag, none).join(targets, ["tag", "none"]).drop("tag", "none"))
    quotas = shard_quotas(cells).select("shard", "source", "quota")
    quotas = cells.select("*", tag, none).join(quotas.select("shard", tag, none, "quota"), ["shard", "tag", "none"], "left")
    taken = F.least(F.coalesce("quota", F.lit(0)) * BLOCK_WORDS, MAX_REPEAT * F.col("cell_size"))
    blocks = F.ceil(F.greatest(F.col("cell_size"), F.lit(1)) / BLOCK_WORDS)
    start = _hash_int(F.concat_ws("|", F.lit(str(SEED)), "source", F.col("shard").cast("string"))) % blocks * BLOCK_WORDS
    quotas = (
        quotas.withColumn("rounds", F.when(F.col("cell_size") > 0, F.floor(taken / F.col("cell_size"))).otherwise(0))
        .withColumn("lo", start)
        .withColumn("end", F.col("lo") + taken - F.col("rounds") * F.col("cell_size"))
        .select(
            "shard", "tag", "none", "source_size", "target", "rounds", "lo", F.least("end", "cell_size").alias("hi"),
            F.greatest(F.lit(0), F.col("end") - F.col("cell_size")).alias("wrap"),
        )
    )
    order = Window.partitionBy("shard", "source").orderBy("key", "doc_id", "size")
    before = F.sum(F.col("size") * F.col("copies")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    placed = sizes.withColumn("first", F.coalesce(before, F.lit(0))).select("*", tag, none)
    return placed.join(quotas, ["shard", "tag", "none"]).select(
        "key", "doc_id", "size", "copies", "source_size", "target", "first", "rounds", "lo", "hi", "wrap"
    )


def _each_copy(plan: DataFrame) -> DataFrame:
    plan = plan.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    plan = plan.withColumn("at", F.col("first") + F.col("copy") * F.col("size"))
    over = lambda lo, hi: F.greatest(F.lit(0), F.least(F.col("at") + F.col("size"), hi) - F.greatest(F.col("at"), lo))
    return plan.withColumn("main", over(F.col("lo"), F.col("hi"))).withColumn("tail", over(F.lit(0), F.col("wrap")))


def taken_words(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken of every document.

    A NULL text has size 0; NULL is a source of its own, the last one. Equal rows stand next
    to each other in the order and are all returned. An empty table gives an empty result.
    Reruns agree: nothing depends on how rows are split. Other columns are ignored.
    """
    return _each_copy(plan_mix(docs)).select(
        "doc_id", "size", "source_size", "target",
        (F.col("rounds") * F.col("size") + F.col("main") + F.col("tail")).cast("long").alias("taken"),
    )


def mixed_documents(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The mix itself: one row for each whole repeat and one for each part that is taken.

    ``columns`` are kept, the text being the words taken with the white space between them.
    Documents without words have nothing to take and stay out; n_chars follows the text.
    """
    plan = _each_copy(plan_mix(docs)).where("size > 0")
    whole = F.array_repeat(F.struct(F.lit(0).cast("long").alias("skip"), F.col("size").alias("n")), F.col("rounds").cast("int"))
    part = F.struct(F.greatest(F.lit(0), F.col("lo") - F.col("at")).cast("long").alias("skip"), F.col("main").cast("long").alias("n"))
    tail = F.struct(F.lit(0).cast("long").alias("skip"), F.col("tail").cast("long").alias("n"))
    spans = F.filter(F.concat(whole, F.array(part, tail)), lambda x: x["n"] > 0)
    spans = plan.select("key", "size", F.explode(spans).alias("span")).select("key", "size", "span.skip", "span.n")
    own = pick(docs, *columns)
    texts = own.withColumn("key", row_key()).dropDuplicates(["key"])
    pieces = F.split(F.regexp_replace("text", r"^[\x20\x09-\x0D]+", ""), r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])")
    excerpt = F.array_join(F.slice(pieces, (F.col("skip") + 1).cast("int"), F.col("n").cast("int")), "")
    rows = texts.join(spans, "key").withColumn("text", F.when(F.col("n") == F.col("size"), F.col("text")).otherwise(excerpt))
    if "n_chars" in columns:
        rows = rows.withColumn("n_chars", F.length("text").cast("long"))
    return rows.select(*columns)


SQL = f"""
WITH s0 AS (
  SELECT md5(concat_ws('|', '{SEED}', doc_id::VARCHAR, source, md5(coalesce(text, '')),
                       CASE WHEN doc_id IS NULL THEN 'no doc_id' END, CASE WHEN source IS NULL THEN 'no source' END)) AS key, doc_id, source,
         coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size
  FROM documents),
s1 AS (SELECT key, doc_id, source, size, count(*) AS copies FROM s0 GROUP BY ALL),
n AS (SELECT greatest(1, ceil(coalesce(sum((size + {ROW_WORDS}) * copies), 0) / {SHARD_WORDS}))::BIGINT AS shards FROM s1),
s AS (SELECT s1.*, ('0x' || substr(key, 1, 8))::BIGINT % shards AS shard FROM s1, n),
t0 AS (
  SELECT source, sum(size * copies)::BIGINT AS source_size,
         [{', '.join(map(str, WEIGHTS))}][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1] AS weight
  FROM s GROUP BY source),
t1 AS (
  SELECT *, {MAX_REPEAT} * source_size AS cap,
         ({SHARE}::DOUBLE * sum(source_size) OVER ()
          - coalesce(sum({MAX_REPEAT} * source_size) OVER (ORDER BY {MAX_REPEAT} * source_size / weight, source NULLS LAST
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY {MAX_REPEAT} * source_size / weight, source NULLS LAST
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM t0),
t AS (
  SELECT source, source_size, coalesce(least(cap::DOUBLE, weight * (max(level) OVER ())), 0) AS target
  FROM t1),
c0 AS (SELECT shard, source, sum(size * copies)::BIGINT AS cell_size FROM s GROUP BY shard, source),
c1 AS (
  SELECT c0.*, source_size, target, CASE WHEN source_size > 0 THEN target * cell_size / source_size ELSE 0 END AS goal
  FROM c0 JOIN t ON c0.source IS NOT DISTINCT FROM t.source),
c2 AS (
  SELECT *, sum(goal) OVER (PARTITION BY shard) AS goals, count(*) OVER (PARTITION BY shard) AS sources,
         floor(goal / {BLOCK_WORDS} + 0.5)::BIGINT AS near FROM c1),
c3 AS (
  SELECT *, greatest(0, near - (ceil(1.5 * sources * coalesce(goal / nullif(goals, 0), 0))::BIGINT + 2)) AS sure,
         near + ceil(1.5 * sources * coalesce(goal / nullif(goals, 0), 0))::BIGINT + 2 AS most FROM c2),
c AS (SELECT *, floor(goals / {BLOCK_WORDS} + 0.5)::BIGINT - sum(sure) OVER (PARTITION BY shard) AS open FROM c3),
q0 AS (SELECT shard, source, sure, goal, open, unnest(range(sure, most + 1)) AS k FROM c WHERE goal > 0),
q1 AS (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY goal / (2 * k + 1) DESC, source NULLS LAST, k) AS place FROM q0),
q AS (SELECT shard, source, first(sure) + sum((place <= open)::INT) AS quota FROM q1 GROUP BY shard, source),
r0 AS (
  SELECT c.shard, c.source, c.cell_size, c.source_size, c.target,
         least(coalesce(quota, 0) * {BLOCK_WORDS}, {MAX_REPEAT} * c.cell_size)::BIGINT AS words,
         ('0x' || substr(md5(concat_ws('|', '{SEED}', c.source, c.shard::VARCHAR)), 1, 8))::BIGINT
           % ceil(greatest(c.cell_size, 1) / {BLOCK_WORDS})::BIGINT * {BLOCK_WORDS} AS lo
  FROM c LEFT JOIN q ON c.shard = q.shard AND c.source IS NOT DISTINCT FROM q.source),
r AS (SELECT *, CASE WHEN cell_size > 0 THEN words // cell_size ELSE 0 END AS rounds FROM r0),
e AS (SELECT *, lo + words - rounds * cell_size AS stop FROM r),
p AS (
  SELECT *, coalesce(sum(size * copies) OVER (PARTITION BY shard, source ORDER BY key, doc_id, size
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM s),
o AS (
  SELECT p.doc_id, p.size, e.source_size, e.target, e.rounds, e.lo, least(e.stop, e.cell_size) AS hi,
         greatest(0, e.stop - e.cell_size) AS wrap, p.start + unnest(range(0, p.copies)) * p.size AS pos
  FROM p JOIN e ON p.shard = e.shard AND p.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target,
       (rounds * size + greatest(0, least(pos + size, hi) - greatest(pos, lo)) + greatest(0, least(pos + size, wrap) - pos))::BIGINT AS taken
FROM o
"""
