"""Host-level quality rules: rule failures per domain, shrunk by an empirical beta prior.

Everything is built-in functions: the text is read once, six small numbers per document are
stored, failures are summed per host, and the verdict of the host is joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swelter.llm.common import pick, store, words

SYMBOLS = "[#*$%&|<>]"
WINDOW = 5
#: Rules of a document beside the base rule; a document counts against its host when any fails.
MAX_SYMBOLS_PER_WORD = 0.1
MEAN_WORD = (2.0, 15.0)
MAX_DUP_LINES = 0.3
#: A host goes when its shrunk failure rate is above this.
MAX_HOST_RATE = 0.5
#: Weight (in documents) of the prior where the hosts do not differ enough to fit one.
PRIOR_DOCS = 10.0


def _add(df: DataFrame, **columns: Column | str) -> DataFrame:
    return df.withColumns({k: F.expr(v) if isinstance(v, str) else v for k, v in columns.items()})


def text_counts(docs: DataFrame, *keep: str) -> DataFrame:
    """Counts of every text: ``keep`` columns, then n_words, word_chars, n_symbols,
    n_lines (those with a word), n_dup_lines, n_repeat_words.

    Windows of five words are compared by hash. Hash and position share one number, so one
    sort of plain longs per text brings equal windows side by side; neighbours with equal
    hashes are then compared word by word. A NULL text has no words; an empty one neither.
    Memory per row is a few numbers per word, so very long texts only need their own size.
    """
    df = pick(docs, *keep, "text").withColumn("text", F.coalesce("text", F.lit("")))
    df = _add(
        df,
        words=words(F.col("text")),
        n_symbols=F.regexp_count("text", F.lit(SYMBOLS)).cast("long"),
        lines=F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
    )
    df = _add(
        df.drop("text"),
        n_words="cast(size(words) as bigint)",
        word_chars="cast(length(array_join(words, '')) as bigint)",
        n_lines="cast(size(lines) as bigint)",
        n_dup_lines="cast(size(lines) - size(array_distinct(lines)) as bigint)",
        hashes="transform(words, w -> xxhash64(w))",
        bits="length(bin(size(words)))",
    ).drop("lines")
    ahead = ", ".join(f"get(hashes, i + {k})" for k in range(WINDOW))
    df = _add(
        df,
        marks=f"""case when n_words >= {WINDOW} then sort_array(transform(
            sequence(0, cast(n_words as int) - {WINDOW}),
            i -> shiftleft(shiftright(xxhash64({ahead}), bits), bits) + i)) else array() end""",
    ).drop("hashes")
    df = _add(df, all_marks="cast(marks as array<bigint>)").drop("marks")

    def same(other: str) -> str:
        place = "cast({} - shiftleft(shiftright({}, bits), bits) as int) + 1"
        mine, yours = place.format("x", "x"), place.format(other, other)
        return f"""coalesce(shiftright(x, bits) = shiftright({other}, bits)
            and slice(words, {mine}, {WINDOW}) = slice(words, {yours}, {WINDOW}), false)"""

    df = _add(
        df,
        starts=f"""sort_array(transform(
            filter(all_marks, (x, i) -> {same('get(all_marks, i - 1)')} or {same('get(all_marks, i + 1)')}),
            x -> x - shiftleft(shiftright(x, bits), bits)))""",
    )
    df = _add(
        df,
        n_repeat_words=f"""aggregate(starts, named_struct('last', cast(-{WINDOW} as bigint), 'n', 0L),
            (a, p) -> named_struct('last', p, 'n', a.n + least({WINDOW}L, p - a.last)), a -> a.n)""",
    )
    return df.select(*keep, "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def rule_failed() -> Column:
    """True when a document breaks the base rule or one of the ratios."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    mean = F.col("word_chars") / n
    return (
        F.col("base_failed")
        | (F.col("n_symbols") > MAX_SYMBOLS_PER_WORD * n)
        | (mean < MEAN_WORD[0])
        | (mean > MEAN_WORD[1])
        | (F.col("n_dup_lines") > MAX_DUP_LINES * F.greatest(F.col("n_lines"), F.lit(1)))
    )


def host_verdicts(counts: DataFrame, host: str, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """One row per host: documents, failures, shrunk rate and whether the host is rejected.

    The prior is a beta distribution with the mean and the variance of the hosts' raw rates
    (method of moments). Where these leave no valid prior (one host, or rates too alike or
    too far apart) the mean counts as ``PRIOR_DOCS`` documents. NULL is a host of its own.
    """
    per = counts.groupBy(host).agg(
        F.count(F.lit(1)).alias("host_docs"), F.sum(F.col("failed").cast("long")).alias("host_failed")
    )
    rate = F.col("host_failed") / F.col("host_docs")
    spread = per.agg(F.avg(rate).alias("m"), F.var_samp(rate).alias("v"))
    fitted = F.col("m") * (1 - F.col("m")) / F.nullif("v", F.lit(0.0)) - 1
    weight = F.coalesce(F.when(fitted > 0, fitted), F.lit(PRIOR_DOCS))
    prior = spread.select("m", weight.alias("w")).first()
    mean, weight = (prior["m"] or 0.0), prior["w"]
    shrunk = (F.col("host_failed") + F.lit(mean * weight)) / (F.col("host_docs") + F.lit(weight))
    return per.select(host, "host_docs", "host_failed", (shrunk > max_rate).alias("host_rejected"))


def apply_host_rules(docs: DataFrame, host: str = "source", max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """Counts, base verdict, host verdict and ``kept`` of every document.

    Repeated rows are judged one by one and all returned; an empty table gives an empty
    result; columns other than doc_id, text and the host are ignored. The join back leaves
    the side to be copied to Spark, which knows both sizes from their shuffles and splits a
    hot host's rows.
    """
    counts = text_counts(docs, "doc_id", host).withColumn("base_failed", base_failed())
    counts = store(counts.withColumn("failed", rule_failed()))
    verdicts = host_verdicts(counts, host, max_rate)
    key = [F.coalesce(F.col(host), F.lit("")).alias("_host"), F.col(host).isNull().alias("_none")]
    joined = counts.select("*", *key).join(verdicts.select(*key, "host_docs", "host_failed", "host_rejected"), ["_host", "_none"])
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~F.col("host_rejected")).alias("kept"), "host_docs", "host_failed", "host_rejected",
    )


SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents),
g AS (
  SELECT rid, i, array_to_string(list_slice(w, i, i + 4), ' ') AS words
  FROM (SELECT rid, w, unnest(range(1, greatest(len(w) - 3, 1))) AS i FROM d)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, words) AS n FROM g) WHERE n > 1),
covered AS (SELECT rid, count(DISTINCT i + k) AS n FROM twice, unnest(range(0, 5)) AS u(k) GROUP BY rid),
lines AS (
  SELECT rid, count(*) AS lines, count(*) - count(DISTINCT l) AS n
  FROM (SELECT rid, unnest(string_split(t, chr(10))) AS l FROM d)
  WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]') GROUP BY rid),
c AS (
  SELECT d.doc_id, d.source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(lines.n, 0)::BIGINT AS n_dup_lines,
         coalesce(lines.lines, 0)::BIGINT AS n_lines,
         coalesce(covered.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN covered USING (rid) LEFT JOIN lines USING (rid)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM c),
f AS (
  SELECT *, base_failed OR n_symbols > {MAX_SYMBOLS_PER_WORD} * greatest(n_words, 1)
         OR word_chars / greatest(n_words, 1) < {MEAN_WORD[0]} OR word_chars / greatest(n_words, 1) > {MEAN_WORD[1]}
         OR n_dup_lines > {MAX_DUP_LINES} * greatest(n_lines, 1) AS failed
  FROM b),
h AS (SELECT source, count(*)::BIGINT AS host_docs, sum(failed::INT)::BIGINT AS host_failed FROM f GROUP BY source),
m AS (SELECT avg(host_failed / host_docs) AS m, var_samp(host_failed / host_docs) AS v FROM h),
p AS (
  SELECT m, CASE WHEN v > 0 AND m * (1 - m) / v - 1 > 0 THEN m * (1 - m) / v - 1 ELSE {PRIOR_DOCS} END AS w FROM m),
r AS (
  SELECT source, host_docs, host_failed, (host_failed + m * w) / (host_docs + w) > {MAX_HOST_RATE} AS host_rejected
  FROM h, p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT host_rejected AS kept, host_docs, host_failed, host_rejected
FROM f JOIN r ON f.source IS NOT DISTINCT FROM r.source
"""
