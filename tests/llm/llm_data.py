"""Awkward tables for the training-data operators, and DuckDB over the same rows."""

import random
import re

import duckdb
import pyarrow as pa

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def sentence(r, n):
    syllables = "ba ke li mo nu ra se ti vo zu".split()
    return " ".join("".join(r.choice(syllables) for _ in range(r.randint(1, 4))) for _ in range(n))


def copy_shingles(text):
    """The runs of five words (all words if there are fewer) of a text."""
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def alike(a, b):
    return len(a & b) >= 0.8 * len(a | b)


def edge_rows(seed=1, long_words=30_000):
    """NULLs in every column, empty and very long texts, ties, repeated rows."""
    r = random.Random(seed)
    line = sentence(r, 60)
    rows = [(i, sentence(r, r.randint(1, 120)), r.choice(["en", "de"]), f"s{i % 4}", 5) for i in range(40)]
    rows += [
        (None, sentence(r, 30), "en", "s1", None), (None, sentence(r, 30), "en", None, 7), (None, None, None, None, None),
        (100, None, "en", "s0", 0), (101, "", "en", "s0", 0), (102, " \t\n ", None, "s2", 3), (103, "ab", "en", "s1", 2),
        (104, "one two", "de", "s1", 7), (105, sentence(r, long_words), "en", "s2", 1), (106, "x " * 50, "de", "s3", 100),
        (107, line + "\n" + sentence(r, 5), "en", "s0", 1), (108, sentence(r, 4) + "\n" + line, "en", "s0", 1), (109, line + "\n" + line, "de", "s1", 1),
        (110, "ÄÖ ñandú 漢字 \U0001f600 𐐀𐐁 mañana", "es", "sé", 1), (110, "same id other text", "en", "s1", 1),
        (111, "#* $% &| <> a\n\nb\nb\nb", "en", "S", 1), (112, "a\r\nb\x0bc\x0cd e", "en", "", 1),
    ]
    return rows + [rows[0]] * 2 + [rows[-1]] + [(None, None, None, None, None)]


def edge_docs(spark, rows=None):
    """The rows with extra columns whose names an operator or Spark might use itself."""
    df = spark.createDataFrame(edge_rows() if rows is None else rows, DOC)
    extra = "score size key row fp kept item_ids comp bucket shard copies _score _row".split()
    df = df.selectExpr("*", *[f"'x' as {c}" for c in extra])
    return df.toDF(*df.columns[:-1], "TEXT")


def empty_docs(spark):
    return edge_docs(spark, [])


def duck_of(**tables):
    con = duckdb.connect()
    for name, df in tables.items():
        con.register(name, df.toArrow() if hasattr(df, "toArrow") else pa.table(df))
    return con


def plain_docs(spark, rows=None):
    return spark.createDataFrame(edge_rows() if rows is None else rows, DOC)
