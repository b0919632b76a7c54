"""Operators with a SQL twin: host rules, mixing, revisits and line runs."""

import random

from compare import differences
from llm_data import DOC, duck_of, edge_docs, edge_rows, empty_docs, plain_docs, sentence
from pyspark.sql import functions as F

from swelter.llm import host_rules, line_runs, mixing, revisits


def brute_repeat_words(text):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    return len({i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(5)})


def test_host_rules_like_sql_on_awkward_rows(spark):
    got = host_rules.apply_host_rules(edge_docs(spark))
    assert differences(got, duck_of(documents=plain_docs(spark)), host_rules.SQL) == []


def test_repeat_words_like_brute_force(spark):
    r = random.Random(5)
    rows = [(i, " ".join(r.choice("abc") for _ in range(r.randint(0, 40))), "en", "s", 1) for i in range(150)]
    got = {x.doc_id: x.n_repeat_words for x in host_rules.text_counts(plain_docs(spark, rows), "doc_id").collect()}
    assert got == {i: brute_repeat_words(t) for i, t, *_ in rows}


def test_host_of_junk_takes_its_documents_along(spark):
    r = random.Random(2)
    rows = [(i, sentence(r, 40), "en", "good", 1) for i in range(60)]
    rows += [(100 + i, "# " * 30 if i else sentence(r, 40), "en", "bad", 1) for i in range(60)]
    got = {x.doc_id: x for x in host_rules.apply_host_rules(plain_docs(spark, rows)).collect()}
    assert got[0].kept and not got[100].base_failed and not got[100].kept and got[100].host_rejected


def test_host_of_repeated_lines_is_rejected(spark):
    """Only the rule on repeated lines fails these documents: 4 of their 13 lines are repeats, of 61 words."""
    r = random.Random(4)
    line = lambda: " ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(7))
    rows = [(k, line() + "\n" + line(), "en", "good", 1) for k in range(40)]
    for k in range(40):
        lines = [line() for _ in range(7)]
        menu = ["home news", "about us"]
        rows.append((100 + k, "\n".join([*lines, *menu, *menu, *menu]), "en", "menus", 1))
    docs = plain_docs(spark, rows)
    got = {x.doc_id: x for x in host_rules.apply_host_rules(docs).collect()}
    assert not got[100].base_failed and got[100].n_dup_lines == 4 and got[100].host_rejected and not got[100].kept
    assert got[0].kept and got[100].n_dup_lines < 0.3 * got[100].n_words
    assert differences(host_rules.apply_host_rules(docs), duck_of(documents=docs), host_rules.SQL) == []


def test_keys_tell_nulls_apart(spark):
    """A document without id of source 5, and document 5 without source, with one text."""
    text = sentence(random.Random(1), 2000)
    rows = [(None, text, "en", "5", 1), (5, text, "en", None, 1), (None, text, "en", None, 1)]
    kept = [(x.doc_id, x.source) for x in mixing.mixed_documents(plain_docs(spark, rows), ["doc_id", "text", "source"]).collect()]
    assert {(None, "5"), (5, None), (None, None)} == set(kept)


def test_host_rules_of_nothing(spark):
    assert host_rules.apply_host_rules(empty_docs(spark)).count() == 0


def test_mix_like_sql_on_awkward_rows(spark):
    got = mixing.taken_words(edge_docs(spark))
    assert differences(got, duck_of(documents=plain_docs(spark)), mixing.SQL) == []


def test_mix_in_many_shards(spark, monkeypatch):
    r = random.Random(3)
    rows = [(i, sentence(r, r.randint(1, 200)), "en", r.choice(["a", "b", "b", "b", "c", None]), 1) for i in range(400)]
    text = mixing.SQL.replace(str(mixing.SHARD_WORDS), "4000")
    monkeypatch.setattr(mixing, "SHARD_WORDS", 4000)
    df = plain_docs(spark, rows)
    assert differences(mixing.taken_words(df), duck_of(documents=df), text) == []


def water_filled(sizes):
    """Targets by sharing the excess again and again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    target, free, left = {}, set(order), 1.5 * sum(sizes.values())
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 2 * sizes[s]}
        if not over:
            return {**target, **{s: level * weight[s] for s in free}}
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        free -= over
    return target


def test_mix_meets_targets_and_limits(spark):
    r = random.Random(4)
    rows = [(i, sentence(r, r.randint(0, 300)), "en", r.choice(["a", "b", "b", "b", "c", "d", None]), 1) for i in range(500)]
    got = mixing.taken_words(plain_docs(spark, rows)).collect()
    source = {i: s for i, _, _, s, _ in rows}
    sizes, taken = {}, {}
    for x in got:
        assert 0 <= x.taken <= 2 * x["size"]
        sizes[source[x.doc_id]] = sizes.get(source[x.doc_id], 0) + x["size"]
        taken[source[x.doc_id]] = taken.get(source[x.doc_id], 0) + x.taken
    want = water_filled(sizes)
    assert all(abs(x.target - want[source[x.doc_id]]) < 1e-6 for x in got)
    assert all(abs(taken[s] - want[s]) <= mixing.BLOCK_WORDS for s in want)


def test_mixed_texts_hold_the_words_taken(spark):
    df = edge_docs(spark)
    mixed = mixing.mixed_documents(df, ["doc_id", "text", "source", "n_chars"])
    words = F.size(mixing_words("text"))
    got = {x.doc_id: x.n for x in mixed.groupBy("doc_id").agg(F.sum(words).alias("n")).collect()}
    want = {x.doc_id: x.n for x in mixing.taken_words(df).groupBy("doc_id").agg(F.sum("taken").alias("n")).where("n > 0").collect()}
    assert got == want
    whole = {(i, t) for i, t, *_ in edge_rows()}
    assert all((x.doc_id, x.text) in whole or any(x.text in (t or "") for i, t in whole if i == x.doc_id) for x in mixed.collect())


def mixing_words(column):
    from swelter.llm.common import words

    return words(F.col(column))


def quotients(goals, seats):
    got = dict.fromkeys(goals, 0)
    for _ in range(seats):
        got[max(goals, key=lambda s: (goals[s] / (2 * got[s] + 1), [-ord(c) for c in s]))] += 1
    return got


def test_quotas_are_those_of_the_highest_quotients(spark):
    r = random.Random(6)
    rows, want = [], {}
    for shard in range(25):
        cells = {f"s{k:02d}": r.randint(1, 5000) for k in range(r.randint(1, 12))}
        total = sum(cells.values())
        rows += [(shard, s, n, n, float(n) * 1.5) for s, n in cells.items()]
        want[shard] = quotients({s: 1.5 * n for s, n in cells.items()}, int(1.5 * total / mixing.BLOCK_WORDS + 0.5))
    cells = spark.createDataFrame(rows, "shard long, source string, cell_size long, source_size long, target double")
    got = {}
    for x in mixing.shard_quotas(cells).collect():
        got.setdefault(x.shard, {})[x.source] = x.quota
    assert got == want


def test_mix_of_nothing(spark):
    assert mixing.taken_words(empty_docs(spark)).count() == 0
    assert mixing.taken_words(plain_docs(spark, [(1, None, "en", "a", 0)])).collect()[0].target == 0.0


PAGES = "page_id long, url string, html string"


def test_revisits_like_sql(spark):
    r = random.Random(1)
    hosts = ["http://a.example/x", "https://www.A.example:443/x/#f", "http://a.example/y?b=2&a=1", "https://a.example/y?a=1&utm_source=q&b=2", None, ""]
    rows = [(i, r.choice(hosts), r.choice(["<p>1", "<p>2", None])) for i in range(0, 4000, 6)]
    df = spark.createDataFrame(rows, PAGES)
    got = revisits.resolve_revisits(revisits.captures_of(df.selectExpr("*", "1 as at", "2 as block", "3 as headers")))
    got = got.select("record_id", "canonical", F.col("at").alias("captured_at"), "outcome", "refers_to", revisits.header_lines(F.col("headers")).alias("headers"))
    assert differences(got, duck_of(pages=df), revisits.SQL) == []
    assert {x.outcome for x in got.select("outcome").distinct().collect()} >= {"resolved", "mismatch", "no validator", "no url"}


def test_revisit_rules(spark):
    e = lambda tag: {"etag": tag} if tag else {}
    rows = [
        (1, "http://h/a", 10, "response", {"etag": '"1"', "content-length": "9", "x": "old"}), (2, "http://h/a", 10, "response", e('"2"')),
        (3, "http://h/a", 10, "revisit", e('"2"')), (4, "https://h/a/", 11, "revisit", {"etag": 'W/"2"', "content-length": "0", "x": "new"}),
        (5, "http://h/a", 9000, "revisit", e('"1"')), (6, "http://h/a", 9000, "revisit", None), (7, None, 9000, "revisit", e('"2"')),
        (8, "http://h/a", None, "revisit", e('"2"')), (None, "http://h/a", 8000, "response", e('"9"')), (9, "http://h/A", 9000, "revisit", e('"2"')),
        (4, "https://h/a/", 11, "revisit", {"etag": 'W/"2"', "content-length": "0", "x": "new"}),
    ]
    df = spark.createDataFrame(rows, "record_id long, url string, at long, kind string, headers map<string,string>")
    got = sorted((x.record_id, x.outcome, x.refers_to) for x in revisits.resolve_revisits(df).collect())
    assert got == [
        (3, "no response", None), (4, "resolved", 2), (4, "resolved", 2), (5, "mismatch", None), (6, "no validator", None),
        (7, "no url", None), (8, "no response", None), (9, "no response", None),
    ]
    merged = [x.headers for x in revisits.resolve_revisits(df).where("record_id = 4").collect()][0]
    assert merged == {"etag": 'W/"2"', "x": "new"}
    assert revisits.resolve_revisits(df.limit(0)).count() == 0


def brute_lines(rows, least):
    """Delete every line that lies in a run of enough words of which a copy begins earlier."""
    import hashlib
    import re

    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, hashlib.md5((rows[i][1] or "").encode()).hexdigest()))
    docs = [(rows[i][1] or "").split("\n") for i in order]
    words = [[len(re.findall(r"[^\x20\x09-\x0D]+", x)) for x in d] for d in docs]
    seen, gone = set(), [set() for _ in docs]
    for d, lines in enumerate(docs):
        for a in range(len(lines)):
            for b in range(a, len(lines)):
                if sum(words[d][a : b + 1]) >= least and tuple(lines[a : b + 1]) in seen:
                    gone[d] |= set(range(a, b + 1))
            for b in range(a, len(lines)):
                seen.add(tuple(lines[a : b + 1]))
    return sorted((str(rows[i][0]), "\n".join(x for k, x in enumerate(docs[p]) if k not in gone[p])) for p, i in enumerate(order))


def test_line_runs_like_brute_force(spark):
    r = random.Random(8)
    lines = ["a b c", "d e", "f", "", "g h i j k l", "m n"]
    rows = [(i, "\n".join(r.choice(lines) for _ in range(r.randint(1, 14))), "en", "s", 1) for i in range(45)]
    rows += [rows[3], (None, rows[5][1], "en", "s", 1), (None, None, None, None, None)]
    for least in (1, 6, 13):
        got = sorted((str(x.doc_id), x.kept) for x in line_runs.dedup_lines(plain_docs(spark, rows), least).collect())
        assert got == brute_lines(rows, least), least


def test_line_runs_like_sql_on_awkward_rows(spark):
    kept = line_runs.dedup_lines(edge_docs(spark))
    got = kept.select("doc_id", "n_lines", "n_removed", F.length("kept").cast("long").alias("n_kept_chars"), F.md5("kept").alias("kept_md5"))
    assert differences(got, duck_of(documents=plain_docs(spark)), line_runs.SQL) == []
    assert line_runs.dedup_lines(empty_docs(spark)).count() == 0


def test_long_copies_are_deleted_whole(spark):
    r = random.Random(9)
    text = "\n".join(sentence(r, 3) for _ in range(300))
    rows = [(1, text, "en", "s", 1), (2, "own line\n" + text + "\nother", "en", "s", 1), (3, text, "en", "s", 1)]
    got = {x.doc_id: x.kept for x in line_runs.dedup_lines(spark.createDataFrame(rows, DOC)).collect()}
    assert got == {1: text, 2: "own line\nother", 3: ""}
