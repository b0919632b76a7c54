"""Token alignment, the k-means tree and collocations against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from llm_data import edge_docs, edge_rows, empty_docs, sentence

from swelter.llm import collocations, kmeans_tree, token_align
from swelter.llm.common import table

SMALL = "/root/testdata/sf0.01"


# token alignment


def brute_alignment(text, a, b, spell_a):
    """Ids, byte ends and overlapping places of both sides, straight from the libraries."""
    if not text:
        return [], [], [], []
    ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    pieces = [b.IdToPiece(i) for i in ids[1]]
    spans_b = [bytes([int(p[3:5], 16)]) if b.IsByte(i) else p.replace("▁", " ").encode() for i, p in zip(ids[1], pieces)]
    spans_a = [bytes(spell_a[c] for c in a.id_to_token(i)) for i in ids[0]]
    if {b"".join(spans_a), b"".join(spans_b)} != {(" " + text).encode()}:
        return [], [], [], []
    ends = [np.cumsum([len(x) for x in s]).tolist() for s in (spans_a, spans_b)]
    starts = [[0, *e[:-1]] for e in ends]
    over = [(i, j) for i in range(len(ids[0])) for j in range(len(ids[1])) if starts[0][i] < ends[1][j] and starts[1][j] < ends[0][i]]
    return *ids, over, [(i, j) for i, j in over if ends[0][i] == ends[1][j]]


def spelled(ids_a, ids_b, links):
    groups, i, j = [], 0, 0
    for x, y in links:
        groups.append(",".join(map(str, ids_a[i : x + 1])) + "|" + ",".join(map(str, ids_b[j : y + 1])))
        i, j = x + 1, y + 1
    return hashlib.sha256(";".join(groups).encode()).hexdigest() if ids_a else ""


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(token_align.VOCABULARY_A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=token_align.VOCABULARY_B), token_align._byte_of_char()


AWKWARD = ["<|endoftext|> a <s></s> b", "a  b\t\tc d e", "  lead and trail  ", "ﬁne ① Å é é", "\x00\x01 nul", "x" * 3000, "don't I'll we've 12 345", "​﻿z", "a\r\nb", "lower▁block"]


def test_alignment_like_brute_force(spark, libraries):
    r = random.Random(3)
    signs = "ab AB.,'é漢😀ß\n\t 12" + "̀"
    rows = [x for x in edge_rows(long_words=300)]
    rows += [(200 + k, t, "en", "s", 1) for k, t in enumerate(AWKWARD)]
    rows += [(300 + k, "".join(r.choice(signs) for _ in range(r.randint(1, 60))), None, None, None) for k in range(60)]
    docs = edge_docs(spark, rows)
    want = [brute_alignment(t, *libraries) for _, t, *_ in rows]
    got = token_align.align_tokens(docs).collect()
    by_place = lambda x: (str(x[0]), str(x[1:]))
    assert sorted(
        ((x.doc_id, x.a_ids, x.b_ids, list(zip(x.over_a, x.over_b)), list(zip(x.link_a, x.link_b))) for x in got), key=by_place
    ) == sorted(((row[0], *w) for row, w in zip(rows, want)), key=by_place)
    assert any(w[0] for w in want) and any(t and not w[0] for (_, t, *_), w in zip(rows, want))

    count = Counter((w[0][i], w[1][j]) for w in want for i, j in w[3])
    most = defaultdict(int)
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    wanted = []
    for row, (ids_a, ids_b, _, links) in zip(rows, want):
        ns = [(count[ids_a[i], ids_b[j]], most[ids_b[j]]) for i, j in links]
        wanted.append((row[0], len(ids_a), len(ids_b), len(links), len(links), sum(n == m for n, m in ns), sum(n for n, _ in ns), spelled(ids_a, ids_b, links)))
    for head in (token_align.HEAD, 5):  # nearly all pairs beyond the head
        found = [tuple(x) for x in token_align.alignment_digest(docs, head=head).collect()]
        assert sorted(found, key=by_place) == sorted(wanted, key=by_place)


def test_alignment_of_no_documents(spark):
    assert token_align.alignment_digest(empty_docs(spark)).collect() == []
    only_empty = edge_docs(spark, [(1, None, None, None, None), (2, "", "en", "s", 0)])
    assert {tuple(x) for x in token_align.alignment_digest(only_empty).collect()} == {(k, 0, 0, 0, 0, 0, 0, "") for k in (1, 2)}


def test_digests_are_made_of_few_texts_in_the_task_that_aligns_them(spark):
    """A task holds the tokens of ``ALIGNED`` characters, and no second worker gets them."""
    rows = [(k, "lorem ipsum " * 1000, "en", "s", 1) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)
    together = token_align.align_tokens(docs, then=lambda a_ids, *rest: [pa.array([len(a_ids)] * len(a_ids), pa.int32())], out="together int")
    assert together._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert {x.together for x in together.collect()} == {token_align.ALIGNED // 12_000}
    assert [tuple(x)[1:] for x in token_align.alignment_digest(docs).collect()] == [tuple(x)[1:] for x in token_align.alignment_digest(docs.repartition(60)).collect()]


def test_both_libraries_of_side_a_agree(spark, libraries):
    """The vocabulary file is read by a faster library; it gives the same ids."""
    pair = token_align.load_pair()
    texts = [r.text for r in table(spark, SMALL, "documents").select("text").collect()] + AWKWARD
    texts += [f"a{chr(c)}b {chr(c)}{chr(c)} 1{chr(c)}" for c in range(1, 0x3000, 7)]
    assert [pair.a.encode_ordinary(" " + t) for t in texts] == [x.ids for x in libraries[0].encode_batch([" " + t for t in texts], add_special_tokens=False)]


# nearest neighbours

VECTORS = "vec_id long, embedding array<float>, score string, leaf string, v string"


def brute_nearest(rows):
    """Each query's nearest by the definition."""
    from fractions import Fraction

    good = []
    for i, v, *_ in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v) and (i, v) not in good:
            good.append((i, v))
    length = Counter(len(v) for _, v in good)
    size = min(length, key=lambda k: (-length[k], k)) if length else 0
    good = [(i, v) for i, v in good if len(v) == size]

    def cosine(a, b):
        dot = sum(Fraction(x) * Fraction(y) for x, y in zip(a, b))
        return (1 if dot >= 0 else -1) * float(dot * dot / (sum(Fraction(x) ** 2 for x in a) * sum(Fraction(y) ** 2 for y in b))) ** 0.5

    out = []
    for i, v in good:
        if i % 50 == 0:
            scores = sorted(((round(-cosine(v, w), 12), j) for j, w in good if (j, w) != (i, v)))[:5]
            out += [(i, k + 1, j, -s) for k, (s, j) in enumerate(scores)]
    return sorted(out)


def vector_rows():
    r = np.random.default_rng(4)
    f = lambda v: [float(np.float32(x)) for x in v]
    rows = [(k, f(r.normal(size=6))) for k in range(120)]
    same = f(r.normal(size=6))
    rows += [(200 + k, same) for k in range(60)] + [(300 + k, [2.0 * x for x in same]) for k in range(9)]
    rows += [(400, f(r.normal(size=6))), (400, f(r.normal(size=6))), (450, same), (450, same), (-50, f(r.normal(size=6)))]
    rows += [(500, None), (550, []), (600, [0.0] * 6), (650, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (700, [float("nan")] + [1.0] * 5), (750, [float("inf")] + [1.0] * 5)]
    rows += [(800, [1.0, 2.0]), (None, same), (850, f(1e-30 * r.normal(size=6))), (851, f(1e30 * r.normal(size=6)))]
    return [(*x, "x", "y", "z") for x in rows]


def test_neighbours_like_brute_force(spark):
    """With so few rows every leaf is visited, so nothing is approximate."""
    rows = vector_rows()
    got = kmeans_tree.nearest_neighbours(spark.createDataFrame(rows, VECTORS)).collect()
    assert sorted((x.query_id, x.rank, x.vec_id, round(x.score, 12)) for x in got) == brute_nearest(rows)


def test_no_neighbours(spark):
    make = lambda rows: sorted(tuple(x) for x in kmeans_tree.nearest_neighbours(spark.createDataFrame(rows, VECTORS)).collect())
    assert make([]) == [] and make([(0, None, "", "", ""), (50, [0.0], "", "", "")]) == [] and make([(0, [1.0], "", "", "")]) == []
    assert make([(0, [1.0, 0.0], "", "", ""), (1, [1.0, 0.0], "", "", "")]) == [(0, 1, 1, 1.0)]


def test_recall_and_scores_with_many_leaves(spark, monkeypatch):
    """A tree on a small part of the rows, several cells, one vector that a third of the rows share."""
    monkeypatch.setattr(kmeans_tree, "SAMPLE", 1500)
    monkeypatch.setattr(kmeans_tree, "LEAF_SAMPLE", 16)
    monkeypatch.setattr(kmeans_tree, "CELL_VALUES", 6000)
    r = np.random.default_rng(5)
    centres = r.normal(size=(40, 12))
    v = np.concatenate([centres[r.integers(0, 40, 3000)] + 0.3 * r.normal(size=(3000, 12)), np.tile(centres[:1], (1500, 1))]).astype(np.float32)
    ids = r.permutation(len(v))
    got = kmeans_tree.nearest_neighbours(spark.createDataFrame([(int(i), x.tolist(), "", "", "") for i, x in zip(ids, v)], VECTORS)).toPandas()
    u = v.astype(np.float64) / np.linalg.norm(v.astype(np.float64), axis=1, keepdims=True)
    hits = total = 0
    place = {int(i): k for k, i in enumerate(ids)}
    for q, mine in got.sort_values(["query_id", "rank"]).groupby("query_id"):
        scores = u @ u[place[q]]
        scores[place[q]] = -9
        order = np.lexsort((ids, -scores.round(12)))[:5]
        assert mine["rank"].tolist() == [1, 2, 3, 4, 5]
        assert np.allclose(scores[[place[i] for i in mine["vec_id"]]], mine["score"], atol=1e-12)
        hits, total = hits + len(set(mine["vec_id"]) & set(ids[order])), total + 5
    assert len(got) == 5 * len([i for i in ids if i % 50 == 0]) and hits / total >= 0.95


def test_best_bin_first_order():
    """Leaves come in the order of a queue over all opened nodes, here by sorting it anew at every step."""
    r = np.random.default_rng(6)
    points = kmeans_tree.unit(r.normal(size=(3000, 8)))
    tree = kmeans_tree.grow(points)
    leaf = kmeans_tree.descend(tree, points)
    assert set(leaf) <= set(tree.leaves.tolist()) and len(tree.leaves) > 20
    near = tree.centre @ points[0]
    waiting, order = [0], []
    while waiting:
        waiting.sort(key=lambda k: (-near[k], k))
        node = waiting.pop(0)
        if tree.many[node]:
            waiting += range(tree.first[node], tree.first[node] + tree.many[node])
        else:
            order.append(node)
    assert kmeans_tree.best_bin_first(tree, near, len(near)) == order and sorted(order) == tree.leaves.tolist()


# collocations


def brute_phrases(rows, least):
    f = defaultdict(Counter)
    for _, text, lang, *_ in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            for k in range(1, 5):
                f["und" if lang is None else lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        total = sum(v for k, v in c.items() if len(k) == 1)
        wanted = {k: v for k, v in c.items() if len(k) > 1 and v >= least}
        inside = {k[i : i + s] for k, v in wanted.items() for s in range(2, len(k)) for i in range(len(k) - s + 1) if 100 * v >= 80 * wanted[k[i : i + s]]}
        best = []
        for k, a in wanted.items():
            if k not in inside:
                score, _, left, rest = min((2_000_000 * a // (c[k[:j]] + c[k[j:]]), j, c[k[:j]], c[k[j:]]) for j in range(1, len(k)))
                best.append((-score, -a, " ".join(k).encode(), left, rest))
        out += [(lang, n + 1, x[2].decode(), -x[1], x[3], x[4], total, -x[0]) for n, x in enumerate(sorted(best)[: collocations.REPORTED])]
    return sorted(out)


@pytest.mark.parametrize("head,bits", [(collocations.HEAD, collocations.BITS), (7, 64)])
def test_phrases_like_brute_force(spark, head, bits):
    """The second time nearly all words and runs lie beyond the ranks, and the bit table is full."""
    r = random.Random(8)
    words = "New york TIMES über a\xa0b 漢字 <x> of the in".split(" ")
    rows = edge_rows(long_words=500)
    for k in range(500):
        text = "".join(r.choice(words) + r.choice([" ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", "? "]) for _ in range(r.randint(0, 60)))
        rows.append((1000 + k, text, r.choice(["en", "de", None, "und"]), "s", 1))
    rows += [(2000, "New york times, new york times! the " * 40, "fr", "s", 1)]
    got = [tuple(x) for x in collocations.collocations(edge_docs(spark, rows), head=head, bits=bits).collect()]
    want = brute_phrases(rows, collocations.LEAST)
    assert sorted(got) == want and {x[0] for x in want} >= {"en", "de", "und", "fr"}


def test_phrases_of_no_documents(spark):
    assert collocations.collocations(empty_docs(spark)).collect() == []
    assert collocations.collocations(edge_docs(spark, [(1, None, None, None, None), (2, "one two", "en", "s", 0)])).collect() == []


def test_tiles_count_like_a_counter(monkeypatch):
    monkeypatch.setattr(collocations, "TILE", 8)
    r = np.random.default_rng(9)
    left, right = r.zipf(1.3, 5000) % 300, r.zipf(1.3, 5000) % 200
    x, y, n = collocations.count_tiles(left, right)
    assert dict(zip(zip(x.tolist(), y.tolist()), n.tolist())) == Counter(zip(left.tolist(), right.tolist())) and len(x) == len(set(zip(x.tolist(), y.tolist())))


def test_counts_of_runs_are_added_up():
    r = np.random.default_rng(4)
    rows, n = r.integers(0, 4, (2000, 4)).astype(np.uint64), r.integers(1, 9, 2000)
    want = Counter()
    for row, k in zip(rows.tolist(), n.tolist()):
        want[tuple(row)] += k
    got, sums = collocations.add_up(rows, n)
    assert len(got) == len(want) and dict(zip(map(tuple, got.tolist()), sums.tolist())) == want
    none, no_sums = collocations.add_up(rows[:0], n[:0])
    assert none.shape == (0, 4) and len(no_sums) == 0


def test_a_task_hands_on_a_run_of_four_once(spark):
    """Rows of the last step follow the cores and the different runs, not the parts of the table."""
    docs = spark.range(960).selectExpr("'en' as lang", "'new york city hall opens , ' || cast(id % 2 as string) || ' of them' as text").repartition(96)
    words = collocations.ranks(collocations.word_counts(docs).select("h", "n"), collocations.HEAD, collocations.BITS)
    encoded, shorter = collocations.encode(docs, words), words
    for size in (2, 3):
        shorter = collocations.ranks(collocations._named(collocations.run_counts(encoded, words, shorter, size)), collocations.HEAD, collocations.BITS)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        made = collocations.task_counts(encoded, words, shorter, 4, flush=4).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    sums, times = Counter(), Counter()
    for *run, n in made:
        sums[tuple(run)] += n
        times[tuple(run)] += 1
    assert sorted(sums.values()) == [960, 960]
    assert max(times.values()) <= max(2 * spark.sparkContext.defaultParallelism, 96 // collocations.PARTS) < 96


def test_long_products_are_exact(spark):
    """Counts whose product with the scale passes 64 bits."""
    big = 9_000_000_000_000_000_007
    runs = spark.createDataFrame([(1, [1], big), (2, [2], big - 3), (3, [1, 2], big - 5)], "h long, words array<bigint>, n long")
    row = collocations._scored(runs).first()
    assert row.score == 2_000_000 * (big - 5) // (2 * big - 3)
