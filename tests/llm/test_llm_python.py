"""Operators without SQL: brute force, round trips and held-out accuracy."""

import itertools
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from llm_data import DOC, alike, copy_shingles, edge_docs, edge_rows, empty_docs, plain_docs, sentence

from swelter.llm import decontam, html_blocks, html_crf, language_spans, packing, quality_fm, simhash
from swelter.llm.html_samples import PageMaker

SMALL = "/root/testdata/sf0.01"


# near duplicates


def brute_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def brute_components(prints):
    label = list(range(len(prints)))
    for i, j in itertools.combinations(range(len(prints)), 2):
        if bin(prints[i] ^ prints[j]).count("1") <= 2 and label[i] != label[j]:
            old, new = max(label[i], label[j]), min(label[i], label[j])
            label = [new if x == old else x for x in label]
    return label


def test_near_duplicates_like_brute_force(spark):
    r = random.Random(1)
    rows = edge_rows(long_words=4000)
    base = sentence(r, 900).split()
    for k in range(40):
        words = list(base)
        for _ in range(k % 5):
            words[r.randrange(len(words))] = "X" + str(r.randrange(9))
        rows.append((500 - k, " ".join(words), "en", "s", 1))
    prints = [brute_fingerprint(t) for _, t, *_ in rows]
    label = brute_components(prints)
    first = {c: min((rows[i][0] for i in range(len(rows)) if label[i] == c and rows[i][0] is not None), default=None) for c in set(label)}
    want = sorted((str(rows[i][0]), f"{prints[i]:016x}", str(first[label[i]])) for i in range(len(rows)))
    got = simhash.near_duplicates(edge_docs(spark, rows)).collect()
    assert sorted((str(x.doc_id), x.fingerprint, str(x.component_id)) for x in got) == want


def test_one_of_each_like_brute_force(spark):
    """Every group is one chain of copies, or copies with edits of their own; edits near the limit on both sides."""
    r = random.Random(5)
    rows = edge_rows(long_words=4000)
    for g in range(12):
        base = sentence(r, r.randint(60, 400)).split()
        for k in range(6):
            words = list(base)
            for _ in range(max(1, len(words) * r.choice([2, 5, 60]) // 1000)):
                words[r.randrange(len(words))] = "X" + str(r.randrange(10**6))
            rows.append((1000 - 10 * g - k, " ".join(words), "en", "s", 1))
            base = words if g % 2 else base
    rows += [(2000 + k, rows[0][1].upper(), "en", "s", 1) for k in range(300)]
    sets, label = [copy_shingles(x[1]) for x in rows], list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        if label[i] != label[j] and alike(sets[i], sets[j]):
            old, new = max(label[i], label[j]), min(label[i], label[j])
            label = [new if x == old else x for x in label]
    kept = [x.doc_id for x in simhash.one_of_each(plain_docs(spark, rows), ["doc_id", "text"]).collect()]
    want = {min((x[0] for x, c in zip(rows, label) if c == group and x[0] is not None), default=None) for group in set(label)}
    missed = {x for x in kept if x is not None} - want
    assert want - {None} <= set(kept)
    assert len(kept) == len(set(label)) and not missed


def test_many_copies_with_one_fingerprint(spark):
    """Sets that share a fingerprint are compared with two of them, not with each other."""
    rows = [(k, [7 + (t << 8) for t in range(simhash.TABLES)]) for k in range(500)]
    pairs = simhash.copy_candidates(spark.createDataFrame(rows, "sid long, prints array<long>")).collect()
    assert {(x.a, x.b) for x in pairs} == {(0, k) for k in range(1, 500)} | {(k, 499) for k in range(499)}


def test_candidates_are_those_within_two_bits(spark):
    r = random.Random(6)
    rows = []
    for k in range(60):
        prints = [r.getrandbits(simhash.BITS) for _ in range(simhash.TABLES)] if k % 4 == 0 else list(rows[-1][1])
        t = r.randrange(simhash.TABLES)
        for b in r.sample(range(simhash.BITS), r.randint(1, 4)):
            prints = [p ^ (1 << b) if (i == t or k % 2) else p ^ (1 << b) * 0b111 % (1 << simhash.BITS) for i, p in enumerate(prints)]
        rows.append((k, prints))
    near = lambda p, q: any(bin(x ^ y).count("1") <= 2 for x, y in zip(p, q))
    want = {(i, j) for (i, p), (j, q) in itertools.combinations(rows, 2) if near(p, q)}
    got = simhash.copy_candidates(spark.createDataFrame(rows, "sid long, prints array<long>")).collect()
    assert want and {(x.a, x.b) for x in got} == want


def block_edits():
    """Pairs with one block added or replaced: similarity 0.8 exactly, and the next step below it."""
    r = random.Random(10)
    word = lambda: f"w{r.randrange(10**6)}"
    for k in range(120):
        more = 50 + k % 2
        if k % 4 < 2:
            base = [word() for _ in range(204)]
            at = r.choice([0, 204])
            other = base[:at] + [word() for _ in range(more)] + base[at:]
        else:
            base = [word() for _ in range(211)]
            at, size = r.randrange(10, 170), more - 31
            other = base[:at] + [word() for _ in range(size)] + base[at + size :]
        yield " ".join(base), " ".join(other)


def test_copies_with_one_block_added_or_replaced(spark):
    pairs = list(block_edits())
    near = [alike(copy_shingles(a), copy_shingles(b)) for a, b in pairs]
    assert near == [k % 2 == 0 for k in range(len(pairs))]
    docs = plain_docs(spark, [(2 * k + i, t, "en", "s", 1) for k, pair in enumerate(pairs) for i, t in enumerate(pair)])
    kept = {x.doc_id for x in simhash.one_of_each(docs, ["doc_id", "text"]).collect()}
    assert kept == {2 * k for k in range(len(pairs))} | {2 * k + 1 for k, x in enumerate(near) if not x}


def test_parities_of_large_sets_rule_out_strangers_alone(spark):
    """Never more bits than shingles that differ, also where one set has twice the classes; strangers differ in more than alike sets may."""
    r = np.random.default_rng(11)
    draw = lambda n: np.unique(r.integers(-(1 << 63), (1 << 63) - 1, n))
    rows, differ, strangers = [], [], []
    for n, m in ((900, 1000), (1000, 1100), (2000, 2100), (2040, 2060), (5000, 5100), (3800, 4300), (30000, 34000)):
        x = draw(n)
        near = np.unique(np.concatenate([x[: n - n // 20], draw(m - n + n // 20)]))
        for y, stranger in ((x, False), (near, False), (draw(m), True)):
            finest = [v if len(v) else simhash.parities(f) for f in (x, y) for v in [simhash.wide_parities(f)]]
            rows.append((len(rows), len(x) + len(y), *[v.tolist() for v in finest]))
            differ.append(len(np.setxor1d(x, y)))
            strangers.append(stranger)
    pairs = spark.createDataFrame(rows, "i int, both long, p array<long>, q array<long>")
    for x, y in (("p", "q"), ("q", "p")):
        got = [x.bits for x in pairs.select("i", simhash._differ(x, y).alias("bits")).orderBy("i").collect()]
        assert all(b <= d for b, d in zip(got, differ)) and got[0] == 0
        assert [9 * b > row[1] for b, row in zip(got, rows)] == strangers


def test_long_texts_in_pairs_near_the_limit(spark):
    """Long texts around the sizes at which parities get more bits, with edits on both sides of 0.8."""
    r = random.Random(12)
    texts = []
    for n in (1020, 1030, 2040, 2060, 4200):
        base = [f"w{r.randrange(10**6)}" for _ in range(n)]
        for share in (0, 0.02, 0.024, 0.04):
            words = list(base) + [f"w{r.randrange(10**6)}" for _ in range(int(20 * share))]
            for at in r.sample(range(n), int(share * n)):
                words[at] = f"v{r.randrange(10**6)}"
            texts.append(" ".join(words))
    sets, label = [copy_shingles(t) for t in texts], list(range(len(texts)))
    for i, j in itertools.combinations(range(len(texts)), 2):
        if label[i] != label[j] and alike(sets[i], sets[j]):
            old, new = max(label[i], label[j]), min(label[i], label[j])
            label = [new if x == old else x for x in label]
    assert 5 < len(set(label)) < len(texts)
    kept = [x.doc_id for x in simhash.one_of_each(plain_docs(spark, [(k, t, "en", "s", 1) for k, t in enumerate(texts)]), ["doc_id", "text"]).collect()]
    assert sorted(kept) == sorted(set(label))


def test_pairs_meet_at_their_first_shingle_alone_or_are_listed_once(spark, monkeypatch):
    """However few of the earlier shingles are looked at, every pair is listed, and once."""
    r = random.Random(13)
    sets = {sid: sorted(r.sample(range(60), 20)) for sid in range(30)}
    rows = spark.createDataFrame([(sid, 100, sid, at, h) for sid, hs in sets.items() for at, h in enumerate(hs)], "sid long, n long, comp long, at int, h long")
    distinct = spark.createDataFrame([(sid, [0] * (simhash.PARITIES // 64)) for sid in sets], "sid long, odd array<long>")
    want = {(i, j) for i, j in itertools.combinations(sets, 2) if set(sets[i]) & set(sets[j])}
    for back in (1, 4, 100):
        monkeypatch.setattr(simhash, "LOOK_BACK", back)
        ready = simhash._with_before(rows, distinct)
        got = [(x.a, x.b) for x in simhash._pairs(ready, ready, meet_once=True).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_star_of_variants_is_one_group(spark):
    """Variants alike to their original alone, which is neither the first nor the last of them by any id."""
    r = random.Random(8)
    base = [f"w{r.randrange(10**6)}" for _ in range(300)]
    texts = [" ".join(base)]
    for k in range(1000):
        words = list(base)
        for at in r.sample(range(10, 290, 8), 5):
            words[at] = f"v{k}x{at}"
        texts.append(" ".join(words))
    sets = [copy_shingles(t) for t in texts]
    assert all(alike(sets[0], s) for s in sets) and not any(alike(sets[i], sets[i + 1]) for i in range(1, 1000))
    # one original among many texts is easy to take for a leader; without it every variant stays alone
    for rows in (texts, texts[1:61]):
        docs = plain_docs(spark, [(k, t, "en", "s", 1) for k, t in enumerate(rows)])
        want = {0} if rows is texts else set(range(60))
        kept = [x.doc_id for x in simhash.one_of_each(docs, ["doc_id", "text"]).collect()]
        assert sorted(kept) == sorted(want)


def test_links_keep_what_is_reachable(spark):
    r = random.Random(2)
    prints = {0, 3, 6, 1 << 63}
    for _ in range(25):
        p = r.getrandbits(64)
        for _ in range(r.randint(1, 12)):
            prints.add(p)
            for _ in range(r.randint(1, 3)):
                p ^= 1 << r.randrange(64)
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    got = {x.fp: x.comp for x in simhash.components(spark.createDataFrame([(p,) for p in signed], "fp long")).collect()}
    label = brute_components(prints)
    groups = lambda ls: sorted(sorted(i for i in range(len(prints)) if ls[i] == x) for x in set(ls))
    assert groups([got[p] for p in signed]) == groups(label)


def test_near_duplicates_of_nothing(spark):
    assert simhash.near_duplicates(empty_docs(spark)).count() == 0
    assert simhash.one_of_each(empty_docs(spark), ["doc_id", "text"]).count() == 0


# decontamination


def sellers(pattern, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        now = [i]
        for j, e in enumerate(text, 1):
            now.append(min(row[j - 1] + (c != e), row[j] + 1, now[-1] + 1))
        row = now
    return min(row)


def brute_items(text, items):
    codes, out = decontam.normal(text).tolist(), set()
    for i, item in items:
        own = decontam.normal(item).tolist()
        if i is not None and 0 < len(own) < decontam.Q and own == codes:
            out.add(i)
        if i is not None and len(own) >= decontam.Q and any(sellers(own[a:b], codes) <= decontam.budget(b - a) for a, b in decontam.windows(len(own))):
            out.add(i)
    return sorted(out)


def edited(r, text, n):
    chars = list(text)
    for _ in range(n):
        k = r.randrange(len(chars))
        chars[k : k + 1] = r.choice(([], [chars[k], r.choice("abxyz ")], [r.choice("xyzÄ")]))
    return "".join(chars)


def test_decontamination_like_brute_force(spark, monkeypatch):
    r = random.Random(3)
    items = [(i, sentence(r, n)) for i, n in enumerate([2, 5, 8, 14, 20, 30, 45])]
    items += [(7, items[4][1]), (8, None), (None, "x"), (9, ""), (10, items[5][1].upper().replace(" ", ",\n"))]
    rows = []
    for k in range(90):
        _, item = r.choice([x for x in items if x[1] and x[0] is not None])
        part = item if r.random() < 0.6 else item[r.randrange(len(item)) :]
        middle = edited(r, part, r.choice([0, 1, 3, 5, 9])) if len(part) > 2 else part
        rows.append((k, sentence(r, r.randint(0, 12)) + " " + middle + " " + sentence(r, r.randint(0, 12)), "en", "s", 1))
    rows += [(200, None, "en", "s", 1), (201, "", "en", "s", 1), (None, items[5][1], "en", "s", 1), rows[0]]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    want = sorted((str(i), brute_items(t, items)) for i, t, *_ in rows)
    assert sum(bool(x) for _, x in want) > 30
    for size in (decontam.BLOCK_CHARS, 150):  # one block, and one per item or two
        monkeypatch.setattr(decontam, "BLOCK_CHARS", size)
        got = decontam.mark_contaminated(edge_docs(spark, rows), benchmark, "doc_id").collect()
        assert sorted((str(x.doc_id), x.item_ids) for x in got) == want
    clean = decontam.clean_documents(plain_docs(spark, rows), benchmark, ["doc_id", "text"])
    assert sorted(str(x.doc_id) for x in clean.collect()) == sorted(i for i, found in want if not found)
    assert decontam.mark_contaminated(empty_docs(spark), benchmark, "doc_id").count() == 0
    assert decontam.mark_contaminated(plain_docs(spark, rows), benchmark.limit(0), "doc_id").where("size(item_ids) > 0").count() == 0


def test_passages_of_all_places_of_an_item():
    """Every run of WINDOW characters of an item is found, verbatim and with the edits of its budget."""
    r = random.Random(9)
    item = sentence(r, 45)
    own = decontam.normal(item)
    blocks = [decontam.Block.of([(1, sentence(r, 30)), (2, item)])]
    text = lambda codes: "".join(map(chr, codes))
    around = lambda x: sentence(r, 30) + "#" + x + "#" + sentence(r, 30)
    for a in range(len(own) - decontam.WINDOW + 1):
        chars = list(text(own[a : a + decontam.WINDOW]))
        assert decontam.matched_items(around("".join(chars)), blocks) == [2]
        for at in r.sample(range(1, decontam.WINDOW - 1), decontam.budget(decontam.WINDOW)):
            chars[at] = "Q"
        assert decontam.matched_items(around("".join(chars)), blocks) == [2]
    assert decontam.matched_items(around(text(own[40:120])), blocks) == []
    starts = np.arange(len(own) - decontam.WINDOW + 1)
    for _ in range(20):
        other = decontam.normal(edited(r, item[r.randrange(60) :][:150], r.randint(0, 12)))
        band = (-len(own), len(other))
        brute = [min(5, sellers(own[a : a + decontam.WINDOW].tolist(), other.tolist())) for a in starts[::40]]
        assert [decontam.least_edits(own, starts[a : a + 1], decontam.WINDOW, other, band, 4) for a in starts[::40]] == brute
        assert decontam.least_edits(own, starts[::40], decontam.WINDOW, other, band, 4) == min(brute)


def test_very_long_texts_are_searched_across_chunks(monkeypatch):
    r = random.Random(4)
    items = [(1, sentence(r, 40)), (2, sentence(r, 40))]
    blocks = [decontam.Block.of(items)]
    monkeypatch.setattr(decontam, "CHUNK", 256)
    for lead in range(150, 300, 7):
        assert decontam.matched_items("z" * lead + " " + items[1][1] + " " + sentence(r, 200), blocks) == [2]


# packing


def unpacked(rows):
    out = {}
    for x in rows:
        ids = np.frombuffer(x.ids, packing.ID)
        assert len(ids) == 64 and x.cu_seqlens[-1] == x.n_tokens <= 64 and list(x.position_resets) == list(x.cu_seqlens[:-1])
        positions = packing.position_ids(x.cu_seqlens)
        assert [int(positions[k]) for k in x.position_resets] == [0] * len(x.doc_ids)
        for doc, piece, a, b in zip(x.doc_ids, x.pieces, x.cu_seqlens, x.cu_seqlens[1:]):
            out.setdefault(doc, []).append((piece, ids[a:b].tolist()))
    return out


@pytest.mark.parametrize("chars", [10_000_000, 20_000])
def test_packing_is_lossless(spark, chars, tmp_path):
    rows = [x for x in edge_rows(long_words=3000) if x[0] not in (None, 0, 110, 112)]
    packed = packing.pack_documents(edge_docs(spark, rows), row_tokens=64, shard_chars=chars)
    made = packed.collect()
    encoding = packing._encoding(packing.VOCABULARY)
    got = {}
    for doc, pieces in unpacked(made).items():
        pieces.sort()
        assert [p for p, _ in pieces] == list(range(len(pieces)))
        ids = [i for _, piece in pieces for i in piece]
        assert ids.pop() == packing.END_OF_TEXT
        got[doc] = encoding.decode(ids)
    assert got == {i: t or "" for i, t, *_ in rows}
    files = packing.write_binary(packed, str(tmp_path)).collect()
    assert sum(x.n_rows for x in files) == len(made)
    total = sum(len(np.fromfile(x.file, packing.ID)) for x in files)
    assert total == 64 * len(made)


def test_packing_keeps_repeated_rows_and_nulls(spark):
    rows = [(None, "a b", "en", "s", 1), (None, "a b", "en", "s", 1), (1, None, "en", "s", 1), (1, "x", "en", "s", 1), (1, "x", "en", "s", 1)]
    docs = [d for x in packing.pack_documents(plain_docs(spark, rows), row_tokens=8).collect() for d in x.doc_ids]
    assert sorted(docs, key=str) == [1, 1, 1, None, None]
    assert packing.pack_documents(empty_docs(spark)).count() == 0


def test_best_fit_decreasing_takes_the_fullest_row_that_fits():
    r = random.Random(5)
    for _ in range(60):
        top = r.randint(1, 40)
        lengths = [r.randint(1, top) for _ in range(r.randint(0, 60))]
        rows = packing.best_fit_decreasing(lengths, top)
        assert sorted(i for row in rows for i in row) == list(range(len(lengths)))
        free, count = [], 0
        for n in sorted(lengths, reverse=True):
            fits = [f for f in free if f >= n]
            if fits:
                free.remove(min(fits))
                free.append(min(fits) - n)
            else:
                count += 1
                free.append(top - n)
        assert len(rows) == count and sorted(free) == sorted(top - sum(lengths[i] for i in row) for row in rows)


# quality


def test_pairwise_terms_by_the_sum_of_squares():
    rng = np.random.default_rng(1)
    machine = quality_fm.Machine(0.3, rng.normal(size=quality_fm.SIZE), rng.normal(size=(quality_fm.SIZE, quality_fm.FACTORS)))
    text = "one two three two # one!\nfour"
    at, x = quality_fm.features(text, 9)
    pairs = sum(machine.factors[at[i]] @ machine.factors[at[j]] * x[i] * x[j] for i in range(len(at)) for j in range(i))
    raw = 0.3 + machine.weights[at] @ x + pairs
    assert machine.score(text, 9) == pytest.approx(1 / (1 + np.exp(-np.clip(raw, -30, 30))))


def test_quality_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    scored = quality_fm.classify_quality(docs, labels)
    rows = scored.join(labels, "doc_id").where("held_out").collect()
    assert len(rows) > 40
    assert sum(x.predicted == x.quality for x in rows) / len(rows) > 0.95
    again = {x.doc_id: x.score for x in quality_fm.classify_quality(docs.repartition(5), labels.repartition(3)).collect()}
    assert again == {x.doc_id: x.score for x in scored.collect()}



def test_the_fit_holds_its_sample_in_arrays(spark, monkeypatch):
    """The driver makes no Python object of every feature: rows are views of the arrays that arrived."""
    docs = plain_docs(spark)
    labels = docs.where("doc_id is not null").selectExpr("doc_id", "cast(doc_id % 2 as int) quality")
    got = []
    monkeypatch.setattr(quality_fm.Machine, "fit", classmethod(lambda cls, rows: got.extend(rows)))
    quality_fm.fit_quality(docs, labels)
    assert len(got) > 20 and not any(part.flags.owndata for at, x, _ in got for part in (at, x))
    texts = {}
    for r in docs.where("doc_id is not null").collect():
        texts.setdefault(r.doc_id, []).append((r.text is not None, r.text or "", r.text, r.n_chars))
    learned = sorted(i for i in texts if zlib.crc32(str(i).encode()) % 5)
    want = [(*quality_fm.features(*min(texts[i])[2:]), i % 2) for i in learned]
    assert [(at.tolist(), x.tolist(), y) for at, x, y in got] == [(at.tolist(), x.tolist(), y) for at, x, y in want]


def test_quality_never_learns_from_the_held_out_fold(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    hidden = quality_fm.held_out()
    assert all(x.h == (zlib.crc32(str(x.doc_id).encode()) % 5 == 0) for x in docs.select("doc_id", hidden.alias("h")).collect())
    turned = labels.withColumn("quality", (1 - labels.quality) * hidden.cast("int") + labels.quality * (~hidden).cast("int"))
    a, b = quality_fm.fit_quality(docs, labels), quality_fm.fit_quality(docs, turned)
    assert a.bias == b.bias and (a.weights == b.weights).all()


def test_quality_of_awkward_rows(spark):
    labels = spark.createDataFrame([(i, i % 2, None) for i in range(30)] + [(3, 0, 0), (None, 1, 1), (4, None, 1)], "doc_id long, quality int, toxic int")
    got = quality_fm.classify_quality(edge_docs(spark), labels).collect()
    assert len(got) == len(edge_rows()) and all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.3) for x in got)
    assert quality_fm.classify_quality(empty_docs(spark), labels).count() == 0
    assert {x.score for x in quality_fm.classify_quality(plain_docs(spark), labels.limit(0)).collect()} == {0.5}


# languages


def brute_path(scores):
    value = lambda p: sum(scores[i, k] for i, k in enumerate(p)) - language_spans.SWITCH * sum(a != b for a, b in zip(p, p[1:]))
    return max(value(p) for p in itertools.product(range(scores.shape[1]), repeat=len(scores))), value


def test_viterbi_like_brute_force():
    rng = np.random.default_rng(3)
    model = language_spans.Model(["a", "b", "c"], np.zeros((1, 3)), {})
    texts = []
    for _ in range(120):
        s = np.maximum(rng.normal(0, 5, (rng.integers(1, 8), 3)), -12)
        texts.append(s - s.max(axis=1, keepdims=True))
    for s, path in zip(texts, model.paths(texts)):
        best, value = brute_path(s)
        assert value(path) == pytest.approx(best)


def test_languages_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = language_spans.identify_languages(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert all(zlib.crc32(str(x.doc_id).encode()) % 3 == 1 for x in rows)
    assert sum(x.lang_pred == x.lang for x in rows) / len(rows) > 0.97


def test_spans_of_a_mixed_text(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = language_spans.fit_languages(docs)
    part = {x.lang: x.text for x in docs.where("n_chars > 900 and lang in ('en', 'de')").orderBy("doc_id").collect()}
    text = part["en"][:500] + " " + part["de"][:500]
    (a, b) = model.spans([text])[0]
    assert (a[2], b[2]) == ("en", "de") and a[0] == 0 and abs(a[1] - 500) < 40 and b[1] > 960


def test_scripts_narrow_the_candidates(spark):
    rows = [(i, "слово дело место", "ru", "s", 1) for i in range(60)] + [(100 + i, "word deed place", "en", "s", 1) for i in range(60)]
    rows += [(300, "место", None, "s", 1), (301, "PLACE", None, "s", 1), (302, "12 !? ١", None, "s", 1), (303, "漢字", None, "s", 1)]
    got = {x.doc_id: x.lang_pred for x in language_spans.identify_languages(plain_docs(spark, rows)).collect()}
    assert (got[300], got[301], got[302]) == ("ru", "en", "und") and got[303] in ("en", "ru")


def test_languages_of_awkward_rows(spark):
    got = language_spans.identify_languages(edge_docs(spark)).collect()
    assert len(got) == len(edge_rows())
    assert {x.lang_pred for x in got if x.doc_id in (100, 101, 102)} == {"und"}
    assert all(0 <= x.score <= 1 for x in got)
    assert language_spans.identify_languages(empty_docs(spark)).count() == 0
    nameless = plain_docs(spark, [(1, "a b", None, "s", 1)])
    assert [x.lang_pred for x in language_spans.identify_languages(nameless).collect()] == ["und"]
    assert language_spans.label_spans(edge_docs(spark)).count() == len(edge_rows())


# pages


@pytest.fixture(scope="module")
def field():
    return html_crf.default_field(300)


def test_decoding_like_brute_force(field):
    rng = np.random.default_rng(2)
    for _ in range(40):
        own = html_crf.Field({f"f{k}": float(rng.normal()) for k in range(6)}, rng.normal(size=(2, 2)))
        features = [[f"f{k}" for k in rng.choice(6, 2)] for _ in range(rng.integers(1, 8))]
        value = lambda p: sum(own.weights[f] for y, fs in zip(p, features) for f in fs if y) + sum(own.steps[a, b] for a, b in zip(p, p[1:]))
        assert value(own.decode(features)) == pytest.approx(max(map(value, itertools.product((0, 1), repeat=len(features)))))


def test_gradient_of_the_likelihood():
    rng = np.random.default_rng(4)
    unary, steps = rng.normal(size=5), rng.normal(size=(2, 2))

    def partition(u, s):
        return np.log(sum(np.exp(sum(u[i] for i, y in enumerate(p) if y) + sum(s[a, b] for a, b in zip(p, p[1:]))) for p in itertools.product((0, 1), repeat=5)))

    share, pairs = html_crf._marginals(unary, steps)
    for k in range(5):
        up = unary.copy()
        up[k] += 1e-5
        assert (partition(up, steps) - partition(unary, steps)) / 1e-5 == pytest.approx(share[k], abs=1e-3)
    for a, b in itertools.product((0, 1), repeat=2):
        up = steps.copy()
        up[a, b] += 1e-5
        assert (partition(unary, up) - partition(unary, steps)) / 1e-5 == pytest.approx(pairs[a, b], abs=1e-3)


def test_blocks_on_unseen_layouts(field):
    right = total = 0
    for seed in range(50_000, 50_150):
        page, main = PageMaker(seed).page()
        blocks = html_blocks.leaf_blocks(page)
        labels = field.decode(html_crf.block_features(blocks))
        right += sum(y == (b.text in main) for b, y in zip(blocks, labels))
        total += len(blocks)
    assert right / total > 0.98


def test_pages_of_the_small_tables(spark, field):
    import html

    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    source = {x.page_id: x.html for x in pages.collect()}
    got = html_crf.extract_pages(pages, field).collect()
    same = 0
    for x in got:
        inner = re.search(r"<article>(.*?)</article>", source[x.page_id], re.DOTALL).group(1)
        plain = html.unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", inner)))
        same += x.text == re.sub(r"\s+", " ", plain).strip()
    assert same / len(got) > 0.98


def test_markup_that_is_cut_short_or_odd():
    texts = lambda page: [b.text for b in html_blocks.leaf_blocks(page)]
    assert texts("<p>a&amp;b<b>c</b>d<br>e<p>f<ul><li>x<li>y</ul>z") == ["a&bcd e", "f", "x", "y", "z"]
    assert texts("<title>t</title><head><style>p{}</style><body>seen<script>if (a<b) '<p>'</script> too<!-- <p>no</p> -->") == ["seen", "too"]
    assert texts("a < b &lt;p&gt; &#8364;&nbsp;\n\t c<p") == ["a < b <p> € c"]
    assert texts(None) == texts("") == texts("<p>") == texts("<!-- open <p>x") == texts("<script>x") == []
    assert html_blocks.leaf_blocks("<td>1<td>2</table>3")[1].path == ["td"]


def test_pages_of_awkward_rows(spark, field):
    rows = [(1, "u", None), (2, None, ""), (None, None, "<article><p>Some text here.</p></article>"), (1, "u", None), (3, "u", "<p>" + "word " * 50_000 + ".</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as text", "2 as n_chars")
    got = sorted(html_crf.extract_pages(df, field).collect(), key=lambda x: str(x.page_id))
    assert [(x.page_id, x.text) for x in got[:3]] == [(1, ""), (1, ""), (2, "")]
    assert all(x.n_chars == len(x.text) for x in got) and len(got) == 5
    assert html_crf.extract_pages(df.limit(0), field).count() == 0


def test_stray_quotes_implied_heads_and_hidden_elements():
    texts = lambda page: [b.text for b in html_blocks.leaf_blocks(page)]
    assert texts("<p><a href=/it's>Hello</a> world</p><p>second</p>") == ["Hello world", "second"]
    assert texts("<p class=a'>One.</p><p>Two.</p>") == ["One.", "Two."]
    assert texts('<p title = "a > b" x=\'c>d\' y="open>One.</p><p>">Two.</p>') == ["Two."]
    assert texts("<html><head><title>T</title><h1>A</h1><p>Body</p>") == ["A", "Body"]
    assert texts("<head><meta x>  <style>p{}</style>\n words <b>and</b> more") == ["words and more"]
    assert texts("<head><noscript><img src=x>no</noscript><script>a</script></head><p>B") == ["B"]
    assert texts("<div hidden>no<p>no</p></div><div class='hidden lg'>a</div><p HIDDEN='until-found'>no</p><p data-hidden>b") == ["a", "b"]
    assert texts("<head><title>T</title></head><head>x") == ["x"]


def test_page_forms_do_not_change_the_text():
    """Pages without the tags that may be left out, with stray quotes, and deep in other elements."""
    field = html_crf.default_field()
    for seed in range(5000, 5040):
        page, _ = PageMaker(seed).page()
        want = html_crf.main_text(page, field)
        bare = re.sub(r"</head>\s*<body[^>]*>|</body>|</html>", "", page)
        quotes = re.sub(r"<p>", "<p data-x=it's>", page)
        assert bare != page and html_crf.main_text(bare, field) == want
        assert html_crf.main_text(quotes, field) == want


def test_deep_pages_stay_small():
    import tracemalloc

    field = html_crf.default_field()
    deep = "<body>" + "".join(f"<div class='a b n{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676 % 26)}'>word" for i in range(40_000))
    tracemalloc.start()
    blocks = html_blocks.leaf_blocks(deep, field.names)
    html_crf.main_text(deep + "</b></i></span></q>" + "</section>" * 40_000, field)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(blocks) == 40_000 and blocks[-1].path.count("div") == 40_000 and peak < 500e6


def test_short_items_are_whole_texts():
    blocks = [decontam.Block.of([(1, "Yes, 42!"), (2, "yes 42"), (3, "!?"), (4, "no")])]
    found = lambda text: decontam.matched_items(text, blocks)
    assert found(" yes (42)") == [1, 2] and found("yes 42 no") == [] and found("No.") == [4] and found("?!") == [] and found(None) == []


def test_short_passages_of_all_places():
    """With a window of 50, any 50 letters of an item with two edits, and no 40."""
    r = random.Random(12)
    item = sentence(r, 300)
    own = decontam.normal(item)
    assert len(own) > decontam.PIECE
    blocks = [decontam.Block.of([(1, sentence(r, 30)), (2, item)], 50)]
    text = lambda codes: "".join(map(chr, codes))
    around = lambda part: sentence(r, 20) + " " + part + " " + sentence(r, 20)
    for a in range(0, len(own) - 50 + 1, 3):
        chars = list(text(own[a : a + 50]))
        for at in r.sample(range(1, 49), decontam.budget(50)):
            chars[at] = "#"
        assert decontam.matched_items(around("".join(chars)), blocks) == [2]
    assert decontam.budget(50) == 2 and decontam.matched_items(around(text(own[100:140])), blocks) == []
    assert decontam.windows(60, 50) == [(s, s + 50) for s in range(11)]


def test_long_items_and_many_shared_places(monkeypatch):
    """Pieces and halves give what one look at everything gives."""
    r = random.Random(13)
    items = [(1, sentence(r, 900)), (2, "ab " * 800), (3, sentence(r, 60)), (4, "0" * 500 + sentence(r, 5) + "1" * 90)]
    texts = [sentence(r, 400) + items[0][1][at : at + 200] + sentence(r, 300) for at in range(0, 4000, 450)]
    texts += ["0" * 4000, "ab " * 900, "0" * 80 + sentence(r, 900) + items[2][1], "x" * 5000, sentence(r, 5) + "1" * 3000]
    blocks = [decontam.Block.of(items)]
    whole = [decontam.matched_items(t, blocks) for t in texts]
    assert whole[:9] == [[1]] * 9 and whole[9:] == [[4], [2], [3], [], []]
    monkeypatch.setattr(decontam, "MOST_PLACES", 3000)
    assert [decontam.matched_items(t, blocks) for t in texts] == whole


def test_equal_characters_stay_small():
    import tracemalloc

    blocks = [decontam.Block.of([(1, "0" * 600), (2, "1" * 100_000), (3, "01" * 300)])]
    tracemalloc.start()
    assert decontam.matched_items("0" * (1 << 20), blocks) == [1]
    assert decontam.matched_items("1" * (1 << 18) + "2" + "10" * (1 << 17), blocks) == [2, 3]
    assert decontam.matched_items(("0" * 30 + "xyz") * 300, blocks) == []
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 500e6
