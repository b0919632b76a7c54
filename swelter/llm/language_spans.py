"""Language identification of mixed texts: scripts narrow the candidates, Viterbi labels spans.

Every word gets a score per candidate language from character n-grams; a path through the
words pays a penalty whenever it changes the language. The best path gives the spans, and
the language of most letters is that of the document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swelter.llm.common import map_text, pick

#: Most documents per language the fit looks at, in order of a hash of their id.
SAMPLE_ROWS = 1000
#: Documents whose crc32(doc_id as text) leaves this remainder are never learned from.
FOLDS, HELD_OUT = 3, 1
SWITCH = 8.0
#: No word counts for more than this between two languages, so one odd word makes no span.
MOST_PER_WORD = 4.0
_BUCKETS = 1 << 16
_CHUNK = 1 << 18
_GROUP = 1 << 22
UNKNOWN = "und"

#: Ranges of letters by script; fixed values of the Unicode blocks.
SCRIPTS = (
    ("latin", 0x0041, 0x024F), ("latin", 0x1E00, 0x1EFF), ("greek", 0x0370, 0x03FF), ("cyrillic", 0x0400, 0x052F),
    ("armenian", 0x0530, 0x058F), ("hebrew", 0x0590, 0x05FF), ("arabic", 0x0600, 0x06FF), ("arabic", 0x0750, 0x077F),
    ("devanagari", 0x0900, 0x097F), ("bengali", 0x0980, 0x09FF), ("tamil", 0x0B80, 0x0BFF), ("thai", 0x0E00, 0x0E7F),
    ("georgian", 0x10A0, 0x10FF), ("hangul", 0x1100, 0x11FF), ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x4DBF),
    ("han", 0x4E00, 0x9FFF), ("hangul", 0xAC00, 0xD7AF),
)
SCRIPT_NAMES = sorted({name for name, _, _ in SCRIPTS} | {"other"})
_BMP = 1 << 16


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Lower-case letter (a space for all else) and script number of every character below 65536."""
    letters, scripts = np.full(_BMP, 32, np.uint32), np.full(_BMP, SCRIPT_NAMES.index("other"), np.uint8)
    for name, low, high in SCRIPTS:
        scripts[low : high + 1] = SCRIPT_NAMES.index(name)
    for c in range(_BMP):
        if chr(c).isalpha():
            low = chr(c).lower()
            letters[c] = ord(low) if len(low) == 1 else c
    return letters, scripts


_LETTER, _SCRIPT = _tables()


@dataclass
class Words:
    """The words (runs of letters) of a text: lower-case codes with a space on both sides, and where each begins."""

    codes: np.ndarray
    first: np.ndarray
    length: np.ndarray

    @classmethod
    def of(cls, text: str | None) -> Words:
        codes = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)
        low = _LETTER[np.minimum(codes, _BMP - 1)]
        for i in np.flatnonzero(codes >= _BMP):
            low[i] = codes[i] if chr(codes[i]).isalpha() else 32
        low = np.concatenate([[32], low, [32]]).astype(np.uint32)
        edge = np.diff((low != 32).astype(np.int8))
        first = np.flatnonzero(edge == 1) + 1
        return cls(low, first, np.flatnonzero(edge == -1) + 1 - first)

    def chunks(self) -> list[tuple[int, int]]:
        """Ranges of words of about ``_CHUNK`` characters."""
        cuts = np.unique(self.first // _CHUNK, return_index=True)[1].tolist()
        return list(zip(cuts, [*cuts[1:], len(self.first)]))

    def grams(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """For words a to b: buckets of the one, two and three letters around each letter, and where words begin."""
        size = self.length[a:b]
        begin = np.cumsum(size) - size
        at = np.repeat(self.first[a:b] - begin, size) + np.arange(size.sum())
        left, mid, right = (self.codes[at + k] for k in (-1, 0, 1))
        two = mid * np.uint32(0x9E3779B1) + left * np.uint32(0x85EBCA77)
        three = two + right * np.uint32(0xC2B2AE3D) + np.uint32(0x27D4EB2F)
        mixed = [mid * np.uint32(0x9E3779B1) + np.uint32(0x165667B1), two, three]
        return np.stack([((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(16) for h in mixed]), begin

    def scripts(self, a: int, b: int) -> np.ndarray:
        """Script number of the first letter of words a to b."""
        return _SCRIPT[np.minimum(self.codes[self.first[a:b]], _BMP - 1)]


@dataclass
class Model:
    """Log shares of n-gram buckets by language, and the languages that use each script."""

    languages: list[str]
    table: np.ndarray
    scripts: dict[str, list[int]]

    @classmethod
    def of(cls, languages: list[str], counts: np.ndarray, scripts: np.ndarray) -> Model:
        """From counts per n-gram bucket and language, and word counts per script and language."""
        shares = (counts + 0.5) / (counts.sum(axis=0) + 0.5 * _BUCKETS)
        # a script belongs to the languages that write at least a hundredth of their words in it
        own = (scripts > 0) & (scripts * 100 >= scripts.sum(axis=0))
        return cls(languages, np.log(shares).astype(np.float32), {s: np.flatnonzero(own[k]).tolist() for k, s in enumerate(SCRIPT_NAMES) if own[k].any()})

    def scores(self, words: Words) -> np.ndarray:
        """A row per word: 0 for the best language, at least -MOST_PER_WORD for the others.

        Languages that do not use the script of a word lie furthest off; a script that no
        language uses says nothing.
        """
        barred = np.full((len(SCRIPT_NAMES), len(self.languages)), -np.inf)
        for k, name in enumerate(SCRIPT_NAMES):
            barred[k, self.scripts.get(name, [])] = 0
        silent = np.isinf(barred).all(axis=1)
        barred[silent] = 0
        out = []
        for a, b in words.chunks():
            buckets, begin = words.grams(a, b)
            letters = self.table[buckets[0]] + self.table[buckets[1]] + self.table[buckets[2]]
            kinds = words.scripts(a, b)
            rows = np.add.reduceat(letters, begin, axis=0) + barred[kinds]
            rows = np.maximum(rows - rows.max(axis=1, keepdims=True), -MOST_PER_WORD)
            rows[silent[kinds]] = 0
            out.append(rows)
        return np.concatenate(out)

    def paths(self, scores: list[np.ndarray]) -> list[np.ndarray]:
        """Best language of every word of several texts, changes being charged with ``SWITCH``.

        Texts in which staying pays are settled at once; the others go through Viterbi side
        by side, one word of each at a time.
        """
        best = [int(s.sum(axis=0).argmax()) for s in scores]
        out = [np.full(len(s), b) for s, b in zip(scores, best)]
        open_texts = sorted((i for i, s in enumerate(scores) if not self._constant(s, best[i])), key=lambda i: -len(scores[i]))
        if not open_texts:
            return out
        size = np.array([len(scores[i]) for i in open_texts])
        start, flat = np.cumsum(size) - size, np.concatenate([scores[i] for i in open_texts])
        active = len(size) - np.searchsorted(size[::-1], np.arange(size[0]), side="right")
        value, back = flat[start], np.empty(flat.shape, np.int16)
        stay = np.arange(flat.shape[1])
        for t in range(1, size[0]):
            now = value[: active[t]]
            top = now.argmax(axis=1)
            jump = now[np.arange(len(now)), top, None] - SWITCH
            at = start[: active[t]] + t
            back[at] = np.where(now >= jump, stay, top[:, None])
            value[: active[t]] = np.maximum(now, jump) + flat[at]
        path, label = np.empty(len(flat), np.int64), value.argmax(axis=1)
        for t in range(size[0] - 1, -1, -1):
            at = start[: active[t]] + t
            path[at] = label[: active[t]]
            if t:
                label[: active[t]] = back[at, label[: active[t]]]
        for i, a, n in zip(open_texts, start, size):
            out[i] = path[a : a + n]
        return out

    @staticmethod
    def _constant(scores: np.ndarray, best: int) -> bool:
        """True if no run of words gains half a penalty elsewhere; then no path beats staying.

        A path with s foreign segments changes at least s times, or s - 1 times if it never
        uses ``best``; its gain is below s * SWITCH / 2, which no s makes up for.
        """
        gain = np.cumsum(scores - scores[:, [best]], axis=0)
        low = np.minimum.accumulate(np.vstack([np.zeros((1, scores.shape[1])), gain[:-1]]), axis=0)
        return bool(((gain - low) <= SWITCH / 2).all())

    def label(self, texts: list[str | None]) -> Iterator[tuple[Words, np.ndarray]]:
        """The words of every text and their languages; texts are taken together up to ``_GROUP`` characters."""
        held: list[Words] = []
        size = 0
        for n, text in enumerate(texts, 1):
            held.append(Words.of(text))
            size += len(held[-1].codes)
            if n == len(texts) or size >= _GROUP:
                told = [w for w in held if len(w.first) and self.languages]
                found = iter(self.paths([self.scores(w) for w in told]))
                yield from ((w, next(found) if len(w.first) and self.languages else np.empty(0, int)) for w in held)
                held, size = [], 0

    def spans(self, texts: list[str | None]) -> list[list[tuple[int, int, str]]]:
        """Start, end (in characters) and language of the spans of every text, in order; none without letters."""
        out = []
        for words, path in self.label(texts):
            cuts = [0, *(np.flatnonzero(np.diff(path)) + 1).tolist(), len(path)] if len(path) else []
            ends = words.first + words.length - 1
            out.append([(int(words.first[a]) - 1, int(ends[b - 1]), self.languages[path[a]]) for a, b in zip(cuts, cuts[1:])])
        return out

    def documents(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Language of most letters and its share of them; 'und' and 0 without letters (or languages)."""
        out = []
        for words, path in self.label(texts):
            if not len(path):
                out.append((UNKNOWN, 0.0))
                continue
            letters = np.bincount(path, words.length, len(self.languages))
            top = int(letters.argmax())
            out.append((self.languages[top], float(letters[top] / letters.sum())))
        return out


def held_out() -> Column:
    """True for the fold that is never learned from; rows without id belong to it."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(True))


def _bucket_counts(texts: list) -> list:
    """N-gram buckets of every text with their counts; words per script follow behind the last bucket."""
    out = [[], []]
    for text in texts:
        words = Words.of(text)
        counts = np.zeros(_BUCKETS + len(SCRIPT_NAMES), np.int64)
        for a, b in words.chunks():
            counts[:_BUCKETS] += np.bincount(words.grams(a, b)[0].ravel(), minlength=_BUCKETS)
            counts[_BUCKETS:] += np.bincount(words.scripts(a, b), minlength=len(SCRIPT_NAMES))
        at = np.flatnonzero(counts)
        out[0].append(at)
        out[1].append(counts[at])
    return out


def fit_languages(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on about ``sample_rows`` texts per language, outside the held-out fold.

    A text is taken when a hash of its id is below the share that its language needs, so the
    sample is the same in every run; of several texts with one id the smallest counts. Only
    the sums per language and bucket (``_BUCKETS`` at most) come to the driver.
    """
    own = pick(docs, "doc_id", "text", "lang").where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    # one row per language
    rows = F.broadcast(own.groupBy("lang").agg(F.count(F.lit(1)).alias("rows")))
    share = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) * F.col("rows") < F.lit(sample_rows * (1 << 30))
    own = own.join(rows, "lang").where(share).groupBy("lang", "doc_id").agg(F.min("text").alias("text"))
    found = map_text(own.select("lang", "text"), _bucket_counts, "at array<int>, n array<bigint>")
    pairs = found.select("lang", F.explode(F.arrays_zip("at", "n")).alias("p"))
    sums = pairs.groupBy("lang", "p.at").agg(F.sum("p.n").alias("n")).toArrow()
    languages = sorted(set(sums.column("lang").to_pylist()))
    counts = np.zeros((_BUCKETS + len(SCRIPT_NAMES), len(languages)))
    place = {lang: k for k, lang in enumerate(languages)}
    counts[sums.column("at").to_numpy(), [place[x] for x in sums.column("lang").to_pylist()]] = sums.column("n").to_numpy()
    return Model.of(languages, counts[:_BUCKETS], counts[_BUCKETS:])


def identify_languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document, from its whole text.

    A text that is NULL or has no letter is 'und' with score 0, and so is every text when no
    language could be learned. Of languages with equally many letters the first by name
    wins. Repeated rows are judged each; other columns are ignored.
    """
    model = fit_languages(docs)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def judge(texts: list) -> list:
        return list(zip(*sent.value.documents(texts))) or [[], []]

    return map_text(pick(docs, "doc_id", "text"), judge, "lang_pred string, score double").select(
        "doc_id", held_out().alias("held_out"), "lang_pred", "score"
    )


def label_spans(docs: DataFrame) -> DataFrame:
    """doc_id and the spans (start, stop, lang) of every whole text, in order of their start."""
    sent = docs.sparkSession.sparkContext.broadcast(fit_languages(docs))

    def spans(texts: list) -> list:
        return [[[{"start": a, "stop": b, "lang": c} for a, b, c in found] for found in sent.value.spans(texts)]]

    return map_text(pick(docs, "doc_id", "text"), spans, "spans array<struct<start:int,stop:int,lang:string>>")
