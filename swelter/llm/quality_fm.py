"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(w0 + sum w_i x_i + 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2]), in
time linear in the number of features of a text. It is fitted on the driver on a bounded
sample of labelled rows and scores every whole text inside the tasks.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swelter.llm.common import flat, map_text, pick

#: Most labelled rows that the fit looks at, taken in order of a hash of their id.
SAMPLE_ROWS = 6000
#: Documents whose crc32(doc_id as text) leaves this remainder are never learned from.
FOLDS, HELD_OUT = 5, 0
THRESHOLD = 0.3

WORD_BITS = 15
BINS = 12
FACTORS = 4
EPOCHS = 6
RATE = 0.08
DECAY = 1e-5
SEED = 7

_SYMBOLS = b"#*$%&|<>@^~_=+/\\{}[]"
_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_DIGITS = b"0123456789"
_STOPS = b".,;:!?"
#: Upper ends of the bins of a share.
_SHARES = np.array([0.0, 0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.7, 0.9])


def _share(n: float, of: float) -> int:
    return int(np.searchsorted(_SHARES, n / of if of else 0.0))


def _log(n: float) -> int:
    return min(BINS - 1, int(np.log2(n + 1)))


def _without(data: bytes, drop: bytes) -> int:
    return len(data) - len(data.translate(None, drop))


def structure(data: bytes, words: list[bytes], counts: Counter) -> list[int]:
    """A bin for every statistic of a whole text."""
    n, size = len(words), len(data)
    lines = [x for x in data.split(b"\n") if x.strip()]
    upper, lower = _without(data, _UPPER), _without(data, _LOWER)
    repeats = sum(a == b for a, b in zip(words, words[1:]))
    worst = max((_without(x, _SYMBOLS) / len(x) for x in lines), default=0.0)
    loud = max((_without(x, _UPPER) / len(x) for x in lines), default=0.0)
    return [
        _share(_without(data, _SYMBOLS), size),
        _share(upper, upper + lower),
        _share(_without(data, _DIGITS), size),
        _share(_without(data, _STOPS), n),
        _share(data.count(b"!"), n),
        _share(data.count(b"|"), n),
        _share(len(counts), n),
        _share(max(counts.values(), default=0), n),
        _share(repeats, n),
        _share(len(lines) - len(set(lines)), len(lines)),
        _share(worst, 1),
        _share(loud, 1),
        min(BINS - 1, int(sum(map(len, words)) / n)) if n else 0,
        _log(n),
        _log(len(lines)),
        _log(n / len(lines)) if lines else 0,
    ]


STATISTICS = 16
SIZE = (1 << WORD_BITS) + (STATISTICS + 1) * (BINS + 1)


def features(text: str | None, n_chars: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and values of the features of a text; a NULL text counts as an empty one."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    counts = Counter(words)
    hashed = np.unique(np.fromiter((zlib.crc32(w.lower()) & ((1 << WORD_BITS) - 1) for w in counts), np.int64, len(counts)))
    base = 1 << WORD_BITS
    bins = [*structure(data, words, counts), BINS if n_chars is None else _log(max(0, n_chars) / 16)]
    marks = np.array([base + k * (BINS + 1) + b for k, b in enumerate(bins)], np.int64)
    values = np.concatenate([np.full(len(hashed), 1 / np.sqrt(max(1, len(hashed)))), np.full(len(marks), 0.5)])
    return np.concatenate([hashed, marks]), values


@dataclass
class Machine:
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    @classmethod
    def fit(cls, rows: list[tuple[np.ndarray, np.ndarray, int]]) -> Machine:
        """Stochastic gradient steps with AdaGrad on the log loss, in a seeded order.

        Without any labelled row the machine gives 0.5 to every text.
        """
        rng = np.random.default_rng(SEED)
        own = cls(0.0, np.zeros(SIZE), rng.normal(0, 0.02, (SIZE, FACTORS)) if rows else np.zeros((SIZE, FACTORS)))
        past_w, past_v, past_b = np.full(SIZE, 1e-6), np.full((SIZE, FACTORS), 1e-6), 1e-6
        for _ in range(EPOCHS):
            for i in rng.permutation(len(rows)):
                at, x, label = rows[i]
                v = own.factors[at]
                total = x @ v
                error = _sigmoid(own._raw(at, x, v, total)) - label
                gw = error * x + DECAY * own.weights[at]
                gv = error * x[:, None] * (total - x[:, None] * v) + DECAY * v
                past_w[at] += gw * gw
                past_v[at] += gv * gv
                past_b += error * error
                own.weights[at] -= RATE * gw / np.sqrt(past_w[at])
                own.factors[at] -= RATE * 0.3 * gv / np.sqrt(past_v[at])
                own.bias -= RATE * error / np.sqrt(past_b)
        return own

    def _raw(self, at: np.ndarray, x: np.ndarray, v: np.ndarray, total: np.ndarray) -> float:
        return self.bias + self.weights[at] @ x + 0.5 * (total @ total - (x * x) @ (v * v).sum(axis=1))

    def score(self, text: str | None, n_chars: int | None) -> float:
        at, x = features(text, n_chars)
        v = self.factors[at]
        return float(_sigmoid(self._raw(at, x, v, x @ v)))


def _sigmoid(z: float) -> float:
    return 1 / (1 + np.exp(-min(30.0, max(-30.0, z))))


def held_out() -> Column:
    """True for the fold that is never learned from; rows without id belong to it."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(True))


def _own_features(texts: list, sizes: list) -> tuple[list, list]:
    made = [features(t, n) for t, n in zip(texts, sizes)]
    return [m[0] for m in made], [m[1] for m in made]


def fit_quality(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Machine:
    """Fit on up to ``sample_rows`` labelled ids outside the held-out fold.

    Rows without label are skipped; of several labels or texts of an id the smallest counts.
    """
    known = pick(labels, "doc_id", "quality").where(~held_out() & F.col("quality").isNotNull())
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    # the sample is at most sample_rows ids and labels, so it can be copied to the tasks
    rows = pick(docs, "doc_id", "text", "n_chars").withColumn("n_chars", F.col("n_chars").cast("long"))
    rows = rows.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "quality").agg(F.min(F.struct("text", "n_chars")).alias("row"))
    rows = rows.select("doc_id", "quality", "row.text", "row.n_chars")
    found = map_text(rows, _own_features, "at array<bigint>, x array<double>", ("text", "n_chars"))
    # an id is one row here; its features stay in the arrays they came in
    found = found.toArrow().combine_chunks().sort_by("doc_id")
    (at, sizes), (x, _) = (flat(found.column(c).combine_chunks()) for c in ("at", "x"))
    ends = np.cumsum(sizes)
    good = (found.column("quality").to_numpy() > 0).astype(int).tolist()
    return Machine.fit([(at[e - n : e], x[e - n : e], label) for e, n, label in zip(ends.tolist(), sizes.tolist(), good)])


def score_quality(docs: DataFrame, machine: Machine, *keep: str) -> DataFrame:
    """``keep`` columns and ``_score`` of every document, with text or not; repeated rows are scored each."""
    sent = docs.sparkSession.sparkContext.broadcast(machine)

    def scores(texts: list, sizes: list) -> list:
        return [[sent.value.score(t, n) for t, n in zip(texts, sizes)]]

    own = pick(docs, *keep, *(c for c in ("text", "n_chars") if c not in keep)).withColumn("n_chars", F.col("n_chars").cast("long"))
    return map_text(own, scores, "_score double", ("text", "n_chars"), keep_inputs=True).select(*keep, "_score")


def classify_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted (1 from ``THRESHOLD`` on) of every document.

    NULL and empty texts are scored by their (empty) statistics; NULL ids are held out. An
    empty table gives an empty result, no labels a score of 0.5 for all. Other columns are
    ignored.
    """
    scored = score_quality(docs, fit_quality(docs, labels), "doc_id")
    predicted = (F.col("_score") >= THRESHOLD).cast("int")
    return scored.select("doc_id", held_out().alias("held_out"), F.col("_score").alias("score"), predicted.alias("predicted"))


def good_documents(docs: DataFrame, labels: DataFrame, columns: list[str]) -> DataFrame:
    """The documents that the classifier does not reject."""
    return score_quality(docs, fit_quality(docs, labels), *columns).where(F.col("_score") >= THRESHOLD).select(*columns)
