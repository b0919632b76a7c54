"""Main text of HTML pages by a linear-chain conditional random field over DOM leaf blocks.

Each block is main text or not. Its features are the tags and names of its ancestors and the
looks of its text; a second set of weights ties neighbours together. The field is trained on
labelled pages by gradient steps on the exact likelihood (forward-backward) and decoded by
Viterbi, page by page inside the tasks.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swelter.llm.common import map_text, pick
from swelter.llm.html_blocks import Block, leaf_blocks
from swelter.llm.html_samples import PageMaker

#: Labelled pages that the field is trained on.
TRAINING_PAGES = 800
EPOCHS = 5
RATE = 0.3
DECAY = 1e-4
_WHOLE = (None, "html", "body")
_HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")


def block_features(blocks: list[Block]) -> list[list[str]]:
    """Names of the features that hold for every block of a page; the same whether or not a page
    writes the tags of html and body, which may be left out."""
    holders = [t for t in ("article", "main") if any(t in b.tags for b in blocks)]
    out = []
    for k, b in enumerate(blocks):
        words = b.text.count(" ") + 1
        own = ["bias", f"words {min(7, words.bit_length())}", f"tag {b.tag if b.tag not in _WHOLE else 'body'}"]
        own += [f"in {t}" for t in b.tags if t not in _WHOLE] + [f"named {n}" for n in b.names] + [f"near {n}" for n in set(b.near)]
        own += [f"inner {b.holder or 'body'}"] + [f"outside {t}" for t in holders if t not in b.tags]
        own.append(f"linked {4 * b.linked // max(1, len(b.text))}")
        own.append(f"ends {b.text[-1] if b.text[-1] in '.!?:' else 'open'}")
        if b.fields:
            own.append("fields")
        if b.links > 1:
            own.append("links")
        if b.text[0] in "©|»" or "©" in b.text:
            own.append("sign")
        if b.tag in _HEADINGS and k + 1 < len(blocks) and blocks[k + 1].text[:40] == b.text[:40]:
            own.append("leads")
        own.append("first" if k == 0 else "last" if k == len(blocks) - 1 else "mid")
        out.append(own)
    return out


@dataclass
class Field:
    """Weight of every feature for 'main text', and of every step from label to label."""

    weights: dict[str, float]
    steps: np.ndarray

    @cached_property
    def names(self) -> frozenset[str]:
        """Element names that have a weight."""
        return frozenset(f.split(" ", 1)[1] for f in self.weights if f.startswith(("named ", "near ")))

    def decode(self, features: list[list[str]]) -> list[int]:
        """The likeliest labels of a page."""
        get = self.weights.get
        (a, b), (c, d) = self.steps.tolist()
        back: list[tuple[int, int]] = []
        no, yes = 0.0, sum(get(f, 0.0) for f in features[0]) if features else 0.0
        for own in features[1:]:
            score = sum(get(f, 0.0) for f in own)
            back.append((int(yes + c > no + a), int(yes + d > no + b)))
            no, yes = max(no + a, yes + c), max(no + b, yes + d) + score
        path = [int(yes > no)] if features else []
        for from_no, from_yes in reversed(back):
            path.append(from_yes if path[-1] else from_no)
        return path[::-1]


def train(pages: list[tuple[list[list[str]], list[int]]]) -> Field:
    """Fit to labelled pages, in order, with AdaGrad."""
    index: dict[str, int] = {}
    coded = [([np.array([index.setdefault(f, len(index)) for f in own]) for own in features], np.array(labels)) for features, labels in pages if features]
    w, past_w = np.zeros(len(index)), np.full(len(index), 1e-6)
    steps, past_s = np.zeros((2, 2)), np.full((2, 2), 1e-6)
    for _ in range(EPOCHS):
        for features, labels in coded:
            unary = np.array([w[at].sum() for at in features])
            share, pairs = _marginals(unary, steps)
            gap = share - labels
            size = np.array([len(at) for at in features])
            flat = np.concatenate(features)
            used, place = np.unique(flat, return_inverse=True)
            grad = np.bincount(place, np.repeat(gap, size)) + DECAY * w[used]
            past_w[used] += grad * grad
            w[used] -= RATE * grad / np.sqrt(past_w[used])
            seen = np.zeros((2, 2))
            np.add.at(seen, (labels[:-1], labels[1:]), 1)
            grad_s = pairs - seen + DECAY * steps
            past_s += grad_s * grad_s
            steps -= RATE * grad_s / np.sqrt(past_s)
    return Field({f: float(w[k]) for f, k in index.items()}, steps)


def _marginals(unary: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chance of label 1 for every block, and expected number of steps of each kind."""
    n, move = len(unary), np.exp(steps)
    emit = np.ones((n, 2))
    emit[:, 1] = np.exp(np.clip(unary, -30, 30))
    ahead, back = np.empty((n, 2)), np.ones((n, 2))
    ahead[0] = emit[0] / emit[0].sum()
    for k in range(1, n):
        ahead[k] = (ahead[k - 1] @ move) * emit[k]
        ahead[k] /= ahead[k].sum()
    for k in range(n - 2, -1, -1):
        back[k] = move @ (emit[k + 1] * back[k + 1])
        back[k] /= back[k].sum()
    share = ahead * back
    pairs = np.zeros((2, 2))
    for k in range(n - 1):
        own = ahead[k][:, None] * move * (emit[k + 1] * back[k + 1])
        pairs += own / own.sum()
    return share[:, 1] / share.sum(axis=1), pairs


@lru_cache(maxsize=2)
def default_field(pages: int = TRAINING_PAGES) -> Field:
    """The field trained on ``pages`` labelled pages."""
    made = []
    for seed in range(pages):
        page, main = PageMaker(seed).page()
        blocks = leaf_blocks(page)
        known = set(main)
        made.append((block_features(blocks), [int(b.text in known) for b in blocks]))
    return train(made)


def main_text(page: str | None, field: Field) -> str:
    """Blocks of the main text, joined by one space; empty if there is none."""
    blocks = leaf_blocks(page, field.names)
    return " ".join(b.text for b, label in zip(blocks, field.decode(block_features(blocks))) if label)


def extract_pages(pages: DataFrame, field: Field | None = None) -> DataFrame:
    """page_id, url, text (the main text) and n_chars of every page, from its whole html.

    NULL and empty html give an empty text. Repeated rows are read each; other columns are
    ignored; an empty table gives an empty result.
    """
    sent = pages.sparkSession.sparkContext.broadcast(field or default_field())
    found = map_text(pick(pages, "page_id", "url", "html"), lambda rows: [[main_text(h, sent.value) for h in rows]], "text string", ("html",))
    return found.withColumn("n_chars", F.length("text").cast("long"))
