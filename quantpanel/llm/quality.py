"""Quality classifier (6): generalised additive model with pairwise interactions.

Shallow trees are boosted in turn over the features (and then over the chosen pairs of features), each a small step, and
added into a lookup table for the feature or pair. A score is the sum of table entries at a document's bins, so scoring
is a bin search and an addition for each table, over whole batches. The fit is on a bounded sample of labelled rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .common import map_rows, small_batches
from .toxicity import LEARNABLE, training_rows

BINS, PAIR_BINS, PAIRS, ROUNDS, RATE = 64, 12, 10, 300, 0.1
FEATURES = (
    "words", "chars_per_word", "distinct_share", "top_word_share", "repeat_share", "upper_share", "digit_share", "space_share", "ascii_punct_share", "bar_share",
    "bang_share", "stop_share", "symbol_share", "line_count", "words_per_line", "repeated_line_share", "alpha_word_share", "long_word_share", "short_word_share", "bigram_repeat_share",
)
_CLASS = {name: np.array([bool(re.match(p, chr(b))) for b in range(128)] + [False] * 128) for name, p in {"upper": "[A-Z]", "digit": "[0-9]", "space": r"\s", "punct": r"[!-/:-@\[-`{-~]", "bar": r"[|]", "bang": "[!?]", "stop": "[.]", "symbol": r"[#$%&*+<=>@^_~\\]"}.items()}


def features(text: str | None) -> list[float]:
    """Numbers of a whole text; all 0 without words."""
    words = text.split() if text else []
    if not words:
        return [0.0] * len(FEATURES)
    raw = np.bincount(np.frombuffer(text.encode(), dtype=np.uint8), minlength=256)
    size, n = raw.sum(), len(words)
    share = {k: float(raw[m].sum() / size) for k, m in _CLASS.items()}
    counts = Counter(words)
    same = sum(a == b for a, b in zip(words, words[1:], strict=False))
    lines = [x for x in text.split("\n") if x.strip()]
    lengths = [len(w) for w in words]
    return [
        float(np.log1p(n)), sum(lengths) / n, len(counts) / n**0.8, max(counts.values()) / n, same / n, share["upper"], share["digit"], share["space"], share["punct"], share["bar"],
        share["bang"], share["stop"], share["symbol"], float(np.log1p(len(lines))), float(np.log1p(n / len(lines))), 1 - len(set(lines)) / len(lines), sum(map(str.isalpha, words)) / n,
        sum(x > 12 for x in lengths) / n, sum(x < 3 for x in lengths) / n, 1 - len(set(zip(words, words[1:], strict=False))) / max(1, n - 1),
    ]


class AdditiveModel:
    """score(x) in 0..1; fitted by cyclic boosting of trees with up to three leaves a feature, four a pair."""

    def fit(self, x: np.ndarray, y: np.ndarray) -> AdditiveModel:
        n, d = x.shape
        self.cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(d)]
        self.pair_cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, PAIR_BINS + 1)[1:-1])) for j in range(d)]
        rate = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
        self.bias = float(np.log(rate / (1 - rate)))
        self.tables = [np.zeros(len(c) + 1) for c in self.cuts]
        bins = [np.searchsorted(c, x[:, j], "right") for j, c in enumerate(self.cuts)]
        f = np.full(n, self.bias)
        for _ in range(ROUNDS):
            for j in range(d):
                g, h = self._slopes(f, y)
                step = self._tree(np.bincount(bins[j], g, len(self.tables[j])), np.bincount(bins[j], h, len(self.tables[j])))
                self.tables[j] += step
                f += step[bins[j]]
        coarse = [np.searchsorted(c, x[:, j], "right") for j, c in enumerate(self.pair_cuts)]
        g, h = self._slopes(f, y)
        gains = sorted(((self._gain(coarse[a], coarse[b], g, h), a, b) for a, b in combinations(range(d), 2)), reverse=True)
        self.pairs = {(a, b): np.zeros((PAIR_BINS, PAIR_BINS)) for _, a, b in gains[:PAIRS]}
        for _ in range(ROUNDS // 4):
            for (a, b), table in self.pairs.items():
                g, h = self._slopes(f, y)
                cell = coarse[a] * PAIR_BINS + coarse[b]
                step = self._pair_tree(np.bincount(cell, g, PAIR_BINS**2).reshape(PAIR_BINS, PAIR_BINS), np.bincount(cell, h, PAIR_BINS**2).reshape(PAIR_BINS, PAIR_BINS))
                table += step
                f += step.ravel()[cell]
        return self

    @staticmethod
    def _slopes(f, y):
        p = 1 / (1 + np.exp(-f))
        return y - p, np.maximum(p * (1 - p), 1e-4)

    @staticmethod
    def _split(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
        """(gain, first bin of the right part) of the best cut of a histogram."""
        gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
        if not len(gl):
            return 0.0, 0
        gain = gl**2 / (hl + 1) + (g.sum() - gl) ** 2 / (h.sum() - hl + 1) - g.sum() ** 2 / (h.sum() + 1)
        k = int(gain.argmax())
        return float(gain[k]), k + 1

    @classmethod
    def _tree(cls, g: np.ndarray, h: np.ndarray) -> np.ndarray:
        _, k = cls._split(g, h)
        edges = [0, k, len(g)]
        inner = [(cls._split(g[a:b], h[a:b]), a) for a, b in zip(edges, edges[1:], strict=False) if b - a > 1]
        if inner:
            (_, cut), a = max(inner)
            edges = sorted({*edges, a + cut})
        out = np.zeros(len(g))
        for a, b in zip(edges, edges[1:], strict=False):
            if b > a:
                out[a:b] = RATE * g[a:b].sum() / (h[a:b].sum() + 1)
        return out

    @classmethod
    def _pair_tree(cls, g: np.ndarray, h: np.ndarray) -> np.ndarray:
        _, i = cls._split(g.sum(axis=1), h.sum(axis=1))
        out = np.zeros_like(g)
        for rows in (slice(0, i), slice(i, None)):
            gr, hr = g[rows].sum(axis=0), h[rows].sum(axis=0)
            _, j = cls._split(gr, hr)
            for cols in (slice(0, j), slice(j, None)):
                out[rows, cols] = RATE * gr[cols].sum() / (hr[cols].sum() + 1)
        return out

    @staticmethod
    def _gain(a, b, g, h) -> float:
        cell = a * PAIR_BINS + b
        gs, hs = np.bincount(cell, g, PAIR_BINS**2), np.bincount(cell, h, PAIR_BINS**2)
        return float((gs**2 / (hs + 1)).sum())

    def score(self, x: np.ndarray) -> np.ndarray:
        f = np.full(len(x), self.bias)
        for j, (cuts, table) in enumerate(zip(self.cuts, self.tables, strict=True)):
            f += table[np.searchsorted(cuts, x[:, j], "right")]
        if self.pairs:
            coarse = [np.searchsorted(c, x[:, j], "right") for j, c in enumerate(self.pair_cuts)]
            for (a, b), table in self.pairs.items():
                f += table[coarse[a], coarse[b]]
        return 1 / (1 + np.exp(-np.clip(f, -30, 30)))


def _featured(batches: Iterator[pd.DataFrame], label: str) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pd.DataFrame({"x": [features(t) for t in pdf["text"]], "y": pdf[label].astype(float)})


def _scored(batches: Iterator[pd.DataFrame], model: AdditiveModel | float) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        x = np.array([features(t) for t in pdf["text"]]).reshape(-1, len(FEATURES))
        yield pdf[["doc_id"]].assign(score=model.score(x) if isinstance(model, AdditiveModel) else float(model))


def score_quality(docs: DataFrame, labels: DataFrame, train_docs: DataFrame | None = None, where: str = LEARNABLE) -> DataFrame:
    """(doc_id, score) for each row of docs (doc_id, text), score from 0 to 1.

    The model is fitted on the labelled rows of train_docs (docs if None) that `where` allows, FIT_ROWS of the toxicity
    module at most. Null, empty and wordless texts have all features 0 and get the score of such a text. Labels that are
    null or neither 0 nor 1 are ignored; without labels of both kinds the score is the share of label 1 (0 without any).
    A repeated doc_id is scored row by row. Other columns are ignored; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    train = training_rows(docs if train_docs is None else train_docs, labels, "quality", where)
    rows = map_rows(train, partial(_featured, label="quality"), "x array<double>, y double").toPandas()  # the bounded sample
    y = rows["y"].to_numpy() if len(rows) else np.zeros(0)
    model: AdditiveModel | float = float(y.mean()) if len(y) else 0.0
    if 0 < model < 1:
        model = AdditiveModel().fit(np.array(rows["x"].tolist()), y)
    return map_rows(docs.select("doc_id", "text"), partial(_scored, model=model), "doc_id long, score double")
