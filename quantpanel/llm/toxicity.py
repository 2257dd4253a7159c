"""Toxicity (4): Levenshtein automata of the terms that a trie of their pieces finds, and context windows around matches.

The lexicon is learned from a bounded sample of labelled rows: words, and stems that several words share, that stand in
toxic documents more often than chance over all words allows, whatever the size of the sample. A term within k edits
keeps one of its k + 1 pieces near its place, where the swap of two neighbours is one edit and pieces leave a letter
between them, so that no edit breaks two. A word runs the automaton (bits of one row of distances) of just the terms
whose pieces it holds. Each match looks at the window of text around it: quotation marks on both sides make it quoted,
otherwise it is abuse. A logistic model on the counts and weights of both kinds gives the score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import partial

import ahocorasick
import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Remembered, held, join_ids, map_rows, mix, small_batches, store

#: Labelled rows that the models are fitted on at most (in expectation; chosen by a hash of their ids).
FIT_ROWS = 30_000
STEM = (4, 5, 6)
#: Log of how unlikely a term's share of toxic documents is by chance, at least: one in a million terms.
EVIDENCE = 14
#: Log-odds of a term at least.
ODDS = 2.0
#: Min-hashes that tell near copies of a text.
SKETCHES = 4
WINDOW = 60
_TOKEN = re.compile(r"[^\W_](?:[\w*@$'’-]*[^\W_])?")
_OPEN, _CLOSE = re.compile(r"[\"“„«‚‘]|(?<!\w)'"), re.compile(r"[\"”“»‘’]|'(?!\w)")
FEATURES = ("bias", "exact", "stem", "fuzzy", "quoted", "weight", "most", "density")


def allowed(n: int) -> int:
    """Edits that a term of n letters allows."""
    return 0 if n < 5 else 1 if n < 9 else 2


def pieces(term: str) -> list[tuple[int, str]]:
    """(place, piece) of a term's k + 1 pieces; the letter between two of them is in none."""
    k = allowed(len(term)) + 1
    cuts = [i * (len(term) + 1) // k for i in range(k + 1)]
    return [(a, term[a : b - 1]) for a, b in zip(cuts, cuts[1:], strict=False)]


def automaton(term: str) -> dict[str, int]:
    """letter -> the places of the term that hold it, as bits."""
    out: dict[str, int] = {}
    for i, c in enumerate(term):
        out[c] = out.get(c, 0) | 1 << i
    return out


def distance(places: dict[str, int], m: int, word: str) -> int:
    """Edits between word and the term of m letters, the swap of two neighbours as one (Hyyro's bit-parallel rows)."""
    full, last = (1 << m) - 1, 1 << (m - 1)
    up, down, diagonal, before, out = full, 0, 0, 0, m
    for c in word:
        same = places.get(c, 0)
        diagonal = ((((~diagonal & same) << 1) & before) | (((same & up) + up) ^ up) | same | down) & full
        right, left = down | (full & ~(diagonal | up)), diagonal & up
        out += 1 if right & last else -1 if left & last else 0
        right, left = (right << 1 | 1) & full, (left << 1) & full
        up, down, before = left | (full & ~(diagonal | right)), right & diagonal, same
    return out


class Lexicon:
    """terms: {(term, is it a stem): weight}. match(word) -> (kind, weight) of the best term, or None; remembers words.

    Kinds: 0 the word itself, 1 a stem, 2 a misspelling; an earlier kind wins, then the larger weight.
    """

    def __init__(self, terms: dict[tuple[str, bool], float]):
        self.words = {t: w for (t, stem), w in terms.items() if not stem}
        self.stems = {t: w for (t, stem), w in terms.items() if stem}
        self.sizes = sorted({len(t) for t in self.stems})
        #: piece -> {(place in a word, letters of the word): terms}
        spots: dict[str, dict[tuple[int, int], list[tuple]]] = {}
        for term, weight in sorted(self.words.items()):
            if k := allowed(len(term)):
                entry = (term, k, weight, automaton(term))
                for at, piece in pieces(term):
                    held = spots.setdefault(piece, {})
                    for place in range(max(0, at - k), at + k + 1):
                        for n in range(len(term) - k, len(term) + k + 1):
                            held.setdefault((place, n), []).append(entry)
        self.sieve = ahocorasick.Automaton()
        for piece, held in spots.items():
            self.sieve.add_word(piece, (len(piece) - 1, held))
        if spots:
            self.sieve.make_automaton()
        self.longest = max((len(t) + allowed(len(t)) for t in self.words), default=0) if spots else 0
        self.memo = Remembered(self._find)
        self.match = self.memo.__getitem__

    def _find(self, word: str) -> tuple[int, float] | None:
        if word in self.words:
            return 0, self.words[word]
        stems = [self.stems[word[:k]] for k in self.sizes if word[:k] in self.stems]
        if stems:
            return 1, max(stems)
        n, best, seen = len(word), None, set()
        if n > self.longest:
            return None
        for end, (back, held) in self.sieve.iter(word):
            for term, k, weight, places in held.get((end - back, n), ()):
                if (best is None or weight > best) and term not in seen:
                    seen.add(term)
                    if distance(places, len(term), word) <= k:
                        best = weight
        return None if best is None else (2, best)


def lexicon_of(terms: dict[tuple[str, bool], float]) -> Lexicon:
    """One for each worker process, so words are remembered across its tasks."""
    return held(("lexicon", *sorted(terms.items())), lambda: Lexicon(terms))


def matches(text: str | None, lexicon: Lexicon) -> tuple[int, list[tuple[str, int, float, bool]]]:
    """(words, [(word, kind, weight, quoted)]) of a whole text."""
    if not text:
        return 0, []
    low = text.lower()
    words = _TOKEN.findall(low)
    find = lexicon.match
    if not any(map(find, words)):
        return len(words), []
    out = []
    for m in _TOKEN.finditer(low):
        hit = find(m[0])
        if hit is not None:
            before, after = low[max(0, m.start() - WINDOW) : m.start()], low[m.end() : m.end() + WINDOW]
            # quoted: the nearest line holds an opening mark before and a closing one after
            quoted = bool(_OPEN.search(before.rpartition("\n")[2]) and _CLOSE.search(after.partition("\n")[0]))
            out.append((m[0], *hit, quoted))
    return len(words), out


def features(text: str | None, lexicon: Lexicon) -> list[float]:
    n, found = matches(text, lexicon)
    plain = [x for x in found if not x[3]]
    kinds = Counter(x[1] for x in plain)
    total = sum(x[2] for x in plain)
    return [1.0, math.log1p(kinds[0]), math.log1p(kinds[1]), math.log1p(kinds[2]), math.log1p(len(found) - len(plain)), math.log1p(total), max((x[2] for x in plain), default=0.0), math.sqrt(len(plain) / n) if n else 0.0]


def _counted(batches: Iterator[pd.DataFrame], label: str) -> Iterator[pd.DataFrame]:
    seen: dict[int, Counter] = {0: Counter(), 1: Counter()}
    for pdf in batches:
        for text, y in zip(pdf["text"], pdf[label], strict=True):
            words = set(_TOKEN.findall((text or "").lower()))
            c = seen[int(y)]
            c.update((w, False) for w in words if len(w) <= 40)
            c.update({(w[:k], True) for w in words for k in STEM if len(w) > k})
        if sum(map(len, seen.values())) > 500_000:
            yield _rows(seen)
    yield _rows(seen)


def _rows(seen: dict[int, Counter]) -> pd.DataFrame:
    out = [(t, s, n * y, n * (1 - y)) for y, c in seen.items() for (t, s), n in c.items()]
    for c in seen.values():
        c.clear()
    return pd.DataFrame(out, columns=["term", "stem", "pos", "neg"])


def training_rows(docs: DataFrame, labels: DataFrame, label: str, where: str) -> DataFrame:
    """(doc_id, text, label) of the bounded sample of labelled rows that the condition `where` on doc_id allows.

    Of several labels of a doc_id the largest counts; each of its texts is a row.
    """
    known = labels.where(F.expr(where) & F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).alias(label))
    n = known.count()
    share = min(1.0, FIT_ROWS / n) if n else 1.0
    known = store(known.where(F.expr(f"pmod(xxhash64(doc_id), 1000000) < {math.ceil(share * 1_000_000)}")), "labelled")
    return store(join_ids(docs.select("doc_id", "text"), known, "doc_id", "inner"), "training")


def _sources(batches: Iterator[pd.DataFrame], terms: frozenset, label: str) -> Iterator[pd.DataFrame]:
    """(term, stem, sketch, which, y) of the terms of each text: SKETCHES min-hashes of its pairs of words."""
    for pdf in batches:
        out = []
        for text, y in zip(pdf["text"], pdf[label], strict=True):
            words = _TOKEN.findall((text or "").lower())
            once = set(words)
            held = {(w, False) for w in once} | {(w[:k], True) for w in once for k in STEM if len(w) > k}
            if held := held & terms:
                pairs = np.array([xxhash.xxh3_64_intdigest(f"{a} {b}") for a, b in zip(words, words[1:] or [""], strict=False)], dtype=np.uint64)
                least = [int(mix(pairs + np.uint64(i)).min() >> np.uint64(1)) for i in range(SKETCHES)]
                out += [(t, stem, x, i, int(y)) for t, stem in held for i, x in enumerate(least)]
        yield pd.DataFrame(out, columns=["term", "stem", "sketch", "which", "y"])


def _strong(counts: DataFrame, pos: int, neg: int) -> DataFrame:
    """Terms whose share of toxic rows passes ODDS and EVIDENCE."""
    odds = F.log((F.col("pos") + 0.5) / (pos + 1)) - F.log((F.col("neg") + 0.5) / (neg + 1))
    share, base = F.col("pos") / (F.col("pos") + F.col("neg")), pos / (pos + neg)
    evidence = F.col("pos") * F.log(share / base) + F.when(F.col("neg") > 0, F.col("neg") * F.log((1 - share) / (1 - base))).otherwise(0.0)
    return counts.where("pos > 0").withColumns({"odds": odds, "evidence": evidence}).where(f"odds >= {ODDS} and evidence >= {EVIDENCE}")


def learn_lexicon(train: DataFrame, label: str = "toxic") -> dict[tuple[str, bool], float]:
    """Terms that chance does not explain, counted over rows and then over sources: near copies of a text are one source."""
    sizes = dict(train.groupBy(label).count().collect())
    pos, neg = sizes.get(1, 0), sizes.get(0, 0)
    if not pos or not neg:
        return {}
    counts = map_rows(train.select("text", label), partial(_counted, label=label), "term string, stem boolean, pos long, neg long")
    counts = counts.groupBy("term", "stem").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    odds = {(r["term"], r["stem"]): float(r["odds"]) for r in _strong(counts, pos, neg).collect()}
    if not odds:
        return {}
    seen = map_rows(train.select("text", label), partial(_sources, terms=frozenset(odds), label=label), "term string, stem boolean, sketch long, which int, y int")
    seen = seen.distinct().groupBy("term", "stem", "which").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    # the sketch in which near copies fall together most
    seen = seen.groupBy("term", "stem").agg(F.min("pos").alias("pos"), F.min("neg").alias("neg"))
    return tidy({k: odds[k] for r in _strong(seen, pos, neg).collect() if (k := (r["term"], r["stem"])) in odds})


def tidy(terms: dict[tuple[str, bool], float]) -> dict[tuple[str, bool], float]:
    """Stems that three words or more share, the shortest of nested ones; words without such a stem."""
    words = [t for t, stem in terms if not stem]
    stems: list[str] = []
    for s in sorted((t for t, stem in terms if stem), key=lambda t: (len(t), t)):
        if not s.startswith(tuple(stems)) and sum(w.startswith(s) for w in words) >= 3:
            stems.append(s)
    return {(t, stem): w for (t, stem), w in terms.items() if (t in stems if stem else not t.startswith(tuple(stems)))}


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge * max(1, len(y)) / 100)
    penalty[0] = 1e-6
    for _ in range(rounds):  # Newton steps on a bounded sample
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (p - y) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _featured(batches: Iterator[pd.DataFrame], terms: dict, label: str) -> Iterator[pd.DataFrame]:
    lexicon = lexicon_of(terms)
    for pdf in batches:
        yield pd.DataFrame({"x": [features(t, lexicon) for t in pdf["text"]], "y": pdf[label].astype(float)})


def _scored(batches: Iterator[pd.DataFrame], terms: dict, weights: np.ndarray) -> Iterator[pd.DataFrame]:
    lexicon = lexicon_of(terms)
    for pdf in batches:
        x = np.array([features(t, lexicon) for t in pdf["text"]]).reshape(-1, len(FEATURES))
        yield pdf[["doc_id", "th"]].assign(score=1 / (1 + np.exp(-np.clip(x @ weights, -30, 30))))


#: Rows whose labels may be learned from.
LEARNABLE = "pmod(crc32(cast(doc_id as string)), 4) <> 2"


def score_toxicity(docs: DataFrame, labels: DataFrame, train_docs: DataFrame | None = None, where: str = LEARNABLE) -> DataFrame:
    """(doc_id, th, score) for each row of docs (doc_id, text), score from 0 to 1; th is xxhash64 of the text.

    The model is fitted on the labelled rows of train_docs (docs if None) that `where` allows, FIT_ROWS of them at most.
    Words of more than 40 letters are no terms of the lexicon. Null and empty texts get the score of a text without matches. Labels that are null or neither 0 nor 1 are ignored;
    without labels of both kinds the score is the share of label 1 (0 without any). A repeated doc_id is scored row by
    row. Other columns are ignored; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    train = training_rows(docs if train_docs is None else train_docs, labels, "toxic", where)
    terms = learn_lexicon(train)
    rows = map_rows(train, partial(_featured, terms=terms, label="toxic"), "x array<double>, y double").toPandas()  # FIT_ROWS rows of a few numbers
    if len(rows):
        weights = fit_logistic(np.array(rows["x"].tolist()), rows["y"].to_numpy())
    else:
        weights = np.array([-30.0] + [0.0] * (len(FEATURES) - 1))
    return map_rows(docs.select("doc_id", F.xxhash64("text").alias("th"), "text"), partial(_scored, terms=terms, weights=weights), "doc_id long, th long, score double")
