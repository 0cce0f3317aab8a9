"""Language of every word by a linear-chain conditional random field.

A word's emissions add weights of its affixes, its three-letter grams and the word
itself (hashed); learned transitions make neighbours agree, so that text that changes
language is labelled word by word. Marginals come from the forward-backward
algorithm over the whole text; a text's language is the one with most expected words.
"""

from __future__ import annotations

import random
import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import in_fold, whole_text

BUCKETS = 1 << 16
#: Expected documents per language that the model is fitted on.
DOCS_PER_LANGUAGE = 150
#: Texts with more bytes than this teach nothing: it bounds what reaches the driver.
LONGEST_LEARNT = 1 << 16
#: In learning, for so many chains of one language one is put together from runs of several, so that
#: the transitions see languages change; a run has so many words.
PURE_FOR_MIXED = 4
RUN = (4, 25)
#: In learning, texts are chains of at most so many words; every word takes part.
CHAIN = 100
#: Words decoded together, and remembered per task.
BATCH_WORDS = 400_000
REMEMBERED = 600_000
UNKNOWN = "und"

_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    """Runs of letters in lower case."""
    words = _WORD.findall(text.lower())
    if all(map(str.isalpha, words)):
        return words
    return [w for w in words if any(map(str.isalpha, w))]  # digits of other scripts count as word characters


def word_features(word: str) -> list[int]:
    """Buckets of the word, its first and last one to three bytes and its grams of three bytes."""
    raw = b"^" + word.encode() + b"$"
    crc = zlib.crc32
    found = [crc(raw), crc(raw[:2]), crc(raw[:4]), crc(raw[-2:]), crc(raw[-4:])]
    found += [crc(raw[i : i + 3]) for i in range(len(raw) - 2)]
    return found


def _emissions(words: list[str], weights: np.ndarray) -> np.ndarray:
    """Summed weights of each word's features."""
    features = [word_features(w) for w in words]
    firsts = np.r_[0, np.cumsum([len(f) for f in features])[:-1]]
    flat = np.fromiter(chain.from_iterable(features), np.int64) % BUCKETS
    return np.add.reduceat(weights[flat], firsts, axis=0)


def forward_backward(
    emission: np.ndarray, lengths: np.ndarray, step: np.ndarray, joint: np.ndarray | None = None
) -> np.ndarray:
    """Marginals of chains laid end to end, longest first, all moved along together.

    ``joint``, if given, gets the expected number of each pair of neighbours' languages added.
    """
    n, k = len(lengths), emission.shape[1]
    starts = np.r_[0, np.cumsum(lengths)[:-1]]
    e = np.exp(emission - emission.max(axis=1, keepdims=True))
    forward = np.empty_like(e)
    alive = np.searchsorted(-lengths, -np.arange(lengths[0] if n else 0), side="left")
    message = np.full((n, k), 1.0 / k)
    for t, m in enumerate(alive):
        at = starts[:m] + t
        now = (message[:m] if t == 0 else forward[at - 1] @ step) * e[at]
        forward[at] = now / now.sum(axis=1, keepdims=True)
    marginal = forward.copy()
    backward = np.ones((n, k))
    for t in range(len(alive) - 2, -1, -1):
        m = alive[t + 1]
        at = starts[:m] + t
        ahead = backward[:m] * e[at + 1]
        if joint is not None:
            pair = forward[at][:, :, None] * step * ahead[:, None, :]
            joint += (pair / pair.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        ahead = ahead @ step.T
        backward[:m] = ahead / ahead.sum(axis=1, keepdims=True)
        marginal[at] *= backward[:m]
    return marginal / marginal.sum(axis=1, keepdims=True)


@dataclass
class Tagger:
    """Languages in order, weights per bucket and language, and transition weights."""

    languages: list[str]
    weights: np.ndarray
    transitions: np.ndarray

    def __post_init__(self) -> None:
        self._index: dict[str, int] = {}
        self._known = np.empty((0, len(self.languages)))

    def _rows(self, words: list[str]) -> np.ndarray:
        """Emissions of words; those not remembered are made in one go."""
        if len(self._index) > REMEMBERED:
            self._index, self._known = {}, self._known[:0]
        new = [w for w in set(words) if w not in self._index]
        if new:
            self._index.update(zip(new, range(len(self._index), len(self._index) + len(new)), strict=True))
            self._known = np.concatenate([self._known, _emissions(new, self.weights)])
        return self._known[np.fromiter(map(self._index.__getitem__, words), np.int64, len(words))]

    def marginals(self, texts: list[list[str]]) -> list[np.ndarray]:
        """Per text, words by languages; texts without words are not allowed."""
        lengths = np.array([len(w) for w in texts])
        order = np.argsort(-lengths, kind="stable")
        emission = self._rows(list(chain.from_iterable(texts[i] for i in order)))
        found = forward_backward(emission, lengths[order], np.exp(self.transitions))
        out: list[np.ndarray] = [None] * len(texts)  # type: ignore[list-item]
        for i, part in zip(order, np.split(found, np.cumsum(lengths[order])[:-1]), strict=True):
            out[i] = part
        return out

    def label_words(self, text: str) -> list[tuple[str, str]]:
        """Each word with its likeliest language."""
        words = words_of(text)
        if not words or not self.languages:
            return [(w, UNKNOWN) for w in words]
        best = self.marginals([words])[0].argmax(axis=1)
        return [(w, self.languages[b]) for w, b in zip(words, best, strict=True)]

    def predict(self, texts: Iterable[str]) -> list[tuple[str, float]]:
        """Language and its share of expected words; ``und`` and 0 without a letter."""
        out: list[tuple[str, float]] = []
        batch: list[list[str]] = []
        held = 0

        def flush() -> None:
            nonlocal held
            decoded = iter(self.marginals([w for w in batch if w]) if held else [])
            for words in batch:
                if words:
                    share = next(decoded).mean(axis=0)
                    out.append((self.languages[int(share.argmax())], float(share.max())))
                else:
                    out.append((UNKNOWN, 0.0))
            batch.clear()
            held = 0

        for text in texts:
            words = words_of(text) if self.languages else []
            batch.append(words)
            held += len(words)
            if held >= BATCH_WORDS:
                flush()
        flush()
        return out


def mixed_chains(pieces: list[tuple[list[str], list[int]]], k: int, seed: int = 5) -> list[tuple[list[str], list[int]]]:
    """Chains of runs from pieces of different languages, one after the other, with each word's own label."""
    rng = random.Random(seed)
    by_language: list[list[list[str]]] = [[] for _ in range(k)]
    for words, ys in pieces:
        by_language[ys[0]].append(words)
    there = [y for y in range(k) if by_language[y]]
    out = []
    for _ in range(len(pieces) // PURE_FOR_MIXED if len(there) > 1 else 0):
        words: list[str] = []
        labels: list[int] = []
        y = rng.choice(there)
        while len(words) < CHAIN:
            source = rng.choice(by_language[y])
            n = rng.randint(*RUN)
            start = rng.randrange(max(1, len(source) - n + 1))
            run = source[start : start + n]
            words += run
            labels += [y] * len(run)
            y = rng.choice([z for z in there if z != y])
        out.append((words[:CHAIN], labels[:CHAIN]))
    return out


def fit(texts: list[list[str]], labels: list[int], languages: list[str], steps: int = 40, rate: float = 0.3, ridge: float = 2e-5) -> Tagger:
    """Maximises the likelihood of labelled words by adaptive gradient steps."""
    k = len(languages)
    pieces = [(w[i : i + CHAIN], [y] * len(w[i : i + CHAIN])) for w, y in zip(texts, labels, strict=True) for i in range(0, len(w), CHAIN)]
    pieces += mixed_chains(pieces, k)
    pieces.sort(key=lambda c: -len(c[0]))
    tagger = Tagger(languages, np.zeros((BUCKETS, k)), np.zeros((k, k)))
    if not pieces or k < 2:
        return tagger
    lengths = np.array([len(w) for w, _ in pieces])
    vocabulary: dict[str, int] = {}
    word = np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for c, _ in pieces for w in c), np.int64, lengths.sum())
    truth = np.array([y for _, ys in pieces for y in ys])
    features = [word_features(w) for w in vocabulary]
    flat = np.fromiter(chain.from_iterable(features), np.int64) % BUCKETS
    owner = np.repeat(np.arange(len(features)), [len(f) for f in features])
    firsts = np.r_[0, np.cumsum([len(f) for f in features])[:-1]]
    gold = np.bincount(word * k + truth, minlength=len(vocabulary) * k).reshape(-1, k)
    last = np.zeros(len(word), bool)
    last[np.cumsum(lengths) - 1] = True
    pairs = np.flatnonzero(~last)
    gold_pairs = np.bincount(truth[pairs] * k + truth[pairs + 1], minlength=k * k).reshape(k, k).astype(float)
    total = len(word)
    square_w, square_t = np.zeros_like(tagger.weights), np.zeros((k, k))
    for _ in range(steps):
        emission = np.add.reduceat(tagger.weights[flat], firsts, axis=0)[word]
        step = np.exp(tagger.transitions)
        joint = np.zeros((k, k))
        marginal = forward_backward(emission, lengths, step, joint)
        expected = np.stack([np.bincount(word, weights=marginal[:, j], minlength=len(vocabulary)) for j in range(k)], axis=1)
        slope = (gold - expected)[owner] / total
        g = np.stack([np.bincount(flat, weights=slope[:, j], minlength=BUCKETS) for j in range(k)], axis=1) - ridge * tagger.weights
        gt = (gold_pairs - joint) / total - 0.01 * tagger.transitions
        square_w += g**2
        square_t += gt**2
        tagger.weights += rate * g / (np.sqrt(square_w) + 1e-9)
        tagger.transitions += rate * gt / (np.sqrt(square_t) + 1e-9)
    return tagger


def predicted(model: Tagger, text: Column) -> Column:
    languages, weights, transitions = model.languages, model.weights.astype(np.float32), model.transitions

    def predict(series: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        tagger = Tagger(languages, weights.astype(float), transitions)
        for texts in series:
            yield pd.DataFrame(tagger.predict(texts), columns=["lang_pred", "score"])

    predict.__annotations__ = {"series": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(predict, "lang_pred string, score double")(text)


def languages(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", folds: int = 3, fold: int = 1
) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every row.

    Fitted outside the held-out fold, on a sample by id of about ``DOCS_PER_LANGUAGE``
    whole texts of each language, none longer than ``LONGEST_LEARNT`` bytes; NULL languages teach
    nothing. NULL texts and those without a letter are ``und`` with score 0, and so is all if nothing can
    be learned. Repeated rows are predicted each, and of rows that share an id one teaches. Other
    columns are ignored; an empty table gives an empty one.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), whole_text(text).alias("text"), F.col(lang).alias("lang"))
    learning = rows.where(~in_fold("doc_id", folds, fold) & F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    learning = learning.where(F.octet_length("text") <= LONGEST_LEARNT)
    counts = {r["lang"]: r["n"] for r in learning.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    names = sorted(counts)
    share = F.lit(0.0)
    for name in names:
        share = F.when(F.col("lang") == name, F.lit(DOCS_PER_LANGUAGE / counts[name])).otherwise(share)
    draw = F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1_000_000)) / 1_000_000
    sample = learning.where(draw < share).dropDuplicates(["doc_id"]).orderBy("doc_id").toPandas()
    model = fit([words_of(t) for t in sample["text"]], [names.index(x) for x in sample["lang"]], names)
    answer = rows.select("doc_id", in_fold("doc_id", folds, fold).alias("held_out"), predicted(model, F.col("text")).alias("p"))
    return answer.select("doc_id", "held_out", "p.lang_pred", "p.score")
