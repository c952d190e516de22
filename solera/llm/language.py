"""Language ID with a linear-chain conditional random field over words (operator 2).

Every word of a text gets a language: the score of a labelling is the sum over words of the
weights of the word's features for its label, and of learned transitions from word to word.
Features of a word: its letter n-grams (1 to 4, with marks at both ends, so that beginnings
and endings are features of their own) and the lexicons (frequent words of one language) that
hold it.  The marginal of each word comes from forward-backward over the whole text; a
document's language is the one with the greatest sum of marginals over words with a letter.

Training is bounded: for each language the whole texts of ``DOCS_PER_LANG`` documents of at most
``TRAIN_CHARS`` code points, the first in the order of a hash of the id, are cut into passages
that are joined to ``SEQUENCES`` code-switched sequences of ``LENGTH`` words (a passage takes the
language of its document), and the conditional likelihood is maximised in numpy.  So a word in
a foreign passage is labelled by what it is, and transitions are learned from switches.

Prediction is one pass over whole texts, without a shuffle.  A task gathers documents until
they have ``BLOCK_WORDS`` words, scores the distinct words of the block once, and runs
forward-backward for all its documents together, one word position after the other.

Defined cases: a text that is null or has no letter is ``und`` with score 0 (so is every text if
no document with a language may be learnt from); ties go to the first language in code point
order; a word of more than ``WORD_CHARS`` code points is taken in pieces of that length;
repeated rows each get a row; an empty table gives an empty result; other columns are kept.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from solera.llm.common import crc_mod, fitted, text_batches, text_of

FOLDS, HELD_OUT = 5, 0
DOCS_PER_LANG = 300
TRAIN_CHARS = 20000
SEQUENCES, LENGTH, EPOCHS = 4000, 40, 4
LEXICON = 300
HASHED = 1 << 16
WORD_CHARS = 32
BLOCK_WORDS = 1_000_000
_MARKS = ".,;:!?\"'()[]{}|«»¿¡"


def held_out(doc_id: Column) -> Column:
    return crc_mod(doc_id, FOLDS) == HELD_OUT


def words_in(text: str) -> list[str]:
    """Lower-cased words without outer punctuation, long ones in pieces."""
    out = [w.strip(_MARKS) or w for w in text.lower().split()]
    if any(len(w) > WORD_CHARS for w in out):
        out = [w[k:k + WORD_CHARS] for w in out for k in range(0, len(w), WORD_CHARS)]
    return out


def _grams(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(which words, hashed feature) for each n-gram position of words of WORD_CHARS at most."""
    codes = np.array([f"\x02{w}\x03" for w in words], dtype=f"U{WORD_CHARS + 2}").view(np.uint32).reshape(len(words), -1).astype(np.uint64)
    lens = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    order = np.argsort(-lens, kind="stable")
    codes, sorted_lens = codes[order], -lens[order]
    for n in range(1, 5):
        for at in range(int(-sorted_lens[0]) - n + 1 if len(words) else 0):
            k = int(np.searchsorted(sorted_lens, -(at + n), side="right"))  # words that long
            h = np.full(k, 0x9E3779B97F4A7C15 + n, np.uint64)
            for j in range(at, at + n):
                h = (h ^ codes[:k, j]) * np.uint64(0x100000001B3)
                h ^= h >> np.uint64(29)
            yield order[:k], ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.int64)


class Crf:
    """langs, weights (HASHED + languages, languages), moves and first (log transition scores)."""

    def __init__(self, langs: list[str], lexicon: dict[str, int]):
        n = len(langs)
        self.langs, self.lexicon = langs, lexicon
        self.weights, self.moves, self.first = np.zeros((HASHED + n, n)), np.zeros((n, n)), np.zeros(n)

    def emissions(self, words: list[str]) -> np.ndarray:
        """Summed feature weights of each word for each language."""
        out = np.zeros((len(words), len(self.langs)))
        for which, feature in _grams(words):
            out[which] += self.weights[feature]  # a word once in each position
        for k, w in enumerate(words):
            if w in self.lexicon:
                out[k] += self.weights[HASHED + self.lexicon[w]]
        return out

    def marginals(self, emission: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """Forward-backward for several texts laid end to end, longest first: one row a word."""
        move, first = np.exp(self.moves), np.exp(self.first)
        e = np.exp(emission - emission.max(axis=1, keepdims=True))
        starts = np.cumsum(lens) - lens
        alive = len(lens) - np.searchsorted(lens[::-1], np.arange(lens[0]) + 1, side="left")  # texts that have word t
        ahead = np.empty_like(e)
        a = first * e[starts[:alive[0]]]
        for t in range(int(lens[0])):
            k = alive[t]
            if t:
                a = (a[:k] @ move) * e[starts[:k] + t]
            a = a / a.sum(axis=1, keepdims=True)
            ahead[starts[:k] + t] = a
        out, b = ahead, np.ones((0, e.shape[1]))
        for t in range(int(lens[0]) - 1, -1, -1):
            k = alive[t]
            if len(b):
                b = (b * e[starts[:len(b)] + t + 1]) @ move.T
            b = np.vstack([b, np.ones((k - len(b), e.shape[1]))])
            b = b / b.sum(axis=1, keepdims=True)
            g = ahead[starts[:k] + t] * b
            out[starts[:k] + t] = g / g.sum(axis=1, keepdims=True)
        return out

    def predict(self, texts: list[list[str]]) -> list[tuple[str, float, int]]:
        """(language, score, switches) of each text given as words; texts without words are und."""
        out = [("und", 0.0, 0)] * len(texts)
        order = sorted((k for k, t in enumerate(texts) if t), key=lambda k: -len(texts[k]))
        if not order or not self.langs:
            return out
        at: dict[str, int] = {}
        lens = np.array([len(texts[k]) for k in order], np.int64)
        ids = np.fromiter((at.setdefault(w, len(at)) for k in order for w in texts[k]), np.int64, int(lens.sum()))
        words = list(at)
        letters = np.fromiter((any(map(str.isalpha, w)) for w in words), bool, len(words))
        emission = self.emissions(words) * letters[:, None]
        marginal = self.marginals(emission[ids], lens)
        starts = np.cumsum(lens) - lens
        lettered = letters[ids]
        total = np.add.reduceat(marginal * lettered[:, None], starts, axis=0)
        best = marginal.argmax(axis=1)
        turn = np.append(False, (best[1:] != best[:-1]) & lettered[1:] & lettered[:-1])
        turn[starts] = False
        turns = np.add.reduceat(turn.astype(np.int64), starts)
        for k, s, n in zip(order, total, turns):
            if s.sum() > 0:
                out[k] = (self.langs[int(s.argmax())], float(min(1.0, s.max() / s.sum())), int(n))
        return out


def _sequences(docs: list[tuple[int, list[str]]], count: int, length: int, rng: np.random.Generator):
    """Code-switched training sequences: words and labels, (count, length) each."""
    docs = [d for d in docs if d[1]]
    words, labels = [], np.empty((count, length), np.int64)
    by_lang = {k: [d for d in docs if d[0] == k] for k in {d[0] for d in docs}}
    langs = sorted(by_lang)
    for s in range(count):
        row: list[str] = []
        while len(row) < length:
            own = by_lang[langs[rng.integers(len(langs))]]
            lang, text = own[rng.integers(len(own))]
            n = min(int(rng.integers(4, length + 1)), length - len(row))
            at = int(rng.integers(max(1, len(text) - n + 1)))
            part = text[at:at + n]
            labels[s, len(row):len(row) + len(part)] = lang
            row += part
        words.append(row)
    return words, labels


def fit(docs: list[tuple[str, str]], sequences: int = SEQUENCES, length: int = LENGTH, epochs: int = EPOCHS, rate: float = 0.2,
        decay: float = 1e-6, batch: int = 64) -> Crf:
    """Train on (language, text).  Adagrad on the conditional log-likelihood."""
    langs = sorted({x for x, _ in docs})
    if not langs:
        return Crf([], {})
    texts = [(langs.index(x), words_in(t)) for x, t in docs]
    counts = [Counter(w for k, t in texts if k == lang for w in t) for lang in range(len(langs))]
    every = sum(counts, Counter())
    lexicon = {w: k for k, c in enumerate(counts) for w in
               sorted((w for w, n in c.items() if n >= 3 and n >= 0.8 * every[w]), key=lambda w: (-c[w], w))[:LEXICON]}
    crf = Crf(langs, lexicon)
    if not any(t for _, t in texts):
        return crf
    rng = np.random.default_rng(7)
    rows, labels = _sequences(texts, sequences, length, rng)
    at: dict[str, int] = {}
    ids = np.array([[at.setdefault(w, len(at)) for w in r] for r in rows])
    words = list(at)
    found = [(which, feature) for which, feature in _grams(words)]
    lex = [(k, HASHED + lexicon[w]) for k, w in enumerate(words) if w in lexicon]
    which = np.concatenate([x for x, _ in found] + [np.array([k for k, _ in lex], np.int64)])
    feature = np.concatenate([x for _, x in found] + [np.array([f for _, f in lex], np.int64)])
    order = np.argsort(which, kind="stable")
    feature, n_feats = feature[order], np.bincount(which, minlength=len(words))
    ends = np.cumsum(n_feats)
    n, size = len(langs), HASHED + len(langs)
    past = [np.full_like(x, 1e-6) for x in (crf.weights, crf.moves, crf.first)]
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(sequences), max(1, sequences // batch)):
            own, back = np.unique(ids[part].ravel(), return_inverse=True)
            sizes = n_feats[own]
            offsets = np.cumsum(sizes) - sizes
            flat = feature[np.repeat(ends[own] - n_feats[own] - offsets, sizes) + np.arange(int(sizes.sum()))]
            emission = np.add.reduceat(crf.weights[flat], offsets, axis=0)[back].reshape(len(part), length, n)
            e = np.exp(emission - emission.max(axis=2, keepdims=True))
            move = np.exp(crf.moves)
            a, b = np.empty_like(e), np.ones_like(e)
            x = np.exp(crf.first) * e[:, 0]
            for t in range(length):
                if t:
                    x = (a[:, t - 1] @ move) * e[:, t]
                a[:, t] = x / x.sum(axis=1, keepdims=True)
            for t in range(length - 2, -1, -1):
                x = (b[:, t + 1] * e[:, t + 1]) @ move.T
                b[:, t] = x / x.sum(axis=1, keepdims=True)
            g = a * b
            g /= g.sum(axis=2, keepdims=True)
            two = a[:, :-1, :, None] * move * (b * e)[:, 1:, None, :]
            two /= two.sum(axis=(2, 3), keepdims=True)
            y = labels[part]
            gold = np.eye(n)[y]
            grad_word = np.zeros((len(own), n))
            np.add.at(grad_word, back.ravel(), (gold - g).reshape(-1, n))
            spread = np.repeat(grad_word, sizes, axis=0)
            grad = np.stack([np.bincount(flat, spread[:, k], size) for k in range(n)], axis=1)
            pairs = np.bincount((y[:, :-1] * n + y[:, 1:]).ravel(), minlength=n * n).reshape(n, n)
            grads = (grad - decay * crf.weights, pairs - two.sum(axis=(0, 1)), (gold[:, 0] - g[:, 0]).sum(axis=0))
            for p, h, d in zip((crf.weights, crf.moves, crf.first), past, grads):
                d = d / len(part)
                h += d * d
                p += rate * d / np.sqrt(h)
    crf.weights = crf.weights.astype(np.float32)
    return crf


def train(docs: DataFrame, per_lang: int = DOCS_PER_LANG, chars: int = TRAIN_CHARS, **kw) -> Crf:
    """Fit on the bounded sample of ``docs`` (doc_id, text, lang)."""
    first = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    usable = docs.filter(F.col("lang").isNotNull() & (F.length("text") <= chars))
    ids = usable.select("doc_id", "lang").withColumn("nth", F.row_number().over(first)).filter(F.col("nth") <= per_lang)
    ids = ids.select(F.col("doc_id").alias("__id"), F.col("lang").alias("__lang"))
    sample = usable.join(ids, usable["doc_id"].eqNullSafe(ids["__id"]) & (usable["lang"] == ids["__lang"]), "left_semi")
    return fitted(sample.select("lang", "text").distinct(), lambda pdf: fit(sorted(zip(pdf["lang"], pdf["text"])), **kw))


def labelled(docs: DataFrame, model: Crf) -> DataFrame:
    """``docs`` without ``text`` and with lang_pred, score and n_switches (words whose language
    differs from that of the word before)."""
    spark = docs.sparkSession
    text_batches(spark)
    docs = docs.drop("lang_pred", "score", "n_switches")  # results take the place of columns of their names
    shared = spark.sparkContext.broadcast(model)
    kept = [f for f in docs.schema.fields if f.name != "text"]
    schema = T.StructType([*kept, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
                           T.StructField("n_switches", T.LongType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        crf, held, words, count = shared.value, [], [], 0

        def flush() -> pd.DataFrame:
            out = pd.concat(held, ignore_index=True)
            return out.assign(**{c: list(x) for c, x in zip(("lang_pred", "score", "n_switches"), zip(*crf.predict(words)))})

        for pdf in batches:
            own = [words_in(t) if lettered else [] for t, lettered in zip(pdf["__text"], pdf["__letter"])]
            held.append(pdf.drop(columns=["__text", "__letter"]))
            words += own
            count += sum(map(len, own))
            if count >= BLOCK_WORDS:
                yield flush()
                held, words, count = [], [], 0
        if words:
            yield flush()

    text = text_of(F.col("text"))
    given = docs.select(*[f.name for f in kept], text.alias("__text"), text.rlike(r"\p{L}").alias("__letter"))
    return given.mapInPandas(run, schema)
