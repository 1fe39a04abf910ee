"""Toxicity by bags of subword embeddings, averaged, into a linear softmax; trained jointly in numpy.

A word (lower-cased run of letters and digits) is the average of the embeddings of its character n-grams, with
marks for its ends, and of the whole word, all hashed to BUCKETS rows of DIM numbers; so a misspelling that was never seen
shares most of its vectors with the word it comes from. A text is scored in stretches of WINDOW words: the
average of a stretch's words (a repeated word counts as nothing the second time) goes through a linear softmax of two
classes, and the text has its highest stretch's score, so a few words count in a long text as much as in a short one. All words of all texts are scored.
Runs of over LONGEST code points (unspaced text, words run together) become overlapping pieces of PIECE code points, each a word of its
own, so what stands in a run counts wherever it stands.

Training starts from small random embeddings and random softmax weights and moves both by Adam on the cross entropy of the
stretches of a bounded sample of the labelled rows: up to SAMPLE of each label, in the order of a hash of the id, of up to
MAX_POINTS code points each and SAMPLE_POINTS in all; rows beyond are passed over. All stretches of these texts are
learned from. Those of a text share its weight: at first alike, then those that the model finds toxic most weigh more, since most
stretches of a toxic text are harmless and the ones of a harmless text that look toxic are those that count. Training ends when
GOAL of the toxic texts score SURE, as labels may be wrong, or after STEPS steps. Rows that fewer than MIN_TEXTS texts have
aren't learned; their embeddings are zero.

Both classes' log odds are linear in the embeddings, so a step needs one number for each row and stretch
(row times the difference of the softmax weights) and its gradient is an outer product; scoring keeps that number of each row only.

Defined results: a null or wordless text gets the model's score for no words at all; null ids and repeated rows are scored
as they are; a null label isn't learned from; without labels of both kinds every score is the share of label 1 (0
without labels); an empty table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, per_text

BUCKETS = 1 << 19
DIM = 16
GRAMS = (3, 4, 5)
WINDOW = 8
#: Rows of each label that training takes at most, code points of such a row, and of all of them.
SAMPLE = 1000
MAX_POINTS = 200_000
SAMPLE_POINTS = 12_000_000
STEPS, ALL_STEPS = 200, 10
GOAL, SURE = 0.95, 0.75
#: Rows of fewer training texts are not learned.
MIN_TEXTS = 4
#: Adam's rates of embeddings and bias, and of the softmax weights; after DECAY steps they are half as large.
RATE, SOFT_RATE, DECAY = 1.0, 0.1, 60
#: Values whose gradient's size is below this share of the largest move less than the others.
FLOOR = 0.3
#: All harmless texts together weigh so many times as much as all toxic ones.
HARMLESS = 8.0
#: How much more a stretch of a toxic text weighs for each standard deviation that it scores above the text's mean.
SHARPNESS = 0.3
SEED = 7
CUT = 0.7

WORDS = re.compile(r"[^\W_]+")
#: Code points of a word at most; longer runs are split into pieces of PIECE code points, one at each PIECE // 2.
LONGEST = 64
PIECE = 16
#: Words that a worker remembers, and words that it takes in hand at once.
REMEMBER = 1 << 17
STEP = 1 << 14
#: Texts of more code points are read some words at a time.
LONG = 1 << 20
_MUL = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.cumprod(np.full(LONGEST + 2, 0x5851F42D4C957F2D, np.uint64))


def _in_pieces(words: list[str]) -> list[str]:
    """Long runs in pieces; the last ends with its run."""
    if not words or max(map(len, words)) <= LONGEST:
        return words
    return [x for w in words for x in ([w] if len(w) <= LONGEST else [*(w[k : k + PIECE] for k in range(0, len(w) - PIECE, PIECE // 2)), w[-PIECE:]])]


def in_steps(text: str) -> Iterator[list[str]]:
    """The words of a text, some at a time."""
    found = WORDS.finditer(text.lower())
    while part := [m[0] for m in islice(found, STEP)]:
        yield _in_pieces(part)


def words_of(text: str) -> list[str]:
    """The words of a text."""
    return _in_pieces(WORDS.findall(text.lower()))


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(row, number of its word) of the n-grams, with end marks, and the wholes of all words."""
    marked = [f"<{w}>" for w in words]
    points = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.array([len(w) for w in marked])
    starts = np.cumsum(sizes) - sizes
    word = np.repeat(np.arange(len(words)), sizes)
    left = (starts + sizes)[word] - np.arange(len(points))  # points up to the word's end
    rows, owners = [], []
    for n in GRAMS:
        at = np.flatnonzero(left >= n)
        h = np.full(len(at), n, np.uint64)
        for k in range(n):
            h = (h ^ points[at + k]) * _MUL
            h ^= h >> np.uint64(29)
        rows.append(h)
        owners.append(word[at])
    whole = points * _POWERS[np.arange(len(points)) - starts[word]]
    rows.append((np.add.reduceat(whole, starts) ^ np.uint64(0xA5)) * _MUL)
    owners.append(np.arange(len(words)))
    h = np.concatenate(rows)
    return ((h ^ (h >> np.uint64(32))) % np.uint64(BUCKETS)).astype(np.int64), np.concatenate(owners)


def stretches(n: int) -> np.ndarray:
    """Starts of the stretches of n words: about WINDOW words each."""
    k = max(1, n // WINDOW)
    return np.arange(k) * n // k


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def _again(stretch: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Which places repeat a word of the same stretch."""
    order = np.lexsort((word, stretch))
    same = np.zeros(len(word), bool)
    same[order[1:]] = (word[order[1:]] == word[order[:-1]]) & (stretch[order[1:]] == stretch[order[:-1]])
    return same


class Model:
    """Embeddings of the learned rows, softmax weights and bias; rows has each row's share of the log odds, which scoring needs."""

    def __init__(self, learned: np.ndarray, embeddings: np.ndarray, soft: np.ndarray, bias: np.ndarray):
        self.learned, self.embeddings, self.soft, self.bias = learned, embeddings, soft, bias
        self.rows = np.zeros(BUCKETS, np.float32)
        self.rows[learned] = embeddings @ (soft[1] - soft[0])
        self.base = float(bias[1] - bias[0])
        self._forget()

    def _forget(self) -> None:
        self.number: dict[str, int] = {}
        self.shares = np.zeros(0, np.float32)

    def __getstate__(self):
        return {"rows": self.rows, "base": self.base}

    def __setstate__(self, state):
        self.__dict__ |= state
        self._forget()

    def _learn(self, words) -> None:
        """Remembers the words that it doesn't know yet."""
        new = [w for w in words if w not in self.number]
        shares = [self.shares]
        for k in range(0, len(new), STEP):
            part = new[k : k + STEP]
            rows, owner = subwords(part)
            shares.append((np.bincount(owner, self.rows[rows], len(part)) / np.bincount(owner, minlength=len(part))).astype(np.float32))
        self.number.update(zip(new, range(len(self.number), len(self.number) + len(new)), strict=True))
        self.shares = np.concatenate(shares)

    def scores(self, texts: list[str]) -> list[float]:
        if len(self.number) >= REMEMBER:
            self._forget()
        out = []
        bags = [words_of(t) if len(t) <= LONG else None for t in texts]
        self._learn(set().union(*filter(None, bags)))
        for text, words in zip(texts, bags, strict=True):
            if words is None:  # some words at a time
                numbers = array("i")
                for part in in_steps(text):
                    self._learn(dict.fromkeys(part))
                    numbers.extend(map(self.number.__getitem__, part))
            else:
                numbers = np.fromiter(map(self.number.__getitem__, words), np.int32, len(words))
            out.append(float(_sigmoid(self._log_odds(np.asarray(numbers, np.int32)))))
        return out

    def _log_odds(self, words: np.ndarray) -> float:
        if not len(words):
            return self.base
        at = stretches(len(words))
        sizes = np.diff(at, append=len(words))
        s = self.shares[words].astype(np.float64)
        s[_again(np.repeat(np.arange(len(at)), sizes), words)] = 0
        return float((np.add.reduceat(s, at) / sizes).max()) + self.base


def _constant(rate: float) -> Model:
    """The same score for all texts."""
    odds = np.log(max(rate, 1e-9)) - np.log(max(1 - rate, 1e-9))
    return Model(np.zeros(0, np.int64), np.zeros((0, DIM)), np.zeros((2, DIM)), np.array([0.0, odds]))


class _Sample:
    """The training texts as numbers: words of each stretch, n-gram rows of each word."""

    def __init__(self, rows: list[tuple[str, int]]):
        number: dict[str, int] = {}
        ids, starts, owner, label, in_texts = array("i"), array("q"), array("i"), array("b"), array("i")
        for doc, (text, y) in enumerate(rows):
            words = words_of(text)
            if not words:
                continue
            at = stretches(len(words))
            starts.extend((at + len(ids)).tolist())
            ids.extend([number.setdefault(w, len(number)) for w in words])
            owner.extend([doc] * len(at))
            label.extend([y] * len(at))
            in_texts.extend([0] * (len(number) - len(in_texts)))
            for k in {number[w] for w in words}:
                in_texts[k] += 1
        self.texts, self.words = len(rows), np.array(ids, np.int64)
        self.starts, self.owner, self.label = np.array(starts, np.int64), np.array(owner, np.int64), np.array(label, np.int64)
        if not len(self.words):
            return
        self.sizes = np.diff(self.starts, append=len(self.words))
        self.once = ~_again(np.repeat(np.arange(len(self.starts)), self.sizes), self.words)
        vocabulary, parts, counts = list(number), [], []
        for at in range(0, len(vocabulary), 1 << 13):  # in blocks, for the driver's memory
            found, of = subwords(vocabulary[at : at + (1 << 13)])
            parts.append(found[np.argsort(of, kind="stable")].astype(np.int32))
            counts.append(np.bincount(of))
        grams, self.gram_sizes = np.concatenate(parts), np.concatenate(counts)
        self.gram_starts = np.cumsum(self.gram_sizes) - self.gram_sizes
        seen = np.bincount(grams, np.repeat(np.array(in_texts), self.gram_sizes), BUCKETS)
        #: Rows that are learned; all others share one place behind them, which stays zero.
        self.learned = np.flatnonzero(seen >= MIN_TEXTS)
        place = np.full(BUCKETS, len(self.learned), np.int64)
        place[self.learned] = np.arange(len(self.learned))
        self.grams = place[grams]

    def shared(self, weight: np.ndarray) -> np.ndarray:
        """Weights of stretches that add up to 1 for each text."""
        return weight / np.bincount(self.owner, weight, self.texts)[self.owner]

    def standing(self, z: np.ndarray) -> np.ndarray:
        """By how many standard deviations of its text's stretches a stretch is above their mean."""
        n = np.bincount(self.owner, minlength=self.texts).clip(1)
        out = z - (np.bincount(self.owner, z, self.texts) / n)[self.owner]
        return out / (np.sqrt(np.bincount(self.owner, out * out, self.texts) / n)[self.owner] + 1e-9)

    def log_odds(self, rows: np.ndarray) -> np.ndarray:
        """Of each stretch, without the bias, from the rows' shares."""
        words = np.add.reduceat(np.append(rows, 0.0)[self.grams], self.gram_starts) / self.gram_sizes
        return np.add.reduceat(words[self.words] * self.once, self.starts) / self.sizes

    def to_rows(self, stretches: np.ndarray) -> np.ndarray:
        """What the rows get of numbers for the stretches: log_odds' transpose."""
        words = np.bincount(self.words, np.repeat(stretches / self.sizes, self.sizes) * self.once, len(self.gram_sizes))
        return np.bincount(self.grams, np.repeat(words / self.gram_sizes, self.gram_sizes), len(self.learned) + 1)[:-1]


def start(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Random embeddings of n rows and softmax weights, and the bias."""
    rng = np.random.default_rng(SEED)
    return rng.uniform(-1, 1, (n, DIM)) / DIM, rng.normal(0, 1, (2, DIM)) / DIM**0.5, np.array([0.0, -2.0])


def train(rows: list[tuple[str, int]]) -> Model:
    """Fits the model to (text, label) rows."""
    rate = sum(y for _, y in rows) / max(1, len(rows))
    s = _Sample(rows) if 0 < rate < 1 else None
    if s is None or not len(s.words):
        return _constant(rate)
    toxic = np.unique(s.owner[s.label == 1])
    texts = [max(1, len(np.unique(s.owner[s.label == k]))) for k in (0, 1)]
    share = np.where(s.label == 1, 1 / texts[1], HARMLESS / texts[0])
    params = start(len(s.learned))
    emb, soft, bias = params
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    for step in range(STEPS):
        d = soft[1] - soft[0]
        z = s.log_odds(np.einsum("ij,j->i", emb, d)) + bias[1] - bias[0]
        p = _sigmoid(z)
        most = np.full(s.texts, -np.inf)
        np.maximum.at(most, s.owner, z)
        weight = np.ones(len(z))
        if step >= ALL_STEPS:
            if (_sigmoid(most[toxic]) >= SURE).mean() >= GOAL:
                break
            weight = np.where(s.label == 1, np.exp(SHARPNESS * s.standing(z)), (p + 0.02) ** 2)
        weight = s.shared(weight) * share
        dz = (p - s.label) * weight
        c = s.to_rows(dz)
        dw = np.einsum("i,ij->j", c, emb)
        grads = (np.outer(c, d), np.stack([-dw, dw]), np.array([-dz.sum(), dz.sum()]))
        for value, (m, v), grad, r in zip(params, moments, grads, (RATE, SOFT_RATE, RATE), strict=True):
            m += 0.1 * (grad - m)
            v += 0.01 * (grad * grad - v)
            size = np.sqrt(v / (1 - 0.99 ** (step + 1)))
            # Rows with a small gradient beside the largest move less than the rate, so few texts teach little.
            value -= r / (1 + step / DECAY) * m / (1 - 0.9 ** (step + 1)) / (size + FLOOR * np.sqrt(v.max(initial=0)) + 1e-12)
    return Model(s.learned, emb, soft, bias)


def held_out(doc_id):
    """Whether a row's label may not be learned from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def sample(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> list[tuple[str, int]]:
    """The rows that training takes: at most size of each label; docs has columns doc_id and text."""
    order = [F.md5(F.coalesce(F.col("id").cast("string"), F.lit(""))), "id"]
    can = labels.select(F.col("doc_id").alias("id"), F.col("toxic").alias("y")).filter(~held_out(F.col("id")) & F.col("id").isNotNull())
    few = [can.filter(F.col("y") == y).orderBy(*order).limit(size) for y in (0, 1)]
    few = few[0].unionByName(few[1]).groupBy("id").agg(F.max("y").alias("y"))  # 2 * size rows at most
    rows = docs.filter(F.length("text") <= MAX_POINTS).join(F.broadcast(few), F.col("doc_id") == F.col("id")).groupBy("id").agg(F.min("text").alias("text"), F.first("y").alias("y"))
    out, held = [], 0
    for r in rows.orderBy(*order).toLocalIterator():
        if held + len(r.text) <= SAMPLE_POINTS:
            held += len(r.text)
            out.append((r.text, int(r.y)))
    return out


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    return train(sample(id_and_text(docs, id_col, text_col), labels))


def score_of(docs: DataFrame, model: Model, text: Column) -> Column:
    """The score of a text column of docs."""
    given = docs.sparkSession.sparkContext.broadcast(model)  # 2 MB, whatever the input
    return per_text(docs.sparkSession, lambda texts: pa.array(given.value.scores(texts), pa.float64()), "double", text)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row of docs: doc_id, held_out, score, predicted."""
    docs = id_and_text(docs, id_col, text_col)
    out = docs.select("doc_id", score_of(docs, model, F.col("text")).alias("score"))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def keep_harmless(docs: DataFrame, model: Model, text_col: str = "text", cut_at: float = CUT) -> DataFrame:
    """docs, with all its columns, without the rows that score cut_at or more."""
    return docs.filter(score_of(docs, model, F.col(text_col)) < cut_at)
