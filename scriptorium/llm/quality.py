"""Quality classification by co-training.

Two views of a document: its text (hashed words and the text's shape) and its metadata (source, language, size and line
counts). Each view has a logistic classifier. In each round of co-training every unlabelled document is scored with both
views on the executors: what one view is confident about becomes pseudo-labelled training data of the other.
Held-out labels calibrate both views and weigh their combination, which scores all documents.

Only labelled rows are bounded: ``labelled_rows`` at most, drawn by a hash of the id over the whole table; their features
reach the driver. Pseudo-labelled documents come as sums over all of them:

- for the metadata view, the number of documents of each metadata tuple and pseudo-label, which is all it needs;
- for the text view, the gradient at the weights of the round before and the sum of squares for each feature. They make a
  proximal term, which is minimised together with the labelled rows' loss.

All pseudo-labelled documents weigh alike, half a labelled row each, and half of the labelled rows together at most.
"""

from __future__ import annotations

import string
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import WordHashes, discard, stored, tidy, words_alnum

BITS = 16
WORDS = 1 << BITS
#: Buckets of the text's shape follow the words' in the text view.
SHAPES, LEVELS = 12, 8
TEXT_SIZE = WORDS + SHAPES * LEVELS
META_SIZE = 1 << 12
#: Bytes of some symbols, frequent capitals and digits, and of all ASCII punctuation, capitals and digits.
GROUPS = ("#$%&*|!@", "AEINORST", "012357", string.punctuation, string.ascii_uppercase, string.digits)
CLASSES = np.array([[b in c.encode() for b in range(256)] for c in GROUPS], np.int64)
CONFIDENT, ROUNDS = 0.97, 3
#: Labelled ids (8 bytes each) are broadcast up to this count.
BROADCAST_IDS = 1_000_000
#: Sums of gradients are of whole numbers, so they don't depend on the order of tasks.
UNIT = float(1 << 24)
FEATURES = "doc_id long, y int, held boolean, i binary, v binary, m binary"


def shape(raw: bytes, words: list[bytes], distinct: int) -> list[int]:
    """Buckets of shape: shares (in eighths) of repeated words, of some symbols, frequent capitals and digits, of all ASCII punctuation, capitals and digits, the longest line's length and so on."""
    n, m = max(1, len(raw)), max(1, len(words))
    bytes_of = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    symbols, upper, digits, all_symbols, all_upper, all_digits = (CLASSES @ bytes_of / n).tolist()
    lines = int(bytes_of[10]) + 1
    longest = max(map(len, raw.split(b"\n")))
    doubled = sum(a == b for a, b in zip(words, words[1:], strict=False)) / m
    values = [1 - distinct / m, 8 * symbols, 4 * upper, 8 * digits, lines / m * 4, doubled, n / m / 24, min(1.0, np.log2(m) / 16)]
    values += [all_symbols, all_upper, all_digits, min(1.0, np.log2(longest + 1) / 16)]
    return [WORDS + i * LEVELS + min(LEVELS - 1, int(v * LEVELS)) for i, v in enumerate(values)]


def text_view(raw: bytes, hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """(feature indices, values): log-scaled word counts and shape buckets."""
    words = words_alnum(raw)
    index, count = np.unique((hashes.of(words) & np.uint64(WORDS - 1)).astype(np.int32), return_counts=True)
    shapes = shape(raw, words, len(index))
    return np.concatenate([index, shapes]).astype(np.int32), np.concatenate([np.log1p(count), np.ones(len(shapes))]).astype(np.float32)


def meta_view(source: str | None, lang: str | None, n_chars: int | None, raw: bytes) -> np.ndarray:
    """Feature indices: hashed source, language, their pair, and size and line counts in powers of two."""
    lines = raw.count(b"\n") + 1
    size = n_chars if n_chars is not None else len(raw)
    names = (f"s={source}", f"l={lang}", f"s={source}/l={lang}", f"n={int(size).bit_length()}", f"r={lines.bit_length()}", f"w={(max(0, size) // lines).bit_length()}", "")
    return np.array([zlib.crc32(x.encode()) % META_SIZE for x in names], np.int32)


class Logistic:
    """Logistic regression on sparse rows with an L1 penalty, by accelerated proximal steps."""

    def __init__(self, size: int, penalty: float):
        self.w, self.bias, self.penalty = np.zeros(size), 0.0, penalty

    def fit(self, rows: Rows, y: np.ndarray, weight: np.ndarray, steps: int = 60, others: Others | None = None) -> Logistic:
        """On rows, and on ``others`` by their gradient and squares at the present weights."""
        if not len(y) or y.min() == y.max():  # one class: a constant
            self.w[:] = 0
            self.bias = float(np.clip(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)), -4, 4)) if len(y) else 0.0
            return self
        weight = weight / weight.sum()
        start, start_bias, share, pull, pull_bias, hold = self.w, self.bias, 0.0, np.zeros(len(self.w)), 0.0, np.zeros(len(self.w))
        if others is not None:  # a proximal step for them, of the same size as a step for rows
            share = others.share
            weight, pull, pull_bias = weight * (1 - share), share * others.gradient, share * others.bias
            hold = share * np.sqrt(others.squares * others.squares.max() * max(1.0, rows.size.mean()))
        curve = np.bincount(rows.index, np.repeat(weight, rows.size) * rows.value**2, len(self.w)) + 1e-6
        rate = 4.0 / (np.sqrt(curve * curve.max()) * max(1.0, np.sqrt(rows.size.mean())))
        w, bias, t = self.w, self.bias, 1.0
        ahead, ahead_bias = w, bias
        for _ in range(steps):
            error = weight * (sigmoid(rows.dot(ahead) + ahead_bias) - y)
            slope = np.bincount(rows.index, np.repeat(error, rows.size) * rows.value, len(w)) + pull
            step = ahead - rate * slope + rate * hold / 4 * start
            new = np.sign(step) * np.maximum(0, np.abs(step) - rate * self.penalty) / (1 + rate * hold / 4)
            new_bias = ahead_bias - 2.0 * (error.sum() + pull_bias + share / 4 * (ahead_bias - start_bias))
            t, last = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
            ahead, ahead_bias = new + (last - 1) / t * (new - w), new_bias + (last - 1) / t * (new_bias - bias)
            w, bias = new, new_bias
        self.w, self.bias = w, float(bias)
        return self


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass(frozen=True)
class Others:
    """Means over rows that are elsewhere, and their share of the weight of all rows."""

    gradient: np.ndarray
    bias: float
    squares: np.ndarray
    share: float


class Rows:
    """Sparse rows, one after another."""

    def __init__(self, index: np.ndarray, value: np.ndarray, size: np.ndarray):
        self.index, self.value, self.size = index, value, size
        self.at = np.cumsum(size) - size

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.add.reduceat(w[self.index] * self.value, self.at) if len(self.size) else np.empty(0)

    def take(self, rows: np.ndarray) -> Rows:
        size = self.size[rows]
        place = np.repeat(self.at[rows] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        return Rows(self.index[place], self.value[place], size)

    @staticmethod
    def of(index: list[bytes], value: list[bytes] | None = None) -> Rows:
        flat = np.frombuffer(b"".join(index), np.int32)
        values = np.ones(len(flat), np.float32) if value is None else np.frombuffer(b"".join(value), np.float32)
        return Rows(flat, values, np.fromiter((len(x) // 4 for x in index), np.int64, len(index)))


@dataclass(frozen=True)
class Model:
    text: np.ndarray
    text_bias: float
    meta: np.ndarray
    meta_bias: float
    text_scale: tuple[float, float]
    meta_scale: tuple[float, float]
    combined: tuple[float, float, float]


def calibrate(x: np.ndarray, y: np.ndarray, penalty: float = 1e-2) -> np.ndarray:
    """Weights and bias of a small logistic regression by Newton steps; targets are pulled from 0 and 1 (Platt)."""
    a = np.column_stack([x, np.ones(len(y))])
    if not len(y):
        return np.append(np.ones(x.shape[1]), 0.0)
    plus, minus = y.sum(), len(y) - y.sum()
    target = np.where(y == 1, (plus + 1) / (plus + 2), 1 / (minus + 2))
    w = np.zeros(a.shape[1])
    for _ in range(30):
        p = sigmoid(a @ w)
        hess = (a * (p * (1 - p) + 1e-9)[:, None]).T @ a + penalty * np.eye(len(w))
        w = w - np.linalg.solve(hess, a.T @ (p - target) + penalty * w)
    return w


@dataclass(frozen=True)
class Pseudo:
    """Sums over the pseudo-labelled documents: of the text view's features, and (metadata tuple, label) -> documents."""

    gradient: np.ndarray
    bias: float
    squares: np.ndarray
    n: int
    tuples: dict[tuple[bytes, int], int]


def _sure(p: np.ndarray) -> np.ndarray:
    return (p >= CONFIDENT) | (p <= 1 - CONFIDENT)


def pseudo_labelled(pool: DataFrame, text: Logistic, meta: Logistic) -> Pseudo:
    """Scores all of ``pool`` with both views, and sums up what each view's confident documents tell the other."""
    (tw, tb), (mw, mb) = (text.w, text.bias), (meta.w, meta.bias)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gradient, squares, bias, n = np.zeros(TEXT_SIZE), np.zeros(TEXT_SIZE), 0.0, 0
        tuples: Counter[tuple[bytes, int]] = Counter()
        for batch in batches:
            if not batch.num_rows:
                continue
            i, v, m = (c.to_pylist() for c in batch.columns)
            words, marks = Rows.of(i, v), Rows.of(m)
            p_text, p_meta = sigmoid(words.dot(tw) + tb), sigmoid(marks.dot(mw) + mb)
            at = np.flatnonzero(_sure(p_meta))
            rows, error = words.take(at), p_text[at] - (p_meta[at] > 0.5)
            gradient += np.bincount(rows.index, np.repeat(error, rows.size) * rows.value, TEXT_SIZE)
            squares += np.bincount(rows.index, rows.value.astype(float) ** 2, TEXT_SIZE)
            bias, n = bias + error.sum(), n + len(at)
            tuples.update((m[k], int(p_text[k] > 0.5)) for k in np.flatnonzero(_sure(p_text)).tolist())
        used = np.flatnonzero(squares)
        whole = lambda x: np.rint(x * UNIT).astype(np.int64).tolist()
        key = [b""] * (len(used) + 1) + [k for k, _ in tuples]
        place = [-1, *used.tolist(), *[y for _, y in tuples]]
        a = [*whole(np.array([bias])), *whole(gradient[used]), *tuples.values()]
        b = [n, *whole(squares[used]), *[0] * len(tuples)]
        yield pa.RecordBatch.from_arrays([pa.array(key, pa.binary()), pa.array(place, pa.int32()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["key", "place", "a", "b"])

    found = pool.select("i", "v", "m").mapInArrow(tidy(run), "key binary, place int, a long, b long").groupBy("key", "place").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).toArrow()
    gradient, squares, bias, n, tuples = np.zeros(TEXT_SIZE), np.zeros(TEXT_SIZE), 0.0, 0, {}
    for key, place, a, b in zip(*(found[c].to_pylist() for c in ("key", "place", "a", "b")), strict=True):
        if key:
            tuples[key, place] = a
        elif place < 0:
            bias, n = a / UNIT, b
        else:
            gradient[place], squares[place] = a / UNIT, b / UNIT
    return Pseudo(gradient, bias, squares, n, dict(sorted(tuples.items())))


def fit(text: Rows, meta: Rows, labels: np.ndarray, held: np.ndarray, pseudo: Callable[[Logistic, Logistic], Pseudo]) -> Model:
    """Co-trains both views on rows with ``labels`` 1 and 0, of which ``held`` calibrate only, and on what ``pseudo`` finds."""
    by_text, by_meta = Logistic(TEXT_SIZE, 4e-4), Logistic(META_SIZE, 1e-3)
    known = np.flatnonzero(~held)
    words, marks, y, n = text.take(known), meta.take(known), labels[known].astype(float), len(known)
    by_text.fit(words, y, np.ones(n), steps=240)  # labelled rows are fitted before others hold the weights back
    by_meta.fit(marks, y, np.ones(n))
    for _ in range(ROUNDS if n else 0):
        found = pseudo(by_text, by_meta)
        mass = 0.5 * min(n, found.n)
        others = Others(found.gradient / found.n, found.bias / found.n, found.squares / found.n, mass / (n + mass)) if found.n else None
        if others:
            by_text.fit(words, y, np.ones(n), others=others)
        count = np.fromiter(found.tuples.values(), float, len(found.tuples))
        extra, extra_y = Rows.of([m for m, _ in found.tuples]), np.array([label for _, label in found.tuples], float)
        all_rows = Rows(np.append(marks.index, extra.index), np.append(marks.value, extra.value), np.append(marks.size, extra.size))
        by_meta.fit(all_rows, np.append(y, extra_y), np.append(np.ones(n), count * 0.5 * min(1.0, n / max(1.0, count.sum()))))
    check = np.flatnonzero(held)
    y = labels[check].astype(float)
    logits = {"text": text.take(check).dot(by_text.w) + by_text.bias, "meta": meta.take(check).dot(by_meta.w) + by_meta.bias}
    scale = {v: calibrate(x[:, None], y) for v, x in logits.items()}
    both = calibrate(np.column_stack([scale[v][0] * logits[v] + scale[v][1] for v in ("text", "meta")]), y)
    return Model(by_text.w.astype(np.float32), by_text.bias, by_meta.w.astype(np.float32), by_meta.bias, tuple(scale["text"]), tuple(scale["meta"]), tuple(both))


COLUMNS = ["text", "lang", "source", "n_chars"]


def marks_of(labels: DataFrame) -> DataFrame:
    """_id and ``y`` (1 good: quality 1 and not toxic) of each labelled document."""
    good = F.when(F.col("quality").isNull(), F.lit(None)).otherwise(((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).cast("int"))
    return labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(good).alias("y")).where("y IS NOT NULL").withColumnRenamed("doc_id", "_id")


def labelled(docs: DataFrame, marks: DataFrame, labelled_rows: int) -> DataFrame:
    """Labelled rows to fit on, one for each id: doc_id, ``y``, ``held`` and the columns of the views.

    Of rows that share an id, the one whose text has the least hash counts, so the rows are bounded however often ids repeat.
    """
    share = min(1.0, labelled_rows / max(1, marks.count()))
    ids = F.broadcast(marks.where(F.pmod(F.xxhash64(F.lit("draw"), "_id"), F.lit(1 << 30)) < int((1 << 30) * share)))  # about labelled_rows rows
    one = F.min_by(F.struct(*COLUMNS), F.struct(F.xxhash64(*COLUMNS), F.length("text")))
    rows = docs.join(ids, F.col("doc_id") == F.col("_id")).groupBy("doc_id").agg(F.first("y").alias("y"), one.alias("views"))
    return rows.select("doc_id", "y", (F.pmod(F.xxhash64(F.lit("held"), "doc_id"), F.lit(4)) == 0).alias("held"), "views.*")


def _views(batch: pa.RecordBatch, hashes: WordHashes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    text, lang, source, n_chars = batch.columns[-4:]
    for raw, la, so, n in zip(text.cast(pa.binary()), lang.to_pylist(), source.to_pylist(), n_chars.to_pylist(), strict=True):
        raw = raw.as_py() or b""
        yield *text_view(raw, hashes), meta_view(so, la, n, raw)


def featured(rows: DataFrame) -> DataFrame:
    """doc_id, y, held and the features of both views as bytes."""

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            index, value, meta = [], [], []
            for i, v, m in _views(batch, hashes):
                index.append(i.tobytes())
                value.append(v.tobytes())
                meta.append(m.tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *[pa.array(x, pa.binary()) for x in (index, value, meta)]], ["doc_id", "y", "held", "i", "v", "m"])

    return rows.select("doc_id", "y", "held", "text", "lang", "source", F.col("n_chars").cast("long")).mapInArrow(tidy(features), FEATURES)


def unlabelled(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """Features of every document without a label. Ids of labels are broadcast up to BROADCAST_IDS; beyond, features are shuffled, not texts."""
    rows = docs.select("doc_id", F.lit(-1).alias("y"), F.lit(False).alias("held"), *COLUMNS)
    ids = marks.select("_id")
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids.hint("merge")
    return featured(rows).join(ids, F.col("doc_id") == F.col("_id"), "left_anti").select("i", "v", "m")


def bounded(found: DataFrame, labelled_bytes: int) -> DataFrame:
    """Featured rows of about ``labelled_bytes`` in all, drawn by a hash of the id; all of them where they have no more."""
    found = stored(found, "labelled")
    total = found.agg(F.sum(F.octet_length("i") + F.octet_length("v") + F.octet_length("m")).alias("n")).first()["n"] or 0
    return found if total <= labelled_bytes else found.where(F.pmod(F.xxhash64(F.lit("bytes"), "doc_id"), F.lit(1 << 30)) < int((1 << 30) * labelled_bytes / total))


def train(docs: DataFrame, labels: DataFrame, labelled_rows: int = 12_000, labelled_bytes: int = 256 << 20) -> Model:
    """A model from hash-drawn labelled rows and all unlabelled documents; without any labels, scores are 0.5.

    The driver gets ``labelled_rows`` and ``labelled_bytes`` of features at most (give or take what drawing by a hash does).
    """
    docs = docs.select(F.col("doc_id").cast("long"), *COLUMNS)
    marks = marks_of(labels)
    rows = bounded(featured(labelled(docs, marks, labelled_rows)), labelled_bytes)
    found = rows.toArrow().sort_by([("doc_id", "ascending"), ("i", "ascending")])
    discard(rows)
    index, value, meta = (found[c].to_pylist() for c in "ivm")
    held = found["held"].to_numpy().astype(bool)
    pool = stored(unlabelled(docs, marks), "unlabelled") if (~held).any() else None
    model = fit(Rows.of(index, value), Rows.of(meta), found["y"].to_numpy().astype(int), held, lambda text, by_meta: pseudo_labelled(pool, text, by_meta))
    if pool is not None:
        discard(pool)
    return model


def scored(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """doc_id, p_text, p_meta (calibrated views), score (combined), kept (``score >= threshold``) for every row.

    Null texts are empty; null metadata is a value of its own; repeated rows score alike; ids may be
    null; an empty table gives no rows; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            out = []
            for i, v, m in _views(batch, hashes):
                a = model.text_scale[0] * (float(model.text[i] @ v) + model.text_bias) + model.text_scale[1]
                b = model.meta_scale[0] * (float(model.meta[m].sum()) + model.meta_bias) + model.meta_scale[1]
                out.append((a, b, model.combined[0] * a + model.combined[1] * b + model.combined[2]))
            p = sigmoid(np.array(out, float).reshape(-1, 3))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(p[:, k]) for k in range(3)], pa.array(p[:, 2] >= threshold)], ["doc_id", "p_text", "p_meta", "score", "kept"])

    rows = docs.select(F.col("doc_id").cast("long"), "text", "lang", "source", F.col("n_chars").cast("long"))
    return rows.mapInArrow(tidy(run), "doc_id long, p_text double, p_meta double, score double, kept boolean")
