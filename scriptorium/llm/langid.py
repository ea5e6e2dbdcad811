"""Language identification by mixture inference over n-gram likelihoods.

Training counts byte trigrams of words (letters and non-ASCII bytes, a space on either side, A-Z
lower-cased) for each language over all training rows. A word's likelihood in a language is the
product of its trigrams' smoothed probabilities. Expectation-maximisation estimates a document's language
proportions, with words as the units that belong to one language each. Languages ordered by proportion
give nested sets; the set is chosen by likelihood less half the logarithm of the number of words
for each language after the first, and the prediction is its largest language.

A :class:`Model` has COUNTS numbers at most and goes through the driver: with more languages each has fewer buckets for its trigrams. Up to OWN languages
:func:`fitted` gives one. With more, however many, it gives a :class:`StoredModel`: counts are summed and stored by executors, a row a language, and a task
lays them out in a file that it maps into memory, so every language keeps counts of its own and can be predicted, and memory is bounded.
:func:`train` alone pools languages beyond ``own`` by hash in ``pools`` columns, each named by the most frequent of its languages.

A document's mixture is among all languages. With more than TOGETHER of them documents are taken one by one.
"""

from __future__ import annotations

import re
import tempfile
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import stored, tidy, words_letters
from .token_output import slices

#: Most buckets for trigram counts of a language, fewest, and numbers in a model: its languages times its buckets.
BUCKETS, FEWEST, COUNTS = 1 << 16, 1 << 10, 1 << 22
#: Languages of a model that goes through the driver, pools of :func:`train`, and languages up to which many documents' mixtures are found together.
OWN, POOLS, TOGETHER = 1_000, 24, 32
#: Likelihoods of a document that are in memory; more are in a file.
CELLS = 1 << 24
SMOOTHING = 0.1
ITERATIONS = 10
#: Words whose likelihoods a task remembers, bytes of text taken at once for four languages, and for any number of them.
MOST_WORDS, SLICE_BYTES, MOST_BYTES = 200_000, 4_000_000, 1_000_000
ASCII_LETTER = re.compile(rb"[A-Za-z]").search


def has_letter(text: bytes) -> bool:
    """Whether a text has a letter: a character of Unicode's categories L. Roman and other numerals are none."""
    return bool(ASCII_LETTER(text)) or any(map(str.isalpha, text.decode()))


@dataclass(frozen=True)
class Model:
    languages: list[str]
    log_p: np.ndarray  # (buckets, languages), float32

    def __len__(self) -> int:
        return len(self.languages)

    def load(self) -> Model:
        return self


def _floats(shape: tuple[int, int]) -> np.ndarray:
    """Numbers in memory, or above CELLS in a file without a name, which goes with the array."""
    if shape[0] * shape[1] <= CELLS:
        return np.empty(shape, np.float32)
    with tempfile.TemporaryFile() as file:
        return np.memmap(file, np.float32, "w+", shape=shape)


@dataclass(frozen=True)
class StoredModel:
    """Counts (lang, buckets, counts) of all languages as Parquet under ``path``, which executors share."""

    path: str
    size: int
    buckets: int

    def __len__(self) -> int:
        return self.size

    def load(self) -> Model:
        """The model, read by a task. Languages are in the order of their names, as in any other model."""
        from pyarrow import dataset, fs

        store, path = fs.FileSystem.from_uri(self.path.replace("s3a://", "s3://", 1)) if ":/" in self.path else (fs.LocalFileSystem(), self.path)
        table = dataset.dataset(path, format="parquet", filesystem=store)
        languages = sorted(lang for batch in table.to_batches(columns=["lang"]) for lang in batch.column(0).to_pylist())
        place = {lang: i for i, lang in enumerate(languages)}
        log_p = _floats((self.buckets, len(languages)))
        for batch in table.to_batches(batch_size=256, batch_readahead=1, fragment_readahead=1):
            for lang, buckets, counts in zip(batch["lang"].to_pylist(), batch["buckets"], batch["counts"], strict=True):
                counts = counts.values.to_numpy()
                whole = counts.sum() + SMOOTHING * self.buckets
                log_p[:, place[lang]] = np.log(SMOOTHING / whole)
                log_p[buckets.values.to_numpy(), place[lang]] = np.log((counts + SMOOTHING) / whole)
        return Model(languages, log_p)


def buckets_for(languages: int) -> int:
    """Buckets (a power of two) for each of so many languages."""
    return max(FEWEST, min(BUCKETS, 1 << ((COUNTS // max(1, languages)).bit_length() - 1)))


def trigrams(words: list[bytes], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(trigram buckets of all words in order, number of trigrams of each word: its bytes)."""
    joined = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8).astype(np.uint32)
    code = (joined[:-2] << np.uint32(16)) | (joined[1:-1] << np.uint32(8)) | joined[2:]
    inside = joined[1:-1] != 32
    bucket = (code[inside] * np.uint32(2654435761)) >> np.uint32(33 - buckets.bit_length())
    return bucket.astype(np.int64), np.fromiter(map(len, words), np.int64, len(words))


def columns_of(rows: DataFrame, own: int, pools: int) -> tuple[DataFrame, list[str]]:
    """``rows`` (lang, text) with the column that each language counts in, and the columns' names."""
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n"))
    frequent = [r["lang"] for r in sizes.orderBy(F.desc("n"), "lang").limit(own).collect()]  # a bounded list
    names = sorted(frequent)
    table = rows.sparkSession.createDataFrame(list(zip(names, range(len(names)), strict=True)), "lang string, at int")
    if len(frequent) < own:
        return rows.join(F.broadcast(table), "lang").select("at", "text"), names
    pool = F.pmod(F.xxhash64("lang"), F.lit(pools)).cast("int")
    rare = sizes.join(F.broadcast(table), "lang", "left_anti").groupBy(pool.alias("pool")).agg(F.min_by("lang", F.struct(-F.col("n"), "lang")).alias("lang"))
    pooled = sorted((r["pool"], r["lang"]) for r in rare.collect())  # a row for each pool
    place = {p: len(names) + i for i, (p, _) in enumerate(pooled)}
    of_pool = F.get(F.array(*[F.lit(place.get(p)).cast("int") for p in range(pools)]), pool)
    return rows.join(F.broadcast(table), "lang", "left").select(F.coalesce("at", of_pool).alias("at"), "text"), names + [lang for _, lang in pooled]


def _rows(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """(lang, text) of the rows that have both."""
    return docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))


def _counted(placed: DataFrame, buckets: int) -> DataFrame:
    """(at, bucket, n): trigrams of the texts by bucket, for each value of a first column ``at`` of any type.

    A task holds a bounded number of words and gives sums of them, so many languages don't fill its memory.
    """
    kind = placed.schema["at"].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[int | str, Counter] = {}
        held = 0

        def flush(at_type: pa.DataType) -> Iterator[pa.RecordBatch]:
            for at, seen in words.items():
                bucket, size = trigrams(list(seen), buckets) if seen else (np.zeros(1, np.int64), [1])
                weight = np.repeat(np.fromiter(seen.values(), np.int64, len(seen)), size) if seen else np.zeros(1, np.int64)
                total = np.bincount(bucket, weights=weight, minlength=buckets).astype(np.int64)
                bucket = np.flatnonzero(total) if seen else bucket  # a language without words is a language
                yield pa.RecordBatch.from_arrays([pa.array([at], at_type).take(pa.array(np.zeros(len(bucket), np.int64))), pa.array(bucket, pa.int32()), pa.array(total[bucket], pa.int64())], ["at", "bucket", "n"])
            words.clear()

        at_type = pa.string()
        for batch in batches:
            at_type = batch.column(0).type
            for at, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                seen = words.setdefault(at, Counter())
                held -= len(seen)
                seen.update(words_letters(text.as_py()))
                held += len(seen)
                if held + len(words) > 2 * MOST_WORDS:
                    yield from flush(at_type)
                    held = 0
        yield from flush(at_type)

    return placed.mapInArrow(tidy(count), f"at {kind}, bucket int, n long").groupBy("at", "bucket").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", own: int = OWN, pools: int = POOLS) -> Model:
    """A model from all rows with a language and a text, however many languages there are; beyond ``own`` they are pooled.

    Texts are counted where they are, and counts are summed by language and bucket; the driver gets the sums, COUNTS at most.
    """
    rows = _rows(docs, text_col, lang_col)
    placed, languages = columns_of(rows, own, pools)
    buckets = buckets_for(len(languages))

    counts = _counted(placed, buckets).toArrow()
    table = np.zeros((buckets, len(languages)))
    table[counts["bucket"].to_numpy(), counts["at"].to_numpy()] = counts["n"].to_numpy()
    table += SMOOTHING
    table /= table.sum(axis=0)
    return Model(languages, np.log(table).astype(np.float32))


def fitted(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", own: int = OWN) -> Model | StoredModel:
    """A model in which every language of the rows with a text has counts of its own, however many languages there are."""
    rows = _rows(docs, text_col, lang_col)
    languages = rows.select("lang").distinct().count()
    if languages <= own:
        return train(docs, text_col, lang_col, own)
    buckets = buckets_for(languages)
    each = _counted(rows.select(F.col("lang").alias("at"), "text"), buckets).groupBy(F.col("at").alias("lang")).agg(F.collect_list(F.struct("bucket", "n")).alias("c"))
    table = stored(each.select("lang", F.col("c.bucket").alias("buckets"), F.col("c.n").alias("counts")), "languages")
    return StoredModel(table.inputFiles()[0].rpartition("/")[0], languages, buckets)


class WordLikelihoods(dict):
    """word -> row of ``rows``: its likelihood in each language, over the largest of them."""

    def __init__(self, model: Model):
        super().__init__()
        self.model, self.new = model, []
        self.rows = np.empty((0, len(model.languages)), np.float32)

    def __missing__(self, word: bytes) -> int:
        value = self[word] = len(self)
        self.new.append(word)
        return value

    def of(self, docs: list[list[bytes]]) -> np.ndarray:
        """Likelihoods of all words of the documents, in order."""
        if len(self) > MOST_WORDS:
            self.clear()
            self.rows = self.rows[:0]
        get = self.__getitem__
        index = np.fromiter((i for words in docs for i in map(get, words)), np.int32)
        if self.new:
            bucket, size = trigrams(self.new, len(self.model.log_p))
            log_p = np.add.reduceat(self.model.log_p[bucket], np.cumsum(size) - size)
            self.rows = np.concatenate([self.rows, np.exp(log_p - log_p.max(axis=1, keepdims=True))])
            self.new = []
        return np.maximum(self.rows[index], np.float32(1e-30))


def _maximise(likelihood: np.ndarray, size: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """EM from ``share`` (documents, languages): (shares, log-likelihoods), documents' words one after another."""
    at = np.cumsum(size) - size
    for _ in range(ITERATIONS):
        weight = likelihood * np.repeat(share, size, axis=0)
        weight /= weight.sum(axis=1, keepdims=True)
        share = (np.add.reduceat(weight, at) / size[:, None]).astype(np.float32)
    total = (likelihood * np.repeat(share, size, axis=0)).sum(axis=1)
    return share, np.add.reduceat(np.log(np.maximum(total, np.float32(1e-35))), at, dtype=np.float64)


def mixtures(likelihood: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Proportions (documents, languages) of the chosen language sets; every document has a word."""
    n, langs = len(size), likelihood.shape[1]
    share, _ = _maximise(likelihood, size, np.full((n, langs), 1 / langs, np.float32))
    order = np.argsort(-share, axis=1, kind="stable")
    best = np.zeros((n, langs), np.float32)
    best[np.arange(n), order[:, 0]] = 1
    alone = np.log(np.take_along_axis(likelihood, np.repeat(order[:, :1], size, axis=0), axis=1)[:, 0])
    score = np.add.reduceat(alone, np.cumsum(size) - size, dtype=np.float64)
    open_ = np.arange(n)
    for k in range(2, langs + 1):
        # A set one larger can't be better if its last language has next to no share.
        open_ = open_[share[open_, order[open_, k - 1]] * size[open_] > 0.25]
        if not len(open_):
            break
        mask = np.zeros((len(open_), langs), np.float32)
        np.put_along_axis(mask, order[open_, :k], 1 / k, axis=1)
        chosen = np.zeros(n, bool)
        chosen[open_] = True
        part, fit = _maximise(likelihood[np.repeat(chosen, size)], size[open_], mask)
        fit -= 0.5 * (k - 1) * np.log(size[open_])
        better = fit > score[open_]
        score[open_[better]], best[open_[better]] = fit[better], part[better]
    return best


def mixture_of_all(model: Model, words: list[bytes]) -> np.ndarray:
    """One document's proportions of the chosen language set, as :func:`mixtures` has them, for any number of languages.

    Distinct words are taken in pieces, and their likelihoods are in a file if they are many, so memory is bounded. No set is larger than those that can
    be better: likelihoods are 1 at most, so a set's score is at most what it loses for its size.
    """
    seen = Counter(words)
    distinct, times, n = list(seen), np.fromiter(seen.values(), np.float32, len(seen)), len(words)
    step = max(1, COUNTS // 8 // len(model))
    likelihood = _floats((len(distinct), len(model)))
    for at in range(0, len(distinct), step):
        bucket, size = trigrams(distinct[at : at + step], len(model.log_p))
        part = np.add.reduceat(model.log_p[bucket], np.cumsum(size) - size)
        likelihood[at : at + step] = np.maximum(np.exp(part - part.max(axis=1, keepdims=True)), np.float32(1e-30))

    def maximise(columns, count: int) -> tuple[np.ndarray, float]:
        share = np.full(count, 1 / count, np.float32)
        wide = max(1, COUNTS // count)
        pieces = [slice(at, at + wide) for at in range(0, len(distinct), wide)]
        own = likelihood[:, columns] if len(pieces) == 1 else None
        of = lambda piece: own if own is not None else likelihood[piece, columns]
        for _ in range(ITERATIONS):
            new = np.zeros(count)
            for piece in pieces:
                part = of(piece)
                new += (times[piece] / (part @ share)) @ part
            share = (share * new / n).astype(np.float32)
        return share, float(sum(times[piece].astype(np.float64) @ np.log(np.maximum(of(piece) @ share, np.float32(1e-35))) for piece in pieces))

    share, _ = maximise(slice(None), len(model))
    order = np.argsort(-share, kind="stable")
    chosen, best = order[:1], np.ones(1, np.float32)
    score = float(times.astype(np.float64) @ np.log(likelihood[:, order[0]]))
    for k in range(2, len(model) + 1):
        loss = 0.5 * (k - 1) * np.log(n)
        if share[order[k - 1]] * n <= 0.25 or 1e-5 * n - loss <= score:
            break
        part, fit = maximise(order[:k], k)
        if fit - loss > score:
            chosen, best, score = order[:k], part, fit - loss
    out = np.zeros(len(model), np.float32)
    out[chosen] = best
    return out


def predict(docs: DataFrame, model: Model | StoredModel, keep: list[str] = (), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The columns ``keep`` and lang_pred, score and languages (array of lang and share, largest first).

    lang_pred is the largest language of the mixture, score its share. Texts that are null or have no letter,
    and all texts where the model has no language, get ``und``, score 0 and no languages. Rows are
    independent: ids may be null or repeat, an empty table gives no rows, and other columns are not read. A text goes to a worker
    once, kept or not, and rows come back a slice at a time, so a worker holds one Arrow batch and one slice's words.
    """
    keep = list(keep)
    text_at = keep.index(text_col) if text_col in keep else len(keep)
    fields = [docs.schema[c] for c in keep]
    given, n_langs = model, len(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = given.load()
        likelihoods = WordLikelihoods(model)
        for batch in batches:
            for at, length in slices(batch.column(text_at), max(1, min(MOST_BYTES, SLICE_BYTES * 4 // max(4, n_langs)))):
                rows = batch.slice(at, length)
                pred, score, mixes = [], [], []
                raw = [t.as_py() or b"" for t in rows.column(text_at).cast(pa.binary())]
                words = [words_letters(t) if n_langs and has_letter(t) else [] for t in raw]
                size = np.fromiter(map(len, words), np.int64, len(words))
                share = np.zeros((len(words), n_langs), np.float32)
                if n_langs > TOGETHER:
                    for i in np.flatnonzero(size).tolist():
                        share[i] = mixture_of_all(model, words[i])
                elif size.any():
                    share[size > 0] = mixtures(likelihoods.of(words), size[size > 0])
                for row, n in zip(share, size, strict=True):
                    order = np.argsort(-row, kind="stable")[: int((row > 0).sum())] if n else []
                    mixes.append([{"lang": model.languages[i], "share": float(row[i])} for i in order])
                    pred.append(mixes[-1][0]["lang"] if mixes[-1] else "und")
                    score.append(min(1.0, mixes[-1][0]["share"]) if mixes[-1] else 0.0)
                kind = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))
                yield pa.RecordBatch.from_arrays([*rows.columns[: len(keep)], pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(mixes, kind)], [*keep, "lang_pred", "score", "languages"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "lang_pred string, score double, languages array<struct<lang:string,share:double>>"])
    return docs.select(*keep, *([F.col(text_col).alias("_text")] if text_at == len(keep) else [])).mapInArrow(tidy(run), schema)


def held_out(id_col: str = "doc_id"):
    """Whether a row is kept from training: CRC-32 of the id as text leaves 1 by 3. Null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1


def identified(docs: DataFrame, min_score: float = 0.5) -> DataFrame:
    """``docs`` whose text has a language with ``min_score`` of its words, by a model of the rows not held out.

    Each row is judged by its own text, so repeated rows stay or go together and ids may repeat; a row without id has no remainder, so it isn't
    learned from, but judged. Null texts and texts without a letter go. Where no row has a language nothing can be told and all rows
    go; an empty table stays empty. Columns may have any names.
    """
    model = fitted(docs.where(~held_out()))
    found = predict(docs, model, [*docs.columns])
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= min_score)).select(*docs.columns)
