"""Toxicity by compression distance.

Two zstandard dictionaries are trained: one on ordinary text, one on toxic text. Labels hold for whole documents, of which few
words are toxic, so the toxic dictionary is trained on those words of toxic documents that hold a run of GRAM bytes
which toxic documents have significantly more often than ordinary ones. A window of WINDOW words is compressed once with the
ordinary dictionary and once with both; the bytes saved are the window's toxicity. In some SETTINGS, windows of ordinary documents in which the toxic dictionary saves bytes
nevertheless train additions to the ordinary one. A document's rates of saved bytes, and of windows that save two and three, or some of the three, go into a logistic score with no negative weights. Of the SETTINGS and the
FEATURES those count whose two-fold cross-fitted scores have the largest area under the curve on the sample itself. The threshold, the best F1 of those scores between two distinct ones, is moved to CUT.

Whole windows of toxic documents don't do as the toxic dictionary's samples: most of their words are ordinary, and the area under the curve falls to 0.59 to 0.69 (README).

The model is fitted on a sample of the labelled documents: of each class, the MOST_TOXIC and MOST_ORDINARY with the smallest hashes of their ids, in that
order as far as MOST_BYTES of text go. Of several texts of one id the one with the smallest hash counts. What zstandard can't train a dictionary on (a few short samples) is joined
and its last bytes, as many as the dictionary may have, are the dictionary.
Language, source and id are no inputs. Every text is scored whole.

Defined cases: a null or empty text has no windows and scores what a text without toxic windows does; an id labelled more than once is toxic if any
label says so; null labels and ids don't count; with fewer than LEAST documents of either class, and where no run of bytes is significant, nothing is known of toxic text and all scores are 0; rows of one id are scored each; an
empty table gives no rows; other columns pass through.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard as zs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brackwater.llm import labelled
from brackwater.llm.common import read, ship

HOLD_OUT, HELD = 3, 1
CUT = 0.7
MOST_TOXIC, MOST_ORDINARY = 2500, 6500
#: Bytes of ordinary and of toxic text that the driver holds at most.
MOST_BYTES = (24 << 20, 8 << 20)
WINDOW = 8
GRAM, GRAM_BITS, LEAST_Z = 5, 21, 4.0
#: Bytes of the ordinary and of the toxic dictionary, and rounds that add ordinary windows which looked toxic.
SETTINGS = ((32768, 2048, 0), (32768, 2048, 3), (65536, 8192, 0), (65536, 8192, 3))
#: Features that a curve is tried with: the rate of saved bytes, of windows that save two, and three.
FEATURES = ((0,), (1,), (2,), (0, 1), (0, 2), (1, 2), (0, 1, 2))
#: Documents of each class without which nothing is fitted.
LEAST = 4
#: Bytes that such a round adds.
HARD_BYTES = 12288
#: Windows of ordinary text that the dictionary is trained on at most, dealt over all documents of the sample.
ORDINARY_WINDOWS = 30_000
_DROPPED = b".,;:!?\"'()[]{}|#*$%&<>=-_/\\+0123456789"
_SPACED = bytes.maketrans(_DROPPED, b" " * len(_DROPPED))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().translate(_SPACED).split()


def windows_of(words: list[bytes]) -> list[bytes]:
    return [b" " + b" ".join(words[i : i + WINDOW]) + b" " for i in range(0, len(words), WINDOW)]


def _grams(text: bytes) -> np.ndarray:
    a = np.frombuffer(text, np.uint8).astype(np.uint64)
    n = len(a) - GRAM + 1
    if n < 1:
        return np.empty(0, np.int64)
    h = np.zeros(n, np.uint64)
    for k in range(GRAM):
        h = h * np.uint64(1099511628211) + a[k : n + k]
    h = (h ^ h >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(64 - GRAM_BITS)).astype(np.int64)


def _dictionary(samples: list[bytes], size: int, segment: int) -> bytes:
    """The content of a dictionary that zstandard trains; what it can't train on is its own dictionary."""
    try:
        trained = zs.train_dictionary(size, samples, k=segment, d=6).as_bytes()
        return trained[-(size - 500) :]  # without the tables of its header, which would make windows of one text differ by their entropy coding
    except zs.ZstdError:
        return b"".join(samples)[-size:]


def _compressor(content: bytes) -> zs.ZstdCompressor:
    params = zs.ZstdCompressionParameters(window_log=19, chain_log=18, hash_log=18, search_log=8, min_match=5, target_length=64, strategy=zs.STRATEGY_LAZY2, write_content_size=False, write_checksum=False, write_dict_id=False)
    return zs.ZstdCompressor(dict_data=zs.ZstdCompressionDict(content or b" ", dict_type=zs.DICT_TYPE_RAWCONTENT), compression_params=params)


def samples(docs: list[bytes], toxic: np.ndarray) -> tuple[list[bytes], list[bytes]]:
    """Windows of ordinary documents, and words of toxic ones with a run of bytes that these have more often. docs: words joined by blanks. They are split one
    document at a time, for the lists of all words would be many times as large."""
    df, n = np.zeros((2, 1 << GRAM_BITS), np.float32), [int((~toxic).sum()), int(toxic.sum())]
    for text, t in zip(docs, toxic, strict=True):
        df[int(t), np.unique(_grams(b" " + text + b" "))] += 1
    odds = lambda k: np.log((df[k] + 0.5) / (n[k] + 0.5 - df[k]))
    z = (odds(1) - odds(0)) / np.sqrt(1 / (df[1] + 0.5) + 1 / (df[0] + 0.5))
    found = []
    for text, t in zip(docs, toxic, strict=True):
        if t:
            has, at = z[_grams(b" " + text + b" ")] > LEAST_Z, 0
            for w in text.split():
                if has[at : max(at + 1, at + len(w) + 3 - GRAM)].any():
                    found.append(b" " + w + b" ")
                at += len(w) + 1
    step = max(1, math.ceil(sum(text.count(b" ") // WINDOW + 1 for text, t in zip(docs, toxic, strict=True) if not t) / ORDINARY_WINDOWS))
    return list(itertools.islice((x for text, t in zip(docs, toxic, strict=True) if not t for x in windows_of(text.split())), 0, None, step)), found


class Coders:
    def __init__(self, ordinary: bytes, toxic: bytes):
        self.contents = ordinary, toxic
        self._made = None

    def __getstate__(self):
        return self.contents

    def __setstate__(self, contents):
        self.contents, self._made = contents, None

    @classmethod
    def trained(cls, plain: list[bytes], found: list[bytes], ordinary_bytes: int, toxic_bytes: int, rounds: int) -> Coders:
        coders = cls(_dictionary(plain, ordinary_bytes, 256), _dictionary([b"".join(found[i : i + 6]) for i in range(0, len(found), 6)], toxic_bytes, 64))
        for _ in range(rounds):
            hard = [x for x, n in zip(plain, coders.saved(plain), strict=True) if n >= 2]
            if len(hard) < 100:
                break
            ordinary, toxic = coders.contents
            coders = cls(_dictionary(hard, HARD_BYTES, 128) + ordinary, toxic)
        return coders

    def saved(self, windows: list[bytes]) -> list[int]:
        """Bytes that the toxic dictionary saves in each window."""
        if self._made is None:
            ordinary, toxic = self.contents
            self._made = _compressor(ordinary).compress, _compressor(toxic + ordinary).compress
        one, both = self._made
        return [len(one(x)) - len(both(x)) for x in windows]

    def features(self, words: list[bytes]) -> list[float]:
        saved = np.array(self.saved(windows_of(words)), int)
        n = len(saved)
        return [float(saved.sum()) / (n + 3), math.log(0.005 + float((saved >= 2).sum()) / (n + 2)), math.log(0.005 + float((saved >= 3).sum()) / (n + 2))]


class Model:
    """The coders and a logistic curve over some of their features. Without a toxic dictionary nothing is toxic: all scores are 0."""

    def __init__(self, docs: list[bytes], toxic: np.ndarray, weight: np.ndarray):
        fold = np.arange(len(docs)) % 2 == 0
        crossed = np.empty((len(SETTINGS), len(docs), 3))
        for part in (fold, ~fold):
            plain, found = samples([d for d, p in zip(docs, part, strict=True) if p], toxic[part])
            for x, setting in zip(crossed, SETTINGS, strict=True):
                coders = Coders.trained(plain, found, *setting)
                x[~part] = [coders.features(d.split()) for d, p in zip(docs, part, strict=True) if not p]
        tried = [(labelled.area(self._fit(x, toxic, weight, f), toxic), k, f) for k, x in enumerate(crossed) for f in FEATURES]
        _, k, self.features = max(tried, key=lambda t: t[0])
        self.setting = SETTINGS[k]
        z = self._fit(crossed[k], toxic, weight, self.features)
        self.shift = math.log(CUT / (1 - CUT)) - labelled.best_cut(z, toxic, weight)
        plain, found = samples(docs, toxic)
        self.coders = Coders.trained(plain, found, *self.setting) if found and self.w[:3].any() else None

    def _fit(self, x: np.ndarray, toxic: np.ndarray, weight: np.ndarray, features: tuple[int, ...]) -> np.ndarray:
        """Sets mean, scale and w; the curve's logits. Of the named features those weigh that point to toxic text; what would weigh less than nothing is left out, the worst first."""
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-9
        a, y, used = np.column_stack([(x - self.mean) / self.scale, np.ones(len(x))]), toxic.astype(float), list(features)
        while True:
            at = [*used, 3]
            w, ridge = np.zeros(len(at)), np.append(np.ones(len(used)), 1e-6)
            for _ in range(40):  # Newton's steps, with a small ridge
                p = 1 / (1 + np.exp(-np.clip(a[:, at] @ w, -30, 30)))
                h = (a[:, at] * (weight * p * (1 - p))[:, None]).T @ a[:, at] + np.diag(ridge)
                w += np.linalg.solve(h, a[:, at].T @ (weight * (y - p)) - np.append(np.ones(len(used)), 0) * w)
            if not used or w[:-1].min() >= 0:
                break
            del used[int(w[:-1].argmin())]
        self.w = np.zeros(4)
        self.w[at] = w
        return a @ self.w

    def score(self, text: bytes | None) -> float:
        if self.coders is None:
            return 0.0
        x = (np.array(self.coders.features(words_of(text))) - self.mean) / self.scale
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, float(x @ self.w[:3] + self.w[3] + self.shift)))))


def held_out(key: str) -> Column:
    return labelled.held_out(key, HOLD_OUT, HELD)


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> Model | None:
    """Labels of rows that are held out are not looked at."""
    found = labelled.sample(docs, labels, "toxic", held_out("id"), (MOST_ORDINARY, MOST_TOXIC), MOST_BYTES, key, text)
    if min(found.mark.sum(), (~found.mark).sum()) < LEAST:
        return None
    return Model([b" ".join(words_of(t)) for t in found.texts], found.mark, found.weight)


def scored(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """row (docs' columns as a struct) and score, between 0 and 1."""
    ship(docs.sparkSession)
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(text).cast("binary").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries and a few numbers

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [shared.value.score(x.as_py()) if shared.value else 0.0 for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["row", "score"])

    return rows.mapInArrow(add, T.StructType([T.StructField("row", rows.schema["row"].dataType), T.StructField("score", T.DoubleType())]))


def toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """row, score and predicted (1 if the score reaches CUT) of each row of docs."""
    return scored(docs, fit(docs, labels, key, text), text).withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity(docs, read(spark, sf_dir, "labels")).select("row.doc_id", held_out("row.doc_id").alias("held_out"), "score", "predicted")
