"""Quality by nearest-neighbour voting in a latent-semantic space.

A document's features are its words, its words' shapes (`a.` for a word with a full stop, `A!` for a shouted one) and marks of the whole: how long it is, and which shares of its five-word windows, lines and words come again.
Each kind is hashed into its own columns, counted as 1 + log(uses), weighed by the inverse document frequency over all documents, and scaled to unit length; KINDS says what a kind weighs. A truncated singular value decomposition of a bounded sample of labelled
documents gives the latent space. The sample's vectors and labels are broadcast (LABELLED rows of RANK numbers, and a projection of COLUMNS by RANK), and every document is projected
and multiplied with all of them, in exact blocks. Its NEIGHBOURS most similar ones vote with their similarity to a power, times their class weight; all that tie with the last of them vote too.

Of some SETTINGS (neighbours, power) that one is taken that orders the sample best when each row is left out of its own vote; the cut between the classes, the best F1 of the label 0 there, is moved to CUT.

Defined cases: a null or empty text has the marks of an empty document, and is scored by them; an id labelled more than once has its largest label; null labels and ids don't count; if the labelled rows are all of one
class that class is everybody's score, and without any all scores are 1; rows of one id are scored each; an empty table gives no rows; very long texts are read whole; other columns
pass through in `row`, whatever their names. Language, source, id and labels are no inputs of a score.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brackwater.llm import labelled
from brackwater.llm.common import read, ship

HOLD_OUT, HELD = 5, 0
CUT = 0.3
#: Labelled documents, and bytes of their text, that the driver holds at most, of the labels 0 and 1.
LABELLED, LABELLED_BYTES = (1200, 2400), (8 << 20, 16 << 20)
RANK = 64
#: Columns and weight of words, shapes and marks.
KINDS = ((6144, 0.5), (1536, 1.0), (512, 1.0))
COLUMNS = sum(n for n, _ in KINDS)
#: Neighbours and power.
SETTINGS = ((9, 4.0), (9, 16.0), (25, 4.0), (25, 16.0))
#: Documents whose products are made at once.
BLOCK = 256
CACHED = 300_000
_RUN = re.compile(rb"(.)\1+", re.S)
_SHAPE = bytes(65 if 65 <= b <= 90 else 97 if 97 <= b <= 122 or b >= 128 else 48 if 48 <= b <= 57 else b for b in range(256))


def shape(word: bytes) -> bytes:
    """Each run of capitals, other letters or digits as A, a or 0, and each run of one other character as that."""
    return _RUN.sub(rb"\1", word.translate(_SHAPE))[:12]


class Words(dict):
    """The columns of a word and, in the lower 16 bits, of its shape."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED:
            self.clear()
        column = zlib.crc32(word.lower().strip(b".,;:!?\"'()[]|#*$%&")) % KINDS[0][0]
        self[word] = both = column << 16 | KINDS[0][0] + zlib.crc32(shape(word)) % KINDS[1][0]
        return both


def _again(values: np.ndarray) -> int:
    """In sixteenths, how many of the values are found twice or more; any at all counts as 1."""
    if not len(values):
        return 0
    values = np.sort(values)
    same = np.concatenate([[False], values[1:] == values[:-1], [False]])
    twice = int((same[1:] | same[:-1]).sum())
    return max(int(twice > 0), 16 * twice // len(values))


def marks(text: bytes, word_columns: np.ndarray) -> list[int]:
    """Columns of the marks; they spread over neighbouring values, so that similar documents share some."""
    n = len(word_columns)
    lines = np.array([zlib.crc32(x) for x in text.split(b"\n") if x.strip()], np.int64)
    window = np.zeros(max(0, n - 4), np.uint64)
    for k in range(5 if n > 4 else 0):
        window = window * np.uint64(1_000_003) + word_columns[k : n - 4 + k].astype(np.uint64)
    seen = {"words": int(2 * math.log2(n + 1)), "windows": _again(window), "lines": _again(lines), "letters": 8 * (len(text) - n) // max(1, n)}
    seen["distinct"] = 16 * int(np.count_nonzero(np.bincount(word_columns))) // max(1, n)
    return [_mark(kind, value + d) for kind, value in seen.items() for d in (-1, 0, 1)]


@lru_cache(maxsize=4096)
def _mark(kind: str, value: int) -> int:
    return KINDS[0][0] + KINDS[1][0] + zlib.crc32(f"{kind} {value}".encode()) % KINDS[2][0]


def counted(text: bytes | None, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """The columns that a document has, in ascending order, and its uses of them."""
    text = text or b""
    found = text.split()
    both = np.fromiter(map(words.__getitem__, found), np.int64, len(found))
    columns = both >> 16
    uses = np.bincount(np.concatenate([columns, both & 0xFFFF, np.array(marks(text, columns), np.int64)]), minlength=COLUMNS)
    at = np.flatnonzero(uses)
    return at, uses[at]


def document_frequencies(docs: DataFrame, text: str = "text") -> tuple[int, np.ndarray]:
    """The number of documents, and how many of them have each column. COLUMNS numbers are gathered."""
    ship(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, words = np.zeros(COLUMNS + 1, np.int64), Words()
        for batch in batches:
            for x in batch.column(0):
                df[counted(x.as_py(), words)[0]] += 1
                df[COLUMNS] += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], names=["column", "n"])

    rows = docs.select(F.col(text).cast("binary").alias("text")).mapInArrow(count, "column long, n long").groupBy("column").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(COLUMNS + 1, np.int64)
    for r in rows:
        df[r["column"]] = r["n"]
    return int(df[COLUMNS]), df[:COLUMNS]


class Model:
    """The projection, the labelled vectors and their votes."""

    def __init__(self, found: labelled.Sample, n_docs: int, df: np.ndarray):
        self.idf = np.log((1 + n_docs) / (1 + df)) + 1
        self.only = None
        if len(found.mark) == 0 or found.mark.all() or not found.mark.any():
            self.only = float(found.mark.all())
            return
        words = Words()
        weighed = [self.weigh(*counted(t, words)) for t in found.texts]
        x = np.zeros((len(weighed), COLUMNS), np.float32)
        for row, (at, w) in zip(x, weighed, strict=True):
            row[at] = w
        rng, k = np.random.default_rng(0), min(RANK, *x.shape)
        basis = np.linalg.qr(x @ rng.normal(size=(COLUMNS, min(k + 16, len(x)))).astype(np.float32))[0]
        for _ in range(3):  # subspace iterations
            basis = np.linalg.qr(x @ (x.T @ basis))[0]
        self.projection = np.linalg.svd(basis.T @ x, full_matrices=False)[2][:k].T.astype(float)
        del x
        self.vectors = self.project(weighed)
        self.mark = found.mark.astype(float)
        self.weight = found.weight
        votes = self.left_out()
        areas = [labelled.area(v, found.mark) for v in votes]
        self.setting = SETTINGS[int(np.argmax(areas))]
        cut = -labelled.best_cut(-_logit(votes[int(np.argmax(areas))]), ~found.mark, found.weight)
        self.shift = math.log(CUT / (1 - CUT)) - cut

    def left_out(self) -> list[np.ndarray]:
        """The votes on the labelled rows by each of SETTINGS, each row left out of its own vote. The driver holds the products of BLOCK rows at once."""
        parts = []
        for at in range(0, len(self.vectors), BLOCK):
            alike = self.alike(self.vectors[at : at + BLOCK])
            alike[np.arange(len(alike)), at + np.arange(len(alike))] = -np.inf
            parts.append([self.vote(alike, *s) for s in SETTINGS])
        return [np.concatenate(v) for v in zip(*parts, strict=True)]

    def weigh(self, at: np.ndarray, uses: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w, low = (1 + np.log(uses)) * self.idf[at], 0
        for n, share in KINDS:
            a, b = np.searchsorted(at, (low, low + n))
            w[a:b] *= share / max(1e-12, float(np.sqrt((w[a:b] ** 2).sum())))
            low += n
        return at, w

    def project(self, weighed: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Unit vectors in the latent space. Each is summed apart, so that it doesn't hang on its neighbours in a batch."""
        out = np.stack([w @ self.projection[at] for at, w in weighed])
        return out / np.maximum(1e-12, np.sqrt((out**2).sum(axis=1)))[:, None]

    def alike(self, vectors: np.ndarray) -> np.ndarray:
        """Cosines with all labelled vectors, to nine places."""
        return np.round(vectors @ self.vectors.T, 9)

    def vote(self, alike: np.ndarray, neighbours: int, power: float) -> np.ndarray:
        k = min(neighbours, alike.shape[1])
        last = np.partition(alike, alike.shape[1] - k, axis=1)[:, alike.shape[1] - k]
        w = np.where(alike >= last[:, None], np.maximum(alike, 1e-6) ** power * self.weight, 0)
        return (w @ self.mark) / w.sum(axis=1)

    def scores(self, texts: list[bytes | None], words: Words) -> np.ndarray:
        if self.only is not None:
            return np.full(len(texts), self.only)
        z = _logit(self.vote(self.alike(self.project([self.weigh(*counted(t, words)) for t in texts])), *self.setting))
        return 1 / (1 + np.exp(-(z + self.shift)))


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def held_out(key: str) -> Column:
    return labelled.held_out(key, HOLD_OUT, HELD)


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> Model:
    """Labels of rows that are held out are not looked at."""
    found = labelled.sample(docs, labels, "quality", held_out("id"), LABELLED, LABELLED_BYTES, key, text)
    return Model(found, *document_frequencies(docs, text))


def scored(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """row (docs' columns as a struct) and score, between 0 and 1."""
    ship(docs.sparkSession)
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(text).cast("binary").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by LABELLED, COLUMNS and RANK: 6 MB

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(at, BLOCK)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.scores(batch.column(1).to_pylist(), words), pa.float64())], names=["row", "score"])

    return rows.mapInArrow(add, T.StructType([T.StructField("row", rows.schema["row"].dataType), T.StructField("score", T.DoubleType())]))


def quality(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """row, score and predicted (1 if the score reaches CUT) of each row of docs."""
    return scored(docs, fit(docs, labels, key, text), text).withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return quality(docs, read(spark, sf_dir, "labels")).select("row.doc_id", held_out("row.doc_id").alias("held_out"), "score", "predicted")
