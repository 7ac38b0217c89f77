"""Language-model scores from a lattice of subwords.

A word's lattice has as arcs the pieces of an existing vocabulary, apart for pieces that start a word and pieces that go on in one, bytes for what no piece
covers, a stop that ends the word, and the word as a whole if training has it. The word's probability is the sum over all segmentations, by forward recursion
in log space. Vocabularies here come with the order of a BPE, not with a unigram's probabilities, so that order is the prior of the pieces, and their weights
are their expected uses, over all segmentations, in all distinct training words (ROUNDS rounds). A whole word's arc weighs its count less a discount, over all
tokens; what the discounts free is the weight of the spellings (absolute discounting, d = n1 / (n1 + 2 n2)). That model of the corpus is in turn what a
language's discounted counts fall back on. The languages of the training documents group the counts; a document's own language is no input of its score.
MOST_LANGUAGES have models of their own, all others together have one.

Words come again in a document more often than in the corpus: after i words of a document, a word that it has had k times and that has probability p has (k + FIRMNESS * p) /
(i + FIRMNESS). Multiplied over the document that depends on its words' counts alone. A document's probability is the sum over languages of the language's share, that product, and
the end's probability.

Texts are coded against the words of their chunk, a bounded stretch of one task's documents, so that a word is counted, joined and
spelled once for each chunk or once in all, never for each of its uses. What is gathered is a table of all distinct words.

Defined cases: a null text is empty and has only its end; a null id counts as the text ""; rows of one id are scored each (and learnt from each);
a null language is a language; without training rows the vocabulary's own order is the model; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard as zs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brackwater.llm.common import read, ship, stored

HOLD_OUT, HELD = 7, 2
#: A chunk ends when it has so many tokens or distinct words.
CHUNK_TOKENS, CHUNK_WORDS = 6_000_000, 600_000
#: What the prior of the pieces weighs, in uses.
PRIOR_USES = 500.0
MOST_LANGUAGES = 64
#: Rounds of weighing the pieces; each sees all distinct training words.
ROUNDS = 2
#: How many words of a document its own counts have to outweigh. Chosen on one half of sf0.01's training documents with the other half as the model's.
FIRMNESS = 3000.0
#: Words whose lattices a worker goes through at once.
BATCH = 2048
_PREFIX = -1


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@lru_cache(maxsize=2)
def _vocabulary(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def _is_byte(piece: str) -> bool:
    return len(piece) == 6 and piece.startswith("<0x")


#: An arc of a word's lattice: the character where it starts, how many it covers, and its code.
ARC = np.dtype([("start", "<u4"), ("long", "u1"), ("code", "<u4")])


class Spelling:
    """The arcs of words under a vocabulary of n pieces, whatever they weigh. Codes: 0 to n - 1 for pieces that start a word, n to 2n - 1 for pieces further on, from 2n on a character that is spelled byte by byte."""

    def __init__(self, path: str):
        model = _vocabulary(path)
        self.n = n = model.get_piece_size()
        self.pieces, scores = [model.id_to_piece(i) for i in range(n)], np.array([model.get_score(i) for i in range(n)])
        self.scores = scores
        # Scores of -1e9 mark pieces that the vocabulary itself never uses, but a bare ▁ has to start the words that no longer piece starts.
        usable = np.array([not model.is_control(i) and not model.is_unknown(i) and (scores[i] > -1e8 or self.pieces[i] == "▁") for i in range(n)])
        self.byte = np.array([_is_byte(x) for x in self.pieces])
        self.starts = np.array([x.startswith("▁") for x in self.pieces]) & usable
        self.inner = usable & ~self.starts
        self.first, self.going = {}, {}
        for i, piece in enumerate(self.pieces):
            if usable[i] and not self.byte[i]:
                table, code = (self.first, i) if self.starts[i] else (self.going, n + i)
                table[piece] = code
                for k in range(1, len(piece)):
                    table.setdefault(piece[:k], _PREFIX)

    def arcs(self, words: list[bytes]) -> list[bytes]:
        """Each word's arcs, by where they start."""
        start, long, codes, ends, letters = [], [], [], [0], 2 * self.n
        for word in words:
            s = "▁" + word.decode("utf-8", "surrogateescape")
            n, table = len(s), self.first
            come = bytearray(n + 1)
            come[0] = 1
            for i in range(n):
                if i:
                    if not come[i]:
                        continue
                    table = self.going
                    start.append(i)
                    long.append(1)
                    codes.append(letters + ord(s[i]))
                    come[i + 1] = 1
                for j in range(i + 1, n + 1):
                    code = table.get(s[i:j])
                    if code is None:
                        break
                    if code >= 0:
                        start.append(i)
                        long.append(j - i)
                        codes.append(code)
                        come[j] = 1
            ends.append(len(codes))
        found = np.empty(len(codes), ARC)
        found["start"], found["long"], found["code"] = start, long, codes
        whole = found.tobytes()
        return [whole[ARC.itemsize * a : ARC.itemsize * b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


@lru_cache(maxsize=2)
def spelling(path: str) -> Spelling:
    return Spelling(path)


class Lattice:
    """What the arcs weigh. uses: of each piece of the vocabulary at the start of words and further on; words: number of words."""

    def __init__(self, path: str, first: np.ndarray, going: np.ndarray, words: float):
        v = spelling(path)
        self.path, self.n = path, v.n
        prior = np.where(v.byte | (v.scores < -1e8), 1 / v.n, 1 / (1.0 - np.minimum(v.scores, 0)))
        first = np.where(v.starts, first + PRIOR_USES * prior / prior[v.starts].sum(), 0)
        going = np.where(v.inner, going + PRIOR_USES * prior / prior[v.inner].sum(), 0)
        stop = words + PRIOR_USES / 5
        all_going = going.sum() + stop
        self.logs = np.concatenate([np.log(np.maximum(first / first.sum(), 1e-300)), np.log(np.maximum(going / all_going, 1e-300))])
        self.stop = math.log(stop / all_going)
        self.bytes = [0.0] * 256
        for i in np.flatnonzero(v.byte):
            self.bytes[int(v.pieces[i][3:5], 16)] = float(self.logs[v.n + i])

    def _table(self, codes: dict[str, int]) -> dict[str, float | None]:
        return {k: None if c < 0 else float(self.logs[c]) for k, c in codes.items()}

    @property
    def first(self) -> dict[str, float | None]:
        """Logarithms of the pieces that start words; None for what only begins one."""
        return self._table(spelling(self.path).first)

    @property
    def going(self) -> dict[str, float | None]:
        return self._table(spelling(self.path).going)

    def forward(self, arcs: list[bytes]) -> tuple[np.ndarray, ...]:
        """The recursion in log space for many words at once, whose nodes are numbered end to end. Layer by layer, a layer being the arcs that start at one place of their words: the logarithm of what comes to
        each node, the words' last nodes, the bounds of the layers, and where the arcs start and stop, their logarithms and codes."""
        found = np.frombuffer(b"".join(arcs), ARC)
        counts = np.array([len(x) // ARC.itemsize for x in arcs], np.int64)
        start, stop, codes = found["start"].astype(np.int64), found["start"].astype(np.int64) + found["long"], found["code"].astype(np.int64)
        last = np.maximum.reduceat(stop, np.cumsum(counts) - counts)  # every word has arcs, and one of them reaches its end
        heads = np.cumsum(last + 1) - (last + 1)
        order = np.argsort(start.astype(np.int32), kind="stable")
        bounds = np.flatnonzero(np.diff(start[order], prepend=-1, append=-1))
        base = np.repeat(heads, counts)
        start, stop, codes = (start + base)[order], (stop + base)[order], codes[order]
        p = np.empty(len(codes))
        piece = codes < 2 * self.n
        p[piece] = self.logs[codes[piece]]
        letters, place = np.unique(codes[~piece], return_inverse=True)
        p[~piece] = np.array([sum(self.bytes[b] for b in chr(c - 2 * self.n).encode("utf-8", "surrogateescape")) for c in letters.tolist()])[place] if len(letters) else 0.0
        came = np.full(int((last + 1).sum()), -np.inf)
        came[heads] = 0.0
        for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            np.logaddexp.at(came, stop[low:high], came[start[low:high]] + p[low:high])
        return came, heads + last, bounds, start, stop, p, codes

    def log_probabilities(self, arcs: list[bytes]) -> np.ndarray:
        """Natural logarithms of the sums over all segmentations of words, given by their arcs."""
        found = []
        for at in range(0, len(arcs), BATCH):
            came, tails, *_ = self.forward(arcs[at : at + BATCH])
            found.append(came[tails] + self.stop)
        return np.concatenate(found) if found else np.zeros(0)

    def log_probability(self, word: bytes) -> float:
        return float(self.log_probabilities(spelling(self.path).arcs([word]))[0])

    def uses(self, arcs: list[bytes]) -> np.ndarray:
        """How often words, given by their arcs, use each piece at their start and further on (two rows), on average over their segmentations: forward and backward, in log space."""
        total = np.zeros(2 * self.n)
        for at in range(0, len(arcs), BATCH):
            came, tails, bounds, start, stop, p, codes = self.forward(arcs[at : at + BATCH])
            goes = np.full(len(came), -np.inf)
            goes[tails] = np.where(np.isfinite(came[tails]), -came[tails], -np.inf)  # so that an arc's two sides and its own logarithm add up to its share of the word
            for low, high in zip(bounds[-2::-1].tolist(), bounds[:0:-1].tolist(), strict=True):
                np.logaddexp.at(goes, start[low:high], goes[stop[low:high]] + p[low:high])
            piece = codes < 2 * self.n
            total += np.bincount(codes[piece], weights=np.exp(came[start] + p + goes[stop])[piece], minlength=2 * self.n)
        return total.reshape(2, self.n)

    def expected_uses(self, words: list[bytes]) -> tuple[dict[str, float], dict[str, float]]:
        """uses() of words, by piece."""
        v = spelling(self.path)
        return tuple({v.pieces[i]: float(x[i]) for i in np.flatnonzero(x)} for x in self.uses(v.arcs(words)))


def held_out(key: str, mod: int, rest: int) -> Column:
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % mod == rest


def packed(numbers: np.ndarray) -> bytes:
    """The distinct numbers of a text's words in ascending order, each as its distance from the one before, and how often each occurs."""
    ids, n = np.unique(numbers, return_counts=True)
    return zs.ZstdCompressor(level=1).compress(np.concatenate([np.diff(ids, prepend=0), n]).astype(np.int32).tobytes())


def unpacked(ids: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(zs.ZstdDecompressor().decompress(ids), np.int32)
    return np.cumsum(both[: len(both) // 2]), both[len(both) // 2 :]


def coded(docs: DataFrame, key: str, text: str, lang: str, langs: dict[str | None, int], held: Column) -> DataFrame:
    """Rows of two kinds. `words`: chunk, idx, word, uses (in the training documents of each language). `docs`: chunk, doc_id, held_out, lang_no, ids (see packed())."""
    id_type = docs.schema[key].dataType

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["kind", "chunk", "idx", "word", "uses", "doc_id", "held_out", "lang_no", "ids"]
        many = len(langs) + 1
        id_arrow = None
        chunk = TaskContext.get().partitionId() << 24
        numbers: defaultdict[bytes, int] = defaultdict()
        numbers.default_factory = numbers.__len__
        learnt: list[list[np.ndarray]] = [[] for _ in range(many)]
        tokens = 0

        def words() -> Iterator[pa.RecordBatch]:
            uses = np.stack([np.bincount(np.concatenate([*x, np.empty(0, np.int32)]).astype(np.int64), minlength=len(numbers)) for x in learnt], axis=1).astype(np.int64)
            found = list(numbers)
            for at in range(0, len(found), 20_000):
                part = found[at : at + 20_000]
                n = len(part)
                yield pa.RecordBatch.from_arrays([pa.array(["words"] * n), pa.array([chunk] * n, pa.int64()), pa.array(np.arange(at, at + n, dtype=np.int32)), pa.array(part, pa.binary()), pa.ListArray.from_arrays(pa.array(np.arange(0, many * n + 1, many, dtype=np.int32)), pa.array(uses[at : at + n].ravel())), pa.nulls(n, id_arrow), pa.nulls(n, pa.bool_()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=names)

        for whole in batches:
            id_arrow = whole.column(0).type
            for at in range(0, whole.num_rows, 128):
                batch = whole.slice(at, 128)
                ids, no = [], [langs.get(x, many - 1) for x in batch.column(3).to_pylist()]
                for text, held, k in zip(batch.column(1), batch.column(2).to_pylist(), no, strict=True):
                    x = np.array([numbers[w] for w in (text.as_py() or b"").lower().split()], np.int32)
                    tokens += len(x)
                    if not held:
                        learnt[k].append(x)
                    ids.append(packed(x))
                n = len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(["docs"] * n), pa.array([chunk] * n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.list_(pa.int64())), batch.column(0), batch.column(2), pa.array(no, pa.int32()), pa.array(ids, pa.binary())], names=names)
                if tokens >= CHUNK_TOKENS or len(numbers) * max(9, many) >= CHUNK_WORDS * 9:  # a word has a number for each language
                    yield from words()
                    chunk, tokens = chunk + 1, 0
                    numbers.clear()
                    for x in learnt:
                        x.clear()
        yield from words()

    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("binary").alias("text"), held.alias("held_out"), F.col(lang).alias("lang"))
    return rows.mapInArrow(code, f"kind string, chunk long, idx int, word binary, uses array<long>, doc_id {id_type.simpleString()}, held_out boolean, lang_no int, ids binary")


def with_arcs(vocab: DataFrame, path: str) -> DataFrame:
    """vocab (word, ...) with each word's arcs."""
    ship(vocab.sparkSession)

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH):
                batch = whole.slice(at, BATCH)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(spelling(path).arcs(batch.column(0).to_pylist()), pa.binary())], names=[*batch.schema.names, "arcs"])

    return vocab.mapInArrow(spell, ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in vocab.schema), "arcs binary"]))


def weighed(vocab: DataFrame, path: str) -> Lattice:
    """The lattice after ROUNDS rounds over the distinct training words. A round gathers a number for each piece of the vocabulary."""
    spark, n = vocab.sparkSession, spelling(path).n
    lattice = Lattice(path, np.zeros(n), np.zeros(n), 0)
    for _ in range(ROUNDS):
        shared = spark.sparkContext.broadcast(lattice)

        def count(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            used, words = np.zeros((2, n)), 0
            for batch in batches:
                words += batch.num_rows
                used += shared.value.uses(batch.column(0).to_pylist()) if batch.num_rows else 0
            at = np.flatnonzero(used.any(axis=0))
            yield pa.RecordBatch.from_arrays([pa.array([*at.tolist(), -1], pa.int64()), pa.array([*used[0, at], float(words)]), pa.array([*used[1, at], 0.0])], names=["piece", "first", "going"])

        first, going, words = np.zeros(n), np.zeros(n), 0.0
        for r in vocab.where("uses > 0").select("arcs").mapInArrow(count, "piece long, first double, going double").groupBy("piece").agg(F.sum("first").alias("first"), F.sum("going").alias("going")).collect():
            if r["piece"] < 0:
                words = r["first"]
            else:
                first[r["piece"]], going[r["piece"]] = r["first"], r["going"]
        lattice = Lattice(path, first, going, words)
    return lattice


def log_gamma(x: np.ndarray) -> np.ndarray:
    """For x of 1 or more: Stirling's series, eight further on."""
    y = x + 8.0
    series = (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    return series - np.log(np.prod([x + k for k in range(8)], axis=0))


def reinforced(times: np.ndarray, log_p: np.ndarray) -> np.ndarray:
    """Logarithms of the products over a document's words, for each column of log_p. times: how often each distinct word occurs."""
    again = times > 1
    own = FIRMNESS * np.exp(log_p[again])
    rises = log_gamma(own + times[again, None]) - log_gamma(own + 1.0)  # what follows a word's first occurrence
    total = math.lgamma(FIRMNESS + int(times.sum())) - math.lgamma(FIRMNESS)
    return log_p.sum(axis=0) + len(times) * math.log(FIRMNESS) + rises.sum(axis=0) - total


class Counts:
    """Of the training tokens of one language, or of all: tokens, distinct ones, ends, and the discount."""

    def __init__(self, tokens: int, distinct: int, ones: int, twos: int, ends: int):
        self.n, self.v, self.ends = tokens + ends, distinct + (ends > 0), ends
        ones, twos = ones + (ends == 1), twos + (ends == 2)
        self.discount = min(0.9, max(0.1, ones / max(1, ones + 2 * twos)))

    def log_probability(self, uses: np.ndarray, fallback: np.ndarray) -> np.ndarray:
        if not self.n:
            return fallback
        with np.errstate(divide="ignore"):
            return np.logaddexp(np.log(np.maximum(uses - self.discount, 0) / self.n), math.log(self.discount * self.v / self.n) + fallback)


def lm_scores(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", held: Column | None = None, vocabulary: str | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row. held: which rows are not learnt from."""
    spark, path = docs.sparkSession, vocabulary or default_vocabulary()
    held = held if held is not None else F.lit(False)
    common = docs.where(~held).groupBy(lang).agg(F.count("*").alias("n")).orderBy(F.desc("n"), lang).limit(MOST_LANGUAGES).collect()
    langs = {r[0]: i for i, r in enumerate(common)}
    many = len(langs) + 1  # and the others
    both = stored(coded(docs, key, text, lang, langs, held), "coded", partition_by="kind")
    words, texts = both.where("kind = 'words'").select("chunk", "idx", "word", "uses"), both.where("kind = 'docs'").select("chunk", "doc_id", "held_out", "lang_no", "ids")
    names = ["uses", *(f"u{i}" for i in range(many))]
    counted = words.groupBy("word").agg(*[F.sum(F.col("uses")[i]).alias(f"u{i}") for i in range(many)]).withColumn("uses", sum((F.col(f"u{i}") for i in range(many)), F.lit(0))).select("word", *names)
    vocab = stored(with_arcs(counted, path), "vocab")  # so that the rounds and the scores read the arcs instead of finding them again
    ends = {r[0]: r[1] for r in texts.where("not held_out").groupBy("lang_no").count().collect()}
    sums = vocab.agg(*[f(c) for c in names for f in (F.sum, lambda c: F.count_if(F.col(c) > 0), lambda c: F.count_if(F.col(c) == 1), lambda c: F.count_if(F.col(c) == 2))]).first()
    corpus, *by_lang = [Counts(*(int(x or 0) for x in sums[4 * i : 4 * i + 4]), ends.get(i - 1, 0) if i else sum(ends.values())) for i in range(many + 1)]
    n, v = corpus.n, corpus.v
    lattice = spark.sparkContext.broadcast(weighed(vocab, path))  # as large as the vocabulary

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            model = lattice.value
            spelled = model.log_probabilities(batch.column(2 + many).to_pylist())
            each = np.stack([batch.column(2 + i).to_numpy() for i in range(many)], axis=1)
            rows, k = np.nonzero(each)
            entries = (k.astype(np.uint64) << np.uint64(56)) | each[rows, k].astype(np.uint64)  # few words are of more than one language
            ends = np.concatenate([[0], np.cumsum(8 * np.bincount(rows, minlength=len(each)))]).astype(np.int32)
            uses = pa.Array.from_buffers(pa.binary(), len(each), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(entries.tobytes())])
            yield pa.RecordBatch.from_arrays([batch.column(0), uses, pa.array(corpus.log_probability(batch.column(1).to_numpy(), spelled).astype(np.float32))], names=["word", "by_lang", "all_langs"])

    scored = vocab.select("word", *names, "arcs").mapInArrow(score, "word binary, by_lang binary, all_langs float")
    end_base = math.log10((corpus.ends + 1) / (n + v + 1))
    end_all = corpus.log_probability(np.array([corpus.ends]), np.array([math.log(1 / (n + v + 1))]))
    end = np.array([c.log_probability(np.array([c.ends]), end_all)[0] for c in by_lang])
    shares = np.log((np.array([c.ends for c in by_lang]) + 1) / (corpus.ends + many))

    def add(left: pa.Table, right: pa.Table) -> pa.Table:
        idx, given = right["idx"].to_numpy(), right["by_lang"].to_pylist()
        entries = np.frombuffer(b"".join(given), np.uint64)
        uses, all_langs = np.zeros((len(idx), many), np.int64), np.empty(len(idx))
        uses[np.repeat(idx, [len(x) // 8 for x in given]), (entries >> np.uint64(56)).astype(int)] = (entries & np.uint64((1 << 56) - 1)).astype(np.int64)
        all_langs[idx] = right["all_langs"].to_numpy()
        known, base = uses.any(axis=1), np.log10((uses.sum(axis=1) + 1) / (n + v + 1))
        scores = np.stack([c.log_probability(uses[:, i], all_langs) for i, c in enumerate(by_lang)], axis=1)
        out = []
        for x in left["ids"]:
            ids, times = unpacked(x.as_py())
            by = shares + end + reinforced(times, scores[ids])
            top = by.max()
            out.append((int(times.sum()) + 1, int(times @ known[ids]) + (corpus.ends > 0), float(times @ base[ids]) + end_base, float(top + np.log(np.exp(by - top).sum())) / math.log(10)))
        cols = list(zip(*out, strict=True)) or [(), (), (), ()]
        return pa.table([left["doc_id"], left["held_out"], pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array([n] * len(out), pa.int64()), pa.array(cols[2], pa.float64()), pa.array(cols[3], pa.float64())], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    numbers = words.join(scored, "word").select(F.col("chunk").alias("of_chunk"), "idx", "by_lang", "all_langs")
    return texts.groupBy("chunk").cogroup(numbers.groupBy("of_chunk")).applyInArrow(add, f"doc_id {docs.schema[key].dataType.simpleString()}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op6_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(read(spark, sf_dir, "documents").select("doc_id", "text", "lang"), held=held_out("doc_id", HOLD_OUT, HELD))
