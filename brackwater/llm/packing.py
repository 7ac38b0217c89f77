"""Mixture-controlled packing: deficit round-robin over source queues.

A source's documents, end to end, are a queue of tokens, served in quanta of QUANTUM tokens. In round r each queue is credited
with its weight's share of a window, and served as many quanta as its credit allows; the rest, its deficit, is carried into
the next round, and so across windows. A queue that has run out leaves its share to the others. Rounds, end to end, are one
stream that is cut into windows of LENGTH tokens: each holds the target proportions, to within a quantum for each source, and
none is padded; the last, partial one is cut into lengths that are powers of two, which aren't padded either.

The deficits after r rounds have a closed form, r * credit mod QUANTUM, in whole numbers. So where a quantum lands follows from its
number and the queues' lengths: partitions carry each other's deficits without waiting for each other. Only a table of each
partition's tokens in each queue is gathered. There are as many queues as sources, up to MOST_QUEUES; of more sources, those that the targets
name keep a queue each, and the others share queues by hash.

Ids are the tokenizer's own, so the strings of its special tokens become their ids.

Defined cases: a null text is empty and has only the end token; a null source is a queue of its own; a text with special tokens is
tokenized whole; targets that name no source with a positive weight leave each source its own size as weight; rows of one id are packed
each; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brackwater.llm.common import lookup_join, read, ship, stored

LENGTH = 4096
QUANTUM = 256
END_ID = 2
#: What op10 packs to: each source in proportion to the root of its tokens, as long as it lasts.
TEMPER = 0.5
MOST_QUEUES = 4096
#: What the weights add up to, about.
WEIGHT_SUM = 1 << 20
#: Words whose ids a worker keeps.
CACHED = 500_000
#: Texts are split here before they are tokenized word by word; the tokenizer never joins what these separate.
_WORD = re.compile(r"[^ \t\n\r\x0b\x0c]+")
#: Texts of ASCII without apostrophes and of Latin letters are split further, into letters and the rest, as the tokenizer splits them.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_PLAIN = re.compile(rf"[{_LETTERS}\x00-\x26\x28-\x7e]*")
_UNIT = re.compile(rf"[{_LETTERS}]+|[^{_LETTERS} \t\n\r\x0b\x0c]+")
_IS_LETTERS = re.compile(rf"[{_LETTERS}]+")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _byte_letters() -> list[str]:
    """The character by which byte-level vocabularies write each byte: itself where it prints, else the next from 256."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in prints else chr(next(spare)) for b in range(256)]


class WordIds(dict):
    """The ids of a word as little-endian unsigned 32-bit numbers. Words of Latin letters go to the vocabulary's merges without the
    tokenizer's other steps, which leave them as they are but for their case."""

    def __init__(self, path: str):
        self.tokenizer = _tokenizer(path)
        self.merges, self.letters = self.tokenizer.model.tokenize, _byte_letters()
        added = sorted({x for t in self.tokenizer.get_added_tokens_decoder().values() for x in (t.content, t.content.lower())})
        self.special = re.compile("|".join(map(re.escape, added)), re.I) if added else re.compile(r"(?!)")

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHED:
            self.clear()
        if _IS_LETTERS.fullmatch(word):
            low = word.lower()
            if low != word:
                ids = self[low]
            else:
                spelled = low if low.isascii() else "".join([self.letters[b] for b in low.encode()])
                ids = np.array([t.id for t in self.merges(spelled)], "<u4").tobytes()
        else:
            ids = np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
        self[word] = ids
        return ids

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def ids(self, texts: list[str], end: bytes) -> list[bytes]:
        return [self.whole(x) + end if self.special.search(x) else b"".join([*map(self.__getitem__, (_UNIT if _PLAIN.fullmatch(x) else _WORD).findall(x)), end]) for x in texts]


def tokenized(docs: DataFrame, key: str, text: str, source: str, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """doc_id, queue, part (the task), before (tokens of this queue that the task has had before), doc_tokens, ids (binary)."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, had, words = TaskContext.get().partitionId(), {}, WordIds(tokenizer)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = batch.slice(at, 256)
                ids = words.ids(rows.column(2).to_pylist(), end)
                counts, before = [len(x) // 4 for x in ids], []
                for queue, n in zip(rows.column(1).to_pylist(), counts, strict=True):
                    before.append(had.get(queue, 0))
                    had[queue] = before[-1] + n
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array([part] * len(ids), pa.int32()), pa.array(before, pa.int64()), pa.array(counts, pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "queue", "part", "before", "doc_tokens", "ids"])

    ship(docs.sparkSession)
    return docs.select(F.col(key).alias("doc_id"), F.col(source).alias("queue"), F.coalesce(F.col(text), F.lit("")).alias("text")).mapInArrow(encode, f"doc_id {docs.schema[key].dataType.simpleString()}, queue string, part int, before long, doc_tokens long, ids binary")


class Layout:
    """Where the tokens of the queues land. lengths: tokens in each queue; weights: of each queue."""

    def __init__(self, lengths: list[int], weights: list[float], length: int = LENGTH, quantum: int = QUANTUM):
        self.n, weights = np.array(lengths, np.int64), [max(0.0, w) for w in weights]
        total = sum(weights)
        if not total:
            weights, total = lengths, sum(lengths)
        self.w = np.array([max(1, round(w / total * WEIGHT_SUM)) for w in weights], np.int64)
        self.sum, self.length, self.quantum, self.slots = int(self.w.sum()), length, quantum, length // quantum
        all_tokens = int(self.n.sum())
        self.full = all_tokens // length
        rest = all_tokens - self.full * length
        sizes = [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]
        self.tail = self.full * length + np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]).astype(np.int64)

    def served(self, rounds: np.ndarray, q: np.ndarray | slice = slice(None)) -> np.ndarray:
        """Tokens that queues have been served when so many rounds are over."""
        return np.minimum(self.n[q], self.quantum * (rounds * self.w[q] * self.slots // self.sum))

    def places(self, queue: np.ndarray, number: np.ndarray) -> np.ndarray:
        """Where in the stream the quanta of these numbers in their queues start."""
        out = np.empty(len(queue), np.int64)
        step = max(1, 2_000_000 // max(1, len(self.n)))
        for at in range(0, len(queue), step):
            q, j = queue[at : at + step], number[at : at + step]
            by = self.w[q] * self.slots
            rounds = -(-(j + 1) * self.sum // by)
            before, after = self.served(rounds[:, None] - 1), self.served(rounds[:, None])
            earlier = np.arange(len(self.n)) < q[:, None]
            own = self.quantum * ((rounds - 1) * by // self.sum)
            out[at : at + step] = before.sum(axis=1) + ((after - before) * earlier).sum(axis=1) + self.quantum * j - own
        return out

    def windows(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of places in the stream: number, start and end of the sequence."""
        k = place // self.length
        late = k >= self.full
        t = np.clip(np.searchsorted(self.tail, place, side="right") - 1, 0, max(0, len(self.tail) - 2))
        end = self.tail[np.minimum(t + 1, len(self.tail) - 1)]
        return np.where(late, self.full + t, k), np.where(late, self.tail[t], k * self.length), np.where(late, end, (k + 1) * self.length)

    def pieces(self, queue: np.ndarray, start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of documents at `start` of their queues: document's index, start in it, length, sequence, offset of each piece."""
        q = self.quantum
        first, last = start // q, (start + count - 1) // q
        m = last - first + 1
        doc = np.repeat(np.arange(len(start)), m)
        number = np.repeat(first, m) + np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m)
        low, high = np.maximum(number * q, start[doc]), np.minimum((number + 1) * q, (start + count)[doc])
        place = self.places(queue[doc], number) + low - number * q
        at, n = low - start[doc], high - low
        parts = []
        while len(doc):  # most quanta lie in one sequence; what is beyond its end goes round again
            seq, begin, end = self.windows(place)
            take = np.minimum(n, end - place)
            parts.append(np.stack([doc, at, take, seq, place - begin]))
            more = take < n
            doc, at, place, n = doc[more], (at + take)[more], (place + take)[more], (n - take)[more]
        if not parts:
            return tuple(np.empty((5, 0), np.int64))
        doc, at, n, seq, offset = (all_ := np.concatenate(parts, axis=1))[:, np.lexsort((all_[1], all_[0]))]
        joins = np.concatenate([[False], (doc[1:] == doc[:-1]) & (seq[1:] == seq[:-1]) & (offset[1:] == offset[:-1] + n[:-1])])
        heads = np.flatnonzero(~joins)
        return doc[heads], at[heads], np.add.reduceat(n, heads), seq[heads], offset[heads]


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", tokenizer: str | None = None, targets: dict[str | None, float] | None = None, length: int = LENGTH, quantum: int = QUANTUM, most_queues: int = MOST_QUEUES, temper: float = 1.0) -> DataFrame:
    """doc_id, start, length, doc_tokens, sequence_id, offset, ids (binary, unsigned 32-bit little-endian) of each piece. targets: the
    weight of each source (one it doesn't name has weight 0 and is served as slowly as can be); without it, sources are weighted by their tokens to the power `temper`."""
    sources = docs.select(source).distinct().limit(most_queues + 1).count()
    own = F.concat(F.lit("s"), F.col(source).cast("string"))  # null stays null
    if sources > most_queues:
        named = [x for x in targets or () if x is not None]
        shared = F.concat(F.lit("h"), F.pmod(F.xxhash64(source), F.lit(most_queues)).cast("string"))
        own = F.when(F.col(source).isNull() | F.col(source).cast("string").isin(named), own).otherwise(shared)
    weight_of = {None if x is None else f"s{x}": w for x, w in (targets or {}).items()}
    queue = own
    tokens = stored(tokenized(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), queue.alias("queue")), "doc_id", "text", "queue", tokenizer or default_tokenizer()), "tokens")
    sums = tokens.groupBy("queue", "part").agg(F.sum("doc_tokens").alias("n"))
    starts = stored(sums.withColumn("base", F.coalesce(F.sum("n").over(Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))), "starts")
    queues = {r["queue"]: r["n"] for r in starts.groupBy("queue").agg(F.sum("n").alias("n")).collect()}  # most_queues rows, and one for each named target
    names = sorted(queues, key=lambda x: (x is None, x))
    layout = Layout([queues[x] for x in names], [weight_of.get(x, 0) if targets else queues[x] ** temper for x in names], length, quantum) if names else None
    index = {x: i for i, x in enumerate(names)}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for row in range(0, whole.num_rows, 512):
                batch = whole.slice(row, 512)
                queue = np.array([index[x] for x in batch.column(1).to_pylist()], np.int64)
                count = batch.column(3).to_numpy()
                doc, at, n, seq, offset = layout.pieces(queue, batch.column(2).to_numpy(), count)
                ids = [memoryview(x) for x in batch.column(4).to_pylist()]
                cuts = pa.array([bytes(ids[d][4 * a : 4 * (a + k)]) for d, a, k in zip(doc.tolist(), at.tolist(), n.tolist(), strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc)), pa.array(at), pa.array(n), pa.array(count[doc]), pa.array(seq), pa.array(offset), cuts], names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

    placed = lookup_join(tokens, starts.select("queue", "part", "base"), ["queue", "part"], starts.count())
    return placed.select("doc_id", "queue", (F.col("before") + F.col("base")).alias("at"), "doc_tokens", "ids").mapInArrow(
        cut, f"doc_id {docs.schema[key].dataType.simpleString()}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
    )


def sequences(pieces: DataFrame, length: int = LENGTH) -> DataFrame:
    """sequence_id, ids (binary), n_tokens, padding of each sequence that pack() has laid out: `length` tokens' worth of pieces at most."""
    whole = pieces.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"), F.sum("length").alias("n_tokens"))
    power = (F.col("n_tokens").bitwiseAND(F.col("n_tokens") - 1)) == 0
    return whole.select("sequence_id", F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"), "n_tokens", F.when(power, 0).otherwise(length - F.col("n_tokens")).alias("padding"))


def digests(docs: DataFrame) -> DataFrame:
    return pack(docs, temper=TEMPER).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(read(spark, sf_dir, "documents").select("doc_id", "text", "source"))
