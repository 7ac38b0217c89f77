"""Cross-tokenizer alignment: which tokens of two vocabularies end together, counted in dense matrices that are striped by id.

A text's tokens under a byte-level BPE (side A) and a piece model (side B) are laid over its bytes. Where tokens of both sides end at one byte, they are linked, and the text
is cut into groups. How often an id pair is linked in the corpus is counted in a matrix of B ids by A ids, dealt into STRIPES stripes of B ids: links are packed by stripe,
added into the stripe's dense block with np.add.at, and the row maxima of a block give the best count of each B id. The links meet their stripe's block again and are
scored there; the scores are summed by document. (See postings.py for how stripes stay even and bounded.)

Texts are cut into units that neither tokenizer reads across: at a blank or line feed after something that is no white space. No piece holds a blank after something else, or a line
feed, which is checked when the model is loaded (else the whole text is one unit). A unit is tokenized and aligned once for each worker that meets it, for up to CACHED short units.

Defined cases: a null or empty text, and one whose joined tokens of either side differ from a blank and the text, has no tokens: zeros, and '' as groups. Special tokens' strings are plain
text. Rows of one id are aligned each, and repeated rows count each; a null id passes through; very long texts are aligned whole; an empty table gives no rows; other columns are not read,
whatever their names.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brackwater.llm import postings
from brackwater.llm.common import read, ship, stored

#: Stripes of B ids. A block of one of them holds as many numbers as a stripe has B ids, times the A ids: 500 x 50,257 for the vocabularies that op11 uses, 201 MB where all are touched.
STRIPES = 64
#: A worker keeps units of up to LONG characters: up to twice so many, of which those that don't come again are left behind.
CACHED, LONG = 300_000, 64
#: Units that are aligned at once, and, where some of them are not spelled by their tokens, those that are then tried at once.
BATCH, FEW = 512, 64
#: A unit starts at a blank or a line feed after something that is no white space. (Some tokenizers take the three named characters for white space, some don't.)
_MORE = "\u180e\u200b\ufeff"
_UNIT = re.compile(rf"[ \n](?:\s|[{_MORE}])*(?:[^\s{_MORE}]+(?:(?:[^\S \n]|[{_MORE}])(?:\s|[{_MORE}])*[^\s{_MORE}]*)*)?")
_BLANK = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B))) + _MORE
_SPACE = "▁"


def default_tokenizers() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def _byte_of_letter() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: itself where it prints, else the next from 256."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return {chr(b) if b in prints else chr(next(spare)): b for b in range(256)}


class Sides:
    """Both tokenizers, and the units that have been aligned: ids of both sides, their groups as text, and the codes of their links."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True
        byte = _byte_of_letter()
        self.n_a, self.n_b = self.a.get_vocab_size(), self.b.get_piece_size()
        self.bytes_a = [bytes(byte.get(c, 0) for c in self.a.id_to_token(i)) if self.a.id_to_token(i) else b"" for i in range(self.n_a)]
        pieces = [self.b.id_to_piece(i) for i in range(self.n_b)]
        self.bytes_b = [bytes([int(x[3:5], 16)]) if self.b.is_byte(i) else x.replace(_SPACE, " ").encode() for i, x in enumerate(pieces)]
        self.bare = self.b.piece_to_id(_SPACE)
        self.cuts = not any(re.search(f"[^{_SPACE}]{_SPACE}|\n", x) for x in pieces) and not any(x != b"\n" and b"\n" in x for x in self.bytes_b)
        self.rows = -(-self.n_b // STRIPES)
        self.long_a, self.long_b = (np.array([len(x) for x in of]) for of in (self.bytes_a, self.bytes_b))
        # Links with B id b have the codes from here on, one for each A id: b's row in its stripe, stripe after stripe.
        every = np.arange(self.n_b)
        self.base_b = (every % STRIPES * self.rows + every // STRIPES) * self.n_a
        self.most = max(self.n_a, self.n_b)
        self.names = [f"{i}{mark}" for mark in ",|;\n" for i in range(self.most)]
        self.known: dict[str, tuple | None] = {}
        self.before: dict[str, tuple | None] = {}
        self.lost: set[str] = set()  # those that are known to have no tokens

    @property
    def width(self) -> int:
        return self.rows * self.n_a

    def units(self, text: str) -> list[str]:
        """The units of a blank and the text."""
        whole = " " + text
        if not self.cuts:
            return [whole]
        return _UNIT.findall(whole)

    def aligned(self, ends: np.ndarray, stops_a: np.ndarray, stops_b: np.ndarray, flat_a: np.ndarray, flat_b: np.ndarray) -> list[tuple]:
        """n_a, n_b, n_groups, groups, codes of the links, of units that their tokens spell. They are laid end to end, so that one pass over bytes, tokens and groups does them all: ends are those of
        their bytes, stops those of their tokens."""
        ends_a, ends_b = np.cumsum(self.long_a[flat_a]), np.cumsum(self.long_b[flat_b])
        cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)
        last_a, last_b = np.searchsorted(ends_a, cuts), np.searchsorted(ends_b, cuts)
        codes = (self.base_b[flat_b[last_b]] + flat_a[last_a]).astype("<u8").tobytes()
        stops = np.searchsorted(cuts, ends) + 1
        # Each token is written with what follows it: a comma, a bar after a group's last of side A, a semicolon after its last of side B, a line feed at the end of a unit.
        mark_a, mark_b = np.zeros(len(flat_a), np.int64), np.zeros(len(flat_b), np.int64)
        mark_a[last_a], mark_b[last_b], mark_b[last_b[stops - 1]] = 1, 2, 3
        order = np.argsort(np.concatenate([2 * np.searchsorted(cuts, ends_a), 2 * np.searchsorted(cuts, ends_b) + 1]), kind="stable")
        written = np.concatenate([mark_a * self.most + flat_a, mark_b * self.most + flat_b])[order]
        groups = "".join(map(self.names.__getitem__, written.tolist())).split("\n")
        sizes = (np.diff(x, prepend=0).tolist() for x in (stops_a, stops_b, stops))
        return [(x, y, n, g, codes[8 * (m - n) : 8 * m]) for x, y, n, g, m in zip(*sizes, groups, stops.tolist(), strict=False)]

    def encode_a(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def learn(self, units: list[str]) -> None:
        plain = [u for u in units if self.cuts and u[-1].strip(_BLANK)]
        each = [u for u in units if not (self.cuts and u[-1].strip(_BLANK))]
        if plain and not self.learn_joined(plain):
            for at in range(0, len(plain), FEW):
                if not self.learn_joined(plain[at : at + FEW]):
                    each += plain[at : at + FEW]
        if each:
            self.learn_each(each)

    def learn_joined(self, units: list[str]) -> bool:
        """Learns units that end in something else than white space, read by both sides as one text, and told apart by where their bytes end; False if a side doesn't spell them."""
        first = " a"  # so that the text begins with a blank, as texts do
        text = first + "".join(units)
        ends = np.cumsum(np.fromiter(map(len, map(str.encode, units)), np.int64, len(units))) + len(first)
        spelled, sides = text.encode(), []
        for ids, long, spell in ((self.encode_a([text])[0], self.long_a, self.bytes_a), (self.b.encode(text[1:]), self.long_b, self.bytes_b)):
            flat = np.array(ids, np.int64)
            at = np.cumsum(long[flat])
            stops = np.searchsorted(at, np.concatenate([[len(first)], ends])) + 1
            if b"".join(map(spell.__getitem__, ids)) != spelled or stops[-1] != len(flat) or (at[stops - 1] != np.concatenate([[len(first)], ends])).any():
                return False
            sides.append((stops[1:] - stops[0], flat[stops[0] :]))
        (stops_a, flat_a), (stops_b, flat_b) = sides
        self.known.update(zip(units, self.aligned(ends - len(first), stops_a, stops_b, flat_a, flat_b), strict=True))
        return True

    def learn_each(self, units: list[str]) -> None:
        # The model of side B adds a blank; so a unit's own is left out, and the one before a line feed is taken off again.
        ids_b = self.b.encode([u[u[0] == " " :] for u in units], num_threads=1)
        good, ids = [], []
        for u, a, b in zip(units, self.encode_a(units), ids_b, strict=True):
            if u == " ":
                b = [self.bare]
            elif u[0] == "\n":
                b = b[1:] if b[:1] == [self.bare] else [0]
            spelled = u.encode()
            if b"".join([self.bytes_a[i] for i in a]) == spelled == b"".join([self.bytes_b[i] for i in b]):
                good.append(u)
                ids.append((a, b))
            else:
                self.known[u] = None
                self.lost.add(u)
        if good:
            flat_a, flat_b = (np.fromiter(chain.from_iterable(x[k] for x in ids), np.int64) for k in (0, 1))
            stops_a, stops_b = (np.cumsum([len(x[k]) for x in ids]) for k in (0, 1))
            self.known.update(zip(good, self.aligned(np.cumsum([len(u.encode()) for u in good]), stops_a, stops_b, flat_a, flat_b), strict=True))

    def found(self, texts: list[str | None]) -> Iterator[list[tuple] | None]:
        """What is known of the units of each text; None if it has no tokens."""
        cut = [self.units(x) if x else [] for x in texts]
        if len(self.known) > CACHED:
            self.before, self.known = self.known, {}  # units that come again are taken over
            self.lost = {u for u in self.lost if u in self.before}
        missing = list(set(chain.from_iterable(cut)).difference(self.known))
        if self.before:
            again = [u for u in missing if u in self.before]
            self.known.update(zip(again, map(self.before.__getitem__, again), strict=True))
            missing = [u for u in missing if u not in self.known]
        for at in range(0, len(missing), BATCH):
            self.learn(missing[at : at + BATCH])
        known, lost = self.known, self.lost
        for c in cut:
            yield list(map(known.__getitem__, c)) if c and lost.isdisjoint(c) else None
        for u in missing:
            if len(u) > LONG:
                del known[u]
                lost.discard(u)


@lru_cache(maxsize=2)
def sides(path_a: str, path_b: str) -> Sides:
    return Sides(path_a, path_b)


def encoded(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizers: tuple[str, str] | None = None, digest: bool = False) -> DataFrame:
    """Two kinds of rows. Of each document: row, doc_id, n_a, n_b, n_groups, groups (`a1,a2|b1;a3|b2,b3`, ids in order; or, as a digest, the SHA-256 of that). Of each stripe and batch of
    documents: their links, packed (see postings.PACKED)."""
    paths = tokenizers or default_tokenizers()
    ship(docs.sparkSession)
    kind = docs.schema[key].dataType
    fields = [f.split() for f in postings.PACKED.split(", ")]
    arrow = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, number = sides(*paths), TaskContext.get().partitionId() << 31
        for whole in batches:
            texts, at = whole.column(1), 0
            while at < whole.num_rows:
                stats, codes, n = [], [], 0
                start = at
                while at < whole.num_rows and at - start < postings.DOCS and n < postings.ENTRIES:
                    for units in both.found(texts.slice(at, min(64, postings.DOCS - (at - start))).to_pylist()):
                        if units is None:
                            stats.append((0, 0, 0, ""))
                            codes.append(b"")
                        else:
                            a, b, cuts, groups, links = zip(*units, strict=True)
                            groups = ";".join(groups)
                            stats.append((sum(a), sum(b), sum(cuts), hashlib.sha256(groups.encode()).hexdigest() if digest else groups))
                            codes.append(b"".join(links))
                        n += len(codes[-1]) // 8
                        at += 1
                places = np.repeat(np.arange(len(codes)), [len(c) // 8 for c in codes])
                rows = list(postings.packed(np.frombuffer(b"".join(codes), "<u8"), places, number, both.width))
                ids = whole.column(0).slice(start, at - start)
                doc = [pa.array(np.arange(len(stats)) + number * postings.DOCS), ids, *(pa.array([s[k] for s in stats], pa.string() if k == 3 else pa.int64()) for k in range(4))]
                names = ["row", "doc_id", "n_a", "n_b", "n_groups", "groups"]
                empty = [pa.nulls(len(stats), arrow[t]) for _, t in fields]
                yield pa.RecordBatch.from_arrays([*doc, *empty], names=[*names, *(f for f, _ in fields)])
                for i in range(0, len(rows), 8):  # a few rows of postings at a time
                    some = rows[i : i + 8]
                    columns = [pa.array([r[k] for r in some], arrow[t]) for k, (_, t) in enumerate(fields)]
                    yield pa.RecordBatch.from_arrays([*(pa.nulls(len(some), d.type) for d in doc), *columns], names=[*names, *(f for f, _ in fields)])
                number += 1

    return docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).mapInArrow(encode, f"row long, doc_id {kind.simpleString()}, n_a long, n_b long, n_groups long, groups string, {postings.PACKED}")


def pair_counts(links: DataFrame, n_a: int, rows: int) -> DataFrame:
    """stripe, and packed codes and counts of all linked id pairs, one row for each stripe."""
    return stored(postings.totals(links, STRIPES, rows * n_a, lambda df: stored(df, "combined")), "pairs")


def align(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizers: tuple[str, str] | None = None, digest: bool = False) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups of each row of docs."""
    both = sides(*(tokenizers or default_tokenizers()))
    found = stored(encoded(docs, key, text, tokenizers, digest), "aligned")
    links, n_a, rows = found.where("stripe IS NOT NULL"), both.n_a, both.rows
    counts = pair_counts(links, n_a, rows)

    def prepare(blocks: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        return blocks[0], blocks[0].reshape(rows, n_a).max(axis=1)

    def score(ready: tuple[np.ndarray, np.ndarray], codes: np.ndarray) -> list[np.ndarray]:
        count = ready[0][codes]
        return [count == ready[1][codes // n_a], count]

    sums = postings.contributions(links, [counts], STRIPES, both.width, prepare, score, ["n_best", "count_sum"])
    each = found.where("stripe IS NULL").select("row", "doc_id", "n_a", "n_b", "n_groups", "groups")
    zero = F.lit(0).cast("long")
    return each.join(sums, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups")


def best_pairs(docs: DataFrame, text: str = "text", tokenizers: tuple[str, str] | None = None) -> DataFrame:
    """b, a, n: for each B id the A ids that it is linked with most often, ties included, and how often: a map from one vocabulary to the other."""
    both = sides(*(tokenizers or default_tokenizers()))
    rows, n_a = both.rows, both.n_a
    found = stored(encoded(docs.select(F.lit(0).alias("doc_id"), F.col(text).alias("text")), tokenizers=tokenizers, digest=True), "aligned")
    ship(docs.sparkSession)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for stripe, codes, counts in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                codes, counts = np.frombuffer(codes, "<u4").astype(np.int64), np.frombuffer(counts, "<i8")
                most = np.zeros(rows, np.int64)
                np.maximum.at(most, codes // n_a, counts)
                top = counts == most[codes // n_a]
                yield pa.RecordBatch.from_arrays([pa.array(codes[top] // n_a * STRIPES + stripe), pa.array(codes[top] % n_a), pa.array(counts[top])], names=["b", "a", "n"])

    return pair_counts(found.where("stripe IS NOT NULL"), n_a, rows).mapInArrow(best, "b long, a long, n long")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(read(spark, sf_dir, "documents").select("doc_id", "text"), digest=True).withColumnRenamed("groups", "groups_sha256")
