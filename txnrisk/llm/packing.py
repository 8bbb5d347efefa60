"""Best-fit decreasing packing of tokenised documents into sequences.

A document's tokens are cut into pieces of at most ``capacity`` tokens; only
documents longer than that are cut. Best-fit decreasing takes the pieces from
the longest to the shortest and puts each into the open sequence with the
least room that still holds it, or opens one. A segment tree over the
remaining capacities finds that room in logarithmic time.

Pieces of one length are alike to the packing, and so are sequences of one
remaining capacity. What is packed is therefore the histogram of lengths, at
most ``capacity`` numbers whatever the corpus: equal pieces that go to equal
sequences are one *run* of the plan. Spark numbers the pieces in decreasing
length (range partitions, with the offset of each), and a piece's number
alone says its run, sequence and place. The whole corpus is packed as one
best-fit decreasing would pack it; no task or driver holds the pieces.

The tokenizer splits at white space and at word borders, so a text's ids are
those of its words in sequence. Words met before come from a bounded table
per worker; texts with characters outside Latin letters, digits and ASCII
signs go through the tokenizer itself. Long texts are read in stretches cut
at a blank.

Defined results: a null or empty text, or one of white space, is the single
end id. Repeated rows are packed once each. Null and repeated doc_ids keep
their rows. An empty table gives no row. Other columns are not read.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txnrisk.llm.common import numbered, saved

CAPACITY = 2048
END = bytes(4)              # id 0 closes a document
STRETCH = 1 << 20           # code points of a text tokenised at once
KNOWN = 1 << 19             # entries of a worker's table of known words
BATCH = 1 << 14             # output rows held before they are passed on

BLANK = re.compile(r"[ \n]")
PLAIN = re.compile(r"[\x00-\x1b\x20-ɏ]*")  # here NFC changes nothing and lower case is letter by letter
# The pre-tokenizer's pattern, as its file states it.
WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
PIECE = T.StructType([T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()),
                      T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())])
RUN = ("first", "length", "per_sequence", "sequence", "offset")


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


class Words:
    """Ids of whole texts as little-endian 32-bit numbers."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True  # their names in a text are ordinary text
        self.ends = np.zeros(self.whole.get_vocab_size(), bool)
        for word, i in self.whole.get_vocab(with_added_tokens=False).items():
            self.ends[i] = word.endswith("</w>")
        self.known: dict[str, bytes] = {}

    def encoded(self, text: str) -> np.ndarray:
        return np.array(self.whole.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def learn(self, words: set[str]) -> None:
        new = list(words.difference(self.known))
        if not new:
            return
        ids = self.encoded(" ".join(new))
        ends = (np.flatnonzero(self.ends[ids]) + 1) * 4
        if len(ends) != len(new):
            raise ValueError("a word has not exactly one last token: this tokenizer is no BPE with word ends")
        data, at = ids.tobytes(), 0
        for word, end in zip(new, ends.tolist(), strict=True):
            self.known[word] = data[at:end]
            at = end

    def ids(self, text: str) -> bytes:
        if not PLAIN.fullmatch(text):
            return self.encoded(text).tobytes()
        parts = text.lower().split()
        new = set(parts).difference(self.known)
        if len(self.known) + 2 * len(new) > KNOWN:
            self.known, new = {}, set(parts)
        mixed = {p: WORD.findall(p) for p in new if not p.isalpha()}
        self.learn({p for p in new if p not in mixed}.union(*mixed.values()))
        for p, words in mixed.items():
            self.known[p] = b"".join([self.known[w] for w in words])
        return b"".join(map(self.known.__getitem__, parts))


@lru_cache(maxsize=2)
def words_of(path: str) -> Words:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs one task a core
    return Words(path)


def stretches(text: str) -> Iterator[str]:
    """``text`` in parts that end before a blank, which no token crosses."""
    at = 0
    while at < len(text):
        blank = BLANK.search(text, at + STRETCH)
        end = blank.start() if blank else len(text)
        yield text[at:end]
        at = end


def pieces_of(text: str | None, words: Words, capacity: int) -> Iterator[tuple[int, int, int, int]]:
    """(piece, start, length, crc32 of the ids) of one document."""
    held, n, size = bytearray(), 0, capacity * 4

    def cut(data) -> tuple[int, int, int, int]:
        return n, n * capacity, len(data) // 4, crc32(data)

    for part in stretches(text or ""):
        held += words.ids(part)
        whole = len(held) // size
        for i in range(whole):
            yield cut(held[i * size:(i + 1) * size])
            n += 1
        del held[:whole * size]
    yield cut(held + END)  # what is held is shorter than a piece


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of every piece of every document."""
    from pyspark.sql.pandas.types import to_arrow_schema
    schema = T.StructType([docs.schema["doc_id"], *PIECE.fields])
    target = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = words_of(tokenizer)

        def batch(b: pa.RecordBatch, rows: list[int], out: list[tuple]) -> pa.RecordBatch:
            columns = zip(*out, strict=True)
            return pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())).cast(target.types[0]),
                                               *[pa.array(c, k) for c, k in zip(columns, target.types[1:], strict=True)]], schema=target)

        for b in batches:
            rows, out = [], []
            for i, text in enumerate(b.column(1)):
                for piece in pieces_of(text.as_py(), words, capacity):
                    rows.append(i)
                    out.append(piece)
                    if len(out) >= BATCH:
                        yield batch(b, rows, out)
                        rows, out = [], []
            if out:
                yield batch(b, rows, out)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


class Rooms:
    """Segment tree over remaining capacities: how many runs of open sequences have each."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.open = [0] * (2 * self.size)

    def add(self, room: int, n: int) -> None:
        at = room + self.size
        while at:
            self.open[at] += n
            at //= 2

    def tightest(self, least: int) -> int | None:
        """The smallest room of at least ``least`` with an open sequence."""
        at = least + self.size
        while not self.open[at]:
            while at % 2:  # a right child: nothing further right below its parent
                at //= 2
            if not at:
                return None
            at += 1
        while at < self.size:
            at = 2 * at if self.open[2 * at] else 2 * at + 1
        return at - self.size


def best_fit_plan(counts: dict[int, int], capacity: int = CAPACITY) -> dict[str, np.ndarray]:
    """Runs of best-fit decreasing over ``counts`` (length to number of pieces).

    A run covers the pieces from number ``first`` (in decreasing length, from
    0): ``per_sequence`` at a time they go to ``sequence`` and the following
    ones, from ``offset`` on. A piece that fits goes to the tightest sequence,
    which stays the tightest until no equal piece fits, so equal pieces fill
    one sequence after another.
    """
    rooms, held, runs = Rooms(capacity), {}, []
    first = opened = 0

    def put(room: int, sequence: int, n: int) -> None:
        if n and room:
            held.setdefault(room, []).append((sequence, n))
            rooms.add(room, 1)

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            room = rooms.tightest(length)
            if room is None:
                room, sequence = capacity, opened
                n = -(-left // (capacity // length))
                opened += n
            else:
                sequence, n = held[room].pop()
                rooms.add(room, -1)
            per = room // length
            full = min(n, left // per)
            some = left - full * per if full < n else 0  # pieces of a last sequence that they do not fill
            taken = full * per + some
            runs.append((first, length, per, sequence, capacity - room))
            put(room - per * length, sequence, full)
            if some:
                put(room - some * length, sequence + full, 1)
            put(room, sequence + full + (some > 0), n - full - (some > 0))
            first += taken
            left -= taken
    return {k: np.array([r[i] for r in runs], np.int64) for i, k in enumerate(RUN)}


def placed(numbers: np.ndarray, plan: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of the pieces with these numbers."""
    run = np.searchsorted(plan["first"], numbers, "right") - 1
    within = numbers - plan["first"][run]
    per = plan["per_sequence"][run]
    return plan["sequence"][run] + within // per, plan["offset"][run] + within % per * plan["length"][run]


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece."""
    cut = saved(pieces(docs, tokenizer or default_tokenizer(), capacity).withColumn("_row", F.monotonically_increasing_id()), "pieces")
    counts = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}  # at most ``capacity`` rows
    plan = best_fit_plan(counts, capacity)
    ranked, _ = numbered(cut, [F.col("length").desc(), F.col("_row")], "_number", "pieces-in-order")
    schema = T.StructType([docs.schema["doc_id"], *PIECE.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sequence, offset = placed(b.column(b.num_columns - 1).to_numpy(zero_copy_only=False), plan)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(sequence), pa.array(offset)], names=schema.names)

    return ranked.select("doc_id", *PIECE.names, "_number").mapInArrow(place, schema)
