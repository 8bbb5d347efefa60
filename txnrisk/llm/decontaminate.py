"""Benchmark decontamination: size-partitioned MinHash containment search.

A benchmark item leaks into a document if at least ``containment`` of its
distinct word shingles occur there. Items are partitioned by size: an item of
q shingles is represented by the floor((1 - containment) * q) + 1 shingles
with the smallest hashes, a bottom-k MinHash sketch whose k follows the item's
size and not the document's, so short items are found in documents of any
length. A document that holds enough of the item must hold one of the sketch,
so the search has no false negatives; every candidate is then verified by
exact containment of its shingles as text.

Items are a stated query set: they go to the tasks in blocks of a bounded
number of words, and all documents are read once for each block. Documents
are never shuffled.

Words are runs of letters and digits, lower-cased. Items with fewer words
than a shingle are one shingle of that many words, items without a word leak
nowhere. Null texts and null items are empty. Rows that share an item_id are
one item each and are told apart by their text; equal texts under one id are
one item. Repeated documents give repeated rows. Other columns of both tables
are not read by ``leaks`` and pass through ``without_leaks``.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txnrisk.llm.common import add_columns, fresh, saved

WORDS = 5
CONTAINMENT = 0.8
BLOCK_WORDS = 500_000   # words of items sent to the tasks at once
CHUNK = 1 << 15            # document shingles hashed at once
TOKEN = re.compile(r"[^\W_]+")


def tokens(text: str | None) -> list[bytes]:
    return " ".join(TOKEN.findall((text or "").lower())).encode("utf-8", "surrogatepass").split()


def shingles(words: list[bytes], n: int) -> list[bytes]:
    return [b" ".join(words[i:i + n]) for i in range(len(words) - n + 1)]


class Index:
    """Items' shingles and sketches, by shingle length in words."""

    def __init__(self, items: list[tuple], words: int, containment: float) -> None:
        self.items, by_width = [], defaultdict(lambda: defaultdict(list))
        for item_id, text in items:
            found = tokens(text)
            width = min(words, len(found))
            own = frozenset(shingles(found, width)) if width else frozenset()
            if not own:
                continue
            sketch_size = int((1 - containment) * len(own) + 1e-9) + 1
            for h in sorted(xxhash.xxh64_intdigest(s) for s in own)[:sketch_size]:
                by_width[width][h].append(len(self.items))
            self.items.append((item_id, own))
        self.sketches = {w: (np.array(sorted(d), np.uint64), d) for w, d in by_width.items()}
        self.containment = containment

    def search(self, text: str | None) -> list[tuple]:
        """(item_id, shingles of the item, shared shingles) of every item that leaks into a text."""
        found, candidates = None, defaultdict(set)
        if text:
            found = tokens(text)
        if not found:
            return []
        joined, digest = b" ".join(found), xxhash.xxh64_intdigest
        ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        for width, (sorted_hashes, where) in self.sketches.items():
            n = len(found) - width + 1
            for at in range(0, n, CHUNK):
                upto = min(n, at + CHUNK)
                hashes = np.array([digest(joined[s:e]) for s, e in zip(starts[at:upto].tolist(), ends[at + width - 1:upto + width - 1].tolist(), strict=True)], np.uint64)
                place = np.minimum(np.searchsorted(sorted_hashes, hashes), sorted_hashes.size - 1)
                for h in hashes[sorted_hashes[place] == hashes].tolist():
                    candidates[width].update(where[h])
        out = []
        for width, numbers in candidates.items():
            wanted = frozenset().union(*(self.items[i][1] for i in numbers))
            here = {s for i in range(len(found) - width + 1) if (s := joined[starts[i]:ends[i + width - 1]]) in wanted}
            for i in sorted(numbers):
                item_id, own = self.items[i]
                shared = len(own & here)
                if shared >= self.containment * len(own) - 1e-9:
                    out.append((item_id, len(own), shared))
        return out


def item_blocks(items: DataFrame, words: int, containment: float, block: int) -> Iterator[Index]:
    """Indexes over blocks of at most ``block`` words of items, or one longer item.

    Items stream to the driver, which holds one block at a time. How they fall
    into blocks does not change what is found.
    """
    rows = saved(items.select("item_id", F.coalesce("text", F.lit("")).alias("text")).distinct(), "items")
    held, size = [], 0
    for item_id, text in rows.toLocalIterator():
        n = len(TOKEN.findall(text))
        if held and size + n > block:
            yield Index(held, words, containment)
            held, size = [], 0
        held.append((item_id, text))
        size += n
    if held:
        yield Index(held, words, containment)


def with_hits(docs: DataFrame, index: Index, name: str, id_type: T.DataType) -> DataFrame:
    kind = T.ArrayType(T.StructType([T.StructField("item_id", id_type), T.StructField("n_shingles", T.LongType()), T.StructField("n_shared", T.LongType())]))

    def search(texts: list) -> dict[str, list]:
        return {name: [[dict(zip(("item_id", "n_shingles", "n_shared"), x, strict=True)) for x in index.search(t)] for t in texts]}

    return add_columns(docs, "text", T.StructType([T.StructField(name, kind)]), search)


def leaks(docs: DataFrame, items: DataFrame, words: int = WORDS, containment: float = CONTAINMENT, block: int = BLOCK_WORDS) -> DataFrame:
    """One row per document and item that it holds: doc_id, item_id, n_shingles, n_shared, containment."""
    docs, id_type = docs.select("doc_id", "text"), items.schema["item_id"].dataType

    def found(index: Index) -> DataFrame:
        return with_hits(docs, index, "hits", id_type).select("doc_id", F.explode("hits").alias("h")).select("doc_id", "h.*")

    out, blocks = [], item_blocks(items, words, containment, block)
    current = found(next(blocks, None) or Index([], words, containment))
    for index in blocks:
        out.append(saved(current, "leaks"))   # so that a task holds one index at a time
        current = found(index)
    every = reduce(DataFrame.union, [*out, current])
    return every.withColumn("containment", F.col("n_shared") / F.col("n_shingles"))


def without_leaks(docs: DataFrame, items: DataFrame, words: int = WORDS, containment: float = CONTAINMENT, block: int = BLOCK_WORDS) -> DataFrame:
    """The documents that hold no item, with all their columns."""
    name, id_type = fresh(docs, "_hits"), items.schema["item_id"].dataType
    for i, index in enumerate(item_blocks(items, words, containment, block)):
        if i:
            docs = saved(docs, "clean")   # so that a task holds one index at a time
        docs = with_hits(docs, index, name, id_type).filter(F.size(name) == 0).drop(name)
    return docs


#: DuckDB: the same by exact containment of all shingles of all documents.
SQL = r"""
WITH w AS (SELECT 'd' AS side, doc_id AS id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS ws FROM documents
           UNION ALL SELECT 'i', item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') FROM benchmark),
items AS (SELECT DISTINCT id, least(len(ws), 5) AS k, array_to_string(ws[i:i + least(len(ws), 5) - 1], ' ') AS s
          FROM (SELECT id, ws, unnest(range(1, len(ws) - least(len(ws), 5) + 2)) AS i FROM w WHERE side = 'i' AND len(ws) > 0)),
widths AS (SELECT DISTINCT k FROM items),
docs AS (SELECT DISTINCT id, k, array_to_string(ws[i:i + k - 1], ' ') AS s
         FROM (SELECT id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, widths WHERE side = 'd' AND len(ws) >= k)),
shared AS (SELECT d.id AS doc_id, i.id AS item_id, count(*) AS n_shared FROM docs d JOIN items i ON d.k = i.k AND d.s = i.s GROUP BY ALL),
sizes AS (SELECT id, count(*) AS n_shingles FROM items GROUP BY id)
SELECT doc_id, item_id, n_shingles, n_shared, n_shared / n_shingles AS containment
FROM shared JOIN sizes ON item_id = id WHERE n_shared >= 0.8 * n_shingles - 1e-9
"""
