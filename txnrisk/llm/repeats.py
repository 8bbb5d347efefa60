"""Exact removal of long repeated byte strings by column-wise suffix sorting.

Every window of ``length`` bytes is assigned to its anchor: the leftmost of
its ``gram``-byte strings with the smallest hash. Equal windows have equal
anchors at equal places, so only texts around an anchor that occurs more than
once have to be compared, and there windows start in the same columns.

Those stretches, laid one per row with their anchors in one column, are the
documents of a collection Burrows-Wheeler construction that works column by
column from the right: each round inserts one symbol of every stretch,
re-sorts the rows stably by it, and updates the common prefix of each pair of
neighbours. A window is repeated if its row has a neighbour whose common
prefix reaches ``length`` in the window's first column. Rows reach this step
through Spark's sorted shuffle files, which are read in sequence; a task
holds a bounded run of whole anchor groups. Groups of more than ``split``
stretches are not gathered: their windows are counted by hash instead, with
partial sums before the shuffle.

Equal texts are compared once. Within one text, equal stretches are folded
into one, so a text that repeats a line a thousand times costs as much as one
that repeats it twice.

Defined results: a null text is empty. A text shorter than ``length`` keeps
everything. Every row of a text that occurs twice, rows with equal doc_id
included, loses all of it. Null and repeated doc_ids get one output row per
input row. Other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txnrisk.llm.common import map_rows, saved, tasks

LENGTH = 400          # bytes of a repeated string
GRAM = 32             # bytes of an anchor, a multiple of 8
SPLIT = 1 << 15       # stretches of one anchor above which windows are counted by hash
ROWS = 1 << 14        # stretches sorted together, but for whole groups
BLOCK = 1 << 20       # bytes anchored at once; places within a block take 20 bits
PLACE = np.uint64(BLOCK - 1)
ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]


def gram_hashes(b: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of the ``gram`` bytes at each place."""
    w = b.astype(np.uint64)
    for shift in (1, 2, 4):
        w = w[:-shift] | w[shift:] << np.uint64(8 * shift)
    n = b.size - gram + 1
    h = np.zeros(n, np.uint64)
    for i in range(gram // 8):
        h = (h ^ (h >> np.uint64(29))) * ODD[0] + w[8 * i:8 * i + n] * ODD[i % 3 + 1]
    h ^= h >> np.uint64(32)
    h *= ODD[0]
    return h ^ (h >> np.uint64(29))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    n = x.size - width + 1
    full = np.concatenate([x, np.full(-x.size % width, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, width)
    after = np.minimum.accumulate(full[:, ::-1], 1)[:, ::-1].ravel()
    before = np.minimum.accumulate(full, 1).ravel()
    return np.minimum(after[:n], before[width - 1:width - 1 + n])


def anchors(b: np.ndarray, length: int, gram: int):
    """(hash, place, first window, last window) of each run of windows with the same anchor."""
    found = []
    for at in range(0, b.size - length + 1, BLOCK - length):
        part = b[at:at + BLOCK - 1]
        h = gram_hashes(part, gram)
        low = sliding_min(h & ~PLACE | np.arange(h.size, dtype=np.uint64), length - gram + 1)
        low = (low & PLACE).astype(np.int64)[:BLOCK - length]
        first = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
        last = np.append(first[1:], low.size) - 1
        place = low[first]
        found.append((h[place].view(np.int64), place + at, first + at, last + at))
    return [np.concatenate(x) for x in zip(*found, strict=True)]


def folded(text: bytes, length: int, gram: int):
    """Anchor runs of a text, equal stretches once, and the window runs that repeat inside it."""
    h, place, first, last = anchors(np.frombuffer(text, np.uint8), length, gram)
    _, back, times = np.unique(h, return_inverse=True, return_counts=True)
    again = np.flatnonzero(times[back] > 1)
    if not again.size:
        return (h, place, first, last), []
    seen, keep, inside = {}, np.ones(h.size, bool), np.zeros(h.size, bool)
    for i in again.tolist():
        p, f, e = int(place[i]), int(first[i]), int(last[i])
        key = (p - f, e - f, text[f:e + length])
        if (one := seen.setdefault(key, i)) != i:
            keep[i] = False
            inside[one] = inside[i] = True
    runs = []
    for i in np.flatnonzero(inside).tolist():
        f, e = int(first[i]), int(last[i])
        if runs and f <= runs[-1][1] + 1:
            runs[-1][1] = max(runs[-1][1], e)
        else:
            runs.append([f, e])
    return (h[keep], place[keep], first[keep], last[keep]), runs


RUN = T.StructType([T.StructField("digest", T.BinaryType()), T.StructField("gram", T.LongType()), T.StructField("place", T.IntegerType()),
                    T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType())])


def anchor_runs(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """Anchor runs of all texts (digest, body); rows with a null gram are runs that repeat inside their text."""
    def per_batch(batch):
        out = {f.name: [] for f in RUN}
        done = set()
        for digest, body in zip(batch["digest"], batch["body"], strict=True):
            if digest in done:
                continue
            done.add(digest)
            found, runs = folded(body, length, gram)
            n = found[0].size
            out["digest"] += [digest] * (n + len(runs))
            for name, x in zip(("gram", "place", "first", "last"), found, strict=True):
                out[name] += x.tolist()
            out["gram"] += [None] * len(runs)
            out["place"] += [None] * len(runs)
            out["first"] += [r[0] for r in runs]
            out["last"] += [r[1] for r in runs]
        return out

    return map_rows(texts, RUN, per_batch)


STRETCH = T.StructType([T.StructField("gram", T.LongType()), T.StructField("hot", T.BooleanType()), T.StructField("digest", T.BinaryType()),
                        T.StructField("first", T.IntegerType()), T.StructField("before", T.IntegerType()),
                        T.StructField("windows", T.IntegerType()), T.StructField("body", T.BinaryType())])
SPAN = T.StructType([T.StructField("digest", T.BinaryType()), T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType())])


def stretches(texts: DataFrame, runs: DataFrame, length: int) -> DataFrame:
    """The bytes of every run's windows; texts and runs meet by digest."""
    listed = runs.groupBy("digest").agg(F.collect_list(F.struct("gram", "hot", "place", "first", "last")).alias("runs"))

    def per_batch(batch):
        out = {f.name: [] for f in STRETCH}
        for digest, body, found in zip(batch["digest"], batch["body"], batch["runs"], strict=True):
            for r in found:
                row = (r["gram"], r["hot"], digest, r["first"], r["place"] - r["first"], r["last"] - r["first"] + 1, body[r["first"]:r["last"] + length])
                for f, v in zip(STRETCH, row, strict=True):
                    out[f.name].append(v)
        return out

    return map_rows(texts.join(listed, "digest").select("digest", "body", "runs"), STRETCH, per_batch)


def repeated_windows(group: np.ndarray, before: np.ndarray, windows: np.ndarray, bodies: list, length: int, gram: int) -> np.ndarray:
    """Which windows of each row (columns: place relative to the anchor) occur in another row of its group.

    ``group`` ascends. The rows' anchors are in column ``length - gram``.
    """
    anchor, n = length - gram, len(bodies)
    cells = np.zeros((2 * anchor + gram, n), np.uint16)  # by column; 0 is no symbol
    for i, body in enumerate(bodies):
        at = anchor - before[i]
        cells[at:at + len(body), i] = np.frombuffer(body, np.uint8)
    sizes = np.fromiter(map(len, bodies), np.int64, n)
    column = np.arange(cells.shape[0])[:, None]
    filled = (column >= anchor - before) & (column < anchor - before + sizes)
    cells += filled
    order, common = np.arange(n), np.zeros(n + 1, np.int32)   # common[i]: of rows i - 1 and i in this order
    starts = anchor - before
    ends = starts + windows
    hit = np.zeros((n, anchor + 1), bool)
    base = group.astype(np.int64) * 257
    for c in range(cells.shape[0] - 1, -1, -1):
        key = base[order] + cells[c][order]
        if (key[1:] >= key[:-1]).all():
            by, same = None, key[1:] == key[:-1]
            grown = np.where(same, common[1:n] + 1, 0)
        else:
            by = np.argsort(key, kind="stable")
            key = key[by]
            same = key[1:] == key[:-1]
            grown = np.zeros(n - 1, np.int32)
            i = np.flatnonzero(same)
            if i.size:
                left, right = by[i], by[i + 1]
                # the common prefix of two rows is the least of all between them in the order before
                grown[i] = np.minimum.reduceat(common, np.stack([left + 1, right + 1], 1).ravel())[::2] + 1
            order = order[by]
        grown[key[1:] % 257 == 0] = 0
        common[1:n] = grown
        if c <= anchor:
            near = np.maximum(common[:-1], common[1:]) >= length
            rows = order[near]
            hit[rows, c] = (starts[rows] <= c) & (c < ends[rows])
    return hit


def sorted_spans(cold: DataFrame, length: int, gram: int, rows: int) -> DataFrame:
    """Window runs that occur in another stretch of the same anchor."""
    dealt = cold.repartition(tasks(cold.sparkSession), "gram").sortWithinPartitions("gram")
    anchor = length - gram

    def flush(held):
        grams, first, before, windows = (np.array(held[k]) for k in ("gram", "first", "before", "windows"))
        change = np.concatenate([[0], np.cumsum(grams[1:] != grams[:-1])])
        paired = np.bincount(change)[change] > 1
        at = np.flatnonzero(paired)
        if not at.size:
            return
        group = np.unique(change[at], return_inverse=True)[1]
        hit = repeated_windows(group, before[at], windows[at], [held["body"][i] for i in at.tolist()], length, gram)
        edge = np.diff(np.pad(hit, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        row, begin = np.nonzero(edge == 1)
        _, end = np.nonzero(edge == -1)
        shift = first[at][row] - (anchor - before[at][row])
        yield pa.RecordBatch.from_arrays([pa.array([held["digest"][i] for i in at[row].tolist()], pa.binary()),
                                          pa.array((begin + shift).astype(np.int32)), pa.array((end - 1 + shift).astype(np.int32))],
                                         names=["digest", "first", "last"])

    def run(batches):
        held = {k: [] for k in ("gram", "digest", "first", "before", "windows", "body")}
        for b in batches:
            for piece in (b.slice(i, 4096) for i in range(0, b.num_rows, 4096)):
                for k in held:
                    held[k] += piece.column(piece.schema.get_field_index(k)).to_pylist()
                if len(held["gram"]) >= rows:
                    end = len(held["gram"])
                    while end and held["gram"][end - 1] == held["gram"][-1]:
                        end -= 1
                    if end:
                        yield from flush({k: v[:end] for k, v in held.items()})
                        held = {k: v[end:] for k, v in held.items()}
        if held["gram"]:
            yield from flush(held)

    return dealt.select("gram", "digest", "first", "before", "windows", "body").mapInArrow(run, SPAN)


def counted_spans(hot: DataFrame, length: int) -> DataFrame:
    """The same for anchors with very many stretches: windows by 128-bit hash, counted with partial sums."""
    schema = T.StructType([*SPAN.fields[:2], T.StructField("window", T.BinaryType())])

    def per_batch(batch):
        out = {"digest": [], "first": [], "window": []}
        for digest, first, n, body in zip(batch["digest"], batch["first"], batch["windows"], batch["body"], strict=True):
            out["digest"] += [digest] * n
            out["first"] += range(first, first + n)
            out["window"] += [hashlib.blake2b(body[i:i + length], digest_size=16).digest() for i in range(n)]
        return out

    windows = map_rows(hot.select("digest", "first", "windows", "body"), schema, per_batch)
    twice = windows.groupBy("window").agg(F.count("*").alias("n")).filter("n > 1").select("window")
    return windows.join(twice, "window", "left_semi").select("digest", "first", F.col("first").alias("last"))


RESULT = T.StructType([T.StructField("digest", T.BinaryType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()),
                       T.StructField("kept_sha256", T.StringType())])


def cut_out(body: bytes, runs: list, length: int) -> tuple[int, list[tuple[int, int]]]:
    """Bytes removed and the maximal byte spans that cover all repeated windows (``runs`` of first and last start)."""
    spans: list[list[int]] = []
    for f, e in sorted(runs):
        if spans and f <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], e + length)
        else:
            spans.append([f, e + length])
    return sum(e - f for f, e in spans), [(f, e) for f, e in spans]


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, split: int = SPLIT, rows: int = ROWS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("body"))
    docs = docs.withColumn("n_bytes", F.octet_length("body").cast("long"))
    long = docs.filter(F.col("n_bytes") >= length).select(F.unhex(F.sha2("body", 256)).alias("digest"), "body")
    runs = saved(anchor_runs(long, length, gram), "anchors")
    mark = F.xxhash64("digest", "place")
    often = (runs.filter("gram is not null").groupBy("gram").agg(F.min(mark).alias("a"), F.max(mark).alias("b"), F.count("*").alias("n"))
             .filter("a <> b").select("gram", (F.col("n") > split).alias("hot")))
    shared = runs.join(often, "gram").distinct()
    texts = long.groupBy("digest").agg(F.min("body").alias("body"), F.count("*").alias("copies"))
    found = saved(stretches(texts.select("digest", "body"), shared, length), "stretches")
    spans = sorted_spans(found.filter("not hot"), length, gram, rows).union(counted_spans(found.filter("hot"), length)) \
        .union(runs.filter("gram is null").select("digest", "first", "last"))
    listed = spans.groupBy("digest").agg(F.collect_set(F.struct("first", "last")).alias("runs"))
    once = texts.filter("copies = 1").join(listed, "digest").select("digest", "body", "runs")

    def per_batch(batch):
        out = {f.name: [] for f in RESULT}
        for digest, body, found_runs in zip(batch["digest"], batch["body"], batch["runs"], strict=True):
            n, gone = cut_out(body, [(r["first"], r["last"]) for r in found_runs], length)
            kept, at = hashlib.sha256(), 0
            for f, e in [*gone, (len(body), len(body))]:
                kept.update(body[at:f])
                at = e
            for name, v in zip(out, (digest, n, len(gone), kept.hexdigest()), strict=True):
                out[name].append(v)
        return out

    copies = long.groupBy("digest").count().filter("count > 1").select("digest", F.lit(-1).cast("long"), F.lit(1).cast("long"), F.sha2(F.lit(""), 256))
    result = map_rows(once, RESULT, per_batch).union(copies)
    keyed = docs.select("doc_id", "n_bytes", F.sha2("body", 256).alias("whole"))
    joined = keyed.join(result.withColumn("digest", F.lower(F.hex("digest"))), F.col("whole") == F.col("digest"), "left")
    return joined.select("doc_id", "n_bytes",
                         F.when(F.col("n_removed") < 0, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
                         F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"), F.coalesce("kept_sha256", "whole").alias("kept_sha256"))
