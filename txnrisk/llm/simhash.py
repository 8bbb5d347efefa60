"""SimHash near-duplicates found through deletion-variant signatures.

A 64-bit fingerprint is cut into ``bits // 2 + 1`` segments: fewer than one
per differing bit, so that of two fingerprints at most ``bits`` apart some
segment differs in at most one place. Each fingerprint is indexed under every
one-wildcard variant of every segment; linked fingerprints meet under at
least one variant, where the distance is verified.

Only distinct fingerprints are indexed. A variant's members are linked by a
search that sets aside what it has reached, so a dense group of near copies
gives a spanning tree and not all its pairs. A variant with more than
``split`` members is cut again by the bits outside its segment: into
``bits + 1`` exact pieces, of which one is equal for every linked pair.

Defined results: a null text, or one without a word, has fingerprint zero and
links like any other. Texts shorter than a shingle are one shingle. Rows with
equal fingerprints are one node. A component is named by its smallest
non-null doc_id (null if all are null). Repeated rows each get their own
output row. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txnrisk.llm.common import add_columns, connected, saved, tasks

WORDS = 4          # words in a shingle
BITS = 4           # most differing bits of a link
SEED = 42
SPLIT = 1 << 17    # members of a variant above which it is cut by further bits
CHUNK = 1 << 14    # shingle hashes summed at once
PAIRWISE = 8       # members up to which a variant is compared pair by pair

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def simhash(text: str | None, words: int = WORDS) -> int:
    """Fingerprint of one whole text: a bit is set if over half of the shingle hashes have it."""
    tokens = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not tokens:
        return 0
    joined, digest = b" ".join(tokens), xxhash.xxh64_intdigest
    size = np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(size + 1) - 1
    starts = ends - size
    if len(tokens) < words:
        return digest(joined, SEED)
    ones, n = np.zeros(64, np.int64), len(tokens) - words + 1
    first, last = starts[:n].tolist(), ends[words - 1:].tolist()
    for at in range(0, n, CHUNK):
        hashes = np.array([digest(joined[s:e], SEED) for s, e in zip(first[at:at + CHUNK], last[at:at + CHUNK], strict=True)], ">u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def with_fingerprint(df: DataFrame, name: str, text: str = "text", words: int = WORDS) -> DataFrame:
    """``df`` with its fingerprints as signed BIGINT in column ``name``."""
    added = T.StructType([T.StructField(name, T.LongType())])

    def hashes(texts: list) -> dict[str, list]:
        return {name: pa.array(np.array([simhash(t, words) for t in texts], np.uint64).view(np.int64))}

    return add_columns(df, text, added, hashes)


def segments(n: int, total: int = 64) -> list[tuple[int, int]]:
    """(lowest bit, width) of ``n`` nearly equal pieces."""
    edges = [round(i * total / n) for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def variants(prints: DataFrame, bits: int = BITS) -> DataFrame:
    """One row per fingerprint and one-wildcard variant: the variant's key, the fingerprint and the segment's number.

    A key is the masked segment with the wildcard's number in the bits that
    the mask leaves free at the top or, for the top segment, at the bottom.
    """
    rows = []
    for seg, (low, width) in enumerate(segments(bits // 2 + 1)):
        for j in range(low, low + width):
            mask = ((1 << width) - 1) << low & ~(1 << j)
            tag = j << (0 if low >= 16 else 40)
            rows.append((signed(mask), signed(tag), seg))
    pairs = F.array(*[F.struct(F.lit(m).alias("mask"), F.lit(t).alias("tag"), F.lit(s).alias("seg")) for m, t, s in rows])
    return (prints.select("fp", F.explode(pairs).alias("v"))
            .select(F.col("fp").bitwiseAND(F.col("v.mask")).bitwiseOR(F.col("v.tag")).alias("key"), "fp", F.col("v.seg").alias("seg")))


def pieces(bits: int = BITS) -> list[list[int]]:
    """Per segment ``bits + 1`` masks that cut all bits outside it, of which two fingerprints at most ``bits`` apart agree on one."""
    out = []
    for low, width in segments(bits // 2 + 1):
        outside = [b for b in range(64) if not low <= b < low + width]
        out.append([sum(1 << b for b in outside[at:at + w]) for at, w in segments(bits + 1, len(outside))])
    return out


def signed(x: int) -> int:
    x &= (1 << 64) - 1
    return x - (1 << 64) if x >> 63 else x


def links_within(key: np.ndarray, fp: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of fingerprints that share a key (rows sorted by key) and spanning trees for larger groups."""
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.append(start, key.size))
    out_a, out_b = [], []
    small = np.repeat(size <= PAIRWISE, size)
    for d in range(1, PAIRWISE):
        near = (key[d:] == key[:-d]) & small[d:]
        i = np.flatnonzero(near)
        i = i[np.bitwise_count(fp[i] ^ fp[i + d]) <= bits]
        out_a.append(fp[i])
        out_b.append(fp[i + d])
    for s, n in zip(start[size > PAIRWISE], size[size > PAIRWISE], strict=True):
        rest = fp[s:s + n]
        while rest.size > 1:
            reached, rest = rest[:1], rest[1:]
            while reached.size and rest.size:
                x, reached = reached[0], reached[1:]
                near = np.bitwise_count(rest ^ x) <= bits
                got = rest[near]
                if got.size:
                    out_a.append(np.full(got.size, x))
                    out_b.append(got)
                    reached, rest = np.concatenate([reached, got]), rest[~near]
    return np.concatenate(out_a), np.concatenate(out_b)


LINK = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def compare_groups(keyed: DataFrame, keys: list[str], bits: int) -> DataFrame:
    """Links among the rows of each key group. Groups are whole within a sorted partition; one group is held at a time."""
    dealt = keyed.repartition(tasks(keyed.sparkSession), *keys).sortWithinPartitions(*keys)
    width = len(keys)

    def run(batches):
        held = None
        for b in batches:
            cols = [b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(width + 1)]
            held = cols if held is None else [np.concatenate(p) for p in zip(held, cols, strict=True)]
            change = np.zeros(max(0, held[0].size - 1), bool)
            for c in held[:-1]:
                change |= c[1:] != c[:-1]
            cut = np.flatnonzero(change)
            if cut.size:
                end = int(cut[-1]) + 1
                yield found([c[:end] for c in held])
                held = [c[end:] for c in held]
        if held is not None and held[0].size:
            yield found(held)

    def found(cols):
        group = np.zeros(cols[0].size, np.int64)
        for c in cols[:-1]:
            group[1:] += c[1:] != c[:-1]
        a, b = links_within(np.cumsum(group), cols[-1].view(np.uint64), bits)
        return pa.RecordBatch.from_arrays([pa.array(a.astype(np.uint64).view(np.int64)), pa.array(b.astype(np.uint64).view(np.int64))], names=["a", "b"])

    return dealt.select(*keys, "fp").mapInArrow(run, LINK)


def links(prints: DataFrame, bits: int = BITS, split: int = SPLIT) -> DataFrame:
    """Links (a, b) of distinct fingerprints that connect all pairs at most ``bits`` apart."""
    index = variants(prints, bits)
    sizes = index.groupBy("key").count().filter(F.col("count") > split).select("key")
    large = saved(sizes, "hot-variants")
    if large.isEmpty():
        found = compare_groups(index, ["key"], bits)
    else:
        found = compare_groups(index.join(large, "key", "left_anti"), ["key"], bits)
        masks = F.array(*[F.array(*[F.lit(signed(m)) for m in own]) for own in pieces(bits)])
        hot = (index.join(large, "key", "left_semi").select("key", "fp", F.posexplode(F.get(masks, F.col("seg"))).alias("piece", "mask"))
               .select("key", F.col("piece").cast("long").alias("piece"), F.col("fp").bitwiseAND(F.col("mask")).alias("part"), "fp"))
        found = found.union(compare_groups(hot, ["key", "piece", "part"], bits))
    return found.distinct()


def near_duplicates(docs: DataFrame, bits: int = BITS, words: int = WORDS, split: int = SPLIT) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every document."""
    rows = saved(with_fingerprint(docs.select("doc_id", "text"), "fp", words=words).select("doc_id", "fp"), "fingerprints")
    groups = components(rows, bits, split)
    return (rows.join(groups, "fp")
            .select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"))


def components(rows: DataFrame, bits: int = BITS, split: int = SPLIT) -> DataFrame:
    """(fp, low, root, component_id) of every fingerprint in ``rows`` (doc_id, fp); low is its smallest doc_id, root the component's own key."""
    prints = saved(rows.groupBy("fp").agg(F.min("doc_id").alias("low")), "prints")
    nodes = connected(links(prints.select("fp"), bits, split))
    rooted = prints.join(nodes, prints["fp"] == nodes["node"], "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    names = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    return rooted.join(names, "root").select("fp", "low", "root", "component_id")


def keep_one(docs: DataFrame, bits: int = BITS, words: int = WORDS, split: int = SPLIT) -> DataFrame:
    """The documents with one row of each component: that of the smallest doc_id (null if all are), ties by text.

    All columns pass through. Of rows that tie in both, one stays.
    """
    packed = docs.select(F.struct("*").alias("row"), F.col("text").alias("text"), F.col("doc_id").alias("doc_id"))
    rows = saved(with_fingerprint(packed, "fp", words=words).drop("text"), "simhash-rows")
    # by fingerprint and doc_id, so the copies of one text are no hot key
    named = (components(rows.select("doc_id", "fp"), bits, split).filter(F.col("low").eqNullSafe(F.col("component_id")))
             .select(F.col("fp").alias("named_fp"), "low", "root"))
    first = rows.join(named, (F.col("fp") == F.col("named_fp")) & F.col("doc_id").eqNullSafe(F.col("low")))
    # mostly one row of a component is left by now; the aggregate picks the smallest text where ids repeat
    return (first.groupBy("root").agg(F.min_by("row", F.coalesce("row.text", F.lit(""))).alias("row"))
            .select("row.*"))
