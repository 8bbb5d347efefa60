"""Spelling variants by a bit-sliced position index.

Words are runs of Latin letters of whole texts, a fixed share of them with
one letter taken out; frequent ones form the vocabulary. Two words are near
if one inserted, deleted or replaced letter makes one the other. A word's
form is its most frequent near word, if that is much more frequent.

The vocabulary is laid into groups, in each of which the words agree but for
one *region*: near words differ in the first or in the second half of the
shorter one, so they agree in the other. A group of more than ``split`` words
has its region halved again, by the same argument, until the groups fit; a
region of one letter holds at most 90 words of the shorter and 90 * 90 of the
longer length. So no frequent beginning or end makes a large group, and none
is cut off.

A group's index has one bitset over its words per position of the region and
letter. A query runs through its own letters once, with two sets at a time:
the words without an error so far and those with one; matches at the shifted
position carry a deleted letter on. Bits stand in order of frequency, so the
lowest bit of the result is the form and its bit count the near words; pairs
are not written. A pair that could be aligned in two regions counts in the
left one only.

Forms are followed to their roots by pointer doubling; frequencies grow at
least ``ratio`` times a step, so chains are short.

Defined results: a null text has no word. A null doc_id is the empty text in
the number that picks the damaged runs. Repeated rows count each. An empty
table, or one without a frequent word, gives no row. Other columns are not
read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txnrisk.llm.audits import CRC32, crc32_sql
from txnrisk.llm.common import discard, saved, tasks

RUN = re.compile("[A-Za-zÀ-ÿ]+")
BREAK = re.compile("[^A-Za-zÀ-ÿ]")
LOWER = {c: c + 32 for c in range(65, 91)}
DAMAGED = 199           # one run of so many, by CRC-32, loses a letter
LETTERS = 6             # code points of a word, at least
OCCURRENCES = 5         # of a word, at least
RATIO = 5               # how much more frequent a form is than the word
SPLIT = 1 << 13         # words of a group above which its region is halved; at least 90 + 90 * 90
HELD = 1 << 17          # words counted in a task before they are passed on
STRETCH = 1 << 20       # code points of a text read at once
KEY = ("m", "lo", "hi", "head", "tail")


def runs(text: str) -> Counter:
    """Maximal runs of letters with their frequencies, A-Z lower-cased."""
    raw, at = Counter(), 0
    while at < len(text):
        cut = BREAK.search(text, at + STRETCH)
        end = cut.start() if cut else len(text)
        raw.update(RUN.findall(text, at, end))
        at = end
    found: Counter = Counter()
    for run, n in raw.items():
        found[run.lower() if run.isascii() else run.translate(LOWER)] += n
    return found


def words_of(doc_id, text: str | None, letters: int) -> Iterator[tuple[str, int]]:
    """(word, occurrences) of one document after damage."""
    seed = crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for run, n in runs(text or "").items():
        h = crc32(run.encode(), seed)
        if h % DAMAGED == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1:]
        if len(run) >= letters:
            yield run, n


def vocabulary(docs: DataFrame, letters: int = LETTERS, occurrences: int = OCCURRENCES) -> DataFrame:
    """(word, n) of the frequent words; counted in each task before the shuffle."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(held, pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                for word, n in words_of(doc_id, text.as_py(), letters):
                    held[word] = held.get(word, 0) + n
                if len(held) >= HELD:
                    yield batch()
                    held = {}
        yield batch()

    return docs.select("doc_id", "text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= occurrences)


def keyed(rows: DataFrame, halves: list[tuple]) -> DataFrame:
    """``rows`` (word, n, m) once per region (lo, hi) of ``halves``, with the letters outside it."""
    x = rows.select("word", "n", "m", F.explode(F.array(*[F.struct(lo.cast("int").alias("lo"), hi.cast("int").alias("hi")) for lo, hi in halves])).alias("r")) \
        .select("word", "n", "m", "r.lo", "r.hi")
    tail = F.col("m") - F.col("hi")
    return x.withColumn("head", F.substring(F.col("word"), F.lit(1), F.col("lo"))) \
        .withColumn("tail", F.when(tail > 0, F.substring(F.col("word"), -tail, tail)).otherwise(""))


def halved(rows: DataFrame) -> DataFrame:
    mid = F.floor((F.col("lo") + F.col("hi")) / 2)
    return keyed(rows, [(F.col("lo"), mid), (mid, F.col("hi"))])


def grouped(words: DataFrame, letters: int = LETTERS, split: int = SPLIT) -> DataFrame:
    """Every word in its groups: those of its own length m, and as the longer word those of m = its length - 1."""
    size = F.length("word")
    x = words.select("word", "n", F.explode(F.array(size, size - 1)).alias("m")).filter(F.col("m") >= letters)
    current = halved(x.select("word", "n", "m", F.lit(0).alias("lo"), F.col("m").alias("hi")))
    ready = []
    while True:
        current = saved(current, "groups")
        large = saved(current.groupBy(*KEY).count().filter((F.col("count") > split) & (F.col("hi") - F.col("lo") > 1)).drop("count"), "large-groups")
        if large.isEmpty():
            return reduce(DataFrame.unionByName, [*ready, current])
        ready.append(current.join(large, [*KEY], "left_anti").select(current.columns))
        current = halved(current.join(large, [*KEY], "left_semi").select(current.columns))


class Index:
    """Bitsets over the shorter words of a group: ``at[i][c]`` has those with letter c at place i of the region."""

    def __init__(self, regions: list[str]):
        self.all = (1 << len(regions)) - 1
        rows: list[dict[str, list[int]]] = [{} for _ in regions[0]] if regions else []
        for j, region in enumerate(regions):
            for i, c in enumerate(region):
                rows[i].setdefault(c, []).append(j)
        self.at = [{c: self.bits(js) for c, js in row.items()} for row in rows]

    @staticmethod
    def bits(places: list[int]) -> int:
        out = bytearray(places[-1] // 8 + 1)
        for j in places:
            out[j >> 3] |= 1 << (j & 7)
        return int.from_bytes(out, "little")

    def replaced(self, region: str) -> int:
        """Words that differ from ``region`` in exactly one letter."""
        none, one = self.all, 0
        for at, c in zip(self.at, region, strict=True):
            bits = at.get(c, 0)
            same = none & bits
            none, one = same, (one & bits) | (none ^ same)
        return one

    def deleted(self, region: str, first_too: bool) -> int:
        """Words that ``region``, one letter longer, becomes by losing a letter; without ``first_too``, not those it becomes by losing the first."""
        none, one, first = self.all, self.all, self.all
        for i, at in enumerate(self.at):
            shifted = at.get(region[i + 1], 0)
            none &= at.get(region[i], 0)
            one, first = (one & shifted) | none, first & shifted
        return one if first_too else one & ~first


def near_in_group(m: int, lo: int, hi: int, words: list[tuple[str, int]]) -> Iterator[tuple[str, int, int, str | None, int | None]]:
    """(word, n, near words, the most frequent one, its n) for the words of a group that have any."""
    short = sorted((w for w in words if len(w[0]) == m), key=lambda w: (-w[1], w[0]))
    long = sorted((w for w in words if len(w[0]) > m), key=lambda w: (-w[1], w[0]))
    if not short or len(words) < 2:
        return
    index = Index([w[lo:hi] for w, _ in short])
    extra: dict[int, list] = {}     # of a short word: how many longer ones are near, and the first
    for word, n in long:
        near = index.deleted(word[lo:hi + 1], lo == 0)
        if near:
            yield (word, n, near.bit_count(), *short[(near & -near).bit_length() - 1])
        while near:
            low = near & -near
            extra.setdefault(low.bit_length() - 1, [0, (word, n)])[0] += 1
            near ^= low
    for j, (word, n) in enumerate(short):
        near, (more, best) = index.replaced(word[lo:hi]), extra.get(j, (0, None))
        if near:
            other = short[(near & -near).bit_length() - 1]
            best = other if best is None else min(best, other, key=lambda w: (-w[1], w[0]))
        if best:
            yield (word, n, near.bit_count() + more, *best)


NEAR = T.StructType([T.StructField("word", T.StringType()), T.StructField("n", T.LongType()), T.StructField("n_near", T.LongType()),
                     T.StructField("near", T.StringType()), T.StructField("near_n", T.LongType())])


def near_words(groups: DataFrame) -> DataFrame:
    """Near words of every word in every group; a task holds one group at a time."""
    from pyspark.sql.pandas.types import to_arrow_schema
    target = to_arrow_schema(NEAR)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, words = None, []
        for b in batches:
            out = []
            columns = [c.to_pylist() for c in b.columns]
            for *here, word, n in zip(*columns, strict=True):
                if here != key:
                    if len(words) > 1:
                        out += near_in_group(*key[:3], words)
                    key, words = here, []
                words.append((word, n))
            yield pa.RecordBatch.from_pylist([dict(zip(NEAR.names, x, strict=True)) for x in out], target)
        if len(words) > 1:
            yield pa.RecordBatch.from_pylist([dict(zip(NEAR.names, x, strict=True)) for x in near_in_group(*key[:3], words)], target)

    return groups.repartition(tasks(groups.sparkSession), *KEY).sortWithinPartitions(*KEY).select(*KEY, "word", "n").mapInArrow(search, NEAR)


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): pointers doubled until none moves."""
    current = saved(forms.select("word", F.col("form").alias("root")), "pointers")
    while True:
        step = current.select(F.col("word").alias("at"), F.col("root").alias("further"))
        following = saved(current.join(step, F.col("root") == F.col("at"), "left").select("word", F.coalesce("further", "root").alias("root"), F.col("at").isNotNull().alias("moved")), "pointers")
        discard(current)
        current = following
        if current.filter("moved").isEmpty():
            return current.select("word", "root")


def variants(docs: DataFrame, letters: int = LETTERS, occurrences: int = OCCURRENCES, ratio: int = RATIO, split: int = SPLIT) -> DataFrame:
    """word, form, root, n, n_near and form_n of every frequent word."""
    words = saved(vocabulary(docs, letters, occurrences), "vocabulary")
    none = words.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("string").alias("near"), F.lit(None).cast("long").alias("near_n"))
    best = F.min(F.when(F.col("near").isNotNull(), F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("word")))).alias("best")
    found = none.unionByName(near_words(grouped(words, letters, split))).groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best)
    is_form = -F.col("best.less") >= ratio * F.col("n")
    table = saved(found.select("word", "n", "n_near", F.when(is_form, F.col("best.word")).alias("form"), F.when(is_form, -F.col("best.less")).alias("form_n")), "forms")
    return table.join(roots(table.filter("form IS NOT NULL")), "word", "left") \
        .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


#: DuckDB: near words by equal results of deleting one letter.
SQL = f"""
WITH RECURSIVE {CRC32}
runs AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS k
         FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents) GROUP BY ALL),
hashed AS (SELECT run, k, {crc32_sql("(coalesce(doc_id::VARCHAR, '') || ':' || run)")} AS h FROM runs, crc_table),
vocabulary AS (SELECT word, sum(k)::BIGINT AS n FROM (
                 SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, k FROM hashed)
               WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5),
shorter AS (SELECT word, n, p, substr(word, 1, p - 1) || substr(word, p + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS p FROM vocabulary)),
pairs AS (SELECT a.word AS a, a.n AS an, b.word AS b, b.n AS bn FROM shorter a JOIN shorter b ON a.rest = b.rest AND a.p = b.p AND a.word <> b.word
          UNION SELECT s.word, s.n, v.word, v.n FROM shorter s JOIN vocabulary v ON s.rest = v.word
          UNION SELECT v.word, v.n, s.word, s.n FROM shorter s JOIN vocabulary v ON s.rest = v.word),
near AS (SELECT a, count(*) AS n_near, min({{'less': -bn, 'word': b}}) AS best FROM pairs GROUP BY a),
forms AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.less >= 5 * n THEN best.word END AS form, CASE WHEN -best.less >= 5 * n THEN -best.less END AS form_n
          FROM vocabulary LEFT JOIN near ON a = word),
chain AS (SELECT word, form AS at FROM forms WHERE form IS NOT NULL
          UNION ALL SELECT c.word, f.form FROM chain c JOIN forms f ON f.word = c.at WHERE f.form IS NOT NULL),
last AS (SELECT c.word, c.at FROM chain c JOIN forms f ON f.word = c.at WHERE f.form IS NULL)
SELECT f.word, form, coalesce(l.at, f.word) AS root, n, n_near, form_n FROM forms f LEFT JOIN last l ON l.word = f.word
"""
