"""Document fingerprints: a Merkle tree over sections, paragraphs and pieces.

A text is cut, without losing a character, into sections (after an empty
line), sections into paragraphs (after a line break), paragraphs into pieces
(after the end of a sentence, or 32 code points on). Pieces are hashed, and
every node above is the hash of its children in order. So equal roots mean
equal texts; where two trees differ, only the differing branches have to be
followed to find the edit.

Everything here is built-in column expressions.

Defined results: a null text is the empty text, whose tree has no leaf.
Rows that share a doc_id share their next document: the next smaller id and,
if that id repeats too, its smallest text. A null doc_id has no place in the
order: its row is edited against the empty text. With one id only, a document
is its own next. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txnrisk.llm.common import numbered, saved

PIECE = 32      # most code points in a piece before its closing punctuation
LEAF = 8        # hex digits of a piece's hash
NODE = 16       # hex digits of a paragraph's or section's hash


def pieces(paragraph: Column, longest: int = PIECE) -> Column:
    return F.regexp_extract_all(paragraph, F.lit(rf"(?s)[^.!?\n]{{1,{longest}}}[.!?\n]*|[.!?\n]+"), F.lit(0))


def digest(x: Column, digits: int) -> Column:
    return F.substring(F.sha2(x, 256), 1, digits)


def leaf_hex(piece: Column) -> Column:
    return F.lower(F.right(F.lpad(F.hex(F.xxhash64(piece)), 16, "0"), F.lit(LEAF)))


def tree(text: Column, longest: int = PIECE) -> Column:
    """Array of sections, each an array of paragraphs, each an array of piece hashes."""
    return F.transform(F.split(text, r"(?<=\n\n)"), lambda section: F.transform(
        F.split(section, r"(?<=\n)"), lambda paragraph: F.transform(pieces(paragraph, longest), leaf_hex)))


def fingerprint(text: Column, nested: Column) -> Column:
    """``root:section;section``, a section being ``hash(paragraph,paragraph)`` and a paragraph ``hash=leaves``.

    The root also takes in the whole text, so that it is exact even where two
    pieces should share their short hash.
    """
    paragraphs = F.transform(nested, lambda section: F.transform(
        section, lambda leaves: F.concat(digest(F.array_join(leaves, ","), NODE), F.lit("="), F.array_join(leaves, ""))))
    body = F.transform(paragraphs, lambda section: F.concat(
        digest(F.array_join(F.transform(section, lambda p: F.substring(p, 1, NODE)), ","), NODE),
        F.lit("("), F.array_join(section, ","), F.lit(")")))
    sections = F.array_join(F.transform(body, lambda s: F.substring(s, 1, NODE)), ",")
    return F.concat(F.sha2(F.concat(F.sha2(text, 256), F.lit(":"), sections), 256), F.lit(":"), F.array_join(body, ";"))


def leaves(nested: Column) -> Column:
    return F.flatten(F.flatten(nested))


def likeness(a: Column, b: Column) -> Column:
    """Dice likeness (0 to 1) of two trees' distinct leaves; two empty trees are alike."""
    shared = F.size(F.array_intersect(a, b))
    both = F.size(F.array_distinct(a)) + F.size(F.array_distinct(b))
    return F.when(both == 0, F.lit(1.0)).otherwise(2.0 * shared / both)


def with_tree(df: DataFrame, text: str, nested: str, mark: str) -> DataFrame:
    """``df`` with the tree of column ``text`` and its fingerprint."""
    return df.withColumn(nested, tree(F.col(text))).withColumn(mark, fingerprint(F.col(text), F.col(nested)))


def parse(mark: Column) -> Column:
    """A fingerprint's paragraphs in order: (section, section_hash, paragraph, hash, leaves)."""
    sections = F.filter(F.split(F.substring_index(mark, ":", -1), ";"), lambda s: s != "")
    return F.flatten(F.transform(sections, lambda s, i: F.transform(
        F.split(F.substring_index(F.substring_index(s, "(", -1), ")", 1), ","), lambda p, j: F.struct(
            i.alias("section"), F.substring_index(s, "(", 1).alias("section_hash"), j.alias("paragraph"),
            F.substring_index(p, "=", 1).alias("hash"), F.substring_index(p, "=", -1).alias("leaves")))))


def differing(nodes: DataFrame) -> DataFrame:
    """Nodes (pair, side, place, hash, ...) that are not the same in both sides' order.

    The k-th node of a hash on one side belongs to the k-th of that hash on the
    other. Nodes without such a partner differ, and so do partners that are not
    equally far along among the nodes with one. One side's nodes of one pair
    are ordered together: the parts of one text.
    """
    one, both = ["pair", "hash", "_k"], ["pair", "side", "_paired"]
    nodes = nodes.withColumn("_k", F.row_number().over(Window.partitionBy("pair", "side", "hash").orderBy("place")))
    nodes = nodes.withColumn("_paired", F.count("*").over(Window.partitionBy(*one)) == 2)
    nodes = nodes.withColumn("_at", F.row_number().over(Window.partitionBy(*both).orderBy("place")))
    apart = F.min("_at").over(Window.partitionBy(*one)) != F.max("_at").over(Window.partitionBy(*one))
    return nodes.withColumn("_apart", apart).filter("not _paired or _apart").drop("_k", "_paired", "_at", "_apart")


def locate_edits(pairs: DataFrame) -> DataFrame:
    """Where two texts differ, from (pair, a, b): their fingerprints under a pair's id, each id once.

    Returns (pair, side, section, paragraph, hash), a row per paragraph of side
    ``a`` or ``b`` that differs from the other in order and multiplicity:
    swapped, moved, added and removed paragraphs, repeats included. Only
    differing branches are followed: pairs of equal roots end at once, then
    sections are compared, then the paragraphs of sections that differ; where
    only the sections' order tells two texts apart, all of these. A null
    fingerprint has no paragraph, and one without text differs from nothing.
    """
    root = lambda mark: F.substring_index(mark, ":", 1)
    pairs = pairs.filter(~root(F.col("a")).eqNullSafe(root(F.col("b"))))
    sides = F.explode(F.array(*[F.struct(F.lit(x).alias("side"), parse(F.col(x)).alias("paragraphs")) for x in ("a", "b")])).alias("s")
    paragraphs = pairs.select("pair", sides).select("pair", "s.side", F.explode("s.paragraphs").alias("p")).filter("p.leaves <> ''") \
        .select("pair", "side", "p.section", "p.paragraph", "p.hash", "p.section_hash")
    sections = paragraphs.filter("paragraph = 0").select("pair", "side", F.col("section").alias("place"), F.col("section_hash").alias("hash"))
    followed = differing(sections).select("pair", "side", F.col("place").alias("section"))
    below = paragraphs.join(followed, ["pair", "side", "section"]).withColumn("place", F.struct("section", "paragraph"))
    found = differing(below)
    moved = below.join(found.select("pair").distinct(), "pair", "left_anti")
    return found.unionByName(moved).select("pair", "side", "section", "paragraph", "hash")


def next_ids(docs: DataFrame) -> DataFrame:
    """(doc_id, before): for every distinct non-null id, the id that it is next to in descending order, the first again after the last."""
    ids, n = numbered(docs.select("doc_id").filter("doc_id is not null").distinct(), [F.col("doc_id").desc()], "_n", "ids")
    ids = saved(ids, "ids")
    following = ids.select(F.col("doc_id").alias("before"), F.pmod(F.col("_n") + 1, F.lit(max(n, 1))).alias("_n"))
    return ids.join(following, "_n").select("doc_id", "before")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every document and of its edited text, and how alike the first is to the second and to the next document's.

    The edited text is the document with its last third replaced by as much of
    the beginning of the next document in descending doc_id order.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    named = docs.filter("doc_id is not null")
    # both joins read one shuffle of the texts by doc_id; only the next texts are shuffled again
    following = (named.join(next_ids(docs), "doc_id").groupBy("before").agg(F.min("text").alias("next_text")))
    rows = named.join(following, named["doc_id"] == following["before"], "left").drop("before") \
        .union(docs.filter("doc_id is null").select("doc_id", "text", F.lit("").alias("next_text")))
    rows = rows.withColumn("next_text", F.coalesce("next_text", F.lit(""))).withColumn("n_chars", F.length("text").cast("long"))
    rows = rows.withColumn("edited", F.concat(F.expr("substring(text, 1, cast(n_chars - n_chars div 3 as int))"),
                                              F.expr("substring(next_text, 1, cast(n_chars div 3 as int))")))
    rows = with_tree(rows, "text", "_tree", "fingerprint")
    rows = with_tree(rows, "edited", "_edited_tree", "edited_fingerprint")
    rows = rows.withColumn("_leaves", leaves(F.col("_tree"))).withColumn("_edited_leaves", leaves(F.col("_edited_tree"))) \
        .withColumn("_next_leaves", leaves(tree(F.col("next_text"))))
    return rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
                       likeness(F.col("_leaves"), F.col("_edited_leaves")).alias("near_edited"),
                       likeness(F.col("_leaves"), F.col("_next_leaves")).alias("near_next"))
