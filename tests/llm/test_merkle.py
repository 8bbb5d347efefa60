import hashlib
import random
import re

from pyspark.sql import functions as F

from txnrisk.llm import merkle as M
from txnrisk.llm.common import read_table

SF = "/root/testdata/sf0.01"


def edited(rows):
    """(doc_id, n_chars, sha256 of the edited text) by the definition, for distinct ids."""
    order = sorted(rows, key=lambda r: -r[0])
    out = []
    for i, (d, t) in enumerate(order):
        t, follows, n = t or "", order[(i + 1) % len(order)][1] or "", len(t or "") // 3
        out.append((d, len(t), hashlib.sha256((t[:len(t) - n] + follows[:n]).encode()).hexdigest()))
    return sorted(out)


def test_edits_of_the_whole_table(spark):
    docs = read_table(spark, SF, "documents")
    got = M.edited_fingerprints(docs).collect()
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(tuple(r)[:3] for r in got) == edited(rows)
    texts, marks = dict(rows), {r.doc_id: r.fingerprint for r in got}
    by_text = {}
    for d, t in texts.items():
        by_text.setdefault(t, set()).add(marks[d])
    assert all(len(m) == 1 for m in by_text.values()) and len(set(marks.values())) == len(by_text)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    long = [r for r in got if r.n_chars > 500]
    assert sum(r.near_edited > 0.5 for r in long) > 0.98 * len(long)
    assert sum(r.near_next < 0.3 for r in long) > 0.9 * len(long)


def test_nulls_repeats_and_clashing_columns(spark):
    docs = spark.createDataFrame([(3, "𝔘nd so weiter", 0), (2, None, 0), (1, "b", 0), (1, "aaa", 0), (1, "aaa", 0), (None, "abcdef", 0)],
                                 "doc_id long, text string, fingerprint int")
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    got = sorted((tuple(r)[:3] for r in M.edited_fingerprints(docs).collect()), key=repr)
    assert got == sorted([(3, 13, sha("𝔘nd so we")), (2, 0, sha("")), (1, 1, sha("b")), (1, 3, sha("aa𝔘")), (1, 3, sha("aa𝔘")), (None, 6, sha("abcd"))], key=repr)
    one = M.edited_fingerprints(docs.filter("doc_id = 3")).first()
    assert one.edited_sha256 == sha("𝔘nd so we" + "𝔘nd ") and one.near_next == 1.0
    assert M.edited_fingerprints(docs.limit(0)).count() == 0


def located(spark, pairs):
    """For every pair of texts: the places of differing paragraphs on either side."""
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "pair long, a string, b string")
    df = M.with_tree(M.with_tree(df, "a", "_a", "fa"), "b", "_b", "fb").select("pair", F.col("fa").alias("a"), F.col("fb").alias("b"))
    found = [{"a": [], "b": []} for _ in pairs]
    for r in M.locate_edits(df).collect():
        found[r.pair][r.side].append((r.section, r.paragraph))
    return [(sorted(f["a"]), sorted(f["b"])) for f in found]


def test_edits_are_located(spark):
    a = "First line of a.\nSecond line.\n\nNew section, one.\nIts end."
    lines = "one\ntwo\nthree\ntwo\nfour"
    pairs = [(a, a.replace("Second", "Changed")), (a, a), ("", a), ("", ""), (None, a),
             (lines, "one\nthree\ntwo\ntwo\nfour"), (lines, "one\ntwo\nthree\nfour"), (lines, lines.replace("four", "two\nfour")),
             ("s\n\nt\n\nu", "t\n\ns\n\nu"), ("s\n\nt\n\nu", "s\n\nu"), ("x\n" * 500, "x\n" * 499),
             ("x\n\n\nfoo\n\n", "\nfoo\n\nx\n\n")]
    want = [([(0, 1)], [(0, 1)]), ([], []), ([], [(0, 0), (0, 1), (0, 2), (1, 0), (1, 1)]), ([], []), ([], [(0, 0), (0, 1), (0, 2), (1, 0), (1, 1)]),
            ([(0, 1), (0, 2)], [(0, 1), (0, 2)]), ([(0, 3)], []), ([], [(0, 4)])]
    got = located(spark, pairs)
    assert got[:8] == want
    assert all(p[0] in (0, 1) for side in got[8] for p in side) and got[8][0] and got[8][1]
    assert {p[0] for p in got[9][0]} == {1} and got[9][1] == [] and got[10] == ([(0, 499)], []) and got[11][0] and got[11][1]


def test_what_is_not_located_is_common(spark):
    """Random edits: without the located paragraphs both texts hold the same ones; equal texts, and only those, have none."""
    rnd = random.Random(4)
    pairs = []
    for _ in range(150):
        a = rnd.choices(["p\n", "q\n", "r\n", "s.\n", "\n"], k=rnd.randint(0, 12))
        b = list(a)
        for _ in range(rnd.randint(0, 3)):
            i = rnd.randint(0, len(b))
            b[i:i + rnd.randint(0, 2)] = rnd.choices(["p\n", "z\n", "\n"], k=rnd.randint(0, 2))
        pairs.append(("".join(a), "".join(b)))
    tree = lambda t: {(i, j): p for i, s in enumerate(re.split(r"(?<=\n\n)", t)) for j, p in enumerate(re.split(r"(?<=\n)", s))}
    for (a, b), (in_a, in_b) in zip(pairs, located(spark, pairs), strict=True):
        assert (a == b) == (not in_a and not in_b), (a, b)
        left = [sorted(p for place, p in tree(t).items() if p and place not in out) for t, out in ((a, in_a), (b, in_b))]
        assert left[0] == left[1], (a, b)


def test_pieces_lose_nothing(spark):
    text = "A b.  C!\n\n\n...x" + "y" * 100 + "\n?é\r\nz"
    df = spark.createDataFrame([(text,)], "t string")
    parts = F.flatten(F.transform(F.split("t", r"(?<=\n\n)"), lambda s: F.flatten(F.transform(F.split(s, r"(?<=\n)"), lambda p: M.pieces(p)))))
    assert df.select(F.array_join(parts, "")).first()[0] == text


def test_the_plan_has_no_python(spark):
    plan = M.edited_fingerprints(read_table(spark, "/root/testdata/sf0.001", "documents"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
