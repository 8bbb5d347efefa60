import random
import re
from collections import Counter
from zlib import crc32

import duckdb
import pytest

from txnrisk.llm import spelling as S
from txnrisk.llm.common import read_table
from txnrisk.llm.queries import op12_spelling_variants

SF = "/root/testdata/sf0.01"


def near(a, b):
    """One inserted, deleted or replaced letter, by trying all."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(rows, letters=6, occurrences=5, ratio=5):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= letters:
                counts[run] += 1
    words = {w: n for w, n in counts.items() if n >= occurrences}
    close = {w: sorted((-words[x], x) for x in words if near(w, x)) for w in words}
    form = {w: c[0][1] if c and -c[0][0] >= ratio * words[w] else None for w, c in close.items()}

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted((w, form[w], root(w), n, len(close[w]), words.get(form[w])) for w, n in words.items())


def dense_rows(seed, words=60):
    """Few letters, so that most words have many near ones and double letters that align in several ways."""
    rnd = random.Random(seed)
    base = ["".join(rnd.choices("abÉ", k=rnd.randint(6, 9))) for _ in range(words)] + ["aaaaaa", "aaaaaaa", "aaaaaaaa", "aabbaabb", "aabbbaabb"]
    rows = [(None, None), (1, ""), (2, "Short x"), (3, "Überß×÷ÿÀ " * 7), (4, "IİK" * 9)]
    for i in range(40):
        rows.append((rnd.choice([i, i, None]), " ".join(rnd.choice(base).upper() if rnd.random() < 0.2 else rnd.choice(base) for _ in range(200))))
    return rows + [(50, "é-".join(["aaaaaab"] * 900)), (51, "verylong" * 300), (52, "verylong" * 300 + "x " + ("verylong" * 300 + " ") * 40 + (("verylong" * 300)[1:] + ",") * 6)]


@pytest.mark.parametrize("split", [S.SPLIT, 12, 1])
def test_variants_against_brute_force(spark, split):
    rows = dense_rows(split)
    docs = spark.createDataFrame([(d, t, 1, "x", 2) for d, t in rows], "doc_id long, text string, n int, Word string, m int").repartition(6)
    got = S.variants(docs, split=split).collect()
    assert got[0].__fields__ == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted(map(tuple, got)) == brute(rows)


def test_groups_are_split_until_they_fit(spark):
    words = spark.createDataFrame([("prefix" + a + b + c, 5) for a in "abcdefgh" for b in "abcdefgh" for c in "abcdefgh"], "word string, n long")
    sizes = {(r["lo"], r["hi"], r["head"], r["tail"], r["m"]): r["count"] for r in S.grouped(words, split=20).groupBy(*S.KEY).count().collect()}
    assert max(n for (lo, hi, *_), n in sizes.items() if hi - lo > 1) <= 20
    pairs = S.near_words(S.grouped(words, split=20)).groupBy("word").agg({"n_near": "sum"}).collect()
    assert {r[1] for r in pairs} == {21} and len(pairs) == 512


def test_chains_lead_to_one_root(spark):
    forms = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(27)] + [("x", "w3")], "word string, form string")
    assert {tuple(r) for r in S.roots(forms).collect()} == {(f"w{i}", "w27") for i in range(27)} | {("x", "w27")}


def test_long_texts_in_stretches_and_empty_tables(spark, monkeypatch):
    text = " ".join(random.Random(4).choices(["Alpha", "beta", "Éclair", "x"], k=500))
    whole = S.runs(text)
    monkeypatch.setattr(S, "STRETCH", 9)
    assert S.runs(text) == whole
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert S.variants(docs).collect() == []
    assert S.variants(spark.createDataFrame([(1, "seldom words here")], docs.schema)).collect() == []


def test_whole_table_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got = sorted(map(tuple, op12_spelling_variants(spark, SF).collect()))
    assert got == sorted(con.execute(S.SQL).fetchall())
    assert len(got) > 1000 and any(r[5] for r in got)
    rows = [(r["doc_id"], r["text"]) for r in read_table(spark, SF, "documents").limit(60).collect()]
    small = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, S.variants(small).collect())) == brute(rows)
