import hashlib
import random
from collections import Counter

import pytest

from txnrisk.llm import repeats

SCHEMA = "doc_id long, text string, n_removed string"


def brute(rows, length):
    bodies = [(t or "").encode() for _, t, _ in rows]
    seen = Counter(b[i:i + length] for b in bodies for i in range(len(b) - length + 1))
    out = []
    for (d, _, _), b in zip(rows, bodies, strict=True):
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        spans = sum(gone[i] and not (i and gone[i - 1]) for i in range(len(b)))
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def made(seed, n=60):
    rnd = random.Random(seed)
    words = ["".join(rnd.choices("abé", k=rnd.randint(1, 5))) for _ in range(60)]
    passage = " ".join(rnd.choices(words, k=20))
    rows = []
    for i in range(n):
        t = " ".join(rnd.choices(words, k=rnd.randint(0, 60)))
        if rnd.random() < 0.4:
            at = rnd.randint(0, len(t))
            t = t[:at] + passage[rnd.randint(0, 9):] + t[at:]
        if rnd.random() < 0.1:
            t = "ab " * rnd.randint(5, 80)
        if rnd.random() < 0.2 and rows:
            t = rnd.choice(rows)[1]
        rows.append((rnd.choice([i, i, None, 3]), t, "x"))
    return [*rows, (None, None, None), (7, "", None)]


@pytest.mark.parametrize("split, chunk", [(1 << 15, 1 << 14), (3, 16), (0, 1)])
def test_against_brute_force(spark, split, chunk):
    rows = made(split + chunk)
    got = repeats.remove_repeats(spark.createDataFrame(rows, SCHEMA), length=24, gram=8, split=split, rows=chunk).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows, 24)


def test_blocks_of_a_long_text(spark, monkeypatch):
    monkeypatch.setattr(repeats, "BLOCK", 1 << 20)
    rnd = random.Random(4)
    part = "".join(rnd.choices("abcdefgh", k=600))
    rows = [(1, "".join(rnd.choices("abcdefgh", k=1_200_000)) + part, ""), (2, part + "zz", "")]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in repeats.remove_repeats(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: (1_200_600, 600, 1), 2: (602, 600, 1)}


def test_passages_of_over_fifty_words(spark):
    rnd = random.Random(9)

    def words(n, size):
        return " ".join("".join(rnd.choices("abcdefgh", k=size)) for _ in range(n))

    long, short = words(60, 8), words(51, 3)       # 539 and 203 bytes: only strings of 400 are repeats
    texts = [f"{words(40, 7)} {x} {words(40, 7)}" for x in (long, long, short, short, "é " + words(60, 8))]
    rows = [(i, t, "") for i, t in enumerate([*texts, f"{long[:300]} {words(9, 5)} {long[300:]}", f"{texts[4][99:520]}!{texts[4][99:520]}"])]
    got = sorted(map(tuple, repeats.remove_repeats(spark.createDataFrame(rows, SCHEMA)).collect()))
    assert got == brute(rows, repeats.LENGTH)
    assert [r[0] for r in got if r[2]] == [0, 1, 4, 6] and [r[1] for r in got] == [len(t.encode()) for _, t, _ in rows]


def test_empty_table(spark):
    assert repeats.remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0
