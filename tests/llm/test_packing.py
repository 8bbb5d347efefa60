import random
from bisect import bisect_left, insort
from collections import defaultdict
from zlib import crc32

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from txnrisk.llm import packing as P
from txnrisk.llm.common import read_table
from txnrisk.llm.queries import op13_best_fit_packing

SF = "/root/testdata/sf0.01"
ODD = ["", " \t\n", "It's a TEST, isn't it?  we'll 'tis ''s \x1c\x1d x\u0085y z", "<|endoftext|> and <|startoftext|>", "İstanbul ǅ ß ŉ",
       "ΣΊΣΥΦΟΣ ϐ", "é ́ ä", "漢字かな 12 ①½ _under_score", "emoji 👩‍👧 ok", "x" * 5000, "1234567890" * 50, "\x00 a\x00b"]


def plain_ids(texts):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(P.default_tokenizer())
    t.encode_special_tokens = True
    return [e.ids + [0] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def plain_best_fit(lengths, capacity):
    """Piece by piece: the number of sequences and the sorted contents."""
    rooms, held = [], []
    for n in sorted(lengths, reverse=True):
        at = bisect_left(rooms, (n, -1))
        room, k = rooms.pop(at) if at < len(rooms) else (capacity, len(held))
        if k == len(held):
            held.append([])
        held[k].append(n)
        if room > n:
            insort(rooms, (room - n, k))
    return len(held), sorted(map(tuple, held))


def check(rows, texts, capacity):
    """Every piece by the tokenizer itself; sequences gapless and within capacity."""
    ids = dict(zip(texts, plain_ids(texts.values()), strict=True))
    got, filled = defaultdict(list), defaultdict(list)
    for r in rows:
        got[r["doc_id"]].append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
        filled[r["sequence_id"]].append((r["offset"], r["length"]))
    for d, x in ids.items():
        want = [(i, s, len(x[s:s + capacity]), crc32(np.array(x[s:s + capacity], "<u4").tobytes())) for i, s in enumerate(range(0, len(x), capacity))]
        assert sorted(got.pop(d)) == want, d
    assert not got
    for parts in filled.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= capacity
    return plain_best_fit([r["length"] for r in rows], capacity), (len(filled), sorted(tuple(sorted((n for _, n in x), reverse=True)) for x in filled.values()))


@given(st.lists(st.integers(1, 40), max_size=120), st.integers(40, 64))
@settings(max_examples=300, deadline=None)
def test_plan_equals_best_fit_decreasing_piece_by_piece(lengths, capacity):
    counts = {n: lengths.count(n) for n in lengths}
    plan = P.best_fit_plan(counts, capacity)
    ordered = np.array(sorted(lengths, reverse=True), np.int64)
    sequence, offset = P.placed(np.arange(len(ordered)), plan) if lengths else (ordered, ordered)
    filled = defaultdict(list)
    for s, o, n in zip(sequence.tolist(), offset.tolist(), ordered.tolist(), strict=True):
        filled[s].append((o, n))
    for parts in filled.values():
        ends = np.cumsum([n for _, n in sorted(parts)])
        assert [o for o, _ in sorted(parts)] == [0, *ends[:-1].tolist()] and ends[-1] <= capacity
    n, _ = plain_best_fit(lengths, capacity)
    assert len(filled) == n
    assert set(filled) == set(range(n))


def test_tightest_room_against_a_scan():
    rnd, rooms, open_ = random.Random(3), P.Rooms(100), [0] * 101
    for _ in range(3000):
        r = rnd.randint(1, 100)
        if open_[r] and rnd.random() < 0.7:
            open_[r] -= 1
            rooms.add(r, -1)
        elif rnd.random() < 0.2:
            open_[r] += 1
            rooms.add(r, 1)
        least = rnd.randint(1, 100)
        assert rooms.tightest(least) == next((i for i in range(least, 101) if open_[i]), None)


@pytest.mark.parametrize("stretch, known", [(1 << 20, 1 << 18), (7, 20)])
def test_ids_are_the_tokenizers(monkeypatch, stretch, known):
    monkeypatch.setattr(P, "STRETCH", stretch)
    monkeypatch.setattr(P, "KNOWN", known)
    words = P.Words(P.default_tokenizer())
    rnd = random.Random(5)
    texts = ODD + ["".join(rnd.choices("abÀé'st.,!?0 19\n\t _-ɏĲŉ", k=rnd.randint(1, 300))) for _ in range(400)]
    for text, ids in zip(texts, plain_ids(texts), strict=True):
        assert b"".join(words.ids(x) for x in P.stretches(text)) + P.END == np.array(ids, "<u4").tobytes(), text


def test_odd_rows(spark):
    texts = dict(enumerate(ODD)) | {100: None, 101: "word " * 3000, 102: " ".join(["ab"] * 2047), 103: " ".join(["ab"] * 2048)}
    docs = spark.createDataFrame([(d, t, 1, "x", 2) for d, t in texts.items()], "doc_id int, text string, length int, Piece string, _row int")
    got = P.pack(docs).collect()
    assert got[0].__fields__ == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    plain, packed = check(got, texts, P.CAPACITY)
    assert plain == packed
    same = spark.createDataFrame([(7, "one two three")] * 900 + [(None, None)] * 3, "doc_id long, text string")
    rows = P.pack(same, capacity=16).collect()
    assert len(rows) == 903 and len({(r["sequence_id"], r["offset"]) for r in rows}) == 903
    assert len({r["sequence_id"] for r in rows}) == 225 + 1
    assert P.pack(docs.limit(0)).collect() == []


def test_whole_table(spark):
    texts = {r["doc_id"]: r["text"] for r in read_table(spark, SF, "documents").collect()}
    plain, packed = check(op13_best_fit_packing(spark, SF).collect(), texts, P.CAPACITY)
    assert plain[0] == packed[0]
    small = read_table(spark, SF, "documents")
    plain, packed = check(P.pack(small, capacity=64).collect(), texts, 64)
    assert plain[0] == packed[0]
