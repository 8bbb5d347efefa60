import random

import pytest
import xxhash

from txnrisk.llm import simhash as S
from txnrisk.llm.common import read_table

SF = "/root/testdata/sf0.01"


def plain(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i:i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute(rows, bits=4):
    prints = [plain(t) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= bits and group[i] != group[j]:
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    low = {}
    for (d, _), g in zip(rows, group, strict=True):
        if d is not None:
            low[g] = min(low.get(g, d), d)
    return sorted(((d, f"{p:016x}", low.get(g)) for (d, _), p, g in zip(rows, prints, group, strict=True)), key=repr), group


def near_rows(n, seed):
    rnd = random.Random(seed)
    base = [" ".join(rnd.choices("alpha Beta gamma\tdelta epsilon zeta eta".split(), k=40)) for _ in range(6)]
    rows = [(None, None), (None, ""), (900, " \n"), (901, "one two"), (902, "One  two"), (None, "one two")]
    for i in range(n):
        words = rnd.choice(base).split()
        for _ in range(rnd.randint(0, 2)):
            words[rnd.randrange(len(words))] = rnd.choice(["x", "y", "Ünï"])
        rows.append((rnd.choice([i, i, i, None]), " ".join(words)))
    return rows


@pytest.mark.parametrize("split, pairwise", [(1 << 17, 8), (5, 3), (0, 2)])
def test_components_against_brute_force(spark, monkeypatch, split, pairwise):
    monkeypatch.setattr(S, "PAIRWISE", pairwise)
    rows = near_rows(150, split)
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, fingerprint int")
    want, group = brute(rows)
    got = S.near_duplicates(docs, split=split).collect()
    assert sorted(map(tuple, got), key=repr) == want
    kept = S.keep_one(docs, split=split)
    best = {}
    for (d, t), g in zip(rows, group, strict=True):
        best[g] = min(best.get(g, (2,)), (d is None, d or 0, t or ""))
    assert kept.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in kept.collect()) == sorted(best.values())


def test_whole_table_against_brute_force(spark):
    docs = read_table(spark, SF, "documents").select("doc_id", "text")
    want, _ = brute([tuple(r) for r in docs.collect()])
    assert sorted(map(tuple, S.near_duplicates(docs).collect()), key=repr) == want


def test_fingerprint_of_a_long_text_in_chunks(monkeypatch):
    text = " ".join(random.Random(1).choices("abc De fgh ijk L".split(), k=999))
    monkeypatch.setattr(S, "CHUNK", 7)
    assert S.simhash(text) == plain(text)


def test_chain_is_one_component(spark):
    prints = [0]
    for i in range(30):
        prints.append(prints[-1] ^ 0b11 << 2 * i)
    rows = spark.createDataFrame([(100 - i, S.signed(p)) for i, p in enumerate(prints)], "doc_id long, fp long")
    assert {r.component_id for r in S.components(rows).collect()} == {70}


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert S.near_duplicates(docs).count() == 0 and S.keep_one(docs).count() == 0


@pytest.mark.parametrize("bits", [2, 3, 4, 7])
def test_pieces_lie_outside_their_segment(bits):
    for (low, width), masks in zip(S.segments(bits // 2 + 1), S.pieces(bits), strict=True):
        own = ((1 << width) - 1) << low
        assert len(masks) == bits + 1 and all(masks)
        assert sum(masks) == (1 << 64) - 1 - own and sum(m.bit_count() for m in masks) == 64 - width     # disjoint, whole, none inside


def test_no_piece_keeps_a_hot_group_whole(spark):
    rnd = random.Random(8)
    (low, width), segment = S.segments(3)[0], 0
    own = ((1 << width) - 1) << low
    prints = [rnd.getrandbits(64) & ~own for _ in range(2000)]            # all share every variant of the first segment
    for mask in S.pieces()[segment]:
        sizes = {}
        for p in prints:
            sizes[p & mask] = sizes.get(p & mask, 0) + 1
        assert max(sizes.values()) < 60
    near = prints[:50] + [p ^ (1 << rnd.randrange(low + width, 64)) for p in prints[:50]]
    df = spark.createDataFrame([(S.signed(p),) for p in sorted({*prints, *near})], "fp long")
    got = {frozenset(r) for r in S.links(df, 4, 100).collect()}
    assert {frozenset((S.signed(a), S.signed(b))) for a, b in zip(near[:50], near[50:], strict=True)} <= got
