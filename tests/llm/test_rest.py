"""Mixing, sharding, decontamination, archives and the pipeline."""
import gzip
import hashlib
import random

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from txnrisk.llm import decontaminate, hilbert, mixing, queries, simhash, warc
from txnrisk.llm.common import connected, numbered, read_table

SF = "/root/testdata/sf0.01"


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


# --- mixing ---------------------------------------------------------------

def raked_by_hand(cells, targets, sweeps=60):
    x = cells["n"] / cells["n"].sum()
    for _ in range(sweeps):
        for d in targets:
            x = x * cells[d].map(targets[d]) / x.groupby(cells[d]).transform("sum")
    return x


def test_raking_against_numpy(spark):
    rnd = random.Random(1)
    cells = pd.DataFrame([(s, l, t, rnd.randint(1, 500)) for s in "abc" for l in ["en", "de"] for t in ["x", "y"]], columns=["source", "lang", "topic", "n"])
    targets = {"source": {"a": .2, "b": .5, "c": .3}, "lang": {"en": .6, "de": .4}, "topic": {"x": .5, "y": .5}}
    got = mixing.rake(spark.createDataFrame(cells), {d: spark.createDataFrame(list(t.items()), "value string, share double") for d, t in targets.items()}, 1e-9).toPandas()
    got = got.merge(cells.assign(want=raked_by_hand(cells, targets)), on=["source", "lang", "topic"])
    assert np.allclose(got["x"], got["want"], atol=1e-7)


def test_contradicting_targets_end(spark):
    cells = spark.createDataFrame([("a", "en", "x", 10), ("b", "de", "x", 10)], "source string, lang string, topic string, n long")
    goal = lambda *rows: spark.createDataFrame(rows, "value string, share double")
    got = mixing.rake(cells, {"source": goal(("a", .9), ("b", .1)), "lang": goal(("en", .5), ("de", .5)), "topic": goal(("x", 1.))}).toPandas()
    assert got["x"].sum() == pytest.approx(1)


def test_whole_table_is_calibrated(spark):
    got = mixing.mix(read_table(spark, SF, "documents")).toPandas()
    assert len(got) == 1000 and got["probability"].between(0, 1).all()
    expected = got["n_tokens"] * got["probability"]
    assert expected.sum() / got["n_tokens"].sum() == pytest.approx(mixing.KEEP, abs=1e-3)
    mass = (got["n_tokens"] * got["weight"]).groupby(got["lang"]).sum()
    natural = got["n_tokens"].groupby(got["lang"]).sum() ** mixing.TEMPER["lang"]
    assert np.allclose(mass / mass.sum(), natural / natural.sum(), atol=1e-5)
    assert abs((got["n_tokens"] * got["sampled"]).sum() / expected.sum() - 1) < 0.1


@pytest.mark.parametrize("keep, lowered", [(0.6, False), (0.7, True)])
def test_expected_draw_meets_the_targets_with_a_hot_source(spark, keep, lowered):
    """A source with a third of all tokens, languages of unlike sizes; at 0.7 the smallest language has too few tokens for any fit."""
    rows = [(f"s{i}", lang, f"t{t}", int(n * (10 if i == 0 else 1) * (1 + (i * 7 + t * 3 + n) % 5 / 5)), 0.5)
            for i in range(21) for lang, n in (("en", 620), ("fr", 150), ("de", 140), ("es", 90)) for t in range(3)]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, n_tokens long, u double")
    got = mixing.weighted(cells, keep=keep).toPandas()
    drawn = got["n_tokens"] * got["probability"]
    assert got["probability"].between(0, 1).all() and (got["probability"] > 0.999).any()
    for d in mixing.DIMENSIONS:
        goal = got["n_tokens"].groupby(got[d]).sum() ** mixing.TEMPER[d]
        assert np.allclose(drawn.groupby(got[d]).sum() / drawn.sum(), goal / goal.sum(), atol=1e-5)
    assert (got["kept_share"] < keep).all() == lowered and got["distance"].max() <= mixing.TOLERANCE
    assert drawn.sum() / got["n_tokens"].sum() == pytest.approx(got["kept_share"][0], abs=1e-5)


def test_draw_of_nulls_repeats_and_clashing_columns(spark):
    rows = [(1, "wonderful words here", "s", None, 1.0), (1, "wonderful words here", "s", None, 1.0), (None, "b", None, "en", 2.0), (3, None, "s", "en", 3.0), (4, "", "t", "en", 4.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, weight double")
    got = mixing.mix(docs).collect()
    assert len(got) == 5 and {r.probability for r in got if r.doc_id in (3, 4) and r.source == "t"} == {0.0}
    assert len({r.sampled for r in got if r.doc_id == 1}) == 1
    assert mixing.mixed(docs, keep=1.0).columns == docs.columns
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.mixed(docs.limit(0)).count() == 0
    with_topic = docs.withColumn("topic", F.lit("own"))
    assert {r.topic for r in mixing.mix(with_topic).collect()} == {"own"}
    only = spark.createDataFrame([("s", 1.0)], "value string, share double")
    left = mixing.mix(docs, {"source": only}).collect()
    assert {r.probability for r in left if r.source != "s"} == {0.0}


# --- sharding -------------------------------------------------------------

@pytest.mark.parametrize("d, bits", [(2, 4), (3, 3), (4, 2)])
def test_hilbert_curve_steps_to_a_neighbour(d, bits):
    cells = np.array(np.meshgrid(*[range(1 << bits)] * d)).reshape(d, -1).T
    index = hilbert.hilbert_index(cells, bits)
    assert sorted(index) == list(range((1 << bits) ** d))
    assert (np.abs(np.diff(cells[np.argsort(index)], axis=0)).sum(1) == 1).all()


def check_shards(got, rows, shards):
    assert sorted(r.text_crc32 for r in got) == sorted(int(np.uint32(__import__("zlib").crc32((t or "").encode()))) for _, t, _ in rows)
    assert sorted((r["size"] for r in got)) == sorted(len((t or "").encode()) + 1 for _, t, _ in rows)
    by = {}
    for r in got:
        assert 0 <= r.shard < shards and r.law == "rows" and r.grown_shard is None
        by.setdefault(r.shard, []).append(r.slot)
    counts = [len(by.get(s, [])) for s in range(shards)]
    assert max(counts) - min(counts) <= 1 and all(sorted(x) == list(range(len(x))) for x in by.values())


@pytest.mark.parametrize("n", [0, 1, 5, 16, 100])
def test_shards_of_odd_tables(spark, n):
    rnd = random.Random(n)
    rows = [(rnd.choice([i, None, 3]), rnd.choice([None, "", "é" * i, "x" * i * 100]), rnd.choice([None, "src1", "src2", ""])) for i in range(n)]
    got = hilbert.shard_documents(spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("shard", F.lit(1))).collect()
    check_shards(got, rows, 16)


def test_shards_of_the_whole_table(spark, tmp_path):
    docs = read_table(spark, SF, "documents")
    check_shards(hilbert.shard_documents(docs).collect(), [tuple(r) for r in docs.select("doc_id", "text", "source").collect()], 16)
    sharded = hilbert.sharded(docs.withColumn("shard", F.lit("own")))
    assert sharded.columns == [*docs.columns, "shard", "_shard", "slot"]
    hilbert.write_shards(hilbert.sharded(docs), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).groupBy("shard").count().count() == 16


def test_cell_borders_are_quantiles_of_all_rows(spark):
    """Partitions of unlike sizes and values, nulls, and a dimension without values."""
    low, high = spark.range(0, 9000, 1, 7).select((F.col("id") % 100).alias("v")), spark.range(0, 1000, 1, 3).select((F.col("id") + 1000).alias("v"))
    df = low.union(high).union(spark.range(50).select(F.lit(None).cast("long").alias("v")))
    got, none = hilbert.cell_borders(df, [F.col("v"), F.lit(None)], 4)
    values = np.array([r.v for r in df.filter("v is not null").collect()])
    want = np.quantile(values, [i / 16 for i in range(1, 16)])
    share = lambda b: np.searchsorted(np.sort(values), b, "right") / values.size
    assert none.size == 0 and got.size == 15 and np.abs(share(got) - share(want)).max() < 0.03


def test_cells_of_sources_with_a_common_prefix(spark):
    """Equal-frequency cells in the order of the whole text, one hot source, nulls."""
    names = [f"https://example.org/corpus/{i:04d}é" for i in range(400)]
    rows = [(n,) for n in names for _ in range(3)] + [(names[200],)] * 600 + [(None,)] * 5
    df = spark.createDataFrame(rows, "source string").repartition(4)
    cells = {r.source: r.c for r in df.withColumn("c", hilbert.text_cells(df, "source", 4)).distinct().collect()}
    assert cells.pop(None) == 0 and [cells[n] for n in names] == sorted(cells.values())
    at = {n: sum(1 for r in rows if r[0] is not None and r[0] < n) * 16 // 1800 for n in names}
    place = {c: i for i, c in enumerate(sorted(set(at.values())))}
    assert cells == {n: place[c] for n, c in at.items()} and len(place) > 10
    none = spark.createDataFrame([(None,)], "source string")
    assert none.select(hilbert.text_cells(none, "source").alias("c")).first().c == 0


def test_curve_shards_prune(spark):
    """A range on one dimension touches fewer shards than with rows dealt at random."""
    got = hilbert.shard_documents(read_table(spark, SF, "documents")).toPandas()
    box = got.groupby("shard")[["size", "doc_id"]].agg(["min", "max"])
    touched = sum((b[("doc_id", "min")] <= 100) for _, b in box.iterrows()) + sum(b[("size", "max")] >= 8000 for _, b in box.iterrows())
    assert touched <= 16


# --- shared helpers -------------------------------------------------------

def test_numbering_is_gapless_and_ordered(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"), F.lit(0).alias("_part"))
    got, n = numbered(df, [F.col("v").desc()], "n", "t")
    assert n == 1000 and [r.n for r in got.orderBy(F.desc("v")).collect()] == list(range(1000))


def test_components_of_random_graphs(spark):
    rnd = random.Random(8)
    edges = [(rnd.randint(0, 300), rnd.randint(0, 300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(40)]
    root = {x: x for e in edges for x in e}
    for a, b in edges * len(root):
        if root[a] != root[b]:
            lo, hi = sorted((root[a], root[b]))
            root = {k: lo if v == hi else v for k, v in root.items()}
        if all(root[a] == root[b] for a, b in edges):
            break
    got = dict(tuple(r) for r in connected(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {k: v for k, v in root.items() if any(k in e and e[0] != e[1] for e in edges)}


# --- decontamination ------------------------------------------------------

def leaks_by_hand(docs, items, words=5, least=0.8):
    out = []
    for item, it in items:
        q = decontaminate.tokens(it)
        w = min(words, len(q))
        own = set(decontaminate.shingles(q, w)) if w else set()
        for d, t in docs:
            shared = len(own & set(decontaminate.shingles(decontaminate.tokens(t), w))) if own else 0
            if own and shared >= least * len(own) - 1e-9:
                out.append((d, item, len(own), shared, shared / len(own)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [10, 10 ** 6])
def test_leaks_against_brute_force(spark, block):
    rnd = random.Random(6)
    words = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(rnd.choices(words, k=rnd.choice([1, 3, 5, 8, 20, 45])))) for i in range(25)] + [(50, None), (51, "?!"), (None, "only one here to find now"), (52, "dup item"), (52, "dup other")]
    docs = [(None, None), (1, ""), (2, "!!")]
    for i in range(60):
        t = rnd.choices(words, k=rnd.randint(0, 80))
        item = (rnd.choice(items)[1] or "").split()
        for _ in range(rnd.randint(0, 2)):
            if item:
                item[rnd.randrange(len(item))] = "changed"
        docs.append((rnd.choice([i, None]), " ".join(t[:20] + [x.upper() + "," for x in item] + t[20:])))
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = leaks_by_hand(docs, items)
    assert rows_of(decontaminate.leaks(d, b, block=block)) == want and len(want) > 20
    clean = decontaminate.without_leaks(d.withColumn("_hits", F.lit(1)), b, block=block)
    dirty = {t for _, t in docs if leaks_by_hand([(0, t)], items)}
    assert sorted((r.text for r in clean.collect()), key=repr) == sorted((t for _, t in docs if t not in dirty), key=repr) and clean.columns == ["doc_id", "text", "_hits"]


def test_item_blocks_are_bounded(spark):
    items = [(i, " ".join(f"w{i}x{j}" for j in range(n))) for i, n in enumerate([3, 40, 3, 3, 12, 7, 0, 1])]
    blocks = list(decontaminate.item_blocks(spark.createDataFrame(items, "item_id long, text string"), 5, 0.8, 12))
    n = dict((i, len(t.split())) for i, t in items)
    sizes = [[n[i] for i, _ in b.items] for b in blocks]
    assert all(sum(s) <= 12 or len(s) == 1 for s in sizes) and sorted(sum(sizes, [])) == [1, 3, 3, 3, 7, 12, 40]


def test_empty_benchmark_and_documents(spark):
    d, b = spark.createDataFrame([(1, "a b c")], "doc_id long, text string"), spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert decontaminate.leaks(d, b.limit(0)).count() == 0 and decontaminate.leaks(d.limit(0), b).count() == 0 and decontaminate.leaks(d, b).count() == 1
    assert decontaminate.without_leaks(d, b.limit(0)).count() == 1


# --- archives -------------------------------------------------------------

def test_round_trip_of_odd_pages(spark):
    big = "<p>é</p>\r\n\r\nWARC/1.0\r\nContent-Length: 5\r\n\r\n" * 60
    rows = [(1, "http://a/\r\nx", big), (5, "http://b", big), (None, "http://c", big), (2, None, None), (3, "u", ""), (4, "u", "x"), (6, "u", "x"), (7, "u", big + "!"), (7, "u", big + "!"), (8, "v", big + "?"), (8, "w", big + "?"),
            ((1 << 63) - 1, "z", "max"), (-(1 << 63), "z", "min")]
    got = rows_of(warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("record_type", F.lit(1))))
    want = []
    for p, u, h in rows:
        body = (h or "").encode()
        top = max(((q if q is not None else -1), v or "") for q, v, k in rows if (k or "") == (h or ""))
        revisit = len(body) >= 1000 and ((p if p is not None else -1), u or "") != top
        want.append((p, len(body), hashlib.sha1(body).hexdigest(), "revisit" if revisit else "response", top[0] if revisit else None))
    assert got == sorted(want, key=repr)
    assert warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string").limit(0)).count() == 0


def test_archives_are_bounded(spark, tmp_path):
    sizes = [10, 3000, 50, 9000, 10, 10, 10, 10, 10, 4000]
    pages = spark.createDataFrame([(i, "u", chr(97 + i) * n) for i, n in enumerate(sizes)], "page_id long, url string, html string")
    warc.write_archives(pages.coalesce(1), str(tmp_path / "a"), per_archive=4, max_bytes=6000)
    files = list((tmp_path / "a").rglob("part-*"))
    held = []
    for f in files:
        data = f.read_bytes()
        found = [r for _, _, r, _ in warc.salvage(data)]
        assert all(found) and len(found) <= 4 and (len(data) <= 6000 or len(found) == 1)
        held.append([int(r["fields"]["page-id"]) for r in found])
    assert sorted(sum(held, [])) == list(range(len(sizes))) and len(held) > 3


def test_oracle_sql_of_whole_tables(spark):
    for t in ("documents", "benchmark", "pages", "conversations"):
        duckdb.sql(f"CREATE OR REPLACE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name, sql in queries.oracle_sql().items():
        df = queries.queries()[name](spark, SF)
        assert rows_of(df) == sorted(duckdb.sql(f"SELECT {', '.join(df.columns)} FROM ({sql})").fetchall(), key=repr), name


def record(i, body):
    block = warc.HTTP.encode() + body
    return (f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <{i}>\r\nPage-ID: {i}\r\nWARC-Payload-Digest: sha1:{hashlib.sha1(body).hexdigest()}\r\n"
            f"Content-Type: application/http\r\nContent-Length: {len(block)}\r\n\r\n").encode() + block + b"\r\n\r\n"


@pytest.mark.parametrize("zipped", [False, True])
def test_salvage_recovers_what_follows_the_damage(spark, tmp_path, zipped):
    parts = [record(i, f"page {i} ".encode() * 40) for i in range(6)]
    parts = [gzip.compress(p) for p in parts] if zipped else parts
    hurt = bytearray(parts[2])
    hurt[-30] ^= 0xFF
    cut = parts[4][:len(parts[4]) // 2]
    data = b"junk" + parts[0] + parts[1] + bytes(hurt) + parts[3] + cut + parts[5] + b"tail"
    (tmp_path / "a.warc").write_bytes(data)
    (tmp_path / "empty.warc").write_bytes(b"")
    got = warc.read_archives(spark, str(tmp_path)).collect()
    assert sorted(r.page_id for r in got if r.gap is None) == [0, 1, 3, 5]
    assert all(bytes(r.payload) == f"page {r.page_id} ".encode() * 40 for r in got if r.gap is None)
    spans = sorted((r.offset, r.length) for r in got)
    assert [a + n for a, n in spans] == [a for a, _ in spans[1:]] + [len(data)] and spans[0][0] == 0
    assert sorted(r.length for r in got if r.gap) == sorted([4, len(hurt), len(cut), 4])


# --- pipeline -------------------------------------------------------------

def test_stages_by_brute_force(spark):
    docs = read_table(spark, SF, "documents")
    extra = spark.createDataFrame([(5000, "... 123 ...", "en", "s", 1), (None, None, None, None, None)], docs.schema)
    docs = docs.union(extra).withColumn("shard", F.lit("x"))
    stages = dict(corpus_pipeline.STAGES)
    known = stages["language_id"](spark, docs, SF)
    assert known.columns == docs.columns and known.count() == 1000
    one = stages["simhash_near_dedup"](spark, known, SF)
    groups = simhash.near_duplicates(known)
    assert {r.doc_id for r in one.collect()} == {r.component_id for r in groups.collect()} and one.columns == docs.columns
    clean = stages["decontamination"](spark, one, SF)
    items = [tuple(r) for r in read_table(spark, SF, "benchmark").select("item_id", "text").collect()]
    leaked = {x[0] for x in leaks_by_hand([(r.doc_id, r.text) for r in one.collect()], items)}
    assert leaked and {r.doc_id for r in clean.collect()} == {r.doc_id for r in one.collect()} - leaked
    drawn = stages["mixing"](spark, clean, SF)
    assert {r.doc_id for r in drawn.collect()} == {r.doc_id for r in mixing.mix(clean).filter("sampled").collect()} and drawn.columns == docs.columns
    last = stages["hilbert_shards"](spark, drawn, SF)
    assert last.columns == [*docs.columns, "_shard", "slot"] and last.count() == drawn.count()


def test_run_over_the_whole_table(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "shard", "slot"]
    assert 300 < got.count() < 1000 and got.select("shard", "slot").distinct().count() == got.count()


def test_stages_take_an_empty_table(spark):
    docs = read_table(spark, SF, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0
