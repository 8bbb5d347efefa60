"""Ingest rules on landed pages, the org directory and cleaning."""
import json
import tempfile

from pyspark.sql import functions as F

from fixture_dirs import SF_SMALL
from txnrisk.sources import fixtures as FX
from txnrisk.sources import ingest as IN


def page(org, p, n, start=0):
    recs = [{"id": org * 10_000 + start + i, "amount": 1234, "date": "2024-05-01", "type": "card",
             "organization": {"id": org}} for i in range(n)]
    return (org, p, json.dumps(recs))


def test_page_rules(spark):
    rows = [
        page(1, 1, 100), page(1, 2, 100), page(1, 3, 40), page(1, 4, 100),   # stops after short page 3
        page(2, 1, 100), page(2, 3, 100),                                    # page 2 missing: only page 1
        page(3, 1, 100), (3, 2, '{"message": "boom"}'), page(3, 3, 10),      # error page read → nothing
        page(4, 1, 50), (4, 2, '{"message": "never read"}'),                 # error after short page: fine
        (5, 1, "[]"),                                                        # empty first page
    ]
    pages = spark.createDataFrame(rows, "org_id long, page long, payload string")
    got = {(r.org_id, r.page) for r in IN.pages_to_read(IN.page_table(pages)).collect()}
    assert got == {(1, 1), (1, 2), (1, 3), (2, 1), (4, 1)}
    capped = {(r.org_id, r.page) for r in IN.pages_to_read(IN.page_table(pages), limit=150).collect()}
    assert capped == {(1, 1), (1, 2), (2, 1), (4, 1)}      # page 2 read because 100 < 150
    recs = IN.read_transaction_pages(pages, limit=None)
    assert recs.count() == 100 + 100 + 40 + 100 + 50


def test_landed_files_roundtrip(spark):
    pages = FX.api_pages(spark, SF_SMALL)
    path = tempfile.mkdtemp(prefix="txnrisk-land-")
    IN.land_pages(pages, path + "/pages")
    back = IN.read_landed_pages(spark, path + "/pages")
    a = sorted(IN.read_transaction_pages(pages).select("rec.id").collect())
    b = sorted(IN.read_transaction_pages(back).select("rec.id").collect())
    assert a == b and len(a) > 0
    # a filter on the organization reaches the files' statistics
    plan = back.filter(F.col("org_id") == 3)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(org_id), EqualTo(org_id,3)]" in plan


def test_mapping_defaults_and_placeholders(spark):
    rows = [(1, 1, json.dumps([{"id": 7, "date": "2024-01-02"}, {"id": 8, "amount": "x", "date": "bad"},
                               {"id": 9, "amount": 250, "date": "2024-01-03", "organization": {"id": 4},
                                "creator": {"id": 11}, "merchant": {"id": 12}, "type": "refund"}]))]
    pages = spark.createDataFrame(rows, "org_id long, page long, payload string")
    m = IN.map_api_records(IN.read_transaction_pages(pages, None))
    r = {x.transaction_id: x for x in m.collect()}
    r = {int(k): v for k, v in r.items()}
    assert r[7].amount == 0.0 and r[7].organization_id == 0 and r[7].transaction_type == "unknown"
    assert 1 <= int(r[7].user_id) <= 999 and 1 <= r[7].product_id <= 19 and r[7].device_type in ("mobile", "desktop", "tablet")
    assert r[9].amount == 2.5 and r[9].user_id == "11" and r[9].merchant_id == "12"
    # deterministic: the same id always gets the same placeholders
    again = {x.transaction_id: x for x in m.collect()}
    assert again["7"] == r[7]
    clean = IN.clean_ingest(m)
    assert {x.transaction_id for x in clean.collect()} == {"7", "9"}     # id 8 has no parsable date


def test_org_directory_last_duplicate_wins(spark):
    raw = spark.createDataFrame([(5, "Acme", "A", 1), (6, "acme", "B", 2), (0, "zero", "Z", 3), (7, "", "E", 4)],
                                "id long, slug string, name string, ord long")
    d = {r.slug: (r.id, r.name) for r in IN.load_org_directory(raw, "ord").collect()}
    assert d == {"acme": (6, "B")}


def test_required_columns_defaults(spark):
    df = spark.createDataFrame([(1, 2.0)], "transaction_id long, amount double")
    out = IN.with_required_columns(df).first().asDict()
    assert out["organization_id"] == -1 and out["device_type"] == "unknown" and out["is_fraud"] == 0
    assert out["date"] is None


def test_streaming_ingest(spark):
    from txnrisk.streaming.pages import read_ingested, start_page_ingest
    root = tempfile.mkdtemp(prefix="txnrisk-stream-")
    pages = FX.api_pages(spark, SF_SMALL)
    IN.land_pages(pages, root + "/landing")
    q = start_page_ingest(spark, root + "/landing", root + "/table", root + "/ckpt")
    q.awaitTermination(120)
    got = read_ingested(spark, root + "/table", limit=5000)
    want = IN.clean_ingest(IN.map_api_records(IN.read_transaction_pages(pages, limit=5000)))
    assert sorted(got.select("transaction_id").collect()) == sorted(want.select("transaction_id").collect())


def test_streaming_batch_replay_is_idempotent(spark):
    from txnrisk.streaming.pages import read_ingested, start_page_ingest, write_batch
    root = tempfile.mkdtemp(prefix="txnrisk-replay-")
    pages = FX.api_pages(spark, SF_SMALL)
    write_batch(pages, 0, root + "/table")
    write_batch(pages, 0, root + "/table")          # the same batch delivered again
    once = read_ingested(spark, root + "/table", limit=5000).count()
    want = IN.clean_ingest(IN.map_api_records(IN.read_transaction_pages(pages, limit=5000))).count()
    assert once == want
    # a scheduled re-run with nothing new landed adds nothing
    IN.land_pages(pages, root + "/landing")
    for _ in range(2):
        start_page_ingest(spark, root + "/landing", root + "/t2", root + "/ck").awaitTermination(120)
    assert read_ingested(spark, root + "/t2", limit=5000).count() == want


def test_text_ids_survive(spark):
    rows = [(1, 1, json.dumps([{"id": f"txn_{i}", "amount": 5, "date": "2024-01-02", "creator": {"id": "u1"}, "organization": {"id": "x"}} for i in range(5)]))]
    got = IN.clean_ingest(IN.map_api_records(IN.read_transaction_pages(spark.createDataFrame(rows, "org_id long, page long, payload string")))).collect()
    assert {r.transaction_id for r in got} == {f"txn_{i}" for i in range(5)}
    assert {(r.user_id, r.organization_id) for r in got} == {("u1", 0)}


def test_a_truncated_or_missing_payload_is_an_error_page(spark):
    cut = page(1, 2, 100)[2][:-30]
    rows = [page(1, 1, 100), (1, 2, cut), page(2, 1, 100), (2, 2, None), page(3, 1, 100), (3, 2, "")]
    assert IN.read_transaction_pages(spark.createDataFrame(rows, "org_id long, page long, payload string")).count() == 0


def test_a_page_landed_again_counts_once_and_newest(spark):
    schema = "org_id long, page long, payload string"
    old = spark.createDataFrame([page(1, 1, 100), page(1, 2, 100, 100), (2, 1, "{}")], schema)
    new = spark.createDataFrame([page(1, 1, 100, 500), page(1, 3, 7, 300), page(2, 1, 3)], schema)
    got = IN.read_transaction_pages(IN.union_pages(old, new)).select("org_id", "page", "rec.id").collect()
    assert len(got) == 100 + 100 + 7 + 3
    assert {int(r.id) for r in got if (r.org_id, r.page) == (1, 1)} == set(range(10_500, 10_600))


def test_payloads_are_parsed_once(spark):
    plan = IN.page_table(FX.api_pages(spark, SF_SMALL))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("from_json") == 1


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_payloads_are_shuffled_only_where_a_page_repeats(spark):
    schema = "org_id long, page long, payload string"
    rows = [page(1, 1, 100), page(1, 2, 7, 100), page(2, 1, 3), (None, 1, "[]"), (3, None, None)]
    once = IN.page_table(spark.createDataFrame(rows, schema))
    assert "Exchange" not in plan_of(once)
    assert once.count() == len(rows)
    more = spark.createDataFrame([*rows, page(1, 1, 100, 500), (None, 1, "[]"), (3, None, "{}")], schema)
    assert "Exchange" in plan_of(IN.page_table(more))
    got = IN.page_table(more).collect()
    assert sorted((r.org_id or 0, r.page or 0, r.bad, r.n) for r in got) == sorted(
        [(1, 1, False, 100), (1, 2, False, 7), (2, 1, False, 3), (0, 1, False, 0), (3, 0, True, None)], key=str)
    assert next(r.records for r in got if (r.org_id, r.page) == (1, 1)) == max(
        (r.records for r in IN.page_table(spark.createDataFrame([page(1, 1, 100)], schema)).union(IN.page_table(spark.createDataFrame([page(1, 1, 100, 500)], schema))).collect()),
        key=lambda rs: int(rs[0]["id"]))
