import random
from zlib import crc32

import duckdb
import pyarrow as pa
import pytest

from txnrisk.llm import audits as A
from txnrisk.llm.queries import op11_structure_repair

SF = "/root/testdata/sf0.01"
SCHEMA = "conv_id long, turn long, role string, text string"


def follows(state, letter):
    return {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}.get((state, letter))


def brute(rows):
    """Cheapest, then least, edits of (role code, fault) rows, with whole strings and any number of insertions."""
    def inserted(best):
        todo = list(best)
        while todo:
            x = todo.pop()
            for c in "ua":
                y, option = follows(x, c), (best[x][0] + A.INSERT, best[x][1] + "I")
                if y is not None and option < best.get(y, (A.NEVER,)):
                    best[y] = option
                    todo.append(y)
        return best

    best = inserted({0: (0, "")})
    for role, fault in rows:
        found = {}
        for x, (cost, letters) in best.items():
            late = A.TRUNCATED if fault == 3 else 0
            options = [(x, A.DELETE, "D")]
            if fault not in (1, 2):
                options += [(follows(x, A.ROLES[role]), late, "K")] + [(follows(x, c), late + A.REROLE, "R") for c in "ua"]
            for y, more, letter in options:
                if y is not None:
                    found[y] = min(found.get(y, (A.NEVER,)), (cost + more, letters + letter))
        best = inserted(found)
    return min(best[x] for x in (0, 3) if x in best)


def cases(n, longest, seed):
    rnd = random.Random(seed)
    some = [[(rnd.randrange(4), rnd.choice([0, 0, 0, 1, 2, 3])) for _ in range(rnd.randint(0, longest))] for _ in range(n)]
    return some + [[(rnd.choice([2, 3, 2, 3, 1]), rnd.choice([0, 0, 3, 3, 1])) for _ in range(8 * longest)] for _ in range(5)]


def codes(rows):
    return bytes(role * 4 + fault for role, fault in rows)


def cheapest(ends):
    return min(ends[x] for x in (A.START, A.A) if ends[x])


def test_walks_against_brute_force():
    some = cases(2000, 14, 1)
    for rows, ends in zip(some, A.walked([codes(r) for r in some], [0] * len(some)), strict=True):
        assert cheapest(ends) == brute(rows), rows


def test_hash_collisions_are_decided_by_the_letters(monkeypatch):
    monkeypatch.setattr(A.Tree, "rolled", staticmethod(lambda h, letter: (h + letter) & A.np.uint64(1)))
    met, less = [], A.Tree.less

    def counted(self, a, b):
        before = self.collisions
        out = less(self, a, b)
        met.append(self.collisions - before)
        return out

    monkeypatch.setattr(A.Tree, "less", counted)
    some = cases(400, 12, 2)
    for rows, ends in zip(some, A.walked([codes(r) for r in some], [0] * len(some)), strict=True):
        assert cheapest(ends) == brute(rows), rows
    assert sum(met) > 100


@pytest.mark.parametrize("cut", [1, 3, 7])
def test_stretches_join_to_the_whole(cut):
    for rows in cases(60, 14, 3):
        code = codes(rows)
        parts = [code[i:i + cut] for i in range(0, len(code), cut)]
        walks = [(p, x) for p in parts for x in range(4)]
        ends = A.walked([p for p, _ in walks], [x for _, x in walks])
        audit = A.Audit()
        for i in range(len(parts)):
            audit.add([{"x": x, "y": y, "cost": e[0], "letters": e[1]} for x in range(4) for y, e in enumerate(ends[4 * i + x]) if e])
        assert not parts or audit.chosen() == brute(rows)


def by_sql(rows):
    con = duckdb.connect()
    table = pa.table({n: pa.array([r[i] for r in rows], k) for i, (n, k) in enumerate(
        (("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())))})
    con.register("conversations", table)
    return sorted(con.execute(A.SQL).fetchall(), key=repr)


def odd_rows():
    rnd = random.Random(7)
    texts = ["Yes.", "Yes.", "no", "", " \t\x0b", "é!", "a.b?c!", "ends. \n", None, "。", " ."]
    roles = ["user", "assistant", "system", "user", "assistant", None, "", "User", "unknown", "tool", "agent"]
    rows = [(rnd.choice([*range(40), None]), rnd.choice([*range(12), None]), rnd.choice(roles), rnd.choice(texts)) for _ in range(600)]
    rows += [(500, t, ("user", "assistant")[t % 2], rnd.choice(texts[:4]) + str(t % 9) + ".") for t in range(120)]   # a long one
    rows += [(501, 3, "user", "Same.")] * 40 + [(502, None, "user", None)] + [(503, t * 5, "assistant", "x" * 40000 + ".") for t in range(3)]
    dropped = next(i for i in range(1000, 9999) if crc32(f"{i}:0".encode()) % 20 == 0)
    return rows + [(dropped, 0, "user", "Gone.")]


@pytest.mark.parametrize("stretch", [A.STRETCH, 4])
def test_odd_rows_against_sql(spark, stretch):
    rows = odd_rows()
    table = spark.createDataFrame([(*r, 1, "x", 5) for r in rows], f"{SCHEMA}, cost int, _row string, Audit int").repartition(5)
    got = A.repair(table, stretch).collect()
    assert got[0].__fields__ == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert sorted(map(tuple, got), key=repr) == by_sql(rows)
    assert A.repair(spark.createDataFrame([], SCHEMA)).collect() == []


def test_a_stretch_holds_no_more_rows_than_asked(spark):
    table = spark.createDataFrame([(1, t, ("user", "assistant")[t % 2], f"{t}.") for t in range(3000)] + [(2, 0, "user", "a.")], SCHEMA)
    rows = A.damaged(table).withColumn("_digest", A.digest(A.F.col("role"), A.F.col("text"))).withColumn("_row", A.F.monotonically_increasing_id())
    sizes = [len(r["_codes"]) for r in A.coded(rows.filter("_here"), 100).collect()]
    assert max(sizes) <= 100 and sum(sizes) == rows.filter("_here").count()


def test_whole_table_against_sql(spark):
    got = sorted(map(tuple, op11_structure_repair(spark, SF).collect()), key=repr)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    assert got == sorted(con.execute(A.SQL).fetchall(), key=repr)
