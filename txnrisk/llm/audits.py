"""Conversation structure repair: cheapest audits by a persistent dynamic program.

A conversation fits if the first letters of its roles read
``(s?(ua)+)?``. Rows are kept, given another role, deleted or inserted at
fixed costs; of the cheapest edits the ASCII-least letters (Delete, Insert,
Keep, Rerole) are the *audit*.

The program walks a conversation with four states (nothing yet, after s,
after u, after a). A state's edits so far are one node of a shared tree:
letter, parent, ancestors at powers of two and a rolling hash of the letters
from the root. Equal costs are compared at the first letter in which two
nodes differ, which binary lifting finds as the end of their longest common
prefix: hashes of ancestors at equal depth are equal up to there. Letters
fix the state, so equal prefixes are one node, and a comparison whose last
common prefix is not one node has met a hash collision: it is decided by the
letters themselves. Many walks run side by side as columns of arrays.

In Spark a row is one letter of 16 (role and first fault), in the order of
its conversation. Conversations are cut into stretches of at most ``stretch``
rows; a stretch walks from every state it can begin in, and a conversation's
stretches are joined in order. Copies of one row are found by an aggregate
on (conversation, digest). So a hot conversation spreads over tasks, up to
its output row, the audit, and its hash: SHA-256 runs through the repaired
conversation in order, one row at a time in memory.

Defined results: a null role or text is one space, and so are a null conv_id
and turn in the number that picks the damage. A null conv_id is a
conversation of its own. Rows of one turn stand in the order of the SHA-256
of role and text. A role that is empty, or begins with another letter, can
not be kept. Repeated rows are duplicates. An empty table gives no row.
Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txnrisk.llm.common import map_rows, saved, tasks

STRETCH = 1024          # rows of a stretch
WALKED = 1 << 16        # rows walked at once
RULES = 20              # damage: one of so many rules by CRC-32, of which 5 change a row
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
START, S, U, A = range(4)
D, I, K, R = (ord(c) for c in "DIKR")
ROLES = " sua"          # other, system, user, assistant: two bits of a row's code
FAULTS = ("none", "blank", "duplicate", "truncated")
NEVER = 1 << 40
BLANKS = " \t\n\x0b\x0c\r"


class Tree:
    """Nodes that share edit prefixes; node 0 is the empty prefix."""

    def __init__(self, nodes: int):
        self.letter = np.zeros(nodes, np.uint8)
        self.depth = np.zeros(nodes, np.int32)
        self.hash = np.zeros(nodes, np.uint64)
        self.up = [np.zeros(nodes, np.int32)]
        self.n = 1
        self.deepest = 0
        self.collisions = 0

    def add(self, parent: np.ndarray, letter: np.ndarray) -> np.ndarray:
        at = np.arange(self.n, self.n + len(parent), dtype=np.int32)
        if len(at) == 0:
            return at
        if at[-1] >= len(self.letter):
            more = max(len(self.letter), len(at))
            self.letter, self.depth, self.hash = (np.concatenate([x, np.zeros(more, x.dtype)]) for x in (self.letter, self.depth, self.hash))
            self.up = [np.concatenate([x, np.zeros(more, x.dtype)]) for x in self.up]
        self.n += len(at)
        self.letter[at], self.depth[at] = letter, self.depth[parent] + 1
        self.hash[at] = self.rolled(self.hash[parent], np.asarray(letter, np.uint64))
        self.deepest = max(self.deepest, int(self.depth[at].max()))
        while 1 << len(self.up) <= self.deepest:
            last = self.up[-1]
            self.up.append(last[last])
        up = parent
        self.up[0][at] = up
        for k in range(1, len(self.up)):
            up = self.up[k - 1][up]
            self.up[k][at] = up
        return at

    @staticmethod
    def rolled(h: np.ndarray, letter: np.ndarray) -> np.ndarray:
        h = (h ^ letter) * np.uint64(0x9E3779B97F4A7C15)
        return h ^ (h >> np.uint64(29))

    def raised(self, a: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """Ancestors at ``depth``."""
        above = self.depth[a] - depth
        for k, up in enumerate(self.up):
            a = np.where(above >> k & 1, up[a], a)
        return a

    def less(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the letters of each node of ``a`` come before those of ``b``."""
        depth = np.minimum(self.depth[a], self.depth[b])
        x, y = self.raised(a, depth), self.raised(b, depth)
        prefix = x == y
        for up in reversed(self.up):
            differ = self.hash[up[x]] != self.hash[up[y]]
            x, y = np.where(differ, up[x], x), np.where(differ, up[y], y)
        out = np.where(prefix, self.depth[a] < self.depth[b], self.letter[x] < self.letter[y])
        same = self.up[0][x] == self.up[0][y]
        for i in np.flatnonzero(~prefix & ~(same & (self.letter[x] != self.letter[y]))):
            self.collisions += 1
            out[i] = self.letters(int(a[i])) < self.letters(int(b[i]))
        return out

    def letters(self, node: int) -> str:
        found = []
        while node:
            found.append(self.letter[node])
            node = int(self.up[0][node])
        return bytes(found[::-1]).decode()

    def all_letters(self, nodes: np.ndarray) -> list[str]:
        """Letters of many nodes, all walked up together."""
        depth = self.depth[nodes]
        table = np.zeros((len(nodes), max(int(depth.max(initial=0)), 1)), np.uint8)
        at, rows = nodes.copy(), np.arange(len(nodes))
        while len(rows):
            rows = rows[at[rows] > 0]
            node = at[rows]
            table[rows, self.depth[node] - 1] = self.letter[node]
            at[rows] = self.up[0][node]
        return [bytes(t[:d]).decode() for t, d in zip(table, depth.tolist(), strict=True)]


class Walks:
    """Costs and nodes of the four states, of many walks side by side."""

    def __init__(self, tree: Tree, begin: np.ndarray):
        self.tree = tree
        self.cost = np.full((4, len(begin)), NEVER, np.int64)
        self.node = np.zeros((4, len(begin)), np.int32)
        self.cost[begin, np.arange(len(begin))] = 0

    def best(self, a: tuple, b: tuple) -> tuple:
        """The better of two (cost, node, letter to add) of each walk.

        The nodes alone decide ties: where one begins the other, the longer
        has an insertion more, a cost that no letter of one row makes up.
        """
        better = b[0] < a[0]
        tied = np.flatnonzero((b[0] == a[0]) & (a[0] < NEVER))
        better[tied] = self.tree.less(b[1][tied], a[1][tied])
        return tuple(np.where(better, y, x) for x, y in zip(a, b, strict=True))

    def opened(self, rows: np.ndarray) -> tuple:
        """The best of the states that a user may follow."""
        none = np.zeros(len(rows), np.uint8)
        found = [(self.cost[x, rows], self.node[x, rows], none) for x in (START, S, A)]
        return self.best(self.best(found[0], found[1]), found[2])

    def commit(self, rows: np.ndarray, state: int, found: tuple) -> None:
        """Take the found edits into ``state``, with a node for each that adds a letter."""
        cost, node, letter = found
        new = np.flatnonzero((letter > 0) & (cost < NEVER))
        node = node.copy()
        node[new] = self.tree.add(node[new], letter[new])
        self.cost[state, rows], self.node[state, rows] = cost, node

    def step(self, rows: np.ndarray, role: np.ndarray, fault: np.ndarray) -> None:
        """One row of each of the walks ``rows``, then what may be inserted after it."""
        stays = np.where((fault == 1) | (fault == 2), NEVER, np.where(fault == 3, TRUNCATED, 0))

        def edit(source: tuple, extra, letter) -> tuple:
            cost = np.minimum(source[0] + extra, NEVER)
            return cost, source[1], np.broadcast_to(np.asarray(letter, np.uint8), cost.shape)

        states = [(self.cost[x, rows], self.node[x, rows], None) for x in range(4)]
        deleted = [edit(x, DELETE, D) for x in states]
        turn = self.opened(rows)
        to = {}
        for state, source, own in ((U, turn, 2), (A, states[U], 3)):
            kept = role == own
            to[state] = self.best(deleted[state], edit(source, stays + np.where(kept, 0, REROLE), np.where(kept, K, R)))
        to[S] = self.best(deleted[S], edit(states[START], np.where(role == 1, stays, NEVER), K))
        to[START] = deleted[START]
        for state, found in to.items():
            self.commit(rows, state, found)
        self.insert(rows)

    def insert(self, rows: np.ndarray) -> None:
        """One inserted row; two in a place are never among the cheapest, as deleting a row or leaving both out is cheaper."""
        turn, user = self.opened(rows), (self.cost[U, rows], self.node[U, rows])
        self.commit_if(rows, U, turn)
        self.commit_if(rows, A, user)

    def commit_if(self, rows: np.ndarray, state: int, source: tuple) -> None:
        """An insertion after ``source`` where that is better than what the state holds."""
        own, cost = self.cost[state, rows], np.minimum(source[0] + INSERT, NEVER)
        take = cost < own
        tied = np.flatnonzero((cost == own) & (own < NEVER))
        take[tied] = self.tree.less(source[1][tied], self.node[state, rows[tied]])
        self.cost[state, rows[take]] = cost[take]
        self.node[state, rows[take]] = self.tree.add(source[1][take], np.full(int(take.sum()), I, np.uint8))


def walked(codes: list[bytes], begin: list[int]) -> list[list[tuple[int, str] | None]]:
    """Of each walk (row codes, state it begins in) the cost and letters at each state it can end in."""
    n = np.array([len(c) for c in codes], np.int64)
    order = np.argsort(-n, kind="stable")
    left, longest = n[order], int(n.max(initial=0))
    table = np.zeros((len(codes), max(longest, 1)), np.uint8)
    for i, at in enumerate(order):
        table[i, :n[at]] = np.frombuffer(codes[at], np.uint8)
    tree = Tree(6 * int(n.sum()) + 16)
    walks = Walks(tree, np.array(begin, np.int64)[order])
    walks.insert(np.flatnonzero(walks.cost[START] == 0))
    for j in range(longest):
        rows = np.arange(int(np.searchsorted(-left, -j, "left")))  # the walks with more than j rows
        code = table[rows, j]
        walks.step(rows, code >> 2 & 3, code & 3)
    out: list = [None] * len(codes)
    letters = [tree.all_letters(walks.node[x]) for x in range(4)]
    for i, at in enumerate(order):
        out[at] = [(int(walks.cost[x, i]), letters[x][i]) if walks.cost[x, i] < NEVER else None for x in range(4)]
    return out


class Audit:
    """The cheapest, then least, edits through a conversation's stretches so far, for every state."""

    def __init__(self):
        self.held: list = [(0, None), None, None, None]  # cost and (link before, letters)

    @staticmethod
    def spelled(link, until=None) -> str:
        found = []
        while link is not until:
            found.append(link[1])
            link = link[0]
        return "".join(found[::-1])

    def least(self, options: list[tuple]) -> tuple | None:
        cheapest = min((o[0] for o in options), default=None)
        options = [o for o in options if o[0] == cheapest]
        while len(options) > 1:
            (c, a), (_, b) = options.pop(), options.pop()
            seen, above = set(), a
            while above is not None:
                seen.add(id(above))
                above = above[0]
            common = b
            while common is not None and id(common) not in seen:
                common = common[0]
            options.append((c, min(a, b, key=lambda x: self.spelled(x, common))))
        return options[0] if options else None

    def add(self, paths: list[dict]) -> None:
        self.held = [self.least([(self.held[p["x"]][0] + p["cost"], (self.held[p["x"]][1], p["letters"]))
                                 for p in paths if p["y"] == y and self.held[p["x"]]]) for y in range(4)]

    def chosen(self) -> tuple[int, str]:
        cost, link = self.least([h for h in (self.held[START], self.held[A]) if h])
        return cost, self.spelled(link)


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role and text after damage; a dropped row has rule 0 and stays."""
    space = F.lit(" ")
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    x = rows.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"),
                    (F.crc32(F.encode(name, "UTF-8")) % RULES).alias("_rule"))
    text = F.when(F.col("_rule") == 1, "").when(F.col("_rule") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("_rule") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return x.select("conv_id", "turn", F.when(F.col("_rule") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
                    (F.col("_rule") != 0).alias("_here"), copies.alias("_copy"))


def digest(role: Column, text: Column) -> Column:
    return F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, F.lit(":"), text), 256)


def role_code() -> Column:
    """0 to 3 by the role's first letter."""
    initial = F.substring("role", 1, 1)
    return F.when(initial == "s", 1).when(initial == "u", 2).when(initial == "a", 3).otherwise(0)


def ranged(narrow: DataFrame) -> DataFrame:
    """Rows in conversation order, written once, with their range (_part) and place in it (_local)."""
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("_digest"), F.col("_row")]
    return saved(narrow.repartitionByRange(tasks(narrow.sparkSession), *order).sortWithinPartitions(*order)
                 .withColumn("_part", F.spark_partition_id())
                 .withColumn("_local", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "turns")


def coded(here: DataFrame, stretch: int) -> DataFrame:
    """One row per stretch: conv_id, its place (_part, _from) and the codes of its rows in order."""
    last = F.substring(F.rtrim(F.col("text"), F.lit(BLANKS)), -1, 1)
    fault = F.when(last == "", 1).when(last.isin(".", "!", "?"), 0).otherwise(3)
    ordered = ranged(here.select("conv_id", "turn", "_digest", "_row", (role_code() * 4 + fault).cast("int").alias("_code")))
    first = ordered.groupBy("conv_id", "_digest").agg(F.min(F.struct("_part", "_local")).alias("_first"), F.count("*").alias("_n")).filter("_n > 1") \
        .select(F.col("conv_id").alias("_conv"), F.col("_digest").alias("_same"), "_first")
    again = (F.col("_first") < F.struct("_part", "_local")) & (F.col("_code") % 4 != 1)
    x = ordered.join(first, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("_digest") == F.col("_same")), "left") \
        .withColumn("_code", F.when(again, F.col("_code") - F.col("_code") % 4 + 2).otherwise(F.col("_code")))
    return x.groupBy("conv_id", "_part", F.floor(F.col("_local") / stretch).alias("_at")) \
        .agg(F.array_sort(F.collect_list(F.struct("_local", "_code"))).alias("_rows")) \
        .select("conv_id", "_part", F.col("_rows")[0]["_local"].alias("_from"), F.col("_rows._code").alias("_codes"))


PATH = T.ArrayType(T.StructType([T.StructField("x", T.IntegerType()), T.StructField("y", T.IntegerType()),
                                 T.StructField("cost", T.LongType()), T.StructField("letters", T.StringType())]))
COUNTS = ("blank", "duplicate", "truncated", "illegal")
LEGAL = {(1, 2), (2, 3), (3, 2)}


def paths(stretches: DataFrame, stretch: int) -> DataFrame:
    """Per stretch the cheapest edits between any two states, and the counts of its faults.

    A stretch that does not begin at a multiple of ``stretch`` follows another
    conversation's row, so it is the first of its own.
    """
    schema = T.StructType([stretches.schema["conv_id"], stretches.schema["_part"], stretches.schema["_from"], T.StructField("_paths", PATH),
                           *[T.StructField(f"_{c}", T.LongType()) for c in COUNTS], T.StructField("_first", T.IntegerType()), T.StructField("_last", T.IntegerType())])

    def walk(b: dict[str, list]) -> dict[str, list]:
        codes = [bytes(c) for c in b["_codes"]]
        found: list[list[dict]] = [[] for _ in codes]
        walks = [(i, x) for i, at in enumerate(b["_from"]) for x in (range(4) if at % stretch == 0 else (START,))]
        done = 0
        while done < len(walks):
            n, rows = 0, 0
            while done + n < len(walks) and (not n or rows + len(codes[walks[done + n][0]]) <= WALKED):
                rows += len(codes[walks[done + n][0]])
                n += 1
            some = walks[done:done + n]
            for (i, x), ends in zip(some, walked([codes[i] for i, _ in some], [x for _, x in some]), strict=True):
                found[i] += [{"x": x, "y": y, "cost": e[0], "letters": e[1]} for y, e in enumerate(ends) if e]
            done += n
        out = {"conv_id": b["conv_id"], "_part": b["_part"], "_from": b["_from"], "_paths": found}
        for k, c in enumerate(COUNTS[:3], 1):
            out[f"_{c}"] = [sum(x & 3 == k for x in row) for row in codes]
        out["_illegal"] = [sum((x >> 2, y >> 2) not in LEGAL for x, y in zip(row, row[1:], strict=False)) for row in codes]
        return out | {"_first": [row[0] >> 2 for row in codes], "_last": [row[-1] >> 2 for row in codes]}

    return map_rows(stretches, schema, walk)


class Conversation:
    """What one conversation's stretches and then its rows give, in order; one row's text at a time."""

    def __init__(self):
        self.audit, self.counts, self.last = Audit(), dict.fromkeys(COUNTS, 0), None
        self.letters = self.cost = None
        self.at, self.sha, self.empty, self.state = 0, hashlib.sha256(), True, START
        self.turns, self.low, self.high, self.turn = 0, None, None, None

    def stretch(self, row: dict) -> None:
        self.audit.add(row["_paths"])
        for c in COUNTS:
            self.counts[c] += row[f"_{c}"]
        self.counts["illegal"] += self.last is not None and (self.last, row["_first"]) not in LEGAL
        self.last = row["_last"]

    def spoken(self, role: str, text: str) -> None:
        self.sha.update(("" if self.empty else "\n").encode() + f"{role}:{text}".encode("utf-8", "surrogatepass"))
        self.empty = False

    def inserted(self) -> None:
        while self.at < len(self.letters) and self.letters[self.at] == "I":
            self.spoken(self.other(), "")
            self.at += 1

    def other(self) -> str:
        """The role that must follow, which is then the last."""
        self.state = A if self.state == U else U
        return "assistant" if self.state == A else "user"

    def row(self, turn, role: str, text: str) -> None:
        if self.letters is None:
            self.cost, self.letters = self.audit.chosen()
        if turn is not None and turn != self.turn:
            self.turns, self.turn = self.turns + 1, turn
            self.low, self.high = turn if self.low is None else self.low, turn
        self.inserted()
        letter = self.letters[self.at]
        self.at += 1
        if letter == "R":
            self.spoken(self.other(), text)
        elif letter == "K":
            if role[:1] == "s":
                self.state = S
            else:
                self.other()
            self.spoken(role, text)

    def result(self) -> list:
        if self.letters is None:
            return [0] * 6 + ["", self.sha.hexdigest()]
        self.inserted()
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return [gaps, *self.counts.values(), self.cost, self.letters, self.sha.hexdigest()]


RESULT = T.StructType([*[T.StructField(c, T.LongType()) for c in ("gaps", *COUNTS, "cost")], T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType())])


def repair(conversations: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """One row per conversation of the damaged rows: its faults, the audit with its cost, and the hash of the repaired rows."""
    rows = saved(damaged(conversations).withColumn("_digest", digest(F.col("role"), F.col("text"))).withColumn("_row", F.monotonically_increasing_id()), "damaged")
    edits = paths(coded(rows.filter("_here"), stretch), stretch)
    return repaired(rows, edits)


def repaired(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """A conversation's stretches, then its rows, run through one task in order; none is held."""
    schema = T.StructType([rows.schema["conv_id"], *RESULT.fields])
    from pyspark.sql.pandas.types import to_arrow_schema
    target = to_arrow_schema(schema)
    order = ["conv_id", "_kind", "_part", "_from"]
    stream = edits.withColumn("_kind", F.lit(0)).unionByName(
        rows.withColumn("_kind", F.when(F.col("_here"), 1).otherwise(2)), allowMissingColumns=True) \
        .repartition(tasks(rows.sparkSession), "conv_id") \
        .sortWithinPartitions(*order, F.col("turn").asc_nulls_first(), "_digest", "_row") \
        .select("conv_id", "_kind", "_paths", *[f"_{c}" for c in COUNTS], "_first", "_last", "turn", "role", F.when(F.col("_here"), F.col("text")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, name, begun = None, None, False

        def batch(done: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), target.types, strict=True)], schema=target)

        for b in batches:
            done = []
            for row in b.to_pylist():
                if not begun or row["conv_id"] != name:
                    if begun:
                        done.append((name, *current.result()))
                    current, name, begun = Conversation(), row["conv_id"], True
                if row["_kind"] == 0:
                    current.stretch(row)
                elif row["_kind"] == 1:
                    current.row(row["turn"], row["role"], row["text"])
            if done:
                yield batch(done)
        if begun:
            yield batch([(name, *current.result())])

    return stream.mapInArrow(run, schema)


#: DuckDB: CRC-32 from its polynomial, then all edits of all rows as strings, the least (cost, letters) of each state kept.
CRC32 = """
crc_table AS (SELECT list(c ORDER BY n) AS t FROM (
  SELECT n, list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
  FROM (SELECT unnest(range(256)) AS n))),
"""


def crc32_sql(text: str) -> str:
    """CRC-32 of the UTF-8 bytes of the SQL expression ``text``; needs ``crc_table`` in scope."""
    return (f"xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(1, octet_length(encode({text})) + 1), "
            f"lambda i: ('0x' || substr(hex(encode({text})), 2 * i - 1, 2))::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])))")


SQL = f"""
WITH RECURSIVE {CRC32}
src AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
               {crc32_sql("(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")} % 20 AS rule
        FROM conversations, crc_table),
damaged AS (SELECT conv_id, turn, CASE rule WHEN 4 THEN 'user' ELSE role END AS role,
                   CASE rule WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE rule WHEN 3 THEN 2 ELSE 1 END)) AS copy
            FROM src WHERE rule <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(role) || ':' || role || ':' || text)) AS i,
                  regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS last FROM damaged),
faults AS (SELECT *, CASE WHEN last = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
                          WHEN last NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
                  substr(role, 1, 1) AS c, lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM placed),
steps(x, c, y) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (3, 'u', 2), (2, 'a', 3)),
one AS (SELECT x, x AS y, 'D' AS letter, NULL AS c, 2 AS cost FROM (VALUES (0), (1), (2), (3)) s(x)
        UNION ALL SELECT x, y, 'K', c, 0 FROM steps UNION ALL SELECT x, y, 'R', NULL, 1 FROM steps WHERE c <> 's'),
adds AS (SELECT x, x AS y, '' AS letters, 0 AS cost FROM (VALUES (0), (1), (2), (3)) s(x)
         UNION ALL SELECT x, y, 'I', 5 FROM steps WHERE c <> 's'
         UNION ALL SELECT a.x, b.y, 'II', 10 FROM steps a JOIN steps b ON b.x = a.y WHERE a.c <> 's' AND b.c <> 's'),
edits AS (SELECT one.x, adds.y, one.letter || adds.letters AS letters, one.letter, c, one.cost + adds.cost AS cost FROM one JOIN adds ON adds.x = one.y),
dp AS (SELECT conv_id, 0::BIGINT AS i, y AS state, adds.cost::BIGINT AS cost, adds.letters AS audit FROM (SELECT DISTINCT conv_id FROM faults), adds WHERE x = 0
       UNION ALL
       SELECT conv_id, i, state, b.cost, b.audit FROM (
         SELECT dp.conv_id, f.i, e.y AS state,
                min({{'cost': dp.cost + e.cost + CASE WHEN f.fault = 'truncated' AND e.letter <> 'D' THEN 5 ELSE 0 END, 'audit': dp.audit || e.letters}}) AS b
         FROM dp JOIN faults f ON f.conv_id IS NOT DISTINCT FROM dp.conv_id AND f.i = dp.i + 1
              JOIN edits e ON e.x = dp.state AND (e.letter = 'D' OR f.fault IN ('', 'truncated')) AND (e.c IS NULL OR e.c = f.c)
         GROUP BY dp.conv_id, f.i, e.y)),
final AS (SELECT conv_id, min({{'cost': cost, 'audit': audit}}) AS b FROM dp JOIN (SELECT conv_id AS k, max(i) AS n FROM faults GROUP BY ALL) ON k IS NOT DISTINCT FROM conv_id AND n = i
          WHERE state IN (0, 3) GROUP BY conv_id),
walk AS (SELECT conv_id, p, substr(b.audit, p, 1) AS letter, p - length(replace(substr(b.audit, 1, p), 'I', '')) AS inserted
         FROM (SELECT conv_id, b, unnest(range(1, length(b.audit) + 1)) AS p FROM final)),
said AS (SELECT w.conv_id, w.p, w.letter, f.role, coalesce(f.text, '') AS text, row_number() OVER (PARTITION BY w.conv_id ORDER BY w.p) AS k
         FROM walk w LEFT JOIN faults f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND w.letter <> 'I' AND f.i = w.p - w.inserted WHERE w.letter <> 'D'),
head AS (SELECT conv_id AS k2, bool_or(k = 1 AND letter = 'K' AND role[1] = 's') AS system FROM said GROUP BY ALL),
repaired AS (SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN (k + system::INT) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY p) AS r
             FROM said JOIN head ON k2 IS NOT DISTINCT FROM conv_id GROUP BY conv_id),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
                  count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
                  count(*) FILTER (before IS NOT NULL AND before || c NOT IN ('su', 'ua', 'au')) AS illegal FROM faults GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(b.cost, 0)::BIGINT AS cost, coalesce(b.audit, '') AS audit, sha256(coalesce(r, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
     LEFT JOIN final f ON f.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN repaired r ON r.conv_id IS NOT DISTINCT FROM o.conv_id
"""
