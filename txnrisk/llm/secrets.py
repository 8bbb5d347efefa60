"""Secret scanning with multipart credential linking.

Patterns that are strong on their own are always reported: assignments to a
secret's name, AKIA access identifiers and long hex strings. Weak parts are
other access identifiers, short or unassigned secrets, and endpoints; a weak
identifier or secret is reported only if its complement co-occurs: an
identifier needs a secret, a secret needs an identifier or an endpoint, within
the scope of ``REACH`` code points around the part. An unlabelled token in the
path of an address is a part of the address: as a secret it needs an
identifier. An endpoint is no secret and adds no span; the linked table and
the column ``endpoints`` give the span of the nearest one in scope (ties: the
smaller start).

The link is an interval join on (row, bin): a part is dealt to every bin that
its scope touches, and inside a bin one ordered pass finds the nearest
complement on either side, so no pairs are made and a long document is spread
over its bins.

Defined results: a null text is empty. Matches of one kind are leftmost and do
not overlap; those that fail their check are dropped without a retry. Weak
parts that touch a strong match or an earlier weak part are dropped, but an
endpoint is cut before the first one and may hold path tokens. Repeated
rows and null doc_ids give one row each. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txnrisk.llm.common import add_columns, saved

REACH = 200          # code points on either side of a part that its scope takes in
BIN = 4096           # code points of a bin of the interval join
ENTROPY = 3.5        # bits per character that a weak secret has at least

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")

URL = re.compile(r"\b[a-z][a-z0-9+.-]{1,15}://[^\s\"'<>]{3,512}")
WEAK = (
    ("id", re.compile(r"\b(?:ASIA|AIDA|AROA|AGPA|ANPA)[A-Z0-9]{12,}\b")),
    ("id", re.compile(r"""(?ai:access_?key_?id|client_?id|user_?name|login|account_?id)["']?[ \t]{0,8}[:=][ \t]{0,8}["']?[A-Za-z0-9_.@-]{3,128}""")),
    ("secret", re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20{0,8}[:=]\x20{0,8}["']?[A-Za-z0-9+/_.=-]{4,7}(?![A-Za-z0-9+/_.=-])""")),
    ("secret", re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+={0,2}(?![A-Za-z0-9+/_=-])")),
    ("secret", re.compile(r"(?<![A-Za-z0-9])[0-9a-f]{16,31}(?![A-Za-z0-9])")),
    ("endpoint", URL),
    ("endpoint", re.compile(r"""(?ai:host|server|endpoint)["']?[ \t]{0,8}[:=][ \t]{0,8}["']?[A-Za-z0-9.-]{3,253}(?::[0-9]{2,5})?""")),
)


ROLE = {"assign": "secret", "access": "id", "hex": "secret"}
#: Roles of which one must be in scope of a weak part; the base rule, and the one with endpoints and path tokens.
PAIRS = {"id": ("secret",), "secret": ("id",)}
COMPLEMENTS = {"id": ("secret", "path"), "secret": ("id", "endpoint"), "path": ("id",)}


def strong_spans(text: str) -> list[tuple[str, int, int]]:
    found = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[1]) >= 8]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def random_looking(token: str) -> bool:
    """Letters and digits mixed, and many different characters."""
    if not (re.search("[0-9]", token) and re.search("[A-Za-z]", token)):
        return False
    n = len(token)
    return -sum(c / n * math.log2(c / n) for c in Counter(token).values()) >= min(ENTROPY, math.log2(n) - 1)


def in_path(text: str, s: int, e: int) -> bool:
    """A token of an address that is no value of its query and no password before its host."""
    return text[s - 1:s] != "=" and not (text[s - 1:s] == ":" and text[e:e + 1] == "@")


def weak_parts(text: str, strong: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Weak parts that touch no strong span and no earlier weak part; no endpoints if the text has no secret, which every link needs."""
    taken, address, found = bytearray(len(text)), bytearray(len(text)), []
    for _, s, e in strong:
        taken[s:e] = b"\1" * (e - s)
    if "://" in text:
        for m in URL.finditer(text):
            address[m.start():m.end()] = b"\1" * (m.end() - m.start())
    for role, pattern in WEAK:
        if role == "endpoint" and not (any(r != "id" for r, _, _ in found) or any(ROLE[k] == "secret" for k, _, _ in strong)):
            break
        for m in pattern.finditer(text):
            s, e = m.span()
            if role == "endpoint":
                cut = taken.find(1, s, e)
                if cut >= 0 and not pattern.fullmatch(text[s:cut]):
                    continue
                e = e if cut < 0 else cut
            labelled = role == "secret" and (":" in m[0] or "=" in m[0].rstrip("="))
            if role == "secret" and not labelled and not random_looking(m[0]):
                continue
            if role == "endpoint" or not any(taken[s:e]):
                path = role == "secret" and not labelled and address[e - 1] and in_path(text, s, e)
                found.append(("path" if path else role, s, e))
                taken[s:e] = (b"\2" if path else b"\1") * (e - s)
    return sorted(found, key=lambda x: x[1:])


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


PART = T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()),
                                 T.StructField("weak", T.BooleanType())]))
SCANNED = T.StructType([*[T.StructField(f"n_{k}", T.LongType()) for k in KINDS], T.StructField("base_sha256", T.StringType()),
                        T.StructField("base", T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))),
                        T.StructField("parts", PART)])


def scan(texts: list) -> dict[str, list]:
    out = {f.name: [] for f in SCANNED}
    for text in texts:
        strong = strong_spans(text or "")
        weak = weak_parts(text or "", strong)
        for k in KINDS:
            out[f"n_{k}"].append(sum(x[0] == k for x in strong))
        out["base_sha256"].append(hashlib.sha256(joined(strong).encode()).hexdigest())
        out["base"].append([dict(zip(("kind", "start", "end"), x, strict=True)) for x in strong])
        parts = [(ROLE[k], s, e, False) for k, s, e in strong] + [(r, s, e, True) for r, s, e in weak]
        # without a weak part that has a complement somewhere in the text there is nothing to link
        roles = {p[0] for p in parts}
        linkable = any(not roles.isdisjoint(COMPLEMENTS.get(r, ())) for r, _, _ in weak)
        out["parts"].append([dict(zip(("role", "start", "end", "weak"), p, strict=True)) for p in parts] if linkable else [])
    return out


def linked(parts: DataFrame, reach: int = REACH, width: int = BIN, complements: dict[str, tuple[str, ...]] = PAIRS) -> DataFrame:
    """Weak parts (row, role, start, end, weak) whose complement is in scope, once each, with the nearest endpoint (distance, start, end) in scope, if any."""
    dealt = parts.withColumn("bin", F.explode(F.expr(f"sequence((start - {reach}) div {width}, (end + {reach}) div {width})")))
    order = Window.partitionBy("row", "bin").orderBy("start", "end", "role")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)

    def reached(role):
        left = F.max(F.when(F.col("role") == role, F.col("end"))).over(before) >= F.col("start") - reach
        right = F.min(F.when(F.col("role") == role, F.col("start"))).over(after) <= F.col("end") + reach
        return F.coalesce(left, F.lit(False)) | F.coalesce(right, F.lit(False))

    def within(side, distance):
        far = F.greatest(distance, F.lit(0))
        return F.when(side.isNotNull() & (far <= reach), F.struct(far.alias("distance"), side["start"].alias("start"), side["end"].alias("end")))

    is_endpoint = F.col("role") == "endpoint"
    last = F.max(F.when(is_endpoint, F.struct("end", F.col("start")))).over(before)
    first = F.min(F.when(is_endpoint, F.struct("start", F.col("end")))).over(after)
    roles = sorted({r for needed in complements.values() for r in needed})
    seen = dealt.select("*", *[reached(r).alias(f"by_{r}") for r in roles], last.alias("last"), first.alias("first"))
    nearest = F.least(within(F.col("last"), F.col("start") - F.col("last.end")), within(F.col("first"), F.col("first.start") - F.col("end")))
    complement = F.lit(False)
    for role, needed in complements.items():
        for r in needed:
            complement = complement | (F.col("role") == role) & F.col(f"by_{r}")
    return seen.filter(F.col("weak") & complement).groupBy("row", "role", "start", "end").agg(F.min(nearest).alias("endpoint"))


def find_secrets(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked, n_with_endpoint, endpoints of every document."""
    rows = saved(add_columns(docs.select("doc_id", "text"), "text", SCANNED, scan).drop("text")
                 .withColumn("row", F.monotonically_increasing_id()), "secrets")
    parts = rows.filter(F.size("parts") > 0).select("row", F.explode("parts").alias("p")).select("row", "p.*")
    kind = F.when(F.col("role") == "path", "secret").otherwise(F.col("role"))
    added = linked(parts, reach, complements=COMPLEMENTS).groupBy("row").agg(
        F.collect_list(F.struct(kind.alias("kind"), "start", "end")).alias("added"), F.count("endpoint").alias("n_with_endpoint"),
        F.sort_array(F.collect_set(F.when(F.col("endpoint").isNotNull(), F.struct("endpoint.start", "endpoint.end")))).alias("near"))
    out = rows.join(added, "row", "left").withColumn("added", F.coalesce("added", F.expr("array()")))
    rank = "CASE {k} WHEN 'assign' THEN 0 WHEN 'access' THEN 1 WHEN 'hex' THEN 2 WHEN 'id' THEN 3 ELSE 4 END"
    every = F.expr("concat(transform(base, x -> struct(x.start, " + rank.format(k="x.kind") + " as rank, x.kind, x.end)), "
                   "transform(added, x -> struct(x.start, " + rank.format(k="x.kind") + " as rank, x.kind, x.end)))")
    spans = F.array_join(F.transform(F.array_sort(every), lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    return out.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", spans.alias("spans"),
                      F.size("added").cast("long").alias("n_linked"), F.coalesce("n_with_endpoint", F.lit(0)).cast("long").alias("n_with_endpoint"),
                      F.coalesce(F.array_join(F.transform("near", lambda x: F.concat_ws(":", F.lit("endpoint"), x["start"], x["end"])), ","), F.lit("")).alias("endpoints"))
