"""Personal data by bootstrapped contextual extraction.

Base matches (email, ip, card, phone) are the seeds. Each seed and each
weaker look-alike is an instance that stands in up to three lexical patterns of
its kind: the two tokens before it on its line (words, numbers as one class,
the line's start), the word after it, and the last two tokens of its column's
heading where lines are cut into equally many cells. Spark scores the
pattern-instance graph in rounds: a pattern is as good as the instances it
holds, an instance as good as the patterns that hold it, and seeds are
certain. Look-alikes in a pattern of high score and with enough different
seeds become spans.

Base spans always stay; a look-alike that touches one is never a candidate.

Defined results: a null text is empty. Matches of one kind are leftmost and do
not overlap; those that fail their check are dropped without a retry. A
pattern needs a word; an instance without one around it stands in no pattern,
and a pattern that holds a single instance is left out of the graph. Repeated
rows and null doc_ids give one row each, and repeats of one instance in one
pattern count once. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txnrisk.llm.common import add_columns, discard, saved

ROUNDS = 3            # rounds of scoring
MIN_SCORE = 0.8       # of a pattern that may discover
MIN_SEEDS = 3         # different seeds in such a pattern
PRIOR = 1.0           # instances of score 0 that every pattern is taken to hold besides its own

KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A run of digits is taken whole: what fails from its start fails from within.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
#: Look-alikes by kind: spelled-out or malformed addresses, long or failing numbers, numbers without a country.
ALIKE = (
    ("email", re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:@|\(at\)|\[at\]) ?[A-Za-z0-9-]++(?:(?:\.| ?(?:\(dot\)|\[dot\]) ?)[A-Za-z0-9-]++)*+")),
    ("ip", re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){3,7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])")),
    ("ip", re.compile(r"(?<![0-9.])[0-9]{1,4}(?:\.[0-9]{1,4}){3}(?![0-9.])")),
    ("card", re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])")),
    ("phone", re.compile(r"(?<![0-9+])\(?[0-9]++\)?(?:[ .-]?\(?[0-9]++\)?)*+")),
)
NEEDLE = {"email": re.compile(r"@|\(at\)|\[at\]"), "ip": re.compile("[0-9]"), "card": re.compile("[0-9]"), "phone": re.compile("[0-9]")}
TOKEN = re.compile(r"[^\W\d_]+|\d+|\n")
CUT = re.compile(r"[\t|\n]")
DIGITS = re.compile(r"[^0-9]+")


def emails(text: str) -> list[tuple[int, int]]:
    """Email matches, found from each @: the local part is the run before it, after the last match."""
    found, end, at = [], 0, text.find("@")
    while at >= 0:
        low = at
        while low > end and (text[low - 1] in "._%+-" or text[low - 1].isascii() and text[low - 1].isalnum()):
            low -= 1
        m = DOMAIN.match(text, at) if low < at else None
        if m:
            end = m.end()
            found.append((low, end))
        at = text.find("@", m.end() if m else at + 1)
    return found


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(2 * d - 9 * (d > 4) for d in map(int, digits[-2::-2]))) % 10 == 0


def low_part(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or "0") <= 255


def base_spans(text: str) -> list[tuple[str, int, int]]:
    found = [("email", s, e) for s, e in emails(text)] if "@" in text else []
    if NEEDLE["ip"].search(text):
        found += [("ip", *m.span()) for m in IP.finditer(text) if all(map(low_part, m[0].split(".")))]
        for m in CARD.finditer(text):
            digits = DIGITS.sub("", m[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", *m.span()))
        if "+" in text:
            found += [("phone", *m.span()) for m in PHONE.finditer(text) if 10 <= len(DIGITS.sub("", m[0])) <= 15]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def alike_spans(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    taken, found = bytearray(len(text)), []
    for _, s, e in base:
        taken[s:e] = b"\1" * (e - s)
    for kind, pattern in ALIKE:
        if not NEEDLE[kind].search(text):
            continue
        for m in pattern.finditer(text):
            s, e = m.span()
            if kind == "phone" and not 7 <= len(DIGITS.sub("", m[0])) <= 15:
                continue
            if 1 not in taken[s:e]:
                found.append((kind, s, e))
                taken[s:e] = b"\1" * (e - s)
    return found


class Surroundings:
    """What stands around spans of one text: its tokens by position, and the headings of its tables.

    Every list is made in one pass over the text, every look-up is a binary
    search, so a long line with many instances costs no more than many short.
    """

    def __init__(self, text: str):
        tokens = [(m.start(), m.end(), "" if m[0] == "\n" else "#" if m[0][0].isdecimal() else m[0].lower()) for m in TOKEN.finditer(text)]
        self.starts, self.ends, self.names = map(list, zip(*tokens, strict=True)) if tokens else ([], [], [])
        self.lines, self.cuts, self.heads = [0], [[]], [0]   # of every line: start, places of its cell borders, first line of its table
        if "\t" in text or "|" in text:
            shape = ""
            for m in CUT.finditer(text + "\n"):
                if m[0] != "\n":
                    self.cuts[-1].append(m.start())
                    continue
                before, shape = shape, "".join(text[c] for c in self.cuts[-1])
                self.heads[-1] = self.heads[-2] if shape and shape == before else len(self.lines) - 1
                self.lines.append(m.end())
                self.cuts.append([])
                self.heads.append(len(self.heads))

    def before(self, low: int, end: int) -> tuple[str, str]:
        """The last two tokens that lie wholly in text[low:end] and on its last line; "^" where there is none."""
        i = bisect_right(self.ends, end) - 1
        got = []
        for j in (i, i - 1):
            here = j >= 0 and self.starts[j] >= low and self.names[j] and (not got or got[0] != "^")
            got.append(self.names[j] if here else "^")
        return got[1], got[0]

    def after(self, start: int) -> str:
        i = bisect_left(self.starts, start)
        return self.names[i] if i < len(self.names) and self.names[i] else "$"

    def heading(self, start: int) -> tuple[str, str]:
        line = bisect_right(self.lines, start) - 1
        head = self.heads[line]
        if head == line:
            return "^", "^"
        cell = bisect_left(self.cuts[line], start)
        low = self.cuts[head][cell - 1] + 1 if cell else self.lines[head]
        high = self.cuts[head][cell] if cell < len(self.cuts[head]) else self.lines[head + 1] - 1
        return self.before(low, high)

    def patterns(self, kind: str, start: int, end: int) -> list[str]:
        found = [f"{kind} {place} {a} {b}" for place, (a, b) in (("<", self.before(0, start)), ("/", self.heading(start))) if a.isalpha() or b.isalpha()]
        word = self.after(end)
        return [*found, f"{kind} > {word}"] if word.isalpha() else found


SPAN_LIST = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
NODE = T.ArrayType(T.StructType([T.StructField("pattern", T.StringType()), T.StructField("instance", T.StringType()), T.StructField("seed", T.BooleanType()),
                                 T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
SCANNED = T.StructType([*[T.StructField(f"n_{k}", T.LongType()) for k in KINDS], T.StructField("base_sha256", T.StringType()),
                        T.StructField("base", SPAN_LIST), T.StructField("nodes", NODE)])


def scan(texts: list) -> dict[str, list]:
    out = {f.name: [] for f in SCANNED}
    for text in texts:
        text = text or ""
        base = base_spans(text)
        for k in KINDS:
            out[f"n_{k}"].append(sum(x[0] == k for x in base))
        out["base_sha256"].append(hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in base).encode()).hexdigest())
        out["base"].append([dict(zip(("kind", "start", "end"), x, strict=True)) for x in base])
        nodes, alike = [], alike_spans(text, base)
        around = Surroundings(text) if base or alike else None
        for seed, spans in ((True, base), (False, alike)):
            for kind, s, e in spans:
                instance = f"{kind} {hashlib.blake2b(text[s:e].lower().encode(), digest_size=12).hexdigest()}"
                nodes += [{"pattern": p, "instance": instance, "seed": seed, "kind": kind, "start": s, "end": e} for p in around.patterns(kind, s, e)]
        out["nodes"].append(nodes)
    return out


def good_patterns(edges: DataFrame, rounds: int = ROUNDS, min_score: float = MIN_SCORE, min_seeds: int = MIN_SEEDS) -> DataFrame:
    """Patterns to discover with, from edges (pattern, instance, seed), each once.

    A round scores patterns as the mean score of their instances, with
    ``PRIOR`` instances of score 0 added, then every instance that is no seed
    as the mean of its patterns. Sums are partial before each shuffle, and the
    edge table with its current scores is written after each round.
    """
    current = saved(edges.withColumn("score", F.col("seed").cast("double")), "pii-edges")
    for _ in range(rounds):
        patterns = current.groupBy("pattern").agg((F.sum("score") / (F.count("*") + PRIOR)).alias("p"))
        scored = current.join(patterns, "pattern")
        instances = scored.groupBy("instance").agg(F.avg("p").alias("i"))
        following = saved(scored.drop("score", "p").join(instances, "instance")
                          .select("pattern", "instance", "seed", F.when(F.col("seed"), 1.0).otherwise(F.col("i")).alias("score")), "pii-edges")
        discard(current)
        current = following
    return (current.groupBy("pattern").agg((F.sum("score") / (F.count("*") + PRIOR)).alias("pattern_score"), F.sum(F.col("seed").cast("long")).alias("seeds"))
            .filter((F.col("pattern_score") >= min_score) & (F.col("seeds") >= min_seeds)))


def find_personal_data(docs: DataFrame, rounds: int = ROUNDS, min_score: float = MIN_SCORE, min_seeds: int = MIN_SEEDS) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_discovered of every document."""
    rows = saved(add_columns(docs.select("doc_id", "text"), "text", SCANNED, scan).drop("text")
                 .withColumn("row", F.monotonically_increasing_id()), "pii")
    nodes = rows.filter(F.size("nodes") > 0).select("row", F.explode("nodes").alias("n")).select("row", "n.*")
    edges = saved(nodes.groupBy("pattern", "instance").agg(F.max("seed").alias("seed")), "pii-all-edges")
    several = edges.groupBy("pattern").count().filter("count > 1").select("pattern")
    good = good_patterns(edges.join(several, "pattern"), rounds, min_score, min_seeds)
    added = nodes.filter("not seed").join(good.select("pattern"), "pattern").groupBy("row").agg(F.collect_set(F.struct("kind", "start", "end")).alias("added"))
    out = rows.join(added, "row", "left").withColumn("added", F.coalesce("added", F.expr("array()")))
    ranked = "transform({c}, x -> struct(x.start, array_position(array('email', 'ip', 'card', 'phone'), x.kind) as rank, x.kind, x.end))"
    every = F.expr(f"concat({ranked.format(c='base')}, {ranked.format(c='added')})")
    spans = F.array_join(F.transform(F.array_sort(every), lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    return out.select("doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", spans.alias("spans"), F.size("added").cast("long").alias("n_discovered"))
