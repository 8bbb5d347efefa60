"""Language identification with hyperdimensional profiles.

Every letter owns a pseudo-random +1/-1 vector. A letter trigram is the bind
(elementwise product) of its letters' vectors, the first rolled by two
places, the second by one. A text is the bundle (sum) of its trigrams, a
language prototype the bundle of all its training texts, and a text gets the
language whose prototype has the largest cosine.

Letters are lower-cased; a run of anything else is one blank, which is a
symbol of its own, so trigrams also see how words begin and end. Texts are
read whole, in blocks, so memory does not grow with a text.

A text is unlike every learned language by either of two measures, both
learned. Letters: fewer than half of its letters belong to an alphabet, the
most frequent letters that make up ``COVER`` of a language's text. Trigrams:
its cosine is below ``LEAST`` of the cosine that a text of its language and of
its effective number of trigrams has on average, and that bound is above
``NOISE`` standard deviations of an unrelated text's cosine, 1 / sqrt(DIM).
Texts too short for such a bound are judged by their letters alone.

Defined results: a text that is null or has no letter gets ``und`` with
score 0; so does every text when nothing was learned. Rows with a null lang
teach nothing. Equal cosines go to the smaller language value. Repeated rows
each count. Other columns are neither read nor renamed.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txnrisk.llm.common import add_columns, map_rows

DIM = 512              # components of a hypervector
BLOCK = 1 << 18        # symbols bundled at once
MAX_LANGUAGES = 2000   # bound on prototypes, which travel to every task
UNKNOWN = "und"
DENSE = 1 << 22        # largest trigram code space counted without sorting
COVER = 0.999          # of a language's letters that its alphabet makes up
LEAST = 0.3            # of the expected cosine that a text in a learned language reaches
NOISE = 3.0            # standard deviations of an unrelated text's cosine from which a bound on it can decide


@dataclass(frozen=True)
class Profiles:
    """Language values in ascending order, one unit prototype per row, each one's expected cosine with a text of
    one trigram, and the letters of all alphabets."""

    languages: tuple[str, ...]
    prototypes: np.ndarray
    expected: np.ndarray
    alphabet: np.ndarray


@lru_cache(maxsize=1)
def letter_codes() -> np.ndarray:
    """Code point → its lower-case letter, 0 for anything that is no letter."""
    codes = np.zeros(0x110000, np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            codes[i] = ord(low) if len(low) == 1 else i
    return codes


@lru_cache(maxsize=8192)
def letter_vector(code: int, dim: int) -> np.ndarray:
    return np.random.default_rng(code).integers(0, 2, dim, dtype=np.int8) * 2 - 1


def symbols(text: str | None) -> np.ndarray:
    """Letters of a text with single blanks (0) between, before and after words; empty if it has no letter."""
    codes = letter_codes()[np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)]
    codes = np.concatenate([codes, np.zeros(1, np.uint32)])
    codes = codes[(codes != 0) | np.concatenate([[False], codes[:-1] != 0])]
    return np.concatenate([np.zeros(1, np.uint32), codes]) if codes.size else codes


def bundle(texts: list, owners: np.ndarray, n: int, dim: int = DIM, see: Callable[[int, np.ndarray], None] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Bundles of ``n`` owners over their texts' trigrams, and each owner's letters seen; ``see`` gets each text's owner and symbols."""
    total, letters = np.zeros((n, dim)), np.zeros(n, np.int64)
    parts, held, size = [], [], 0

    def flush() -> None:
        if parts:
            add_trigrams(total, np.concatenate(parts), np.repeat(held, [p.size for p in parts]), dim)

    for text, owner in zip(texts, owners, strict=True):
        s = symbols(text)
        if not s.size:
            continue
        letters[owner] += np.count_nonzero(s)
        if see:
            see(owner, s)
        for at in range(0, s.size - 2, BLOCK):
            piece = s[at:at + BLOCK + 2]
            parts.append(piece)
            held.append(owner)
            size += piece.size
            if size >= BLOCK:
                flush()
                parts, held, size = [], [], 0
    flush()
    return total, letters


def add_trigrams(total: np.ndarray, s: np.ndarray, owner: np.ndarray, dim: int) -> None:
    """Add the trigram vectors of a run of symbols to their owners' rows."""
    present = np.flatnonzero(np.bincount(s))
    rank = np.zeros(int(present[-1]) + 1, np.int64)
    rank[present] = np.arange(present.size)
    r, width = rank[s], present.size
    # two pieces meet at blank + blank, or at a block edge, where the owner or the overlap ends
    inside = ((s[:-2] | s[1:-1]) != 0) & ((s[1:-1] | s[2:]) != 0) & (owner[:-2] == owner[2:])
    ids, own = ((r[:-2] * width + r[1:-1]) * width + r[2:])[inside], owner[:-2][inside]
    if not ids.size:
        return
    if width ** 3 <= DENSE:
        grams = np.flatnonzero(np.bincount(ids))
        place = np.zeros(int(grams[-1]) + 1, np.int64)
        place[grams] = np.arange(grams.size)
        column = place[ids]
    else:
        grams, column = np.unique(ids, return_inverse=True)
    owners, row = np.unique(own, return_inverse=True)
    counts = np.bincount(row * grams.size + column, minlength=owners.size * grams.size)
    letters = np.stack([letter_vector(int(c), dim) for c in present])
    vectors = (np.roll(letters, 2, 1)[grams // (width * width)] * np.roll(letters, 1, 1)[grams // width % width]
               * letters[grams % width])
    total[owners] += counts.reshape(owners.size, grams.size).astype(np.float32) @ vectors.astype(np.float32)


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", dim: int = DIM,
        max_languages: int = MAX_LANGUAGES) -> Profiles:
    """Learn one prototype per non-null language from all rows.

    Tasks return one partial bundle per language and batch, which Spark sums,
    and with it the language's trigrams (place ``dim``) and letters (places
    above). The driver gets one vector and one table of letters per language;
    more than ``max_languages`` values raise, they are never dropped.
    """
    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("place", T.IntegerType()),
                           T.StructField("value", T.LongType())])

    def partial(batch: dict[str, list]) -> dict[str, list]:
        names = sorted(set(batch["lang"]))
        at = {x: i for i, x in enumerate(names)}
        counts = [Counter() for _ in names]

        def see(owner: int, s: np.ndarray) -> None:
            seen = np.bincount(s)
            codes = np.flatnonzero(seen[1:]) + 1
            counts[owner].update({dim: s.size - 2} | dict(zip((dim + codes).tolist(), seen[codes].tolist(), strict=True)))

        total, letters = bundle(batch["text"], np.array([at[x] for x in batch["lang"]], np.int64), len(names), dim, see)
        out = {"lang": [], "place": [], "value": []}
        for i in np.flatnonzero(letters):
            out["lang"] += [names[i]] * (dim + len(counts[i]))
            out["place"] += [*range(dim), *counts[i]]
            out["value"] += [*np.rint(total[i]).astype(np.int64).tolist(), *counts[i].values()]
        return out

    rows = labelled.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).filter("lang is not null and text is not null")
    found = (map_rows(rows, schema, partial).groupBy("lang", "place").agg(F.sum("value").alias("value"))
             .groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("place", "value"))).alias("v"))
             .limit(max_languages + 1).collect())
    if len(found) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    found.sort(key=lambda r: r["lang"])
    vectors = np.array([[x["value"] for x in r["v"][:dim]] for r in found], np.float64).reshape(len(found), dim)
    norms = np.linalg.norm(vectors, axis=1)
    grams = np.array([r["v"][dim]["value"] for r in found], np.float64)
    # the chance that two of the language's trigrams are equal, over the prototype's norm per trigram
    expected = np.maximum(norms ** 2 / dim - grams, 0) / np.maximum(grams - 1, 1) / np.maximum(norms / dim ** 0.5, 1e-9)
    alphabet = np.zeros(0x110000, bool)
    for r in found:
        codes, seen = np.array([(x["place"] - dim, x["value"]) for x in r["v"][dim + 1:]], np.int64).T
        order = np.argsort(-seen, kind="stable")
        before = np.cumsum(seen[order]) - seen[order]
        alphabet[codes[order][before < COVER * seen.sum()]] = True
    return Profiles(tuple(r["lang"] for r in found), vectors / np.maximum(norms, 1e-9)[:, None], expected, alphabet)


def predict(df: DataFrame, profiles: Profiles, text: str = "text", lang_pred: str = "lang_pred", score: str = "score",
            known: str | None = None) -> DataFrame:
    """Every row of ``df`` with the predicted language, its cosine (0 to 1) and, as ``known``, whether the text is like a learned language."""
    languages, prototypes = profiles.languages, profiles.prototypes
    added = T.StructType([T.StructField(lang_pred, T.StringType()), T.StructField(score, T.DoubleType()),
                          *([T.StructField(known, T.BooleanType())] if known else [])])

    def label(texts: list) -> dict[str, list]:
        if not languages:
            return {lang_pred: [UNKNOWN] * len(texts), score: [0.0] * len(texts), known: [False] * len(texts)}
        dim, grams, own = prototypes.shape[1], np.zeros(len(texts)), np.zeros(len(texts))

        def see(owner: int, s: np.ndarray) -> None:
            grams[owner] += s.size - 2
            own[owner] += np.count_nonzero(profiles.alphabet[s])

        total, letters = bundle(texts, np.arange(len(texts)), len(texts), dim, see if known else None)
        norm = np.maximum(np.linalg.norm(total, axis=1), 1e-9)
        cosine = total @ prototypes.T / norm[:, None]
        best = cosine.argmax(1)
        value = np.clip(cosine[np.arange(len(texts)), best], 0.0, 1.0)
        # a bundle of n different trigrams has the norm sqrt(n * dim), repeats make it longer
        bound = LEAST * np.minimum(profiles.expected[best] * grams * dim ** 0.5 / norm, 1.0)
        unlike = (2 * own < letters) | (value < bound) & (bound >= NOISE / dim ** 0.5)
        return {lang_pred: [languages[b] if n else UNKNOWN for b, n in zip(best, letters, strict=True)],
                score: np.where(letters > 0, value, 0.0).tolist(), known: ((letters > 0) & ~unlike).tolist()}

    return add_columns(df, text, added, label)


def held_out(doc_id: Column) -> Column:
    """Documents kept from training: crc32 of the id as text, modulo 4, is 2 (a null id is not)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def language_of_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document, learned from those not held out."""
    docs = docs.select("doc_id", "text", "lang")
    profiles = fit(docs.filter(~held_out(F.col("doc_id"))))
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return predict(rows, profiles).select("doc_id", "held_out", "lang_pred", "score")
