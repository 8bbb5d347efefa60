import numpy as np
import pytest

from txnrisk.llm import language_id as L
from txnrisk.llm.common import read_table

SF = "/root/testdata/sf0.01"


def by_hand(text, dim):
    """The definition, letter by letter."""
    s = [ord(c) for c in " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())]
    s = [0, *[0 if c == 32 else c for c in s], 0]
    v = np.zeros(dim)
    for a, b, c in zip(s, s[1:], s[2:], strict=False):
        v += np.roll(L.letter_vector(a, dim), 2).astype(int) * np.roll(L.letter_vector(b, dim), 1) * L.letter_vector(c, dim)
    return v


@pytest.mark.parametrize("block", [4, 1 << 18])
def test_bundle_is_the_sum_of_bound_trigrams(monkeypatch, block):
    monkeypatch.setattr(L, "BLOCK", block)
    texts = ["Hello, wörld! x", "", None, "123", "aé" * 30, "ab  CD\n\nef"]
    got, letters = L.bundle(texts, np.arange(6), 6, 64)
    for t, v, n in zip(texts, got, letters, strict=True):
        assert n == sum(c.isalpha() for c in t or "")
        assert np.array_equal(v, by_hand(t, 64) if n else np.zeros(64))


def test_held_out_accuracy(spark):
    docs = read_table(spark, SF, "documents")
    rows = L.language_of_documents(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count()
    held = [r for r in rows if r.held_out]
    assert len(held) > 100 and sum(r.lang == r.lang_pred for r in held) / len(held) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def test_nulls_letters_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "the cat and the hat", "en", 5), (2, None, "en", 5), (3, "12 34 ?", None, 5), (None, "der hut und die katze", "de", 5),
                                  (4, "", None, None), (4, "the hat", None, 1), (4, "the hat", None, 1)], "doc_id long, text string, lang string, score int")
    got = sorted(L.language_of_documents(docs).collect(), key=repr)
    assert len(got) == 7
    assert {(r.doc_id, r.lang_pred) for r in got if r.doc_id in (2, 3)} == {(2, "und"), (3, "und")}
    assert [r.score for r in got if r.lang_pred == "und"] == [0.0] * 3
    profiles = L.fit(docs)
    kept = L.predict(docs, profiles, lang_pred="_l", score="_s")
    assert kept.columns == ["doc_id", "text", "lang", "score", "_l", "_s"] and kept.filter("_l = 'de'").count() == 1


def test_nothing_learned_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert [tuple(r)[2:] for r in L.language_of_documents(docs).collect()] == [("und", 0.0)]
    assert L.language_of_documents(docs.limit(0)).count() == 0


def test_too_many_languages_raise(spark):
    docs = spark.createDataFrame([(i, "abc", f"l{i}") for i in range(4)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError):
        L.fit(docs, max_languages=3)


def test_texts_in_no_learned_language_are_rejected(spark):
    """Unlearned scripts at any length, and noise in learned letters from some 20 words on; all labelled documents stay."""
    import random

    import corpus_pipeline
    rnd = random.Random(4)
    noise = lambda letters, n: " ".join("".join(rnd.choices(letters, k=rnd.randint(2, 9))) for _ in range(n))
    docs = read_table(spark, SF, "documents").select("doc_id", "text", "lang")
    kinds = {"cyrillic": ("абвгдежзийклмнопрстуфхцчшщыьэюя", (1, 5, 200)), "greek": ("αβγδεζηθικλμνξοπρστυφχψω", (1, 5, 200)),
             "han": ([chr(c) for c in range(0x4E00, 0x9000)], (1, 5, 200)), "noise": ("bcdfghjklmnpqrstvwxz", (25, 200))}
    rows = [(-1, noise(letters, n), None) for letters, sizes in kinds.values() for n in sizes for _ in range(20)]
    got = corpus_pipeline.identified(spark, docs.union(spark.createDataFrame(rows, docs.schema)), SF)
    assert got.columns == docs.columns
    assert got.filter("doc_id >= 0").count() == docs.count() and got.filter("doc_id = -1").count() == 0
