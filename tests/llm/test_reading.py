import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wavelattice.llm.pages import is_broken, joined, letters, reading_order
from wavelattice.llm.reading import MEASURES, article_words, count_lines, fit_bands, fit_spread_bands, is_english, matter_of, measures, reading_bands, syllables, word_odds

EASY = "The cat sat on the mat. It was a big red mat. The dog ran to the cat. The cat did not run. It sat by the fire. "
HARD = "The epistemological presuppositions of the argument necessarily undermine transcendental argumentation, notwithstanding considerable methodological sophistication. The institutional intermediaries of the administration systematically reconfigure responsibilities. "


@pytest.mark.parametrize(("word", "n"), [("cat", 1), ("table", 2), ("make", 1), ("makes", 1), ("wanted", 2), ("walked", 1), ("reading", 2), ("education", 4), ("syllable", 3), ("the", 1), ("b", 1)])
def test_syllables(word, n):
    assert syllables(word) == n


def test_pages():
    assert joined(["a transcen-", "dental mat¬", "ter of", "fact"]) == "a transcendental matter of fact "
    assert is_broken("abc­ ") and not is_broken("abc")
    assert letters("Événement, No. 5!") == "evenementno5"
    assert reading_order(list("abcd"), np.array([40, 300, 42, 301]), np.array([10, 10, 30, 30])) == [0, 2, 1, 3]
    assert reading_order(list("abc"), np.array([1, 2]), np.array([1, 2])) == [0, 1, 2]
    assert reading_order(list("abc"), None, None) == [0, 1, 2]


def test_other_matter():
    lines = ["No. 12   PRICE 2d.", "NEWS FROM HERE", "The old bridge was closed", "* * * LAMP OIL * * *", "Brown of Here", "Never fails. Tvy it today!", "9s. 4d.", "by order of the council.", "Soap ........ 33 5½ 17", "WANTED, clean lad. Apply Smith."]
    learnt = {"fails": 4.0, "today": 3.0, "of": -1.0, "brown": 0.5}
    assert [b for b, k in zip(lines, matter_of(lines, None, learnt)) if k] == ["The old bridge was closed", "by order of the council."]


def test_measures():
    easy, hard = (measures(*article_words(t, None, None)) for t in (EASY * 5, HARD * 5))
    assert easy[-1] < 2 < 15 < hard[-1] and measures([], 0) == (0.0,) * len(MEASURES)
    assert is_english("the cat and the dog".split()) and not is_english("le chat et la souris dans une rue".split()) and not is_english([])


def test_fit():
    rng = np.random.default_rng(0)
    t = pd.DataFrame(np.vstack([rng.normal(b, 0.2, (40, len(MEASURES))) for b in (1, 2, 3)]), columns=list(MEASURES)).assign(band=np.repeat([1, 2, 3], 40))
    classes, mean, scale, w = fit_bands(t)
    z = np.c_[np.ones(120), (t[list(MEASURES)].to_numpy() - mean) / scale]
    assert classes == [1, 2, 3] and ((z @ w).argmax(1) + 1 == t["band"]).mean() > 0.97
    assert fit_bands(t.head(0))[0] == []


def test_query(spark):
    rng = random.Random(2)

    def page(text, n=6):
        parts = text.strip().split(". ")
        return ". ".join(rng.choices(parts, k=n * len(parts)))

    docs = [(i, page(EASY if i % 2 else HARD, 4), "en" if i % 3 else "English", None) for i in range(40)]
    docs += [(100, page(EASY), "fr", None), (101, page(EASY), None, None), (102, None, "en", None), (103, "", "en", None), (104, "Too short.", "EN", None), (105, "le chat est dans la rue et il ne dort pas " * 20, "en", None), (106, page(HARD) * 50, "en-GB", 9), (None, page(EASY), "en", None)]
    d = spark.createDataFrame([(*r, 0.0) for r in docs], "doc_id long, text string, lang string, band int, grade double")
    known = spark.createDataFrame([(i, 1 if i % 2 else 4) for i in range(12)] + [(12, None), (None, 1), (0, 4)], "doc_id long, band int")
    got = {r.doc_id: r.band for r in reading_bands(d, known).collect()}
    assert got == {i: (1 if i % 2 else 4) for i in range(12, 40)} | {106: 4}
    assert reading_bands(d.limit(0), known).count() == 0 and reading_bands(d, known.limit(0)).count() == 0


def test_every_labelled_page_counts(spark):
    """Of 40 000 labels only the twelve that come last by the hash of their id have a page; these teach the bands."""
    labels = spark.range(1000, 41000).withColumnRenamed("id", "doc_id")
    last = [r.doc_id for r in labels.orderBy(F.xxhash64("doc_id").desc(), F.desc("doc_id")).limit(12).collect()]
    band = {i: 1 + 3 * (k % 2) for k, i in enumerate(last)}
    wanted = {i: 1 + 3 * (i % 2) for i in range(10)}
    docs = spark.createDataFrame([(i, (EASY if b == 1 else HARD) * 6, "en") for i, b in (band | wanted).items()], "doc_id long, text string, lang string")
    known = labels.withColumn("band", F.when(F.col("doc_id").isin([i for i, b in band.items() if b == 1]), 1).otherwise(4))
    for most in (32_000_000, -1):
        assert {r.doc_id: r.band for r in reading_bands(docs, known, broadcast_bytes=most).collect()} == wanted


def test_fit_over_partitions(spark):
    rng = np.random.default_rng(1)
    t = pd.DataFrame(np.vstack([rng.normal(b, 0.9, (50, len(MEASURES))) for b in (1, 2, 4)]), columns=list(MEASURES)).assign(band=np.repeat([1, 2, 4], 50))
    here, spread = fit_bands(t), fit_spread_bands(spark.createDataFrame(t).repartition(3))
    assert here[0] == spread[0] == [1, 2, 4] and all(np.allclose(a, b, atol=1e-7) for a, b in zip(here[1:], spread[1:]))
    assert fit_spread_bands(spark.createDataFrame(t).limit(0))[0] == []


def test_unseen_adverts_are_learnt_from_layout():
    rng = random.Random(3)
    article = "the council met on monday to talk about the new road that leads past the mill and over the bridge to the farms".split()
    wording = ["Ours alone lasts a lifetime.", "Ask your grocer, refuse others!", "Doctors praise it daily."]

    def page():
        out = []
        for _ in range(4):
            out += [" ".join(rng.choices(article, k=7)) for _ in range(12)]
            out += ["ZINGO PILLS", rng.choice(wording), "Price 2s. 6d. a box"]
        return out + [" ".join(rng.choices(article, k=7)) for _ in range(6)]

    near, far = Counter(), Counter()
    sums = [count_lines(page(), 2, near, far) for _ in range(60)]
    odds = word_odds(near, far, sum(a for a, _ in sums), sum(b for _, b in sums))
    lines = page()
    assert [line for line, k in zip(lines, matter_of(lines, {}, odds)) if not k] == [line for line in lines if line in wording or line[0].isupper()]
    assert all(matter_of(["a young man praised the doctor for his daily walk past", "the mill and over the bridge"], {}, odds))
    assert word_odds(Counter(), Counter(), 0, 0) == {} and all(matter_of(article[:3], {}, {}))
