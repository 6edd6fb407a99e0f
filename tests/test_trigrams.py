"""Trigrams are counted inside tasks: texts meet the profiles without a row for each trigram."""

from collections import Counter

from kithgraph.operators import languages
from kithgraph.plans import catalogue

DATA = "/root/testdata/sf0.001"


def test_numbers():
    """As by hand over texts side by side, also too short ones and letters beyond 16 bits."""
    texts = ["", "ab", "abc", "a", "déjà vu 𝔘𝔫𝔦", "", "xyzxyz"]
    every, counts = languages._numbers(texts)
    assert counts.tolist() == [max(0, len(t) - 2) for t in texts]
    assert list(map(languages._word, every.tolist())) == [t[i : i + 3] for t in texts for i in range(len(t) - 2)]
    assert languages._numbers(["", "a"])[0].tolist() == [] and languages._numbers(["a", "", "bc"])[0].tolist() == []


def test_no_rows_by_trigram(spark):
    """Every trigram of a text was a row that was exchanged."""
    for name in ("language_profiles", "language_detected", "language_found_keep", "english_documents"):
        plan = catalogue.queries()[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
        assert "MapInArrow" in plan and "Generate explode(flatten" not in plan, name


def test_profiles_by_hand(spark):
    rows = [("en", "the cat the"), ("en", None), ("de", "der Hund!"), (None, "abc")]
    got = {(r.lang, r.gram) for r in languages.profiles(spark.createDataFrame(rows, "lang string, text string")).collect()}
    by = {"en": Counter(), "de": Counter()}
    for lang, text in rows:
        if lang and text:
            t = " " + text.lower().replace("!", "") + " "
            by[lang].update(t[i : i + 3] for i in range(len(t) - 2))
    assert got == {(lang, g) for lang, c in by.items() for g in c}
