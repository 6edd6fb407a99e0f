"""The license scan against a plain search, on planted notices, edits, repeats, nulls and empty tables."""

import random
import re

import pytest
from pyspark.sql import functions as F

from kithgraph.llm import licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
MIT, APACHE, GPL = (next(t for t in licenses.NOTICES if t.label == x) for x in ("mit", "apache", "gpl"))


def cut(text):
    return WORD.findall((text or "").translate(LOWER))


def noise(rng, n):
    return [rng.choice("the of any person to this software license a gnu public mit apache general no".split()) for _ in range(n)]


def plain(text, least=0.5):
    """Base places, labels and best share: every diagonal of every template, and every run of near diagonals, by dictionaries."""
    w, spots, labels, best = cut(text), [], set(), 0.0
    for t in licenses.TEMPLATES:
        m = len(t.words)
        k = min(3, m)
        diagonals = {}
        places = {}
        for place in range(m - k + 1):
            places.setdefault(tuple(t.words[place : place + k]), []).append(place)
        for d in range(len(w) - k + 1):
            for place in places.get(tuple(w[d : d + k]), ()):
                diagonals.setdefault(d - place, set()).add(place)
        if t.base:
            whole = sorted(x for x in range(len(w) - m + 1) if w[x : x + m] == t.words)
            spots += [(x, t.label) for x in whole]
            if whole:
                best, labels = 1.0, labels | {t.label}
            continue
        strong = sorted(x for x, p in diagonals.items() if len(p) > 1 or m < 8)
        runs = []
        for x in strong:
            if runs and x - runs[-1][-1] <= min(3, m // 8):
                runs[-1].append(x)
            else:
                runs.append([x])
        groups = [[x] for x in strong]
        for r in runs:
            at = [x + p for x in r for p in diagonals[x]]
            if len(r) > 1 and 2 * len(at) >= max(at) + k - min(at):
                groups.append(r)
        for g in groups:
            share = len(set().union(*(diagonals[x] for x in g))) / (m - k + 1)
            best = max(best, share)
            if share >= least:
                labels.add(t.label)
    return spots, labels, best


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    edited = list(MIT.words)
    edited[10:12], edited[40:40] = ["changed"], ["two", "more"]
    out = [None, "", "!!! \n", "MIT License", "mit, LICENSE mit-license", "the GNU General Public License", "general public", "license", APACHE.text, GPL.text.upper(), " ".join(edited), " ".join(MIT.words[:30]), " ".join(MIT.words[:60] + noise(rng, 40) + MIT.words[60:])]
    out += [" ".join(noise(rng, rng.randint(0, 300))) for _ in range(25)]
    out += [" ".join(noise(rng, 15_000) + APACHE.words + ["apache", "license"]), "mit license " * 400, "ſoftware Ⅷ Mit Lıcense mit licenſe mit licenKe", MIT.text + "\n" + MIT.text, *[t.text for t in licenses.NOTICES]]
    return out


def test_scan(spark, texts):
    rows = [(i // 2, t) for i, t in enumerate([x for t in texts for x in (t, t)])] + [(None, "MIT License")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("key", "w", "t", "k", "h", "spans", "label", "start", "hits")}).repartition(3)
    got = {}
    for r in licenses.scan(docs).collect():
        got.setdefault(r.doc_id, []).append((r.n_words, r.best, r.spans))
    assert [len(got[i]) for i in range(len(texts))] == [2] * len(texts) and len(got[None]) == 1
    for i, text in enumerate(texts):
        spots, labels, best = plain(text)
        assert got[i][0] == got[i][1]
        n, share, spans = got[i][0]
        assert n == len(cut(text)) and share == pytest.approx(best), (i, text)
        assert sorted((s.start, s.label) for s in spans if s.base) == sorted(spots)
        assert {s.label for s in spans} == labels, (i, text)
        assert all(0 <= s.start < s.stop <= n for s in spans) and [s.start for s in spans] == sorted(s.start for s in spans)


def test_no_rows(spark, texts):
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    some = spark.createDataFrame([(1, "mit license")], "doc_id long, text string")
    assert licenses.scan(some, (licenses.Template("none", "..."),)).first().spans == []
    assert [(s.label, s.start, s.stop) for s in licenses.scan(some, (licenses.Template("one", "license", True),)).first().spans] == [("one", 1, 2)]


def test_limit(spark, monkeypatch):
    monkeypatch.setattr(licenses, "MOST_GRAMS", 3)
    with pytest.raises(ValueError):
        licenses.template_table(spark, licenses.TEMPLATES)
