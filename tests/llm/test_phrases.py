"""Phrase mining against counting every n-gram in dictionaries, and the suffix array against sorting."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from kithgraph.llm import phrases

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def plain(rows, rule):
    f, n = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, rule.words + 1):
                f.setdefault(lang, Counter()).update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, count in f.items():
        some = {p: c for p, c in count.items() if len(p) > 1 and c >= rule.least}
        told = []
        for p, a in some.items():
            score, k = min((2_000_000 * a // (count[p[:k]] + count[p[k:]]), k) for k in range(1, len(p)))
            if not any(len(q) > len(p) and 100 * c >= rule.share * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, c in some.items()):
                told.append((-score, -a, " ".join(p).encode(), count[p[:k]], count[p[k:]]))
        out += [(lang, r, p.decode(), -a, x, y, n[lang], -s) for r, (s, a, p, x, y) in enumerate(sorted(told)[: rule.top], 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    words = ["An", "the", "of", "café", "日本", "x y", "b\x00c", "it's", "É", "ſ", "w1", "w2"]
    out = [(None, "en"), ("", None), (" \t ", "en"), (".,;:!?\n\x0b\x0c\r", "en"), ("one", "xx"), ("same words here always, ", "en")]
    for i in range(150):
        t = "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ", ", ".", "\n", " a\x85b "]) for _ in range(rng.randint(1, 60)))
        out.append((t, rng.choice(["en", "en", "fr", None, "und", ""])))
    return out + [("New York City hall and New York City park " * 40, "en"), ("the of " * 20_000, "fr")] + [("Very hot line of very hot words. " * 3, "de")] * 60


@pytest.mark.parametrize(("rule", "bits"), [(phrases.Rule(4, 5, 80, 40), 1 << 15), (phrases.Rule(), 1 << 20), (phrases.Rule(3, 2, 50, 10_000), 1 << 16)])
def test_mine(spark, rows, rule, bits):
    df = spark.createDataFrame(rows, "text string, lang string").withColumns({c: F.lit("clash") for c in ("phrase", "l", "r", "n", "h", "words", "t", "part")}).repartition(3)
    assert sorted(map(tuple, phrases.mine(df, rule, bits=bits).collect())) == plain(rows, rule)


def test_no_rows(spark):
    df = spark.createDataFrame([], "text string, lang string")
    assert phrases.mine(df, bits=1 << 15).count() == 0
    with pytest.raises(ValueError):
        phrases.counted(df, bits=100_000)


@pytest.mark.parametrize("depth", [1, 2, 3, 4, 7])
def test_suffix_array(depth):
    rng = np.random.default_rng(depth)
    for size in (0, 1, 2, 400):
        codes = rng.integers(0, 4, size).astype(np.int32)
        ahead = [tuple(np.concatenate([codes, np.zeros(depth, int)])[i : i + depth]) for i in range(size)]
        order = phrases.suffix_array(codes, depth)
        assert sorted(order.tolist()) == list(range(size)) and [ahead[i] for i in order] == sorted(ahead)
        for n, (places, counts) in enumerate(phrases.intervals(codes, depth), 1):
            want = Counter(a[:n] for a in ahead if 0 not in a[:n])
            assert {ahead[p][:n]: c for p, c in zip(places.tolist(), counts.tolist(), strict=True)} == dict(want) and len(places) == len(want)


def test_filter(spark):
    h = np.random.default_rng(1).integers(-(2**63), 2**63, 3000)
    counts = spark.createDataFrame([(int(x), 1 + i % 3) for i, x in enumerate(h)], "h long, c long")
    from kithgraph.llm import common

    made = phrases._filter(counts, 3, 1 << 15, common.scratch(spark, "filter")).value
    assert made.has(h[2::3].view(np.uint64)).all()
    assert np.unpackbits(made.bytes).sum() == len(np.unique(h[2::3] & ((1 << 15) - 1)))
