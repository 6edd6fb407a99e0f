"""run() against a brute-force version, and the entry point with and without the text operators."""

import hashlib
import os
import shutil
import subprocess
import sys

import public_tokenizers
from test_operators import cut, encoding, expected_spans

import corpus_pipeline

REPO = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))


def test_run(spark, docs, raw, benchmark, tmp_path):
    docs.select(*corpus_pipeline.COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    benchmark.write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    # language
    left = {i: t for i, t, *_ in raw if t and any(c.isalpha() for c in t)}
    # near copies
    sets = {i: frozenset(tuple(w[k : k + min(5, len(w))]) for k in range(len(w) - min(5, len(w)) + 1)) if (w := cut(t)) else frozenset() for i, t in left.items()}
    root = {i: i for i in left}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in left:
        for j in left:
            if i < j and sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    left = {i: t for i, t in left.items() if find(i) == i}
    # benchmark
    windows = set()
    for r in benchmark.collect():
        w = cut(r.text)
        n = min(10, len(w))
        windows |= {tuple(w[k : k + n]) for k in range(len(w) - n + 1 if n else 0)}
    left = {i: t for i, t in left.items() if not any(tuple(w[k : k + n]) in windows for n in {len(x) for x in windows} for w in [cut(t)] for k in range(len(w) - n + 1))}
    # secrets
    _, enc = encoding()
    for i, t in left.items():
        out, at = "", 0
        for a, _, b, _ in expected_spans(t):
            if a >= at:
                out += t[at:a] + "[secret]"
            at = max(at, b)
        left[i] = out + t[at:]
    assert set(got) == set(left)
    for i, t in left.items():
        ids = enc.encode_ordinary(t)
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()), i
    assert public_tokenizers.PATTERN


def test_repeated_ids_and_empty_tables(spark, docs, benchmark, tmp_path):
    x, y = " ".join(f"x{c}" for c in "abcdefghijklmnop"), " ".join(f"y{c}" for c in "abcdefghijklmnop")
    rows = [(5, x, "en", "a", 0), (5, y, None, "a", 0), (1, x, "en", "a", 0), (5, y, None, "a", 0), (9, "½ ②", "en", "a", 0)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    d.write.parquet(str(tmp_path / "a" / "documents.parquet"))
    benchmark.write.parquet(str(tmp_path / "a" / "benchmark.parquet"))
    _, enc = encoding()
    want = sorted((i, hashlib.sha256(" ".join(map(str, enc.encode_ordinary(t))).encode()).hexdigest()) for i, t in ((1, x), (5, y)))
    assert sorted((r.doc_id, r.ids_sha256) for r in corpus_pipeline.run(spark, str(tmp_path / "a")).collect()) == want
    assert {r.lang for r in corpus_pipeline.languages(spark, d, "").collect()} == {"en"}
    d.limit(0).write.parquet(str(tmp_path / "b" / "documents.parquet"))
    benchmark.limit(0).write.parquet(str(tmp_path / "b" / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "b")).count() == 0


def test_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near copies", "benchmark", "secrets", "byte-level BPE"]


def test_entry_without_text_operators(tmp_path):
    shutil.copytree(REPO, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", "spark-warehouse"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'exposure_by_k' in q and not any(n.startswith('op') for n in q); assert set(e.oracle_sql()) < set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", check=True, env={**os.environ, "PYTHONPATH": ""})


def test_entry_with_text_operators():
    import __spark_entry__ as e

    names = [n for n in e.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in e.queries()
