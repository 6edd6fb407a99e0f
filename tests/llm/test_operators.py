"""Each operator against brute force or a library, over nulls, empty and long texts, repeats, ties and empty tables."""

import collections
import hashlib
import math
import re
import struct
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kithgraph.llm import bpe, chroma, common, decontaminate, groups, jaccard, language, packing, pitman_yor, secrets, shards, toxicity

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def cut(text):
    return WORD.findall((text or "").translate(LOWER))


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


# --- 3


def test_shards(docs, raw, nothing):
    got = by_id(shards.shard(docs))
    sums, texts = collections.Counter(), {}
    for i, t, *_ in raw:
        b = (t or "").encode()
        assert (got[i].size, got[i].text_crc32, got[i].law) == (len(b) + 1, zlib.crc32(b), "bytes")
        sums[got[i].shard] += len(b) + 1
        assert texts.setdefault(t or "", got[i].shard) == got[i].shard
    atoms = collections.Counter()
    for _, t, *_ in raw:
        atoms[hashlib.md5((t or "").encode()).hexdigest()] += len((t or "").encode()) + 1
    sizes = [atoms[k] for k in sorted(atoms)]

    def fits(c):
        n, s = 1, 0
        for x in sizes:
            if x > c:
                return False
            n, s = (n + 1, x) if s + x > c else (n, s + x)
        return n <= 8

    assert max(sums.values()) == next(c for c in range(max(sizes), sum(sizes) + 1) if fits(c))
    slots = collections.defaultdict(list)
    for r in got.values():
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert shards.shard(nothing).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_shard_plan(spark, seed):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(1, 1000, 3000)
    sizes[7] = 400_000 if seed % 2 else 5
    df = spark.createDataFrame([(hashlib.md5(str(i).encode()).hexdigest(), int(s)) for i, s in enumerate(sizes)], "digest string, size long")
    plan = shards.plan(df, 8)
    rows = sorted(map(tuple, df.collect()))

    def fits(c):
        n, s = 1, 0
        for _, x in rows:
            if x > c:
                return False
            n, s = (n + 1, x) if s + x > c else (n, s + x)
        return n <= 8

    assert fits(plan.capacity) and not fits(plan.capacity - 1)
    sums = collections.Counter()
    for d, x in rows:
        sums[sum(d >= c for c in plan.cuts)] += x
    assert max(sums.values()) <= plan.capacity


# --- 5


def test_decontaminate(docs, raw, benchmark, nothing):
    windows = collections.defaultdict(set)
    for r in benchmark.collect():
        w = cut(r.text)
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[k : k + n])] |= {str(r.item_id)} if r.item_id is not None else set()
    got = by_id(decontaminate.match(docs, benchmark))
    for i, t, *_ in raw:
        w, hit, items = cut(t), set(), set()
        for n in {len(k) for k in windows}:
            for k in range(len(w) - n + 1):
                if (key := tuple(w[k : k + n])) in windows:
                    hit |= set(range(k, k + n))
                    items |= windows[key]
        listed = ",".join(sorted(items))
        assert (got[i].n_words, got[i].n_hit, got[i].n_items, got[i].items_sha256) == (len(w), len(hit), len(items), hashlib.sha256(listed.encode()).hexdigest())
        assert got[i].hit_words == sorted(hit)
    assert got[90].n_hit == 13 and got[92].n_hit == 10 and got[91].n_hit == 0 and got[93].n_hit == 3
    assert decontaminate.match(nothing, benchmark).count() == 0
    assert decontaminate.match(docs, benchmark.limit(0)).agg(F.sum("n_hit")).first()[0] == 0


def test_blocks(docs, benchmark, monkeypatch):
    whole = {i: tuple(r) for i, r in by_id(decontaminate.match(docs, benchmark)).items()}
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 20)
    assert {i: tuple(r) for i, r in by_id(decontaminate.match(docs, benchmark)).items()} == whole


def test_winnowing_guarantee():
    rng = np.random.default_rng(0)
    for _ in range(50):
        shared = rng.integers(0, 2**63, 10).astype(np.uint64)
        a, b = (np.concatenate([rng.integers(0, 2**63, 30).astype(np.uint64), shared, rng.integers(0, 2**63, 30).astype(np.uint64)]) for _ in range(2))
        ga, gb = common.ngram_hashes(a, decontaminate.GRAM), common.ngram_hashes(b, decontaminate.GRAM)
        assert set(ga[decontaminate.winnow(ga)].tolist()) & set(gb[decontaminate.winnow(gb)].tolist())


# --- 6


def expected_spans(text):
    kinds = [("assign", re.compile(secrets.BASE[0].pattern.replace("(?i)", "").replace("(password|passwd|secret|token|api_?key)", "((?i:password|passwd|secret|token|api_?key))"), re.A), 2, 6), ("access", re.compile(secrets.BASE[1].pattern), 0, 20), ("hex", re.compile(secrets.BASE[2].pattern), 0, 24)]
    return sorted((m.start(), k, m.end(), name) for k, (name, p, g, least) in enumerate(kinds) for m in p.finditer(text or "") if len(m.group(g)) >= least)


def test_secrets(spark, docs, raw, nothing, tmp_path):
    path = "file://" + str(tmp_path / "ledger")
    got = by_id(secrets.findings(docs, path))
    for i, t, *_ in raw:
        base = [(f.start, f.stop, f.kind) for f in got[i].found if f.kind in ("assign", "access", "hex")]
        assert base == [(a, b, n) for a, _, b, n in expected_spans(t)]
    assert got[86].found
    scanned = spark.read.parquet(path).count()
    assert scanned == len({t or "" for _, t, *_ in raw})
    # the same versions again, one new blob, one new rule version
    more = docs.unionByName(docs.where("doc_id = 0").withColumn("text", F.lit("secret=newsecret1")))
    secrets.findings(more, path).count()
    assert spark.read.parquet(path).count() == scanned + 1
    rules = (*secrets.RULES[1:], secrets.Rule("assign", 2, secrets.BASE[0].pattern, 6, 2))
    secrets.findings(more, path, rules=rules).count()
    again = spark.read.parquet(path)
    assert again.count() == 2 * (scanned + 1) and again.where("size(rules) = 1").count() == scanned + 1
    assert secrets.findings(nothing, "file://" + str(tmp_path / "none")).count() == 0


def test_many_secrets(spark, tmp_path, monkeypatch):
    """More matches than are walked at a time, and a batch that was appended twice."""
    monkeypatch.setattr(secrets, "STRIDE", 7)
    text = " é ".join(("deadbeef" * 3, "token=abc", "token=abcdefg")[i % 3] for i in range(50))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    path = "file://" + str(tmp_path / "ledger")
    want = [(a, b, n) for a, _, b, n in expected_spans(text)]
    assert [(f.start, f.stop, f.kind) for f in secrets.findings(df, path).first().found] == want and len(want) > 30
    spark.read.parquet(path).coalesce(1).write.mode("append").parquet(path)
    assert [(f.start, f.stop, f.kind) for f in secrets.findings(df, path).first().found] == want


def test_redaction(spark):
    df = spark.createDataFrame([("ab secret=abcdefgh é password=12345678",)], "text string").withColumn("doc_id", F.lit(1))
    found = secrets.findings(df, common.scratch(spark, "ledger"))
    assert found.select(secrets.redact(F.col("text"), F.col("found")).alias("t")).first().t == "ab [secret] é [secret]"


# --- 7


def test_packing_round_trip():
    rng = np.random.default_rng(0)
    for n in (0, 1, 127, 128, 129, 5000):
        for top in (1, 2, 300, 2**31):
            x = rng.integers(0, top, n)
            x[::50] = rng.integers(0, 2**32 - 1, len(x[::50]))
            image = packing.pack(x)
            assert (packing.unpack(image) == x).all() and len(packing.unpack(image)) == n
    assert (packing.unpack(packing.pack(np.arange(1000)), 2, 4) == np.arange(256, 512)).all()
    with pytest.raises(ValueError):
        packing.unpack(b"none" * 9)


def test_token_files(spark, docs, raw, nothing):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t, model, at = Tokenizer.from_file(path), open(path, encoding="utf-8").read(), 0
    out = common.scratch(spark, "ids")
    packing.write(docs, out, model)
    got = by_id(packing.read(spark, out))
    for i, text, *_ in sorted(raw):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        at += len(ids)
    packing.write(nothing, empty := common.scratch(spark, "ids"), model)
    assert packing.read(spark, empty).count() == 0


def test_word_encoder():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t, e = Tokenizer.from_file(path), packing.encoder(open(path, encoding="utf-8").read())
    texts = ["", "x<|endoftext|>y <|ENDOFTEXT|> a", "É́tude, ŒUVRE! ß. İstanbul ΣΑΣ. KK", "12,5. 3.", "ab ", "!!!... —. 'S 's. it's,", "½. Ⅷ, ª."]
    ids, n = e(pa.array(texts), 2)
    want = [t.encode(x, add_special_tokens=False).ids + [2] for x in texts]
    assert ids.tolist() == [i for w in want for i in w] and n.tolist() == [len(w) for w in want]


# --- 8


def test_jaccard(docs, raw, nothing):
    sets = {i: frozenset(tuple(w[k : k + min(5, len(w))]) for k in range(len(w) - min(5, len(w)) + 1)) if (w := cut(t)) else frozenset() for i, t, *_ in raw}
    links, root = collections.Counter(), {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                a, b = sorted((find(i), find(j)))
                root[b] = a
    got = by_id(jaccard.join(docs))
    assert {i: (r.n_links, r.group_id) for i, r in got.items()} == {i: (links[i], find(i)) for i in sets}
    assert jaccard.join(nothing).count() == 0


def test_repeated_ids(spark):
    """Rows of one id with unlike texts are documents of their own."""
    x, y = " ".join(f"x{i}" for i in range(40)), " ".join(f"y{i}" for i in range(40))
    rows = [(5, x), (5, y), (1, x), (5, y), (7, y + " more"), (None, x), (8, None), (8, "")]
    got = jaccard.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert len(got) == len(rows)
    h = {r.t: r.h for r in spark.createDataFrame([(t,) for t in (x, y, y + " more")], "t string").withColumn("h", F.xxhash64("t")).collect()}
    told = collections.Counter((r.doc_id, r.text_hash, r.group_id, r.group_hash, r.n_links, r.n_texts) for r in got if r.doc_id not in (None, 8))
    assert told == {(5, h[x], 1, h[x], 1, 0): 1, (1, h[x], 1, h[x], 1, 0): 1, (5, h[y], 5, h[y], 2, 1): 2, (7, h[y + " more"], 5, h[y], 2, 1): 1}
    assert all(r.group_id == r.doc_id and r.n_links == 0 for r in got if r.doc_id in (None, 8))


def test_blocks_of_a_large_group(docs, monkeypatch):
    whole = {i: tuple(r) for i, r in by_id(jaccard.join(docs)).items()}
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    assert {i: tuple(r) for i, r in by_id(jaccard.join(docs)).items()} == whole


def test_bands():
    b, r = jaccard.bands_and_rows()
    assert 1 - (1 - 0.8**r) ** b >= 0.9999 and b * r <= 512


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (101, 102), (200, 200)]
    got = {r.node: r.root for r in groups.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[102] == 100 and 200 not in got


# --- 9


def test_language(spark, nothing):
    rng = np.random.default_rng(2)
    forms = {"aa": "ka lo mi".split(), "bb": "str ung ich".split()}
    rows = [(i, " ".join("".join(rng.choice(forms[lang], 3)) for _ in range(30)), lang) for i in range(60) for lang in [("aa", "bb")[i % 2]]]
    rows += [(100, None, "aa"), (101, "", None), (102, "12 !?", "bb"), (103, "日本", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = by_id(language.predict(docs, language.learned(docs)))
    assert all(got[i].lang_pred == lang for i, _, lang in rows[:60])
    assert [got[i].lang_pred for i in (100, 101, 102)] == ["und"] * 3 and got[103].lang_pred in forms
    assert all(0 <= r.score <= 1 for r in got.values())
    assert language.predict(nothing, language.learned(docs)).count() == 0
    assert {r.lang_pred for r in language.predict(docs, {}).collect()} == {"und"}


def test_letters(spark):
    """Numbers that are no letters leave a text without a language; marks beside letters do not."""
    rows = [(1, "½ ² Ⅷ ③"), (2, "½ a"), (3, "a" * 30_000), (3, "a" * 30_000), (4, "é" + "\u0301")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash")).withColumn("lang", F.lit("clash"))
    got = language.predict(docs, {"aa": ["a", "aa"], "bb": ["b"]}, keep=("lang", "score")).collect()
    assert sorted((r[0], r[1]) for r in got) == [(1, "und"), (2, "aa"), (3, "aa"), (3, "aa"), (4, "aa")]
    assert {r[3] for r in got} == {"clash"} and {r[4] for r in got} == {"clash"}


def test_out_of_place(spark, docs, raw):
    """Profiles and distances against plain counting."""
    import regex

    def ranked(texts):
        n = collections.Counter()
        for t in texts:
            for run in regex.findall(r"\p{L}+", t.lower()):
                w = f"_{run}_"
                n.update(g for k in (1, 2, 3) for i in range(len(w) - k + 1) if (g := w[i : i + k]) != "_")

        def tie(g):
            return int(common.mixed(np.array([sum(ord(c) * 2 ** (21 * i) for i, c in enumerate(g))], np.uint64))[0])

        return sorted(n, key=lambda g: (-n[g], tie(g)))[: language.GRAMS]

    learned = language.profiles(docs)
    want = {lang: ranked(t for _, t, x, *_ in raw if x == lang and t) for lang in {x for _, t, x, *_ in raw if x and t is not None}}
    assert learned == {k: v for k, v in want.items() if v}
    got = by_id(language.predict(docs, learned))
    for i, t, *_ in raw:
        own = ranked([t or ""])
        if not own:
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
            continue
        far = {lang: sum(abs(k - p.index(g)) if g in p else language.GRAMS for k, g in enumerate(own)) for lang, p in learned.items()}
        best = min(sorted(far), key=far.get)
        assert got[i].lang_pred == best and abs(got[i].score - (1 - far[best] / (language.GRAMS * len(own)))) < 1e-9, i


# --- 2


def test_machine():
    m = toxicity.Machine({"idiot": 3.0, "scum": 2.0}, {"lowei": 1.0})

    def near(a, b):  # at most one edit
        d = [list(range(len(b) + 1))] + [[i] + [0] * len(b) for i in range(1, len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
        return d[-1][-1]

    for w in ("idiot", "idiott", "idot", "1diot", "idxxt", "scum", "scam", "scu", "abc", "id", "idiotic"):
        assert m(w)[0] == (1 if w in ("idiot", "scum") else 2 if near(w, "idiot") == 1 else 0), w
    assert m("loweichen")[0] == 3 and m("loweschen")[0] == 4 and m("xyz")[0] == 0


def test_toxicity(spark, nothing):
    rng = np.random.default_rng(3)
    filler = ["".join(rng.choice(list("abdeglmnorstu"), 6)) for _ in range(300)]
    rows, marks = [], []
    for i in range(400):
        w = list(rng.choice(filler, 30))
        toxic = i % 4 == 0
        if toxic:
            w[5], w[9] = ("idiot", "stupid", "id1ot")[i % 3], "you"
        rows.append((i, " ".join(w)))
        marks.append((i, int(toxic)))
    rows += [(1000, None), (1001, "")]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks + marks[:3], "doc_id long, toxic int")
    model = toxicity.train(docs, labels.where("doc_id % 5 <> 0"))
    got = by_id(toxicity.score(docs, model))
    right = sum((got[i].score >= 0.3) == bool(t) for i, t in marks)
    assert right > 0.97 * len(marks) and got[1000].score < 0.3 and got[1001].score < 0.3
    assert toxicity.score(nothing, model).count() == 0
    assert toxicity.score(docs, None).agg(F.max("score")).first()[0] == 0


def test_short_terms(spark):
    """One edit of a four-letter term counts half; three-letter terms enter the lexicon and match exactly."""
    m = toxicity.Machine({"scum": 2.0, "git": 3.0, "idiot": 4.0}, {}, short=True)
    for w, want in {"scum": (1, 2.0), "scam": (2, 1.0), "scumm": (2, 1.0), "scu": (2, 1.0), "sc": (0, 0.0), "git": (1, 3.0), "gut": (0, 0.0), "gi": (0, 0.0), "idot": (2, 4.0)}.items():
        assert m(w) == want, w
    near = toxicity.FEATURES.index("near terms")
    assert toxicity.Scorer({"scum": 2.0}, {})(pa.array(["you sc0m"]))[0][near] > 0
    rows = [(f"filler word{i} git" if i % 2 else f"filler word{i}", i % 2) for i in range(40)]
    terms, _ = toxicity.lexicon(spark.createDataFrame(rows, "text string, toxic int"))
    assert "git" in terms and "filler" not in terms


def test_long_texts():
    """Each hit counts by its own window, in texts of any length: n times the passage has n times the evidence."""
    one = 'he said "scum" to you . ' + "filler " * 20
    quoted, addressed = toxicity.FEATURES.index("quoted"), toxicity.FEATURES.index("addressed")
    scorer = toxicity.Scorer({"scum": 2.0}, {})
    for n in (1, 150, 3000):
        x = scorer(pa.array([one * n]))[0]
        assert x[quoted] == pytest.approx(np.log1p(2.0 * n)) and x[addressed] == pytest.approx(np.log1p(2.0 * n))
    # a mark on the same word far away is no mark of this hit
    assert scorer(pa.array(["he said scum " + "filler " * 20 + '"scum"']))[0][quoted] == pytest.approx(np.log1p(1.0))
    text = "a «b c» d'e 'f\xa0g' h\x1ci\" é"
    words, n = common.flat_words(pa.array([text]), common.WORDS)
    own = [t for t in text.encode().split() for _ in t.translate(common.WORDS).split()]
    assert toxicity.quote_marks(text, int(n[0])) == [bool(toxicity.QUOTES.search(t)) for t in own]


# --- 10


def encoding():
    import tiktoken

    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return ranks, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe(docs, raw, nothing):
    ranks, enc = encoding()
    out = bpe.encode(docs, ranks, public_tokenizers.PATTERN, with_ids=True)
    got = by_id(bpe.decode(out, ranks))
    for i, t, *_ in raw:
        ids = enc.encode_ordinary(t or "")
        assert got[i].ids == ids and bytes(got[i].decoded) == (t or "").encode()
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    assert bpe.encode(nothing, ranks, public_tokenizers.PATTERN).count() == 0


# --- 1


def test_pitman_yor(spark, docs, raw, nothing):
    train = common.remainder("doc_id", 5) != 1
    got = by_id(pitman_yor.score(docs, train))
    tokens = {i: [*(t or "").encode().translate(common.LOWER).split(), b" end"] for i, t, *_ in raw}
    c = collections.Counter(w for i, ws in tokens.items() if zlib.crc32(str(i).encode()) % 5 != 1 for w in ws)
    n, v = sum(c.values()), len(c)
    for i, ws in tokens.items():
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(ws), sum(c[w] > 0 for w in ws), n)
        assert got[i].base_score == pytest.approx(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), rel=1e-9)
    held = [i for i in tokens if zlib.crc32(str(i).encode()) % 5 == 1]
    assert sum(got[i].score for i in held) > sum(got[i].base_score for i in held)
    assert pitman_yor.score(nothing, train).count() == 0
    untrained = by_id(pitman_yor.score(docs, F.lit(False)))
    assert untrained[0].train_tokens == 0 and untrained[0].n_known == 0


def test_predictive_probabilities(spark, raw, monkeypatch):
    """Seating and scores against plain dictionaries, with words hot enough to be dealt to several buckets and counts past EXACT."""
    monkeypatch.setattr(pitman_yor, "DISCOUNTS", (0.4,))
    monkeypatch.setattr(pitman_yor, "STRENGTHS", (30.0,))
    texts = [(i, t) for i, t, *_ in raw if i != 85] + [(1000 + i, "the cat the dog " + "the " * 12 + ("end cat " * (i % 3))) for i in range(400)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    got = by_id(pitman_yor.score(docs, common.remainder("doc_id", 5) != 1))
    end = pitman_yor.END
    tokens = {i: [*(t or "").encode().translate(common.LOWER).split(), end] for i, t in texts}
    c = collections.Counter((u, w) for i, ws in tokens.items() if zlib.crc32(str(i).encode()) % 5 != 1 for u, w in zip([end, *ws], ws, strict=False))
    words, d, s, base = {w for _, w in c}, 0.4, 30.0, 0.5
    number = {w: i for i, w in enumerate(sorted({w for ws in tokens.values() for w in ws}, key=lambda w: int(common.hashes([w])[0])))}
    t, above = dict.fromkeys(c, 1), dict.fromkeys(words, 1)

    def of(x, k):
        out = collections.Counter()
        for p, n in x.items():
            out[p[k]] += n
        return out

    customers, kept = of(c, 0), []
    assert max(c.values()) > pitman_yor.EXACT
    assert pitman_yor.hot_ways(np.array([sum(n for (_, w), n in c.items() if w == b"the")]), sum(c.values()), common.partitions(spark) * pitman_yor.BUCKETS)[0] > 1

    def draw(n, others, p, word, context, sweep):
        rng = pitman_yor.Keyed(np.array([number[word]]), None if context is None else np.array([number[context]]), sweep)
        return int(pitman_yor.seat(np.array([n]), np.array([others]), np.array([p]), d, s, rng)[0])

    for sweep in range(pitman_yor.BURN_IN + pitman_yor.SAMPLES):
        sent, total, tables = of(t, 1), of(t, 0), sum(above.values())
        up = lambda n, a: (max(n - d * a, 0) + (s + d * tables) * base / len(words)) / (s + sum(t.values()))  # noqa: E731, B023
        new = {}
        for (u, w), n in c.items():
            rest = max(sent[w] - t[u, w], 0)
            new[u, w] = draw(n, max(total[u] - t[u, w], 0), up(rest, min(above[w], rest)), w, u, sweep)
        t = new
        above = {w: draw(n, max(tables - above[w], 0), base / len(words), w, None, sweep) for w, n in of(t, 1).items()}
        if sweep >= pitman_yor.BURN_IN:
            kept.append((t, above, of(t, 0), of(t, 1)))
    for i, ws in tokens.items():
        want = 0.0
        for u, w in zip([end, *ws], ws, strict=False):
            p = 0.0
            for t, above, total, sent in kept:
                b = base / len(words) if w in words else base
                up = (max(sent.get(w, 0) - d * above.get(w, 0), 0) + (s + d * sum(above.values())) * b) / (s + sum(t.values()))
                p += (max(c.get((u, w), 0) - d * t.get((u, w), 0), 0) + (s + d * total.get(u, 0)) * up) / (s + customers.get(u, 0))
            want += math.log10(p / len(kept))
        assert got[i].score == pytest.approx(want, abs=1e-5 * len(ws)), i


def test_partitions_do_not_matter(spark, docs):
    train, before = common.remainder("doc_id", 5) != 1, spark.conf.get("spark.sql.shuffle.partitions")
    a = {r.doc_id: r.score for r in pitman_yor.score(docs, train).collect()}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "3")
        b = {r.doc_id: r.score for r in pitman_yor.score(docs, train).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert a == pytest.approx(b, abs=1e-4)


def test_seating():
    """Exact draws against the enumerated probabilities of table counts."""
    d, strength, p, c = 0.4, 3.0, 0.2, 5
    s = pitman_yor.stirling(d)
    w = np.array([math.exp(s[c, t]) * math.prod(strength + d * k for k in range(t)) * p**t for t in range(1, c + 1)])
    t = pitman_yor.seat(np.full(40_000, c), np.zeros(40_000), np.full(40_000, p), d, strength, np.random.default_rng(0))
    assert np.bincount(t, minlength=c + 1)[1:] / 40_000 == pytest.approx(w / w.sum(), abs=0.01)


# --- 4


def test_fingerprints():
    rng = np.random.default_rng(0)
    x = (128 + 60 * np.sin(2 * np.pi * np.cumsum(rng.choice([220, 330, 440, 550], 40).repeat(400)) / 8000)).astype(np.uint8)
    a = chroma.fingerprint(x.tobytes())
    b = chroma.fingerprint(x[64 * 20 :].tobytes())
    assert len(chroma.fingerprint(b"")) == 0 and len(chroma.fingerprint(b"ab")) == 1
    assert chroma.bit_error(a, b, -20) == (0.0, len(b))
    q = chroma.Queries([7], [a.tobytes()])
    assert q.align(b)[0][:2] == (0, -20)
    noisy = chroma.fingerprint(np.clip(x.astype(int) + rng.integers(-2, 3, len(x)), 0, 255).astype(np.uint8).tobytes())
    assert chroma.bit_error(a, noisy, 0)[0] < 0.1


def test_search(spark, docs, nothing):
    query = F.coalesce(F.col("doc_id") % 10 == 0, F.lit(False))
    got = by_id(chroma.search(docs, query, "doc_id", "text"))
    prints = {r.doc_id: chroma.fingerprint((r.text or "").encode()) for r in docs.select("doc_id", "text").collect()}
    asked = sorted({p.tobytes(): i for i, p in sorted(prints.items(), reverse=True) if i % 10 == 0 and len(p)}.values())
    q = chroma.Queries(asked, [prints[i].tobytes() for i in asked])
    for i, p in prints.items():
        found = [(e, asked[k], o) for k, o, _, e in q.align(p) if prints[asked[k]].tobytes() != p.tobytes()] if len(p) else []
        copy = [j for j in asked if len(p) and prints[j].tobytes() == p.tobytes() and j != i]
        assert got[i].n_queries == len(found) + len(copy)
        assert got[i].best_query == (copy[0] if copy else min(found)[1] if found else None)
    assert chroma.search(nothing, query, "doc_id", "text").count() == 0


def test_short_recordings():
    """Exact excerpts of 720 to 1,500 bytes, which are shorter than the vote floor of long recordings, are aligned with their source."""
    rng = np.random.default_rng(3)
    x = (128 + 60 * np.sin(2 * np.pi * np.cumsum(rng.choice([220, 262, 330, 392, 440, 550], 60).repeat(150)) / 8000)).astype(np.uint8).tobytes()
    q = chroma.Queries([7], [chroma.fingerprint(x).tobytes()])
    for n in (720, 800, 1000, 1500):
        p = chroma.fingerprint(x[64 * 30 : 64 * 30 + n])
        assert len(p) == 1 + (n - 704) // 64
        assert [(k, o, e) for k, o, _, e in q.align(p)] == [(0, -30, 0.0)]


def _tone(seed, n):
    rng = np.random.default_rng(seed)
    return (128 + 60 * np.sin(2 * np.pi * np.cumsum(rng.choice([220, 262, 330, 392, 440, 550], n // 150 + 1).repeat(150)[:n]) / 8000)).astype(np.uint8).tobytes()


def _brute(a, b):
    """Whether any stretch at any offset is an alignment, by trying all."""
    short = min(len(a), len(b))
    least, floor = min(chroma.OVERLAP, short), min(chroma.VOTES, short)
    for o in range(-len(a) + 1, len(b)):
        lo, hi = max(0, -o), min(len(a), len(b) - o)
        wrong = np.bitwise_count(a[lo:hi] ^ b[lo + o : hi + o]).astype(int)
        if hi - lo < least or (wrong == 0).sum() < floor:
            continue
        bits, same = (np.concatenate([[0], np.cumsum(x)]) for x in (wrong, wrong == 0))
        i, j = np.triu_indices(hi - lo + 1, least)
        if ((bits[j] - bits[i] <= chroma.ERROR * 32 * (j - i)) & (same[j] - same[i] >= floor)).any():
            return True
    return False


def test_shared_passages():
    """A passage is found between texts that differ around it, also when what it holds came earlier."""
    passage, early = _tone(1, 64 * 40), _tone(2, 64 * 200)
    a = chroma.fingerprint(early + passage + _tone(3, 64 * 200))
    b = chroma.fingerprint(_tone(4, 64 * 150) + passage + _tone(5, 64 * 250))
    assert [(q, o) for q, o, *_ in chroma.Queries([7], [a.tobytes()]).align(b)] == [(0, -50)]
    # each integer of the passage stands earlier in the query too, in another order
    p, rng = chroma.fingerprint(passage), np.random.default_rng(0)
    noise = rng.integers(0, 2**32, 300, dtype=np.uint32)
    found = chroma.Queries([7], [np.concatenate([rng.permutation(p), noise[:100], p]).tobytes()]).align(np.concatenate([noise[100:200], p]))
    assert [(q, o, e) for q, o, _, e in found] == [(0, -len(p), 0.0)]


def test_recall(raw):
    """All pairs that a brute force over all offsets and stretches aligns, and no others."""
    prints = {i: chroma.fingerprint((t or "").encode()) for i, t, *_ in raw}
    extra = prints[85][200:230]
    prints[1000], prints[1010] = np.concatenate([prints[60], extra]), np.concatenate([extra, prints[87], prints[88]])
    prints = {i: p for i, p in prints.items() if len(p)}
    asked = [i for i in prints if i % 10 == 0 or i == 85]
    q = chroma.Queries(asked, [prints[i].tobytes() for i in asked])
    got = {(asked[k], i) for i, p in prints.items() for k, *_ in q.align(p)}
    assert got == {(j, i) for j in asked for i, p in prints.items() if _brute(prints[j], p)}
    assert {(1000, 85), (1010, 85), (1000, 1010)} <= got


def test_votes(monkeypatch):
    rng = np.random.default_rng(1)
    queries, p = [rng.integers(0, 4, n, dtype=np.uint32) for n in (1, 30, 70)], rng.integers(0, 5, 50, dtype=np.uint32)
    want = collections.Counter((k, i - j) for k, q in enumerate(queries) for i, x in enumerate(p.tolist()) for j, y in enumerate(q.tolist()) if x == y)
    for most in (1 << 20, 300, 1):
        monkeypatch.setattr(chroma, "PAIRS", most)
        got = chroma.Queries([1, 2, 3], [q.tobytes() for q in queries]).votes(p)
        assert dict(zip(zip(got[0].tolist(), got[1].tolist(), strict=True), got[2].tolist(), strict=True)) == want


def test_links(spark):
    """A recording that shares passages with two queries has both links, the best first; copies of a query have it too."""
    p, q, r = _tone(11, 64 * 60), _tone(12, 64 * 60), _tone(13, 64 * 60)
    rows = [(0, _tone(14, 6400) + p), (10, q + _tone(15, 6400)), (3, p + r + q), (13, p + r + q), (4, _tone(16, 6400)), (14, q + _tone(15, 6400)), (5, None)]
    got = by_id(chroma.search(spark.createDataFrame([(i, bytearray(x) if x else x) for i, x in rows], "doc_id long, pcm binary"), F.col("doc_id") % 10 == 0, "doc_id", "pcm"))
    for i, want in {0: [], 10: [], 3: [0, 10], 13: [0, 10], 4: [], 14: [10], 5: []}.items():
        assert sorted(x.query for x in got[i].links) == want and got[i].n_queries == len(want)
        assert got[i].best_query == (min(got[i].links, key=lambda x: (x.bit_error, x.query)).query if want else None)


def test_one_id_with_two_recordings(spark, monkeypatch):
    """Classes are told apart by their prints, not by an id that several of them may share; so it is with one block a query."""
    a, b = bytearray(_tone(21, 6400)), bytearray(_tone(22, 6400))
    rows = spark.createDataFrame([(5, a), (5, b), (7, a), (9, b), (10, a), (10, b)], "doc_id long, pcm binary")
    for size in (chroma.BLOCK_BYTES, 64):
        monkeypatch.setattr(chroma, "BLOCK_BYTES", size)
        got = sorted((r.doc_id, r.class_id, r.n_queries, r.best_query, r.bit_error) for r in chroma.search(rows, F.col("doc_id").isin(7, 9), "doc_id", "pcm").collect())
        assert got == [(5, 5, 1, 7, 0.0), (5, 5, 1, 9, 0.0), (7, 5, 0, None, None), (9, 5, 0, None, None), (10, 5, 1, 7, 0.0), (10, 5, 1, 9, 0.0)]


def test_hot_blob(spark, tmp_path):
    """One blob of a million copies: merged before texts are exchanged or joined, and its paths dealt to many tasks."""
    path = "file://" + str(tmp_path / "ledger")
    secrets.scan(spark.createDataFrame([("token=firstone",)], "text string"), path)
    docs = spark.range(0, 1_000_000, 1, 32).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 1000 == 0, F.concat(F.lit("secret=number"), "id")).otherwise("password=abcdef123").alias("text"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = secrets.findings(docs, path)
        most = out.groupBy(F.spark_partition_id().alias("p")).count().agg(F.max("count")).first()[0]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert most < 600_000 and out.count() == 1_000_000 and out.where("size(found) = 1").count() == 1_000_000
    assert spark.read.parquet(path).count() == 1002


def test_decode_unknown(spark):
    ranks = {bytes([i]): i for i in range(256)} | {b"ab": 256}
    got = bpe.decode(spark.createDataFrame([([97, 256, 98],), ([],), (None,), ([97, 300],)], "ids array<int>"), ranks).collect()
    assert [None if r.decoded is None else bytes(r.decoded) for r in got] == [b"aabb", b"", None, None]
