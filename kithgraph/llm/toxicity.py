"""Toxicity: a Levenshtein automaton intersected with a lexicon trie, and scores of the words around each hit.

The lexicon is learned from labelled texts: words and word beginnings that toxic texts hold far more often. It is a trie;
the automaton of one edit runs over it as a lazily built deterministic machine, so a word costs one look-up a letter and
ends early when no term is near. Hits are weighed by what stands around them: quotation marks and words of report, or
words of address. A logistic regression over these features gives the score.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Bounds of the labelled sample, by class, and of the lexicon.
SAMPLE_TOXIC, SAMPLE_CLEAN, TERMS = 6000, 12000, 1500
LEAST_DOCS, LEAST_ODDS = 5, 2.5
SHORT, STEM, AROUND = 4, 5, 6
#: Of the words of the lexicon, the shortest; and what an edit of a term of SHORT letters weighs.
LEAST_LETTERS, SHORT_EDIT = 3, 0.5
#: Marks and words around a hit, parameters of the context features: quotation, report and address in five languages.
QUOTES = re.compile(b"|".join(c.encode() for c in "\"'«»“”„‘’`"))
REPORT = frozenset("said says say called calls wrote writes word words term quote quoted quotes dit dite mot wort sagte palabra dijo llamó".split())
ADDRESS = frozenset("you your you're youre u are yourself du dich dir ihr euch sie vous votre tu te toi tú usted eres ustedes".split())


class Machine:
    """Trie x Levenshtein(1), made deterministic as it is used. A word's result is (kind, weight).

    kind: 0 none, 1 a term, 2 one edit from a term, 3 begins with a stem, 4 begins one edit from a stem. Terms and stems
    shorter than SHORT + 1 allow no edit; with `short`, terms of SHORT letters allow one, at SHORT_EDIT of their weight. Any
    letter may be the edited one, the first too. Words may have any length; the machine stops where no term is near.
    """

    def __init__(self, terms: dict[str, float], stems: dict[str, float], edits: int = 1, short: bool = False):
        self.short = short
        self.edits, self.children, self.term, self.stem, self.size = edits, [{}], {}, {}, [0]
        for words, ends in ((terms, self.term), (stems, self.stem)):
            for w, weight in words.items():
                node = 0
                for c in w:
                    if c not in self.children[node]:
                        self.children[node][c] = len(self.children)
                        self.children.append({})
                        self.size.append(self.size[node] + 1)
                    node = self.children[node][c]
                ends[node] = max(weight, ends.get(node, 0.0))
        self.first = self._closed({(0, 0)})
        self.steps: dict = {}
        self.ends: dict = {}
        self.seen: dict = {}

    def _closed(self, states: set) -> frozenset:
        todo, best = list(states), {}
        while todo:
            node, e = todo.pop()
            if best.get(node, self.edits + 1) <= e:
                continue
            best[node] = e
            if e < self.edits:
                todo += [(child, e + 1) for child in self.children[node].values()]
        return frozenset(best.items())

    def _step(self, state: frozenset, c: str) -> frozenset:
        new = set()
        for node, e in state:
            if (child := self.children[node].get(c)) is not None:
                new.add((child, e))
            if e < self.edits:
                new.add((node, e + 1))
                new.update((child, e + 1) for child in self.children[node].values())
        return self._closed(new)

    def _end(self, state: frozenset, ends: dict) -> list[tuple[int, float]]:
        found = [(e, ends[node]) for node, e in state if node in ends and (e == 0 or self.size[node] > SHORT)]
        if self.short and ends is self.term:
            found += [(e, SHORT_EDIT * ends[node]) for node, e in state if node in ends and e and self.size[node] == SHORT]
        return found

    def __call__(self, word: str) -> tuple[int, float]:
        if len(self.steps) > 500_000:
            self.steps.clear()
        state, stem = self.first, []
        for c in word:
            key = (state, c)
            nxt = self.steps.get(key)
            if nxt is None:
                nxt = self.steps[key] = self._step(state, c)
            state = nxt
            if not state:
                break
            if state not in self.ends:
                self.ends[state] = (self._end(state, self.term), self._end(state, self.stem))
            stem += self.ends[state][1]
        term = self.ends[state][0] if state and state in self.ends else []
        found = [(1 + e, w) for e, w in term] + [(3 + e, w) for e, w in stem]
        return min(found, key=lambda x: (x[0], -x[1])) if found else (0, 0.0)


FEATURES = ("bias", "terms", "near terms", "stems", "near stems", "weight", "weight a word", "quoted", "addressed", "densest window", "distinct")


def quote_marks(text: str, n: int) -> list[bool]:
    """For each of a text's n words, whether the raw token (between white space) that holds it has a quotation mark."""
    data = text.encode("utf-8", "surrogatepass")
    at = np.array([m.start() for m in QUOTES.finditer(data)], np.int64)
    if not len(at):
        return [False] * n
    space = np.isin(np.frombuffer(data, np.uint8), np.frombuffer(b" \t\n\r\x0b\x0c", np.uint8))
    inside = np.frombuffer(data.translate(common.WORDS), np.uint8) != 32
    token = np.cumsum(space)
    begins = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))
    return np.isin(token[begins], token[at]).tolist()


def features(text: str, spots: np.ndarray, kinds: np.ndarray, weights: np.ndarray, words: list[str]) -> list[float]:
    """spots: the places of hits among all words of the text."""
    n = [float(np.log1p((kinds == k).sum())) for k in (1, 2, 3, 4)]
    total = float(weights.sum())
    quoted = addressed = 0.0
    if len(spots):
        marks = quote_marks(text, len(words))
        for i, s in enumerate(spots.tolist()):
            a, b = max(0, s - AROUND), s + 1 + AROUND
            near = words[a:s] + words[s + 1 : b]
            said = any(w in REPORT for w in near)
            marked = said and any(marks[j] and words[j] == words[s] for j in range(a, min(b, len(words))))
            quoted += weights[i] * (0.5 * said + 0.5 * marked)
            addressed += weights[i] * any(w in ADDRESS for w in near)
    dense = float(max((np.searchsorted(spots, s + 2 * AROUND) - i for i, s in enumerate(spots.tolist())), default=0))
    distinct = len({words[s] for s in spots.tolist()})
    return [1.0, *n, float(np.log1p(total)), float(np.log1p(100 * total / max(1, len(words)))), float(np.log1p(quoted)), float(np.log1p(addressed)), float(np.log1p(dense)), float(np.log1p(distinct))]


class Scorer:
    def __init__(self, terms: dict[str, float], stems: dict[str, float]):
        self.machine, self.known = Machine(terms, stems, short=True), {}

    def __call__(self, texts: pa.Array) -> np.ndarray:
        words, counts = common.flat_words(texts, common.WORDS)
        values, codes = common.coded(words)
        if len(self.known) > 400_000:
            self.known.clear()
        kind, weight = np.zeros(len(values), np.int8), np.zeros(len(values))
        for i, v in enumerate(values):
            got = self.known.get(v)
            if got is None:
                got = self.known[v] = self.machine(v.decode("utf-8", "replace"))
            if got[0]:
                kind[i], weight[i] = got
        out = np.zeros((len(counts), len(FEATURES)))
        out[:, 0] = 1.0
        if not len(codes):
            return out
        k, ends = kind[codes], np.cumsum(counts)
        hits = np.flatnonzero(k)
        doc = np.searchsorted(ends, hits, side="right")
        for d in np.unique(doc).tolist():
            a, b = np.searchsorted(doc, [d, d + 1])
            spots, begin = hits[a:b], int(ends[d] - counts[d])
            own = [w.decode("utf-8", "replace") for w in words[begin : int(ends[d])]]
            out[d] = features(texts[d].as_py(), spots - begin, k[spots], weight[codes[spots]], own)
        return out


def lexicon(sample: DataFrame) -> tuple[dict[str, float], dict[str, float]]:
    """Words and stems (beginnings of STEM letters of longer words) by log odds of document counts. sample: text, toxic."""

    def run(batches):
        for batch in common.slices(batches, "text"):
            words, counts = common.flat_words(batch.column(0), common.WORDS)
            seen: dict = {}
            at = 0
            for n, toxic in zip(counts.tolist(), batch.column(1).to_pylist(), strict=True):
                own = {w.decode("utf-8", "replace") for w in words[at : at + n]}
                at += n
                for t in {w for w in own if len(w) >= LEAST_LETTERS} | {w[:STEM] + "*" for w in own if len(w) > STEM}:
                    p = seen.setdefault(t, [0, 0])
                    p[toxic] += 1
            yield pa.RecordBatch.from_pydict({"term": pa.array(list(seen), pa.string()), "clean": pa.array([v[0] for v in seen.values()], pa.int64()), "toxic": pa.array([v[1] for v in seen.values()], pa.int64())})

    totals = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    p, n = totals.get(1, 0), totals.get(0, 0)
    if not p or not n:
        return {}, {}
    odds = F.log((F.col("t") + 0.5) / F.lit(p + 1.0)) - F.log((F.col("c") + 0.5) / F.lit(n + 1.0))
    counted = sample.select("text", "toxic").mapInArrow(common.lean(run), "term string, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("c"), F.sum("toxic").alias("t"))
    top = counted.where(F.col("t") >= max(LEAST_DOCS, p // 500)).withColumn("odds", odds).where(F.col("odds") >= LEAST_ODDS).orderBy(F.desc(F.col("odds") * F.sqrt("t")), "term").limit(TERMS).collect()
    stems = {r.term[:-1]: float(r.odds) for r in top if r.term.endswith("*")}
    return {r.term: float(r.odds) for r in top if not r.term.endswith("*") and not (len(r.term) > STEM and r.term[:STEM] in stems)}, stems


def fit(x: np.ndarray, y: np.ndarray, l2: float = 1e-3, steps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Weights of a logistic regression by Newton's method, and the features' scales."""
    scale = np.maximum(np.abs(x).max(axis=0), 1e-9)
    x, w = x / scale, np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) / len(y) + l2 * w
        h = (x * (p * (1 - p))[:, None]).T @ x / len(y) + l2 * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w, scale


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic"):
    """A model from labelled texts, a hash sample of at most about SAMPLE_TOXIC and SAMPLE_CLEAN. Labels that repeat: the greatest.

    The chosen ids are at most that many, so they are broadcast. Without texts of both classes the model is None.
    """
    marks = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg(F.max(F.col(label_col).cast("int")).alias("toxic"))
    totals = {r.toxic: r["count"] for r in marks.groupBy("toxic").count().collect()}
    bucket = F.xxhash64("doc_id").bitwiseAND((1 << 20) - 1)
    share = lambda t, most: int(min(1.0, most / max(1, totals.get(t, 0))) * (1 << 20))
    chosen = marks.where(bucket <= F.when(F.col("toxic") == 1, share(1, SAMPLE_TOXIC)).otherwise(share(0, SAMPLE_CLEAN)))
    sample = common.kept(docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id").select("text", "toxic"), "toxic-sample")
    terms, stems = lexicon(sample)

    def run(batches):
        score = Scorer(terms, stems)
        for batch in common.slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([pa.array(score(batch.column(0)).tolist(), pa.list_(pa.float64())), batch.column(1)], ["x", "toxic"])

    rows = sample.select("text", "toxic").mapInArrow(common.lean(run), "x array<double>, toxic int").toArrow()
    y = np.array(rows.column(1).to_pylist(), float)
    if len(set(y.tolist())) < 2:
        return None
    # classes were sampled apart: weights restore their shares
    x = np.array(rows.column(0).to_pylist())
    w, scale = fit(x, y)
    shift = np.log(max(totals.get(1, 1), 1) / max((y == 1).sum(), 1)) - np.log(max(totals.get(0, 1), 1) / max((y == 0).sum(), 1))
    w = w.copy()
    w[0] += shift * scale[0]
    return terms, stems, w, scale


def score(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score for every row; null and empty texts have no hits. Without a model every score is 0."""

    def run(batches):
        scorer = Scorer(model[0], model[1]) if model else None
        for batch in common.slices(batches, "text"):
            p = 1 / (1 + np.exp(-np.clip(scorer(batch.column(1)) / model[3] @ model[2], -700, 700))) if model else np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(p)], ["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(common.lean(run), "doc_id long, score double")


def query(spark, sf_dir: str) -> DataFrame:
    docs, labels = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")
    common.shared_dir(spark)
    model = train(docs, labels.where(common.remainder("doc_id", 4) != 2))
    return score(docs, model).select("doc_id", (common.remainder("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
