"""Queries of the text operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chroma, common, decontaminate, jaccard, language, licenses, negatives, packing, phrases, pitman_yor, secrets, shards, toxicity


def op3_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard(common.table(spark, sf_dir, "documents"))


def queries():
    return {"op1_pitman_yor": pitman_yor.query, "op2_toxicity": toxicity.query, "op3_shards": op3_shards, "op4_chroma": chroma.query, "op5_decontaminate": decontaminate.query, "op6_secrets": secrets.query, "op7_token_ids": packing.query, "op8_jaccard": jaccard.query, "op9_language": language.query, "op10_bpe": bpe.query, "op11_phrases": phrases.query, "op12_negatives": negatives.query, "op13_licenses": licenses.query}


#: Lower-cases A-Z and cuts words, as common.WORDS does.
WORDS_SQL = r"regexp_extract_all(translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: Every window of an item against every window of its length in the documents.
DECONTAMINATE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS_SQL.format(text='text')} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {WORDS_SQL.format(text='text')} AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(10, len(w)) AS n, list_slice(w, i, i + least(10, len(w)) - 1) AS win
       FROM (SELECT item, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT r, n, i, list_slice(w, i, i + n - 1) AS win FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)),
hits AS (SELECT dw.r, dw.i, dw.n, bw.item FROM dw JOIN bw ON dw.n = bw.n AND dw.win = bw.win),
words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hits) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hits WHERE item IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""


#: Fixed values, written apart from those of the operator: kind, base or not, characters that the group must have, group, pattern.
SECRET_RULES = (
    ("assign", True, 6, 2, r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
    ("access", True, 20, 0, "AKIA[A-Z0-9]+"),
    ("hex", True, 24, 0, "[0-9a-f]+"),
    ("pem", False, 20, 0, "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    ("jwt", False, 30, 0, "eyJ[A-Za-z0-9_-]+[.]eyJ[A-Za-z0-9_-]+[.][A-Za-z0-9_-]+"),
)


def _secrets_sql() -> str:
    """Each rule's matches by the pieces between them, whose lengths add up to places."""
    of_rule = "SELECT r, {rank} AS rank, '{kind}' AS kind, {base} AS base, {least} AS least, regexp_extract_all(t, '{pattern}') AS hits, string_split_regex(t, '{pattern}') AS gaps, regexp_extract_all(t, '{pattern}', {group}) AS told FROM d"
    rules = [of_rule.format(rank=i, kind=kind, base=str(base).lower(), least=least, pattern=pattern.replace("'", "''"), group=group) for i, (kind, base, least, group, pattern) in enumerate(SECRET_RULES)]
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
m AS ({" UNION ALL ".join(rules)}),
one AS (SELECT r, rank, kind, base, least, unnest(hits) AS hit, unnest(list_slice(gaps, 1, len(hits))) AS gap, unnest(told) AS told, unnest(range(1, len(hits) + 1)) AS i FROM m WHERE len(hits) > 0),
spots AS (SELECT *, CAST(sum(length(gap) + length(hit)) OVER (PARTITION BY r, rank ORDER BY i) AS BIGINT) AS stop FROM one),
found AS (SELECT r, rank, kind, base, stop - length(hit) AS start, stop FROM spots WHERE length(told) >= least),
told AS (SELECT r, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
         string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER (base) AS base, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS spans FROM found GROUP BY r)
SELECT doc_id, CAST(coalesce(n_assign, 0) AS BIGINT) AS n_assign, CAST(coalesce(n_access, 0) AS BIGINT) AS n_access, CAST(coalesce(n_hex, 0) AS BIGINT) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN told USING (r)
"""


#: All pairs that share a shingle, their Jaccard similarity on whole sets, and the least id that links reach.
JACCARD_SQL = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS_SQL.format(text='text')} AS w FROM documents),
sh AS (SELECT DISTINCT r, list_slice(w, i, i + least(5, len(w)) - 1) AS s FROM (SELECT r, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM d WHERE len(w) > 0)),
size AS (SELECT r, count(*) AS n FROM sh GROUP BY r),
few AS (SELECT s, md5(string_agg(CAST(r AS VARCHAR), ',' ORDER BY r)) AS k, list(r) AS rows FROM sh GROUP BY s HAVING count(*) > 1),
groups AS (SELECT k, any_value(rows) AS rows, count(*) AS n FROM few GROUP BY k),
shared AS (SELECT a, b, sum(n) AS n FROM (SELECT a, unnest(rows) AS b, n FROM (SELECT unnest(rows) AS a, rows, n FROM groups)) WHERE a <> b GROUP BY a, b),
links AS (SELECT a, b, shared.n = x.n AND shared.n = y.n AS same FROM shared JOIN size x ON x.r = a JOIN size y ON y.r = b WHERE shared.n >= 0.8 * (x.n + y.n - shared.n) - 1e-6),
reach AS (SELECT r AS a, r AS b FROM size UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
root AS (SELECT a AS r, min(doc_id) AS group_id FROM reach JOIN d ON d.r = b GROUP BY a),
sets AS (SELECT a AS r, min(doc_id) AS other FROM links JOIN d ON d.r = b WHERE same GROUP BY a),
n AS (SELECT a AS r, count(*) AS n_links FROM links GROUP BY a),
unlike AS (SELECT a AS r, count(DISTINCT least(o.doc_id, coalesce(sets.other, o.doc_id))) AS n_texts FROM links JOIN d o ON o.r = b LEFT JOIN sets ON sets.r = b WHERE NOT same GROUP BY a)
SELECT d.doc_id, least(d.doc_id, coalesce(other, d.doc_id)) AS set_id, coalesce(group_id, d.doc_id) AS group_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, CAST(coalesce(n_texts, 0) AS BIGINT) AS n_texts
FROM d LEFT JOIN root USING (r) LEFT JOIN sets USING (r) LEFT JOIN n USING (r) LEFT JOIN unlike USING (r)
"""


def _licenses_sql() -> str:
    """Base phrases by comparing word lists; other labels from the grams of each template that stand on a diagonal or its neighbours."""
    base = [("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license")]
    notices = ", ".join(f"({i}, '{t.label}', '{' '.join(t.words)}')" for i, t in enumerate(licenses.NOTICES))
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS_SQL.format(text='text')} AS w FROM documents),
phrases AS (SELECT label, string_split(p, ' ') AS p FROM (VALUES {', '.join(map(str, base))}) AS x(label, p)),
spots AS (SELECT r, label, i - 1 AS spot FROM (SELECT r, w, label, p, unnest(range(1, len(w) - len(p) + 2)) AS i FROM d, phrases WHERE len(w) >= len(p)) WHERE list_slice(w, i, i + len(p) - 1) = p),
places AS (SELECT r, count(*) AS n, min(spot) AS a, max(spot) AS z, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM spots GROUP BY r),
n AS (SELECT t, label, string_split(p, ' ') AS p FROM (VALUES {notices}) AS x(t, label, p)),
tg AS (SELECT t, label, len(p) AS m, i - 1 AS tp, list_slice(p, i, i + 2) AS g FROM (SELECT *, unnest(range(1, len(p) - 1)) AS i FROM n)),
dg AS (SELECT r, i - 1 AS dp, list_slice(w, i, i + 2) AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) > 2)),
v AS (SELECT r, t, label, m, m // 8 AS near, dp - tp AS diag, tp, dp FROM dg JOIN tg USING (g)),
strong AS (SELECT *, count(*) OVER (PARTITION BY r, t, diag) AS n FROM v QUALIFY n > 1 OR m < 8),
marked AS (SELECT *, CASE WHEN coalesce(diag - lag(diag) OVER (PARTITION BY r, t ORDER BY diag, tp), 9) > least(3, near) THEN 1 ELSE 0 END AS new FROM strong),
runs AS (SELECT *, sum(new) OVER (PARTITION BY r, t ORDER BY diag, tp ROWS UNBOUNDED PRECEDING) AS run FROM marked),
alone AS (SELECT r, label, count(DISTINCT tp) / (m - 2) AS share FROM runs GROUP BY r, t, label, m, diag),
merged AS (SELECT r, label, count(DISTINCT tp) / (m - 2) AS share FROM runs GROUP BY r, t, label, m, run HAVING count(DISTINCT diag) > 1 AND 2 * count(*) >= max(dp) + 3 - min(dp)),
shares AS (SELECT * FROM alone UNION ALL SELECT * FROM merged UNION ALL SELECT r, label, 1.0 FROM spots),
best AS (SELECT r, max(share) AS score, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (share >= 0.5) AS labels FROM shares GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(places.n, 0) AS BIGINT) AS n_base, CAST(a AS BIGINT) AS first_word, CAST(z AS BIGINT) AS last_word,
       coalesce(places.labels, '') AS base_labels, coalesce(best.labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM d LEFT JOIN places USING (r) LEFT JOIN best USING (r)
"""


#: Every n-gram of 1 to 4 words by its words.
PHRASES_SQL = r"""
WITH w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (SELECT coalesce(lang, 'und') AS lang,
             unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
total AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
g AS (SELECT lang, p, count(*) AS f FROM (SELECT lang, list_slice(w, i, i + k - 1) AS p FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, range(1, 5) AS x(k) WHERE len(w) >= k)) GROUP BY lang, p HAVING count(*) >= 30),
c AS (SELECT lang, p, f, unnest(range(1, len(p))) AS k FROM g WHERE len(p) > 1),
s AS (SELECT c.lang, c.p, c.f, k, x.f AS l, y.f AS r, 2000000 * CAST(c.f AS HUGEINT) // (x.f + y.f) AS score
      FROM c JOIN g x ON x.lang = c.lang AND x.p = list_slice(c.p, 1, k) JOIN g y ON y.lang = c.lang AND y.p = list_slice(c.p, k + 1, len(c.p))),
low AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
inside AS (SELECT lang, list_slice(p, i, i + k - 1) AS p, max(f) AS longer FROM (SELECT lang, p, f, k, unnest(range(1, len(p) - k + 2)) AS i FROM c WHERE k > 1) GROUP BY ALL),
kept AS (SELECT low.lang, array_to_string(low.p, ' ') AS phrase, f AS a, l, r, score FROM low LEFT JOIN inside ON inside.lang = low.lang AND inside.p = low.p WHERE longer IS NULL OR 100 * CAST(longer AS HUGEINT) < 80 * CAST(f AS HUGEINT)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, n, CAST(score AS BIGINT) AS score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""


#: Every anchor against every row, exactly.
NEGATIVES_SQL = """
WITH e AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS alike, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
      FROM e a JOIN e b ON a.vec_id % 100 = 0 AND (a.vec_id <> b.vec_id OR a.label <> b.label OR a.v <> b.v)),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE alike QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS rank, id AS negative_id, positive_score, score AS negative_score
      FROM p JOIN s USING (anchor_id) WHERE NOT alike AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_decontaminate": DECONTAMINATE_SQL, "op6_secrets": _secrets_sql(), "op8_jaccard": JACCARD_SQL, "op11_phrases": PHRASES_SQL, "op12_negatives": NEGATIVES_SQL, "op13_licenses": _licenses_sql()}
