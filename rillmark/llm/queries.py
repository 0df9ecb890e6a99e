"""The thin opN_ queries over the tables of a folder, and their SQL."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rillmark.llm import decontaminate, langid, licenses, lm, neardup, packing, quality, secrets, toxicity, vectors
from rillmark.llm.cluster import held_out
from rillmark.session import ship

Query = Callable[[SparkSession, str], DataFrame]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = quality.scored(docs, quality.trained(docs, _table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op3_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    added = packing.added_tokens(public_tokenizers.path("byte_bpe_50k.json"))
    return packing.packed(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, added)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = toxicity.scored(docs, toxicity.trained(docs, _table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scored(_table(spark, sf_dir, "documents"))


def op6_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.licences(_table(spark, sf_dir, "documents"))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"), shingle_words=2)


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.secrets(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["order"] < 3)

    def count(k: int, kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["order"] == k)).cast("long").alias(f"n_{kind}")

    counts = [count(k, kind) for k, kind in enumerate(("assign", "access", "hex"))]
    return found.select("doc_id", *counts, F.sha2(secrets.joined(base).cast("binary"), 256).alias("base_sha256"), secrets.joined(F.col("spans")).alias("spans"))


def op9_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(_table(spark, sf_dir, "embeddings"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = langid.identified(docs, langid.trained(docs))
    return found.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score")


QUERIES: dict[str, Query] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_quality": op2_quality,
    "op3_pack": op3_pack,
    "op4_toxicity": op4_toxicity,
    "op5_suffix_tree": op5_suffix_tree,
    "op6_licences": op6_licences,
    "op7_near_duplicates": op7_near_duplicates,
    "op8_secrets": op8_secrets,
    "op9_near_vectors": op9_near_vectors,
    "op10_language": op10_language,
}

_OP1 = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
p AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS phrase
  FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
c AS (
  SELECT r, n, i, array_to_string(w[i : i + n - 1], ' ') AS phrase
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM p) WHERE len(w) >= n)),
o AS (SELECT c.r, c.n, c.i, p.item_id FROM c JOIN p ON c.phrase = p.phrase AND c.n = p.n),
h AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS k FROM o) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
      FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM o) GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(t.n_items, 0) AS n_items,
       sha256(coalesce(t.items, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)
"""

_OP7 = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) < 2 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM w),
x AS (SELECT doc_id, unnest(s) AS g FROM s),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT c.a, c.b FROM c JOIN s p ON p.doc_id = c.a JOIN s q ON q.doc_id = c.b WHERE 100 * c.n >= 80 * (len(p.s) + len(q.s) - c.n)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS d, doc_id AS c FROM s UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.d)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, m.c AS component_id, s.doc_id = m.c AS kept
FROM s JOIN (SELECT d, min(c) AS c FROM r GROUP BY d) m ON m.d = s.doc_id
"""



def _op8_sql() -> str:
    parts = []
    for k, r in enumerate(secrets.RULES):
        # RE2 folds case beyond ASCII, so letters of either case are written out.
        rx = re.sub(r"\(\?i:([^)]*)\)", lambda m: "(?:" + re.sub(r"[a-z]", lambda c: f"[{c[0].upper()}{c[0]}]", m[1]) + ")", r.regex).replace("'", "''")
        parts.append(f"""
  SELECT r, {k} AS ord, '{r.kind}' AS kind, regexp_extract_all(t, '{rx}', 0) AS m, regexp_extract_all(t, '{rx}', {r.group}) AS g, string_split_regex(t, '{rx}') AS p, {r.least} AS least
  FROM d WHERE regexp_matches(t, '{rx}')""")
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
x AS ({" UNION ALL ".join(parts)}),
i AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM x),
y AS (
  SELECT r, ord, kind, m[i] AS hit, list_sum(list_transform(p[1 : i], lambda v: length(v))) + coalesce(list_sum(list_transform(m[1 : i - 1], lambda v: length(v))), 0) AS a
  FROM i WHERE length(g[i]) >= least),
z AS (SELECT r, ord, CAST(a AS BIGINT) AS a, kind || ':' || CAST(a AS BIGINT) || ':' || CAST(a + length(hit) AS BIGINT) AS s FROM y),
n AS (
  SELECT r, count(*) FILTER (ord = 0) AS n_assign, count(*) FILTER (ord = 1) AS n_access, count(*) FILTER (ord = 2) AS n_hex,
         string_agg(s, ',' ORDER BY a, ord) FILTER (ord < 3) AS base, string_agg(s, ',' ORDER BY a, ord) AS spans
  FROM z GROUP BY r)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN n USING (r)
"""


_OP9 = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
k AS (
  SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(e, e) > 0),
l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM k a JOIN k b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.98),
r AS (SELECT vec_id AS d, vec_id AS c FROM v UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.d)
SELECT v.vec_id, CAST((SELECT count(*) FROM l WHERE l.a = v.vec_id) AS BIGINT) AS n_links, m.c AS component_id, v.vec_id = m.c AS kept
FROM v JOIN (SELECT d, min(c) AS c FROM r GROUP BY d) m ON m.d = v.vec_id
"""



def _op6_sql() -> str:
    names, w, b = licenses.model()
    n = len(licenses.FAMILIES)
    weights = ", ".join(f"(' {g} ', {k}, {v:.4f})" for g, row in zip(names, w, strict=True) for k, v in enumerate(row) if v)
    bias = ", ".join(f"({k}, {v:.4f})" for k, v in enumerate(b))
    shapes = ", ".join(f"({k}, {i}, ' {g} ')" for k, f in enumerate(licenses.FAMILIES) for i, t in enumerate(licenses.TEMPLATES[f]) for g in sorted(licenses.grams(t)))
    labels = ", ".join(f"({k}, '{f}')" for k, f in enumerate(licenses.FAMILIES))
    anchors = " OR ".join(f"contains({{p}}, '{w}')" for w in licenses.anchors() if len(w) > 3) + f" OR regexp_matches({{p}}, '{licenses.short_anchors()}')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lower(coalesce(text, '')) AS low FROM documents),
x AS (SELECT r, string_split_regex(low, '\\n[ \\t\\r]*(?:\\n[ \\t\\r]*)+') AS ps FROM d WHERE {anchors.replace("{p}", "low")}),
y AS (SELECT r, j, ps[j] AS p, string_split(ps[j], chr(10)) AS l FROM (SELECT r, ps, unnest(range(1, len(ps) + 1)) AS j FROM x)),
u AS (SELECT r, j, unnest(list_distinct(list_concat(l, list_transform(range(1, len(l)), lambda i: l[i] || chr(10) || l[i + 1]), [p]))) AS p FROM y WHERE {anchors.replace("{p}", "p")}),
a AS (SELECT r, j, row_number() OVER () AS i, ' ' || regexp_replace(p, '[^a-z0-9]+', ' ', 'g') || ' ' AS p FROM u WHERE {anchors.replace("{p}", "p")}),
w(g, k, v) AS (VALUES {weights}), b(k, v) AS (VALUES {bias}), s(k, t, g) AS (VALUES {shapes}), f(k, name) AS (VALUES {labels}),
z AS (SELECT a.i, b.k, any_value(b.v) + coalesce(sum(w.v), 0) AS z FROM a CROSS JOIN b LEFT JOIN w ON w.k = b.k AND contains(a.p, w.g) GROUP BY ALL),
m AS (SELECT i, arg_max(k, z) FILTER (k < {n}) AS k, max(z) FILTER (k < {n}) AS best FROM z GROUP BY ALL),
q AS (SELECT m.i, m.k, 1 / sum(exp(CAST(z.z - m.best AS DOUBLE))) AS p FROM m JOIN z ON z.i = m.i GROUP BY ALL),
c AS (SELECT a.i, s.k, s.t FROM a JOIN s ON true GROUP BY ALL HAVING count(*) FILTER (contains(a.p, s.g)) >= {licenses.CONFIRM} * count(*)),
o AS (SELECT a.r, a.j, CASE WHEN q.p >= {licenses.THRESHOLD} AND EXISTS (SELECT 1 FROM c WHERE c.i = q.i AND c.k = q.k) THEN q.k END AS k FROM a JOIN q ON q.i = a.i),
e AS (SELECT r, j, count(DISTINCT k) AS n FROM o GROUP BY ALL),
g AS (SELECT r, sum(n) AS n_paragraphs, count(*) FILTER (n = 0) AS n_unknown FROM e GROUP BY r),
h AS (SELECT r, string_agg(DISTINCT f.name, ',' ORDER BY f.name) AS families FROM o JOIN f ON f.k = o.k GROUP BY r)
SELECT d.doc_id, CAST(coalesce(n_paragraphs, 0) AS BIGINT) AS n_paragraphs, coalesce(n_unknown, 0) AS n_unknown, coalesce(families, '') AS families FROM d LEFT JOIN g USING (r) LEFT JOIN h USING (r)
"""


@cache
def oracle_sql() -> dict[str, str]:
    """Made when it is asked for: the SQL of the licence scan holds its model."""
    return {"op6_licences": _op6_sql(), "op9_near_vectors": _OP9, "op1_decontaminate": _OP1, "op7_near_duplicates": _OP7, "op8_secrets": _op8_sql()}
