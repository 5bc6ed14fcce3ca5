"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, chaining, decontaminate, hard_negatives, licences, packing, quality_rules, repeats, secret_scans, simhash, suffix_tree, topk, toxicity
from .common import table

#: The tokenizer of the packing query; a path, or the name of a file of the public_tokenizers package.
TOKENIZER = "word_bpe_49k.json"

#: The two tokenizers of the alignment query.
ALIGNED = ("byte_bpe_50k.json", "piece_bpe_32k.model")


def tokenizer_path(name: str = TOKENIZER) -> str:
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.assess(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_failed_lines", "lost_chars")


def op2_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licences.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "digest", "licence", F.array_join("notices", ",").alias("notices"))


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scans.scan(table(spark, sf_dir, "documents"))
    base = F.filter("found", lambda s: s["kind"] < len(secret_scans.BASE_RULES))
    count = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(secret_scans.span_list(base), 256).alias("base_sha256"),
        secret_scans.span_list(F.col("found")).alias("spans"),
    )


def op4_substring_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.deduplicated(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.score(table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.detect(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", "predicted", F.size("passages").cast("long").alias("n_passages"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_fuzzy_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chaining.shared_passages(table(spark, sf_dir, "documents"))
    spans = F.transform("spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string")))
    return found.select("doc_id", "class_id", "n_copies", "n_links_found", "n_shared", F.size("spans").cast("long").alias("n_spans"), F.array_join(spans, ",").alias("spans"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"), *map(tokenizer_path, ALIGNED))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vec, label = F.col("vec_id"), F.col("label").cast("long")
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), F.when(vec % 7 == 0, (label + 1) % 10).otherwise(label), vec % 100 == 0)


def op13_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def queries() -> dict:
    return {f.__name__: f for f in (op1_quality_rules, op2_licences, op3_secret_scans, op4_substring_repeats, op5_lm_scoring, op6_decontamination, op7_packing, op8_simhash, op9_toxicity, op10_fuzzy_passages, op11_alignment, op12_hard_negatives, op13_top_k)}


def _op1_sql() -> str:
    word = r"[^\x20\x09-\x0D]+"
    count = lambda p: f"len(regexp_extract_all(l, '{p}'))"
    rules = " OR ".join(quality_rules.LINE_RULES.values()).format(
        seps=count("[|»›•]"),
        words=count(word),
        marks=count("[#*$%&<>!~^=]"),
        stops=count("[.,;:!?]"),
        furniture="regexp_matches(lower(l), '" + "|".join(quality_rules.BOILERPLATE) + "')",
    )
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
a AS (SELECT *, regexp_extract_all(t, '{word}') AS w, string_split(t, chr(10)) AS ls FROM d),
g AS (SELECT row_number() OVER () AS r, * FROM a),
x AS (SELECT r, unnest(range(1, len(w) - 1)) AS i, w FROM g WHERE len(w) >= 3),
k AS (SELECT r, i, count(*) OVER (PARTITION BY r, w[i], w[i + 1], w[i + 2]) AS c FROM x),
p AS (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nx FROM k WHERE c >= 2),
q AS (SELECT r, CAST(sum(least(3, coalesce(nx, i + 3) - i)) AS BIGINT) AS n FROM p GROUP BY r),
v AS (SELECT r, unnest(ls) AS l FROM g),
f AS (SELECT r, CAST(count(*) FILTER (WHERE {rules}) AS BIGINT) AS n_failed, CAST(coalesce(sum(length(l)) FILTER (WHERE {rules}), 0) AS BIGINT) AS lost,
  CAST(sum(length(l)) AS BIGINT) AS total FROM v GROUP BY r),
b AS (SELECT g.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(list_filter(ls, lambda l: regexp_matches(l, '{word}'))) - len(list_distinct(list_filter(ls, lambda l: regexp_matches(l, '{word}')))) AS BIGINT) AS n_dup_lines,
  coalesce(q.n, 0) AS n_repeat_words, coalesce(f.n_failed, 0) AS n_failed_lines, coalesce(f.lost, 0) AS lost_chars, coalesce(f.total, 0) AS total
  FROM g LEFT JOIN q USING (r) LEFT JOIN f USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  (NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * lost_chars <= 50 * total) AS kept, n_failed_lines, lost_chars FROM b"""


def _op2_sql() -> str:
    def form(t: str) -> str:
        out = f"translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
        title = licences.TITLE_LINE.replace("'", "''")
        out = f"trim(regexp_replace(regexp_replace(regexp_replace({out}, '{title}', ' '), '{licences.COPYRIGHT_LINE}', ' ', 'g'), '[^a-z0-9]+', ' ', 'g'))"
        for a, b in licences.SPELLINGS:
            out = f"replace({out}, '{a}', '{b}')"
        return out

    known = ", ".join(f"('{d}', '{n}')" for d, n in sorted(licences.known_digests().items()))
    return f"""
WITH k(digest, licence) AS (VALUES {known}),
d AS (SELECT row_number() OVER () AS r, doc_id, text, {form("text")} AS f FROM documents),
l AS (SELECT r, unnest(string_split(text, chr(10))) AS l FROM d),
n AS (SELECT r, string_agg(DISTINCT licence, ',' ORDER BY licence) AS notices FROM (SELECT r, sha256({form("l")}) AS digest FROM l WHERE regexp_matches(lower(l), '{licences.ABOUT}')) JOIN k USING (digest) GROUP BY r),
w AS (SELECT r, doc_id, CASE WHEN f <> '' THEN sha256(f) END AS digest FROM d)
SELECT doc_id, w.digest, licence, coalesce(notices, '') AS notices FROM w LEFT JOIN k ON w.digest = k.digest LEFT JOIN n ON w.r = n.r"""


def _op3_sql() -> str:
    """Every rule run over every text, without the index."""
    ctes, parts = [], []
    for i, r in enumerate(secret_scans.RULES):
        p = r.regex.replace("'", "''")
        ctes.append(
            f"m{i} AS (SELECT doc_id, regexp_extract_all(t, '{p}') AS m, regexp_extract_all(t, '{p}', {r.group}) AS c, string_split_regex(t, '{p}') AS g FROM d WHERE regexp_matches(t, '{p}'))"
        )
        at = "list_sum(list_transform(g[1:i], lambda z: length(z))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda z: length(z))), 0)"
        parts.append(f"SELECT doc_id, {i} AS kind, '{r.kind}' AS name, {at} AS s, {at} + length(m[i]) AS e FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM m{i}) WHERE length(c[i]) >= {r.least}")
    one = "name || ':' || CAST(CAST(s AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(e AS BIGINT) AS VARCHAR)"
    count = lambda k: f"CAST(count(*) FILTER (WHERE kind = {k}) AS BIGINT)"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), {", ".join(ctes)},
s AS ({" UNION ALL ".join(parts)}),
n AS (SELECT doc_id, {count(0)} AS n_assign, {count(1)} AS n_access, {count(2)} AS n_hex,
  string_agg({one}, ',' ORDER BY s, kind) FILTER (WHERE kind < 3) AS base, string_agg({one}, ',' ORDER BY s, kind) AS spans FROM s GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN n USING (doc_id)"""


def _op6_sql() -> str:
    """Windows of documents joined with windows of items, as joined words."""
    words = lambda t: f"regexp_extract_all(translate(coalesce({t}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {words("text")} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {words("text")} AS w FROM benchmark),
i AS (SELECT item, least(13, len(w)) AS n, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS p FROM b WHERE len(w) > 0),
g AS (SELECT DISTINCT item, n, array_to_string(w[p:p + n - 1], ' ') AS k FROM i),
s AS (SELECT DISTINCT n FROM g),
x AS (SELECT r, n, w, unnest(range(1, len(w) - n + 2)) AS p FROM d, s WHERE len(w) >= n),
y AS (SELECT r, n, p, array_to_string(w[p:p + n - 1], ' ') AS k FROM x),
m AS (SELECT y.r, y.p, y.n, g.item FROM y JOIN g ON y.n = g.n AND y.k = g.k),
h AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS q FROM m) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM m) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)"""


def _vectors(scale: int, where: str) -> str:
    """Rows that take part, their components scaled."""
    return f"""SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: floor({scale} * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0{where}"""


def _op12_sql() -> str:
    return f"""
WITH e AS ({_vectors(256, " AND label IS NOT NULL")}),
c AS (SELECT r, vec_id, v, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE label END AS label FROM e),
s AS (SELECT a.r, a.vec_id AS anchor_id, c.vec_id AS other, a.label = c.label AS same, CAST(list_inner_product(a.v, c.v) AS BIGINT) AS score
  FROM c AS a JOIN c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT r, anchor_id, other AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY r ORDER BY score DESC, other) AS place FROM s WHERE same),
n AS (SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.r, place ORDER BY score DESC, other) AS INTEGER) AS rank, other AS negative_id, positive_score, score AS negative_score
  FROM p JOIN s ON p.r = s.r WHERE place <= 5 AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT * FROM n WHERE rank <= 10"""


def _op13_sql() -> str:
    return f"""
WITH e AS ({_vectors(64, "")}),
s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM e AS q JOIN e AS c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
k AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT * FROM k WHERE rank <= 20"""


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": _op1_sql(), "op2_licences": _op2_sql(), "op3_secret_scans": _op3_sql(), "op6_decontamination": _op6_sql(), "op12_hard_negatives": _op12_sql(), "op13_top_k": _op13_sql()}
