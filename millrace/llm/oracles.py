"""Those parts of the corpus operators that SQL can express: queries of their own,
with SQL, and the SQL of whole results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.mixing import source_targets
from millrace.llm.quality_rules import document_counts
from millrace.llm.text import count_words
from millrace.llm.url_filter import LOWER, RULES, UPPER, judge_by_rules, url_parts

WORD = "[^\\x20\\x09-\\x0D]+"


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path and rule of every page (operator 1 without its trees)."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge_by_rules(url_parts(pages)).select("page_id", "host", "path", "rule", "rule_verdict")


def _rule_cases(value: str) -> str:
    cases = "".join(f" WHEN (host = '{x.host}' OR ends_with(host, '.{x.host}')) AND starts_with(path, '{x.path}') THEN '{getattr(x, value)}'" for x in sorted(RULES, key=lambda x: -len(x.rule)))
    return f"CASE{cases} END"


URL_RULES = f"""WITH p AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages)
SELECT page_id, host, path, {_rule_cases("rule")} AS rule, {_rule_cases("verdict")} AS rule_verdict FROM p"""


def text_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts of every text and its base verdict (operator 4 without its estimate)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return document_counts(docs, "doc_id").select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"))


TEXT_COUNTS = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), l AS (SELECT doc_id, t, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS lines, regexp_extract_all(t, '{WORD}') AS ws FROM d),
w AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM l), g AS (SELECT doc_id, i, w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o || ' ' || lead(w, 3) OVER o || ' ' || lead(w, 4) OVER o AS gram FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
c AS (SELECT doc_id, i, CASE WHEN gram IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, gram) > 1 THEN 1 ELSE 0 END AS again FROM g), m AS (SELECT doc_id, max(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS inside FROM c), n AS (SELECT doc_id, CAST(sum(inside) AS BIGINT) AS n FROM m GROUP BY 1)
SELECT l.doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g'))::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
len(ws) < 10 OR 100 * coalesce(n, 0) > 20 * len(ws) AS base_failed FROM l LEFT JOIN n USING (doc_id)"""


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes and targets (operator 6 without its rounding)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", count_words("text").alias("size"))
    targets = source_targets(docs.withColumn("n", F.lit(1)))
    joined = docs.join(targets, docs["source"].eqNullSafe(targets["source"]))
    return joined.select("doc_id", "size", "source_size", (F.floor(F.col("target") * 1000 + 0.5) / 1000).alias("target"))


MIX_TARGETS = f"""WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size FROM documents), s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source IS NULL, source) AS k FROM d GROUP BY 1),
w AS (SELECT *, [5.0, 2.0, 1.0][(k - 1) % 3 + 1]::DOUBLE AS weight, 2.0::DOUBLE * source_size AS cap, (SELECT 1.5::DOUBLE * sum(source_size) FROM s) AS total FROM s),
v AS (SELECT *, sum(cap) OVER (ORDER BY cap / weight, k) + cap / weight * coalesce(sum(weight) OVER (ORDER BY cap / weight, k ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) <= total AS capped FROM w),
t AS (SELECT source, source_size, CASE WHEN capped THEN cap ELSE (total - (SELECT coalesce(sum(cap), 0) FROM v WHERE capped)) * weight / (SELECT sum(weight) FROM v WHERE NOT capped) END AS target FROM v)
SELECT doc_id, size, source_size, floor(target * 1000 + 0.5) / 1000 AS target FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source"""

#: The whole result of operator 5: links by shared shingles, then components.
JACCARD = f"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS ws FROM documents), w AS (SELECT doc_id, len(ws) AS n, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM d),
g AS (SELECT doc_id, n, i, CASE WHEN n >= 3 THEN w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o WHEN i = 1 THEN w || coalesce(' ' || lead(w, 1) OVER o, '') END AS gram FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
s AS (SELECT DISTINCT doc_id, gram FROM g WHERE gram IS NOT NULL), z AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1), p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN z zx ON zx.doc_id = x JOIN z zy ON zy.doc_id = y WHERE 100 * k >= 90 * (zx.n + zy.n - k)), r AS (SELECT x, x AS root FROM (SELECT DISTINCT x FROM e) UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.x WHERE r.root < e.y)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce((SELECT min(root) FROM r WHERE r.x = d.doc_id), doc_id)) AS component_id FROM d LEFT JOIN z USING (doc_id)"""

#: The whole result of operator 12, over the full grid of kept terms and groups.
DIVERGENCE = f"""WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS ws FROM documents), w AS (SELECT k, lang, source, unnest(ws) AS t FROM d),
kept AS (SELECT lang, t FROM w GROUP BY 1, 2 HAVING count(DISTINCT k) >= 10), v AS (SELECT lang, count(*) AS v FROM kept GROUP BY 1), c AS (SELECT lang, source, t, count(*) AS n FROM w SEMI JOIN kept USING (lang, t) GROUP BY 1, 2, 3), g AS (SELECT DISTINCT lang, source FROM d),
s AS (SELECT g.lang, g.source, coalesce(sum(n), 0) AS total FROM g LEFT JOIN c ON c.lang = g.lang AND c.source = g.source GROUP BY 1, 2), l AS (SELECT lang, t, sum(n) AS n FROM c GROUP BY 1, 2), m AS (SELECT lang, sum(n) AS total FROM l GROUP BY 1),
x AS (SELECT s.lang, s.source, kept.t, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (s.total + 2 * v.v)::HUGEINT AS p, 1 + (1000000000::HUGEINT * (l.n + 2)) // (m.total + 2 * v.v)::HUGEINT AS q FROM s JOIN kept ON kept.lang = s.lang JOIN v ON v.lang = s.lang JOIN l ON l.lang = s.lang AND l.t = kept.t JOIN m ON m.lang = s.lang LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.t = kept.t),
y AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value FROM x a JOIN x b ON a.lang = b.lang AND a.t = b.t AND a.source <> b.source GROUP BY 1, 2, 3),
z AS (SELECT a.lang, a.source, b.source AS item, coalesce(y.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN y ON y.lang = a.lang AND y.source = a.source AND y.item = b.source),
r AS (SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM z UNION ALL SELECT * FROM (SELECT lang, source, 'term' AS part, t AS item, ((p - q) * (p - q)) // (p + q) AS value, row_number() OVER (PARTITION BY lang, source ORDER BY ((p - q) * (p - q)) // (p + q) DESC, t) AS rank FROM x WHERE n > 0 AND p > q) WHERE rank <= 10)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM r"""

QUERIES = {"url_rules": url_rules, "text_counts": text_counts, "mix_targets": mix_targets}
ORACLE_SQL = {"url_rules": URL_RULES, "text_counts": TEXT_COUNTS, "mix_targets": MIX_TARGETS, "op5_ngram_jaccard": JACCARD, "op12_source_divergence": DIVERGENCE}
