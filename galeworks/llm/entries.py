"""The registered queries of the subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galeworks.llm.common import table
from galeworks.llm.embeddings import near_vectors
from galeworks.llm.exact import dedup_exact
from galeworks.llm.lines import drop_recurring_lines
from galeworks.llm.mainpage import extract_main, fit_extractor, labelled_pages
from galeworks.llm.minhash import near_duplicates
from galeworks.llm.packing import pack_documents
from galeworks.llm.periodic import longest_run, periodic_runs, repeat_tails
from galeworks.llm.pieces import encode_pieces
from galeworks.llm.quality import fit_quality, score_quality
from galeworks.llm.secrets import KINDS, scan_secrets, span_text
from galeworks.llm.shards import assign_shards
from galeworks.llm.urls import judge_urls, rule_table
from galeworks.llm.whitening import whiten

TOKENIZERS = "/opt/tokenizers"
BYTE_BPE, PIECE_BPE = "byte_bpe_50k.json", "piece_bpe_32k.model"

# The rules of the URL query.
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def vocabulary(name: str, folder: str | None = None) -> str:
    """Path of a public tokenizer's file: of the installed package, or of a folder that is named."""
    if folder is None:
        try:
            import public_tokenizers

            return public_tokenizers.path(name)
        except ImportError:
            folder = TOKENIZERS
    return os.path.join(folder, name)


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"), least=0.95)


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=4, num=80, den=100)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), vocabulary(BYTE_BPE), end_id=2, size=1024)


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rule_table(spark, RULES)).drop("url")


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels")))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_exact(table(spark, sf_dir, "documents"), keep="largest")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents"))
    counts = [F.size(F.filter("base", _of_kind(kind))).cast("long").alias(f"n_{kind}") for kind in KINDS[:3]]
    every = F.array_sort(F.concat("base", "added"))
    return found.select("doc_id", *counts, F.sha2(span_text(F.col("base")), 256).alias("base_sha256"), span_text(every).alias("spans"))


def _of_kind(kind: str):
    return lambda span: span["kind"] == kind


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_recurring_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encode_pieces(table(spark, sf_dir, "documents"), vocabulary(PIECE_BPE))
    joined = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    spans = F.concat_ws(";", joined("begins"), joined("ends"))
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined("ids"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), F.sha2(spans, 256).alias("spans_sha256"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(table(spark, sf_dir, "documents"), shards=40)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(repeat_tails(table(spark, sf_dir, "documents")), least=12).withColumn("most", longest_run())
    start, length, period = -F.col("most.start"), F.col("most.length"), -F.col("most.period")
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), start.alias("start"), length.alias("length"), period.alias("period"),
                        F.expr("(1000 * most.length) div -most.period").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op12_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extract_main(pages, fit_extractor(labelled_pages(pages)))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"), components=8, scale=1024, shift=100_000)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = [op1_embedding_near_dedup, op2_minhash_near_dedup, op3_best_fit_packing, op4_url_filter, op5_quality_classifier, op6_exact_dedup, op7_secret_scan, op8_line_dedup, op9_sentencepiece, op10_sharding, op11_periodic_runs, op12_html_extraction, op13_embedding_whitening]
    return {f.__name__: f for f in ops}


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_REACH = """reach(a, b) AS (SELECT a, a FROM (SELECT a FROM both_ways) UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON r.b = l.a),
component AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)"""

SQL = {
    "op1_embedding_near_dedup": f"""WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL),
both_ways AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id <> y.vec_id AND list_cosine_similarity(x.e, y.e) >= 0.95),
{_REACH}, links AS (SELECT a, count(*) AS n FROM both_ways GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(component_id, vec_id) AS component_id, vec_id = coalesce(component_id, vec_id) AS kept
FROM embeddings LEFT JOIN links ON links.a = vec_id LEFT JOIN component c ON c.a = vec_id""",
    "op2_minhash_near_dedup": f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS t FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(t) = 0 THEN [] WHEN len(t) < 4 THEN [array_to_string(t, ' ')]
 ELSE list_transform(range(1, len(t) - 2), lambda i: array_to_string(t[i:i + 3], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links), {_REACH}
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(component_id, d.doc_id) AS component_id, d.doc_id = coalesce(component_id, d.doc_id) AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN component c ON c.a = d.doc_id""",
    "op4_url_filter": f"""WITH r(rh, rp, rv) AS (VALUES {", ".join(map(str, RULES))}),
u AS (SELECT page_id, {_LOWER.format("regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)([^?#]*)', 1, 's')")} AS host,
 regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)([^?#]*)', 2, 's') AS path FROM pages),
m AS (SELECT page_id, rh || rp AS rule, rv AS verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(rh || rp) DESC, length(rh) DESC, rv DESC) AS k
 FROM u JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT u.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM u LEFT JOIN m ON m.page_id = u.page_id AND k = 1""",
    "op6_exact_dedup": f"""WITH d AS (SELECT doc_id, {_LOWER.format("coalesce(text, '')")} AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256 FROM d""",
    "op8_line_dedup": """WITH l AS (SELECT doc_id, md5(text) AS text, unnest(range(len(string_split(text, chr(10))))) AS pos, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL),
r AS (SELECT *, regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+') AS raw FROM l),
whole AS (SELECT doc_id, pos, text, array_to_string(raw, chr(31)) AS words FROM r WHERE len(raw) >= 50),
t AS (SELECT doc_id, pos, line, text, list_transform(raw, lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END) AS tokens FROM r),
f AS (SELECT *, len(tokens) || chr(31) || array_to_string(tokens[1:3], chr(31)) AS leaf FROM t WHERE len(tokens) > 3 OR len(list_filter(tokens, lambda x: x <> '<*>')) > 0),
hot AS (SELECT leaf FROM f GROUP BY leaf HAVING count(DISTINCT text) >= 5),
h AS (SELECT f.* FROM f JOIN hot USING (leaf)), once AS (SELECT DISTINCT text, leaf, tokens FROM h),
e AS (SELECT text, leaf, tokens, unnest(range(len(tokens))) AS place, unnest(tokens) AS token FROM once),
fixed AS (SELECT leaf, place, token FROM e WHERE place >= 3 AND token <> '<*>' GROUP BY ALL HAVING count(*) >= 5),
shape AS (SELECT leaf, tokens, list_transform(range(len(tokens)), lambda i: CASE WHEN i < 3 OR len(list_filter(p, lambda q: q = i)) > 0 THEN tokens[i + 1] ELSE '<*>' END) AS tpl
 FROM (SELECT o.leaf, o.tokens, coalesce(p, []) AS p FROM (SELECT DISTINCT leaf, tokens FROM once) o LEFT JOIN
 (SELECT leaf, tokens, list(DISTINCT place) AS p FROM e JOIN fixed USING (leaf, place, token) GROUP BY ALL) k ON k.leaf = o.leaf AND k.tokens = o.tokens)),
good AS (SELECT leaf, tokens, array_to_string(tpl, chr(31)) AS tpl FROM shape WHERE len(list_filter(tpl, lambda x: x <> '<*>')) / len(tpl) >= 0.7 OR len(tpl) <= 3),
lined AS (SELECT h.doc_id, h.pos, h.text, g.tpl FROM h JOIN good g ON g.leaf = h.leaf AND g.tokens = h.tokens),
bad AS (SELECT tpl FROM lined GROUP BY tpl HAVING count(DISTINCT text) >= 5),
gone AS (SELECT doc_id, pos FROM lined WHERE tpl IN (SELECT tpl FROM bad)
 UNION SELECT doc_id, pos FROM whole WHERE words IN (SELECT words FROM whole GROUP BY words HAVING count(DISTINCT text) >= 2)),
kept AS (SELECT l.doc_id, count(*) AS n_lines, count(g.pos) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY l.pos) FILTER (WHERE g.pos IS NULL), '') AS body
 FROM l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.pos = l.pos GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_dropped, 0)::BIGINT AS n_dropped, sha256(coalesce(body, '')) AS text_sha256
FROM documents d LEFT JOIN kept USING (doc_id)""",
    "op12_html_extraction": r"""WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*)</article>', 1, 's') AS t FROM pages),
b AS (SELECT page_id, unnest(range(len(p))) AS k, unnest(p) AS line FROM (SELECT page_id, string_split_regex(regexp_replace(t, '</?(b|br)>', ' ', 'g'), '</?(?:p|h1)>') AS p FROM a)),
c AS (SELECT page_id, k, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(line, '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&quot;?', '"', 'g'), '&amp;?', '&', 'g'), '\s+', ' ', 'g')) AS line FROM b),
d AS (SELECT page_id, string_agg(line, chr(10) ORDER BY k) AS body FROM c WHERE line <> '' GROUP BY page_id)
SELECT page_id, url, coalesce(body, '') AS text, length(coalesce(body, '')) AS n_chars FROM a LEFT JOIN d USING (page_id)""",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
