"""The registered queries of this subpackage and, where SQL can express them, their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.bpe import encode_decode
from weftline.llm.chat import format_chats
from weftline.llm.decontaminate import find_leaks
from weftline.llm.license_templates import TEMPLATES
from weftline.llm.licenses import scan
from weftline.llm.media import store, with_features, with_metadata
from weftline.llm.neardup import near_duplicates
from weftline.llm.quality import score, train
from weftline.llm.repair import checksums, with_starts, write_ids
from weftline.llm.token_counts import at_limits, length_histogram
from weftline.llm.urls import filter_urls
from weftline.session import table


def tokenizer(name: str) -> str:
    """The file of a public tokenizer; the operators take it as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


# The rules of the URL query, (verdict, host, path).
URL_RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License templates found in documents."""
    return scan(table(spark, sf_dir, "documents"))


def op2_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded and decoded again; the digests are of the operator's ids and texts."""
    out = encode_decode(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages found in documents, with their place and number of edits."""
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL judged by the rules, else by its redirect class."""
    return filter_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups over four-word shingles."""
    return near_duplicates(table(spark, sf_dir, "documents"), n=4, percent=80)


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its scores and the decision at 0.5."""
    docs = table(spark, sf_dir, "documents")
    out = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return out.withColumn("kept", F.col("score") >= 0.5)


def op7_token_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text written to grammar-compressed files and read back."""
    refs = write_ids(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), end_id=1)
    out = checksums(with_starts(refs))
    return out.select("doc_id", F.col("first").alias("start"), F.col("n_read").alias("n_tokens"), "ids_crc32")


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maximal conversations, rendered."""
    return format_chats(table(spark, sf_dir, "conversations"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals at every length that occurs as a context limit."""
    return at_limits(length_histogram(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json")))


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as an image in tar shards, with metadata and features read back."""
    out = with_features(with_metadata(store(table(spark, sf_dir, "documents"))))
    return out.select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", F.col("length").alias("media_bytes"), "media_sha256", "feature",
        "width", "height",
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_license_scan, op2_bpe_encode_decode, op3_benchmark_decontamination, op4_url_filter, op5_minhash_near_dedup,
        op6_quality_classifier, op7_token_id_files, op8_chat_formatting, op9_token_counts, op10_media_columns,
    )
}

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"



def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_TEMPLATES = ", ".join(f"({i}, {_quoted(a)}, {_quoted(b)})" for i, (a, b) in enumerate(TEMPLATES))
_RULES = ", ".join(f"({_quoted(v)}, {_quoted(h)}, {_quoted(p)})" for v, h, p in URL_RULES)


def _list(text: str) -> str:
    return rf"list_filter(string_split(regexp_replace(lower(coalesce({text}, '')), '[^\p{{L}}\p{{N}}]+', ' ', 'g'), ' '), lambda x: x <> '')"


def _host(url: str) -> str:
    return rf"translate(regexp_extract({url}, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


ORACLE: dict[str, str] = {
    "op5_minhash_near_dedup": f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
             ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS k FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.k + y.k - c)),
r AS (SELECT doc_id AS v, doc_id AS t FROM documents UNION SELECT r.v, l.b FROM r JOIN l ON l.a = r.t),
m AS (SELECT v, min(t) AS t FROM r GROUP BY 1)
SELECT d.doc_id, CAST(coalesce(n.k, 0) AS BIGINT) AS n_shingles, m.t AS component_id, d.doc_id = m.t AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN m ON m.v = d.doc_id""",
    "op1_license_scan": f"""
WITH t AS (SELECT *, {_list("text")} AS w FROM (VALUES {_TEMPLATES}) v(template, license, text)),
k AS (SELECT template, license, least(len(w), 5) AS n, w FROM t WHERE len(w) > 0),
g AS (SELECT DISTINCT template, license, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS g FROM k),
z AS (SELECT template, count(*) AS z FROM g GROUP BY 1),
d AS (SELECT doc_id, {_list("text")} AS w FROM documents),
s AS (SELECT doc_id, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: struct_pack(i := i, g := array_to_string(w[i:i + n - 1], ' ')))) AS x
      FROM d, (SELECT DISTINCT n FROM k) WHERE len(w) >= n),
m AS (SELECT doc_id, n, x.g AS g, min(x.i) AS i FROM s WHERE x.g IN (SELECT g FROM g) GROUP BY ALL)
SELECT doc_id, template, license, count(*) AS n_found, any_value(z) AS n_grams, min(i) AS first_word
FROM m JOIN g USING (g, n) JOIN z USING (template) GROUP BY doc_id, template, license HAVING 100 * count(*) >= 80 * any_value(z)""",
    "op4_url_filter": rf"""
WITH RECURSIVE p AS (SELECT *, {_host("url")} AS host, coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path,
  coalesce(regexp_extract(url, '^.*?://([^#]*)', 1, 's'), '') AS k FROM pages),
l AS (SELECT DISTINCT page_id, k, regexp_extract(regexp_extract(html, '(?i)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>'), '(?i)\bhref\s*=\s*["'']?([^"''\s>]+)', 1) AS t FROM p
  UNION SELECT page_id, k, regexp_extract(regexp_extract(html, '(?i)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>'), '(?i)\burl\s*=\s*["'']?([^"''\s>]+)', 1) FROM p),
e AS (SELECT k AS a, regexp_extract(t, '^.*?://([^#]*)', 1) AS b FROM l WHERE t LIKE '%://%' AND k <> ''),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
c AS (SELECT a AS v, a AS t FROM u UNION SELECT c.v, u.b FROM c JOIN u ON u.a = c.t),
n AS (SELECT DISTINCT t, translate(regexp_extract(t, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS h, regexp_extract(t, '^[^/?#]*([^?#]*)', 1) AS q FROM c),
r AS (SELECT * FROM (VALUES {_RULES}) v(verdict, h, q)),
s AS (SELECT n.t, r.verdict FROM n JOIN r ON (n.h = r.h OR ends_with(n.h, '.' || r.h)) AND starts_with(n.q, r.q)
  QUALIFY row_number() OVER (PARTITION BY n.t ORDER BY length(r.h || r.q) DESC) = 1),
x AS (SELECT c.v AS k, CASE WHEN bool_or(s.verdict = 'allow') THEN 'allow' ELSE 'block' END AS alias FROM c JOIN s USING (t) GROUP BY 1),
j AS (SELECT p.page_id, r.h || r.q AS rule, r.verdict FROM p JOIN r ON (p.host = r.h OR ends_with(p.host, '.' || r.h)) AND starts_with(p.path, r.q)
  QUALIFY row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.h || r.q) DESC) = 1)
SELECT p.page_id, coalesce(p.host, '') AS host, p.path, j.rule, coalesce(j.verdict, x.alias, 'allow') AS verdict,
  CASE WHEN j.verdict IS NOT NULL THEN 'rule' WHEN x.alias IS NOT NULL THEN 'alias' ELSE 'default' END AS by
FROM p LEFT JOIN j USING (page_id) LEFT JOIN x ON x.k = p.k""",
    "op8_chat_formatting": """
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
f AS (SELECT conv_id, list(struct_pack(turn := turn, role := role, text := text) ORDER BY turn, role, text) AS l, max(turn) AS top FROM t GROUP BY 1),
keep AS (SELECT conv_id FROM f WHERE NOT EXISTS (
  SELECT 1 FROM f AS b WHERE b.conv_id <> f.conv_id AND len(b.l) >= len(f.l) AND b.l[:len(f.l)] = f.l
    AND (len(b.l) > len(f.l) AND b.l[len(f.l) + 1].turn > f.top OR len(b.l) = len(f.l) AND b.conv_id < f.conv_id))),
g AS (SELECT conv_id, CAST(floor(turn / 256) AS BIGINT) AS blk, count(*) AS n_turns,
  string_agg('<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '' ORDER BY turn, role, text) AS rendered
  FROM t JOIN keep USING (conv_id) GROUP BY 1, 2)
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY blk) - 1 AS part, n_turns, rendered FROM g""",
}
