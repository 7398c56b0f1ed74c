"""The queries of the ten operators over the test tables, and SQL for them where SQL can say it."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.llm import bpe_count, byte_cnn, decontam, divergence, mixing, neardup, spans, token_files, toxicity, url_rules
from textmill.llm._common import shared_path, table



def tokenizer(name: str) -> str:
    """Where a tokenizer file is: in the folder TEXTMILL_TOKENIZERS if that is set, else where the ``public_tokenizers`` package has it.

    Every executor has it at the same place.
    """
    if folder := os.environ.get("TEXTMILL_TOKENIZERS"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


TOKENIZERS = os.path.dirname(tokenizer("word_bpe_49k.json"))

_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

OP8_SQL = rf"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bi AS (SELECT item_id, w, least(len(w), 8) AS m, unnest(range(1, len(w) - least(len(w), 8) + 2)) AS i FROM bw WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS win FROM bi),
sizes AS (SELECT DISTINCT m FROM win),
di AS (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM dw, sizes WHERE len(w) >= m),
dwin AS (SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS win FROM di),
hits AS (SELECT d.doc_id, d.i, d.m, b.item_id FROM dwin d JOIN win b ON d.m = b.m AND d.win = b.win),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM hits) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id)
SELECT dw.doc_id, len(dw.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM dw LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_path(spark, "tokens")
    token_files.write_token_files(table(spark, sf_dir, "documents"), folder, tokenizer("word_bpe_49k.json"), end_id=2)
    return token_files.read_token_files(spark, folder)


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), weights=[3, 1, 2], share=1.5, most=2.0).select("doc_id", "size", "source_size", "target", "taken", "source")


def op3_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents"))


def op4_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels")))


SITE_RULES = [
    url_rules.site_rule(verdict, site)
    for verdict, site in (("block", "com/en/"), ("allow", "example.com/en/7"), ("block", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
]


def op5_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge_urls(table(spark, sf_dir, "pages"), SITE_RULES, url_rules.DEFAULT_GLOBS)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def op6_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = byte_cnn.fit_quality(docs, table(spark, sf_dir, "labels"), among=~held_out(F.col("doc_id")))
    return byte_cnn.score_quality(docs, net, threshold=0.7).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op7_bpe_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_count.count_tokens(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), limit=512)


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), n=8, min_items=2)


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op10_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = spans.dedup_spans(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_sentences", "n_removed", "n_words_removed", spans.crc32_of("text").alias("clean_crc32"), (F.col("n_removed") > 0).alias("changed"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_token_files, op2_mix_sources, op3_divergence, op4_toxicity_chain, op5_url_rules, op6_byte_cnn, op7_bpe_count, op8_decontaminate, op9_near_duplicates, op10_sentence_spans)
    return {f.__name__: f for f in every}


def _glob_regex(glob: str) -> str:
    """A glob of the URL automaton as a regular expression; U+0001 is the separator."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**", i):
            out, i = out + "(?:.|\\n)*", i + 2
            continue
        out += {"*": "[^\\x01]*", "?": "[^\\x01]", "|": "\\x01"}.get(glob[i], glob[i] if glob[i].isalnum() or glob[i] in "/_-=:" else "\\" + glob[i])
        i += 1
    return out


def _url_sql() -> str:
    rules = ", ".join(f"({k}, '{r.name}', '{r.verdict}', {r.length}, '{_glob_regex(g)}')" for k, r in enumerate(SITE_RULES) for g in r.globs)
    globs = ", ".join(f"({k}, '{r.name}', '{r.verdict}', {r.length}, '{_glob_regex(g)}')" for k, r in enumerate(url_rules.DEFAULT_GLOBS) for g in r.globs)
    return rf"""
WITH rest AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(r, '^([^/?#]*)', 1), {_AZ}) AS host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(r, '^[^?#]*(\?[^#]*)', 1) AS query FROM rest),
sites(k, name, verdict, size, rx) AS (VALUES {rules}),
globs(k, name, verdict, size, rx) AS (VALUES {globs}),
s AS (SELECT page_id, arg_min(name, (-size, k)) AS name, arg_min(verdict, (-size, k)) AS verdict FROM parts JOIN sites ON regexp_full_match(host || chr(1) || path, rx) GROUP BY page_id),
g AS (SELECT page_id, arg_min(name, (-size, k)) AS name, arg_min(verdict, (-size, k)) AS verdict FROM parts JOIN globs ON regexp_full_match(host || chr(1) || path || query, rx) GROUP BY page_id)
SELECT p.page_id, p.host, p.path, s.name AS rule, coalesce(s.verdict, g.verdict, 'allow') AS verdict, CASE WHEN s.name IS NULL THEN g.name END AS glob
FROM parts p LEFT JOIN s USING (page_id) LEFT JOIN g USING (page_id)
"""


OP9_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, array_to_string(w[i:i + least(len(w), 3) - 1], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(len(w), 3) + 2)) AS i FROM d WHERE len(w) > 0))),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
walk(doc_id, c) AS (SELECT doc_id, doc_id FROM d UNION SELECT edge.b, walk.c FROM walk JOIN edge ON edge.a = walk.doc_id),
comp AS (SELECT doc_id, min(c) AS component_id FROM walk GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, component_id = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN comp USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_url_rules": _url_sql(), "op8_decontaminate": OP8_SQL, "op9_near_duplicates": OP9_SQL}
