"""Queries on documents, records, search and statistics of a corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textmill.operators import corpus as C
from textmill.operators import stats as S
from textmill.operators import tokens as T
from textmill.queries import TOKENS, query, table


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def toks(spark: SparkSession, sf_dir: str, *keep: str) -> DataFrame:
    return T.tokens(docs(spark, sf_dir), keep=keep)


_STATS = f"WITH {TOKENS}, c AS (SELECT doc_id, token, count(*) AS n FROM t GROUP BY ALL), s AS (SELECT doc_id, count(*) FILTER (n = 1)::BIGINT AS hapax_legomena, sum(n)::BIGINT AS total_tokens, count(*)::BIGINT AS total_terms, count(*) FILTER (n = 2)::BIGINT AS hapax_dislegomena, round(100 * count(*) / sum(n), 2)::DOUBLE AS vocabulary_density FROM c GROUP BY doc_id)"


@query(f"{_STATS} SELECT * FROM s")
def doc_stats(spark, sf_dir):
    return S.doc_stats_of(docs(spark, sf_dir))


@query("SELECT lang, source, count(*)::BIGINT AS docs, sum(length(text))::BIGINT AS chars FROM documents GROUP BY ALL")
def docs_per_lang_source(spark, sf_dir):
    return docs(spark, sf_dir).groupBy("lang", "source").agg(F.count("*").alias("docs"), F.sum(F.length("text")).alias("chars"))


@query(f"WITH {TOKENS} SELECT token AS term, count(*)::BIGINT AS n FROM t GROUP BY ALL ORDER BY n DESC, term LIMIT 100")
def term_counts_top100(spark, sf_dir):
    return T.most_common(T.term_counts(toks(spark, sf_dir)), 100)


@query(f"WITH {TOKENS}, c AS (SELECT lang, token AS term, count(*)::BIGINT AS n FROM t GROUP BY ALL) SELECT lang, term, n, row_number() OVER (PARTITION BY lang ORDER BY n, term)::INTEGER AS rank FROM c QUALIFY rank <= 10")
def least_common_terms_per_lang(spark, sf_dir):
    return T.top_per_group(T.term_counts(toks(spark, sf_dir, "lang"), "lang"), 10, "lang", ascending=True).select("lang", "term", "n", "rank")


@query(f"WITH {TOKENS}, c AS (SELECT lang, token AS term, count(*)::BIGINT AS n FROM t GROUP BY ALL) SELECT lang, term, n, row_number() OVER (PARTITION BY lang ORDER BY n DESC, term)::INTEGER AS rank FROM c QUALIFY rank <= 25")
def top_terms_per_lang(spark, sf_dir):
    return T.top_per_group(T.term_counts(toks(spark, sf_dir, "lang"), "lang"), 25, "lang").select("lang", "term", "n", "rank")


@query(f"{_STATS} SELECT count(*)::BIGINT AS num_docs, sum(total_tokens)::BIGINT AS num_tokens, sum(total_terms)::BIGINT AS num_terms, (SELECT count(DISTINCT token) FROM t)::BIGINT AS n_distinct_terms FROM s")
def corpus_totals(spark, sf_dir):
    sums = S.doc_stats_of(docs(spark, sf_dir)).agg(F.count("*").alias("num_docs"), F.sum("total_tokens").alias("num_tokens"), F.sum("total_terms").alias("num_terms"))
    return sums.crossJoin(F.broadcast(T.term_counts(toks(spark, sf_dir)).agg(F.count("*").alias("n_distinct_terms"))))


_RECORDS = "WITH w AS (SELECT documents.*, coalesce(quality, 0) = 1 AS is_active, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS w FROM documents LEFT JOIN labels USING (doc_id)), r AS (SELECT doc_id, lang, source, is_active, len(w)::BIGINT AS num_tokens, len(list_distinct(w))::BIGINT AS num_terms, CASE WHEN len(w) > 0 THEN len(list_distinct(w)) / len(w) ELSE 0 END AS vocab_density, text FROM w)"


def recs(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    joined = docs(spark, sf_dir).join(labels, "doc_id", "left")
    return C.records(joined, active=F.coalesce(F.col("quality"), F.lit(0)) == 1)


@query(f"{_RECORDS} SELECT doc_id, is_active, num_tokens, num_terms, round(vocab_density, 6) AS vocab_density, CASE WHEN length(text) > 50 THEN substr(text, 1, 50) || '...' ELSE text END AS preview, sha256(text) AS content_hash FROM r")
def corpus_records(spark, sf_dir):
    return recs(spark, sf_dir).select("doc_id", "is_active", "num_tokens", "num_terms", F.round("vocab_density", 6).alias("vocab_density"), "preview", "content_hash")


@query(f"{_RECORDS} SELECT count(*)::BIGINT AS total_records, count(*) FILTER (is_active)::BIGINT AS active_records, coalesce(sum(num_tokens) FILTER (is_active), 0)::BIGINT AS total_tokens, coalesce(sum(num_terms) FILTER (is_active), 0)::BIGINT AS total_terms, round(avg(vocab_density) FILTER (is_active AND num_tokens > 0), 6) AS average_vocab_density, max(num_tokens) FILTER (is_active)::BIGINT AS max_tokens FROM r")
def record_stats_by_active(spark, sf_dir):
    return C.stats(recs(spark, sf_dir)).withColumn("average_vocab_density", F.round("average_vocab_density", 6))


@query(f"{_RECORDS} SELECT doc_id, num_tokens FROM r WHERE is_active AND lang = 'en' AND num_tokens BETWEEN 100 AND 1000")
def filter_records_bounds(spark, sf_dir):
    return C.filter_records(recs(spark, sf_dir), min_tokens=100, max_tokens=1000, is_active=True, lang="en").select("doc_id", "num_tokens")


@query("SELECT doc_id, lang, source FROM documents WHERE lang = 'fr' AND source IN ('src1', 'src3')")
def meta_filter_lang_source(spark, sf_dir):
    return C.filter_records(docs(spark, sf_dir), lang="fr", source=["src1", "src3"]).select("doc_id", "lang", "source")


@query("SELECT doc_id, lang, md5(text) AS h FROM documents WHERE doc_id IN (7, 42, 77)")
def record_lookup(spark, sf_dir):
    return C.lookup(docs(spark, sf_dir), ids=[7, 42, 77]).select("doc_id", "lang", F.md5(F.col("text").cast("binary")).alias("h"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def remove_anti(spark, sf_dir):
    return C.remove(docs(spark, sf_dir), table(spark, sf_dir, "labels").where("toxic = 1")).select("doc_id")


@query("SELECT doc_id, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def semi_labels(spark, sf_dir):
    return docs(spark, sf_dir).join(table(spark, sf_dir, "labels").where("quality = 1"), "doc_id", "left_semi").select("doc_id", "n_chars")


@query("SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN d.source ELSE 'labelled' END AS source FROM documents d LEFT JOIN labels l USING (doc_id)")
def upsert_source(spark, sf_dir):
    changes = table(spark, sf_dir, "labels").select("doc_id", F.lit("labelled").alias("source"))
    return C.update(docs(spark, sf_dir).select("doc_id", "source"), changes)


@query("SELECT doc_id, lang FROM documents WHERE lang <> 'en' UNION ALL SELECT doc_id, lang FROM documents WHERE lang = 'en'")
def insert_missing_docs(spark, sf_dir):
    d = docs(spark, sf_dir).select("doc_id", "lang")
    return C.insert_missing(d.where("lang <> 'en'"), d)


@query("SELECT doc_id, CASE WHEN n > 0 THEN source || '-' || lpad(n::VARCHAR, 3, '0') ELSE source END AS name FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS n FROM documents)")
def unique_record_names(spark, sf_dir):
    n = F.col("name")
    wide = C.unique_names(docs(spark, sf_dir).select("doc_id", F.col("source").alias("name")))
    return wide.select("doc_id", n)


_INDEX = "WITH ix AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS term FROM documents)"


@query(f"{_INDEX} SELECT doc_id FROM ix WHERE term IN ('the', 'was') GROUP BY doc_id HAVING count(*) = 2")
def text_search_and(spark, sf_dir):
    return C.search(C.inverted_index(docs(spark, sf_dir)), "the was")


@query(f"{_INDEX} SELECT DISTINCT doc_id FROM ix WHERE term IN ('license', 'lizenz')")
def text_search_or(spark, sf_dir):
    return C.search(C.inverted_index(docs(spark, sf_dir)), "license OR lizenz")


@query(f"{_INDEX} SELECT term, count(*)::BIGINT AS df FROM ix GROUP BY term")
def inverted_index_df(spark, sf_dir):
    return C.inverted_index(docs(spark, sf_dir)).groupBy("term").agg(F.count("*").alias("df"))


@query("SELECT doc_id, lang FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1")
def dedupe_text(spark, sf_dir):
    d = docs(spark, sf_dir).select("doc_id", "lang", F.sha2(F.col("text").cast("binary"), 256).alias("h"))
    return C.dedupe(d, ["h"]).select("doc_id", "lang")


@query("SELECT doc_id, lang FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) > 1")
def show_duplicates(spark, sf_dir):
    d = docs(spark, sf_dir).select("doc_id", "lang", F.sha2(F.col("text").cast("binary"), 256).alias("h"))
    return C.show_duplicates(d, ["h"]).select("doc_id", "lang")


@query("SELECT doc_id AS id, text, lang FROM documents UNION ALL SELECT item_id, text, NULL FROM benchmark")
def union_datasets(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")
    return C.append(docs(spark, sf_dir).select(F.col("doc_id").alias("id"), "text", "lang"), b)


@query(
    f"{_RECORDS}, h AS (SELECT count(*) AS n, count(*) FILTER (is_active) AS a, sum(('0x' || substr(sha256(doc_id::VARCHAR || '|' || is_active::VARCHAR || '|' || num_tokens::VARCHAR), 1, 8))::BIGINT) AS s FROM r) "
    "SELECT n::BIGINT AS num_docs, a::BIGINT AS num_active_docs, s::BIGINT AS content_sum, substr(sha256(n::VARCHAR || '|' || a::VARCHAR || '|' || s::BIGINT::VARCHAR), 1, 16) AS fingerprint FROM h"
)
def fingerprint(spark, sf_dir):
    return C.fingerprint(recs(spark, sf_dir))


@query(f"{_STATS} SELECT round(avg(total_tokens), 6) AS mean, round(stddev_samp(total_tokens), 6) AS standard_deviation FROM s")
def corpus_mean_spread(spark, sf_dir):
    return S.mean_and_spread(S.doc_stats_of(docs(spark, sf_dir))).select(F.round("mean", 6).alias("mean"), F.round("standard_deviation", 6).alias("standard_deviation"))


@query(f"{_STATS}, q AS (SELECT quantile_cont(total_tokens, 0.25) AS q1, quantile_cont(total_tokens, 0.75) AS q3 FROM s) SELECT q1::DOUBLE AS q1, q3::DOUBLE AS q3, (q3 - q1)::DOUBLE AS iqr, (q1 - 1.5 * (q3 - q1))::DOUBLE AS lower_bound, (q3 + 1.5 * (q3 - q1))::DOUBLE AS upper_bound FROM q")
def iqr_bounds(spark, sf_dir):
    return S.quartiles(S.doc_stats_of(docs(spark, sf_dir)))


@query(f"{_STATS}, q AS (SELECT quantile_cont(total_tokens, 0.25) AS q1, quantile_cont(total_tokens, 0.75) AS q3 FROM s) SELECT doc_id, total_tokens FROM s, q WHERE total_tokens < q1 - 1.5 * (q3 - q1) OR total_tokens > q3 + 1.5 * (q3 - q1)")
def iqr_outliers(spark, sf_dir):
    return S.iqr_outliers(S.doc_stats_of(docs(spark, sf_dir)).select("doc_id", "total_tokens"))


@query(f"{_STATS}, q AS (SELECT avg(total_tokens) AS m, stddev_pop(total_tokens) AS sd FROM s) SELECT doc_id, total_tokens FROM s, q WHERE abs(total_tokens - m) > 2 * sd")
def std_outliers(spark, sf_dir):
    return S.std_outliers(S.doc_stats_of(docs(spark, sf_dir)).select("doc_id", "total_tokens"))


@query(
    f"{_STATS}, m AS (SELECT avg(total_tokens) AS mu FROM s), d AS (SELECT avg((total_tokens - mu) ^ 2) AS m2, avg((total_tokens - mu) ^ 3) AS m3, avg((total_tokens - mu) ^ 4) AS m4 FROM s, m) "
    "SELECT round(m3 / m2 ^ 1.5, 6) AS skewness, round(m4 / m2 ^ 2 - 3, 6) AS kurtosis, (SELECT round(stddev_samp(total_tokens) / avg(total_tokens), 6) FROM s) AS coefficient_of_variation FROM d"
)
def distribution_stats(spark, sf_dir):
    d = S.distribution(S.doc_stats_of(docs(spark, sf_dir)))
    return d.select(*[F.round(c, 6).alias(c) for c in d.columns])


@query(f"{_STATS} SELECT " + ", ".join(f"quantile_cont(total_tokens, {p / 100})::DOUBLE AS percentile_{p}" for p in (5, 10, 25, 50, 75, 90, 95)) + ", min(total_tokens) AS min, max(total_tokens) AS max, max(total_tokens) - min(total_tokens) AS range FROM s")
def percentiles(spark, sf_dir):
    return S.percentiles(S.doc_stats_of(docs(spark, sf_dir)))


@query(
    f"{_STATS}, r AS (SELECT *, total_terms / total_tokens AS ttr FROM s) SELECT round(avg(ttr), 6) AS mean_ttr, round(quantile_cont(ttr, 0.5), 6) AS median_ttr, round(stddev_pop(ttr), 6) AS std_ttr, round(sum(total_terms) / sum(total_tokens), 6) AS corpus_ttr, "
    "round(sum(hapax_legomena) / sum(total_terms), 6) AS hapax_ratio, round(sum(hapax_dislegomena) / sum(total_terms), 6) AS dislegomena_ratio FROM r"
)
def diversity(spark, sf_dir):
    d = S.diversity(S.doc_stats_of(docs(spark, sf_dir)))
    return d.select(*[F.round(c, 6).alias(c) for c in d.columns])


@query(
    f"{_STATS}, r AS (SELECT total_terms / sqrt(2 * total_tokens) AS cttr, total_terms / sqrt(total_tokens) AS rttr, CASE WHEN total_tokens > 1 THEN ln(total_terms) / ln(total_tokens) END AS log_ttr FROM s) SELECT "
    + ", ".join(f"round(avg({k}), 6) AS {k}_mean, round(quantile_cont({k}, 0.5), 6) AS {k}_median, round(stddev_samp({k}), 6) AS {k}_std" for k in ("cttr", "rttr", "log_ttr"))
    + " FROM r"
)
def advanced_diversity(spark, sf_dir):
    d = S.advanced_diversity(S.doc_stats_of(docs(spark, sf_dir)))
    return d.select(*[F.round(c, 6).alias(c) for c in d.columns])


@query(
    f"WITH {TOKENS}, n AS (SELECT doc_id, count(*) AS n, least(count(*), 50) AS size FROM t GROUP BY doc_id), p AS (SELECT doc_id, pos, lag(pos) OVER (PARTITION BY doc_id, token ORDER BY pos) AS last FROM t), "
    "c AS (SELECT doc_id, greatest(0, least(pos, n - size) - greatest(0, pos - size + 1, coalesce(last + 1, 0)) + 1) AS new, n, size FROM p JOIN n USING (doc_id)) SELECT doc_id, round(sum(new) / any_value(size) / (any_value(n) - any_value(size) + 1), 6) AS mattr FROM c GROUP BY doc_id"
)
def mattr(spark, sf_dir):
    return S.mattr_of(docs(spark, sf_dir)).select("doc_id", F.round("mattr", 6).alias("mattr"))


@query(
    f"WITH {TOKENS}, c AS (SELECT token, count(*) AS n FROM t GROUP BY token), r AS (SELECT log10(n) AS y, log10(row_number() OVER (ORDER BY n DESC, token)) AS x FROM c) "
    "SELECT round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 6) AS intercept, round(regr_r2(y, x), 6) AS r_squared, count(*)::BIGINT AS num_terms FROM r"
)
def zipf_fit(spark, sf_dir):
    z = S.zipf(T.term_counts(toks(spark, sf_dir)))
    return z.select(*[F.round(c, 6).alias(c) for c in ("slope", "intercept", "r_squared")], "num_terms")


@query(
    f"{_STATS}, v AS (SELECT count(*) AS vocabulary, count(*) FILTER (n = 1) AS hapax FROM (SELECT token, count(*) AS n FROM t GROUP BY token)), a AS (SELECT count(*) AS num_docs, sum(total_tokens) AS total_tokens, stddev_pop(total_tokens) / avg(total_tokens) AS length_cv, stddev_pop(vocabulary_density) / avg(vocabulary_density) AS density_cv FROM s) "
    "SELECT num_docs::BIGINT AS num_docs, total_tokens::BIGINT AS total_tokens, round(length_cv, 6) AS length_cv, round(density_cv, 6) AS density_cv, vocabulary::BIGINT AS vocabulary, hapax::BIGINT AS hapax, "
    "CASE WHEN length_cv < 0.2 THEN 'very_balanced' WHEN length_cv < 0.4 THEN 'balanced' WHEN length_cv < 0.6 THEN 'moderately_unbalanced' ELSE 'highly_unbalanced' END AS balance, round(vocabulary / total_tokens, 6)::DOUBLE AS richness, round(hapax / vocabulary, 6) AS hapax_share, "
    "CASE WHEN hapax / vocabulary < 0.1 THEN 'excellent' WHEN hapax / vocabulary < 0.3 THEN 'good' WHEN hapax / vocabulary < 0.5 THEN 'adequate' ELSE 'insufficient' END AS sampling_adequacy, greatest(30, floor(0.1 * vocabulary))::BIGINT AS recommended_min_docs FROM a, v"
)
def quality_metrics(spark, sf_dir):
    t = toks(spark, sf_dir)
    q = S.quality(S.doc_stats_of(docs(spark, sf_dir)), T.term_counts(t))
    return q.withColumns({c: F.round(c, 6) for c in ("length_cv", "density_cv", "richness", "hapax_share")})


_GROUPS = f"{_STATS}, g AS (SELECT total_tokens AS x, quality AS g FROM s JOIN labels USING (doc_id))"


def grouped(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("g"))
    return S.doc_stats_of(docs(spark, sf_dir)).join(labels, "doc_id").select(F.col("total_tokens").alias("x"), "g")


@query(
    f"{_GROUPS}, a AS (SELECT count(*) FILTER (g = 0) AS n0, count(*) FILTER (g = 1) AS n1, avg(x) FILTER (g = 0) AS m0, avg(x) FILTER (g = 1) AS m1, var_samp(x) FILTER (g = 0) AS v0, var_samp(x) FILTER (g = 1) AS v1 FROM g), "
    "b AS (SELECT *, ((n0 - 1) * v0 + (n1 - 1) * v1) / (n0 + n1 - 2) AS p FROM a) SELECT n0, n1, round(m0, 6) AS mean0, round(m1, 6) AS mean1, round((m0 - m1) / sqrt(p * (1 / n0 + 1 / n1)), 6) AS statistic, (n0 + n1 - 2)::DOUBLE AS df, round((m0 - m1) / sqrt(p), 6) AS cohens_d FROM b"
)
def compare_groups_t(spark, sf_dir):
    r = S.t_test(grouped(spark, sf_dir), "x", "g")
    return r.withColumns({c: F.round(c, 6) for c in ("mean0", "mean1", "statistic", "cohens_d")})


@query(
    f"{_GROUPS}, a AS (SELECT count(*) FILTER (g = 0) AS n0, count(*) FILTER (g = 1) AS n1, avg(x) FILTER (g = 0) AS m0, avg(x) FILTER (g = 1) AS m1, var_samp(x) FILTER (g = 0) AS v0, var_samp(x) FILTER (g = 1) AS v1 FROM g), "
    "b AS (SELECT *, ((n0 - 1) * v0 + (n1 - 1) * v1) / (n0 + n1 - 2) AS p, v0 / n0 AS e0, v1 / n1 AS e1 FROM a) SELECT n0, n1, round(m0, 6) AS mean0, round(m1, 6) AS mean1, round((m0 - m1) / sqrt(e0 + e1), 6) AS statistic, round((e0 + e1) ^ 2 / (e0 ^ 2 / (n0 - 1) + e1 ^ 2 / (n1 - 1)), 6) AS df, round((m0 - m1) / sqrt(p), 6) AS cohens_d FROM b"
)
def compare_groups_welch(spark, sf_dir):
    r = S.t_test(grouped(spark, sf_dir), "x", "g", equal_var=False)
    return r.withColumns({c: F.round(c, 6) for c in ("mean0", "mean1", "statistic", "df", "cohens_d")})


@query(
    f"{_GROUPS}, v AS (SELECT x, count(*) FILTER (g = 0) AS a, count(*) FILTER (g = 1) AS b, count(*) AS t FROM g GROUP BY x), r AS (SELECT *, coalesce(sum(t) OVER (ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (t + 1) / 2 AS rank FROM v) "
    "SELECT (sum(a * rank) - sum(a) * (sum(a) + 1) / 2)::DOUBLE AS u1, sum(a)::BIGINT AS n1, sum(b)::BIGINT AS n2, sum(t * t * t - t)::BIGINT AS ties FROM r"
)
def mwu_statistic(spark, sf_dir):
    return S.rank_sum(grouped(spark, sf_dir), "x", "g")


@query()
def bootstrap_interval(spark, sf_dir):
    return S.bootstrap_interval(S.doc_stats_of(docs(spark, sf_dir)), rounds=100)


@query(
    "WITH b AS (SELECT conv_id, count(*)::BIGINT AS turns, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS dialogue FROM conversations GROUP BY conv_id) SELECT conv_id, turns, md5(dialogue) AS h FROM b"
)
def conversations_merged(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    rows = F.array_sort(F.collect_list(F.struct("turn", F.concat_ws(": ", "role", "text").alias("line"))))
    return c.groupBy("conv_id").agg(F.count("*").alias("turns"), F.md5(F.array_join(F.transform(rows, lambda x: x["line"]), "\n").cast("binary")).alias("h"))


@query("SELECT doc_id, source, n_chars, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id)::BIGINT AS running, round(n_chars / sum(n_chars) OVER (PARTITION BY source), 6)::DOUBLE AS share FROM documents")
def running_share_per_source(spark, sf_dir):
    w = Window.partitionBy("source")
    return docs(spark, sf_dir).select("doc_id", "source", "n_chars", F.sum("n_chars").over(w.orderBy("doc_id")).alias("running"), F.round(F.col("n_chars") / F.sum("n_chars").over(w), 6).alias("share"))
