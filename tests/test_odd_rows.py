"""Queries against their SQL on rows that the test tables don't have."""

import duckdb
import pytest

from textmill.queries import load

QUERIES = load()
TEXTS = [None, "", " ", "\n\n", "a", "the", "the the the", ". . !", "One. . Two! Three", "One.\n\nTwo. ", "x  y\nz   ", "The cat saw the dog. The dog saw The cat.", "a b a b a b c", "Ä b ä B the a, the b.", "12 dogs and 3 cats ran. 12 dogs!", "one two three", "one two three four five"]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Documents with odd texts, each twice, in English and German."""
    at = tmp_path_factory.mktemp("odd")
    rows = [(i * 50, t, "de" if i % 3 == 0 else "en", f"s{i % 2}", len(t or "")) for i, t in enumerate(TEXTS + TEXTS)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(at / "documents.parquet"))
    return str(at)


def same_as_sql(spark, odd, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{odd}/documents.parquet/*.parquet')")
    got, want = QUERIES[name].run(spark, odd).toPandas(), con.sql(QUERIES[name].sql).df()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    rows = lambda d: sorted(d[cols].astype(object).where(d[cols].notna(), None).itertuples(index=False, name=None), key=lambda r: [(x is None, x) for x in r])
    return rows(got), rows(want)


@pytest.mark.parametrize("name", ["filter_complement", "sentence_counts", "whitespace_widths", "ngrams_bigram_counts", "ngrams_trigram_minfreq", "ngrams_filtered", "ztest_bigrams", "token_windows", "chunk_on_milestone", "chunk_on_milestone_following", "chunk_on_milestone_preceding", "corpus_totals", "cooccurrence_edges", "position_bias", "yake_features", "burrows_z", "burrows_delta", "quadratic_delta", "stylo_features", "stylo_tfidf", "compare_docs_to_classes", "compare_docs_to_classes_top", "compare_doc_to_corpus_top"])
def test_odd_rows(spark, odd, name):
    got, want = same_as_sql(spark, odd, name)
    assert got == want


#: How often rows of a query are shuffled by a key: not at all, or once as sums of each document.
SHUFFLES = {"token_windows": 0, "chunk_on_milestone_following": 0, "chunk_on_milestone_preceding": 0, "burrows_z": 0, "burrows_delta": 0, "quadratic_delta": 0, "yake_features": 1, "cooccurrence_edges": 1, "position_bias": 1, "corpus_totals": 1, "ztest_bigrams": 1}


@pytest.mark.parametrize("name", SHUFFLES)
def test_no_token_is_shuffled(spark, odd, name):
    plan = QUERIES[name].run(spark, odd)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= SHUFFLES[name] and "Window" not in plan


def test_texts_are_counted_once_for_comparisons(spark, odd):
    """What all steps read is a written table of counts, so no plan after it reads the texts."""
    for name in ("compare_docs_to_classes", "compare_docs_to_classes_top", "compare_doc_to_corpus_top"):
        plan = QUERIES[name].run(spark, odd)._jdf.queryExecution().executedPlan().toString()
        assert "documents.parquet" not in plan and "/counts-" in plan
