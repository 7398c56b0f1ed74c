"""Operators on small tables with known results, and edge cases."""

import collections
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from textmill.functions.tokens import whitespace_tokens
from textmill.operators import chunks, cluster, corpus, distinct, dtm, keyterms, kwic, milestones, stats, stylometry, topics, windows
from textmill.operators import tokens as T


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, "the cat sat on the mat"), (2, "A dog sat. The dog ran!"), (3, ""), (4, None), (5, "word")]
    return spark.createDataFrame(rows, "doc_id long, text string").cache()


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_tokens_and_counts(docs):
    t = T.tokens(docs)
    assert t.count() == 13
    assert rows(T.most_common(T.term_counts(t), 2), "n", "term") == [(2, "dog"), (2, "sat")] or T.most_common(T.term_counts(t), 1).first().n == 2
    assert T.top_per_group(T.term_counts(t, "doc_id"), 1, "doc_id").where("doc_id = 1").first().term == "the"
    assert T.ngrams(docs, 2, min_freq=2).count() == 0
    assert T.sentences(docs).where("doc_id = 2").count() == 2


def test_doc_stats(docs):
    s = {r.doc_id: r for r in stats.doc_stats(T.tokens(docs)).collect()}
    assert set(s) == {1, 2, 5}
    assert (s[1].total_tokens, s[1].total_terms, s[1].hapax_legomena, s[1].hapax_dislegomena, s[1].vocabulary_density) == (6, 5, 4, 1, 83.33)


def test_quartiles(spark):
    df = spark.createDataFrame([(i, n) for i, n in enumerate((5, 10, 15, 20, 25))], "doc_id long, total_tokens long")
    q = stats.quartiles(df).first()
    assert (q.q1, q.q3, q.iqr, q.lower_bound, q.upper_bound) == (10, 20, 10, -5, 35)
    assert stats.iqr_outliers(df).count() == 0


def test_mattr(spark):
    df = spark.createDataFrame([(1, "a b a b c a"), (2, "x x")], "doc_id long, text string")
    got = {r.doc_id: r.mattr for r in stats.mattr(T.tokens(df), 3).collect()}
    w = "a b a b c a".split()
    want = np.mean([len(set(w[i : i + 3])) / 3 for i in range(4)])
    assert got[1] == pytest.approx(want) and got[2] == 0.5


def test_p_values():
    assert stats.t_p(2.228, 10) == pytest.approx(0.05, abs=1e-3)
    assert stats.rank_sum_p(8, 5, 5, 0) == pytest.approx(0.4034, abs=1e-3)
    w, p = stats.shapiro_wilk([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236])
    assert w == pytest.approx(0.79, abs=0.01) and p == pytest.approx(0.0067, abs=0.002)
    assert stats.zipf_fit_class(-1.1, 0.95) == "excellent"
    assert stats.effect_class(0.35, (0.1, 0.3, 0.5)) == "medium"


def test_windows(spark, docs):
    c = windows.token_counts(T.tokens(docs), "THE", 3)
    assert rows(c.where("doc_id = 1"), "start", "the") == [(0, 1), (1, 0), (2, 1), (3, 1)]
    assert c.where("doc_id = 5").count() == 0
    d = spark.createDataFrame([(1, "Hello world Hello test")], "doc_id long, text string")
    assert windows.string_windows(d, 5).count() == 18
    assert windows.char_counts(d, "l", 5).where("start = 0").first().n == 2
    r = windows.ratios(windows.token_counts(T.tokens(d), ["hello", "world"], 2))
    assert rows(r, "start", "hello:world") == [(0, 0.5), (1, 0.5), (2, 1.0)]
    assert windows.interpolate([0, 1, 2], [0, 1, 4], [0.5, 2]) == [0.5, 4.0]
    assert windows.interpolate([0, 1, 2], [0, 1, 4], [1.0, 2.0], "pchip") == pytest.approx([1, 4])


def test_kwic(docs):
    h = kwic.characters(docs, "the", window=4)
    assert rows(h.where("doc_id = 1"), "start", "before", "keyword", "after") == [(0, "", "the", " cat"), (15, " on ", "the", " mat")]
    a = docs.select("doc_id", whitespace_tokens(F.col("text")).alias("tokens"))
    assert rows(kwic.token_context(a, "SAT", window=2), "doc_id", "before", "after") == [(1, "the cat", "on the")]
    assert rows(kwic.phrase_context(a, ["the", "mat"], window=1), "pos", "before", "after") == [(4, "on", "")]
    assert kwic.sort_hits(h).count() == h.count()


def test_milestones(docs):
    assert rows(milestones.string_matches(docs, ["cat", "[ms]at"]).where("doc_id = 1"), "start", "text") == [(4, "cat"), (8, "sat"), (19, "mat")]
    tagged = milestones.iob(T.tokens(docs), "^(the|cat)$")
    assert [r.iob for r in tagged.where("doc_id = 1").orderBy("pos").collect()] == ["B", "I", "O", "O", "B", "O"]
    spans = milestones.spans_to_tokens(milestones.string_matches(docs, "cat sat"), milestones.tokens_with_offsets(docs))
    assert rows(spans, "first_token", "last_token") == [(1, 2)]
    assert milestones.without_milestones(T.tokens(docs), spans).where("doc_id = 1").count() == 4
    n = T.tokens(docs).groupBy("doc_id").agg(F.count("*").alias("n"))
    assert rows(milestones.move(spans, n, "after"), "first_token") == [(3,)]
    assert rows(milestones.move(spans, n, "before"), "first_token") == [(0,)]
    assert milestones.sentence_groups(docs, step=2).where("doc_id = 2").count() == 1


def test_chunks(spark, docs):
    d = spark.createDataFrame([(1, "abcdefghij"), (2, ""), (3, "ab")], "doc_id long, text string")
    assert rows(chunks.by_characters(d, 4), "doc_id", "chunk") == [(1, "abcd"), (1, "efgh"), (1, "ij"), (3, "ab")]
    assert rows(chunks.by_characters(d, 4, merge_final=True), "doc_id", "chunk") == [(1, "abcd"), (1, "efghij"), (3, "ab")]
    assert rows(chunks.by_characters(d, 4, overlap=1), "doc_id", "chunk") == [(1, "abcd"), (1, "defgh"), (1, "hij"), (3, "ab")]
    a = docs.select("doc_id", whitespace_tokens(F.col("text")).alias("tokens")).where("doc_id = 1")
    assert [len(r.tokens) for r in chunks.into_parts(a, 4).orderBy("chunk_no").collect()] == [2, 2, 1, 1]
    t = T.tokens(docs).where("doc_id = 1")
    assert rows(chunks.on_milestones(t, "the"), "chunk_no", "chunk") == [(1, "cat sat on"), (2, "mat")]
    assert rows(chunks.on_milestones(t, "the", keep="following"), "chunk_no", "chunk") == [(1, "the cat sat on"), (2, "the mat")]
    assert rows(chunks.on_milestones(t, "the", keep="preceding"), "chunk_no", "chunk") == [(0, "the"), (1, "cat sat on the"), (2, "mat")]
    assert rows(chunks.merge(chunks.by_characters(d, 4), ""), "doc_id", "text") == [(1, "abcdefghij"), (3, "ab")]
    assert "doc1_001" in {r.name for r in chunks.names(chunks.by_characters(d, 4)).collect()}


def test_dtm(docs):
    c = dtm.dtm(T.tokens(docs))
    assert c.where("doc_id = 1 and term = 'the'").first().n == 2
    assert dtm.dtm(T.tokens(docs), min_df=2).count() == 0
    assert dtm.dtm(T.tokens(docs), vocabulary=["sat"]).count() == 1
    norm = dtm.weighted(c, idf=True, norm="l2").groupBy("doc_id").agg(F.sum(F.col("weight") ** 2).alias("s"))
    assert all(r.s == pytest.approx(1) for r in norm.collect())
    m = {r.term: r for r in dtm.margins(c, 5).collect()}
    assert m["the"].mean == 0.4 and m["the"].median == 0


def test_distinct(spark):
    a = spark.createDataFrame([("x", 8), ("y", 2)], "term string, n long")
    b = spark.createDataFrame([("x", 1), ("z", 9)], "term string, n long")
    z = {r.term: r.z_score for r in distinct.z_test(a, b).collect()}
    p = 9 / 20
    assert z["x"] == pytest.approx((0.8 - 0.1) / math.sqrt(p * (1 - p) * 0.2)) and set(z) == {"x", "y", "z"}
    counts = spark.createDataFrame([(1, "x", 3), (2, "x", 1), (3, "x", 1)], "doc_id long, term string, n long")
    u = distinct.mann_whitney(counts, F.col("doc_id") <= 2, 2, 3).first()
    # Target 3, 1; others 1, 0, 0.
    assert u.u_statistic == 3 + 2.5


def test_corpus(spark, docs):
    r = corpus.records(docs.where("text is not null"))
    s = corpus.stats(r).first()
    assert (s.total_records, s.total_tokens, s.max_tokens) == (4, 13, 6)
    f1 = corpus.fingerprint(r).first().fingerprint
    assert f1 == corpus.fingerprint(r.repartition(3)).first().fingerprint != corpus.fingerprint(r.where("doc_id > 1")).first().fingerprint
    ix = corpus.inverted_index(docs)
    assert rows(corpus.search(ix, "sat dog"), "doc_id") == [(2,)]
    assert rows(corpus.search(ix, "cat OR dog"), "doc_id") == [(1,), (2,)]
    d = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "doc_id long, name string")
    assert rows(corpus.dedupe(d, ["name"]), "doc_id") == [(1,), (3,)]
    assert rows(corpus.show_duplicates(d, ["name"]), "doc_id") == [(2,)]
    assert rows(corpus.unique_names(d), "name") == [("a",), ("a-001",), ("b",)]
    assert rows(corpus.update(d, spark.createDataFrame([(3, "c"), (4, "d")], "doc_id long, name string")), "doc_id", "name") == [(1, "a"), (2, "a"), (3, "c"), (4, "d")]
    m = spark.createDataFrame([(1, {"a": "x", "doc_id": "9"})], "doc_id long, meta map<string,string>")
    assert corpus.flatten_metadata(m, "meta", ["a", "doc_id"]).columns == ["doc_id", "a", "metadata_doc_id"]
    res = corpus.Results()
    res.put("m", {"k": 1}, f1)
    assert res.compatible("m", f1)
    with pytest.raises(ValueError):
        res.put("m", {}, f1)


def test_stylometry(spark):
    c = spark.createDataFrame([(1, "a", 2), (1, "b", 2), (2, "a", 1), (2, "b", 3), (3, "a", 4)], "doc_id long, term string, n long")
    z = stylometry.burrows_z(stylometry.features(c, 2))
    d = {(r.query_id, r.doc_id): r.delta for r in stylometry.delta(z, spark.createDataFrame([(1,)], "doc_id long")).collect()}
    freq = np.array([[0.5, 0.5], [0.25, 0.75], [1, 0]])
    zs = (freq - freq.mean(0)) / freq.std(0)
    assert d[1, 2] == pytest.approx(np.abs(zs[0] - zs[1]).mean()) and d[1, 3] == pytest.approx(np.abs(zs[0] - zs[2]).mean())
    s = stylometry.structural_tokens(spark.createDataFrame([(1, "a  b \n\nC!")], "doc_id long, text string"), mode="whitespace")
    assert s.count() == 3


def test_trees():
    x = np.array([[0.0], [1], [5], [6], [20]])
    merges = cluster.linkage(cluster.pairwise(x))
    assert [m[:2] for m in merges] == [(0, 1), (2, 3), (5, 6), (4, 7)]
    assert merges[2][2] == pytest.approx(5)
    assert cluster.newick(merges, list("abcde")).endswith(";")
    rng = np.random.default_rng(0)
    two = np.vstack([rng.normal(0, 0.1, (3, 20)), rng.normal(5, 0.1, (3, 20))])
    assert frozenset({0, 1, 2}) in {c for c, s in cluster.consensus(two, rounds=10) if s == 1}
    for method in ("single", "complete", "ward", "weighted"):
        assert len(cluster.linkage(cluster.pairwise(x, "cityblock"), method)) == 4


def test_topics(spark):
    tt = spark.createDataFrame([(0, "a", 3.0), (0, "b", 1.0), (1, "c", 2.0)], "topic int, term string, w double")
    p = {(r.topic, r.term): r.p for r in topics.term_probabilities(tt).collect()}
    assert p[0, "a"] == 0.75
    assert topics.divergences(topics.rank_weights(tt)).first().jsd == pytest.approx(math.log(2))
    assert rows(topics.keys(tt, 1), "topic", "keys") == [(0, "a"), (1, "c")]
    d = topics.scale_distances(np.array([[0.0, 3, 4], [3, 0, 5], [4, 5, 0]]))
    assert np.linalg.norm(d[1] - d[2]) == pytest.approx(5)


def test_keyterms(spark, docs):
    text = "Machine learning models learn. Machine learning needs data. Data feeds learning models."
    for method in keyterms.METHODS:
        got = keyterms.METHODS[method](text, topn=5)
        assert 0 < len(got) <= 5
        assert keyterms.METHODS[method]("") == []
    assert keyterms.textrank(text, sizes=(1,), topn=1)[0][0] == "learning"
    assert keyterms.keyterms(docs, "yake", topn=2).where("doc_id = 3").count() == 0
    assert sum(keyterms.pagerank({("a", "b"): 1.0, ("b", "c"): 1.0}).values()) == pytest.approx(1)


def test_lda_draws_all_documents(spark, monkeypatch):
    from textmill.queries import load

    d = spark.createDataFrame([(i, ["a", "b"] if i % 2 else ["c", "d"]) for i in range(8)], "doc_id long, tokens array<string>")
    _, _, (_, model) = topics.train(d, 2)
    assert model.getSubsamplingRate() * model.getMaxIter() >= 20
    _, _, (_, model) = topics.train(d, 2, iterations=4)
    assert model.getSubsamplingRate() == 1
    how = []
    monkeypatch.setattr(topics, "train", lambda docs, k, **options: how.append(options) or (docs, None, None))
    load()["lda_topics"].run(spark, "/root/testdata/sf0.001")
    assert how == [{}]


def test_sgrank_takes_every_candidate():
    words = [f"{a}{b}" for a in "bcdfghjklm" for b in "aeiouy"]
    text = " . ".join(f"{w} {v}" for w, v in zip(words, words[1:], strict=False)) + ". zebra zulu. zebra."
    found = sorted((i, g) for r in keyterms._runs(keyterms.terms_of(text), set(keyterms.STOPWORDS)) for i, g in keyterms._grams(r, range(1, 7)))
    count = collections.Counter(g for _, g in found)
    for window in (1500, 7):
        edges = collections.defaultdict(float)
        for k, (i, a) in enumerate(found):
            for j, b in found[k + 1 :]:
                if 0 < j - i <= window and a != b:
                    edges[tuple(sorted((" ".join(a), " ".join(b))))] += count[a] * count[b] / (j - i)
        want = keyterms.pagerank(edges)
        got = dict(keyterms.sgrank(text, window=window, topn=len(count)))
        assert len(count) > 20 and "zebra zulu" in got
        assert got == {t: pytest.approx(want[t], abs=1e-9) for t in got}
        # Before, candidates past the 20 * topn heaviest were left out.
        few = keyterms.sgrank(text, window=window, topn=1)
        assert few[0][1] == pytest.approx(max(want.values()), abs=1e-9)


def test_compare_scores_absent_terms(spark):
    c = spark.createDataFrame([("x", "a", 3), ("x", "b", 1), ("y", "b", 2), ("y", "c", 5)], "lang string, term string, n long")
    got = {(r.lang, r.term): r.z_score for r in distinct.compare_with_rest(c, "lang").collect()}
    for lang, other in (("x", "y"), ("y", "x")):
        z = distinct.z_test(c.where(f"lang = '{lang}'"), c.where(f"lang = '{other}'"))
        assert {t: s for (g, t), s in got.items() if g == lang} == {r.term: pytest.approx(r.z_score) for r in z.collect()}
    assert got["x", "c"] < 0 and got["y", "a"] < 0
    assert [(r.lang, r.term) for r in distinct.compare_with_rest(c, "lang", 1).orderBy("lang").collect()] == [("x", "a"), ("y", "a")]
