"""The corpus object and the data of figures."""

from textmill.corpus import Corpus
from textmill.operators import cluster, visual


def test_corpus(spark, tmp_path):
    docs = spark.createDataFrame([(1, "the cat, the mat", "a"), (2, "the dog", "b"), (3, "the dog", "b")], "doc_id long, text string, kind string")
    c = Corpus(docs)
    assert c.term_counts(1).first().term == "the"
    assert c.filter(kind="b").docs.count() == 2
    assert c.dedupe().docs.count() == 2
    assert c.scrub("punctuation", "lower_case").docs.where("doc_id = 1").first().text == "the cat the mat"
    assert {r.doc_id for r in c.search("the dog").collect()} == {2, 3}
    assert c.remove([1]).docs.count() == 2 and c.get(ids=[2]).count() == 1
    assert c.add(docs.limit(1)).docs.count() == 4
    assert c.kwic("dog", window=4).count() == 2
    assert c.rolling("the", 2).count() == 5
    assert c.doc_stats().count() == 3 and c.dtm(min_df=2).select("term").distinct().count() == 2
    assert c.compare("kind", 1).count() == 2
    assert c.fingerprint() == Corpus(docs.orderBy("text")).fingerprint()
    c.save(str(tmp_path / "c"), {"name": "x"})
    assert Corpus.load(spark, str(tmp_path / "c")).docs.count() == 3
    (tmp_path / "f.txt").write_text("hello")
    assert Corpus.from_files(spark, str(tmp_path / "f.txt")).docs.first().text == "hello"


def test_figures(spark):
    counts = spark.createDataFrame([(1, "a", 4), (1, "b", 1), (2, "a", 1), (2, "c", 9)], "doc_id long, term string, n long")
    assert [tuple(r) for r in visual.cloud_counts(counts, limit=2).collect()] == [("c", 9), ("a", 5)]
    assert [tuple(r) for r in visual.cloud_counts(counts, docs=[1]).orderBy("term").collect()] == [("a", 4), ("b", 1)]
    assert visual.multicloud_counts(counts, limit=1).count() == 2
    at = visual.bubbles([("a", 10), ("b", 5), ("c", 5)])
    for i, (_, x, y, r) in enumerate(at):
        for _, u, v, q in at[:i]:
            assert ((x - u) ** 2 + (y - v) ** 2) ** 0.5 >= r + q
    assert visual.bubble_svg(visual.cloud_counts(counts)).count("<circle") == 3
    assert "font-size" in visual.cloud_html(visual.cloud_counts(counts)) and "<section>" in visual.multicloud_html(counts)
    assert visual.line_svg({"x": [(0, 1), (1, 2)]}, [0.5]).count("<line") == 1
    import numpy as np

    merges = cluster.linkage(cluster.pairwise(np.array([[0.0], [1], [9]])))
    assert visual.dendrogram_svg(merges, ["x", "y", "z"]).count("<path") == 2
    b = visual.box_values(counts, "n").first()
    assert (b.median, b.low) == (2.5, 1)
    assert visual.rows_of([1, 2, 3], 2) == [[1, 2], [3]]
