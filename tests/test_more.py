"""Figures of trees, spreadsheets, annotations, files and models."""

import re
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from textmill.operators import annotate, cluster, topics, trees
from textmill.sources import readers, sheets, sinks


def test_colours():
    assert len(set(trees.palette(7))) == 7 and all(re.fullmatch("#[0-9a-f]{6}", c) for c in trees.palette(7)) and trees.palette(0) == []
    got = trees.label_colours(["a", "b", "c", "d"], {"a": "x", "b": "x", "c": "y"}, {"y": "#ff0000"})
    assert got["a"] == got["b"] != got["c"] == "#ff0000" and got["d"] == "#000000"


def test_tree_figures():
    x = np.array([[0.0], [1], [5], [6], [20]])
    merges, labels = cluster.linkage(cluster.pairwise(x)), ["a", "b", "c<", "d", "e"]
    assert sorted(trees.leaf_order(merges, 5)) == list(range(5))
    at, branches = trees.fan_layout(merges, 5)
    assert len(branches) == 8 and len(at) == 9
    height = dict.fromkeys(range(5), 0.0) | {5 + k: m[2] for k, m in enumerate(merges)}
    assert all(np.hypot(at[a][0] - at[b][0], at[a][1] - at[b][1]) == pytest.approx(height[a] - height[b]) for a, b in branches)
    fan = trees.fan_tree_svg(merges, labels, colours={"a": "#123456"})
    assert fan.count("<line") == 8 and "#123456" in fan and "c&lt;" in fan
    clades = [(frozenset({0, 1}), 0.9), (frozenset({0, 1, 2}), 0.6)]
    joined, support = trees.consensus_merges(clades, 5)
    assert {frozenset(c) for c in cluster.clades(joined, 5)} >= {c for c, _ in clades} and joined[-1][3] == 5
    assert "0.90" in trees.rectangular_tree_svg(joined, labels, support=support)
    assert trees.fan_tree_svg([], ["one"]).count("<text") == 1


def test_clustermap():
    x = np.array([[1.0, 2, 9], [1, 2, 8], [9, 9, 1]])
    svg = trees.clustermap_svg(x, ["r1", "r2", "r3"], ["c1", "c2", "c3"], standard="z")
    assert svg.count("<rect") == 9 and svg.count("<polyline") == 4
    assert trees.clustermap_svg(np.ones((1, 2)), ["r"], ["a", "b"], standard="scale").count("<rect") == 2


def test_voronoi_cells_hold_the_nearest_points():
    rng = np.random.default_rng(2)
    centres = rng.random((6, 2))
    cells = trees.voronoi_cells(centres, (0, 0, 1, 1))
    area = lambda c: abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(c, [*c[1:], *c[:1]], strict=True))) / 2
    assert sum(map(area, cells)) == pytest.approx(1)
    for p in rng.random((200, 2)):
        k = int(((centres - p) ** 2).sum(1).argmin())
        c = cells[k]
        turns = [(b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0]) for a, b in zip(c, [*c[1:], *c[:1]], strict=True)]
        assert min(turns) > -1e-9
    assert trees.voronoi_svg(rng.random((5, 2)), [0, 1, 2, 0, 1], centres[:3]).count("<polygon") == 3


def test_sheets(spark, tmp_path):
    df = spark.createDataFrame([(1, "a & b", 0.5, True), (2, None, None, False), (3, "line\nbreak \x01", -1.0, None)], "n long, t string, x double, b boolean")
    sheets.write_sheet(df, str(tmp_path / "a.xlsx"))
    got = sheets.read_sheet(spark, str(tmp_path), ["n", "t", "x", "b", "none"]).orderBy("row").drop("path", "row").collect()
    assert [tuple(r) for r in got] == [("1", "a & b", "0.5", "true", None), ("2", None, None, "false", None), ("3", "line\nbreak ", "-1.0", None, None)]
    with zipfile.ZipFile(tmp_path / "b.xlsx", "w") as z:
        ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>head</t></si><si><r><t>ri</t></r><r><t>ch</t></r></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c r="B1" t="s"><v>0</v></c></row><row><c r="B2" t="s"><v>1</v></c><c r="AA2" t="b"><v>1</v></c></row></sheetData></worksheet>')
    rows = sheets.sheet_rows((tmp_path / "b.xlsx").read_bytes())
    assert rows == [[None, "head"], [None, "rich", *[None] * 24, "true"]]


def test_tokenizer_with_attributes(spark):
    t = annotate.Tokenizer(stopwords=["the"])
    t.add_stopwords(["a", "of"])
    t.remove_stopwords("of")
    t.add_extension("shape", lambda token: F.regexp_replace(F.regexp_replace(token, "[A-Z]", "X"), "[a-z]", "x"))
    t.add_extension("origin", "mine")
    t.add_extension("gone", 1)
    t.remove_extension("gone")
    t.add_component("content", lambda rows: rows.where("not is_stop"))
    t.add_component("upper", lambda rows: rows.withColumn("token", F.upper("token")))
    docs = spark.createDataFrame([(1, "The end of a Day"), (2, None)], "doc_id long, text string")
    assert t.pipeline == ["content", "upper"]
    t.disabled.add("upper")
    assert t.pipeline == ["content"]
    assert [(r.pos, r.token, r.shape, r.origin) for r in t(docs).orderBy("pos").collect()] == [(1, "end", "xxx", "mine"), (2, "of", "xx", "mine"), (4, "Day", "Xxx", "mine")]
    with pytest.raises(ValueError):
        t.add_extension("pos", 1)
    with pytest.raises(KeyError):
        t.remove_extension("gone")


def test_annotations_and_conllu(spark):
    docs = spark.createDataFrame([(1, "Cats sleep . Dogs bark ."), (2, "")], "doc_id long, text string")

    def model(texts):
        for text in texts:
            n, out = 0, []
            for w in text.split():
                out.append({"token": w, "lemma": w.lower().rstrip("s"), "sent": n})
                n += w == "."
            yield out

    rows = annotate.annotated(docs, model, {"lemma": "string", "tag": "string", "sent": "int"})
    assert [(r.token, r.lemma, r.tag, r.sent) for r in rows.where("doc_id = 1").orderBy("pos").limit(2).collect()] == [("Cats", "cat", None, 0), ("sleep", "sleep", None, 0)]
    text = {r.doc_id: r.text for r in annotate.conllu(rows, sentence="sent", columns=["lemma", "tag", *[None] * 6]).collect()}
    assert set(text) == {1}
    sents = text[1].split("\n\n")
    assert len(sents) == 3 and sents[2] == "" and sents[1].split("\n")[0] == "1\tDogs\tdog\t_\t_\t_\t_\t_\t_\t_"
    lines = [line.split("\t") for s in sents[:2] for line in s.split("\n")]
    assert [f[0] for f in lines] == ["1", "2", "3"] * 2 and {len(f) for f in lines} == {10}


def test_files_and_records(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_bytes("Déjà vu\r\nlà".encode("cp1252"))
    got = readers.normalize_files(spark, str(tmp_path / "in"), str(tmp_path / "out")).first()
    assert got.encoding == "cp1252" and (tmp_path / "out" / "a.txt").read_bytes() == "Déjà vu\nlà".encode()
    sinks.record_to_disk({"id": 1, "name": "é"}, str(tmp_path / "r"))
    assert sinks.record_from_disk(str(tmp_path / "r")) == {"id": 1, "name": "é"}
    sinks.save_corpus(spark.createDataFrame([(1, "x")], "doc_id long, text string"), str(tmp_path / "c"), {"k": 1})
    sinks.unpack_corpus(sinks.pack_corpus(str(tmp_path / "c"), str(tmp_path / "c.zip")), str(tmp_path / "d"))
    rows, meta = sinks.load_corpus(spark, str(tmp_path / "d"))
    assert rows.first().text == "x" and meta == {"k": 1}
    with zipfile.ZipFile(tmp_path / "bad.zip", "w") as z:
        z.writestr("../out.txt", "x")
    with pytest.raises(ValueError):
        sinks.unpack_corpus(str(tmp_path / "bad.zip"), str(tmp_path / "e"))


def test_topic_models_are_kept(spark, tmp_path):
    d = spark.createDataFrame([(i, ["a", "b"] if i % 2 else ["c", "d"]) for i in range(8)] + [(99, ["none"])], "doc_id long, tokens array<string>")
    before, _, models = topics.train(d, 2, iterations=3)
    topics.save_model(models, str(tmp_path / "m"), {"name": "mine"})
    loaded, meta = topics.load_model(spark, str(tmp_path / "m"))
    assert meta == {"k": 2, "vocabulary": 4, "name": "mine"}
    as_map = lambda t: {(r.doc_id, r.topic): pytest.approx(r.p) for r in t.collect()}
    after = topics.infer(d, loaded)
    assert {(r.doc_id, r.topic): r.p for r in after.collect()} == as_map(before)
    # A document without known terms has all topics alike.
    assert [r.p for r in after.where("doc_id = 99").collect()] == [0.5, 0.5]


def test_seriation_puts_like_columns_together():
    x = np.array([[5.0, 0, 4, 0, 0], [4, 0, 5, 1, 0], [0, 5, 1, 4, 0], [0, 4, 0, 5, 0]])
    order = topics.seriate(x)
    assert order[-1] == 4 and {frozenset(order[:2]), frozenset(order[2:4])} == {frozenset({0, 2}), frozenset({1, 3})}
    assert topics.seriate(np.zeros((2, 3))) == [0, 1, 2]
