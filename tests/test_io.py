"""Readers, sinks and streams on small files."""

import gzip
import json
import zipfile

import pytest

from textmill import streaming
from textmill.sources import readers, sinks


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("é\r\nb".encode())
    (tmp_path / "b.txt").write_bytes("é".encode("cp1252"))
    (tmp_path / "c.pickle").write_bytes(b"x")
    with zipfile.ZipFile(tmp_path / "d.zip", "w") as z:
        z.writestr("../in/e.txt", "entry")
        z.writestr("f.bin", b"\x00\x01")
    with zipfile.ZipFile(tmp_path / "g.docx", "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:p><w:r><w:t>one</w:t></w:r></w:p><w:p><w:t>two</w:t></w:p></w:document>')
    (tmp_path / "h.zip").write_bytes(b"PK\x03\x04broken")
    rows = readers.files(spark, str(tmp_path))
    assert {r.name: r.text for r in readers.good(rows).collect()} == {"a": "é\nb", "b": "é", "e": "entry", "g": "one\ntwo"}
    assert readers.load_errors(rows).count() == 3
    assert readers.safe_entry("../../x/./y") == "x/y"


def test_tables(spark, tmp_path):
    (tmp_path / "t.csv").write_text('title,content\nx,"a, ""b""\nc"\n')
    r = readers.read_csv(spark, str(tmp_path / "t.csv"), name_col="title", text_col="content").first()
    assert (r.name, r.text) == ("x", 'a, "b"\nc')
    with pytest.raises(ValueError):
        readers.read_csv(spark, str(tmp_path / "t.csv"))
    (tmp_path / "t.json").write_text(json.dumps([{"name": "n", "text": "t"}]))
    assert readers.read_json(spark, str(tmp_path / "t.json")).first().text == "t"
    (tmp_path / "l.txt").write_text("one\ntwo\n")
    assert [(r.name, r.text) for r in readers.read_lines(spark, str(tmp_path / "l.txt")).collect()] == [("text001", "one"), ("text002", "two")]
    assert [r.name for r in readers.from_texts(spark, ["a", "b"]).collect()] == ["text001", "text002"]
    (tmp_path / "k.tsv").write_text("1\tlab\tsome\ttext\nlab2\tt2\nonly\n")
    assert [(r.label, r.text) for r in readers.read_labelled(spark, str(tmp_path / "k.tsv")).collect()] == [("lab", "some text"), ("lab2", "t2"), ("no_label", "only")]


def test_topic_files(spark, tmp_path):
    (tmp_path / "d.txt").write_text("0\ta\t0.25\t0.75\n1\tb\t1:0.5 0:0.5\n")
    assert sorted((r.doc_id, r.topic, r.p) for r in readers.read_doc_topics(spark, str(tmp_path / "d.txt")).collect()) == [(0, 0, 0.25), (0, 1, 0.75), (1, 0, 0.5), (1, 1, 0.5)]
    with gzip.open(tmp_path / "s.gz", "wt") as f:
        f.write("#doc source pos typeindex type topic\n#alpha : 0.1 0.2\n#beta : 0.01\n0 a 0 0 cat 1\n")
    assert readers.state_alpha(str(tmp_path / "s.gz")) == [0.1, 0.2]
    assert readers.read_topic_state(spark, str(tmp_path / "s.gz")).first().topic == 1
    (tmp_path / "k.txt").write_text("0\t0.5\ta b\n1\n")
    assert [(r.weight, r.keywords) for r in readers.read_topic_keys(spark, str(tmp_path / "k.txt")).collect()] == [(0.5, "a b"), (None, "")]
    parts = readers.split_conllu("\n\n".join(f"1\tw{i}" for i in range(10)))
    assert [len(parts[k]) for k in ("train", "dev", "test")] == [8, 1, 1]
    assert readers.combine_conllu(["a", "b\n"]) == "a\n\nb\n\n"


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a cat"), (2, "dog")], "doc_id long, text string")
    sinks.save_corpus(df, str(tmp_path / "c"), {"k": 1})
    back, meta = sinks.load_corpus(spark, str(tmp_path / "c"))
    assert back.count() == 2 and meta == {"k": 1}
    raw = sinks.record_bytes({"id": 1, "text": "é"})
    assert sinks.record_from_bytes(raw) == {"id": 1, "text": "é"}
    with pytest.raises(ValueError):
        sinks.record_from_bytes(raw.replace(b"1", b"2", 1) if not raw.endswith(b"1") else raw)
    sinks.chunk_files(spark.createDataFrame([("x_001", " a ")], "name string, chunk string"), str(tmp_path / "ch"))
    assert (tmp_path / "ch" / "x_001.txt").read_text() == "a"
    sinks.to_sqlite(df, str(tmp_path / "r.db"))
    assert sinks.search_sqlite(str(tmp_path / "r.db"), "cat") == [(1, "a cat")]
    tt = spark.createDataFrame([(0, "a", 3.0), (1, "b", 2.0)], "topic int, term string, w double")
    dt = spark.createDataFrame([(7, 0, 0.5), (7, 1, 0.5)], "doc_id long, topic int, p double")
    sinks.topic_browser_files(dt, tt, str(tmp_path / "tb"))
    assert json.loads((tmp_path / "tb" / "tw.json").read_text())["tw"][0]["words"] == ["a"]
    assert sinks.report(str(tmp_path / "rep"), {"docs": 2}, df, as_html=True).endswith("report.html")


def test_streams(spark, tmp_path):
    src, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    src.mkdir()
    (src / "a.txt").write_text("One, TWO")
    stream = streaming.scrubbed(streaming.text_files(spark, str(src)), ["lower_case", "punctuation"])
    streaming.run_once(stream.select("name", "text"), out, state)
    (src / "b.txt").write_text("Three!")
    streaming.run_once(stream.select("name", "text"), out, state)
    assert sorted((r.name, r.text) for r in spark.read.parquet(out).collect()) == [("a", "one two"), ("b", "three")]
    q = streaming.running_term_counts(streaming.text_files(spark, str(src))).writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("select sum(n) from counts").first()[0] == 3


def test_encodings():
    texts = {
        "utf-8": "Grüße aus Köln — ça va? 日本語", "utf-16": "plain text é", "cp1252": "Déjà vu: les élèves “français” déjeunent là-bas, où ça coûte 3 €.", "cp1251": "Съешь же ещё этих мягких французских булок, да выпей чаю",
        "koi8_r": "Съешь же ещё этих мягких французских булок, да выпей чаю", "shift_jis": "これは日本語のテキストです。漢字とかなを含みます。", "euc_jp": "これは日本語のテキストです。漢字とかなを含みます。", "euc_kr": "안녕하세요. 이것은 한국어로 쓴 짧은 글입니다.",
        "gb18030": "这是一个用中文写的句子，没有别的意思。我们今天去学校学习新的知识。",
    }
    for name, text in texts.items():
        assert readers.decode(text.encode(name)) == text, (name, readers.encoding_of(text.encode(name)))
    assert readers.decode(b"plain\r\nascii\r") == "plain\nascii\n" and readers.decode(b"") == ""
    assert readers.encoding_of(b"caf\xe9") == "cp1252"


def test_topic_browser_tables(spark, tmp_path):
    tt = spark.createDataFrame([(t, w, float(n)) for t, ws in enumerate(("ab", "bc", "de")) for n, w in enumerate(ws, 1)], "topic int, term string, w double")
    dt = spark.createDataFrame([(d, t, [0.5, 0.5, 0.0][(d + t) % 3]) for d in (7, 3) for t in range(3)], "doc_id long, topic int, p double")
    counts = spark.createDataFrame([(7, 0, 4), (3, 2, 9)], "doc_id long, topic int, n long")
    (tmp_path / "metadata.csv").write_text("mine")
    sinks.topic_browser_files(dt, tt, str(tmp_path), counts=counts)
    assert (tmp_path / "doc-topic-counts.csv").read_text() == "docNum,topic0,topic1,topic2\n0,0,0,9\n1,4,0,0\n"
    assert (tmp_path / "doc-topic.txt").read_text().splitlines()[0] == "0\tdoc1\t0.5000000000\t0.5000000000\t0.0000000000"
    assert (tmp_path / "metadata.csv").read_text() == "mine"
    lines = (tmp_path / "topic_coords.csv").read_text().splitlines()
    assert lines[0] == "topic,x,y" and len(lines) == 4


def test_labelled_lines_are_numbered_within_their_file(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("one\nl\ttwo\nid9\tl\tthree\n")
    (tmp_path / "b.tsv").write_text("")
    assert sorted(tuple(r) for r in readers.read_labelled(spark, str(tmp_path)).collect()) == [("0", "no_label", "one"), ("1", "l", "two"), ("id9", "l", "three")]
