"""The pipeline against brute force, stage by stage."""

import importlib
import zlib

import numpy as np
import pytest

from tests.llm.test_operators import LONG, SF, TOKENS, brute_hits, brute_near, table

pipeline = importlib.import_module("corpus_pipeline")


@pytest.fixture(scope="module")
def stages(spark):
    from textmill.llm._common import materialize
    from textmill.llm._common import table as read

    out = [read(spark, SF, "documents")]
    for name, stage in pipeline.STAGES:
        out.append(materialize(stage(spark, out[-1], SF), name))
    return [d.toPandas() for d in out]


def test_stages(stages):
    documents, clean, unique, safe, mixed, tokens = stages
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "near_dedup", "decontamination", "mixing", "token_output"]
    for d in stages[:-1]:
        assert list(d.columns) == list(documents.columns)
    toxic = set(table("labels").query("toxic == 1").doc_id)
    dropped = set(documents.doc_id) - set(clean.doc_id)
    assert len(dropped & toxic) > 0.5 * len(dropped) > 0
    near = brute_near(list(zip(clean.doc_id, clean.text, strict=True)))
    assert set(unique.doc_id) == {i for i, (_, c) in near.items() if i == c}
    items = list(table("benchmark").itertuples(index=False, name=None))
    assert set(safe.doc_id) == {r.doc_id for r in unique.itertuples() if brute_hits(r.text, items)[2] == 0}
    assert set(mixed.doc_id) <= set(safe.doc_id) and mixed.groupby("doc_id").size().max() <= 2
    words = lambda d: d.text.map(lambda t: len((t or "").split())).sum()
    assert words(mixed) == pytest.approx(1.5 * words(safe), rel=0.02)
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(f"{TOKENS}/word_bpe_49k.json")
    start = 0
    for r, d in zip(tokens.sort_values("start").itertuples(), mixed.sort_values(["doc_id", "text"]).itertuples(), strict=True):
        ids = [*lib.encode(d.text or "", add_special_tokens=False).ids, 2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (d.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_run_gives_the_last_stage(spark, stages):
    got = pipeline.run(spark, SF).toPandas()
    assert sorted(got.ids_crc32) == sorted(stages[-1].ids_crc32)


def test_hard_rows(spark):
    toxic_free = "A quiet line about rivers and stones that nobody could mind at all today."
    rows = [(1, None, None, None, None), (1, None, None, None, None), (2, "", "en", "a", 0), (None, "no id", "en", None, 5), (3, LONG, "en", "a", len(LONG)), (4, "one two", None, "b", 7), (4, "one two", None, "b", 7), (5, toxic_free, "en", "a", 9), (6, toxic_free + " Yes.", "en", "a", 9), (7, toxic_free + " Yes.", "xx", "c", 9)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, hits string, key string, size long, __p string, times int, n long, component_id long"
    docs = spark.createDataFrame([(*r, "h", "k", 1, "p", 2, 3, 4) for r in rows], schema)
    for d in (docs, docs.limit(0)):
        seen = []
        for _, stage in pipeline.STAGES:
            before, d = d, stage(spark, d, SF)
            seen.append([tuple(r) for r in d.collect()])
            if stage is not pipeline.STAGES[-1][1]:
                assert d.schema == docs.schema
                # Rows come out as they went in.
                assert set(seen[-1]) <= {tuple(r) for r in before.collect()}
        clean, unique, safe, mixed, tokens = seen
        if before.isEmpty():
            assert not tokens
            continue
        assert sorted(map(str, clean)) == sorted(str(tuple(r)) for r in docs.collect())
        # Texts 5 to 7 are one group (11 of 12 shingles); rows of one id, and those without id or words, stay.
        assert sorted(str(r[0]) for r in unique) == sorted(map(str, [1, 1, 2, None, 3, 4, 4, 5]))
        assert sorted(map(str, safe)) == sorted(map(str, unique))
        ids = [r[0] for r in mixed]
        assert max(map(ids.count, [None, 2, 3, 5])) <= 2 and max(map(ids.count, [1, 4])) <= 4
        assert sorted(str(r[0]) for r in tokens) == sorted(map(str, ids)) and [r[1] for r in sorted(tokens, key=lambda r: r[1])][0] == 0
