"""The pipeline against a plain version of all its stages."""


import pytest

from tests.llm import brute
from tests.llm.test_operators import encoders, passages  # noqa: F401


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("sf"))
    texts = [t for t in passages(9) if t is None or len(t) < 20000]
    texts = [t and t + " The end of the day in the town." for t in texts]
    rows = [(3 * k, t, "en", f"src{k % 3}", None if t is None else len(t)) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{out}/documents.parquet")
    leaks = [(1, " ".join(brute.marks(texts[18])[3:20])), (2, "not in any document at all but long enough to be one window")]
    spark.createDataFrame(leaks, "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return out, rows, leaks


def test_pipeline(spark, folder, encoders):  # noqa: F811
    import corpus_pipeline
    from strata.llm.quality_rules import judge

    out, rows, leaks = folder
    verdict = {r.doc_id: r.kept for r in judge(spark.read.parquet(f"{out}/documents.parquet")).collect()}
    docs = [(doc, text) for doc, text, *_ in rows if verdict[doc]]
    assert docs and len(docs) < len(rows)
    component, _ = brute.components(docs, corpus_pipeline.NEAR_WORDS, corpus_pipeline.NEAR_PERCENT)
    docs = [(doc, text) for doc, text in docs if component[doc] == doc]
    left = []
    for (doc, text), (w, gone) in zip(docs, brute.substring_marks(docs), strict=True):
        if not all(gone):
            left.append((doc, " ".join(x for x, g in zip(w, gone) if not g) if any(gone) else text))
    clean = [(doc, text) for doc, text in left if not brute.benchmark_hits(text, leaks)[1]]
    assert len(clean) < len(left)
    expected = {}
    for doc, text in clean:
        whole = brute.ids(encoders["word_bpe_49k.json"], text)
        for piece, at in enumerate(range(0, len(whole), 2048)):
            part = whole[at:at + 2048]
            expected[doc, piece] = (at, len(part), brute.crc(part))
    got = corpus_pipeline.run(spark, out).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == expected
    assert len({r.sequence_id for r in got}) == brute.best_fit([e[1] for e in expected.values()], 2048)


def test_stages_keep_the_columns(spark, folder):
    import corpus_pipeline

    out, rows, _ = folder
    docs = spark.read.parquet(f"{out}/documents.parquet")
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, out).columns == docs.columns
        assert stage(spark, empty, out).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, empty, out).count() == 0
