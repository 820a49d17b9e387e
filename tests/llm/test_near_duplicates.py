"""Near duplicates under the pipeline's rule: five words, four fifths."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents():
    r = random.Random(8)
    out = []
    for _ in range(12):
        base = [f"w{r.randrange(10**6)}" for _ in range(200)]
        out.append(base)
        for edits in (1, 3, 5, 8):  # at the border of either rule
            copy = list(base)
            for at in r.sample(range(0, 200, 6), edits):
                copy[at] = "edit"
            out.append(copy)
        cut = list(base[:165])  # a part: both rules see the same share
        out.append(cut)
    return [(k, " ".join(w)) for k, w in enumerate(out)] + [(900, "a b c"), (901, "A b c"), (902, ""), (903, None)]


def linked(docs, size, percent):
    from tests.llm import brute

    sets = {doc: brute.shingles(text, size) for doc, text in docs}
    up = {doc: doc for doc in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = root(a), root(b)
                    up[max(x, y)] = min(x, y)
    return {doc: root(doc) for doc in up}


def test_pipeline_stage_takes_five_words(spark):
    import corpus_pipeline
    from strata.llm.minhash import near_duplicates

    rows = documents()
    docs = spark.createDataFrame([(k, t, "en", "s", None) for k, t in rows], SCHEMA).repartition(3)
    five, three = linked(rows, 5, 80), linked(rows, 3, 85)
    assert five != three
    assert {r.doc_id: r.component_id for r in near_duplicates(docs, shingle=5, percent=80).collect()} == five
    assert {r.doc_id: r.component_id for r in near_duplicates(docs).collect()} == three
    kept = corpus_pipeline.minhash_dedup(spark, docs, "")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(k for k, c in five.items() if k == c)


def test_bands_follow_the_threshold():
    from strata.llm.minhash import banding

    assert banding(85) == (6, 32, 134)
    for percent in (50, 70, 80, 90, 95):
        rows, bands, least = banding(percent)
        assert (1 - (percent / 100) ** rows) ** bands <= 3e-7 and rows * bands <= 192 and least < percent * rows * bands / 100
