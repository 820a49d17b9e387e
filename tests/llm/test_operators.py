"""Each operator against its plain version, with awkward rows: nulls, empty and
very long texts, ties, repeated rows, empty tables and extra columns."""

import random
import zlib

import pytest
from pyspark.sql import functions as F

from tests.llm import brute

SCHEMA = "doc_id long, text string, id string, n long, row string, block long, digest string"


def passages(seed=3):
    r = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in "the of and un der mit é".split() for b in ("", "x", "yz", "ß", "Q")]
    line = lambda k: " ".join(r.choice(vocabulary) for _ in range(k))
    shared = [line(40) for _ in range(4)]
    out = [None, "", " ", "\n\t ", "one", "two words", "One", "a b c", "same words " * 60, "x" * 500]
    for k in range(40):
        parts = [line(r.randint(1, 60)), r.choice(shared), line(r.randint(1, 30))]
        r.shuffle(parts)
        out.append(r.choice(["\n", " ", "  \t"]).join(parts))
    base = line(120).split(" ")
    for k in range(12):  # near copies
        copy = list(base)
        for _ in range(k):
            copy[r.randrange(len(copy))] = "edit"
        out.append(" ".join(copy))
    out += [out[15]] * 5 + [line(6000)] + [shared[0]]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(10 * k + 3, t, "clash", k, "r", 1, "d") for k, t in enumerate(passages())]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def rows(docs):
    return sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    """Null ids, and one row three times."""
    text = " ".join(f"w{k}" for k in range(150))
    same = (7, text, "c", 1, "r", 1, "d")
    return spark.createDataFrame([same, same, same, (None, text, "c", 1, "r", 1, "d"), (None, None, "c", 1, "r", 1, "d")], SCHEMA)


def test_quality_rules(docs, rows, nothing, odd):
    from strata.llm.quality_rules import judge, keep_clean

    got = {r.doc_id: r for r in judge(docs).collect()}
    for doc, text in rows:
        r = got[doc]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute.quality(text)
        assert not (r.base_failed and r.kept)
    kept = keep_clean(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, r in got.items() if r.kept)
    assert judge(nothing).count() == 0 and keep_clean(nothing).count() == 0
    assert judge(odd).count() == 5


def test_quality_verdict(spark):
    from strata.llm.quality_rules import judge

    prose = "The river and the hills of the north are quiet in the morning, and it is cold by the sea. " * 1
    rows = [(1, prose + "Nobody was on the road to the town that day."), (2, " ".join(f"{w}$$$" for w in prose.split())),
            (3, "\n".join(f"- {w} the" for w in prose.split())), (4, " ".join(f"zq{k}x" for k in range(40)))]
    got = {r.doc_id: r.kept for r in judge(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: True, 2: False, 3: False, 4: False}


def test_substrings(docs, rows, nothing, odd):
    from strata.llm.substrings import digest, remove

    got = {r.doc_id: r for r in digest(docs).collect()}
    for (doc, _), (w, gone) in zip(rows, brute.substring_marks(rows), strict=True):
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        assert (got[doc].n_words, got[doc].n_removed, got[doc].kept_sha256) == (len(w), sum(gone), brute.sha(kept))
    left = remove(docs)
    assert left.columns == docs.columns
    texts = {r.doc_id: r.text for r in left.collect()}
    for (doc, text), (w, gone) in zip(rows, brute.substring_marks(rows), strict=True):
        if gone and all(gone):
            assert doc not in texts
        else:
            assert texts[doc] == (" ".join(x for x, g in zip(w, gone) if not g) if any(gone) else text)
    assert digest(nothing).count() == 0 and remove(nothing).count() == 0
    assert sorted((r.doc_id is None, r.n_words, r.n_removed) for r in digest(odd).collect()) == [
        (False, 150, 0)] * 3 + [(True, 0, 0), (True, 150, 150)]


def test_substrings_short_windows(docs, rows):
    from strata.llm.substrings import digest

    got = {r.doc_id: r.n_removed for r in digest(docs, window=5).collect()}
    assert got == {doc: sum(gone) for (doc, _), (_, gone) in zip(rows, brute.substring_marks(rows, 5), strict=True)}


def test_substring_levels(spark, docs):
    from strata.llm import substrings as S

    assert S.levels(13) == [4, 8, 13] and S.levels(5) == [4, 5] and S.levels(3) == [3] and S.levels(16) == [4, 8, 16]
    finish = lambda ids, data, offsets, words, marks: S.pa.RecordBatch.from_arrays([S.pa.array([int(marks.sum())])], names=["n"])
    trace = []
    removed = sum(r.n for r in S.repeats(docs, finish, "n long", trace=trace).collect())
    assert removed and [length for length, _ in trace] == [4, 8, 13] and all(n for _, n in trace)
    asked, plain = dict(trace), []
    S.repeats(docs, finish, "n long", window=4, trace=plain)  # all windows of four words
    assert asked[4] < plain[0][1]
    alone = spark.createDataFrame([(k, " ".join(f"w{k}x{j}" for j in range(40))) for k in range(9)], "doc_id long, text string")
    trace = []
    assert sum(r.n for r in S.repeats(alone, finish, "n long", trace=trace).collect()) == 0
    assert [length for length, _ in trace] == [4, 8] and trace[0][1] and not trace[1][1]  # none survives the first


def test_equal_first_hashes():
    import numpy as np

    from strata.llm.substrings import by_hash

    h, second = np.array([5, 3, 5, 5, 3], np.uint64), np.array([1, 9, 2, 1, 9], np.uint32)
    order, fresh = by_hash(h, second)
    assert order.tolist() == [1, 4, 0, 3, 2] and fresh.tolist() == [True, False, True, False, True]


def test_decontamination(spark, docs, rows, nothing, odd, monkeypatch):
    from strata.llm import decontaminate as D

    r = random.Random(5)
    items = [(1, None), (2, ""), (3, "one"), (4, "Two, words!"), (None, "a b c"), (12, rows[-1][1]), (12, rows[-1][1])]
    for k in range(20):
        w = brute.marks(r.choice(rows[12:])[1])
        at = r.randrange(max(1, len(w) - 12))
        items.append((100 + k, " ".join(w[at:at + r.choice([4, 10, 15])]).upper()))
    bench = spark.createDataFrame(items, "item_id long, text string")
    expected = {doc: brute.benchmark_hits(text, items) for doc, text in rows}

    def check():
        for g in D.digest(D.find(docs, bench)).collect():
            n, hit, found = expected[g.doc_id]
            assert (g.n_words, g.n_hit, g.n_items, g.items_sha256, g.contaminated) == (
                n, hit, len(found), brute.sha(",".join(found)), hit > 0)

    check()
    monkeypatch.setattr(D, "BLOCK_BYTES", 600)  # the same by joins
    check()
    clean = D.drop_contaminated(docs, bench)
    assert clean.columns == docs.columns
    assert sorted(x.doc_id for x in clean.collect()) == sorted(d for d, e in expected.items() if not e[1])
    empty = spark.createDataFrame([], "item_id long, text string")
    assert D.digest(D.find(docs, empty)).where("contaminated").count() == 0
    assert D.find(nothing, bench).count() == 0 and D.find(odd, bench).count() == 5


def test_minhash(docs, rows, nothing, odd):
    from strata.llm.minhash import near_duplicates

    component, sizes = brute.components(rows)
    got = {r.doc_id: r for r in near_duplicates(docs).collect()}
    for doc, _ in rows:
        assert (got[doc].n_shingles, got[doc].component_id, got[doc].kept) == (sizes[doc], component[doc], component[doc] == doc)
    assert near_duplicates(nothing).count() == 0
    answer = sorted((r.doc_id is None, r.n_shingles, r.component_id or 0, r.kept) for r in near_duplicates(odd).collect())
    assert answer == [(False, 148, 7, True)] * 3 + [(True, 0, 0, True), (True, 148, 7, False)]


def test_minhash_blocks(docs, rows, monkeypatch):
    from strata.llm import minhash

    monkeypatch.setattr(minhash, "BLOCK_BYTES", 4000)  # groups spread over pairs of blocks
    component, _ = brute.components(rows)
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(docs).collect()} == component


def test_recall_at_the_threshold():
    """Of pairs just at the threshold, bands and screen lose none."""
    import numpy as np
    import pyarrow as pa

    from strata.llm import minhash, textvec

    r = random.Random(12)
    for percent, size in ((85, 3), (80, 5)):
        per_band, bands, least = minhash.banding(percent)
        for shared in (17, 34, 170, 850):
            texts = []
            for pair in range(150):  # sets of single words, sized so that the similarity is the threshold
                both = [f"s{r.random()}" for _ in range(shared * percent // 85)]
                extra = max(0, int(len(both) * 100 / percent + 1e-9) - len(both))
                texts += [" ".join([*both, *(f"a{r.random()}" for _ in range(extra // 2))]),
                          " ".join([*both, *(f"b{r.random()}" for _ in range(extra - extra // 2))])]
            value, bounds = minhash.shingle_sets(*textvec.buffers(pa.array(texts)), 1)
            marks = minhash.signatures(value, bounds, per_band * bands)
            left, right = marks[::2], marks[1::2]
            met = (left.reshape(-1, bands, per_band) == right.reshape(-1, bands, per_band)).all(2).any(1)
            assert met.all() and ((left == right).sum(1) >= least).all()
            for k in range(0, len(texts), 2):
                one, two = (set(value[bounds[j]:bounds[j + 1]].tolist()) for j in (k, k + 1))
                assert percent / 100 <= len(one & two) / len(one | two) <= percent / 100 + 0.06
    assert np.array_equal(minhash.shared_with(np.array([1, 5], np.uint64), np.array([1, 5, 7, 5], np.uint64), np.array([0, 3, 4])), [2, 1])


def test_components_of_a_long_path(spark):
    from strata.llm.common import Scratch
    from strata.llm.components import components

    edges = spark.range(40).select((F.col("id") + 1).alias("u"), F.col("id").alias("v")).unionByName(
        spark.createDataFrame([(100, 101), (103, 101), (5, 5), (100, 101)], "u long, v long"))
    got = {r.u: r.v for r in components(edges, Scratch(spark, "t"), "t").collect()}
    assert got == {**{k: 0 for k in range(1, 41)}, 101: 100, 103: 100}


def test_suffixes(docs, rows, nothing, odd):
    from strata.llm.suffixes import digest

    texts = [(t or "").encode() for _, t in rows]
    got = {r.doc_id: r for r in digest(docs).collect()}
    for (doc, _), text, gone in zip(rows, texts, brute.byte_marks(texts), strict=True):
        kept = bytes(b for b, g in zip(text, gone) if not g)
        spans = len([1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1])])
        r = got[doc]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(text), sum(gone), spans, brute.sha(kept))
    assert digest(nothing).count() == 0
    assert sorted((r.doc_id is None, r.n_removed > 0) for r in digest(odd).collect()) == [
        (False, False), (False, True), (False, True), (True, False), (True, True)]


def test_hot_anchors():
    """One common line in many contexts: the parts give what one text gives."""
    import numpy as np

    from strata.llm import blocks, suffixes

    r = random.Random(9)
    line = b"this line stands in every document and in many places of it"
    around = [bytes(r.choice(b"abcd ") for _ in range(90)) for _ in range(60)]
    texts = [r.choice(around)[r.randrange(20):] + line + r.choice(around)[:r.randrange(60, 90)] for _ in range(400)]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    phrases = suffixes.Phrases(data, offsets, 100, 32)
    blob = suffixes.send_blob(phrases, np.arange(len(phrases.first)), np.arange(len(texts)), data)
    kept, said = suffixes.HOT_BYTES, []
    try:
        for suffixes.HOT_BYTES in (0, 3000, 1 << 30):
            said.append(blocks.expand(suffixes.interval_answers(100, 32)([0], [blob])[0]))
    finally:
        suffixes.HOT_BYTES = kept
    assert said[0] == said[1] == said[2] and any(said[0])


def test_suffixes_parted(docs, rows, monkeypatch):
    from strata.llm import suffixes

    monkeypatch.setattr(suffixes, "HOT_BYTES", 0)
    texts = [(t or "").encode() for _, t in rows]
    got = {r.doc_id: r.n_removed for r in suffixes.digest(docs).collect()}
    assert got == {doc: sum(gone) for (doc, _), gone in zip(rows, brute.byte_marks(texts), strict=True)}


def test_intervals_of_small_texts():
    import numpy as np

    from strata.llm.suffixes import expand_intervals

    r = random.Random(2)
    for _ in range(60):
        text = bytes(r.choice(b"ab" if r.random() < 0.5 else b"abcde") for _ in range(r.randint(0, 60)))
        length = r.randint(1, 9)
        order, borders = expand_intervals(np.frombuffer(text, np.uint8), length)
        for k in range(1, len(order)):
            a, b = text[order[k - 1]:][:length], text[order[k]:][:length]
            assert borders[k] == (a != b or len(a) < length)


def test_shards(spark, docs, rows, nothing, odd):
    from strata.llm.minimax_shards import shard

    for n in (1, 4, 40, 200):
        got = shard(docs, n).collect()
        assert sorted(r.doc_id for r in got) == [d for d, _ in rows]
        texts = dict(rows)
        by, where = {}, {}
        for r in got:
            body = (texts[r.doc_id] or "").encode()
            assert (r.size, r.text_crc32) == (len(body) + 16, zlib.crc32(body)) and 0 <= r.shard < n
            by.setdefault(r.shard, []).append(r)
            where.setdefault(body, set()).add(r.shard)
        assert all(len(s) == 1 for s in where.values())
        assert all(sorted(r.slot for r in part) == list(range(len(part))) for part in by.values())
        groups = {}
        for r in sorted(got, key=lambda r: (r.shard, r.slot)):
            groups[bytes(r.digest)] = groups.get(bytes(r.digest), 0) + r.size
        low, high = max(groups.values()), sum(groups.values())
        while low < high:  # the smallest capacity of a contiguous fill
            middle, used, held = (low + high) // 2, 1, 0
            for size in groups.values():
                if held + size > middle:
                    used, held = used + 1, 0
                held += size
            low, high = (low, middle) if used <= n else (middle + 1, high)
        assert max(sum(r.size for r in part) for part in by.values()) == low
    assert shard(nothing).count() == 0 and shard(odd).count() == 5


def test_shards_with_a_hot_group(spark):
    from strata.llm.minimax_shards import shard

    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(
        F.col("id").cast("string")).alias("text"))
    got = shard(rows, 8).collect()
    assert len(got) == 3000 and len({r.shard for r in got if r.doc_id % 3 == 0}) == 1
    for k in {r.shard for r in got}:
        slots = sorted(r.slot for r in got if r.shard == k)
        assert slots == list(range(len(slots)))


@pytest.fixture(scope="module")
def encoders():
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    out = {}
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        out[name] = Tokenizer.from_file(public.path(name))
        out[name].encode_special_tokens = True
    return out


ODD_TEXTS = [
    "á éÅ É", "İstanbul ΣΑΣ 'S it's DON'T l'été", "x  y  z  \n\n t\t\tq ", "<|endoftext|> a<|startoftext|>b",
    "日本語 テキスト１２３ ²½ ⅷ", "ＦＵＬＬ width…—“q”", "a\x1cb\x85c​d", "µ ß ÿ Ÿ ×÷ ªº", "don''t ''s '", "éé x́ a­b",
    "foo_bar __x__ 12_3 a1b2", "\U0001f600 \U0001f468‍\U0001f469", "  　x", "tail \n", "a" * 300 + "Ж" * 70]


def test_encoder_equals_the_library(encoders):
    from strata.llm.encoding import Encoder, resolve

    for name, library in encoders.items():
        mine = Encoder(resolve(name))
        for text in ODD_TEXTS + [t or "" for t in passages()]:
            import numpy as np

            assert np.frombuffer(mine.encode([text])[0], "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_encoder_batches(encoders, monkeypatch):
    """Whole batches, with a memory of pieces that is too small and one that is not."""
    import pyarrow as pa

    from strata.llm import encoding

    r = random.Random(6)
    parts = [" ", "  ", "\n", "\t ", " \n", "\r\n", "a", "It's", "word", "Word,", "x" * 70, "é", "日本", "\u00a0", "12", "'", "<|", "e\u0301", "\u2028", "\x1d", "İ"]
    texts = ODD_TEXTS + passages() + ["".join(r.choice(parts) for _ in range(r.randrange(12))) for _ in range(1500)]
    for name, library in encoders.items():
        for entries in (10, 10**6):
            monkeypatch.setattr(encoding, "PIECES", entries)
            mine = encoding.Encoder(encoding.resolve(name))
            for at in range(0, len(texts), 300):
                some = texts[at:at + 300]
                ids, bounds = mine.batch(pa.array(["pad", *some], pa.string()).slice(1), 7)
                for k, text in enumerate(some):
                    assert ids[bounds[k]:bounds[k + 1]].tolist() == [*library.encode(text or "", add_special_tokens=False).ids, 7], (name, text)
            assert mine.batch(pa.array([], pa.string()), 7)[0].tolist() == []


def test_packing(docs, rows, nothing, odd, encoders):
    from strata.llm.best_fit import pack

    for capacity in (2048, 64):
        got = pack(docs, capacity=capacity).collect()
        expected = {}
        for doc, text in rows:
            whole = brute.ids(encoders["word_bpe_49k.json"], text)
            for piece, at in enumerate(range(0, len(whole), capacity)):
                part = whole[at:at + capacity]
                expected[doc, piece] = (at, len(part), brute.crc(part))
        assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == expected
        bins = {}
        for r in got:
            bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for held in bins.values():
            at = 0
            for offset, length in sorted(held):
                assert offset == at
                at += length
            assert at <= capacity
        assert len(bins) == brute.best_fit([e[1] for e in expected.values()], capacity)
    assert pack(nothing).count() == 0 and pack(odd).count() == 5


def test_wavelet_round_trip(docs, rows, nothing, odd, encoders, monkeypatch):
    from strata.llm import wavelet

    monkeypatch.setattr(wavelet, "RANGE_BYTES", 9000)
    monkeypatch.setattr(wavelet, "SHARD_TOKENS", 700)
    start = 0
    for r, (doc, text) in zip(wavelet.round_trip(docs).orderBy("doc_id").collect(), rows, strict=True):
        whole = brute.ids(encoders["byte_bpe_50k.json"], text)
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc, start, len(whole), brute.crc(whole))
        start += len(whole)
    assert wavelet.round_trip(nothing).count() == 0
    assert sorted((r.doc_id is None, r.n_tokens > 1) for r in wavelet.round_trip(odd).collect()) == [
        (False, True)] * 3 + [(True, False), (True, True)]


def test_wavelet_matrix_queries():
    import numpy as np

    from strata.llm.wavelet import read_shard, write_shard

    r = random.Random(4)
    for top, n in ((1, 5), (3, 700), (50257, 3000), (70000, 1500), (9, 0)):
        values = np.array([r.randrange(top) for _ in range(n)], np.uint32)
        ids, starts, matrix = read_shard(write_shard(np.array([4, 9]), np.array([0, n // 2, n]), values))
        assert ids.tolist() == [4, 9] and starts.tolist() == [0, n // 2, n]
        assert matrix.values().tolist() == values.tolist()
        at = [r.randrange(n) for _ in range(20)] if n else []
        assert matrix.access(np.array(at, np.int64)).tolist() == values[at].tolist()
        for value in [0, top - 1, *(values[:3].tolist()), 123456]:
            assert matrix.occurrences(value) == np.flatnonzero(values == value).tolist()
            assert matrix.count(value, n // 3, n // 2) == int((values[n // 3:n // 2] == value).sum())


def test_wavelet_reads_what_it_needs(monkeypatch):
    import numpy as np

    from strata.llm import wavelet

    monkeypatch.setattr(wavelet, "FRAME", 256)
    values = np.random.default_rng(1).zipf(1.3, 60_000).clip(0, 40_000).astype(np.uint32)
    at = [1, 40_000, 59_000]
    values[at] = 45_000
    data = wavelet.write_shard(np.array([1]), np.array([0, len(values)]), values)
    _, _, matrix = wavelet.read_shard(data)
    frames = sum(p.frames for p in matrix.planes)
    assert matrix.frames_read == 0 and matrix.occurrences(45_000) == at
    assert 0 < matrix.frames_read <= 8 * len(matrix.planes) < frames / 3
    _, _, matrix = wavelet.read_shard(data)
    assert matrix.access(np.array([at[1]])).tolist() == [45_000] and matrix.frames_read <= 2 * len(matrix.planes)
    _, _, matrix = wavelet.read_shard(data)
    assert matrix.count(1, 100, 50_000) == int((values[100:50_000] == 1).sum()) and matrix.frames_read <= 4 * len(matrix.planes)
    assert matrix.occurrences(1) == np.flatnonzero(values == 1).tolist() and matrix.values().tolist() == values.tolist()


def test_warc(spark):
    from strata.llm import warc

    long, short = "<p>" + "x" * 200 + "é</p>", "<p>short</p>"
    pages = spark.createDataFrame(
        [(5, "http://a/ b\r\nc", long, 1), (2, None, long, 1), (9, "http://b", long, 1), (3, "http://c", short, 1), (4, "http://c", short, 1),
         (6, "http://d", None, 1), (7, "http://e", "", 1), (None, "http://n", long, 1), (9, "http://b", long, 1)],
        "page_id long, url string, html string, record_id long")
    got = sorted(((r.page_id is None, r.page_id or 0), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)
                 for r in warc.round_trip(pages).collect())
    n, d = len(long.encode()), brute.sha(long)
    s, e = brute.sha(short), brute.sha("")
    assert got == sorted([
        ((False, 2), n, d, "response", None), ((False, 3), 12, s, "response", None), ((False, 4), 12, s, "response", None),
        ((False, 5), n, d, "revisit", 2), ((False, 6), 0, e, "response", None), ((False, 7), 0, e, "response", None),
        ((False, 9), n, d, "revisit", 2), ((False, 9), n, d, "revisit", 2), ((True, 0), n, d, "revisit", 2)])
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_warc_ids_and_links(spark):
    """One id with several payloads and null ids, under any partitioning."""
    from strata.llm import warc

    r = random.Random(3)
    bodies = [f"<p>{k} " + "y" * 150 + "</p>" for k in range(9)]
    rows = [(r.choice([*range(40), None]), r.choice(["http://a/", "http://b/", None]), r.choice(bodies)) for _ in range(300)]
    rows += [rows[0]] * 5
    first = {}
    for page, _, body in rows:
        if page is not None:
            first[body] = min(first.get(body, page), page)
    expected = sorted((page is None, page or 0, brute.sha(body), "response" if page == first[body] else "revisit",
                       -1 if page == first[body] else first[body]) for page, _, body in rows)
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(7)
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        for n in (8, 64):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            got = warc.round_trip(pages).collect()
            assert sorted((x.page_id is None, x.page_id or 0, x.payload_digest, x.record_type,
                           -1 if x.refers_to is None else x.refers_to) for x in got) == expected
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


def test_warc_transactions(spark):
    """Concurrent-to in either direction, several metadata, and orphans."""
    from strata.llm import warc

    fields = "record_id string, type string, concurrent_to string"
    rows = [("r1", "response", None), ("q1", "request", "r1"), ("m1", "metadata", "r1"), ("m2", "metadata", "r1"),
            ("q2", "request", None), ("r2", "revisit", "q2"), ("m9", "metadata", "gone"), ("i", "warcinfo", None)]
    have = spark.createDataFrame(rows, fields).select(
        "*", *[F.lit(None).cast(t).alias(c) for c, t in (("refers_to", "string"), ("uri", "string"), ("date", "string"), ("status", "int"),
               ("payload_bytes", "long"), ("payload_digest", "string"), ("payload", "binary"))],
        F.create_map().cast("map<string,string>").alias("fields"))
    got = {r.capture_id: (r.response and r.response.record_id, [x.record_id for x in r.requests or []], [x.record_id for x in r.metadata or []])
           for r in warc.assemble(have).collect()}
    assert got == {"r1": ("r1", ["q1"], ["m1", "m2"]), "r2": ("r2", ["q2"], []), "gone": (None, [], ["m9"])}


ARTICLE = ("<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var t=\"</p>\";</script></head><body>"
           "<nav><ul><li><a href='/'>Home</a></li></ul></nav><!-- <p>no</p> --><div class=\"ad\">Buy\nthis</div>"
           "<article><header><h1>T &amp; t</h1></header><p><b>One  two.<br>three<p>Fi<b>ve</b>&nbsp;&#233;&lt;\n\n six</p>"
           "<aside>Also</aside><div class='comments'><p>Reader says</p></div><form><input>Go</form></article>"
           "<footer>&copy; us</footer></body></html>")


def test_html_article():
    from strata.llm.html_text import KEPT, segments

    assert " ".join(t for k, t in segments(ARTICLE) if k == KEPT) == "T & t One two. three Five é< six"


def test_html_extract(spark):
    from strata.llm.html_text import extract

    menu = "<div>Acme daily news about everything local and global since 1901</div>"
    plain = [f"<html><body>{menu}<h2>Story {k}</h2><p>Only page {k} tells what happened on day {k} of it.</p></body></html>" for k in range(6)]
    rows = [(k, f"http://Host.example/{k}", h, "x") for k, h in enumerate(plain)]
    rows += [(20, "http://host.example/a", ARTICLE, "x"), (21, None, plain[0], "x"), (22, "http://other.example", plain[0], "x"),
             (23, "http://host.example/n", None, "x"), (24, "http://host.example/e", "", "x"), (25, "u", "<p>cut <b", "x"),
             (None, "http://solo.example/", "<p>" + "long " * 50000 + "</p>", "x")]
    got = {r.page_id: r for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string, host string")).collect()}
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got.values())
    for k in range(6):  # the menu repeats on the host, the stories do not
        assert got[k].text == f"Story {k} Only page {k} tells what happened on day {k} of it."
    assert got[20].text == "T & t One two. three Five é< six"
    assert got[21].text == got[22].text == "Acme daily news about everything local and global since 1901 Story 0 Only page 0 tells what happened on day 0 of it."
    assert got[23].text == got[24].text == "" and got[25].text == "cut"
    assert got[None].n_chars == 5 * 50000 - 1
    assert extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_html_runs():
    from strata.llm.html_text import repeated

    pages = [["a b c d e f g".split(), "x y".split()], ["q a b c d e f g r".split()], ["x y z".split()], []]
    got = [[m.tolist() for m in page] for page in repeated(pages, 4)]
    assert got == [[[True] * 7, [False] * 2], [[False] + [True] * 7 + [False]], [[False] * 3], []]
