"""Token ids where a text holds the content of an added token, against the
library as it comes from the file."""

import numpy as np
import pytest

SCHEMA = "doc_id long, text string"
TEXTS = ["stop <|endoftext|> next", "<|endoftext|>", "a<|startoftext|>b", "<|endoftext|><|endoftext|> x", "<|ENDOFTEXT|> a  <|endoftext|>\n",
         "<|endoftext| >", "é <|endoftext|>'s", "plain words"]


@pytest.fixture(scope="module")
def libraries():
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    return {name: Tokenizer.from_file(public.path(name)) for name in ("byte_bpe_50k.json", "word_bpe_49k.json")}


def test_encoder_finds_added_tokens(libraries):
    from strata.llm.encoding import encoder, resolve

    for name, library in libraries.items():
        for text in TEXTS:
            got = np.frombuffer(encoder(resolve(name)).encode([text])[0], "<u4").tolist()
            assert got == library.encode(text, add_special_tokens=False).ids, (name, text)


def test_operators_find_added_tokens(spark, libraries):
    from strata.llm.best_fit import pack
    from strata.llm.wavelet import round_trip
    from tests.llm import brute

    docs = spark.createDataFrame(list(enumerate(TEXTS)), SCHEMA)
    start = 0
    for r, text in zip(round_trip(docs).orderBy("doc_id").collect(), TEXTS, strict=True):
        whole = brute.ids(libraries["byte_bpe_50k.json"], text)
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(whole), brute.crc(whole))
        start += len(whole)
    for r in pack(docs).collect():
        whole = brute.ids(libraries["word_bpe_49k.json"], TEXTS[r.doc_id])
        assert (r.length, r.ids_crc32) == (len(whole), brute.crc(whole))
