import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import public_tokenizers
from tideline.llm import bpe

CODEC = bpe.Codec(bpe.vocabulary())
LIBRARY = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
TEXTS = ["", "a" * 700, " " * 50 + "x  ", "<|endoftext|>hi<|endoftext|><|endoftext|>", "日本語 한국어 ١٢٣ ½ é \u0085 \r\n\n", "it's I'LL \U0001f600‍", "aaaa aaaaaaa ababab", "<|endoftext|", "hello hello hello"]


def ids(texts):
    return [x.tolist() for x in bpe.Encoder(CODEC).encode(texts)]


def test_equals_the_library():
    assert ids(TEXTS) == [e.ids for e in LIBRARY.encode_batch(TEXTS, add_special_tokens=False)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.characters(blacklist_categories=("Cs", "Cn", "Co")), max_size=60), max_size=4))
def test_random_texts(texts):
    got = ids(texts)
    assert got == [e.ids for e in LIBRARY.encode_batch(texts, add_special_tokens=False)]
    assert [CODEC.decode(g) for g in got] == texts


def test_decode_of_broken_bytes():
    broken = [i for i, p in enumerate(CODEC.pieces) if p == b"\xe6"][:1] * 2 + ids(["ok"])[0]
    assert CODEC.decode(broken) == LIBRARY.decode(broken, skip_special_tokens=False)


def test_words_are_forgotten_between_chunks(monkeypatch):
    monkeypatch.setattr(bpe, "KEPT_WORDS", 3)
    e = bpe.Encoder(CODEC)
    assert [e.encode([t])[0].tolist() for t in TEXTS * 2] == ids(TEXTS) * 2


def test_disordered_merges_are_refused():
    import json

    spec = json.loads(bpe.vocabulary())
    spec["model"]["merges"].reverse()
    with pytest.raises(ValueError):
        bpe.Codec(json.dumps(spec))


def test_dataframe_edges(spark):
    rows = [(None, None, 1), (1, "", 2), (1, "", 2), (2, "word " * 20_000, 3), (3, "<|endoftext|>", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = bpe.encode_texts(docs.drop("n_tokens"), bpe.vocabulary(), with_decoded=True, keep=("doc_id",)).collect()
    assert len(got) == 5
    by = {r.doc_id: r for r in got}
    assert by[None].n_tokens == 0 and by[1].n_tokens == 0 and by[3].ids == [50256]
    assert by[2].decoded_sha256 == hashlib.sha256(("word " * 20_000).encode()).hexdigest()
    assert by[2].ids_sha256 == hashlib.sha256(np.array(by[2].ids, "<u4").tobytes()).hexdigest()
    back = bpe.decode_ids(bpe.encode_texts(docs.drop("n_tokens"), bpe.vocabulary(), keep=("doc_id",)), bpe.vocabulary(), keep=("doc_id",))
    assert {r.doc_id: r.text for r in back.collect()}[3] == "<|endoftext|>"
    assert bpe.encode_texts(docs.limit(0).drop("n_tokens"), bpe.vocabulary(), keep=("doc_id",)).count() == 0
