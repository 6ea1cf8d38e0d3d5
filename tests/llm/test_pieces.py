"""SentencePiece ids and texts, held against the library."""

import hashlib
import random

import numpy as np
import pytest
import sentencepiece

from quillon.llm import pieces

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path(pieces.MODEL)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def model():
    return pieces.PieceModel(PATH)


def held(model, library, texts):
    got = [np.frombuffer(x, "<u4").tolist() for x in pieces.Encoder(model)(texts)]
    want = library.encode([t or "" for t in texts], add_bos=True, add_eos=True, num_threads=1)
    for text, mine, theirs in zip(texts, got, want):
        assert mine == theirs, repr(text[:60])
        assert model.decode(mine) == library.decode(theirs)


def test_edge_texts_have_the_library_s_ids(model, library):
    runs = [" " * n + "x" + " " * n for n in range(1, 70)]
    odd = ["", " ", "\n", "a\x00b", "▁", "▁▁ ▁x", "<s> </s> <0x41> <unk>", "日本語", "é́ x", "\U0001f600\U0001f9ff", "a" * 5000, "=" * 777, "ab" * 900, "a  " * 400, "\t\t x", "\U0010ffff"]
    held(model, library, [*runs, *odd])


def test_random_texts_have_the_library_s_ids(model, library):
    rng = random.Random(7)
    sets = ["abcde ", "etaoin shrdlu", "aab", "= -", "▁ a", "0123456789.,", "日本語の言葉 中文", "αβγδε ж ш", "()[]{}<>/\\ \n\t"]
    texts = []
    for _ in range(1500):
        letters = rng.choice([*sets, "".join(model.pieces[rng.randrange(259, 32000)] for _ in range(20))])
        texts.append("".join(rng.choice(letters) for _ in range(rng.randrange(250))))
    held(model, library, texts)


def test_one_word_of_many_characters(model, library):
    rng = random.Random(8)
    held(model, library, ["".join(rng.choice("etaoinshrdlucm") for _ in range(30_000))])


def test_decoding_of_any_ids(model, library):
    rng = random.Random(9)
    for _ in range(400):
        ids = [rng.choice([rng.randrange(32000), rng.randrange(3, 259), rng.randrange(3)]) for _ in range(rng.randrange(12))]
        assert model.decode(ids) == library.decode(ids), ids


def test_kept_words_are_bounded_and_ids_do_not_depend_on_them(model):
    texts = [f"word{k} other{k * k}" for k in range(200)]
    small = pieces.Encoder(model, kept_chars=50)
    assert [small([t])[0] for t in texts] == pieces.Encoder(model)(texts)
    assert small.size < 100


def test_a_model_of_another_kind_is_refused(tmp_path):
    with open(PATH, "rb") as f:
        data = bytearray(f.read())
    at = data.rindex(b"identity")
    # remove_extra_whitespaces on
    data[data.index(b"\x20\x00", at) + 1] = 1
    path = tmp_path / "m.model"
    path.write_bytes(bytes(data))
    with pytest.raises(ValueError):
        pieces.PieceModel(str(path))


def test_query_equals_the_library(spark, documents, sf_dir, library):
    texts = {r.doc_id: r.text or "" for r in documents.select("doc_id", "text").collect()}
    got = pieces.op11_sentencepiece(spark, sf_dir).collect()
    assert len(got) == documents.count()
    for row in got:
        ids = library.encode(texts[row.doc_id], add_bos=True, add_eos=True)
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_nulls_repeats_and_empty_tables(make):
    df = make([(1, None), (1, None), (None, "a b"), (3, "")])
    rows = pieces.encoded(df).collect()
    assert sorted((r.doc_id is None, len(r.ids)) for r in rows) == [(False, 2), (False, 2), (False, 2), (True, 4)]
    assert all(r.ids[0] == 1 and r.ids[-1] == 2 for r in rows)
    assert pieces.digests(pieces.encoded(df.limit(0))).count() == 0
