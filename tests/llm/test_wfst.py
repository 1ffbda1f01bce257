import numpy as np
import pytest
import sentencepiece

from tonelake.llm import wfst

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
ODD = ["", " ", "  ", "a", " a", "a ", "  a   b ", "tab\tnew\nline\r\n", "ﬁ Ⅷ é é 😀", "x" * 500, "▁ a▁b", "<0x0A> <s> </s> <unk>", "éeaux###  %%%%&&& ünïcödé", "a b", "日本語テキスト", "\x00\x01", "1234567890 3.14", "....,,,;;;", " " * 17 + "z" + " " * 40]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_same_ids_as_merging(library):
    t = wfst.Transducer(wfst._model(MODEL))
    for text in ODD:
        assert t.encode(text).tolist() == library.encode(text), text
        if "▁" not in text:
            assert t.decode(t.encode(text).tolist()) == text


def test_random_texts(library):
    t = wfst.Transducer(wfst._model(MODEL))
    rng = np.random.default_rng(1)
    letters = list("etaoinshrdlu  .,'éßñ\n") + ["th", "ing", "  ", "tion", "▁"]
    for _ in range(1500):
        text = "".join(rng.choice(letters, rng.integers(1, 40)))
        assert t.encode(text).tolist() == library.encode(text), text
    pieces = [library.id_to_piece(i).replace("▁", " ") for i in range(259, 32000)]
    for _ in range(1500):
        text = "".join(rng.choice(pieces, 4))
        assert t.encode(text).tolist() == library.encode(text), text


def test_table(spark, sf_dir, library):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = wfst.round_trip(docs, MODEL).collect()
    assert len(got) == len(texts)
    for r in got:
        assert r.lossless and r.ids == library.encode(texts[r.doc_id]) and r.n_tokens == len(r.ids)


def test_edge_rows_and_columns(spark, library):
    rows = [(1, None), (1, None), (None, "some text"), (2, "word " * 60_000)] + list(enumerate(ODD, 10))
    docs = spark.createDataFrame([(d, t, [1], True) for d, t in rows], "doc_id long, text string, ids array<int>, lossless boolean")
    got = wfst.round_trip(docs, MODEL).collect()
    assert sorted((str(r.doc_id), r.ids) for r in got) == sorted((str(d), library.encode(t or "")) for d, t in rows)
    assert wfst.round_trip(docs.limit(0), MODEL).count() == 0
    back = wfst.decode(wfst.encode(docs, MODEL), MODEL, out="again").where("text not like '%▁%' or text is null").collect()
    assert all(r.again == (r.text or "") for r in back)


def test_forgotten_words_are_encoded_the_same_again():
    transducer = wfst.Transducer(wfst._model(MODEL))
    texts = ["a transducer forgets", "what it  has seen ", "日本 and 日本", ""]
    first = [transducer.encode(t).tolist() for t in texts]
    assert transducer.young
    transducer.forget()
    assert not transducer.young and not transducer.old and not transducer.follows
    assert [transducer.encode(t).tolist() for t in texts] == first
