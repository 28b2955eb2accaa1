import zlib

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from gridlark.llm import sentencepiece_wfst as wfst


@pytest.fixture(scope="module")
def library(pieces):
    return sentencepiece.SentencePieceProcessor(model_file=pieces)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("thesrandioumng  ▁é\n\t.0漢👍<s>"), max_size=50))
def test_same_ids_and_text_as_the_library(pieces, library, text):
    t = wfst.transducer(pieces)
    ids = t.encode(text).tolist()
    assert ids == library.encode(text)
    assert t.decode(ids) == library.decode(ids)


def test_bytes_that_are_no_utf8(pieces, library):
    t = wfst.transducer(pieces)
    ids = [library.piece_to_id(f"<0x{b:02X}>") for b in (0xE6, 0xBC, 0x41)] + library.encode(" x")
    assert t.decode(ids).endswith("A  x") and "�" in t.decode(ids)
    with pytest.raises(IndexError):
        t.decode([32_000])


def test_unigram_shortest_path(pieces):
    t = wfst.Transducer(pieces)
    t.kind, t.cost = wfst.UNIGRAM, {"▁": (1.0, 1), "a": (2.0, 2), "b": (2.0, 3), "ab": (3.5, 4), "▁a": (2.5, 5)}
    t.starts = {"▁", "a"}
    assert t.shortest("▁ab") in (["▁", "ab"], ["▁a", "b"]) and t.shortest("ab") == ["ab"]
    assert t.shortest("▁az") == ["▁a", "z"]


def test_columns(spark, tricky, pieces, library):
    out = wfst.encode(tricky, pieces, out="key")
    assert out.columns == ["doc_id", "text", "n_tokens", "score", "key"]
    for r in out.collect():
        assert r.key == (None if r.text is None else library.encode(r.text))
    back = wfst.decode(wfst.encode(tricky.select("doc_id", "text"), pieces).withColumnRenamed("text", "was"), pieces)
    assert back.where(~F.col("text").eqNullSafe(F.col("was"))).count() == 0
    assert wfst.encode(tricky.where("false"), pieces).count() == 0


def test_round_trip(spark, tricky, pieces, library):
    rows = wfst.round_trip(tricky, pieces).collect()
    texts = {r.doc_id: r.text or "" for r in tricky.collect()}
    assert len(rows) == tricky.count()
    for r in rows:
        ids = library.encode(texts[r.doc_id])
        assert (r.n_ids, r.ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        assert r.same and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode())
