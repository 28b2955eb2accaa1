import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from gridlark.llm import packing, pretokens, token_counts


@pytest.fixture(scope="module")
def library(byte_bpe):
    return Tokenizer.from_file(byte_bpe)


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_chunks_give_the_pre_tokens(texts):
    for t in texts:
        if t and "<|" not in t:
            assert [w for c in pretokens.chunks(t) for w in pretokens.find(pretokens.raw(c))] == pretokens.find(t)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("aeinrstz' .,\n\t\xa0É漢0１👍<|endoftext|>"), max_size=60))
def test_same_tokens_as_the_library(byte_bpe, library, text):
    want = ids_of(library, text)
    assert token_counts.Counter(token_counts.merger(byte_bpe)).count([text]) == [len(want)]
    assert packing.encoder(byte_bpe).encode(text) == np.array(want, "<u4").tobytes()


def test_token_counts(spark, tricky, byte_bpe, library):
    out = token_counts.token_counts(tricky, byte_bpe, limit=100)
    assert out.columns == ["doc_id", "text", "score", "key", "n_bytes", "n_tokens", "over_limit"]
    rows = out.collect()
    assert len(rows) == tricky.count()
    for r in rows:
        n = len(ids_of(library, r.text))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((r.text or "").encode()), n, n > 100)
    assert token_counts.token_counts(tricky.where("false"), byte_bpe).count() == 0


def check_packed(rows, wanted, size):
    """Every id of each document in one piece, and no gap in a sequence."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for doc, ids in wanted.items():
        pieces = sorted(by_doc[doc], key=lambda r: r.start)
        assert [x for r in pieces for x in r.ids] == ids
        at = 0
        for r in pieces:
            assert (r.start, r.length, r.doc_tokens) == (at, len(r.ids), len(ids)) and r.length > 0
            assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
            at += r.length
    short = 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= size
        short += at < size
    return short


def test_packing(spark, tricky, byte_bpe, library):
    docs = tricky.where("doc_id is not null").dropDuplicates(["doc_id"]).coalesce(2)
    for size in (2, 16, 2048):
        rows = packing.pack(docs, byte_bpe, size=size).collect()
        wanted = {r.doc_id: [*ids_of(library, r.text), 1] for r in docs.collect()}
        assert check_packed(rows, wanted, size) <= 2
    assert packing.pack(tricky, byte_bpe).where("doc_id is null").count() == 1
    twice = packing.pack(tricky.where("doc_id = 2"), byte_bpe).collect()
    assert len(twice) == 2 and packing.pack(tricky.where("false"), byte_bpe).count() == 0


def test_sum_of_squares_rule():
    rng = np.random.default_rng(1)
    p = packing.Packer(10, most_open=1000)
    for n in rng.integers(1, 10, 300).tolist():
        level = p.level[1:10].copy()

        def after(fill, n=n, level=level):
            x = level.copy()
            if fill:
                x[fill - 1] -= 1
            if fill + n < 10:
                x[fill + n - 1] += 1
            return int((x.astype(int) ** 2).sum())

        best = min(after(f) for f in [0, *[f for f in range(1, 10) if level[f - 1] and f + n <= 10]])
        (placed,) = p.put(n)
        assert after(placed[2]) == best
    assert p.n_open == p.level.sum() == sum(map(len, p.windows))


def test_few_windows_stay_open():
    p = packing.Packer(100, most_open=3)
    sizes = np.random.default_rng(2).integers(51, 99, 200).tolist()
    out = [x for n in sizes for x in p.put(n)]
    assert p.n_open <= 3 and sum(n for n, _, _ in out) == sum(sizes)
    fill = {}
    for n, w, o in out:
        assert fill.get(w, 0) == o
        fill[w] = o + n
    assert max(fill.values()) <= 100 and sum(v < 100 for v in fill.values()) == p.n_open
