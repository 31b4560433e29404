from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.helpers import EDGE, edge, empty, prose
from tracemill.llm import tokenbin, tokencount, wordbpe
from tracemill.llm.queries import tokenizer

PIECES, BYTES, WORDS = tokenizer("piece_bpe_32k.model"), tokenizer("byte_bpe_50k.json"), tokenizer("word_bpe_49k.json")
TEXTS = st.text(st.sampled_from("ab thE.,'\n\t \u00a0é1▁<|/s>日"), max_size=60)


@pytest.fixture(scope="module")
def library():
    import sentencepiece
    from tokenizers import Tokenizer

    return sentencepiece.SentencePieceProcessor(model_file=PIECES), Tokenizer.from_file(BYTES), Tokenizer.from_file(WORDS)


def whole(r):
    return r[1] or ""


def test_counts_equal_the_library(library):
    texts = [whole(r) for r in EDGE] + prose(200) + [" " * 40 + "x", "a" * 200 + " b", "▁▁a"]
    assert tokencount.compiled(PIECES).counts(texts).tolist() == [len(x) for x in library[0].encode(texts)]


@settings(max_examples=150, deadline=None)
@given(st.lists(TEXTS, min_size=1, max_size=5))
def test_counts_of_odd_texts(texts):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    assert tokencount.compiled(PIECES).counts(texts).tolist() == [len(x) for x in sp.encode(texts)]


def test_chunks_and_restarts_change_nothing(library):
    own = tokencount.Transducer(tokencount.compiled(PIECES).scores, max_states=50)
    texts = prose(40, 5)
    for k in range(4):
        assert own.counts(texts[k::4]).tolist() == [len(x) for x in library[0].encode(texts[k::4])]


def test_count_rows(spark, library):
    got = tokencount.token_counts(edge(spark), PIECES, limit=100).collect()
    assert sorted((r["doc_id"] or 0, r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in got) == sorted((d or 0, len((t or "").encode()), n := len(library[0].encode(t or "")), n > 100) for d, t, *_ in EDGE)
    assert tokencount.token_counts(empty(spark), PIECES).count() == 0


@pytest.mark.parametrize("width", [1, 7, 16, 17, 31])
def test_packing_round_trip(width):
    ids = np.random.default_rng(width).integers(0, 1 << width, 1000, np.uint32)
    assert (tokenbin.unpack(tokenbin.pack(ids, width), 1000, width) == ids).all()


def test_shard_random_access(tmp_path):
    rng = np.random.default_rng(2)
    docs = [(None if k == 0 else k, rng.integers(0, 50257, n, np.uint32)) for k, n in enumerate([3, 0, 40000, 1, 20000])]
    writer = tokenbin.Writer(str(tmp_path / "a.bits"), 16)
    for d, ids in docs:
        writer.add(d, ids)
    writer.close()
    reader, every = tokenbin.Reader(str(tmp_path / "a.bits")), np.concatenate([d[1] for d in docs])
    assert [(d, ids.tolist()) for d, _, ids in reader.documents()] == [(d, ids.tolist()) for d, ids in docs]
    for a, b in ((0, 5), (16000, 17000), (59999, 60004), (7, 7)):
        assert (reader.ids(a, b) == every[a:b]).all()


@pytest.mark.parametrize("rows_per_shard", [3, 1000])
def test_ids_read_back(spark, library, rows_per_shard):
    docs = edge(spark).unionByName(spark.createDataFrame([(100 + i, t, "en", "a", 1) for i, t in enumerate(prose(30))], "doc_id long, text string, lang string, source string, n_chars long"), allowMissingColumns=True)
    got = sorted(tokenbin.read(tokenbin.write(docs, BYTES, rows_per_shard=rows_per_shard)).collect(), key=lambda r: r["start"])
    encoded = [(d, library[1].encode(t or "", add_special_tokens=False).ids + [2]) for d, t in docs.select("doc_id", "text").collect()]
    encoded.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    start = 0
    for r, (d, ids) in zip(got, encoded, strict=True):
        assert tuple(r) == (d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert tokenbin.read(tokenbin.write(empty(spark), BYTES)).count() == 0


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_word_table_equals_the_library(text):
    table = wordbpe.word_table(WORDS)
    ids = table.tokenizer.encode(text, add_special_tokens=False).ids
    assert [i for w in text.encode().split() for i in table.word(w)] == ids
    assert " ".join(table.pieces[i] for i in ids) == table.tokenizer.decode(ids, skip_special_tokens=False)
    own = tokenbin.encoder(BYTES)
    assert np.frombuffer(own.text(text), "<u2").tolist() == own.tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("block_words", [300_000, 20])
def test_encode_decode_rows(spark, library, block_words):
    got = wordbpe.encode_decode(edge(spark), WORDS, digests=True, block_words=block_words).collect()
    want = []
    for d, t, *_ in EDGE:
        ids = library[2].encode(t or "", add_special_tokens=False).ids
        want.append((d or 0, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library[2].decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted((r[0] or 0, *r[1:]) for r in got) == sorted(want)
    plain = wordbpe.encode_decode(edge(spark), WORDS)
    texts = [(d or 0, library[2].encode(t or "", add_special_tokens=False).ids) for d, t, *_ in EDGE]
    assert sorted((r["doc_id"] or 0, r["n_tokens"], r["ids"], r["decoded"]) for r in plain.collect()) == sorted((d, len(i), " ".join(map(str, i)), library[2].decode(i, skip_special_tokens=False)) for d, i in texts)
    assert wordbpe.encode_decode(empty(spark), WORDS).count() == 0


def test_one_long_text_of_pieces(library):
    """States beyond every bound inside a single text: compilation starts anew and the count is the library's."""
    sp, rng = library[0], np.random.default_rng(3)
    pieces = [p for p in (sp.id_to_piece(i) for i in range(1000, 32000)) if p.isascii()]
    text = "".join(rng.choice(pieces, 40_000))
    own = tokencount.Transducer(tokencount.compiled(PIECES).scores, max_states=3000, slot_bits=14)
    assert own.counts([text, text[:999], "x"]).tolist() == [len(sp.encode(t)) for t in (text, text[:999], "x")]
    assert len(own.states) < 3000 + 3 * 8192


def test_texts_that_fit_no_pair_are_counted_by_the_model():
    own = tokencount.Transducer({"▁": -1.0, "a": -2.0}, plain=lambda t: 99)
    own.fit = lambda left, right: False
    assert own.counts(["a", "", "aa"]).tolist() == [99, 0, 99]


def test_words_are_encoded_once(spark):
    """However many blocks and documents have a word, one bucket holds it, and each of a bucket's words once."""
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(prose(80) * 3)], "doc_id long, text string").repartition(6)
    rows = wordbpe.split(docs.selectExpr("doc_id", "text as __text"), 8, 30).filter("bucket is not null").collect()
    held = {}
    for r in rows:
        for w in wordbpe.zstandard.ZstdDecompressor().decompress(r["words"]).split(b" "):
            held.setdefault(w, set()).add(r["bucket"])
    assert len({r["block"] for r in rows}) > 6 and all(len(b) == 1 for b in held.values())
    assert set(held) == {w for t in prose(80) for w in t.encode().split()}


def test_planes_and_packing():
    numbers = np.array([0, 1, 255, 256, 70_000, 2**31], np.uint32)
    assert (wordbpe.from_planes(wordbpe.in_planes(numbers)) == numbers).all() and len(wordbpe.from_planes(b"")) == 0
    assert [a.tolist() for a in wordbpe.unpacked(wordbpe.packed(numbers, numbers[:0], numbers[:2]))] == [numbers.tolist(), [], [0, 1]]
