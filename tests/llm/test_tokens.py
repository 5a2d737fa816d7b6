import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from factweave.llm import bpe, planes, queries

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
ODD = ["", " ", "a", "a\n\n b  c\t\td 's'S don't   x \x85 y 　z", "x\r\ny \x1c\x1d", "12 34५६ ½ Ⅷ", "😀😀 👩‍👩‍👧 \U0001f1e6", "é" * 700, "a" * 4000, "zq" * 3000 + " end", "퟿ ", "×÷À ɏɐ'll", "<|endoftext|> x"]
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tik():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def codec():
    tokens = bpe.read_ranks(RANKS)
    return bpe.Codec(tokens, public_tokenizers.PATTERN, bpe.PerfectHash(tokens))


def test_perfect_hash_is_minimal(codec):
    assert sorted(codec.table.slots) == list(range(len(codec.tokens)))
    assert all(codec.table.index(t) == i for i, t in enumerate(codec.tokens))


def test_encodes_as_tiktoken(codec, tik):
    rng = random.Random(2)
    letters = "abcdeéß'st \n\t09½.,_-×ж中 "
    texts = ODD + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    for t in texts:
        ids = codec.encode(t).tolist()
        assert ids == tik.encode_ordinary(t)
        assert codec.decode(ids) == t.encode()


def test_cache_is_bounded(codec, tik, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 5)
    text = "the quick brown foxes jumped overly lazily"
    assert codec.encode(text).tolist() == tik.encode_ordinary(text) and len(codec) <= 5


def test_query_equals_tiktoken(spark, tik):
    got = {r.doc_id: r for r in queries.QUERIES["op6_bpe"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = tik.encode_ordinary(d.text)
        r = got[d.doc_id]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(d.text.encode()).hexdigest())


def test_encode_and_decode_keep_other_columns(spark, tik):
    docs = spark.createDataFrame([(1, "a b", "x"), (None, None, None), (1, "a b", "x")], "doc_id long, text string, ids string")
    enc = bpe.encode(docs, RANKS, public_tokenizers.PATTERN)
    assert enc.columns == ["doc_id", "ids"]
    rows = bpe.decode(enc, RANKS, public_tokenizers.PATTERN).collect()
    assert sorted((r.doc_id or 0, r.ids, bytes(r.decoded)) for r in rows) == [(0, [], b"")] + [(1, tik.encode_ordinary("a b"), b"a b")] * 2
    assert bpe.round_trip(docs.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


@pytest.mark.parametrize("bits", [True, False])
@pytest.mark.parametrize("n", [0, 1, 7, 8, 1000])
def test_planes_round_trip(n, bits):
    ids = np.random.default_rng(n).integers(0, 1 << 16, n).astype(np.uint32)
    made = planes.to_planes(ids, 16 if bits else 2, bits)
    assert (planes.from_planes(made, n, bits) == ids).all()


@pytest.mark.parametrize("bits", [True, False])
def test_file_holds_documents_and_reads_single_blocks(tmp_path, bits):
    rng = np.random.default_rng(1)
    docs = [(i * 3 - 5, rng.integers(0, 50257, n).astype(np.uint32)) for i, n in enumerate([0, 5, 64, 1, 300, 0, 63])]
    with open(tmp_path / "f", "wb") as out:
        w = planes.Writer(out, 16 if bits else 2, bits, block=64)
        for i, ids in docs:
            w.add(i, ids)
        w.close()
    with open(tmp_path / "f", "rb") as src:
        r = planes.Reader(src)
        got = [(i, ids.tolist()) for i, ids in r.documents()]
        every = np.concatenate([x for _, x in docs])
        assert (r.read_block(2) == every[128:192]).all()
    assert got == [(i, x.tolist()) for i, x in docs]


def test_ids_that_do_not_fit_are_refused(tmp_path):
    with open(tmp_path / "f", "wb") as out:
        w = planes.Writer(out, 8)
        w.add(1, np.array([256], np.uint32))
        with pytest.raises(ValueError, match="fit"):
            w.close()


def test_plane_encoder_equals_the_library(monkeypatch):
    monkeypatch.setattr(planes, "CACHE", 20)
    definition = open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read()
    lib = Tokenizer.from_str(definition)
    lib.encode_special_tokens = True
    e = planes.Encoder(definition, public_tokenizers.PATTERN)
    for t in ODD * 2:
        assert e.encode([t])[0].tolist() == lib.encode(t, add_special_tokens=False).ids


def test_plane_query_equals_the_library(spark):
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    lib.encode_special_tokens = True
    got = {r.doc_id: tuple(r) for r in queries.QUERIES["op8_bit_planes"](spark, SF).collect()}
    at = 0
    for d in sorted(spark.read.parquet(f"{SF}/documents.parquet").collect(), key=lambda d: d.doc_id):
        ids = [*lib.encode(d.text, add_special_tokens=False).ids, 0]
        assert got[d.doc_id] == (d.doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_special_tokens_in_texts_equal_the_library_as_loaded(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    definition, lib, end = open(path, encoding="utf-8").read(), Tokenizer.from_file(path), "<|endoftext|>"
    texts = [*ODD, f"a {end} b", end, end * 3, f"  {end}  {end}\n\n x", f"<|{end}|>", "<|endoftext|", f"{end}\n{'zq' * 50}{end}"]
    want = [lib.encode(t, add_special_tokens=False).ids for t in texts]
    assert lib.token_to_id(end) in want[len(ODD)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(planes.round_trip(docs, definition, public_tokenizers.PATTERN).collect(), key=lambda r: r.doc_id)
    assert [(r.n_tokens, r.ids_crc32) for r in got] == [(len(x) + 1, zlib.crc32(np.array([*x, 0], "<u4").tobytes())) for x in want]


def test_planes_of_odd_tables(spark):
    definition = open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read()
    docs = spark.createDataFrame([(2, None, 1), (None, "z", 1), (1, "", 1), (1, "", 1)], "doc_id long, text string, start int")
    got = sorted(planes.round_trip(docs, definition, public_tokenizers.PATTERN).collect(), key=lambda r: r.start)
    assert [(r.doc_id, r.start, r.n_tokens) for r in got] == [(1, 0, 1), (1, 1, 1), (2, 2, 1), (None, 3, 2)]
    assert planes.round_trip(docs.limit(0), definition, public_tokenizers.PATTERN).count() == 0
