"""BPE by distinct words, and the Arrow token files, against the tokenizers library over whole texts."""

from __future__ import annotations

import glob
import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from vellum.llm import bpe, tokenfile
from tests.llm.helpers import empty, odd

PATH = public_tokenizers.path("word_bpe_49k.json")
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
HARD = ["<|endoftext|> and<|startoftext|>x", "it's WE'LL İstanbul ǅ ﬁne", "e\u0301 é ½ ² ٣ 漢字 👩‍👩‍👧 \u2028x\u00a0y", "\x00\x01 \u200b \u0085 a\u3000b", "…—“q” a.b,c!?.. 3rd v1.2", "ß ÿ Ÿ µ ª º ñ\u0303"]


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(PATH)
    t.no_padding()
    t.no_truncation()
    return t


def all_docs(spark, sf):
    cols = "doc_id bigint, text string"
    hard = spark.createDataFrame([(-i, t) for i, t in enumerate(HARD, 1)], cols)
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionByName(hard).unionByName(odd(spark).select("doc_id", "text"))


def test_round_trip(spark, sf, tokenizer):
    docs = all_docs(spark, sf)
    wanted = []
    for r in docs.collect():
        ids = tokenizer.encode(r.text or "", add_special_tokens=False).ids
        wanted.append((r.doc_id, len(ids), sha(" ".join(map(str, ids))), sha(tokenizer.decode(ids, skip_special_tokens=False))))
    key = lambda x: (x[0] is None, x[0] or 0, *x[1:])
    for size in (bpe.BLOCK_BYTES, 40_000):
        got = [tuple(r) for r in bpe.round_trip(docs, PATH, block_bytes=size).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()]
        assert sorted(got, key=key) == sorted(wanted, key=key)


def test_encode_and_decode(spark, sf, tokenizer):
    docs = all_docs(spark, sf).where("doc_id is not null").dropDuplicates(["doc_id"])
    ids = bpe.encode(docs, PATH)
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in ids.collect():
        assert r.ids == tokenizer.encode(text[r.doc_id] or "", add_special_tokens=False).ids
    for r in bpe.decode(ids, PATH).join(ids, "doc_id").collect():
        assert r.text == tokenizer.decode(r.ids, skip_special_tokens=False)


def test_token_files(spark, sf, tokenizer, tmp_path):
    docs = all_docs(spark, sf).where("doc_id is not null").dropDuplicates(["doc_id"])
    start, wanted = 0, []
    for r in docs.orderBy("doc_id").collect():
        ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2]
        wanted.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = tokenfile.written_and_read(docs, PATH, shard_bytes=60_000, sequence=64, batch=8).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == wanted
    tokenfile.write_shards(docs, f"file://{tmp_path}/t", PATH, 2, shard_bytes=60_000, sequence=64, batch=8)
    files = sorted(glob.glob(f"{tmp_path}/t/*.tokens"))
    assert len(files) > 1
    whole = []
    for name in files:
        f, k = tokenfile.SequenceFile(name), 0
        while True:
            try:
                tokens, mask = f[k]
            except IndexError:
                break
            assert len(tokens) == len(mask) == 64
            whole += np.asarray(tokens)[np.asarray(mask)].tolist()
            k += 1
        assert np.array_equal(np.asarray(f[k - 1][0]), np.asarray(tokenfile.SequenceFile(name)[k - 1][0]))
    assert len(whole) == start


def test_a_row_repeated_many_times_is_one_row_of_a_block(spark, tokenizer):
    text = " ".join(f"word{i} and" for i in range(300))
    docs = spark.range(100_000).selectExpr("cast(7 as bigint) as doc_id", f"'{text}' as text").unionByName(spark.createDataFrame([(8, "x")], "doc_id bigint, text string"))
    blocked, blocks = bpe._blocks(docs, "doc_id", "text", bpe.BLOCK_BYTES)
    assert blocked.where("id = 7").count() <= 200 and blocks > 8
    found = bpe.round_trip(docs, PATH).groupBy("doc_id", "n_tokens", "ids_sha256").count().collect()
    ids = tokenizer.encode(text, add_special_tokens=False).ids
    assert {(r.doc_id, r["count"]) for r in found} == {(7, 100_000), (8, 1)}
    assert next(r for r in found if r.doc_id == 7).ids_sha256 == sha(" ".join(map(str, ids)))


def test_empty(spark):
    assert bpe.round_trip(empty(spark), PATH).count() == 0
    assert tokenfile.written_and_read(empty(spark), PATH).count() == 0
