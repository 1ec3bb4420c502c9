import base64
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from matchlake.llm import bpe, packing
from matchlake.llm.registered import _ranks
from tests.llm.helpers import DOCS, awkward, clashing, empty, prose


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids(b):
    return np.frombuffer(b, "<u4").tolist()


def test_encode_matches_library_and_round_trips(spark, reference):
    docs = awkward(spark)
    got = bpe.decode(bpe.encode(clashing(docs, "ids", "row", "piece"), *_ranks(), chunk_chars=500, overlap_chars=64), *_ranks()).collect()
    want = sorted((r["text"] or "", reference.encode_ordinary(r["text"] or "")) for r in docs.collect())
    assert sorted((bytes(r["decoded"]).decode(), ids(r["ids"])) for r in got) == want
    assert all(r["n_tokens"] == len(ids(r["ids"])) for r in got)
    assert bpe.encode(empty(spark), *_ranks()).count() == 0


def test_chunks_resynchronise_at_every_cut(spark, reference):
    texts = [prose(5, 300) + "'ll we've" * 20, "a" * 700 + " b", " " * 400 + "end", "x\n \ny  z\t\n" * 60, "12,345.678 " * 50, "日本" * 300, "$$$ %%%" * 100 + " \n" * 100]
    docs = spark.createDataFrame([(i, t, None, None, 0) for i, t in enumerate(texts)], DOCS)
    for size, overlap in ((64, 40), (97, 50), (200, 100)):
        got = {r["doc_id"]: ids(r["ids"]) for r in bpe.encode(docs, *_ranks(), chunk_chars=size, overlap_chars=overlap).collect()}
        assert got == {i: reference.encode_ordinary(t) for i, t in enumerate(texts)}


def test_runs_that_exhaust_the_library(spark):
    c = bpe.codec(*_ranks())
    for text in (" " * 1_000_000 + "x", "a" * 60_000):
        assert c.decode(c.encode(text)).decode() == text


def test_same_ids_as_the_tokenizers_file(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(str(P.path("byte_bpe_50k.json")))
    t.encode_special_tokens = True
    c = bpe.codec(*_ranks())
    for r in awkward(spark).collect():
        text = (r["text"] or "")[:5000] + "<|endoftext|>"
        assert ids(c.encode(text)) == t.encode(text, add_special_tokens=False).ids


def test_pieces_are_powers_of_two_and_cover_each_document(spark, reference):
    docs = awkward(spark)
    rows = packing.pack(clashing(docs, "length", "start", "ids"), *_ranks(), max_tokens=64).collect()
    assert len({r["sequence_id"] for r in rows}) == len(rows) and {r["offset"] for r in rows} == {0}
    assert all(r["length"] in {1, 2, 4, 8, 16, 32, 64} and len(r["ids"]) == 4 * r["length"] for r in rows)
    whole = {}
    for r in sorted(rows, key=lambda r: r["sequence_id"]):
        key = (r["doc_id"], r["doc_tokens"])
        if r["start"] == 0:
            whole.setdefault(key, []).append([])
        assert r["start"] == len(whole[key][-1])
        whole[key][-1] += ids(r["ids"])
    want = sorted(reference.encode_ordinary(r["text"] or "") + [0] for r in docs.collect())
    assert sorted(x for v in whole.values() for x in v) == want
    assert zlib.crc32(bytes(rows[0]["ids"])) >= 0
    assert packing.pack(empty(spark), *_ranks()).count() == 0


def test_packed_ids_are_those_of_the_tokenizers_file(spark):
    from tokenizers import Tokenizer

    t, mark = Tokenizer.from_file(str(P.path("byte_bpe_50k.json"))), "<|endoftext|>"
    texts = [f"before {mark} after", mark, mark * 3, f"{mark} x", f"x{mark}", f"<|endoftext{mark}|>", f"a\n {mark}\t b  {mark[:-1]}", f"été{mark}日本", "none", f"<{mark}<|endoftext", f"w {mark} " * 400]
    rows = packing.pack(spark.createDataFrame([(i, x, None, None, 0) for i, x in enumerate(texts)], DOCS), *_ranks(), max_tokens=64).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["start"])):
        got.setdefault(r["doc_id"], []).extend(ids(r["ids"]))
    assert got == {i: t.encode(x, add_special_tokens=False).ids + [0] for i, x in enumerate(texts)}
    assert {r["doc_tokens"] for r in rows if r["doc_id"] == 0} == {5}


def test_added_tokens_with_options():
    from tokenizers import AddedToken, Tokenizer

    t = Tokenizer.from_file(str(P.path("byte_bpe_50k.json")))
    options = {"<l>": {"lstrip": True}, "<r>": {"rstrip": True}, "wo": {"single_word": True}, "<lr>": {"lstrip": True, "rstrip": True}}
    t.add_tokens([AddedToken(c, normalized=False, **o) for c, o in options.items()])
    tokens = [{"id": t.token_to_id(c), "content": c, **o} for c, o in options.items()]
    a = packing.AddedTokens(tokens, bpe.codec(*_ranks()))
    for text in ("a  <l> b", "a <r>  b", "wo wow two wo, wo", "x <lr> <lr>\n y", "<l><r><l>", " <r> <l> z", "x_wo éwo wo-"):
        assert ids(a.encode(text)) == t.encode(text, add_special_tokens=False).ids, text


def test_binary_lengths():
    assert packing.binary_lengths(2500, 1024) == [1024, 1024, 256, 128, 64, 4]
    assert packing.binary_lengths(1, 1) == [1]
    assert all(sum(packing.binary_lengths(n, 16)) == n for n in range(200))


def test_buckets_hold_one_length(spark, tmp_path):
    packing.write_buckets(packing.pack(awkward(spark), *_ranks()), str(tmp_path / "b"))
    back = spark.read.parquet(str(tmp_path / "b"))
    assert back.where("length * 4 <> length(ids)").count() == 0 and back.count() > 0
