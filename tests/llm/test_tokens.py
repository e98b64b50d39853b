import random

import tiktoken
from base64 import b64decode
from pathlib import Path

from weftline.llm import tokens as T


def reference():
    lines = Path(f"{T.TOKENIZERS}/byte_bpe_50k.tiktoken").read_bytes().splitlines()
    return tiktoken.Encoding("own", pat_str=T.PATTERN, mergeable_ranks={b64decode(a): int(b) for a, b in map(bytes.split, lines)}, special_tokens={})


def test_ids_equal_merging(spark):
    want, pick = reference(), random.Random(2)
    signs = "ab \n\t\r'sé​\xa0\x1c\x85漢字😀<|endoftext|>  1２ll"
    texts = ["".join(pick.choice(signs) for _ in range(pick.randrange(40))) for _ in range(3000)] + ["x" * 30_000, "ab " * 400_000, "<|endoftext|>", " ", "\n\n \n"]
    own = T.encoder(f"{T.TOKENIZERS}/byte_bpe_50k.json")
    for text, ids in zip(texts, own.encode(texts).to_pylist(), strict=True):
        assert ids == want.encode_ordinary(text), repr(text[:60])
    assert own.sizes_of(texts).tolist() == [len(want.encode_ordinary(t)) for t in texts]


def test_null_empty_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "ab", "x"), (3, "ab", "x")], "doc_id long, text string, ids string")
    got = sorted((r["doc_id"], r["ids"]) for r in T.encode(df, ["doc_id"], "text").collect())
    assert got[:2] == [(1, []), (2, [])] and got[2] == got[3] and got[2][1]
    assert T.encode(df.limit(0), ["doc_id"], "text").count() == 0


def test_documents(spark, data):
    want = reference()
    docs = spark.read.parquet(f"{data}/documents.parquet")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.select("doc_id", "text").collect()}
    got = {r["doc_id"]: r["ids"] for r in T.encode(docs, ["doc_id"], "text").collect()}
    assert got == {k: want.encode_ordinary(v) for k, v in texts.items()}
