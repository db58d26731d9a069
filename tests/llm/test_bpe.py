import hashlib
import random

import public_tokenizers
from fixtures_docs import ODD, documents, odd_documents
from tokenizers import Tokenizer

from corvane.llm import blocks, bpe
from corvane.llm.common import id_text

PATH = public_tokenizers.path("byte_bpe_50k.json")


def noise(n):
    rng = random.Random(1)
    return ["".join(rng.choice("ab 's'tm\n\t12é.,!ñ　Z're<|endoftext|>\U0001f600Ა") for _ in range(rng.randrange(80))) for _ in range(n)]


def test_query_equals_the_library(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(blocks, "total_bytes", lambda df: 1 << 27)
    texts = ODD[:-1] + noise(120) + ["x<|endoftext|>y", "<|endoftext|>"] + [ODD[-1]]
    df = documents(spark, texts)
    df.union(df.where("doc_id = 3")).write.parquet(f"{tmp_path}/documents.parquet")
    rows = bpe.op3_bpe(spark, str(tmp_path)).collect()
    assert len(rows) == len(texts) + 1
    library = Tokenizer.from_file(PATH)
    for r in rows:
        ids = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert (r.n_tokens, r.ids_sha256) == (len(ids), sha(",".join(map(str, ids))))
        assert r.decoded_sha256 == sha(library.decode(ids, skip_special_tokens=False))


def test_query_of_null_ids_texts_and_clashing_columns(spark, tmp_path):
    df = spark.createDataFrame([(None, None, 1, "x"), (None, "a b", 2, None), (4, "a b", None, "y")], "doc_id long, text string, ids int, n_tokens string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    rows = bpe.op3_bpe(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in rows) == [(0, 0), (0, 2), (4, 2)]
    assert len({r.ids_sha256 for r in rows}) == 2


def test_decoding_any_ids(spark):
    rng = random.Random(3)
    lists = [[rng.randrange(50257) for _ in range(rng.randrange(30))] for _ in range(60)] + [[50256, 0, 50256], []]
    df = spark.createDataFrame([*enumerate(lists), (99, None)], "doc_id long, ids array<int>")
    got = {r.doc_id: r.decoded for r in bpe.decode(df, PATH).collect()}
    library = Tokenizer.from_file(PATH)
    assert got.pop(99) is None
    assert got == {i: library.decode(x, skip_special_tokens=False) for i, x in enumerate(lists)}


def test_empty_table(spark):
    assert bpe.encode(id_text(documents(spark, [])), PATH).count() == 0
