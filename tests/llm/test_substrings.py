import hashlib
import random

import numpy as np
import pytest
from fixtures_docs import ODD, documents, odd_documents

from corvane.llm import blocks, substrings
from corvane.llm.common import id_text
from corvane.llm.suffix import shared_groups, suffix_array


def brute(docs, least):
    """docs: (id, bytes). The removed flag of each byte of each row."""
    order = lambda i: docs[i][0] if docs[i][0] is not None else 1 << 70
    first = {}
    for i, (_, raw) in enumerate(docs):
        for s in range(len(raw) - least + 1):
            key = (order(i), s)
            w = raw[s : s + least]
            first[w] = min(first.get(w, key), key)
    out = []
    for i, (_, raw) in enumerate(docs):
        gone = np.zeros(len(raw), bool)
        for s in range(len(raw) - least + 1):
            if first[raw[s : s + least]] < (order(i), s):
                gone[s : s + least] = True
        out.append(gone)
    return out


def corpus(rng, n):
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(1, 9)))
    passages = [" ".join(word() for _ in range(rng.randint(20, 60))) for _ in range(6)]
    texts = []
    for _ in range(n):
        parts = [" ".join(word() for _ in range(rng.randint(0, 60))) for _ in range(rng.randint(1, 3))]
        for _ in range(rng.randint(0, 2)):
            parts.insert(rng.randint(0, len(parts)), rng.choice(passages))
        texts.append(" ".join(parts))
    texts += [texts[3], texts[5] + "x", "ab" * 400, "q" * 500, "zz" + "ab" * 300, passages[0][7:110]]
    return texts


def check(rows, docs, least):
    want = sorted((d[0] if d[0] is not None else -1, len(d[1]), int(g.sum()), int((np.diff(g.astype(np.int8), prepend=0) == 1).sum()), hashlib.sha256(bytes(np.frombuffer(d[1], np.uint8)[~g])).hexdigest()) for d, g in zip(docs, brute(docs, least)))
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows)
    assert got == want


@pytest.mark.parametrize("hot", [4096, 2])
def test_query_equals_brute_force(spark, tmp_path, monkeypatch, hot):
    monkeypatch.setattr(substrings, "HOT", hot)
    texts = ODD + corpus(random.Random(hot), 60)
    df = documents(spark, texts)
    extra = spark.createDataFrame([(None, texts[12] + "tail" * 40, None, None, None, None), (12, texts[12], None, None, None, None), (13, texts[14], None, None, None, None)], df.schema)
    df = df.union(extra)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    docs = [(r.doc_id, (r.text or "").encode()) for r in df.collect()]
    check(substrings.op8_substrings(spark, str(tmp_path)).collect(), docs, 100)


def test_many_blocks(spark, monkeypatch):
    texts = corpus(random.Random(9), 40)
    monkeypatch.setattr(blocks, "total_bytes", lambda df: 1 << 28)
    out = substrings.repeated_spans(id_text(documents(spark, texts))).collect()
    gone = brute([(i, t.encode()) for i, t in enumerate(texts)], 100)
    assert {r.doc_id: sum(s.length for s in r.spans) for r in out} == {i: int(g.sum()) for i, g in enumerate(gone)}


def test_empty_table(spark):
    assert substrings.repeated_spans(id_text(documents(spark, []))).count() == 0


def test_suffix_order_and_groups():
    rng = random.Random(2)
    for _ in range(100):
        parts = [[rng.choice([2, 3, 4][: rng.choice([1, 2, 3])]) for _ in range(rng.randrange(1, 25))] for _ in range(rng.randrange(1, 6))]
        line = [x for p in parts for x in [*p, 1]] + [0]
        symbols = np.array(line, np.uint16)
        assert suffix_array(symbols).tolist() == sorted(range(len(line)), key=lambda i: line[i:])
        for least in (1, 3, 8):
            order, group = shared_groups(symbols, least)
            group = dict(zip(order.tolist(), group.tolist()))
            whole = [i for i in group if i + least <= len(line) and min(line[i : i + least]) >= 2]
            assert all((line[a : a + least] == line[b : b + least]) == (group[a] == group[b]) for a in whole for b in whole)
