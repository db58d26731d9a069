"""Aligned tokens against whole texts encoded at once, groups cut by sets of ends, links pair by pair."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import sentencepiece
from fixtures_docs import ODD, documents, odd_documents
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corvane.llm.alignment import SCORED, Aligner, align, linked, merged

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def plainly(texts):
    """Per text: n_a, n_b, n_groups, n_links, n_best, n_best_b, count_sum, digest."""
    tok = Tokenizer.from_file(A)
    tok.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=B)
    stand_ins = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in stand_ins} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in stand_ins)}
    every = []
    for text in texts:
        whole = (" " + (text or "")).encode()
        a, b = tok.encode(" " + (text or ""), add_special_tokens=False), sp.encode(text or "")
        bytes_a = [bytes(byte_of[c] for c in t) for t in a.tokens]
        bytes_b = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, sp.id_to_piece(i)) for i in b)]
        if not text or b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
            every.append(None)
            continue
        ends = [[sum(map(len, part[: k + 1])) for k in range(len(part))] for part in (bytes_a, bytes_b)]
        groups = defaultdict(lambda: ([], []))
        cuts = sorted(set(ends[0]) & set(ends[1]))
        for side, (ids, e) in enumerate(((a.ids, ends[0]), (b, ends[1]))):
            for i, end in zip(ids, e):
                groups[next(c for c in cuts if c >= end)][side].append(i)
        every.append((a.ids, b, [groups[c] for c in cuts]))
    links = [Counter((x, y) for xs, ys in d[2] for x in xs for y in ys) if d else Counter() for d in every]
    count = Counter(p for one in links for p in one)
    best = [Counter(), Counter()]
    for pair, n in count.items():
        for side in (0, 1):
            best[side][pair[side]] = max(best[side][pair[side]], n)
    out = []
    for d, one in zip(every, links):
        digest = hashlib.sha256(";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in d[2]).encode()).hexdigest() if d else ""
        n_best = [sum(n for p, n in one.items() if count[p] == best[side][p[side]]) for side in (0, 1)]
        a, b, groups = d or ((), (), ())
        out.append((len(a), len(b), len(groups), sum(one.values()), *n_best, sum(n * count[p] for p, n in one.items()), digest))
    return out


def got(docs, **more):
    return sorted(((r["doc_id"], tuple(r)[1:]) for r in align(docs, A, B, **more)[0].collect()), key=str)


HARD = [
    "<|endoftext|> <s>plain</s> <0x41> <unk>", "a ▁ b", "▁", " ", "  ", "\n", "\n\n x", " \n y\n", "x   y　 z  q", "it's 'twas\n's  don't",
    "\ttabs\t\tand \r\n lines\r\n", "漢字かな交じり文 と 한국어", "é ﬁ ① \x00 \x1c \x85 z", "🙂👩‍👩‍👧 family", "=" * 700 + " " * 90, "ab" * 400, "à la carte à  é",
]


def test_documents_equal_whole_texts_encoded_at_once(spark, sf="/root/testdata/sf0.001"):
    texts = HARD + [r["text"][:3000] for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").limit(60).collect()]
    chance = random.Random(4)
    signs = ["a", "B", "é", " ", "  ", "\n", "'", "s", "1", "漢", ".", "\t", " ", "▁", "<", "ing", "🙂", " ", "́", "\x00", "\r", " the"]
    texts += ["".join(chance.choices(signs, k=chance.randint(1, 30))) for _ in range(400)]
    want = sorted(((i, w) for i, w in enumerate(plainly(texts))), key=str)
    assert got(documents(spark, texts)) == want
    assert got(documents(spark, texts), block_bytes=500) == want  # many blocks


def test_odd_rows(spark):
    docs = odd_documents(spark)
    null_id = docs.where("text like '%nïc%'").withColumn("doc_id", F.lit(None).cast("long"))
    clashing = docs.union(null_id).withColumn("block", F.lit(1)).withColumn("a", F.lit("x")).withColumn("links", F.lit(b""))
    texts = [*ODD, ODD[-1], ODD[4]]
    ids = [*range(len(ODD)), len(ODD) - 1, None]
    assert got(clashing) == sorted(zip(ids, plainly(texts)), key=str)
    assert align(docs.limit(0), A, B)[0].collect() == []
    assert align(docs.limit(0), A, B)[0].columns == [c.split()[0] for c in SCORED.split(", ")]


def test_pairs_have_the_highest_counts_of_both_sides(spark):
    _, pairs = align(documents(spark, ["the cat", "the dog", "antidisestablishment"]), A, B)
    rows = pairs.collect()
    for side in "ab":
        for x in {r[side] for r in rows}:
            assert {r[f"best_{side}"] for r in rows if r[side] == x} == {max(r["count"] for r in rows if r[side] == x)}


def test_groups_of_many_tokens_link_by_distinct_ids():
    assert merged(np.array([1, 3, 4]), np.array([3, 4])).tolist() == [3, 4]
    pairs, n = linked(np.array([7] * 1000 + [8]), np.array([9] * 2000))
    assert dict(zip(pairs.tolist(), n.tolist())) == {7 * (1 << 15) + 9: 2_000_000, 8 * (1 << 15) + 9: 2000}


def test_large_groups_equal_small_ones(spark, monkeypatch):
    texts = [t for t in HARD if t] * 2
    want = got(documents(spark, texts))
    aligner = Aligner(A, B)
    one = aligner.align(texts)
    monkeypatch.setattr("corvane.llm.alignment.LARGE", 0)
    other = Aligner(A, B).align(texts)
    assert all(np.array_equal(x, y) for x, y in zip(one, other)) and [w[1][0] for w in want] and len(want) == len(texts)
