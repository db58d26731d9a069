import random
import zlib

import numpy as np
import public_tokenizers
from fixtures_docs import ODD, documents, odd_documents
from tokenizers import Tokenizer

from corvane.llm import packing, tokens
from corvane.llm.common import Scratch

WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
TRICKY = ["don't I'll x's 's ' s it's'd ''s  's", "a  b   c\n\nd \t e ", "Σίσυφος ΣΑΣ İstanbul é", "x<|endoftext|>y <|startoftext|>z", "34½ a1b2", "Ᲊnew", "\xa0x　y", "a'sb'llc 'LL", "ﬁ Å 한국어", "!'s !' s"]


def noise(n):
    rng = random.Random(1)
    return ["".join(rng.choice("ab 's'tm\n\t12é.,!ñ　Z'rellvedŠ") for _ in range(rng.randrange(60))) for _ in range(n)]


def test_word_ids_equal_the_library():
    texts = [t or "" for t in ODD] + TRICKY + noise(800)
    want = [e.ids for e in Tokenizer.from_file(WORDS).encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in tokens.Encoder(WORDS).ids(texts)] == want


def test_lower_case_that_undoes_normal_form():
    texts = [f"x{base}{chr(mark)} y" for base in "İIÅ" for mark in range(0x300, 0x370)] + ["İ" + "".join(map(chr, marks)) for marks in ((0x327, 0x301), (0x301, 0x327), (0x331, 0x345))]
    want = [e.ids for e in Tokenizer.from_file(WORDS).encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in tokens.Encoder(WORDS).ids(texts)] == want


def test_random_texts_equal_the_library():
    rng = random.Random(3)
    signs = [*"ab İıIŒſKÅΣσς'12.\n", *map(chr, range(0x300, 0x345)), "ǅ", "ẞ", "漢", "한", "ά", "ʼ", "\u1fb7"]
    library, encoder = Tokenizer.from_file(WORDS), tokens.Encoder(WORDS)
    for _ in range(20):
        texts = ["".join(rng.choices(signs, k=rng.randint(1, 12))) for _ in range(5000)]
        assert [x.tolist() for x in encoder.ids(texts)] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_spaced_words_equal_the_library():
    texts = [t for t in [t or "" for t in ODD] + TRICKY + noise(800) if not tokens.odd(t)]
    words, inverse, bounds = tokens.distinct_words(texts, spaced=True)
    ids = tokens.encode_words(BYTES, words)
    got = [[i for k in inverse[a:b] for i in ids[k]] for a, b in zip(bounds, bounds[1:])]
    assert got == [e.ids for e in Tokenizer.from_file(BYTES).encode_batch(texts, add_special_tokens=False)]


def least_bins(sizes, capacity):
    """Brute force over all partitions of a few pieces."""
    best = [len(sizes)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + sizes[i] <= capacity:
                bins[k] += sizes[i]
                go(i + 1, bins)
                bins[k] -= sizes[i]
        bins.append(sizes[i])
        go(i + 1, bins)
        bins.pop()

    go(0, [])
    return best[0]


def test_reduction_loses_nothing():
    rng = random.Random(7)
    reduced = 0
    for _ in range(120):
        capacity = rng.choice([10, 13, 20])
        sizes = sorted((rng.randint(1, capacity) for _ in range(rng.randint(1, 8))), reverse=True)
        counts = np.bincount(sizes, minlength=capacity + 1)
        fixed = packing.reduce_dominated(counts, capacity)
        rest = [s for s in range(capacity, 0, -1) for _ in range(counts[s])]
        bins = sum(times for times, _ in fixed)
        reduced += bins
        assert bins + least_bins(rest, capacity) == least_bins(sizes, capacity)
    assert reduced > 100


def lower_bound(counts, capacity):
    """Martello and Toth's second bound."""
    size, best = np.arange(capacity + 1), 0
    for k in range(capacity // 2 + 1):
        alone, large, small = size > capacity - k, (size > capacity / 2) & (size <= capacity - k), (size >= k) & (size <= capacity / 2)
        free = (counts * (capacity - size))[large].sum()
        best = max(best, counts[alone].sum() + counts[large].sum() + max(0, -(-((counts * size)[small].sum() - free) // capacity)))
    return best


def test_plan_places_each_rank_once():
    rng = np.random.default_rng(3)
    counts = np.zeros(51, np.int64)
    counts[1:] = rng.integers(0, 40, 50)
    runs, used = packing.plan(counts.copy(), 50), {}
    for size in range(1, 51):
        for rank in range(counts[size]):
            table = runs[size]
            first, base, each, at = table[np.searchsorted(table[:, 0], rank, "right") - 1]
            used.setdefault(base + (rank - first) // each, []).append((at + (rank - first) % each * size, size))
    assert lower_bound(counts, 50) <= len(used) <= 1.01 * lower_bound(counts, 50)
    for slots in used.values():
        end = 0
        for at, size in sorted(slots):
            assert at == end
            end += size
        assert end <= 50


def test_plan_does_not_grow_with_the_pieces():
    for n in (10**3, 10**9):
        counts = np.zeros(2049, np.int64)
        counts[[1040, 1000, 700, 300, 2048]] = n, n, n, 3 * n, n // 7
        runs = packing.plan(counts.copy())
        assert sum(map(len, runs.values())) < 40
        for size, table in runs.items():
            assert table[0, 0] == 0 and table[-1, 0] < counts[size]


def test_pieces_of_a_long_text_and_a_null_id(spark):
    texts = ["a b c " * 3000, None, "x"]
    df = documents(spark, texts).selectExpr("nullif(doc_id, 2L) as doc_id", "text")
    rows = sorted(packing.tokenised_pieces(df, WORDS, 50).collect(), key=lambda r: (str(r.doc_id), r.piece))
    found = {}
    for r in rows:
        assert r.start == 50 * r.piece and r.length == len(r.ids) // 4 <= 50
        found.setdefault(r.doc_id, []).append(np.frombuffer(r.ids, "<u4"))
    library = Tokenizer.from_file(WORDS)
    for i, t in ((0, texts[0]), (1, ""), (None, "x")):
        assert np.concatenate(found[i]).tolist() == library.encode(t, add_special_tokens=False).ids + [0]
    placed = packing.place(packing.tokenised_pieces(df, WORDS, 50).drop("ids"), 50)
    assert placed.count() == len(rows) and placed.where("doc_id is null").count() == 1
    clash = packing.tokenised_pieces(df, WORDS, 50).drop("ids").selectExpr("*", "'x' as sequence_id", "0 as _salt")
    want = sorted((r.doc_id or -1, r.piece, r.sequence_id, r.offset) for r in placed.collect())
    assert sorted((r.doc_id or -1, r.piece, r.sequence_id, r.offset) for r in packing.place(clash, 50).collect()) == want


def test_a_length_of_many_equal_pieces_is_numbered_in_parts(spark):
    """Repeated rows and null ids among them."""
    rows = [(None if i % 3 else 5, 0, 0, 7 if i % 4 else 20, i % 1000) for i in range(2000)]
    pieces = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, drawn int").repartition(3)
    pieces = Scratch(spark).table(pieces)
    for part_rows in (1 << 20, 40, None):
        used = {}
        for r in packing.place(pieces, 50, part_rows).collect():
            used.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert sum(map(len, used.values())) == 2000 and sorted(used) == list(range(len(used)))
        for slots in used.values():
            ends = np.cumsum([n for _, n in sorted(slots)])
            assert [at for at, _ in sorted(slots)] == [0, *ends[:-1]] and ends[-1] <= 50
        assert "drawn" not in packing.place(pieces, 50).columns


def test_query(spark, tmp_path):
    odd_documents(spark).write.parquet(f"{tmp_path}/documents.parquet")
    rows = packing.op9_packing(spark, str(tmp_path)).collect()
    library, used, by_doc = Tokenizer.from_file(WORDS), {}, {}
    for r in rows:
        ids = library.encode(ODD[r.doc_id] or "", add_special_tokens=False).ids + [0]
        part = np.array(ids[r.start : r.start + 2048], "<u4")
        assert (r.start, r.length, r.ids_crc32) == (2048 * r.piece, len(part), zlib.crc32(part.tobytes()))
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
        by_doc[r.doc_id] = by_doc.get(r.doc_id, 0) + r.length
    twice = 2 * (len(library.encode(ODD[-1], add_special_tokens=False).ids) + 1)
    assert by_doc[len(ODD) - 1] == twice and len(by_doc) == len(ODD)
    for slots in used.values():
        ends = np.cumsum([n for _, n in sorted(slots)])
        assert [at for at, _ in sorted(slots)] == [0, *ends[:-1]] and ends[-1] <= 2048
    counts = np.bincount([r.length for r in rows], minlength=2049)
    assert len(used) <= 1 + 1.02 * lower_bound(counts, 2048)


def test_empty_table(spark):
    pieces = packing.tokenised_pieces(documents(spark, []), WORDS)
    assert packing.place(pieces).count() == 0
