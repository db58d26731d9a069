import random

import pytest
from fixtures_docs import ODD, documents
from test_simhash import brute_fp

from corvane.llm import blocks, simhash, similar


def sets_of(text, n=5):
    words = (text or "").lower().split()
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def brute(texts):
    """The first text of each component of pairs at two bits, or at a Jaccard similarity of 0.8 and more."""
    fps, sets, root = [brute_fp(t, 5) for t in texts], [sets_of(t) for t in texts], list(range(len(texts)))
    far = 0
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            alike = both and both * 9 >= 4 * (len(sets[i]) + len(sets[j]))
            bits = (fps[i] ^ fps[j]).bit_count()
            far += bool(alike and bits > 2)
            if (alike or bits <= 2) and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    return {i for i, r in enumerate(root) if i == r}, far


def edited(rng, n, copies):
    out = []
    for k in range(n):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.randint(20, 160))]
        for _ in range(copies):
            words = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3, 4])):
                words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
            out.append(" ".join(words[: len(words) - rng.choice([0, 0, 5, 12])]))
    return out


@pytest.mark.parametrize("group, rounds", [(256, 3), (2, 0)])
def test_every_pair_at_four_fifths_is_linked(spark, monkeypatch, group, rounds):
    monkeypatch.setattr(similar, "GROUP", group)
    monkeypatch.setattr(similar, "ROUNDS", rounds)
    monkeypatch.setattr(blocks, "total_bytes", lambda df: 1 << 27)
    texts = [t or "" for t in ODD] + edited(random.Random(5), 12, 8)
    want, far = brute(texts)
    assert far > 40
    got = {r.doc_id for r in simhash.keep_one(documents(spark, texts)).collect()}
    assert got == want
