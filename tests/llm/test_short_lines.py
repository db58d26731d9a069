import random
import re

from fixtures_docs import ODD, documents
from test_lines import corpus, distance

from corvane.llm import lines
from corvane.llm.common import id_text


def test_equal_lines_go_at_any_length(spark):
    long, other = "這是一行沒有空格的文字" * 20, "https://example.org/" + "a1b2c3" * 40
    texts = [f"Read more\n\n{long}\none two three four", f"Read  more\nRead less\n\n{long}\n{other}", f"{other}\none two three\none two three four\n \nRead more"]
    rows = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in lines.deduplicate_lines(id_text(documents(spark, texts))).collect()}
    assert rows == {0: (texts[0], 4, 0), 1: (f"Read less\n\n{other}", 5, 2), 2: ("one two three\n ", 5, 3)}


def test_short_lines_have_no_variants(spark):
    texts = ["a b c d", "a b c", "a b c e", "a b c d e", "x a b c d e"]
    out = {r.doc_id: r.n_removed for r in lines.deduplicate_lines(id_text(documents(spark, texts))).collect()}
    assert out == {0: 0, 1: 0, 2: 0, 3: 0, 4: 1}


def test_all_lines_equal_brute_force(spark):
    texts = [t or "" for t in ODD] + corpus(random.Random(3), 60)
    split = [[(line, tuple(re.findall(r"[^\x20\x09-\x0D]+", line))) for line in t.split("\n")] for t in texts]
    known, want = [], []
    for one in split:
        kept = []
        for line, words in one:
            near = lambda k: k == words or (min(len(k), len(words)) >= 5 and abs(len(k) - len(words)) <= 1 and distance(k, words) <= 1)
            if not words or not any(map(near, known)):
                kept.append(line)
            known += [words] if words and words not in known else []
        want.append("\n".join(kept))
    rows = lines.deduplicate_lines(id_text(documents(spark, texts))).collect()
    assert [r.text for r in sorted(rows, key=lambda r: r.doc_id)] == want
