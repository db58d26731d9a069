import hashlib
import random
import re

from fixtures_docs import ODD, documents, odd_documents
from pyspark.sql import functions as F

from corvane.llm import lines
from corvane.llm.common import id_text


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute(docs):
    """docs: (id, text). Texts without each line that equals an earlier one, or, of five words, lies within one edit of it."""
    order = lambda i: i if i is not None else 1 << 70
    known = {}
    for i, text in docs:
        for no, line in enumerate((text or "").split("\n")):
            words = tuple(re.findall(r"[^\x20\x09-\x0D]+", line))
            if words:
                known[words] = min(known.get(words, (1 << 80, 0)), (order(i), no))
    out = []
    for i, text in docs:
        kept = []
        for no, line in enumerate((text or "").split("\n")):
            words = tuple(re.findall(r"[^\x20\x09-\x0D]+", line))
            alike = lambda k: k == words or (min(len(k), len(words)) >= 5 and abs(len(k) - len(words)) <= 1 and distance(k, words) <= 1)
            if not words or not any(known[k] < (order(i), no) and alike(k) for k in known):
                kept.append(line)
        out.append("\n".join(kept))
    return out


def corpus(rng, n):
    pool = [" ".join(rng.choice("abcdef") * rng.randint(1, 2) for _ in range(rng.randint(3, 14))) for _ in range(n)]
    texts = []
    for _ in range(n):
        out = []
        for _ in range(rng.randint(1, 5)):
            words = rng.choice(pool).split()
            if rng.random() < 0.6:
                at, kind = rng.randrange(len(words)), rng.choice("ird")
                words[at : at + (kind != "i")] = [] if kind == "d" else [rng.choice("xyz")]
            out.append(rng.choice([" ", "  ", "\t"]).join(words))
        texts.append("\n".join(out))
    return texts


def test_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(3)
    texts = ODD + corpus(rng, 60) + ["only w1 w2 w3 w4 w5 w6 w7", "only w1 w2 w3 w4 w5 w6 w7 w8\nonly w1 w2 w3 w4 q w6 w7", " ".join(f"u{i}" for i in range(200)), " ".join(f"u{i}" for i in range(200) if i != 130)]
    df = documents(spark, texts)
    df = df.union(df.where("doc_id in (3, 12)")).union(spark.createDataFrame([(None, texts[14] + "\nnew words stand in here", None, None, None, None), (13, texts[15], None, None, None, None), (30, texts[30] + "\nnew words stand in here", None, None, None, None)], df.schema))
    df = df.withColumn("doc_id", F.col("doc_id") - 20)  # ids below zero too
    df.write.parquet(f"{tmp_path}/documents.parquet")
    docs = [(r.doc_id, r.text) for r in df.collect()]
    want = sorted((str(i), hashlib.sha256(t.encode()).hexdigest()) for (i, _), t in zip(docs, brute(docs)))
    rows = lines.op7_lines(spark, str(tmp_path)).collect()
    assert sorted((str(r.doc_id), r.kept_sha256) for r in rows) == want
    assert sum(r.n_removed for r in rows) > 60


def test_one_hash_shared_by_very_many_lines(spark):
    texts = [f"item {i} is in stock again now" for i in range(3000)]
    out = lines.deduplicate_lines(id_text(documents(spark, texts)))
    assert [(r.doc_id, r.n_lines) for r in out.where("n_removed = 0").collect()] == [(0, 1)] and out.count() == 3000


def test_rows_without_an_id_are_ordered_by_their_texts(spark):
    texts = [f"a line of seven words {i % 40} here\nshort {i % 7}" for i in range(300)]
    df = documents(spark, texts).selectExpr("cast(null as long) as doc_id", "text")
    kept = [x for r in lines.deduplicate_lines(df).collect() for x in r.text.split("\n") if x]
    # One line of each class stays: those of seven words are all within one edit. Rows of the same text are one document.
    assert {x for x in kept if x.startswith("short")} == {f"short {i}" for i in range(7)}
    assert len({x for x in kept if x.startswith("a line")}) == 1


def test_bucket_of_one_row_sharing_an_id_hides_no_earlier_line(spark):
    texts = ["u v w x y z 1", "u v w x y z 2", "u v w x y z 3"]
    df = documents(spark, texts).selectExpr("if(doc_id = 0, 0L, 5L) as doc_id", "text")
    assert {r.text for r in lines.deduplicate_lines(df).collect() if r.doc_id == 5} == {""}


def test_empty_table(spark):
    assert lines.deduplicate_lines(id_text(documents(spark, []))).count() == 0


def test_verification(spark):
    pairs = [("a b c d e", "a b c d e", True), ("a b c d e", "a b x d e", True), ("a b c d e", "b c d e", True), ("a a a", "a a", True), ("a b c", "b a c", False), ("a b c d", "a x c y", False), ("a b", "a b c d", False)]
    df = spark.createDataFrame(pairs, "a string, b string, want boolean").withColumn("got", lines.within_one_edit(F.split("a", " "), F.split("b", " ")))
    assert df.where("got <> want").count() == 0
