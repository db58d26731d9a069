import random
import re

from fixtures_docs import ODD, documents, odd_documents

from corvane.llm import quality
from corvane.llm.common import id_text

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    words = WORD.findall(text or "")
    seen = {}
    for i in range(len(words) - 7):
        seen.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {i + k for at in seen.values() if len(at) > 1 for i in at for k in range(8)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def labelled(n=120):
    rng = random.Random(5)
    good = ["the", "quiet", "river", "runs", "over", "stones", "and", "we", "walk", "home", "slowly", "tonight"]
    texts = [" ".join(rng.choice(good) for _ in range(40)) for _ in range(n)]
    return [t if i % 3 else " ".join(w + rng.choice(["***", "$$$", "%%%"]) for w in t.split()) for i, t in enumerate(texts)]


def test_counts_equal_brute_force(spark):
    rng = random.Random(2)
    texts = ODD + ["".join(rng.choice("ab é\n\t*#") for _ in range(300)) for _ in range(30)] + ["x y " * 40, "\n\n", "a\n a\na"]
    docs = id_text(documents(spark, texts))
    model = quality.fit(docs, spark.createDataFrame([], "doc_id long, quality int"))
    got = {r.doc_id: r for r in quality.judge(docs, model).collect()}
    for i, t in enumerate(texts):
        want = brute(t)
        assert tuple(got[i][c] for c in quality.COUNTS) == want
        assert got[i].base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert got[i].kept == (not got[i].base_failed)  # no labels: the classifier keeps all


def test_held_out_accuracy_and_query(spark, tmp_path):
    texts = labelled()
    documents(spark, texts).union(odd_documents(spark)).write.parquet(f"{tmp_path}/documents.parquet")
    half = [(i, int(i % 3 > 0), None) for i in range(len(texts) // 2)] + [(None, 1, 0), (3, None, 0)]
    spark.createDataFrame(half, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = [r for r in quality.op10_quality(spark, str(tmp_path)).collect() if r.n_words == 40]
    later = [r for r in rows if r.doc_id >= len(texts) // 2]
    assert sum(r.kept == (r.doc_id % 3 > 0) for r in later) >= 0.97 * len(later)


def test_fit_is_stable_and_takes_labels_of_documents_only(spark):
    texts = labelled()
    docs = id_text(documents(spark, texts).union(documents(spark, ["another text of an id"] * 3, first=4)))
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(len(texts))] + [(10**6 + i, 1) for i in range(500)], "doc_id long, quality int")
    one, two = (quality.fit(d, labels, sample_rows=100) for d in (docs, docs.repartition(7)))
    assert (one.weights == two.weights).all() and one.weights.any() and (one.slope, one.offset) == (two.slope, two.offset)


def test_null_ids_and_clashing_columns(spark):
    docs = spark.createDataFrame([(None, "a b " * 30, 5, "x"), (1, None, None, None)], "doc_id long, text string, n_words int, kept string")
    rows = quality.judge(docs, quality.Model(quality.np.zeros(quality.BUCKETS), 0.0, 30.0)).collect()
    assert {(r.doc_id, r.n_words, r.kept) for r in rows} == {(None, 60, False), (1, 0, False)}


def test_empty_tables(spark):
    docs = id_text(documents(spark, []))
    assert quality.judge(docs, quality.fit(docs, spark.createDataFrame([], "doc_id long, quality int"))).count() == 0
