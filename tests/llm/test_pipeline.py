import random

import public_tokenizers
from fixtures_docs import ODD
from test_lines import brute as without_lines
from test_simhash import brute_fp, components
from test_substrings import brute as covered
from tokenizers import Tokenizer

import corpus_pipeline
from corvane.llm import quality

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 8)))
    line = lambda n: " ".join(word() for _ in range(n))
    shared, passage = line(14), line(70)
    out = []
    for i in range(60):
        lines = [line(rng.randint(6, 30)) for _ in range(rng.randint(2, 5))]
        if i % 4 == 0:
            lines.insert(1, shared.replace(" ", " x ", 1) if i % 8 else shared)
        if i % 5 == 0:
            lines[0] += " " + passage + " " + line(6)
        if i % 7 == 3:
            lines = [" ".join(w + "***" for w in x.split()) for x in lines]
        out.append("\n".join(lines))
    return ODD + out + [out[2], out[4] + " end", out[5]]


def test_run_equals_brute_force(spark, tmp_path):
    texts = corpus()
    rows = [(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)] + [(None, texts[12], None, None, None), (12, texts[12], "en", "src0", 1)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([(i + len(ODD), int(i % 7 != 3), 0) for i in range(50)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    # The classifier is the operator's own; its verdicts are tested beside it.
    docs = spark.createDataFrame([(k, r[0], r[1] or "") for k, r in enumerate(rows)], "row long, doc_id long, text string")
    model = quality.fit(docs.select("doc_id", "text"), labels)
    kept = {r.row for r in quality.judge(docs, model).where("kept").collect()}
    left = [(r[0], r[1] or "") for k, r in enumerate(rows) if k in kept]
    assert 40 < len(left) < len(rows)
    left = [(i, t) for (i, _), t in zip(left, without_lines(left))]
    order = lambda i: i if i is not None else 1 << 70
    left.sort(key=lambda d: order(d[0]))
    groups = components([brute_fp(t, 5) for _, t in left])
    left = [d for k, d in enumerate(left) if groups[k] == k]
    pairs = [(i, t.encode()) for i, t in left]
    texts = [bytes(b for b, g in zip(raw, gone) if not g).decode() for (_, raw), gone in zip(pairs, covered(pairs, 100))]
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = sorted((str(i), len(library.encode(t, add_special_tokens=False).ids) + 1) for (i, _), t in zip(left, texts))
    assert sorted((str(r.doc_id), r.length) for r in got) == want
    assert len({r.sequence_id for r in got}) == max(r.sequence_id for r in got) + 1


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_chained_before_anything_is_written(spark, tmp_path):
    """With columns beyond those of documents, some of clashing names; two chains at once do not meet."""
    rows = [(i, t, "en", "s", len(t or ""), "x", i, 0.5) for i, t in enumerate(corpus())]
    docs = spark.createDataFrame(rows, SCHEMA + ", rest string, block int, kept double")
    labels = spark.createDataFrame([(i + len(ODD), int(i % 7 != 3), 0) for i in range(50)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    chained = docs
    for _, stage in corpus_pipeline.STAGES:
        chained = stage(spark, chained, str(tmp_path))
    ran = corpus_pipeline.run(spark, str(tmp_path))
    place = lambda df: sorted((r.doc_id, r.piece, r.length) for r in df.collect())
    assert place(chained) == place(ran) and place(ran)
