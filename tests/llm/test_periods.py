import random

from fixtures_docs import documents
from test_substrings import check

from corvane.llm import substrings


def test_stretches_of_every_period(spark, tmp_path):
    rng = random.Random(7)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    texts = ["".join(rng.choices(letters, k=n)) * (600 // n + 2) for n in range(1, 102)]
    documents(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    check(substrings.op8_substrings(spark, str(tmp_path)).collect(), [(i, t.encode()) for i, t in enumerate(texts)], 100)
