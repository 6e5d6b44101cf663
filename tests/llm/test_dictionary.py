import numpy as np
import public_tokenizers
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from trajecta.llm import token_store

WORD = public_tokenizers.path("word_bpe_49k.json")


def trained_on(monkeypatch, docs, size):
    """The sample's ids."""
    seen = []
    monkeypatch.setattr(zstandard, "train_dictionary", lambda n, samples: seen.extend(samples) or zstandard.ZstdCompressionDict(b""))
    token_store.train_dictionary(docs, WORD, 1, "doc_id", "text", 4096, size)
    return [np.frombuffer(x, "<u2").tolist() for x in seen]


def test_late_parts_of_long_texts(spark, monkeypatch):
    late = Tokenizer.from_file(WORD).encode("zebra", add_special_tokens=False).ids
    docs = spark.createDataFrame([(1, "apple " * 20_000 + "zebra " * 5000), (2, None), (3, "")], "doc_id long, text string")
    samples = trained_on(monkeypatch, docs, 1 << 20)
    assert len(samples) == -(-150_000 // 4096) + 2 and sum(x[-1:] == [1] for x in samples) == 3
    assert sum(x[: len(late)] == late or late[-1] in x for x in samples) >= 7
    few = trained_on(monkeypatch, docs, 375)
    assert 8 <= len(few) <= 32 and any(late[-1] in x for x in few)


def test_sample_grows_with_the_input(spark, monkeypatch):
    docs = spark.range(30_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("some words of number "), F.col("id").cast("string")).alias("text"))
    assert len(trained_on(monkeypatch, docs, 1 << 15)) == 30_000
    total = docs.agg(F.sum(F.length("text"))).first()[0]
    assert 0.8 < len(trained_on(monkeypatch, docs, total // 400)) / 15_000 < 1.2
