"""The pipeline's stages one by one, each against brute force on its own input."""

import random
from collections import defaultdict

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_filters import counts
from tests.llm.test_minhash import brute
from tests.llm.test_repeats import covered

SF = "/root/testdata/sf0.001"


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "toxicity", "minhash_dedup", "substring_dedup", "best_fit_pack"]
    assert corpus_pipeline.ORACLE_SQL is None


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)

    good = stages["quality_rules"](spark, docs, SF)
    kept = {r.doc_id: r.text for r in good.collect()}
    assert good.schema == docs.schema and kept.items() <= rows.items() and all(not counts(t)[-1] for t in kept.values())

    clean = stages["toxicity"](spark, good, SF)
    left = {r.doc_id: r.text for r in clean.collect()}
    assert clean.schema == docs.schema and left.items() <= kept.items()

    single = stages["minhash_dedup"](spark, clean, SF)
    want = {k for k, (_, _, stays) in brute(sorted(left.items()), 80).items() if stays}
    ones = {r.doc_id: r.text for r in single.collect()}
    assert single.schema == docs.schema and set(ones) == want

    cut = stages["substring_dedup"](spark, single, SF)
    keys = sorted(ones)
    words = [ones[k].encode().split() for k in keys]
    for key, w, gone in zip(keys, words, covered(words, 20)):
        ones[key] = b" ".join(x for x, g in zip(w, gone) if not g).decode()
    found = {r.doc_id: (r.text, r.n_chars) for r in cut.collect()}
    assert cut.columns == docs.columns and found == {k: (t, len(t)) for k, t in ones.items()}

    packed = stages["best_fit_pack"](spark, cut, SF).collect()
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    total, filled = defaultdict(int), defaultdict(int)
    for r in packed:
        total[r.doc_id] += r.length
        filled[r.sequence_id] += r.length
    assert dict(total) == {k: len(library.encode(t, add_special_tokens=False).ids) + 1 for k, t in ones.items()}
    assert max(filled.values()) <= 1024


def test_run_gives_the_last_stage(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and got.count()


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_odd_inputs(spark, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    rng = random.Random(2)
    rows = [(1, None, None, None, None, "x"), (2, "", "en", None, 0, None), (3, " ".join(rng.choice("abcd") for _ in range(300)), None, "s", None, "y"), (3, "same key", None, "s", None, "y"), (None, "no key", None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string")
    got = stage(spark, docs, SF)
    assert got.count() >= 0
    if name != "best_fit_pack":
        assert got.columns == docs.columns
    assert stage(spark, docs.where("false"), SF).count() == 0
