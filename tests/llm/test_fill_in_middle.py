"""Fill-in-the-middle ropes against a rule-by-rule version on lists of units, and exact round trips."""

import hashlib
import random
import re

import numpy as np
import pytest

from trajecta.llm import fill_in_middle as fim

UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]", re.S)


def plainly(key, text, cut=90, suffix_first=20):
    text = text or ""
    units, h = UNIT.findall(text), hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= cut:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    x, y, z = ("".join(units[i:j]) for i, j in ((0, a), (a, b), (b, n)))
    if h4 % 100 < suffix_first:
        return n, "spm", len(x), len(y), f"<S>{z}<P>{x}<M>{y}"
    return n, "psm", len(x), len(y), f"<P>{x}<S>{z}<M>{y}"


def odd_texts():
    rng = random.Random(2)
    some = [None, "", "a", "ab", ".", "\n", "é", "日本語", "a<P>b", "x <S>", "<M>", "<", "<S", "P>", "<P", "a\r\nb", "A" * 9000, "é" * 700, "a1" * 700, "<S" * 50, "S>P>M>" * 30, "<<<", "𝔘𝔫𝔦code"]
    alphabet = ["word", "Zz", " ", "\n", ".", "<", "S", ">", "P", "M", "é", "日", "𝔘", "<S", "M>", "1", "__"]
    some += ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 900))) for _ in range(120)]
    return [*some, "".join(rng.choice(alphabet) for _ in range(60_000)), "a", "a"]


def test_equal_to_the_rules_and_back(spark):
    rows = [(None if i in (3, 9) else i // 2 if i % 5 == 0 else i, t, "x", None) for i, t in enumerate(odd_texts())]
    df = spark.createDataFrame(rows, "doc_id long, text string, n string, fim_form string").repartition(3)
    for cut, first in ((90, 20), (100, 50), (100, 0), (100, 100)):
        s = fim.Settings(cut, first)
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        want = [(k, *(w := plainly(k, t, cut, first))[:4], sha(w[4]), sha(t or "")) for k, t, *_ in rows]
        assert sorted((tuple(r) for r in fim.digests(df, s).collect()), key=str) == sorted(want, key=str)
    made = fim.transformed(df, fim.Settings(100, 50))
    assert made.columns == ["doc_id", "text", "n", "fim_n", "fim_form", "fim_prefix_chars", "fim_middle_chars", "fim_text"]
    back = fim.originals(made).collect()
    assert len(back) == len(rows) and all(r.restored_text == (r.text or "") and r.n == "x" for r in back)
    assert sorted(str((r.doc_id, r.fim_text)) for r in back) == sorted(str((k, plainly(k, t, 100, 50)[4])) for k, t, *_ in rows)


def test_empty_table_and_nulls_on_the_way_back(spark):
    df = spark.createDataFrame([(1, None, "psm"), (2, "abc", None), (3, "abc", "plain")], "id long, fim_text string, fim_form string")
    assert [r.restored_text for r in fim.originals(df).orderBy("id").collect()] == [None, None, "abc"]
    none = df.where("false")
    assert fim.digests(none, key="id", column="fim_text").collect() == [] and fim.transformed(none.toDF("id", "text", "kind"), key="id").collect() == []
    with pytest.raises(ValueError, match="fim_text"):
        fim.transformed(df, key="id", column="fim_text")


@pytest.mark.parametrize("leaf", [1, 2, 5, 256])
def test_ropes(monkeypatch, leaf):
    """Splits at every rank, cached counts, and heights that stay logarithmic."""
    monkeypatch.setattr(fim, "LEAF", leaf)
    texts = ["", "ab c", "é日x9", "Words, and more words: " * 20]
    raw = "".join(texts).encode()
    at = np.cumsum([0, *(len(t.encode()) for t in texts)])
    for text, rope in zip(texts, fim.ropes(raw, at)):
        units = UNIT.findall(text)
        assert (rope.units if rope else 0) == len(units) and fim.content(rope) == text.encode()
        for rank in range(len(units) + 1):
            a, b = fim.split(rope, rank)
            for part, want in ((a, units[:rank]), (b, units[rank:])):
                assert fim.content(part).decode() == "".join(want)
                assert part is None or (part.units, part.chars, part.size) == (len(want), len("".join(want)), len("".join(want).encode()))
            both = fim.joined(b, a)
            assert both is None or both.height <= 2 * max(1, len(list(fim.leaves(both)))).bit_length() + 2


def test_few_bytes_are_read_again(monkeypatch):
    """A cut reads its own leaf, whatever the length of the text."""
    text = ("some words and 12 numbers. " * 40_000).encode()
    (rope,) = fim.ropes(text, np.array([0, len(text)]))
    read = []
    starts = fim._starts
    monkeypatch.setattr(fim, "_starts", lambda raw: read.append(len(raw)) or starts(raw))
    made, _, _ = fim.arranged(rope, 12_345, 99_999, False)
    assert sum(read) < 4096 and fim.restored(fim.content(made), "psm") == text
