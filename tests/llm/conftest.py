import random

import pytest

SF = "/root/testdata/sf0.001"


def words(rng, n):
    return [rng.choice("abcdefgh") * rng.randint(1, 3) + rng.choice("xyz.,") for _ in range(n)]


def passages(rng):
    """Texts with shared passages, copies, near copies, nulls, empties and one very long text."""
    common, other = words(rng, 70), words(rng, 30)
    texts = [None, "", "   \n\t", "one", "one", "Two words"]
    for i in range(40):
        body = words(rng, rng.randint(3, 160))
        if i % 3 == 0:
            body[len(body) // 2 : len(body) // 2] = common[: rng.randint(15, 70)]
        if i % 5 == 0:
            body += other + other
        texts.append(" ".join(body).replace(". ", ".\n", 2))
    base = words(rng, 120)
    for i in range(12):
        edited = list(base)
        for _ in range(i // 3):
            edited[rng.randrange(len(edited))] = "edited%d" % i
        texts.append(" ".join(edited))
    texts += [texts[10], texts[10].upper(), "aa " * 300, "é ü 日本語   " * 30, "x" * 5000, " ".join(words(rng, 20_000))]
    return texts


@pytest.fixture(scope="session")
def texts():
    return passages(random.Random(5))


@pytest.fixture(scope="session")
def docs(spark, texts):
    """doc_id out of order, with other columns null now and then and names that operators use."""
    rows = [(1000 - 7 * i, t, None if i % 4 == 0 else "en", "src", None if t is None else len(t), "mine", False) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_removed string, kept boolean").repartition(3)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.where("false")
