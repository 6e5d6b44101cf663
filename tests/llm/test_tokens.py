import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from trajecta.llm import best_fit_pack, bpe, token_store, tokens
from trajecta.llm import text as tx

WORD, BYTE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))
LETTERS = "ab cdeéñÉ'.,!#012  \n\n\t\r 　\x85\x1c 日́|*"


@pytest.fixture(scope="module")
def samples(texts):
    rng = random.Random(1)
    made = ["".join(rng.choice(LETTERS) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    wild = ["".join(chr(rng.choice([rng.randint(32, 0x24F), rng.randint(0x300, 0x36F), rng.randint(0x370, 0xD7FF), rng.randint(0x1F300, 0x1F9FF)])) for _ in range(25)) for _ in range(300)]
    special = ["<|endoftext|> x <|endoftext|>", "A<|startoftext|>b", "<|ENDOFTEXT|>", " a", " ", "", "|", "a | b", "it's DON'T can't.", "x\x00y z\x00"]
    return [t or "" for t in texts] + made + wild + special


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_encoder_equals_library(samples, path):
    library = Tokenizer.from_file(path)
    encoder = tokens.Encoder(path)
    for at in range(0, len(samples), 500):
        part = samples[at : at + 500]
        flat, edge = encoder.encode(*tx.buffers(pa.array(part, pa.string())))
        for t, a, b in zip(part, edge[:-1], edge[1:]):
            assert flat[a:b].tolist() == library.encode(t, add_special_tokens=False).ids


def test_cache_generations(monkeypatch, samples):
    monkeypatch.setattr(tokens, "CACHE_BYTES", 5000)
    test_encoder_equals_library(samples[:700], BYTE)


def test_backtracking_encoder(samples):
    library, own = Tokenizer.from_file(WORD), bpe.WordBpe(WORD)
    for t in samples:
        want = library.encode(t, add_special_tokens=False).ids
        ids = own.encode(t.encode())
        assert ids.tolist() == want
        assert own.decode(ids) == library.decode(want, skip_special_tokens=False).encode()


def test_word_encoder_by_pieces(samples):
    """Whole slices are cut into pieces, each met once whatever marks or case it has in the text."""
    own, library, seen = bpe.WordBpe(WORD), Tokenizer.from_file(WORD), []
    own.cutter.known.encode = lambda piece, f=own.cutter.known.encode: seen.append(piece) or f(piece)
    part = [*samples[:300], *samples[-20:], "Word word, WORD! (word) word..."]
    flat, edge = own.encode_all(*tx.buffers(pa.array(part, pa.string())))
    for t, a, b in zip(part, edge[:-1], edge[1:]):
        assert flat[a:b].tolist() == library.encode(t, add_special_tokens=False).ids
    assert len(seen) == len(set(seen)) and not {b"Word", b"word,", b"WORD!", b"(word)"} & set(seen)


def test_bpe_columns(docs, empty):
    ids = bpe.encode_column(docs, WORD)
    back = {r.doc_id: r.text for r in bpe.decode_column(ids, WORD).collect()}
    library = Tokenizer.from_file(WORD)
    for r in docs.collect():
        assert back[r.doc_id] == library.decode(library.encode(r.text or "", add_special_tokens=False).ids, skip_special_tokens=False)
    assert bpe.round_trip(empty, WORD).count() == 0


def test_store(docs, empty):
    library = Tokenizer.from_file(WORD)
    blocks, dictionary = token_store.write(docs, WORD, end_id=1)
    rows = sorted((r.doc_id, r.text or "") for r in docs.collect())
    want, start = [], 0
    for key, t in rows:
        ids = [*library.encode(t, add_special_tokens=False).ids, 1]
        want.append((key, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        start += len(ids)
    assert sorted(tuple(r) for r in token_store.checksums(blocks, dictionary).collect()) == [w[:4] for w in want]
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids) for r in token_store.read(blocks, dictionary).collect()) == [(*w[:3], w[4]) for w in want]
    assert [r.ids for r in token_store.lookup(blocks, dictionary, want[3][0]).collect()] == [want[3][4]]
    with pytest.raises(ValueError):
        token_store.Block(blocks.first().data, b"another")
    assert token_store.checksums(*token_store.write(empty, WORD, end_id=1)).count() == 0


def test_store_with_equal_keys(spark):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (None, "c")], "doc_id long, text string")
    got = sorted((r.start, r.ids) for r in token_store.read(*token_store.write(df, WORD, end_id=1)).collect())
    library = Tokenizer.from_file(WORD)
    assert [ids for _, ids in got] == [[*library.encode(t, add_special_tokens=False).ids, 1] for t in "cab"]


def test_store_with_null_keys_and_few_documents(spark):
    """A null key is not a key of -1, and a corpus too small for the trainer still has a dictionary."""
    df = spark.createDataFrame([(-1, "minus one"), (None, "no key"), (0, None)], "doc_id long, text string")
    blocks, dictionary = token_store.write(df, WORD, end_id=1)
    assert dictionary
    library = Tokenizer.from_file(WORD)
    ids = lambda t: [*library.encode(t, add_special_tokens=False).ids, 1]
    assert {r.doc_id: r.ids for r in token_store.read(blocks, dictionary).collect()} == {None: ids("no key"), -1: ids("minus one"), 0: [1]}
    assert {r.doc_id for r in token_store.checksums(blocks, dictionary).collect()} == {None, -1, 0}
    for key, text in ((None, "no key"), (-1, "minus one"), (0, "")):
        assert [r.ids for r in token_store.lookup(blocks, dictionary, key).collect()] == [ids(text)]
    assert token_store.lookup(blocks, dictionary, 7).count() == 0


THUE_MORSE = "a"
for _ in range(10):
    THUE_MORSE += THUE_MORSE.translate(str.maketrans("ab", "ba"))
COMPLEMENT = THUE_MORSE.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_words_that_collide_modulo_powers_of_two(path):
    library = Tokenizer.from_file(path)
    flat, edge = tokens.Encoder(path).encode(*tx.buffers(pa.array([THUE_MORSE, COMPLEMENT])))
    assert [flat[a:b].tolist() for a, b in zip(edge[:-1], edge[1:])] == [library.encode(t, add_special_tokens=False).ids for t in (THUE_MORSE, COMPLEMENT)]


def test_hashes():
    rng = np.random.default_rng(0)
    x, prime = rng.integers(0, 256, 3000).astype(np.uint8), (1 << 61) - 1
    rolling = tx.Rolling(x)
    for a, b in np.sort(rng.integers(0, 3001, (40, 2))):
        value = sum((int(c) + 1) * pow(tx._POINT, i, prime) for i, c in enumerate(x[a:b])) % prime
        assert rolling.of(np.array([a]), np.array([b]))[0] == tx.mix(np.array([value], np.uint64))[0]
    both = np.frombuffer((THUE_MORSE + COMPLEMENT).encode(), np.uint8)
    assert len(set(tx.Rolling(both).of(np.array([0, 1024]), np.array([1024, 2048])).tolist())) == 2


def plain_best_fit(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in rooms if r >= n]
        rooms.remove(min(fits)) if fits else None
        rooms.append((min(fits) if fits else capacity) - n)
    return sorted(rooms)


def test_plan_is_best_fit_decreasing():
    rng = random.Random(0)
    for trial in range(200):
        capacity = rng.choice([5, 17, 64, 100])
        lengths = [min(capacity, int(rng.expovariate(6 / capacity)) + 1) if trial % 2 else rng.randint(1, capacity) for _ in range(rng.randint(1, 150))]
        filled, counts = defaultdict(list), Counter()
        for n, low, high, first, each, offset in best_fit_pack.plan(dict(Counter(lengths)), capacity):
            for r in range(low, high + 1):
                filled[first + (r - low) // each].append((offset + n * ((r - low) % each), n))
                counts[n] += 1
        assert counts == Counter(lengths)
        for rows in filled.values():
            place = 0
            for offset, n in sorted(rows):
                assert offset == place
                place += n
        assert sorted(capacity - sum(n for _, n in rows) for rows in filled.values()) == plain_best_fit(lengths, capacity)


def test_packing(docs, empty):
    library = Tokenizer.from_file(BYTE)
    got = best_fit_pack.pack(docs, BYTE, end_id=2, capacity=256).collect()
    by_doc, filled = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        filled[r.sequence_id].append((r.offset, r.length))
    for d in docs.collect():
        ids = [*library.encode(d.text or "", add_special_tokens=False).ids, 2]
        place = 0
        for r in sorted(by_doc[d.doc_id], key=lambda r: r.piece):
            assert r.start == place and (r.length == 256 or r.piece == 0) and zlib.crc32(np.array(ids[place : place + r.length], "<u4").tobytes()) == r.ids_crc32
            place += r.length
        assert place == len(ids) and [r.piece for r in sorted(by_doc[d.doc_id], key=lambda r: r.piece)] == list(range(-(-len(ids) // 256)))
    for rows in filled.values():
        place = 0
        for offset, n in sorted(rows):
            assert offset == place
            place += n
        assert place <= 256
    assert len(filled) == len(plain_best_fit([r.length for r in got], 256))
    assert best_fit_pack.pack(empty, BYTE, end_id=2).count() == 0
