import hashlib
import html
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from trajecta.llm import html_extract, jpeg_media


def test_payloads_come_back():
    rng = np.random.default_rng(0)
    parts = [rng.integers(0, 256, 192 * k, dtype=np.uint8) for k in (1, 2, 3, 7, 50)]
    parts += [np.where(rng.random(192 * 9) < f, 128, rng.integers(0, 256, 192 * 9)).astype(np.uint8) for f in (0.5, 0.9, 0.99, 1)]
    parts += [np.full(192 * 4, v, np.uint8) for v in (0, 255, 127, 128, 32)]
    files = jpeg_media.store(np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])]))
    for p, (frame, values) in zip(parts, jpeg_media.decode(files)):
        assert ((values.reshape(-1)[: int(frame.note.split()[1])] + 128).astype(np.uint8) == p).all()
    for full, small in zip(jpeg_media.decode(files), jpeg_media.decode(files, dc_only=True)):
        assert jpeg_media.feature(full[0], full[1][:, 0]) == jpeg_media.feature(*small)


def test_files_without_restarts_and_one_component():
    """A gray 16 x 8 file made by hand: two DC values and no AC."""
    table = lambda kind: b"\xff\xc4\x00\x15" + bytes([kind, 0, 2] + [0] * 14 + ([4, 0] if kind == 0 else [0, 1]))
    head = b"\xff\xd8" + b"\xff\xdb\x00\x43\x00" + b"\x08" * 64 + b"\xff\xc0\x00\x0b\x08\x00\x08\x00\x10\x01\x01\x11\x00"
    # Codes 00 and 01: DC size 4 value 10 (1010), AC end; DC size 0, AC end.
    bits = "00" + "1010" + "00" + "01" + "00"
    bits += "1" * (-len(bits) % 8)
    data = head + table(0) + table(0x10) + b"\xff\xda\x00\x08\x01\x01\x00\x00\x3f\x00" + int(bits, 2).to_bytes(len(bits) // 8, "big") + b"\xff\xd9"
    frame, dc = jpeg_media.decode([data], dc_only=True)[0]
    assert (frame.width, frame.height, dc.tolist()) == (16, 8, [10, 10])
    assert jpeg_media.thumbnail(frame, dc).tolist() == [[138, 138]]


@pytest.mark.parametrize("data", [None, b"", b"\xff\xd8", b"not a file", b"\xff\xd8\xff\xc2\x00\x0b\x08\x00\x08\x00\x10\x01\x01\x11\x00"])
def test_other_bytes(data):
    assert jpeg_media.decode([data]) == [None]


def test_damaged_scan():
    raw = np.arange(192 * 3, dtype=np.int64).astype(np.uint8)
    data = jpeg_media.store(raw, np.array([0, len(raw)]))[0]
    for cut in (len(data) - 40, len(data) - 200):
        assert jpeg_media.decode([data[:cut]]) == [None]


def test_media_query(docs, empty):
    got = {r.doc_id: r for r in jpeg_media.read_media(jpeg_media.to_media(docs)).collect()}
    same = {}
    for d in docs.collect():
        raw = (d.text or "").encode()
        payload = raw + b" " * (-len(raw) % 192 or (192 if not raw else 0))
        r = got[d.doc_id]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert same.setdefault(d.text or "", tuple(r)[2:]) == tuple(r)[2:]
    assert jpeg_media.read_media(jpeg_media.to_media(empty)).count() == 0


def test_media_columns(docs):
    media = docs.join(jpeg_media.to_media(docs), "doc_id").withColumn("width", F.lit("old"))
    got = jpeg_media.media_features(media.withColumn("media", F.when(F.col("doc_id") % 2 == 0, F.col("media"))))
    assert got.schema["width"].dataType.simpleString() == "int"
    assert all((r.width is None) == (r.doc_id % 2 == 1) and (r.feature is None) == (r.width is None) for r in got.collect())


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>no</p>";</script></head><body>
<nav><ul><li><a href="/">Home page</a></li></ul></nav><div id="cookie-notice"><p>We use cookies here</p></div><header><p>Site name and slogan of the site</p></header>
<article><h1>A &amp; B</h1><p>First   words
 of the <a href="/x">story</a> &lt;here&gt; and some more words<p>Second block<br>after a break<div class="advert">Buy this now</div><form><p>Your name</p></form><p>Last <b>block&nbsp;ends</article>
<section class="comments"><p>Reader comment with many words in it that nobody wants to see here at all</p></section><footer>&copy; Somebody</footer></body></html>"""


def test_article():
    assert html_extract.default_model().extract(PAGE) == "A & B\nFirst words of the story <here> and some more words\nSecond block\nafter a break\nLast block ends"


@pytest.mark.parametrize("page", [None, "", "<p>", "<!-- only -->", "<script>x</script>", "<div></div>"])
def test_pages_without_text(page):
    assert html_extract.default_model().extract(page) == ""


def test_plain_and_broken_pages():
    model = html_extract.default_model()
    assert model.extract("just words") == "just words"
    assert model.extract("<article><p>one two three four five <form>six seven eight") == "one two three four five\nsix seven eight"
    assert model.extract("<article><p>a < b and c > d</p></article>") == "a < b and c > d"


def test_held_out_pages():
    model = html_extract.default_model()
    pages = html_extract.labelled_pages(200, seed=99)
    right = sum(html_extract._filled(p, *model.region(p)) == html_extract._filled(p, *region) for p, region in pages)
    assert right / len(pages) >= 0.95


def test_whole_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: r for r in html_extract.annotate(pages, html_extract.default_model()).collect()}
    for p in pages.collect():
        inner = re.search(r"<article>(.*?)</article>", p.html, re.S)[1]
        blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1|br)\b[^>]*>", inner))
        assert got[p.page_id].text == "\n".join(b for b in blocks if b) and got[p.page_id].n_chars == len(got[p.page_id].text)


def test_page_columns(spark):
    df = spark.createDataFrame([(1, None, "old"), (1, "<p>hello there</p>", "old")], "page_id int, html string, text string")
    assert sorted(tuple(r) for r in html_extract.annotate(df, html_extract.default_model()).collect()) == [(1, "", 0), (1, "hello there", 11)]
