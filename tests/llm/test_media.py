"""Media columns and fixity audits."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from hypothesis import given, settings
from hypothesis import strategies as st

from gritsieve.llm import media, warc


def payload(b):
    return b + b"\xff" * (max(576, -(-len(b) // 576) * 576) - len(b))


@settings(max_examples=30, deadline=None)
@given(st.lists(st.binary(max_size=3000), min_size=1, max_size=5))
def test_round_trip(texts):
    stored = media.encode([payload(t) for t in texts])
    assert [media.stored_bytes(x) for x in media.decode(stored)] == [payload(t) for t in texts]


def test_wide_images(monkeypatch):
    monkeypatch.setattr(media, "MOST_DOWN", 4)
    monkeypatch.setattr(media, "CHUNK", 7)
    data = payload(np.random.default_rng(0).integers(0, 256, 20_000).astype(np.uint8).tobytes())
    image = media.decode(media.encode([data]))[0]
    assert media.stored_bytes(image) == data and image.width > 24 and media.thumbnail(image).shape == (image.height // 8, image.width // 8)


def plain_jpeg(blocks, layout, sizes, sampling, interval):
    """A baseline image by a plain bitwise coder; blocks: {component: (rows, columns, 64)}."""
    counts = bytes([0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 250])
    symbols = bytes(range(250))
    code = {s: (c, n) for s, c, n in media.codes(counts, symbols)}
    bits, out, pred, mark = [], bytearray(), {}, 0

    def put(v, n):
        bits.extend((v >> k) & 1 for k in range(n - 1, -1, -1))

    def flush():
        while len(bits) % 8:
            bits.append(1)
        for k in range(0, len(bits), 8):
            out.append(int("".join(map(str, bits[k : k + 8])), 2))
            if out[-1] == 255:
                out.append(0)
        bits.clear()

    def number(v):
        n = abs(v).bit_length()
        return n, v if v >= 0 else v + (1 << n) - 1

    def block(c, z):
        n, v = number(int(z[0]) - pred.get(c, 0))
        pred[c] = int(z[0])
        put(*code[n]), put(v, n)
        run = 0
        for k in range(1, 64):
            if z[k] == 0:
                run += 1
                continue
            while run > 15:
                put(*code[0xF0])
                run -= 16
            n, v = number(int(z[k]))
            put(*code[run << 4 | n]), put(v, n)
            run = 0
        if run:
            put(*code[0])

    across, down = layout
    for m in range(across * down):
        if interval and m and m % interval == 0:
            flush()
            out.extend((255, 0xD0 + mark % 8))
            mark += 1
            pred.clear()
        r, q = divmod(m, across)
        for c, (h, v) in enumerate(sampling):
            for i in range(v):
                for j in range(h):
                    block(c, blocks[c][r * v + i, q * h + j])
    flush()
    frame = b"\x08" + sizes[1].to_bytes(2, "big") + sizes[0].to_bytes(2, "big") + bytes([len(sampling)]) + b"".join(bytes((c + 1, h << 4 | v, 0)) for c, (h, v) in enumerate(sampling))
    scan = bytes([len(sampling)]) + b"".join(bytes((c + 1, 0)) for c in range(len(sampling))) + b"\x00\x3f\x00"
    seg = media._segment
    return b"\xff\xd8" + seg(0xDB, b"\x00" + bytes(range(1, 65))) + seg(0xC0, frame) + seg(0xC4, b"\x00" + counts + symbols + b"\x10" + counts + symbols) + (seg(0xDD, interval.to_bytes(2, "big")) if interval else b"") + seg(0xDA, scan) + bytes(out) + b"\xff\xd9"


@pytest.mark.parametrize("interval", [0, 1, 3])
@pytest.mark.parametrize("sampling", [[(1, 1)], [(2, 2), (1, 1), (1, 1)], [(2, 1), (1, 1)]])
def test_images_of_other_writers(sampling, interval):
    rng = np.random.default_rng(7)
    h, v = sampling[0]
    across, down = 3, 2
    size = (across * 8 * h - 3, down * 8 * v - 5)
    blocks = {c: np.where(rng.random((down * b, across * a, 64)) < 0.15, rng.integers(-200, 200, (down * b, across * a, 64)), 0) for c, (a, b) in enumerate(sampling)}
    data = plain_jpeg(blocks, (across, down), size, sampling, interval)
    image, other = media.decode([data, data])
    assert (image.width, image.height) == size
    for c in blocks:
        assert np.array_equal(image.coefficients[c], blocks[c]) and np.array_equal(other.coefficients[c], blocks[c])
    assert np.array_equal(media.thumbnail(image), np.clip(np.rint(blocks[0][:, :, 0] * 1 / 8) + 128, 0, 255).astype(np.uint8))


def test_what_is_no_image():
    good = media.encode([payload(b"text")])[0]
    for bad in (b"", b"\x89PNG", good[:100], good[:-2]):
        with pytest.raises((ValueError, IndexError, KeyError)):
            media.decode([bad])


def test_media_column(spark):
    texts = {0: None, 1: "", 2: "a", 3: "é" * 288, 4: "x" * 577, 5: "long text " * 200_000, 6: "a"}
    df = spark.createDataFrame([*texts.items(), (None, "a"), (2, "a")], "doc_id long, text string")
    rows = media.describe(media.store(df)).collect()
    assert len(rows) == 9
    for r in rows:
        b = (texts[r.doc_id] if r.doc_id is not None else "a") or ""
        p = payload(b.encode())
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(b.encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
    same = {(r.media_sha256, r.feature, r.media_bytes) for r in rows if r.n_bytes == 1}
    assert len(same) == 1
    assert media.describe(media.store(df.limit(0))).count() == 0


def test_fixity(spark):
    rows = [(i, f"http://h/{i}", f"<p>{i}</p>" * (i % 5 + 1)) for i in range(3000)] + [(None, None, None), (None, "u", "b"), (7, "again", "twice")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    changed = [(i, u, h + "!" if i in (5, 1029, 2999) else h) for i, u, h in rows if i not in (17, 2048)]
    replica = spark.createDataFrame([*changed, (5000, "new", "new")], pages.schema)
    found = warc.audit(warc.leaves(warc.records(pages)), warc.leaves(warc.records(replica))).collect()
    assert sorted((r.id, r.outcome) for r in found) == sorted([(5, "changed"), (1029, "changed"), (2999, "changed"), (17, "missing"), (2048, "missing"), (5000, "added")])
    out = warc.report(pages, replica).collect()
    assert len(out) == len(rows) + 1 and sum(r.outcome != "intact" for r in out) == 6
    assert [(r.page_id, r.file, r.offset, r.length, r.digest) for r in out if r.outcome == "added"] == [(5000, None, None, None, None)]
    assert warc.audit(warc.leaves(warc.records(pages)), warc.leaves(warc.records(pages))).count() == 0
    nothing = warc.leaves(warc.records(pages.limit(0)))
    assert warc.audit(nothing, nothing).count() == 0
    in_file = sorted((r.offset, r.length) for r in out if r.file == 1)
    assert all(a[0] + a[1] == b[0] for a, b in zip(in_file, in_file[1:])) and in_file[0][0] == 0


def test_fixity_of_far_ids_and_clashing_columns(spark):
    far = [-(2**63), -(9 * 10**18), -1, 0, 31, 32, 9 * 10**18, 2**63 - 1]
    rows = [(i, None, "x" * 3_000_000 if i == 0 else str(i)) for i in far]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("id", F.lit(1)).withColumn("hash", F.lit("h")).withColumn("node", F.lit(2)).withColumn("replica", F.lit("r"))
    for bad in far[1:2]:
        replica = pages.withColumn("html", F.when(F.col("page_id") == bad, F.concat("html", F.lit("!"))).otherwise(F.col("html")))
        assert [(r.page_id, r.outcome) for r in warc.report(pages, replica).collect() if r.outcome != "intact"] == [(bad, "changed")]
    assert sorted((r.page_id, r.outcome) for r in warc.report(pages, pages.filter("page_id > 0")).collect() if r.outcome != "missing") == sorted((i, "intact") for i in far if i > 0)
    assert warc.report(pages.limit(0), pages.limit(0)).count() == 0
    assert {r.outcome for r in warc.report(pages.limit(0), pages).collect()} == {"added"}


def test_every_digit_of_a_digest_counts(spark):
    digests = ["0" * 64] + ["0" * k + "1" + "0" * (63 - k) for k in range(64)]
    df = spark.createDataFrame([(i, i, 5, d) for i, d in enumerate(digests)], "page_id long, id long, length long, digest string")
    assert warc.leaves(df).select("hash").distinct().count() == 65


def test_nodes_cover_ranges_of_offsets(spark):
    leaf = lambda lengths: spark.createDataFrame([(i, n, "same") for i, n in enumerate(lengths)], "id long, length long, hash string")
    roots = [warc.trees(leaf(x), leaf(x))[-1].first().hash for x in ([1, 2, 3], [1, 3, 2], [1, 2, 3])]
    assert roots[0] == roots[2] != roots[1]
