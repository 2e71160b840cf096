"""Media columns: baseline JPEG, written and read in numpy.

The reader parses markers, decodes the Huffman-coded scans of baseline images (any
sampling, any tables, one or more scans) and rebuilds a thumbnail from the luminance DC
coefficients alone.  Restart intervals are independent, so that all intervals of all images
of a batch that share their tables are decoded in step, one symbol each at a time.

The writer stores arbitrary bytes without loss, in the format's own unit: each quantized
coefficient holds a byte plus one (1 to 256, in range for baseline), 64 to a block in
zigzag order, with a restart marker after every block.  No coefficient is zero, so there
are no zero runs and a block is exactly 64 symbols.  A comment segment holds the number of
bytes; blocks that only fill up the rectangle are empty.

Defined cases: a null or empty text is one unit of padding.  Rows are independent, so ids
may repeat or be null.  Further columns are ignored.  Bytes that are no baseline JPEG raise
``ValueError`` in :func:`decode`.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

UNIT = 576
#: Blocks across; taller images than MOST_DOWN blocks become wider.
ACROSS, MOST_DOWN = 3, 8190
#: Blocks and lanes that are worked on at once; bounds memory.
CHUNK = 16384

#: Code lengths of the writer's tables by symbol (size of the value; 0 ends a block).
_LENGTHS = {7: 1, 6: 2, 8: 3, 4: 4, 5: 7, 3: 7, 2: 7, 1: 7, 9: 7, 0: 7}


def _dht() -> tuple[bytes, bytes]:
    order = sorted(_LENGTHS, key=lambda s: _LENGTHS[s])
    return bytes(sum(v == n for v in _LENGTHS.values()) for n in range(1, 17)), bytes(order)


def codes(counts: bytes, symbols: bytes) -> list[tuple[int, int, int]]:
    """Canonical Huffman codes: (symbol, code, length)."""
    out, code, k = [], 0, 0
    for n in range(1, 17):
        for _ in range(counts[n - 1]):
            out.append((symbols[k], code, n))
            code, k = code + 1, k + 1
        code <<= 1
    return out


_CODE, _LENGTH = np.zeros(257, np.int64), np.zeros(257, np.int64)
_OF = {s: (c, n) for s, c, n in codes(*_dht())}
for _v in range(1, 257):
    _CODE[_v] = _OF[_v.bit_length()][0] << _v.bit_length() | _v
    _LENGTH[_v] = _OF[_v.bit_length()][1] + _v.bit_length()
#: An empty block: DC difference 0, end of block.
_EMPTY = (_OF[0][0] << _OF[0][1] | _OF[0][0], 2 * _OF[0][1])


def _entropy(values: np.ndarray, restart: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The coded blocks, each ending with its restart marker unless ``restart`` is -1; and their sizes.

    ``values``: (blocks, 64), 1 to 256, or 0 throughout for an empty block.
    """
    n = len(values)
    code, length = _CODE[values], _LENGTH[values]
    empty = values[:, 0] == 0
    code[empty, 0], length[empty, 0] = _EMPTY
    bits = length.sum(axis=1)
    size = (bits + 7) // 8
    starts = np.cumsum(size) - size
    at = np.cumsum(length, axis=1) - length + 8 * starts[:, None]
    pad = 8 * size - bits
    code = np.concatenate([code.ravel(), (1 << pad) - 1])
    length = np.concatenate([length.ravel(), pad])
    at = np.concatenate([at.ravel(), 8 * starts + bits])
    x = code << (32 - (at & 7) - length)
    byte, total = at >> 3, int(size.sum()) + 4
    data = np.zeros(total)
    for k in range(3):
        data += np.bincount(byte + k, (x >> (24 - 8 * k)) & 255, total)[:total]
    data = data[:-4].astype(np.uint8)
    full = np.flatnonzero(data == 255)
    ends, marks = (starts + size)[restart >= 0], restart[restart >= 0]
    out = np.insert(data, np.concatenate([full + 1, ends, ends]), np.concatenate([np.zeros(len(full), np.uint8), np.full(len(ends), 255, np.uint8), (0xD0 + marks).astype(np.uint8)]))
    stuffed = np.bincount(np.searchsorted(starts, full, side="right") - 1, minlength=n)
    return out, size + stuffed + 2 * (restart >= 0)


def _shape(blocks: int) -> tuple[int, int]:
    across = ACROSS * max(1, -(-blocks // (ACROSS * MOST_DOWN)))
    return across, -(-blocks // across)


def _segment(marker: int, body: bytes) -> bytes:
    return bytes((255, marker)) + (len(body) + 2).to_bytes(2, "big") + body


def _head(n: int, across: int, down: int) -> bytes:
    counts, symbols = _dht()
    frame = b"\x08" + (8 * down).to_bytes(2, "big") + (8 * across).to_bytes(2, "big") + b"\x01\x01\x11\x00"
    return b"".join(
        (b"\xff\xd8", _segment(0xFE, b"bytes=%d" % n), _segment(0xDB, b"\x00" + b"\x01" * 64), _segment(0xC0, frame), _segment(0xC4, b"\x00" + counts + symbols),
         _segment(0xC4, b"\x10" + counts + symbols), _segment(0xDD, b"\x00\x01"), _segment(0xDA, b"\x01\x01\x00\x00\x3f\x00"))
    )


def encode(payloads: list[bytes]) -> list[bytes]:
    """JPEG images that hold the payloads; lengths are positive multiples of 64."""
    shapes = [_shape(len(p) // 64) for p in payloads]
    heads = [_head(len(p), *s) for p, s in zip(payloads, shapes)]
    out: list[list] = [[h] for h in heads]
    blocks, marks, owner, held = [], [], [], 0

    def flush() -> None:
        nonlocal held
        if blocks:
            data, sizes = _entropy(np.concatenate(blocks), np.concatenate(marks))
            stop = np.cumsum([int(x) for x in np.add.reduceat(sizes, np.cumsum([0, *(len(b) for b in blocks)])[:-1])])
            for k, a, b in zip(owner, [0, *stop], stop):
                out[k].append(data[a:b].tobytes())
        blocks.clear(), marks.clear(), owner.clear()
        held = 0

    for k, (p, (across, down)) in enumerate(zip(payloads, shapes)):
        n = across * down
        for i in range(0, n, CHUNK):
            j = min(n, i + CHUNK)
            own = np.frombuffer(p, np.uint8, max(0, min(len(p), 64 * j) - 64 * i), min(len(p), 64 * i)).astype(np.int64) + 1
            v = np.zeros((j - i, 64), np.int64)
            v.ravel()[: len(own)] = own
            mark = np.arange(i, j) % 8
            if j == n:
                mark[-1] = -1
            blocks.append(v), marks.append(mark), owner.append(k)
            held += j - i
            if held >= CHUNK:
                flush()
    flush()
    return [b"".join([*parts, b"\xff\xd9"]) for parts in out]


@dataclass
class Scan:
    parts: tuple  #: of each component: (its number, DC table, AC table)
    interval: int
    start: int
    stop: int


@dataclass
class Image:
    width: int = 0
    height: int = 0
    components: tuple = ()  #: (id, across, down, quantization table number)
    quant: dict = field(default_factory=dict)
    scans: list = field(default_factory=list)
    comment: bytes = b""
    coefficients: dict = field(default_factory=dict)  #: component: (blocks down, blocks across, 64), zigzag


def parse(data: bytes) -> Image:
    """Markers and tables of a baseline JPEG, without decoding its scans."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("no JPEG")
    image, tables, interval, at = Image(), {}, 0, 2
    while True:
        while data[at : at + 2] == b"\xff\xff":
            at += 1
        if at + 2 > len(data) or data[at] != 255:
            raise ValueError("a marker is missing")
        kind = data[at + 1]
        if kind == 0xD9:
            break
        n = int.from_bytes(data[at + 2 : at + 4], "big")
        body = data[at + 4 : at + 2 + n]
        at += 2 + n
        if kind == 0xFE:
            image.comment = body
        elif kind == 0xDB:
            while body:
                wide = 2 if body[0] >> 4 else 1
                image.quant[body[0] & 15] = np.frombuffer(body[1 : 1 + 64 * wide], ">u2" if wide == 2 else "u1").astype(np.int64)
                body = body[1 + 64 * wide :]
        elif kind in (0xC0, 0xC1):
            image.height, image.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            image.components = tuple((body[k], body[k + 1] >> 4, body[k + 1] & 15, body[k + 2]) for k in range(6, 6 + 3 * body[5], 3))
        elif 0xC2 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            raise ValueError("not a baseline image")
        elif kind == 0xC4:
            while body:
                counts = body[1:17]
                tables[body[0]] = (counts, body[17 : 17 + sum(counts)])
                body = body[17 + sum(counts) :]
        elif kind == 0xDD:
            interval = int.from_bytes(body, "big")
        elif kind == 0xDA:
            ids = [c[0] for c in image.components]
            parts = tuple((ids.index(body[k]), tables[body[k + 1] >> 4], tables[16 | body[k + 1] & 15]) for k in range(1, 1 + 2 * body[0], 2))
            stop = at
            while True:
                stop = data.find(b"\xff", stop)
                if stop < 0 or stop + 1 >= len(data):
                    raise ValueError("the scan has no end")
                if data[stop + 1] != 0 and not 0xD0 <= data[stop + 1] <= 0xD7:
                    break
                stop += 2
            image.scans.append(Scan(parts, interval, at, stop))
            at = stop
    return image


_LUTS: dict = {}


def _lookup(table: tuple[bytes, bytes]) -> np.ndarray:
    """For each 16 bits: the symbol, times 32, plus the length of its code."""
    if table not in _LUTS:
        if len(_LUTS) >= 64:
            _LUTS.clear()
        lut = np.zeros(1 << 16, np.int64)
        for symbol, code, n in codes(*table):
            lut[code << (16 - n) : (code + 1) << (16 - n)] = symbol << 5 | n
        _LUTS[table] = lut
    return _LUTS[table]


def _layout(image: Image, scan: Scan) -> tuple[list[tuple[int, int, int]], int, int]:
    """Blocks of an MCU as (part, row, column), and MCUs across and down."""
    most_h, most_v = max(c[1] for c in image.components), max(c[2] for c in image.components)
    if len(scan.parts) == 1:
        _, h, v, _ = image.components[scan.parts[0][0]]
        return [(0, 0, 0)], -(-(-(-image.width * h // most_h)) // 8), -(-(-(-image.height * v // most_v)) // 8)
    return [(k, r, c) for k, p in enumerate(scan.parts) for r in range(image.components[p[0]][2]) for c in range(image.components[p[0]][1])], -(-image.width // (8 * most_h)), -(-image.height // (8 * most_v))


def _decode_lanes(data: np.ndarray, starts: np.ndarray, mcus: np.ndarray, parts: tuple, layout: list) -> np.ndarray:
    """Coefficients (lanes, MCUs, blocks of an MCU, 64) of restart intervals, decoded in step."""
    lanes, most = len(starts), int(mcus.max(initial=0))
    out = np.zeros((lanes, most, len(layout), 64), np.int32)
    wide = np.concatenate([data, np.full(8, 255, np.uint8)]).astype(np.int64)
    w = wide[:-4] << 32 | wide[1:-3] << 24 | wide[2:-2] << 16 | wide[3:-1] << 8 | wide[4:]
    pos = starts.astype(np.int64) * 8
    last = 8 * len(data)
    predicted = np.zeros((len(parts), lanes), np.int64)
    luts = [(_lookup(dc), _lookup(ac)) for _, dc, ac in parts]

    def symbol(p: np.ndarray, lut: np.ndarray) -> tuple[np.ndarray, ...]:
        p = np.minimum(p, last)
        x = (w[p >> 3] << (p & 7)) & 0xFFFFFFFFFF
        hit = lut[x >> 24]
        return x, hit >> 5, hit & 31

    def number(x: np.ndarray, n: np.ndarray, size: np.ndarray) -> np.ndarray:
        v = (x >> (40 - n - size)) & ((1 << size) - 1)
        return np.where(v < (1 << size) >> 1, v - (1 << size) + 1, v)

    for m in range(most):
        alive = np.flatnonzero(mcus > m)
        for b, (part, _, _) in enumerate(layout):
            dc, ac = luts[part]
            x, size, n = symbol(pos[alive], dc)
            pos[alive] += n + size
            predicted[part, alive] += number(x, n, size)
            flat = out[:, m, b]
            flat[alive, 0] = predicted[part, alive]
            lane, k, p = alive, np.ones(len(alive), np.int64), pos[alive]
            while len(lane):
                x, s, n = symbol(p, ac)
                if not n.all():
                    raise ValueError("a code that no table holds")
                run, size = s >> 4, s & 15
                k += run
                coded = size > 0
                p = p + n + size
                if coded.all():
                    if k.max() > 63:
                        raise ValueError("a run beyond the block")
                    flat[lane, k] = number(x, n, size)
                    k += 1
                else:
                    c = np.flatnonzero(coded)
                    if len(c) and k[c].max() > 63:
                        raise ValueError("a run beyond the block")
                    flat[lane[c], k[c]] = number(x, n, size)[c]
                    k = np.where(coded | (run == 15), k + 1, 64)
                if k.max() > 63:
                    pos[lane] = p
                    go = np.flatnonzero(k < 64)
                    lane, k, p = lane[go], k[go], p[go]
    return out


def decode(images: list[bytes]) -> list[Image]:
    """The images with all coefficients; those with like tables are decoded together."""
    parsed = [parse(x) for x in images]
    groups: dict = {}
    for k, image in enumerate(parsed):
        for scan in image.scans:
            groups.setdefault((scan.parts, tuple(_layout(image, scan)[0])), []).append((k, scan))
    for (parts, layout), members in groups.items():
        layout = list(layout)
        bodies = [np.frombuffer(images[k], np.uint8, s.stop - s.start, s.start) for k, s in members]
        data = np.concatenate(bodies)
        first = np.cumsum([len(b) for b in bodies]) - [len(b) for b in bodies]
        ff = np.flatnonzero(data[:-1] == 255)
        ff = ff[data[ff + 1] != 255]
        follows = data[ff + 1]
        ends = ff[(follows >= 0xD0) & (follows <= 0xD7)]
        keep = np.ones(len(data), bool)
        keep[ff[follows == 0] + 1] = False
        keep[ends] = keep[ends + 1] = False
        shift = np.cumsum(keep) - keep
        raw = np.sort(np.concatenate([first, ends + 2]))
        starts = np.append(shift, int(keep.sum()))[raw]
        clean = data[keep]
        owner = np.searchsorted(first, raw, side="right") - 1
        shapes = [_layout(parsed[k], s)[1:] for k, s in members]
        total = np.array([a * d for a, d in shapes])
        interval = np.array([s.interval or a * d for (k, s), (a, d) in zip(members, shapes)])
        nth = np.arange(len(raw)) - np.searchsorted(owner, np.arange(len(members)))[owner]
        mcus = np.clip(total[owner] - nth * interval[owner], 0, interval[owner])
        pieces: list[list[np.ndarray]] = [[] for _ in members]
        step = max(1, CHUNK // max(1, int(mcus.max(initial=1)) * len(layout)))
        for i in range(0, len(raw), step):
            j = min(len(raw), i + step)
            lo, hi = int(starts[i]), int(starts[j]) if j < len(raw) else len(clean)
            got = _decode_lanes(clean[lo:hi], starts[i:j] - lo, mcus[i:j], parts, layout)
            cuts = [0, *(np.flatnonzero(np.diff(owner[i:j])) + 1).tolist(), j - i]
            for a, b in zip(cuts, cuts[1:]):
                own = got[a:b].reshape(-1, len(layout), 64)
                if got.shape[1] > 1:
                    own = own[(np.arange(got.shape[1])[None, :] < mcus[i + a : i + b, None]).ravel()]
                pieces[owner[i + a]].append(own)
        for (k, scan), (across, down), own in zip(members, shapes, pieces):
            got = np.concatenate(own) if len(own) != 1 else own[0]
            if len(got) != across * down:
                raise ValueError("a scan holds too few blocks")
            for p, (component, _, _) in enumerate(scan.parts):
                at = [b for b, (q, _, _) in enumerate(layout) if q == p]
                _, h, v, _ = parsed[k].components[component]
                if len(layout) == 1:
                    h = v = 1
                grid = got[:, at].reshape(down, across, v, h, 64).swapaxes(1, 2).reshape(down * v, across * h, 64)
                parsed[k].coefficients[component] = grid
    return parsed


def thumbnail(image: Image) -> np.ndarray:
    """One luminance sample for each block, from its DC coefficient alone."""
    q = image.quant[image.components[0][3]][0]
    return np.clip(np.rint(image.coefficients[0][:, :, 0] * q / 8) + 128, 0, 255).astype(np.uint8)


def average_hash(thumb: np.ndarray) -> int:
    """64 bits: which cells of an 8 by 8 grid are brighter than their mean."""
    rows, columns = (np.minimum(np.arange(9) * n // 8, n - 1) if n < 8 else np.arange(9) * n // 8 for n in thumb.shape)
    sums = np.zeros((thumb.shape[0] + 1, thumb.shape[1] + 1))
    sums[1:, 1:] = thumb.astype(float).cumsum(0).cumsum(1)
    lo_r, hi_r = rows[:-1], np.maximum(rows[1:], rows[:-1] + 1)
    lo_c, hi_c = columns[:-1], np.maximum(columns[1:], columns[:-1] + 1)
    area = (hi_r - lo_r)[:, None] * (hi_c - lo_c)[None, :]
    cell = (sums[np.ix_(hi_r, hi_c)] - sums[np.ix_(lo_r, hi_c)] - sums[np.ix_(hi_r, lo_c)] + sums[np.ix_(lo_r, lo_c)]) / area
    return int.from_bytes(np.packbits((cell > cell.mean()).ravel()).tobytes(), "big")


def stored_bytes(image: Image) -> bytes:
    """What :func:`encode` has put in."""
    n = int(image.comment.removeprefix(b"bytes="))
    return (image.coefficients[0].reshape(-1)[:n] - 1).astype(np.uint8).tobytes()


def _slices(batch: pa.RecordBatch, sizes: np.ndarray, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about ``most`` bytes."""
    at = 0
    total = np.cumsum(sizes)
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, side="right")))
        yield batch.slice(at, stop - at)
        at = stop


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        texts = whole.column(1).cast(pa.binary())
        sizes = np.array([len(x.as_py() or b"") if x.is_valid else 0 for x in texts], np.int64)
        at = 0
        for batch in _slices(whole, sizes):
            payloads, n = [], []
            for x in batch.column(1).cast(pa.binary()):
                b = x.as_py() or b""
                n.append(len(b))
                payloads.append(b + b"\xff" * (max(UNIT, -(-len(b) // UNIT) * UNIT) - len(b)))
            at += len(n)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(encode(payloads), pa.binary())], names=["doc_id", "n_bytes", "media"])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in _slices(whole, np.array([len(x.as_py()) for x in whole.column(2)], np.int64)):
            stored = [x.as_py() for x in batch.column(2)]
            rows = []
            for raw, image in zip(stored, decode(stored)):
                payload, thumb = stored_bytes(image), thumbnail(image)
                feature = f"{image.width}x{image.height}:{average_hash(thumb):016x}:{zlib.crc32(thumb.tobytes()):08x}"
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(raw), hashlib.sha256(raw).hexdigest(), feature, image.width, image.height))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds))],
                names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height"],
            )


def store(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_bytes, media)``: each whole text as a JPEG image."""
    return docs.select("doc_id", "text").mapInArrow(_write, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary")


def describe(media: DataFrame) -> DataFrame:
    """Checksums of what the images hold, their dimensions and thumbnail hashes."""
    schema = f"doc_id {media.schema['doc_id'].dataType.simpleString()}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, width int, height int"
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_read, schema)
