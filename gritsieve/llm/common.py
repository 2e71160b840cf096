"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gritsieve.plans.storage import materialize, shared_dir  # noqa: F401  for the operators

#: A word: a longest run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_of_id(doc_id: Column | str = "doc_id") -> Column:
    """crc32 of the id as text; a null id counts as 0 and so as held out."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")), F.lit(0))


def held_out(modulus: int, doc_id: Column | str = "doc_id") -> Column:
    return crc_of_id(doc_id) % modulus == 0


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is found once, however often ``body`` has it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: bytes | None) -> list[bytes]:
    """The words of a UTF-8 text with A-Z lower-cased; other letters stay as they are."""
    return text.lower().split() if text else []


#: Bytes of text that a worker takes up at once, unless one text has more.
PIECE = 1 << 20


def release() -> None:
    """Hands freed memory back to the system, for a worker outlives its tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        return


def pieces(batches: Iterator[pa.RecordBatch], column: int, most: int = PIECE) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows with about ``most`` bytes in a text column; memory is handed back at the end."""
    try:
        for b in batches:
            if not b.num_rows:
                continue
            size = pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 64
            cuts = np.flatnonzero(np.diff((np.cumsum(size) - size) // most)) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows]):
                yield b.slice(lo, hi - lo)
    finally:
        release()


#: Odd, so it has an inverse modulo 2**64.
_BASE = 0x9E3779B97F4A7C15
#: Bytes that are hashed at once.
_WINDOW = 1 << 16


def _powers(base: int) -> np.ndarray:
    out = np.empty(_WINDOW + 1, np.uint64)
    out[0] = 1
    out[1:] = np.uint64(base)
    return np.multiply.accumulate(out)


_UP: list[np.ndarray] = []


def _window_codes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the words of a window of bytes, and where they begin.

    The code is a polynomial in the word's bytes: a difference of running sums of bytes
    times powers, brought back to the word's own beginning by the inverse power.
    """
    blank = data == 32
    edge = np.flatnonzero(np.diff(np.concatenate([[True], blank, [True]]).astype(np.int8)))
    start, stop = edge[::2], edge[1::2]
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _UP[0][: len(data)], out=sums[1:])
    return _mixed((sums[stop] - sums[start]) * _UP[1][start]), start


def _mixed(code: np.ndarray) -> np.ndarray:
    code = code ^ (code >> np.uint64(31))
    code *= np.uint64(0xBF58476D1CE4E5B9)
    return code ^ (code >> np.uint64(29))


def _long_code(word: bytes) -> np.ndarray:
    """What :func:`_window_codes` would give of a word that is longer than a window."""
    total = 0
    for k in range(0, len(word), _WINDOW):
        data = np.frombuffer(word, np.uint8, min(_WINDOW, len(word) - k), k)
        part = int(((data.astype(np.uint64) + np.uint64(1)) * _UP[0][: len(data)]).sum(dtype=np.uint64))
        total += part * pow(_BASE, k, 1 << 64)
    return _mixed(np.array([total & 0xFFFFFFFFFFFFFFFF], np.uint64))


def word_codes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit codes of the words of all texts one after the other, and how many each has.

    Words are parted by blanks only; equal words have equal codes, in whichever process.
    """
    if not _UP:
        _UP.extend((_powers(_BASE), _powers(pow(_BASE, -1, 1 << 64))))
    joined = b" ".join(texts)
    out, begins, at = [], [], 0
    while at < len(joined):
        stop = len(joined)
        if stop - at > _WINDOW:
            stop = joined.rfind(b" ", at, at + _WINDOW) + 1  # windows end behind a blank
            if not stop:
                stop = joined.find(b" ", at + _WINDOW) + 1 or len(joined)
                out.append(_long_code(joined[at:stop].rstrip(b" "))), begins.append(np.array([at]))
                at = stop
                continue
        c, start = _window_codes(np.frombuffer(joined, np.uint8, stop - at, at))
        out.append(c), begins.append(start + at)
        at = stop
    ends = np.cumsum([len(t) + 1 for t in texts])
    begin = np.concatenate(begins) if begins else np.empty(0, np.int64)
    n = np.diff(np.searchsorted(begin, ends), prepend=0)
    return (np.concatenate(out) if out else np.empty(0, np.uint64)), n
