"""Benchmark decontamination: counts of shared word pairs, then Smith-Waterman alignment.

An alignment is a chain of matched words.  Two matches that follow each other, the second
``a`` words on in the item and ``b`` in the document, add 2 less max(a, b) - 1 to the score;
so only links with ``a`` and ``b`` of 1 or 2 add anything, 2 if both are 1 and else 1, and
the first match adds 2.  Hence a score of ``s`` needs links worth ``s - 2``, each from
another word of the item, inside a stretch of 3 m - s words (m: words of the item).  Pairs
of words one or two places apart are looked up in the documents, and (document, item) pairs
are aligned word by word where a stretch holds links enough: none with a score of ``least``
or more is lost, wherever the edits stand.  A first pass over all documents counts the
pairs, so that the commonest ones need no look-up: leaving out ``r`` words of an item lowers
what is asked of the others by 2 r.
The score is the alignment's, divided by that of the item with itself.

What is broadcast is the test set, whose words are counted first: items are dealt out into
blocks of at most ``BLOCK_WORDS`` words, and each block is held against all documents.

Words are lower-cased and parted by blanks, ASCII marks and common other marks.  Defined cases: null or wordless texts
have no hits; items that are null or have fewer than three words are not looked for; items
with equal texts are found each; rows that repeat an id are searched each, and the best
score of an (id, item) pair is returned.  Further columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gritsieve.llm.common import pieces, word_codes

#: ASCII bytes that are no letters or digits part words, A-Z are lower-cased; other marks are blanked before.
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_MARKS = re.compile("[\u00a0-\u00bf\u2000-\u206f\u3000-\u303f]")
#: Fewest words of an item.
N = 3
#: Words between linked matches, in the item and in the document.
GAPS = (1, 2)
MATCH, MISMATCH, GAP = 2, -1, -1
#: Least score of a leak.
LEAK = 0.5
BLOCK_WORDS = 2_000_000
#: Links that are weighed at once, unless one stretch has more.
MOST_LINKS = 250_000
#: Words of a text that are searched at once; longer texts are cut into stretches that overlap.
STRETCH = 1 << 16


def plain(text: str | None) -> bytes:
    """The text with a blank between words."""
    if not text:
        return b""
    if not text.isascii():
        text = _MARKS.sub(" ", text.lower())
    return text.encode().translate(_PLAIN)


def codes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Word codes of all texts one after the other, and how many each has."""
    return word_codes([plain(t) for t in texts])


def pairs(w: np.ndarray, gap: int) -> np.ndarray:
    """Codes of all pairs of words that stand ``gap`` places apart."""
    out = w[:-gap] * np.uint64(0x9E3779B97F4A7C15)
    out ^= out >> np.uint64(32)
    out = (out ^ w[gap:]) * np.uint64(0x9E3779B97F4A7C15)
    return out ^ (out >> np.uint64(32))


class Filter:
    """Finds, among many word pairs, those of a sorted table; most others fall out by one lookup."""

    BITS = 22

    def __init__(self, table: np.ndarray):
        self.table = table
        self.maybe = np.zeros(1 << self.BITS, bool)
        self.maybe[table >> np.uint64(64 - self.BITS)] = True

    def find(self, w: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Texts, table places, first words and gaps of all hits; ``w``, ``n``: what :func:`codes` gives."""
        stop, out = np.cumsum(n), []
        for gap in GAPS:
            g = pairs(w, gap)
            at = np.flatnonzero(self.maybe[g >> np.uint64(64 - self.BITS)])
            place = np.searchsorted(self.table, g[at])
            place[place == len(self.table)] = 0
            ok = self.table[place] == g[at] if len(self.table) else np.zeros(len(at), bool)
            at, place = at[ok], place[ok]
            text = np.searchsorted(stop, at, side="right")
            inside = at + gap < stop[text]
            out.append((text[inside], place[inside], at[inside], np.full(inside.sum(), gap)))
        return tuple(np.concatenate(x) for x in zip(*out))


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int]:
    """Smith-Waterman over word codes: the best score and where in the passage it ends."""
    at = np.arange(len(passage) + 1, dtype=np.int64)
    row = np.zeros(len(passage) + 1, np.int64)
    best, end = 0, 0
    for x in item:
        new = np.zeros_like(row)
        new[1:] = row[:-1] + np.where(passage == x, MATCH, MISMATCH)
        np.maximum(new, row + GAP, out=new)
        np.maximum(new, 0, out=new)
        row = np.maximum.accumulate(new - GAP * at) + GAP * at
        k = int(row.argmax())
        if row[k] > best:
            best, end = int(row[k]), k
    return best, end


class Items:
    """A block of test items with their word pairs; those that are looked up once they are chosen."""

    def __init__(self, rows: list[tuple], least: float = LEAK):
        self.ids = [i for i, _ in rows]
        self.words = [codes([t])[0] for _, t in rows]
        m = np.array([len(w) for w in self.words], np.int64)
        score = np.maximum(np.ceil(least * MATCH * m - 1e-9).astype(np.int64), 1)
        self.need = score - MATCH  #: what links must be worth
        self.span = np.maximum(3 * m - score, 1)  #: most words of an alignment with that score
        links = [(pairs(w, gap), k, gap) for k, w in enumerate(self.words) for gap in GAPS]
        n = [len(x) for x, _, _ in links]
        self.pair = np.concatenate([x for x, _, _ in links])
        self.item = np.repeat(np.array([k for _, k, _ in links], np.int32), n)
        self.gap = np.repeat(np.array([gap for _, _, gap in links], np.int8), n)
        self.place = np.concatenate([np.arange(k, dtype=np.int32) for k in n])
        self.distinct = np.unique(self.pair)

    def choose(self, frequency: np.ndarray) -> None:
        """Leaves out the commonest pairs of each item, as far as half its need; ``frequency`` goes with ``distinct``."""
        n = frequency[np.searchsorted(self.distinct, self.pair)]
        first = np.concatenate([[0], np.cumsum([len(w) for w in self.words])])
        word = first[self.item] + self.place
        total = np.bincount(word, n, first[-1])
        item = np.repeat(np.arange(len(self.ids)), np.diff(first))
        order = np.lexsort((-total, item))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order)) - first[item[order]]
        out = np.maximum(self.need, 0) // 4
        self.left = self.need - 2 * out
        order = np.flatnonzero((rank >= out[item])[word] & (self.need > 0)[self.item])
        order = order[np.argsort(self.pair[order], kind="stable")]
        self.pair, self.item, self.place, self.gap = self.pair[order], self.item[order], self.place[order], self.gap[order]
        self.seeds, self.begin = np.unique(self.pair, return_index=True)
        self.begin = np.append(self.begin, len(self.pair))

    def _stretches(self, text: np.ndarray, key: np.ndarray, at: np.ndarray, gap: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(text, item, first word, end) of the stretches with links enough; ``at`` counts from the text's beginning."""
        lo, n = self.begin[key], self.begin[key + 1] - self.begin[key]
        hit = np.repeat(np.arange(len(key)), n)
        link = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
        both = text[hit] * len(self.ids) + self.item[link]
        worth = 1 + ((self.gap[link] == 1) & (gap[hit] == 1))
        # all hits in a text first, for few items have enough of them
        which, of = np.unique(both, return_inverse=True)
        ok = (np.bincount(of, worth) >= self.left[which % len(self.ids)])[of]
        hit, link, both, worth = hit[ok], link[ok], both[ok], worth[ok]
        # windows of twice the span, beginning a span apart, hold every alignment; each word of the item counts once
        span = self.span[self.item[link]]
        window, place = at[hit] // span, self.place[link]
        before = window > 0
        both, place, worth = (np.concatenate([x, x[before]]) for x in (both, place, worth))
        window = np.concatenate([window, window[before] - 1])
        order = np.lexsort((worth, place, window, both))
        both, window, place, worth = both[order], window[order], place[order], worth[order]
        same = (np.diff(both) == 0) & (np.diff(window) == 0)
        last = np.append(~(same & (np.diff(place) == 0)), True)[: len(both)]
        group = np.cumsum(np.concatenate([[0], ~same]))[: len(both)]
        total = np.bincount(group, worth * last)
        begin = np.flatnonzero(np.diff(group, prepend=-1))
        good = begin[total >= self.left[both[begin] % len(self.ids)]]
        cut = np.flatnonzero((np.diff(both[good]) != 0) | (np.diff(window[good]) > 1)) + 1
        for a, b in zip([0, *cut], [*cut, len(good)]) if len(good) else []:
            t, i = divmod(int(both[good[a]]), len(self.ids))
            yield t, i, int(window[good[a]] * self.span[i]), int((window[good[b - 1]] + 2) * self.span[i])

    def search(self, table: Filter, w: np.ndarray, n: np.ndarray) -> Iterator[tuple[int, int, float, int, int]]:
        """(text, item, score, first word, number of words) of the best passage of an item in a text.

        All passages with the least score or more are among them.  ``table`` is the filter of ``seeds``.
        """
        over = 2 * int(self.span.max(initial=1))
        most = max(STRETCH, 4 * over)
        if n.max(initial=0) <= most:
            yield from self._search(table, w, n)
            return
        for t, (start, k) in enumerate(zip(np.cumsum(n) - n, n)):
            best: dict[int, tuple[float, int, int]] = {}
            for first in range(0, max(1, int(k) - over), most - over):  # an alignment lies in one stretch
                part = w[start + first : start + min(first + most, k)]
                for _, i, score, begin, words in self._search(table, part, np.array([len(part)])):
                    if score > best.get(i, (0.0,))[0]:
                        best[i] = (score, first + begin, words)
            yield from ((t, i, *v) for i, v in sorted(best.items()))

    def _search(self, table: Filter, w: np.ndarray, n: np.ndarray) -> Iterator[tuple[int, int, float, int, int]]:
        start = np.cumsum(n) - n
        text, key, at, gap = table.find(w, n)
        order = np.argsort(text, kind="stable")
        text, key, at, gap = text[order], key[order], at[order] - start[text[order]], gap[order]
        found = [(t, i, 0, int(n[t])) for i in np.flatnonzero(self.need <= 0).tolist() for t in np.flatnonzero(n).tolist()]
        held = np.cumsum(self.begin[key + 1] - self.begin[key])
        a = 0
        while a < len(text):
            b = int(np.searchsorted(held, (held[a - 1] if a else 0) + MOST_LINKS, side="right"))
            b = max(int(np.searchsorted(text, text[min(b, len(text) - 1)])), int(np.searchsorted(text, text[a], side="right"))) if b < len(text) else b
            found += self._stretches(text[a:b], key[a:b], at[a:b], gap[a:b])
            a = b
        best: dict[tuple[int, int], tuple[float, int, int]] = {}
        for t, i, first, stop in found:
            m = len(self.words[i])
            score, end = align(self.words[i], w[start[t] + first : start[t] + min(stop, n[t])])
            if score / (MATCH * m) > best.get((t, i), (0.0,))[0]:
                begin = max(0, first + end - max(m + m // 2, 3 * m - score))
                best[t, i] = (score / (MATCH * m), begin, first + end - begin)
        return ((t, i, *v) for (t, i), v in sorted(best.items()))


def blocks(benchmark: DataFrame, least: float) -> Iterator[Items]:
    """The test items in blocks of a bounded number of words."""
    rows, n = [], 0
    for r in benchmark.filter("text is not null").select("item_id", "text").toLocalIterator():
        k = len(plain(r.text).split())
        if k < N:
            continue
        if rows and n + k > BLOCK_WORDS:
            yield Items(rows, least)
            rows, n = [], 0
        rows.append((r.item_id, r.text))
        n += k
    if rows:
        yield Items(rows, least)


def _frequencies(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Filter(shared.value)
        count = np.zeros(len(table.table), np.int64)
        for batch in pieces(batches, 0):
            np.add.at(count, table.find(*codes(batch.column(0).to_pylist()))[1], 1)
        at = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(count[at])], names=["at", "n"])

    return run


def seeded(docs: DataFrame, benchmark: DataFrame, least: float) -> list:
    """Broadcasts of the blocks of items, without the pairs that are commonest in ``docs``.

    The driver holds a block at a time; those broadcast are files.
    """
    spark, out = docs.sparkSession, []
    for b in blocks(benchmark, least):
        shared = spark.sparkContext.broadcast(b.distinct)
        got = docs.select("text").mapInArrow(_frequencies(shared), "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
        n = np.zeros(len(b.distinct), np.int64)
        n[got["at"].to_numpy()] = got["n"].to_numpy()
        b.choose(n)
        out.append(spark.sparkContext.broadcast(b))
    return out


def _leaks(shared, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        table = Filter(items.seeds)
        for batch in pieces(batches, 1):
            found = [x for x in items.search(table, *codes(batch.column(1).to_pylist())) if x[2] >= least]
            k = pa.array([x[0] for x in found], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(k), pa.array([items.ids[x[1]] for x in found], pa.int64()), *(pa.array([x[j] for x in found], t) for j, t in ((2, pa.float64()), (3, pa.int64()), (4, pa.int64())))],
                names=["doc_id", "item_id", "score", "first_word", "n_words"],
            )

    return run


def leaks(docs: DataFrame, benchmark: DataFrame, least: float = LEAK) -> DataFrame:
    """``(doc_id, item_id, score, first_word, n_words)``: which test items stand in which documents."""
    schema = "doc_id long, item_id long, score double, first_word long, n_words long"
    slim, out = docs.select(F.col("doc_id").cast("long"), "text"), None
    for shared in seeded(docs, benchmark, least):
        part = slim.mapInArrow(_leaks(shared, least), schema)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return docs.sparkSession.createDataFrame([], schema)
    best = out.groupBy("doc_id", "item_id").agg(F.max(F.struct("score", F.negative("first_word").alias("f"), "n_words")).alias("m"))
    return best.select("doc_id", "item_id", "m.score", F.negative("m.f").alias("first_word"), "m.n_words")


def decontaminate(docs: DataFrame, benchmark: DataFrame, least: float = LEAK) -> DataFrame:
    """``docs`` without the rows that hold a test item."""

    def clean(shared, at: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = shared.value
            table = Filter(items.seeds)
            for batch in pieces(batches, at):
                clean = np.ones(batch.num_rows, bool)
                clean[[x[0] for x in items.search(table, *codes(batch.column(at).to_pylist())) if x[2] >= least]] = False
                yield batch.filter(pa.array(clean))

        return run

    for shared in seeded(docs, benchmark, least):
        docs = docs.mapInArrow(clean(shared, docs.columns.index("text")), docs.schema)
    return docs
