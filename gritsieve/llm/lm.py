"""Language-model scores by a hierarchical Pitman-Yor model of word pairs.

Every word of the training texts has a context restaurant of its own; all of them share one
parent, the root restaurant, whose base is uniform over the training words and one unknown
word.  Every training token is a customer of the restaurant of the word before it; the
tables there are the root's customers.  Seatings are kept as numbers of tables.

A Gibbs sweep visits the dishes of a restaurant in up to ``TURNS`` turns (one by one, where
it has no more repeated dishes) and draws a dish's number of tables anew given all others:
``PARTICLES`` times its customers are seated by the Chinese restaurant process, with an eye
to those who follow, and one of the seatings is taken by its importance weight.  Customers are seated one by one or, after
the first ones, in groups that grow with the number seated (:func:`groups`); this is one
rule for all counts.  The strength is drawn from a grid after each sweep, the discount comes
from the numbers of single and double customers.  Predictive probabilities are averaged over
the sweeps after the burn-in.  While contexts are swept, the parent's probability of a word
is its count times the share of customers of like words that have opened tables; then the
root is seated with the tables of all contexts.

How it is spread: texts are cut into chunks of about ``CHUNK`` tokens, which hold 64-bit
codes of words.  A chunk asks the wards, that is ranges of context codes, for its distinct
pairs, and the word ranges for its distinct words; answers come back in the order of the
questions and are joined by chunk.  So a pair or word moves once for each chunk that has it,
however often it occurs, and no row belongs to a single hot word.  A context with more than
``WARD`` customers is dealt out by dish to several wards; each takes its own tables as a
fair share of the context's.  What is gathered grows with the corpus: all its pairs and words.
The driver holds totals and about ``HOT`` commonest words; of all others, wards are told
the exact counts with the pairs, so how many are held bears on no result.

Defined cases: a null or blank text has one token, the end.  A null id is held out.  Rows
that repeat an id are scored each.  With no training rows all probabilities are uniform over
what is known, which is the unknown word.  Texts of any length are scored whole.  Further
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from gritsieve.llm.common import materialize, pieces, release, word_codes
from gritsieve.plans.storage import drop

CHUNK = WARD = 1 << 21
#: About as many commonest words have their counts held by all tasks; those of the others travel with the pairs.
HOT = 100_000
BURN_IN, SAMPLES, PARTICLES, TURNS = 1, 3, 4, 16
#: Strengths that are tried.
GRID = 2.0 ** np.arange(-6, 13)
#: The code of the end of a text, which is also the context of its first word.
END = np.uint64(0x5851F42D4C957F2D)
#: A-Z are lower-cased, ASCII white space becomes blanks.
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else 32 if 9 <= c <= 13 else c for c in range(256))
ROWS = "kind int, part long, chunk long, a binary, b binary, c binary"
WORDS, PAIRS, TEXTS, ROOT, HALLS, TOLD = range(6)


_ZSTD = pa.Codec("zstd", compression_level=1)


def packed(x: np.ndarray) -> bytes:
    """An array's length in bytes and its bytes, compressed, for they lie on disk and travel.

    Numbers whose upper bytes are alike take less room byte by byte; the length's last byte then
    tells how many bytes a number has.
    """
    raw = np.ascontiguousarray(x).view(np.uint8)
    if not len(raw):
        return bytes(8)
    out, size = _ZSTD.compress(raw, asbytes=True), 0
    if x.dtype.itemsize > 1:
        planes = _ZSTD.compress(np.ascontiguousarray(raw.reshape(-1, x.dtype.itemsize).T).reshape(-1), asbytes=True)
        if len(planes) < len(out):
            out, size = planes, x.dtype.itemsize
    return len(raw).to_bytes(7, "little") + bytes([size]) + out


def unpacked(x, dtype) -> np.ndarray:
    """What :func:`packed` has packed, from bytes or a buffer."""
    x = memoryview(x)
    n, size = int.from_bytes(x[:7], "little"), x[7]
    if not n:
        return np.empty(0, dtype)
    raw = np.frombuffer(_ZSTD.decompress(x[8:], decompressed_size=n), np.uint8)
    return (np.ascontiguousarray(raw.reshape(size, -1).T).reshape(-1) if size else raw).view(dtype)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Of positive numbers, by Stirling's series after a shift."""
    x = np.asarray(x, float)
    shift = np.zeros_like(x)
    y = x.copy()
    for _ in range(7):
        low = y < 7
        shift = np.where(low, shift - np.log(y), shift)
        y = np.where(low, y + 1, y)
    z = 1 / (y * y)
    return shift + (y - 0.5) * np.log(y) - y + 0.9189385332046727 + (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z / 1680))) / y


def discount(customers: np.ndarray) -> float:
    singles, doubles = np.count_nonzero(customers == 1), np.count_nonzero(customers == 2)
    return float(np.clip(singles / max(singles + 2 * doubles, 1), 0.05, 0.95)) if singles + doubles else 0.5


def draw_strength(customers: np.ndarray, tables: np.ndarray, d: float, rng: np.random.Generator) -> float:
    """From its conditional on a grid, given every restaurant's customers and tables."""
    more = customers > 1
    if not more.any():
        return 1.0
    # most restaurants have the same few numbers
    kinds, first, n = np.unique(customers[more].astype(np.int64) * 0x9E3779B97F4A7C1 + tables[more].astype(np.int64), return_index=True, return_counts=True)
    c, t = customers[more][first].astype(float), tables[more][first].astype(float)
    s = GRID[:, None]
    like = ((log_gamma(s / d + t) - log_gamma(s / d + 1) - log_gamma(s + c) + log_gamma(s + 1)) * n).sum(axis=1)
    return float(GRID[int(np.argmax(like + rng.gumbel(size=len(GRID))))])


def groups(most: int) -> Iterator[tuple[int, int]]:
    """(customers seated, size of the next group) up to ``most`` customers: one by one up to 24, then a twelfth."""
    n = 1
    while n < most:
        size = max(1, n // 12)
        yield n, size
        n += size


def draw_tables(c: np.ndarray, alpha: np.ndarray, delta: np.ndarray, d: float, rng: np.random.Generator, particles: int = PARTICLES) -> np.ndarray:
    """Numbers of tables of dishes with ``c`` customers.

    A new table has the mass ``alpha + delta * tables``, the old ones ``customers - d * tables``.
    """
    order = np.argsort(-c, kind="stable")
    c, alpha, delta = c[order], alpha[order], delta[order]
    out = np.ones((particles, len(c)), np.int64)
    weight = np.zeros((particles, len(c)))
    for n, size in groups(int(c.max(initial=1))):
        k = int(np.searchsorted(-c, -n, side="left"))  # those with more than n customers
        step = np.minimum(size, c[:k] - n)
        t = out[:, :k]
        middle = n + (step - 1) / 2
        # a further table makes all that follow less likely, about by this factor
        level = alpha[:k] - (d - delta[:k]) * t
        later = ((middle + 1 + level) / (c[:k] + level)) ** (d - delta[:k])
        fresh = (alpha[:k] + delta[:k] * t) * later
        total = np.maximum(middle - d * t, 1e-9) + fresh
        p = fresh / total
        more = rng.random(p.shape) < p if size == 1 else rng.binomial(np.broadcast_to(step, p.shape), p)
        weight[:, :k] += step * np.log(total) - more * np.log(later)
        t += more
    best = np.argmax(weight + rng.gumbel(size=weight.shape), axis=0) if particles > 1 else np.zeros(len(c), int)
    t = np.empty(len(c), np.int64)
    t[order] = np.minimum(out[best, np.arange(len(c))], c)
    return t


@dataclass
class Known:
    """What all tasks know: the commonest words, sorted by code, with their counts; totals."""

    codes: np.ndarray
    counts: np.ndarray
    total: int  #: training tokens
    distinct: int
    wards: int  #: bits
    bands: np.ndarray | None = None  #: tokens of all words by the whole logarithm of the word's count; None if ``codes`` has all words

    def mass(self) -> np.ndarray:
        if self.bands is not None:
            return self.bands.astype(float)
        return np.bincount(np.log2(np.maximum(self.counts, 1)).astype(np.int64), self.counts, 64) if len(self.counts) else np.zeros(64)

    def count(self, words: np.ndarray) -> np.ndarray:
        """0 for words that aren't held; none of these has ``WARD`` tokens."""
        out = np.zeros(len(words))
        if len(self.codes):
            at = np.minimum(np.searchsorted(self.codes, words), len(self.codes) - 1)
            ok = self.codes[at] == words
            out[ok] = self.counts[at[ok]]
        return out

    def rooms(self, contexts: np.ndarray) -> np.ndarray:
        """To how many wards each context is dealt out."""
        return np.clip(np.ceil(self.count(contexts) / WARD).astype(np.int64), 1, 1 << self.wards)

    def ward(self, contexts: np.ndarray, rooms: np.ndarray, words: np.ndarray) -> np.ndarray:
        room = (words >> np.uint64(20)) % rooms.astype(np.uint64)
        mixed = contexts + room * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.wards)).astype(np.int64) if self.wards else np.zeros(len(contexts), np.int64)


def sweep(c: np.ndarray, rest: np.ndarray, words: np.ndarray, rooms: np.ndarray, known: Known, rng: np.random.Generator, told: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, float, float]:
    """Tables of a ward's pairs: of the last sweep and averaged; discount and strength.

    ``c``: customers of each pair; ``rest``: its restaurant (sorted, from 0); ``rooms``: of each restaurant;
    ``told``: counts of those words that ``known`` doesn't hold.
    """
    d = discount(c)
    t = np.minimum(c, 1)
    size = len(rooms)
    customers = np.bincount(rest, c, size)
    seen = known.count(words) if told is None else np.maximum(known.count(words), told)
    band = np.log2(np.maximum(seen, 1)).astype(np.int64) * (c > 0)
    in_band = np.bincount(band, c, 64)
    mass = known.mass()
    many = np.flatnonzero(c > 1)
    first = np.searchsorted(rest[many], rest[many])
    turn = (np.arange(len(many)) - first) % TURNS
    turns = [many[turn == k] for k in range(min(TURNS, int(turn.max(initial=-1)) + 1))]
    room = np.bincount(rest, t, size)
    mean, theta = np.zeros(len(c)), 1.0
    for k in range(BURN_IN + SAMPLES):
        opened = np.bincount(band, t, 64) / np.maximum(in_band, 1)
        opened[in_band == 0] = 1
        share = opened / max(float((mass * opened).sum()), 1e-300)
        for own in turns:
            h = np.minimum(seen[own] * share[band[own]], 1.0)
            others = theta + d * (rooms[rest[own]] * room[rest[own]] - t[own])
            alpha, delta = h * others, h * d
            twice = c[own] == 2
            new = np.ones(len(own), np.int64)
            new[twice] += rng.random(int(twice.sum())) * (1 - d + alpha[twice] + delta[twice]) < alpha[twice] + delta[twice]
            more = ~twice
            new[more] = draw_tables(c[own][more], alpha[more], delta[more], d, rng)
            np.add.at(room, rest[own], new - t[own])
            t[own] = new
        theta = draw_strength(customers, room, d, rng)
        if k >= BURN_IN:
            mean += t
    return t, mean / SAMPLES, d, theta


# chunks


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids, out, n, at = [], [], 0, TaskContext.get().partitionId() << 32

    def chunk() -> pa.RecordBatch:
        held, sizes, tokens = (np.concatenate([x[k] for x in out]) for k in range(3))
        codes, index = np.unique(tokens, return_inverse=True)
        counts = np.bincount(index[np.repeat(~held, sizes)], minlength=len(codes)).astype(np.int32)
        one = lambda x: pa.array([packed(x)], pa.binary())
        listed = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
        whole = pa.concat_arrays(ids)
        return pa.RecordBatch.from_arrays([pa.array([at]), listed(whole), one(held), one(sizes.astype(np.int32)), one(codes), one(counts), one(index.astype(np.int32))], names=["chunk", "ids", "held", "sizes", "codes", "counts", "tokens"])

    for batch in pieces(batches, 1):
        w, sizes = word_codes([(t or b"").translate(_PLAIN) for t in batch.column(1).cast(pa.binary()).to_pylist()])
        ids.append(batch.column(0))
        out.append((batch.column(2).to_numpy(zero_copy_only=False), sizes + 1, np.insert(w, np.cumsum(sizes), END)))
        n += len(w) + len(sizes)
        if n >= CHUNK:
            yield chunk()
            ids, out, n, at = [], [], 0, at + 1
    if out:
        yield chunk()


def chunks(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, held_out) as chunks of token indices into sorted word codes."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", "held_out").mapInArrow(_chunks, f"chunk long, ids array<{kind}>, held binary, sizes binary, codes binary, counts binary, tokens binary")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["kind", "part", "chunk", "a", "b", "c"])


def _column(batch: pa.RecordBatch, name: str, row: int, dtype) -> np.ndarray:
    return unpacked(batch.column(batch.schema.get_field_index(name))[row].as_buffer(), dtype)


def _cuts(codes: np.ndarray, bits: int) -> list[int]:
    """Where ranges of the codes' top bits begin, in sorted codes, and the end."""
    return [0, *np.searchsorted(codes, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)).tolist(), len(codes)] if bits else [0, len(codes)]


def _ask_words(bits: int) -> Callable:
    """Rows (word range, chunk, codes, counts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                codes, counts, chunk = _column(batch, "codes", k, np.uint64), _column(batch, "counts", k, np.int32), batch.column(0)[k].as_py()
                cut = _cuts(codes, bits)
                yield _rows([(WORDS, part, chunk, packed(codes[i:j]), packed(counts[i:j]), None) for part, (i, j) in enumerate(zip(cut, cut[1:])) if j > i])
        release()

    return run


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """Runs of rows of one part; a row is (kind, part, chunk, a, b, c)."""

    def rows() -> Iterator[tuple]:
        for batch in batches:
            for k in range(batch.num_rows):
                yield tuple(batch.column(i)[k].as_py() for i in range(3)) + tuple(batch.column(i)[k].as_buffer() for i in range(3, 6))

    for value, own in groupby(rows(), lambda r: r[1]):
        yield value, list(own)


def _dealt(rows: DataFrame, parts: int) -> DataFrame:
    """Each part in a task of its own, by chunk."""
    return rows.repartitionById(parts, F.col("part").cast("int")).sortWithinPartitions("part", "kind", "chunk")


def _sum_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (range, words, counts, how many words have a count with a like logarithm), and the counts for each chunk."""
    for part, rows in _grouped(batches):
        codes, at = np.unique(np.concatenate([unpacked(r[3], np.uint64) for r in rows]), return_inverse=True)
        asked = [unpacked(r[4], np.int32) for r in rows]
        n = np.bincount(at, np.concatenate(asked)).astype(np.int64)
        end = np.cumsum([len(x) for x in asked])
        yield _rows([(TOLD, part, r[2], packed(n[at[j - len(x) : j]]), None, None) for r, x, j in zip(rows, asked, end)])
        codes, n = codes[n > 0], n[n > 0]
        steps = np.bincount((8 * np.log2(n)).astype(np.int64), minlength=512) if len(n) else np.zeros(512, np.int64)
        yield _rows([(WORDS, part, len(codes), packed(codes), packed(n), packed(steps.astype(np.int64)))])
    release()


def _commonest(least: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                codes, n = _column(batch, "a", k, np.uint64), _column(batch, "b", k, np.int64)
                keep = n >= least
                yield pa.RecordBatch.from_arrays([pa.array(codes[keep].view(np.int64)), pa.array(n[keep])], names=["code", "n"])

    return run


def _bits(n: float) -> int:
    return max(3, int(np.ceil(np.log2(max(n, 1)))))


def counted(chunked: DataFrame, bits: int) -> DataFrame:
    """The training words' counts by ranges, and what each chunk is told of its own words."""
    return materialize(_dealt(chunked.select("chunk", "codes", "counts").mapInArrow(_ask_words(bits), ROWS), 1 << bits).mapInArrow(_sum_words, ROWS))


def known(chunked: DataFrame, bits: int, ranges: DataFrame | None = None) -> Known:
    """Totals and commonest words of the training texts; what reaches the driver is bounded by ``HOT`` and 512 sums a range."""
    words = (counted(chunked, bits) if ranges is None else ranges).filter(F.col("kind") == WORDS)
    steps, distinct = np.zeros(512, np.int64), 0
    for r in words.select("chunk", "c").toLocalIterator():
        steps += unpacked(r.c, np.int64)
        distinct += r.chunk
    held = np.cumsum(steps[::-1])[::-1]
    least = 2.0 ** (int(np.argmax(held <= HOT)) / 8)
    got = words.select("a", "b").mapInArrow(_commonest(min(least, WARD)), "code long, n long").toArrow()
    bands = np.zeros(64, np.int64)
    for r in words.select("b").mapInArrow(_bands, "band int, n long").groupBy("band").agg(F.sum("n").alias("n")).collect():  # 64 at most
        bands[r.band] = r.n
    total = int(bands.sum())
    codes, n = got["code"].to_numpy().view(np.uint64), got["n"].to_numpy()
    order = np.argsort(codes)
    return Known(codes[order], n[order], total, distinct, _bits(total / WARD), bands)


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            n = _column(batch, "b", k, np.int64)
            sums = np.zeros(64, np.int64)
            np.add.at(sums, np.log2(n).astype(np.int64), n)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(64, dtype=np.int32)), pa.array(sums)], names=["band", "n"])


# pairs


def _sorted(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys (0 at least) and where each was; as single numbers, if key and place fit into one."""
    shift = len(key).bit_length()
    if len(key) and int(key.max()).bit_length() + shift > 63:
        order = np.argsort(key, kind="stable")
        return key[order], order
    both = np.sort(key << shift | np.arange(len(key)))
    return both >> shift, both & ((1 << shift) - 1)


class Asked:
    """The distinct pairs of a chunk in the order in which wards are asked for them."""

    def __init__(self, codes: np.ndarray, tokens: np.ndarray, k: Known):
        n = len(codes)
        before = np.empty(len(tokens), np.int64)
        before[0] = np.searchsorted(codes, END)
        before[1:] = tokens[:-1]
        key, order = _sorted(before * n + tokens)
        new = np.diff(key, prepend=-1) != 0
        self.pair = np.empty(len(key), np.int64)  #: which pair each token ends
        self.pair[order] = np.cumsum(new) - 1
        self.context, self.word = np.divmod(key[new], n)
        del before, key, order, new
        ward = k.ward(codes[self.context], k.rooms(codes)[self.context], codes[self.word])
        if k.wards <= 16:
            ward = ward.astype(np.uint16)  # sorts faster
        self.order = np.argsort(ward, kind="stable")
        self.cut = np.searchsorted(ward[self.order], np.arange((1 << k.wards) + 1))
        self.wards = 1 << k.wards

    def runs(self, ward: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of a ward's pairs, where its contexts begin among them, and which contexts these are."""
        own = self.order[self.cut[ward] : self.cut[ward + 1]]
        context = self.context[own]
        begin = np.flatnonzero(np.diff(context, prepend=-1))
        return own, begin, context[begin]


def _ask_pairs(shared) -> Callable:
    """Rows (ward, chunk, contexts and how many pairs each has, words, counts of the pairs and of the words that not all tasks hold).

    The words' counts come in ``told``, by ranges; without it all words must be held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                codes, tokens = _column(batch, "codes", k, np.uint64), _column(batch, "tokens", k, np.int32).astype(np.int64)
                train = np.repeat(~_column(batch, "held", k, bool), _column(batch, "sizes", k, np.int32))
                told = np.zeros(len(codes), np.int32)
                if "told" in batch.schema.names:
                    n = np.concatenate([unpacked(x.as_buffer(), np.int64) for x in batch.column(batch.schema.get_field_index("told"))[k].values])
                    told = np.where(shared.value.count(codes) > 0, 0, n).astype(np.int32)  # below WARD
                asked = Asked(codes, tokens, shared.value)
                count = np.bincount(asked.pair[train], minlength=len(asked.word)).astype(np.int32)
                for ward in range(asked.wards):
                    own, begin, context = asked.runs(ward)
                    if len(own):
                        head = packed(np.concatenate([codes[context], np.diff(np.append(begin, len(own))).astype(np.uint64)]))
                        yield _rows([(PAIRS, ward, batch.column(0)[k].as_py(), head, packed(codes[asked.word[own]]), packed(np.concatenate([count[own], told[asked.word[own]]])))])
                del asked, tokens, train, count, told
        release()

    return run


def _seat(shared, bits: int) -> Callable:
    """Answers (chunk, masses of pairs, contexts' masses for the parent, strength) and, for the root, (word range, words, customers without a table)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = shared.value
        for ward, rows in _grouped(batches):
            heads = [unpacked(r[3], np.uint64) for r in rows]
            heads = [(h[: len(h) // 2], h[len(h) // 2 :].view(np.int64)) for h in heads]
            every, rank = np.unique(np.concatenate([u for u, _ in heads]), return_inverse=True)
            context = np.repeat(rank, np.concatenate([n for _, n in heads]))
            word = np.concatenate([unpacked(r[4], np.uint64) for r in rows])
            both = [unpacked(r[5], np.int32).reshape(2, -1) for r in rows]
            count, told = (np.concatenate([x[j] for x in both]) for j in (0, 1))
            # inside a context, words are told apart by the upper bits that there is room for, 40 or more
            room = 63 - len(every).bit_length()
            key = context << room | (word >> np.uint64(64 - room)).astype(np.int64)
            order = np.argsort(key)
            new = np.diff(key[order], prepend=-1) != 0
            at = np.flatnonzero(new)
            c = np.add.reduceat(count[order].astype(np.int64), at)
            rest, w, told = context[order][at], word[order][at], told[order][at]
            pair = np.empty(len(order), np.int64)
            pair[order] = np.cumsum(new) - 1
            u = every
            del context, word, count, both, key, order, new, at, rank
            rooms = k.rooms(u)
            t, mean, d, theta = sweep(c, rest, w, rooms, k, np.random.default_rng(ward), told)
            mass = (c - d * mean).astype(np.float32)
            fresh = theta / rooms + d * np.bincount(rest, mean, len(u))
            begin = 0
            for r, (own, n) in zip(rows, heads):
                yield _rows([(PAIRS, ward, r[2], packed(mass[pair[begin : begin + n.sum()]]), packed(fresh[np.searchsorted(u, own)].astype(np.float32)), packed(np.array([theta])))])
                begin += int(n.sum())
            lost = c > t
            words, of = np.unique(w[lost], return_inverse=True)
            gone = np.bincount(of, (c - t)[lost], len(words)).astype(np.int64)
            cut = _cuts(words, bits)
            yield _rows([(ROOT, part, ward, packed(words[i:j]), packed(gone[i:j]), None) for part, (i, j) in enumerate(zip(cut, cut[1:])) if j > i])
            dealt = rooms > 1
            if dealt.any():
                whole = theta / rooms + np.bincount(rest, c, len(u))
                yield _rows([(HALLS, ward, 0, packed(u[dealt]), packed(whole[dealt]), packed(fresh[dealt]))])
        release()

    return run


# the root and the scores


def _seat_root(total: int, distinct: int) -> Callable:
    """Answers (chunk, counts, masses at the root) and one row of sums for each word range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in _grouped(batches):
            asks = [(r[2], unpacked(r[3], np.uint64), unpacked(r[4], np.int32)) for r in rows if r[0] == WORDS]
            codes, at = np.unique(np.concatenate([x[1] for x in asks]), return_inverse=True)
            n = np.bincount(at, np.concatenate([x[2] for x in asks])).astype(np.int64)
            customers = n.copy()
            for r in rows:
                if r[0] == ROOT:
                    customers[np.searchsorted(codes, unpacked(r[3], np.uint64))] -= unpacked(r[4], np.int64)
            d, rng = discount(customers), np.random.default_rng(part)
            tables = np.minimum(customers, 1)
            many = customers > 1
            h = np.full(int(many.sum()), 1 / (distinct + 1))  # every word has a table at least, so the root has about as many
            tables[many] = draw_tables(customers[many], h * (1 + d * distinct), h * d, d, rng)
            mass = (customers - d * tables).astype(np.float64)
            begin = 0
            for chunk, own, _ in asks:
                place = at[begin : begin + len(own)]
                yield _rows([(WORDS, part, chunk, packed(n[place].astype(np.int64)), packed(mass[place].astype(np.float32)), None)])
                begin += len(own)
            yield _rows([(ROOT, part, 0, packed(np.array([customers.sum(), tables.sum(), d * tables.sum()], float)), None, None)])
        release()

    return run


def _halls(seated: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Contexts that are dealt out, sorted, with their masses summed over wards; a context for each ``WARD`` tokens at most."""
    got: dict[int, np.ndarray] = {}
    for r in seated.filter(F.col("kind") == HALLS).select("a", "b", "c").toLocalIterator():
        for u, whole, fresh in zip(unpacked(r.a, np.uint64).tolist(), unpacked(r.b, float), unpacked(r.c, float)):
            got[u] = got.get(u, 0) + np.array([whole, fresh])
    codes = np.array(sorted(got), np.uint64)
    masses = np.array([got[u] for u in sorted(got)]).reshape(-1, 2)
    return codes, masses[:, 0], masses[:, 1]


def root_strength(customers: float, tables: float, d: float) -> float:
    return draw_strength(np.array([customers]), np.array([tables]), d, np.random.default_rng(1)) if customers > 1 else 1.0


def _score(shared, kind: pa.DataType) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, halls, theta, spread, customers = shared.value

        def rows() -> Iterator[dict]:
            for batch in batches:
                for i in range(batch.num_rows):
                    yield {n: batch.column(j)[i] for j, n in enumerate(batch.schema.names)}

        for _, own in groupby(rows(), lambda r: r["chunk"].as_py()):
            words, pairs, text = [], {}, None
            for r in own:
                what = r["kind"].as_py()
                if what == WORDS:  # sorted by range
                    words.append((unpacked(r["a"].as_buffer(), np.int64), unpacked(r["b"].as_buffer(), np.float32)))
                elif what == PAIRS:
                    pairs[r["part"].as_py()] = tuple(unpacked(r[n].as_buffer(), t) for n, t in (("a", np.float32), ("b", np.float32), ("c", np.float64)))
                else:
                    text = r
            held, sizes = unpacked(text["a"].as_buffer(), bool), unpacked(text["b"].as_buffer(), np.int32).astype(np.int64)
            tokens, codes = unpacked(text["c"].as_buffer(), np.int32).astype(np.int64), unpacked(text["d"].as_buffer(), np.uint64)
            count, root = (np.concatenate([x[j] for x in words]) for j in (0, 1))
            root = root.astype(float)
            parent = (root + (theta + spread) / (k.distinct + 1)) / (theta + customers)
            base = np.log10((count + 0.1) / (k.total + 0.1 * (k.distinct + 1)))
            asked = Asked(codes, tokens, k)
            mass = np.empty(len(asked.word))
            whole, fresh = np.zeros(len(codes)), np.zeros(len(codes))
            for ward, (m, b, strength) in pairs.items():
                place, _, context = asked.runs(ward)
                mass[place], fresh[context] = m, b
                whole[context] = strength + count[context]  # as many customers as the word before them has tokens
            hall = np.searchsorted(codes, halls[0])
            here = (hall < len(codes)) & (codes[np.minimum(hall, len(codes) - 1)] == halls[0])
            whole[hall[here]], fresh[hall[here]] = halls[1][here], halls[2][here]
            p = np.log10((mass + fresh[asked.context] * parent[asked.word]) / whole[asked.context])
            p = p[asked.pair]
            begin = np.cumsum(sizes) - sizes
            add = lambda x: np.add.reduceat(x, begin)
            yield pa.RecordBatch.from_arrays(
                [text["ids"].values.cast(kind), pa.array(held), pa.array(sizes), pa.array(add((count > 0)[tokens].astype(np.int64))), pa.array(np.full(len(sizes), k.total, np.int64)), pa.array(add(base[tokens])), pa.array(add(p))],
                names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )
            del asked, words, pairs, text, tokens, codes, mass, p
        release()

    return run


def score(docs: DataFrame, held_out) -> DataFrame:
    """Learns from the rows that aren't ``held_out`` (a condition) and scores all.

    ``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` for each of ``docs``.
    """
    spark = docs.sparkSession
    chunked = materialize(chunks(docs.select("doc_id", "text").withColumn("held_out", held_out)))
    words, n, most = chunked.agg(F.coalesce(F.sum(F.octet_length("codes") / 8), F.lit(0)), F.count("*"), F.max(F.col("chunk").bitwiseAND(F.lit(0xFFFFFFFF)))).first()
    bits = _bits(words / WARD)
    ranges = counted(chunked, bits)
    k = known(chunked, bits, ranges)
    told = ranges.filter(F.col("kind") == TOLD).groupBy("chunk").agg(F.transform(F.array_sort(F.collect_list(F.struct("part", "a"))), lambda x: x["a"]).alias("told"))
    first, chunked = chunked, materialize(chunked.join(told, "chunk"))
    drop(first)
    drop(ranges)
    shared = spark.sparkContext.broadcast(k)
    asks = chunked.select("chunk", "held", "sizes", "codes", "tokens", "told").mapInArrow(_ask_pairs(shared), ROWS)
    seated = materialize(_dealt(asks, 1 << k.wards).mapInArrow(_seat(shared, bits), ROWS))
    asks = chunked.select("chunk", "codes", "counts").mapInArrow(_ask_words(bits), ROWS).unionByName(seated.filter(F.col("kind") == ROOT))
    rooted = materialize(_dealt(asks, 1 << bits).mapInArrow(_seat_root(k.total, k.distinct), ROWS))
    sums = np.zeros(3)
    for r in rooted.filter(F.col("kind") == ROOT).select("a").toLocalIterator():  # a row for each word range
        sums += unpacked(r.a, float)
    customers, tables, spread = sums
    totals = spark.sparkContext.broadcast((k, _halls(seated), root_strength(customers, tables, spread / tables if tables else 0.5), spread, customers))
    kind = docs.schema["doc_id"].dataType.simpleString()
    nothing = F.lit(None).cast("binary")
    texts = chunked.select(F.lit(TEXTS).alias("kind"), F.lit(0).cast("long").alias("part"), "chunk", F.col("held").alias("a"), F.col("sizes").alias("b"), F.col("tokens").alias("c"), F.col("codes").alias("d"), "ids")
    answers = rooted.filter(F.col("kind") == WORDS).unionByName(seated.filter(F.col("kind") == PAIRS)).withColumn("d", nothing).withColumn("ids", F.lit(None).cast(chunked.schema["ids"].dataType))
    # chunks are numbered by task, and tasks make about equally many
    number = F.shiftright("chunk", 32) * F.lit(int(most or 0) + 1) + F.col("chunk").bitwiseAND(F.lit(0xFFFFFFFF))
    parts = max(int(n), 1)
    rows = answers.unionByName(texts).repartitionById(parts, F.pmod(number, F.lit(parts)).cast("int")).sortWithinPartitions("chunk", "kind", "part")
    return rows.mapInArrow(_score(totals, to_arrow_type(docs.schema["doc_id"].dataType)), f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def perplexity(scored: DataFrame) -> float:
    """Per token, of the scored rows."""
    got = scored.agg(F.sum("score"), F.sum("n_tokens")).first()
    return float(10 ** (-got[0] / got[1])) if got[1] else float("nan")
