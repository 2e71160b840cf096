"""Near-duplicate classes by b-bit MinHash.

Each text becomes a set of 5-word shingles.  128 minima are taken over the set; bands of
four full minima name buckets, while for the comparison of candidates only the low four
bits of each minimum are kept, packed into 64 bytes.  Two unrelated minima agree in their
low bits by chance once in 16, so the share of agreeing nibbles, found by bit counts, is
corrected for that before it is compared with a floor well below the wanted similarity.
What passes is confirmed on the full shingle sets.

Texts with the same word sequence count once (a 128-bit digest names them).  No bucket's
pairs are listed: first each member is compared with its bucket's least member; then, only
in buckets whose members still belong to different components, members of different
components are compared chunk by chunk, estimate first, and only links come out.  So a pair that shares a bucket is compared or already connected.  A pair with
similarity 0.75 shares none of the 32 buckets with probability 5e-6, and falls below the
floor with probability 3e-7.

Defined cases: a text that is null, empty or blank has an empty set and is alone; with one
to four words the whole sequence is the only shingle.  Rows with a null id take part; a
component's id is its least id that isn't null.  Rows that repeat an id share its class if
their texts do.  Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gritsieve.llm.common import materialize, pieces, words_of
from gritsieve.plans.graph import components

SHINGLE = 5
BANDS, ROWS, BITS = 32, 4, 4
PERCENT = 75
#: Least estimated similarity of a candidate; 0.75 lies 5 standard deviations above it.
FLOOR = 0.55
#: Word hashes that a worker remembers.
MEMORY = 100_000
#: Members of a bucket, and shingles of them, that are compared in one group.
CHUNK_ROWS, CHUNK_SHINGLES = 512, 1 << 20
#: Most rows of the bit table, 64 bits each.
FILTER_ROWS = 1 << 20


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMORY:
            self.clear()
        out = self[word] = xxhash.xxh3_64_intdigest(word)
        return out


def shingle_set(words: list[bytes], hashes: dict) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the shingles."""
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = min(SHINGLE, len(words))
    out = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + len(out)]
        out ^= out >> np.uint64(29)
    if n < SHINGLE:
        out ^= np.uint64(n * 0xD6E8FEB86659FD93 % 2**64)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(out ^ (out >> np.uint64(32)))


_rng = np.random.default_rng(20240229)
_XOR = _rng.integers(0, 2**32, BANDS * ROWS, np.uint32)
_MUL = _rng.integers(0, 2**32, BANDS * ROWS, np.uint32) | np.uint32(1)
_BAND = _rng.integers(0, 2**63, BANDS, np.uint64)


def minima(shingles: np.ndarray) -> np.ndarray:
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(BANDS * ROWS, 2**32 - 1, np.uint32)
    for k in range(0, len(x), 1024):
        np.minimum(least, ((x[k : k + 1024, None] ^ _XOR) * _MUL).min(axis=0), out=least)
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    rows = least.reshape(BANDS, ROWS).astype(np.uint64)
    key = _BAND.copy()
    for k in range(ROWS):
        key = (key ^ rows[:, k]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(31)
    return key.view(np.int64)


def packed(least: np.ndarray) -> np.ndarray:
    """The low four bits of each minimum, 16 to a 64-bit word."""
    low = (least & np.uint32(15)).astype(np.uint8).reshape(-1, 2)
    return (low[:, 0] | (low[:, 1] << 4)).view(np.int64)


def digest(words: list[bytes]) -> bytes:
    return xxhash.xxh3_128_digest(b" ".join(words))


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = _Hashes()
    for batch in pieces(batches, 2):
        keys, sizes, bands, signs = [], [], [], []
        for text in batch.column(2).cast(pa.binary()):
            words = words_of(text.as_py())
            if not words:
                keys.append(None), sizes.append(0), bands.append(None), signs.append(None)
                continue
            s = shingle_set(words, hashes)
            least = minima(s)
            keys.append(digest(words)), sizes.append(len(s)), bands.append(band_keys(least)), signs.append(packed(least))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(signs, pa.list_(pa.int64()))],
            names=["doc_id", "text_hash", "key", "n_shingles", "bands", "sign"],
        )


def signatures(docs: DataFrame) -> DataFrame:
    slim = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text")
    return slim.mapInArrow(_sign, "doc_id long, text_hash long, key binary, n_shingles long, bands array<long>, sign array<long>")


def estimate(a: Column, b: Column) -> Column:
    """Similarity from two packed signatures, corrected for chance agreement."""
    unlike = F.lit(0)
    for k in range(BANDS * ROWS // 16):
        x = F.get(a, F.lit(k)).bitwiseXOR(F.get(b, F.lit(k)))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseAND(F.lit(0x1111111111111111))
        unlike = unlike + F.bit_count(x)
    chance = 1 / 2**BITS
    return ((1 - unlike / (BANDS * ROWS)) - chance) / (1 - chance)


def alike_in_size(a: Column, b: Column) -> Column:
    return (100 * F.least(a, b)) >= (PERCENT * F.greatest(a, b))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = _Hashes()
    for batch in pieces(batches, 2):
        keys, ids, sets = batch.column(1).to_pylist(), [], []
        for k, text in enumerate(batch.column(2).cast(pa.binary())):
            words = words_of(text.as_py())
            if digest(words) == keys[k]:
                ids.append(k), sets.append(shingle_set(words, hashes).view(np.int64))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids, pa.int64())), pa.array(sets, pa.list_(pa.int64()))], names=["id", "shingles"])


def sieved(rows: DataFrame, wanted: DataFrame, hashed: Column, key: Column) -> DataFrame:
    """``rows`` whose ``hashed`` value may be the ``key`` of a wanted row: all of those and few others.

    The bit table has about 16 bits for each wanted row and ``FILTER_ROWS`` rows at most; beyond
    that more rows pass, none is lost.
    """
    size = min(FILTER_ROWS, max(64, wanted.count() // 4))
    bit = lambda h: F.shiftrightunsigned(h, 58).cast("int")
    table = wanted.select(F.pmod(key, F.lit(size)).alias("__w"), F.expr("1L").alias("one"), bit(key).alias("k")).groupBy("__w").agg(F.bit_or(F.call_function("shiftleft", "one", "k")).alias("__bits"))
    placed = rows.withColumn("__h", hashed).withColumn("__at", F.pmod("__h", F.lit(size)))
    kept = placed.join(F.broadcast(table), F.col("__at") == F.col("__w")).filter(F.call_function("shiftrightunsigned", "__bits", bit(F.col("__h"))).bitwiseAND(F.lit(1)) == 1)
    return kept.select(rows.columns)


def full_sets(wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """``(id, shingles)``: the full shingle sets of the wanted texts (id, key, rep_id, rep_hash)."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    texts = sieved(texts, wanted, F.xxhash64("doc_id", "text_hash"), F.xxhash64("rep_id", "rep_hash"))
    found = wanted.join(texts, F.col("rep_id").eqNullSafe(F.col("doc_id")) & (F.col("rep_hash") == F.col("text_hash"))).select("id", "key", "text")
    return found.mapInArrow(_sets, "id long, shingles array<long>").dropDuplicates(["id"])


def alike(a: Column, b: Column) -> Column:
    """Whether two full sets are similar enough."""
    return (100 + PERCENT) * F.size(F.array_intersect(a, b)) >= PERCENT * (F.size(a) + F.size(b))


def _unlike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many minima differ in their low bits, for all rows of a against all of b."""
    x = a[:, None, :] ^ b[None, :, :]
    x |= x >> np.uint64(1)
    x |= x >> np.uint64(2)
    return np.bitwise_count(x & np.uint64(0x1111111111111111)).sum(axis=2, dtype=np.int64)


#: Most differing minima of a candidate.
_MOST_UNLIKE = BANDS * ROWS * (1 - 1 / 2**BITS) * (1 - FLOOR)


def _links(rows: list[dict]) -> Iterator[tuple[int, int | None, int, int | None]]:
    """Links that join components of one bucket's two chunks (or of one chunk in itself)."""
    a = [r for r in rows if r["side"] == 0]
    b = [r for r in rows if r["side"] == 1]
    itself = not b
    b = b or a
    column = lambda side, name, kind: np.array([r[name] for r in side], kind)
    sign_a, sign_b = column(a, "sign", np.int64).view(np.uint64), column(b, "sign", np.int64).view(np.uint64)
    n_a, n_b = column(a, "n", np.int64), column(b, "n", np.int64)
    names = {c: k for k, c in enumerate({r["component"] for r in rows})}
    of_a, of_b = (np.array([names[r["component"]] for r in side]) for side in (a, b))
    bands_a, bands_b = column(a, "bands", np.int64), column(b, "bands", np.int64)
    place = a[0]["place"] if a else 0
    for i in range(len(a)):
        near = (of_b != of_a[i]) & (100 * np.minimum(n_a[i], n_b) >= PERCENT * np.maximum(n_a[i], n_b))
        if itself:
            near[: i + 1] = False
        at = np.flatnonzero(near)
        at = at[_unlike(sign_a[i : i + 1], sign_b[at])[0] <= _MOST_UNLIKE]
        at = at[~(bands_b[at, :place] == bands_a[i, :place]).any(axis=1)]  # a band before has dealt with the others
        while len(at):
            part, at = at[:32], at[32:]
            sets = [b[j]["shingles"] for j in part]
            inside = np.isin(np.concatenate(sets), a[i]["shingles"], assume_unique=False)
            both = np.add.reduceat(inside, np.cumsum([0, *map(len, sets[:-1])]), dtype=np.int64)
            for j in part[(100 + PERCENT) * both >= PERCENT * (n_a[i] + n_b[part])]:
                if of_b[j] != of_a[i]:
                    yield a[i]["id"], a[i]["least_id"], b[j]["id"], b[j]["least_id"]
                    old, new = of_b[j], of_a[i]
                    of_a[of_a == old] = new
                    of_b[of_b == old] = new
            at = at[of_b[at] != of_a[i]]


def _link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    key = None
    found: list[tuple] = []
    for batch in batches:
        heads = list(zip(*(batch.column(k).to_pylist() for k in range(3))))
        numpy = {n: batch.column(n) for n in ("sign", "bands", "shingles")}
        plain = {n: batch.column(n).to_pylist() for n in ("side", "id", "least_id", "n", "component", "place")}
        for k, head in enumerate(heads):
            if head != key:
                found += _links(held) if len(held) > 1 else ()
                held, key = [], head
            held.append({n: v[k] for n, v in plain.items()} | {n: v[k].values.to_numpy() for n, v in numpy.items()})
        yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in found], pa.int64()) for j in range(4)], names=["a", "least_a", "b", "least_b"])
        found = []
    if len(held) > 1:
        found = list(_links(held))
        yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in found], pa.int64()) for j in range(4)], names=["a", "least_a", "b", "least_b"])


def linked(members: DataFrame) -> DataFrame:
    """``(a, least_a, b, least_b)``: links by which members of different components of a bucket are joined.

    A bucket is cut into chunks of about ``CHUNK_ROWS`` members or ``CHUNK_SHINGLES`` shingles, and
    each pair of chunks is a group of its own, so that no task holds a whole bucket.  All pairs
    in a group are compared, save those that a link of the group or an earlier band has dealt with.
    """
    chunks = members.groupBy("band").agg(F.ceil(F.greatest(F.count("*") / CHUNK_ROWS, F.sum("n") / CHUNK_SHINGLES)).alias("chunks"))
    dealt = members.join(chunks, "band").withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    dealt = dealt.select("band", F.least("chunk", "other").alias("lo"), F.greatest("chunk", "other").alias("hi"), (F.col("chunk") > F.col("other")).cast("int").alias("side"), "id", "least_id", "n", "component", "place", "sign", "bands", "shingles")
    return dealt.repartition("band", "lo", "hi").sortWithinPartitions("band", "lo", "hi").mapInArrow(_link, "a long, least_a long, b long, least_b long")


def node(least: str, name: str) -> Column:
    """A text as a node of the graph; known ids come first, in order."""
    return F.struct(F.col(least).isNull().alias("unknown"), F.coalesce(least, F.lit(0).cast("long")).alias("least_id"), F.col(name).alias("id"))


def classes(docs: DataFrame) -> DataFrame:
    """``(doc_id, text_hash, n_shingles, component_id, kept, group)`` for every document."""
    signed = materialize(signatures(docs))
    reps = signed.filter("key is not null").groupBy("key").agg(
        F.min("doc_id").alias("least_id"), F.min(F.struct("doc_id", "text_hash")).alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("sign").alias("sign")
    )
    reps = materialize(reps.select("key", "least_id", F.col("rep.doc_id").alias("rep_id"), F.col("rep.text_hash").alias("rep_hash"), "n", "bands", "sign").withColumn("id", F.monotonically_increasing_id()))

    # rows of buckets with two members at least that have a partner by the estimate
    buckets = reps.select("id", F.explode("bands").alias("band"))
    many = buckets.groupBy("band").agg(F.count("*").alias("members")).filter("members > 1").select("band")
    shared = materialize(buckets.join(many, "band").join(reps.select("id", "least_id", "n", "sign"), "id"))

    def promising(a: DataFrame, b: DataFrame, *more: Column) -> Column:
        out = (F.col("a.band") == F.col("b.band")) & (F.col("a.id") != F.col("b.id"))
        for c in (*more, alike_in_size(F.col("a.n"), F.col("b.n")), estimate(F.col("a.sign"), F.col("b.sign")) >= FLOOR):
            out = out & c
        return out

    a, b = shared.alias("a"), shared.alias("b")
    shared = materialize(a.join(b, promising(a, b), "left_semi"))
    sets = materialize(full_sets(shared.select("id").distinct().join(reps.select("id", "key", "rep_id", "rep_hash"), "id"), docs))

    # each member against the least member of its bucket
    pivots = shared.groupBy("band").agg(F.min(F.struct("id", "least_id")).alias("p"))
    pairs = shared.join(pivots, "band").filter("id <> p.id").select(F.col("id").alias("a"), F.col("least_id").alias("least_a"), F.col("p.id").alias("b"), F.col("p.least_id").alias("least_b")).distinct()
    own = lambda side: sets.select(F.col("id").alias(side), F.col("shingles").alias(f"s{side}"))
    links = materialize(pairs.join(own("a"), "a").join(own("b"), "b").filter(alike(F.col("sa"), F.col("sb"))).select("a", "least_a", "b", "least_b"))
    edges = lambda df: df.select(node("least_a", "a").alias("a"), node("least_b", "b").alias("b"))
    first = components(edges(links))

    # what still lies apart in one bucket: all pairs, but never listed
    placed = shared.join(first.select(F.col("node.id").alias("id"), F.col("component.id").alias("component")), "id", "left").withColumn("component", F.coalesce("component", "id"))
    mixed = placed.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("band")
    apart = materialize(placed.join(mixed, "band"))
    a, b = apart.alias("a"), apart.alias("b")
    differ = F.col("a.component") != F.col("b.component")
    apart = a.join(b, promising(a, b, differ), "left_semi").join(reps.select("id", "bands"), "id").join(sets, "id")
    more = materialize(linked(materialize(apart.withColumn("place", F.array_position("bands", F.col("band")).cast("int") - 1))))
    whole = components(edges(links.unionByName(more))) if more.take(1) else first

    labels = reps.select("key", "id", "least_id").join(whole.select(F.col("node.id").alias("id"), "component"), "id", "left")
    least = F.when(F.col("component").isNull(), F.col("least_id")).when(~F.col("component.unknown"), F.col("component.least_id"))
    labels = labels.select("key", F.coalesce("component.id", "id").alias("group"), least.alias("component_id"))
    out = signed.select("doc_id", "text_hash", "key", "n_shingles").join(labels, "key", "left")
    component = F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "text_hash", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"), "group")


def dedup(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each class; all blank texts stay.

    The one that stays has the class's least id.  If a class has no id at all, or its least
    one stands in several rows, one of those rows stays.
    """
    from pyspark.sql import Window as W

    c = classes(docs).filter(F.col("kept") | F.col("group").isNull() | F.col("component_id").isNull())
    c = c.withColumn("nth", F.row_number().over(W.partitionBy("group", "component_id").orderBy("text_hash"))).filter(F.col("group").isNull() | (F.col("nth") == 1))
    c = c.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), F.col("group").isNull().alias("__blank")).distinct()
    d = docs.withColumn("__th", F.xxhash64("text"))
    joined = d.join(c, F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.col("__th") == F.col("__hash")))
    nth = F.row_number().over(W.partitionBy("__id", "__hash").orderBy("__id"))
    return joined.withColumn("__nth", nth).filter(F.col("__blank") | (F.col("__nth") == 1)).select(docs.columns)
