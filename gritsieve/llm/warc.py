"""Merkle fixity audit of WARC replicas.

Pages are serialized as WARC response records and dealt into files of ``SPAN`` consecutive
ids; the index holds each id's byte offset.  Leaves hash the records of an id.  An inner
node stands for up to ``FANOUT`` children in order of id, and so for a range of offsets: it
hashes where each child's bytes begin and end in that range, and the child's hash; a file
is a node of its own.  Two replicas are audited from their roots: only where the hashes of a
node differ are its children compared, down to the ids whose records are damaged, missing
or added.

Records of one id are hashed into a leaf by their number, total length and the sums of all
eighths of their digests, which partial aggregates build up, so no task holds all records of
a much repeated id; such rows share an offset and an outcome.

Defined cases: a null id counts as -1; a null url or body as empty.  Ids may lie anywhere in
the range of long.  Equal replicas give no rows, as do two empty ones.  Bodies of any length
are hashed whole.  Further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from gritsieve.llm.common import materialize

FANOUT_BITS = 5
FANOUT = 1 << FANOUT_BITS
SPAN = FANOUT**2
#: Its bits but the highest turn order of ids into order of nodes, which count as unsigned.
_SIGN = -(1 << 63)


def records(pages: DataFrame) -> DataFrame:
    """``(page_id, id, length, digest)`` of each page's WARC record."""
    body = F.coalesce("html", F.lit(""))
    record = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: "), F.coalesce("url", F.lit("")), F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
        F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"),
    )
    named = pages.select("page_id", F.coalesce(F.col("page_id").cast("long"), F.lit(-1).cast("long")).alias("id"), record.alias("record"))
    return named.select("page_id", "id", F.octet_length("record").cast("long").alias("length"), F.sha2(F.col("record").cast("binary"), 256).alias("digest"))


def leaves(recorded: DataFrame) -> DataFrame:
    """``(id, length, hash)``."""
    eighth = lambda k: F.sum(F.conv(F.substring("digest", 1 + 8 * k, 8), 16, 10).cast("decimal(28,0)")).cast("string")
    return recorded.groupBy("id").agg(F.sum("length").alias("length"), F.sha2(F.concat_ws(":", F.count("*").cast("string"), F.sum("length").cast("string"), *(eighth(k) for k in range(8))).cast("binary"), 256).alias("hash"))


def index(leaf: DataFrame) -> DataFrame:
    """``(id, file, offset)``: where in which file an id's records begin."""
    before = W.partitionBy("file").orderBy("id").rowsBetween(W.unboundedPreceding, -1)
    return leaf.withColumn("file", F.floor(F.col("id") / SPAN)).select("id", "file", F.coalesce(F.sum("length").over(before), F.lit(0)).alias("offset"))


def _ranges(children: Column) -> Column:
    """``node:begin-end:hash`` of each child in order, offsets counted from the first child's."""
    begin = lambda k: F.aggregate(F.slice(children, F.lit(1), k), F.lit(0).cast("long"), lambda at, x: at + x["length"])
    return F.array_join(F.transform(children, lambda x, k: F.concat_ws(":", x["node"].cast("string"), F.concat_ws("-", begin(k).cast("string"), (begin(k) + x["length"]).cast("string")), x["hash"])), ",")


def trees(a: DataFrame, b: DataFrame) -> list[DataFrame]:
    """Levels ``(replica, node, length, hash)`` of both trees, leaves first, root last."""
    both = materialize(a.select(F.lit("a").alias("replica"), "id", "length", "hash").unionByName(b.select(F.lit("b").alias("replica"), "id", "length", "hash")))
    low, high = both.agg(F.min("id"), F.max("id")).first()
    levels = [both.select("replica", F.col("id").bitwiseXOR(F.lit(_SIGN)).alias("node"), "length", "hash")]
    apart = ((low ^ high) & (1 << 64) - 1) if low is not None else 0  #: all ids agree in the bits above
    while apart:
        children = F.array_sort(F.collect_list(F.struct("node", "length", "hash")))  # FANOUT at most
        up = levels[-1].groupBy("replica", F.shiftrightunsigned("node", FANOUT_BITS).alias("parent")).agg(children.alias("c"), F.sum("length").alias("length"))
        levels.append(materialize(up.select("replica", F.col("parent").alias("node"), "length", F.sha2(_ranges(F.col("c")).cast("binary"), 256).alias("hash"))))
        apart >>= FANOUT_BITS
    return levels


def audit(a: DataFrame, b: DataFrame) -> DataFrame:
    """``(id, outcome)`` of the leaves (see :func:`leaves`) in which replicas a and b differ.

    The outcome is what became of a's records in b: ``changed``, ``missing`` or ``added``.
    """
    suspects = None
    for level in reversed(trees(a, b)):
        nodes = level if suspects is None else level.join(suspects.withColumnRenamed("node", "parent"), F.shiftrightunsigned(level["node"], FANOUT_BITS) == F.col("parent"), "left_semi")
        sides = nodes.groupBy("node").agg(F.max(F.when(F.col("replica") == "a", F.col("hash"))).alias("ha"), F.max(F.when(F.col("replica") == "b", F.col("hash"))).alias("hb"))
        suspects = materialize(sides.filter(~F.col("ha").eqNullSafe(F.col("hb"))))
    outcome = F.when(F.col("hb").isNull(), "missing").when(F.col("ha").isNull(), "added").otherwise("changed")
    return suspects.select(F.col("node").bitwiseXOR(F.lit(_SIGN)).alias("id"), outcome.alias("outcome"))


def report(pages: DataFrame, replica: DataFrame) -> DataFrame:
    """One row for each of ``pages``: its file, offset, length, digest and outcome in the replica.

    One row more for each id that only the replica has, without file, offset, length or digest.
    """
    own = records(pages)
    leaf = materialize(leaves(own))
    found = materialize(audit(leaf, materialize(leaves(records(replica)))))
    placed = own.join(index(leaf), "id").join(found, "id", "left")
    rows = placed.select("page_id", "file", "offset", "length", "digest", F.coalesce("outcome", F.lit("intact")).alias("outcome"))
    no = lambda name: F.lit(None).cast(rows.schema[name].dataType).alias(name)
    added = found.filter("outcome = 'added'").select(F.col("id").cast(rows.schema["page_id"].dataType).alias("page_id"), no("file"), no("offset"), no("length"), no("digest"), "outcome")
    return rows.unionByName(added)


def worn(pages: DataFrame) -> DataFrame:
    """A replica of ``pages`` with planted damage, to audit: bodies altered, records lost, records added."""
    body = F.when(F.col("page_id") % 89 == 3, F.concat(F.lit("#"), F.col("html"))).otherwise(F.col("html"))
    kept = pages.filter(~F.coalesce(F.col("page_id") % 211 == 17, F.lit(False))).withColumn("html", body)
    return kept.unionByName(pages.filter(F.col("page_id") % 307 == 5).withColumn("page_id", -F.col("page_id") - 2))
