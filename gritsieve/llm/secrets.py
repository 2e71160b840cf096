"""Secret scans over a trigram inverted index, with SQL expressions only.

Each rule is a regular expression.  From its parse tree a Boolean query over trigrams is
derived (a disjunction of conjunctions that every match must satisfy, on lower-cased
text).  The index holds postings for the trigrams that some rule asks for, as one bit of
each trigram beside the row; a rule's query intersects the bits, and only candidate rows are
verified with the expression itself.  A rule without a mandatory trigram (a run of hex
digits) scans every document.  Since a document's bits stay in its row, candidates need not
be joined with their texts: nothing is shuffled.  :func:`postings` lists the same index by
trigram.

Positions are running sums of the lengths of matches and of the pieces between them, taken
block by block, so that their cost grows no faster than the text.

Defined cases: a null or empty text has no spans.  Rows that repeat an id or a text are
scanned each.  A null id is kept as null.  Texts of any length are scanned whole.  Spans
that start together are listed by rule.  Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

import re._constants as rc
import re._parser as rp
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gritsieve.llm.common import let


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str  #: understood alike by Java and Python
    group: int = 0  #: the group whose length counts
    least: int = 1  #: a match with a shorter group is dropped
    base: bool = False


#: Kinds in the order in which spans that start together are listed.
RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, True),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24, True),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("stripe", r"[sr]k_live_[A-Za-z0-9]{16,}"),
)

#: Names of the columns that hold trigram bits and spans beside a row.
BITS, FOUND = "__bits", "__found"
#: Positions whose running values are listed together.
STEP = 64
SPANS = "array<struct<start:bigint,rule:int,stop:bigint>>"

#: More alternatives than this are not multiplied out; the part then demands nothing.
MOST_STRINGS = 64


def _strings(items) -> list[tuple[set[str], bool]]:
    """Pieces of a sequence: sets of literal strings, each with whether it may grow on.

    Neighbouring pieces are literal continuations of each other unless an open piece
    (anything that is no small set of strings) stands between them.
    """
    pieces: list[tuple[set[str], bool]] = [({""}, True)]

    def put(options: set[str] | None) -> None:
        if options is None:
            pieces.append(({""}, True))
            return
        last, _ = pieces[-1]
        if len(last) * len(options) <= MOST_STRINGS:
            pieces[-1] = ({a + b for a in last for b in options}, True)
        else:
            pieces.append((options, True))

    for op, arg in items:
        if op is rc.LITERAL:
            put({chr(arg).lower()})
        elif op is rc.SUBPATTERN:
            inner = _strings(arg[3])
            put(inner[0][0] if len(inner) == 1 else None)
        elif op is rc.BRANCH:
            each = [_strings(x) for x in arg[1]]
            put(set().union(*(x[0][0] for x in each)) if all(len(x) == 1 for x in each) else None)
        elif op is rc.IN:
            chars = {chr(v).lower() for o, v in arg if o is rc.LITERAL}
            put(chars if all(o is rc.LITERAL for o, _ in arg) else None)
        elif op in (rc.MAX_REPEAT, rc.MIN_REPEAT):
            low, high, inner = arg[0], arg[1], _strings(arg[2])
            if len(inner) == 1 and low == high <= 8:
                for _ in range(low):
                    put(inner[0][0])
            elif len(inner) == 1 and (low, high) == (0, 1):
                put(inner[0][0] | {""})
            else:
                put(None)
        else:
            put(None)
    return pieces


def trigram_query(pattern: str) -> list[list[set[str]]]:
    """Clauses that all must hold; each is a list of trigram sets of which one must be present.

    An empty list means that the pattern has no mandatory trigram.
    """
    clauses = []
    for options, _ in _strings(rp.parse(pattern)):
        sets = [{s[i : i + 3] for i in range(len(s) - 2)} for s in sorted(options)]
        if all(sets):
            clauses.append([s for s in sets if not any(t < s for t in sets)])  # a subset demands less, so it speaks for both
    return clauses


def asked_grams(rules=RULES) -> list[str]:
    """The trigrams that some rule asks for; a trigram's place is its bit."""
    return sorted({g for r in rules for c in trigram_query(r.pattern) for s in c for g in s})


def indexed(docs: DataFrame, rules=RULES) -> DataFrame:
    """``docs`` with the array ``__bits``: which of the trigrams asked for a row's text has."""
    low = docs.withColumn("__low", F.lower("text"))
    return low.withColumn(BITS, F.array(*(F.coalesce(F.contains("__low", F.lit(g)), F.lit(False)) for g in asked_grams(rules)))).drop("__low")


def postings(docs: DataFrame, rules=RULES) -> DataFrame:
    """``(gram, doc_id, text_hash)``: where each trigram that a rule asks for occurs."""
    grams = F.array(*(F.lit(g) for g in asked_grams(rules)))
    here = F.filter(grams, lambda g, k: F.get(F.col(BITS), k))
    return indexed(docs, rules).select(F.explode(here).alias("gram"), "doc_id", F.xxhash64("text").alias("text_hash"))


def _all_of(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def candidate(rule: Rule, rules=RULES) -> Column:
    """Whether a row's trigram bits satisfy a rule's query; always, if it has none."""
    place = {g: k for k, g in enumerate(asked_grams(rules))}
    out = F.lit(True)
    for clause in trigram_query(rule.pattern):
        one = F.lit(False)
        for s in clause:
            one = one | _all_of([F.get(BITS, F.lit(place[g])) for g in sorted(s)])
        out = out & one
    return out


def candidates(docs: DataFrame, rules=RULES) -> DataFrame:
    """``(doc_id, text_hash, rules)``: rows whose bits satisfy the query of a rule that has one."""
    which = F.filter(F.array(*(F.when(candidate(r, rules), F.lit(k)) for k, r in enumerate(rules) if trigram_query(r.pattern))), lambda x: x.isNotNull())
    return indexed(docs, rules).select("doc_id", F.xxhash64("text").alias("text_hash"), which.alias("rules")).filter(F.size("rules") > 0)


def _last(a: Column) -> Column:
    return F.get(a, F.size(a) - 1)


def running(values: Column, merge: Callable[[Column, Column], Column]) -> Column:
    """Running sums (or maxima) of a non-empty array of longs that are 0 at least.

    Lists of ``STEP`` values are run through on their own and then moved by what comes before.
    """

    def run(a: Column, start: Column) -> Column:
        return F.aggregate(a, start, lambda acc, x: F.concat(acc, F.array(merge(F.coalesce(_last(acc), F.lit(0).cast("long")), x))))

    nothing = F.array().cast("array<bigint>")

    def whole(a: Column) -> Column:
        steps = F.sequence(F.lit(0), F.floor((F.size(a) - 1) / STEP).cast("int"))
        parts = F.transform(steps, lambda k: run(F.slice(a, k * STEP + 1, F.lit(STEP)), nothing))
        return let(parts, lambda p: let(run(F.transform(p, _last), F.array(F.lit(0).cast("long"))), lambda tops: F.flatten(F.zip_with(p, F.slice(tops, F.lit(1), F.size(p)), lambda x, t: F.transform(x, lambda v: merge(t, v))))))

    return let(values, whole)


def _spans(r: Rule, k: int) -> Column:
    """Spans of one rule in ``text``, in order."""
    p = F.lit(r.pattern)
    lengths = lambda a: F.transform(a, lambda x: F.length(x).cast("long"))

    def placed(widths: Column) -> Column:
        steps = F.zip_with(F.slice(lengths(F.split("text", r.pattern, -1)), F.lit(1), F.size(widths)), widths, lambda x, y: x + y)
        spans = F.zip_with(running(steps, lambda x, y: x + y), widths, lambda stop, width: F.struct((stop - width).alias("start"), F.lit(k).alias("rule"), stop.alias("stop")))
        if r.least == 1:
            return spans
        counted = F.zip_with(spans, lengths(F.regexp_extract_all("text", p, F.lit(r.group))), lambda x, n: F.when(n >= r.least, x))
        return F.filter(counted, lambda x: x.isNotNull())

    return F.when(F.regexp_like("text", p), let(lengths(F.regexp_extract_all("text", p, F.lit(0))), placed))


def with_spans(docs: DataFrame, rules=RULES) -> DataFrame:
    """``docs`` with the array ``__found`` of (start, rule, stop): a row's spans in order; code points, stop exclusive."""
    each = [F.coalesce(F.when(candidate(r, rules), _spans(r, k)), F.array().cast(SPANS)) for k, r in enumerate(rules)]
    return indexed(docs, rules).withColumn(FOUND, F.sort_array(F.flatten(F.array(*each)))).drop(BITS)


def find_spans(docs: DataFrame, rules=RULES) -> DataFrame:
    """``(doc_id, text_hash, rule, start, stop)``: every span."""
    rows = with_spans(docs.select("doc_id", "text"), rules).select("doc_id", F.xxhash64("text").alias("text_hash"), F.explode(FOUND).alias("m"))
    return rows.select("doc_id", "text_hash", "m.rule", "m.start", "m.stop")


def scan(docs: DataFrame, rules=RULES) -> DataFrame:
    """One row per document: base counts, the digest of base spans, and all spans."""
    slim = with_spans(docs.select("doc_id", "text"), rules).select("doc_id", F.col(FOUND).alias("found"))
    kind = F.array(*(F.lit(r.kind) for r in rules))
    listed = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", F.get(kind, x["rule"]), x["start"].cast("string"), x["stop"].cast("string"))), ",")
    base = [k for k, r in enumerate(rules) if r.base]
    count = lambda k: F.size(F.filter("found", lambda x: x["rule"] == k)).cast("long")
    return slim.select(
        "doc_id",
        *(count(k).alias(f"n_{rules[k].kind}") for k in base),
        F.sha2(listed(F.filter("found", lambda x: x["rule"].isin(base))).cast("binary"), 256).alias("base_sha256"),
        listed(F.col("found")).alias("spans"),
    )


def redact(docs: DataFrame, rules=RULES, mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span, or run of overlapping spans, replaced by ``mask``.

    Other rows stay as they are; ``n_chars``, where there is one, follows a changed text.
    Letters are taken from an array of the text's code points, so the cost is that of the text.
    """
    found = F.col(FOUND)
    reach = running(F.transform(found, lambda x: x["stop"]), lambda x, y: F.greatest(x, y))

    def kept(reached: Column, letters: Column) -> Column:
        before = F.concat(F.array(F.lit(0).cast("long")), reached)
        part = lambda lo, hi: F.array_join(F.slice(letters, (lo + 1).cast("int"), (hi - lo).cast("int")), "")
        gaps = F.zip_with(found, F.slice(before, F.lit(1), F.size(found)), lambda x, r: F.when((x["start"] > r) | (r == 0), F.concat(part(r, F.greatest(x["start"], r)), F.lit(mask))).otherwise(F.lit("")))
        return F.concat(F.array_join(gaps, ""), part(_last(reached), F.size(letters).cast("long")))

    hidden = F.size(FOUND) > 0
    changed = let(reach, lambda r: let(F.split("text", ""), lambda letters: kept(r, letters)))
    out = with_spans(docs, rules).withColumn("text", F.when(hidden, changed).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(hidden, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(docs.columns)
