"""Language identification of mixed texts: scripts, per-word scores and Viterbi labels.

A word is a longest run of letters of one script with the marks that combine with them,
lower-cased; scripts that are written without blanks are cut into words of up to four
letters.  A word's script (by code point ranges) narrows the candidates to the languages
that were seen in that script.  Its score for a
candidate is the log likelihood of its byte trigrams under that language, relative to the
best one and bounded, so that a single word cannot outvote a sentence.  Viterbi with a
penalty for each switch labels the words; runs of one label are the spans.  The text's
language is the one whose spans hold most letters.

Trigram counts cover every training row.  They are hashed into ``CELLS`` cells for each
language, so that the model has a fixed size for each language.

A path that stays with the best single language is optimal if no run of words gains more
by another language than one penalty; only for other texts are the recurrences run.

Defined cases: a null text or one without a letter is ``und`` with score 0.  Rows without
a label aren't learned from; with no labels at all every text is ``und``.  Ties go to the
first language by code point.  Rows that repeat an id are scored each.  Texts of any length
are labelled as a whole.  Further columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gritsieve.llm.common import pieces

CELLS = 1 << 16
#: Price of a switch and bound of one word's evidence, in nats.
SWITCH, BOUND = 18.0, 9.0
SMOOTH = 0.5
#: A script belongs to a language if at least this share of its letters is in that script.
SCRIPT_SHARE = 0.01
#: Words that a worker remembers.
MEMORY = 100_000

#: Last code points of Unicode script ranges, with the script's name.
SCRIPTS = (
    (0x02AF, "latin"), (0x036F, "other"), (0x03FF, "greek"), (0x052F, "cyrillic"), (0x058F, "armenian"), (0x05FF, "hebrew"), (0x08FF, "arabic"),
    (0x097F, "devanagari"), (0x0DFF, "indic"), (0x0E7F, "thai"), (0x109F, "other"), (0x10FF, "georgian"), (0x11FF, "hangul"), (0x139F, "ethiopic"),
    (0x1DFF, "other"), (0x1EFF, "latin"), (0x1FFF, "greek"), (0x303F, "other"), (0x30FF, "kana"), (0x33FF, "other"), (0x9FFF, "han"),
    (0xABFF, "other"), (0xD7FF, "hangul"), (0x10FFFF, "other"),
)
_ENDS = [x for x, _ in SCRIPTS]
_LAST = np.array(_ENDS)
_NAMES = sorted({n for _, n in SCRIPTS})
_SCRIPT_OF = np.array([_NAMES.index(n) for _, n in SCRIPTS])
#: Fixed value: scripts that are written without blanks between words.
UNSPACED = ("han", "kana", "thai")
#: Letters of a word of such a script.
UNIT = 4


def _ranges(points: list[int]) -> str:
    """What stands in a regular expression's brackets for the code points."""
    p = np.array(points)
    cut = np.flatnonzero(np.diff(p) > 1)
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(p[[0, *(cut + 1)]], p[[*cut, -1]]))


def _word_patterns() -> tuple[re.Pattern, re.Pattern]:
    """Words, script by script; and words of the first Latin letters, where no mark combines."""
    letters: dict[str, list[int]] = {}
    marks: list[int] = []
    for c in range(0x32400):  # letters and marks end there but for variation selectors
        ch = chr(c)
        if ch.isalpha():
            letters.setdefault(SCRIPTS[bisect_left(_ENDS, c)][1], []).append(c)
        elif unicodedata.category(ch)[0] == "M":
            marks.append(c)
    each = []
    for name in sorted(letters, key=lambda n: (n == "other", n != "latin", n)):
        one, m = _ranges(letters[name]), _ranges([c for c in marks if c < 0x10000 or name == "other"])
        each.append(f"(?:[{one}][{m}]*){{1,{UNIT}}}" if name in UNSPACED else f"[{one}][{one}{m}]*")
    return re.compile("|".join(each)), re.compile(f"[{_ranges([c for c in letters['latin'] if c <= _ENDS[0]])}]+")


_ANY, _LATIN = _word_patterns()
#: What is neither Latin nor a common mark, such as dashes and quotes.
_OTHER = re.compile("[^\x00-\u02af\u2000-\u2064\u20a0-\u20bf\u2190-\u2bff\u3000-\u3004]")


def pattern(text: str) -> re.Pattern:
    """The quickest pattern that finds the text's words."""
    return _ANY if _OTHER.search(text) else _LATIN


def words_in(text: str) -> list[str]:
    low = text.lower()
    return pattern(low).findall(low)


def script(word: str) -> int:
    return int(_SCRIPT_OF[np.searchsorted(_LAST, ord(word[0]))])


def _grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Cells of the trigrams of all words (each between blanks), and where each word's begin."""
    data = np.frombuffer((" " + "  ".join(words) + " ").encode(), np.uint8).astype(np.uint32)
    lengths = np.fromiter((len(w.encode()) for w in words), np.int64, len(words))
    h = data[:-2] * np.uint32(0x9E3779B1) ^ data[1:-1] * np.uint32(0x85EBCA77) ^ data[2:] * np.uint32(0xC2B2AE3D)
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    starts = np.cumsum(lengths + 2) - (lengths + 2)
    # of each word's n + 2 windows, the first n lie inside its own blanks
    inside = np.ones(len(h) + 2, bool)
    ends = starts + lengths
    inside[ends] = inside[ends + 1] = False
    begins = np.cumsum(lengths) - lengths
    return (h >> np.uint32(16))[inside[: len(h)]], begins


@dataclass
class Model:
    langs: list[str]
    logs: np.ndarray  #: (CELLS, languages)
    scripts: dict[int, np.ndarray] = field(default_factory=dict)  #: script: which languages


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    grams: dict[str, np.ndarray] = {}
    for batch in pieces(batches, 1, 16 << 20):
        words: dict[str, Counter] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            words.setdefault(lang, Counter()).update(words_in(text.as_py()))
        for lang, c in words.items():
            if c:
                cells, begins = _grams(list(c))
                n = np.fromiter(c.values(), np.int64, len(c))
                lengths = np.diff(np.append(begins, len(cells)))
                total = grams.setdefault(lang, np.zeros(CELLS + len(_NAMES), np.int64))
                total += np.bincount(cells, np.repeat(n, lengths), CELLS + len(_NAMES)).astype(np.int64)
                for w, k in c.items():
                    total[CELLS + script(w)] += k * len(w)
    for lang, total in grams.items():
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at), pa.array(total[at])], names=["lang", "cell", "n"])


def learn(training: DataFrame) -> Model:
    """A model of the rows' ``lang`` and ``text``; rows without either are passed over.

    What reaches the driver is at most ``CELLS`` sums for each language.
    """
    rows = training.filter("lang is not null and text is not null").select("lang", "text").mapInArrow(_count, "lang string, cell long, n long")
    got = rows.groupBy("lang", "cell").agg(F.sum("n").alias("n")).toArrow().to_pandas()
    langs = sorted(got["lang"].unique())
    counts = np.zeros((CELLS + len(_NAMES), max(1, len(langs))))
    for k, lang in enumerate(langs):
        own = got[got["lang"] == lang]
        counts[own["cell"].to_numpy(), k] = own["n"].to_numpy()
    grams, letters = counts[:CELLS] + SMOOTH, counts[CELLS:]
    share = letters / np.maximum(letters.sum(axis=0), 1)
    return Model(langs, np.log(grams / grams.sum(axis=0)).astype(np.float32), {s: share[s] >= SCRIPT_SHARE for s in range(len(_NAMES))})


class Scorer:
    """Scores words by a model and remembers them."""

    def __init__(self, model: Model):
        self.model, self.known, self.rows = model, {}, np.empty((1 << 14, len(model.langs)), np.float32)
        self.can = np.array([model.scripts[k] for k in range(len(_NAMES))])

    def of(self, texts: list[list[str]]) -> list[np.ndarray]:
        if len(self.known) > MEMORY:
            self.known = {}
        new = list({w for t in texts for w in t if w not in self.known})
        if new:
            cells, begins = _grams(new)
            s = np.add.reduceat(self.model.logs[cells], begins, axis=0)
            which = _SCRIPT_OF[np.searchsorted(_LAST, np.fromiter((ord(w[0]) for w in new), np.int64, len(new)))]
            can = self.can[which]
            s[~can & can.any(axis=1, keepdims=True)] = -np.inf
            s = np.maximum(s - s.max(axis=1, keepdims=True), -BOUND)
            s[~can.any(axis=1)] = 0
            n = len(self.known)
            self.known.update(zip(new, range(n, n + len(new))))
            while len(self.rows) < n + len(new):
                self.rows = np.concatenate([self.rows, np.empty_like(self.rows)])
            self.rows[n : n + len(new)] = s
        get = self.known.__getitem__
        return [self.rows[np.fromiter(map(get, t), np.int64, len(t))] for t in texts]


def viterbi(s: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best label of each row of ``s`` (words, languages)."""
    best = int(s.sum(axis=0, dtype=np.float64).argmax())
    rise = np.cumsum(s - s[:, best : best + 1], axis=0, dtype=np.float64)
    low = np.minimum(np.minimum.accumulate(rise, axis=0), 0)
    rise[1:] -= low[:-1]
    if rise.max(initial=0) <= switch:
        return np.full(len(s), best)
    n, langs = s.shape
    back = np.empty((n, langs), np.int32)
    value = s[0].tolist()
    rows, own = s.tolist(), list(range(langs))
    back[0] = own
    for t in range(1, n):
        top = max(value)
        at, least = value.index(top), top - switch
        froms = [k if value[k] >= least else at for k in own]
        back[t] = froms
        value = [max(v, least) + x for v, x in zip(value, rows[t])]
    out = np.empty(n, np.int64)
    out[-1] = int(np.argmax(value))
    for t in range(n - 1, 0, -1):
        out[t - 1] = back[t, out[t]]
    return out


def decide(s: np.ndarray, lengths: np.ndarray, labels: np.ndarray) -> tuple[int, float]:
    """The language that holds most letters, and a score from 0 to 1.

    The score is the share of letters under that label times how clearly an average word
    there speaks for it rather than for the next best language.
    """
    letters = np.bincount(labels, lengths, s.shape[1])
    best = int(letters.argmax())
    own = s[labels == best]
    rest = np.delete(own, best, axis=1)
    margin = float((own[:, best] - rest.max(axis=1)).mean()) if rest.size else BOUND
    return best, float(letters[best] / letters.sum() * (1 / (1 + np.exp(-4 * margin))))


class Judge:
    """What a task knows of the languages."""

    def __init__(self, model: Model):
        self.model, self.scorer = model, Scorer(model) if model.langs else None

    def of(self, texts: list[str], spans: bool = False) -> Iterator[tuple[str, float, list[dict]]]:
        """Language, score and spans of each text."""
        words = [words_in(t) for t in texts]
        langs = self.model.langs
        for text, w, s in zip(texts, words, self.scorer.of(words) if self.scorer else [None] * len(texts)):
            if not w or s is None:
                yield "und", 0.0, []
                continue
            labels = viterbi(s)
            best, score = decide(s, np.fromiter(map(len, w), np.int64, len(w)), labels)
            found = []
            if spans:
                at = [(m.start(), m.end()) for m in _ANY.finditer(text)]
                if len(at) != len(w):  # lower-casing has split or joined a word
                    at = [(m.start(), m.end()) for m in _ANY.finditer(text.lower())]
                cuts = [0, *(np.flatnonzero(np.diff(labels)) + 1).tolist(), len(w)]
                found = [{"start": at[i][0], "stop": at[j - 1][1], "lang": langs[labels[i]]} for i, j in zip(cuts, cuts[1:])]
            yield langs[best], score, found


def _predict(shared, spans: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(shared.value)
        for batch in pieces(batches, 1):
            preds, scores, found = zip(*judge.of([x or "" for x in batch.column(1).to_pylist()], spans))
            out = [batch.column(0), pa.array(preds, pa.string()), pa.array(scores, pa.float64())]
            names = ["doc_id", "lang_pred", "score"]
            if spans:
                out.append(pa.array(found, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("lang", pa.string())]))))
                names.append("spans")
            for c in range(2, batch.num_columns):
                out.append(batch.column(c)), names.append(batch.schema.names[c])
            yield pa.RecordBatch.from_arrays(out, names=names)

    return run


def identify(docs: DataFrame, model: Model, spans: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """``(doc_id, lang_pred, score)``, with ``spans`` also the labelled spans (code points), and the columns to ``keep``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    slim = docs.select("doc_id", "text", *(F.col(c) for c in keep))
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double" + ", spans array<struct<start:bigint,stop:bigint,lang:string>>" * spans
    return slim.mapInArrow(_predict(shared, spans), schema + "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in keep))


#: Texts whose language has a lower score than this are rejected, as ``und`` ones are.
REJECT = 0.25


def identified(docs: DataFrame, model: Model, least: float = REJECT) -> DataFrame:
    """``docs`` without the rows whose language can't be told."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(shared.value)
        for batch in pieces(batches, at):
            yield batch.filter(pa.array([p != "und" and s >= least for p, s, _ in judge.of([x or "" for x in batch.column(at).to_pylist()])], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
