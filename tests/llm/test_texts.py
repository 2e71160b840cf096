"""Near duplicates, language, decontamination, language model, quality and toxicity."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from gritsieve.llm import common, decontam, langid, lm, neardup, quality, toxicity
from gritsieve.llm.common import held_out
from gritsieve.llm.labelled import sample, with_texts

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], SCHEMA)


def shingles(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {(len(w), *w)} if w else set()


def brute_classes(rows):
    sets = [shingles(t) for _, t, _ in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    least = {}
    for k, (i, _, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return [(i, len(sets[k]), i if not sets[k] else least.get(find(k))) for k, (i, _, _) in enumerate(rows)]


def edited(base, n, rng):
    w = list(base)
    for _ in range(n):
        w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
    return " ".join(w)


def near_rows():
    rng = random.Random(5)
    rows = [(0, None, "en"), (1, "", "en"), (2, " \n", "en"), (3, "one", "en"), (4, "ONE", "en"), (5, "a b c d", "en"), (6, "a b c d e", "en"), (7, "a b c d", "en")]
    base = [f"w{k}" for k in range(150)]
    rows += [(1000 - k, edited(base, k % 6, rng), "en") for k in range(240)]  # a blob about the threshold
    for g in range(20):
        own = [f"g{g}_{k}" for k in range(rng.randrange(6, 300))]
        rows += [(2000 + 10 * g + k, edited(own, k // 2, rng), "en") for k in range(6)]
    rows += [(3000 + k, "the very same text of a good many words", "en") for k in range(50)]
    rows += [(None, "the very same text of a good many words", None), (None, "alone and without an id but with words", None), (3000, "the very same text of a good many words", "en")]
    rows += [(4000, " ".join(f"long{k % 9999}" for k in range(60_000)), "en")]
    return rows


@pytest.mark.parametrize("chunk", [512, 16])
def test_near_duplicates(spark, monkeypatch, chunk):
    monkeypatch.setattr(neardup, "CHUNK_ROWS", chunk)
    rows = near_rows()
    got = neardup.classes(docs(spark, rows).withColumn("key", F.lit(1)).withColumn("band", F.lit(2))).collect()
    assert sorted(str((r.doc_id, r.n_shingles, r.component_id)) for r in got) == sorted(map(str, brute_classes(rows)))
    assert all(r.kept == (r.doc_id is not None and r.doc_id == r.component_id) for r in got)


def test_one_of_each_class_stays(spark):
    rows = near_rows()
    left = neardup.dedup(docs(spark, rows)).collect()
    classes = brute_classes(rows)
    want = len({c for _, n, c in classes if n and c is not None}) + 1 + 3  # a class without any id, and three blank texts
    assert len(left) == want
    assert neardup.dedup(docs(spark, [])).count() == 0


def test_estimate_is_corrected_for_chance(spark):
    rng = np.random.default_rng(0)
    rows = []
    for share in (0.0, 0.5, 0.75, 1.0):
        for _ in range(40):
            n = 400
            common = rng.integers(0, 2**63, int(2 * n * share / (1 + share)), np.uint64)
            x, y = (np.unique(np.concatenate([common, rng.integers(0, 2**63, n - len(common), np.uint64)])) for _ in "ab")
            rows.append((share, neardup.packed(neardup.minima(x)).tolist(), neardup.packed(neardup.minima(y)).tolist()))
    df = spark.createDataFrame(rows, "share double, a array<long>, b array<long>")
    for r in df.groupBy("share").agg(F.avg(neardup.estimate(F.col("a"), F.col("b"))).alias("e")).collect():
        assert abs(r.e - r.share) < 0.03


def prose(rng, parts, n):
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randrange(1, 4))) for _ in range(n))


LANGS = {"aa": ["the", "er", "ing", "ow"], "bb": ["eau", "oi", "que", "é"], "cc": ["жа", "ри", "ско"]}


def language_rows():
    rng = random.Random(2)
    return [(i, prose(rng, LANGS[lang], rng.randrange(5, 60)), lang) for i in range(300) for lang in [rng.choice(list(LANGS))]]


def test_language(spark):
    rows = language_rows()
    df = docs(spark, [*rows, (900, None, "aa"), (901, "12 !?", "bb"), (902, "", None), (903, "θεω", None), (904, rows[0][1], None), (904, rows[0][1], None)])
    model = langid.learn(df.filter(~held_out(5)))
    got = {r.doc_id: r for r in langid.identify(df, model, spans=True).collect()}
    assert sum(got[i].lang_pred == lang for i, _, lang in rows) >= 0.98 * len(rows)
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (900, 901, 902)) and got[903].lang_pred in LANGS
    assert langid.identify(df, model).count() == 306 and all(0 <= r.score <= 1 for r in got.values())
    assert langid.identified(df, model).columns == df.columns and langid.identified(df, model).filter("doc_id in (900, 901, 902)").count() == 0


def test_spans_of_mixed_text(spark):
    rng = random.Random(9)
    a, b = prose(rng, LANGS["aa"], 40), prose(rng, LANGS["bb"], 30)
    train = docs(spark, language_rows())
    got = langid.identify(docs(spark, [(1, f"{a}. {b}", None)]), langid.learn(train), spans=True).first()
    assert [s.lang for s in got.spans] == ["aa", "bb"] and got.lang_pred == "aa"
    assert abs(got.spans[0].stop - len(a)) < 15


def test_viterbi_against_enumeration():
    from itertools import product

    rng = np.random.default_rng(4)
    for _ in range(60):
        s = np.maximum(rng.normal(0, 3, (7, 3)), -9)
        value = lambda p: s[np.arange(7), list(p)].sum() - 4.0 * sum(x != y for x, y in zip(p, p[1:]))  # noqa: B023, E731
        assert math.isclose(value(langid.viterbi(s, 4.0)), max(map(value, product(range(3), repeat=7))))


def test_no_labels(spark):
    df = docs(spark, [(i, "some words", None) for i in range(5)])
    assert {r.lang_pred for r in langid.identify(df, langid.learn(df)).collect()} == {"und"}


def benchmark(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


def test_decontamination(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 6)))
    items = [(k, " ".join(word() for _ in range(40))) for k in range(12)] + [(50, None), (51, "two words"), (52, "")]
    plain = lambda n: " ".join(word() for _ in range(n))
    rows, want = [(i, plain(120), "en") for i in range(60)], set()
    for k in range(12):
        w = items[k][1].split()
        for _ in range(4 if k % 2 else 0):
            w[rng.randrange(len(w))] = word()
        rows.append((100 + k, f"{plain(30)} {' '.join(w).upper()}, {plain(50)}", "en"))
        want.add((100 + k, k))
    rows += [(200, None, None), (201, "", None), (None, items[3][1], None), (202, items[0][1] + " " + plain(20_000) + " " + items[1][1], None), (202, items[0][1], None)]
    want |= {(None, 3), (202, 0), (202, 1)}
    df = docs(spark, rows).withColumn("item_id", F.lit(1))
    b = benchmark(spark, items)
    got = decontam.leaks(df, b).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want)
    assert all(0.5 <= r.score <= 1 for r in got)
    assert sorted(r.doc_id for r in decontam.decontaminate(df, b).collect()) == sorted([*range(60), 200, 201])
    assert decontam.leaks(df, benchmark(spark, [])).count() == 0 and decontam.decontaminate(docs(spark, []), b).count() == 0


def test_word_codes(monkeypatch):
    texts = ["Ab c, d!", None, "", "é« x » y", "one " * 100, "c ab D", "one\u2014ab"]
    whole, n = decontam.codes(texts)
    assert list(n) == [3, 0, 0, 3, 100, 3, 2]
    first = np.cumsum(n) - n
    assert list(whole[:3]) == list(whole[first[5] :][[1, 0, 2]]) and len(set(whole[first[4] : first[5]])) == 1
    assert whole[first[6]] == whole[first[4]] and whole[first[6] + 1] == whole[0] and len(set(whole)) == 7
    monkeypatch.setattr(common, "_WINDOW", 16)
    assert np.array_equal(decontam.codes(texts)[0], whole)


def test_items_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK_WORDS", 30)
    items = [(k, " ".join(f"i{k}w{j}" for j in range(20))) for k in range(7)]
    df = docs(spark, [(k, f"before {t} after", "en") for k, t in items])
    assert {(r.doc_id, r.item_id) for r in decontam.leaks(df, benchmark(spark, items)).collect()} == {(k, k) for k in range(7)}
    assert decontam.decontaminate(df, benchmark(spark, items)).count() == 0


@pytest.mark.parametrize("least", [0.5, 0.3])
def test_regular_edits_against_brute_force_alignment(spark, least):
    rng = random.Random(9)
    word = lambda: f"w{rng.randrange(3000)}"
    items = [(k, " ".join(word() for _ in range(n))) for k, n in enumerate([3, 4, 7, 20, 33, 60])]
    rows = [(i, " ".join(word() for _ in range(200))) for i in range(40)]
    for _, t in items:
        for every in range(1, 8):
            w = t.split()
            replaced = [word() if j % every == 0 else x for j, x in enumerate(w)]
            dropped = [x for j, x in enumerate(w) if j % every or every == 1]
            added = [y for j, x in enumerate(w) for y in ([x, word()] if j % every == 0 else [x])]
            for copy in (replaced, dropped, added):
                rows.append((len(rows), " ".join([*(word() for _ in range(rng.randrange(90))), *copy, *(word() for _ in range(rng.randrange(90)))])))
    rows += [(len(rows) + k, " ".join(f"w{rng.randrange(3)}" for _ in range(150))) for k in range(5)]
    items += [(10 + k, " ".join(f"w{rng.randrange(6)}" for _ in range(12))) for k in range(5)]
    want = {}
    for i, t in rows:
        for k, x in items:
            score = decontam.align(decontam.codes([x])[0], decontam.codes([t])[0])[0] / (2 * len(x.split()))
            if score >= least:
                want[i, k] = score
    got = decontam.leaks(docs(spark, [(*r, None) for r in rows]), benchmark(spark, items), least)
    assert {(r.doc_id, r.item_id): r.score for r in got.collect()} == want and len(want) > 100


def test_alignment_against_plain_recurrence():
    rng = np.random.default_rng(0)
    for _ in range(50):
        a, b = rng.integers(0, 4, 9), rng.integers(0, 4, 12)
        h = np.zeros((10, 13), int)
        for i in range(1, 10):
            for j in range(1, 13):
                h[i, j] = max(0, h[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
        assert decontam.align(a, b)[0] == h.max()


def lm_rows():
    rng = random.Random(8)
    words = [f"v{k}" for k in range(3000)]
    rows = []
    for i in range(300):
        w, t = rng.choice(words), []
        for _ in range(rng.randrange(1, 80)):
            w = words[(int(w[1:]) * 7 + rng.randrange(5)) % 3000] if rng.random() < 0.8 else rng.choice(words)
            t.append(w)
        rows.append((i, " ".join(t), "en"))
    return [*rows, (1000, None, None), (1001, "", None), (1002, "never seen before", None), (None, "V1 v2", None), (1003, "v1 " * 50_000, None), (5, "v5 v6", "en")]


@pytest.mark.parametrize("small", [False, True])
def test_language_model(spark, monkeypatch, small):
    rows = lm_rows()
    if small:  # many chunks, wards and contexts that are dealt out
        monkeypatch.setattr(lm, "HOT", 3)
        monkeypatch.setattr(lm, "CHUNK", 900)
        monkeypatch.setattr(lm, "WARD", 2000)
    got = lm.score(docs(spark, rows).withColumn("row", F.lit(1)), held_out(10)).collect()
    out = lambda i: i is None or zlib.crc32(str(i).encode()) % 10 == 0
    tokens = lambda t: [*"".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").split(), "</>"]
    counts = Counter(w for i, t, _ in rows if not out(i) for w in tokens(t))
    total, distinct = sum(counts.values()), len(counts)
    want = []
    for i, t, _ in rows:
        w = tokens(t)
        want.append((i, out(i), len(w), sum(counts[x] > 0 for x in w), total, round(sum(math.log10((counts[x] + 0.1) / (total + 0.1 * (distinct + 1))) for x in w), 4)))
    assert sorted(str((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4))) for r in got) == sorted(map(str, want))
    assert all(r.score < 0 for r in got)
    test = [r for r in got if r.held_out]
    assert sum(r.score for r in test) > sum(r.base_score for r in test)


def test_no_count_is_a_mean(spark, monkeypatch):
    """Scores are the same however few words all tasks hold."""
    rows = [r for r in lm_rows() if r[0] != 1003]
    monkeypatch.setattr(lm, "CHUNK", 5000)
    scores = lambda: sorted((r.doc_id or -1, r.n_tokens, r.score) for r in lm.score(docs(spark, rows), held_out(10)).collect())
    every = scores()
    monkeypatch.setattr(lm, "HOT", 3)
    assert scores() == every


def seatings(c, t, d):
    """log of a generalized Stirling number."""
    s = {(0, 0): 1.0}
    for n in range(c):
        for k in range(n + 2):
            s[n + 1, k] = s.get((n, k - 1), 0.0) + (n - d * k) * s.get((n, k), 0.0)
    return math.log(s[c, t])


@pytest.mark.parametrize(("c", "alpha", "delta"), [(2, 0.4, 0.1), (3, 0.4, 0.05), (6, 2.0, 0.2), (20, 1.5, 0.01), (40, 0.3, 0.02)])
def test_tables_against_their_exact_distribution(c, alpha, delta):
    d, n = 0.6, 40_000
    weight = np.array([seatings(c, t, d) + sum(math.log(alpha + delta * j) for j in range(1, t)) for t in range(1, c + 1)])
    exact = np.exp(weight - weight.max())
    exact /= exact.sum()
    got = np.bincount(lm.draw_tables(np.full(n, c), np.full(n, alpha), np.full(n, delta), d, np.random.default_rng(0)), minlength=c + 1)[1:] / n
    assert abs(got - exact).sum() / 2 < 0.04 and abs((got - exact) @ np.arange(1, c + 1)) < 0.1 * (exact @ np.arange(1, c + 1))


@pytest.mark.parametrize(("alpha", "delta"), [(2.0, 0.01), (0.01, 0.0001), (300.0, 0.05)])
def test_many_customers_in_groups(monkeypatch, alpha, delta):
    """Seating in groups comes near to seating all customers one by one."""
    c, n, draw = 1500, 4000, lambda: lm.draw_tables(np.full(n, c), np.full(n, alpha), np.full(n, delta), 0.5, np.random.default_rng(0))
    grouped = draw()
    monkeypatch.setattr(lm, "groups", lambda most: ((k, 1) for k in range(1, most)))
    single = draw()
    assert abs(grouped.mean() / single.mean() - 1) < 0.03


def test_sweeps_against_a_plain_sampler(monkeypatch):
    """Tables of a small restaurant against Gibbs sampling by exact conditionals with the same parent."""
    counts = np.array([12, 7, 5, 3, 2, 2, 1, 1, 1, 1])
    words = np.arange(10, dtype=np.uint64)
    known = lm.Known(words, counts * 1, int(counts.sum()), 10, 0)
    rest, rooms = np.zeros(10, np.int64), np.ones(1, np.int64)
    rng, theta = np.random.default_rng(1), 2.0
    monkeypatch.setattr(lm, "draw_strength", lambda *_: theta)
    monkeypatch.setattr(lm, "BURN_IN", 30)
    monkeypatch.setattr(lm, "SAMPLES", 900)
    _, got, d, _ = lm.sweep(counts, rest, words, rooms, known, rng)
    t, seen = np.ones(10, int), []
    for k in range(900):
        band = np.log2(counts).astype(int)
        opened = np.bincount(band, t, 8) / np.maximum(np.bincount(band, counts, 8), 1)
        h = counts * opened[band] / (counts * opened[band]).sum()
        for i in range(10):
            others = theta + d * (t.sum() - t[i])
            w = np.array([seatings(int(counts[i]), s, d) + sum(math.log(h[i] * (others + d * j)) for j in range(s)) for s in range(1, counts[i] + 1)])
            w = np.exp(w - w.max())
            t[i] = 1 + rng.choice(len(w), p=w / w.sum())
        if k > 50:
            seen.append(t.copy())
    assert np.allclose(got, np.mean(seen, axis=0), rtol=0.08)


def test_predictive_probabilities_sum_to_one(spark, monkeypatch):
    """Contexts' masses: what is not given to their own words is given to the parent."""
    monkeypatch.setattr(lm, "CHUNK", 900)
    df = docs(spark, [r for r in lm_rows() if r[0] != 1003]).select("doc_id", "text").withColumn("held_out", F.lit(False))
    chunked = lm.chunks(df).cache()
    k = lm.known(chunked, 3)
    shared = spark.sparkContext.broadcast(k)
    asks = chunked.select("chunk", "held", "sizes", "codes", "tokens").mapInArrow(lm._ask_pairs(shared), lm.ROWS).cache()
    seated = lm._dealt(asks, 8).mapInArrow(lm._seat(shared, 3), lm.ROWS).filter(F.col("kind") == lm.PAIRS).collect()
    asked = {(r.part, r.chunk): r for r in asks.collect()}
    masses, strength, fresh = defaultdict(dict), {}, {}
    for r in seated:
        q = asked[r.part, r.chunk]
        head = lm.unpacked(q.a, np.uint64)
        u, n = head[: len(head) // 2], head[len(head) // 2 :].astype(int)
        for context, w, m in zip(np.repeat(u, n).tolist(), lm.unpacked(q.b, np.uint64).tolist(), lm.unpacked(r.a, np.float32).tolist()):
            masses[context][w] = m
        fresh |= dict(zip(u.tolist(), lm.unpacked(r.b, np.float32).tolist()))
        strength |= dict.fromkeys(u.tolist(), lm.unpacked(r.c, float)[0])
    tokens = Counter(x for r in chunked.collect() for x in np.repeat(lm.unpacked(r.codes, np.uint64), lm.unpacked(r.counts, np.int32)).tolist())
    whole = {u: strength[u] + tokens[u] for u in fresh}
    assert len(whole) > 2000 and all(math.isclose(sum(masses[u].values()) + fresh[u], whole[u], rel_tol=1e-5) for u in whole)
    asks = chunked.select("chunk", "codes", "counts").mapInArrow(lm._ask_words(3), lm.ROWS)
    rooted = lm._dealt(asks, 8).mapInArrow(lm._seat_root(k.total, k.distinct), lm.ROWS).collect()
    word_mass = {}
    words = {(r.part, r.chunk): r for r in asks.collect()}
    for r in rooted:
        if r.kind == lm.WORDS:
            word_mass |= dict(zip(lm.unpacked(words[r.part, r.chunk].a, np.uint64).tolist(), lm.unpacked(r.b, np.float32).tolist()))
    sums = [lm.unpacked(r.a, float) for r in rooted if r.kind == lm.ROOT]
    assert len(word_mass) == k.distinct and math.isclose(sum(word_mass.values()) + sum(a[2] for a in sums), sum(a[0] for a in sums), rel_tol=1e-5)


def test_log_gamma():
    x = np.array([0.01, 0.3, 1.0, 2.5, 17.0, 1e6])
    assert np.allclose(lm.log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-9, atol=1e-9)


def test_language_model_of_an_empty_table(spark):
    assert lm.score(docs(spark, []), held_out(10)).count() == 0


def test_no_training_rows(spark):
    got = lm.score(docs(spark, [(None, "a b", None)]), held_out(10)).first()
    assert (got.n_tokens, got.n_known, got.train_tokens, got.base_score) == (3, 0, 0, 0.0) and math.isfinite(got.score)


def labelled(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(400):
        good, toxic = rng.random() < 0.8, rng.random() < 0.25
        w = [rng.choice(["the", "river", "house", "walks", "green", "over", "table", "nine"]) for _ in range(rng.randrange(30, 90))]
        for _ in range(rng.randrange(2, 5) if toxic else 0):
            w.insert(rng.randrange(len(w)), rng.choice(["vilest", "rotter", "snakeoid", "snakeish"]))
        t = " ".join(w) if good else " ".join(x.upper() + "!!" for x in w)
        rows.append((i, t, "en"))
        labels.append((i, int(good), int(toxic)))
    rows += [(900, None, None), (901, "", None), (None, "x", None), (902, rows[0][1], None), (902, rows[0][1], None)]
    return docs(spark, rows).withColumn("y", F.lit(1)).withColumn("score", F.lit(2)), spark.createDataFrame([*labels, (0, None, None), (1, 1, 0)], "doc_id long, quality int, toxic int"), labels


@pytest.mark.parametrize(("operator", "column"), [(quality, 1), (toxicity, 2)])
def test_classifiers(spark, operator, column):
    df, labels, truth = labelled(spark)
    model = operator.learn(df, labels)
    rows = operator.score(df, model).collect()
    got = {r.doc_id: r for r in rows}
    assert len(rows) == 405 and all(0 <= r.score <= 1 and r.predicted == (r.score >= (0.3 if operator is quality else 0.5)) for r in rows)
    test = [t for t in truth if zlib.crc32(str(t[0]).encode()) % 5 == 0]
    assert sum(got[t[0]].predicted == t[column] for t in test) >= 0.95 * len(test)
    again = operator.score(df.repartition(3), operator.learn(df.repartition(5), labels)).collect()
    assert all(math.isclose(got[r.doc_id].score, r.score, abs_tol=1e-6) for r in again)


@pytest.mark.parametrize("operator", [quality, toxicity])
def test_labels_of_one_kind_or_none(spark, operator):
    df, labels, _ = labelled(spark)
    for some in (labels.limit(0), labels.filter("quality = 1 and toxic = 0")):
        assert operator.score(df, operator.learn(df, some)).count() == 405
    assert operator.score(df.limit(0), operator.learn(df, labels)).count() == 0


def test_a_hot_id_does_not_outgrow_the_sample(spark):
    many = spark.range(2000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("toxic"))
    hot = spark.range(100_000).select(F.lit(3).cast("long").alias("doc_id"), F.lit(1).alias("toxic"))
    chosen = sample(many.unionByName(hot), "toxic", 400)
    assert 300 < chosen.count() < 500 and sample(hot, "toxic", 400).count() == 1
    df = docs(spark, [(3, f"copy {k}", "en") for k in range(50)] + [(6, None, "en")])
    pairs = spark.createDataFrame([(3, 1), (3, 1), (6, 0)], "doc_id long, y int")
    assert sorted((r.doc_id, r.y) for r in with_texts(df, pairs.distinct()).collect()) == [(3, 1), (6, 0)]


@pytest.mark.parametrize("operator", [quality, toxicity])
def test_classifiers_take_very_long_texts(spark, operator):
    df, labels, _ = labelled(spark)
    model = operator.learn(df, labels)
    rows = operator.score(docs(spark, [(1, "river vilest " * 150_000, "en"), (2, "x" * 2_000_000, "en"), (2, "x" * 2_000_000, "en")]), model).collect()
    assert len(rows) == 3 and all(0 <= r.score <= 1 for r in rows) and len({r.score for r in rows if r.doc_id == 2}) == 1


def test_voters_that_follow_the_label_keep_their_weight():
    rng = np.random.default_rng(3)
    y = rng.random(4000) < 0.3
    v = np.column_stack([(rng.random(4000) < np.where(y, 0.9, 0.02)).astype(float) for _ in range(4)] + [np.zeros(4000)])
    v[:, -1] = -1.0 * (v[:, :-1].sum(axis=1) == 0)
    posterior, weight = toxicity.label_model(v, 0.3)
    assert (weight[:4] > 0.6).all() and ((posterior > 0.5) == y).mean() > 0.93


def test_correlated_voters_count_once():
    rng = np.random.default_rng(0)
    y = rng.random(2000) < 0.3
    a = ((rng.random(2000) < np.where(y, 0.8, 0.05))).astype(float)
    b = ((rng.random(2000) < np.where(y, 0.8, 0.05))).astype(float)
    v = np.column_stack([a, a, a, b, -((a + b) == 0).astype(float)])
    posterior, weight = toxicity.label_model(v, 0.3)
    assert weight[0] < 0.5 and weight[3] > weight[0] and ((posterior > 0.5) == y).mean() > 0.9


def test_words_of_many_scripts():
    got = langid.words_in("हिन्दी भाषा Hello wörld приветhello 漢字仮名交じり文 x²y 12 éa")
    assert got == ["हिन्दी", "भाषा", "hello", "wörld", "привет", "hello", "漢字仮名", "交", "じり", "文", "x", "y", "éa"]
    for text in ("only plain words, l'été", "12 !?", "", "z" * 100_000, "dash \u2014 \u201cquote\u201d \u2190 \u20ac3"):
        assert langid.words_in(text) == langid._ANY.findall(text.lower())


def test_pieces_are_bounded_by_bytes():
    import pyarrow as pa

    from gritsieve.llm.common import pieces

    texts = ["a" * 10, None, "b" * 3_000_000, "", "c" * 500_000, "d" * 500_000, "e" * 500_000]
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(texts)], names=["i", "t"])
    got = list(pieces(iter([batch, batch.slice(0, 0)]), 1))
    assert [x for b in got for x in b.column(1).to_pylist()] == texts
    assert all(sum(len(x or "") for x in b.column(1).to_pylist()) < 2 << 20 or b.num_rows <= 3 for b in got) and len(got) > 2


def test_a_long_word_is_hashed_whole(monkeypatch):
    word = "x" * 200_000
    a, n = decontam.codes([f"{word} tail", f"{word}y tail", word, "head " + word])
    assert list(n) == [2, 2, 1, 2] and a[0] == a[4] == a[6] != a[2] and a[1] == a[3]
    monkeypatch.setattr(common, "_WINDOW", 1 << 12)
    assert np.array_equal(decontam.codes([f"{word} tail", f"{word}y tail", word, "head " + word])[0], a)


def test_long_texts_are_searched_in_stretches(spark, monkeypatch):
    monkeypatch.setattr(decontam, "STRETCH", 64)
    rng = random.Random(1)
    items = [(k, " ".join(f"i{rng.randrange(400)}" for _ in range(15))) for k in range(6)]
    text = " ".join(w for k in range(60) for w in [*(f"z{rng.randrange(10**6)}" for _ in range(rng.randrange(40))), items[k % 6][1] if k % 2 else items[k % 6][1][:40]])
    b = decontam.Items(items)
    b.choose(np.ones(len(b.distinct)))
    w, n = decontam.codes([text])
    short = list(b.search(decontam.Filter(b.seeds), w, n))
    monkeypatch.setattr(decontam, "STRETCH", 1 << 16)
    whole = list(b.search(decontam.Filter(b.seeds), w, n))
    assert [x[:3] for x in short] == [x[:3] for x in whole] and len(whole) == 6
