"""Winnowing, word tries and whitening against plain models, and the cases that they define."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np

from stridelake.llm import queries, whitening, winnowing, word_trie

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text):
    return WORD.findall((text or "").translate(LOW))


# ---- winnowing


def plain_contamination(docs, items):
    wins = {}
    for item, text in items:
        ws = words(text)
        n = min(len(ws), 10)
        for s in range(len(ws) - n + 1) if n else []:
            wins.setdefault(tuple(ws[s : s + n]), set()).add(item)
    sizes = {len(w) for w in wins}
    out = []
    for key, text in docs:
        ws = words(text)
        hit, found = set(), set()
        for n in sizes:
            for s in range(len(ws) - n + 1):
                own = wins.get(tuple(ws[s : s + n]))
                if own:
                    hit |= set(range(s, s + n))
                    found |= own
        found.discard(None)
        out.append((key, len(ws), len(hit), sorted(map(str, found)), bool(hit)))
    return sorted(out, key=str)


def contaminated(spark, docs, items, **more):
    d = spark.createDataFrame([(k, t, "x") for k, t in docs], "doc_id bigint, text string, n_hit string")
    i = spark.createDataFrame([(k, t, 1) for k, t in items], "item_id bigint, text string, len int")
    got = winnowing.contamination(d, i, **more).collect()
    assert all(r.n_items == len(r.item_ids) for r in got)
    return sorted(((r.doc_id, r.n_words, r.n_hit, r.item_ids, r.contaminated) for r in got), key=str)


def corpus(seed, n=40, vocabulary=30):
    """Items, and documents with whole, cut, joined and rewritten pieces of them among words that repeat often."""
    rnd = random.Random(seed)
    vocab = [f"w{k}" for k in range(vocabulary)] + ["É", "ñez", "straße"]
    say = lambda k: [rnd.choice(vocab) for _ in range(k)]
    items = [(k, " ".join(say(rnd.choice([3, 7, 10, 11, 25])))) for k in range(12)] + [(3, " ".join(say(14))), (None, " ".join(say(12))), (50, None), (51, " .. ")]
    docs = []
    for k in range(n):
        text = []
        for _ in range(rnd.randrange(5)):
            own = (rnd.choice(items)[1] or "").split()
            a, b = sorted(rnd.randrange(len(own) + 1) for _ in range(2)) if own else (0, 0)
            text += say(rnd.randrange(9)) + (own[a:b] if rnd.random() < 0.5 else own)
        docs.append((k % (n - 3), rnd.choice([" ", ", ", " -- "]).join(w.upper() if rnd.random() < 0.2 else w for w in text)))
    return docs + [(None, docs[0][1]), (7, None), (8, ""), (9, "!?")], items


def test_contamination_against_a_plain_model(spark):
    for seed, vocabulary in ((1, 30), (2, 3), (3, 400)):
        docs, items = corpus(seed, vocabulary=vocabulary)
        assert contaminated(spark, docs, items) == plain_contamination(docs, items)


def test_large_benchmarks_and_long_texts_go_other_ways(spark, monkeypatch):
    docs, items = corpus(4)
    want = plain_contamination(docs, items)
    monkeypatch.setattr(winnowing, "BROADCAST", -1)
    assert contaminated(spark, docs, items) == want
    monkeypatch.setattr(winnowing, "PLACE", 3)  # places count around after eight words
    assert contaminated(spark, docs, items) == want


def test_empty_tables_and_giant_words(spark):
    long = "a" * 300_000
    assert contaminated(spark, [], [(1, "one two three")]) == []
    assert contaminated(spark, [(1, "one two")], []) == [(1, 2, 0, [], False)]
    assert contaminated(spark, [(1, f"{long} b"), (2, "x " * 200_000)], [(5, long), (6, " x" * 12)]) == [(1, 2, 1, ["5"], True), (2, 200_000, 200_000, ["6"], True)]


# ---- word tries


def features(text):
    ws = words(text)
    return [" ".join(ws[i : i + n]) for n in (1, 2, 3) for i in range(len(ws) - n + 1)]


def plain_draw(docs, target):
    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    s, t = (Counter(bucket(f) for text in texts for f in features(text)) for texts in ([x for _, x in docs], target))
    ss, tt = sum(s.values()) + 10_000, sum(t.values()) + 10_000
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * ss / ((s[b] + 1.0) * tt)))
    rows = []
    for key, text in docs:
        own = features(text)
        h = int(hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        w = sum(gain(bucket(f)) for f in own)
        rows.append([key, len(own), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(text))])
    able = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], math.inf if r[0] is None else r[0]))
    for k, r in enumerate(able[: len(able) * 5 // 100]):
        r[4] = k + 1
    return sorted(map(tuple, rows), key=str)


def draw(spark, docs, target):
    d = spark.createDataFrame([(k, t, 0) for k, t in docs], "doc_id bigint, text string, rank int")
    i = spark.createDataFrame([(t,) for t in target], "text string")
    return sorted((tuple(r[c] for c in ("doc_id", "n_features", "weight", "score", "rank", "n_words")) for r in word_trie.resample(d, i).collect()), key=str)


def tale(rnd, n):
    return " ".join(rnd.choice(["The", "cat", "ñu", "SAT", "on", "a", "mat-and", "é", "42", "İx", "z" * rnd.randrange(1, 40)]) for _ in range(n))


def test_draw_against_a_plain_model(spark):
    rnd = random.Random(5)
    docs = [(k, tale(rnd, rnd.choice([0, 1, 2, 3, 19, 20, 60, 200]))) for k in range(400)] + [(401, None), (402, " "), (None, tale(rnd, 50)), (5, tale(rnd, 30))]
    target = [tale(rnd, 40) for _ in range(10)] + [None, ""]
    assert draw(spark, docs, target) == plain_draw(docs, target)
    assert draw(spark, [], target) == [] and draw(spark, docs[:30], []) == plain_draw(docs[:30], [])


def test_tries_that_cut_texts_lose_no_run(monkeypatch):
    rnd = random.Random(6)
    texts = [tale(rnd, n) for n in (0, 1, 2, 5, 300, 3, 1, 700)] + [None]
    want = Counter(zlib.crc32(f.encode()) % 97 for t in texts for f in features(t))
    for piece, nodes in ((1 << 20, 400_000), (1, 1), (7, 2), (20, 3), (64, 10), (100, 64)):
        monkeypatch.setattr(word_trie, "PIECE", piece)
        total, n = np.zeros(97, np.int64), np.zeros(len(texts), np.int64)
        for trie, doc in word_trie.tries(texts, nodes):
            total += trie.totals(97)
            n += trie.collect(np.ones(97, np.int64), doc, len(texts))[1]
        assert dict(enumerate(total)) == {k: want[k] for k in range(97)} and n.tolist() == [len(features(t)) for t in texts]


def test_a_megabyte_of_text(spark):
    text = "ab cd " * 170_000
    got = draw(spark, [(1, text), (2, "x" * 1_000_000)], ["ab cd"])
    assert [r[1] for r in got] == [3 * 340_000 - 3, 1]


# ---- whitening


def test_double_doubles_keep_what_doubles_lose():
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(500, 3)) * 1e8, rng.normal(size=(500, 3)) * 1e-9
    i, j = np.triu_indices(3)
    h, l = whitening.added(*whitening.products(a, b, i, j))
    for k, (p, q) in enumerate(zip(i, j)):
        exact = sum((Fraction(a[r, p]) + Fraction(b[r, p])) * (Fraction(a[r, q]) + Fraction(b[r, q])) for r in range(500))
        assert abs(Fraction(h[k]) + Fraction(l[k]) - exact) <= abs(Fraction(1, 1 << 90)) * Fraction(500 * 10**17)


def whitened(spark, rows, **more):
    d = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, component string")
    return whitening.whiten(d, **more).collect()


def plain_whitened(rows):
    xs = {k: [math.floor(256 * float(np.float32(c))) for c in v] for k, v in rows}
    fit = sorted(set(map(tuple, xs.values())))
    n, dim = len(fit), len(fit[0])
    s = [sum(c) for c in zip(*fit)]
    d = [[Fraction(c) - Fraction(t, n) for c, t in zip(x, s)] for x in fit]
    cov = np.array([[float(sum(x[p] * x[q] for x in d) / n) for q in range(dim)] for p in range(dim)])
    e, v = np.linalg.eigh(cov)
    order = np.argsort(-e)[:4]
    return {k: (n, sum((n * c - t) ** 2 for c, t in zip(x, s)), [abs(sum(float(Fraction(c) - Fraction(t, n)) * v[i, o] for i, (c, t) in enumerate(zip(x, s)))) / math.sqrt(e[o]) for o in order], [e[o] / np.trace(cov) for o in order]) for k, x in xs.items()}


def test_whitening_against_exact_fractions(spark):
    rng = np.random.default_rng(2)
    made = rng.normal(size=(60, 6)) * [8, 4, 2, 1, 0.5, 0.1] + 30
    rows = [(k, [float(c) for c in v]) for k, v in enumerate(made)] + [(100, [float(c) for c in made[3]])]
    want = plain_whitened(rows)
    bad = [(200, None), (201, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (202, [float("nan")] * 6), (203, [float("inf")] * 6), (204, []), (205, [1.0])]
    got = whitened(spark, [(k, v, "x") for k, v in rows + bad])
    assert len(got) == 4 * 61 and {r.vec_id for r in got} == set(want) and {r.n for r in got} == {60}
    for r in got:
        n, deviation, white, explained = want[r.vec_id]
        assert r.deviation == deviation and math.isclose(r.explained, explained[r.component - 1], rel_tol=1e-9)
        assert math.isclose(abs(r.whitened), white[r.component - 1], rel_tol=1e-7, abs_tol=1e-9) and r.identity_error < 1e-9
    assert [r.whitened for r in got if r.vec_id == 100] == [r.whitened for r in got if r.vec_id == 3]


def test_whitening_of_nothing_and_of_one(spark):
    assert whitened(spark, []) == [] and whitened(spark, [(1, [1.0, 2.0], "x")] * 3) == []
    flat = whitened(spark, [(k, [float(k), 0.0, 5.0], "x") for k in range(4)])
    assert sorted({(r.component, r.n, r.explained) for r in flat}) == [(1, 4, 1.0)] and [round(r.whitened**2, 9) for r in sorted(flat, key=lambda r: r.vec_id)] == [1.8, 0.2, 0.2, 1.8]


def test_sums_beyond_a_long_and_a_tree_of_tasks(spark, monkeypatch):
    big = whitened(spark, [(k, [float(k * 2**26), 1.0], "x") for k in range(3)])
    assert sorted((r.vec_id, r.deviation) for r in big) == [(0, None), (1, 0), (2, None)]
    monkeypatch.setattr(whitening, "FAN", 2)
    rows = [(k, [float(k % 7), float(k % 5), float(k % 3)], "x") for k in range(105)]
    a = sorted((r.vec_id, r.component, round(abs(r.whitened), 9)) for r in whitened(spark, rows))
    monkeypatch.setattr(whitening, "FAN", 64)
    assert a == sorted((r.vec_id, r.component, round(abs(r.whitened), 9)) for r in whitened(spark, rows)) and len(a) == 315


def test_queries_have_the_columns_asked_for(spark):
    want = {"op11_winnowing": "doc_id n_words n_hit n_items items_sha256 contaminated", "op12_resampling": "doc_id n_features weight score rank", "op13_whitening": "vec_id component n deviation whitened explained identity_error"}
    for name, columns in want.items():
        assert queries.QUERIES[name](spark, "/root/testdata/sf0.001").columns == columns.split()
