"""Each operator against brute force or an exact round trip, with nulls, empties, ties, repeats and clashing names."""

import base64
import hashlib
import io
import math
import random
import re
import zipfile
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from stridelake.llm import bpe, langrank, mixing, nbsvm, pii, pstable, simhash_bk, substring_cms, warczip
from stridelake.llm.queries import VOCABULARY

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORDS = [a + b for a in ("ba", "de", "mo", "ti", "sou", "wha") for b in ("n", "ring", "le", "st", "the", "ou")]


def corpus(n=120, seed=1):
    rnd = random.Random(seed)
    say = lambda k: " ".join(rnd.choice(WORDS) for _ in range(k))
    rows = [(i, say(rnd.randrange(1, 90)), rnd.choice(["en", "fr"]), f"s{rnd.randrange(3)}", 1) for i in range(n)]
    shared = say(30)
    rows += [(n + i, f"{say(5)} {shared} {say(i % 4)}", "en", "s0", 1) for i in range(20)]
    rows += [(n + 50 + i, rows[i][1], "en", "s0", 1) for i in range(10)]
    return rows + [(n + 90, None, None, None, None), (n + 91, "", "en", "s1", 0), (n + 92, " \t ", "en", "s1", 3), (n + 93, shared, "en", "s1", 3), (n + 93, shared, "en", "s1", 3), (n + 94, "word " * 40_000, "en", "s9", 9)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).withColumns({"id": F.lit("x"), "text_": F.lit(1)}).repartition(3).cache()


def test_bpe_equals_the_public_library(spark, docs):
    ranks = bpe.read_ranks(public_tokenizers.path(VOCABULARY))
    codec = bpe.Codec(ranks, public_tokenizers.PATTERN, cache_entries=50)
    assert all(codec.whole.get(k) == v for k, v in ranks.items()) and codec.whole.get(b"qqzzqqzz") is None
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rnd = random.Random(4)
    for _ in range(3000):
        t = "".join(rnd.choice(list(" \n\t'sabcé中1٣.! 　\x1c\x85-_") + ["'ll", "  ", "word", "Überraschung"]) for _ in range(rnd.randrange(12)))
        ids = codec.encode(t)
        assert ids == known.encode_ordinary(t) and codec.decode(ids) == t.encode()
    rows = bpe.round_trip_digests(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN).collect()
    want = sorted((i, len(x := known.encode_ordinary(t or "")), hashlib.sha256(",".join(map(str, x)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t, *_ in corpus())
    assert sorted(map(tuple, rows)) == want
    back = bpe.decode_ids(bpe.encode_text(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)
    assert all(bytes(r.decoded) == (r.text or "").encode() for r in back.collect())
    assert bpe.encode_text(docs.limit(0), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN).count() == 0


def test_simhash_components_against_all_pairs(spark, docs):
    def fp(t):
        w = (t or "").encode().lower().split()
        sh = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(s, seed=42) for s in sh]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    rows = corpus()
    near = [(i, " ".join(t.split()[:-1] + ["x"])) for i, t, *_ in rows if t and i < 60]
    pairs = [(i, t) for i, t, *_ in rows] + [(i + 1000, t) for i, t in near]
    fps = {i: fp(t) for i, t in pairs}
    got = {r.doc_id: r for r in simhash_bk.simhash_components(spark.createDataFrame(pairs, "doc_id bigint, text string")).collect()}
    low = {i: i for i in fps}
    changed = True
    while changed:
        changed = False
        for a in fps:
            for b in fps:
                if (fps[a] ^ fps[b]).bit_count() <= 3 and low[a] != low[b]:
                    low[a] = low[b] = min(low[a], low[b])
                    changed = True
    assert all(got[i].fingerprint == f"{fps[i]:016x}" and got[i].component_id == low[i] for i in fps)
    assert spark.createDataFrame([("a b c",)], "t string").select(F.xxhash64("t")).first()[0] % 2**64 == xxhash.xxh64_intdigest("a b c", seed=42)
    assert simhash_bk.simhash_components(docs.limit(0)).count() == 0
    assert sorted(r.doc_id for r in simhash_bk.keep_first(docs).collect() if r.doc_id == 210 or r.doc_id == 211) == [210]


def test_bk_forest_finds_all_within_the_radius():
    rng = np.random.default_rng(0)
    fp = np.unique(rng.integers(0, 1 << 12, 500, dtype=np.uint64))
    forest = simhash_bk.BKForest(np.zeros(len(fp), np.int64), fp)
    i, j = forest.within(np.arange(len(fp)), 2)
    want = {(a, b) for a in range(len(fp)) for b in range(len(fp)) if (int(fp[a]) ^ int(fp[b])).bit_count() <= 2}
    assert set(zip(i.tolist(), j.tolist())) == want


@pytest.mark.parametrize("hot", [None, 3])
def test_repeated_windows_against_all_windows(spark, docs, monkeypatch, hot):
    if hot:
        monkeypatch.setattr(substring_cms, "max", lambda a, b: hot if a == 4096 else (a if a > b else b), raising=False)
    rows = [(i, (t or "").encode().split()) for i, t, *_ in corpus()]
    own = {}
    for i, w in rows:
        for k in range(len(w) - 12):
            own[tuple(w[k : k + 13])] = min(i, own.get(tuple(w[k : k + 13]), i))
    want = []
    for i, w in rows:
        gone = [False] * len(w)
        for k in range(len(w) - 12):
            if own[tuple(w[k : k + 13])] < i:
                gone[k : k + 13] = [True] * 13
        want.append((i, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()))
    assert sorted(map(tuple, substring_cms.remove_repeats(docs).collect())) == sorted(want)
    assert substring_cms.remove_repeats(docs.limit(0)).count() == 0


def test_warc_round_trip_and_zip_directories(spark):
    pages = [(3, "u", "same"), (1, "u", "same"), (2, None, None), (4, "u", ""), (None, "u", "same"), (None, "u", "alone"), (5, "u\n", "été"), (5, "v", "été")]
    got = warczip.round_trip(spark.createDataFrame(pages, "page_id bigint, url string, html string")).collect()
    dig = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    want = [(3, 4, dig("same"), "revisit", 1), (1, 4, dig("same"), "response", None), (2, 0, dig(""), "response", None), (4, 0, dig(""), "revisit", 2), (None, 4, dig("same"), "revisit", 1), (None, 5, dig("alone"), "response", None), (5, 5, dig("été"), "response", None), (5, 5, dig("été"), "response", None)]
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert warczip.round_trip(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w", zipfile.ZIP_STORED) as z:
        with z.open("archive/a", "w", force_zip64=True) as f:
            f.write(b"hello")
        z.writestr("packed", b"x" * 99, compress_type=zipfile.ZIP_DEFLATED)
        z.comment = b"PK\x05\x06 in a comment"
    inside = {m.name: m for m in warczip.members(raw, len(raw.getvalue()))}
    at, n = warczip.stored_range(raw, inside["archive/a"])
    assert raw.getvalue()[at : at + n] == b"hello"
    with pytest.raises(ValueError, match="compressed"):
        warczip.stored_range(raw, inside["packed"])
    with pytest.raises(ValueError, match="no end"):
        warczip.members(io.BytesIO(b"x" * 50), 50)


def test_cosine_links_against_all_pairs(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((120, 16))
    x = np.r_[x, x[:40] + rng.standard_normal((40, 16)) * 0.03, x[:5], x[:3]]
    rows = [(i, [float(v) for v in np.float32(r)], i % 3) for i, r in enumerate(x)]
    rows += [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, rows[0][1], None), (904, [], 0), (905, [None] * 16, 0), (906, rows[0][1][:8], 0)]
    got = {r.vec_id: r for r in pstable.cosine_links(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")).collect()}
    use = [(i, np.array(v), l) for i, v, l in rows[: len(x)]]
    link = lambda a, b: a[2] == b[2] and a[1] @ b[1] / np.linalg.norm(a[1]) / np.linalg.norm(b[1]) >= 0.98
    n = {a[0]: sum(link(a, b) for b in use if b is not a) for a in use}
    assert len(got) == len(rows) and all(got[i].n_links == n.get(i, 0) for i, *_ in rows)
    low = {i: i for i, *_ in rows}
    for _ in use:
        for a in use:
            for b in use:
                if low[b[0]] > low[a[0]] and link(a, b):
                    low[b[0]] = low[a[0]]
    assert any(n.values()) and {i: r.component_id for i, r in got.items()} == low
    assert all(got[i].kept == (got[i].component_id == i) for i, *_ in rows) and got[900].component_id == 900


def test_nearest_recall_and_contract(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((400, 24)) * rng.uniform(0.5, 2, (400, 1))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1020, [0.0] * 24), (1040, [float("inf")] * 24)]
    got = pstable.nearest(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), "vec_id % 20 = 0").collect()
    true = {(q, int(j)) for q in range(0, 400, 20) for j in np.argsort(-np.where(np.arange(400) == q, -np.inf, x @ x[q]), kind="stable")[:20]}
    assert len({(r.query_id, r.vec_id) for r in got} & true) / len(true) >= 0.9
    assert all(r.score == pytest.approx(x[r.query_id] @ x[r.vec_id], abs=1e-12) and r.vec_id != r.query_id for r in got)
    assert {r.query_id for r in got} == set(range(0, 400, 20))


def test_nearest_finds_all_of_few_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.standard_normal(24).tolist()) for i in range(15)] + [(100 + i, rng.standard_normal(7).tolist()) for i in range(4)] + [(200, [1.0, 2.0])]
    got = pstable.nearest(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), "true").collect()
    want = sorted((a, b) for a, x in rows for b, y in rows if a != b and len(x) == len(y))
    assert sorted((r.query_id, r.vec_id) for r in got) == want


def test_languages_and_quality_on_held_out_rows(spark):
    rnd = random.Random(8)
    sound = {"aa": ["the", "ing", "tion", "wh"], "bb": ["sch", "ung", "eit", "ß"], "cc": ["eau", "oi", "que", "é"]}
    say = lambda l: " ".join("".join(rnd.choice(sound[l]) for _ in range(rnd.randrange(1, 4))) for _ in range(40))
    rows = [(i, say(l := rnd.choice("abc") * 2), l) for i in range(150)] + [(500, None, "aa"), (501, "12 !", "aa"), (502, "the", None)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = {r.doc_id: r for r in langrank.predict_language(d, langrank.learn_profiles(d.where("crc32(cast(doc_id as string)) % 4 <> 2"))).collect()}
    assert all(got[i].lang_pred == l and 0 <= got[i].score <= 1 for i, t, l in rows[:150])
    assert (got[500].lang_pred, got[501].lang_pred, got[500].score) == ("und", "und", 0.0)
    empty = langrank.learn_profiles(d.limit(0))
    assert {r.lang_pred for r in langrank.predict_language(d, empty).collect()} == {"und"}
    bad = lambda t: " ".join(w + "###" for w in t.split())
    q = spark.createDataFrame([(i, bad(t) if i % 4 == 0 else t) for i, t, _ in rows[:150]] + [(500, None)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(150)] + [(500, None), (None, 1)], "doc_id bigint, quality int")
    s = {r.doc_id: r for r in nbsvm.score_quality(q, labels, "crc32(cast(doc_id as string)) % 5 <> 0").collect()}
    held = [i for i in range(150) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(s) == 151 and all(s[i].predicted == int(i % 4 != 0) for i in held)
    assert {r.score for r in nbsvm.score_quality(q, labels.limit(0), "true").collect()} == {0.5}


def test_surrogates(spark):
    text = "Foo.Bar7@mail3.example.com foo.bar7@MAIL3.example.com +1 (017) 555-7713, (017) 555-7713; 10.1.2.3 233.254.104.120 4111 1111 1111 1111 4111111111111111 Mr. John Smith, Mrs. Smith"
    rows = [(1, text), (2, None), (3, ""), (4, "In 2024, 12.5 of 1,000 were fine."), (1, text), (5, 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"')]
    d = spark.createDataFrame(rows, "doc_id int, text string").withColumn("k", F.lit(0))
    got = sorted(pii.replace_pii(d, "key").collect(), key=lambda r: r.doc_id)
    new = got[0].text
    assert got[1].text == new and len(got) == 6 and [r.n_entities for r in got] == [10, 10, 0, 0, 0, 1]
    assert got[2].text is None and got[3].text == "" and got[4].text == rows[3][1] and "04dbebab" not in got[5].text
    a, b = new.split(" ")[:2]
    assert a.lower() == b.lower() and a != text.split(" ")[0] and a.endswith(".com") and re.fullmatch(r"[A-Z]..\.[A-Z]..\d@[a-z]{4}\d\..*", a)
    phones = re.findall(r"\((\d{3})\) (\d{3}-\d{4})", new)
    assert phones[0] == phones[1] != ("017", "555-7713") and "+1 (" in new and " 10." in new
    cards = re.findall(r"\d{4} \d{4} \d{4} \d{4}|\d{16}", new)
    assert cards[0].replace(" ", "") == cards[1] and cards[1][0] == "4" and sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(cards[1][::-1])) % 10 == 0
    him, her = re.findall(r"Mrs?\. (?:(\w+) )?(\w+)", new)
    assert him[0] in pii.MALE and him[0] != "John" and him[1] == her[1] != "Smith"
    assert pii.replace_pii(d.limit(0), "key").count() == 0


def test_each_kind_of_entity_alone_passes_the_prefilter(spark):
    secrets = ["password: correcthorsebattery", "passwd=hunterhunter", 'PASSWORD = "AbCdEfGhIjKl"', "token:abcdefghij", "secret' = abcdefghij", "api_key=abcdefghij", "apikey=abcdefghij", "access-key: abcdefghij", "abcdef" * 6]
    others = ["foo.bar@mail.example", "4111 1111 1111 1111", "3782 822463 10005", "4111111111111111", "DE44500105175407324931", "10.1.2.3", "123-45-6789", "+1 (017) 555-7713", "(017) 555-7713", "017-555-7713", "ab12" * 9]
    names = [f"{a} {b}" for a in pii.ADDRESS.split("|") for b in ("Quimby", "Ёлкин")] + ["Dr. Quimby"]
    texts = [f"so {t} then" for t in secrets + others + names]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    left = d.where(F.col("text").rlike(pii.PATTERN) & ~F.col("text").rlike(pii.MAYBE) | ~F.col("text").rlike(pii.PATTERN)).collect()
    assert left == []
    got = {r.doc_id: r for r in pii.replace_pii(d, "key").collect()}
    assert [i for i, t in enumerate(texts) if got[i].n_entities != 1 or got[i].text == t] == []


def test_colliding_surrogates_go_on(spark, monkeypatch):
    real = pii._surrogate
    monkeypatch.setattr(pii, "_surrogate", lambda key, kind, norm, attempt: F.when(attempt == 0, F.lit("same")).otherwise(real(key, kind, norm, attempt)))
    d = spark.createDataFrame([(1, "10.1.2.3 and 10.1.2.4 and 10.1.2.3")], "doc_id int, text string")
    a, b, c = pii.replace_pii(d, "key").first().text.split(" and ")
    assert a == c != b
    monkeypatch.setattr(pii, "EXCEPTIONS", 0)
    assert pii.replace_pii(d, "key").first().text == f"{a} and {b} and {c}"


def test_mixing(spark, docs):
    a = mixing.poisson_mix(docs, "s")
    assert a.columns == [*docs.columns, "copy", "shuffle_key"]
    rows = [tuple(r) for r in a.collect()]
    assert rows == sorted(rows, key=lambda r: r[-1]) and rows == [tuple(r) for r in mixing.poisson_mix(docs.repartition(7), "s").collect()]
    assert mixing.poisson_mix(docs.limit(0), "s").count() == 0
    big = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("ten chars.").alias("text"), F.when(F.col("id") < 15_000, "a").otherwise("b").alias("source"))
    n = {r.source: r.n for r in mixing.poisson_mix(big, "s", {"a": 1.0, "b": 3.0}, target=400_000.0).groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert n["a"] == pytest.approx(10_000, rel=0.05) and n["b"] == pytest.approx(30_000, rel=0.05)
    draws = [(r, u) for r in (0.3, 1.0, 7.5, 99.0, 400.0, 20_000.0) for u in (0.0, 0.2, 0.5, 0.9, 0.999999)]
    got = spark.createDataFrame(draws, "r double, u double").select("r", "u", mixing.poisson_quantile(F.col("r"), F.col("u")).alias("n")).collect()

    def quantile(r, u):
        n, c = 0, math.exp(-r) if r < 700 else 0.0
        while c <= u:
            n += 1
            c += math.exp(n * math.log(r) - r - math.lgamma(n + 1))
        return n

    assert [g.n for g in got if g.u] == [quantile(g.r, g.u) for g in got if g.u]
    clash = docs.withColumns({"src": F.lit(1), "rate": F.lit(2), "q": F.lit(3), "copy": F.lit(4), "__rate": F.lit(5)}).drop("__rate")
    assert sorted(r.shuffle_key for r in mixing.poisson_mix(clash, "s").collect()) == [r[-1] for r in rows]
    first = lambda: [tuple(r) for r in mixing.poisson_mix(docs, "s").select("doc_id", "copy", "shuffle_key").collect()]
    by_broadcast = first()
    with pytest.MonkeyPatch.context() as m:
        m.setattr(mixing, "RATES_BROADCAST", 0)
        assert first() == by_broadcast


def test_near_components_at_a_similarity_against_all_pairs(spark):
    from stridelake.llm import simhash_wide as wide

    rnd = random.Random(8)
    rows = []
    for g in range(25):
        base = [rnd.choice(WORDS) + str(rnd.randrange(40)) for _ in range(rnd.randrange(40, 160))]
        for _ in range(rnd.randrange(1, 9)):
            t = list(base)
            for _ in range(rnd.choice([0, 1, 1, 6])):
                t[rnd.randrange(len(t))] = "changed"
            rows.append((len(rows), " ".join(t).upper() if g % 5 == 0 else " ".join(t)))
    rows += [(1000, None), (1001, ""), (1002, " \t"), (1003, "one two"), (1004, "ONE  two"), (1005, rows[0][1]), (1005, rows[0][1]), (None, rows[0][1]), (None, "only here"), (1006, "word " * 50_000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"key": F.lit("x"), "node": F.lit(1), "label": F.lit(2), "k": F.lit(3)}).repartition(4)
    low = {i: i for i, _ in rows if i is not None}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := (t or "").lower().split()) else set() for i, t in rows if i is not None}
    same = lambda a, b: a == b or len(a & b) >= 0.8 * len(a | b) > 0
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and same(sets[a], sets[b]) and low[a] != low[b]:
                keep, gone = sorted((low[a], low[b]))
                low = {i: keep if c == gone else c for i, c in low.items()}
    got = wide.near_components(docs).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == low
    assert sorted(str(r.component_id) for r in got if r.doc_id is None) == ["0", "None"]
    first = [r.doc_id for r in wide.keep_first(docs).collect()]
    assert sorted(first, key=str) == sorted([*set(low.values()), None, None], key=str)
    assert wide.near_components(docs.limit(0)).count() == 0 and wide.keep_first(docs).columns == docs.columns


def test_near_components_miss_no_link_of_short_or_long_texts(spark):
    from stridelake.llm import simhash_wide as wide

    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("abcdefghijklmnopqrst") for _ in range(7))
    rows = []
    for shared, extra in [(8, 1), (8, 2), (12, 2), (16, 4), (20, 5), (80, 20), (200, 50)]:  # five-word shingles
        for _ in range(60):
            w = [word() for _ in range(shared + 4)]
            rows += [(len(rows), " ".join(w)), (len(rows) + 1, " ".join(w + [word() for _ in range(extra)]))]
    assert {wide.similarity(wide.shingle_set(rows[i][1]), wide.shingle_set(rows[i + 1][1])) >= 0.8 for i in range(0, len(rows), 2)} == {True}
    got = dict(map(tuple, wide.near_components(spark.createDataFrame(rows, "doc_id int, text string")).collect()))
    assert [i for i in range(0, len(rows), 2) if got[i] != i or got[i + 1] != i] == []
