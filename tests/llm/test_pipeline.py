"""Each stage of the corpus pipeline, and all of them in order."""

import random

import public_tokenizers
import pytest

import corpus_pipeline as cp
from stridelake.llm import bpe
from stridelake.llm.queries import VOCABULARY

WORDS = [a + b for a in ("ba", "de", "mo", "ti", "sou", "wha") for b in ("n", "ring", "le", "st", "the", "ou")]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents of which every fourth is junk, with copies, near copies, personal data, nulls and empty texts; labels of most."""
    at = tmp_path_factory.mktemp("corpus")
    rnd = random.Random(3)
    say = lambda n: " ".join(rnd.choice(WORDS) for _ in range(n)).capitalize() + "."
    junk = lambda n: " ".join("".join(rnd.choice("#$%|0123456789") for _ in range(6)) for _ in range(n))
    rows = [(i, junk(40) if i % 4 == 0 else say(60), "en", f"s{i % 3}", 1) for i in range(200)]
    rows += [(200, rows[1][1], "en", "s0", 1), (201, rows[2][1] + " more", "en", "s0", 1), (202, say(50) + " Write to foo.bar@mail.example.com now.", "en", "s1", 1)]
    rows += [(203, None, None, None, None), (204, "", "en", "s1", 0), (None, say(60), "en", "s2", 1)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(0, 200) if i % 7], "doc_id bigint, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return str(at)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    kept = cp.quality(spark, docs, folder)
    assert kept.columns == cp.COLUMNS
    ids = {r.doc_id for r in kept.collect()}
    assert not {i for i in range(0, 200, 4)} & ids and {i for i in range(200) if i % 4} <= ids
    assert all(r == rows[r.doc_id] for r in kept.collect() if r.doc_id is not None)

    first = cp.near_duplicates(spark, docs, folder)
    assert first.columns == cp.COLUMNS
    got = sorted((r.doc_id for r in first.collect()), key=lambda i: (i is None, i))
    assert got == [*range(200), 202, 203, None]  # 200 and 201 repeat 1 and 2, 204 is as empty as 203

    clean = {r.doc_id: r for r in cp.personal_data(spark, docs, folder).collect()}
    assert len(clean) == len(rows) and "foo.bar@" not in clean[202].text and clean[202].n_chars == len(clean[202].text)
    changed = {i for i in rows if i is not None and clean[i] != rows[i] and not (i < 200 and i % 4 == 0)}
    assert changed == {202}

    mixed = cp.mix(spark, docs, folder)
    assert mixed.columns == cp.COLUMNS and {r.doc_id for r in mixed.collect()} <= set(rows)
    codec = bpe.Codec(bpe.read_ranks(public_tokenizers.path(VOCABULARY)), public_tokenizers.PATTERN)
    for r in cp.encode(spark, docs, folder).collect():
        assert r.n_tokens == len(r.token_ids) and codec.decode(r.token_ids).decode() == (rows[r.doc_id].text or "")
    for _, stage in cp.STAGES:
        assert stage(spark, docs.limit(0), folder).count() == 0


def test_run_is_the_stages_in_order(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for k, (_, stage) in enumerate(cp.STAGES):
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
    plain = lambda d: sorted((str(r.doc_id), str(r.source), list(r.token_ids), r.n_tokens) for r in d.collect())
    got = plain(cp.run(spark, folder))
    assert got == plain(docs) and len(got) > 100
    assert cp.run(spark, folder).columns == ["doc_id", "source", "token_ids", "n_tokens"]
