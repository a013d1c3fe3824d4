"""Benchmark decontamination by winnowing; DataFrame functions only.

A window is ``size`` consecutive words of a benchmark item; an item of fewer words is one window.
Of the ``size - gram + 1`` hashed ``gram``-word sequences within ``size`` words the smallest is
kept, in documents and items alike, so that a shared window always shares a kept hash.  Kept
hashes are joined, and each hit is extended: the document's windows around it are
compared, word by word, with the item's.  A short item is its own sequence, looked for at every place.

Texts are known by 128 bits of hash while only places travel.  Documents without a shared hash are
scanned and never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from stridelake.operators.scratch import Scratch

SIZE, GRAM = 10, 6
PLACE = 22  # bits of a kept hash that tell its place, counted around in longer texts
BROADCAST = 8 << 20  # bytes of a benchmark table that is broadcast; a larger one is shuffled
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # of a text whose letters keep their case


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once a row."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """Words of a text, A-Z in lower case; none for null."""
    ascii_only = F.octet_length(text) == F.length(text)
    low = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(F.coalesce(low, F.lit("")), BETWEEN), "")


def _placed(ws: Column, gram: int) -> Column:
    """A long for each ``gram``-word sequence: its hash above its place."""
    mask = (1 << PLACE) - 1
    one = lambda i: F.shiftleft(F.xxhash64(F.slice(ws, i, gram)), PLACE).bitwiseOR(F.lit(mask) - i.bitwiseAND(F.lit(mask)))
    return F.when(F.size(ws) >= gram, F.transform(F.sequence(F.lit(1), F.size(ws) - gram + 1), one)).otherwise(F.array().cast("array<bigint>"))


def kept(ws: Column, size: int, gram: int) -> Column:
    """The smallest of the placed hashes within each ``size`` words, each once; none in fewer words."""
    span = size - gram + 1
    small = lambda v: F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(v) - span + 1), lambda i: F.array_min(F.slice(v, i, span)))) if span > 1 else v
    return _let(ws, lambda ws: F.when(F.size(ws) >= size, _let(_placed(ws, gram), small)).otherwise(F.array().cast("array<bigint>")))


def _hash(v: Column) -> Column:
    return F.shiftright(v, PLACE)


def _place(v: Column) -> Column:
    """The place of the sequence from 1, less whole turns of ``PLACE`` bits."""
    return (F.lit((1 << PLACE) - 1) - v.bitwiseAND(F.lit((1 << PLACE) - 1))).cast("int")


def _starts(places: Column, n: Column, size: int, gram: int) -> Column:
    """Starts, from 1, of the windows around the places."""
    turns = lambda p: F.transform(F.sequence(F.lit(0), F.shiftright(n, PLACE)), lambda j: p + F.shiftleft(j, PLACE))
    around = lambda p: F.when((p >= 1) & (p <= n - gram + 1), F.sequence(F.greatest(p - (size - gram), F.lit(1)), F.least(p, n - size + 1))).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.flatten(F.transform(F.flatten(F.transform(places, turns)), around)))


def _small(df: DataFrame, size: Column) -> DataFrame:
    """``df``, to be broadcast if it is small by its own measure."""
    held = df.agg(F.coalesce(F.sum(size), F.lit(0)).alias("b")).first()["b"]
    return F.broadcast(df) if held <= BROADCAST else df


def item_windows(items: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """``item, len, win`` of all windows of all items."""
    ws = words(F.col(text))
    n = lambda w: F.least(F.size(w), F.lit(size))
    each = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - n(w) + 1), lambda i: F.struct(n(w).alias("len"), F.array_join(F.slice(w, i, n(w)), " ").alias("win")))
    rows = items.select(F.col(key).cast("string").alias("item"), ws.alias("w")).where(F.size("w") > 0)
    return rows.select("item", F.explode(each(F.col("w"))).alias("x")).select("item", "x.*")


def contamination(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", size: int = SIZE, gram: int = GRAM) -> DataFrame:
    """``key, n_words, n_hit, n_items, item_ids, contaminated``: what each document shares with the items.

    ``n_hit`` counts words inside any occurrence of a window, ``n_items`` the items with
    occurring windows, whose keys ``item_ids`` lists, sorted as strings.  Every row is returned;
    equal texts get equal results; null, empty and wordless texts have no words.  Items that share
    a key are one; the windows of an item without a key make hits, but it is neither counted nor
    listed.  Without items, or with items that have no words, nothing is hit.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "winnowing")
    every = scratch.keep(item_windows(items, item_key, item_text, size).distinct(), "items")
    known = scratch.keep(every.select("len", "win").distinct().withColumn("wid", F.monotonically_increasing_id()), "windows")
    lengths = sorted(r["len"] for r in known.select("len").distinct().collect())  # ``size`` at most

    texts = docs.where(F.col(text).isNotNull()).select(F.xxhash64(text).alias("t1"), F.xxhash64(F.lit("second"), F.col(text)).alias("t2"), F.col(text).alias("t"))
    spans, hits = {n: (n, gram if n == size else n) for n in lengths}, None
    split = texts.select("t1", "t2", words(F.col("t")).alias("w"))
    for n, (whole, g) in spans.items():
        own = known.where(F.col("len") == n).select(F.explode(kept(F.split("win", " "), whole, g)).alias("v")).select(_hash(F.col("v")).alias("h")).distinct()
        own = _small(scratch.keep(own, f"kept{n}"), F.lit(32))
        found = split.select("t1", "t2", F.explode(kept(F.col("w"), whole, g)).alias("v"))
        found = found.join(own, _hash(F.col("v")) == F.col("h")).select("t1", "t2", F.struct(F.lit(n).alias("len"), _place(F.col("v")).alias("p")).alias("x"))
        hits = found if hits is None else hits.unionByName(found)
    n_words = F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("bigint")
    rows = docs.select(F.col(key), n_words.alias("n_words"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit("second"), F.col(text)).alias("t2"), F.col(text).isNull().alias("none"))
    if hits is None:
        return rows.select(key, "n_words", F.lit(0).cast("bigint").alias("n_hit"), F.lit(0).cast("bigint").alias("n_items"), F.array().cast("array<string>").alias("item_ids"), F.lit(False).alias("contaminated"))
    hits = scratch.keep(hits.groupBy("t1", "t2").agg(F.collect_set("x").alias("xs")), "hits")  # a text's own places

    def windows(n: int, g: int) -> Column:
        places = F.transform(F.filter("xs", lambda x: x["len"] == n), lambda x: x["p"])
        starts = _starts(places, F.size("w"), n, g)
        return F.transform(starts, lambda s: F.struct(F.lit(n).alias("len"), s.alias("start"), F.array_join(F.slice("w", s, n), " ").alias("win")))

    near = texts.join(hits, ["t1", "t2"]).select("t1", "t2", words(F.col("t")).alias("w"), "xs")
    near = near.select("t1", "t2", F.explode(F.concat(*(windows(n, g) for n, g in spans.values()))).alias("x")).select("t1", "t2", "x.*")
    same = near.join(_small(known, F.octet_length("win") + 64), ["len", "win"]).select("t1", "t2", "start", "len", "wid").distinct()
    same = scratch.keep(same, "matches")

    step = lambda s, x: F.struct((s["n"] + F.greatest(F.lit(0), x["start"] + x["len"] - F.greatest(x["start"], s["end"]))).alias("n"), F.greatest(s["end"], x["start"] + x["len"]).alias("end"))
    covered = F.aggregate(F.array_sort(F.collect_set(F.struct("start", "len"))), F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), step, lambda s: s["n"].cast("bigint"))
    by_text = same.groupBy("t1", "t2").agg(covered.alias("n_hit"))
    named = every.join(known, ["len", "win"]).where("item is not null").select("wid", "item")
    listed = same.select("t1", "t2", "wid").distinct().join(named, "wid").select("t1", "t2", "item").distinct().groupBy("t1", "t2").agg(F.array_sort(F.collect_list("item")).alias("item_ids"))
    found = scratch.keep(by_text.join(listed, ["t1", "t2"], "left").withColumn("none", F.lit(False)), "found")
    out = rows.join(found, ["t1", "t2", "none"], "left")
    ids, n_hit = F.coalesce("item_ids", F.array().cast("array<string>")), F.coalesce("n_hit", F.lit(0)).cast("bigint")
    return out.select(key, "n_words", n_hit.alias("n_hit"), F.size(ids).cast("bigint").alias("n_items"), ids.alias("item_ids"), (n_hit > 0).alias("contaminated"))
