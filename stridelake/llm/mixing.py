"""Mixing sources to target weights by Poisson replication; DataFrame functions only.

A source's target rate is its share of the wanted size over its own size.  Each document's
count is the Poisson quantile, at its source's rate, of a uniform number hashed from the seed
and the document's key; the document is repeated that often and everything is put into one
global random order.  The result doesn't depend on partitions, and a recomputed task
makes the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

BLOCK = 10_000  # most copies that one row makes in one task
RATES_BROADCAST = 8 << 20  # bytes of rates that are broadcast; more are joined by salted keys
SALT = 64


def _ln_factorial(j: Column) -> Column:
    """Stirling's series; exact to 1e-10 from 10 on, and 0 at 0."""
    return F.when(j < 1, F.lit(0.0)).otherwise(j * F.log(j) - j + 0.5 * F.log(2 * F.pi() * j) + 1 / (12 * j) - 1 / (360 * F.pow(j, 3)) + 1 / (1260 * F.pow(j, 5)))


def poisson_quantile(rate: Column, u: Column) -> Column:
    """How many of P(X <= 0), P(X <= 1), ... are at most ``u``: the inverted distribution, for 0 <= u < 1.

    Sums from where the mass begins to where doubles can tell it from 1, which is about 24 square
    roots of the rate; nothing is kept but the sums.
    """
    low = F.when(rate > 100, F.floor(rate - 12 * F.sqrt(rate))).otherwise(F.lit(0)).cast("bigint")
    high = F.ceil(rate + 12 * F.sqrt(rate) + 30).cast("bigint")

    def counted(x):
        rate, u, low = x["rate"], x["u"], x["low"]
        first = F.exp(F.when(low > 0, low * F.log(rate)).otherwise(F.lit(0.0)) - rate - _ln_factorial(low.cast("double")))
        below = lambda c: (c <= u).cast("bigint")
        zero = F.transform(F.array(first), lambda p: F.struct(p.alias("p"), p.alias("c"), (low + below(p)).alias("n")))[0]

        def step(s, j):
            nxt = F.struct((s["p"] * rate / j).alias("p"), (s["c"] + s["p"] * rate / j).alias("c"))
            return F.transform(F.array(nxt), lambda y: F.struct(y["p"].alias("p"), y["c"].alias("c"), (s["n"] + below(y["c"])).alias("n")))[0]

        return F.aggregate(F.sequence(low + 1, x["high"]), zero, step, lambda s: s["n"])

    return F.transform(F.array(F.struct(rate.alias("rate"), u.alias("u"), low.alias("low"), high.alias("high"))), counted)[0]


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from 52 bits of a SHA-256 over the parts."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def source_rates(docs: DataFrame, weights: dict[str, float] | None = None, target: float | None = None, source: str = "source", text: str = "text") -> DataFrame:
    """``src, rate``: a row for each source present, nulls as a source of their own.

    Sizes are characters.  Sources that ``weights`` doesn't name weigh nothing (all weigh the
    same without it); ``target`` is the size of the mix, that of the input by default.  A source
    without characters can't be brought to a weight and has rate 1.
    """
    sizes = docs.groupBy(F.col(source).alias("src")).agg(F.coalesce(F.sum(F.length(text)), F.lit(0)).alias("size"))
    if weights is None:
        weight = F.lit(1.0)
    else:
        table = F.create_map(*(x for s, w in weights.items() for x in (F.lit(s), F.lit(float(w))))) if weights else None
        weight = F.coalesce(table[F.col("src")], F.lit(0.0)) if weights else F.lit(0.0)
    sizes = sizes.withColumn("w", weight)
    sums = sizes.agg(F.sum(F.when(F.col("size") > 0, F.col("w"))).alias("ws"), F.sum("size").alias("total")).first()
    whole = float(sums.total or 0) if target is None else float(target)
    share = F.col("w") / F.lit(float(sums.ws or 1.0))
    return sizes.select("src", F.when(F.col("size") > 0, share * F.lit(whole) / F.col("size")).otherwise(F.lit(1.0)).alias("rate"))


def counted(docs: DataFrame, seed: str = "mix", weights: dict[str, float] | None = None, target: float | None = None, key: str = "doc_id", source: str = "source", text: str = "text") -> tuple[DataFrame, float]:
    """``docs`` with ``__ident``, ``__rate`` and ``__n``, how often each is repeated, and the largest rate."""
    rates = source_rates(docs, weights, target, source, text).select(F.col("src").alias("__src"), F.col("rate").alias("__rate"))
    ident = F.coalesce(F.col(key).cast("string"), F.concat(F.lit("text:"), F.sha2(F.coalesce(F.col(text), F.lit("")), 256)))
    drawn = docs.withColumn("__ident", ident).withColumn("__u", uniform(F.lit(seed), F.lit("count"), ident))
    size = rates.agg(F.coalesce(F.sum(F.coalesce(F.octet_length("__src"), F.lit(0)) + 64), F.lit(0)).alias("b"), F.coalesce(F.max("__rate"), F.lit(0.0)).alias("most")).first()
    if size["b"] <= RATES_BROADCAST:
        joined = drawn.join(F.broadcast(rates), F.col(source).eqNullSafe(F.col("__src")))
    else:
        salted = rates.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        joined = drawn.withColumn("__s", F.pmod(F.xxhash64("__ident"), F.lit(SALT)).cast("int"))
        joined = joined.join(salted, F.col(source).eqNullSafe(F.col("__src")) & (F.col("__s") == F.col("__salt")))
    n = F.when(F.col("__rate") > 0, poisson_quantile(F.col("__rate"), F.col("__u"))).otherwise(F.lit(0).cast("bigint"))
    return joined.select(*docs.columns, "__ident", "__rate", n.alias("__n")), size["most"]


def _in_blocks(rows: DataFrame) -> DataFrame:
    """``rows`` with ``copy`` from 1 to ``__n``: large blocks and blocks of copies first, dealt out by their numbers, then the copies."""
    upto = lambda first, last: F.explode(F.sequence(first, last))
    wide = BLOCK * BLOCK
    large = rows.withColumn("__large", upto(F.lit(0).cast("bigint"), F.floor((F.col("__n") - 1) / wide)))
    low = F.col("__large") * BLOCK
    small = large.withColumn("__block", upto(low, F.least(low + (BLOCK - 1), F.floor((F.col("__n") - 1) / BLOCK))))
    dealt = small.repartition("__ident", "__block")
    first = F.col("__block") * BLOCK + 1
    return dealt.withColumn("copy", upto(first, F.least(first + (BLOCK - 1), F.col("__n")))).drop("__large", "__block")


def poisson_mix(docs: DataFrame, seed: str = "mix", weights: dict[str, float] | None = None, target: float | None = None, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """``docs`` repeated to target weights and globally shuffled, with ``copy`` (from 1) and ``shuffle_key``.

    Rows come out sorted by ``shuffle_key``, a hash of the seed, the key and the copy.  A null key
    draws by its text instead.  Copies of documents that may have more than ``BLOCK`` are dealt out in
    blocks before they are made, so that a tiny source at a large target is no single task.  Rows that share a key share a count; an empty table gives an empty
    result.  Columns named ``copy`` or ``shuffle_key`` are replaced.
    """
    docs = docs.drop("copy", "shuffle_key")
    drawn, most = counted(docs, seed, weights, target, key, source, text)
    often = F.col("__rate") > float(BLOCK) / 2  # below that no count comes to BLOCK
    light = drawn.where(~often) if most > BLOCK / 2 else drawn
    copies = light.where("__n > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("__n"))))
    if most > BLOCK / 2:
        copies = copies.unionByName(_in_blocks(drawn.where(often & (F.col("__n") > 0))))
    order = F.substring(F.sha2(F.concat_ws("|", F.lit(seed), F.lit("order"), F.col("__ident"), F.col("copy").cast("string")), 256), 1, 16)
    return copies.withColumn("shuffle_key", order).select(*docs.columns, "copy", "shuffle_key").orderBy("shuffle_key")
