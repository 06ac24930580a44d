"""Mixing sources to target weights by Poisson replication.

Each source gets a repetition rate, its target share of the character budget over its size. Each
document draws its number of copies from a Poisson distribution with that mean: a hash of seed
and document id is the uniform number that is inverted, so a draw depends on nothing else, repeats
on any cluster and survives lost executors. Rates above ``STEP`` are sums of independent draws of
at most ``STEP`` each, which keeps the inversion within double precision and every rate exact.

Sizes are pre-aggregated by source, so a hot source is one row per task before the shuffle, and
the rates join the documents as a measured broadcast. The copies are shuffled globally by a hash
of document and copy: the hash is uniform, so equal slices of its range are equal partitions and
no sampling pass is needed.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortmill.llm.common import partitions, text_or_empty
from cohortmill.session import broadcast_if_small

STEP = 8.0
TERMS = 80
DIGITS = 13


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from 52 bits of a hash of the parts; null parts count as empty."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, DIGITS), 16, 10).cast("double") / float(16 ** DIGITS)


def poisson(rate: Column, u: Column) -> Column:
    """The Poisson quantile of ``u``: the first count whose distribution function passes it."""
    start = F.struct(F.lit(0).alias("k"), F.exp(-rate).alias("p"), F.exp(-rate).alias("c"))

    def step(acc, i):
        p = acc["p"] * rate / i
        return F.when(acc["c"] > u, acc).otherwise(
            F.struct((acc["k"] + 1).alias("k"), p.alias("p"), (acc["c"] + p).alias("c")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), start, step, lambda acc: acc["k"])


def source_rates(docs: DataFrame, weights: Mapping[str, float] | None, temperature: float,
                 epochs: float, source: str, text: str) -> DataFrame:
    """(source, chars, rate), rates to nine decimals.

    Shares follow ``weights`` (sources it does not name get none); without weights they follow
    size to the power of ``temperature``. A source of empty texts only has rate one.
    """
    sizes = docs.groupBy(F.col(source).alias("source__")).agg(
        F.sum(F.length(text_or_empty(text))).alias("chars__"))
    if weights is None:
        share = F.pow(F.col("chars__").cast("double"), F.lit(temperature))
    else:
        share = F.lit(0.0)
        for name, weight in weights.items():
            share = F.when(F.col("source__") == name, float(weight)).otherwise(share)
    sizes = sizes.withColumn("share__", F.when(F.col("chars__") > 0, share).otherwise(0.0))
    chars, shares = sizes.agg(F.coalesce(F.sum("chars__"), F.lit(0)),
                              F.coalesce(F.sum("share__"), F.lit(0.0))).first()
    rate = F.col("share__") / F.lit(shares or 1.0) * (float(chars) * epochs) / F.col("chars__")
    return sizes.select("source__", "chars__", F.when(F.col("chars__") > 0, F.round(rate, 9))
                        .otherwise(1.0).alias("rate__"))


def mix(docs: DataFrame, weights: Mapping[str, float] | None = None, temperature: float = 0.5,
        epochs: float = 1.0, seed: int = 17, doc_id: str = "doc_id", source: str = "source",
        text: str = "text") -> DataFrame:
    """Each document as often as its draw says, in global random order, with ``rate``, ``copy``
    (from 1) and ``shuffle_key``; columns of these names are replaced.

    Null sources form one source; null texts have no characters. Rows that share an id share the
    draw. An empty table gives an empty result.
    """
    rates = broadcast_if_small(source_rates(docs, weights, temperature, epochs, source, text))
    rated = docs.drop("rate", "copy", "shuffle_key").join(
        rates, docs[source].eqNullSafe(rates["source__"]), "left")
    draws = F.ceil(F.col("rate__") / STEP).cast("int")
    each = F.col("rate__") / F.greatest(draws, F.lit(1))
    copies = F.when(F.col("rate__") <= 0, 0).otherwise(F.aggregate(
        F.transform(F.sequence(F.lit(1), F.greatest(draws, F.lit(1))),
                    lambda j: poisson(each, uniform(F.lit(seed), F.col(doc_id), j))),
        F.lit(0), lambda total, k: total + k))
    copied = (rated.withColumn("copies__", copies).where(F.col("copies__") > 0)
              .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies__"))))
              .withColumnRenamed("rate__", "rate")
              .withColumn("shuffle_key", F.md5(F.concat_ws(
                  ":", F.lit(seed), F.lit("order"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")),
                  F.col("copy").cast("string"))))
              .drop("source__", "chars__", "copies__"))
    n = partitions(docs.sparkSession)
    slot = F.floor(F.conv(F.substring("shuffle_key", 1, 8), 16, 10).cast("double") * n / 16 ** 8)
    return copied.repartitionById(n, slot.cast("int")).sortWithinPartitions("shuffle_key")
