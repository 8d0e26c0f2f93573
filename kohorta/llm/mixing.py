"""Mixing sources to target weights by Poisson replication.

Each document is repeated a Poisson number of times, with the mean that its source needs to reach its
share of the mixture. The Poisson number is the inverse of the distribution function at a uniform
number made from a hash of the document, so every run and every recomputed task draws the same. A
large mean is cut into equal parts, each drawn by a hash of its own and added up, which is exact for
Poisson numbers. The copies are then shuffled globally by another hash.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kohorta.llm.common import boxed, shuffle_partitions, unboxed
from kohorta.plans.skew import small_table
from kohorta.session import written

#: Largest mean of one draw: far above it, the distribution function starts below the smallest double.
MAX_RATE = 500.0
#: Tables of more sources than this are joined by a shuffle.
MAX_BROADCAST_SOURCES = 10_000
SEED = 8


def hash_uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of an MD5 of the parts, null as an empty part."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))


def poisson_draws(u: Column, rate: Column) -> Column:
    """0 to k-1 for the smallest k with P(X <= k) > u, X being Poisson with mean ``rate``, ``MAX_RATE`` at most.

    The distribution function is summed term by term up to a bound far beyond any double below one.
    The state carries ``u`` and ``rate``, so they are not computed again at each step.
    """
    bound = F.ceil(rate + F.sqrt(rate) * 12 + 40).cast("int")
    start = F.struct(
        F.lit(0).cast("long").alias("k"), F.exp(-rate).alias("term"), F.exp(-rate).alias("total"), u.alias("u"), rate.alias("rate")
    )

    def step(s: Column, i: Column) -> Column:
        term = s["term"] * s["rate"] / i
        going = s["total"] <= s["u"]
        return F.struct(
            F.when(going, s["k"] + 1).otherwise(s["k"]).alias("k"),
            F.when(going, term).otherwise(s["term"]).alias("term"),
            F.when(going, s["total"] + term).otherwise(s["total"]).alias("total"),
            s["u"].alias("u"),
            s["rate"].alias("rate"),
        )

    none = F.array().cast("array<bigint>")
    numbers = lambda s: F.when(s["k"] > 0, F.sequence(F.lit(0).cast("long"), s["k"] - 1)).otherwise(none)
    return F.aggregate(F.sequence(F.lit(1), bound), start, step, numbers)


def poisson_parts(rate: Column, uniform: Callable[[Column], Column]) -> Column:
    """Poisson numbers that add up to one with mean ``rate``: of equal parts of mean ``MAX_RATE`` at most.

    ``uniform`` gives the number in [0, 1) of a part, which is numbered from 0.
    """
    parts = F.greatest(F.ceil(rate / MAX_RATE), F.lit(1)).cast("long")
    return F.transform(F.sequence(F.lit(0).cast("long"), parts - 1), lambda p: F.size(poisson_draws(uniform(p), rate / parts)).cast("long"))


def source_rates(docs: DataFrame, weights: Mapping[str | None, float] | None = None, repetition: float = 1.0, temper: float = 0.5) -> DataFrame:
    """(source, n_docs, rate): mean number of copies of a document of each source.

    ``weights`` gives the share of each source in the mixture (a source without one gets none);
    without it, shares are the sources' sizes to the power ``temper``. The mixture has ``repetition``
    times as many documents as the input. Null is a source of its own.
    """
    sizes = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"))
    if weights is None:
        weight = F.pow(F.col("n_docs").cast("double"), F.lit(temper))
    else:
        weight = F.lit(0.0)
        for source, share in weights.items():
            weight = F.when(F.col("source").eqNullSafe(F.lit(source)), F.lit(float(share))).otherwise(weight)
    weighted = sizes.select("source", "n_docs", weight.alias("weight"))
    total = weighted.agg(F.sum("weight").alias("weight"), F.sum("n_docs").alias("docs")).first()
    if not total["weight"]:
        return weighted.select("source", "n_docs", F.lit(0.0).alias("rate"))
    rate = F.col("weight") / F.lit(total["weight"]) * F.lit(total["docs"]) * repetition / F.col("n_docs")
    return weighted.select("source", "n_docs", rate.alias("rate"))


def mix_sources(
    docs: DataFrame,
    weights: Mapping[str | None, float] | None = None,
    repetition: float = 1.0,
    temper: float = 0.5,
    seed: int = SEED,
) -> DataFrame:
    """Every document as often as its draw says, shuffled over all partitions.

    Added columns: ``copy`` (from 0), ``copies``, ``rate`` of the source, ``shuffle_key`` in [0, 1), by
    a hash of which rows are dealt to partitions and by which they are sorted there; columns of the input with these names are replaced. The draw depends
    on seed, doc_id and text, so repeated rows get the same number of copies each. A document drawn
    zero times is left out, which is the feature. Empty tables give no rows. A rate above ``MAX_RATE``
    is drawn in equal parts below it; its copies are numbered through from one part to the next.
    """
    rates = source_rates(docs, weights, repetition, temper)
    rates = rates.select("source", "rate")
    # Few sources travel to the documents; many are written first, so a hot source's join can be split.
    few = small_table(rates, MAX_BROADCAST_SOURCES)
    rates = written(rates, "source-rates") if few is None else few
    joined = boxed(docs).join(rates, F.col("row.source").eqNullSafe(F.col("source")))
    joined = joined.withColumn("digest", F.md5(F.coalesce("row.text", F.lit("")).cast("binary")))
    named = (F.lit(seed), F.lit("draw"), F.col("row.doc_id"), F.col("digest"))
    drawn = joined.withColumn("draws", poisson_parts(F.col("rate"), lambda p: F.when(p == 0, hash_uniform(*named)).otherwise(hash_uniform(*named, p))))
    total = lambda draws: F.aggregate(draws, F.lit(0).cast("long"), lambda a, k: a + k)
    # One row per part first: no array grows with the rate but the parts' numbers.
    parts = drawn.select("row", "rate", "digest", "draws", total(F.col("draws")).alias("copies"), F.posexplode("draws").alias("part", "k"))
    before = total(F.slice("draws", 1, F.col("part")))
    parts = parts.where("k > 0").select("row", "rate", "digest", "copies", "k", before.alias("before"))
    copy = F.sequence(F.col("before"), F.col("before") + F.col("k") - 1)
    spread = parts.select("row", "rate", "digest", "copies", F.explode(copy).alias("copy"))
    key = hash_uniform(F.lit(seed), F.lit("order"), F.col("row.doc_id"), F.col("copy"), F.col("digest"))
    names = [c for c in docs.columns if c not in ("copy", "copies", "rate", "shuffle_key")]
    mixed = spread.select(*unboxed(names), "rate", "copies", "copy", key.alias("shuffle_key"))
    return mixed.repartition(shuffle_partitions(docs.sparkSession), "shuffle_key").sortWithinPartitions("shuffle_key")
