"""Mixing sources to target weights by Poisson replication, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import stage

#: Largest mean of one inverted draw. Greater rates are sums of several draws, whose seeds differ.
DRAW_RATE = 8.0
#: Terms of the distribution function; at a mean of 8 what lies beyond is far below the 52 bits of a draw.
TERMS = 64
#: Draws of a document that are made in one row. Sources with more are dealt out in blocks of so many first.
BLOCK = 128
#: The order of a mix is a number below this.
ORDERS = 1 << 52


def hash_unit(*parts: Column | str) -> Column:
    """A number in [0, 1) with 52 bits, from the MD5 of the parts."""
    return hash_number(*parts).cast("double") / F.lit(float(ORDERS))


def hash_number(*parts: Column | str) -> Column:
    """A long below 2^52 from the MD5 of the parts."""
    text = F.concat_ws("|", *[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("NULL")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")


def repetition_rates(docs: DataFrame, targets: DataFrame | None, source: str = "source") -> DataFrame:
    """One row per source of ``docs``: how often each of its documents shall occur on average, and how to draw that.

    The mix shall have as many documents as ``docs``, shared out by ``targets(source, weight)``; without targets all
    sources weigh the same. A source without a target, or with one that is NULL or not above 0, gets the rate 0.
    NULL is a source like any other. Columns: source, __rate, __draws, __cdf.
    """
    sizes = docs.groupBy(F.col(f"`{source}`").alias("__source")).agg(F.count("*").alias("__n"))
    if targets is None:
        weighted = sizes.withColumn("__weight", F.lit(1.0))
    else:
        wanted = targets.groupBy(F.col(source).alias("__wanted")).agg(F.sum(F.col("weight").cast("double")).alias("__weight"))
        weighted = sizes.join(wanted, F.col("__source").eqNullSafe(F.col("__wanted")), "left").drop("__wanted")
    weight = F.when(F.col("__weight") > 0, F.col("__weight")).otherwise(0.0)
    weighted = stage(weighted.withColumn("__weight", weight), "mixing-sizes")
    whole = weighted.agg(F.sum("__n").alias("n"), F.sum("__weight").alias("w")).select(F.struct("n", "w").alias("s")).scalar()
    rate = F.when(F.col("__weight") > 0, F.col("__weight") / whole["w"] * whole["n"] / F.col("__n")).otherwise(0.0)
    draws = F.greatest(F.ceil(F.col("__rate") / DRAW_RATE), F.lit(1)).cast("long")
    mean = F.col("__rate") / F.col("__draws")
    begin = F.struct(F.exp(-F.col("__mean")).alias("term"), F.array(F.exp(-F.col("__mean"))).alias("cdf"))

    def add(state, k):
        term = state["term"] * F.col("__mean") / k
        return F.struct(term.alias("term"), F.concat(state["cdf"], F.array(F.element_at(state["cdf"], -1) + term)).alias("cdf"))

    steps = F.sequence(F.lit(1), F.lit(TERMS - 1))
    return (
        weighted.withColumn("__rate", rate)
        .withColumn("__draws", draws)
        .withColumn("__mean", mean)
        .withColumn("__cdf", F.aggregate(steps, begin, add, lambda state: state["cdf"]))
        .select("__source", "__rate", "__draws", "__cdf")
    )


def mix_sources(
    docs: DataFrame,
    targets: DataFrame | None = None,
    key: str = "doc_id",
    source: str = "source",
    seed: str = "mix",
    copy_column: str = "copy",
    order_column: str = "shuffle_key",
) -> DataFrame:
    """``docs`` with each row repeated a Poisson number of times, in a global random order.

    The mean of a row's repetitions is its source's rate (``repetition_rates``); the number is the inverse of the
    distribution at a hash of ``seed`` and ``key``, so equal keys (NULL ones too) repeat equally often, and any run or
    retry gives the same mix. The columns of ``docs`` stay as they are, whatever their names; ``copy_column`` (int, from 1) and ``order_column``
    (long) come behind them, with underscores at their end where such a name is taken. Rows are range-partitioned and sorted by the
    latter. An empty table gives an empty mix.

    The rates are one row per source, written to the shared folder, so Spark knows their size: small ones are
    broadcast, and beyond that the join on the source is one whose hot sides AQE splits. Documents move once, by uniform keys;
    those of sources so rare that a document needs more than ``BLOCK`` draws are first dealt out in blocks of draws, so that no
    row and no task makes all copies of one. More than 2^31 - 1 copies of one document are an error.
    """
    rates = stage(repetition_rates(docs, targets, source), "mixing-rates")
    taken = set(map(str.lower, docs.columns))  # Spark tells names apart without regard to case
    while copy_column.lower() in taken:
        copy_column += "_"
    while order_column.lower() in {copy_column.lower(), *taken}:
        order_column += "_"
    held = docs.select(F.struct("*").alias("doc"))
    own_key = F.col(f"doc.`{key}`")

    def joined(some: DataFrame) -> DataFrame:
        return held.join(some, F.col(f"doc.`{source}`").eqNullSafe(F.col("__source"))).where("__rate > 0")

    def drawn(first: Column, last: Column) -> Column:
        """Copies that the draws from ``first`` to ``last`` give."""
        return F.aggregate(
            F.sequence(first, last),
            F.lit(0),
            lambda total, draw: total + F.size(F.filter("__cdf", lambda c: c <= hash_unit(seed, own_key, draw))),
        )

    few = joined(rates.where(F.col("__draws") <= BLOCK)).withColumn("__count", drawn(F.lit(1).cast("long"), F.col("__draws"))).where("__count > 0")
    copies = few.select("doc", F.explode(F.sequence(F.lit(1), F.col("__count"))).alias("__copy"))
    many = rates.where(F.col("__draws") > BLOCK)
    if not many.isEmpty():
        blocks = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("__draws") - 1) / BLOCK)))
        dealt = stage(joined(many).withColumn("__row", F.monotonically_increasing_id()), "mixing-rare").withColumn("__block", blocks)
        dealt = dealt.repartition("__row", "__block")
        begin = F.col("__block") * BLOCK + 1
        counted = dealt.withColumn("__count", drawn(begin, F.least(begin + BLOCK - 1, F.col("__draws"))))
        counted = stage(counted.select("__row", "__block", "__count"), "mixing-counts")
        earlier = Window.partitionBy("__row").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
        before = F.coalesce(F.sum("__count").over(earlier), F.lit(0)).cast("int")
        numbered = counted.withColumn("__before", before).where("__count > 0")
        rare = dealt.select("doc", "__row", "__block").join(numbered, ["__row", "__block"])
        copies = copies.unionByName(rare.select("doc", F.explode(F.sequence(F.col("__before") + 1, F.col("__before") + F.col("__count"))).alias("__copy")))
    ordered = copies.withColumn("__order", hash_number(f"{seed}-order", own_key, F.col("__copy")))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = F.floor(F.col("__order") / F.lit(ORDERS) * parts).cast("int")
    mixed = ordered.repartitionById(parts, place).sortWithinPartitions("__order", own_key, "__copy")
    return mixed.select("doc.*", F.col("__copy").alias(copy_column), F.col("__order").alias(order_column))
