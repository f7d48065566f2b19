"""Running numbers that never order a whole table, or one hot group, in one task.

A plain ``row_number() OVER (ORDER BY ..)`` moves every row to one task, and with
``PARTITION BY slide`` it moves a slide that holds a third of all rows to one
task. Here rows are first counted per (keys, major, block of the minor id); the
counts are summed in order, and each row adds its place inside its own block.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BLOCK = 4096
#: Hash buckets in which the rows of keys are counted.
BUCKETS = 4096


def crowded(df: DataFrame, keys: list[str], least: int = BLOCK) -> Column | None:
    """Whether the keys of a row may hold very many rows of ``df``; None where no keys do."""
    return crowding(df, keys, least)[0]


def crowding(df: DataFrame, keys: list[str], least: int = BLOCK, weight: Column | None = None) -> tuple[Column | None, int]:
    """What ``crowded`` tells, and the number of rows; each counts as ``weight`` where that is given.

    Rows are counted in ``BUCKETS`` buckets by a hash of the keys, so the list at the driver has at most that many
    rows; a key with over four of ``BUCKETS`` shares of all rows is always told.
    """
    bucket = F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")
    counts = df.groupBy(bucket.alias("_b")).agg(F.sum(F.lit(1) if weight is None else weight).alias("_n")).collect()
    rows = sum(r["_n"] for r in counts)
    most = max(least, 4 * rows // BUCKETS)
    hot = [r["_b"] for r in counts if r["_n"] > most]
    return (bucket.isin(hot) if hot else None), rows


def matched(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join on columns of one name, where a null meets a null as in a group."""
    other = right.withColumnsRenamed({n: "_on_" + n for n in on})
    same = reduce(and_, [F.col(n).eqNullSafe(F.col("_on_" + n)) for n in on])
    return left.join(other, same, how).drop(*["_on_" + n for n in on])


def running_number(df: DataFrame, keys: list[str], major: list[tuple[Column, bool]], minor: str, out: str = "rn",
                   block: Column | None = None, coarse: Column | None = None) -> DataFrame:
    """1-based number per ``keys`` in the order ``major`` then ``minor``.

    ``major`` holds (value, descending) pairs; descending ones must be numbers.
    ``minor`` settles the rest of the order. Rows with equal keys and major values
    are cut into blocks: by default ranges of a whole-number ``minor``, else by
    ``block``, which must not decrease as ``minor`` grows. ``coarse``, a function of
    the major values that does not decrease in their order, cuts the ordered list of
    counts into pieces, so that no list has a row per different major value. Keys that hold
    few rows are numbered by a window of their own.
    """
    if not keys:
        return _in_blocks(df, keys, major, minor, out, block, coarse)
    hot = crowded(df, keys)
    order = W.partitionBy(*keys).orderBy(*[-value if descending else value for value, descending in major], minor)
    own = (df if hot is None else df.where(~hot)).withColumn(out, F.row_number().over(order).cast("bigint"))
    return own if hot is None else own.unionByName(_in_blocks(df.where(hot), keys, major, minor, out, block, coarse))


def _in_blocks(df: DataFrame, keys: list[str], major: list[tuple[Column, bool]], minor: str, out: str, block: Column | None, coarse: Column | None) -> DataFrame:
    names = [f"_m{i}" for i in range(len(major))]
    tagged = df
    for name, (value, descending) in zip(names, major):
        tagged = tagged.withColumn(name, -value if descending else value)
    tagged = tagged.withColumn("_blk", F.floor(F.col(minor) / BLOCK) if block is None else block)
    if coarse is not None:
        tagged = tagged.withColumn("_band", coarse)
    bands = [] if coarse is None else ["_band"]
    group = [*keys, *bands, *names, "_blk"]
    counts = tagged.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    earlier = (W.unboundedPreceding, -1)
    if block is None:
        # blocks are summed in groups of BLOCK first, so that the one ordered list
        # per key has a row per BLOCK * BLOCK numbers
        counts = counts.withColumn("_sup", F.floor(F.col("_blk") / BLOCK))
        supers = [*keys, *bands, *names, "_sup"]
        tops = counts.groupBy(*supers).agg(F.sum("_n").alias("_s"))
        tops = _before(tops, keys, bands, [*names, "_sup"], "_s", "_top")
        inner = F.sum("_n").over(W.partitionBy(*supers).orderBy("_blk").rowsBetween(*earlier))
        offsets = (counts.withColumn("_in", F.coalesce(inner, F.lit(0))).transform(lambda df: matched(df, tops, supers))
                   .select(*group, (F.col("_top") + F.col("_in")).alias("_before")))
    else:
        offsets = _before(counts, keys, bands, [*names, "_blk"], "_n", "_before")
    local = tagged.withColumn("_local", F.row_number().over(W.partitionBy(*group).orderBy(minor)))
    return (matched(local, offsets, group).withColumn(out, (F.col("_before") + F.col("_local")).cast("bigint"))
            .drop(*names, *bands, "_blk", "_before", "_local"))


def _before(counts: DataFrame, keys: list[str], bands: list[str], order: list[str], n: str, out: str) -> DataFrame:
    """``keys, bands, order`` with the sum of ``n`` over all earlier rows of the keys: bands first, then inside a band."""
    earlier = (W.unboundedPreceding, -1)
    inner = F.coalesce(F.sum(n).over(W.partitionBy(*keys, *bands).orderBy(*order).rowsBetween(*earlier)), F.lit(0))
    if not bands:
        return counts.select(*keys, *order, inner.alias(out))
    whole = counts.groupBy(*keys, *bands).agg(F.sum(n).alias("_w"))
    ahead = whole.select(*keys, *bands, F.coalesce(F.sum("_w").over(W.partitionBy(*keys).orderBy(*bands).rowsBetween(*earlier)), F.lit(0)).alias("_ahead"))
    return matched(counts.withColumn("_inner", inner), ahead, [*keys, *bands]).select(*keys, *bands, *order, (F.col("_inner") + F.col("_ahead")).alias(out))


def salted_lookup(big: DataFrame, small: DataFrame, keys: list[str], how: str = "inner", salts: int = 16) -> DataFrame:
    """Join ``big`` with a table that is unique on ``keys``.

    The unique side is repeated ``salts`` times and the other side spreads each
    key over as many tasks, so one key with a third of all rows is no single task.
    """
    spread = big.withColumn("_salt", F.pmod(F.xxhash64(*big.columns), F.lit(salts)).cast("int"))
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return spread.transform(lambda df: matched(df, copies, [*keys, "_salt"], how)).drop("_salt")


def hot_lookup(big: DataFrame, small: DataFrame, keys: list[str], share: int = 4096, least: int = 4096) -> DataFrame:
    """Left join of ``big`` with a table that is unique on ``keys``; rows of hot keys stay where they are.

    At most ``share`` keys hold more than one in ``share`` rows of ``big`` each, so their rows of ``small`` are
    broadcast; all other keys meet by an exchange in which no key has more rows than that.
    """
    rows = big.count()
    if rows <= least:
        return big.join(small, keys, "left")
    hot = big.dropna(subset=keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > max(least, rows // share)).select(*keys, F.lit(True).alias("_hot"))
    marked = big.join(F.broadcast(hot.join(small, keys, "left")), keys, "left")
    columns = [*big.columns, *[n for n in small.columns if n not in keys]]
    rest = marked.where("_hot is null").select(*big.columns).join(small, keys, "left")
    return marked.where("_hot").select(*columns).unionByName(rest.select(*columns))
