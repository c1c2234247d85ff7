"""Train/test splits and folds by a hash of the key: the same rows on every run and any partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F



def _hex(key: Column | str, start: int, length: int) -> Column:
    digits = F.substring(F.md5(F.col(key) if isinstance(key, str) else key), start, length)
    return F.conv(digits, 16, 10).cast("long")


def hash_percent(key: Column | str = "customer_id") -> Column:
    """0..99 from the first 32 bits of the md5 of the key."""
    return (_hex(key, 1, 8) % 100).cast("int")


def hash_order(key: Column | str = "customer_id") -> Column:
    """A place for each key that sorts first by :func:`hash_percent`; below 2**51, exact as a double."""
    return hash_percent(key) * F.lit(2**44) + _hex(key, 9, 11)


def mark_hash_split(
    df: DataFrame, test_percent: int = 20, key: str = "customer_id", flag: str = "is_test"
) -> DataFrame:
    """Add ``flag``, true for about ``test_percent`` of the keys; rows without a key are for training."""
    return df.withColumn(flag, F.coalesce(hash_percent(key) < test_percent, F.lit(False)))


#: Bits of a place that one round leaves open, from the widest cells to single places.
ROUNDS = (36, 18, 0)


def _last_places(keyed: DataFrame, test_percent: int) -> DataFrame:
    """``stratum, last``: the place of the last row of each stratum that belongs to the test part, null for none.

    Every round counts the rows of a stratum in cells of the hash order and goes on in the cell that holds the
    wanted row; a round sees at most 2**18 cells of a stratum, and never its rows, in one task.
    """
    wanted = F.floor((F.count("*") * test_percent + 50) / 100)
    strata = keyed.groupBy("stratum").agg(wanted.alias("wanted"))
    inside = keyed
    for bits in ROUNDS:
        cells = inside.groupBy("stratum", F.floor(F.col("place") / F.lit(2**bits)).alias("cell")).agg(F.count("*").alias("n"))
        upto = F.sum("n").over(Window.partitionBy("stratum").orderBy("cell"))
        summed = cells.withColumn("upto", upto).join(strata, "stratum")
        hit = summed.where((F.col("upto") >= F.col("wanted")) & (F.col("upto") - F.col("n") < F.col("wanted")))
        found = hit.select("stratum", F.col("cell").alias("found"), (F.col("wanted") - F.col("upto") + F.col("n")).alias("wanted"))
        strata = found.select("stratum", "wanted")
        if bits:
            cell = F.floor(F.col("place") / F.lit(2**bits))
            inside = keyed.join(found.select("stratum", "found"), "stratum").where(cell == F.col("found")).select("stratum", "place")
    return found.select("stratum", F.col("found").alias("last"))


def mark_stratified_split(
    staged: DataFrame, label: str, test_percent: int = 20, key: str = "customer_id", flag: str = "is_test"
) -> DataFrame:
    """Add ``flag`` with the share exact in each label: the first keys of each label in hash order.

    Any number of labels; rows without one are a stratum of their own. Rows without a key come last in the order, rows with
    one key stay together.
    """
    stratum = F.coalesce(F.concat(F.lit("="), F.col(label).cast("string")), F.lit(""))
    place = F.coalesce(hash_order(key), F.lit(100 * 2**44))
    keyed = staged.select(stratum.alias("stratum"), place.alias("place"))
    last = _last_places(keyed, test_percent).withColumnRenamed("stratum", "_stratum").withColumnRenamed("last", "_last")
    joined = staged.join(last, stratum == F.col("_stratum"), "left")
    return joined.withColumn(flag, F.coalesce(place <= F.col("_last"), F.lit(False))).drop("_stratum", "_last")


def mark_folds(df: DataFrame, folds: int = 5, key: str = "customer_id") -> DataFrame:
    """Add ``fold``, 0..folds-1; rows without a key are in fold 0."""
    return df.withColumn("fold", F.coalesce((_hex(key, 1, 8) % folds).cast("int"), F.lit(0)))


def train_part(df: DataFrame, flag: str = "is_test") -> DataFrame:
    return df.filter(~F.col(flag)).drop(flag)


def test_part(df: DataFrame, flag: str = "is_test") -> DataFrame:
    return df.filter(flag).drop(flag)
