"""Joins against side tables whose size is checked before they are broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_BROADCAST_ROWS = 100_000
MAX_BROADCAST_BYTES = 64 << 20
SALTS = 64


def lookup_join(
    big: DataFrame,
    small: DataFrame,
    on: list[str],
    how: str = "inner",
    max_rows: int = MAX_BROADCAST_ROWS,
    salts: int = SALTS,
) -> DataFrame:
    """Join a large table to an aggregate that is expected to be small.

    At most ``max_rows + 1`` rows of the small side are fetched. If they are all of
    it and take at most ``MAX_BROADCAST_BYTES``, they are broadcast; otherwise both sides are shuffled with a salt, so that a
    key holding a large share of the big side is spread over ``salts`` tasks.
    """
    if how not in ("inner", "left", "left_semi"):
        raise ValueError("only joins that keep the big side's rows can be salted")
    head = small.limit(max_rows + 1).toArrow()
    if head.num_rows <= max_rows and head.nbytes <= MAX_BROADCAST_BYTES:
        local = big.sparkSession.createDataFrame(head, schema=small.schema)
        return big.join(F.broadcast(local), on, how)
    return salted_join(big, small, on, how, salts)


def salted_join(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner", salts: int = SALTS) -> DataFrame:
    rest = [c for c in big.columns if c not in on] or on
    salted = big.withColumn("_salt", F.pmod(F.xxhash64(*rest), F.lit(salts)))
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return salted.join(copies, [*on, "_salt"], how).drop("_salt")
