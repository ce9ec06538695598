"""Joining many rows to few answers when one key may hold a third of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows from which a key is hot, at least; a key is hot only above a thousandth of all rows, so at most 1000 are.
HOT_ROWS, HOT_SHARE, SALTS = 50_000, 1000, 64


def salted_join(rows: DataFrame, answers: DataFrame, keys: list[str], copies: str, total: int, how: str = "inner", hot_rows: int = HOT_ROWS, salts: int = SALTS) -> DataFrame:
    """Joins rows to answers, one answer for each key, with the rows of hot keys spread over salts.

    copies: the column of answers that counts the rows of its key; total: all
    rows. At most HOT_SHARE keys can be hot, so their broadcast is bounded.
    A row's salt is a hash of its other columns, so that a stage that is run
    again after a lost executor salts it alike. Null keys match nothing. The
    column `copies` is dropped.
    """
    least = max(hot_rows, total // HOT_SHARE)
    hot = answers.filter(F.col(copies) >= least).select(*keys).withColumn("_hot", F.lit(True))
    spread = F.when(F.col(copies) >= least, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    right = answers.withColumn("_salt", F.explode(spread)).drop(copies)
    others = [c for c in rows.columns if c not in keys]
    salt = F.pmod(F.xxhash64(*others), F.lit(salts)).cast("int") if others else F.lit(0)
    left = rows.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.when(F.col("_hot"), salt).otherwise(0)).drop("_hot")
    return left.join(right, [*keys, "_salt"], how).drop("_salt")
