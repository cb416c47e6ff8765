"""A bounded sample of rows for training, the same however the table is partitioned."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hash_sample(df: DataFrame, total: int, key: str, rows: int) -> DataFrame:
    """At most `rows` rows of df: those with the smallest hashes of the key.

    total is about the number of rows; from it a bound on the hash is set so that tasks hand on few rows besides those
    taken, instead of `rows` each.
    """
    hashed = F.xxhash64(F.col(key))
    if total > 4 * rows:
        df = df.where(hashed <= F.lit(int(-(2**63) + 3.0 * rows / total * 2**64)))
    return df.orderBy(hashed, key).limit(rows)
