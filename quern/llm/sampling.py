"""Bounded samples of labelled rows, for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def held_out(doc_id: Column) -> Column:
    """The rows that nothing is learned from: crc32 of doc_id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


#: Labels that a classifier may have; each is a row on the driver.
MOST_LABELS = 1000


def bounded_sample(labelled: DataFrame, label: str, per_class: int, key: str = "doc_id") -> DataFrame:
    """At most per_class rows of each label, those with the smallest hashes of the key.

    Keys are counted over all rows; a hash threshold then leaves the rows of about four times per_class keys
    of each label to be ranked, so that no frequent label is sorted whole. The key of the smallest hash always
    stays, so a label whose rows share a few keys keeps some. More than MOST_LABELS labels raise a ValueError.
    """
    hashed = labelled.withColumn("__h", F.pmod(F.xxhash64(F.col(key), F.lit(7)), F.lit(1 << 32)))
    found = hashed.filter(F.col(label).isNotNull()).groupBy(label).agg(F.approx_count_distinct("__h").alias("keys"), F.min("__h").alias("least"))
    counts = found.limit(MOST_LABELS + 1).collect()
    if len(counts) > MOST_LABELS:
        raise ValueError(f"{label} has more than {MOST_LABELS} values")
    keep = F.lit(False)
    for row in counts:
        most = max(row["least"] + 1, int((1 << 32) * min(1.0, (4 * per_class + 40) / row["keys"])))
        keep |= (F.col(label) == F.lit(row[label])) & (F.col("__h") < most)
    ranked = hashed.filter(keep).withColumn("__r", F.row_number().over(Window.partitionBy(label).orderBy("__h", key)))
    return ranked.filter(F.col("__r") <= per_class).drop("__h", "__r")
