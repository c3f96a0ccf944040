"""Near-duplicate pairs by 64-bit similarity hashes: lossless bands, then the exact distance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import bands, hamming


def pairs(rows: DataFrame, key: str, distance: int = 3) -> DataFrame:
    """(a, b, distance), a < b, of rows(key, simhash, characters) within the distance and 25 % in length.

    Rows of one hash and length collapse to their smallest key first, and each other member is paired with it alone, so a group of copies gives a star and not
    all its pairs; pairs between different hashes are given for the representatives.
    """
    reps = rows.groupBy("simhash", "characters").agg(F.min(key).alias("k"))
    star = rows.join(reps, ["simhash", "characters"]).where(F.col(key) != F.col("k")).select(F.col("k").alias("a"), F.col(key).alias("b"), F.lit(0).alias("distance"))
    b = reps.withColumn("band", F.explode(bands(F.col("simhash"))))
    left, right = b.toDF("s1", "c1", "a", "band"), b.toDF("s2", "c2", "b", "band")
    d = hamming(F.col("s1"), F.col("s2"))
    ratio = F.col("c1") / F.greatest(F.lit(1), F.col("c2"))
    cross = left.join(right, "band").where((F.col("a") < F.col("b")) & (d <= distance) & ratio.between(0.75, 1.25)).select("a", "b", d.alias("distance")).distinct()
    return star.union(cross)
