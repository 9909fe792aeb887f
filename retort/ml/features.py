"""Character n-grams of reaction texts as hashed sparse vectors (ML1)."""

from __future__ import annotations

from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FEATURES = 1 << 18
SIZES = (3, 4, 5)


def character_ngrams(text: Column, sizes: tuple[int, ...] = SIZES) -> Column:
    """All substrings of the sizes, in order, case kept; shorter texts give none.

    They are put together from an array of the characters, as finding a place in a long text takes time by its distance.
    """

    def of(chars: Column, n: int) -> Column:
        count = F.size(chars) - (n - 1)
        made = F.transform(F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1), lambda i: F.concat(*[F.get(chars, i + k) for k in range(n)]))
        return F.when(count > 0, made).otherwise(F.array().cast("array<string>"))

    letters = F.filter(F.split(text, ""), lambda c: c != "")
    return F.transform(F.array(letters), lambda chars: F.concat(*[of(chars, n) for n in sizes]))[0]


def sparse_parts(vector: str) -> Column:
    """Struct (indices, values) of a sparse vector column, without making it dense."""
    whole = F.from_json(F.to_json(F.struct(F.col(vector).alias("v"))), "v struct<indices:array<int>,values:array<double>>")
    return whole["v"]


def hash_features(frame: DataFrame, text: str, out: str = "features", size: int = FEATURES) -> DataFrame:
    """Adds the L2-normalised counts of hashed n-grams; a null text has none."""
    grams = frame.withColumn("_grams", F.coalesce(character_ngrams(F.col(text)), F.array().cast("array<string>")))
    counted = HashingTF(numFeatures=size, inputCol="_grams", outputCol="_counts").transform(grams)
    return Normalizer(p=2.0, inputCol="_counts", outputCol=out).transform(counted).drop("_grams", "_counts")
