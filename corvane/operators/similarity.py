"""Near-duplicate notes by sequence ratio, with the length bound as an equi-join on length bands.

The ratio has no transform that an index could answer exactly, so every pair within the length bound is a candidate, as its
definition says. What keeps that bearable is that pairs are narrow: lengths and counts of characters only, whose bound of the
ratio is exact; the two texts are joined to the pairs that pass it.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from corvane.functions import rules as R
from corvane.functions import text as T
from corvane.runtime import ship


KINDS = 40  # counted characters: the letters, digits and blanks; all others together


def _profile(text: F.Column) -> F.Column:
    """How many characters of each kind a text has."""
    kinds = "abcdefghijklmnopqrstuvwxyz0123456789 .,"
    counts = [F.length(text) - F.length(F.replace(text, F.lit(k), F.lit(""))) for k in kinds]
    return F.array(*counts, F.length(F.translate(text, kinds, "")))


def candidates(notes: DataFrame, least: float = 0.70, least_chars: int = 80, by_characters: bool = True) -> DataFrame:
    """(a, b): pairs with 2 * shorter / sum >= least, the first bound of the ratio, and (by_characters) 2 * common characters / sum >= least, the second.

    Lengths are cut into bands of the ratio that the first bound allows, so partners lie in the same band or the next
    and the join is on the band; there is no cross join. Notes of at most least_chars characters have no pairs.
    """
    step = math.log((2 - least) / least)
    rows = normal(notes, least_chars).select("rel", F.length("t").alias("n"), _profile(F.col("t")).alias("k"))
    band = F.floor(F.log(F.col("n").cast("double")) / step)
    one = rows.select(F.col("rel").alias("a"), F.col("n").alias("n_a"), F.col("k").alias("k_a"), band.alias("band"))
    two = rows.select(F.col("rel").alias("b"), F.col("n").alias("n_b"), F.col("k").alias("k_b"), F.explode(F.array(band - 1, band, band + 1)).alias("band"))
    common = F.aggregate(F.zip_with("k_a", "k_b", lambda x, y: F.least(x, y)), F.lit(0), lambda t, x: t + x)
    pairs = one.join(two, "band").where((F.col("a") < F.col("b")) & (2 * F.least("n_a", "n_b") >= least * (F.col("n_a") + F.col("n_b"))))
    pairs = pairs if not by_characters else pairs.where(2 * common >= least * (F.col("n_a") + F.col("n_b")))
    return pairs.select("a", "b")


def normal(notes: DataFrame, least_chars: int = 80) -> DataFrame:
    """(rel, t) of the notes whose normal text is longer than least_chars."""
    return notes.select("rel", T.normal_text(F.col("content")).alias("t")).where(F.length("t") > least_chars)


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """difflib's ratio; it is not symmetric, so the pair's order counts."""
    from difflib import SequenceMatcher

    return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)])


def duplicates(notes: DataFrame, least: float = 0.70) -> DataFrame:
    """(a, b, ratio, advice) of pairs at or over the threshold. Equal texts are settled without the matcher."""
    ship(notes.sparkSession)
    text = lambda r, t: normal(notes).select(F.col("rel").alias(r), F.col("t").alias(t))
    pairs = candidates(notes, least).join(text("a", "text_a"), "a").join(text("b", "text_b"), "b")
    ratio = F.when(F.col("text_a") == F.col("text_b"), F.lit(1.0)).otherwise(sequence_ratio("text_a", "text_b"))
    return pairs.select("a", "b", ratio.alias("ratio")).where(F.col("ratio") >= least).select("a", "b", "ratio", R.duplicate_advice(F.col("ratio")).alias("advice"))
