"""Trust ledger: authority counts, roll-up by source, illegal values, and add-only backfill."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions import rules as R


def statistics(records: DataFrame) -> DataFrame:
    """One row: total, with_authority, and a count for each legal authority; other values count nowhere."""
    counts = [F.count_if(F.col("authority") == a).alias(a) for a in R.AUTHORITIES if a != "unknown"]
    unknown = F.count_if(F.coalesce("authority", F.lit("unknown")) == "unknown").alias("unknown")
    return records.agg(F.count("*").alias("total"), F.count("authority").alias("with_authority"), *counts, unknown)


def sources(records: DataFrame) -> DataFrame:
    """(source, note_count, max_authority, reviewed_count, dirs): the best authority by rank, then by value."""
    rank = R.choose([(F.col("a") == a, i) for i, a in enumerate(R.AUTHORITIES)], len(R.AUTHORITIES))
    rows = records.where("source IS NOT NULL").withColumn("a", F.coalesce("authority", F.lit("unknown"))).withColumn("k", rank)
    return rows.groupBy("source").agg(
        F.count("*").alias("note_count"), F.min(F.struct("k", "a"))["a"].alias("max_authority"),
        F.count_if(F.col("review_status") == "reviewed").alias("reviewed_count"),
        F.array_sort(F.collect_set(F.substring_index("rel", "/", 1))).alias("dirs"),
    )


def illegal_values(records: DataFrame) -> DataFrame:
    """(rel, field, value): trust fields that are present and not legal."""
    legal = {"authority": R.AUTHORITIES, "claim_risk": R.CLAIM_RISKS, "review_status": R.REVIEW_STATUSES}
    rows = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value"), F.col(f).isin(v).alias("ok")) for f, v in legal.items()]))
    return records.select("rel", rows.alias("x")).where("x.value IS NOT NULL AND NOT x.ok").select("rel", "x.field", "x.value")


def backfill(records: DataFrame) -> DataFrame:
    """(rel, adds): the trust fields that a note lacks, by its place and other fields; existing ones are never replaced.

    records: rel, type, title, tags, source_type, source_author, authority, claim_risk, review_status.
    """
    pair = R.trust(*[F.col(c) for c in ("rel", "type", "title", "tags", "source_type", "source_author")])
    wanted = F.array(*[F.struct(F.lit(f).alias("field"), v.alias("value"), F.col(f).isNull().alias("missing")) for f, v in (("authority", pair["authority"]), ("claim_risk", pair["claim_risk"]), ("review_status", F.lit("unreviewed")))])
    adds = F.transform(F.filter(wanted, lambda x: x["missing"]), lambda x: F.concat(x["field"], F.lit(": "), x["value"]))
    return records.select("rel", adds.alias("adds")).where(F.size("adds") > 0)
