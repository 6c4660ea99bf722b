"""Replies of a rating model: JSON text to scores, and their mean."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What stands for a reply that can't be read.
FAILED = -1.0
MOST_ISSUES = 12
_SCHEMA = "analysis string, issues array<string>, score double, broken string"


def read_reply(reply: str | Column) -> Column:
    """A struct (score, issues, analysis, error) of a reply's JSON.

    A reply that isn't a JSON object, has no score from 0 to 100, or has a field of another type, has the score -1, no
    issues, and says in error what is wrong; so has a null. Issues beyond the twelfth stay.
    """
    text = F.col(reply) if isinstance(reply, str) else reply
    made = F.from_json(text, _SCHEMA, {"columnNameOfCorruptRecord": "broken", "mode": "PERMISSIVE"})
    wrong = F.when(text.isNull(), "no reply").when(made.isNull() | made["broken"].isNotNull(), "not the JSON asked for").when(made["score"].isNull() | F.isnan(made["score"]), "no score").when(~made["score"].between(0, 100), "score out of range")
    good = wrong.isNull()
    return F.struct(
        F.when(good, made["score"]).otherwise(F.lit(FAILED)).alias("score"), F.when(good, F.coalesce(made["issues"], F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>")).alias("issues"),
        F.when(good, F.coalesce(made["analysis"], F.lit(""))).otherwise("").alias("analysis"), wrong.alias("error"),
    )


def mean_rating(replies: DataFrame, reply_col: str = "reply", *by: str) -> DataFrame:
    """(by..., items, failed, mean_score, issues): the mean counts failures as -1; issues are all that were listed."""
    read = replies.select(*by, read_reply(reply_col).alias("r"))
    return read.groupBy(*by).agg(F.count("*").alias("items"), F.count("r.error").alias("failed"), F.round(F.avg("r.score"), 6).alias("mean_score"), F.sum(F.size("r.issues")).cast("bigint").alias("issues"))
