"""Chat sessions over a messages table (conv_id, turn, role, content)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def last_messages(messages: DataFrame, n: int = 60) -> DataFrame:
    return messages.groupBy("conv_id").agg(F.max(F.struct("turn", "content")).alias("m"), F.count("*").alias("n_messages")).select("conv_id", "n_messages", F.left("m.content", F.lit(n)).alias("last_message"))


def session_history(messages: DataFrame, conv_id: int, n: int = 20) -> DataFrame:
    """The last ``n`` messages in time order."""
    return messages.where(F.col("conv_id") == conv_id).orderBy(F.desc("turn"), "role", "content").limit(n).orderBy("turn", "role", "content")


def session_histories(messages: DataFrame, n: int = 20) -> DataFrame:
    order = Window.partitionBy("conv_id").orderBy(F.desc("turn"), "role", "content")
    return messages.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= n).drop("_n")


def session_titles(messages: DataFrame, titles: DataFrame | None = None) -> DataFrame:
    """The stored title, else 50 characters of the first message of a user."""
    first = messages.where("role = 'user'").groupBy("conv_id").agg(F.min(F.struct("turn", "content")).alias("m")).select("conv_id", F.left("m.content", F.lit(50)).alias("title"))
    if titles is None:
        return first
    return first.withColumnRenamed("title", "_first").join(titles.select("conv_id", "title"), "conv_id", "full_outer").select("conv_id", F.coalesce("title", "_first").alias("title"))
