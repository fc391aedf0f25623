"""Language of messages and of whole conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.labels import message_language


def with_language(messages: DataFrame, text: str = "text") -> DataFrame:
    return messages.withColumn("language", message_language(F.col(text)))


def conversation_language(messages: DataFrame, request: str = "lv", stored: DataFrame | None = None) -> DataFrame:
    """Language per conversation: its last user message, else the stored, else the requested one."""
    turn = F.when(F.col("role") == "user", F.col("turn"))
    last = messages.groupBy("conv_id").agg(F.max_by("text", turn).alias("last_text"))
    known = last.join(stored.select("conv_id", "chat_locale"), "conv_id", "left") if stored is not None else last.withColumn("chat_locale", F.lit(None).cast("string"))

    def valid(c: Column) -> Column:
        return F.when(c.isin(*fixed.CHAT_LOCALES), c)

    locale = F.coalesce(message_language(F.col("last_text")), valid(F.col("chat_locale")), valid(F.lit(request)), F.lit("lv"))
    return known.select("conv_id", locale.alias("locale"))
