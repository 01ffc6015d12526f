"""Names documents: by id, and by text where rows of one id have different texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvloom.llm.shipping import materialise

NULL_ID = -(1 << 63)


def told_apart(docs: DataFrame, doc: str = "doc", copy: str = "copy") -> DataFrame:
    """``docs`` with ``doc`` (a null id is the smallest long) and ``copy``: a hash of the text where
    an id has several texts, else 0."""
    named = docs.withColumn(doc, F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID))).withColumn(copy, F.xxhash64("text"))
    texts = named.select(doc, copy).distinct()
    several = texts.join(texts.groupBy(doc).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select(doc), doc)
    several = materialise(several.withColumn("__told", F.col(copy)))
    if several.isEmpty():
        return named.withColumn(copy, F.lit(0).cast("long"))
    return named.join(several, [doc, copy], "left").withColumn(copy, F.coalesce("__told", F.lit(0).cast("long"))).drop("__told")
