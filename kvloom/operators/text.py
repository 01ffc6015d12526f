"""Tokens, an inverted index, and keywords by TF-IDF."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MODES = ("default", "short_words", "multi_words")


def tokens(text: Column, mode: str = "default", case_sensitive: bool = False) -> Column:
    """Runs of letters and digits.  ``short_words`` cuts them into pairs of characters,
    ``multi_words`` gives the words and their pairs."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}")
    folded = text if case_sensitive else F.lower(text)
    words = F.filter(F.split(folded, r"[^\p{L}\p{N}]+"), lambda w: w != "")
    if mode == "default":
        return words
    pairs = F.flatten(F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - 1, F.lit(1))), lambda i: F.substr(w, i, F.lit(2)))))
    return pairs if mode == "short_words" else F.concat(words, pairs)


def postings(docs: DataFrame, key: str, text: str, **options) -> DataFrame:
    """token, key and how often."""
    return docs.select(key, F.explode(tokens(F.col(text), **options)).alias("token")).groupBy("token", key).agg(F.count(F.lit(1)).alias("tf"))


def search(index: DataFrame, key: str, words: list[str]) -> DataFrame:
    """Keys that hold all words."""
    return index.where(F.col("token").isin(words)).groupBy(key).agg(F.count_distinct("token").alias("n")).where(F.col("n") == len(set(words))).select(key)


def keywords(docs: DataFrame, key: str, text: str, top: int) -> DataFrame:
    """The ``top`` tokens of each document by tf * ln(N / df), ties by token.  The number of
    documents is one row, so it is broadcast."""
    found = postings(docs, key, text)
    df = found.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    total = docs.agg(F.count(F.lit(1)).alias("n_docs"))
    weighed = found.join(df, "token").crossJoin(F.broadcast(total)).withColumn("score", F.round(F.col("tf") * F.ln(F.col("n_docs") / F.col("df")), 6))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "token"))
    return weighed.withColumn("rank", rank).where(F.col("rank") <= top).select(key, "token", "tf", "df", "score", "rank")
