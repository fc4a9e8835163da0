"""Small tables with the awkward rows every corpus operator must take."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

# Extra columns with names the operators use themselves, or that need quoting.
CLASHES = "row string, id string, at long, grp string, h long, `a.b` string"
DOCUMENTS = f"doc_id long, text string, lang string, source string, n_chars long, {CLASHES}"
PAGES = f"page_id long, url string, html string, {CLASHES}"
_EXTRA = ("r", "i", 1, "g", 2, "ab")


def prose(seed: int, words: int) -> str:
    draw = random.Random(seed)
    stems = ["the", "river", "stone", "of", "under", "light", "walks", "seven", "and", "ember", "to", "glass"]
    return " ".join(draw.choice(stems) + draw.choice(["", "s", "ed", "ing", "er"]) for _ in range(words)).capitalize()


def documents(spark: SparkSession, *texts: str | None) -> DataFrame:
    """Texts with ids from 1, then nulls in every column, repeated rows and repeated ids."""
    rows = [(i, text, "en", "web", len(text or ""), *_EXTRA) for i, text in enumerate(texts, 1)]
    awkward = [
        (901, None, "en", "web", None, *_EXTRA), (902, "", "en", None, 0, *_EXTRA), (903, " \n\t ", None, "web", 4, *_EXTRA),
        (None, prose(5, 60), "en", "web", 1, *_EXTRA), (None, None, None, None, None, *([None] * 6)),
        (904, prose(6, 40), "en", "web", 1, *_EXTRA), (904, prose(6, 40), "en", "web", 1, *_EXTRA),
        (904, prose(7, 45), "de", "web", 1, *_EXTRA), (905, prose(8, 30_000), "en", "web", 1, *_EXTRA),
    ]
    return spark.createDataFrame(rows + awkward, DOCUMENTS).repartition(3)


def no_documents(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], DOCUMENTS)


def pages(spark: SparkSession, *rows: tuple[str | None, str | None]) -> DataFrame:
    """Pages with ids from 1, then nulls in every column and repeated rows."""
    own = [(i, url, html, *_EXTRA) for i, (url, html) in enumerate(rows, 1)]
    awkward = [
        (901, None, "<p>no address</p>", *_EXTRA), (902, "http://a.org/", None, *_EXTRA), (903, "", "", *_EXTRA),
        (None, "http://a.org/x", "<p>no id</p>", *_EXTRA), (None, None, None, *([None] * 6)),
        (904, "http://b.org/", "<p>twice</p>", *_EXTRA), (904, "http://b.org/", "<p>twice</p>", *_EXTRA),
        (905, "http://long.org/" + "p/" * 20_000, "<p>" + "word " * 100_000, *_EXTRA),
    ]
    return spark.createDataFrame(own + awkward, PAGES).repartition(3)


def no_pages(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], PAGES)


def rows_of(df: DataFrame) -> list[tuple]:
    return sorted((tuple(row) for row in df.collect()), key=repr)
