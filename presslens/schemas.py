"""Column lists and types shared by every module."""

from __future__ import annotations

from pyspark.sql import types as T

MISSING = "N/A"

ARTICLE_COLUMNS = [
    "title", "authors", "date", "summary", "text", "tags", "url",
    "source", "language", "extracted_by", "scraped_at",
]

SENTIMENT_TYPES = {
    "vader_compound": "double",
    "vader_label": "string",
    "vader_pos": "double",
    "vader_neu": "double",
    "vader_neg": "double",
    "tb_compound": "double",
    "tb_label": "string",
    "tb_subjectivity": "double",
}

LOAD_COLUMNS = [
    "id", "title", "url", "source", "date", "authors", "summary", "scraped_at",
    *SENTIMENT_TYPES,
]

ARTICLE = T.StructType([T.StructField(c, T.StringType()) for c in ARTICLE_COLUMNS])

STORED = T.StructType(
    [T.StructField("id", T.LongType())]
    + ARTICLE.fields
    + [T.StructField("created_at", T.StringType())]
)

SCORES = T.StructType(
    [T.StructField("id", T.LongType())]
    + [
        T.StructField(c, T.DoubleType() if t == "double" else T.StringType())
        for c, t in SENTIMENT_TYPES.items()
    ]
)

SCORED = T.StructType(STORED.fields + SCORES.fields[1:])

DEAD_LETTER = T.StructType([
    T.StructField("failed_at", T.StringType()),
    T.StructField("reason", T.StringType()),
    T.StructField("url", T.StringType()),
])

PAGE = T.StructType([
    T.StructField("page_id", T.LongType()),
    T.StructField("url", T.StringType()),
    T.StructField("html", T.StringType()),
])
