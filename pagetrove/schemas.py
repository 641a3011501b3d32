"""Record shapes. Readers always pass one of these; nothing is inferred."""

from pyspark.sql import types as T

RAW_PAGE = T.StructType(
    [
        T.StructField("url", T.StringType()),
        T.StructField("content", T.StringType()),
    ]
)

# What a feed reader yields: the page plus the raw text of an undecodable line.
FEED_LINE = T.StructType(RAW_PAGE.fields + [T.StructField("_corrupt_record", T.StringType())])

PARSED_DOC = T.StructType(
    [
        T.StructField("author", T.StringType()),
        T.StructField("content", T.ArrayType(T.StringType())),
        T.StructField("description", T.StringType()),
        T.StructField("published_date", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("url", T.StringType()),
    ]
)

STORED_DOC = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("author", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("published_date", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("url", T.StringType()),
    ]
)
STORED_COLUMNS = [f.name for f in STORED_DOC.fields]

REJECT = T.StructType(
    [
        T.StructField("url", T.StringType()),
        T.StructField("reject_reason", T.StringType()),
        T.StructField("_file", T.StringType()),
        T.StructField("_block", T.LongType()),
        T.StructField("_seq", T.LongType()),
    ]
)

# Longest accepted value, in characters, per stored column.
LIMITS = {"author": 255, "published_date": 30, "title": 255, "url": 255}

# Position of a record in its feed. Compared as a whole it is the arrival order.
ORDER = ["_file", "_block", "_seq"]
