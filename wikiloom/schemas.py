"""Row shapes shared by the jobs."""

from pyspark.sql import types as T

CATALOG_COLUMNS = ["referenceid", "endpoint", "resolverid", "displaycolor"]

CATALOG_CSV = T.StructType(
    [T.StructField(c, T.StringType()) for c in CATALOG_COLUMNS]
    + [T.StructField("_corrupt_record", T.StringType())]
)

MESSAGES = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("content", T.StringType()),
])

# Responses of the two kinds of wiki API, as far as the cards need them.
SEARCH_XML = "query struct<search struct<p array<struct<_title string>>>>"
PAGE_XML = (
    "query struct<pages struct<page struct<"
    "extract struct<_VALUE string>, _fullurl string, thumbnail struct<_source string>>>>"
)
SEARCH_JSON = "total int, items array<struct<id int>>"
SECTIONS_JSON = "sections array<struct<content array<struct<text string>>>>"
DETAILS_JSON = (
    "basepath string, "
    "items map<string, struct<url string, title string, thumbnail variant, abstract string>>"
)
