"""Table schemas."""

from pyspark.sql import types as T

LISTING = T.StructType([
    T.StructField("source", T.StringType()),
    T.StructField("pos", T.LongType()),
    T.StructField("title", T.StringType()),
    T.StructField("company", T.StringType()),
    T.StructField("location", T.StringType()),
    T.StructField("posted_date", T.DateType()),
    T.StructField("deadline", T.StringType()),
    T.StructField("job_url", T.StringType()),
    T.StructField("views", T.StringType()),
])

POSTING = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("title", T.StringType()),
    T.StructField("company", T.StringType()),
    T.StructField("location", T.StringType()),
    T.StructField("job_url", T.StringType()),
    T.StructField("posted_date", T.DateType()),
    T.StructField("created_at", T.TimestampType()),
    T.StructField("updated_at", T.TimestampType()),
    T.StructField("source", T.StringType()),
])

DETAIL_FIELDS = [
    "description", "requirements", "job_type", "job_level", "education",
    "category", "salary", "deadline", "views",
]

DETAIL = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("job_id", T.LongType()),
    T.StructField("job_url", T.StringType()),
    *[T.StructField(n, T.StringType()) for n in DETAIL_FIELDS[:-1]],
    T.StructField("views", T.LongType()),
    T.StructField("scraped_at", T.TimestampType()),
])

PAGE = T.StructType([
    T.StructField("page_id", T.LongType()),
    T.StructField("url", T.StringType()),
    T.StructField("status", T.IntegerType()),
    T.StructField("html", T.StringType()),
])

CRAWL = T.StructType([
    T.StructField("site", T.StringType()),
    T.StructField("crawl_id", T.LongType()),
    T.StructField("scroll_no", T.IntegerType()),
    T.StructField("height", T.LongType()),
    T.StructField("pos", T.LongType()),
    T.StructField("url", T.StringType()),
    T.StructField("card_lines", T.ArrayType(T.StringType())),
])

OUTBOX = T.StructType([
    T.StructField("job_id", T.LongType()),
    T.StructField("chat_id", T.StringType()),
    T.StructField("message", T.StringType()),
    T.StructField("rendered_at", T.TimestampType()),
])

DELIVERY = T.StructType([
    T.StructField("job_id", T.LongType()),
    T.StructField("outcome", T.StringType()),
    T.StructField("error", T.StringType()),
    T.StructField("at", T.TimestampType()),
    T.StructField("call", T.StringType()),
    T.StructField("step", T.StringType()),
])

METRICS = T.StructType([
    T.StructField(n, T.LongType())
    for n in ("inserted", "skipped", "details_ok", "details_failed", "send", "skip", "skip_no_details",
              "rejected_lines", "failed_files", "failed_sources")
])

# One listing as it sits inside a JSON array payload.
LISTING_PAYLOAD = T.ArrayType(T.StructType([
    T.StructField("url", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("company", T.StringType()),
    T.StructField("location", T.StringType()),
]))

REJECTED = T.StructType([
    T.StructField("file", T.StringType()),
    T.StructField("line", T.StringType()),
    T.StructField("reason", T.StringType()),
    T.StructField("at", T.TimestampType()),
])

# Landed files that could not be read (outcome ``failed``), and those of them that could be read later (``read``).
FILES = T.StructType([
    T.StructField("file", T.StringType()),
    T.StructField("outcome", T.StringType()),
    T.StructField("reason", T.StringType()),
    T.StructField("at", T.TimestampType()),
])

# What rounds carry on: postings without details, unsent postings with what a message needs, and stored URLs by bucket.
PENDING = T.StructType([T.StructField("id", T.LongType()), T.StructField("job_url", T.StringType())])

UNSENT = T.StructType([
    *[f for f in POSTING.fields if f.name in ("id", "title", "company", "location", "job_url", "posted_date")],
    *[f for f in DETAIL.fields if f.name in DETAIL_FIELDS and f.name != "education"],
    T.StructField("rendered_at", T.TimestampType()),
    T.StructField("rendered_batch", T.LongType()),
])

KEYS = T.StructType([T.StructField("job_url", T.StringType()), T.StructField("bucket", T.IntegerType())])
