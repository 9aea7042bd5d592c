"""Detail extraction: landed pages to detail fields.

One Arrow pass over the pages returns raw strings; every rule on them is a column expression.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

import postmill
from postmill.functions import fixed_values as fv
from postmill.functions import text
from postmill.functions.html_rows import loose_row, section_row
from postmill.functions.numbers import first_compact_number, salary_span
from postmill.functions.payload_rows import payload_row
from postmill.schemas import DETAIL_FIELDS
from postmill.sources.staging import stage

# The page helpers travel with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(postmill)

_S = T.StringType()
_SCALAR = T.StructType([T.StructField("value", _S), T.StructField("is_number", T.BooleanType())])

SECTION_RAW = T.StructType([
    T.StructField("description", _S),
    T.StructField("requirements", _S),
    T.StructField("category", _S),
    T.StructField("sidebar", T.ArrayType(T.StructType([
        T.StructField("label", _S), T.StructField("value", _S)]))),
    T.StructField("numbers", T.ArrayType(_S)),
    T.StructField("nodes", T.ArrayType(_S)),
])
PAYLOAD_RAW = T.StructType([
    T.StructField("payload", _S),
    T.StructField("text", _S),
    T.StructField("text_length", T.LongType()),
    T.StructField("category", _S),
    T.StructField("deadline", _SCALAR),
    T.StructField("salary", _SCALAR),
    T.StructField("views", _SCALAR),
])
LOOSE_RAW = T.StructType([
    T.StructField("title", _S), T.StructField("description", _S), T.StructField("requirements", _S)])


@dataclass(frozen=True)
class Site:
    """A listing site: the host its URLs hold and how its pages carry the details."""

    host: str
    kind: str  # "sections" or "payload"


def payload_script(html: Column) -> Column:
    """The first script that holds the payload marker, NULL when there is none."""
    scripts = F.regexp_extract_all(html, F.lit(r"(?is)<script\b[^>]*>(.*?)</script"), 1)
    found = F.try_element_at(F.filter(scripts, lambda s: s.contains(fv.PAYLOAD_MARKER)), F.lit(1))
    return F.when(html.contains(fv.PAYLOAD_MARKER), found)


def meta_description(html: Column) -> Column:
    """Content of the first ``og:description`` tag."""
    tag = r"(?is)<meta\b[^>]*\sproperty\s*=\s*[\"']?og:description[\"'\s/>][^>]*>?"
    content = r"(?is)\scontent\s*=\s*(?:\"([^\"]*)\"|'([^']*)')"
    first = F.regexp_extract(html, tag, 0)
    value = F.concat(F.regexp_extract(first, content, 1), F.regexp_extract(first, content, 2))
    return F.when(html.contains("og:description"), F.nullif(text.decode_entities(value), F.lit("")))


#: Bytes of bodies, and pages, whose results a worker holds at a time; a longer body stands alone.
SLICE_BYTES, SLICE_PAGES = 1 << 20, 256


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Neighbouring pages of a batch, few enough to be held as Python objects."""
    begin = held = 0
    for at, size in enumerate(pc.fill_null(pc.binary_length(batch.column("body")), 0).to_pylist()):
        if at > begin and (held + size > SLICE_BYTES or at - begin == SLICE_PAGES):
            yield batch.slice(begin, at - begin)
            begin, held = at, 0
        held += size
    if begin < batch.num_rows:
        yield batch.slice(begin)


def parse_pages(pages: DataFrame, parsers: dict[str, tuple[Callable[[str], dict], T.StructType]],
                keys: Sequence[str]) -> DataFrame:
    """Run the parser named by column ``kind`` on column ``body``; a NULL body is left alone.

    The result has the keys, one struct per parser (NULL for the others) and ``error``. A page
    that cannot be read gives an error, not a failed task. Arrow batches are bounded in bytes by
    ``spark.sql.execution.arrow.maxBytesPerBatch``; of a batch a worker turns one slice after the other into Python
    objects, so what it holds beside the batch does not grow with the number of its rows.
    """
    source = pages.select(*keys, "kind", "body")
    schema = T.StructType([
        *[source.schema[k] for k in keys],
        *[T.StructField(name, raw) for name, (_, raw) in parsers.items()],
        T.StructField("error", _S),
    ])
    arrow = to_arrow_schema(schema)
    functions = {name: parser for name, (parser, _) in parsers.items()}

    def parse_one(kind, body):
        if body is None:
            return {}
        try:
            return {kind: functions[kind](body)}
        except Exception as e:  # noqa: BLE001 - a bad page must not fail the job
            return {"error": f"{type(e).__name__}: {e}"}

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch):
                rows = [parse_one(k, b) for k, b in zip(
                    part.column("kind").to_pylist(), part.column("body").to_pylist(), strict=True)]
                parsed = pa.RecordBatch.from_pylist(rows, pa.schema(list(arrow)[len(keys):]))
                yield pa.RecordBatch.from_arrays(
                    [part.column(k) for k in keys] + parsed.columns, schema=arrow)

    return source.mapInArrow(parse, schema)


# -- server-rendered pages -----------------------------------------------------

def label_values(sidebar: Column) -> dict[str, Column]:
    """Fields of the sidebar rows: the label contains the word, tested in order; later rows win."""
    def last_value(word, earlier):
        hits = F.filter(sidebar, lambda r: r["label"].contains(word) & ~text.contains_any(r["label"], earlier))
        return F.try_element_at(hits, F.lit(-1))["value"]

    words = [word for word, _ in fv.SIDEBAR_LABELS]
    return {field: last_value(word, words[:i]) for i, (word, field) in enumerate(fv.SIDEBAR_LABELS)}


def with_section_fields(parsed: DataFrame, raw: str = "sections") -> DataFrame:
    """Fields of server-rendered pages. The page text is joined once, as a column of its own."""
    section = F.col(raw)
    side = label_values(section["sidebar"])
    texts = parsed.withColumns({
        "_text": F.array_join(section["nodes"], ""),
        "_spaced": F.array_join(section["nodes"], " "),
        "_type": side["job_type"],
    })
    return texts.withColumns({
        "description": section["description"],
        "requirements": section["requirements"],
        "job_type": F.coalesce(F.nullif(F.col("_type"), F.lit("")),
                               text.first_word_in_order(F.col("_text"), fv.JOB_TYPE_WORDS), "_type"),
        "job_level": side["job_level"],
        "education": side["education"],
        "category": section["category"],
        "salary": salary_span(F.col("_spaced")),
        "deadline": side["deadline"],
        "views": first_compact_number(section["numbers"]),
    }).drop("_text", "_spaced", "_type")


# -- payload pages -------------------------------------------------------------

def split_sections(df: DataFrame, column: str, requirement_markers: Sequence[str] = fv.REQUIREMENT_MARKERS,
                   description_markers: Sequence[str] = fv.DESCRIPTION_MARKERS) -> DataFrame:
    """Add ``description`` and ``requirements`` of a combined text.

    The first marker in list order that occurs marks each section; what comes first ends where
    the other begins. Without a description marker the text before the requirements is the
    description; with no text there, or no marker at all, the whole text is.

    Positions are columns of their own, so each search is done once per row.
    """
    full = F.col(column)

    def start(markers):
        return F.coalesce(*[F.nullif(F.locate(m, full), F.lit(0)) for m in markers])

    def part(begin, end=None):
        length = F.length(full) if end is None else end - begin
        return F.nullif(text.strip(F.substring(full, begin, length)), F.lit(""))

    req, desc = F.col("_req"), F.col("_desc")
    # Where each part ends: at the other part when that begins later.
    marked = df.withColumns({"_req": start(requirement_markers), "_desc": start(description_markers)})
    marked = marked.withColumns({
        "_desc_from": F.when(desc.isNull() & req.isNotNull(), 1).otherwise(desc),
        "_desc_to": F.when((desc < req) | desc.isNull(), req),
        "_req_to": F.when(req < desc, desc),
    })
    return marked.withColumns({
        "description": F.coalesce(part(F.col("_desc_from"), F.coalesce("_desc_to", F.length(full) + 1)), full),
        "requirements": part(req, F.coalesce("_req_to", F.length(full) + 1)),
    }).drop("_req", "_desc", "_desc_from", "_desc_to", "_req_to")


def classify_by_keyword(description: Column, requirements: Column,
                        pairs: Sequence[tuple[str, str]]) -> Column:
    """Label of the first word, in list order, found anywhere in the lowered texts."""
    both = F.lower(F.concat(description, F.lit("\n"), F.coalesce(requirements, F.lit(""))))
    return F.when(description != "", text.first_label_in_order(both, pairs))


def _plain_payload_fields(raw: Column) -> dict[str, Column]:
    """Fields that depend on nothing but their own raw value."""
    deadline, salary, views = raw["deadline"], raw["salary"], raw["views"]
    amount = F.when(salary["is_number"], salary["value"].try_cast("double"))
    return {
        "category": raw["category"],
        "deadline": F.when(~deadline["is_number"] & (F.length(deadline["value"]) >= 10),
                           F.substring(deadline["value"], 1, 10)),
        "salary": F.when(amount > 0, F.concat(amount.try_cast("bigint").cast("string"), F.lit(" " + fv.CURRENCY_CODE)))
        .when(~salary["is_number"], F.nullif(text.strip(salary["value"]), F.lit(""))),
        "views": F.when(views["is_number"], views["value"].try_cast("double").try_cast("bigint")),
    }


def meta_fallback(description: Column, meta: Column) -> Column:
    """The description, or the meta text with plain spaces when there is none."""
    plain = F.replace(F.nullif(meta, F.lit("")), F.lit("\u00a0"), F.lit(" "))
    return F.coalesce(F.nullif(description, F.lit("")), plain, description)


def with_payload_fields(parsed: DataFrame, raw: str = "payload") -> DataFrame:
    """Payload fields, labels found in the text, then column ``meta`` as fallback."""
    payload = F.col(raw)
    plain = parsed.withColumns({
        "_full": F.when(payload["text_length"] > 10, payload["text"]),
        "job_level": F.lit(None).cast("string"),
        **_plain_payload_fields(payload),
    })
    cut = split_sections(plain, "_full")
    both = F.lower(F.concat("description", F.lit("\n"), F.coalesce("requirements", F.lit(""))))
    return cut.withColumn("_both", F.when(F.col("description") != "", both)).withColumns({
        "job_type": text.first_label_in_order(F.col("_both"), fv.JOB_TYPE_LABELS),
        "education": text.first_label_in_order(F.col("_both"), fv.EDUCATION_LABELS),
        "description": meta_fallback(F.col("description"), F.col("meta")),
    }).drop("_full", "_both")


# -- jobs ----------------------------------------------------------------------

def section_details(pages: DataFrame, keys: Sequence[str] = ("page_id",)) -> DataFrame:
    """Detail fields of server-rendered pages."""
    bodies = pages.select(*keys, F.lit("sections").alias("kind"), F.col("html").alias("body"))
    parsed = parse_pages(bodies, {"sections": (section_row, SECTION_RAW)}, keys)
    return with_section_fields(parsed).select(*keys, *DETAIL_FIELDS, "error")


def payload_details(pages: DataFrame, keys: Sequence[str] = ("page_id",)) -> DataFrame:
    """Detail fields of payload pages. Only the payload script itself crosses to Python."""
    bodies = pages.select(
        *keys, meta_description(F.col("html")).alias("meta"),
        F.lit("payload").alias("kind"), payload_script(F.col("html")).alias("body"))
    parsed = parse_pages(bodies, {"payload": (payload_row, PAYLOAD_RAW)}, [*keys, "meta"])
    return with_payload_fields(parsed).select(
        *keys, *DETAIL_FIELDS, F.coalesce("payload.payload", F.lit("none")).alias("payload"), "error")


def title_and_sections_loose(pages: DataFrame, keys: Sequence[str] = ("page_id",)) -> DataFrame:
    bodies = pages.select(*keys, F.lit("loose").alias("kind"), F.col("html").alias("body"))
    return parse_pages(bodies, {"loose": (loose_row, LOOSE_RAW)}, keys).select(*keys, "loose.*")


def latest_pages(pages: DataFrame, wanted: DataFrame) -> DataFrame:
    """Newest usable page of each wanted posting, with its HTML.

    Which pages these are is found on narrow rows: their ids are a partial maximum per URL of what a semi join lets through. (Pages that
    have a column ``length`` need not be opened for that.) The chosen ids are written; then the bodies are scanned once, cut
    in the scan to the range of the ids, and joined by id, so that bodies of other pages stay where they are: Spark
    broadcasts the ids where they are few, else it filters the scan through a Bloom filter of them before it moves anything.
    """
    body = F.col("length") > 0 if "length" in pages.columns else F.col("html").isNotNull() & (F.col("html") != "")
    usable = body & (F.col("status") == 200) if "status" in pages.columns else body
    newest = pages.filter(usable).select("url", "page_id").join(
        wanted.select(F.col("job_url").alias("url")).distinct(), "url", "left_semi").groupBy("url").agg(F.max("page_id").alias("page_id"))
    seen = Observation()
    chosen = stage(wanted.select("job_id", "job_url").join(newest, F.col("job_url") == F.col("url")).select(
        "job_id", "job_url", "page_id").observe(seen, F.min("page_id").alias("low"), F.max("page_id").alias("high")), "chosen-pages")
    low, high = seen.get["low"], seen.get["high"]
    if low is None:
        return chosen.withColumn("html", F.lit(None).cast("string"))
    bodies = pages.filter(F.col("page_id").between(low, high) & usable).select("page_id", "url", "html")
    found = bodies.join(chosen.filter(F.col("page_id").between(low, high)).withColumnRenamed("page_id", "_chosen"),
                        (F.col("page_id") == F.col("_chosen")) & (F.col("url") == F.col("job_url")))
    return found.select("job_id", "job_url", "page_id", "html")


def _kind(sites: Sequence[Site]) -> Column:
    url = text.ascii_fold(F.col("job_url"))
    return F.coalesce(*[F.when(url.contains(s.host.lower()), F.lit(s.kind)) for s in sites], F.lit(None).cast("string"))


def wanted_of(pending: DataFrame, sites: Sequence[Site]) -> DataFrame:
    """``(job_id, job_url)`` of the pending postings of the sites."""
    return pending.select(F.col("id").alias("job_id"), "job_url").filter(_kind(sites).isNotNull())


def read_details(wanted: DataFrame, pages: DataFrame, sites: Sequence[Site]) -> DataFrame:
    """``job_id``, detail fields and ``error`` of the newest usable page of each wanted posting."""
    html = F.col("html")
    payload = F.col("kind") == "payload"
    bodies = latest_pages(pages, wanted).withColumn("kind", _kind(sites)).select(
        "job_id", "kind", F.when(payload, meta_description(html)).alias("meta"),
        F.when(payload, payload_script(html)).otherwise(html).alias("body"))
    parsed = parse_pages(bodies, {"sections": (section_row, SECTION_RAW), "payload": (payload_row, PAYLOAD_RAW)},
                         ["job_id", "meta"])
    # Each page is of one kind, so the fields of the other kind are NULL throughout.
    by_section = with_section_fields(parsed).select(
        "job_id", "error", "meta", "payload", F.struct(*DETAIL_FIELDS).alias("_s"))
    return with_payload_fields(by_section).select("job_id", "error", *[
        F.coalesce(F.col(n), F.col("_s")[n]).alias(n) for n in DETAIL_FIELDS])


def content() -> Column:
    """Tells the fields of two pages apart."""
    return F.xxhash64(*DETAIL_FIELDS)


def outcomes(wanted: DataFrame, read: DataFrame, order: Column, columns: Sequence[str]) -> DataFrame:
    """One row per wanted posting: ``columns`` of what was read for it, and ``status``.

    ``ok`` means that a page was there and could be read, even if it held no field; ``no_page``
    and ``error`` are failures. Should a page have landed twice under one id, one of them counts, whichever way they come.
    Choosing that one and the join use one partitioning by id.
    """
    best = Window.partitionBy("job_id").orderBy("error", order)
    first = read.filter(F.col("job_id").isNotNull()).withColumn("_rank", F.row_number().over(best)).filter(F.col("_rank") == 1)
    return wanted.join(first.select("job_id", "error", *columns, F.lit(True).alias("_read")), "job_id", "left").select(
        "job_id", "job_url", *columns,
        F.when(F.col("_read").isNull(), "no_page").when(F.col("error").isNotNull(), "error")
        .otherwise("ok").alias("status"))


def details_job(pending: DataFrame, pages: DataFrame, sites: Sequence[Site]) -> DataFrame:
    """One row per pending posting of the sites: detail fields and ``status`` (``outcomes``)."""
    wanted = wanted_of(pending, sites)
    return outcomes(wanted, read_details(wanted, pages, sites), content(), DETAIL_FIELDS)


def extract_counts(extracted: DataFrame, accepted: DataFrame | None = None) -> DataFrame:
    """Extractions that were stored, and those that failed or were refused."""
    ok = F.count_if(F.col("status") == "ok")
    if accepted is None:
        return extracted.agg(ok.alias("ok"), F.count_if(F.col("status") != "ok").alias("failed"))
    rows = extracted.select(F.lit(0).alias("stored")).unionAll(accepted.select(F.lit(1)))
    stored = F.count_if(F.col("stored") == 1)
    return rows.agg(stored.alias("ok"), (F.count_if(F.col("stored") == 0) - stored).alias("failed"))
