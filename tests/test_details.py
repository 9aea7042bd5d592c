import re
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from postmill.functions import fixed_values as fv
from postmill.functions.html_rows import NO_TEXT, VOID, Outline
from postmill.operators import details as det
from postmill.sources.readers import read_pages

SIDEBAR = '<aside><h3>Vakansiya haqqında</h3>{}</aside>'


def pages(spark, *htmls):
    return spark.createDataFrame(list(enumerate(htmls)), "page_id long, html string")


def section(spark, html):
    return det.section_details(pages(spark, html)).first()


def row(label, value):
    return f'<div class="flex w-full justify-between"><p>{label}</p><p>{value}</p></div>'


@pytest.mark.parametrize(("html", "description"), [
    ("<p>none</p>", None),
    ('<h3>Təsvir</h3><div class="description-html"></div>', ""),
    ('<h3>Təsvir</h3><p>x</p><div class="a description-html b"><p>a</p> <p>b &amp; c</p></div>', "a\nb & c"),
    ("<h3> Təsvir\n</h3>text<p>next <b>one</b></p>", "next\none"),
    ("<div><h3>Təsvir</h3></div><p>outside</p>", None),
    ("<h3>Təsvir işi</h3><p>x</p>", None),
    ('<h3>Təsvir</h3><div class="description-html"><script>x</script>a<!-- c -->b<br>c</div>', "a\nb\nc"),
    ('<h3>Təsvir</h3><div class="description-html"><p>a<p>b</div><p>c', "a\nb"),
])
def test_sections(spark, html, description):
    assert section(spark, html).description == description


def test_sidebar(spark):
    html = SIDEBAR.format(row("Təhsil", "Orta") + row("Təhsil:", "Ali") + row("Son tarix", "1 may")
                          + '<div class="flex justify-between"><p>Vəzifə dərəcəsi</p></div>'
                          + row("Son tarix Təhsil", "2 may")) + row("Vakansiya növü", "outside")
    r = section(spark, html)
    assert (r.education, r.deadline, r.job_level, r.job_type) == ("Ali", "2 may", None, None)


def test_type_falls_back_to_page_text(spark):
    assert section(spark, "<p>Daimi, Yarım ştat</p>").job_type == "Yarım ştat"
    assert section(spark, SIDEBAR.format(row("Vakansiya növü", "Daimi")) + "Tam ştat").job_type == "Daimi"
    assert section(spark, SIDEBAR.format(row("Vakansiya növü", ""))).job_type == ""


def test_views_and_salary(spark):
    box = '<div class="flex items-center"><p>new</p><p>{}</p><p>9</p></div>'
    assert section(spark, box.format("1,234")).views == 1234
    assert section(spark, box.format("0") + box.format("1.5K")).views == 1500
    assert section(spark, box.format("1.234") + box.format("5")).views is None
    assert section(spark, "<b>500</b>\n<i>AZN</i>").salary == "500 \n AZN"


def test_loose(spark):
    html = "<h1> A <b>b</b></h1><h2>x Təsvir y</h2><div>d</div><h2><b>Tələblər</b></h2><p>r</p>"
    r = det.title_and_sections_loose(pages(spark, html, "")).orderBy("page_id").collect()
    assert (r[0].title, r[0].description, r[0].requirements) == ("Ab", "d", "")
    assert (r[1].title, r[1].description, r[1].requirements) == ("Unknown", "", "")


class Texts(HTMLParser):
    """Text pieces by the standard parser, to compare the outline with."""

    def __init__(self, page):
        super().__init__()
        self.seen, self.open = [[]], [""]
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.seen.append([])
        if tag not in VOID:
            self.open.append(tag)

    def handle_endtag(self, tag):
        self.seen.append([])
        if tag in self.open:
            while self.open.pop() != tag:
                pass

    def handle_comment(self, data):
        self.seen.append([])

    handle_decl = handle_comment

    def handle_data(self, data):
        if self.open[-1] not in NO_TEXT:
            self.seen[-1].append(data)

    def pieces(self):
        return [p for p in map("".join, self.seen) if p]


def test_outline_agrees_with_the_standard_parser(spark, sf_dir):
    for page in spark.read.parquet(f"{sf_dir}/pages.parquet").select("html").collect():
        assert list(Outline(page.html).pieces()) == Texts(page.html).pieces()


# -- payload -------------------------------------------------------------------

def payload(spark, fields, arguments="", names="a", before="", after=""):
    html = (f"<html>{before}<script>x()</script><script>window.__NUXT__=(function({names}){{return "
            f"{{s:{{tab_data:{{vacancy:{{{fields}}}}}}}}}}})({arguments})</script>{after}</html>")
    return det.payload_details(pages(spark, html)).first()


LONG = "text:\"<p>Responsibilities</p><p>do it</p><p>Requirements</p>know it\""


def test_payload_text(spark):
    r = payload(spark, LONG)
    assert (r.description, r.requirements) == ("Responsibilities\ndo it", "Requirements\nknow it")
    assert payload(spark, 'text:"0123456789"').description is None
    assert payload(spark, 'text:"01234567890"').description == "01234567890"
    assert payload(spark, "x:{text:\"inner text here\"},y:\"text:1\"").description is None


@pytest.mark.parametrize(("value", "salary"), [
    ("0", None), ("1500", "1500 AZN"), ("1500.9", "1500 AZN"), ("' x '", "x"), ("''", None), ("void 0", None),
    ("true", "1 AZN"), ("null", None), ("-.5", None),
])
def test_payload_salary(spark, value, salary):
    assert payload(spark, "salary:a", value).salary == salary


def test_payload_arguments(spark):
    r = payload(spark, "salary:c,category:{id:1,title:d},v_count:e,deadline_at:f",
                r'''{x:[1,2]},[3,"]"],7,"a\"b\u0041\n}\x42",-12.7,"2026-07-28T00"''', names="a,b,c,d,e,f")
    assert (r.salary, r.category, r.views, r.deadline) == ("7 AZN", 'a"bA\n}B', -12, "2026-07-28")
    assert payload(spark, "deadline_at:a", '"123456789"').deadline is None
    assert payload(spark, 'category:{title:"x"},z:"}{",v_count:5').views == 5


def test_payload_labels(spark):
    r = payload(spark, 'text:"webmaster, REMOTE work"')
    assert (r.job_type, r.education) == ("Remote", "Master")
    assert payload(spark, "v_count:1", before='<meta property="og:description" content="full-time">').job_type is None


def test_meta_fallback(spark):
    meta = '<meta name="x" content="no"><meta content="a\u00a0b &amp; c" property="og:description">'
    assert payload(spark, "v_count:1", before=meta).description == "a b & c"
    assert det.payload_details(pages(spark, meta)).first().description == "a b & c"
    assert payload(spark, LONG, before=meta).description == "Responsibilities\ndo it"


def test_bad_pages_do_not_fail(spark):
    bad = ["no marker", "<script>__NUXT__ = {</script>", "<script>window.__NUXT__=(function(a){return {tab_data:{</script>", "", None]
    rows = det.payload_details(pages(spark, *bad)).orderBy("page_id").collect()
    assert [r.payload for r in rows] == ["none", "unreadable", "unreadable", "none", "none"]
    assert all(r.description is None and r.error is None for r in rows)


@pytest.mark.parametrize(("text", "description", "requirements"), [
    ("a Tələblər b Öhdəliklər c", "Öhdəliklər c", "Tələblər b"),
    ("a Öhdəliklər c Tələblər b", "Öhdəliklər c", "Tələblər b"),
    ("a Tələblər b", "a", "Tələblər b"),
    ("Tələblər b", "Tələblər b", "Tələblər b"),
    ("a Öhdəliklər c", "Öhdəliklər c", None),
    ("plain", "plain", None),
    ("Requirements: x Tələblər y", "Requirements: x", "Tələblər y"),
])
def test_split_sections(spark, text, description, requirements):
    r = det.split_sections(spark.createDataFrame([(text,)], "t string"), "t").first()
    assert (r.description, r.requirements) == (description, requirements)


# -- the job -------------------------------------------------------------------

def test_details_job(spark):
    pending = spark.createDataFrame(
        [(1, "https://a.com/1"), (2, "https://A.com/2"), (3, "https://b.com/3"), (4, "https://c.com/4"), (5, None)],
        "id long, job_url string")
    landed = spark.createDataFrame([
        (1, "https://a.com/1", "<h3>Təsvir</h3><p>old</p>"), (2, "https://a.com/1", "<h3>Təsvir</h3><p>new</p>"),
        (3, "https://b.com/3", "<script>window.__NUXT__=(function(a){return {tab_data:{vacancy:{v_count:a}}}})(4)</script>"),
        (4, "https://A.com/2", ""), (5, "https://c.com/4", "<p>x</p>")], "page_id long, url string, html string")
    job = det.details_job(pending, landed, [det.Site("a.com", "sections"), det.Site("b.com", "payload")])
    rows = {r.job_id: (r.status, r.description, r.views) for r in job.collect()}
    assert rows == {1: ("ok", "new", None), 2: ("no_page", None, None), 3: ("ok", None, 4)}
    counts = det.extract_counts(job).first()
    assert (counts.ok, counts.failed) == (2, 1)
    refused = det.extract_counts(job, job.filter("job_id = 1")).first()
    assert (refused.ok, refused.failed) == (1, 2)


def test_bodies_are_scanned_once(spark, plan, tmp_path):
    path = str(tmp_path / "pages")
    spark.createDataFrame([(1, "a.example/u", 200, "h")], "page_id long, url string, status int, html string").write.parquet(path)
    wanted = spark.range(1).select(F.col("id").alias("job_id"), F.lit("u").alias("job_url"))
    pending = wanted.withColumnRenamed("job_id", "id").withColumn("job_url", F.lit("a.example/u"))
    text = plan(det.details_job(pending, read_pages(spark, path), [det.Site("a.example", "sections")]))
    assert len(re.findall("ReadSchema: struct<[^>]*html", text)) == 1


def test_payload_script_is_the_one_all_scripts_would_give(spark):
    mark = fv.PAYLOAD_MARKER
    pages = [
        f"<script>a</script><script defer>x {mark} y</script>z", f"<SCRIPT>x {mark} y</SCRIPT>", f"{mark}<script>x {mark} y</script>", f"<p>{mark}</p>",
        f"<script>a</script>{mark}<script>{mark}=1</script>", f"<script>x {mark} never ends", f"<scripted>{mark}</scripted><script>b {mark}</script>",
        f"<script>a<SCRIPT>{mark}</Script>", f"<script src='{mark}'>a</script>", f"<script>{mark}</SCRIPT>b</script>", "", None, "no", f"é\U0001F600<script>é {mark} ü</script>"]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "i int, html string")
    got = [r[0] for r in df.orderBy("i").select(det.payload_script(F.col("html"))).collect()]
    want = []
    for p in pages:
        found = [s for s in re.findall(r"(?is)<script\b[^>]*>(.*?)</script", p or "") if mark in s]
        want.append(found[0] if found else None)
    assert got == want
