"""Landed pages to case records: scans, links, parsing, joins, and the reports on them."""

from __future__ import annotations

import uuid

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from lodestone import storage
from lodestone.sources import decision as D
from lodestone.sources import html as H

BASE_URL = "https://example.org/judjuris"
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
REQUIRED, OPTIONAL = ("gr_number", "title", "promulgated", "body"), ("division", "ponente", "separate_opinions", "footnotes")
RECORD = (
    "doc_id long, gr_number string, title string, promulgated date, body string, division string, ponente string, source_url string, "
    "separate_opinions array<string>, footnotes string"
)
MANIFEST = "url string, path string, status string, detail string, fetched_at timestamp"


@F.pandas_udf(StringType())
def decoded(raw: pd.Series) -> pd.Series:
    """Page bytes to text."""
    return raw.map(lambda b: None if b is None else H.decode(bytes(b)))


@F.pandas_udf(StringType())
def page_text(html: pd.Series) -> pd.Series:
    """The cleaned text of a page, without scripts, styles and watermarks."""
    return html.map(lambda x: None if x is None else H.page_text(x))


@F.pandas_udf(ArrayType(StringType()))
def page_links(html: pd.Series) -> pd.Series:
    return html.map(lambda x: H.links(x or ""))


def month_no(month: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(month)).cast("int")


def year_index_url(year: Column) -> Column:
    return F.format_string(f"{BASE_URL}/juri%1$d/juri%1$d.html", year)


def source_url(year: Column, month: Column, file: Column) -> Column:
    return F.format_string(f"{BASE_URL}/juri%1$d/%2$s%1$d/%3$s", year, month, file)


def month_pages(pages: DataFrame) -> DataFrame:
    """(year, month, url) that year pages(year, url, html) link, one a month, in calendar order.

    Links to another year's months do not count; of several to one month the last does.
    """
    rows = pages.select("year", "url", F.posexplode(page_links("html")).alias("pos", "href"))
    shape = rf"(?i)^({'|'.join(MONTHS)})(\d{{4}})/\1\2\.html$"
    rows = rows.where(F.col("href").rlike(shape) & (F.regexp_extract("href", shape, 2) == F.col("year").cast("string")))
    month = F.lower(F.regexp_extract("href", shape, 1)).alias("month")
    last = rows.select("year", month, "pos", F.concat(F.regexp_replace("url", "[^/]*$", ""), "href").alias("url"))
    return last.groupBy("year", "month").agg(F.max_by("url", "pos").alias("url")).orderBy("year", month_no(F.col("month")))


def decision_urls(pages: DataFrame, per_month: int | None = None) -> DataFrame:
    """(slug, url, pos): pages beside a month page(slug, url, html) that it links, where first linked.

    per_month keeps the first so many of each month.
    """
    rows = pages.select("slug", "url", F.posexplode(page_links("html")).alias("pos", "href"))
    rows = rows.where(F.col("href").rlike(f"(?i){D.LOCAL_PAGE.pattern}") & (F.lower("href") != F.concat("slug", F.lit(".html"))))
    found = rows.select("slug", F.concat(F.regexp_replace("url", "[^/]*$", ""), "href").alias("url"), "pos").groupBy("slug", "url").agg(F.min("pos").alias("pos"))
    if per_month is not None:
        found = found.withColumn("n", F.row_number().over(Window.partitionBy("slug").orderBy("pos"))).where(F.col("n") <= per_month).drop("n")
    return found


def raw_pages(spark: SparkSession, folder: str) -> DataFrame:
    """(year, month, file, is_index, html) of the pages in a folder of year/month/file, as landed."""
    # Spark's listing skips folders whose name begins with "_"; those named in a pattern it reads
    place = spark._jvm.org.apache.hadoop.fs.Path
    files = place(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    patterns = [p for p in (f"{folder}/*/_index/*.html", f"{folder}/*/[a-z]*/*.html") if len(files.globStatus(place(p)) or [])]
    if not patterns:
        return spark.createDataFrame([], "year int, month string, file string, is_index boolean, html string")
    rows = spark.read.format("binaryFile").load(patterns)
    parts = F.split("path", "/")
    at = lambda k: F.element_at(parts, -k)
    slug = F.regexp_replace(at(1), r"\.html$", "")
    index = (at(2) == "_index") & slug.rlike(r"^[a-z]{3}\d{4}$")
    rows = rows.where(index | (at(2).isin(*MONTHS) & at(3).rlike(r"^\d{4}$")))
    year = F.when(index, F.right(slug, F.lit(4))).otherwise(at(3)).try_cast("int").alias("year")
    month = F.when(index, F.left(slug, F.lit(3))).otherwise(at(2)).alias("month")
    return rows.select(year, month, at(1).alias("file"), index.alias("is_index"), decoded("content").alias("html"))


_PLACE = [("year", pa.int32()), ("month", pa.string()), ("file", pa.string())]
_TEXTS = lambda *names: pa.list_(pa.struct([(n, pa.string()) for n in names]))
_OUTLINED = pa.schema([*_PLACE, ("title", pa.string()), ("paragraphs", _TEXTS("mark", "text")), ("siblings", _TEXTS("kind", "justice", "href"))])


def _outlined(batches):
    for batch in batches:
        rows = [{k: r[k] for k in ("year", "month", "file")} | D.outline(r["html"] or "") for r in batch.to_pylist()]
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=_OUTLINED)


_PARSED = ("year", "month", "file", "kind", "caption", "citations", "division", "ponente", "body", "footnotes")


def parsed_pages(pages: DataFrame) -> DataFrame:
    """Fields of decision pages(year, month, file, html)."""
    rows = pages.select("year", "month", "file", "html").mapInArrow(_outlined, f"year int, month string, file string, {D.OUTLINE}")
    return D.fields(rows).select(*_PARSED)


def _listed(batches):
    schema = pa.schema([("year", pa.int32()), ("month", pa.string()), ("row", pa.int32()), ("decision_file", pa.string()), ("citations", pa.list_(pa.string())), ("caption", pa.string()), ("promulgated", pa.string()), ("opinion_files", pa.list_(pa.string()))])
    for batch in batches:
        out = [{"year": r["year"], "month": r["month"], **row} for r in batch.to_pylist() for row in D.listing_rows(r["html"] or "")]
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)


def listing(pages: DataFrame) -> DataFrame:
    """The rows of month pages(year, month, html).

    Month pages are few and long, and what makes them may leave them all to one task; they are dealt out first.
    """
    pages = pages.select("year", "month", "html").repartition(4 * pages.sparkSession.sparkContext.defaultParallelism)
    rows = pages.mapInArrow(_listed, "year int, month string, row int, decision_file string, citations array<string>, caption string, promulgated string, opinion_files array<string>")
    return rows.withColumn("promulgated", F.to_date("promulgated"))


def build_records(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, problems) of landed pages, as raw_pages() gives them.

    A case without its decision's page goes, and is a problem; so is a missing opinion, or a
    decision without a body, which stays. doc_id counts records by month and row: months are ranked
    by how many cases stand before them, so that no one task numbers all rows. Each page is parsed
    once: what the joins below need several times is stored first.
    """
    spark = pages.sparkSession
    folder = f"{storage.shared_folder(spark)}/records-{uuid.uuid4().hex}"
    storage.delete_on_exit(spark, folder)
    rows = storage.save(listing(pages.where("is_index")), f"{folder}/listing")
    parsed = storage.save(parsed_pages(pages.where("NOT is_index")), f"{folder}/parsed")
    name = ["year", "month"]
    path = lambda file: F.concat_ws("/", F.col("year").cast("string"), "month", file)
    joined = rows.join(parsed.select(*name, F.col("file").alias("decision_file"), *[F.col(c).alias(f"p_{c}") for c in _PARSED[3:]]), [*name, "decision_file"], "left")
    missing = joined.where("p_body IS NULL").select(F.lit("missing-html").alias("kind"), path("decision_file").alias("detail"))
    kept = joined.where("p_body IS NOT NULL")
    wanted = kept.select(*name, "row", F.posexplode("opinion_files").alias("k", "file")).join(parsed.select(*name, "file", "kind", "ponente", "body"), [*name, "file"], "left")
    lost = wanted.where("body IS NULL").select(F.lit("missing-opinion").alias("kind"), path("file").alias("detail"))
    blocks = wanted.where("body <> ''").select(*name, "row", "k", F.concat(D.opinion_head(F.col("kind"), F.col("ponente")), F.lit("\n\n"), "body").alias("text"))
    opinions = blocks.groupBy(*name, "row").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "text"))), lambda x: x.text).alias("separate_opinions"))
    empty = kept.where("p_body = ''").select(F.lit("empty-body").alias("kind"), path("decision_file").alias("detail"))
    months = kept.groupBy(*name).agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("year", month_no(F.col("month"))).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    numbered = kept.withColumn("in_month", F.row_number().over(Window.partitionBy(*name).orderBy("row")) - 1).join(months.drop("n"), name)
    cited = F.when(F.size("citations") > 0, F.col("citations")).otherwise(F.col("p_citations"))
    records = numbered.join(opinions, [*name, "row"], "left").select(
        (F.col("before") + F.col("in_month")).cast("long").alias("doc_id"), F.array_join(cited, "; ").alias("gr_number"),
        F.when(F.col("caption") != "", F.col("caption")).otherwise(F.col("p_caption")).alias("title"), "promulgated", F.col("p_body").alias("body"),
        F.col("p_division").alias("division"), F.col("p_ponente").alias("ponente"), source_url(F.col("year"), F.col("month"), F.col("decision_file")).alias("source_url"),
        F.coalesce("separate_opinions", F.array().cast("array<string>")).alias("separate_opinions"), F.col("p_footnotes").alias("footnotes"),
    )
    return records, missing.unionByName(lost).unionByName(empty)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RECORD).json(path)


def write_records(records: DataFrame, path: str) -> None:
    records.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def completeness(records: DataFrame) -> DataFrame:
    """(field, required, present, total, percent), from one pass over the records."""
    kinds = dict(records.dtypes)

    def there(c: str) -> Column:
        if kinds[c] == "string":
            return F.count_if(F.col(c).rlike(r"(?U)\S"))
        return F.count_if(F.size(c) > 0) if kinds[c].startswith("array") else F.count(c)

    counts = records.agg(F.count("*").alias("total"), *[there(c).alias(c) for c in REQUIRED + OPTIONAL])
    rows = F.array(*[F.struct(F.lit(c).alias("field"), F.lit(c in REQUIRED).alias("required"), F.col(c).alias("present")) for c in REQUIRED + OPTIONAL])
    percent = F.when(F.col("total") > 0, F.col("present") / F.col("total") * 100).otherwise(0.0)
    return counts.select("total", F.inline(rows)).select("field", "required", "present", "total", percent.alias("percent"))


def body_report(records: DataFrame) -> DataFrame:
    """Characters of non-empty bodies: least, upper median and most, and the range of years.

    The median is taken from counts by length, of which there are few, by their running sum.
    """
    lengths = records.where(F.col("body") != "").groupBy(F.length("body").alias("chars")).agg(F.count("*").alias("n"))
    order = Window.orderBy("chars")
    ranked = lengths.select("chars", F.sum("n").over(order).alias("upto"), F.sum("n").over(Window.partitionBy()).alias("total"))
    sizes = ranked.agg(F.min("chars").alias("least"), F.min(F.when(F.col("upto") > F.floor(F.col("total") / 2), F.col("chars"))).alias("median"), F.max("chars").alias("most"), F.lit(1).alias("k"))
    years = records.agg(F.min(F.year("promulgated")).alias("year_min"), F.max(F.year("promulgated")).alias("year_max"), F.lit(1).alias("k"))
    return sizes.join(F.broadcast(years), "k").drop("k")


def problem_report(problems: DataFrame) -> DataFrame:
    return problems.groupBy("kind").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "kind")


def first_problems(problems: DataFrame, n: int = 10) -> DataFrame:
    """The first problems by year, month and file, which Spark takes with a bounded heap in each task."""
    part = F.split("detail", "/")
    return problems.orderBy(F.get(part, F.lit(0)), month_no(F.get(part, F.lit(1))), F.get(part, F.lit(2)), "kind").limit(n)


def report(records: DataFrame, problems: DataFrame, listed: DataFrame) -> str:
    """What a run of build_records() gave, as text: counts, lengths of bodies, completeness of fields, and problems.

    listed: the rows of the month pages, as listing() gives them. Each line is an aggregate.
    """
    counts = listed.agg(F.count_distinct("year", "month").alias("months"), F.count("*").alias("rows")).first()
    opinions = records.agg(F.coalesce(F.sum(F.size("separate_opinions")), F.lit(0))).first()[0]
    kinds = {r["kind"]: r["n"] for r in problem_report(problems).collect()}
    body, total = body_report(records).first(), records.count()
    lines = [f"{name:<19}{n}" for name, n in (("months read", counts["months"]), ("index rows", counts["rows"]), ("records written", total), ("separate opinions", opinions))]
    lines += [f"{'missing html':<19}{kinds.get('missing-html', 0)}", f"{'empty body':<19}{kinds.get('empty-body', 0)}"]
    if body["year_min"] is not None:
        lines.append(f"{'date range':<19}{body['year_min']}-{body['year_max']}")
    if body["median"] is not None:
        lines.append(f"{'body chars':<19}median {body['median']:,}  min {body['least']:,}  max {body['most']:,}")
    lines += ["", "field completeness"]
    lines += [f" {'*' if r['required'] else ' '} {r['field']:<18} {r['present']:>6,} / {r['total']:,}  {r['percent']:5.1f}%" for r in completeness(records).collect()]
    if kinds:
        lines += ["", "problems by kind", *[f"   {kind:<18} {n:>6,}" for kind, n in kinds.items()]]
        lines += ["", "first 10 problems", *[f"   {r['kind']}: {r['detail']}" for r in first_problems(problems).collect()]]
    return "\n".join(lines)


def append_manifest(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def crawl_counters(manifest: DataFrame) -> DataFrame:
    """Counts of a manifest(status, bytes) by what became of each address, and the share that failed."""
    status = F.col("status")
    counts = manifest.agg(
        F.count("*").alias("attempted"), *[F.count_if(status == s).alias(s) for s in ("fetched", "cached", "failed", "disallowed")],
        F.coalesce(F.sum(F.when(status == "fetched", F.col("bytes"))), F.lit(0)).alias("bytes_fetched"),
    )
    return counts.withColumn("failed_percent", F.when(F.col("attempted") > 0, F.col("failed") / F.col("attempted") * 100).otherwise(0.0))
