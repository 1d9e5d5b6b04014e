"""Board payloads that were already fetched, as postings; a registry of readers by kind."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.money import structured_salary
from ..functions.text import field_text, known
from ..functions.urls import safe_link, slug_ok
from ..operators.parsing import board_facts, html_blocks, pay_excerpt

#: kind -> reader of a table of payloads (source, status, payload).
READERS: dict[str, Callable[[DataFrame], DataFrame]] = {}
PAGE, MAX_PAGES = 100, 20


def reader(kind: str):
    def add(f):
        READERS[kind] = f
        return f

    return add


def base_posting(**fields: Column) -> list[Column]:
    """The columns of a posting; unknown ones are told as 未知, unsafe links as ''."""
    names = ["company", "title", "city", "salary_raw", "experience", "education", "responsibilities", "requirements"]
    out = [F.coalesce(F.when(known(fields[n]), fields[n]), F.lit("未知")).alias(n) if n in fields else F.lit("未知").alias(n) for n in names]
    out.append(fields.get("published_at", F.lit(None).cast("string")).alias("published_at"))
    out.append(fields.get("status_validity", F.lit("未知")).alias("status_validity"))
    out.append(fields.get("raw_text", F.lit("")).alias("raw_text"))
    return [*out, safe_link(fields.get("source_url", F.lit(""))).alias("source_url")]


@reader("board")
def board(payloads: DataFrame) -> DataFrame:
    """{jobs: [{title, location{name}, content, updated_at, first_published, absolute_url, metadata[{name, value}]}]}: an update isn't a publication.

    Duties, requirements, experience and education come from the content's sections, pay from the metadata or else from the line that tells it."""
    schema = "jobs array<struct<title:string,location:struct<name:string>,content:string,updated_at:string,first_published:string,absolute_url:string,metadata:array<struct<name:string,value:string>>>>"
    j = payloads.where("status = 200").select("source", "company", F.explode(F.from_json("payload", schema)["jobs"]).alias("j"))
    pay = F.try_element_at(F.filter("j.metadata", lambda m: m["name"].rlike("(?i)salary|薪资") & (F.coalesce(m["value"], F.lit("")) != "")), F.lit(1))["value"]
    j = j.withColumns({"_text": field_text(F.col("j.content")), "_blocks": html_blocks(F.coalesce("j.content", F.lit("")))}).withColumn("_facts", board_facts(F.col("_blocks")))
    facts = {f: F.col(f"_facts.{f}") for f in ("responsibilities", "requirements", "experience", "education")}
    return j.select("source", *base_posting(company=F.col("company"), title=F.col("j.title"), city=F.col("j.location.name"), salary_raw=F.coalesce(pay, pay_excerpt(F.col("_text"))), **facts, published_at=F.col("j.first_published"), raw_text=F.col("_text"), status_validity=F.lit("有效"), source_url=F.col("j.absolute_url")))


@reader("postings")
def postings(payloads: DataFrame) -> DataFrame:
    """[{text, descriptionPlain, categories{location}, salaryRange{currency, interval, min, max}, hostedUrl}]."""
    schema = "array<struct<text:string,descriptionPlain:string,categories:struct<location:string>,salaryRange:struct<currency:string,interval:string,min:bigint,max:bigint>,hostedUrl:string>>"
    j = payloads.where("status = 200").select("source", "company", F.explode(F.from_json("payload", schema)).alias("j"))
    s = "j.salaryRange"
    pay = F.when(F.col(s).isNotNull(), structured_salary(F.col(f"{s}.currency"), F.col(f"{s}.min"), F.col(f"{s}.max"), F.col(f"{s}.interval")))
    return j.select("source", *base_posting(company=F.col("company"), title=F.col("j.text"), city=F.col("j.categories.location"), salary_raw=pay, raw_text=F.coalesce("j.descriptionPlain", F.lit("")), status_validity=F.lit("有效"), source_url=F.col("j.hostedUrl")))


def read_source(kind: str, payloads: DataFrame) -> DataFrame:
    if kind not in READERS:
        raise ValueError(f"no reader for {kind}")
    return READERS[kind](payloads)


def outcomes(payloads: DataFrame) -> DataFrame:
    """One row a payload with its error, if any: a failed fetch is a row, and says nothing about a posting's validity."""
    error = F.when(~slug_ok(F.col("source")), "bad source name").when(F.col("status") != 200, F.concat(F.lit("HTTP "), F.col("status").cast("string"))).when(F.try_parse_json("payload").isNull(), "not JSON")
    return payloads.select("source", "status", error.alias("error"))


def page_offsets(spark, total_pages: int = MAX_PAGES) -> DataFrame:
    """The offsets of a paged source, up to its cap."""
    return spark.range(min(total_pages, MAX_PAGES)).select((F.col("id") * PAGE).alias("skip"))
