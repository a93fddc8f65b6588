"""Queries of facts from free text: every document's whole text holds planted facts, chosen and placed by its key; the SQL works out from the key what is to be read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import enrichment
from tidemark.operators.storage import spread
from tidemark.queries import query
from tidemark.session import table

CERTIFIED = [
    ("ATC", "board of certification"), ("CISSN", "certified sports nutritionist"), ("CSCS", "certified strength & conditioning specialist"), ("CSPS", "CSPS"), ("DPT", "doctorate of physical therapy"),
    ("LAT", "licensed athletic trainer"), ("NSCA-CPT", "NSCA CPT"), ("PhD", "Ph.D."), ("RD", "registered dietitian"), ("TSAC-F", "TSAC-F"),
]
CLEARED = [("TS/SCI", "top secret with SCI"), ("Top Secret", "an active TS clearance"), ("Secret", "able to obtain a Secret"), ("Public Trust", "a public trust position"), (None, "our trade secret"), (None, "no paper")]
SCHOOLED = [("High School", "a GED"), ("Associate", "an associate degree"), ("Bachelor", "a bachelor's"), ("Master", "a master's"), ("Doctorate", "a terminal degree")]
SCHEDULED = [("Full-time", "full time"), ("Part-time", "part-time"), ("Per-diem", "PRN"), ("Contract", "a contract position")]
PLACED = [(f"Fort {name}", f"{kind} {said}") for name, names in enrichment.FORTS.items() for said in names for kind in ("Fort", "Ft.")] + [
    (name, said) for name, _, names in enrichment.BASES for said in names
]
SERVED = [(service, term) for service, terms in enrichment.SERVICES.items() for term in terms]
NAMED = [("THOR3", "tactical human optimization"), ("POTFF", "preservation of the force and family"), ("SMART", "the SMART clinic"), ("H2F", "holistic health and fitness")]


def _said(table_: list[tuple[str | None, str]], at: str) -> Column:
    return F.get(F.array(*(F.lit(said) for _, said in table_)), F.expr(f"cast({at} as int)"))


def _names(table_: list[tuple[str | None, str]], at: str) -> str:
    """SQL for the name at a place of a table."""
    return "([" + ", ".join("NULL" if name is None else f"'{name}'" for name, _ in table_) + f"])[({at}) + 1]"


def planted(spark: SparkSession, d: str, fact: Column) -> DataFrame:
    """doc_id and a description: the document's whole text with a fact put in at a place that follows from its id."""
    docs = spread(table(spark, d, "documents")).withColumn("_text", F.coalesce("text", F.lit("")))
    place = F.expr("cast(doc_id * 7919 % (length(_text) + 1) as int)")
    text = F.concat(F.left("_text", place), F.lit("\n"), fact, F.lit("\n"), F.substring("_text", place + 1, F.length("_text")))
    return docs.select("doc_id", text.alias("description"))


def _read(spark: SparkSession, d: str, fact: Column, *fields: str) -> DataFrame:
    rows = planted(spark, d, fact).withColumns({"title": F.lit("Worker"), "location": F.lit(""), "compensation": F.lit("")})
    return enrichment.enrich(rows).select("doc_id", *(F.col(f"enrichment.{f}") for f in fields))


def _some(table_: list[tuple[str, str]], empty: str) -> Column:
    """All of a table whose bit of the key is set."""
    return F.concat_ws("; ", F.lit(empty), *(F.expr(f"if(shiftright(doc_id, {k}) & 1 = 1, '{said}', null)") for k, (_, said) in enumerate(table_)))


@query("SELECT doc_id, array_to_string(list_filter([" + ", ".join(f"CASE WHEN (doc_id >> {k}) & 1 = 1 THEN '{name}' END" for k, (name, _) in enumerate(CERTIFIED)) + "], lambda x: x IS NOT NULL), ',') AS certifications FROM documents")
def text_certifications(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, _some(CERTIFIED, "papers"), "certifications").withColumn("certifications", F.array_join("certifications", ","))


@query(f"SELECT doc_id, {_names(CLEARED, 'doc_id % 6')} AS clearance FROM documents")
def text_clearance(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, _said(CLEARED, "doc_id % 6"), "clearance")


@query(f"SELECT doc_id, {_names(SCHOOLED, 'least(doc_id % 5, doc_id // 5 % 5)')} AS education FROM documents")
def text_education(spark: SparkSession, d: str) -> DataFrame:
    """Of two degrees the lower one is asked for."""
    return _read(spark, d, F.concat_ws(" or ", _said(SCHOOLED, "doc_id % 5"), _said(SCHOOLED, "doc_id div 5 % 5")), "education")


@query("SELECT doc_id, CASE WHEN doc_id % 44 < 40 THEN doc_id % 44 + 1 END::INT AS years_experience_min FROM documents")
def text_years(spark: SparkSession, d: str) -> DataFrame:
    """A span of years of which the first counts; more than 40 aren't believed."""
    fact = F.format_string("%d to %d years of experience", F.expr("doc_id % 44 + 1"), F.expr("doc_id % 44 + 2"))
    return _read(spark, d, fact, "years_experience_min")


@query(f"SELECT doc_id, {_names(SCHEDULED, 'doc_id % 4')} AS employment_type FROM documents")
def text_employment_type(spark: SparkSession, d: str) -> DataFrame:
    """Of two schedules the first counts."""
    return _read(spark, d, F.concat_ws(", later ", _said(SCHEDULED, "doc_id % 4"), _said(SCHEDULED, "doc_id div 4 % 4")), "employment_type")


@query(f"SELECT doc_id, {_names(PLACED, f'doc_id % {len(PLACED)}')} AS installation FROM documents")
def text_installation(spark: SparkSession, d: str) -> DataFrame:
    """Every spelling of every installation."""
    return _read(spark, d, _said(PLACED, f"doc_id % {len(PLACED)}"), "installation")


@query(f"SELECT doc_id, {_names(SERVED, f'doc_id % {len(SERVED)}')} AS service_branch FROM documents")
def text_service_branch(spark: SparkSession, d: str) -> DataFrame:
    """Every word of every service."""
    return _read(spark, d, _said(SERVED, f"doc_id % {len(SERVED)}"), "service_branch")


@query(f"SELECT doc_id, {_names(NAMED, 'least(doc_id % 4, doc_id // 4 % 4)')} AS program FROM documents")
def text_program(spark: SparkSession, d: str) -> DataFrame:
    """Of two programmes the more special one."""
    return _read(spark, d, F.concat_ws(" and ", _said(NAMED, "doc_id % 4"), _said(NAMED, "doc_id div 4 % 4")), "program")


_LOW = "(20000 + doc_id * 37 % 100000)"


@query(f"""SELECT doc_id, CASE WHEN doc_id % 3 = 1 THEN 10.5 + doc_id % 150 ELSE {_LOW} END::DOUBLE AS salary_min,
    CASE doc_id % 3 WHEN 0 THEN {_LOW} + 1000 + doc_id % 5000 WHEN 1 THEN 12.5 + doc_id % 150 END::DOUBLE AS salary_max, CASE WHEN doc_id % 3 = 1 THEN 'hour' ELSE 'year' END AS salary_period FROM documents""")
def text_salary(spark: SparkSession, d: str) -> DataFrame:
    """A span of yearly pay, a span of hourly pay, or a floor."""
    dollars = lambda x: F.concat(F.lit("$"), F.format_number(F.expr(x), 0))
    hourly = F.format_string("pays $%.2f to $%.2f per hour", F.expr("cast(10.5 + doc_id % 150 as double)"), F.expr("cast(12.5 + doc_id % 150 as double)"))
    yearly = F.concat(F.lit("the salary is "), dollars(_LOW), F.lit(" - "), dollars(f"{_LOW} + 1000 + doc_id % 5000"), F.lit(" per year"))
    fact = F.when(F.col("doc_id") % 3 == 0, yearly).when(F.col("doc_id") % 3 == 1, hourly).otherwise(F.concat(F.lit("pay starting at "), dollars(_LOW), F.lit(" annually")))
    return _read(spark, d, fact, "salary_min", "salary_max", "salary_period")
