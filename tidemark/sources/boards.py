"""Postings from board payloads: one declarative field map a kind, one parser for all."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.money import tolerant_time
from tidemark.functions.text import html_to_text, looks_remote
from tidemark.operators.history import first_of_each


@dataclass(frozen=True)
class FieldMap:
    """Where a kind keeps its fields.  Paths are JSON paths from a row; the first that holds something wins.

    url_form makes a URL of {base} and {id} where no path gives one.  facts are a label and paths, of which the first that holds something
    counts; they are put behind the description, facts_apart as a paragraph of their own.  Codes such as FULL_TIME are made readable in the facts that
    coded_facts names, all others stay as they are.  statuses, if given, are those that may be published (a row without a status is kept).  pay is (low, high, interval) paths.
    """

    rows: tuple[str, ...]
    source_id: tuple[str, ...]
    url: tuple[str, ...] = ()
    title: tuple[str, ...] = ("$.title",)
    location: tuple[str, ...] = ()
    location_parts: tuple[str, ...] = ()
    department: tuple[str, ...] = ()
    compensation: tuple[str, ...] = ()
    pay: tuple[str, str, str] | None = None
    posted_at: tuple[str, ...] = ()
    remote: tuple[str, ...] = ()
    description: tuple[str, ...] = ()
    description_parts: tuple[str, ...] = ()
    facts: tuple[tuple[str, ...], ...] = ()
    coded_facts: tuple[str, ...] = ()
    facts_apart: bool = True
    url_form: str = ""
    https_only: bool = False
    status: tuple[str, ...] = ()
    statuses: tuple[str, ...] = ()
    employer: tuple[str, ...] = ()


_PAY_PARTS = ("$.detail.payRange.minimum", "$.detail.payRange.maximum", "$.detail.payRange.frequency")

KINDS: dict[str, FieldMap] = {
    "greenhouse": FieldMap(
        ("$.jobs",), ("$.id",), ("$.absolute_url",), location=("$.location.name",), department=("$.departments[0].name",), posted_at=("$.updated_at", "$.created_at"), description=("$.content",),
    ),
    "lever": FieldMap(
        ("$",), ("$.id",), ("$.hostedUrl", "$.applyUrl"), ("$.text",), ("$.categories.location",), department=("$.categories.team",), posted_at=("$.createdAt",),
        description=("$.descriptionPlain", "$.description"), description_parts=("$.lists[*].content",), remote=("$.categories.commitment",),
    ),
    "ashby": FieldMap(
        ("$.jobs",), ("$.id",), ("$.jobUrl",), location=("$.location",), department=("$.department", "$.team"), compensation=("$.compensationTierSummary",), posted_at=("$.publishedAt",),
        remote=("$.isRemote",), description=("$.descriptionPlain", "$.descriptionHtml"),
    ),
    "workable": FieldMap(
        ("$.jobs",), ("$.shortcode", "$.id"), ("$.url", "$.application_url"), location_parts=("$.city", "$.state", "$.country"), department=("$.department",),
        posted_at=("$.published_on", "$.created_at"), remote=("$.telecommuting",), description=("$.description",), description_parts=("$.requirements",),
    ),
    # Rows of the next three are {listing, detail}, see with_detail.
    "smartrecruiters": FieldMap(
        ("$",), ("$.listing.id",), ("$.detail.postingUrl", "$.detail.applyUrl", "$.listing.ref"), ("$.listing.name",),
        location_parts=("$.listing.location.city", "$.listing.location.region", "$.listing.location.country"), department=("$.listing.department.label",), posted_at=("$.listing.releasedDate",),
        remote=("$.listing.location.remote",), description=("$.detail.jobAd.sections.jobDescription.text", "$.listing.name"),
        description_parts=("$.detail.jobAd.sections.qualifications.text", "$.detail.jobAd.sections.additionalInformation.text"),
    ),
    "bamboohr": FieldMap(
        ("$",), ("$.listing.id",), url_form="{base}/careers/{id}", title=("$.listing.jobOpeningName", "$.listing.title", "$.listing.name"),
        location_parts=("$.listing.location.city", "$.listing.location.state", "$.listing.location.country"), department=("$.listing.departmentLabel", "$.listing.department"),
        compensation=("$.detail.compensation", "$.detail.compensationRange", "$.detail.payRange"), posted_at=("$.listing.datePosted", "$.detail.datePosted"), remote=("$.listing.isRemote",),
        description=("$.detail.description", "$.detail.jobSummary", "$.detail.jobDescription", "$.listing.jobOpeningName"),
        facts=(("Department", "$.listing.departmentLabel"), ("Employment type", "$.listing.employmentStatusLabel")),
    ),
    "workday": FieldMap(
        ("$",), ("$.detail.jobReqId", "$.listing.externalPath"), ("$.detail.externalUrl",), ("$.listing.title", "$.detail.title"), url_form="{base}{path}", location=("$.detail.location", "$.listing.locationsText"),
        department=("$.detail.jobFamilyGroup", "$.detail.jobFamily", "$.detail.jobCategory", "$.detail.supervisoryOrganization", "$.detail.department"),
        compensation=("$.detail.payRangeText", "$.detail.compensation", "$.detail.salaryRange"), pay=_PAY_PARTS,
        posted_at=("$.detail.startDate", "$.detail.postedOnDate", "$.detail.postedOn", "$.listing.postedOn"), remote=("$.detail.remoteType",),
        description=("$.detail.jobDescription", "$.listing.title"), facts=(("Job requisition id", "$.detail.jobReqId"), ("Time type", "$.detail.timeType"), ("Remote type", "$.detail.remoteType")),
    ),
    "recruitee": FieldMap(
        ("$.offers",), ("$.id",), ("$.careers_url", "$.careers_apply_url"), location_parts=("$.city", "$.state_name", "$.country"), department=("$.department",),
        posted_at=("$.published_at", "$.created_at"), remote=("$.remote",), description=("$.description",), description_parts=("$.requirements",),
    ),
    "breezy": FieldMap(
        ("$.positions", "$.jobs", "$"), ("$.id", "$._id", "$.friendly_id"), ("$.url",), ("$.name", "$.title"), ("$.location.name",), ("$.location.city", "$.location.state.name", "$.location.country.name"),
        department=("$.department", "$.team"), posted_at=("$.published_date", "$.creation_date", "$.updated_date"), remote=("$.location.is_remote",), description=("$.description", "$.content"),
        facts=(("Department", "$.department"), ("Employment type", "$.type.name", "$.type.label", "$.type")), url_form="{base}/p/{id}",
    ),
    "jazzhr": FieldMap(
        ("$.jobs", "$"), ("$.id", "$.board_code"), title=("$.title", "$.job_title"), location_parts=("$.city", "$.state", "$.country"), department=("$.department",),
        posted_at=("$.original_open_date", "$.open_date", "$.created_date"), description=("$.description", "$.job_description"), facts=(("Department", "$.department"), ("Employment type", "$.type")),
        url_form="{base}/apply/{id}", status=("$.status", "$.job_status"), statuses=("open", "opened", "active"),
    ),
    "rippling": FieldMap(
        ("$.jobs", "$.results", "$.data", "$"), ("$.uuid", "$.id"), ("$.url",), ("$.name", "$.title"), ("$.workLocation.label", "$.workLocation.name", "$.workLocation"), department=("$.department.label", "$.department.name", "$.department"),
        compensation=("$.compensationDescription", "$.salaryDescription", "$.compensation"), posted_at=("$.publishedAt", "$.postedAt", "$.createdAt", "$.updatedAt"), remote=("$.workLocationType",),
        description=("$.descriptionHtml", "$.description"), facts=(("Department", "$.department.label"), ("Employment type", "$.employmentType"), ("Work location type", "$.workLocationType")), coded_facts=("Employment type", "Work location type"), url_form="{base}/jobs/{id}",
    ),
    "usajobs": FieldMap(
        ("$.SearchResult.SearchResultItems",), ("$.MatchedObjectId", "$.MatchedObjectDescriptor.PositionID"), ("$.MatchedObjectDescriptor.PositionURI",), ("$.MatchedObjectDescriptor.PositionTitle",),
        ("$.MatchedObjectDescriptor.PositionLocationDisplay",), department=("$.MatchedObjectDescriptor.DepartmentName",), posted_at=("$.MatchedObjectDescriptor.PublicationStartDate",),
        employer=("$.MatchedObjectDescriptor.OrganizationName", "$.MatchedObjectDescriptor.DepartmentName"), description=("$.MatchedObjectDescriptor.QualificationSummary",),
        pay=tuple(f"$.MatchedObjectDescriptor.PositionRemuneration[0].{x}" for x in ("MinimumRange", "MaximumRange", "RateIntervalCode")),
        description_parts=tuple(
            f"$.MatchedObjectDescriptor.UserArea.Details.{x}"
            for x in ("JobSummary", "MajorDuties", "Education", "Requirements", "Evaluations", "Benefits", "OtherInformation", "AgencyMarketingStatement")
        ),
        facts=tuple(
            (label, f"$.MatchedObjectDescriptor.UserArea.Details.{x}")
            for label, x in (
                ("Security clearance", "SecurityClearanceRequired"), ("Telework eligible", "TeleworkEligible"), ("Travel", "TravelCode"), ("Promotion potential", "PromotionPotential"),
                ("Who may apply", "WhoMayApply"), ("Drug test required", "DrugTestRequired"),
            )
        ) + tuple((label, f"$.MatchedObjectDescriptor.{x}[*].Name") for label, x in (("Job category", "JobCategory"), ("Position schedule", "PositionSchedule"), ("Offering type", "PositionOfferingType"))),
        facts_apart=False,
    ),
    "phenom": FieldMap(
        ("$.refineSearch.data.jobs", "$.data.jobs", "$.jobs"), ("$.jobId",), ("$.applyUrl",), location=("$.cityStateCountry", "$.location"), location_parts=("$.city", "$.state", "$.country"), department=("$.category",),
        posted_at=("$.postedDate", "$.dateCreated"), description=("$.descriptionTeaser", "$.description"), url_form="{base}/job/{id}",
    ),
    "oraclecloud": FieldMap(
        ("$.items[0].requisitionList",), ("$.Id", "$.RequisitionNumber"), ("$.ExternalURL",), ("$.Title",), ("$.PrimaryLocation",), ("$.workLocation[0].TownOrCity", "$.workLocation[0].Region", "$.workLocation[0].Country"),
        posted_at=("$.PostedDate",), remote=("$.WorkplaceTypeCode",), description=("$.ShortDescriptionStr",), url_form="{base}/job/{id}",
    ),
    "jobvite": FieldMap(("$.jobs",), ("$.id", "$.applyURL"), ("$.applyURL",), location=("$.location", "$.country"), department=("$.category",), posted_at=("$.date",), https_only=True),
    "governmentjobs": FieldMap(
        ("$.jobs", "$.results", "$.items", "$.data", "$"), ("$.id", "$.jobId", "$.jobNumber"), ("$.url", "$.link", "$.jobUrl"), ("$.title", "$.jobTitle", "$.positionTitle"), ("$.location", "$.jobLocation"),
        department=("$.department", "$.departmentName"), compensation=("$.salary", "$.salaryDisplay", "$.salary.display"), pay=("$.salaryMin", "$.salaryMax", "$.salaryType"),
        posted_at=("$.postedDate", "$.openingDate", "$.datePosted"), employer=("$.agency", "$.agencyName"), description=("$.description", "$.jobDescription"), description_parts=("$.minimumQualifications", "$.supplementalInformation"), url_form="{base}/{id}",
    ),
}


def path(row: Column, p: str) -> Column:
    """Text at a JSON path; null for nothing or an empty text."""
    found = F.get_json_object(row, p)
    return F.when((F.trim(found) != "") & (found != "null") & ~found.isin("[]", "{}"), found)


def first_of(row: Column, paths: tuple[str, ...]) -> Column:
    return F.coalesce(*(path(row, p) for p in paths), F.lit(None).cast("string"))


def joined(row: Column, p: str) -> Column:
    """The text at a path; of a list all its texts."""
    found = path(row, p)
    return F.coalesce(F.array_join(F.from_json(found, "array<string>"), " "), found)


def rows_of(payload: Column, paths: tuple[str, ...]) -> Column:
    """The first list found at the paths, one with rows before an empty one, as JSON texts; broken payloads give an empty one."""
    lists = [F.from_json(payload if p == "$" else F.get_json_object(payload, p), "array<string>") for p in paths]
    return F.coalesce(*(F.when(F.size(x) > 0, x) for x in lists), F.array().cast("array<string>"))


def _listed(x: Column) -> Column:
    return F.coalesce(F.from_json(x, "array<string>"), F.array().cast("array<string>"))


def _walked(step: str):
    """What a key, or a number in a list, leads to."""

    def walk(x: Column) -> Column:
        keyed = F.when(F.ltrim(x).startswith("{"), F.get_json_object(x, f"$['{step}']"))
        if not re.fullmatch(r"-?\d+", step):
            return keyed
        at = int(step)
        return F.coalesce(F.when(F.ltrim(x).startswith("["), F.try_element_at(F.from_json(x, "array<string>"), F.lit(at + 1 if at >= 0 else at))), keyed)

    return walk


def resolve(payload: Column, dotted: str) -> Column:
    """The texts at a dot path such as `data.jobs.0.title`, `rows.-1.id` or `sections[].body`, as an array; none for what isn't there.

    A number counts in a list, a negative one from its end; `[]` goes on with every element and flattens what it finds by one
    level; an empty path is the payload itself.  JSON that doesn't parse gives nothing.
    """
    steps = [s.strip() for s in re.sub(r"\[\s*\]", ".[].", dotted or "").split(".") if s.strip()]
    held = F.array_compact(F.array(payload))
    for step in steps:
        held = F.flatten(F.transform(held, _listed)) if step == "[]" else F.transform(held, _walked(step))
        held = F.filter(held, lambda x: x.isNotNull() & ~x.isin("", "null", "[]", "{}"))
    # A list at the end of a mapped path is flattened too.
    if "[]" in steps:
        held = F.flatten(F.transform(held, lambda x: F.coalesce(F.when(x.startswith("["), F.from_json(x, "array<string>")), F.array(x))))
    return held


def with_detail(listed: DataFrame, details: DataFrame, rows: tuple[str, ...], key: tuple[str, ...], inside: tuple[str, ...] = ("$",), payload: str = "payload", budget: int | None = None) -> DataFrame:
    """One payload a row, a list of one {listing, detail}, of list payloads and detail payloads (key, payload).

    A board is told by the columns that both tables have besides: source, base or what else.  Keys count within a board, so boards that use one path
    don't meet; details that hold nothing but key and payload serve every board.  Of a board's listings with one key the first stays, by the order of
    `seq` (page, term) and place where listed has it.  The detail record lies at the first of `inside` that is there; of details repeated for
    a listing the least text counts; a listing without one has no detail.  With a budget the first so many listings of each board take theirs.
    """
    order = ["seq"] if "seq" in listed.columns else []
    names = [c for c in listed.columns if c not in (payload, "seq")]
    one = listed.select(*names, *order, F.posexplode(rows_of(F.col(payload), rows)).alias("_at", "_listing")).withColumn("_key", first_of(F.col("_listing"), key))
    one = one.where("_key is not null").withColumn("_order", F.struct(*order, "_at"))
    one = first_of_each(one, [*names, "_key"], "_order")
    board = [c for c in details.columns if c in names]
    record = F.coalesce(*(F.when(F.get_json_object(payload, p).startswith("{"), F.get_json_object(payload, p)) for p in inside))
    found = details.select(*(F.col(c).alias(f"_of_{c}") for c in board), F.col("key").alias("_for"), record.alias("_detail"))
    found = found.groupBy(*(f"_of_{c}" for c in board), "_for").agg(F.min("_detail").alias("_detail"))
    same = F.col("_key") == F.col("_for")
    for c in board:
        same = same & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    out = one.join(found, same, "left")
    if budget is not None:
        # Ties of order, listings of one place on several pages without seq, go by key.
        place = F.row_number().over(Window.partitionBy(*names).orderBy("_order", "_key"))
        out = out.withColumn("_detail", F.when(place <= budget, F.col("_detail")))
    text = F.concat(F.lit('[{"listing":'), F.col("_listing"), F.lit(',"detail":'), F.coalesce(F.col("_detail"), F.lit("null")), F.lit("}]"))
    return out.select(*names, text.alias(payload))


def parse(payloads: DataFrame, kind: FieldMap | str, payload: str = "payload", source: str = "source", employer: str = "employer", base: str | None = None) -> DataFrame:
    """One posting a row of each payload: source, source_id, url, title, employer, location, department, compensation, posted_at, remote, description.

    Rows without url or title are left out, as the board would drop them.  Nothing in a payload can make it fail.  base is a column with the
    beginning of the URLs that a kind makes up itself.
    """
    spec = KINDS[kind] if isinstance(kind, str) else kind
    start = F.lit("") if base is None else F.regexp_replace(F.coalesce(F.col(base), F.lit("")), "/+$", "")
    rows = payloads.select(source, employer, start.alias("_base"), F.explode(rows_of(F.col(payload), spec.rows)).alias("_row"))
    r = F.col("_row")
    if spec.statuses:
        status = first_of(r, spec.status)
        rows = rows.where(status.isNull() | F.lower(F.trim(status)).isin(*spec.statuses))
    ident = first_of(r, spec.source_id)
    url = first_of(r, spec.url)
    if spec.https_only:
        url = F.when(url.rlike("^https://[^/]"), url)
    if spec.url_form and base is not None:
        made = F.replace(F.replace(F.lit(spec.url_form), F.lit("{id}"), F.url_encode(ident)), F.lit("{path}"), F.coalesce(path(r, "$.listing.externalPath"), F.lit("")))
        url = F.coalesce(url, F.when(ident.isNotNull(), F.replace(made, F.lit("{base}"), F.col("_base"))))
    parts = F.nullif(F.concat_ws(", ", *(path(r, p) for p in spec.location_parts)), F.lit(""))
    place = F.coalesce(first_of(r, spec.location), parts)
    # A wildcard path gives a JSON list of texts, others one text.
    text = html_to_text(F.concat_ws(" ", first_of(r, spec.description), *(joined(r, p) for p in spec.description_parts)))
    facts = F.concat_ws(" ", *(_fact(r, label, paths, label in spec.coded_facts) for label, *paths in spec.facts))
    stated = first_of(r, spec.remote)
    pay = first_of(r, spec.compensation)
    if spec.pay:
        low, high, interval = (path(r, p) for p in spec.pay)
        pay = F.coalesce(pay, F.trim(F.concat_ws(" ", F.when(low.isNotNull() & high.isNotNull(), F.concat(low, F.lit(" - "), high)).otherwise(F.coalesce(low, high)), interval)))
    times = [tolerant_time(path(r, p)) for p in spec.posted_at]
    out = rows.select(
        source, ident.alias("source_id"), url.alias("url"), first_of(r, spec.title).alias("title"), F.coalesce(first_of(r, spec.employer), F.col(employer)).alias(employer),
        F.coalesce(place, F.lit("")).alias("location"), first_of(r, spec.department).alias("department"), F.nullif(pay, F.lit("")).alias("compensation"),
        F.coalesce(*times, F.lit(None).cast("timestamp")).alias("posted_at"), stated.alias("_stated"), F.concat_ws("\n\n" if spec.facts_apart else " ", F.nullif(text, F.lit("")), F.nullif(facts, F.lit(""))).alias("description"),
    )
    is_remote = (F.lower("_stated") == "true") | looks_remote("location", "title", "_stated")
    return out.withColumn("remote", F.coalesce(is_remote, F.lit(False))).drop("_stated").where("url is not null and title is not null")


def _fact(row: Column, label: str, paths: list[str], coded: bool) -> Column:
    """A labelled sentence of the first path that holds something; null if none does."""
    value = F.coalesce(*(joined(row, p) for p in paths))
    return F.concat(F.lit(f"{label}: "), humane(value) if coded else value, F.lit("."))


def humane(c: Column) -> Column:
    """FULL_TIME as Full Time; other texts stay."""
    return F.when(c.rlike("^[^a-z]*[A-Z][^a-z]*$") | F.contains(c, F.lit("_")), F.initcap(F.replace(c, F.lit("_"), F.lit(" ")))).otherwise(c)


def with_details(listed: DataFrame, details: DataFrame, paths: tuple[str, ...], key: str = "source_id", payload: str = "payload") -> DataFrame:
    """Listed postings with the description of their detail payload where there is one (key, payload; of several texts the least); else their own."""
    text = F.concat_ws(" ", *(path(F.col(payload), p) for p in paths))
    texts = details.groupBy(key).agg(F.min(F.when(F.trim(text) != "", text)).alias("_text"))
    out = listed.join(texts, key, "left")
    return out.withColumn("description", F.when(F.trim("_text") != "", html_to_text("_text")).otherwise(F.col("description"))).select(*listed.columns)


def side_loaded(rows: DataFrame, included: DataFrame, type_col: str, id_col: str, value: str, name: str) -> DataFrame:
    """rows with `name`: the included record's value of the same (type, id), of repeats the least."""
    index = included.groupBy("type", "id").agg(F.min(value).alias(name))
    return rows.join(index.withColumnsRenamed({"type": type_col, "id": id_col}), [type_col, id_col], "left")


def personio(payloads: DataFrame, payload: str = "payload", source: str = "source", employer: str = "employer", base: str = "base") -> DataFrame:
    """Postings of Personio's XML: every position, its description the headed sections in their order, with facts behind them."""
    schema = (
        "id string, name string, office string, department string, employmentType string, schedule string, seniority string, createdAt string, "
        "jobDescriptions struct<jobDescription:array<struct<name:string,value:string>>>"
    )
    positions = F.regexp_extract_all(F.coalesce(F.col(payload), F.lit("")), F.lit(r"(?s)<position\b[^>]*>.*?</position\s*>"), F.lit(0))
    rows = payloads.select(source, employer, F.regexp_replace(base, "/+$", "").alias("_base"), F.explode(positions).alias("_xml")).withColumn("p", F.from_xml("_xml", schema))
    p = lambda name: F.trim(F.coalesce(F.col(f"p.{name}"), F.lit("")))
    said = F.filter(F.col("p.jobDescriptions.jobDescription"), lambda s: F.trim(F.coalesce(s["value"], F.lit(""))) != "")
    text = F.array_join(F.transform(said, lambda s: F.concat_ws("\n", F.nullif(F.trim(s["name"]), F.lit("")), s["value"])), "\n\n")
    labels = (("Department", p("department")), ("Employment type", humane(p("employmentType"))), ("Schedule", humane(p("schedule"))), ("Seniority", humane(p("seniority"))))
    facts = F.concat_ws(" ", *(F.when(v != "", F.concat(F.lit(f"{label}: "), v, F.lit("."))) for label, v in labels))
    return rows.where((p("id") != "") & (p("name") != "")).select(
        source, p("id").alias("source_id"), F.concat(F.col("_base"), F.lit("/job/"), F.url_encode(p("id"))).alias("url"), p("name").alias("title"), employer, p("office").alias("location"),
        F.nullif(p("department"), F.lit("")).alias("department"), F.lit(None).cast("string").alias("compensation"), tolerant_time(p("createdAt")).alias("posted_at"),
        F.concat_ws("\n\n", F.nullif(html_to_text(text), F.lit("")), F.nullif(facts, F.lit(""))).alias("description"), looks_remote(p("office"), p("name"), p("schedule")).alias("remote"),
    )
