"""Landed filings to rows (SRC-1..4): company-facts JSON, XBRL instances, Form 4 XML, 13F submissions.

Every reader is a parse of a ``(…, content)`` DataFrame, so a corpus is spread by file and nothing of it
passes through the driver.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from finstrata.session import as_table

_ENTRY = "struct<start:string,end:string,val:double,accn:string,fy:int,fp:string,form:string,filed:string,frame:string>"
FACTS_SCHEMA = (f"cik bigint, entityName string, ticker string, "
                f"facts map<string,map<string,struct<label:string,units:map<string,array<{_ENTRY}>>>>>")


def explode_company_facts(docs: DataFrame) -> DataFrame:
    """Nested company-facts documents to long facts."""
    t = docs.select("ticker", F.explode("facts").alias("taxonomy", "tags"))
    g = t.select("ticker", "taxonomy", F.explode("tags").alias("tag", "body"))
    n = g.select("ticker", "taxonomy", "tag", F.col("body.label").alias("label"), F.explode("body.units").alias("unit", "entries"))
    e = n.select("ticker", "taxonomy", "tag", "label", "unit", F.explode("entries").alias("e"))
    day = lambda c: F.to_date(F.substring(c, 1, 10))
    return e.select("ticker", "taxonomy", "tag", "label", "unit", day("e.start").alias("start"), day("e.end").alias("end"), "e.val", "e.accn",
                    "e.fy", "e.fp", "e.form", day("e.filed").alias("filed"), "e.frame")


def read_company_facts(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Company-facts JSON files (one document a file, or one a line) to long facts."""
    return explode_company_facts(spark.read.schema(FACTS_SCHEMA).option("multiLine", multi_line).json(path))


# ---- XBRL instances

_RAW = ("accn string, filer string, taxonomy string, concept string, start string, end string, cik string, dimensional boolean, "
        "unit_name string, text string, decimals string")
#: Rows handed over at once.
_ROWS = 20_000
# Namespaces whose concepts are standard taxonomies.
_TAXONOMY = re.compile(r"^https?://(?:fasb\.org|xbrl\.sec\.gov|xbrl\.ifrs\.org/taxonomy)/(?:\d{4}-\d{2}-\d{2}/)?([a-z-]+)")
_X = "{http://www.xbrl.org/2003/instance}"
_CONTEXT, _UNIT, _ENTITY, _SEGMENT, _SCENARIO, _PERIOD, _IDENTIFIER, _MEASURE = (
    _X + n for n in ("context", "unit", "entity", "segment", "scenario", "period", "identifier", "measure"))
#: What a filing says of its fiscal year and period, under whatever context.
_FOCUS = ("DocumentFiscalYearFocus", "DocumentFiscalPeriodFocus")


@lru_cache(1 << 16)
def _standard(tag: str) -> tuple[str, str] | None:
    """Taxonomy and concept of an element's tag, if it is one of a standard taxonomy."""
    if tag[0] != "{":
        return None
    uri, concept = tag[1:].split("}", 1)
    found = _TAXONOMY.match(uri)
    return (found.group(1), concept) if found else None


def _period_date(periods: list[ET.Element], name: str) -> str | None:
    for p in periods:
        found = p.find(_X + name)
        if found is not None:
            return (found.text or "").strip()[:10] or None
    return None


def _instance_rows(accn: str, filer: str | None, content: bytes) -> Iterator[tuple]:
    """The facts of one instance, each with every context and unit of its own that it names; of the focus also without.

    Others need a context without dimensions that ends, and a unit.
    """
    local = lambda t: (t or "").strip().rsplit(":", 1)[-1]
    contexts: dict[str | None, list[tuple]] = {}
    units: dict[str | None, list[str]] = {}
    facts = []
    for el in ET.fromstring(content).iter():
        if el.tag == _CONTEXT:
            who, periods = el.find(_ENTITY), el.findall(_PERIOD)
            dim = who is None or who.find(_SEGMENT) is not None or el.find(_SCENARIO) is not None
            contexts.setdefault(el.get("id"), []).append((_period_date(periods, "startDate"), _period_date(periods, "instant") or _period_date(periods, "endDate"),
                                                          ((who.findtext(_IDENTIFIER) if who is not None else None) or "").strip(), dim))
        elif el.tag == _UNIT:
            over = el.find(_X + "divide")
            sides = [over.find(_X + "unitNumerator"), over.find(_X + "unitDenominator")] if over is not None else [el]
            units.setdefault(el.get("id"), []).append("/".join("*".join(local(m.text) for m in s.iter(_MEASURE)) for s in sides if s is not None))
        elif el.get("contextRef") is not None:
            found = _standard(el.tag)
            if found and (el.get("unitRef") is not None or found[0] == "dei"):
                facts.append((*found, el.get("contextRef"), el.get("unitRef"), el.text, el.get("decimals")))
    units.pop(None, None)
    for taxonomy, concept, context, unit, text, decimals in facts:
        focus = taxonomy == "dei" and concept in _FOCUS
        for where in contexts.get(context, [(None, None, None, None)]):
            if focus or (where[3] is False and where[1]):
                for name in units.get(unit, [None]):
                    if focus or name:
                        yield (accn, filer, taxonomy, concept, *where, name, text, decimals)


def _parse_instances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    fields = [c.split() for c in _RAW.split(", ")]
    schema = pa.schema([(n, pa.bool_() if t == "boolean" else pa.string()) for n, t in fields])

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    rows: list[tuple] = []
    for batch in batches:
        for accn, filer, content in zip(*(batch.column(n) for n in ("accn", "filer", "content")), strict=True):
            content = content.as_py()
            rows.extend(_instance_rows(accn.as_py(), filer.as_py(), content if isinstance(content, bytes) else content.encode()))
            if len(rows) >= _ROWS:
                yield packed(rows)
                rows = []
    if rows:
        yield packed(rows)


def frame_of(start: Column, end: Column) -> Column:
    """The calendar frame of a period by its end and length."""
    span = F.datediff(end, F.coalesce(start, end))
    q = F.date_sub(end, 45)
    quarter = F.concat(F.lit("CY"), F.year(q), F.lit("Q"), F.quarter(q))
    return (F.when(span.between(320, 410), F.concat(F.lit("CY"), F.year(F.date_sub(end, 180))))
            .when(span.between(0, 45), F.concat(quarter, F.lit("I"))).when(span.between(46, 136), quarter))


def parse_xbrl_instances(docs: DataFrame) -> DataFrame:
    """XBRL instances (accn, ticker, cik, form, filed, content) to long facts.

    Standard taxonomies, the filer's own contexts without dimensions, a unit and a value; of repeats the most precise.
    """
    filer = F.col("cik").cast("bigint")
    about = docs.select("accn", "ticker", "form", "filed")
    number = F.col("cik").try_cast("bigint")
    plain = ~F.col("dimensional") & F.col("end").isNotNull() & (number.isNull() | (number == F.col("filer").cast("bigint")))
    facts = docs.where(F.col("accn").isNotNull()).select("accn", filer.cast("string").alias("filer"), "content").mapInArrow(_parse_instances, _RAW)
    facts = as_table(facts.withColumn("__plain", F.when(plain, 1)), "xbrl-facts")
    focus = facts.where((F.col("taxonomy") == "dei") & F.col("concept").isin(*_FOCUS))
    order = F.struct(F.coalesce("__plain", F.lit(0)), F.trim("text"))
    focus = focus.groupBy("accn").agg(*[F.max_by(F.trim("text"), F.when((F.col("concept") == c) & (F.trim("text") != ""), order)).alias(n)
                                        for c, n in zip(_FOCUS, ("fy", "fp"), strict=True)])
    val = F.round(F.trim("text").try_cast("decimal(38,10)"), 6).cast("double")
    d = F.upper(F.trim("decimals"))
    precision = F.when(d.isNull() | (d == "INF"), 1e9).otherwise(F.coalesce(d.try_cast("double"), F.lit(-1e9)))
    j = (facts.where((F.col("__plain") == 1) & (F.col("unit_name") != ""))
         .withColumns({"val": val, "__p": precision, "start": F.to_date(F.nullif("start", "end")), "end": F.to_date("end")}).where(F.col("val").isNotNull()))
    kept = j.groupBy("accn", "taxonomy", "concept", "unit_name", "start", "end").agg(F.max_by("val", F.struct("__p", "val")).alias("val"))
    return (kept.join(about, "accn").join(focus, "accn", "left")
            .select("ticker", "taxonomy", F.col("concept").alias("tag"), F.col("unit_name").alias("unit"), "start", "end", "val", "accn",
                    F.col("fy").try_cast("int").alias("fy"), "fp", "form", "filed", frame_of(F.col("start"), F.col("end")).alias("frame")))


def read_xbrl_instances(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """Instance files joined with their *manifest* (file, accn, ticker, cik, form, filed)."""
    files = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    return parse_xbrl_instances(files.join(manifest, "file"))


# ---- Form 4

_V = "struct<value:string>"
_TX = (f"struct<securityTitle:{_V},transactionDate:{_V},conversionOrExercisePrice:{_V},transactionCoding:struct<transactionCode:string>,"
       f"transactionAmounts:struct<transactionShares:{_V},transactionPricePerShare:struct<value:string,footnoteId:array<struct<_id:string>>>,transactionAcquiredDisposedCode:{_V}>,"
       f"postTransactionAmounts:struct<sharesOwnedFollowingTransaction:{_V}>,ownershipNature:struct<directOrIndirectOwnership:{_V}>,"
       f"underlyingSecurity:struct<underlyingSecurityTitle:{_V},underlyingSecurityShares:{_V}>>")
_OWNER = ("struct<reportingOwnerId:struct<rptOwnerCik:string,rptOwnerName:string>,reportingOwnerRelationship:struct<isDirector:string,isOfficer:string,"
          "isTenPercentOwner:string,isOther:string,officerTitle:string>>")
FORM4_SCHEMA = (f"documentType string, periodOfReport string, dateOfOriginalSubmission string, issuer struct<issuerCik:string,issuerTradingSymbol:string>, aff10b5One string, "
                f"reportingOwner array<{_OWNER}>, nonDerivativeTable struct<nonDerivativeTransaction:array<{_TX}>>, derivativeTable struct<derivativeTransaction:array<{_TX}>>, "
                "footnotes struct<footnote:array<struct<_id:string,_VALUE:string>>>")


def _flag(c: Column) -> Column:
    t = F.lower(F.trim(c))
    return F.when(t.isin("1", "true", "y", "yes"), True).when(t.isin("0", "false", "n", "no"), False)


def _parsed_form4(docs: DataFrame) -> DataFrame:
    return docs.select("accession", "filed_date", F.from_xml(F.trim("content"), FORM4_SCHEMA).alias("d")).select("accession", "filed_date", "d.*")


def parse_form4(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Form 4 documents (accession, filed_date, content) to (filing x owner rows, trade rows)."""
    d = _parsed_form4(docs)
    day = lambda c: F.to_date(F.substring(F.trim(c), 1, 10))
    o = d.select("accession", "filed_date", F.trim("documentType").alias("form"), day("periodOfReport").alias("period_of_report"),
                 day("dateOfOriginalSubmission").alias("original_filed"), F.trim("issuer.issuerCik").alias("issuer_cik"),
                 F.trim("issuer.issuerTradingSymbol").alias("ticker"), _flag(F.col("aff10b5One")).alias("aff10b5one"), F.explode_outer("reportingOwner").alias("o"))
    rel = "o.reportingOwnerRelationship."
    no = F.lit(False)
    owners = o.select("accession", F.trim("o.reportingOwnerId.rptOwnerCik").alias("owner_cik"), "ticker", "issuer_cik", "form", "filed_date", "period_of_report",
                      "original_filed", F.trim("o.reportingOwnerId.rptOwnerName").alias("owner_name"), F.coalesce(_flag(F.col(rel + "isDirector")), no).alias("is_director"),
                      F.coalesce(_flag(F.col(rel + "isOfficer")), no).alias("is_officer"), F.trim(rel + "officerTitle").alias("officer_title"),
                      F.coalesce(_flag(F.col(rel + "isTenPercentOwner")), no).alias("is_ten_percent"), F.coalesce(_flag(F.col(rel + "isOther")), no).alias("is_other"), "aff10b5one")
    tag = lambda c, k: F.transform(F.coalesce(c, F.array().cast(f"array<{_TX}>")), lambda t: F.struct(F.lit(k).alias("kind"), t.alias("t")))
    both = F.concat(tag(F.col("nonDerivativeTable.nonDerivativeTransaction"), "nonderivative"), tag(F.col("derivativeTable.derivativeTransaction"), "derivative"))
    notes = F.map_from_entries(F.coalesce(F.transform("footnotes.footnote", lambda n: F.struct(n["_id"].alias("k"), F.regexp_replace(F.trim(n["_VALUE"]), r"\s+", " ").alias("v"))),
                                          F.array().cast("array<struct<k:string,v:string>>")))
    t = d.select("accession", F.trim("issuer.issuerTradingSymbol").alias("ticker"), notes.alias("notes"), F.posexplode(both).alias("seq", "x"))
    num = lambda c: F.regexp_replace(F.trim(c), ",", "").try_cast("double")
    p = "x.t."
    ids = F.array_distinct(F.transform(p + "transactionAmounts.transactionPricePerShare.footnoteId", lambda f: f["_id"]))
    text = F.when(F.size(ids) > 0, F.array_join(F.filter(F.transform(ids, lambda i: F.col("notes")[i]), lambda s: s.isNotNull()), " "))
    trades = t.select("accession", F.col("seq").cast("int").alias("seq"), "ticker", "x.kind", F.trim(p + "securityTitle.value").alias("security_title"),
                      day(p + "transactionDate.value").alias("date"), F.trim(p + "transactionCoding.transactionCode").alias("code"),
                      num(p + "transactionAmounts.transactionShares.value").alias("shares"), num(p + "transactionAmounts.transactionPricePerShare.value").alias("price"),
                      F.coalesce(ids, F.array().cast("array<string>")).alias("price_footnotes"), text.alias("price_footnote_text"),
                      F.trim(p + "transactionAmounts.transactionAcquiredDisposedCode.value").alias("acquired_disposed"),
                      num(p + "postTransactionAmounts.sharesOwnedFollowingTransaction.value").alias("owned_after"),
                      F.trim(p + "ownershipNature.directOrIndirectOwnership.value").alias("direct_indirect"),
                      F.when(F.col("x.kind") == "derivative", num(p + "conversionOrExercisePrice.value")).alias("exercise_price"),
                      F.when(F.col("x.kind") == "derivative", F.trim(p + "underlyingSecurity.underlyingSecurityTitle.value")).alias("underlying_title"),
                      F.when(F.col("x.kind") == "derivative", num(p + "underlyingSecurity.underlyingSecurityShares.value")).alias("underlying_shares"))
    return owners, trades


def _documents(spark: SparkSession, path: str) -> DataFrame:
    """Whole text files with their accession, the file name without its extension."""
    name = F.element_at(F.split("_metadata.file_path", "/"), -1)
    return spark.read.text(path, wholetext=True).select(F.regexp_replace(name, r"\.[^.]*$", "").alias("accession"), F.col("value").alias("content"))


def read_form4(spark: SparkSession, path: str, filed: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Form 4 files; *filed* (accession, filed_date) comes from the filing feed."""
    docs = _documents(spark, path)
    docs = docs.join(filed, "accession", "left") if filed is not None else docs.withColumn("filed_date", F.lit(None).cast("date"))
    return parse_form4(docs)


# ---- 13F

_COVER = ("headerData struct<submissionType:string,filerInfo:struct<periodOfReport:string,filer:struct<credentials:struct<cik:string>>>>, formData struct<coverPage:struct<reportCalendarOrQuarter:string,"
          "reportType:string,isAmendment:string,amendmentInfo:struct<amendmentType:string>>,summaryPage:struct<tableEntryTotal:string,tableValueTotal:string,isConfidentialOmitted:string>>")
_INFO = ("infoTable array<struct<nameOfIssuer:string,titleOfClass:string,cusip:string,value:string,shrsOrPrnAmt:struct<sshPrnamt:string,sshPrnamtType:string>,putCall:string,investmentDiscretion:string>>")


def parse_13f(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """13F submission texts (accession, content) to (cover rows, information-table rows, values as filed)."""
    body = lambda kind: F.regexp_replace(F.regexp_extract("content", rf"(?is)<TYPE>\s*{kind}[^<]*?(?:(?!</DOCUMENT>).)*?<XML>\s*(.*?)\s*</XML>", 1),
                                         r"<(/?)[A-Za-z0-9_]+:", "<$1")
    strip = lambda c: F.regexp_replace(c, r"<\?xml[^>]*\?>", "")
    filed = F.to_date(F.regexp_extract("content", r"FILED AS OF DATE:\s*(\d{8})", 1), "yyyyMMdd")
    d = docs.select("accession", filed.alias("filed"), F.from_xml(strip(body("13F")), _COVER).alias("c"), F.from_xml(strip(body("INFORMATION TABLE")), _INFO).alias("t"))
    num = lambda c: F.regexp_replace(F.trim(c), ",", "").try_cast("double")
    text = lambda c: F.nullif(F.regexp_replace(F.trim(c), r"\s+", " "), F.lit(""))
    cp, sm = "c.formData.coverPage.", "c.formData.summaryPage."
    period = F.coalesce(F.try_to_timestamp(F.col(cp + "reportCalendarOrQuarter"), F.lit("MM-dd-yyyy")), F.try_to_timestamp(F.col("c.headerData.filerInfo.periodOfReport"), F.lit("MM-dd-yyyy"))).cast("date")
    covers = d.select("accession", text("c.headerData.filerInfo.filer.credentials.cik").alias("filer"), text("c.headerData.submissionType").alias("form"), period.alias("period"), "filed",
                      F.coalesce(_flag(F.col(cp + "isAmendment")), F.lit(False)).alias("is_amendment"), text(cp + "amendmentInfo.amendmentType").alias("amendment_type"),
                      num(sm + "tableEntryTotal").cast("bigint").alias("entry_total"), num(sm + "tableValueTotal").alias("value_total"), _flag(F.col(sm + "isConfidentialOmitted")).alias("confidential_omitted"))
    r = d.select("accession", F.posexplode("t.infoTable").alias("row", "h"))
    rows = r.select("accession", F.col("row").cast("bigint").alias("row"), F.upper(text("h.cusip")).alias("cusip"), text("h.nameOfIssuer").alias("issuer"), text("h.titleOfClass").alias("title_of_class"),
                    num("h.value").alias("value"), num("h.shrsOrPrnAmt.sshPrnamt").alias("shares"), text("h.shrsOrPrnAmt.sshPrnamtType").alias("share_type"), text("h.putCall").alias("put_call"),
                    text("h.investmentDiscretion").alias("discretion"))
    return covers, rows


def read_13f(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return parse_13f(_documents(spark, path))
