"""SRC, SNK and INC: files and documents are written from the stand-in relations, then read back by the parsers."""

import uuid

from pyspark.sql import functions as F

from finstrata import sinks
from finstrata.operators import incremental as inc
from finstrata.plans import standin
from finstrata.plans.catalog._core import query
from finstrata.session import ensure_checkpoint_dir
from finstrata.sources import files, filings

R = standin.RELATIONS
_LANDED: dict = {}


def landed(u, name, write):
    """The folder *write* filled, once per application and data folder."""
    key = (u.spark.sparkContext.applicationId, u.dir, name)
    if key not in _LANDED:
        path = f"{ensure_checkpoint_dir(u.spark).rstrip('/')}/landed/{name}-{uuid.uuid4().hex}"
        write(path)
        _LANDED[key] = path
    return _LANDED[key]


# ---- SRC

def _facts_docs(u):
    """One company-facts document per company and report form (a company's balance facts of one form)."""
    e = F.struct(F.col("start").cast("string").alias("start"), F.col("end").cast("string").alias("end"), "val", "accn", F.year("end").alias("fy"), F.lit("FY").alias("fp"), "form",
                 F.col("filed").cast("string").alias("filed"), F.lit(None).cast("string").alias("frame"))
    g = u.f_balance.groupBy("ticker", "form", "tag", "unit").agg(F.collect_list(e).alias("entries"))
    t = g.groupBy("ticker", "form").agg(F.map_from_entries(F.collect_list(F.struct("tag", F.struct(F.col("tag").alias("label"), F.create_map("unit", "entries").alias("units"))))).alias("tags"))
    return t.select("ticker", F.col("ticker").alias("entityName"), F.create_map(F.lit("us-gaap"), "tags").alias("facts"))


@query("src1_company_facts", 'SELECT ticker, \'us-gaap\' AS taxonomy, tag, unit, "end", val, accn, form, filed FROM si_f_balance')
def src1(u):
    path = landed(u, "facts", lambda p: _facts_docs(u).write.json(p))
    return filings.read_company_facts(u.spark, path, multi_line=False).select("ticker", "taxonomy", "tag", "unit", "end", "val", "accn", "form", "filed")


def _instances(u):
    """One XBRL instance per filing: a context per year, a dimensional twin, and facts at two precisions."""
    f = u.f_balance
    ctx = F.concat(F.lit('<xbrli:context id="c'), F.year("end"), F.lit('"><xbrli:entity><xbrli:identifier scheme="cik">77</xbrli:identifier></xbrli:entity><xbrli:period><xbrli:instant>'), F.col("end").cast("string"),
                   F.lit('</xbrli:instant></xbrli:period></xbrli:context><xbrli:context id="d'), F.year("end"), F.lit('"><xbrli:entity><xbrli:identifier scheme="cik">77</xbrli:identifier><xbrli:segment/></xbrli:entity><xbrli:period><xbrli:instant>'),
                   F.col("end").cast("string"), F.lit("</xbrli:instant></xbrli:period></xbrli:context>"))
    fact = lambda c, d, v: F.concat(F.lit("<us-gaap:"), F.col("tag"), F.lit(f' contextRef="{c}'), F.year("end"), F.lit(f'" unitRef="u" decimals="{d}">'), v, F.lit("</us-gaap:"), F.col("tag"), F.lit(">"))
    v = F.col("val").cast("bigint").cast("string")
    body = F.concat(fact("c", "-3", F.lit("1")), fact("c", "0", v), fact("d", "INF", F.lit("2")))
    g = f.groupBy("ticker", "accn", "form", "filed").agg(F.array_join(F.array_sort(F.collect_set(ctx)), "").alias("ctx"), F.array_join(F.array_sort(F.collect_list(body)), "").alias("body"))
    head = '<xbrli:xbrl xmlns:xbrli="http://www.xbrl.org/2003/instance" xmlns:us-gaap="http://fasb.org/us-gaap/2025" xmlns:iso4217="http://www.xbrl.org/2003/iso4217">'
    unit = '<xbrli:unit id="u"><xbrli:measure>iso4217:USD</xbrli:measure></xbrli:unit>'
    return g.select("ticker", "accn", "form", "filed", F.lit("77").alias("cik"), F.concat(F.lit(head + unit), "ctx", "body", F.lit("</xbrli:xbrl>")).cast("binary").alias("content"))


@query("src2_xbrl_instances", 'SELECT ticker, tag, unit, "end", val, accn, form, filed, concat(\'CY\', year("end" - 45), \'Q\', quarter("end" - 45), \'I\') AS frame FROM si_f_balance')
def src2(u):
    return filings.parse_xbrl_instances(_instances(u)).select("ticker", "tag", "unit", "end", "val", "accn", "form", "filed", "frame")


def _form4_docs(u):
    tag = lambda n, v: F.concat(F.lit(f"<{n}>"), v, F.lit(f"</{n}>"))
    val = lambda n, v: tag(n, tag("value", v))
    tx = tag("nonDerivativeTransaction", F.concat(val("securityTitle", F.lit("Common Stock")), val("transactionDate", F.col("date").cast("string")), tag("transactionCoding", tag("transactionCode", F.col("code"))),
             tag("transactionAmounts", F.concat(val("transactionShares", F.col("shares").cast("string")), F.lit("<transactionPricePerShare><value>"), F.col("price").cast("string"), F.lit('</value><footnoteId id="F1"/></transactionPricePerShare>')))))
    t = u.form_trades.groupBy("accession").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", tx.alias("x")))), lambda s: s["x"]), "").alias("tx"))
    f = u.form_filings.join(t, "accession")
    owner = tag("reportingOwner", F.concat(tag("reportingOwnerId", F.concat(tag("rptOwnerCik", F.col("owner_cik").cast("string")), tag("rptOwnerName", F.concat(F.lit("Owner "), "owner_cik")))),
                                           tag("reportingOwnerRelationship", F.concat(tag("isDirector", F.col("is_director").cast("string")), F.coalesce(tag("officerTitle", F.col("officer_title")), F.lit(""))))))
    doc = tag("ownershipDocument", F.concat(tag("documentType", F.col("form")), tag("periodOfReport", F.col("period_of_report").cast("string")), tag("issuer", F.concat(tag("issuerCik", F.lit("1")), tag("issuerTradingSymbol", F.col("ticker")))),
              owner, tag("nonDerivativeTable", F.col("tx")), F.lit('<footnotes><footnote id="F1">weighted  average</footnote></footnotes>')))
    return f.select("accession", "filed_date", F.concat(F.lit('<?xml version="1.0"?>\n'), doc).alias("content"))


@query("src3_form4_filings", "SELECT accession, CAST(owner_cik AS VARCHAR) AS owner_cik, ticker, form, filed_date, period_of_report, is_director, officer_title FROM si_form_filings")
def src3(u):
    return filings.parse_form4(_form4_docs(u))[0].select("accession", "owner_cik", "ticker", "form", "filed_date", "period_of_report", "is_director", "officer_title")


@query("src3_form4_trades", "SELECT accession, CAST(seq - 1 AS INT) AS seq, ticker, 'nonderivative' AS kind, date, code, shares, price, 'weighted average' AS price_footnote_text FROM si_form_trades")
def src3t(u):
    return filings.parse_form4(_form4_docs(u))[1].select("accession", "seq", "ticker", "kind", "date", "code", "shares", "price", "price_footnote_text")


def _13f_docs(u):
    tag = lambda n, v: F.concat(F.lit(f"<{n}>"), v, F.lit(f"</{n}>"))
    row = tag("ns1:infoTable", F.concat(tag("ns1:nameOfIssuer", F.col("issuer")), tag("ns1:titleOfClass", F.lit("COM")), tag("ns1:cusip", F.lower("cusip")), tag("ns1:value", F.format_number("value", 0)),
              tag("ns1:shrsOrPrnAmt", F.concat(tag("ns1:sshPrnamt", F.col("shares").cast("bigint").cast("string")), tag("ns1:sshPrnamtType", F.col("share_type")))), F.coalesce(tag("ns1:putCall", F.col("put_call")), F.lit(""))))
    l = u.fund_lines.groupBy("accession").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", row.alias("x")))), lambda s: s["x"]), "").alias("rows"))
    f = u.fund_filings.join(l, "accession")
    cover = F.concat(F.lit("<XML>\n<?xml version=\"1.0\"?>\n"), tag("edgarSubmission", F.concat(tag("headerData", tag("submissionType", F.col("form"))), tag("formData", F.concat(
        tag("coverPage", F.concat(tag("reportCalendarOrQuarter", F.date_format("period", "MM-dd-yyyy")), F.coalesce(tag("amendmentInfo", tag("amendmentType", F.col("amendment_type"))), F.lit("")))),
        tag("summaryPage", F.concat(tag("tableEntryTotal", F.col("entry_total").cast("string")), tag("tableValueTotal", F.col("value_total").cast("bigint").cast("string")))))))), F.lit("\n</XML>"))
    table = F.concat(F.lit('<XML>\n<ns1:informationTable xmlns:ns1="http://www.sec.gov/edgar/document/thirteenf/informationtable">'), F.col("rows"), F.lit("</ns1:informationTable>\n</XML>"))
    doc = lambda t, x: F.concat(F.lit(f"<DOCUMENT>\n<TYPE>{t}\n<TEXT>\n"), x, F.lit("\n</TEXT>\n</DOCUMENT>\n"))
    return f.select("accession", F.concat(F.lit("FILED AS OF DATE:\t\t"), F.date_format("filed", "yyyyMMdd"), F.lit("\n"), doc("13F-HR", cover), doc("INFORMATION TABLE", table)).alias("content"))


@query("src4_13f_covers", "SELECT accession, form, period, filed, amendment_type, entry_total, value_total FROM si_fund_filings")
def src4(u):
    return filings.parse_13f(_13f_docs(u))[0].select("accession", "form", "period", "filed", "amendment_type", "entry_total", "value_total")


@query("src4_13f_rows", "SELECT accession, upper(cusip) AS cusip, issuer, value, shares, share_type, put_call, count(*) AS n FROM si_fund_lines GROUP BY ALL")
def src4r(u):
    return filings.parse_13f(_13f_docs(u))[1].groupBy("accession", "cusip", "issuer", "value", "shares", "share_type", "put_call").agg(F.count("*").alias("n"))


@query("src5_fred_csv", "SELECT 'fred:gdp' AS series, date, value FROM si_series WHERE series = 'ust:10y' AND value <> 5", r="value")
def src5(u):
    d = u.series.where(F.col("series") == "ust:10y").select(F.col("date").alias("observation_date"), F.when(F.col("value") == 5, ".").otherwise(F.col("value").cast("string")).alias("GDP"))
    path = landed(u, "fred", lambda p: d.write.option("header", True).csv(p))
    return files.read_fred_csv(u.spark, path, "fred:gdp")


@query("src6_treasury_csv", "SELECT series, date, value FROM si_series WHERE series LIKE 'ust:%'", r="value")
def src6(u):
    s = u.series.where(F.col("series").startswith("ust:")).groupBy("date").pivot("series", ["ust:3m", "ust:2y", "ust:10y"]).agg(F.max("value"))
    d = s.select(F.date_format("date", "MM/dd/yyyy").alias("Date"), F.col("`ust:3m`").alias("3 Mo"), F.col("`ust:2y`").alias("2 Yr"), F.col("`ust:10y`").alias("10 Yr"), F.lit("N/A").alias("20 Yr"))
    path = landed(u, "treasury", lambda p: d.write.option("header", True).csv(p))
    return files.read_treasury_csv(u.spark, path)


@query("src7_decimal_month", "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber <= 12 THEN make_date(1871 + l_orderkey % 150, l_linenumber, 1) END AS month, count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber")
def src7(u):
    x = (1871 + F.col("l_orderkey") % 150) + F.col("l_linenumber") / 100.0
    g = u.table("lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"))
    return g.select("l_orderkey", "l_linenumber", files.decimal_month(x.cast("double")).alias("month"), "n")


@query("src8_tickers", "SELECT upper(replace(trim(p_brand), '#', '-')) AS ticker, min(p_partkey) AS position FROM part GROUP BY 1")
def src8(u):
    t = u.table("part").select(F.concat(F.lit(" "), F.lower(F.replace("p_brand", F.lit("#"), F.lit("."))), F.lit(" ")).alias("text"), F.col("p_partkey").alias("position"))
    return files.unique_tickers(t)


@query("src9_read_table", "SELECT ticker, date, ratio FROM si_splits")
def src9(u):
    path = landed(u, "tables", lambda p: u.splits.write.parquet(p + "/split_events"))
    return files.read_table(u.spark, path, "split_events").select("ticker", "date", "ratio")


@query("src10_anti_existing", "SELECT ticker FROM si_company WHERE company_no % 3 <> 0 AND company_no % 5 <> 0")
def src10(u):
    stored = u.company.where(F.col("company_no") % 3 == 0).select("ticker", F.lit(None).cast("string").alias("cik")).unionByName(
        u.company.where(F.col("company_no") % 5 == 0).select(F.concat(F.lit("OLD"), "ticker").alias("ticker"), "cik"))
    return files.anti_existing(u.company.select("ticker", "cik"), stored).select("ticker")


@query("src11_market_data", "SELECT ticker, collected_at, current_price, beta / 100 AS dividend_yield FROM si_snapshots", r="dividend_yield")
def src11(u):
    v = u.snapshots.select("ticker", "collected_at", F.col("current_price").alias("currentPrice"), F.col("beta").alias("dividendYield"))
    return files.market_data(v, {"currentPrice": "current_price", "dividendYield": "dividend_yield"})


@query("src11_statement_long", " UNION ALL ".join(f"SELECT ticker, make_date(CAST(fiscal_year AS BIGINT), 12, 31) AS period_end, '{c}' AS line, CAST({c} AS DOUBLE) AS value FROM si_annual_cal WHERE {c} IS NOT NULL" for c in ("capex", "revenue", "net_income")))
def src11s(u):
    long = u.annual_cal.select("ticker", "fiscal_year", *[F.col(c).cast("double").alias(c) for c in ("capex", "revenue", "net_income")]).unpivot(["ticker", "fiscal_year"], ["capex", "revenue", "net_income"], "line", "v")
    years = sorted(r[0] for r in u.annual_cal.select("fiscal_year").distinct().collect())
    w = long.groupBy("ticker", "line").pivot("fiscal_year", years).agg(F.max("v"))
    return files.statement_long(w.select("ticker", "line", *[F.col(str(y)).alias(f"{y}-12-31") for y in years]), [f"{y}-12-31" for y in years])


@query("src11_vendor_events", "SELECT ticker, date, amount FROM si_dividends")
def src11e(u):
    d = u.dividends.groupBy("ticker", F.year("date").alias("y")).agg(F.collect_list(F.struct(F.concat(F.col("date").cast("string"), F.lit("T00:00:00")).alias("date"), "amount")).alias("dividends"))
    path = landed(u, "vendor", lambda p: d.withColumns({"bars": F.slice("dividends", 1, 0), "splits": F.slice("dividends", 1, 0)}).write.json(p))
    schema = ", ".join(f"{n} array<struct<date:string,amount:double>>" for n in ("bars", "dividends", "splits"))
    return files.vendor_events(u.spark.read.schema(f"ticker string, {schema}").json(path))["dividends"].select("ticker", "date", "amount")


@query("src12_monthly_index", "SELECT CASE series WHEN 'shiller:real_price' THEN 'shiller:price' WHEN 'shiller:real_earnings' THEN 'shiller:earnings' ELSE series END AS series, date, value FROM si_series WHERE series LIKE 'shiller:%'", r="value")
def src12(u):
    s = u.series.where(F.col("series").startswith("shiller:")).groupBy("date").pivot("series", ["shiller:real_price", "shiller:real_earnings", "shiller:cape"]).agg(F.max("value"))
    rows = s.select(F.concat(F.year("date"), F.lit("."), F.date_format("date", "MM")).alias("a"), F.col("`shiller:real_price`").cast("string").alias("b"), F.lit("NA").alias("c"),
                    F.col("`shiller:real_earnings`").cast("string").alias("d"), F.lit("").alias("e"), F.col("`shiller:cape`").cast("string").alias("f"))
    head = u.series.limit(1).select(*[F.lit(x).alias(n) for n, x in zip("abcdef", ("Date", "P", "D", "E", "CPI", "CAPE"))])
    title = u.series.limit(1).select(F.lit("Monthly index, its earnings and prices").alias("a"), *[F.lit(None).cast("string").alias(n) for n in "bcdef"])
    path = landed(u, "index", lambda p: title.unionByName(head).unionByName(rows).select(F.concat_ws(",", *[F.when(F.col("b").isNull() & F.col("c").isNull(), F.lit(None)).otherwise(F.coalesce(c, F.lit(""))) if c != "a" else F.concat(F.lit('"'), "a", F.lit('"')) for c in "abcdef"]).alias("value")).write.text(p))
    return files.read_monthly_index(u.spark, path)


# ---- SNK: the stored rows are the years to 1999, the batch those from 1998 with some values missing.

_OLD = "SELECT ticker, fiscal_year, capex, goodwill FROM si_annual_cal WHERE fiscal_year <= 1999"
_NEW = "SELECT ticker, fiscal_year, CASE WHEN revenue % 3 <> 0 THEN revenue END AS capex, CASE WHEN revenue % 2 = 0 THEN revenue END AS goodwill FROM si_annual_cal WHERE fiscal_year >= 1998"


def _old(u):
    return u.annual_cal.where(F.col("fiscal_year") <= 1999).select("ticker", "fiscal_year", "capex", "goodwill")


def _new(u):
    r = F.col("revenue")
    return u.annual_cal.where(F.col("fiscal_year") >= 1998).select("ticker", "fiscal_year", F.when(r % 3 != 0, r).alias("capex"), F.when(r % 2 == 0, r).alias("goodwill"))


@query("snk1_upsert_overwrite", f"SELECT * FROM ({_OLD}) o WHERE NOT EXISTS (SELECT 1 FROM ({_NEW}) n WHERE n.ticker = o.ticker AND n.fiscal_year = o.fiscal_year) UNION ALL {_NEW}")
def snk1(u):
    return sinks.merge_upsert(_old(u), _new(u), ["ticker", "fiscal_year"])


def _full(a, b):
    return f"SELECT coalesce(o.ticker, n.ticker) AS ticker, coalesce(o.fiscal_year, n.fiscal_year) AS fiscal_year, coalesce({a}.capex, {b}.capex) AS capex, coalesce({a}.goodwill, {b}.goodwill) AS goodwill FROM ({_OLD}) o FULL JOIN ({_NEW}) n ON n.ticker = o.ticker AND n.fiscal_year = o.fiscal_year"


@query("snk2_upsert_keep_existing", _full("n", "o"))
def snk2(u):
    return sinks.merge_upsert(_old(u), _new(u), ["ticker", "fiscal_year"], "keep_existing")


@query("snk3_upsert_fill_only", _full("o", "n"))
def snk3(u):
    return sinks.merge_upsert(_old(u), _new(u), ["ticker", "fiscal_year"], "fill_only")


_NEWT = "SELECT * FROM si_splits WHERE ratio = 2"


@query("snk4_replace_by_key", f"SELECT ticker, date, ratio FROM si_splits WHERE ticker NOT IN (SELECT ticker FROM ({_NEWT}) n) UNION ALL SELECT ticker, date, ratio FROM ({_NEWT}) n")
def snk4(u):
    return sinks.replace_by_key(u.splits, u.splits.where(F.col("ratio") == 2), ["ticker"])


@query("snk5_replace_from_date", "SELECT ticker, date, close FROM si_bars WHERE date < DATE '2001-03-01' UNION ALL SELECT ticker, date, close * 2 FROM si_bars WHERE date >= (SELECT min(date) FROM si_bars b WHERE b.ticker = si_bars.ticker AND b.date >= DATE '2001-03-01')")
def snk5(u):
    new = u.bars.where(F.col("date") >= F.lit("2001-03-01").cast("date")).select("ticker", "date", (F.col("close") * 2).alias("close"))
    return sinks.replace_from_date(u.bars.select("ticker", "date", "close"), new, "ticker")


@query("snk6_replace_if_any", "SELECT ticker, kind, holder, pct FROM si_holders WHERE kind = 'fund' AND pct > 100 UNION ALL SELECT ticker, kind, holder, pct FROM si_holders WHERE ticker NOT IN (SELECT ticker FROM si_holders WHERE kind = 'fund' AND pct > 100)")
def snk6(u):
    return sinks.replace_if_any(u.holders, u.holders.where((F.col("kind") == "fund") & (F.col("pct") > 100)), "ticker")


@query("snk7_merge_run", "SELECT 'snapshots' AS section, ticker, count(*) AS n, max(collected_at) AS latest FROM (SELECT * FROM si_snapshots QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY collected_at DESC) <= 10) s GROUP BY ticker UNION ALL SELECT 'runs', ticker, count(*), max(collected_at) FROM (SELECT * FROM si_runs QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY collected_at DESC) <= 50) s GROUP BY ticker")
def snk7(u):
    cut = F.lit("2001-06-01").cast("timestamp")
    p = u.quarterly.select("ticker", "period_end", "revenue")
    part = lambda d, c, new: d.where((F.col(c) >= cut) if new else (F.col(c) < cut))
    run = lambda new: {"periods": part(p, "period_end", new), "info": u.company.select("ticker", "sic"), "snapshots": part(u.snapshots, "collected_at", new), "runs": part(u.runs, "collected_at", new),
                       "holders": u.holders.where(F.col("kind") == ("fund" if new else "institutional"))}
    m = sinks.merge_run(run(False), run(True), keep_snapshots=10, keep_runs=50)
    out = None
    for n in ("snapshots", "runs"):
        g = m[n].groupBy("ticker").agg(F.count("*").alias("n"), F.max("collected_at").alias("latest")).withColumn("section", F.lit(n))
        out = g if out is None else out.unionByName(g)
    return out


@query("snk8_dedupe_filings", "SELECT ticker, accn AS accession, filed AS date, form, max(CASE WHEN form = '10-K' THEN 'new' ELSE 'old' END) AS source FROM si_listed GROUP BY ALL")
def snk8(u):
    l = u.listed.select("ticker", F.col("accn").alias("accession"), F.col("filed").alias("date"), "form")
    return sinks.dedupe_filings(l.withColumn("source", F.lit("old")), l.where(F.col("form") == "10-K").withColumn("source", F.lit("new")))


@query("snk9_summary_export", "SELECT c.ticker, c.sector_class, m.current_price AS quote_current_price, a.revenue AS annual_revenue FROM si_company c LEFT JOIN ox_market m ON m.ticker = c.ticker LEFT JOIN (SELECT * FROM ox_acal WHERE rn = 1) a ON a.ticker = c.ticker")
def snk9(u):
    from finstrata.operators.companies import latest
    return sinks.summary_export(u.company.select("ticker", "sector_class"), {"quote": latest(u.snapshots, "collected_at").select("ticker", "current_price"), "annual": latest(u.annual_cal, "fiscal_year").select("ticker", "revenue")})


@query("snk10_history_export", _full("n", "o"))
def snk10(u):
    return sinks.history_export(_old(u), _new(u))


@query("snk11_company_json", "SELECT c.ticker, (SELECT count(*) FROM si_splits s WHERE s.ticker = c.ticker) AS splits, c.sic FROM si_company c")
def snk11(u):
    j = sinks.company_json(u.company.select("ticker", "sic"), {"splits": u.splits})
    d = F.from_json("json", "ticker string, sic string, splits array<struct<date:string,ratio:double>>")
    return j.select("ticker", d.alias("d")).select("ticker", F.coalesce(F.size("d.splits"), F.lit(0)).cast("long").alias("splits"), "d.sic")


@query("snk12_export_csv", "SELECT ticker, date, ratio FROM si_splits")
def snk12(u):
    path = landed(u, "csv", lambda p: sinks.export_csv(u.splits, p))
    return u.spark.read.option("header", True).schema("ticker string, date date, ratio double").csv(path)


@query("snk13_write_table", f"SELECT ticker, date, ratio FROM si_splits WHERE ratio <> 2 UNION ALL SELECT ticker, date, ratio + 1 FROM ({_NEWT}) n")
def snk13(u):
    new = u.splits.where(F.col("ratio") == 2).withColumn("ratio", F.col("ratio") + 1)
    path = landed(u, "written", lambda p: sinks.write_table("split_events", u.splits, new, p))
    return u.spark.read.parquet(path).select("ticker", "date", "ratio")


# ---- INC

@query("inc1_append_quote", "SELECT m.ticker, m.current_price * 2 AS current_price, l.beta, l.previous_close FROM ox_market m JOIN (SELECT * FROM si_snapshots QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY collected_at DESC) = 1) l ON l.ticker = m.ticker")
def inc1(u):
    from finstrata.operators.companies import latest
    q = latest(u.snapshots, "collected_at").select("ticker", F.lit("2002-01-01").cast("timestamp").alias("collected_at"), (F.col("current_price") * 2).alias("current_price"), F.lit(None).cast("double").alias("beta"))
    return inc.append_quote(u.snapshots, q).select("ticker", "current_price", "beta", "previous_close")


@query("inc1_refreshed_ev", "SELECT a.ticker, a.fiscal_year, m.market_cap + coalesce(net_debt, 0) AS enterprise_value, CASE WHEN ebitda > 0 THEN (m.market_cap + coalesce(net_debt, 0)) / ebitda END AS ev_to_ebitda FROM ox_ratio a JOIN ox_market m ON m.ticker = a.ticker WHERE rn = 1", r="enterprise_value ev_to_ebitda")
def inc1e(u):
    from finstrata.plans.catalog import d_valuation as D, h_queries as Q
    m = Q.ratio_rows(u).join(u.annual_cal.select("ticker", "fiscal_year", "revenue"), ["ticker", "fiscal_year"])
    return inc.refreshed_ev(m, D.market(u)).select("ticker", "fiscal_year", "enterprise_value", "ev_to_ebitda")


R["si_irun"] = "SELECT *, quality_score % 4 <> 0 AS complete FROM si_runs WHERE collected_at < TIMESTAMP '2001-07-01 00:00:00'"
R["ox_irun"] = "SELECT * FROM si_irun QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY collected_at DESC, run_id DESC) = 1"


@query("inc2_to_reload", "SELECT DISTINCT l.ticker, 'new report' AS reason FROM si_listed l JOIN ox_irun r ON r.ticker = l.ticker WHERE l.filed > CAST(r.collected_at AS DATE) AND l.form IN ('10-K', '10-Q', '10-K/A') UNION ALL SELECT ticker, 'incomplete' FROM ox_irun WHERE NOT complete UNION ALL SELECT DISTINCT s.ticker, 'split' FROM si_splits s JOIN ox_irun r ON r.ticker = s.ticker WHERE s.date > CAST(r.collected_at AS DATE)")
def inc2(u):
    feed = u.listed.join(u.company.select("ticker", "cik"), "ticker").select("cik", "form", "filed")
    return inc.to_reload(feed, u.irun, u.splits, u.company)


@query("inc3_incomplete_tries", "SELECT ticker, CAST(count(*) AS INT) AS tries FROM (SELECT r.* FROM si_irun r LEFT JOIN (SELECT ticker, max(collected_at) AS d FROM si_irun WHERE complete GROUP BY ticker) c ON c.ticker = r.ticker WHERE NOT complete AND (d IS NULL OR collected_at > d)) x GROUP BY ticker")
def inc3(u):
    return inc.incomplete_tries(u.irun)


@query("inc4_recompute_changed", """SELECT *, CASE WHEN capex IS NOT NULL THEN row_number() OVER (PARTITION BY fiscal_year, capex IS NULL ORDER BY capex, ticker) END AS place FROM (
SELECT ticker, fiscal_year, CASE WHEN ticker IN (SELECT ticker FROM si_splits WHERE ratio = 2) THEN capex * 3 + 1 ELSE capex END AS capex FROM si_annual_cal) x""", r="capex")
def inc4(u):
    from finstrata.functions.scale import ordinal
    a = u.annual_cal.select("ticker", "fiscal_year", F.col("capex").cast("double").alias("capex"))
    again = lambda t: a.join(t, "ticker", "left_semi").withColumn("capex", F.col("capex") * 3 + 1)

    def place(d):
        known = ordinal(d.where(F.col("capex").isNotNull()), ["fiscal_year"], "capex", "ticker", "place")
        return d.join(known.select("ticker", "fiscal_year", "place"), ["ticker", "fiscal_year"], "left")
    return inc.recompute_changed(a, u.splits.where(F.col("ratio") == 2), again, place)


@query("inc5_apply_run", "SELECT 'split_events' AS name, count(*) AS rows, sum(ratio) AS total FROM si_splits UNION ALL SELECT 'dividend_events', count(*), sum(amount * 2) FROM si_dividends", r="total")
def inc5(u):
    d = u.dividends.select("ticker", "date", "amount")
    t = inc.apply_run({"split_events": u.splits, "dividend_events": d.where(F.year("date") < 2000)}, {"dividend_events": d.withColumn("amount", F.col("amount") * 2)})
    a = t["split_events"].agg(F.count("*").alias("rows"), F.sum("ratio").alias("total")).withColumn("name", F.lit("split_events"))
    return a.unionByName(t["dividend_events"].agg(F.count("*").alias("rows"), F.sum("amount").alias("total")).withColumn("name", F.lit("dividend_events")))


@query("inc6_one_per_cik", "SELECT cik, ticker FROM (SELECT p_brand AS cik, CAST(p_partkey AS VARCHAR) AS ticker, row_number() OVER (PARTITION BY p_brand ORDER BY p_type <> 'SMALL', p_partkey) AS k FROM part) x WHERE k = 1")
def inc6(u):
    m = u.table("part").select(F.col("p_brand").alias("cik"), F.col("p_partkey").cast("string").alias("ticker"), F.when(F.col("p_type") == "SMALL", "Class A").otherwise("Other").alias("name"), F.col("p_partkey").alias("position"))
    return inc.one_per_cik(m).select("cik", "ticker")


@query("inc7_fill_sic", "SELECT ticker, sic, sic_description FROM si_company")
def inc7(u):
    gone = F.col("company_no") % 2 == 0
    c = u.company.withColumns({"sic_description": F.when(~gone, F.col("sic_description")), "sic": F.when(~gone, F.col("sic"))})
    return inc.fill_sic(c, u.company.select("cik", "sic", "sic_description")).select("ticker", "sic", "sic_description")


@query("inc8_served_day", "SELECT c.ticker, coalesce(greatest(b, s), CAST(r.collected_at AS DATE) - 1) AS served_on FROM ox_irun r JOIN si_company c ON c.ticker = r.ticker LEFT JOIN (SELECT ticker, max(date) AS b FROM si_bars GROUP BY ticker) x ON x.ticker = c.ticker LEFT JOIN (SELECT ticker, max(date) AS s FROM si_splits GROUP BY ticker) y ON y.ticker = c.ticker")
def inc8(u):
    from finstrata.operators.companies import latest
    return inc.served_day(u.bars, u.splits, latest(u.irun, "collected_at").select("ticker", "collected_at"))


@query("inc9_events_since", "SELECT b.ticker, least(b, d, s) AS since FROM (SELECT ticker, max(date) AS b FROM si_bars GROUP BY ticker) b LEFT JOIN (SELECT ticker, max(date) AS d FROM si_dividends GROUP BY ticker) d ON d.ticker = b.ticker LEFT JOIN (SELECT ticker, max(date) AS s FROM si_splits GROUP BY ticker) s ON s.ticker = b.ticker")
def inc9(u):
    return inc.events_since(u.bars, u.dividends, u.splits)


@query("inc9_moving_factors", "SELECT ticker, date, ratio FROM si_splits WHERE date > DATE '1998-01-01' AND ratio <> 1.061")
def inc9m(u):
    return inc.moving_factors(u.splits, u.company.select("ticker", F.lit("1998-01-01").cast("date").alias("since")))


@query("inc10_merge_sections", "SELECT a.ticker, a.run_id, coalesce(a.goodwill, a.revenue) AS revenue, a.capex, 0.04 AS rate FROM (SELECT ticker, CAST(fiscal_year AS BIGINT) AS run_id, goodwill, revenue, capex FROM si_annual_cal) a".replace("0.04 AS rate", "CAST(0.04 AS DOUBLE) AS rate"))
def inc10(u):
    a = u.annual_cal.withColumn("run_id", F.col("fiscal_year").cast("bigint"))
    rates = a.select("run_id").distinct().withColumn("rate", F.lit(0.04))
    return inc.merge_sections(a.select("ticker", "run_id", "revenue", "capex"), a.select("ticker", "run_id", F.col("goodwill").alias("revenue")), rates)
