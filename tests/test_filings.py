"""XBRL instances: facts meet their own filing's contexts and units in one reading."""

import datetime as dt

from finstrata.sources import filings

HEAD = '<xbrli:xbrl xmlns:xbrli="http://www.xbrl.org/2003/instance" xmlns:us-gaap="http://fasb.org/us-gaap/2025" xmlns:dei="http://xbrl.sec.gov/dei/2025">'
UNIT = '<xbrli:unit id="u"><xbrli:measure>iso4217:USD</xbrli:measure></xbrli:unit>'
DOCS = "accn string, ticker string, cik string, form string, filed date, content binary"


def context(name, cik, end="2024-12-31", segment=""):
    return f'<xbrli:context id="{name}"><xbrli:entity><xbrli:identifier>{cik}</xbrli:identifier>{segment}</xbrli:entity><xbrli:period><xbrli:instant>{end}</xbrli:instant></xbrli:period></xbrli:context>'


def fact(where, val, tag="us-gaap:Assets", unit=' unitRef="u"', decimals="0"):
    return f'<{tag} contextRef="{where}"{unit} decimals="{decimals}">{val}</{tag}>'


def docs(spark, **bodies):
    day = dt.date(2025, 2, 1)
    return spark.createDataFrame([(a, f"T{a}", "77", "10-K", day, (HEAD + b + "</xbrli:xbrl>").encode()) for a, b in bodies.items()], DOCS)


def test_instances_are_parsed_once(spark):
    out = filings.parse_xbrl_instances(docs(spark, a=context("c", 77) + UNIT + fact("c", 5)))
    assert "MapInPandas" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert [(r["ticker"], r["tag"], r["unit"], r["val"], r["frame"]) for r in out.collect()] == [("Ta", "Assets", "USD", 5.0, "CY2024Q4I")]


def test_contexts_and_units_belong_to_their_filing(spark):
    a = fact("c", 5) + fact("c", 6, decimals="INF") + fact("d", 9) + fact("other", 8) + fact("gone", 7) + fact("c", 4, unit=' unitRef="none"')
    a += fact("gone", 2023, "dei:DocumentFiscalYearFocus", "") + fact("c", 2024, "dei:DocumentFiscalYearFocus", "")
    a += context("c", 77) + context("d", 77, segment="<xbrli:segment/>") + context("other", 78) + UNIT
    b = context("c", 77, "2023-12-31") + context("gone", 77) + UNIT + fact("c", 3)
    rows = filings.parse_xbrl_instances(docs(spark, a=a, b=b)).collect()
    assert sorted((r["accn"], r["end"].isoformat(), r["val"], r["fy"]) for r in rows) == [("a", "2024-12-31", 6.0, 2024), ("b", "2023-12-31", 3.0, None)]


def test_facts_that_cannot_stay_are_not_written(spark):
    whole = context("c", 77) + context("d", 77, segment="<xbrli:segment/>") + context("e", 77, "") + UNIT + '<xbrli:unit id="v"/>'
    body = whole + fact("c", 5) + fact("d", 9) + fact("e", 8) + fact("gone", 7) + fact("c", 4, unit=' unitRef="v"') + fact("c", 3, unit=' unitRef="none"')
    body += fact("d", 2024, "dei:DocumentFiscalYearFocus", "") + fact("gone", "FY", "dei:DocumentFiscalPeriodFocus", "") + fact("c", 1, "dei:Other", "")
    rows = list(filings._instance_rows("a", "77", (HEAD + body + "</xbrli:xbrl>").encode()))
    assert [(r[3], r[9]) for r in rows] == [("Assets", "5"), ("DocumentFiscalYearFocus", "2024"), ("DocumentFiscalPeriodFocus", "FY")]
