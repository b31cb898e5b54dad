"""Whether an officer title names the company's own sitting chief executive or financial officer (INS-3).

A title is split into clauses; each clause is a row of named facts (has a chief, is past, is someone else's, heads a
unit), and a chief sits if one clause names it and nothing speaks against it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ways to write the two chiefs, after dots are taken out.
CHIEFS = {"ceo": r"chief\s+exec(?:utive)?(?:\s*(?:&|and|/)\s*\w+)?(?:\s+(?:officer|offr|ofcr|off))?", "cfo": r"chief\s+fin(?:ance|ancial)?(?:\s*(?:&|and|/)\s*\w+)?\s+(?:officer|offr|ofcr|off)"}
#: Words that name a post, so that a clause with one goes on with duties rather than with a place or a unit.
ROLES = ("ceo cfo coo cto cio cao cmo cco cso cro chief officer president vice vp svp evp avp chair chairman chairwoman chairperson director board member trustee secretary treasurer controller "
         "comptroller counsel founder cofounder partner principal manager owner executive head general").split()
#: Words of a post that is over or not yet begun, and of one beside the chief's.
PAST = "former formerly ex past retired emeritus elect designate incoming outgoing previous".split()
BESIDE = "office to deputy assistant asst adviser advisor associate under".split()
#: Words that qualify a post without moving it.
NEUTRAL = "interim acting current co the and".split()
#: The company by another name; its ticker is read as the first.
SELF = "company corporation registrant issuer".split()

_ANY_SELF = "|".join(SELF)
_BRACKET = r"\(([^)]*)\)?"


def _words(c: Column) -> Column:
    return F.filter(F.split(c, "[^a-z0-9]+"), lambda w: w != "")


def _has(words: Column, of: list[str]) -> Column:
    return F.arrays_overlap(words, F.array(*map(F.lit, of)))


def _says_nothing(words: Column) -> Column:
    """Only words for the company itself, or that move no post."""
    return F.size(F.array_except(words, F.array(*map(F.lit, SELF + NEUTRAL)))) == 0


def _names_place(c: Column) -> Column:
    """A clause without a post, which so is a place's or a unit's name."""
    words = _words(c)
    return ~_has(words, ROLES + PAST) & ~_says_nothing(words)


def _plain(title: Column, ticker: Column) -> Column:
    """Lower case, chiefs in one spelling, the company's ticker as the word company."""
    t = F.replace(F.lower(title), F.lit("."), F.lit(""))
    t = F.regexp_replace(t, r"\bex[ -]officio\b", " ")
    for name, pattern in CHIEFS.items():
        t = F.regexp_replace(t, rf"\b{pattern}\b", name)
    own = F.concat(F.lit(r"\b\Q"), F.lower(ticker), F.lit(r"\E\b"))
    return F.when(F.length(F.coalesce(ticker, F.lit(""))) > 0, F.regexp_replace(t, own, F.lit(SELF[0]))).otherwise(t)


def _clause(c: Column, following: Column) -> Column:
    """The named facts of a clause; *following* is the one after the comma, or NULL."""
    chief = r"(?s)^(.*?)\b(?:ceo|cfo)\b(.*)$"
    before, after = _words(F.regexp_extract(c, chief, 1)), F.regexp_extract(c, chief, 2)
    last_post = ~_has(_words(after), ROLES)
    return F.struct(
        c.rlike(r"\b(?:ceo|cfo)\b").alias("has_chief"),
        _has(_words(c), PAST).alias("is_past"),
        _has(before, BESIDE).alias("is_anothers"),
        (after.rlike(rf"\b(?:of|at|for)\s+(?!(?:the\s+)?(?:{_ANY_SELF})\b)\S") | last_post & F.coalesce(_names_place(following), F.lit(False))).alias("heads_unit"))


def _remark_matters(c: Column) -> Column:
    """A bracket without a post says something of the chief: past, or of a unit."""
    words = _words(c)
    return ~_has(words, ROLES) & (_has(words, PAST) | _names_place(c))


def is_ceo_cfo(title: Column, ticker: Column) -> Column:
    """True where the title names the company's own chief executive or financial officer in office.

    A place or unit after a comma belongs to the post before it; one after a dash, or after ``of`` and ``at``, to all
    posts before it. Brackets with a post are remarks on that post. Misspelled and run-together titles aren't read.
    """
    t = _plain(title, ticker)
    remarks = F.regexp_extract_all(t, F.lit(_BRACKET), F.lit(1))
    parts = F.split(F.regexp_replace(t, _BRACKET, " "), r"\s+[-–:]+\s*|[-–:]+\s+|:")
    units = F.exists(F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))), _names_place)
    clauses = F.split(F.array_join(parts, ";"), "[,;]")
    judged = F.transform(clauses, lambda c, i: _clause(c, F.get(clauses, i + 1)))
    sits = F.exists(judged, lambda j: j["has_chief"] & ~j["is_past"] & ~j["is_anothers"] & ~j["heads_unit"])
    return F.coalesce(sits & ~units & ~F.exists(remarks, _remark_matters), F.lit(False))


def classify_titles(filings: DataFrame) -> DataFrame:
    """Adds ``is_ceo_cfo``; each distinct (title, ticker) is read once."""
    read = filings.select("officer_title", "ticker").where(F.col("officer_title").isNotNull()).distinct()
    read = read.withColumn("is_ceo_cfo", is_ceo_cfo(F.col("officer_title"), F.col("ticker")))
    rest = filings.drop("is_ceo_cfo")
    return rest.join(read, ["officer_title", "ticker"], "left").withColumn("is_ceo_cfo", F.coalesce("is_ceo_cfo", F.lit(False)))
