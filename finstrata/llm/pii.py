"""Personal data by fixed forms, and the terms whose company in the corpus gives them away."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from finstrata.llm.common import written

#: A term discloses a value if the value is at least this likely where the term stands, by a one-sided bound of BOUND standard errors.
DISCLOSURE, BOUND = 0.5, 1.645
#: Share of a class of rare terms that must stand by their values for more than chance; decoy values that chance is measured by; weight of the wider class.
EXCESS, DECOYS, PRIOR = 0.9, 4, 5.0
#: Words before and after a value that are its company, and what company on another line counts as evidence.
WINDOW, ELSEWHERE = 64, 0.5
#: Letters of the shortest term, and of the longest agreement with a value that is told apart.
TERM_LETTERS, MOST_LETTERS = 3, 8

# The forms in which no part repeats a group, so that a match costs neither stack nor, from a failed start, another pass over the same run.
_LOCAL, _LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
EMAIL = rf"(?s)(?:(?<!{_LOCAL})|\G){_LOCAL}++@{_LABEL}+\.{_LABEL}[A-Za-z0-9.-]*?(?=\.(?:[^A-Za-z0-9-]|\z)|[^A-Za-z0-9.-]|\z)"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?s)[0-9](?=[\x20-]?[0-9])[0-9\x20-]*?(?=[\x20-](?:[^0-9]|\z)|[^0-9\x20-]|\z)"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
WORD = r"[\p{L}\p{N}]+"
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_IP_PARTS = rf"^{_PART}(?:\.{_PART}){{3}}\z"

KINDS = ["email", "ip", "card", "phone", "term"]
SPAN = "array<struct<start:int,kind:int,end:int,value:string>>"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _valid(kind: str, m: Column) -> Column:
    d = _digits(m)
    return {"email": lambda: F.lit(True), "ip": lambda: m.rlike(_IP_PARTS), "phone": lambda: F.length(d).between(10, 15),
            "card": lambda: F.when(F.length(d).between(14, 19), F.call_function("luhn_check", d)).otherwise(False)}[kind]()


def located(texts: DataFrame, pattern: str) -> DataFrame:
    """``key, start, end, line, value``: the leftmost non-overlapping matches of *pattern* in each text of *texts*
    (``key, text``; keys distinct), in code points, with the number of the line. Each match is a row, so that places are running sums."""
    found = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
    gaps = F.slice(F.split("text", pattern, -1), F.lit(1), F.size(found))
    hits = texts.select("key", F.posexplode(F.arrays_zip(gaps.alias("gap"), found.alias("value"))).alias("i", "x")).select(
        "key", "i", "x.value", F.length("x.gap").alias("g"), (F.length("x.gap") - F.length(F.replace("x.gap", F.lit("\n"), F.lit("")))).alias("n"))
    over = Window.partitionBy("key").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    size = F.length("value")
    end = F.sum(F.col("g") + size).over(over)
    return hits.select("key", (end - size).cast("int").alias("start"), end.cast("int").alias("end"), F.sum("n").over(over).alias("line"), "value")


def _needs(text: Column) -> dict[str, Column]:
    """What a text must have for each kind, so that the forms run only where they can match."""
    return {"email": F.contains(text, F.lit("@")), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike(r"[0-9](?:[\x20-]?[0-9]){13}"), "phone": F.contains(text, F.lit("+"))}


def base_spans(texts: DataFrame) -> DataFrame:
    """``key, start, end, line, value, kind`` of the emails, addresses, cards and phones of *texts* (``key, text``)."""
    parts = []
    for kind, pattern in (("email", EMAIL), ("ip", IP), ("card", CARD), ("phone", PHONE)):
        found = located(texts.where(_needs(F.col("text"))[kind]), pattern)
        parts.append(found.where(_valid(kind, F.col("value"))).withColumn("kind", F.lit(KINDS.index(kind))))
    return reduce(DataFrame.unionByName, parts)


def free_words(texts: DataFrame, spans: DataFrame) -> DataFrame:
    """The base spans and the words of *texts* that overlap none of them (``kind``: term), each with ``i``, the number of words up to it."""
    rows = located(texts, WORD).withColumn("kind", F.lit(KINDS.index("term"))).unionByName(spans)
    ahead = Window.partitionBy("key").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    behind = Window.partitionBy("key").orderBy(F.col("start").desc(), F.col("kind").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    is_word = F.col("kind") == KINDS.index("term")
    rows = rows.withColumn("till", F.max(F.when(~is_word, F.col("end"))).over(ahead)).withColumn("next", F.min(F.when(~is_word, F.col("start"))).over(behind))
    rows = rows.where(~is_word | (F.coalesce("till", F.lit(0)) <= F.col("start")) & (F.col("next").isNull() | (F.col("next") >= F.col("end"))))
    return rows.withColumn("i", F.sum(is_word.cast("int")).over(ahead)).withColumn("capital", is_word & F.col("value").rlike(r"^\p{Lu}")).drop("till", "next")


def _terms(line: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(line), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) >= TERM_LETTERS))


def company(rows: DataFrame) -> DataFrame:
    """``key, value, term, same, capital, unit``: words within WINDOW words of a value, by :func:`free_words`.

    ``unit`` tells the surroundings apart: copies of a passage are one. Words and values meet by blocks of WINDOW
    words, so a value has some hundred rows whatever the text's length or lines.
    """
    block = lambda c: F.floor(F.col(c) / WINDOW)
    is_word = F.col("kind") == KINDS.index("term")
    words = rows.where(is_word).select("key", "i", "line", "capital", F.lower("value").alias("term"), block("i").alias("b"))
    values = rows.where(~is_word).select("key", F.col("i").alias("vi"), F.col("line").alias("vl"), "start", "value", F.explode(F.sequence(block("i") - 1, block("i") + 1)).alias("b"))
    met = words.join(values, ["key", "b"]).where(F.abs(F.col("i") - F.col("vi")) <= WINDOW)
    met = met.withColumn("unit", F.bit_xor(F.xxhash64("term", F.col("i") - F.col("vi"))).over(Window.partitionBy("key", "start", "value")))
    return met.where(F.length("term") >= TERM_LETTERS).groupBy("key", "value", "term").agg(F.max(F.col("line") == F.col("vl")).alias("same"), F.max("capital").alias("capital"), F.min("unit").alias("unit"))


def agreement(value: str, term: str) -> Column:
    """Letters and digits of the term if the value's hold them in a row, MOST_LETTERS at most; else 0."""
    squeezed = F.regexp_replace(F.lower(value), r"[^\p{L}\p{N}]", "")
    return F.when(F.contains(squeezed, F.col(term)), F.least(F.length(term), F.lit(MOST_LETTERS))).otherwise(F.lit(0))


def class_excess(pairs: DataFrame) -> DataFrame:
    """``letters, same, capital, excess`` for classes of *pairs* (``value, term, same, capital``): the share of a class that isn't chance.

    A class is how many letters of the term the value has, at least, whether both stand on a line, and the term's
    shape. Chance is how often the same terms agree as well with other values of the corpus, DECOYS for each. Small
    classes lean on all that agree as much. Terms that don't agree at all are no more with their values than with
    others; their excess is 0.
    """
    values = pairs.select("value").distinct()
    deal = Window.partitionBy(F.pmod(F.xxhash64("value"), F.greatest(F.lit(1), F.floor(F.lit(values.count()) / 10_000)).cast("long"))).orderBy(F.xxhash64("value", F.lit(1)), "value")
    others = values.withColumn("others", F.filter(F.array(*[F.lead("value", k).over(deal) for k in range(1, DECOYS + 1)], *[F.lag("value", k).over(deal) for k in range(1, DECOYS + 1)]), F.isnotnull))
    others = others.withColumn("others", F.slice("others", 1, DECOYS))
    own = pairs.select("same", "capital", agreement("value", "term").alias("letters"), F.lit(1.0).alias("own"), F.lit(0.0).alias("chance"))
    # a term that another value stands by as well is no measure of chance
    decoy = pairs.join(others, "value").select("term", "same", "capital", F.explode("others").alias("other"), (F.lit(1.0) / F.size("others")).alias("chance"))
    decoy = decoy.select("same", "capital", agreement("other", "term").alias("letters"), F.lit(0.0).alias("own"), "chance")
    counts = own.unionByName(decoy).where(F.col("letters") > 0).groupBy("letters", "same", "capital").agg(F.sum("own").alias("own"), F.sum("chance").alias("chance"))
    down = Window.orderBy(F.col("letters").desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)  # a few rows
    each = Window.partitionBy("same", "capital").orderBy(F.col("letters").desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    wide = (F.sum("chance").over(down) + 0.5) / (F.sum("own").over(down) + 1)
    return counts.withColumn("wide", wide).select("letters", "same", "capital", (1 - (F.sum("chance").over(each) + PRIOR * F.col("wide")) / (F.sum("own").over(each) + PRIOR)).alias("excess"))


def disclosing_terms(texts: DataFrame, near: DataFrame, copies: DataFrame, total: int, disclosure: float = DISCLOSURE, excess: float = EXCESS) -> DataFrame:
    """``value, term`` where a term's company discloses a protected value.

    *texts* has ``text``, *near* is :func:`company`, *copies* how many documents have a ``key``, *total* the number of
    documents. Of the documents with a term, some hold the value: their share, less BOUND standard errors, is how
    likely the value is where the term stands; it must reach *disclosure* and exceed the value's share of all
    documents. Evidence are different surroundings (another line counts ELSEWHERE), so that neither one document nor
    its copies make a rare word certain. A term too rare for that is judged by its class: it must stand in few
    documents without the value, and of terms that agree as much with their values at least *excess* must be there for
    more than chance (:func:`class_excess`).
    """
    near = written(near.join(copies, "key"), "pii-company")
    of_value = near.groupBy("value", "key").agg(F.max("copies").alias("copies")).groupBy("value").agg(F.sum("copies").alias("n_value"))
    places = near.groupBy("value", "term", "unit").agg(F.sum("copies").alias("copies"), F.max("same").alias("same"), F.max("capital").alias("capital"))
    pairs = places.groupBy("value", "term").agg(F.sum("copies").alias("n_both"), F.sum(F.when(F.col("same"), 1.0).otherwise(ELSEWHERE)).alias("units"), F.max("same").alias("same"), F.max("capital").alias("capital"))
    pairs = written(pairs, "pii-pairs")
    of_term = texts.select(F.explode(_terms(F.coalesce("text", F.lit("")))).alias("term")).groupBy("term").agg(F.count("*").alias("n_term"))
    classes = class_excess(pairs)
    told = pairs.join(of_value, "value").join(of_term, "term", "left").withColumn("letters", agreement("value", "term")).join(F.broadcast(classes), ["letters", "same", "capital"], "left")
    p = F.least(F.lit(1.0), F.col("n_both") / F.coalesce("n_term", "n_both"))
    n, z2 = F.col("units") / p, BOUND ** 2
    least = (p + z2 / (2 * n) - BOUND * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))) / (1 + z2 / n)
    known = (least >= disclosure) & (least > F.col("n_value") / F.lit(float(max(total, 1))))
    return told.where(known | (p >= disclosure) & (F.coalesce("excess", F.lit(0.0)) >= excess)).select("value", "term")


def find(df: DataFrame, doc_id: str = "doc_id", text: str = "text", disclosure: float = DISCLOSURE, excess: float = EXCESS) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base, spans, key`` for each row of *df*: the base spans and all spans (``start, kind,
    end, value``; kind as a place in KINDS) of the whole text, by start, then kind.

    Terms are marked throughout the documents that hold the value they disclose. Null texts are empty and have no spans; ids may be
    null or repeated, since a text's spans depend on the text and the corpus only. Other columns are left out. Matches, words and
    company are rows by text, so work grows with a text's length, however many lines or matches it has.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    docs = df.select(F.col(doc_id).alias("doc_id"), t.alias("text"), F.xxhash64(t).alias("key"))
    copied = docs.where(reduce(Column.__or__, _needs(F.col("text")).values())).groupBy("key").agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    texts = written(copied, "pii-texts")
    spans = written(base_spans(texts), "pii-base")
    held = texts.join(spans.select("key").distinct(), "key", "left_semi")
    rows = written(free_words(held.select("key", "text"), spans), "pii-words")
    pairs = written(disclosing_terms(docs.select("text"), company(rows), texts.select("key", "copies"), docs.count(), disclosure, excess), "pii-terms")
    marks = spans.select("key", "value").distinct().join(pairs, "value").select("key", "term").distinct()
    words = rows.where(F.col("kind") == KINDS.index("term")).withColumn("term", F.lower("value")).join(marks, ["key", "term"], "left_semi")
    one = F.struct(F.col("start"), F.col("kind"), F.col("end"), F.col("value"))
    found = spans.unionByName(words.select(spans.columns)).groupBy("key").agg(F.array_sort(F.collect_list(one)).cast(SPAN).alias("spans"))
    found = written(found.withColumn("base", F.filter("spans", lambda s: s["kind"] < KINDS.index("term"))), "pii-spans")
    none = F.array().cast(SPAN)
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    out = docs.select("doc_id", "key").join(found, "key", "left").withColumns({"base": F.coalesce("base", none), "spans": F.coalesce("spans", none)})
    return out.select("doc_id", *[count(k).alias(f"n_{name}") for k, name in enumerate(KINDS[:4])], "base", "spans", "key")


def span_text(spans: str) -> Column:
    """``kind:start:end``, joined by commas."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def sanitise(df: DataFrame, text: str = "text", **options) -> DataFrame:
    """*df* with each span of *text* replaced by its kind in brackets (``[email]``; a term by ``[term]``); of overlapping spans the first counts. Null texts stay null."""
    key = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    found = find(df.select(F.lit(0).alias("doc_id"), text), "doc_id", text, **options).where(F.size("spans") > 0).select(F.col("key").alias("_k"), F.col("spans").alias("_spans")).dropDuplicates(["_k"])
    kinds = F.array(*map(F.lit, KINDS))

    def step(acc: Column, s: Column) -> Column:
        ahead = F.concat(acc["out"], F.substring(F.col(text), acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), F.element_at(kinds, s["kind"] + 1), F.lit("]"))
        return F.when(s["start"] < acc["at"], acc).otherwise(F.struct(s["end"].alias("at"), ahead.alias("out")))

    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    clean = F.aggregate("_spans", begin, step, lambda acc: F.concat(acc["out"], F.substring(F.col(text), acc["at"] + 1, F.length(text))))
    return df.withColumn("_h", key).join(written(found, "pii-found"), F.col("_h") == F.col("_k"), "left").withColumn(
        text, F.when(F.col("_spans").isNotNull(), clean).otherwise(F.col(text))).select(*df.columns)
