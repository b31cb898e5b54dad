"""Removal of lines that spread over many sites."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from finstrata.llm.common import written

#: A line on this many distinct sites is boilerplate.
MIN_SITES = 10
#: log2 of a sketch's registers, and how far from the threshold (as a share of it) a sketch's estimate is not trusted:
#: four standard errors of 1.04 / sqrt(2^10).
SKETCH_LOG2, BAND = 10, 0.13
#: What lines are trimmed of.
SPACES = " \t\n\x0b\x0c\r"


def _lines(text: Column) -> Column:
    """The text's lines, each trimmed of the six ASCII spaces."""
    return F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(x, F.lit(SPACES)))


def _hash(line: Column) -> Column:
    return F.xxhash64(line)


def boilerplate(docs: DataFrame, text: str = "text", site: str = "source", order: str = "doc_id", min_sites: int = MIN_SITES) -> DataFrame:
    """``h`` (the line's hash) and ``first`` (the smallest *order* that has it) of lines on *min_sites* or more distinct sites.

    Each line's sites are counted by sketches that are made where the rows are and merged by line; a line whose
    estimate is near the threshold is counted exactly. Null sites count as one site; empty lines don't count.
    """
    lines = docs.select(F.xxhash64(F.coalesce(F.col(site), F.lit("")), F.col(site).isNull()).alias("site"), F.col(order).alias("first"), F.explode(_lines(F.col(text))).alias("line")).where(
        F.col("line") != "").select("site", "first", _hash(F.col("line")).alias("h"))
    spread = lines.groupBy("h").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", SKETCH_LOG2)).alias("sites"), F.min("first").alias("first"))
    likely = written(spread.where(F.col("sites") >= min_sites * (1 - BAND)), "line-spread")
    sure, near = likely.where(F.col("sites") > min_sites * (1 + BAND)), likely.where(F.col("sites") <= min_sites * (1 + BAND))
    exact = lines.join(near.select("h"), "h", "left_semi").groupBy("h", "site").agg(F.min("first").alias("first")).groupBy("h").agg(F.count("*").alias("sites"), F.min("first").alias("first"))
    return written(sure.select("h", "first").unionByName(exact.where(F.col("sites") >= min_sites).select("h", "first")), "line-boilerplate")


def _kept(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    """Texts without the lines whose hashes are listed, but for the first of each that is the text's own; one pass over each text's lines."""
    for texts, drops, own in batches:
        out = []
        for t, d, o in zip(texts, drops, own, strict=True):
            if t is None:
                out.append((None, None))
                continue
            drop, first, lines = set(d.tolist()), set(o.tolist()), t.split("\n")
            stay = []
            for x in lines:
                h = xxhash.xxh64_intdigest(x.strip(SPACES).encode("utf-8", "replace"), 42)
                h -= (h >> 63) << 64
                if h not in drop or h in first:
                    stay.append(x)
                    first.discard(h)
            out.append(("\n".join(stay), len(lines) - len(stay)))
        yield pd.DataFrame(out, columns=["text", "removed"], dtype=object)


def dedup(docs: DataFrame, text: str = "text", site: str = "source", order: str = "doc_id", min_sites: int = MIN_SITES, keep_first: bool = True) -> DataFrame:
    """*docs* with boilerplate lines taken out of *text*; adds ``n_lines`` (before) and ``n_removed``.

    With *keep_first* a line stays once, where it first stands in the document with the smallest *order* that has it,
    so what copies on many sites have in common is not lost. The other lines stay as they are, joined by line feeds;
    a text without boilerplate is returned unchanged, null as null with 0 lines. Rows are never dropped. Rows with a
    null *order* keep a line only if no other row has it; rows of equal *order* keep it in each. Columns of *docs*
    named like the added ones are replaced.
    """
    bad = boilerplate(docs, text, site, order, min_sites)
    base = docs.drop("n_lines", "n_removed").withColumn("_k", F.xxhash64(F.col(text)))
    found = base.select("_k", F.explode(_lines(F.col(text))).alias("line")).where(F.col("line") != "").select("_k", _hash(F.col("line")).alias("h")).join(bad, "h")
    drop = written(found.groupBy("_k", "h", "first").agg(F.lit(1)).groupBy("_k").agg(F.collect_list(F.struct("h", "first")).alias("_drop")), "line-drops")
    t = F.coalesce(F.col(text), F.lit(""))
    # drop grows with the corpus: texts are dealt by hash at every size
    joined = base.join(drop.hint("merge"), "_k", "left")
    hashes = lambda of: F.transform(of, lambda d: d["h"])
    own = F.filter("_drop", lambda d: d["first"].eqNullSafe(F.col(order))) if keep_first else F.slice("_drop", 1, 0)
    some = F.col("_drop").isNotNull()
    joined = joined.withColumn("_kept", pandas_udf(_kept, "text string, removed long")(F.when(some, F.col(text)), hashes("_drop"), F.when(some, hashes(own))))
    n = F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, "\n"))).cast("long")
    out = joined.withColumns({"n_lines": n, "n_removed": F.coalesce("_kept.removed", F.lit(0)).cast("long")})
    out = out.withColumn(text, F.when(F.col("n_removed") > 0, F.col("_kept.text")).otherwise(F.col(text)))
    return out.select(*[c for c in docs.columns if c not in ("n_lines", "n_removed")], "n_lines", "n_removed")
