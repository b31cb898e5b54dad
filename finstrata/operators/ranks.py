"""Cross-sectional ranks and industry groups (RNK-1..11).

A universe-wide percentile never sorts the universe in one task: ``functions.scale`` counts values by
order-preserving buckets. Peer groups are handled the same way, so a sector of a third of all
companies is spread over the cluster.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finstrata.functions.scale import ordinal, percentile_of
from finstrata.operators.scores import MAGIC_EXCLUDED

# Fixed values of the ranks.
RANKS = ("strength", "profitability", "growth", "valuation", "momentum")
REQUIRED = {"strength": 2, "profitability": 2, "growth": 2, "valuation": 1, "momentum": 1}
LOWER_IS_BETTER = ("debt_to_revenue", "price_to_value", "pe_pct_rank")
MIN_SECTOR_PEERS = MIN_INDUSTRY_PEERS = MIN_INDUSTRY_SIZE = 10
MIN_RANKS, LABEL_DESCRIPTIONS = 4, 3


def lower_is_better() -> Column:
    return F.col("component").isin(*LOWER_IS_BETTER)


def peer_percentiles(components: DataFrame, min_peers: int = MIN_SECTOR_PEERS) -> DataFrame:
    """Each component's percentile: among the sector where it has enough peers, else among everyone."""
    u = percentile_of(components, ["component"], "value", lower_is_better(), "universe_pct")
    s = percentile_of(u, ["sector_class", "component"], "value", lower_is_better(), "sector_pct", "n_peers")
    return s.withColumn("pct", F.when(F.col("n_peers") >= min_peers, F.col("sector_pct")).otherwise(F.col("universe_pct")))


def _decile(mean: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(10 * mean - 1e-9).cast("int"))


def _ranks(pcts: DataFrame, prefix: str, composite: str) -> DataFrame:
    need = F.coalesce(*[F.when(F.col("rank") == r, F.lit(n)) for r, n in REQUIRED.items()])
    per = pcts.groupBy("ticker", "rank").agg(F.avg("pct").alias("m"), F.count("pct").alias("n"))
    per = per.withColumn("decile", F.when(F.col("n") >= need, _decile(F.col("m"))))
    wide = per.groupBy("ticker").pivot("rank", list(RANKS)).agg(F.max("decile"))
    given = F.array_compact(F.array(*[F.col(r) for r in RANKS]))
    total = F.aggregate(given, F.lit(0.0), lambda a, b: a + b)
    return wide.select("ticker", *[F.col(r).alias(f"{prefix}{r}") for r in RANKS],
                       F.when(F.size(given) >= MIN_RANKS, 10.0 * (total / F.size(given))).alias(composite))


def rank_universe(components: DataFrame) -> DataFrame:
    """The five decile ranks and their composite, for every company with a component."""
    return _ranks(peer_percentiles(components), "rank_", "composite_score")


def magic_rank(scores: DataFrame) -> DataFrame:
    """Position by the sum of the earnings-yield and return-on-capital positions (ties by earnings yield)."""
    ok = scores.where(~F.col("sector_class").isin(*MAGIC_EXCLUDED) & F.col("earnings_yield").isNotNull()
                      & F.col("return_on_capital").isNotNull())
    base = ok.select("ticker", "earnings_yield", "return_on_capital")
    ey = ordinal(base, [], "earnings_yield", "ticker", "ey_rank", descending=True).select("ticker", "ey_rank")
    roc = ordinal(base, [], "return_on_capital", "ticker", "roc_rank", descending=True).select("ticker", "roc_rank")
    # The third ordering reads the first two three times over: they are kept rather than computed again.
    both = ey.join(roc, "ticker").persist(StorageLevel.MEMORY_AND_DISK)
    # Positions are unique, so one number orders (sum, earnings-yield position).
    keyed = both.withColumn("__sum", (F.col("ey_rank") + F.col("roc_rank")).cast("double"))
    keyed = keyed.withColumn("__tie", F.lpad(F.col("ey_rank").cast("string"), 12, "0"))
    first = ordinal(keyed, [], "__sum", "__tie", "magic_formula_rank", prefix=10)
    return first.select("ticker", "ey_rank", "roc_rank", "magic_formula_rank")


def normalize_sic(c: Column) -> Column:
    """A code of one to four digits, zero-padded to four; NULL for anything else."""
    t = F.trim(c.cast("string"))
    return F.when(t.rlike(r"^[0-9]{1,4}$"), F.lpad(t, 4, "0"))


def industry_groups(companies: DataFrame, min_size: int = MIN_INDUSTRY_SIZE) -> DataFrame:
    """Each company's group: its 3-digit prefix when large enough, else its 2-digit prefix, else none.

    Prefix sizes are counted first (at most 1,100 prefixes) and joined back, not windowed over companies.
    """
    c = companies.select("ticker", normalize_sic(F.col("sic")).alias("sic"))
    p3, p2 = F.substring("sic", 1, 3), F.substring("sic", 1, 2)
    sizes = (c.where(F.col("sic").isNotNull()).select(F.explode(F.array(p3, p2)).alias("prefix"))
             .groupBy("prefix").count())
    large = sizes.where(F.col("count") >= min_size).select("prefix")
    return (c.join(large.select(F.col("prefix").alias("g3")), p3 == F.col("g3"), "left")
            .join(large.select(F.col("prefix").alias("g2")), p2 == F.col("g2"), "left")
            .select("ticker", "sic", F.coalesce("g3", "g2").alias("industry_group")))


def industry_members(groups: DataFrame, min_size: int = MIN_INDUSTRY_SIZE) -> DataFrame:
    """(group, ticker): a group's own companies when enough, else every company whose code has the prefix."""
    own = groups.where(F.col("industry_group").isNotNull())
    sizes = own.groupBy("industry_group").agg(F.count("*").alias("n"))
    whole = sizes.where(F.col("n") >= min_size).select("industry_group")
    short = sizes.where(F.col("n") < min_size).select("industry_group")
    prefixes = groups.where(F.col("sic").isNotNull()).select(
        "ticker", F.explode(F.array(F.substring("sic", 1, 3), F.substring("sic", 1, 2))).alias("industry_group"))
    return (own.join(whole, "industry_group").select("industry_group", "ticker")
            .unionByName(prefixes.join(short, "industry_group").select("industry_group", "ticker")))


def group_labels(groups: DataFrame, companies: DataFrame) -> DataFrame:
    """Each group's size and label: its code, what it leaves out or takes in, and its commonest descriptions."""
    members = industry_members(groups)
    counts = (members.join(companies.select("ticker", F.nullif(F.trim("sic_description"), F.lit("")).alias("d")), "ticker")
              .where(F.col("d").isNotNull()).groupBy("industry_group", "d").count())
    # Descriptions per group are few (one per SIC code): the three commonest of a bounded list.
    named = counts.groupBy("industry_group").agg(
        F.slice(F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("c"), "d"))), 1, LABEL_DESCRIPTIONS).alias("top"))
    sizes = members.groupBy("industry_group").agg(F.count("*").alias("members"))
    three = groups.where(F.length("industry_group") == 3).select(F.col("industry_group").alias("g3")).distinct()
    inside = (sizes.where(F.length("industry_group") == 2)
              .join(three, F.substring("g3", 1, 2) == F.col("industry_group"))
              .groupBy("industry_group").agg(F.array_sort(F.collect_set("g3")).alias("within")))
    taken = (members.join(groups.select("ticker", F.col("industry_group").alias("own")), "ticker")
             .where(F.col("own") != F.col("industry_group")).select("industry_group").distinct()
             .withColumn("taken", F.lit(True)))
    scope = F.when(F.col("within").isNotNull(), F.concat(
        F.when(F.col("taken"), F.lit("with ")).otherwise(F.lit("outside ")), F.array_join("within", ", ")))
    code = F.when(scope.isNotNull(), F.concat(F.lit("SIC "), "industry_group", F.lit(" ("), scope, F.lit(")"))).otherwise(
        F.concat(F.lit("SIC "), "industry_group"))
    text = F.array_join(F.transform("top", lambda s: s["d"]), "; ")
    label = F.when(F.col("top").isNotNull(), F.concat(code, F.lit(": "), text)).otherwise(code)
    return (sizes.join(named, "industry_group", "left").join(inside, "industry_group", "left")
            .join(taken, "industry_group", "left").select("industry_group", "members", label.alias("label")))


def rank_industries(components: DataFrame, groups: DataFrame) -> DataFrame:
    """Decile ranks within each company's industry group, on components enough members have."""
    members = industry_members(groups)
    peers = members.join(components, "ticker")
    p = percentile_of(peers, ["industry_group", "component"], "value", lower_is_better(), "pct", "n_peers")
    own = p.join(groups.select("ticker", "industry_group"), ["ticker", "industry_group"], "left_semi")
    return _ranks(own.where(F.col("n_peers") >= MIN_INDUSTRY_PEERS), "ind_rank_", "ind_composite")


def industry_options(companies: DataFrame) -> DataFrame:
    """Every 2- and 3-digit prefix with its size and label."""
    c = companies.select(normalize_sic(F.col("sic")).alias("sic"), F.nullif(F.trim("sic_description"), F.lit("")).alias("d"))
    p = c.where(F.col("sic").isNotNull()).select(
        F.explode(F.array(F.substring("sic", 1, 3), F.substring("sic", 1, 2))).alias("prefix"), "d")
    counts = p.groupBy("prefix", "d").count()
    top = F.array_join(F.transform(F.slice(F.array_sort(F.collect_list(F.when(
        F.col("d").isNotNull(), F.struct((-F.col("count")).alias("c"), "d")))), 1, LABEL_DESCRIPTIONS), lambda s: s["d"]), "; ")
    g = counts.groupBy("prefix").agg(F.sum("count").alias("size"), top.alias("t"))
    return g.select("prefix", "size", F.when(F.col("t") != "", F.concat(F.lit("SIC "), "prefix", F.lit(": "), "t"))
                    .otherwise(F.concat(F.lit("SIC "), "prefix")).alias("label"))


def rank_all(components: DataFrame, scores: DataFrame, companies: DataFrame) -> DataFrame:
    """Universe ranks, magic-formula rank and industry ranks of every scored company."""
    groups = industry_groups(companies.join(scores.select("ticker"), "ticker", "left_semi"))
    return (scores.select("ticker").join(rank_universe(components), "ticker", "left")
            .join(magic_rank(scores).select("ticker", "magic_formula_rank"), "ticker", "left")
            .join(groups.select("ticker", "industry_group"), "ticker", "left")
            .join(rank_industries(components, groups), "ticker", "left"))
