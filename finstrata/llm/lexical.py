"""Ranked lexical search: documents' impact vectors in buckets of like length, pruned by Cauchy-Schwarz and by coordinates."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from finstrata.llm.common import batches_of, written
from finstrata.llm.terms import terms

#: Documents of a bucket, of the longest ones scored first for all, and of a range partition.
BUCKET, SEED, PART_ROWS = 2048, 1024, 1 << 18
#: Texts that a task holds at once.
BATCH = 1000
#: Rows (item, term) of the items that are searched together; more items are searched in blocks.
BLOCK_TERMS = 1 << 20
#: By how much bounds in floating point are widened; scores themselves are integers.
SLACK = 1 + 1e-9


def _query_terms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = [(i if known else None, k, t.decode(), n) for i, known, k, text in zip(b["item_id"].tolist(), b["known"], b["item"], b["text"], strict=True) for t, n in Counter(terms(text)).items()]
        yield pd.DataFrame(rows, columns=["item_id", "item", "term", "n"], dtype=object).astype({"item_id": "Int64", "n": "int64"})


class Items:
    """A block of items as sparse vectors over the terms that any of them has."""

    def __init__(self, rows: pd.DataFrame):
        rows = rows.sort_values(["item", "term"], kind="stable")
        self.terms = sorted(set(rows["term"]))
        at = {t: i for i, t in enumerate(self.terms)}
        self.ids = rows["term"].map(at).to_numpy(np.int64)
        self.counts = rows["n"].to_numpy(np.int64)
        firsts = np.flatnonzero(~rows["item"].duplicated().to_numpy())
        self.bounds = np.append(firsts, len(rows))
        self.item_ids = [None if pd.isna(x) else int(x) for x in rows["item_id"].iloc[firsts]]


def _vectors(shared):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = {t.encode(): i for i, t in enumerate(shared.value)}
        for b in batches:
            n, ids, times = [], [], []
            for text in b["t"]:
                found = Counter(terms(text))
                n.append(sum(found.values()))
                own = sorted((at[t], c) for t, c in found.items() if t in at)
                ids.append(np.array([i for i, _ in own], np.int32))
                times.append(np.array([c for _, c in own], np.int64))
            yield pd.DataFrame({"doc_id": b["doc_id"], "known": b["known"], "n": n, "ids": ids, "times": times})
    return run


def term_weights(df: np.ndarray, n_docs: int) -> np.ndarray:
    """1000 ln((2 N + 2) / (2 df + 1)) rounded down."""
    return np.floor(1000 * np.log((2.0 * n_docs + 2) / (2.0 * df + 1))).astype(np.int64)


def _impacts(n_docs: int, total: int):
    """Of each document's terms, what a weight is multiplied by; and the vector's length."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            sizes = b["ids"].map(len).to_numpy()
            times = np.concatenate(b["times"].to_numpy()).astype(np.int64)
            m = 25 + (75 * b["n"].to_numpy(np.int64) * n_docs) // total
            impact = (1_000_000_000 * times) // (1000 * times + 8 * np.repeat(m, sizes))
            cuts = np.cumsum(sizes)
            norm = np.sqrt(np.add.reduceat(impact.astype(np.float64) ** 2, cuts - sizes))
            yield pd.DataFrame({"doc_id": b["doc_id"], "known": b["known"], "row": b["row"], "norm": norm, "ids": b["ids"], "impacts": np.split(impact.astype(np.int32), cuts[:-1])})
    return run


class Bucket:
    """Documents whose vectors are at most as long as the first one's, with postings by term."""

    def __init__(self, doc_ids: np.ndarray, known: np.ndarray, norms: np.ndarray, ids: list, impacts: list):
        self.doc_ids, self.known, self.norms = doc_ids, known, norms
        self.sizes = np.array([len(x) for x in ids])
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.ids = np.concatenate(ids).astype(np.int64)
        self.impacts = np.concatenate(impacts).astype(np.int64)
        order = np.argsort(self.ids, kind="stable")
        self.by_term = self.ids[order]
        self.docs = np.repeat(np.arange(len(ids)), self.sizes)[order]
        self.weight = self.impacts[order].astype(np.float64)

    def postings(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the postings of the terms *wanted*, and for each which of them it is of."""
        first, end = np.searchsorted(self.by_term, wanted), np.searchsorted(self.by_term, wanted, "right")
        n = end - first
        return np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum()), np.repeat(np.arange(len(wanted)), n)

    def score(self, rows: np.ndarray, dense: np.ndarray) -> np.ndarray:
        """The exact integer products of some rows with a vector given for every term."""
        n = self.sizes[rows]
        at = np.repeat(self.starts[rows] - np.cumsum(n) + n, n) + np.arange(n.sum())
        return np.add.reduceat(dense[self.ids[at]] * self.impacts[at], np.cumsum(n) - n) if len(rows) else np.zeros(0, np.int64)


class Search:
    """The best documents so far of each item, and what it takes to be among them."""

    def __init__(self, items: Items, weights: np.ndarray, k: int, least: np.ndarray | None = None):
        self.items, self.k = items, k
        q = len(items.item_ids)
        self.least = np.zeros(q, np.int64) if least is None else least.copy()
        self.best = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))] * q
        self.dense = np.zeros(len(weights), np.int64)
        self.vectors = []
        for i in range(q):
            own = slice(items.bounds[i], items.bounds[i + 1])
            ids, w = items.ids[own], items.counts[own] * weights[items.ids[own]]
            order = np.argsort(-w, kind="stable")
            ids, w = ids[order], w[order]
            # rest[j]: length of what the first j coordinates leave
            rest = np.sqrt(np.append(np.cumsum((w.astype(np.float64) ** 2)[::-1])[::-1], 0.0))
            self.vectors.append((ids, w, rest))

    def over(self, bucket: Bucket) -> None:
        longest = float(bucket.norms[0])
        for i, (ids, w, rest) in enumerate(self.vectors):
            least = float(self.least[i])
            if not len(ids) or rest[0] * longest * SLACK < least:
                continue  # Cauchy-Schwarz: no vector of this length reaches it
            # coordinates enough that a document with none of them can't reach it
            focus = int(np.argmax(rest * longest * SLACK < max(least, 1.0)))
            at, which = bucket.postings(ids[:focus])
            docs, impact = bucket.docs[at], bucket.weight[at]
            part = np.bincount(docs, w[which] * impact, len(bucket.norms))
            seen = np.bincount(docs, impact * impact, len(bucket.norms))
            # known products, and Cauchy-Schwarz for the coordinates that are left
            bound = (part + rest[focus] * np.sqrt(np.maximum(bucket.norms ** 2 - seen, 0) + 1e-9 * seen)) * SLACK
            rows = np.flatnonzero((seen > 0) & (bound >= max(least, 1.0)))
            self.dense[ids] = w
            score = bucket.score(rows, self.dense)
            self.dense[ids] = 0
            self.add(i, score, bucket.doc_ids[rows], bucket.known[rows])

    def add(self, i: int, score: np.ndarray, doc: np.ndarray, known: np.ndarray) -> None:
        on = score >= max(int(self.least[i]), 1)
        if not on.any():
            return
        s, d, n = (np.concatenate([a, b[on]]) for a, b in zip(self.best[i], (score, doc, known), strict=True))
        order = np.lexsort((d, ~n, -s))[: self.k]
        self.best[i] = s[order], d[order], n[order]
        if len(order) == self.k:
            self.least[i] = max(self.least[i], s[order[-1]])

    def rows(self) -> pd.DataFrame:
        out = [(i, d if n else None, s) for i, (ss, dd, nn) in enumerate(self.best) for s, d, n in zip(ss.tolist(), dd.tolist(), nn.tolist(), strict=True)]
        return pd.DataFrame(out, columns=["item", "doc_id", "score"], dtype=object).astype("Int64")


def _search(shared, k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        items, weights, least = shared.value
        search = Search(items, weights, k, least)
        for b in batches:
            for i in range(0, len(b), BUCKET):
                part = b.iloc[i: i + BUCKET]
                search.over(Bucket(part["doc_id"].to_numpy(np.int64), part["known"].to_numpy(bool), part["norm"].to_numpy(np.float64), list(part["ids"]), list(part["impacts"])))
        yield search.rows()
    return run


_FOUND = "item long, doc_id long, score long"


def _block(docs: DataFrame, rows: pd.DataFrame, k: int) -> DataFrame:
    """The *k* best documents of each item of a block."""
    spark = docs.sparkSession
    items = Items(rows)
    vocabulary = spark.sparkContext.broadcast(items.terms)
    with batches_of(spark, BATCH):
        vectors = written(docs.mapInPandas(_vectors(vocabulary), "doc_id long, known boolean, n long, ids array<int>, times array<long>").withColumn("row", F.monotonically_increasing_id()), "search-terms")
    of_all = vectors.where("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    n_docs, total = int(of_all[0]), max(int(of_all[1]), 1)
    counts = vectors.select(F.explode("ids").alias("id")).groupBy("id").agg(F.count("*").alias("df")).toPandas()  # a row a term of the block at most
    df = np.zeros(len(items.terms), np.int64)
    df[counts["id"].to_numpy(np.int64)] = counts["df"].to_numpy(np.int64)
    weights = term_weights(df, n_docs)
    impacts = vectors.where(F.size("ids") > 0).mapInPandas(_impacts(n_docs, total), "doc_id long, known boolean, row long, norm double, ids array<int>, impacts array<int>").where("norm > 0")
    impacts = written(impacts, "search-impacts")
    longest_first = [F.col("norm").desc(), F.col("doc_id"), F.col("row")]
    wanted = ["doc_id", "known", "norm", "ids", "impacts"]
    # the longest documents of all give each item a score that k of them reach
    seed = impacts.orderBy(*longest_first).limit(SEED).select(wanted).mapInPandas(_search(spark.sparkContext.broadcast((items, weights, None)), k), _FOUND)
    reached = seed.groupBy("item").agg(F.count("*").alias("n"), F.min("score").alias("score")).where(F.col("n") == k).toPandas()
    least = np.zeros(len(items.item_ids), np.int64)
    least[reached["item"].to_numpy(np.int64)] = reached["score"].to_numpy(np.int64)
    shared = spark.sparkContext.broadcast((items, weights, least))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_docs // PART_ROWS))
    found = impacts.repartitionByRange(parts, *longest_first).sortWithinPartitions(*longest_first).select(wanted).mapInPandas(_search(shared, k), _FOUND)
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    names = spark.createDataFrame([(i, x) for i, x in enumerate(items.item_ids)], "item long, item_id long")
    return ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = 10, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``item_id, rank, doc_id, score``: for each of *items* the *k* documents of highest score above 0, from rank 1.

    Of N documents with a term and L terms in all, one with n terms has m = 25 + (75 n N) div L; a term of weight
    w = 1000 ln((2 N + 2) / (2 df + 1)), rounded down, that stands tf times in it adds w ((10^9 tf) div (1000 tf + 8 m))
    for each time it stands in the item. Equal scores are in order of doc_id, null last.

    Documents become vectors over the items' terms and are dealt by length, longest first; in each bucket items whose
    length times the bucket's can't reach their k-th score are passed by, others look only at documents with one of
    the coordinates without which it can't be reached, and only those whose bound reaches it are scored, in integers.
    Of many items, blocks of some BLOCK_TERMS terms are searched one after another; a block and its terms' counts are
    all the driver holds. Items equal in id and text are one; of items without terms, or texts null, there are no
    rows. A repeated document is ranked each time. Empty tables give an empty result; other columns are left out.
    """
    spark = docs.sparkSession
    texts = items.select(F.col(item_id).cast("long").alias("item_id"), F.coalesce(F.col(item_text), F.lit("")).alias("text")).distinct()
    known = texts.withColumn("item", F.sha2(F.concat_ws(":", F.coalesce(F.col("item_id").cast("string"), F.lit("-")), "text"), 256)).withColumn("known", F.col("item_id").isNotNull())
    asked = written(known.withColumn("item_id", F.coalesce("item_id", F.lit(0))).mapInPandas(_query_terms, "item_id long, item string, term string, n long"), "search-items")
    blocks = -(-asked.count() // BLOCK_TERMS)
    corpus = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(0)).alias("doc_id"), F.col(doc_id).isNotNull().alias("known"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    found = None
    for i in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == i).withColumn("item_id", F.col("item_id").cast("string")).toPandas()
        if len(rows):
            one = _block(corpus, rows, k)
            found = one if found is None else found.unionByName(one)
    return found if found is not None else spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
