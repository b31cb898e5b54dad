"""Benchmark decontamination: rare n-gram seeds find test items in training documents, alignment scores edited copies."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finstrata.llm.common import written
from finstrata.llm.wordhash import gram_hashes, pick_hashes, token_hashes

#: Words of a seed; of each SPREAD seeds in a row of an item the rarest in the corpus serves. Seeds with a gap before the
#: last word (words 1, 2, 3 and 5) all serve.
SEED_WORDS, SPREAD, GAPPED = 4, 2, (0, 1, 2, 4)
#: Share of an item's words that alignments must score, the words each must score of any item that long, and the words that suffice of an item of any length.
SCORE, LEAST_WORDS, ENOUGH_WORDS = 0.4, 8, 30
MATCH, MISMATCH, GAP = 1.0, -1.0, -1.0
#: Benchmarks are looked up in parts of at most this many words (8 bytes each) in every task.
PART_WORDS = 4_000_000

FOUND = "doc_id long, item_id long, score double, matched int, first_word long, last_word long"


def align(item: np.ndarray, passage: np.ndarray) -> tuple[float, int, int]:
    """Smith-Waterman over word hashes: best local score, and the passage's first and last aligned word (-1 if none).

    A row of the table at a time; a gap inside the row is a running maximum.
    """
    n = len(passage)
    if not len(item) or not n:
        return 0.0, -1, -1
    ramp = GAP * np.arange(n)
    above, begun = np.zeros(n + 1), np.arange(n + 1)
    best, first, last = 0.0, -1, -1
    for word in item:
        score = np.where(passage == word, MATCH, MISMATCH)
        diagonal, up = above[:-1] + score, above[1:] + GAP
        row = np.maximum(np.maximum(diagonal, up), 0)
        start = np.where(row == diagonal, begun[:-1], begun[1:])
        start = np.where(row == 0, np.arange(n) + 1, start)
        lifted = row - ramp
        top = np.maximum.accumulate(lifted)
        source = np.maximum.accumulate(np.where(lifted == top, np.arange(n), 0))
        row, start = top + ramp, start[source]
        above = np.concatenate([[0.0], row])
        begun = np.concatenate([[0], start])
        k = int(row.argmax())
        if row[k] > best:
            best, first, last = float(row[k]), int(start[k]), k
    return best, first, last


def seeds_of(words: np.ndarray, n: int) -> list[np.ndarray]:
    """Hashes of the runs of *n* words and, of full seeds, of those with a gap, by the word they begin at.

    Both hash the words alone, so a run also meets a gap: there a word was left out or put in.
    """
    return [gram_hashes(words, n)] + ([pick_hashes(words, GAPPED)] if n == SEED_WORDS else [])


class Items:
    """Test items as word hashes, and the seeds that point at them."""

    def __init__(self, ids: list[int], texts: list[str]):
        self.ids = ids
        self.words = [token_hashes([t])[0] for t in texts]
        self.grams = [seeds_of(w, min(SEED_WORDS, max(len(w), 1))) for w in self.words]

    def all_grams(self, words: int) -> np.ndarray:
        parts = [g for own, w in zip(self.grams, self.words, strict=True) if min(SEED_WORDS, len(w)) == words for g in own]
        return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)

    def seeds(self, spread: dict[int, int]) -> dict[int, list[tuple[int, int]]]:
        """hash -> (item, word) of the seeds that serve, by how many documents have each n-gram."""
        out: dict[int, list[tuple[int, int]]] = {}
        for i, (grams, *gapped) in enumerate(self.grams):
            g = grams.tolist()
            serve = {min(range(k, min(k + SPREAD, len(g))), key=lambda j: (spread.get(g[j], 0), g[j])) for k in range(max(len(g) - SPREAD + 1, min(len(g), 1)))}
            for k in serve:
                out.setdefault(g[k], []).append((i, k))
            for k, h in enumerate(gapped[0].tolist() if gapped else ()):
                out.setdefault(h, []).append((i, k))
        return out


class Members:
    """Membership in a sorted set of hashes: a bitmap of their low bits first, then a binary search."""

    def __init__(self, sorted_hashes: np.ndarray):
        self.all = sorted_hashes
        self.bits = np.uint64((1 << max(12, int(len(sorted_hashes)).bit_length() + 5)) - 1)
        self.map = np.zeros(int(self.bits) + 1, bool)
        self.map[sorted_hashes & self.bits] = True

    def where(self, hashes: np.ndarray) -> np.ndarray:
        """Places of *hashes* that are in the set."""
        at = np.flatnonzero(self.map[hashes & self.bits])
        if not len(at) or not len(self.all):
            return at[:0]
        own = hashes[at]
        return at[self.all[np.minimum(np.searchsorted(self.all, own), len(self.all) - 1)] == own]


def _signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def bar(words: int, threshold: float) -> float:
    """The score, in words, from which a document holds an item of so many *words*."""
    return min(max(threshold * words, min(LEAST_WORDS, words)), max(ENOUGH_WORDS, LEAST_WORDS))


def places(item: np.ndarray, words: np.ndarray, spans: list[list[int]], least: float) -> Iterator[tuple[float, int, int]]:
    """(score, first, last word) of the places in *spans* of *words* that align with *item*, best first, down to *least*.

    Places share no word of the item: what one has aligned is taken out of it for the next.
    """
    left, taken = item.copy(), 0
    nothing = words.max() + np.uint64(1) if len(words) else np.uint64(0)  # equals no word
    heap = [(-float(len(item)), lo, hi, -1, 0, 0) for lo, hi in spans]  # a score is an upper bound until it is of this *taken*
    heapq.heapify(heap)
    while heap:
        score, lo, hi, of, first, last = heapq.heappop(heap)
        if of != taken:
            score, first, last = align(left, words[lo:hi])
            if score >= least:
                heapq.heappush(heap, (-score, lo, hi, taken, first, last))
            continue
        yield -score, lo + first, lo + last
        _, a, b = align(words[lo + first: lo + last + 1], left)
        left[a: b + 1] = nothing
        taken += 1
        for x, y in ((lo, lo + first), (lo + last + 1, hi)):
            if y - x >= least:
                heapq.heappush(heap, (score, x, y, -1, 0, 0))


def _passages(items: Items, seeds: dict, keys: Members, words: np.ndarray, threshold: float) -> list[tuple]:
    """(item, score, matched words, first, last word) of the items that *words* holds: the best place of each, or if that isn't enough, all its places."""
    at: dict[int, set[int]] = {}  # item -> where it would begin
    for n in {min(SEED_WORDS, len(w)) for w in items.words if len(w)}:
        for grams in seeds_of(words, n):
            for k in keys.where(grams):
                for i, j in seeds.get(int(grams[k]), ()):
                    if min(SEED_WORDS, len(items.words[i])) == n:
                        at.setdefault(i, set()).add(int(k) - j)
    out = []
    for i, hits in at.items():
        item = items.words[i]
        slack = len(item) // 2 + 2
        spans: list[list[int]] = []
        for begin in sorted(hits):
            lo, hi = max(0, begin - slack), min(len(words), begin + len(item) + slack)
            if spans and lo <= spans[-1][1] and spans[-1][1] - spans[-1][0] < 8 * len(item) + 64:
                spans[-1][1] = max(spans[-1][1], hi)
            else:
                spans.append([lo, hi])
        enough = bar(len(item), threshold)
        score, first, last = 0.0, len(words), -1
        for got, a, b in places(item, words, spans, min(LEAST_WORDS, len(item))):
            score, first, last = score + got, min(first, a), max(last, b)
            if score >= enough:
                out.append((items.ids[i], score / len(item), int(round(score)), first, last))
                break
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = SCORE, doc_id: str = "doc_id", text: str = "text",
                 item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """A row for each document and test item it holds: ``doc_id, item_id, score`` (alignment over the item's words, 1 for
    an exact copy), ``matched`` (alignment score in words) and the passage's ``first_word`` and ``last_word``.

    A word aligned alike counts 1, one changed, left out or put in -1. Local alignments must reach *threshold* of the
    item's words, or ENOUGH_WORDS of an item of any length; each of them LEAST_WORDS, or the whole of a shorter item.
    The best alignment is told if it is enough, else the best ones together until they are: their sum, and the first
    and last word of them all. They share no word of the item, so a passage that is repeated counts once.

    Words are runs of letters, marks and digits, lower-cased; in scripts without spaces every character is one. Of each
    two seeds in a row of an item, the one in the fewest documents serves, however frequent it is, so any copied stretch
    of five words is found; seeds with a gap find copies of which every fourth word is changed, left out or added to. The benchmark is looked up
    inside the tasks that read the documents, in parts of bounded size, so no document is shuffled. The documents that
    hold any n-gram of the benchmark are kept for the second step.

    Null and empty texts on either side find nothing; items shorter than a seed are one seed. Repeated documents and
    repeated items give a row each; null ids stay null. Other columns are left out.
    """
    rows = benchmark.select(F.col(item_id).cast("long").alias("i"), F.coalesce(item_text, F.lit("")).alias("t")).where(F.col("t") != "")
    out = None
    for part in _parts(rows):
        found = _contaminated_by(part, docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(text, F.lit("")).alias("text")), threshold)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], FOUND)


def _parts(rows: DataFrame) -> Iterator[Items]:
    """The benchmark in parts of at most about PART_WORDS words, read one row at a time."""
    ids, texts, size = [], [], 0
    for r in rows.orderBy("i", "t").toLocalIterator():
        ids.append(r["i"])
        texts.append(r["t"])
        size += len(token_hashes([r["t"]])[0])
        if size >= PART_WORDS:
            yield Items(ids, texts)
            ids, texts, size = [], [], 0
    if ids:
        yield Items(ids, texts)


def _contaminated_by(items: Items, docs: DataFrame, threshold: float) -> DataFrame:
    spark = docs.sparkSession
    known = {n: Members(g) for n in range(1, SEED_WORDS + 1) if len(g := items.all_grams(n))}

    def hits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            kept, grams = [], []
            for k, words in enumerate(token_hashes(batch["text"].tolist())):
                own = [g[table.where(g)] for n, table in known.items() for g in seeds_of(words, n)]
                own = np.unique(np.concatenate(own)) if own else np.zeros(0, np.uint64)
                if len(own):
                    kept.append(k)
                    grams.append(_signed(own).tolist())
            near = batch.iloc[kept]
            yield near.assign(grams=pd.Series(grams, index=near.index, dtype=object))

    near = written(docs.mapInPandas(hits, "doc_id long, text string, grams array<long>"), "decontam-hits")
    counts = near.select(F.explode("grams").alias("g")).groupBy("g").agg(F.count("*").alias("n")).collect()  # at most one row for each n-gram of the part
    seeds = items.seeds({r["g"] % (1 << 64): r["n"] for r in counts})
    keys = Members(np.array(sorted(seeds), np.uint64))
    shared = spark.sparkContext.broadcast((items, seeds, keys))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, by_hash, wanted = shared.value
        for batch in batches:
            out = [(d, *p) for d, words in zip(batch["doc_id"], token_hashes(batch["text"].tolist()), strict=True) for p in _passages(part, by_hash, wanted, words, threshold)]
            yield pd.DataFrame(out, columns=["doc_id", "item_id", "score", "matched", "first_word", "last_word"]).astype({"doc_id": "Int64", "item_id": "Int64"})

    return near.select("doc_id", "text").mapInPandas(score, FOUND)


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = SCORE) -> DataFrame:
    """The rows of *docs* (``doc_id``, ``text`` and any others) whose text holds no test item; the decision is the text's, so null ids and copies need no join key but it."""
    key = F.xxhash64(F.coalesce("text", F.lit("")))
    bad = written(contaminated(docs.select(key.alias("k"), "text"), benchmark, threshold, doc_id="k").select(F.col("doc_id").alias("_k")).distinct(), "decontam-bad")
    return docs.withColumn("_h", key).join(bad, F.col("_h") == F.col("_k"), "left_anti").drop("_h")
