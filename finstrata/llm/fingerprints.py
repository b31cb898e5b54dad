"""SimHash fingerprints by weighted term votes, and permuted block tables that find all fingerprints within a radius."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from finstrata.llm.common import batches_of, written
from finstrata.llm.terms import terms

BITS = 64
#: Differing bits up to which fingerprints are near.
RADIUS = 3
#: Document frequencies are counted by this many slots of the term's hash, whatever the vocabulary.
SLOTS = 1 << 18
#: Code points of texts a range partition should hold, and rows that meet in one task of a block table.
PART_CHARS, CHUNK = 1 << 26, 4096
#: Texts that a task holds at once, and terms whose hashes it remembers.
BATCH, MOST_DIGESTS = 1000, 1 << 19
#: Fingerprints that share a block key by chance, when the number of blocks is chosen.
BY_CHANCE = 64
#: Tasks over which the rows of one fingerprint are dealt when counts are joined back.
SALTS = 16


class _Digests(dict):
    """The first 8 bytes of terms' MD5; as many as MOST_DIGESTS are remembered."""

    def __missing__(self, term: bytes) -> bytes:
        if len(self) >= MOST_DIGESTS:
            self.clear()
        out = self[term] = hashlib.md5(term, usedforsecurity=False).digest()[:8]
        return out


_DIGESTS = _Digests()


def _counted(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the text's distinct terms (8 bytes each, the first 64 bits of MD5), and how often each stands there."""
    found = Counter(terms(text))
    hashes = np.frombuffer(b"".join(map(_DIGESTS.__getitem__, found)), ">u8")
    return hashes, np.fromiter(found.values(), np.int64, len(found))


def _slots(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64(SLOTS - 1)).astype(np.int64)


def fingerprint(text: str | None, weights: np.ndarray) -> int:
    """Signed 64-bit number: each term votes for its hash's one bits and against its zero bits with its occurrences
    times the weight of its slot; a bit is 1 if its votes are positive. A text without terms has 0."""
    hashes, times = _counted(text)
    if not len(hashes):
        return 0
    weight = (times * weights[_slots(hashes)]).astype(np.float64)
    votes = np.zeros(BITS)
    for i in range(0, len(hashes), 1 << 14):
        bits = np.unpackbits(hashes[i: i + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1)
        votes += weight[i: i + (1 << 14)] @ bits.astype(np.float64)
    return int.from_bytes(np.packbits(2 * votes > weight.sum()).tobytes(), "big", signed=True)


class Weights:
    """What a corpus says about terms: its number of documents and code points, and a weight per slot."""

    def __init__(self, n_docs: int, n_chars: int, df: np.ndarray):
        self.n_docs, self.n_chars = n_docs, n_chars
        self.by_slot = np.maximum(1, np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1)))).astype(np.int64)


def _slot_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    df, n, chars = np.zeros(SLOTS, np.int64), 0, 0
    for batch in batches:
        for t in batch["t"]:
            slots = np.unique(_slots(_counted(t)[0]))
            df[slots] += 1
            n += 1
            chars += len(t)
    on = np.flatnonzero(df)
    yield pd.DataFrame({"slot": np.concatenate([[-1, -2], on]), "n": np.concatenate([[n, chars], df[on]])})


def fit(docs: DataFrame, text: str = "text") -> Weights:
    """Weights from all of *docs*: 1000 ln((2 N + 2) / (2 df + 1)) rounded down, at least 1; df counts the documents
    with a term in the slot. Each task adds up its documents; SLOTS + 2 sums at most reach the driver."""
    parts = docs.select(F.coalesce(F.col(text), F.lit("")).alias("t")).mapInPandas(_slot_counts, "slot long, n long")
    with batches_of(docs.sparkSession, BATCH):
        sums = parts.groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    by = dict(zip(sums["slot"][sums["slot"] < 0], sums["n"][sums["slot"] < 0], strict=True))
    df = np.zeros(SLOTS, np.int64)
    on = sums[sums["slot"] >= 0]
    df[on["slot"].to_numpy(np.int64)] = on["n"].to_numpy(np.int64)
    return Weights(int(by.get(-1, 0)), int(by.get(-2, 0)), df)


def edited(text: str, after: str) -> str:
    """*text* with its last third (rounded down) replaced by as many code points of the beginning of *after*, or all."""
    k = len(text) // 3
    return text[: len(text) - k] + after[:k]


_ROWS = "p int, part string, doc_id long, known boolean, n_chars long, edited_sha256 string, fp long, edited_fp long, next_fp long, t string"
_COLUMNS = [c.split()[0] for c in _ROWS.split(", ")]


def _done(p: int, doc_id: int, known: bool, text: str, fp: int, after: str, after_fp: int, weights: np.ndarray) -> tuple:
    e = edited(text, after)
    return (p, "row", doc_id, known, len(text), hashlib.sha256(e.encode("utf-8", "replace")).hexdigest(), fp, fingerprint(e, weights), after_fp, None)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=_COLUMNS, dtype=object)  # numbers beside gaps must not pass through doubles
    return out.astype({c: "Int64" for c in ("doc_id", "n_chars", "fp", "edited_fp", "next_fp")})


def _in_order(shared):
    """One pass over a sorted partition. Each row is done when its successor comes; the first row's text is also sent
    ahead (``head``) and the last one's left open (``tail``), to be met across partitions."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p, weights, held = TaskContext.get().partitionId(), shared.value, None
        for batch in batches:
            rows = []
            for doc_id, known, text in zip(batch["doc_id"].tolist(), batch["known"], batch["t"], strict=True):
                fp = fingerprint(text, weights)
                if held is None:
                    rows.append((p, "head", None, None, None, None, fp, None, None, text))
                else:
                    rows.append(_done(p, *held, text, fp, weights))
                held = (doc_id, known, text, fp)
            yield _frame(rows)
        if held is not None:
            yield _frame([(p, "tail", held[0], held[1], None, None, held[3], None, None, held[2])])
    return run


def _across(shared):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            columns = [b[c].tolist() for c in ("doc_id", "known", "t", "fp", "after", "after_fp")]
            yield _frame([_done(0, *row, shared.value) for row in zip(*columns, strict=True)])
    return run


def with_edits(docs: DataFrame, weights: Weights, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fp, edited_fp, next_fp`` for each row of *docs*, in descending order of ids.

    The last third of each text is replaced by the beginning of the next row's, after the last row the first's. Null
    texts are empty; null ids come last; rows of equal id are ordered by a hash of the text. Texts are shuffled once,
    by ranges; a task keeps a batch of rows, and two texts a partition are met across partitions.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(weights.by_slot)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-weights.n_chars // PART_CHARS))
    rows = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(0)).alias("doc_id"), F.col(doc_id).isNotNull().alias("known"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    # equal rows are dealt by where they are read, so that even a third of all rows in one needn't be one range
    rows = rows.withColumn("h", F.xxhash64("t")).withColumn("at", F.monotonically_increasing_id())
    order = [F.col("known").desc(), F.col("doc_id").desc(), F.col("h"), F.col("at")]
    with batches_of(spark, BATCH):
        one = written(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "known", "t").mapInPandas(_in_order(shared), _ROWS), "fingerprint-rows")
    heads = one.where("part = 'head'")
    there = Window.orderBy("p")  # a row a partition
    follows = heads.select("p").withColumn("q", F.coalesce(F.lead("p").over(there), F.first("p").over(there.rowsBetween(Window.unboundedPreceding, Window.currentRow))))
    tails = one.where("part = 'tail'").select("p", "doc_id", "known", "t", "fp").join(follows, "p")
    met = tails.join(heads.select(F.col("p").alias("q"), F.col("t").alias("after"), F.col("fp").alias("after_fp")), "q")
    last = met.select("doc_id", "known", "t", "fp", "after", "after_fp").mapInPandas(_across(shared), _ROWS)
    return one.where("part = 'row'").unionByName(last).select(F.when(F.col("known"), F.col("doc_id")).alias("doc_id"), "n_chars", "edited_sha256", "fp", "edited_fp", "next_fp")


def block_tables(n: int, radius: int = RADIUS) -> list[list[tuple[int, int]]]:
    """The tables that find any two of *n* fingerprints within the radius: each the blocks (first bit, width) that its
    permutation moves to the front and that make its key.

    Bits fall into more blocks than may differ, so that in some table all of a key's blocks agree; into as many more as
    make equal keys rare among n rows.
    """
    for blocks in range(radius + 1, radius + 6):
        cuts = [BITS * k // blocks for k in range(blocks + 1)]
        front = blocks - radius
        if n / 2 ** (BITS * front / blocks) <= BY_CHANCE:
            break
    return [[(cuts[b], cuts[b + 1] - cuts[b]) for b in chosen] for chosen in combinations(range(blocks), front)]


def block_key(fp, table: list[tuple[int, int]]):
    """The front of the permuted fingerprint, as a column."""
    out, at = F.lit(0).cast("long"), 0
    for first, width in table:
        out = out.bitwiseOR(F.shiftleft(F.shiftrightunsigned(fp, first).bitwiseAND(F.lit((1 << width) - 1)), at))
        at += width
    return out


def _keys(fps: np.ndarray, table: list[tuple[int, int]]) -> np.ndarray:
    mask = np.uint64(sum(((1 << width) - 1) << first for first, width in table))
    return fps & mask


def _near_in_runs(rows: pd.DataFrame, tables: list, radius: int) -> pd.DataFrame:
    """``fp, near``: how many documents' fingerprints are within the radius of each, by pairs of a run that meet in no earlier table.

    Rows are compared with those 1, 2, ... places further on in their run. Rows of a chunk meet only in its own pair.
    """
    keys = rows[["tab", "key", "c1", "c2"]].to_numpy(np.int64)
    fps, n, own = rows["fp"].to_numpy(np.int64).view(np.uint64), rows["n"].to_numpy(np.int64), rows["own"].to_numpy(np.int64)
    last = np.flatnonzero(np.concatenate([(keys[1:] != keys[:-1]).any(axis=1), [True]])) + 1
    ends = np.repeat(last, np.diff(np.concatenate([[0], last])))
    near = np.zeros(len(rows), np.int64)
    at, lag = np.arange(len(rows)), 1
    while True:
        at = at[at + lag < ends[at]]
        if not len(at):
            break
        close = np.bitwise_count(fps[at] ^ fps[at + lag]) <= radius
        a = at[close & ((keys[at, 2] == keys[at, 3]) | (own[at] != own[at + lag]))]
        b = a + lag
        for t in range(int(keys[a, 0].max()) if len(a) else 0):
            first = (keys[a, 0] <= t) | (_keys(fps[a], tables[t]) != _keys(fps[b], tables[t]))
            a, b = a[first], b[first]
        np.add.at(near, a, n[b])
        np.add.at(near, b, n[a])
        lag += 1
    on = np.flatnonzero(near)
    return pd.DataFrame({"fp": fps.view(np.int64)[on], "near": near[on]})


def near_counts(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``fp, near`` for each distinct fingerprint of *prints* (``fp``; a written table) near others: the rows whose
    fingerprint differs from it, by *radius* bits or fewer.

    Each fingerprint is a row with its count in every block table; those of equal key meet. A key of over CHUNK
    fingerprints is dealt into chunks, which meet in pairs, so no task holds a whole hot key.
    """
    distinct = written(prints.groupBy("fp").agg(F.count("*").alias("n")), "fingerprints")
    tables = block_tables(distinct.count(), radius)
    keyed = distinct.withColumn("x", F.explode(F.array(*[F.struct(F.lit(t).alias("tab"), block_key(F.col("fp"), table).alias("key")) for t, table in enumerate(tables)])))
    keyed = keyed.select("x.tab", "x.key", "fp", "n")
    sizes = written(keyed.groupBy("tab", "key").agg(F.count("*").alias("m")).where("m > 1"), "block-sizes")
    chunks = F.ceil(F.col("m") / CHUNK)
    met = keyed.join(sizes, ["tab", "key"]).withColumn("own", F.pmod(F.xxhash64("fp"), chunks))
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), chunks - 1), lambda x: F.struct(F.least(x, F.col("own")).alias("c1"), F.greatest(x, F.col("own")).alias("c2")))
    met = met.withColumn("x", F.explode(pairs)).select("tab", "key", "x.c1", "x.c2", "fp", "n", "own")
    run = ["tab", "key", "c1", "c2"]

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None
        for batch in batches:
            held = batch if held is None else pd.concat([held, batch], ignore_index=True)
            open_run = (held[run] == held[run].iloc[-1]).all(axis=1).to_numpy() if len(held) else np.zeros(0, bool)
            if len(held) and not open_run.all():
                yield _near_in_runs(held[~open_run], tables, radius)
                held = held[open_run]
        if held is not None and len(held):
            yield _near_in_runs(held, tables, radius)

    found = met.repartition(*run).sortWithinPartitions(*run, "fp").mapInPandas(count, "fp long, near long")
    return found.groupBy("fp").agg(F.sum("near").alias("near")).join(distinct, "fp", "full").select("fp", (F.coalesce("near", F.lit(0)) + F.col("n") - 1).alias("near")).where("near > 0")


def likeness(a, b):
    """Share of equal bits of two fingerprints."""
    return 1 - F.bit_count(a.bitwiseXOR(b)) / F.lit(float(BITS))


def _hex(fp):
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def edited_documents(docs: DataFrame, radius: int = RADIUS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of each document and of its edited text, and how near they are.

    Columns: ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint`` (16 hex digits), ``near_edited``,
    ``near_next`` (share of bits equal to the edited text's, the next document's) and ``n_near`` (other documents with
    a fingerprint within *radius* bits). See :func:`with_edits` for order, nulls and ties. A text without terms has
    fingerprint zero; a repeated row gives a repeated row; a lone document is its own next; an empty table gives an
    empty result. Other columns are left out.
    """
    weights = fit(docs, text)
    rows = written(with_edits(docs, weights, doc_id, text), "fingerprint-edits")
    salt = F.pmod(F.xxhash64("doc_id", "n_chars"), F.lit(SALTS))
    near = near_counts(rows.select("fp"), radius).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    out = rows.withColumn("salt", salt).join(near, ["fp", "salt"], "left")
    fp, e = F.col("fp"), F.col("edited_fp")
    return out.select("doc_id", "n_chars", "edited_sha256", _hex(fp).alias("fingerprint"), _hex(e).alias("edited_fingerprint"), likeness(fp, e).alias("near_edited"),
                      likeness(fp, F.col("next_fp")).alias("near_next"), F.coalesce("near", F.lit(0)).cast("long").alias("n_near"))
