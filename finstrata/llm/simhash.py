"""Near-duplicates by SimHash fingerprints, compared as vertical bit planes with carry-save counters."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import accumulate, combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import LongType

from finstrata.llm.common import written
from finstrata.llm.components import components, local_roots

BITS, SEED = 64, 42
#: Rows of one key that are compared in one task; the rows of larger keys are dealt into chunks, and chunks met in pairs.
CHUNK = 4096
#: Rows that share a key by chance, when a key's width is chosen.
BY_CHANCE = 64
_ALL, _ONE = np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(1)


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 (seed 42) of the text's shingles in order, repeats included.

    A-Z are lower-cased and words are ``[^\\x20\\x09-\\x0D]+``; a text of fewer words is one shingle, one of none has none.
    """
    w = (text or "").encode("utf-8", "replace").lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    whole = b" ".join(w)
    if len(w) <= words:
        return np.array([xxhash.xxh64_intdigest(whole, SEED)], np.uint64)
    ends = list(accumulate(len(x) + 1 for x in w))
    h = xxhash.xxh64_intdigest
    return np.array([h(whole[a: b - 1], SEED) for a, b in zip([0, *ends], ends[words - 1:], strict=False)], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """Signed 64-bit number; a bit is 1 if it is set in over half of *hashes*. No hashes: 0."""
    counts = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 1 << 14):
        part = hashes[i: i + (1 << 14)].astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big", signed=True)


def fingerprint_of(text: Column, words: int = 3) -> Column:
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([fingerprint(shingle_hashes(t, words)) for t in batch], dtype="int64")
    return pandas_udf(of, LongType())(text)


class Planes:
    """Fingerprints of a table of rows, stored by bit: word w of plane k has bit k of rows 64 w to 64 w + 63."""

    def __init__(self, fps: np.ndarray):
        n = -(-len(fps) // 64) * 64
        rows = np.zeros((n, 8), np.uint8)
        rows[: len(fps)] = fps.astype(np.uint64).view(np.uint8).reshape(-1, 8)
        bits = np.unpackbits(rows, axis=1, bitorder="little")
        self.planes = np.ascontiguousarray(np.packbits(bits, axis=0, bitorder="little").T).view(np.uint64)
        self.own = np.ascontiguousarray((_ALL * bits[: len(fps)].T.astype(np.uint64)))

    def close(self, q: np.ndarray, w: np.ndarray, alive: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (row, row) at *radius* or fewer differing bits: row q[i] against the rows of word w[i] set in alive[i].

        Two planes at a time go through a full adder into counters of ceil(log2(radius + 1)) bits, one for each of the
        64 rows; counters begin high enough to overflow just past the radius. Words whose rows have all overflowed are
        abandoned. A radius of BITS takes every pair uncounted.
        """
        bits = max(1, int(radius).bit_length())
        begin = (1 << bits) - 1 - radius
        count = [np.full(len(q), _ALL if begin >> k & 1 else np.uint64(0)) for k in range(bits)]
        for k in range(0, BITS if radius < BITS else 0, 2):
            x = self.planes[k][w] ^ self.own[k][q]
            y = self.planes[k + 1][w] ^ self.own[k + 1][q]
            either = x ^ y
            carry = (x & y) | (count[0] & either)
            count[0] ^= either
            for c in count[1:]:
                again = c & carry
                c ^= carry
                carry = again
            alive &= ~carry
            if k % 8 == 6:
                on = np.flatnonzero(alive)
                if len(on) < 0.8 * len(alive):
                    q, w, alive, count = q[on], w[on], alive[on], [c[on] for c in count]
                    if not len(on):
                        break
        on = np.flatnonzero(alive)
        hit, bit = np.nonzero(np.unpackbits(alive[on].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
        return q[on][hit], w[on][hit] * 64 + bit


def links_in_runs(fps: np.ndarray, ends: np.ndarray, radius: int, slice_words: int = 1 << 15) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of the same run at *radius* or fewer differing bits, in slices. ends[i]: where row i's run ends."""
    planes, rows = Planes(fps), np.arange(len(fps))
    first, words = rows // 64, np.where(ends - rows > 1, (ends - 1) // 64 - rows // 64 + 1, 0)
    upto, i = np.cumsum(words), 0
    while i < len(rows):
        j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + slice_words, "right")))
        n = words[i:j]
        q = np.repeat(rows[i:j], n)
        w = first[q] + np.arange(len(q)) - np.repeat(np.cumsum(n) - n, n)
        low = np.clip(q + 1 - 64 * w, 0, 64).astype(np.uint64)
        high = np.clip(ends[q] - 64 * w, 0, 64).astype(np.uint64)
        below = lambda b: np.where(b >= 64, _ALL, (_ONE << np.minimum(b, np.uint64(63))) - _ONE)
        alive = below(high) & ~below(low)
        if len(q):
            yield planes.close(q, w, alive, radius)
        i = j


def _run_ends(keys: np.ndarray) -> np.ndarray:
    """Where each row's run of equal rows of *keys* (n x m) ends."""
    last = np.flatnonzero(np.concatenate([(keys[1:] != keys[:-1]).any(axis=1), [True]])) + 1
    return np.repeat(last, np.diff(np.concatenate([[0], last])))


KEY = ["t", "key", "c1", "c2"]


def spanning_edges(members: DataFrame, radius: int, verify: Callable | None = None, extra: list[str] | None = None) -> DataFrame:
    """Edges ``a, b`` that connect whatever links join inside the groups of *members* (``t, key, c1, c2, node, fp``).

    A link is a pair of a group with fingerprints within the radius for which *verify* (given the group's rows of
    *extra* columns) holds too, if given. Each group is whole in one task, in which it is a run of sorted rows; runs
    are handled some thousand rows at a time. Of a group's links only a spanning forest is returned.
    """
    columns = list(dict.fromkeys([*KEY, "node", "fp", *(extra or [])]))

    def edges_of(rows: pd.DataFrame) -> pd.DataFrame:
        keys, node = rows[KEY].to_numpy(np.int64), rows["node"].to_numpy(np.int64)
        ends = _run_ends(keys)
        root = np.arange(len(rows))
        own = [rows[c].to_numpy() for c in extra or []]
        for a, b in links_in_runs(rows["fp"].to_numpy(np.int64), ends, radius):
            root = verify(root, a, b, *own) if verify else local_roots(len(rows), a, b, root)
        on = np.flatnonzero(root != np.arange(len(rows)))
        return pd.DataFrame({"a": node[root[on]], "b": node[on]}).drop_duplicates()

    def edges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            if not len(batch):
                continue
            held.append(batch)
            if (held[0][KEY].iloc[0] == batch[KEY].iloc[-1]).all():
                continue  # still one run
            rows = pd.concat(held, ignore_index=True)
            keys = rows[KEY].to_numpy(np.int64)
            cut = int(np.flatnonzero((keys != keys[-1]).any(axis=1))[-1]) + 1
            yield edges_of(rows.iloc[:cut])
            held = [rows.iloc[cut:]]
        if held:
            yield edges_of(pd.concat(held, ignore_index=True))

    return members.select(columns).repartition(*KEY).sortWithinPartitions(*KEY, "node").mapInPandas(edges, "a long, b long")


def in_chunks(keyed: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """*keyed* (``t, key, node``) without keys that one node has, and with ``c1, c2``: the pair of chunks that meet.

    A key of more than *chunk* nodes is dealt into chunks by the node's hash, each node sent to every pair that its
    chunk is in. The counts of keys are combined before their shuffle and written, so that a small table of them is broadcast and a
    large one joined with splitting of hot keys.
    """
    counts = written(keyed.groupBy("t", "key").agg(F.count("*").alias("n")).where(F.col("n") > 1), "key-counts")
    chunks = F.ceil(F.col("n") / chunk)
    own = F.pmod(F.xxhash64("node"), chunks)
    pairs = F.transform(F.sequence(F.lit(0), chunks - 1), lambda x: F.struct(F.least(x, own).alias("c1"), F.greatest(x, own).alias("c2")))
    rows = keyed.join(counts, ["t", "key"]).withColumn("pair", F.explode(pairs)).select("*", "pair.c1", "pair.c2").drop("pair", "n")
    return rows


def masks(n: int, radius: int) -> list[int]:
    """Masks of which one at least covers equal bits of any two of *n* fingerprints within the radius.

    The bits fall into blocks; radius + 1 or more of them, so that some blocks agree, and as many more as make equal
    bits rare among n rows.
    """
    for blocks in range(radius + 1, radius + 6):
        cuts = [BITS * k // blocks for k in range(blocks + 1)]
        parts = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:], strict=False)]
        agreeing = blocks - radius
        if n / 2 ** (BITS * agreeing / blocks) <= BY_CHANCE:
            break
    return [sum(c) for c in combinations(parts, agreeing)]


def _long(u: int) -> int:
    return u - (1 << 64) if u >> 63 else u


def fingerprint_components(prints: DataFrame, radius: int = 3) -> DataFrame:
    """``fp, component_id``: for each distinct fingerprint of *prints* (``doc_id, fp``) the smallest doc_id that links
    at *radius* or fewer differing bits lead to. *prints* should be a written table.

    Equal fingerprints are one node. Nodes that agree on a mask meet; only there are distances counted.
    """
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "fingerprints")
    tables = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_long(m))).alias("key")) for t, m in enumerate(masks(nodes.count(), radius))])
    keyed = nodes.select(F.explode(tables).alias("x"), F.col("fp").alias("node"), "fp").select("x.t", "x.key", "node", "fp")
    roots = written(components(spanning_edges(in_chunks(keyed), radius)), "simhash-roots")
    firsts = roots.join(nodes, roots["node"] == nodes["fp"]).groupBy("root").agg(F.min("first").alias("component"))
    linked = roots.join(firsts, "root").select(F.col("node").alias("fp"), "component")
    return nodes.join(linked, "fp", "left").select("fp", F.coalesce("component", "first").alias("component_id"))


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, fingerprint`` (16 hex digits) and ``component_id`` (smallest doc_id that links lead to) for each row.

    Shingles of *words* words; null and empty texts have fingerprint zero, which links like any other. Repeated rows
    give repeated rows; null ids count as greater than all others, a component of them alone has a null id. Other columns are left out; an
    empty table gives an empty result.
    """
    prints = written(docs.select(F.col(doc_id).alias("doc_id"), fingerprint_of(F.col(text), words).alias("fp")), "simhash")
    found = fingerprint_components(prints, radius)
    return prints.join(found, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
