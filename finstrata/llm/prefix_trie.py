"""The trie of conversations' prefixes, from sorted neighbours' common prefixes by union-find, partition by partition."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from finstrata.llm.common import written

#: Bytes of a turn's digest; a conversation's key is its turns' digests one after another.
DIGEST = 16
#: Turns a range partition should hold, and ids of one sequence that are joined to one text before hashing.
PART_TURNS, IDS = 1 << 19, 1 << 14
#: Most turns that a rebuilt conversation takes from another, and how far apart the others are.
MOST_TAKEN, EVERY = 5, 100
NO_IDS = hashlib.sha256(b"").hexdigest()


def conversations(turns: DataFrame) -> DataFrame:
    """``conv_id, turns``: each conversation's turns in order, as an array of (digest, n_chars).

    Turns are ordered by ``turn`` (null first), ties by role and a digest of the text; null roles and texts are empty.
    Rows without a conv_id belong to no conversation. A conversation is one row of some 40 bytes a turn.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    one = F.struct(F.col("turn").isNotNull().alias("a"), F.col("turn").alias("b"), role.alias("c"), F.md5(text).alias("d"),
                   F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)).alias("digest"), F.length(text).alias("n"))
    made = turns.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), one.alias("t"))
    made = made.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    return made.select("conv_id", F.transform("ts", lambda t: F.struct(t["digest"].alias("digest"), t["n"].alias("n"))).alias("turns"))


def rebuilt(convs: DataFrame) -> DataFrame:
    """*convs* with the first h turns of the conversation at the hundred below in place of their own; h: CRC-32 of the id, modulo 6."""
    heads = convs.where(F.col("conv_id") % EVERY == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, MOST_TAKEN).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (MOST_TAKEN + 1)).cast("int")
    joined = convs.withColumn("h", h).withColumn("base", F.col("conv_id") - F.col("conv_id") % EVERY).join(heads, "base", "left")
    taken = F.coalesce(F.slice("head", F.lit(1), F.col("h")), F.slice("turns", 1, 0))
    return joined.select("conv_id", F.concat(taken, F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1)))).alias("turns"))


def _id_texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Runs of equal sequences in order, as texts of comma-joined ids."""
    key, ids = None, []

    def row():
        return (key, ids[0], len(ids), ",".join(map(str, ids)))
    for b in batches:
        out = []
        for k, c in zip(b["k"], b["conv_id"].tolist(), strict=True):
            if ids and (k != key or len(ids) == IDS):
                out.append(row())
                ids = []
            key = k
            ids.append(c)
        yield pd.DataFrame(out, columns=["k", "first", "n", "t"])
    if ids:
        yield pd.DataFrame([row()], columns=["k", "first", "n", "t"])


def _hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["k", "least", "n", "ends"]
    key, least, n, h = None, 0, 0, None
    for b in batches:
        out = []
        for k, first, m, t in zip(b["k"], b["first"].tolist(), b["n"].tolist(), b["t"], strict=True):
            if k != key:
                if h is not None:
                    out.append((key, least, n, h.hexdigest()))
                key, least, n, h = k, first, 0, hashlib.sha256()
            else:
                h.update(b",")
            h.update(t.encode())
            n += m
        yield pd.DataFrame(out, columns=columns)
    if h is not None:
        yield pd.DataFrame([(key, least, n, h.hexdigest())], columns=columns)


def members(keyed: DataFrame, parts: int) -> DataFrame:
    """``k, least, n, ends`` for each k of *keyed* (``k, conv_id``): the smallest id, how many, and the SHA-256 of all in order.

    Ids are sorted over all machines and joined to texts there, so that the task that must hash a hot key's ids one
    after another reads one row for IDS of them.
    """
    texts = keyed.repartitionByRange(parts, "k", "conv_id").sortWithinPartitions("k", "conv_id").mapInPandas(_id_texts, "k string, first long, n long, t string")
    return texts.repartition(parts, "k").sortWithinPartitions("k", "first").mapInPandas(_hashed, "k string, least long, n long, ends string")


def _common(a: bytes, b: bytes) -> int:
    """Turns that two keys begin with alike."""
    n = min(len(a), len(b)) // DIGEST
    if not n:
        return 0
    x, y = (np.frombuffer(k, np.uint64, 2 * n).reshape(-1, 2) for k in (a, b))
    differ = (x != y).any(axis=1)
    at = int(differ.argmax())
    return at if differ[at] else n


def common_turns(a: Column, b: Column) -> Column:
    """Turns that two columns of keys begin with alike."""
    def of(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([_common(i, j) for i, j in zip(x, y, strict=True)], dtype="int64")
    return pandas_udf(of, "long")(a, b)


class Forest:
    """The prefixes of a sorted partition's distinct sequences, as chains between branching nodes.

    *before* and *after* are the turns that the first sequence shares with the one before it in another partition, and
    the last one with the one after it (-1: none). Prefixes that short on either's path are open: other partitions
    have members of them too. What is added up here for open nodes is this partition's share: members, leaves, children
    and turns first met here, so that shares only need adding.
    """

    def __init__(self, keys: list[bytes], chars: list[np.ndarray], n: list[int], least: list[int], ends: list[str], before: int, after: int):
        m = len(keys)
        self.keys, self.before, self.after, self.last = keys, before, after, m - 1
        self.end_of = ends
        self.cum = [np.concatenate([[0], np.cumsum(c, dtype=np.int64)]) for c in chars]
        self.root = list(range(m))
        self.top = [len(k) // DIGEST for k in keys]
        self.n, self.least, self.lo, self.hi = list(n), list(least), list(range(m)), list(range(m))
        # below a component's top: members' turns, turns first met here, leaves, children; the sequence that ends at the top
        self.spoken, self.fresh, self.leaves, self.children, self.ended = [0] * m, [0] * m, [0] * m, [0] * m, list(range(m))
        self.waiting: list[list[int]] = [[] for _ in range(m)]
        self.chains: list[tuple] = []
        self.parents: list[int] = []
        shared = [_common(a, b) for a, b in zip(keys, keys[1:], strict=False)]
        for i in sorted(range(m - 1), key=lambda i: -shared[i]):
            self._merge(self._find(i), self._find(i + 1), shared[i])
        self._close(self._find(0), -1)

    def _find(self, i: int) -> int:
        root = self.root
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def _met_before(self, c: int, depth: int) -> bool:
        return self.lo[c] == 0 and depth <= self.before

    def _close(self, c: int, depth: int) -> tuple[int, int, int, int]:
        """The component's chain from its top to just below *depth*; what it adds to the node at *depth*."""
        top, cum, n = self.top[c], self.cum[self.lo[c]], self.n[c]
        if not self.children[c] and not (self.hi[c] == self.last and top == self.after):
            self.leaves[c] = 1
        if top:
            own = int(cum[top] - cum[top - 1])
            self.spoken[c] += n * own
            self.fresh[c] += 0 if self._met_before(c, top) else own
        above = max(top - 1, 0)
        at = len(self.chains)
        self.chains.append((self.lo[c], self.hi[c], top, depth + 1, n, self.least[c], self.children[c], self.leaves[c], self.spoken[c], self.fresh[c], self.ended[c]))
        self.parents.append(-1)
        for child in self.waiting[c]:
            self.parents[child] = at
        if depth < 0:
            return 0, 0, 0, 0
        low = max(depth, min(self.before, above)) if self.lo[c] == 0 else depth
        self.waiting[c] = [at]
        return int(self.spoken[c] + n * (cum[above] - cum[min(depth, above)])), int(self.fresh[c] + cum[above] - cum[min(low, above)]), self.leaves[c], 0 if self._met_before(c, depth + 1) else 1

    def _merge(self, a: int, b: int, depth: int) -> None:
        """Joins components *a* and *b* in a node at *depth*, which one or both may have for a top already."""
        for c in (a, b):
            if self.top[c] > depth:
                self.spoken[c], self.fresh[c], self.leaves[c], self.children[c] = self._close(c, depth)
                self.top[c], self.ended[c] = depth, -1
        if len(self.waiting[a]) < len(self.waiting[b]):
            self.waiting[a], self.waiting[b] = self.waiting[b], self.waiting[a]
        self.waiting[a] += self.waiting[b]
        self.waiting[b] = []
        self.root[b] = a
        for of in (self.n, self.spoken, self.fresh, self.leaves, self.children):
            of[a] += of[b]
        self.least[a] = min(self.least[a], self.least[b])
        self.lo[a], self.hi[a] = min(self.lo[a], self.lo[b]), max(self.hi[a], self.hi[b])
        self.ended[a] = max(self.ended[a], self.ended[b])

    def _prefix(self, row: int, depth: int) -> str:
        return hashlib.md5(self.keys[row][: DIGEST * depth], usedforsecurity=False).hexdigest()

    def nodes(self) -> pd.DataFrame:
        """A row a node; open ones have a name (``node``), and ``parent_node`` names the parent if that is open."""
        lo, hi, top, bottom, n, least, children, leaves, spoken, fresh, ended = (np.array(x, np.int64) for x in zip(*self.chains, strict=True))
        size = top - bottom + 1
        chain = np.repeat(np.arange(len(size)), size)
        depth = top[chain] - (np.arange(len(chain)) - np.repeat(np.cumsum(size) - size, size))
        is_top = depth == top[chain]
        spoken_to, fresh_to = spoken[chain], fresh[chain]
        flat = np.concatenate(self.cum)
        at = np.cumsum([len(c) for c in self.cum]) - [len(c) for c in self.cum]
        base, above = at[lo[chain]], np.maximum(top[chain] - 1, 0)
        below = np.minimum(np.maximum(depth - 1, 0), above)
        met = np.where(lo[chain] == 0, np.clip(self.before, 0, above), 0)
        spoken_to = spoken_to + n[chain] * (flat[base + above] - flat[base + below])
        fresh_to = fresh_to + flat[base + above] - flat[base + np.maximum(below, met)]
        one = 1 - ((lo[chain] == 0) & (depth + 1 <= self.before))
        is_open = ((lo[chain] == 0) & (depth <= self.before)) | ((hi[chain] == self.last) & (depth <= self.after))
        parent = np.where(depth > bottom[chain], chain, np.array(self.parents)[chain])
        up = depth - 1
        parent_open = (parent >= 0) & (up >= 0) & (((lo[parent] == 0) & (up <= self.before)) | ((hi[parent] == self.last) & (up <= self.after)))
        names: dict[tuple[int, int], str] = {}

        def name(row: int, d: int) -> str:
            if (row, d) not in names:
                names[row, d] = self._prefix(row, d)
            return names[row, d]

        def named(on: np.ndarray, row: np.ndarray, d: np.ndarray) -> list[str | None]:
            out: list[str | None] = [None] * len(chain)
            for i in np.flatnonzero(on).tolist():
                out[i] = name(int(row[i]), int(d[i]))
            return out

        return pd.DataFrame({
            "node": named(is_open, lo[chain], depth), "parent_node": named(parent_open, lo[parent], up),
            "depth": depth, "conv_id": least[chain], "parent_conv_id": pd.array(np.where(parent >= 0, least[parent], 0), dtype="Int64").copy(),
            "n_convs": n[chain], "n_children": np.where(is_top, children[chain], one), "n_leaves": leaves[chain], "spoken": spoken_to, "fresh": fresh_to,
            "ends_sha256": [self.end_of[e] if t and e >= 0 else NO_IDS for t, e in zip(is_top.tolist(), ended[chain].tolist(), strict=True)],
        })


_NODES = ("node string, parent_node string, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, spoken long, fresh long, "
          "ends_sha256 string")


def _forest(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("key")
    return Forest(list(rows["key"]), list(rows["chars"]), rows["n"].tolist(), rows["least"].tolist(), list(rows["ends"]), int(rows["before"].iloc[0]), int(rows["after"].iloc[0])).nodes()


def trie(convs: DataFrame) -> DataFrame:
    """A row for each prefix of the conversations of *convs* (``conv_id, turns`` as :func:`conversations` gives them; ids distinct).

    ``conv_id`` (the smallest member's), ``depth``, ``parent_conv_id`` (null for the root), ``n_convs``, ``n_children``,
    ``n_leaves``, ``saved_tokens`` (over the subtree, code points of last texts times members but one) and
    ``ends_sha256`` (of the ids of conversations that end there). An empty table has no nodes.

    Equal conversations are one sequence. Sequences are sorted over all machines; in each partition union-find over
    neighbours' common turns, longest first, makes a branching node of every merge. Each partition's forest is
    contracted to the prefixes it shares with its neighbours, whose shares are added by name; the others are whole.
    """
    spark = convs.sparkSession
    key = F.unhex(F.array_join(F.transform("turns", lambda t: t["digest"]), ""))
    keyed = written(convs.select("conv_id", key.alias("key"), F.transform("turns", lambda t: t["n"]).alias("chars")).withColumn("k", F.md5("key")), "trie-conversations")
    total = keyed.agg(F.sum(F.size("chars") + 1)).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(total) // PART_TURNS))
    sequences = keyed.groupBy("k").agg(F.any_value("key").alias("key"), F.any_value("chars").alias("chars")).join(members(keyed.select("k", "conv_id"), parts), "k").drop("k")
    ranged = written(sequences.repartitionByRange(parts, "key").withColumn("p", F.spark_partition_id()), "trie-sequences")
    # a row a partition: what it shares with those before and after it
    ends = ranged.groupBy("p").agg(F.min("key").alias("first"), F.max("key").alias("last"))
    over = Window.orderBy("p")
    ends = ends.withColumn("prior", F.lag("last").over(over)).withColumn("next", F.lead("first").over(over))
    empty = F.lit(b"")
    shared = ends.select("p", F.when(F.col("prior").isNull(), -1).otherwise(common_turns(F.coalesce("prior", empty), F.col("first"))).cast("long").alias("before"),
                         F.when(F.col("next").isNull(), -1).otherwise(common_turns(F.col("last"), F.coalesce("next", empty))).cast("long").alias("after"))
    nodes = written(ranged.join(shared, "p").groupBy("p").applyInPandas(_forest, _NODES), "trie-nodes")
    opened = nodes.where(F.col("node").isNotNull()).groupBy("node").agg(
        F.max("parent_node").alias("parent_node"), F.max("depth").alias("depth"), F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "spoken", "fresh")],
        F.coalesce(F.max(F.when(F.col("ends_sha256") != NO_IDS, F.col("ends_sha256"))), F.lit(NO_IDS)).alias("ends_sha256"))
    opened = written(opened, "trie-open")
    parents = opened.select(F.col("node").alias("parent_node"), F.col("conv_id").alias("parent_conv_id"))
    closed = nodes.where(F.col("node").isNull())
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", (F.col("spoken") - F.col("fresh")).alias("saved_tokens"), "ends_sha256"]
    inside = closed.where(F.col("parent_node").isNull()).withColumn("parent_conv_id", F.when(F.col("depth") > 0, F.col("parent_conv_id")))
    below = closed.where(F.col("parent_node").isNotNull()).drop("parent_conv_id").join(parents, "parent_node")
    return inside.select(columns).unionByName(below.select(columns)).unionByName(opened.join(parents, "parent_node", "left").select(columns))


def prefix_nodes(turns: DataFrame) -> DataFrame:
    """The trie of all conversations of *turns* (``conv_id, turn, role, text``), rebuilt; see :func:`conversations`,
    :func:`rebuilt` and :func:`trie` for nulls, ties and columns. Other columns are left out; equal rows are turns each."""
    return trie(rebuilt(conversations(turns)))
