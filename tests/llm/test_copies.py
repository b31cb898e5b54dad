import itertools
import random
import re
import time

import numpy as np
import pytest
import xxhash

from finstrata.llm import components as C
from finstrata.llm import hnsw, line_dedup, near_text, simhash

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def _groups(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_components(spark):
    rng = random.Random(0)
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(500, 500 + i) for i in range(1, 300)]
    loose = [(rng.randrange(1000, 1200), rng.randrange(1000, 1200)) for _ in range(90)]
    edges = chain + star + loose + [(7, 7), (-5, 3), (3, -5), (None, 1), (2, None)]
    got = {r.node: r.root for r in C.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = sorted({x for e in edges if None not in e and e[0] != e[1] for x in e})
    at = {x: i for i, x in enumerate(nodes)}
    want = _groups(len(nodes), [(at[a], at[b]) for a, b in edges if a in at and b in at])
    assert got == {x: nodes[want[i]] for i, x in enumerate(nodes)}
    assert C.components(spark.createDataFrame([], "a long, b long")).count() == 0
    a, b = np.array([5, 1, 3, 8]), np.array([1, 0, 4, 9])
    assert C.local_roots(10, a, b).tolist() == [0, 0, 2, 3, 3, 0, 6, 7, 8, 8]


def _print(text, n=3):
    w = SPLIT.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    s = [" ".join(w[i:i + n]) for i in range(len(w) - n + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _prose(rng, n, words=400):
    return [f"w{rng.randrange(words)}é" for _ in range(n)]


def _corpus():
    rng = random.Random(3)
    docs = [None, "", " \t\n", "One", "one", "a b", "A  B\n", "x\x1cy z", "é É"]
    for _ in range(30):
        w = _prose(rng, rng.randrange(5, 120))
        docs += [" ".join(w), "  ".join(w).upper()] if rng.random() < 0.5 else [" ".join(w)]
        for _ in range(rng.randrange(4)):
            v = list(w)
            v[rng.randrange(len(v))] = f"new{rng.randrange(99)}"
            docs.append(" ".join(v))
    return docs + ["hot copy of a text " * 3] * 40 + [" ".join(_prose(rng, 30_000, 9999))]


def test_simhash_against_brute_force(spark):
    docs = _corpus()
    prints = [_print(t) for t in docs]
    want = _groups(len(docs), [(i, j) for i, j in itertools.combinations(range(len(docs)), 2) if bin(prints[i] ^ prints[j]).count("1") <= 3])
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(docs)], "doc_id long, text string, fp string")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(df).collect()}
    assert got == {i: (f"{prints[i]:016x}", want[i]) for i in range(len(docs))}
    odd = simhash.near_duplicates(spark.createDataFrame([(None, "q w e"), (4, "q w e"), (4, "q w e"), (None, "other text of null id")], "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), str(r.component_id)) for r in odd) == [("4", "4"), ("4", "4"), ("None", "4"), ("None", "None")]
    assert simhash.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("radius", [0, 1, 3, 5, 18])
def test_bit_planes(radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = np.concatenate([base ^ (np.uint64(1) << rng.integers(0, 64, 40).astype(np.uint64)) * np.uint64(k % 2) for k in range(8)] + [base, base])
    runs = np.sort(rng.integers(0, 9, len(fps)))
    fps = fps[rng.permutation(len(fps))]
    ends = simhash._run_ends(runs[:, None])
    got = {(int(a), int(b)) for x, y in simhash.links_in_runs(fps.view(np.int64), ends, radius, slice_words=50) for a, b in zip(x, y, strict=True)}
    want = {(i, j) for i, j in itertools.combinations(range(len(fps)), 2) if runs[i] == runs[j] and int(fps[i] ^ fps[j]).bit_count() <= radius}
    assert got == want


def test_masks_find_every_pair_within_the_radius():
    rng = random.Random(1)
    for n in (10, 10**6, 10**9, 10**12):
        m = simhash.masks(n, 3)
        for _ in range(300):
            x = sum({1 << b for b in rng.sample(range(64), 3)})
            assert any(x & k == 0 for k in m)


def test_hot_keys_are_dealt_into_chunks(spark):
    rows = [(0, 5, i) for i in range(100)] + [(0, 6, 1), (1, 6, 1), (1, 7, 1), (1, 7, 2)]
    out = simhash.in_chunks(spark.createDataFrame(rows, "t int, key long, node long"), chunk=16).collect()
    meet = {}
    for r in out:
        meet.setdefault((r.t, r.key, r.c1, r.c2), set()).add(r.node)
    assert max(map(len, meet.values())) < 60 and {(r.t, r.key) for r in out} == {(0, 5), (1, 7)}
    assert {p for v in meet.values() for p in itertools.combinations(sorted(v), 2)} == set(itertools.combinations(range(100), 2))


def test_near_copies_against_brute_force(spark):
    docs = _corpus()
    sets = []
    for t in docs:
        w = SPLIT.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({" ".join(w[i:i + 5]) for i in range(len(w) - 4)} or ({" ".join(w)} if w else set()))
    alike = lambda a, b: len(a & b) >= 0.8 * len(a | b)
    want = _groups(len(docs), [(i, j) for i, j in itertools.combinations(range(len(docs)), 2) if alike(sets[i], sets[j])])
    df = spark.createDataFrame([(i, t, f"s{i}") for i, t in enumerate(docs)] + [(0, None, "again")], "doc_id long, text string, node string")
    kept = near_text.drop_near_copies(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want))
    assert near_text.drop_near_copies(df.limit(0)).count() == 0
    nulls = spark.createDataFrame([(None, "a b c d e f"), (3, "A b c d e f"), (None, "alone in the world here now")], "doc_id long, text string")
    assert sorted(str(r.doc_id) for r in near_text.drop_near_copies(nulls).collect()) == ["3", "None"]


def _lines(rows, min_sites, keep_first):
    strip = " \t\n\x0b\x0c\r"
    sites, first = {}, {}
    for d, t, s in rows:
        for x in (t or "").split("\n"):
            x = x.strip(strip)
            if x:
                sites.setdefault(x, set()).add(s)
                if d is not None:
                    first[x] = min(first.get(x, d), d)
    bad = {x for x, s in sites.items() if len(s) >= min_sites}
    out = []
    for d, t, s in rows:
        raw, seen, kept = (t or "").split("\n"), set(), []
        for x in raw:
            y = x.strip(strip)
            own = keep_first and first.get(y) == d and y not in seen
            seen.add(y)
            if y not in bad or own:
                kept.append(x)
        n = len(raw) if t else 0
        out.append((d, s, t if len(kept) == len(raw) else "\n".join(kept), n, len(raw) - len(kept)))
    return out


@pytest.mark.parametrize("keep_first", [True, False])
def test_lines_against_brute_force(spark, keep_first):
    rng = random.Random(5)
    pool = [f"line {i} é" for i in range(40)] + ["", "  ", "\tpad line \r"]
    rows = [(i, "\n".join(rng.choices(pool, [40 - k if k < 40 else 5 for k in range(43)], k=rng.randrange(1, 9))), f"s{rng.randrange(30)}") for i in range(150)]
    rows += [(900, None, "s1"), (901, "", "s2"), (902, "line 0 é\nline 0 é", None), (903, "\n\n", None), (4, rows[4][1], rows[4][2]), (904, "u" * 200_000, "s3")]
    rows += [(i, "hot\nline 1 é", f"s{i % 12}") for i in range(1000, 1080)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, source string, h string")
    for k in (1, 9, 12):
        out = line_dedup.dedup(df, min_sites=k, keep_first=keep_first)
        assert out.columns == ["doc_id", "text", "source", "h", "n_lines", "n_removed"]
        assert sorted(map(str, [(r.doc_id, r.source, r.text, r.n_lines, r.n_removed) for r in out.collect()])) == sorted(map(str, _lines(rows, k, keep_first)))
    assert line_dedup.dedup(df.limit(0)).count() == 0


def test_long_texts_of_boilerplate(spark):
    lines = [f"line number {i}" for i in range(20_000)]
    rows = [(i, "\n".join(lines[:1] * 3 + lines), f"s{i}") for i in range(12)]
    began = time.time()
    out = {r.doc_id: r for r in line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert out[0].text == "\n".join(lines) and out[0].n_removed == 3 and all(out[i].text == "" and out[i].n_removed == 20_003 for i in range(1, 12))
    assert time.time() - began < 60


def _vectors():
    rng = np.random.default_rng(0)
    base = rng.normal(size=(300, 12))
    near = np.concatenate([base[:40] + rng.normal(size=(40, 12)) * s for s in (0.02, 0.05, 0.15, 0.25)])
    v = [list(map(float, x)) for x in np.concatenate([base, near, base[:5] * 3, np.repeat(base[7:8], 30, axis=0)])]
    v += [None, [], [0.0] * 12, [1.0] * 11, [2.0] * 11, [None] + [1.0] * 11, [float("nan")] + [1.0] * 11, [float("inf")] + [1.0] * 11, [1e-200] * 12, [1e200] * 12, [-0.0] + [1.0] * 11, [0.0] + [1.0] * 11]
    return v


def test_embeddings_against_brute_force(spark):
    v = _vectors()

    def sound(x):
        return bool(x) and None not in x and all(map(np.isfinite, x)) and any(x)

    def unit(x):
        x = np.array(x) / np.max(np.abs(x))
        return x / np.linalg.norm(x)
    u = [unit(x) if sound(x) else None for x in v]
    links = [(i, j) for i, j in itertools.combinations(range(len(v)), 2) if u[i] is not None and u[j] is not None and len(u[i]) == len(u[j]) and u[i] @ u[j] >= 0.95]
    root = _groups(len(v), links)
    n = np.bincount(np.array(links).ravel(), minlength=len(v))
    df = spark.createDataFrame([(i, x, "c") for i, x in enumerate(v)], "vec_id long, embedding array<double>, node string")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in hnsw.near_duplicates(df).collect()}
    assert got == {i: (int(n[i]), root[i], root[i] == i) for i in range(len(v))}
    assert hnsw.near_duplicates(df.limit(0)).count() == 0
    odd = hnsw.near_duplicates(spark.createDataFrame([(None, [1.0, 2.0]), (3, [2.0, 4.0]), (3, [1.0, 2.0]), (None, None)], "vec_id long, embedding array<float>")).collect()
    assert sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in odd) == [("3", 2, "3", True), ("3", 2, "3", True), ("None", 0, "None", True), ("None", 2, "3", False)]


def test_graph_recall_over_shards(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 16))
    x[1000:1400] = x[0] + rng.normal(size=(400, 16)) * 0.1  # one large group
    x[2000:2500] = x[500:1000] + rng.normal(size=(500, 16)) * 0.06
    u = hnsw._unit(x).astype(np.float32)
    a, _ = hnsw.Graph(u).within(u, 0.95)
    assert len(a) >= 0.99 * (u @ u.T >= 0.95).sum()
    monkeypatch.setattr(hnsw, "SHARD_BYTES", 40_000)
    monkeypatch.setattr(hnsw, "PART_BYTES", 70_000)
    df = spark.createDataFrame([(i, y.tolist()) for i, y in enumerate(x)], "vec_id long, embedding array<double>")
    out = hnsw.near_duplicates(df).toPandas().sort_values("vec_id")
    exact = hnsw._unit(x)
    want = (exact @ exact.T >= 0.95).sum(axis=1) - 1
    assert (out["n_links"].to_numpy() <= want).all() and out["n_links"].sum() >= 0.98 * want.sum()


def test_near_copies_with_repeats_and_far_fingerprints(spark, monkeypatch):
    rng = random.Random(11)
    rows = []
    for k in range(20):
        body, line = _prose(rng, 200, 5000), _prose(rng, 8, 5000)
        rows += [(10 * k, " ".join(body + line)), (10 * k + 1, " ".join(body + line * 60))]  # one shingle set but for the seams, far fingerprints
        short = _prose(rng, 26, 5000)
        rows += [(10 * k + 2, " ".join(short)), (10 * k + 3, " ".join(short[1:] + ["end"]))]  # 21 of 23 shingles
    sets = [{t[i:i + 5] for i in range(len(t) - 4)} for t in (tuple(t.split()) for _, t in rows)]
    pairs = [(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    want = sorted({rows[r][0] for r in _groups(len(rows), pairs)})
    assert len(want) == 40
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in near_text.drop_near_copies(df).collect()) == want
    # whatever the fingerprints say
    assert sorted(r.doc_id for r in near_text.drop_near_copies(df, radius=0).collect()) == want


def test_counters_rule_out_no_similar_pair():
    rng = np.random.default_rng(5)
    sets = []
    for _ in range(60):
        base = rng.integers(0, 1 << 32, rng.integers(1, 400), dtype=np.uint32)
        sets += [np.unique(base), np.unique(np.concatenate([base[len(base) // 9:], rng.integers(0, 1 << 32, rng.integers(0, len(base) // 9 + 1), dtype=np.uint32)]))]
    sizes, slots = np.array([len(s) for s in sets]), np.array([np.bincount(s % 256, minlength=256) for s in sets])
    a, b = np.triu_indices(len(sets), 1)
    true = np.array([near_text.similarity(sets[i], sets[j]) >= 0.8 for i, j in zip(a, b, strict=True)])
    may = near_text.may_link(a, b, sizes, slots, 0.8)
    assert true.sum() > 20 and may[true].all() and may.sum() < 2 * true.sum() + 60
