import binascii
import hashlib
import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from finstrata.llm import fingerprints, lexical, prefix_trie
from finstrata.llm.terms import terms

BIG = (1 << 53) + 1


def _docs(rng):
    words = ["The", "of", "Crème", "naïve", "x9", "語", "é"] + [f"w{i}" for i in range(300)]
    texts = [" ".join(rng.choices(words, k=rng.choice([1, 3, 40, 200]))) for _ in range(60)]
    texts += [texts[0]] * 12 + [None, "", " ?!\n\t", "tie tie", "tie tie", "a-b_c\x7fd\x00E", "ab cd", "x" * 200_000, " ".join(f"t{i}" for i in range(40_000))]
    return [(BIG + 7 * i, t) for i, t in enumerate(texts)]


def _term_list(text):
    folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [m.encode() for m in re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", folded)]


def test_terms():
    for t in (None, "", "A-b C9ÉÀ\x80 _x", "語、x", "\x0b\x1c a", "naïve²"):
        assert terms(t) == _term_list(t)


def _fingerprints(texts):
    slot = lambda t: int(hashlib.md5(t).hexdigest()[:16], 16)
    df = Counter(s for t in texts for s in {slot(w) % 2**18 for w in _term_list(t)})

    def of(text):
        votes = [0] * 64
        for w, n in Counter(_term_list(text)).items():
            h = slot(w)
            weight = max(1, math.floor(1000 * math.log((2 * len(texts) + 2) / (2 * df[h % 2**18] + 1))))
            for b in range(64):
                votes[b] += n * weight * (1 if h >> b & 1 else -1)
        return sum(1 << b for b in range(64) if votes[b] > 0)
    return of


def test_fingerprints_against_brute_force(spark):
    rng = random.Random(4)
    rows = _docs(rng)
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, fp string, p int").repartition(5)
    got = {r.doc_id: r for r in fingerprints.edited_documents(df).collect()}
    order = sorted(rows, reverse=True)
    of = _fingerprints([t for _, t in rows])
    prints = {d: of(t) for d, t in order}
    for (d, t), (after, x) in zip(order, order[1:] + order[:1], strict=True):
        t, x = t or "", x or ""
        k = len(t) // 3
        e = t[: len(t) - k] + x[:k]
        alike = lambda a, b: 1 - bin(a ^ b).count("1") / 64
        near = sum(bin(prints[d] ^ p).count("1") <= 3 for i, p in prints.items() if i != d)
        want = (len(t), hashlib.sha256(e.encode()).hexdigest(), f"{prints[d]:016x}", f"{of(e):016x}", alike(prints[d], of(e)), alike(prints[d], prints[after]), near)
        r = got[d]
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next, r.n_near) == want, d


def test_fingerprints_of_odd_tables(spark):
    schema = "doc_id long, text string"
    assert fingerprints.edited_documents(spark.createDataFrame([], schema)).count() == 0
    alone = fingerprints.edited_documents(spark.createDataFrame([(3, "abcdef")], schema)).first()
    assert alone.near_next == 1.0 and alone.edited_sha256 == hashlib.sha256(b"abcdab").hexdigest() and alone.n_near == 0
    odd = fingerprints.edited_documents(spark.createDataFrame([(None, None)] * 3 + [(None, "a b c"), (5, "a b c"), (5, "a b c")], schema)).collect()
    assert sorted(str(r.doc_id) for r in odd) == ["5", "5", "None", "None", "None", "None"]
    assert sorted(r.n_near for r in odd) == [2, 2, 2, 2, 2, 2]


def test_block_tables_find_every_pair_and_count_it_once():
    rng = np.random.default_rng(2)
    for n in (10, 10**6, 10**9):
        for radius in (0, 1, 3):
            masks = [sum(((1 << w) - 1) << a for a, w in t) for t in fingerprints.block_tables(n, radius)]
            assert all(any(x & m == 0 for m in masks) for x in (sum(1 << int(b) for b in rng.choice(64, radius, replace=False)) for _ in range(100)))


@pytest.mark.parametrize("chunk", [4096, 16])
def test_near_counts_with_hot_keys(spark, chunk, monkeypatch):
    monkeypatch.setattr(fingerprints, "CHUNK", chunk)
    rng = random.Random(chunk)
    base = [rng.getrandbits(64) for _ in range(30)]
    fps = base + [b ^ sum(1 << i for i in rng.sample(range(64), rng.randrange(5))) for b in base for _ in range(6)]
    fps += [base[0] ^ 1 << i ^ 1 << j for i, j in itertools.combinations(range(40, 64), 2)] + [base[3]] * 50
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    got = {r.fp: r.near for r in fingerprints.near_counts(spark.createDataFrame([(f,) for f in signed], "fp long")).collect()}
    want = {s: n for f, s in zip(fps, signed, strict=True) if (n := sum(bin(f ^ g).count("1") <= 3 for g in fps) - 1)}
    assert got == want


def _search(docs, items, k):
    tf = [(d, Counter(_term_list(t))) for d, t in docs]
    n_docs, total = sum(bool(c) for _, c in tf), sum(sum(c.values()) for _, c in tf)
    df = Counter(t for _, c in tf for t in c)
    out = []
    for item, text in set(items):
        scored = []
        for d, c in tf:
            m = 25 + 75 * sum(c.values()) * n_docs // max(total, 1)
            s = sum(n * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t, n in Counter(_term_list(text)).items() if t in c)
            if s > 0:
                scored.append((-s, d is None, d))
        out += [(item, r, d, -s) for r, (s, _, d) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("bucket", [2048, 3])
def test_search_against_brute_force(spark, bucket, monkeypatch):
    monkeypatch.setattr(lexical, "BUCKET", bucket)
    monkeypatch.setattr(lexical, "SEED", 20)
    rng = random.Random(bucket)
    docs = _docs(rng) + [(None, "w1 w2 rare"), (None, "w1 w2 rare"), (5, "w1 w2 rare"), (4, "w1 w2 rare")]
    items = [(i, " ".join(rng.choices([f"w{j}" for j in range(300)] + ["the", "unseen", "語"], k=rng.choice([1, 5, 30])))) for i in range(25)]
    items += [(90, None), (91, "  ?"), (92, "nowhere"), (93, "rare rare w1"), (93, "rare rare w1"), (93, "tie"), (None, "w5 x9")]
    d = spark.createDataFrame([(*x, "c", 0) for x in docs], "doc_id long, text string, item_id string, norm int")
    q = spark.createDataFrame([(*x, 9) for x in items], "item_id long, text string, doc_id long")
    for k in (1, 10):
        got = sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in lexical.search(d, q, k).collect()), key=str)
        assert got == _search(docs, items, k)
    monkeypatch.setattr(lexical, "BLOCK_TERMS", 40)
    assert sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in lexical.search(d, q).collect()), key=str) == _search(docs, items, 10)
    assert lexical.search(d, q.limit(0)).count() == 0 and lexical.search(d.limit(0), q).count() == 0
    assert lexical.search(d.where("text is null"), q).count() == 0


def _turns(rng, n):
    rows = []
    for c in range(n):
        conv = rng.choice([c, 100 * c, 7 * c - 90])
        for t in range(rng.choice([0, 1, 2, 3, 4, 9])):
            rows.append((conv, rng.choice([t, t, None]), rng.choice(["user", "assistant", None]), rng.choice([None, "", "hi", "é語", "yes\nno", f"own {rng.randrange(6)}"])))
    rows += [(c, t, "user", f"same {t}") for c in range(2000, 2400, 2) for t in range(9)]
    rows += [(c, t, "user", f"same {t}" if t < c % 50 else f"other {c}") for c in range(4000, 4100) for t in range(60)]
    return rows


def _nodes(rows):
    convs = {}
    for c, t, r, x in rows:
        if c is not None:
            convs.setdefault(c, []).append((t is not None, t or 0, r or "", hashlib.md5((x or "").encode()).hexdigest(), x or ""))
    own = {c: [(r, x) for _, _, r, _, x in sorted(v)] for c, v in convs.items()}
    made = {}
    for c, v in own.items():
        h = binascii.crc32(str(c).encode()) % 6
        made[c] = own.get(c - int(math.fmod(c, 100)), [])[:h] + v[h:]
    nodes = {}
    for c, v in made.items():
        for d in range(len(v) + 1):
            nodes.setdefault(tuple(v[:d]), []).append(c)
    kids = Counter(p[:-1] for p in nodes if p)
    saved, leaves = Counter(), Counter()
    for p, m in nodes.items():
        for d in range(len(p) + 1):
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
            leaves[p[:d]] += not kids[p]
    ends = lambda p: hashlib.sha256(",".join(str(c) for c in sorted(m for m in nodes[p] if len(made[m]) == len(p))).encode()).hexdigest()
    return sorted(((min(m), len(p), min(nodes[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], ends(p)) for p, m in nodes.items()), key=str)


def test_prefix_trie_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "IDS", 7)
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    for seed in range(2):
        rng = random.Random(seed)
        rows = _turns(rng, 150) + [(None, 1, "user", "lost"), (11, 1, "user", "x"), (11, 1, "user", "x"), (-350, 0, "user", "y" * 100_000)]
        rng.shuffle(rows)
        out = prefix_trie.prefix_nodes(spark.createDataFrame([(*r, "c", 3) for r in rows], "conv_id long, turn long, role string, text string, key string, p int"))
        assert out.columns == names
        assert sorted((tuple(r) for r in out.collect()), key=str) == _nodes(rows)
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert prefix_trie.prefix_nodes(empty).count() == 0
    assert [tuple(r) for r in prefix_trie.prefix_nodes(spark.createDataFrame([(1, 0, None, None)], empty.schema)).collect()] == [tuple(r) for r in _nodes([(1, 0, None, None)])]


@pytest.mark.parametrize("seed", range(6))
def test_forests_of_partitions_add_up(seed):
    """Any cut of the sorted sequences into partitions gives the same nodes."""
    rng = random.Random(seed)
    turn = [hashlib.md5(bytes([i])).digest() for i in range(3)]
    length = {t: i + 1 for i, t in enumerate(turn)}
    made = sorted({b"".join(rng.choices(turn, k=rng.randrange(6))) for _ in range(60)})
    n, least = [rng.randrange(1, 4) for _ in made], rng.sample(range(999), len(made))
    cuts = sorted({0, len(made), *rng.sample(range(len(made)), rng.randrange(5))})
    total = {}
    for a, b in itertools.pairwise(cuts):
        before = prefix_trie._common(made[a - 1], made[a]) if a else -1
        after = prefix_trie._common(made[b - 1], made[b]) if b < len(made) else -1
        chars = [np.array([length[k[i: i + 16]] for i in range(0, len(k), 16)], np.int32) for k in made[a:b]]
        f = prefix_trie.Forest(made[a:b], chars, n[a:b], least[a:b], [str(i) for i in range(a, b)], before, after).nodes()
        for r in f.itertuples():
            whose = r.node or (r.conv_id, r.depth)
            old = total.get(whose, (0, 0, 0, 0, 10**9))
            assert r.node or whose not in total
            total[whose] = tuple(x + y for x, y in zip(old[:4], (r.n_convs, r.n_children, r.n_leaves, r.spoken - r.fresh), strict=True)) + (min(old[4], r.conv_id),)
    prefixes = {k[: 16 * d] for k in made for d in range(len(k) // 16 + 1)}
    want = []
    for p in prefixes:
        under = [i for i, k in enumerate(made) if k.startswith(p)]
        below = [q for q in prefixes if q.startswith(p)]
        size = lambda q: sum(n[i] for i, k in enumerate(made) if k.startswith(q))
        saved = sum((size(q) - 1) * length[q[-16:]] for q in below if q)
        want.append((size(p), sum(len(q) == len(p) + 16 for q in below), sum(not any(x.startswith(q) and x != q for x in prefixes) for q in below), saved, min(least[i] for i in under)))
    assert sorted(total.values()) == sorted(want)
