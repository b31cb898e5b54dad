import hashlib
import random
import re
import unicodedata
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from finstrata.llm import decontam, mixing, pii
from finstrata.llm.wordhash import gram_hashes, token_hashes

DOCS = "doc_id long, text string, source string, target string"


def _targets(sizes, weights=(3, 1, 2), share=1.5, cap=2.0):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    fixed, total = {}, share * sum(sizes.values())
    while True:
        free = [s for s in names if s not in fixed]
        left = total - sum(fixed.values())
        t = {s: w[s] * left / sum(w[x] for x in free) for s in free}
        over = [s for s in free if t[s] > cap * sizes[s]]
        if not over:
            return fixed | t
        fixed |= {s: cap * sizes[s] for s in over}


def _rows(seed):
    rng = random.Random(seed)
    rows = [(i, " ".join("w" * rng.randrange(1, 4) for _ in range(rng.choice([0, 1, 5, 40, 200]))), rng.choice(["hot"] * 6 + ["b", "é", "z", None]), "c") for i in range(900)]
    return rows + [(1, "dup dup", "b", "c")] * 20 + [(None, "null id", "b", "c")] * 5 + [(7000, None, "empty", "c"), (7001, "  ", "empty", "c"), (7002, "word " * 30_000, "big", "c")]


def test_mix_targets_and_bounds(spark, monkeypatch):
    monkeypatch.setattr(mixing, "FLIGHT", 50)  # several rounds
    rows = _rows(1)
    df = spark.createDataFrame(rows, DOCS)
    out = mixing.mix(df).toPandas()
    again = mixing.mix(df.repartition(5)).toPandas()
    key = lambda d: sorted(map(str, d.astype(object).where(d.notna(), None).values.tolist()))
    assert len(out) == len(rows) and key(out) == key(again)
    size = {}
    for _, t, s, _ in rows:
        size[s] = size.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want = _targets(size)
    largest = out.groupby("source", dropna=False)["size"].max()
    for s, g in out.groupby("source", dropna=False):
        s = None if s != s else s
        assert g["source_size"].iloc[0] == size[s] == g["size"].sum() and g["target"].iloc[0] == pytest.approx(want[s])
        assert abs(g["taken"].sum() - want[s]) <= 2 * (largest[largest.index.isna()].iloc[0] if s is None else largest[s])
        ratio = want[s] / size[s] if size[s] else 0
        assert ((g["taken"] == np.floor(ratio) * g["size"]) | (g["taken"] == np.ceil(ratio) * g["size"])).all()
    assert (out["taken"] <= 2 * out["size"]).all()
    assert mixing.mix(df.limit(0)).count() == 0


def test_flight_keeps_totals_and_probabilities():
    rng = np.random.default_rng(0)
    size, pi = np.sort(rng.integers(1, 500, 200))[::-1], rng.random(200)
    taken = np.zeros(200)
    for k in range(300):
        p = mixing.fly(size, pi, np.random.default_rng(k), land=False)
        assert ((p > 0) & (p < 1)).sum() <= 2
        assert abs((p * size).sum() - (pi * size).sum()) < 1e-3 and abs(p.sum() - pi.sum()) < 1e-6
        taken += mixing.fly(size, pi, np.random.default_rng(k), land=True)
    assert abs(taken / 300 - pi).max() < 0.16
    assert set(mixing.fly(np.full(9, 4), np.full(9, 0.5), np.random.default_rng(1), land=True)) <= {0.0, 1.0}


def _sw(item, words):
    best, h = 0, [0] * (len(words) + 1)
    for a in item:
        row = [0]
        for j, b in enumerate(words):
            row.append(max(0, h[j] + (1 if a == b else -1), h[j + 1] - 1, row[j] - 1))
        best, h = max([best, *row]), row
    return best


def test_alignment_against_the_table():
    rng = random.Random(0)
    for _ in range(300):
        a, b = ([rng.randrange(5) for _ in range(rng.randrange(0, 14))] for _ in range(2))
        score, first, last = decontam.align(np.array(a, np.uint64), np.array(b, np.uint64))
        assert score == _sw(a, b)
        if score:
            assert _sw(a, b[first:last + 1]) == score and a.count(b[first]) and a.count(b[last])


def test_word_hashes():
    texts = ["Größe, the THE the-the 12 x2_y", None, "", "¿qué? «x» “y” … ª a b", "a" * 70_000 + " b"]
    got = token_hashes(texts, block=40)
    want = [re.findall(r"[^\W_]+", (t or "").lower()) for t in texts]
    assert [len(x) for x in got] == [len(x) for x in want]
    seen = {}
    for w, h in zip(sum(want, []), np.concatenate(got).tolist(), strict=True):
        assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)
    assert len(gram_hashes(got[0], 3)) == len(got[0]) - 2 and len(gram_hashes(got[1], 3)) == 0


def _script_words(text):
    """Words one character at a time: marks and letters run on, characters of scripts without spaces stand alone."""
    out, open_ = [], False
    for c in text.lower():
        alone = re.match(r"[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\U00020000-\U0003ffff]", c)
        if unicodedata.category(c)[0] not in "LMN":
            open_ = False
        elif alone or not open_:
            out.append(c)
            open_ = not alone
        else:
            out[-1] += c
    return out


def test_words_of_all_scripts():
    texts = ["这是一个测试，包含标点。第二句！", "abc中文def 𠀀𠀁x", "ภาษาไทยไม่มีช่องว่าง", "ひらがなとカタカナー、漢字", "مَرْحَبًا، بالعالم؟ نعم", "हिन्दी में, लिखा।", "e\u0301t\u00e9 \u0130x 😀y", "\ud800 bad"]
    got = token_hashes(texts, block=30)
    want = [_script_words(t) for t in texts]
    assert [len(x) for x in got] == [len(x) for x in want]
    seen = {}
    for w, h in zip(sum(want, []), np.concatenate(got).tolist(), strict=True):
        assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def _written_in(script, n, rng):
    lo, hi, join = {"zh": (0x4E00, 0x5200, ""), "th": (0x0E01, 0x0E2E, ""), "ar": (0x0627, 0x064A, " "), "en": (0x61, 0x7A, " ")}[script]
    return join, ["".join(chr(rng.randrange(lo, hi)) for _ in range(1 if join == "" else 5)) for _ in range(n)]


@pytest.mark.parametrize("script", ["zh", "th", "ar", "en"])
def test_edited_copies_in_scripts(spark, script):
    rng = random.Random(8)
    items, docs, other = [], [], lambda n: _written_in(script, n, rng)[1]
    for i in range(8):
        join, w = _written_in(script, 32, rng)
        items.append((i, join.join(w)))
        swap, drop, add = list(w), [x for k, x in enumerate(w) if k % 4 != 3], []
        for k, x in enumerate(w):
            swap[k] = other(1)[0] if k % 4 == 3 else x
            add += [x, *other(k % 4 == 3)]
        for kind, copy in enumerate((w, swap, drop, add)):
            docs.append((10 * i + kind, join.join([*other(40), *copy, *other(30)])))
    docs += [(1000 + k, join.join(other(120))) for k in range(20)]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(df, bench).collect()}
    words = {d: _script_words(t) for d, t in docs}
    want = {(d, i) for i, x in items for d, _ in docs if _sw(_script_words(x), words[d]) >= max(0.4 * len(_script_words(x)), 8)}
    assert {(10 * i + k, i) for i in range(8) for k in range(4)} <= want == got


def test_leaks(spark):
    rng = random.Random(4)
    prose = lambda n: " ".join(f"w{rng.randrange(300)}" for _ in range(n))
    items = [(i, prose(rng.randrange(12, 60))) for i in range(30)] + [(30, None), (31, ""), (32, "three word item"), (33, "w1 w2 " * 4000), (None, prose(20)), (5, prose(25))]
    edited = []
    for i in range(10):
        w = items[i][1].split()
        for _ in range(max(1, len(w) // 9)):
            w[rng.randrange(len(w))] = "changed"
        edited.append(" ".join(w))
    docs = [(i, prose(80) + " " + items[i][1].upper().replace(" ", ", ") + ". " + prose(30), "s", "t") for i in range(10)]
    docs += [(100 + i, prose(50) + "\n" + e + "\n" + prose(40), "s", "t") for i, e in enumerate(edited)]
    docs += [(200 + i, prose(150), "s", "t") for i in range(40)]
    docs += [(300, None, "s", "t"), (301, "", "s", "t"), (302, "a three word item here", "s", "t"), (303, items[3][1], "s", "t"), (303, items[3][1], "s", "t"), (None, items[4][1], "s", "t"), (304, prose(30_000), "s", "t")]
    docs += [(400 + i, "hot passage " + items[9][1], "s", "t") for i in range(60)]
    df, bench = spark.createDataFrame(docs, DOCS), spark.createDataFrame([(*x, "k") for x in items], "item_id long, text string, doc_id string")
    out = decontam.contaminated(df, bench).collect()
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    want = sorted((str(d), str(i)) for d, t, *_ in docs for i, x in items if x and len(words(x)) < 1000 and d != 304 and _sw(words(x), words(t)) >= max(0.4 * len(words(x)), min(8, len(words(x)))))
    assert sorted((str(r.doc_id), str(r.item_id)) for r in out if r.item_id != 33) == want
    assert all(r.score == 1 for r in out if r.doc_id is not None and r.doc_id < 10 and r.item_id == r.doc_id)
    clean = decontam.remove_contaminated(df, bench)
    bad = {d for d, _ in want}
    assert clean.columns == df.columns and sorted(str(r.doc_id) for r in clean.collect()) == sorted(str(d) for d, *_ in docs if str(d) not in bad)
    assert decontam.contaminated(df.limit(0), bench).count() == 0 and decontam.contaminated(df, bench.limit(0)).count() == 0
    assert decontam.remove_contaminated(df, bench.limit(0)).count() == len(docs)


def test_benchmark_in_parts(spark, monkeypatch):
    monkeypatch.setattr(decontam, "PART_WORDS", 20)
    bench = spark.createDataFrame([(i, " ".join(f"q{i}x{k}" for k in range(15))) for i in range(5)], "item_id long, text string")
    docs = spark.createDataFrame([(i, f"see q{i}x1 " + " ".join(f"q{i}x{k}" for k in range(15))) for i in range(5)], "doc_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in decontam.contaminated(docs, bench).collect()) == [(i, i) for i in range(5)]


FORMS = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def _luhn(d):
    return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d))) % 10 == 0


def _base(text):
    out = []
    for n, (k, p) in enumerate(FORMS):
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": k != "ip" or all(int(x) <= 255 for x in m[0].split(".")), "card": 14 <= len(d) <= 19 and _luhn(d), "phone": 10 <= len(d) <= 15}[k]:
                out.append((m.start(), n, f"{k}:{m.start()}:{m.end()}"))
    return ",".join(x[2] for x in sorted(out))


def test_forms_against_brute_force(spark):
    rng = random.Random(6)
    parts = ["a@b.co", "a@b.co_x@d.com", "x.y%z+q@mail-1.example..com", "@", "a@b", "..a@b.c.", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "0001.002.03.255", "4111 1111-1111 1111", "4111111111111112", "12", " - ", "7",
             "+1 (705) 555-6638", "+49.30.1234", "++123456789012", "+1", "(", ").", "é", "\U0001f600", "\n", " ", "-", ".", "x", "00000000000000", "12345678901234567890123"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(1, 14))) for _ in range(600)] + [None, "", "9" * 150_000, "a" * 150_000, ".a" * 40_000 + "@" + "b." * 40_000 + "c", "1 " * 60_000, "1." * 60_000, "+1" * 30_000, "a@b.c " * 400]
    df = spark.createDataFrame([(i, t, 3) for i, t in enumerate(texts)] + [(0, texts[0], 3), (None, "n@u.ll", 3)], "doc_id long, text string, n_email int")
    out = pii.find(df, disclosure=2.0).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", pii.span_text("base").alias("base"), pii.span_text("spans").alias("spans")).collect()
    assert len(out) == len(texts) + 2
    for r in out:
        want = "email:0:6" if r.doc_id is None else _base(texts[r.doc_id])
        assert r.base == want == r.spans, (r.doc_id, r.base[:200], want[:200])
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(len(re.findall(rf"(?:^|,){k}:", want)) for k, _ in FORMS)
    assert pii.find(df.limit(0)).count() == 0


def test_disclosing_terms(spark):
    rows = [(i, f"filler line {i}\nthe mayor Xanadu wrote from kay@town.org on day {i} Xanadu") for i in range(4)]
    rows += [(10 + i, f"the mayor wrote on day {i}\nnothing from anyone") for i in range(30)] + [(99, "Xanadu"), (98, "kay@town.org in Xanadu")][1:]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    spans = {r.doc_id: r.s for r in pii.find(df).select("doc_id", pii.span_text("spans").alias("s")).collect()}
    text = rows[0][1]
    a, b = text.index("Xanadu"), text.rindex("Xanadu")
    assert re.findall(r"term:(\d+)", spans[0]) == [str(a), str(b)] and "email" in spans[0]
    assert all("term" not in spans[10 + i] for i in range(30)) and "term" in spans[98]
    clean = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    assert clean[98] == "[email] in [term]" and clean[10] == rows[4][1] and clean[0].count("[term]") == 2
    assert len(hashlib.sha256(clean[0].encode()).hexdigest()) == 64


def test_no_python_on_the_way(spark):
    df = spark.createDataFrame([(1, "a@b.co")], "doc_id long, text string")
    for d in (pii.find(df), pii.sanitise(df)):
        assert not re.search("Python|Pandas|Arrow", d._jdf.queryExecution().executedPlan().toString())


def test_partial_copies_of_long_items(spark):
    rng = random.Random(12)
    prose = lambda n: [f"w{rng.randrange(2000)}" for _ in range(n)]
    long, mid, short = prose(300), prose(400), prose(48)
    # a hundred words of 300; three parts of a short item, near and far apart; parts of 20 words of a long one; a question with its context left out
    docs = {1: prose(40) + long[90:190] + prose(40), 2: prose(30) + short[32:] + prose(9) + short[:16] + prose(200) + short[16:32] + prose(20),
            3: prose(50) + mid[:20] + prose(50) + mid[200:220] + prose(900) + mid[350:370], 4: prose(5) + mid[360:] + prose(5),
            # one part of a short item, also repeated; little of a long one
            10: prose(30) + short[:16] + prose(30), 11: (prose(9) + short[:16]) * 6, 12: prose(90) + long[20:40] + prose(90), 13: prose(3000)}
    df = spark.createDataFrame([(i, " ".join(w), "s", "t") for i, w in docs.items()], DOCS)
    bench = spark.createDataFrame([(1, " ".join(long)), (2, " ".join(short)), (3, " ".join(mid))], "item_id long, text string")
    out = {(r.doc_id, r.item_id): r for r in decontam.contaminated(df, bench).collect()}
    assert sorted(out) == [(1, 1), (2, 2), (3, 3), (4, 3)]
    assert out[1, 1].matched >= 100 and out[1, 1].first_word <= 40 and out[2, 2].matched >= 32 and out[3, 3].matched >= 40
    assert sorted(r.doc_id for r in decontam.remove_contaminated(df, bench).collect()) == [10, 11, 12, 13]


NAMES = [a + b for a in ("Quil", "Bras", "Vex", "Tor", "Mun", "Yel") for b in ("lon", "tock", "ler", "quist", "dahl")]


def _letters(rng):
    """Documents with an address each, among words that stand nowhere else; by each address its owner's name, at the end again."""
    word = lambda: "".join(rng.choices("abcdefghijklmnoprstuvwxyz", k=rng.randrange(5, 10)))
    rows = []
    for i, n in enumerate(NAMES):
        rare = [word() for _ in range(40)]
        rows.append((i, f"the mayor {n} of {' '.join(rare[:20])}\nwrote to {n.lower()}@town{i}.org and {' '.join(rare[20:])}\n" + "the mayor\n" * 90 + f"signed {n}"))
    rows += [(1000 + i, rows[3][1]) for i in range(50)]  # copies make nothing certain
    return rows + [(2000 + i, f"the mayor wrote to mail or call, signed number {i} of town") for i in range(200)]


def test_rare_words_are_no_terms_but_names_are(spark):
    rows = _letters(random.Random(5))
    out = {r.doc_id: [s.value.lower() for s in r.spans if s.kind == 4] for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    marked = [(NAMES[i].lower(), w) for i in range(len(NAMES)) for w in out[i]]
    assert sum(n != w for n, w in marked) < 0.05 * 40 * len(NAMES)
    assert all(out[i].count(n.lower()) == 2 for i, n in enumerate(NAMES))
    assert all(out[1000 + i] == out[3] for i in range(50)) and not any(out[2000 + i] for i in range(200))


def test_terms_of_often_seen_values(spark):
    # no letters in common: told by company in different surroundings, not by one that is copied
    rows = [(i, f"on day {i} ask Ottoline about {i * 7}\n+1 705 555 6638") for i in range(8)] + [(50 + i, "then ask Isambard\n+1 705 555 9999") for i in range(40)]
    rows += [(100 + i, f"on day {i} ask about it then") for i in range(300)]
    out = {r.doc_id: [s.value for s in r.spans if s.kind == 4] for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(out[i] == ["Ottoline"] for i in range(8)) and not any(out[d] for d in out if d >= 50)


@pytest.mark.parametrize("text", ["mail a{0}@b.co today friend\n", "a{0}@b.co friend "])
def test_work_grows_with_a_text_not_its_square(spark, text):
    rows = [(k, "".join(text.format(i * 10 + k) for i in range(20_000))) for k in range(3)]
    began = time.time()
    out = pii.find(spark.createDataFrame(rows, "doc_id long, text string")).select("n_email", F.size("spans").alias("n")).collect()
    assert all(r.n_email == 20_000 and r.n >= 20_000 for r in out) and time.time() - began < 90
