import zlib

import numpy as np

from finstrata.llm import langid
from finstrata.llm.queries import QUERIES

WORDS = {"aa": "the of and to in that with from this have", "bb": "der die und nicht auch über schön größe für müssen", "cc": "où été très français garçon déjà après même être là"}


def _texts(k, n, seed):
    rng = np.random.default_rng(seed)
    return [" ".join(rng.choice(WORDS[k].split(), rng.integers(3, 60))) for _ in range(n)]


def test_gradient_through_time():
    rng = np.random.default_rng(0)
    m = langid.new_model(["a", "b", "c"], 3, 1)
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    x, y = rng.integers(97, 103, (7, 5)).astype(np.uint8), rng.integers(0, 3, 5)
    real = langid._states
    langid._states = lambda p, d, x, keep=False: _double(real, p, d, x, keep)
    try:
        _, grad = langid._gradient(m, x, y)
        for name in m.p:
            for at in [(0, 0), (m.p[name].shape[0] - 1, m.p[name].shape[1] - 1), (m.p[name].shape[0] // 2, min(99, m.p[name].shape[1] - 1))]:
                keep, step = m.p[name][at], 1e-2
                m.p[name][at] = keep + step
                up, _ = langid._gradient(m, x, y)
                m.p[name][at] = keep - step
                down, _ = langid._gradient(m, x, y)
                m.p[name][at] = keep
                assert abs((up - down) / (2 * step) - grad[name][at]) < 2e-4 + 0.02 * abs(grad[name][at]), (name, at)
    finally:
        langid._states = real


def _double(real, p, d, x, keep):
    out, saved = real(p, d, x, keep)
    return out.astype(np.float64), saved


def test_fast_pass_is_the_network_and_segments_cover_whole_texts():
    m = langid.train([t.encode() for k in WORDS for t in _texts(k, 40, 1)], [k for k in WORDS for _ in range(40)], rounds=40)
    t = ("the of und être " * 20).encode()
    want = np.zeros(3)
    for a in range(0, len(t), langid.SEGMENT):
        x = np.frombuffer(t[a: a + langid.SEGMENT], np.uint8)
        pad = np.concatenate([x, np.full(langid.SEGMENT - len(x), 32, np.uint8)])[:, None]
        prob = langid._softmax(np.matmul(m.p["Vf"], langid._states(m.p, "f", pad)[0]) + np.matmul(m.p["Vb"], langid._states(m.p, "b", pad)[0]) + m.p["c"])
        want += prob[: len(x), :, 0].sum(axis=0)
    assert np.allclose(langid.document_probabilities(m, [b"x", t, b""])[1], want / len(t), atol=1e-4)


def test_rows(spark):
    rows = [(k, t) for k in WORDS for t in _texts(k, 60, 2)] + [(None, "of the"), ("aa", None), ("bb", "")]
    df = spark.createDataFrame(rows, "lang string, text string")
    model = langid.fit(df, rounds=60)
    assert model.langs == ["aa", "bb", "cc"]
    probe = [*((k, t) for k in WORDS for t in _texts(k, 40, 3)), ("und", None), ("und", ""), ("und", "12 + 3 = ?"), ("aa", "the of and " * 40_000), ("aa", "the of and " * 40_000)]
    out = langid.label(spark.createDataFrame([(k, t, 5.0) for k, t in probe], "want string, text string, score double"), model).collect()
    assert len(out) == len(probe) and np.mean([r.want == r.lang_pred for r in out]) > 0.97
    assert all(0 <= r.score <= 1 and (r.lang_pred != "und" or r.score == 0) for r in out)
    none = langid.fit(df.limit(0))
    assert langid.label(df, none).select("lang_pred").distinct().collect()[0][0] == "und"
    assert langid.label(df.limit(0), model).count() == 0


def test_held_out_accuracy(spark):
    out = QUERIES["op3_language_id"](spark, "/root/testdata/sf0.001").toPandas()
    lang = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "lang").toPandas()
    both = out.merge(lang, on="doc_id")
    assert (both["held_out"] == [zlib.crc32(str(i).encode()) % 4 == 2 for i in both["doc_id"]]).all()
    own = both[both["held_out"] & both["lang"].notna()]
    assert (own["lang"] == own["lang_pred"]).mean() > 0.95
