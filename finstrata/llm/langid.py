"""Language of whole documents from a bidirectional gated recurrent network over bytes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StructType

UNDETERMINED = "und"
#: Bytes of a segment. A text is read as consecutive segments; the network starts anew in each, in both directions.
SEGMENT = 64
#: Segments computed side by side.
LANES = 4096


@dataclass
class Model:
    """Weights by direction: byte table ``E`` (3H x 256), recurrence ``U`` (3H x H), its bias ``b``; output ``V``, ``c``.

    The rows of E, U and b are those of update gate, reset gate and candidate state.
    """

    langs: list[str]
    p: dict[str, np.ndarray]

    @property
    def hidden(self) -> int:
        return self.p["Uf"].shape[1]


def new_model(langs: list[str], hidden: int, seed: int) -> Model:
    rng = np.random.default_rng(seed)
    p = {}
    for d in "fb":
        p[f"E{d}"] = rng.normal(0, 0.3, (3 * hidden, 256))
        p[f"U{d}"] = rng.normal(0, 0.5 / np.sqrt(hidden), (3 * hidden, hidden))
        p[f"b{d}"] = np.zeros((3 * hidden, 1))
        p[f"V{d}"] = rng.normal(0, 0.3, (len(langs), hidden))
    p["c"] = np.zeros((len(langs), 1))
    return Model(langs, {k: v.astype(np.float32) for k, v in p.items()})


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _states(p: dict, d: str, x: np.ndarray, keep: bool = False):
    """Hidden states (T x H x N) of direction *d* over bytes *x* (T x N); with *keep* also what back-propagation needs."""
    steps, n = x.shape
    h3, hid = p[f"U{d}"].shape
    e, u, b = p[f"E{d}"], p[f"U{d}"], p[f"b{d}"]
    e = e + np.concatenate([b[: 2 * hid], np.zeros_like(b[2 * hid:])])  # the candidate's bias is inside the reset gate
    bn = b[2 * hid:]
    out, h, saved = np.empty((steps, hid, n), np.float32), np.zeros((hid, n), np.float32), {}
    for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
        a, g = np.take(e, x[t], axis=1), u @ h
        gates = _sigmoid(a[: 2 * hid] + g[: 2 * hid])
        z, r = gates[:hid], gates[hid:]
        inner = g[2 * hid:] + bn
        cand = np.tanh(a[2 * hid:] + r * inner)
        if keep:
            saved[t] = (h, z, r, inner, cand)
        h = cand + z * (h - cand)
        out[t] = h
    return out, saved


def _gradient(m: Model, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean cross-entropy over all positions of *x* (T x N) with labels *y* (N), and its gradient through time."""
    p, (steps, n), hid = m.p, x.shape, m.hidden
    states = {d: _states(p, d, x, keep=True) for d in "fb"}
    prob = _softmax(np.matmul(p["Vf"], states["f"][0]) + np.matmul(p["Vb"], states["b"][0]) + p["c"])
    loss = -np.log(prob[:, y, np.arange(n)] + 1e-9).mean()
    dl = prob
    dl[:, y, np.arange(n)] -= 1
    dl /= steps * n
    grad = {"c": dl.sum(axis=(0, 2))[:, None]}
    for d in "fb":
        out, saved = states[d]
        grad[f"V{d}"] = np.einsum("tln,thn->lh", dl, out)
        dh_out = np.matmul(p[f"V{d}"].T, dl)
        du, db, da_all = np.zeros_like(p[f"U{d}"]), np.zeros_like(p[f"b{d}"]), np.empty((steps, 3 * hid, n), np.float32)
        dh = np.zeros((hid, n), np.float32)
        for t in range(steps - 1, -1, -1) if d == "f" else range(steps):
            h, z, r, inner, cand = saved[t]
            dh = dh + dh_out[t]
            dcand = dh * (1 - z) * (1 - cand * cand)
            dz = dh * (h - cand) * z * (1 - z)
            dr = dcand * inner * r * (1 - r)
            dg = np.concatenate([dz, dr, dcand * r])
            du += dg @ h.T
            db += dg.sum(axis=1, keepdims=True)
            da_all[t] = np.concatenate([dz, dr, dcand])
            dh = dh * z + p[f"U{d}"].T @ dg
        grad[f"U{d}"], grad[f"b{d}"] = du, db
        flat = x.ravel()
        rows = da_all.transpose(1, 0, 2).reshape(3 * hid, -1)
        grad[f"E{d}"] = np.stack([np.bincount(flat, weights=row, minlength=256) for row in rows])
    return float(loss), grad


def train(texts: list[bytes], labels: list[str], hidden: int = 8, rounds: int = 160, batch: int = 256, seed: int = 0) -> Model:
    """A network fitted by back-propagation through time (Adam) on random segments of labelled *texts*."""
    langs = sorted(set(labels))
    m, rng = new_model(langs, hidden, seed), np.random.default_rng(seed)
    if len(langs) < 2:
        return m
    of = {k: np.flatnonzero([x == k and len(t) > 0 for x, t in zip(labels, texts, strict=True)]) for k in langs}
    of = {k: v for k, v in of.items() if len(v)}
    first, second = ({k: np.zeros(v.shape) for k, v in m.p.items()} for _ in range(2))
    for step in range(1, rounds + 1):
        x, y = np.full((SEGMENT, batch), 32, np.uint8), np.empty(batch, np.int64)
        for i in range(batch):
            k = list(of)[i % len(of)]
            t = texts[rng.choice(of[k])]
            at = rng.integers(0, max(len(t) - SEGMENT, 0) + 1)
            piece = np.frombuffer(t[at: at + SEGMENT], np.uint8)
            x[: len(piece), i], y[i] = piece, langs.index(k)
        _, grad = _gradient(m, x, y)
        rate = 0.03 * min(1.0, 2 * (1 - step / (rounds + 1)))
        for k, g in grad.items():
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            m.p[k] -= (rate * first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return m


def _fast_states(e: np.ndarray, u: np.ndarray, bn: np.ndarray, x: np.ndarray, backward: bool) -> np.ndarray:
    """As ``_states``, with the gates' rows halved beforehand so that one tanh serves them, and no new arrays in the loop."""
    steps, n = x.shape
    hid = u.shape[1]
    out = np.empty((steps, hid, n), np.float32)
    a, g, tmp = np.empty((3 * hid, n), np.float32), np.zeros((3 * hid, n), np.float32), np.empty((hid, n), np.float32)
    h = np.zeros((hid, n), np.float32)
    for t in range(steps - 1, -1, -1) if backward else range(steps):
        np.take(e, x[t], axis=1, out=a, mode="clip")
        np.matmul(u, h, out=g)
        gates, cand, inner = a[: 2 * hid], a[2 * hid:], g[2 * hid:]
        gates += g[: 2 * hid]
        np.tanh(gates, out=gates)
        gates *= 0.5
        gates += 0.5
        inner += bn
        inner *= gates[hid:]
        cand += inner
        np.tanh(cand, out=cand)
        np.subtract(h, cand, out=tmp)
        tmp *= gates[:hid]
        np.add(cand, tmp, out=out[t])
        h = out[t]
    return out


def document_probabilities(m: Model, texts: list[bytes]) -> np.ndarray:
    """Languages' probabilities for each text: the mean over all its bytes of those that the network gives each position."""
    p, hid = m.p, m.hidden
    half = np.concatenate([np.full(2 * hid, 0.5), np.ones(hid)]).astype(np.float32)[:, None]
    fast = {}
    for d in "fb":
        e = p[f"E{d}"] + np.concatenate([p[f"b{d}"][: 2 * hid], np.zeros((hid, 1), np.float32)])
        fast[d] = (np.ascontiguousarray(e * half), np.ascontiguousarray(p[f"U{d}"] * half), p[f"b{d}"][2 * hid:])
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(texts) else np.zeros(0, np.int64)
    data = np.frombuffer(b"".join(texts) + b" " * SEGMENT, np.uint8)
    counts = -(-sizes // SEGMENT)
    doc = np.repeat(np.arange(len(texts)), counts)
    within = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)
    at, valid = starts[doc] + within * SEGMENT, np.minimum(sizes[doc] - within * SEGMENT, SEGMENT)
    total = np.zeros((len(m.langs), len(texts)))
    for i in range(0, len(doc), LANES):
        a, v, o = at[i: i + LANES], valid[i: i + LANES], doc[i: i + LANES]
        steps = np.arange(SEGMENT)[:, None]
        inside = steps < v
        x = np.where(inside, data[a + steps], np.uint8(32))
        prob = np.matmul(p["Vf"], _fast_states(*fast["f"], x, False))
        prob += np.matmul(p["Vb"], _fast_states(*fast["b"], x, True))
        prob += p["c"]
        np.exp(np.minimum(prob, 60, out=prob), out=prob)
        prob *= (inside / prob.sum(axis=1))[:, None, :]
        pooled = prob.sum(axis=0)
        for k in range(len(m.langs)):
            total[k] += np.bincount(o, weights=pooled[k], minlength=len(texts))
    return (total / np.maximum(sizes, 1)).T


def predict(m: Model, texts: list[str | None]) -> pd.DataFrame:
    known = [i for i, t in enumerate(texts) if t is not None and any(map(str.isalpha, t))]
    lang, score = np.full(len(texts), UNDETERMINED, object), np.zeros(len(texts))
    if m.langs and known:
        prob = document_probabilities(m, [texts[i].encode("utf-8", "replace") for i in known])
        best = prob.argmax(axis=1)
        lang[known], score[known] = np.array(m.langs, object)[best], np.clip(prob.max(axis=1), 0, 1)
    return pd.DataFrame({"lang_pred": lang, "score": score})


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", per_lang: int = 400, chars: int = 600, max_langs: int = 200, seed: int = 0, **training) -> Model:
    """A model from about *per_lang* rows of each language, of each row *chars* characters from a place of its own.

    Rows are taken by their text's hash, copies once, so the sample is the same at each run, spreads over the whole table
    and is bounded by 2 x *per_lang* x *max_langs* rows of *chars* characters. Rows with null or empty text or null language don't count; more than
    *max_langs* languages are an error. Without labelled rows the model knows no language and predicts ``und``.
    """
    own = F.xxhash64(F.col(text))
    usable = labelled.where(F.col(lang).isNotNull() & (F.length(text) > 0)).select(F.col(text).alias("text"), F.col(lang).alias("lang"), own.alias("h"))
    counts = {r["lang"]: r["n"] for r in labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).groupBy(F.col(lang).alias("lang")).agg(F.count("*").alias("n")).limit(max_langs + 1).collect()}
    if len(counts) > max_langs:
        raise ValueError(f"more than {max_langs} languages")
    if not counts:
        return Model([], new_model([], training.get("hidden", 8), seed).p)
    wanted = F.lit(False)
    for k, n in counts.items():
        wanted = wanted | ((F.col("lang") == k) & (F.pmod("h", F.lit(1 << 30)) < F.lit(int(min(1.0, per_lang / n) * (1 << 30)))))
    place = F.pmod(F.shiftright("h", 30), F.greatest(F.length("text") - chars, F.lit(1))).cast("int") + 1
    rows = usable.where(wanted).select(F.substring("text", place, chars).alias("text"), "lang", "h").distinct().orderBy("h", "lang", "text").limit(2 * per_lang * len(counts)).collect()
    return train([r["text"].encode("utf-8", "replace") for r in rows], [r["lang"] for r in rows], seed=seed, **training)


def label(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds ``lang_pred`` and ``score`` (its pooled probability) to each row of *df*, from the whole text alone.

    Null texts and texts without a letter get ``und`` and 0. Rows stay as they are; columns named like the added ones
    are replaced.
    """
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            yield predict(model, batch.tolist())

    f = pandas_udf(of, StructType.fromDDL("lang_pred string, score double"))
    return df.drop("lang_pred", "score").withColumn("_l", f(F.col(text))).select("*", "_l.lang_pred", "_l.score").drop("_l")


def held_out(doc_id: Column) -> Column:
    """Documents that training never sees: crc32 of the id as text leaves 2 when divided by 4 (null: none)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))
