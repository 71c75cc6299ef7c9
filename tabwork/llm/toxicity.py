"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy, that scores every overlapping
window of a text; a text's score is that of its worst window.

The input of a word is a learned vector (words of the training sample; one vector for all others) beside a projection of
its character trigrams. Training sees labels of whole texts only: each epoch scores all windows of a sample text, and its
highest window stands for it. Learned vectors begin with the log-odds of their word.

Windows begin every `stride` words, half a window, so each passage of up to 21 words lies whole in one. The training
sample is bounded (`toxic_rows` + `clean_rows` labelled texts of smallest hash) and trained on the driver; scoring runs in
the tasks, in chunks of bounded size. Of a sample text of more than `longest_text` characters, `pieces` passages of equal
length are learned, evenly spaced from its first character to its last, which together have `longest_text`; no window lies
across two of them. What makes such a text toxic may be in none of them; this concerns the training only.

Defined results for odd input: a null or empty text gets the network's score of no words at all; labels that are null take
no part, nor do labels of unknown documents or of documents without an id; a label that is there twice counts once (one
of each class: as both), and where rows share an id the least of their texts is learned; equal texts get equal scores; a
text of any length is scored whole; an empty table gives an empty table; without labels of both classes every score is
0; input columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import text_of
from .shingles import in_chunks

_WORD = re.compile(r"\w+")
_f = np.float32


@dataclass(frozen=True)
class Network:
    window: int = 40
    stride: int = 20
    hidden: int = 12
    word_dims: int = 8
    char_dims: int = 16
    attention: int = 12
    trigrams: int = 4096
    most_words: int = 20_000
    least_texts: int = 5
    toxic_rows: int = 1500
    clean_rows: int = 3000
    longest_text: int = 200_000
    pieces: int = 20
    #: distinct words whose projections a worker keeps; beyond it they start anew
    cached_words: int = 100_000
    #: passes over the sample; small samples get more, in smaller batches, until there were `least_steps`
    epochs: int = 10
    least_steps: int = 500
    batch: int = 256
    rate: float = 4e-3
    threshold: float = 0.7
    seed: int = 7


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


@lru_cache(maxsize=4)
def _trigram_table(seed: int, trigrams: int, dims: int) -> np.ndarray:
    return np.random.default_rng(seed).normal(size=(trigrams, dims)).astype(_f)


class _Words(dict):
    """word -> number, in order of first use; `new` lists the words that came since it was last emptied."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self.new.append(word)
        self[word] = n = len(self)
        return n


def char_features(words: list[str], how: Network) -> np.ndarray:
    """The mean of fixed random vectors of each word's character trigrams, with marks for its ends."""
    table = _trigram_table(how.seed, how.trigrams, how.char_dims)
    if not words:
        return np.zeros((0, how.char_dims), _f)
    data = np.frombuffer("".join(f"\x02{w}\x03" for w in words).encode("utf-32-le"), dtype="<u4").astype(np.uint64)
    sizes = np.array([len(w) + 2 for w in words])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    codes = ((data[:-2] * np.uint64(0x9E3779B1) + data[1:-1] * np.uint64(0x85EBCA77) + data[2:] * np.uint64(0xC2B2AE3D)) >> np.uint64(7)) % np.uint64(how.trigrams)
    # trigrams that reach into the next word are dropped
    inside = np.ones(len(data), bool)
    inside[starts[1:] - 1] = inside[starts[1:] - 2] = False
    inside[-2:] = False
    vectors = np.zeros((len(data), how.char_dims), _f)
    vectors[:-2] = table[codes.astype(np.int64)]
    vectors[~inside] = 0
    return np.add.reduceat(vectors, starts, axis=0) / np.maximum(sizes - 2, 1)[:, None].astype(_f)


#: between the passages of a long sample text; no text of the sample holds it otherwise
CUT = "\x1d"


def sample_windows(text: str, how: Network) -> tuple[list[str], list[tuple[int, int]]]:
    """The words of a sample text and its windows, those of each passage by themselves."""
    words, cuts = [], []
    for passage in text.split(CUT):
        own = words_of(passage)
        if own or not cuts:
            cuts += [(len(words) + a, len(words) + b) for a, b in windows(len(own), how)]
        words += own
    return words, cuts


def windows(n: int, how: Network) -> list[tuple[int, int]]:
    """(start, end) of the overlapping windows of n words; one empty window where there are none."""
    last = max(n - how.window, 0)
    starts = [*range(0, last, how.stride), last]
    return [(s, min(s + how.window, n)) for s in starts]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return _f(0.5) * np.tanh(_f(0.5) * x) + _f(0.5)


def _gru(x: np.ndarray, mask: np.ndarray | None, u: np.ndarray, v: np.ndarray, keep: bool):
    """x: (T, B, 3H) input parts of update, reset and candidate; states (T, B, H)."""
    steps, rows, h3 = x.shape
    size = h3 // 3
    h, out, saved = np.zeros((rows, size), _f), np.empty((steps, rows, size), _f), []
    for t in range(steps):
        gates = _sigmoid(x[t, :, :2 * size] + h @ u)
        z, r = gates[:, :size], gates[:, size:]
        c = np.tanh(x[t, :, 2 * size:] + (r * h) @ v)
        new = h + z * (c - h)
        if mask is not None:
            new = np.where(mask[t][:, None], new, h)
        if keep:
            saved.append((h, z, r, c))
        h = out[t] = new
    return out, saved


def _gru_back(d_out: np.ndarray, mask: np.ndarray, u: np.ndarray, v: np.ndarray, saved: list):
    steps, rows, size = d_out.shape
    dx, du, dv, dh = np.zeros((steps, rows, 3 * size), _f), np.zeros_like(u), np.zeros_like(v), np.zeros((rows, size), _f)
    for t in range(steps - 1, -1, -1):
        h, z, r, c = saved[t]
        full = dh + d_out[t]
        d = full * mask[t][:, None]
        dc = d * z * (1 - c * c)
        rh = dc @ v.T
        dz, dr = d * (c - h) * z * (1 - z), rh * h * r * (1 - r)
        dzr = np.concatenate([dz, dr], axis=1)
        dx[t] = np.concatenate([dzr, dc], axis=1)
        du += h.T @ dzr
        dv += (r * h).T @ dc
        dh = full * ~mask[t][:, None] + d * (1 - z) + rh * r + dzr @ u.T
    return dx, du, dv


class Model:
    """The trained network; small enough to travel with the tasks."""

    def __init__(self, how: Network, vocabulary: dict[str, int], first: np.ndarray):
        rng, h, d = np.random.default_rng(how.seed), how.hidden, how.word_dims + how.char_dims
        self.how, self.vocabulary = how, vocabulary
        draw = lambda *s: (rng.normal(size=s) / np.sqrt(s[0])).astype(_f)
        self.p = {"words": draw(len(vocabulary) + 1, how.word_dims) * _f(0.1), "in": draw(d, 6 * h), "bias": np.zeros(6 * h, _f),
                  "u0": draw(h, 2 * h), "v0": draw(h, h), "u1": draw(h, 2 * h), "v1": draw(h, h),
                  "att": draw(2 * h, how.attention), "query": draw(how.attention), "out": draw(2 * h), "base": np.full(1, -2, _f)}
        self.p["words"][:, 0] = first

    def project(self, ids: np.ndarray, chars: np.ndarray) -> np.ndarray:
        """What the gates of both directions get from each word."""
        return np.concatenate([self.p["words"][ids], chars], axis=1) @ self.p["in"] + self.p["bias"]

    def forward(self, x: np.ndarray, mask: np.ndarray | None, keep: bool = False):
        """x: (T, B, 6H) -> logits (B)."""
        p, h = self.p, 3 * self.how.hidden
        a, sa = _gru(x[:, :, :h], mask, p["u0"], p["v0"], keep)
        b, sb = _gru(x[::-1, :, h:], None if mask is None else mask[::-1], p["u1"], p["v1"], keep)
        states = np.concatenate([a, b[::-1]], axis=2)
        tanh = np.tanh(states @ p["att"])
        weight = tanh @ p["query"]
        if mask is not None:
            weight = np.where(mask, weight, _f(-1e9))
        weight = np.exp(weight - weight.max(axis=0))
        if mask is not None:
            weight = weight * mask
        weight = weight / np.maximum(weight.sum(axis=0), _f(1e-9))
        pooled = (weight[:, :, None] * states).sum(axis=0)
        return pooled @ p["out"] + p["base"][0], (sa, sb, states, tanh, weight, pooled)

    def gradients(self, ids: np.ndarray, chars: np.ndarray, mask: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        p, h = self.p, self.how.hidden
        steps, rows = mask.shape
        inputs = np.concatenate([p["words"][ids], chars], axis=2)
        logits, (sa, sb, states, tanh, weight, pooled) = self.forward(inputs @ p["in"] + p["bias"], mask, True)
        d = (_sigmoid(logits) - labels) / rows
        g = {"out": pooled.T @ d, "base": d.sum(keepdims=True)}
        dp = d[:, None] * p["out"][None]
        dw = (states * dp[None]).sum(axis=2)
        dw = weight * (dw - (weight * dw).sum(axis=0))
        dt = dw[:, :, None] * p["query"] * (1 - tanh * tanh)
        g["query"], g["att"] = (tanh * dw[:, :, None]).sum(axis=(0, 1)), np.einsum("tbs,tba->sa", states, dt)
        ds = weight[:, :, None] * dp[None] + dt @ p["att"].T
        dxa, g["u0"], g["v0"] = _gru_back(ds[:, :, :h], mask, p["u0"], p["v0"], sa)
        dxb, g["u1"], g["v1"] = _gru_back(ds[::-1, :, h:], mask[::-1], p["u1"], p["v1"], sb)
        dx = np.concatenate([dxa, dxb[::-1]], axis=2).reshape(steps * rows, -1)
        flat = inputs.reshape(steps * rows, -1)
        g["in"], g["bias"] = flat.T @ dx, dx.sum(axis=0)
        g["words"] = np.zeros_like(p["words"])
        np.add.at(g["words"], ids.reshape(-1), (dx @ p["in"].T)[:, :self.how.word_dims])
        return {k: v.astype(_f) for k, v in g.items()}

    def window_logits(self, table: np.ndarray, at: np.ndarray, cuts: list[tuple[int, int]]) -> np.ndarray:
        """Logits of windows over a text stream; table: projected words, at: row of each word, cuts: (start, end)."""
        how, out = self.how, np.empty(len(cuts), _f)
        bounds = np.array(cuts, dtype=np.int64).reshape(-1, 2)
        full = bounds[:, 1] - bounds[:, 0] == how.window
        for group, whole in ((np.flatnonzero(full), True), (np.flatnonzero(~full), False)):
            for k in range(0, len(group), 1024):
                part = group[k:k + 1024]
                place = bounds[part, 0][None] + np.arange(how.window)[:, None]
                mask = None if whole else place < bounds[part, 1][None]
                rows = at[np.minimum(place, max(len(at) - 1, 0))] if len(at) else np.zeros(place.shape, np.int64)
                out[part] = self.forward(table[rows], mask)[0]
        return out

    def score(self, texts: list[str]) -> np.ndarray:
        """Scores of texts; a word is projected when it first comes up."""
        how = self.how
        if getattr(self, "_known", None) is None or len(self._known) > how.cached_words:
            self._known, self._table = _Words(), np.zeros((0, 6 * how.hidden), _f)
        known = self._known
        listed = [words_of(t) for t in texts]
        at = np.fromiter(map(known.__getitem__, chain.from_iterable(listed)), dtype=np.int64)
        if known.new:
            ids = np.array([self.vocabulary.get(w, 0) for w in known.new], dtype=np.int64)
            self._table = np.concatenate([self._table, self.project(ids, char_features(known.new, how))])
            known.new = []
        table = self._table if len(self._table) else np.zeros((1, 6 * how.hidden), _f)
        cuts, first, base = [], [], 0
        for ws in listed:
            first.append(len(cuts))
            cuts += [(base + a, base + b) for a, b in windows(len(ws), how)]
            base += len(ws)
        logits = self.window_logits(table, at, cuts)
        return _sigmoid(np.maximum.reduceat(logits, first)).astype(np.float64) if texts else np.zeros(0)


def train(texts: list[str], labels: list[int], how: Network = Network()) -> Model:
    parts, y = [sample_windows(t, how) for t in texts], np.array(labels, dtype=_f)
    listed = [ws for ws, _ in parts]
    hits = [Counter(), Counter()]
    for ws, label in zip(listed, labels):
        hits[int(label)].update(set(ws))
    both = hits[0] + hits[1]
    chosen = [w for w, n in sorted(both.items(), key=lambda x: (-x[1], x[0]))[:how.most_words] if n >= how.least_texts]
    vocabulary = {w: i + 1 for i, w in enumerate(chosen)}
    totals = [max(len(y) - y.sum(), 1), max(y.sum(), 1)]
    odds = [0.0, *(np.log((hits[1][w] + 0.5) / (totals[1] + 1)) - np.log((hits[0][w] + 0.5) / (totals[0] + 1)) for w in chosen)]
    odds = np.clip(np.array(odds), -4, 4).astype(_f) / 2
    model, rng = Model(how, vocabulary, odds), np.random.default_rng(how.seed)
    own = sorted({w for ws in listed for w in ws})
    rank = {w: i for i, w in enumerate(own)}
    ids, chars = np.array([vocabulary.get(w, 0) for w in own]), char_features(own, how)
    at = np.array([rank[w] for ws in listed for w in ws], dtype=np.int64)
    cuts, first, base = [], [], 0
    for ws, own in parts:
        first.append(len(cuts))
        cuts += [(base + a, base + b) for a, b in own]
        base += len(ws)
    ends, spans = np.append(first, len(cuts)), np.array(cuts)
    moment = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in model.p.items()}
    step, batch = 0, min(how.batch, max(16, len(listed) // 12))
    epochs = max(how.epochs, -(-how.least_steps * batch // (2 * len(listed))))
    for epoch in range(epochs):
        if epoch == 0:
            value = np.array([odds[ids[at[a:b]]].max(initial=0) for a, b in cuts])
        else:
            value = model.window_logits(model.project(ids, chars), at, cuts)
        worst = np.array([a + int(np.argmax(value[a:b])) for a, b in zip(ends[:-1], ends[1:])])
        # one more window of each clean text, as all of its windows are clean
        clean = np.flatnonzero(y == 0)
        other = np.array([rng.integers(ends[i], ends[i + 1]) for i in clean], dtype=np.int64)
        picked, target = np.concatenate([worst, other]), np.concatenate([y, np.zeros(len(clean), _f)])
        order = rng.permutation(len(picked))
        for k in range(0, len(order), batch):
            part = order[k:k + batch]
            place = spans[picked[part], 0][None] + np.arange(how.window)[:, None]
            mask = place < spans[picked[part], 1][None]
            rows = at[np.minimum(place, len(at) - 1)]
            step += 1
            for name, g in model.gradients(ids[rows], chars[rows], mask, target[part]).items():
                m, v = moment[name]
                m += _f(0.1) * (g - m)
                v += _f(0.001) * (g * g - v)
                model.p[name] -= _f(how.rate) * (m / _f(1 - 0.9 ** step)) / (np.sqrt(v / _f(1 - 0.999 ** step)) + _f(1e-8))
    return model


def passages(text: Column, how: Network) -> Column:
    """A text of up to `longest_text` characters as it is, of a longer one `pieces` evenly spaced passages."""
    size, n = how.longest_text // how.pieces, F.char_length(text)
    plain = F.translate(text, CUT, " ")
    step = (n - size) / F.lit(max(how.pieces - 1, 1))
    cut = F.transform(F.sequence(F.lit(0), F.lit(how.pieces - 1)), lambda i: F.substring(plain, (F.floor(i * step) + 1).cast("int"), F.lit(size)))
    return F.when(n <= how.longest_text, plain).otherwise(F.array_join(cut, CUT))


def sample(docs: DataFrame, labels: DataFrame, how: Network) -> tuple[list[str], list[int]]:
    """The bounded training sample: texts and labels; rows of smallest hash of each class."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", (F.col("toxic") > 0).cast("int").alias("toxic")).distinct()
    order = F.xxhash64(F.lit(how.seed), F.col("doc_id"))
    picked = known.filter("toxic = 1").orderBy(order, "doc_id").limit(how.toxic_rows).union(known.filter("toxic = 0").orderBy(order, "doc_id").limit(how.clean_rows))
    texts = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(picked), "doc_id")
    rows = texts.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).withColumn("text", passages(F.col("text"), how)).collect()
    rows.sort(key=lambda r: (r["doc_id"], r["toxic"]))
    return [r["text"] for r in rows], [r["toxic"] for r in rows]


def scored(docs: DataFrame, labels: DataFrame, how: Network = Network()) -> DataFrame:
    """doc_id, score, predicted for every document; labels: the rows to learn from."""
    texts, marks = sample(docs, labels, how)
    model = train(texts, marks, how) if len(set(marks)) == 2 else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, part in in_chunks(b, 1 << 19):
                scores = model.score(part) if model else np.zeros(len(part))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    out = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")
    return out.withColumn("predicted", (F.col("score") >= how.threshold).cast("int"))


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic").filter(~held)
    return scored(docs, labels).select("doc_id", held.alias("held_out"), "score", "predicted")
