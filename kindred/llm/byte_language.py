"""Operator 11: language of a text by a convolutional network over bytes.

A text is cut into fixed windows of ``WINDOW`` bytes of UTF-8 that overlap by the widest filter less one, so every run
of bytes that a filter can see stands in one of them; the last is filled up with zeros. Bytes are embedded, filters of
several widths run over them, each is pooled by its maximum over the window and a linear layer gives one value for each
language. The values of a text are the means over its windows, weighted by the bytes in them; their softmax is the score.

The network is trained here, in numpy (Adam, cross-entropy), on the driver: on windows of at most about ``PER_LANGUAGE``
labelled documents of each language, taken by the smallest hashes of their keys, and at most ``PER_DOCUMENT`` windows of
each, spread evenly over it: a bounded sample. Only these windows reach the driver (256 bytes each). Prediction is one
pass over all whole texts, without a shuffle: the first layers become tables over pairs of bytes, so a width costs
one or two look-ups at each place, and a few windows are worked on at once whatever the length of a text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm.tables import table

WINDOW = 256
#: The tables over pairs of bytes are laid out for these widths.
WIDTHS, FILTERS, EMBED = (2, 3, 4), 24, 8
STRIDE = WINDOW - max(WIDTHS) + 1
#: Bounds of the labelled sample: documents of a language, windows of a document.
PER_LANGUAGE, PER_DOCUMENT = 1000, 6
#: Steps of training and windows in each.
STEPS, BATCH = 500, 64
#: Windows that are worked on at once.
AT_ONCE = 32
UNKNOWN = "und"


@dataclass
class Network:
    """``languages`` in order, and the weights: ``embed`` (256, EMBED), and for each width ``filters`` (width, EMBED, FILTERS) and ``bias``; ``out`` and ``shift`` of the last layer."""

    languages: list[str]
    embed: np.ndarray
    filters: list[np.ndarray]
    bias: list[np.ndarray]
    out: np.ndarray
    shift: np.ndarray
    tables: tuple[np.ndarray, np.ndarray] | None = field(default=None, repr=False)

    @classmethod
    def fresh(cls, languages: list[str], rng: np.random.Generator) -> Network:
        n = lambda *shape, by: (rng.standard_normal(shape) / np.sqrt(by)).astype(np.float32)
        total = FILTERS * len(WIDTHS)
        return cls(
            languages, n(256, EMBED, by=1), [n(w, EMBED, FILTERS, by=w * EMBED) for w in WIDTHS], [np.zeros(FILTERS, np.float32) for _ in WIDTHS],
            n(total, len(languages), by=total), np.zeros(len(languages), np.float32),
        )

    def weights(self) -> list[np.ndarray]:
        return [self.embed, *self.filters, *self.bias, self.out, self.shift]

    def by_pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """What a pair of bytes adds to the filters of all widths where it starts them, and to those of widths 3 and 4 two bytes later (for width 3 its first byte alone)."""
        if self.tables is None:
            one = [[self.embed @ f[i] for i in range(len(f))] for f in self.filters]
            pair = lambda a, b: (a[:, None] + b[None]).reshape(-1, FILTERS)
            first = np.concatenate([pair(o[0] + b, o[1]) for o, b in zip(one, self.bias, strict=True)], axis=1)
            self.tables = first, np.concatenate([pair(o[2], o[3] if len(o) > 3 else np.zeros_like(o[2])) for o in one[1:]], axis=1)
        return self.tables

    def pooled(self, windows: np.ndarray) -> np.ndarray:
        """Largest value of each filter in each window (rows of WINDOW bytes), none below 0."""
        first, later = self.by_pairs()
        pair = windows.astype(np.intp) << 8
        pair[:, :-1] |= windows[:, 1:]
        z = first.take(pair[:, :-1], axis=0, mode="clip")
        z[:, : WINDOW - 2, FILTERS:] += later.take(pair[:, 2:], axis=0, mode="clip")
        for k, w in enumerate(WIDTHS):
            z[:, WINDOW - w + 1 :, k * FILTERS : (k + 1) * FILTERS] = 0  # no place for this width: a 0 changes no maximum that counts
        return np.maximum(z.max(axis=1), 0)

    def values(self, windows: np.ndarray) -> np.ndarray:
        return self.pooled(windows) @ self.out + self.shift

    def step(self, windows: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean cross-entropy of the windows and its gradients, in the order of ``weights``.

        The maximum lets the gradient through at one place for each filter and window, so going back costs little.
        """
        rows, e, pooled, at = np.arange(len(windows))[:, None], self.embed[windows], [], []
        for w, f, b in zip(WIDTHS, self.filters, self.bias, strict=True):
            n = WINDOW - w + 1
            z = np.concatenate([e[:, i : i + n] for i in range(w)], axis=2) @ f.reshape(-1, FILTERS)
            at.append(z.argmax(axis=1))
            pooled.append(np.take_along_axis(z, at[-1][:, None], axis=1)[:, 0] + b)
        h = np.concatenate(pooled, axis=1)
        active = np.maximum(h, 0)
        v = active @ self.out + self.shift
        v -= v.max(axis=1, keepdims=True)
        p = np.exp(v)
        p /= p.sum(axis=1, keepdims=True)
        loss = float(-np.log(p[rows[:, 0], y] + 1e-12).mean())
        p[rows[:, 0], y] -= 1
        p /= len(y)
        back = (p @ self.out.T) * (h > 0)
        d_embed, d_filters, d_bias = np.zeros_like(self.embed), [], []
        for k, w in enumerate(WIDTHS):
            g = back[:, k * FILTERS : (k + 1) * FILTERS]
            seen = windows[rows[:, :, None], at[k][:, :, None] + np.arange(w)]  # window, filter, offset
            d_filters.append(np.einsum("bf,bfwe->wef", g, self.embed[seen], optimize=True))
            d_bias.append(g.sum(axis=0))
            np.add.at(d_embed, seen, np.einsum("bf,wef->bfwe", g, self.filters[k], optimize=True))
        return loss, [d_embed, *d_filters, *d_bias, active.T @ p, p.sum(axis=0)]


def cut(data: np.ndarray, first: np.ndarray, last: np.ndarray, most: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(text, start, end)`` of the windows of texts that lie at ``first`` to ``last`` in ``data``: one at least for each; ``most`` of them, spread evenly, if that is given."""
    n = np.maximum(1, -(-(last - first - (WINDOW - STRIDE)) // STRIDE))
    take = n if most is None else np.minimum(n, most)
    text = np.repeat(np.arange(len(first)), take)
    turn = np.arange(len(text)) - np.repeat(np.cumsum(take) - take, take)
    start = first[text] + turn * n[text] // take[text] * STRIDE
    return text, start, np.minimum(start + WINDOW, last[text])


def laid_out(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Windows as rows of WINDOW bytes, zeros behind their end."""
    at = start[:, None] + np.arange(WINDOW)
    inside = at < end[:, None]
    return np.where(inside, data[np.where(inside, at, 0)] if len(data) else 0, 0).astype(np.uint8)


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bytes of a column of texts, and where each text begins and ends; null counts as empty."""
    column = texts.cast(pa.large_string()).fill_null("").cast(pa.large_binary())
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8), ends[:-1], ends[1:]


def train(windows: np.ndarray, y: np.ndarray, languages: list[str], steps: int = STEPS, batch: int = BATCH, rate: float = 0.004, seed: int = 11) -> Network:
    """A network for rows of windows with the numbers of their languages; each language is drawn equally often.

    Half of the windows of a step are cut to a random length, so that short texts are learnt too. Without windows
    the weights stay as drawn.
    """
    rng = np.random.default_rng(seed)
    net = Network.fresh(languages, rng)
    if not len(y):
        return net
    present = np.unique(y)
    own = [np.flatnonzero(y == k) for k in present]
    params = net.weights()
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for t in range(1, steps + 1):
        i = np.array([own[k][rng.integers(len(own[k]))] for k in rng.integers(len(present), size=batch)])
        x = windows[i]
        length = np.where(rng.random(batch) < 0.5, rng.integers(6, WINDOW, batch), WINDOW)
        loss, grads = net.step(np.where(np.arange(WINDOW) < length[:, None], x, 0).astype(np.uint8), y[i])
        now = rate * min(1.0, 2 * (1 - t / (steps + 1)))
        for p, g, a, b in zip(params, grads, m, v, strict=True):
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            p -= (now * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.99**t)) + 1e-8)).astype(np.float32)
    return net


def fit(docs: DataFrame, usable: Column | None = None, key: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE, per_document: int = PER_DOCUMENT, steps: int = STEPS) -> Network:
    """A network trained on documents whose key, text and language are not null, and for which ``usable`` holds.

    Rows of a language are taken where the hash of their key lies below the share that gives ``per_language`` of them,
    and no more than twice as many in all; a repeated row may teach twice. Texts without a letter teach nothing. A table
    without such rows gives a network that knows no language. The languages are the distinct values of the column, taken
    to be a label set (their counts come to the driver).
    """
    known = docs.where(F.col(lang).isNotNull() & F.col(key).isNotNull() & has_letter(F.col(text)))
    known = (known.where(usable) if usable is not None else known).select(F.xxhash64(F.col(key).cast("string")).alias("h"), F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(counts)
    if not languages:
        return train(np.zeros((0, WINDOW), np.uint8), np.zeros(0, np.int64), [])
    place = F.shiftrightunsigned("h", 1).cast("double") / F.lit(2.0**63)
    share = F.element_at(F.create_map(*[F.lit(x) for k in languages for x in (k, min(1.0, per_language / counts[k]))]), F.col("lang"))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, first, last = bytes_of(b["text"])
            of, start, end = cut(data, first, last, per_document)
            rows = laid_out(data, start, end)
            cuts = np.searchsorted(of, np.arange(len(first) + 1))
            packed = [rows[i:j].tobytes() for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b["h"], b["lang"].cast(pa.string()), pa.array(packed, pa.binary())], ["h", "lang", "w"])

    sample = known.where(place < share).mapInArrow(windows, "h long, lang string, w binary").orderBy("h", "lang", "w").limit(2 * per_language * len(languages)).toArrow()
    parts = [np.frombuffer(w, np.uint8).reshape(-1, WINDOW) for w in sample["w"].to_pylist()]
    number = {k: i for i, k in enumerate(languages)}
    y = np.repeat(np.array([number[k] for k in sample["lang"].to_pylist()], dtype=np.int64), [len(p) for p in parts])
    return train(np.concatenate(parts) if parts else np.zeros((0, WINDOW), np.uint8), y, languages, steps)


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def text_values(net: Network, texts: pa.Array) -> np.ndarray:
    """Softmax over the languages (columns) of each text: of the means of its windows' values, weighted by their bytes."""
    data, first, last = bytes_of(texts)
    of, start, end = cut(data, first, last)
    total, weight = np.zeros((len(first), len(net.languages))), np.zeros(len(first))
    for i in range(0, len(of), AT_ONCE):
        j = slice(i, i + AT_ONCE)
        w = np.maximum(end[j] - start[j], 1).astype(np.float64)
        np.add.at(total, of[j], net.values(laid_out(data, start[j], end[j])) * w[:, None])
        np.add.at(weight, of[j], w)
    z = total / np.maximum(weight, 1)[:, None]
    p = np.exp(z - z.max(axis=1, keepdims=True, initial=-np.inf)) if len(net.languages) else z
    return p / p.sum(axis=1, keepdims=True) if len(net.languages) else p


def predict_language(docs: DataFrame, net: Network, text: str = "text", lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with the likeliest language of each whole text and its probability, in two columns that replace any of these names (a column
    ``_language`` is lost).

    A null text, one without a letter, and any text under a network that knows no language is ``und`` with score 0. Equal
    texts get equal results; ties go to the first language in order. An empty table stays empty.
    """

    @F.arrow_udf("lang string, score double")
    def predicted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            p = text_values(net, texts)
            best = p.argmax(axis=1) if p.shape[1] else np.zeros(len(texts), dtype=int)
            lang = [net.languages[k] for k in best] if p.shape[1] else [UNKNOWN] * len(texts)
            yield pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(p.max(axis=1, initial=0.0), pa.float64())], ["lang", "score"])

    out = docs.withColumn("_language", predicted(F.col(text)))
    known = has_letter(F.col(text)) & F.lit(bool(net.languages))
    return out.withColumns({lang: F.when(known, F.col("_language.lang")).otherwise(UNKNOWN), score: F.when(known, F.col("_language.score")).otherwise(0.0)}).drop("_language")


def held_out(key: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 5 == 0, F.lit(False))


def op11_byte_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = fit(docs.select("doc_id", "text", "lang"), ~held_out())
    return predict_language(docs.select("doc_id", "text"), net).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
