"""Language identification by a byte convolutional network trained in numpy.

Bytes are embedded; filters of widths 2, 3 and 4 slide over a window of ``WINDOW``
bytes; each filter's maximum over the window, through a ReLU, feeds a softmax over the
languages learned. A text is cut into windows that cover it all; its prediction is the
mean of the windows' distributions, by their bytes.

The network is fitted on a bounded sample of labelled rows: at most ``PER_LANG`` documents
a language and ``SAMPLE`` in all (those with the smallest hashes of doc_id), of each at
most ``PER_DOC`` windows, spread evenly over its whole text. Fitting takes a fixed effort
whatever the size of the corpus.

Null texts and texts without a letter are ``und`` with score 0, as is every text if
nothing is labelled; of equal beliefs the language first in order wins. A very long text is
predicted from all its windows, some at a time. Repeated rows are predicted row by row, and
count once in the sample; rows without a doc_id are predicted and not in it. Other columns,
whatever their names, are left out by ``identify`` and kept by ``keep``; an empty table
gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, pick, stash, without_appended

WINDOW = 192
WIDTHS = (2, 3, 4)
FILTERS = 16
EMBED = 8
PER_LANG = 300
SAMPLE = 6_000
PER_DOC = 48
EPOCHS = 6
BATCH = 48


def windows_of(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Zero-padded windows, the text that each is of, and its bytes."""
    counts = [max(1, -(-len(x) // WINDOW)) for x in raws]
    padded = b"".join(x.ljust(n * WINDOW, b"\0") for x, n in zip(raws, counts, strict=True))
    of = np.repeat(np.arange(len(raws)), counts)
    sizes = np.full(len(of), WINDOW)
    sizes[np.cumsum(counts) - 1] = [len(x) - (n - 1) * WINDOW for x, n in zip(raws, counts, strict=True)]
    return np.frombuffer(padded, np.uint8).reshape(-1, WINDOW), of, np.maximum(sizes, 1)


class ByteNet:
    def __init__(self, langs: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.langs = langs
        self.p = {"e": rng.normal(0, 0.5, (256, EMBED))}
        for w in WIDTHS:
            self.p[f"w{w}"] = rng.normal(0, (w * EMBED) ** -0.5, (w, EMBED, FILTERS))
            self.p[f"b{w}"] = np.zeros(FILTERS)
        self.p["o"] = rng.normal(0, (len(WIDTHS) * FILTERS) ** -0.5, (len(WIDTHS) * FILTERS, len(langs)))
        self.p["c"] = np.zeros(len(langs))
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, rate: float = 0.01, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        # each language weighs the same
        weight = (len(y) / (len(self.langs) * np.maximum(np.bincount(y, minlength=len(self.langs)), 1)))[y].astype(np.float32)
        t = 0
        for epoch in range(epochs):
            order = rng.permutation(len(y))
            for s in range(0, len(order), BATCH):
                i = order[s : s + BATCH]
                g = self._gradient(x[i], y[i], weight[i])
                t += 1
                step = rate * (1 - epoch / epochs)
                for k in self.p:
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    v2[k] = 0.99 * v2[k] + 0.01 * g[k] ** 2
                    self.p[k] = (self.p[k] - step * (m[k] / (1 - 0.9**t)) / (np.sqrt(v2[k] / (1 - 0.99**t)) + 1e-7)).astype(np.float32)

    def _gradient(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        p, n = self.p, len(y)
        emb = p["e"][x]
        pooled, where = [], []
        for w in WIDTHS:
            conv = sum(emb[:, k : WINDOW - w + 1 + k] @ p[f"w{w}"][k] for k in range(w)) + p[f"b{w}"]
            at = conv.argmax(1)
            where.append(at)
            pooled.append(np.take_along_axis(conv, at[:, None], 1)[:, 0])
        h = np.concatenate(pooled, 1)
        a = np.maximum(h, 0)
        z = a @ p["o"] + p["c"]
        q = np.exp(z - z.max(1, keepdims=True))
        q /= q.sum(1, keepdims=True)
        q[np.arange(n), y] -= 1
        dz = q * (weight / n)[:, None]
        g = {"o": a.T @ dz, "c": dz.sum(0), "e": np.zeros_like(p["e"])}
        dh = (dz @ p["o"].T) * (h > 0)
        rows = np.arange(n)[:, None]
        for j, w in enumerate(WIDTHS):
            d = dh[:, j * FILTERS : (j + 1) * FILTERS]
            g[f"b{w}"] = d.sum(0)
            dw = np.zeros_like(p[f"w{w}"])
            for k in range(w):
                seen = x[rows, where[j] + k]  # the byte under tap k of each filter's best place
                dw[k] = np.einsum("nf,nfe->ef", d, p["e"][seen])
                np.add.at(g["e"], seen.ravel(), (d[:, :, None] * p[f"w{w}"][k].T[None]).reshape(-1, EMBED))
            g[f"w{w}"] = dw
        return g

    def tables(self) -> dict[int, list[np.ndarray]]:
        """What two bytes in a row, or one, add to each filter: the same sums as the
        convolution, looked up."""
        out = {}
        for w in WIDTHS:
            taps = [self.p["e"] @ self.p[f"w{w}"][k] for k in range(w)]
            pairs = [(taps[k][:, None, :] + taps[k + 1][None, :, :]).reshape(65536, FILTERS) for k in range(0, w - 1, 2)]
            out[w] = [np.ascontiguousarray(x) for x in pairs] + ([taps[-1]] if w % 2 else [])
        return out

    def predict(self, x: np.ndarray, tables: dict[int, list[np.ndarray]] | None = None) -> np.ndarray:
        tables = tables or self.tables()
        out = np.empty((len(x), len(self.langs)), np.float32)
        for s in range(0, len(x), 256):
            b = x[s : s + 256]
            pair = b[:, :-1].astype(np.uint16) << 8 | b[:, 1:]
            pooled = []
            for w in WIDTHS:
                n = WINDOW - w + 1
                conv = tables[w][0][pair[:, :n]]
                for k, t in enumerate(tables[w][1:], 1):
                    conv += t[pair[:, 2 * k : 2 * k + n]] if len(t) == 65536 else t[b[:, 2 * k : 2 * k + n]]
                pooled.append(conv.max(1) + self.p[f"b{w}"])
            z = np.maximum(np.concatenate(pooled, 1), 0) @ self.p["o"] + self.p["c"]
            q = np.exp(z - z.max(1, keepdims=True))
            out[s : s + 256] = q / q.sum(1, keepdims=True)
        return out


def held_out(doc_id: F.Column) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(labelled: DataFrame, per_lang: int = PER_LANG, sample: int = SAMPLE, per_doc: int = PER_DOC) -> ByteNet | None:
    """Fit on ``labelled`` (doc_id, text, lang); None if it holds no labelled text."""
    rows = pick(labelled, doc_id="bigint", text="string", lang="string").where("doc_id is not null and lang is not null and text is not null and length(text) > 0")
    # ids first, so that no texts are dealt out to find the sample; of a large language only
    # the share of hashes that holds about twice the sample goes to one task
    hashed = rows.select("lang", "doc_id", F.xxhash64("doc_id").alias("h"))
    size = stash(hashed.groupBy("lang").agg(F.count("*").alias("n")), "language-sizes")
    least = F.lit(2.0**64) * F.least(F.lit(1.0), F.lit(2.0 * per_lang + 100) / F.col("n")) - F.lit(2.0**63)
    few = hashed.join(size, "lang").where(F.col("h").cast("double") <= least).select("lang", "doc_id", "h").distinct()
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))
    ids = few.withColumn("nth", nth).where(F.col("nth") <= per_lang).orderBy("nth", "lang", "doc_id").limit(sample).select("doc_id", "lang")
    # at most ``sample`` ids are sent to all tasks
    texts = rows.join(F.broadcast(ids), ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.min("text").alias("text"))

    def cut(batches):
        for batch in batches:
            for doc, lang, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                x, _, _ = windows_of([text.encode("utf-8")])
                at = np.unique(np.linspace(0, len(x) - 1, min(len(x), per_doc)).astype(int))
                yield pa.record_batch([pa.array([doc], pa.int64()), pa.array([lang]), pa.array([x[at].tobytes()], pa.binary())], names=["doc_id", "lang", "windows"])

    taken = texts.mapInArrow(cut, "doc_id bigint, lang string, windows binary").collect()
    if not taken:
        return None
    taken = sorted(taken, key=lambda r: (r["doc_id"], r["lang"]))
    langs = sorted({r["lang"] for r in taken})
    net = ByteNet(langs)
    if len(langs) > 1:
        x = np.concatenate([np.frombuffer(r["windows"], np.uint8).reshape(-1, WINDOW) for r in taken])
        y = np.repeat([langs.index(r["lang"]) for r in taken], [len(r["windows"]) // WINDOW for r in taken])
        net.fit(x, y)
    return net


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


PREDICTION = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])


def predictor(net: ByteNet | None):
    """From texts to arrays of lang_pred and score."""
    tables: list = []

    def run(texts: list[str | None]) -> list[pa.Array]:
        if net and not tables:
            tables.append(net.tables())
        langs, scores = ["und"] * len(texts), [0.0] * len(texts)
        at = [i for i, x in enumerate(texts) if net is not None and has_letter(x)]
        if at:
            x, of, sizes = windows_of([texts[i].encode("utf-8") for i in at])
            total = np.zeros((len(at), len(net.langs)))
            for s in range(0, len(x), 4096):
                part = slice(s, s + 4096)
                np.add.at(total, of[part], net.predict(x[part], tables[0]) * sizes[part, None])
            total /= np.bincount(of, sizes)[:, None]
            for i, best, q in zip(at, total.argmax(1).tolist(), np.clip(total.max(1), 0, 1).tolist(), strict=True):
                langs[i], scores[i] = net.langs[best], q
        return [pa.array(langs, pa.string()), pa.array(scores, pa.float64())]

    return run


def identify(docs: DataFrame, net: ByteNet | None) -> DataFrame:
    """doc_id, lang_pred and score, a row for each row of ``docs``."""
    made = append_columns(pick(docs, doc_id="bigint", text="string"), "text", predictor(net), PREDICTION)
    return made.select(F.col("_c0").alias("doc_id"), "lang_pred", "score")


def keep(docs: DataFrame, net: ByteNet | None, least: float) -> DataFrame:
    """The whole rows whose language is known with belief ``least`` or more."""
    made = append_columns(docs, "text", predictor(net), PREDICTION)
    return without_appended(made.where((F.col("lang_pred") != "und") & (F.col("score") >= least)), docs.columns)
