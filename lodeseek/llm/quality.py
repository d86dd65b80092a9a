"""Quality classifier: a byte-level convolutional network in numpy.

Bytes have learned embeddings; FILTERS learned filters of WIDTH bytes slide over the whole text. Their responses are
max-pooled within chunks of STRIDE positions; neighbouring chunks overlap by WIDTH - 1 bytes, so every WIDTH bytes
of the text lie within some chunk. The mean and the maximum of the chunks' pooled responses give one probability by
a logistic layer. It is trained with Adam on a bounded sample: per_class documents of each label, of which at most
max_bytes each (longer ones by passages over their whole length; scoring reads whole texts); the constant is then set for the share of label 1 among all training labels.

Scoring adds up table rows: the product of embeddings and filter weights is a table for each pair of neighbouring
positions, 65,536 rows of FILTERS numbers, looked up by two bytes at once.

Defined results: null and empty texts get the score of a text without any response; with labels of one class only, or none,
every score is that class's share of the labels (0.5 without labels). Rows that repeat an id are scored each by their own
text, equal texts alike. Labels, lang, source and id are no inputs, and other columns are not looked at, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lodeseek.llm import common as C

PER_CLASS, MAX_BYTES = 800, 16_384
WIDTH, EMBED, FILTERS, STRIDE = 6, 8, 16, 128
EPOCHS, BATCH, RATE = 14, 40, 0.01
#: Small samples are gone through more often, up to so many steps in all.
STEPS = 560


def padded(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes with WIDTH zeros after each text, the positions past a text's last response, the chunks' first positions, and each text's first chunk."""
    n = len(offs) - 1
    size = np.diff(offs)
    out = np.zeros(len(data) + WIDTH * n, np.uint8)
    out[np.arange(len(data)) + np.repeat(np.arange(n) * WIDTH, size)] = data
    over = np.zeros(len(out), bool)
    over[((offs[1:] + np.arange(n) * WIDTH)[:, None] + np.arange(1, WIDTH)).ravel()] = True
    chunks = np.maximum(1, -(-size // STRIDE))
    first = np.concatenate([[0], np.cumsum(chunks)])
    at = (np.arange(first[-1]) - np.repeat(first[:-1], chunks)) * STRIDE + np.repeat(offs[:-1] + np.arange(n) * WIDTH, chunks)
    return out, over, at, first


class ByteNet:
    def __init__(self, seed: int = 1):
        r = np.random.default_rng(seed)
        self.emb = r.normal(0, 0.5, (256, EMBED)).astype(np.float32)
        self.taps = r.normal(0, 0.3, (WIDTH, EMBED, FILTERS)).astype(np.float32)
        self.bias = np.zeros(FILTERS, np.float32)
        self.out = np.zeros(2 * FILTERS, np.float32)
        self.const = np.zeros(1, np.float32)

    def params(self) -> list[np.ndarray]:
        return [self.emb, self.taps, self.bias, self.out, self.const]

    def tables(self) -> np.ndarray:
        one = np.einsum("be,wef->wbf", self.emb, self.taps)
        return np.stack([(one[w][:, None, :] + one[w + 1][None, :, :]).reshape(65536, FILTERS) for w in range(0, WIDTH, 2)])

    def responses(self, x: np.ndarray, over: np.ndarray, tables: np.ndarray) -> np.ndarray:
        two = (x[:-1].astype(np.uint16) << np.uint16(8)) | x[1:]
        n = len(x) - WIDTH + 1
        z = tables[0][two[:n]]
        for k in range(1, WIDTH // 2):
            z += tables[k][two[2 * k : 2 * k + n]]
        # A text's responses end with the one that reads zeros only; those after it would read the next text.
        z[np.flatnonzero(over[: len(z)])] = -np.inf
        return z

    def features(self, data: np.ndarray, offs: np.ndarray, tables: np.ndarray) -> np.ndarray:
        """Mean and maximum of the pooled responses for each text."""
        x, over, at, first = padded(data, offs)
        pooled = np.maximum(np.maximum.reduceat(self.responses(x, over, tables), at, axis=0) + self.bias, 0)
        count = np.diff(first)[:, None]
        return np.hstack([np.add.reduceat(pooled, first[:-1], axis=0) / count, np.maximum.reduceat(pooled, first[:-1], axis=0)])

    def score(self, data: np.ndarray, offs: np.ndarray, tables: np.ndarray) -> np.ndarray:
        return C.sigmoid(self.features(data, offs, tables).astype(np.float64) @ self.out + self.const[0])

    def gradients(self, data: np.ndarray, offs: np.ndarray, y: np.ndarray, w: np.ndarray) -> list[np.ndarray]:
        x, over, at, first = padded(data, offs)
        z = self.responses(x, over, self.tables())
        pooled = np.empty((len(at), FILTERS), np.float32)
        arg = np.empty((len(at), FILTERS), np.int64)
        ends = np.append(at[1:], len(z))
        full = (ends - at) == STRIDE
        if full.any():
            block = z[at[full][:, None] + np.arange(STRIDE)]
            k = block.argmax(axis=1)
            arg[full] = k + at[full][:, None]
            pooled[full] = np.take_along_axis(block, k[:, None, :], axis=1)[:, 0]
        for c in np.flatnonzero(~full):
            k = z[at[c] : ends[c]].argmax(axis=0)
            arg[c] = k + at[c]
            pooled[c] = z[arg[c], np.arange(FILTERS)]
        pooled += self.bias
        on = pooled > 0
        pooled *= on
        doc = np.repeat(np.arange(len(y)), np.diff(first))
        count = np.diff(first)[:, None]
        mean = np.add.reduceat(pooled, first[:-1], axis=0) / count
        top = np.maximum.reduceat(pooled, first[:-1], axis=0)
        feat = np.hstack([mean, top])
        err = (w * (C.sigmoid(feat @ self.out + self.const[0]) - y) / len(y)).astype(np.float32)
        best = pooled == top[doc]
        g = err[doc][:, None] * (self.out[:FILTERS] / count[doc] + self.out[FILTERS:] * best) * on
        tab = np.zeros((WIDTH, 256, FILTERS), np.float32)
        cols = np.broadcast_to(np.arange(FILTERS), arg.shape)
        for w in range(WIDTH):
            np.add.at(tab[w], (x[arg + w], cols), g)
        return [
            np.einsum("wbf,wef->be", tab, self.taps),
            np.einsum("wbf,be->wef", tab, self.emb),
            g.sum(axis=0),
            feat.T @ err + 1e-4 * self.out,
            np.array([err.sum()], np.float32),
        ]


def train(texts: list[str], y: np.ndarray, share: float) -> ByteNet:
    """Adam, with both labels weighing the same; the constant is then corrected for the share of label 1."""
    net = ByteNet()
    raw = [t.encode() for t in texts]
    m = [np.zeros_like(p) for p in net.params()]
    v = [np.zeros_like(p) for p in net.params()]
    r, step = np.random.default_rng(2), 0
    w = np.where(y == 1, 0.5 / max(y.mean(), 1e-6), 0.5 / max(1 - y.mean(), 1e-6))
    epochs = max(EPOCHS, -(-STEPS // max(1, len(raw) // BATCH)))
    for epoch in range(epochs):
        rate = RATE * (1 - epoch / epochs) + RATE / 20
        for idx in np.array_split(r.permutation(len(raw)), max(1, len(raw) // BATCH)):
            data = np.frombuffer(b"".join(raw[i] for i in idx), np.uint8)
            offs = np.concatenate([[0], np.cumsum([len(raw[i]) for i in idx])]).astype(np.int64)
            step += 1
            for p, g, a, b in zip(net.params(), net.gradients(data, offs, y[idx], w[idx]), m, v, strict=True):
                a += 0.1 * (g - a)
                b += 0.01 * (g * g - b)
                p -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-7)
    share = min(max(share, 1e-6), 1 - 1e-6)
    net.const += np.float32(np.log(share / (1 - share)))
    return net


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality", keep: list[str] | None = None, result: str = "result", per_class: int = PER_CLASS, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Columns `keep` (the id unless given) and struct `result` (score: probability of label 1) for each row."""
    texts, y, _, share = C.labelled_sample(docs, labels, label, per_class, max_bytes, id_col, text_col)
    net = train(texts, y, share) if len(set(y.tolist())) == 2 else None
    flat = share if net is None else 0.0
    sent = docs.sparkSession.sparkContext.broadcast([p.copy() for p in net.params()] if net else None)

    def work(batch: pa.RecordBatch, data: np.ndarray, offs: np.ndarray) -> dict[str, object]:
        if sent.value is None:
            return {"score": np.full(len(offs) - 1, flat)}
        own = ByteNet()
        own.emb, own.taps, own.bias, own.out, own.const = sent.value
        tables = own.tables()
        parts = [own.score(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], tables) for i, j in C.slices(offs, C.SLICE_BYTES // 4)]
        return {"score": np.concatenate(parts)}

    return C.map_text(docs, text_col, keep if keep is not None else [id_col], work, [("score", "double")], result)
