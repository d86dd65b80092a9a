"""Toxic passages: maximum-scoring segments over token log-odds, judged by extreme-value statistics.

Learning (a bounded sample: per_class documents of each label, of which at most max_bytes each, longer ones by passages
over their whole length; scoring reads whole texts): a token's score is its log-odds
between toxic and clean texts with an informative Dirichlet prior (the pooled counts, worth PRIOR tokens in all, or a
twentieth of the smaller label's tokens if that is less),
kept where it exceeds Z_MIN standard errors, less DRIFT, which makes the expected score of clean text negative.
Tokens are words and their first 8, 7, ... 4 bytes; a word takes the score of the longest of these that is kept, so that
inflected or compounded forms that were never seen count by their stem.
Folds 1-3 give the scores; fold 4 gives the Gumbel law of the best segment of clean texts and the final calibration.

Scoring: one linear-time pass finds all maximal-scoring segments of a text (disjoint, each cannot be improved by
growing or shrinking). A segment of score s in n tokens has p-value 1 - exp(-K n exp(-lambda s)); those up to P_MAX are the
toxic passages. The text's score is a logistic function of the best segment's significance, the sum over significant
passages and their share of the text.

Defined results: null and empty texts have no tokens and get the score of a text without passages; with labels of
one class only, or none, every score is that class's share (0.5 without labels). Rows that repeat an id are scored each by
their own text, equal texts alike; of equally good passages the first begins first. Other columns are not looked at, whatever their
names. Words compare by 64-bit hash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lodeseek.llm import common as C

PER_CLASS, MAX_BYTES = 3000, 16_384
PRIOR, Z_MIN, DRIFT, P_MAX = 2000.0, 2.5, 2.5, 0.01
#: Bytes of a word that are a token; the first stands for the whole word.
LEVELS = (1 << 30, 8, 7, 6, 5, 4)


def tokens(data: np.ndarray, offs: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """For each level a hash for each word (0: the word is no longer than this level), and the words' places."""
    low = C.LOWER[data]
    starts, ends, first = C.word_spans(low, offs, C.NOT_WORD)
    sums = C.prefix_sums(low)
    out = []
    for k, size in enumerate(LEVELS):
        h = C.span_hash(sums, starts, np.minimum(ends, starts + size)) + np.uint64(k)
        out.append(h if not k else np.where(ends - starts > size, h, np.uint64(0)))
    return out, starts, ends, first


def add_up(words: np.ndarray, y1: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words, and the sums of their toxic and of all occurrences."""
    words, code = np.unique(words, return_inverse=True)
    return words, np.bincount(code, weights=y1, minlength=len(words)), np.bincount(code, weights=n, minlength=len(words))


def log_odds(words: np.ndarray, y1: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted distinct tokens with their toxic and all occurrences those whose log-odds are significant, and these log-odds."""
    y0 = n - y1
    n1, n0 = y1.sum(), y0.sum()
    worth = max(1.0, min(PRIOR, min(n1, n0) / 20))
    prior = worth * (y1 + y0) / max(n1 + n0, 1)
    a, b = y1 + prior, y0 + prior
    delta = np.log(a / np.maximum(n1 + worth - a, 0.5)) - np.log(b / np.maximum(n0 + worth - b, 0.5))
    use = np.abs(delta) >= Z_MIN * np.sqrt(1 / a + 1 / b)
    return words[use], delta[use]


def segments(score: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (start, end, score) of a sequence, in linear time (Ruzzo and Tompa)."""
    total = np.concatenate([[0.0], np.cumsum(score)])
    stack: list[list] = []  # start, end, sum before, sum after, index of the last one with a smaller sum before
    for i in np.flatnonzero(score > 0).tolist():
        cur = [i, i + 1, float(total[i]), float(total[i + 1]), -1]
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= cur[2]:
                j = stack[j][4]
            cur[4] = j
            if j < 0 or stack[j][3] >= cur[3]:
                stack.append(cur)
                break
            cur = [stack[j][0], cur[1], stack[j][2], cur[3], -1]
            del stack[j:]
    return [(s, e, r - l) for s, e, l, r, _ in stack]


class Model:
    def __init__(self, words: np.ndarray, delta: np.ndarray):
        self.words, self.delta = words, delta
        self.lam, self.log_k = 1.0, 0.0
        self.weights = np.array([1.0, 0.0, 0.0, 0.0])

    def token_scores(self, levels: list[np.ndarray]) -> np.ndarray:
        out = np.full(len(levels[0]), -DRIFT)
        todo = np.arange(len(out))
        for h in levels if len(self.words) else []:
            own = h[todo]
            at = np.searchsorted(self.words, own)
            at[at == len(self.words)] = 0
            hit = self.words[at] == own
            out[todo[hit]] += self.delta[at[hit]]
            todo = todo[~hit]
        return out

    def log_p(self, score: np.ndarray, n: np.ndarray) -> np.ndarray:
        """-log10 of the p-value of a best segment of this score in n tokens."""
        x = np.clip(self.log_k + np.log(np.maximum(n, 1)) - self.lam * score, -700, 700)
        e = np.exp(x)
        return -np.log10(np.maximum(np.where(x < -30, e, -np.expm1(-e)), 1e-300))

    def features(self, data: np.ndarray, offs: np.ndarray):
        """For each text: best segment, its significance, sum over significant passages, share; and the passages."""
        levels, starts, ends, first = tokens(data, offs)
        s = self.token_scores(levels)
        good = np.concatenate([[0], np.cumsum(s > 0)])
        n = np.diff(first)
        best = np.zeros(len(n))
        feat = np.zeros((len(n), 3))
        passages: list[list[dict]] = [[] for _ in range(len(n))]
        has = good[first[1:]] > good[first[:-1]]
        for d in np.flatnonzero(has).tolist():
            a, b = first[d], first[d + 1]
            seg = segments(s[a:b])
            sc = np.array([x[2] for x in seg])
            best[d] = sc.max()
            lp = self.log_p(sc, np.full(len(sc), n[d]))
            sig = np.flatnonzero(lp >= -np.log10(P_MAX))
            feat[d] = min(lp.max(), 30), np.log1p(np.minimum(lp[sig], 30).sum()), sum(seg[k][1] - seg[k][0] for k in sig) / n[d]
            passages[d] = [{"start": int(starts[a + seg[k][0]] - offs[d]), "end": int(ends[a + seg[k][1] - 1] - offs[d]), "score": float(sc[k]), "p_value": float(10 ** -lp[k])} for k in sig]
        return n, best, feat, passages


def train(texts: list[str], y: np.ndarray, folds: np.ndarray, share: float) -> Model:
    data, offs = C.text_buffer(pa.array(texts, pa.string()))
    fit = folds != 4
    if len(set(y[fit].tolist())) < 2 or len(set(y[~fit].tolist())) < 2:
        fit = np.ones(len(y), bool)
    none = np.zeros(0)
    counts = [(none.astype(np.uint64), none, none)] * len(LEVELS)  # summed slice by slice: never all tokens at once
    for i, j in C.slices(offs):
        levels, _, _, first = tokens(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
        doc = np.repeat(np.arange(i, j), np.diff(first))
        for k, h in enumerate(levels):
            use = fit[doc] & (h != 0)
            new = add_up(h[use], y[doc[use]], np.ones(int(use.sum())))
            counts[k] = add_up(*(np.concatenate(x) for x in zip(counts[k], new, strict=True)))
    found = [log_odds(*c) for c in counts]
    words, delta = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(words)
    model = Model(words[order], delta[order])
    hold = np.flatnonzero(~fit) if not fit.all() else np.arange(len(y))

    def of(rows: np.ndarray):
        part = [model.features(*C.text_buffer(pa.array([texts[i] for i in rows[k : k + 500]], pa.string())))[:3] for k in range(0, len(rows), 500)]
        return [np.concatenate(x) for x in zip(*part, strict=True)]

    n, best, _ = of(hold)
    clean = (y[hold] == 0) & (n > 0)
    if clean.sum() >= 20:
        # Gumbel law of best segments of clean text: mean and spread, the texts' lengths taken out step by step.
        lam = 1.0
        for _ in range(30):
            x = best[clean] - np.log(n[clean]) / lam
            lam = np.clip(np.pi / np.sqrt(6) / max(x.std(), 1e-3), 0.2, 5)
        model.lam, model.log_k = float(lam), float(lam * x.mean() - 0.5772)
    _, _, feat = of(hold)
    here = min(max(y[hold].mean(), 1e-6), 1 - 1e-6)
    share = min(max(share, 1e-6), 1 - 1e-6)
    w = np.where(y[hold] == 1, share / here, (1 - share) / (1 - here))
    model.weights = C.logistic(feat, y[hold], w, ridge=0.1)
    return model


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic", per_class: int = PER_CLASS, keep: list[str] | None = None, result: str = "result", max_bytes: int = MAX_BYTES) -> DataFrame:
    """Columns `keep` (the id unless given) and struct `result` for each row: score, and the toxic passages (byte ranges, segment score, p-value)."""
    texts, y, folds, share = C.labelled_sample(docs, labels, label, per_class, max_bytes, id_col, text_col)
    model = train(texts, y, folds, share) if len(set(y.tolist())) == 2 else None
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def work(batch: pa.RecordBatch, data: np.ndarray, offs: np.ndarray) -> dict[str, object]:
        scores, passages = [], []
        for i, j in C.slices(offs):
            if sent.value is None:
                scores.append(np.full(j - i, share))
                passages += [[]] * (j - i)
                continue
            _, _, feat, found = sent.value.features(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
            scores.append(C.sigmoid(feat @ sent.value.weights[:-1] + sent.value.weights[-1]))
            passages += found
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("p_value", pa.float64())]))
        return {"score": np.concatenate(scores), "passages": pa.array(passages, kind)}

    fields = [("score", "double"), ("passages", "array<struct<start:bigint,end:bigint,score:double,p_value:double>>")]
    return C.map_text(docs, text_col, keep if keep is not None else [id_col], work, fields, result)
