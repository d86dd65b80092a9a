"""Licence scan: a paragraph classifier confirmed by templates.

Paragraphs end at blank lines; a long one is cut into overlapping windows of WINDOW words. Features are word 1- to 3-grams as
shares of the paragraph's n-grams, kept sparse: only n-grams of the licence texts (licence_texts.py) carry weights, all others
count as one feature. A softmax regression over the licence families and an unknown class is trained on the families' texts,
cut into pieces of about PIECE words and varied by dropping words and adding foreign ones, against texts of licences that
are no family and paragraphs drawn from a bounded sample of the documents.
The unknown class is calibrated on held-out paragraphs of the sample and on held-out licences: the bar that a family's
probability must clear is the value that at most FALSE_RATE of the paragraphs, and none of these licences, reach. Each family
whose probability clears the bar in a window is predicted there.

A family is confirmed by comparison with the templates, which are the same pieces: when a passage holds at least CONFIRM of a piece's
word pairs, one of the pairs that the fewest licences share among them. Templates are looked for around all windows that hold CONFIRM of one,
whatever the classifier says; the best match comes first and takes its words, so that what two licences share counts for one of
them. A piece that several licences have word for word counts for the one that the same document has a piece of its own of, and
for none without such a piece. Licences that are no family take their words too, and are not reported.

Sample paragraphs that hold half of a piece's word pairs are no examples of the unknown class.

Defined results: null and empty texts have no paragraphs and no licence; several families in a text are all
reported, in alphabetical order, those of one window too; a family counts if it is confirmed. Rows that repeat an id are
scanned each. Other columns are not looked at, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeseek.llm import common as C
from lodeseek.llm.licence_texts import HELD_OUT, NOTICES, OTHERS

U = np.uint64
WINDOW, STRIDE = 32, 16
SAMPLE_DOCS, MAX_BYTES = 400, 16_384
FALSE_RATE, CONFIRM = 0.001, 0.6
VARIANTS, ROUNDS = 8, 150
#: Words of a template, about.
PIECE = 16

FAMILIES = sorted(NOTICES)
BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def hashes(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    return C.word_hashes(data, np.array([0, len(data)]), C.NOT_WORD)[0]


def cut_pieces(text: str) -> list[np.ndarray]:
    """Word hashes of a text in pieces of about PIECE words."""
    h = hashes(text)
    return np.array_split(h, max(1, round(len(h) / PIECE)))


def ngrams(h: np.ndarray, first: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Hashes of 1- to 3-grams and the paragraph of each; paragraphs begin at `first` (with the end)."""
    par = np.repeat(np.arange(len(first) - 1), np.diff(first))
    out, cur = [(h, par)], h
    for n in (2, 3):
        cur = C.join_hash(cur[:-1], h[n - 1 :]) if len(h) >= n else cur[:0]
        same = par[n - 1 :] == par[: len(par) - n + 1] if len(h) >= n else np.zeros(0, bool)
        out.append((cur[same], par[n - 1 :][same]))
    return out


class Model:
    def __init__(self) -> None:
        unknown = len(FAMILIES)
        #: (family, words) of each template; licences that are no family come last.
        self.pieces = [(k, h) for k, fam in enumerate(FAMILIES) for t in NOTICES[fam] for h in cut_pieces(t)]
        self.pieces += [(unknown, h) for texts in OTHERS.values() for t in texts for h in cut_pieces(t)]
        whole = [(k, fam, t) for k, fam in enumerate(FAMILIES) for t in NOTICES[fam]] + [(unknown, x, t) for x, texts in OTHERS.items() for t in texts]
        self.grams = np.unique(np.concatenate([g for _, _, t in whole for h in [hashes(t)] for g, _ in ngrams(h, np.array([0, len(h)]))]))
        self.weights = np.zeros((len(self.grams) + 2, unknown + 1))  # then: all other n-grams, the constant
        self.bar = 0.5
        got = [(k, np.unique(ngrams(h, np.array([0, len(h)]))[1][0])) for k, h in self.pieces if len(h) > 1]
        self.family = np.array([k for k, _ in got])
        pairs = [p for _, p in got]
        self.pairs, self.size = np.concatenate(pairs), np.array([len(p) for p in pairs])
        self.sets = [set(p.tolist()) for p in pairs]
        owners: dict[int, set[str]] = {}
        for _, licence, t in whole:
            h = hashes(t)
            for x in ngrams(h, np.array([0, len(h)]))[1][0].tolist():
                owners.setdefault(x, set()).add(licence)
        #: For each template its pairs that the fewest licences have, and these licences' number in all.
        self.rare = [{x for x in own if len(owners[x]) == min(len(owners[z]) for z in own)} for own in self.sets]
        self.shared = [min(len(owners[z]) for z in own) > 1 for own in self.sets]
        #: Families (or the unknown class) that have a shared template's rare pairs.
        number = {fam: k for k, fam in enumerate(FAMILIES)}
        self.owners = [{number.get(o, unknown) for x in rare for o in owners[x]} for rare in self.rare]
        self.order = np.argsort(self.pairs, kind="stable")
        self.template = np.repeat(np.arange(len(self.size)), self.size)[self.order]
        self.sorted = self.pairs[self.order]

    def sparse(self, h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Feature counts as (paragraph, feature), and the paragraphs' numbers of n-grams."""
        rows, cols, total = [], [], np.zeros(len(first) - 1)
        for g, par in ngrams(h, first):
            at = np.searchsorted(self.grams, g)
            at[at == len(self.grams)] = 0
            hit = self.grams[at] == g
            rows.append(par[hit])
            cols.append(at[hit])
            total += np.bincount(par, minlength=len(total))
        return np.concatenate(rows), np.concatenate(cols), total

    def logits(self, h: np.ndarray, first: np.ndarray) -> np.ndarray:
        r, c, total = self.sparse(h, first)
        z = np.zeros((len(total), self.weights.shape[1]))
        np.add.at(z, r, self.weights[c])
        other = total - np.bincount(r, minlength=len(total))
        return (z + other[:, None] * self.weights[-2]) / np.maximum(total, 1)[:, None] + self.weights[-1]

    def fit(self, h: np.ndarray, first: np.ndarray, want: np.ndarray, scale: np.ndarray) -> None:
        """Softmax regression by adaptive gradient steps, on sparse rows."""
        r, c, total = self.sparse(h, first)
        n = len(total)
        other = total - np.bincount(r, minlength=n)
        value = np.concatenate([1 / np.maximum(total, 1)[r], other / np.maximum(total, 1), np.ones(n)])[:, None]
        row = np.concatenate([r, np.arange(n), np.arange(n)])
        col = np.concatenate([c, np.full(n, len(self.grams)), np.full(n, len(self.grams) + 1)])
        by_row, by_col = np.argsort(row, kind="stable"), np.argsort(col, kind="stable")
        rows = np.flatnonzero(np.diff(row[by_row], prepend=-1))
        cols = np.flatnonzero(np.diff(col[by_col], prepend=-1))
        used = col[by_col][cols]
        g2 = np.full(self.weights.shape, 1e-8)
        for _ in range(ROUNDS):
            z = np.add.reduceat((self.weights[col] * value)[by_row], rows)
            d = (softmax(z) - want) * scale[:, None] / n
            g = 1e-6 * self.weights
            g[used] += np.add.reduceat((d[row] * value)[by_col], cols)
            g2 += g * g
            self.weights -= 1.0 * g / np.sqrt(g2)

    def overlap(self, h: np.ndarray) -> np.ndarray:
        """For each template the share of its word pairs that the paragraph holds."""
        own = np.isin(self.pairs, ngrams(h, np.array([0, len(h)]))[1][0])
        return np.add.reduceat(own.astype(np.int64), np.cumsum(self.size) - self.size) / self.size

    def near(self, h: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The windows that hold at least CONFIRM of some template's word pairs."""
        g, win = ngrams(h, first)[1]
        lo, hi = np.searchsorted(self.sorted, g, "left"), np.searchsorted(self.sorted, g, "right")
        n = hi - lo
        hit = np.flatnonzero(n)
        n, lo, win = n[hit], lo[hit], win[hit]
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
        # A pair counts once in a window: `at` names the pair and its template.
        key = np.unique(np.repeat(win, n) * len(self.sorted) + at)
        cell, count = np.unique(key // len(self.sorted) * len(self.size) + self.template[key % len(self.sorted)], return_counts=True)
        return np.unique(cell[count >= CONFIRM * self.size[cell % len(self.size)] - 1e-9] // len(self.size))

    def matches(self, h: np.ndarray) -> list[tuple[int, int, int]]:
        """Templates that the words hold, as (template, first word, end); the best match first, and its words serve no other."""
        pairs: list[int | None] = ngrams(h, np.array([0, len(h)]))[1][0].tolist()
        out = []
        while True:
            found = []
            for t, own in enumerate(self.sets):
                at = [i for i, x in enumerate(pairs) if x in own]
                if len(at) < CONFIRM * len(own) - 1e-9:
                    continue
                for k, i in enumerate(at):
                    seen: dict[int | None, int] = {}
                    for j in at[k : k + 2 * len(own) + 2]:
                        if j >= i + len(own) + max(2, len(own) // 2):
                            break
                        seen.setdefault(pairs[j], j)
                    if len(seen) >= CONFIRM * len(own) - 1e-9 and seen.keys() & self.rare[t]:
                        last = max(seen.values())
                        found.append((-len(seen) / len(own), -len(seen), last - i, i, t, last + 2))
            # Matches that touch no better one; then again with the pairs that are left.
            new = 0
            used = bytearray(len(pairs))
            for _, _, _, a, t, b in sorted(found):
                if not any(used[a : b - 1]):
                    used[a : b - 1] = b"\1" * (b - 1 - a)
                    pairs[a : b - 1] = [None] * (b - 1 - a)
                    out.append((t, a, b))
                    new += 1
            if not new:
                return out

    def resolve(self, found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """(family, first word, end) of a document's matches; shared templates go to a licence with a template of its own here."""
        own = {int(self.family[t]) for t, _, _ in found if not self.shared[t]}
        out = []
        for t, a, b in found:
            k = int(self.family[t])
            if self.shared[t]:
                have = sorted(own & self.owners[t])
                k = k if k in have else have[0] if have else len(FAMILIES)
            if k < len(FAMILIES):
                out.append((k, a, b))
        return out


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def windows(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the paragraphs' windows, and the paragraph of each."""
    size = np.diff(first)
    n = np.maximum(1, -(-(size - (WINDOW - STRIDE)) // STRIDE))
    n[size == 0] = 0
    par = np.repeat(np.arange(len(size)), n)
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    start = first[par] + k * STRIDE
    return start, np.minimum(start + WINDOW, first[par + 1]), par


def flatten(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    size = end - start
    first = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    return h[np.arange(first[-1]) - np.repeat(first[:-1], size) + np.repeat(start, size)], first


def paragraphs(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, starts and ends; the paragraphs' first words; and the document of each paragraph."""
    line = np.flatnonzero(data == 10)
    seen = np.concatenate([[0], np.cumsum(~BLANK[data])])
    blank = seen[line[1:]] == seen[line[:-1]]
    cut = np.unique(np.concatenate([offs, line[1:][blank] + 1]))
    cut = cut[cut <= len(data)]
    if len(cut) < 2:
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), z, z, np.zeros(1, np.int64), z
    h, starts, ends, first = C.word_hashes(data, cut, C.NOT_WORD)
    return h, starts, ends, first, np.searchsorted(offs, cut[:-1], "right") - 1


def regions(near: np.ndarray, s: np.ndarray, e: np.ndarray, par: np.ndarray, first: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of words around these windows, within their paragraphs, those that touch as one."""
    out: list[list[int]] = []
    for w in near.tolist():
        p = int(par[w])
        a, b = max(int(first[p]), int(s[w]) - STRIDE), min(int(first[p + 1]), int(e[w]) + STRIDE)
        if out and out[-1][2] == p and a <= out[-1][1]:
            out[-1][1] = b
        else:
            out.append([a, b, p])
    return [(a, b) for a, b, _ in out]


def train(texts: list[str]) -> Model:
    m, rng = Model(), np.random.default_rng(5)
    rest: list[np.ndarray] = []
    for t in texts:
        data = np.frombuffer(t.encode(), np.uint8)
        h, _, _, first, _ = paragraphs(data, np.array([0, len(data)]))
        s, e, _ = windows(h, first)
        rest += [h[a:b] for a, b in zip(s.tolist(), e.tolist(), strict=True)]
    rest = [p for p in rest if m.overlap(p).max() < 0.5]
    rng.shuffle(rest)
    hold, rest = rest[: len(rest) // 3], rest[len(rest) // 3 :]
    filler = np.concatenate(rest) if rest else np.zeros(0, np.uint64)
    rows, y = [], []
    for k, h in m.pieces:
        for v in range(VARIANTS):
            own = h[rng.random(len(h)) > 0.08 * (v > 0)]
            a, b = rng.integers(0, 12, 2) * (v > 1)
            extra = rng.choice(filler, a + b) if len(filler) else filler
            rows.append(np.concatenate([extra[:a], own, extra[a:]]))
            y.append(k)
    for p in rest[: 2 * len(rows)]:
        rows.append(p)
        y.append(len(FAMILIES))
    first = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
    want = np.eye(len(FAMILIES) + 1)[y]
    scale = 1 / np.maximum(want.sum(axis=0), 1)[y]
    m.fit(np.concatenate(rows), first, want, scale / scale.mean())

    def top(parts: list[np.ndarray]) -> np.ndarray:
        f = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
        return softmax(m.logits(np.concatenate(parts), f))[:, :-1].max(axis=1)

    bars = [0.5, top([h for texts in HELD_OUT.values() for t in texts for h in cut_pieces(t)]).max()]
    if hold:
        bars.append(np.quantile(top(hold), 1 - FALSE_RATE))
    m.bar = float(min(0.99, max(bars)))
    return m


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = SAMPLE_DOCS, max_bytes: int = MAX_BYTES) -> DataFrame:
    """One row per row of docs: id, families (array), and findings (byte range, family, probability, confirmed)."""
    text = F.col(f"`{text_col}`")
    n = docs.count()
    # About sample_docs distinct texts by a hash, and at most four times as many, in the order of that hash; long ones by passages.
    h = F.pmod(F.xxhash64("t"), F.lit(1 << 30))
    sample = docs.select(text.alias("t")).where((F.octet_length("t") > 0) & (h < F.lit(min(1.0, sample_docs / max(n, 1)) * (1 << 30))))
    sample = sample.select(F.xxhash64("t").alias("h"), C.sampled_text(F.col("t"), max_bytes).alias("t")).groupBy("h").agg(F.min("t").alias("t"))
    model = train([r.t for r in sample.orderBy("h").limit(4 * sample_docs).collect()])
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def work(batch: pa.RecordBatch, data: np.ndarray, offs: np.ndarray) -> dict[str, object]:
        m = sent.value
        found: list[list[dict]] = [[] for _ in range(len(offs) - 1)]
        for i, j in C.slices(offs):
            h, starts, ends, first, doc = paragraphs(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
            s, e, par = windows(h, first)
            if not len(s):
                continue
            words = flatten(h, s, e)
            p = softmax(m.logits(*words))
            where = lambda k, a, b, f, prob, sure: {"start": int(starts[a]) - k, "end": int(ends[b - 1]) - k, "family": FAMILIES[f], "probability": float(prob), "confirmed": sure}
            sure: dict[int, list[tuple[int, int]]] = {}
            by_doc: dict[int, list[tuple[int, int, int]]] = {}
            for a, b in regions(m.near(*words), s, e, par, first):
                d = int(doc[np.searchsorted(first, a, "right") - 1])
                by_doc.setdefault(d, []).extend((t, a + x, a + y) for t, x, y in m.matches(h[a:b]))
            for d, matched in by_doc.items():
                for f, x, y in m.resolve(matched):
                    # Windows begin in order; those that touch the match.
                    touch = np.arange(np.searchsorted(e, x, "right"), np.searchsorted(s, y, "left"))
                    found[i + d].append(where(int(offs[i + d] - offs[i]), x, y, f, p[touch, f].max(), True))
                    sure.setdefault(f, []).append((x, y))
            for w, f in np.argwhere((p[:, :-1] >= m.bar) & (p[:, :-1] >= p[:, -1:])).tolist():
                if not any(x < e[w] and s[w] < y for x, y in sure.get(f, [])):
                    d = int(doc[par[w]])
                    found[i + d].append(where(int(offs[i + d] - offs[i]), int(s[w]), int(e[w]), f, p[w, f], False))
        for x in found:
            x.sort(key=lambda f: (f["start"], f["end"], f["family"]))
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("family", pa.string()), ("probability", pa.float64()), ("confirmed", pa.bool_())]))
        names = [sorted({f["family"] for f in x if f["confirmed"]}) for x in found]
        return {"families": pa.array(names, pa.list_(pa.string())), "findings": pa.array(found, kind)}

    fields = [("families", "array<string>"), ("findings", "array<struct<start:bigint,end:bigint,family:string,probability:double,confirmed:boolean>>")]
    out = C.map_text(docs, text_col, [id_col], work, fields, "r")
    return out.select(F.col(f"`{id_col}`"), F.col("r").families.alias("families"), F.col("r").findings.alias("findings"))
