"""Benchmark decontamination by an FM-index per training shard.

A shard is a slice of an Arrow batch, so documents stay where they are read: no shuffle. All its words are indexed, as
symbols of the benchmark's alphabet; words that no item has stand for nothing that a window could match, so each run of
them is one separator, as is the end of a document. The windows are found by backward search through wavelet ranks,
their occurrences located by sampled suffix positions, and overlapping occurrences merged into removal spans.

The benchmark is the stated query set. It is cut into parts of at most PART_BYTES of text; each is broadcast, and the
shards test one part after the other, so a larger benchmark costs time, not memory. More than MOST_PARTS parts, which
every executor would keep on its disk, are refused.

Defined results: null and empty texts have no words and are clean; an item without words matches nothing, one with
fewer words than a window is one window; equal windows of several items count for all of them; an empty benchmark
marks nothing. Words compare by 64-bit hash, A-Z counting as a-z. Rows that repeat a doc_id are judged each; rows that repeat an
item_id count as one item, and items without an id are left out. Other columns are not looked at, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeseek.llm import common as C
from lodeseek.llm.fm_index import FMIndex

PART_BYTES, MOST_PARTS = 8 << 20, 64
#: Bytes of text in one shard; a longer document is a shard of its own.
SHARD_BYTES = 4 << 20


class Phrases:
    """Distinct windows of a set of benchmark items, over the alphabet of their words."""

    def __init__(self, items: list[tuple[str, str | None]], window: int):
        data, offs = C.text_buffer(pa.array([t for _, t in items], pa.string()))
        h, _, _, first = C.word_hashes(data, offs, C.NOT_WORD)
        self.names = [str(i) for i, _ in items]
        self.vocab, sym = np.unique(h, return_inverse=True)
        sym = sym + 1
        size = np.diff(first)
        n = np.where(size > 0, np.maximum(1, size - window + 1), 0)  # windows of each item
        item = np.repeat(np.arange(len(size)), n)
        start = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + first[item]
        place = start[:, None] + np.arange(window)
        rows = np.where(place < first[item + 1][:, None], sym[np.minimum(place, len(sym) - 1)], 0) if len(sym) else np.zeros((0, window), np.int64)
        self.rows, which = np.unique(rows.astype(np.int32), axis=0, return_inverse=True)
        self.lengths = (self.rows > 0).sum(axis=1)
        pairs = np.unique(np.stack([which.ravel(), item]), axis=1)
        self.owner_at = np.searchsorted(pairs[0], np.arange(len(self.rows) + 1))
        self.owners = pairs[1]

    def symbols(self, h: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.vocab, h)
        at[at == len(self.vocab)] = 0
        return np.where(self.vocab[at] == h, at + 1, 0)

    def matches(self, h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Occurrences (window, word position) in the words h of documents that begin at first."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not len(self.rows) or not len(h):
            return none
        sym = self.symbols(h)
        # A separator before the first word, then for each word its symbol, and one before a document's first word.
        new = np.zeros(len(h), bool)
        new[first[:-1][first[:-1] < len(h)]] = True
        none_before = np.concatenate([[True], sym[:-1] == 0])
        use = (sym > 0) | ~none_before  # of a run of foreign words the first one
        cut = new & ~none_before & (sym > 0)  # a document's end between two words of the alphabet
        size = use.astype(np.int64) + cut
        to = np.cumsum(size)
        seq = np.zeros(int(to[-1]) + 2, np.int64)
        src = np.zeros(len(seq), np.int64)
        at = np.flatnonzero(use)
        seq[to[at]] = sym[at]
        src[to[at]] = at
        index = FMIndex(seq, len(self.vocab) + 1)
        lo, hi = index.search(self.rows, self.lengths)
        n = hi - lo
        which = np.repeat(np.arange(len(n)), n)
        rows = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
        return which, src[index.locate(rows)]


def _parts(benchmark: DataFrame, item_col: str, text_col: str) -> int:
    n = max(1, -(-C.total_bytes(benchmark, text_col) // PART_BYTES))
    if n > MOST_PARTS:
        raise ValueError(f"a benchmark of over {MOST_PARTS * PART_BYTES >> 20} MB: pass it in several tables")
    return n


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = 10, keep: list[str] | None = None, result: str = "result"
) -> DataFrame:
    """Columns `keep` (the id unless given) and struct `result` for each row of docs.

    result: n_words, n_hit (words inside an occurrence), items (sorted ids of items with occurrences), spans (byte
    ranges in the UTF-8 text that cover the hit words, merged).
    """
    sc = docs.sparkSession.sparkContext
    n = _parts(benchmark, item_col, item_text)
    items = benchmark.select(F.col(f"`{item_col}`").cast("string").alias("i"), F.col(f"`{item_text}`").alias("t")).where("i is not null")
    part = F.pmod(F.xxhash64("i", "t"), F.lit(n))
    parts = [sc.broadcast(Phrases([tuple(r) for r in items.where(part == k).collect()], window)) for k in range(n)]

    def work(batch: pa.RecordBatch, data: np.ndarray, offs: np.ndarray) -> dict[str, object]:
        words, hits, names, spans = [], [], [], []
        for i, j in C.slices(offs, SHARD_BYTES):
            pieces = [C.word_hashes(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a], C.NOT_WORD) + (a, b) for a, b in ((i + x, i + y) for x, y in C.slices(offs[i : j + 1] - offs[i]))]
            h = np.concatenate([p[0] for p in pieces])
            starts = np.concatenate([p[1] + offs[p[4]] - offs[i] for p in pieces])
            ends = np.concatenate([p[2] + offs[p[4]] - offs[i] for p in pieces])
            at = np.cumsum([0, *[len(p[0]) for p in pieces]])
            first = np.concatenate([p[3][:-1] + k for p, k in zip(pieces, at[:-1], strict=True)] + [[len(h)]]).astype(np.int64)
            delta, pairs = np.zeros(len(h) + 1, np.int64), []
            for bc in parts:
                ph = bc.value
                win, pos = ph.matches(h, first)
                np.add.at(delta, pos, 1)
                np.add.at(delta, pos + ph.lengths[win], -1)
                doc = np.searchsorted(first, pos, "right") - 1
                dw = np.unique(np.stack([doc, win]), axis=1) if len(win) else np.zeros((2, 0), np.int64)
                own = ph.owner_at[dw[1] + 1] - ph.owner_at[dw[1]]
                flat = np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own) + np.repeat(ph.owner_at[dw[1]], own)
                pairs += [(int(d), ph.names[k]) for d, k in zip(np.repeat(dw[0], own).tolist(), ph.owners[flat].tolist(), strict=True)]
                if len(parts) > 1:  # one part in memory at a time; it is read again from the worker's disk
                    bc.__dict__.pop("_value", None)
            hit = np.cumsum(delta[:-1]) > 0
            total = np.concatenate([[0], np.cumsum(hit)])
            words.append(np.diff(first))
            hits.append(total[first[1:]] - total[first[:-1]])
            found: list[set[str]] = [set() for _ in range(j - i)]
            for d, name in pairs:
                found[d].add(name)
            names += [sorted(x, key=str.encode) for x in found]
            edge = np.zeros(len(h) + 1, bool)
            edge[first] = True
            new = hit & np.concatenate([[True], ~hit[:-1] | edge[1:-1]])[: len(h)]
            last = hit & np.concatenate([~hit[1:] | edge[1:-1], [True]])[: len(h)] if len(h) else hit
            a, b = np.flatnonzero(new), np.flatnonzero(last)
            mine: list[list[dict[str, int]]] = [[] for _ in range(j - i)]
            for d, s, e in zip((np.searchsorted(first, a, "right") - 1).tolist(), starts[a].tolist(), ends[b].tolist(), strict=True):
                z = int(offs[i + d] - offs[i])
                mine[d].append({"start": s - z, "end": e - z})
            spans += mine
        return {
            "n_words": np.concatenate(words).astype(np.int64),
            "n_hit": np.concatenate(hits).astype(np.int64),
            "items": pa.array(names, pa.list_(pa.string())),
            "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
        }

    fields = [("n_words", "bigint"), ("n_hit", "bigint"), ("items", "array<string>"), ("spans", "array<struct<start:bigint,end:bigint>>")]
    return C.map_text(docs, text_col, keep if keep is not None else [id_col], work, fields, result)
