"""Language-model scores by a weighted backoff automaton over n-gram counts of the whole corpus.

Model. Counts of all n-grams up to ORDER in the training documents, smoothed with Dirichlet priors, order by order:

    P1(w)   = (c(w) + 1) / (N + V + 1)            P_o(w | h) = (c(hw) + m_o P_{o-1}(w | h')) / (c(h) + m_o)

As an automaton: a state is a context h that occurs in training; an n-gram hw that occurs is an arc with weight
log10 P_o(w | h) to the state of the longest suffix of hw; where a state has no arc for a token, its failure arc leads to
the state of the shorter context with weight log10(m_o / (c(h) + m_o)), and the root takes any token. A text is read once from
left to right, carrying a state: at each token the state's arc is taken, or failure arcs until a state has one.
PRIORS are the weights m_o with the least perplexity on held-out rows (see README.md).

Distribution. The model grows with the corpus, so no task holds it. Documents are dealt into blocks of about
BLOCK_BYTES by a hash of their id. A block asks for its distinct n-grams: it sends their hashes and training counts,
dealt into buckets by the hash's leading bits; a bucket adds up what all blocks sent and answers each block with
the totals, in the order asked. Each block then builds the automaton of its own n-grams from the answers and runs its
texts through it; a long text is read in pieces of LANE tokens side by side, each after the order - 1 tokens before it, which
determine the state. Requests and answers are one binary row for each block and bucket, so work in the JVM does not
grow with the number of n-grams; the exchange of the texts is used for both passes (Spark reuses it).

Hashes of n-grams have as many bits as make a false match rarer than one in a million (at least 48; words: 48 below the
bucket's bits).

Defined results: null and empty texts are the end token alone; without training documents N = V = 0 and all tokens
are unknown; rows that repeat an id are texts of their own; columns other than id and text are not looked at.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeseek.llm import common as C
from lodeseek.llm.common import from_six, six

U = np.uint64
ORDER = 3
#: Weight of the lower order against counts, for orders 2 and 3: the least perplexity of held-out rows of sf0.1 (see README.md).
PRIORS = {2: 6000.0, 3: 4.0}
BLOCK_BYTES = 6 << 20
#: Tokens that one lane of the automaton reads.
LANE = 1024
END, BEGIN = C.hash_words([b" end", b" begin"])


def sequence(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts, each as BEGIN, words, END, and where each text begins."""
    parts, sizes = [], []
    for i, j in C.slices(offs):
        h, _, _, first = C.word_hashes(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], C.SPACE)
        n = np.diff(first)
        at = np.concatenate([[0], np.cumsum(n + 2)])
        seq = np.empty(at[-1], np.uint64)
        seq[at[:-1]] = BEGIN
        seq[at[1:] - 1] = END
        seq[np.arange(len(h)) + np.repeat(2 * np.arange(j - i) + 1, n)] = h
        parts.append(seq)
        sizes.append(n + 2)
    sizes = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def grams(seq: np.ndarray, at: np.ndarray, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each order the hashes of the n-grams and the positions of their last tokens (BEGIN only as a first token)."""
    place = np.arange(len(seq)) - np.repeat(at[:-1], np.diff(at))
    cur = seq
    out = [(seq, np.arange(len(seq)))]
    for o in range(2, order + 1):
        cur = C.join_hash(cur[:-1], seq[o - 1 :])
        pos = np.arange(o - 1, len(seq))
        use = place[o - 1 :] >= o - 1
        out.append((cur[use], pos[use]))
    return out


def pack(keys: np.ndarray, bits: int) -> tuple[bytes, bytes]:
    """Sorted keys below 2**bits: how many share each high part, and the low 32 bits."""
    high = np.bincount((keys >> U(32)).astype(np.int64), minlength=1 << max(0, bits - 32)).astype(np.uint32) if bits > 32 else np.array([len(keys)], np.uint32)
    return zlib.compress(high.tobytes(), 1), (keys & U(0xFFFFFFFF)).astype(np.uint32).tobytes()


def unpack(high: bytes, low: bytes) -> np.ndarray:
    n = np.frombuffer(zlib.decompress(high), np.uint32)
    return np.repeat(np.arange(len(n), dtype=np.uint64) << U(32), n) | np.frombuffer(low, np.uint32).astype(np.uint64)


class Layout:
    """How hashes are cut: the leading bits choose the bucket, `kept` bits below them are the key (words: `word`)."""

    def __init__(self, n_bytes: int, order: int):
        tokens = max(1, n_bytes // 4)
        self.order = order
        self.bucket_bits = min(24, max(6, math.ceil(math.log2(max(1, n_bytes / (8 << 20))))))
        self.kept = max(33, min(64, max(48, math.ceil(math.log2(tokens)) + 20)) - self.bucket_bits)
        self.word = min(48, 64 - self.bucket_bits)

    def reduce(self, h: np.ndarray, o: int) -> np.ndarray:
        """Words keep 48 bits below the bucket's, or all."""
        return h >> U(64 - self.bucket_bits - (self.word if o == 1 else self.kept))


def block_grams(table: pa.Table, lay: Layout):
    """Of a block's texts: tokens, text starts, and for each order (keys of all n-grams, positions, distinct keys, index of each)."""
    seq, at = sequence(*C.text_buffer(table["t"]))
    out = []
    for o, (h, pos) in enumerate(grams(seq, at, lay.order), 1):
        keys, inverse = np.unique(lay.reduce(h, o), return_inverse=True)
        out.append((pos, keys, inverse))
    return seq, at, out


def requests(lay: Layout):
    shift = [U(lay.word)] + [U(lay.kept)] * lay.order

    def run(table: pa.Table) -> pa.Table:
        block = table["block"][0].as_py()
        table = C.undeal(table, ["k", "t"])
        seq, at, orders = block_grams(table, lay)
        train = np.repeat(table["train"].to_numpy(zero_copy_only=False).astype(bool), np.diff(at))
        rows: list[list[list[bytes]]] = [[] for _ in range(1 << lay.bucket_bits)]
        for o, (pos, keys, inverse) in enumerate(orders):
            count = np.bincount(inverse, weights=train[pos], minlength=len(keys)).astype(np.uint32)
            cut = np.concatenate([[0], np.searchsorted(keys, np.arange(1, 1 << lay.bucket_bits, dtype=np.uint64) << shift[o]), [len(keys)]])
            for b in range(1 << lay.bucket_bits):
                part = keys[cut[b] : cut[b + 1]]
                if o == 0:
                    high, low = b"", six(part)
                else:
                    high, low = pack(part & U((1 << lay.kept) - 1), lay.kept)
                rows[b].append([high, low, zlib.compress(count[cut[b] : cut[b + 1]].tobytes(), 1)])
        n = len(rows)
        return pa.table({"bucket": pa.array(range(n), pa.int32()), "block": pa.array([block] * n, pa.int32()), "asked": pa.array(rows, pa.list_(pa.list_(pa.binary())))})

    return run


def totals(table: pa.Table, o: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """Distinct keys of a bucket with summed counts; for each request, in order, the index of its keys; requests' sizes."""
    asked = table["asked"].to_pylist()
    keys = [from_six(a[o][1]) if o == 0 else unpack(a[o][0], a[o][1]) for a in asked]
    counts = np.concatenate([np.frombuffer(zlib.decompress(a[o][2]), np.uint32) for a in asked])
    uniq, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    return uniq, np.bincount(inverse, weights=counts, minlength=len(uniq)).astype(np.int64), inverse, [len(k) for k in keys]


def answers(lay: Layout):
    def run(table: pa.Table) -> pa.Table:
        out: list[list[bytes]] = [[] for _ in range(table.num_rows)]
        for o in range(lay.order):
            _, total, inverse, sizes = totals(table, o)
            mine = total[inverse].astype(np.uint32)
            at = np.concatenate([[0], np.cumsum(sizes)])
            for r in range(table.num_rows):
                out[r].append(zlib.compress(mine[at[r] : at[r + 1]].tobytes(), 1))
        return pa.table({"block": table["block"], "bucket": table["bucket"], "counts": pa.array(out, pa.list_(pa.binary()))})

    return run


def vocabulary(lay: Layout):
    """Of a bucket: training tokens and distinct training tokens."""
    begin = int(lay.reduce(BEGIN, 1))

    def run(table: pa.Table) -> pa.Table:
        uniq, total, _, _ = totals(table, 0)
        if table["bucket"][0].as_py() == begin >> lay.word:
            total = total[uniq != U(begin & ((1 << lay.word) - 1))]
        return pa.table({"n": pa.array([int(total.sum())]), "v": pa.array([int((total > 0).sum())])})

    return run


class Automaton:
    """States, arcs and failure arcs of a block's n-grams.

    ids[o]: for each place of the token sequence the number of the (o+1)-gram that ends there, or -1; counts[o]: the
    training counts of these n-grams. State 0 is the root; then come the n-grams below the top order, by order.
    """

    def __init__(self, ids: list[np.ndarray], counts: list[np.ndarray], n: int, v: int, priors: dict[int, float]):
        order = len(ids)
        self.base = np.concatenate([[1], 1 + np.cumsum([len(c) for c in counts[:-1]])]).astype(np.int64)
        self.symbols = len(counts[0])
        self.unknown = float(np.log10(1 / (n + v + 1)))
        self.fail = np.zeros(self.base[-1], np.int64)
        self.loss = np.zeros(self.base[-1])
        p = (counts[0] + 1) / (n + v + 1)
        #: The root's arcs, by token: weight and target.
        self.root_weight = np.log10(p)
        self.root_to = np.where(counts[0] > 0, self.base[0] + np.arange(self.symbols), 0) if order > 1 else np.zeros(self.symbols, np.int64)
        keys, weights, targets = [], [], []
        for o in range(1, order):
            m = priors.get(o + 1, 10.0)
            place = np.zeros(len(counts[o]), np.int32)
            at = np.flatnonzero(ids[o] >= 0)
            place[ids[o][at]] = at
            del at
            context, suffix = ids[o - 1][place - 1], ids[o - 1][place]
            p = (counts[o] + m * p[suffix]) / (counts[o - 1][context] + m)
            arc = np.flatnonzero(counts[o] > 0)
            keys.append((self.base[o - 1] + context[arc]) * self.symbols + ids[0][place[arc]])
            weights.append(np.log10(p[arc]))
            if o < order - 1:
                mine = self.base[o] + np.arange(len(counts[o]))
                self.fail[mine] = self.base[o - 1] + suffix
                targets.append(mine[arc])
            else:
                targets.append(self.base[o - 1] + suffix[arc])
            states = self.base[o - 1] + np.arange(len(counts[o - 1]))
            self.loss[states] = np.log10(m / (counts[o - 1] + m))
        keys = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        sort = np.argsort(keys)
        self.keys = keys[sort]
        del keys
        self.weight = np.concatenate(weights)[sort] if weights else np.zeros(0)
        self.to = np.concatenate(targets)[sort] if targets else np.zeros(0, np.int64)

    def step(self, state: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log-probabilities of a token in each state, and the states after it."""
        score, after = np.zeros(len(state)), np.zeros(len(state), np.int64)
        todo = np.arange(len(state))
        cur = state
        while len(todo):
            root = cur == 0
            if root.any():
                r, t = todo[root], token[todo[root]]
                score[r] += self.root_weight[t]
                after[r] = self.root_to[t]
                todo, cur = todo[~root], cur[~root]
            if not len(todo):
                break
            key = cur * self.symbols + token[todo]
            at = np.searchsorted(self.keys, key)
            at[at == len(self.keys)] = 0
            hit = self.keys[at] == key if len(self.keys) else np.zeros(len(key), bool)
            score[todo[hit]] += self.weight[at[hit]]
            after[todo[hit]] = self.to[at[hit]]
            todo, cur = todo[~hit], cur[~hit]
            score[todo] += self.loss[cur]
            cur = self.fail[cur]
        return score, after

    def read(self, tokens: np.ndarray, at: np.ndarray, begin: int) -> np.ndarray:
        """Log-probability of each token after the first of each text (token `begin`); texts begin at `at`."""
        order = len(self.base)
        size = np.diff(at) - 1
        lanes = np.maximum(1, -(-size // LANE))
        text = np.repeat(np.arange(len(size)), lanes)
        k = np.arange(len(text)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        start = at[:-1][text] + 1 + k * LANE
        stop = np.minimum(start + LANE, at[1:][text])
        state = np.zeros(len(text), np.int64)
        if order > 1:
            state[k == 0] = self.root_to[begin]
            for back in range(order - 1, 0, -1):  # later lanes reach their state over the tokens before them
                late = np.flatnonzero(k > 0)
                state[late] = self.step(state[late], tokens[start[late] - back])[1]
        by_size = np.argsort(start - stop, kind="stable")
        start, stop, state = start[by_size], stop[by_size], state[by_size]
        out = np.zeros(len(tokens))
        size = stop - start
        for t in range(int(size.max(initial=0))):
            n = int(np.searchsorted(-size, -t, "left"))  # lanes with more than t tokens
            place = start[:n] + t
            out[place], state[:n] = self.step(state[:n], tokens[place])
        return out


def scores(lay: Layout, priors: dict[int, float]):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        left = C.undeal(left, ["k", "t"])
        seq, at, orders = block_grams(left, lay)
        orders = [(pos, len(keys), inverse.astype(np.int32)) for pos, keys, inverse in orders]
        right = right.sort_by("bucket")
        got = right["counts"].to_pylist()
        n, v = right["n"][0].as_py(), right["v"][0].as_py()
        ids, counts = [], []
        while orders:
            pos, size, inverse = orders.pop(0)
            total = np.concatenate([np.frombuffer(zlib.decompress(g[len(ids)]), np.uint32) for g in got]).astype(np.float64)
            if len(total) != size:
                raise ValueError("the answers do not fit the block's n-grams")
            own = np.full(len(seq), -1, np.int32)
            own[pos] = inverse
            ids.append(own)
            counts.append(total)
        del pos, inverse, got
        begin = int(ids[0][at[0]]) if len(at) > 1 else 0
        score = Automaton(ids, counts, n, v, priors).read(ids[0], at, begin)
        real = seq != BEGIN
        known = counts[0][ids[0][real]]
        base = np.log10((known + 1) / (n + v + 1))
        first = (at - np.arange(len(at)))[:-1]  # without the BEGIN tokens
        add = lambda x: np.add.reduceat(x, first) if len(first) else x[:0]
        size = np.diff(at) - 1
        return pa.table({"k": left["k"], "train": left["train"], "n_tokens": pa.array(size), "n_known": pa.array(add((known > 0).astype(np.int64))), "train_tokens": pa.array(np.full(len(size), n)), "base_score": pa.array(add(base)), "score": pa.array(add(score[real]))})

    return run


def lm_scores(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, block_bytes: int = BLOCK_BYTES, priors: dict[int, float] | None = None) -> DataFrame:
    """For each row of docs: id, held_out (not `train`), n_tokens, n_known, train_tokens, base_score, score."""
    size = C.total_bytes(docs, text_col)
    lay = Layout(size, order)
    blocks = max(1, -(-size // block_bytes))
    kind = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    ident = F.col(f"`{id_col}`")
    rows = docs.select(F.pmod(F.xxhash64(ident, F.substring(text, 1, 64)), F.lit(blocks)).cast("int").alias("block"), ident.alias("k"), F.coalesce(train, F.lit(False)).alias("train"), text.alias("t"))
    rows = C.deal(rows)
    asked = rows.groupBy("block").applyInArrow(requests(lay), "bucket int, block int, asked array<array<binary>>").groupBy("bucket")
    told = asked.applyInArrow(answers(lay), "block int, bucket int, counts array<binary>")
    count = asked.applyInArrow(vocabulary(lay), "n bigint, v bigint").agg(F.sum("n").alias("n"), F.sum("v").alias("v"))
    told = told.crossJoin(F.broadcast(count))  # one row
    out = rows.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(scores(lay, priors or PRIORS), f"k {kind}, train boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
    return out.select(F.col("k").alias(id_col), (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
