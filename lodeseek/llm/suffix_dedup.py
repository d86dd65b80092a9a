"""Removal of passages that repeat across documents, by merging Burrows-Wheeler transforms.

A byte goes if a WINDOW-byte string that covers it also starts in a document with a smaller id. Three steps, all exact:

1. Anchors. Each window is assigned to its minimiser: the K-byte substring with the smallest hash (the leftmost of
   equals). Equal windows have equal anchors at equal offsets, so only documents that share an anchor can share a
   window. Consecutive windows with one anchor are a run, and its bytes the anchor's context. Blocks of documents send their
   distinct (anchor, context) hashes with the smallest id to hash buckets, which answer with the smallest id that has this
   context anywhere. A run in a document with a larger id repeats as a whole: settled. What is left are the first
   occurrences of contexts whose anchor also has other contexts.
2. Merge. These contexts go, once each, to a bucket of their anchor. Rows from one block group are a shard: its suffixes
   are sorted and give its Burrows-Wheeler transform. The shards' transforms are merged by interleave refinement:
   starting from the plain concatenation, each round deals the interleave out by the transforms' symbols, as many at once as
   fit, numbered, beside a place in 64 bits (ten or more in prose), which orders all suffixes by as many more; no suffix of another
   shard is compared. After WINDOW symbols the intervals without boundaries are the repeated windows, and the smallest id in an interval
   decides.
3. Cut. Each block recomputes its runs, applies both answers, and merges overlapping windows into removed spans.

Buckets are chosen by hash, and a context reaches a bucket at most once per block in step 1 and once in all in step 2, so
a passage that stands in a third of all documents is as many small rows as there are blocks. There is a row for each pair of block
and bucket, so buckets of messages are few and large (MESSAGE_BYTES of text); a merge takes them in smaller ones (MERGE_BYTES).

A line that many documents hold between different texts gives one anchor as many contexts as documents. Such hot anchors
are split: their windows by the place of the anchor, CHUNK places a piece, with the bytes that all windows of a piece share as
the new key; pieces that are hot still become single windows, keyed by the piece and some bits of the window's hash, more bits
the larger the input. Each key follows from the window's bytes alone and the hot keys, which are the same for all tasks, so
equal windows still meet, and what is open is merged as before. Hot keys are those with HOT or more contexts in the
first block, a random part of the input by hash: they decide how work is dealt out, never what is found.

Defined results: null is the empty text; texts shorter than a window lose nothing; repeats within one document stay;
rows that repeat an id count as one document, which loses nothing to itself. Ids are integers; a null id counts as
the largest. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeseek.llm import common as C
from lodeseek.llm.common import from_six, six

U = np.uint64
WINDOW, K = 50, 20
BLOCK_BYTES = 4 << 20
#: A text is handled in pieces of so many window starts; pieces overlap by a window.
PIECE = 1 << 18
SHARDS = 8
#: Bytes of input text, at least, for each bucket of messages and for each merge.
MESSAGE_BYTES, MERGE_BYTES = 32 << 20, 8 << 20
#: Shorter parts of messages are not compressed.
SMALL = 1 << 10
POS = U((1 << 24) - 1)
NONE = np.iinfo(np.int64).max
#: A key with so many contexts in the first block is split.
HOT = 32
#: Places of a hot anchor in its windows that stay together.
CHUNK = 8


class Hot:
    """Keys to split: hot anchors, hot pieces of theirs, and the number of bits of a window's hash that deal the latter out."""

    def __init__(self, anchors=(), chunks=(), bits: int = 4):
        self.anchors, self.chunks, self.bits = np.sort(np.array(anchors, np.uint64)), np.sort(np.array(chunks, np.uint64)), bits


def runs(data: np.ndarray, offs: np.ndarray, window: int = WINDOW, hot: Hot | None = None) -> tuple[np.ndarray, ...]:
    """Of the texts' windows: key (anchor hash, or that of a piece), context hash, first and last start (places in data) and text number of each run."""
    out = []
    for i, j in C.slices(offs, PIECE):
        for a, b in pieces(int(offs[i]), int(offs[j]), window):
            part = data[a:b]
            own = np.clip(offs[i : j + 1], a, b) - a
            got = _runs(part, own, window, hot or Hot())
            if got is not None:
                anchor, ctx, lo, hi, doc = got
                out.append((anchor, ctx, lo + a, hi + a, doc + i))
    if not out:
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), z, z, z
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def pieces(a: int, b: int, window: int) -> Iterator[tuple[int, int]]:
    """A slice is one piece unless it is one long text."""
    if b - a <= 2 * PIECE:
        yield a, b
        return
    for s in range(a, max(a + 1, b - window + 1), PIECE):
        yield s, min(b, s + PIECE + window - 1)


def _runs(data: np.ndarray, offs: np.ndarray, window: int, hot: Hot):
    n = len(data) - window + 1
    if n <= 0:
        return None
    sums = C.prefix_sums(data)
    m = len(data) - K + 1
    # The order of K-grams: the high 40 bits of a multiplied hash, then the place.
    low = (sums[K:] - sums[:-K]) * C.powers(len(sums))[1][:m]
    low *= U(0x9E3779B97F4A7C15)
    low ^= low >> U(29)
    low *= U(0xBF58476D1CE4E5B9)
    low &= ~POS
    low |= np.arange(m, dtype=np.uint64)
    span, have = window - K + 1, 1
    while have * 2 <= span:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    if have < span:
        low = np.minimum(low[: len(low) - (span - have)], low[span - have :])
    # Windows that would cross the end of a text: the last window - 1 starts of each.
    cross = np.zeros(len(data) + 1, np.int32)
    ends = offs[1:]
    np.add.at(cross, np.maximum(offs[:-1], ends - window + 1), 1)
    np.add.at(cross, ends, -1)
    ok = np.cumsum(cross, dtype=np.int32)[:n] == 0
    new, end = ok.copy(), ok.copy()
    change = low[1:n] != low[: n - 1]
    new[1:] &= change | ~ok[:-1]
    end[:-1] &= change | ~ok[1:]
    lo, hi = np.flatnonzero(new), np.flatnonzero(end)
    if not len(lo):
        return None
    pos = (low[lo] & POS).astype(np.int64)
    key, lo, hi, pos = split(sums, C.span_hash(sums, pos, pos + K), lo, hi, pos, window, hot)
    ctx = C.join_hash(C.span_hash(sums, lo, hi + window), (pos - lo).astype(np.uint64))
    return key, ctx, lo, hi, np.searchsorted(offs, lo, "right") - 1


def split(sums: np.ndarray, key: np.ndarray, lo: np.ndarray, hi: np.ndarray, pos: np.ndarray, window: int, hot: Hot) -> tuple[np.ndarray, ...]:
    """Runs (key, first and last start, place of the anchor) with those of hot keys cut into pieces, and hot pieces into windows."""
    is_hot = among(key, hot.anchors)
    if not is_hot.any():
        return key, lo, hi, pos
    rest = [x[~is_hot] for x in (key, lo, hi, pos)]
    old, a, b, p = (x[is_hot] for x in (key, lo, hi, pos))
    first, last = (p - a) // CHUNK, (p - b) // CHUNK  # the pieces of a run, from its first window to its last
    row, step = spread(first - last + 1)
    piece = first[row] - step
    near = p[row] - CHUNK * piece  # the last start of a whole piece; its windows share the bytes from there on
    a, b = np.maximum(a[row], near - CHUNK + 1), np.minimum(b[row], near)
    old, p = C.join_hash(old[row], C.join_hash(C.span_hash(sums, near, near + window - CHUNK + 1), piece.astype(np.uint64))), p[row]
    single = among(old, hot.chunks)
    row, step = spread((b - a + 1)[single])
    at = a[single][row] + step
    fine = C.span_hash(sums, at, at + window) >> U(64 - hot.bits)
    more = [C.join_hash(old[single][row], fine), at, at, p[single][row]]
    return tuple(np.concatenate([r, x[~single], m]) for r, x, m in zip(rest, (old, a, b, p), more, strict=True))


def among(x: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether x is one of the sorted keys."""
    if not len(keys):
        return np.zeros(len(x), bool)
    return keys[np.minimum(np.searchsorted(keys, x), len(keys) - 1)] == x


def spread(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For counts n: row numbers, each repeated as often as its count, and 0, 1, ... within each row."""
    row = np.repeat(np.arange(len(n)), n)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)


def order_by(first: np.ndarray, *rest: np.ndarray) -> np.ndarray:
    """Order by first, then by rest: only rows that share their first key are sorted by all."""
    order = np.argsort(first)
    same = np.zeros(len(order) + 1, bool)
    same[1:-1] = first[order[1:]] == first[order[:-1]]
    tied = np.flatnonzero(same[:-1] | same[1:])
    rows = order[tied]
    order[tied] = rows[np.lexsort([k[rows] for k in (*rest[::-1], first)])]
    return order


class Block:
    """A block's texts in a fixed order, its runs, and its distinct (anchor, context) keys."""

    def __init__(self, table: pa.Table, window: int, hot: Hot | None = None):
        self.table = table = C.undeal(table, ["k", "t"])
        self.ids = table["k"].fill_null(NONE).to_numpy()
        self.data, self.offs = C.text_buffer(table["t"])
        self.anchor, ctx, self.lo, self.hi, self.doc = runs(self.data, self.offs, window, hot)
        order = order_by(self.anchor, ctx, self.doc)
        a, c = self.anchor[order], ctx[order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (c[1:] != c[:-1])
        self.first = order[new]  # a run of each key, in the text with the smallest id
        self.code = np.empty(len(a), np.int64)
        self.code[order] = np.cumsum(new) - 1
        self.key_anchor, self.key_ctx = a[new], c[new]
        self.key_id = self.ids[self.doc[self.first]]

    def cut(self, bits: int) -> np.ndarray:
        """First place of each bucket among the keys, which are sorted by anchor."""
        return np.concatenate([[0], np.searchsorted(self.key_anchor, np.arange(1, 1 << bits, dtype=np.uint64) << U(64 - bits)), [len(self.key_anchor)]])


def hot_keys(window: int):
    """Keys of a block with HOT or more contexts: anchors, and pieces of these."""

    def run(table: pa.Table) -> pa.Table:
        found = []
        for _ in range(2):
            blk = Block(table, window, Hot(*found))
            keys, n = np.unique(blk.key_anchor, return_counts=True)
            found.append(keys[n >= HOT])
        level = np.repeat([0, 1], [len(x) for x in found])
        return pa.table({"level": pa.array(level, pa.int32()), "key": pa.array(np.concatenate(found).view(np.int64))})

    return run


def packed(x: np.ndarray | bytes) -> bytes:
    raw = x if isinstance(x, bytes) else np.ascontiguousarray(x).tobytes()
    return b"0" + raw if len(raw) < SMALL else b"1" + zlib.compress(raw, 1)


def unpacked(raw: bytes) -> bytes:
    return raw[1:] if raw[:1] == b"0" else zlib.decompress(raw[1:])


def small_ids(x: np.ndarray) -> list[bytes]:
    """Ids as their smallest one and the differences from it, in as few bytes as these need."""
    base = int(x.min()) if len(x) else 0
    d = (x - base).astype(np.uint64)
    top = int(d.max()) if len(x) else 0
    kind = np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64
    return [np.array([base], np.int64).tobytes() + np.dtype(kind).char.encode(), d.astype(kind).tobytes()]


def ids_of(head: bytes, body: bytes) -> np.ndarray:
    return np.frombuffer(body, np.dtype(head[8:].decode())).astype(np.int64) + np.frombuffer(head[:8], np.int64)[0]


def requests(bits: int, window: int, hot: Hot):
    def run(table: pa.Table) -> pa.Table:
        blk = Block(table, window, hot)
        block = table["block"][0].as_py()
        cut = blk.cut(bits)
        rows = []
        for b in range(1 << bits):
            s = slice(cut[b], cut[b + 1])
            rows.append([six(blk.key_anchor[s] >> U(max(0, 64 - bits - 48))), six(blk.key_ctx[s]), *small_ids(blk.key_id[s])])
        n = len(rows)
        return pa.table({"bucket": pa.array(range(n), pa.int32()), "block": pa.array([block] * n, pa.int32()), "asked": pa.array(rows, pa.list_(pa.binary()))})

    return run


def starts_of(*cols: np.ndarray) -> np.ndarray:
    """Where a group of equal rows begins, in sorted columns."""
    new = np.ones(len(cols[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in cols])
    return new


def answers(table: pa.Table) -> pa.Table:
    """For each key asked for: the smallest id with this context if others have the anchor, and whether other contexts do."""
    asked = table["asked"].to_pylist()
    anchor = np.concatenate([from_six(a[0]) for a in asked])
    ctx = np.concatenate([from_six(a[1]) for a in asked])
    ids = np.concatenate([ids_of(a[2], a[3]) for a in asked])
    sizes = [len(a[0]) // 6 for a in asked]
    order = order_by(anchor, ctx)
    a, c, d = anchor[order], ctx[order], ids[order]
    least, flag = np.full(len(a), NONE), np.zeros(len(a), np.uint8)
    if len(a):
        new_a, new_c = starts_of(a), starts_of(a, c)
        at_a, at_c = np.flatnonzero(new_a), np.flatnonzero(new_c)
        in_a, in_c = np.cumsum(new_a) - 1, np.cumsum(new_c) - 1
        several = np.minimum.reduceat(d, at_a) != np.maximum.reduceat(d, at_a)
        kinds = np.add.reduceat(new_c.astype(np.int64), at_a)
        low = np.minimum.reduceat(d, at_c)[in_c]
        least[order] = np.where(low == d, NONE, low)  # no smaller one than that asked with
        flag[order] = (several & (kinds > 1))[in_a]
    at = np.concatenate([[0], np.cumsum(sizes)])
    out = []
    for r in range(table.num_rows):
        mine = least[at[r] : at[r + 1]]
        less = mine != NONE
        head, body = small_ids(mine[less])
        out.append([packed(np.packbits(less)), head, packed(body), packed(np.packbits(flag[at[r] : at[r + 1]]))])
    return pa.table({"block": table["block"], "bucket": table["bucket"], "told": pa.array(out, pa.list_(pa.binary()))})


def read_answers(rows: pa.Table, cut: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key of a block the smallest id with its context anywhere (own: here), and whether its anchor has other contexts."""
    least, flag = own.copy(), []
    for r, (less, head, body, f) in enumerate(rows.sort_by("bucket")["told"].to_pylist()):
        n = cut[r + 1] - cut[r]
        least[cut[r] + np.flatnonzero(bits_of(less, n))] = ids_of(head, unpacked(body))
        flag.append(bits_of(f, n))
    return least, np.concatenate(flag).astype(bool)


def bits_of(raw: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(unpacked(raw), np.uint8), count=int(n))


def open_contexts(bits: int, fine: int, window: int, hot: Hot):
    """Contexts whose first occurrence is in this block and whose anchor has other contexts: one row for each bucket, in the order of its 2**fine merges."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows, buckets = [], []
        if left.num_rows and right.num_rows:
            blk = Block(left, window, hot)
            cut = blk.cut(bits)
            least, flag = read_answers(right, cut, blk.key_id)
            for b in range(1 << bits):
                k = np.arange(cut[b], cut[b + 1])
                k = k[flag[k] & (blk.key_id[k] == least[k])]
                if not len(k):
                    continue
                r = blk.first[k]
                size = blk.hi[r] - blk.lo[r] + window
                at = np.cumsum(size) - size
                src = np.arange(size.sum()) - np.repeat(at, size) + np.repeat(blk.lo[r], size)
                buckets.append(b)
                merge = (blk.key_anchor[k] << U(bits)) >> U(64 - fine) if fine else np.zeros(len(k), np.uint64)
                of = np.bincount(merge.astype(np.int64), minlength=1 << fine).astype(np.uint32)
                rows.append([(k - cut[b]).astype(np.uint32).tobytes(), *small_ids(least[k]), size.astype(np.uint32).tobytes(), packed(blk.data[src]), of.tobytes()])
        block = left["block"][0].as_py() if left.num_rows else 0
        return pa.table({"bucket": pa.array(buckets, pa.int32()), "block": pa.array([block] * len(rows), pa.int32()), "ctx": pa.array(rows, pa.list_(pa.binary()))})

    return run


def ranks(key: np.ndarray, bits: int = 64) -> tuple[np.ndarray, np.ndarray, int]:
    """Dense ranks of keys below 2**bits, an order of the keys, and how many differ. Keys that leave room for their place are sorted as numbers."""
    room = width(len(key))
    if bits + room <= 64:
        got = np.sort((key << U(room)) | np.arange(len(key), dtype=np.uint64))
        order = (got & U((1 << room) - 1)).astype(np.int64)
        got >>= U(room)
    else:
        order = np.argsort(key)
        got = key[order]
    number = np.cumsum(starts_of(got))
    out = np.empty(len(key), np.uint64)
    out[order] = number - 1
    return out, order, int(number[-1]) if len(key) else 0


def width(n: int) -> int:
    """Bits that hold numbers below n."""
    return max(1, (n - 1).bit_length())


def ahead(x: np.ndarray, step: int) -> np.ndarray:
    """What stands step places later; 0 after the end."""
    out = np.zeros(len(x), x.dtype)
    out[: max(0, len(x) - step)] = x[step:]
    return out


def shard_transform(data: np.ndarray, size: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of all suffixes of the texts by their first depth bytes, and the symbols of the texts.

    Each text is followed by a terminator, symbol 0, which is smaller than all bytes (symbols 1..256). Ranks of the
    first few symbols are joined, two or more at once, up to depth; suffixes that agree so far may stand in any order.
    """
    n = len(size)
    ends = np.cumsum(size + 1) - 1
    seq = np.zeros(len(data) + n, np.uint16)
    body = np.ones(len(seq), bool)
    body[ends] = False
    seq[body] = data
    seq[body] += np.uint16(1)
    left = np.repeat(ends, size + 1) - np.arange(len(seq))  # symbols up to the terminator
    symbol, kinds = numbered(seq)
    kinds, have, fits = kinds - 1, 1, 64 - width(len(seq))
    base = rank = symbol.astype(np.uint64)
    while True:
        bits, key, got = width(kinds + 1), rank, have
        parts = max(2, fits // bits)
        for _ in range(parts - 1):
            step = min(have, depth - got)
            if step <= 0:
                break
            # What is beyond a terminator is 0, as is the terminator; where step is short the two overlap.
            after = ahead(base, got - have + step)
            after[left < got - have + step] = 0
            key = (key << U(bits)) | after
            got += step
        rank, order, kinds = ranks(key, min(64, bits * parts))
        have = got
        if have >= depth:
            return order, seq
        rank += U(1)
        base = rank


def numbered(code: np.ndarray) -> tuple[np.ndarray, int]:
    """Symbols of any shards by their rank among those that occur, and how many occur."""
    used = np.zeros(257, bool)
    used[code] = True
    number = np.cumsum(used, dtype=np.int32)
    number -= 1
    return number.astype(np.uint16)[code], int(used.sum())


def transforms(orders: list[np.ndarray], seqs: list[np.ndarray], rounds: int) -> list[np.ndarray]:
    """What each round of a merge deals out by: the shards' transforms by as many symbols at once as fit beside a place in 64 bits.

    A shard is a ring: before its first symbol stands its last one. As many symbols as fit are a gram; the grams that occur are
    numbered, and as many numbers as fit are a code. Codes are in the symbols' order.
    """
    fits = 64 - width(sum(len(s) for s in seqs))
    every, kinds = numbered(np.concatenate(seqs))
    bits = width(kinds)
    at = np.cumsum([len(s) for s in seqs])[:-1]
    rings = np.split(every.astype(np.uint64), at)

    def gram(k: int) -> list[np.ndarray]:
        """The k symbols from each place of a shard on."""
        return [sum((np.roll(r, -i) << U(bits * (k - 1 - i)) for i in range(k)), np.zeros(len(r), np.uint64)) for r in rings]

    def before(grams: list[np.ndarray], k: int) -> list[np.ndarray]:
        return [np.roll(g, k) for g in grams]

    def placed(codes: list[np.ndarray]) -> np.ndarray:
        return np.concatenate([c[o] for c, o in zip(codes, orders, strict=True)])

    span = max(1, min(rounds, fits // bits))
    number, _, kinds = ranks(np.concatenate(gram(span)), min(64, bits * span))
    grams, wide = np.split(number, at), width(kinds)
    many = max(1, fits // wide)

    def code(k: int) -> np.ndarray:
        """Code of the k symbols before each suffix, in whole grams and the symbols that are left."""
        whole, rest = divmod(k, span)
        out = before(gram(rest), k) if rest else [np.zeros(len(r), np.uint64) for r in rings]
        for i in range(whole):
            out = [(c << U(wide)) | g for c, g in zip(out, before(grams, (whole - i) * span), strict=True)]
        return placed(out)

    most = many * span
    whole, rest = divmod(rounds, most)
    by = [code(most)] * whole if whole else []
    while rest:  # symbols that do not fit beside the grams have a round of their own
        odd = rest % span
        k = rest if not odd or bits * odd + wide * (rest // span) <= fits else odd
        by.append(code(k))
        rest -= k
    return by


def merge_transforms(orders: list[np.ndarray], seqs: list[np.ndarray], rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Interleave of the shards' suffixes ordered by their first `rounds` symbols, and where intervals of equal ones begin."""
    z = np.repeat(np.arange(len(seqs), dtype=np.uint8), [len(s) for s in seqs])
    room = width(len(z))
    group = np.zeros(len(z), np.int32)
    new = np.zeros(len(z), bool)
    new[:1] = True
    for text in transforms(orders, seqs, rounds):
        key = text << U(room)
        key |= by_shard(z, len(seqs)).astype(np.uint64)  # the next symbols of each shard, and their places in the interleave
        key.sort()
        deal = (key & U((1 << room) - 1)).astype(np.int64)
        key >>= U(room)
        z, g = z[deal], group[deal]
        np.not_equal(g[1:], g[:-1], out=new[1:])
        new[1:] |= key[1:] != key[:-1]
        np.cumsum(new, out=group)
    return z, new


def by_shard(z: np.ndarray, shards: int) -> np.ndarray:
    """Interleave places of all shards' suffixes, in the shards' own order."""
    return np.concatenate([np.flatnonzero(z == k) for k in range(shards)])


def repeated(windows: int, parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """For each shard (bytes, texts' sizes, texts' ids): for every byte whether the window there starts in a text with a smaller id."""
    orders, seqs = zip(*[shard_transform(d, s, windows) for d, s, _ in parts], strict=True)
    z, new = merge_transforms(list(orders), list(seqs), windows)
    del seqs
    ids, room, place = [], [], []
    for order, (_, size, owner) in zip(orders, parts, strict=True):
        text = np.repeat(np.arange(len(size)), size + 1)[order]
        ids.append(owner[text])
        room.append((np.cumsum(size + 1) - 1)[text] - order >= windows)
        place.append(order - text)
    back = by_shard(z, len(parts))
    got = np.empty(len(z), np.int64)
    got[back] = np.concatenate(ids)
    ok = np.empty(len(z), bool)
    ok[back] = np.concatenate(room)
    at = np.flatnonzero(new)
    low = np.minimum.reduceat(np.where(ok, got, NONE), at)[np.cumsum(new) - 1]
    hit = (ok & (low < got))[back]
    out, k = [], 0
    for p, r, (d, _, _) in zip(place, room, parts, strict=True):
        flags = np.zeros(len(d), bool)
        h = hit[k : k + len(p)]
        flags[p[h & r]] = True
        out.append(flags)
        k += len(p)
    return out


class Contexts:
    """The contexts of one block in a bucket: ids, sizes and bytes, cut into the bucket's merges."""

    def __init__(self, row: list[bytes]):
        self.keys, head, body, sizes, data, of = row
        self.ids, self.size, self.data = ids_of(head, body), np.frombuffer(sizes, np.uint32).astype(np.int64), np.frombuffer(unpacked(data), np.uint8)
        self.cut = np.concatenate([[0], np.cumsum(np.frombuffer(of, np.uint32).astype(np.int64))])
        self.edge = np.concatenate([[0], np.cumsum(self.size)])[self.cut]
        self.flags = np.zeros(len(self.data), bool)

    def part(self, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        s = slice(self.cut[m], self.cut[m + 1])
        return self.data[self.edge[m] : self.edge[m + 1]], self.size[s], self.ids[s]


def merge_bucket(fine: int, window: int):
    def run(table: pa.Table) -> pa.Table:
        blocks, rows = table["block"].to_numpy(), [Contexts(r) for r in table["ctx"].to_pylist()]
        order = np.argsort(blocks, kind="stable").tolist()
        for m in range(1 << fine):
            shard: dict[int, list[Contexts]] = {}
            for r in order:
                if rows[r].cut[m] < rows[r].cut[m + 1]:
                    shard.setdefault(int(blocks[r]) % SHARDS, []).append(rows[r])
            if not shard:
                continue
            parts = [tuple(np.concatenate(x) for x in zip(*[c.part(m) for c in own], strict=True)) for own in shard.values()]
            for own, flags in zip(shard.values(), repeated(window, parts), strict=True):
                k = 0
                for c in own:
                    n = int(c.edge[m + 1] - c.edge[m])
                    c.flags[c.edge[m] : c.edge[m + 1]] = flags[k : k + n]
                    k += n
        masks = [[c.keys, packed(np.packbits(c.flags)), c.size.astype(np.uint32).tobytes()] for c in rows]
        return pa.table({"block": table["block"], "bucket": table["bucket"], "told": pa.array(masks, pa.list_(pa.binary()))})

    return run


def cuts(bits: int, window: int, hot: Hot, id_kind: pa.DataType):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        blk = Block(left, window, hot)
        n = len(blk.offs) - 1
        delta = np.zeros(len(blk.data) + 1, np.int32)
        if right.num_rows and len(blk.lo):
            cut = blk.cut(bits)
            first = np.asarray(right["merged"].to_numpy(zero_copy_only=False)).astype(bool)
            least, _ = read_answers(right.filter(pa.array(~first)), cut, blk.key_id)
            own = blk.ids[blk.doc]
            whole = own > least[blk.code]
            np.add.at(delta, blk.lo[whole], 1)
            np.add.at(delta, blk.hi[whole] + window, -1)
            rest = np.flatnonzero(~whole)
            mask = right.filter(pa.array(first))
            if mask.num_rows and len(rest):
                begin = np.full(len(blk.key_anchor), -1)
                bitmaps, at = [], 0
                for b, (keys, m, sz) in zip(mask["bucket"].to_pylist(), mask["told"].to_pylist(), strict=True):
                    size = np.frombuffer(sz, np.uint32).astype(np.int64)
                    begin[np.frombuffer(keys, np.uint32) + cut[b]] = at + np.cumsum(size) - size
                    bitmaps.append(bits_of(m, size.sum()))
                    at += int(size.sum())
                flags = np.concatenate(bitmaps)
                rest = rest[begin[blk.code[rest]] >= 0]
                size = blk.hi[rest] - blk.lo[rest] + 1
                off = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                start = (np.repeat(blk.lo[rest], size) + off)[flags[np.repeat(begin[blk.code[rest]], size) + off] > 0]
                np.add.at(delta, start, 1)
                np.add.at(delta, start + window, -1)
        gone = np.cumsum(delta[:-1], dtype=np.int32) > 0
        removed, spans, sha, kept, where = np.zeros(n, np.int64), np.zeros(n, np.int64), [], [], []
        raw = blk.data.tobytes()
        edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
        a, b = edge[::2], edge[1::2]
        doc_a = np.searchsorted(blk.offs, a, "right") - 1
        doc_b = np.searchsorted(blk.offs, b - 1, "right") - 1
        mine: dict[int, list[tuple[int, int]]] = {}
        for s, e, d, last in zip(a.tolist(), b.tolist(), doc_a.tolist(), doc_b.tolist(), strict=True):
            while d <= last:  # a removed end and a removed beginning of neighbours in the block are two spans
                x, y = max(s, int(blk.offs[d])), min(e, int(blk.offs[d + 1]))
                if y > x:
                    mine.setdefault(d, []).append((x, y))
                d += 1
        for d in range(n):
            at, end, left_over = int(blk.offs[d]), int(blk.offs[d + 1]), []
            own = mine.get(d, [])
            for s, e in own:
                left_over.append(raw[at:s])
                at = e
            left_over.append(raw[at:end])
            text = b"".join(left_over)
            removed[d], spans[d] = end - int(blk.offs[d]) - len(text), len(own)
            sha.append(hashlib.sha256(text).hexdigest())
            kept.append(text)
            where.append([{"start": s - int(blk.offs[d]), "end": e - int(blk.offs[d])} for s, e in own])
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.table({"k": blk.table["k"].cast(id_kind), "n_bytes": np.diff(blk.offs), "n_removed": removed, "spans": pa.array(where, kind), "kept": pa.array(kept, pa.binary()), "sha": sha})

    return run


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """For each row of docs: id, n_bytes, n_removed, spans (removed byte ranges), kept (remaining bytes), kept_sha256."""
    if window < K:
        raise ValueError(f"windows have {K} bytes or more")
    size = C.total_bytes(docs, text_col)
    blocks = max(1, -(-size // block_bytes))
    bits = min(14, max(6, (size // MESSAGE_BYTES).bit_length()))
    fine = max(0, (size // MERGE_BYTES).bit_length() - bits)
    ident, text = F.col(f"`{id_col}`").cast("long"), F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.pmod(F.xxhash64(ident, F.substring(text, 1, 64)), F.lit(blocks)).cast("int").alias("block"), ident.alias("k"), text.alias("t"))
    sample = C.deal_texts(rows.where("block = 0")).groupBy("block").applyInArrow(hot_keys(window), "level int, key bigint").collect()  # at most a block's keys / HOT
    keys = [np.array([r.key for r in sample if r.level == k], np.int64).view(np.uint64) for k in (0, 1)]
    hot = Hot(*keys, bits=min(40, (4 * blocks).bit_length()))
    rows = C.deal_texts(rows)
    asked = rows.groupBy("block").applyInArrow(requests(bits, window, hot), "bucket int, block int, asked array<binary>")
    told = asked.groupBy("bucket").applyInArrow(answers, "block int, bucket int, told array<binary>")
    by_block = rows.groupBy("block")
    ctx = by_block.cogroup(told.groupBy("block")).applyInArrow(open_contexts(bits, fine, window, hot), "bucket int, block int, ctx array<binary>")
    merged = ctx.groupBy("bucket").applyInArrow(merge_bucket(fine, window), "block int, bucket int, told array<binary>")
    both = told.withColumn("merged", F.lit(False)).unionByName(merged.withColumn("merged", F.lit(True)))
    out = by_block.cogroup(both.groupBy("block")).applyInArrow(cuts(bits, window, hot, pa.int64()), "k bigint, n_bytes bigint, n_removed bigint, spans array<struct<start:bigint,end:bigint>>, kept binary, sha string")
    return out.select(F.col("k").alias(id_col), "n_bytes", "n_removed", "spans", "kept", F.col("sha").alias("kept_sha256"))
