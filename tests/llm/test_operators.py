"""Each operator against a brute-force version, and on the odd cases: nulls, empty and long texts, ties, repeats, empty tables, clashing columns."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodeseek.llm import common as C
from lodeseek.llm import fm_index, licenses, lm_score, near_dedup, packing, quality, queries, suffix_dedup, toxicity
from lodeseek.llm.decontaminate import decontaminate
from lodeseek.llm.exact_dedup import exact_dedup
from lodeseek.llm.language import language_id

WORDS = ["the", "And", "über", "naïve", "cat", "dog", "runs", "x1", "of", "日本", "a-b", "end."]


def corpus():
    """Ids and texts: random texts, copies, near copies, shared passages, and the odd cases."""
    rng = random.Random(3)
    text = lambda n: " ".join(rng.choice(WORDS) + rng.choice(["", "", "s", "ing"]) for _ in range(n))
    rows = [text(rng.randrange(1, 120)) for _ in range(60)]
    passage = text(30)
    rows += [f"{text(20)} {passage} {text(15)}" for _ in range(8)]
    base = text(150).split()
    for _ in range(12):
        w = list(base)
        for _ in range(rng.randrange(0, 6)):
            w[rng.randrange(len(w))] = f"new{rng.randrange(99)}"
        rows.append(" ".join(w))
    rows += [rows[3], rows[3] + "  ", " " + rows[3].replace(" ", "\n"), None, None, "", " \t\n", "one", "ONE", "aaaa " * 200, "b" * 3000, text(4000)]
    ids = list(range(len(rows)))
    rng.shuffle(ids)
    return list(zip(ids, rows, strict=True))


ROWS = corpus()
CLASH = ["id", "k", "t", "block", "train", "result", "kept", "r0", "k0", "norm", "band", "unit", "n"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, *["x"] * len(CLASH)) for i, t in ROWS]
    return spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in CLASH)).repartition(5)


def words(t):
    return (t or "").encode().lower().split()


def test_word_kernels():
    texts = [t or "" for _, t in ROWS]
    data, offs = C.text_buffer(pa.array(texts))
    for sep, pattern in ((C.SPACE, rb"[^\x20\x09-\x0D]+"), (C.NOT_WORD, rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        h, s, e, first = C.word_hashes(data, offs, sep)
        low = C.LOWER[data].tobytes()
        got = [[low[a:b] for a, b in zip(s[i:j], e[i:j], strict=True)] for i, j in zip(first[:-1], first[1:], strict=True)]
        want = [re.findall(pattern, t.encode().lower()) for t in texts]
        assert got == want
        flat = [w for x in want for w in x]
        assert (C.hash_words(flat) == h).all()
        assert len(set(h.tolist())) == len(set(flat))


def test_arrow_slices_and_nulls():
    a = pa.array(["ab", None, "", "c"]).slice(1)
    data, offs = C.text_buffer(a)
    assert data.tobytes() == b"c" and offs.tolist() == [0, 0, 0, 1]
    assert [x for x in C.slices(np.array([0, 5, 5, 9, 30]), 9)] == [(0, 3), (3, 4)]


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(1000 + i, 1001 + i) for i in range(40)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    got = {r.node: r.comp for r in C.components(spark.createDataFrame(edges, "a long, b long"), spark).collect()}
    assert got == {x: find(x) for x in {y for a, b in edges if a != b for y in (a, b)}}


# 1


def test_lm_scores(docs, spark):
    train = C.fold(F.col("doc_id"), 7) != 2
    got = {r.doc_id: r for r in lm_score.lm_scores(docs, train, block_bytes=4000).collect()}
    count = [None] + [collections.Counter() for _ in range(3)]
    seqs = {i: ["<s>", *words(t), "</s>"] for i, t in ROWS}
    for i, w in seqs.items():
        if zlib.crc32(str(i).encode()) % 7 != 2:
            for o in (1, 2, 3):
                count[o].update(tuple(w[k : k + o]) for k in range(len(w) - o + 1))
    begins = count[1].pop(("<s>",))
    n, v = sum(count[1].values()), len(count[1])
    count[1][("<s>",)] = begins
    for i, w in seqs.items():
        base = score = known = 0
        for k in range(1, len(w)):
            p = (count[1][(w[k],)] + 1) / (n + v + 1)
            base += math.log10(p)
            known += count[1][(w[k],)] > 0
            for o in (2, 3):
                if k >= o - 1:
                    m, h = lm_score.PRIORS[o], count[o - 1][tuple(w[k - o + 1 : k])]
                    p = (count[o][tuple(w[k - o + 1 : k + 1])] + m * p) / (h + m)
            score += math.log10(p)
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (zlib.crc32(str(i).encode()) % 7 == 2, len(w) - 1, known, n)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and math.isclose(r.score, score, rel_tol=1e-9)


def test_lm_empty(docs):
    assert lm_score.lm_scores(docs.limit(0), F.lit(True)).count() == 0
    r = lm_score.lm_scores(docs.where("doc_id < 3"), F.lit(False)).collect()
    assert len(r) == 3 and all(x.train_tokens == 0 and x.n_known == 0 for x in r)


# 2


def test_fm_index():
    rng = np.random.default_rng(1)
    for n in (1, 5, 300):
        seq = np.concatenate([[0], rng.integers(0, 4, n), [0]])
        index = fm_index.FMIndex(seq, 4, sample=7)
        phrases = [tuple(p) for k in (1, 2, 3, 5) for p in rng.integers(1, 4, (20, k)).tolist()]
        rows = np.zeros((len(phrases), 5), np.int64)
        for i, p in enumerate(phrases):
            rows[i, : len(p)] = p
        lo, hi = index.search(rows, np.array([len(p) for p in phrases]))
        for p, a, b in zip(phrases, lo, hi, strict=True):
            want = [i for i in range(len(seq)) if tuple(seq[i : i + len(p)]) == p]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_decontaminate(docs, spark, monkeypatch):
    from lodeseek.llm import decontaminate as mod

    pattern = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    split = lambda t: pattern.findall((t or "").encode().lower())
    base = dict(ROWS)
    long = " ".join(w.decode() for w in split(max((t or "" for t in base.values()), key=len))[50:75])
    items = [(7, long), (70, long.upper()), (8, "one"), (9, None), (10, ""), (11, "not in any text at all, never"), (12, "cat the")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    windows = collections.defaultdict(set)
    for i, t in items:
        w = split(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[k : k + 10])].add(str(i))
    for part_bytes in (32 << 20, 60):
        monkeypatch.setattr(mod, "PART_BYTES", part_bytes)
        got = {r.doc_id: r.result for r in decontaminate(docs, bench).collect()}
        for i, t in ROWS:
            w = split(t)
            hit, found = set(), set()
            for win, names in windows.items():
                for k in range(len(w) - len(win) + 1):
                    if tuple(w[k : k + len(win)]) == win:
                        hit.update(range(k, k + len(win)))
                        found |= names
            r = got[i]
            assert (r.n_words, r.n_hit, r["items"]) == (len(w), len(hit), sorted(found))
            raw = (t or "").encode()
            assert sum(len(pattern.findall(raw[s.start : s.end].lower())) for s in r.spans) == len(hit)
    assert decontaminate(docs, bench.limit(0)).where("result.n_hit > 0").count() == 0
    assert decontaminate(docs.limit(0), bench).count() == 0


# 3, 5


def judged(spark, label):
    rng = random.Random(9)
    plain = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(400):
        w = [rng.choice(plain) for _ in range(rng.randrange(20, 80))]
        y = rng.random() < (0.4 if label == "toxic" else 0.6)
        if label == "toxic" and y:
            at = rng.randrange(len(w))
            w[at:at] = [rng.choice(["vile", "scorn", "hate"]) for _ in range(3)]
        if label == "quality" and not y:
            w = [x + "!!" for x in w]
        rows.append((i, " ".join(w)))
        labels.append((i, int(y)))
    rows += [(400, None), (401, ""), (402, "x" * 100_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("result", F.lit(1)).withColumn("t", F.lit("z"))
    return docs, spark.createDataFrame([*labels, (0, None), (None, 1), (999, 1)], f"doc_id long, {label} int"), dict(labels)


@pytest.mark.parametrize(("label", "scores", "least"), [("toxic", toxicity.toxicity_scores, 0.5), ("quality", quality.quality_scores, 0.3)])
def test_classifiers(label, scores, least, spark):
    docs, labels, truth = judged(spark, label)
    got = {r.doc_id: r.result for r in scores(docs, labels).collect()}
    assert len(got) == 403 and all(0 <= r.score <= 1 for r in got.values())
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(got[i].score >= least) == bool(truth[i]) for i in held]) >= 0.95
    if label == "toxic":
        toxic = next(i for i in held if truth[i])
        text = docs.where(F.col("doc_id") == toxic).first().text
        assert any(w in text[s.start : s.end] for s in got[toxic].passages for w in ("vile", "scorn", "hate"))
        assert all(not got[i].passages for i in held if not truth[i])
    swapped = scores(docs, labels.withColumn(label, F.when(C.fold(F.col("doc_id"), 5) == 0, 1 - F.col(label)).otherwise(F.col(label))))
    assert {r.doc_id: round(r.result.score, 9) for r in swapped.collect()} == {i: round(r.score, 9) for i, r in got.items()}  # held-out labels are not used
    assert {r.result.score for r in scores(docs, labels.limit(0)).collect()} == {0.5}
    assert scores(docs.limit(0), labels).count() == 0


def test_segments():
    rng = random.Random(2)
    for _ in range(200):
        s = np.array([rng.choice([-3, -2, -1, 1, 2, 3]) for _ in range(rng.randrange(1, 12))], float)

        def maximal(lo, hi, s=s):
            """By definition: the best segment, then the same on both sides of it."""
            best = max(((s[a:b].sum(), -(b - a), -a, a, b) for a in range(lo, hi) for b in range(a + 1, hi + 1)), default=None)
            if best is None or best[0] <= 0:
                return []
            a, b = best[3], best[4]
            return [*maximal(lo, a), (a, b, best[0]), *maximal(b, hi)]

        got = toxicity.segments(s)
        assert sorted(x[2] for x in got) == sorted(x[2] for x in maximal(0, len(s)))
        assert all(a2 >= b1 for (_, b1, _), (a2, _, _) in zip(got, got[1:], strict=False))


def test_network_gradients():
    net = quality.ByteNet()
    data = np.frombuffer(b"Hello, World! ABABAB" * 20 + b"xy" * 90, np.uint8)
    offs = np.array([0, 400, 400, 580])
    y, w = np.array([1.0, 0.0, 1.0]), np.array([1.0, 2.0, 0.5])

    def loss():
        p = net.score(data, offs, net.tables())
        return float(-(w * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum() / 3)

    net.out += np.float32(0.3)
    for p, g in zip(net.params(), net.gradients(data, offs, y, w), strict=True):
        k = np.unravel_index(np.abs(g).argmax(), g.shape)
        kept, eps = p[k], np.float32(1e-2)
        p[k] = kept + eps
        up = loss()
        p[k] = kept - eps
        down = loss()
        p[k] = kept
        assert math.isclose((up - down) / (2 * eps), g[k], rel_tol=0.15, abs_tol=2e-3)


# 4


def shingles(t, n):
    w = words(t)
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


@pytest.mark.parametrize(("size", "bucket", "block"), [(2, 512, 512), (5, 512, 512), (2, 3, 4)])
def test_near_dedup(size, bucket, block, docs, monkeypatch):
    for name, value in (("BUCKET", bucket), ("BLOCK", block), ("HUBS", 2), ("CHUNK", 2)):
        monkeypatch.setattr(near_dedup, name, value)
    got = {r.doc_id: r for r in near_dedup.near_dedup(docs, shingle=size).collect()}
    sets = {i: shingles(t, size) for i, t in ROWS}
    comp = {i: i for i in sets}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                comp[max(find(a), find(b))] = min(find(a), find(b))
    for i in ids:
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (len(sets[i]), find(i), find(i) == i)
    assert near_dedup.near_dedup(docs.limit(0)).count() == 0


def test_sketches():
    rng = np.random.default_rng(4)
    a = rng.integers(0, 2**63, 4000, dtype=np.uint64)
    for j in (0.6, 0.8, 0.95):
        k = int(2000 * 2 * j / (1 + j))
        one, two = np.unique(a[:2000]), np.unique(np.concatenate([a[:k], a[2000 : 4000 - k]]))
        sk = near_dedup.odd_sketches(np.stack([near_dedup.min_hash(one), near_dedup.min_hash(two)]))
        bits = int(np.unpackbits(sk[0] ^ sk[1]).sum())
        assert abs(near_dedup.sketch_similarity(bits) - j) < 0.2
        assert j < 0.8 or bits <= near_dedup.SKETCH_FAR[0.8]


# 6


def test_license_scan(spark):
    filler = " ".join(random.Random(1).choice(WORDS) for _ in range(200))
    rows = [(0, f"{filler}\nReleased under the MIT License.\n{filler}"), (1, "Licensed under the Apache License, Version 2.0."), (2, filler), (3, None), (4, ""), (5, f"{filler} This work is licensed under the GNU General Public License, version 3. {filler}"), (6, "Licensed under CC BY-NC 4.0.\nThe MIT License")]
    got = {r.doc_id: r for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: r.families for i, r in got.items()} == {0: ["mit"], 1: ["apache"], 2: [], 3: [], 4: [], 5: ["gpl"], 6: ["cc-by-nc", "mit"]}
    f = got[0].findings[0]
    assert "MIT License" in rows[0][1].encode()[f.start : f.end].decode()
    assert licenses.license_scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# 7


@pytest.mark.parametrize("block_bytes", [1 << 22, 6000])
def test_suffix_dedup(block_bytes, docs):
    got = {r.doc_id: r for r in suffix_dedup.suffix_dedup(docs, block_bytes=block_bytes).collect()}
    seen = {}
    for i, t in sorted(ROWS):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if seen.setdefault(b[p : p + 50], i) < i:
                gone[p : p + 50] = b"\1" * 50
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for j in range(len(b)) if gone[j] and (not j or not gone[j - 1]))
        r = got[i]
        assert (r.n_bytes, r.n_removed, len(r.spans), r.kept, r.kept_sha256) == (len(b), len(b) - len(kept), spans, kept, hashlib.sha256(kept).hexdigest())
    assert suffix_dedup.suffix_dedup(docs.limit(0)).count() == 0


def removed(rows, window=50):
    """Bytes that go, by id, from a dictionary of all windows."""
    seen, out = {}, {}
    for i, t in sorted(rows):
        b = t.encode()
        gone = bytearray(len(b))
        for p in range(len(b) - window + 1):
            if seen.setdefault(b[p : p + window], i) < i:
                gone[p : p + window] = b"\1" * window
        out[i] = sum(gone)
    return out


def hot_line_rows(n=1500):
    """Different texts that hold one line, some of them also parts of their neighbours."""
    rng = random.Random(12)
    noise = lambda k: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(k))
    line = "all rights reserved by the holders named below, see the notice that comes with this text"
    rows = []
    for i in range(n):
        before, after = noise(rng.randrange(0, 120)), noise(rng.randrange(0, 120))
        if rows and i % 5 == 0:
            after = rows[rng.randrange(len(rows))][1][-60:] + after
        if rows and i % 7 == 0:
            before = rows[rng.randrange(len(rows))][1][:70]
        rows.append((i, before + line + after))
    return rows


def test_hot_line_is_split():
    """A line between different texts: its contexts are dealt over all buckets."""
    rows = hot_line_rows()
    data, offs = C.text_buffer(pa.array([t for _, t in rows]))
    table = pa.table({"k": pa.array([i for i, _ in rows]), "t": pa.array([t for _, t in rows])})

    def contexts(hot):
        key, ctx, *_ = suffix_dedup.runs(data, offs, 50, hot)
        key = np.unique(np.stack([key, ctx]), axis=1)[0]
        return np.unique(key, return_counts=True)[1].max(), np.bincount((key >> np.uint64(58)).astype(int), minlength=64)

    deal = suffix_dedup.C.undeal
    try:
        suffix_dedup.C.undeal = lambda t, by: t
        found = suffix_dedup.hot_keys(50)(table).to_pydict()
    finally:
        suffix_dedup.C.undeal = deal
    keys = [np.array([k for k, v in zip(found["key"], found["level"], strict=True) if v == n], np.int64).view(np.uint64) for n in (0, 1)]
    assert len(keys[0]) and len(keys[1])
    most, per = contexts(None)
    assert most >= 1000 and per.max() > 5 * np.median(per)
    most, per = contexts(suffix_dedup.Hot(*keys, bits=8))
    assert most < 200 and per.max() < 5 * np.median(per)


@pytest.mark.parametrize("block_bytes", [1 << 22, 40_000])
def test_hot_line_results(block_bytes, spark):
    rows = hot_line_rows()
    got = suffix_dedup.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), block_bytes=block_bytes)
    assert {r.doc_id: r.n_removed for r in got.select("doc_id", "n_removed").collect()} == removed(rows)


def test_merged_transforms():
    rng = np.random.default_rng(6)
    for symbols in (2, 256):
        texts = [rng.integers(0, symbols, rng.integers(3, 40)).astype(np.uint8) for _ in range(12)]
        parts = [(np.concatenate(texts[k::3]), np.array([len(t) for t in texts[k::3]]), np.arange(12)[k::3]) for k in range(3)]
        flags = suffix_dedup.repeated(5, parts)
        for k, own in enumerate(flags):
            at = 0
            for n, t in zip(range(k, 12, 3), texts[k::3], strict=True):
                for p in range(len(t)):
                    w = t[p : p + 5].tobytes()
                    assert own[at + p] == (len(w) == 5 and any(w in texts[m].tobytes() for m in range(n)))
                at += len(t)


def test_long_text_pieces(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE", 1000)
    rng = random.Random(8)
    long = "".join(rng.choice("abcdef ") for _ in range(9000))
    rows = [(0, long), (1, long[2500:7000] + "tail"), (2, "x" + long)]
    got = {r.doc_id: r.n_removed for r in suffix_dedup.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: 0, 1: 4500, 2: 9000}


# 8


def test_optimal_buckets():
    rng = random.Random(4)
    for _ in range(60):
        sizes = rng.sample(range(0, 40), rng.randrange(1, 9))
        counts = [rng.randrange(1, 6) for _ in sizes]
        for k in (1, 2, 3, 20):
            bounds, waste = packing.optimal_buckets(sizes, counts, k)

            def cost(b, sizes=sizes, counts=counts):
                return sum(c * (min(x for x in b if x >= s) - s) for s, c in zip(sizes, counts, strict=True))

            import itertools

            best = min(cost(b) for r in range(1, k + 1) for b in itertools.combinations(sorted(sizes), min(r, len(sizes))) if max(b) == max(sizes))
            assert cost(bounds) == waste == best and len(bounds) <= k
    assert packing.optimal_buckets([], [], 3) == ([], 0)


def test_packing(docs):
    got = packing.packing(docs, buckets=4, budget=300).collect()
    assert sorted(r.doc_id for r in got) == sorted(i for i, _ in ROWS)
    size = {i: len(words(t)) for i, t in ROWS}
    batches = collections.defaultdict(list)
    for r in got:
        assert r.n_tokens == size[r.doc_id] <= r.bucket_tokens
        batches[r.bucket, r.batch_id].append(r)
    for (bucket, n), rows in batches.items():
        most = max(1, 300 // max(1, rows[0].bucket_tokens))
        assert sorted(r.slot for r in rows) == list(range(len(rows))) and len(rows) <= most
        assert len(rows) == most or (bucket, n + 1) not in batches
    assert packing.packing(docs.limit(0)).count() == 0


def test_packing_with_a_tokenizer(spark):
    public = pytest.importorskip("public_tokenizers")
    df = spark.createDataFrame([(0, "hello world"), (1, None)], "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in packing.packing(df, tokenizer=public.path("byte_bpe_50k.json")).collect()}
    assert got == {0: 2, 1: 0}


# 9


def test_exact_dedup(docs):
    norm = lambda t: re.sub("[\x20\x09-\x0d]", "", t or "")
    groups = collections.defaultdict(list)
    for i, t in ROWS:
        groups[norm(t)].append((-len(t or ""), i))
    for bits in (1 << 22, 64):
        got = {r.doc_id: r for r in exact_dedup(docs, digests=True, most_bits=bits).collect()}
        plain = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup(docs, most_bits=bits).collect()}
        assert plain == {i: (r.keep_id, r.group_size, r.kept) for i, r in got.items()}
        for i, t in ROWS:
            g = groups[norm(t)]
            keep = min(g)[1]
            assert (got[i].keep_id, got[i].group_size, got[i].kept, got[i].text_sha256) == (keep, len(g), keep == i, hashlib.sha256(norm(t).encode()).hexdigest())
    assert {(r.doc_id, r.keep_id) for r in exact_dedup(docs).collect()} == {(i, r.keep_id) for i, r in got.items()}
    assert exact_dedup(docs.limit(0)).count() == 0


def test_exact_dedup_repeated_and_null_ids(spark):
    rows = [(1, "a"), (1, "a"), (None, "a"), (None, "b"), (2, "b ")]
    got = exact_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept) for r in got) == [("1", "1", 3, True), ("1", "1", 3, True), ("2", "2", 2, True), ("None", "1", 3, False), ("None", "2", 2, False)]


# 10


def test_language_id(spark, data):
    docs, pages = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/pages.parquet")
    odd = spark.createDataFrame([(10_000, None, None), (10_001, "", ""), (10_002, "not a url", "<p>"), (10_003, "https://www.example.fr/x", None)], pages.schema)
    got = {r.page_id: r for r in language_id(pages.unionByName(odd), docs).collect()}
    truth = {r.page_id: re.search('<html lang="(..)"', r.html)[1] for r in pages.collect()}
    assert np.mean([got[i].language == k for i, k in truth.items()]) >= 0.98
    assert np.mean([got[i].text_language == k for i, k in truth.items()]) >= 0.9
    assert all(i in got and 0 < got[i].probability <= 1 for i in range(10_000, 10_004)) and got[10_003].suffix_language == "fr"
    silent = pages.withColumn("html", F.regexp_replace("html", '<html lang="..">', "<html>")).withColumn("url", F.lit("http://a.example.com/"))
    assert np.mean([r.language == truth[r.page_id] for r in language_id(silent, docs).collect()]) >= 0.9
    assert language_id(pages.limit(0), docs).count() == 0


# All


def test_queries_match_sql(spark, data):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    for name, sql in queries.ORACLE.items():
        df = queries.QUERIES[name](spark, data)
        want = c.sql(sql)
        assert sorted(want.columns) == sorted(df.columns)
        assert sorted(map(repr, want.select(", ".join(df.columns)).fetchall())) == sorted(repr(tuple(r)) for r in df.collect())


def test_first_columns(spark, data):
    want = {
        "op1_lm_score": "doc_id held_out n_tokens n_known train_tokens base_score score",
        "op3_toxicity": "doc_id held_out score predicted",
        "op4_near_dedup": "doc_id n_shingles component_id kept",
        "op5_quality": "doc_id held_out score predicted",
        "op7_suffix_dedup": "doc_id n_bytes n_removed n_spans kept_sha256",
    }
    for name, cols in want.items():
        assert queries.QUERIES[name](spark, data).columns == cols.split()


def test_automaton_states():
    """States, arcs and failure arcs against dictionaries, on a small alphabet, in lanes of any length."""
    rng = np.random.default_rng(3)
    texts = [rng.integers(1, 5, n).tolist() for n in (0, 1, 7, 60, 3)]
    train = [0, 2, 3]
    seq = np.concatenate([[0, *t, 5] for t in texts])
    at = np.concatenate([[0], np.cumsum([len(t) + 2 for t in texts])])
    gram = [collections.Counter() for _ in range(3)]
    for k in train:
        w = [0, *texts[k], 5]
        for o in (1, 2, 3):
            gram[o - 1].update(tuple(w[i : i + o]) for i in range(len(w) - o + 1))
    names, ids, counts = [], [], []
    for o in (1, 2, 3):
        at_place = {p: tuple(seq[p - o + 1 : p + 1].tolist()) for a, b in zip(at[:-1], at[1:], strict=True) for p in range(a + o - 1, b)}
        names.append(sorted(set(at_place.values())))
        ids.append(np.array([names[-1].index(at_place[p]) if p in at_place else -1 for p in range(len(seq))]))
        counts.append(np.array([gram[o - 1][g] for g in names[-1]], float))
    m = {2: 3.0, 3: 0.5}
    auto = lm_score.Automaton(ids, counts, 50, 5, m)
    state = {(): 0} | {g: int(auto.base[o]) + i for o in (0, 1) for i, g in enumerate(names[o])}
    live = {h for h, s in state.items() if not h or gram[len(h) - 1][h]}

    def prob(w, h):
        if not h:
            return (gram[0][(w,)] + 1) / 56
        k = m[len(h) + 1]
        return (gram[len(h)][(*h, w)] + k * prob(w, h[1:])) / (gram[len(h) - 1][h] + k)

    arcs = {divmod(int(x), auto.symbols): (w, t) for x, w, t in zip(auto.keys, auto.weight, auto.to, strict=True)}
    want = {}
    for o in (1, 2):
        for g, c in gram[o].items():
            if c and g in names[o]:
                to = next(g[i:] for i in range(max(0, len(g) - 2), len(g) + 1) if g[i:] in live)
                want[state[g[:-1]], names[0].index(g[-1:])] = (math.log10(prob(g[-1], g[:-1])), state[to])
    assert arcs.keys() == want.keys() and all(math.isclose(arcs[k][0], want[k][0]) and arcs[k][1] == want[k][1] for k in want)
    for h in live - {()}:
        assert auto.fail[state[h]] == state[h[1:]] and math.isclose(auto.loss[state[h]], math.log10(m[len(h) + 1] / (gram[len(h) - 1][h] + m[len(h) + 1])))
    full = auto.read(ids[0], at, names[0].index((0,)))
    for a, b in zip(at[:-1], at[1:], strict=True):
        for p in range(a + 1, b):
            assert math.isclose(full[p], math.log10(prob(int(seq[p]), tuple(seq[max(a, p - 2) : p].tolist()))), rel_tol=1e-9)


def test_automaton_lanes(monkeypatch, docs):
    """Pieces of long texts give the scores of whole ones."""
    train = C.fold(F.col("doc_id"), 7) != 2
    whole = {r.doc_id: r.score for r in lm_score.lm_scores(docs, train).collect()}
    seq = np.array([0, *[1, 2, 1, 1, 3, 2, 1, 4] * 40, 5])
    ids = [seq] + [np.full(len(seq), -1) for _ in range(2)]
    counts = [np.bincount(seq).astype(float)]
    for o in (1, 2):
        keys, inverse = np.unique(np.stack([seq[i : len(seq) - o + i] for i in range(o + 1)]), axis=1, return_inverse=True)
        ids[o][o:] = inverse
        counts.append(np.bincount(inverse).astype(float))
    auto = lm_score.Automaton(ids, counts, 300, 5, lm_score.PRIORS)
    want = auto.read(seq, np.array([0, len(seq)]), 0)
    for lane in (3, 7, 100):
        monkeypatch.setattr(lm_score, "LANE", lane)
        assert np.allclose(auto.read(seq, np.array([0, len(seq)]), 0), want)
    assert len(whole) == len(ROWS)
