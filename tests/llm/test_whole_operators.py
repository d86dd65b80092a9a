"""Cases where an operator did less than the whole job."""

import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodeseek.llm import common as C
from lodeseek.llm import language as L
from lodeseek.llm import licenses, quality, toxicity
from lodeseek.llm.language import language_id


def test_wrapped_and_double_licences(spark):
    """Notices over several lines, and several families in one window."""
    filler = " ".join(random.Random(1).choice(["the", "cat", "runs", "of", "day"]) for _ in range(60))
    rows = [
        ("This work is licensed under the GNU\nGeneral Public License, version 3", ["gpl"]),
        (f"{filler}\nReleased under the\nMIT License\n{filler}", ["mit"]),
        ("Licensed under the MIT license or the Apache License, Version 2.0", ["apache", "mit"]),
        (f"{filler}\n\n# licensed under the GNU Lesser\n# General Public License\n\n{filler} Licensed under CC BY-NC 4.0.", ["cc-by-nc", "lgpl"]),
        ("GNU Lesser General Public License as published by the Free Software Foundation", ["lgpl"]),
        ("licensed under the GNU General Public License", []),
        ("Released under the\n \nMIT License", []),
        (f"{filler}\n{filler}", []),
    ]
    got = licenses.license_scan(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")).collect()
    assert {r.doc_id: r.families for r in got} == {i: f for i, (_, f) in enumerate(rows)}
    both = next(r for r in got if r.doc_id == 2).findings
    assert [rows[2][0][f.start : f.end] for f in both if f.confirmed] == ["Licensed under the MIT license", "the Apache License, Version 2.0"]


def test_all_languages(spark):
    """Over 64 languages in the documents, and languages that only pages name."""
    codes = [a + b for a in "abcdefghi" for b in "klmnopqrst"][:70]
    docs = spark.createDataFrame([(f"{k}zz{k} " * 40 + str(j), k) for n, k in enumerate(codes) for j in range(75 - n)] + [("z" * 20_000, "xy")], "text string, lang string")
    page = lambda k, body: f'<html lang="{k}"><p>{body}'
    rows = [(0, "http://h0.com/", page("", f"{codes[69]}zz{codes[69]} " * 30)), (1, "http://h1.com/", page("ja", "日本語のページ " * 30)), (2, "http://h2.com/", page("xy", "qqww vvyy " * 30)), (3, "http://h3.it/", "<p>")]
    got = {r.page_id: r for r in language_id(spark.createDataFrame(rows, "page_id long, url string, html string"), docs).collect()}
    assert [got[i].language for i in range(4)] == [codes[69], "ja", "xy", "it"]
    alone = language_id(spark.createDataFrame(rows[1:3], "page_id long, url string, html string"), docs.limit(0)).collect()
    assert {r.page_id: r.language for r in alone} == {1: "ja", 2: "xy"}


def test_quality_score_alone_and_in_a_batch():
    """What follows a text in its slice does not count."""
    net = quality.ByteNet()
    net.out += np.float32(0.3)
    texts = [b"", b"\xff\xfe~~~", b"", b"abc", b"", b"zzzzzz" * 50, b"", b"q" * 128, b"~~~~~"]
    score = lambda t: net.score(np.frombuffer(b"".join(t), np.uint8), np.cumsum([0, *map(len, t)]), net.tables())
    for _ in range(2):
        assert np.allclose(score(texts), [score([t])[0] for t in texts], rtol=1e-6, atol=0)
        texts.reverse()


def test_long_labelled_texts_train(spark):
    """Texts longer than the bound of a training text are sampled over their whole length, and one text stands for an id."""
    long = "start " + "filler " * 9000 + "last"
    docs = spark.createDataFrame([(1, long), (1, "b" + long), (2, "short"), (3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "doc_id long, toxic int")
    texts, y, folds, share = C.labelled_sample(docs, labels, "toxic", 10, 4096)
    got = dict(zip(texts, y.tolist(), strict=True))
    assert got.get("short", 0) == got.get("", 0) == 0 and all(f != 0 for f in folds)
    for t, k in got.items():
        if k == 1:
            assert len(t.encode()) <= 4096 and (t.startswith("start") or t.startswith("bstart")) and t.endswith("last") and t.count("\n") == C.PASSAGES - 1


def test_toxicity_against_a_plain_scorer():
    """Word by word: the longest kept prefix's log-odds, all segments by definition, and the logistic function of their statistics."""
    rng = random.Random(4)
    plain, bad = [f"word{i}" for i in range(60)], ["scornful", "scornfully", "hateful", "vile"]
    texts, y = [], []
    for i in range(240):
        w = [rng.choice(plain) for _ in range(rng.randrange(5, 25))]
        if i % 3 == 0:
            w[3:3] = [rng.choice(bad) for _ in range(3)]
        texts.append(" ".join(w))
        y.append(float(i % 3 == 0))
    m = toxicity.train(texts, np.array(y), np.array([1 + i % 4 for i in range(240)]), 0.3)
    delta = dict(zip(m.words.tolist(), m.delta.tolist(), strict=True))

    def word_score(w):
        for k, size in enumerate(toxicity.LEVELS):
            if k and len(w) <= size:
                continue
            h = (int(C.hash_words([w[:size]])[0]) + k) % 2**64
            if h in delta:
                return delta[h] - toxicity.DRIFT
        return -toxicity.DRIFT

    def maximal(s, lo, hi):
        best = max(((sum(s[a:b]), -(b - a), -a, a, b) for a in range(lo, hi) for b in range(a + 1, hi + 1)), default=None)
        if best is None or best[0] <= 1e-12:
            return []
        a, b = best[3], best[4]
        return [*maximal(s, lo, a), (a, b, best[0]), *maximal(s, b, hi)]

    asked = [*texts[:25], "", "vile", "VILE hateful scornfulness", "word1 word2", "é vile ü"]
    data, offs = C.text_buffer(pa.array(asked))
    feat, passages = m.features(data, offs)[2:]
    got = C.sigmoid(feat @ m.weights[:-1] + m.weights[-1])
    for t, g, found in zip(asked, got, passages, strict=True):
        words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.encode().lower())
        seg = maximal([word_score(w) for w in words], 0, len(words))
        logs = []
        for _, _, s in seg:
            x = m.log_k + math.log(len(words)) - m.lam * s
            logs.append(-math.log10(max(-math.expm1(-math.exp(min(x, 700))) if x >= -30 else math.exp(x), 1e-300)))
        sig = [k for k, v in enumerate(logs) if v >= -math.log10(toxicity.P_MAX)]
        f = [min(max(logs), 30), math.log1p(sum(min(logs[k], 30) for k in sig)), sum(seg[k][1] - seg[k][0] for k in sig) / len(words)] if seg else [0, 0, 0]
        assert math.isclose(g, 1 / (1 + math.exp(-(sum(a * b for a, b in zip(f, m.weights[:-1], strict=True)) + m.weights[-1]))), rel_tol=1e-6)
        assert sorted(p["score"] for p in found) == pytest.approx(sorted(seg[k][2] for k in sig))


def test_network_against_a_direct_convolution():
    net = quality.ByteNet()
    rng = np.random.default_rng(1)
    net.out += rng.normal(0, 0.3, net.out.shape).astype(np.float32)
    net.bias += rng.normal(0, 0.3, net.bias.shape).astype(np.float32)
    texts = [b"", b"a", b"some words here", bytes(rng.integers(0, 256, 700).astype(np.uint8)), b"x" * 129, b"ab" * 64, b"z" * 5]
    got = net.score(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]), net.tables())
    for t, g in zip(texts, got, strict=True):
        x = net.emb[np.frombuffer(t + b"\0" * 2 * quality.WIDTH, np.uint8)].astype(np.float64)
        pooled = []
        for chunk in range(max(1, -(-len(t) // quality.STRIDE))):
            best = np.full(quality.FILTERS, -np.inf)
            # The last chunk goes on to the response that reads zeros only.
            stop = len(t) + 1 if chunk == max(1, -(-len(t) // quality.STRIDE)) - 1 else (chunk + 1) * quality.STRIDE
            for p in range(chunk * quality.STRIDE, stop):
                best = np.maximum(best, sum(x[p + w] @ net.taps[w] for w in range(quality.WIDTH)))
            pooled.append(np.maximum(best + net.bias, 0))
        f = np.concatenate([np.mean(pooled, axis=0), np.max(pooled, axis=0)])
        assert math.isclose(g, 1 / (1 + math.exp(-(f @ net.out + net.const[0]))), rel_tol=1e-4), t[:10]


def test_language_against_a_plain_fusion(spark):
    """All four kinds of evidence by loops over pages."""
    words = {"aa": "alpha beta gamma", "bb": "delta omega sigma", "cc": "kappa theta zeta"}
    rng = random.Random(6)
    text = lambda k, n: " ".join(rng.choice(words[k].split()) for _ in range(n))
    train = [(text(k, 30), k) for k in words for _ in range(6)]
    pages = [(i, f"http://{h}.example.{s}/x", f'<html lang="{said}"><p>{text(k, n)}</p>') for i, (h, s, said, k, n) in enumerate([(rng.choice(["a", "b", "www"]), rng.choice(["de", "com", "fr"]), rng.choice(["aa", "bb", "cc", ""]), rng.choice("abc") * 2, rng.choice([0, 1, 3, 40])) for _ in range(60)])]
    pages += [(60, None, None), (60, None, None), (61, "", f'<meta content="bb" http-equiv="content-language">{text("aa", 2)}'), (62, "no url", "x" * 100_000)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("host", F.lit("h")).withColumn("l", F.lit(1)).withColumn("prior", F.lit(2))
    got = L.language_id(df, spark.createDataFrame(train, "text string, lang string")).collect()
    names0, table = L.train([t for t, _ in sorted(train, key=lambda x: x[1])], sorted(k for _, k in train))
    rows = []
    for i, url, html in pages:
        cells = L.trigram_cells(np.frombuffer(L.page_text(html or ""), np.uint8))
        m = L.MARKUP.search((html or "").encode())
        said = (m[1] or m[2] or m[3]).decode().lower() if m else ""
        host = re.match(r"\w+://([^/]+)", url or "")
        host = host[1] if host else ""
        rows.append((i, host, said, L.SUFFIX_LANGUAGE.get(host.split(".")[-1], ""), {k: L.TEMPER * float(table[names0.index(k), cells].sum(dtype=np.float64)) for k in names0}, -L.TEMPER * len(cells) * math.log(L.CELLS)))
    names = sorted(set(names0) | {x for r in rows for x in r[2:4] if x})

    def norm(v):
        s = sum(v)
        return [x / s for x in v] if s > 0 else [1 / len(v)] * len(v)

    text_p = []
    for r in rows:
        like = [r[4].get(k, r[5] if k in r[2:4] else min(r[5], *r[4].values())) for k in names]
        text_p.append(norm([math.exp(x - max(like)) for x in like]))

    def trust(at):
        own = [p[names.index(r[at])] for r, p in zip(rows, text_p, strict=True) if r[at] in names]
        return (sum(own) + 9) / (len(own) + 10)

    t = {at: trust(at) for at in (2, 3)}

    def fused(r, p, prior=None):
        v = list(p)
        for at in (2, 3):
            if r[at] in names:
                v = [x * (t[at] if k == r[at] else (1 - t[at]) / (len(names) - 1)) for x, k in zip(v, names, strict=True)]
        return norm([x * y for x, y in zip(v, prior, strict=True)] if prior else v)

    first = [fused(r, p) for r, p in zip(rows, text_p, strict=True)]
    domain = lambda h: ".".join(h.split(".")[::-1][:2])
    add = lambda use: [sum(f[k] for r, f in zip(rows, first, strict=True) if use(r[1])) for k in range(len(names))]
    level = lambda n, above: [(x + L.LEVEL_WEIGHT * a) / (sum(n) + L.LEVEL_WEIGHT) for x, a in zip(n, above, strict=True)]
    world = level(add(lambda h: True), [1 / len(names)] * len(names))
    want = []
    for r, p in zip(rows, text_p, strict=True):
        prior = level(add(lambda h, r=r: h == r[1]), level(add(lambda h, r=r: domain(h) == domain(r[1])), world))
        post = fused(r, p, prior)
        want.append((r[0], names[post.index(max(post))], round(max(post), 6), r[2], r[1]))
    assert sorted((g.page_id, g.language, round(g.probability, 6), g.declared, g.host) for g in got) == sorted(want)


def test_licence_families_and_others(spark):
    """Paragraphs of several lines, short identifiers, licences that are no family, shared passages; and a plain classifier."""
    from lodeseek.llm.licence_texts import HELD_OUT, NOTICES, OTHERS

    rng = random.Random(2)
    filler = lambda n: " ".join(rng.choice("the cat runs of day with some river stone and house".split()) for _ in range(n))
    wrap = lambda t: "\n".join(" ".join(t.split()[i : i + 9]) for i in range(0, len(t.split()), 9))
    full = {"mit": NOTICES["mit"][4:], "bsd": NOTICES["bsd"][6:], "gpl": NOTICES["gpl"][8:], "lgpl": NOTICES["lgpl"][5:], "apache": NOTICES["apache"][5:]}
    rows = [(f"{filler(80)}\n\n{wrap(' '.join(t))}\n\n{filler(40)}", [k]) for k, t in full.items()]
    rows += [(f"# SPDX-License-Identifier: {x}", [k]) for x, k in (("MIT", "mit"), ("Apache-2.0", "apache"), ("GPL-3.0-or-later", "gpl"), ("BSD-3-Clause", "bsd"))]
    rows += [(wrap(NOTICES["mit"][-2] + " " + NOTICES["mit"][-1]), ["mit"]), (wrap(NOTICES["bsd"][8]), ["bsd"])]
    rows += [(f"{filler(50)}\n\n{wrap(' '.join(t))}", []) for t in [*OTHERS.values(), *HELD_OUT.values()]]
    rows += [("Boost Software License", []), (filler(300), []), ("x" * 70_000, []), ("Released under the MIT License. " * 3000, ["mit"])]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)] + [(0, "The MIT License")], "doc_id long, text string").withColumn("families", F.lit(1)).withColumn("findings", F.lit(2))
    got = licenses.license_scan(df).collect()
    assert sorted((r.doc_id, r.families) for r in got) == sorted([(i, k) for i, (_, k) in enumerate(rows)] + [(0, ["mit"])])
    assert all(f.probability <= 1 and f.start < f.end for r in got for f in r.findings)
    m = licenses.train([filler(400) for _ in range(30)])
    known = {int(g): i for i, g in enumerate(m.grams)}
    for t in ["Released under the MIT License", filler(40), NOTICES["bsd"][8], "word"]:
        h = licenses.hashes(t)
        grams = [int(C.join_hash(C.join_hash(h[i : i + 1], h[i + 1 : i + 2]), h[i + 2 : i + 3])[0] if n == 3 else C.join_hash(h[i : i + 1], h[i + 1 : i + 2])[0] if n == 2 else h[i]) for n in (1, 2, 3) for i in range(len(h) - n + 1)]
        z = sum(m.weights[known.get(g, len(m.grams))] for g in grams) / len(grams) + m.weights[-1]
        assert np.allclose(licenses.softmax(z[None])[0], licenses.softmax(m.logits(h, np.array([0, len(h)])))[0], atol=1e-9)


def test_op7_merges_by_several_symbols_a_round():
    """Fewer rounds than the window has bytes, and the windows of a brute force, for any length of the window."""
    import numpy as np

    from lodeseek.llm import suffix_dedup as S

    rng = np.random.default_rng(5)
    for window in (1, 2, 7, 20, 51):
        common = [rng.integers(97, 100, 60).astype(np.uint8) for _ in range(4)]
        parts = []
        for _ in range(3):
            texts = [np.concatenate([rng.integers(0, 256, rng.integers(0, 30)).astype(np.uint8), common[rng.integers(4)]]) for _ in range(6)]
            parts.append((np.concatenate(texts), np.array([len(t) for t in texts]), rng.integers(0, 15, len(texts))))
        least, at = {}, []
        for d, size, owner in parts:
            for t, end in enumerate(np.cumsum(size).tolist()):
                begin = end - int(size[t])
                at.append([(d[i : i + window].tobytes() if i + window <= end else None, int(owner[t])) for i in range(begin, end)])
        for w, o in sum(at, []):
            least[w] = min(o, least.get(w, o))
        want = [w is not None and least[w] < o for w, o in sum(at, [])]
        assert np.concatenate(S.repeated(window, parts)).tolist() == want
        orders, seqs = zip(*[S.shard_transform(d, s, window) for d, s, _ in parts], strict=True)
        assert window < 7 or len(S.transforms(list(orders), list(seqs), window)) <= -(-window // 2)


def test_op7_grows_with_the_input(spark):
    """Few rounds over prose; a bucket of messages is cut into merges; a part of few texts is not longer than they are."""
    import numpy as np
    import pyarrow as pa

    from lodeseek.llm import common as C
    from lodeseek.llm import suffix_dedup as S

    rng = np.random.default_rng(9)
    words = ["".join(rng.choice(list("etaoinshr"), rng.integers(2, 8))) for _ in range(60)]
    texts = [" ".join(rng.choice(words, 60)) for _ in range(40)]
    texts += [texts[k % 40][: 80 + 5 * k] + " ".join(rng.choice(words, 30)) for k in range(20)]
    data = [np.frombuffer(t.encode(), np.uint8) for t in texts]
    parts = [(np.concatenate(data[k::4]), np.array([len(t) for t in data[k::4]]), np.arange(60)[k::4]) for k in range(4)]
    orders, seqs = zip(*[S.shard_transform(d, s, 50) for d, s, _ in parts], strict=True)
    assert len(S.transforms(list(orders), list(seqs), 50)) <= 7

    rows = []
    for d, size, ids in parts:
        of = np.array([5, 0, 4, len(size) - 9], np.uint32)  # each block's texts in four merges, one of them empty
        rows.append([b"", *S.small_ids(ids), size.astype(np.uint32).tobytes(), S.packed(d), of.tobytes()])
    table = pa.table({"block": pa.array(range(4), pa.int32()), "bucket": pa.array([0] * 4, pa.int32()), "ctx": pa.array(rows, pa.list_(pa.binary()))})
    got = [S.bits_of(m, len(d)) for (_, m, _), (d, _, _) in zip(S.merge_bucket(2, 50)(table)["told"].to_pylist(), parts, strict=True)]
    for a, b in ((0, 5), (5, 9), (9, 15)):
        own = [np.concatenate([[0], np.cumsum(s)])[[a, min(b, len(s))]] for _, s, _ in parts]
        want = S.repeated(50, [(d[i:j], s[a:b], ids[a:b]) for (d, s, ids), (i, j) in zip(parts, own, strict=True)])
        assert [g[i:j].tolist() for g, (i, j) in zip(got, own, strict=True)] == [w.tolist() for w in want]

    rows = [(k % 7, None if k == 3 else k - 5, "" if k % 5 == 0 else "né " * k) for k in range(50)]
    dealt = C.deal_texts(spark.createDataFrame(rows, "block int, k bigint, t string").coalesce(1)).collect()
    assert len(dealt) == 7 and all(len(r.texts) < 300 for r in dealt)
    for r in dealt:
        back = C.undeal(pa.table({"texts": pa.array([r.texts], pa.binary())}), ["k", "t"]).to_pylist()
        assert sorted(map(str, back)) == sorted(str({"k": k, "t": t}) for b, k, t in rows if b == r.block)
