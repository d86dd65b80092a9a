"""Language identification of web pages by Bayesian fusion of four kinds of evidence.

1. Text: log-likelihoods of a multinomial model of byte trigrams for each language, learned from a bounded sample of
   documents with a known language (per_lang texts of each, or a few more, of which at most max_bytes each, longer ones by
   passages over their whole length). The likelihood is tempered (TEMPER), as overlapping trigrams are not independent.
2. Declared markup language: <html lang>, xml:lang or a content-language meta tag, reduced to its primary tag.
3. Address suffix: country domains that stand for a language, and a language tag as a path step.
4. Host prior: hosts, then registered domains, then all pages, smoothed level by level: each level's language
   distribution is its expected counts plus the level above times a weight. Counts are the expected languages from the other
   evidence, summed by grouped aggregation, so they need no labels.

What a declared tag or a suffix says is trusted as far as it agrees with the text: the agreement rate of each kind
is estimated over all pages and smoothed.

Defined results: null html or url is no evidence of its kind; a page without any evidence gets the overall prior; ties
go to the alphabetically first language; the languages are those of the sample and those that pages declare or whose
country domains they have, those without texts in the sample with a flat text likelihood (all cells alike) on the
pages that name them, and elsewhere as unlikely as the least likely language of the sample; an empty table gives no rows. Rows that repeat a page_id are judged each. Other columns are not looked at, whatever their names.
"""

from __future__ import annotations

import re
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeseek.llm import common as C

PER_LANG, MAX_BYTES = 400, 16_384
TEMPER, LEVEL_WEIGHT, UNSEEN = 0.05, 5.0, 0.01
#: Slices of a language in which training texts are chosen before they are chosen among all.
SLICES = 256
CELLS = 1 << 15

#: Languages that country domains stand for.
SUFFIX_LANGUAGE = {"at": "de", "de": "de", "es": "es", "fr": "fr", "it": "it", "mx": "es", "nl": "nl", "pl": "pl", "pt": "pt", "uk": "en", "us": "en"}

_DROP = re.compile(rb"<(script|style|noscript)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", re.S | re.I)
MARKUP = re.compile(rb"""<html\b[^>]*?\b(?:xml:)?lang\s*=\s*["']?([A-Za-z]{2,3})|<meta\b[^>]*?\bhttp-equiv\s*=\s*["']?content-language["']?[^>]*?\bcontent\s*=\s*["']?([A-Za-z]{2,3})|<meta\b[^>]*?\bcontent\s*=\s*["']?([A-Za-z]{2,3})[^>]*?\bhttp-equiv\s*=\s*["']?content-language\b""", re.I)


def trigram_cells(data: np.ndarray) -> np.ndarray:
    low = C.LOWER[data].astype(np.uint32)
    if len(low) < 3:
        return np.zeros(0, np.int64)
    return (((low[:-2] * np.uint32(0x9E3779B1)) ^ (low[1:-1] * np.uint32(0x85EBCA77)) ^ (low[2:] * np.uint32(0xC2B2AE3D))) * np.uint32(0x27D4EB2F) >> np.uint32(17)).astype(np.int64)


def train(texts: list[str], langs: list[str]) -> tuple[list[str], np.ndarray]:
    names = sorted(set(langs))
    count = np.zeros((len(names), CELLS))
    for t, k in zip(texts, langs, strict=True):
        cells = trigram_cells(np.frombuffer(t.encode(), np.uint8))
        count[names.index(k)] += np.bincount(cells, minlength=CELLS)
    total = count.sum(axis=1, keepdims=True)
    # The same share of each language goes to all cells alike: what no language has seen tells none apart.
    seen = np.where(total > 0, 1 - UNSEEN, 0.0)
    return names, np.log(seen * count / np.maximum(total, 1) + (1 - seen) / CELLS).astype(np.float32)


def page_text(html: str) -> bytes:
    """The text of a page: markup, scripts and styles dropped."""
    return unescape(_DROP.sub(b" ", html.encode()).decode()).encode("utf-8", "replace")


def training_texts(docs: DataFrame, text_col: str, lang_col: str, per_lang: int, max_bytes: int) -> tuple[list[str], list[str]]:
    """Of each language the per_lang distinct texts with the smallest hashes: the same ones however the table is dealt."""
    text = F.col(f"`{text_col}`")
    rows = docs.select(F.coalesce(text, F.lit("")).alias("t"), F.col(f"`{lang_col}`").alias("l")).where((F.octet_length("t") > 0) & F.col("l").isNotNull())
    rows = rows.withColumn("h", F.xxhash64("t"))
    # Hashes of distinct texts, first for each slice of a language, so that a language that a third of all rows have is no task of its own.
    top = lambda by: F.row_number().over(Window.partitionBy(*by).orderBy("h"))
    slices = rows.select("l", "h").distinct().withColumn("s", F.pmod("h", F.lit(SLICES)))
    best = slices.withColumn("place", top(["l", "s"])).where(F.col("place") <= per_lang).withColumn("place", top(["l"])).where(F.col("place") <= per_lang).select("l", "h")
    taken = rows.join(F.broadcast(best), ["l", "h"]).groupBy("l", "h").agg(F.min(C.sampled_text(F.col("t"), max_bytes)).alias("t")).orderBy("l", "h").collect()
    return [r.t for r in taken], [r.l for r in taken]


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))


def evidence(pages: DataFrame, model: tuple[list[str], np.ndarray], keep: list[str], html_col: str) -> DataFrame:
    """For each page the text's log-likelihoods (tempered, by language of the model), the flat one, and the declared language."""
    names, table = model
    sent = pages.sparkSession.sparkContext.broadcast(table)

    def work(batch: pa.RecordBatch, data: np.ndarray, offs: np.ndarray) -> dict[str, object]:
        texts = batch.column(batch.schema.get_field_index("t")).to_pylist()
        like, flat, said = np.zeros((len(texts), len(names))), np.zeros(len(texts)), []
        for i, t in enumerate(texts):
            t = t or ""
            m = MARKUP.search(t.encode())
            said.append((m[1] or m[2] or m[3]).decode().lower() if m else "")
            cells = trigram_cells(np.frombuffer(page_text(t), np.uint8))
            flat[i] = -TEMPER * len(cells) * np.log(CELLS)
            if len(cells) and len(names):
                like[i] = TEMPER * sent.value[:, cells].sum(axis=1, dtype=np.float64)
        return {"like": pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * len(names)), pa.array(like.ravel())), "flat": flat, "said": said}

    return C.map_text(pages, html_col, keep, work, [("like", "array<double>"), ("flat", "double"), ("said", "string")], "r")


def language_id(
    pages: DataFrame, docs: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", text_col: str = "text", lang_col: str = "lang", per_lang: int = PER_LANG, max_bytes: int = MAX_BYTES
) -> DataFrame:
    """One row per page: id, language, probability, text_language, declared, suffix_language, host, host_pages."""
    model = train(*training_texts(docs, text_col, lang_col, per_lang, max_bytes))
    rows = evidence(pages, model, [id_col, url_col], html_col)
    url = F.col(f"`{url_col}`")
    rows = rows.select(F.col(f"`{id_col}`").alias("id"), host(url).alias("host"), F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[^:]*://[^/?#]+/([A-Za-z]{2})(?:[/?#]|$)", 1)).alias("step"), F.col("r")["like"].alias("like"), F.col("r")["flat"].alias("flat"), F.col("r")["said"].alias("said"))
    top = F.element_at(F.split("host", r"\."), -1)
    country = F.coalesce(*[F.when(top == k, v) for k, v in SUFFIX_LANGUAGE.items()], F.lit(""))
    rows = C.settle(rows.withColumn("country", country), "page evidence")
    named = {x for r in rows.select("said", "country").distinct().collect() for x in r if x}
    names = sorted(named | set(model[0])) or sorted(set(SUFFIX_LANGUAGE.values()))
    langs = F.array(*[F.lit(x) for x in names])
    rows = rows.withColumn("suffix", F.when(F.array_contains(langs, F.col("step")), F.col("step")).otherwise(F.col("country")))
    least = F.least(F.col("flat"), F.array_min("like"))
    untrained = lambda x: F.when((F.col("said") == x) | (F.col("suffix") == x), F.col("flat")).otherwise(least)
    rows = rows.withColumn("like", F.array(*[F.element_at("like", model[0].index(x) + 1) if x in model[0] else untrained(x) for x in names]))
    rows = rows.withColumn("domain", F.array_join(F.slice(F.reverse(F.split("host", r"\.")), 1, 2), "."))
    like = F.transform("like", lambda x: F.exp(x - F.array_max("like")))
    total = F.aggregate(like, F.lit(0.0), lambda a, x: a + x)
    rows = rows.withColumn("text_p", F.transform(like, lambda x: x / total))
    rows = C.settle(rows.drop("like", "flat", "step", "country"), "pages")

    # How far to trust a declared tag or a suffix: the text's probability of it, on average over all pages.
    def agreement(col: str) -> Column:
        at = F.array_position(langs, F.col(col))
        return (F.coalesce(F.sum(F.when(at > 0, F.element_at("text_p", F.greatest(at, F.lit(1)).cast("int")))), F.lit(0.0)) + 9) / (F.coalesce(F.sum(F.when(at > 0, 1).otherwise(0)), F.lit(0)) + 10)

    trust = rows.agg(agreement("said"), agreement("suffix")).first()

    def fused(p: Column, priors: Column | None = None) -> Column:
        def weight(name: Column) -> Column:
            w = F.lit(1.0)
            for col, t in (("said", trust[0]), ("suffix", trust[1])):
                other = (1 - t) / max(1, len(names) - 1)
                w = w * F.when(F.array_contains(langs, F.col(col)), F.when(F.col(col) == name, F.lit(float(t))).otherwise(F.lit(float(other)))).otherwise(F.lit(1.0))
            return w

        v = F.zip_with(p, langs, lambda x, name: x * weight(name))
        if priors is not None:
            v = F.zip_with(v, priors, lambda x, y: x * y)
        s = F.aggregate(v, F.lit(0.0), lambda a, x: a + x)
        return F.transform(v, lambda x: F.when(s > 0, x / s).otherwise(1.0 / len(names)))

    def counts(key: str) -> DataFrame:
        sums = [F.sum(F.element_at("p", i + 1)) for i in range(len(names))]
        return by_page.groupBy(key).agg(F.array(*sums).alias(f"n_{key}"), F.count("*").alias(f"rows_{key}"))

    by_page = rows.withColumn("p", fused(F.col("text_p")))
    hosts = counts("host").withColumn("domain", F.array_join(F.slice(F.reverse(F.split("host", r"\.")), 1, 2), "."))
    sums = [F.sum(F.element_at("n_host", i + 1)) for i in range(len(names))]
    domains = hosts.groupBy("domain").agg(F.array(*sums).alias("n_domain"))
    world = domains.agg(F.array(*[F.coalesce(F.sum(F.element_at("n_domain", i + 1)), F.lit(0.0)) for i in range(len(names))])).first()[0]
    all_ = sum(world) + LEVEL_WEIGHT
    base = F.array(*[F.lit((x + LEVEL_WEIGHT / len(names)) / all_) for x in world])

    def level(n: Column, above: Column) -> Column:
        s = F.aggregate(n, F.lit(0.0), lambda a, x: a + x)
        return F.zip_with(n, above, lambda x, a: (x + LEVEL_WEIGHT * a) / (s + LEVEL_WEIGHT))

    priors = hosts.join(domains, "domain").select("host", level(F.col("n_host"), level(F.col("n_domain"), base)).alias("prior"), "rows_host")
    # A hot host, or the many pages without one, is no task of its own: see common.join_groups.
    out = C.join_groups(rows, priors, "host", "rows_host", rows.count()).select("*", "group.*").drop("group").withColumn("post", fused(F.col("text_p"), F.col("prior")))
    best = lambda p: F.element_at(langs, F.array_position(p, F.array_max(p)).cast("int"))
    return out.select(
        F.col("id").alias(id_col),
        best(F.col("post")).alias("language"),
        F.array_max("post").alias("probability"),
        best(F.col("text_p")).alias("text_language"),
        F.col("said").alias("declared"),
        F.col("suffix").alias("suffix_language"),
        "host",
        F.col("rows_host").alias("host_pages"),
    )
