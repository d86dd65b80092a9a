"""Structure of HTML pages and style sheets, plain text of pages, and documents; columns only where that is possible."""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeseek.functions.text import strip
from lodeseek.schema import capsule_id

TAG, CLASS, META = r"(?U)<\s*(\w+)", r"class=[\"']([^\"']+)[\"']", r"<meta\s+([^>]+)>"
HEADING = r"<(h[1-6])\b[^>]*>(.*?)</h[1-6]>"
SELECTOR, COLOUR = r"(?U)([.#@]?[a-zA-Z][\w-]*)\s*\{", r"(#[0-9a-fA-F]{3,8}|rgba?\([^)]+\)|hsla?\([^)]+\))"
MIME = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "webp": "image/webp", "svg": "image/svg+xml", "bmp": "image/bmp", "ico": "image/x-icon"}


def _all(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def tag_counts(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, tag, n)"""
    return pages.select(key, F.explode(_all(F.col(html), TAG)).alias("tag")).groupBy(key, "tag").agg(F.count("*").alias("n"))


def tag_summary(html: Column) -> Column:
    """`a(3), p(2)`: tags in order with their counts, within the row."""
    tags = F.array_sort(_all(html, TAG))
    one = F.array_distinct(tags)
    return F.array_join(F.transform(one, lambda t: F.concat(t, F.lit("("), F.size(F.filter(tags, lambda x: x == t)).cast("string"), F.lit(")"))), ", ")


def classes(html: Column, most: int = 30) -> Column:
    parts = F.flatten(F.transform(_all(html, CLASS), lambda c: F.filter(F.split(c, r"\s+"), lambda x: x != "")))
    return F.slice(F.array_sort(F.array_distinct(parts)), 1, most)


def metas(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, name, value) of meta tags with a name or property and a content; of equal names the last counts."""
    attrs = pages.select(key, F.posexplode(_all(F.col(html), META)).alias("pos", "a"))
    name = F.coalesce(*[F.nullif(F.regexp_extract("a", rf"{n}=[\"']([^\"']+)[\"']", 1), F.lit("")) for n in ("name", "property")])
    value = F.nullif(F.regexp_extract("a", r"content=[\"']([^\"']+)[\"']", 1), F.lit(""))
    rows = attrs.select(key, "pos", name.alias("name"), value.alias("value")).where("name is not null and value is not null")
    return rows.groupBy(key, "name").agg(F.max_by("value", "pos").alias("value"))


def headings(html: Column, most: int = 10) -> Column:
    """`H1: text`, at most 100 characters of text each."""
    level, text = F.slice(_all(html, HEADING, 1), 1, most), F.slice(_all(html, HEADING, 2), 1, most)
    return F.zip_with(level, text, lambda h, t: F.concat(F.upper(h), F.lit(": "), F.substring(strip(t), 1, 100)))


def json_ld(html: Column) -> Column:
    found = _all(html, r"(?s)<script\s[^>]*type=[\"']application/ld\+json[\"'][^>]*>(.*?)</script>")
    return F.substring(F.coalesce(F.try_element_at(found, F.lit(1)), F.lit("")), 1, 500)


def css_selectors(css: Column, most: int = 30) -> Column:
    return F.slice(F.array_sort(F.array_distinct(_all(css, SELECTOR))), 1, most)


def css_colours(css: Column, most: int = 20) -> Column:
    return F.slice(F.array_sort(F.array_distinct(_all(css, COLOUR))), 1, most)


def css_fonts(css: Column, most: int = 10) -> Column:
    return F.transform(F.slice(_all(css, r"font-family\s*:\s*([^;]+);"), 1, most), strip)


def css_media(css: Column, most: int = 5) -> Column:
    return F.transform(F.slice(_all(css, r"@media\s+([^{]+)\{"), 1, most), strip)


def plain_text(html: Column, most: int = 3000) -> Column:
    """Text without scripts, styles and tags; blanks collapsed to one."""
    text = F.regexp_replace(html, r"(?is)<(script|style|noscript)[^>]*>.*?</\1>", " ")
    return F.substring(F.trim(F.regexp_replace(F.regexp_replace(text, r"<[^>]+>", " "), r"\s+", " ")), 1, most)


@F.pandas_udf(T.StringType())
def parsed_text(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Text nodes by the standard HTML parser, trimmed and joined by new lines, at most 3000 characters."""
    from html.parser import HTMLParser

    class Collect(HTMLParser):
        def __init__(self) -> None:
            super().__init__(convert_charrefs=True)
            self.hidden, self.parts = 0, []

        def handle_starttag(self, tag, attrs):
            self.hidden += tag in ("script", "style", "noscript")

        def handle_endtag(self, tag):
            self.hidden -= tag in ("script", "style", "noscript") and self.hidden > 0

        def handle_data(self, data):
            if not self.hidden and data.strip():
                self.parts.append(data.strip())

    for part in pages:
        out = []
        for html in part:
            c = Collect()
            c.feed(html or "")
            out.append("\n".join(c.parts)[:3000])
        yield pd.Series(out)


def document_capsules(docs: DataFrame, path: Column, name: Column, text: Column, language: Column) -> DataFrame:
    """One document capsule per text, in columns only."""
    body, raw = strip(F.coalesce(text, F.lit(""))), F.coalesce(text, F.lit(""))
    sig = F.concat(F.lit("[doc] "), name)
    props = F.array(F.struct(F.lit("chars").alias("k"), F.length(raw).cast("string").alias("v")))
    none = F.array().cast("array<string>")
    return docs.select(
        capsule_id(path, F.lit(1), sig).alias("id"), F.lit("document").alias("type"), name.alias("name"), path.alias("file_path"), F.lit(1).alias("start_line"),
        (F.length(raw) - F.length(F.translate(raw, "\n", "")) + 1).alias("end_line"), language.alias("language"), sig.alias("signature"), body.alias("content"),
        F.substring(body, 1, 300).alias("docstring"), none.alias("calls"), none.alias("imports"), props.alias("properties"), F.lit(0).alias("seq"), F.lit(None).cast("string").alias("error"),
    )


def markup_capsules(files: DataFrame) -> DataFrame:
    """files (file_path, content, language html or css) -> one capsule each with the structure as properties."""
    text = F.coalesce("content", F.lit(""))
    stem = F.regexp_replace(F.element_at(F.split("file_path", "/"), -1), r"(.)\.[^.]*$", "$1")
    html = F.col("language") == "html"
    meta = metas(files.where(html), "file_path", "content").groupBy("file_path").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "name", "value"))), ", ").alias("m"))
    pair = lambda k, v: F.struct(F.lit(k).alias("k"), v.alias("v"))
    page = F.array(pair("tags", tag_summary(text)), pair("css_classes", F.array_join(classes(text), ", ")), pair("meta_tags", F.coalesce("m", F.lit(""))), pair("headings", F.array_join(headings(text), ", ")), pair("json_ld", json_ld(text)), pair("chars", F.length(text).cast("string")))
    sheet = F.array(pair("selectors", F.array_join(css_selectors(text), ", ")), pair("colors", F.array_join(css_colours(text), ", ")), pair("fonts", F.array_join(css_fonts(text), ", ")), pair("media_queries", F.array_join(css_media(text), ", ")), pair("chars", F.length(text).cast("string")))
    none = F.array().cast("array<string>")
    return files.join(meta, "file_path", "left").select(
        capsule_id(F.col("file_path"), F.lit(1), F.concat("language", F.lit("_structure"))).alias("id"), F.lit("document").alias("type"), F.concat(stem, F.lit("."), "language").alias("name"),
        "file_path", F.lit(1).alias("start_line"), (F.length(text) - F.length(F.translate(text, "\n", "")) + 1).alias("end_line"), "language",
        F.concat(F.lit("["), "language", F.lit("] "), stem).alias("signature"), F.substring(text, 1, 3000).alias("content"), F.lit(None).cast("string").alias("docstring"),
        none.alias("calls"), none.alias("imports"), F.when(html, page).otherwise(sheet).alias("properties"), F.lit(0).alias("seq"), F.lit(None).cast("string").alias("error"),
    )


def image_capsules(files: DataFrame) -> DataFrame:
    """files (file_path, data) -> one image capsule each, its content a data URL."""
    ext = F.regexp_extract(F.lower("file_path"), r"\.([^./]+)$", 1)
    mime = F.coalesce(*[F.when(ext == k, v) for k, v in MIME.items()], F.lit("image/png"))
    name = F.element_at(F.split("file_path", "/"), -1)
    sig = F.concat(F.lit("[image] "), name)
    none = F.array().cast("array<string>")
    pair = lambda k, v: F.struct(F.lit(k).alias("k"), v.alias("v"))
    return files.select(
        capsule_id(F.col("file_path"), F.lit(1), sig).alias("id"), F.lit("image").alias("type"), name.alias("name"), "file_path", F.lit(1).alias("start_line"), F.lit(1).alias("end_line"),
        F.lit("image").alias("language"), sig.alias("signature"), F.concat(F.lit("data:"), mime, F.lit(";base64,"), F.base64("data")).alias("content"), F.lit(None).cast("string").alias("docstring"),
        none.alias("calls"), none.alias("imports"), F.array(pair("mime", mime), pair("size_bytes", F.octet_length("data").cast("string"))).alias("properties"), F.lit(0).alias("seq"), F.lit(None).cast("string").alias("error"),
    )
