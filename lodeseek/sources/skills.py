"""Skill files: Markdown with a front matter of simple `key: value` and list lines, read as rule rows."""

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SKILL = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("priority", T.IntegerType()),
        T.StructField("task_types", T.ArrayType(T.StringType())),
        T.StructField("triggers", T.ArrayType(T.StringType())),
        T.StructField("file_extensions", T.ArrayType(T.StringType())),
        T.StructField("body", T.StringType()),
    ]
)


def front_matter(text: str) -> tuple[dict[str, object], str]:
    """Keys and the rest of the text; a value is a string, `[a, b]`, or the `- item` lines after it."""
    m = re.match(r"---\s*\n(.*?)\n---\s*\n?(.*)", text or "", re.S)
    if not m:
        return {}, text or ""
    out: dict[str, object] = {}
    key = ""
    bare = lambda s: s.strip().strip("'\"")
    for line in m[1].split("\n"):
        if item := re.match(r"\s*-\s+(.*)", line):
            out[key] = [*(out[key] if isinstance(out.get(key), list) else []), bare(item[1])]
        elif pair := re.match(r"(\w+)\s*:\s*(.*)", line):
            key, value = pair[1], pair[2].strip()
            out[key] = [bare(x) for x in value[1:-1].split(",") if x.strip()] if value.startswith("[") else bare(value)
    return out, m[2]


@F.udf(SKILL)
def parse(path: str, text: str):
    keys, body = front_matter(text)
    as_list = lambda k: keys[k] if isinstance(keys.get(k), list) else [keys[k]] if keys.get(k) else []
    number = str(keys.get("priority", "0"))
    name = keys.get("name") or path.rsplit("/", 1)[-1].removesuffix(".md")
    return name, int(number) if re.fullmatch(r"-?\d+", number) else 0, as_list("task_types"), as_list("triggers"), [e.lstrip(".").lower() for e in as_list("file_extensions")], body


def read_skills(spark: SparkSession, *roots: str) -> DataFrame:
    """Skills below the roots; a few files, one row each."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").text(list(roots), wholetext=True)
    return files.select(parse(F.col("_metadata.file_path"), "value").alias("s")).select("s.*").orderBy(F.desc("priority"), "name")
