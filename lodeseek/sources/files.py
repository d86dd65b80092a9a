"""Source files: listing, language detection, pruning, reading, line search, and the saved index."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeseek.schema import CAPSULE

# Extensions of each language, special file names, pruned and document directories.
EXTENSIONS = {
    "python": ["py", "pyw"], "javascript": ["js", "mjs", "cjs", "jsx"], "typescript": ["ts", "tsx"], "go": ["go"], "rust": ["rs"], "java": ["java"],
    "ruby": ["rb"], "c": ["c", "h"], "cpp": ["cpp", "cc", "cxx", "hpp", "hxx"], "csharp": ["cs"], "php": ["php", "phtml"], "swift": ["swift"],
    "kotlin": ["kt", "kts"], "scala": ["scala"], "dart": ["dart"], "lua": ["lua"], "r": ["r"], "elixir": ["ex", "exs"], "haskell": ["hs"],
    "perl": ["pl", "pm"], "julia": ["jl"], "objectivec": ["m", "mm"], "shell": ["sh", "bash", "zsh"], "sql": ["sql"], "html": ["html", "htm"], "css": ["css"],
    "text": ["txt", "md", "rst", "cfg", "ini", "toml", "yaml", "yml", "json", "xml", "ps1", "bat", "dockerfile", "makefile", "cmake"],
    "image": ["png", "jpg", "jpeg", "gif", "webp", "svg", "bmp", "ico"],
}
SPECIAL_NAMES = ["dockerfile", "makefile", "gemfile", "rakefile", "cmakelists.txt"]
PRUNED = ["__pycache__", ".git", "node_modules", "venv", ".venv", "dist", "build", ".tox", ".egg-info"]
DOCUMENT_DIRS = ["data", "docs", "doc", "synthetic"]
# End of the fixed values.


def extension(path: Column) -> Column:
    return F.regexp_extract(F.lower(path), r"\.([^./]+)$", 1)


def detect_language(path: Column) -> Column:
    """Language of a file by its extension; unknown ones and special names are text."""
    ext = extension(path)
    return F.coalesce(*[F.when(ext.isin(v), k) for k, v in EXTENSIONS.items()], F.lit("text"))


def pruned(path: Column) -> Column:
    """Whether a part of the path is a directory that is never read."""
    return F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(p) for p in PRUNED]))


def admitted(path: Column) -> Column:
    """Not pruned; .txt files only below a directory for documents."""
    docs = F.arrays_overlap(F.split(F.lower(path), "/"), F.array(*[F.lit(p) for p in DOCUMENT_DIRS]))
    return ~pruned(path) & ((extension(path) != "txt") | docs)


def in_repo(path: Column, repo: Column) -> Column:
    return (path == repo) | F.startswith(path, F.concat(repo, F.lit("/")))


def read_sources(spark: SparkSession, root: str, languages: list[str] | None = None) -> DataFrame:
    """(file_path, language, content, data) of the admitted files below root; images keep their bytes only.

    languages None or ['auto'] means all; otherwise the file listing is already narrowed by a glob.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if languages and languages != ["auto"]:
        reader = reader.option("pathGlobFilter", "*.{" + ",".join(e for k in languages for e in EXTENSIONS.get(k, [])) + "}")
    rows = reader.load(root).withColumn("language", detect_language(F.col("path"))).where(admitted(F.col("path")))
    text = F.when(F.col("language") != "image", F.decode(F.col("content"), "UTF-8"))
    return rows.select(F.col("path").alias("file_path"), "language", text.alias("text"), F.when(F.col("language") == "image", F.col("content")).alias("data")).withColumnRenamed("text", "content")


def list_files(paths: DataFrame, path: str, depth: int, pattern: str = "*") -> DataFrame:
    """Paths of at most `depth` directories whose name fits a shell pattern."""
    like = pattern.replace("%", r"\%").replace("_", r"\_").replace("*", "%").replace("?", "_")
    name = F.element_at(F.split(F.col(path), "/"), -1)
    return paths.where((F.size(F.split(F.col(path), "/")) <= depth) & name.like(like))


def grep(files: DataFrame, pattern: str, key: str, content: str, most: int = 20, regex: bool = False) -> DataFrame:
    """Lines that hold a pattern (without case unless regex), clipped to 120 characters, the first `most` by file and line."""
    lines = files.select(key, F.posexplode(F.split(F.col(content), "\n")).alias("pos", "line"))
    hit = F.rlike("line", F.lit(pattern)) if regex else F.contains(F.lower("line"), F.lit(pattern.lower()))
    return lines.where(hit).select(key, (F.col("pos") + 1).alias("line_no"), F.substring(F.trim("line"), 1, 120).alias("line")).orderBy(key, "line_no").limit(most)


def save_index(capsules: DataFrame, path: str) -> None:
    """The index as compressed JSON, with contents."""
    capsules.write.mode("overwrite").option("compression", "gzip").json(path)


def load_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CAPSULE).json(path)


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old with the rows of new in place of those with the same key."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def indexed_repos(capsules: DataFrame, repo: str = "repo") -> DataFrame:
    return capsules.select(repo).distinct()
