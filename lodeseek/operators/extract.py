"""Extraction of all kinds of files: each language goes to its extractor, and failures become rows of their own."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeseek.operators.extract_generic import generic_capsules
from lodeseek.operators.extract_markup import document_capsules, image_capsules, markup_capsules
from lodeseek.operators.extract_python import python_capsules
from lodeseek.operators.frameworks import detect_frameworks
from lodeseek.schema import FIELDS


def capsules(files: DataFrame) -> DataFrame:
    """files (file_path, language, content, data) -> capsules with the column framework ('' if none).

    One scan per kind of extractor, each with its own filter on language, which reaches the scan if files is partitioned by it.
    """
    lang = F.col("language")
    name = F.element_at(F.split("file_path", "/"), -1)
    code = [
        python_capsules(files.where(lang == "python")),
        generic_capsules(files.where(~lang.isin("python", "html", "css", "text", "image"))),
        markup_capsules(files.where(lang.isin("html", "css"))),
    ]
    ruled = detect_frameworks(reduce(DataFrame.unionByName, [c.select(*FIELDS) for c in code]))
    plain = [document_capsules(files.where(lang == "text"), F.col("file_path"), name, F.col("content"), lang), image_capsules(files.where(lang == "image"))]
    return reduce(DataFrame.unionByName, [p.select(*FIELDS).withColumn("framework", F.lit("")) for p in plain], ruled)


def errors(found: DataFrame) -> DataFrame:
    """(file_path, error) of files whose extraction failed."""
    return found.where("type = 'error'").select("file_path", "error")
