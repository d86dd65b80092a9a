"""Python source files made from table columns, so that what extraction must find is known from the same columns.

One file per part (a constant, a function that calls another), nation (a class and a function) and supplier (a test and
an entry point).
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PART = """concat('import math\\nRATE_', p_partkey, ' = ', p_size, '\\n\\ndef make_', p_partkey, '(size: int, rate=1.5) -> float:\\n',
    CASE WHEN p_partkey % 3 <> 0 THEN concat('    \\"\\"\\"Builds ', p_brand, ' things.\\"\\"\\"\\n') ELSE '' END,
    '    return scale_', p_partkey % 25, '(size) + check(rate)\\n')"""
NATION = """concat('class Nation', n_nationkey, '(Base):\\n    \\"\\"\\"Region ', n_regionkey, '.\\"\\"\\"\\n    def scale(self):\\n        return make_', n_nationkey + 1,
    '(1)\\n\\n@app.get(\\"/scale\\")\\ndef scale_', n_nationkey, '(x):\\n    return x\\n')"""
SUPPLIER = """concat('from src.lib import scale_', s_suppkey % 25, '\\n\\ndef test_supplier_', s_suppkey, '():\\n    assert scale_', s_suppkey % 25,
    '(1) == 1\\n\\nif __name__ == \\'__main__\\':\\n    test_supplier_', s_suppkey, '()\\n')"""


def source_files(spark: SparkSession, folder: str) -> DataFrame:
    """(file_path, content)"""
    t = lambda n: spark.read.parquet(f"{folder}/{n}.parquet")
    part = t("part").select(F.expr("concat('src/parts/p', p_partkey % 10, '/part_', p_partkey, '.py')").alias("file_path"), F.expr(PART).alias("content"))
    nation = t("nation").select(F.expr("concat('src/lib/nation_', n_nationkey, '.py')").alias("file_path"), F.expr(NATION).alias("content"))
    supplier = t("supplier").select(F.expr("concat('tests/test_supplier_', s_suppkey, '.py')").alias("file_path"), F.expr(SUPPLIER).alias("content"))
    return part.unionByName(nation).unionByName(supplier)
