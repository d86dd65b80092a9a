"""Tables that several requests read: written once in a session, in a folder that driver and executors share."""

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Callable
from functools import cache

from pyspark.sql import SparkSession

_written: dict[tuple[str, str], tuple[SparkSession, str]] = {}


@cache
def _own_folder() -> str:
    return f"file://{tempfile.mkdtemp(prefix='lodeseek-index-')}"


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset a local master (tests) takes a folder of this machine, and a cluster is an error."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
    return _own_folder()


def stored(spark: SparkSession, name: str, write: Callable[[str], None]) -> str:
    """The path of a table (or folder of tables): the first call of a session writes it, later ones find it as it was then."""
    key = spark.sparkContext.applicationId, name
    if key not in _written:
        path = f"{folder(spark)}/lodeseek/index-{uuid.uuid4().hex}"
        write(path)
        _written[key] = spark, path
    return _written[key][1]


@atexit.register
def forget() -> None:
    """Remove what stored() has written."""
    for spark, path in _written.values():
        with contextlib.suppress(Exception):  # the session may be gone; the folder's owner cleans it then
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    _written.clear()
