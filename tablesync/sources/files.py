"""The few file-system calls Spark has no DataFrame operation for."""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import cache

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _fs(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    return _fs(spark, path).exists(_path(spark, path))


def names(spark: SparkSession, path: str) -> list[str]:
    """Names of the entries of a folder, sorted; none if it does not exist."""
    if not exists(spark, path):
        return []
    return sorted(s.getPath().getName() for s in _fs(spark, path).listStatus(_path(spark, path)))


def size(spark: SparkSession, path: str) -> int:
    return _fs(spark, path).getContentSummary(_path(spark, path)).getLength()


def read_text(spark: SparkSession, path: str) -> str:
    stream = _fs(spark, path).open(_path(spark, path))
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def create_text(spark: SparkSession, path: str, text: str) -> bool:
    """Publish a small file in one step; false if it already exists."""
    fs = _fs(spark, path)
    draft = f"{path}.{uuid.uuid4().hex}.draft"
    stream = fs.create(_path(spark, draft), False)
    stream.write(bytearray(text.encode()))
    stream.close()
    hadoop = spark._jvm.org.apache.hadoop.fs
    rename = getattr(hadoop, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.NONE
    context = hadoop.FileContext.getFileContext(_path(spark, path).toUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(_path(spark, draft), _path(spark, path), options)
    except Py4JJavaError as error:
        fs.delete(_path(spark, draft), False)
        if "FileAlreadyExistsException" in str(error.java_exception.getClass()):
            return False
        raise
    return True


def delete(spark: SparkSession, path: str) -> None:
    _fs(spark, path).delete(_path(spark, path), True)


def delete_uri(spark: SparkSession, uri: str) -> None:
    """Delete a folder named as file metadata names it, with escapes."""
    path = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(uri))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def shared_folder(spark: SparkSession) -> str:
    """Folder all executors reach: the checkpoint folder the session names.

    Only a session in one process, which has no other executors, may do without.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir has to name a folder shared by all executors")
    return _own_folder()


@cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="tablesync-")


def run_folder(spark: SparkSession, run_id: str) -> str:
    return f"{shared_folder(spark)}/tablesync/{run_id}"
