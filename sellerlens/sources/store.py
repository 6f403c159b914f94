"""Folders of the shared store, through Spark's own file systems (local, HDFS, object stores).

Only names and small text files pass here; data is read and written by Spark.
"""

from __future__ import annotations

from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _fs(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    return _fs(spark, path).exists(_path(spark, path))


def names(spark: SparkSession, folder: str) -> list[str]:
    """The names in a folder, sorted; none where there is no folder."""
    if not exists(spark, folder):
        return []
    return sorted(x.getPath().getName() for x in _fs(spark, folder).listStatus(_path(spark, folder)))


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder that this library wrote; nothing happens where there is none."""
    _fs(spark, path).delete(_path(spark, path), True)


def read_text(spark: SparkSession, path: str) -> str:
    stream = _fs(spark, path).open(_path(spark, path))
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def create_text(spark: SparkSession, path: str, text: str) -> bool:
    """Writes a small file if there is none of this name; False, and nothing changes, if there is one.

    The store decides: a create that may not overwrite is atomic in HDFS, and a conditional put in object stores that have it.
    """
    try:
        stream = _fs(spark, path).create(_path(spark, path), False)
    except Exception as e:  # the JVM's exception, by its class
        if "FileAlreadyExistsException" in str(e):
            return False
        raise
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    return True


def replace_text(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small file beside `path` and renames it onto it, so that a reader sees the old or the new text."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    new = _path(spark, path + ".new")
    stream = _fs(spark, path).create(new, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    target = _fs(spark, path).makeQualified(_path(spark, path))
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), conf)
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(_fs(spark, path).makeQualified(new), target, options)
