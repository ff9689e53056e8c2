"""Text files and folders by path, on a local disk or in any store that Spark's Hadoop client knows."""

from __future__ import annotations

import os
import re
import shutil
import uuid
from pathlib import Path, PurePosixPath

from pyspark.sql import SparkSession

# Schemes of stores, and mounts that are local although they look remote.
_CLOUD = re.compile(r"^(s3|s3a|abfss|abfs|gs|dbfs|wasbs|hdfs):/")


def is_cloud_path(path: str) -> bool:
    return bool(_CLOUD.match(str(path)))


def _hadoop(path: str):
    spark = SparkSession.getActiveSession()
    if spark is None:
        raise RuntimeError(f"A session is needed to reach {path}")
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def _local(path: str) -> Path:
    return Path(str(path).removeprefix("file://").removeprefix("file:"))


def write_text(path: str, text: str) -> None:
    if is_cloud_path(path):
        system, target = _hadoop(path)
        out = system.create(target, True)
        out.write(bytearray(text.encode()))
        out.close()
        return
    _local(path).parent.mkdir(parents=True, exist_ok=True)
    _local(path).write_text(text)


def read_text(path: str) -> str:
    if is_cloud_path(path):
        system, target = _hadoop(path)
        stream = system.open(target)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
    return _local(path).read_text()


def append_text(path: str, text: str) -> None:
    """Adds to a local file; in a store, where files don't grow, adds a file to the folder of that name."""
    if is_cloud_path(path):
        write_text(f"{path.rstrip('/')}/{uuid.uuid4().hex}", text)
        return
    _local(path).parent.mkdir(parents=True, exist_ok=True)
    with _local(path).open("a") as file:
        file.write(text)


def path_exists(path: str) -> bool:
    if is_cloud_path(path):
        system, target = _hadoop(path)
        return system.exists(target)
    return _local(path).exists()


def list_files(path: str) -> list[str]:
    """Files of a folder by name, hidden ones aside."""
    if is_cloud_path(path):
        system, target = _hadoop(path)
        return sorted(x.getPath().toString() for x in system.listStatus(target) if x.isFile() and not x.getPath().getName().startswith("."))
    return sorted(str(p) for p in _local(path).iterdir() if p.is_file() and not p.name.startswith("."))


def copy_file(source: str, target: str) -> None:
    if is_cloud_path(source) or is_cloud_path(target):
        write_text(target, read_text(source))
        return
    _local(target).parent.mkdir(parents=True, exist_ok=True)
    shutil.copy(_local(source), _local(target))


def ensure_dir(path: str) -> None:
    if is_cloud_path(path):
        system, target = _hadoop(path)
        system.mkdirs(target)
    else:
        _local(path).mkdir(parents=True, exist_ok=True)


def remove_dir(path: str) -> None:
    if is_cloud_path(path):
        system, target = _hadoop(path)
        system.delete(target, True)
    else:
        shutil.rmtree(_local(path), ignore_errors=True)


def path_name(path: str) -> str:
    return str(path).rstrip("/").rsplit("/", 1)[-1]


def path_stem(path: str) -> str:
    return PurePosixPath(path_name(path)).stem


def join_path(first: str, *rest: str) -> str:
    return "/".join([str(first).rstrip("/"), *(str(r).strip("/") for r in rest)]) if is_cloud_path(first) else os.path.join(first, *rest)


def resolve_dir(path: str, base: str | None = None) -> str:
    """An absolute or store path as it is; else below base, or the working folder."""
    return str(path) if is_cloud_path(path) or os.path.isabs(path) else str(Path(base or os.getcwd(), path))
