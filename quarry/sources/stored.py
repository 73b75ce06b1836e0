"""Derived tables that are kept by the signature of the files they come from.

A table is built into a folder of its own and named by one small pointer file, which is
renamed into place when all is written: readers see the old table or the new one, never a
part, and a build that fails changes nothing.  The signature is the names, times and sizes
of the source's files: as long as it stands nothing is built again.
"""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import SparkSession

POINTER = "current"


def home(spark: SparkSession) -> str:
    """The folder for derived tables that driver and executors share: below spark.checkpoint.dir; where that is unset, one of this machine if it is all there is."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("quarry.stored.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="quarry-stored-")
        spark.conf.set("quarry.stored.dir", found)
    return f"{found.rstrip('/')}/quarry-stored"


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _fs(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def _files(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """(name, time, size) of the files below a path; hidden ones and markers do not count."""
    fs, out = _fs(spark, path), []
    if fs.exists(_path(spark, path)):
        found = fs.listFiles(_path(spark, path), True)
        while found.hasNext():
            f = found.next()
            if not f.getPath().getName().startswith(("_", ".")):
                out.append((f.getPath().toString(), f.getModificationTime(), f.getLen()))
    return sorted(out)


def size(spark: SparkSession, paths: list[str]) -> int:
    """Bytes of all files below the paths."""
    return sum(f[2] for p in paths for f in _files(spark, p))


def signature(spark: SparkSession, paths: list[str], definition: str = "") -> str:
    """Names, times and sizes of all files below the paths, and how the table is made of them, as one digest.  Reads no file."""
    listed = [f for p in paths for f in _files(spark, p)]
    return hashlib.sha256(repr((definition, listed)).encode()).hexdigest()


@dataclass(frozen=True)
class Stored:
    """A kept table: its folder, the signature it was built for, and whether it was built just now."""

    folder: str
    signature: str
    built: bool = False


def current(spark: SparkSession, root: str) -> Stored | None:
    """What the pointer names."""
    fs, pointer = _fs(spark, root), _path(spark, f"{root}/{POINTER}")
    if not fs.exists(pointer):
        return None
    stream = fs.open(pointer)
    try:
        sign, folder = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").split("\n")[:2]
    finally:
        stream.close()
    return Stored(f"{root}/{folder}", sign)


def _swap(spark: SparkSession, root: str, text: str) -> None:
    """Writes the pointer beside its place and renames it over the old one in one step."""
    jvm = spark._jvm
    new = _path(spark, f"{root}/.{POINTER}-{uuid.uuid4().hex}")
    out = _fs(spark, root).create(new, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(kind, 1)
    options[0] = kind.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(_fs(spark, root).getUri(), spark._jsc.hadoopConfiguration())
    context.rename(new, _path(spark, f"{root}/{POINTER}"), options)


def ensure(spark: SparkSession, root: str, sign: str, build: Callable[[str], None], force: bool = False) -> Stored:
    """The table of a signature below root; build(folder) writes it if the pointer names another one or none."""
    now = current(spark, root)
    if now and now.signature == sign and not force:
        return now
    folder = f"{sign[:16]}-{uuid.uuid4().hex}"
    build(f"{root}/{folder}")
    _swap(spark, root, f"{sign}\n{folder}\n")
    return Stored(f"{root}/{folder}", sign, True)


def invalidate(spark: SparkSession, root: str) -> None:
    """Forgets what the pointer names; the next ensure() builds."""
    _fs(spark, root).delete(_path(spark, f"{root}/{POINTER}"), False)


def prune(spark: SparkSession, root: str) -> int:
    """Deletes the tables below root that the pointer does not name, and says how many; for when nobody reads them any more."""
    now, fs, n = current(spark, root), _fs(spark, root), 0
    for status in fs.listStatus(_path(spark, root)) if fs.exists(_path(spark, root)) else []:
        name = status.getPath().getName()
        if status.isDirectory() and not (now and now.folder.endswith(f"/{name}")):
            n += fs.delete(status.getPath(), True)
    return n


def status(spark: SparkSession, root: str, sign: str | None = None) -> dict:
    """Whether there is a table, whether it is the one of a signature, and its bytes."""
    now = current(spark, root)
    return {"exists": now is not None, "current": bool(now and sign == now.signature), "bytes": size(spark, [now.folder]) if now else 0}
