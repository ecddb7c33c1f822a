"""Small files and whole folders in any store that Spark reaches, by Hadoop's file systems: listings, texts, and moves into place."""

from __future__ import annotations

import fnmatch
import json
import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Entry:
    """A file or folder of a listing."""

    path: str
    name: str
    size: int
    is_folder: bool


class Store:
    """Paths are URIs; without a scheme they are of the session's default file system."""

    def __init__(self, spark: SparkSession) -> None:
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def _at(self, path: str):
        at = self._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self._conf), at

    def exists(self, path: str) -> bool:
        fs, at = self._at(path)
        return fs.exists(at)

    def listing(self, folder: str, pattern: str = "*") -> list[Entry]:
        """What lies in a folder under names that fit the pattern, by name; nothing if there is no such folder."""
        fs, at = self._at(folder)
        if not fs.exists(at):
            return []
        found = [Entry(s.getPath().toString(), s.getPath().getName(), s.getLen(), s.isDirectory()) for s in fs.listStatus(at)]
        return sorted((e for e in found if fnmatch.fnmatchcase(e.name, pattern)), key=lambda e: e.name)

    def read(self, path: str) -> str:
        fs, at = self._at(path)
        stream = fs.open(at)
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, path: str, text: str) -> None:
        """The whole file or none of it: it is written beside its place, then moved there."""
        beside = f"{path}.{uuid.uuid4().hex}.tmp"
        fs, at = self._at(beside)
        stream = fs.create(at, True)
        try:
            stream.write(bytearray(text, "utf-8"))
        finally:
            stream.close()
        self.replace(beside, path)

    def replace(self, source: str, target: str) -> None:
        """Move a file or folder to a place, which is emptied first."""
        fs, to = self._at(target)
        self.delete(target)
        if to.getParent() is not None:
            fs.mkdirs(to.getParent())
        if not fs.rename(self._at(source)[1], to):
            raise OSError(f"{source} can't be moved to {target}")

    def delete(self, path: str) -> None:
        fs, at = self._at(path)
        fs.delete(at, True)


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path where all executors can write and read: in that of checkpoints, or a temporary one of a local master's."""
    sc = spark.sparkContext
    at = sc._jsc.sc().getCheckpointDir()
    shared = at.get() if at.isDefined() else spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="quillspan-")
    return f"{shared}/{name}-{uuid.uuid4().hex}"


def beside(output: str, kind: str) -> str:
    """The path of a run's file of some kind, such as its summary, beside its output."""
    folder, _, name = output.rpartition("/")
    stem = name.rsplit(".", 1)[0] if "." in name else name
    return f"{folder}/{stem}.{kind}.json" if folder else f"{stem}.{kind}.json"


def written_files(store: Store, output: str) -> list[dict]:
    return [{"name": e.name, "size": e.size} for e in store.listing(output) if not e.is_folder and not e.name.startswith(("_", "."))]


def committed(store: Store, output: str) -> bool:
    """Whether an output is whole: it has its summary, which comes last, and the files that its manifest lists."""
    if not (store.exists(output) and store.exists(beside(output, "summary")) and store.exists(beside(output, "manifest"))):
        return False
    try:
        return json.loads(store.read(beside(output, "manifest")))["files"] == written_files(store, output)
    except (ValueError, KeyError):
        return False


def commit(store: Store, output: str, write, summarise) -> dict:
    """Write an output, then its manifest, then its summary, each moved into its place; what was there of an earlier run goes first.

    write(path) writes the rows to a staging folder; summarise(path) makes the summary of what it wrote. A run that is killed leaves
    no summary, and so counts as not done, and at most a staging folder, which the next run of the same output removes.
    """
    folder, _, name = output.rpartition("/")
    folder = folder or "."
    for stale in store.listing(folder, f"_{name}.staging-*"):
        store.delete(stale.path)
    for kind in ("summary", "manifest"):
        store.delete(beside(output, kind))
    staging = f"{folder}/_{name}.staging-{uuid.uuid4().hex}"
    write(staging)
    store.replace(staging, output)
    summary = summarise(output)
    store.write(beside(output, "manifest"), json.dumps({"files": written_files(store, output)}))
    store.write(beside(output, "summary"), json.dumps(summary, indent=2, ensure_ascii=False))
    return summary
