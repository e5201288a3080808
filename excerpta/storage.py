"""Small JSON state on any Hadoop file system: registry, catalogs and manifests, never data."""

from __future__ import annotations

import json
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


KEPT_REVISIONS = 50


class Folder:
    """One root path with the few file operations the library needs."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = str(root).rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def path(self, *parts):
        return "/".join((self.root, *parts))

    def _hadoop(self, *parts):
        return self._jvm.org.apache.hadoop.fs.Path(self.path(*parts))

    def _fs(self):
        return self._hadoop().getFileSystem(self._conf)

    def exists(self, *parts):
        return self._fs().exists(self._hadoop(*parts))

    def names(self, *parts):
        if not self.exists(*parts):
            return []
        return sorted(status.getPath().getName() for status in self._fs().listStatus(self._hadoop(*parts)))

    def listing(self, *parts):
        """(path, size, modification time) of every file below a folder."""
        found, files = [], self._fs().listFiles(self._hadoop(*parts), True)
        while files.hasNext():
            status = files.next()
            found.append((status.getPath().toString(), status.getLen(), status.getModificationTime()))
        return sorted(found)

    def read_json(self, *parts):
        return json.loads(self.read_text(*parts))

    def read_text(self, *parts):
        stream = self._fs().open(self._hadoop(*parts))
        try:
            return bytes(stream.readAllBytes()).decode("utf-8")
        finally:
            stream.close()

    def write_text(self, text, *parts):
        """Write beside the target, then replace it in one step."""
        *folder, name = parts
        beside = (*folder, f".{name}-{uuid.uuid4().hex}")
        stream = self._fs().create(self._hadoop(*beside), True)
        try:
            stream.write(bytearray(text, "utf-8"))
        finally:
            stream.close()
        options = self._jvm.org.apache.hadoop.fs.Options.Rename
        array = self.spark.sparkContext._gateway.new_array(options, 1)
        array[0] = options.OVERWRITE
        self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(
            self._hadoop(*beside).toUri() if self.root.find("://") > 0 else self._fs().getUri(), self._conf
        ).rename(self._fs().makeQualified(self._hadoop(*beside)), self._fs().makeQualified(self._hadoop(*parts)), array)

    def write_json(self, value, *parts):
        self.write_text(json.dumps(value, ensure_ascii=False, sort_keys=True, indent=2) + "\n", *parts)

    def write_new(self, text, *parts) -> bool:
        """Write a file that must not exist; False if it does. Of several callers one gets True, and a reader sees the
        whole text or no file: it is written beside the target, then takes its name.

        HDFS refuses to rename to a name that exists; for the local file system, whose Hadoop client would replace the
        target, a hard link gives the name.
        """
        *folder, name = parts
        beside = (*folder, f".{name}-{uuid.uuid4().hex}")
        stream = self._fs().create(self._hadoop(*beside), True)
        try:
            stream.write(bytearray(text, "utf-8"))
        finally:
            stream.close()
        source, target = (self._fs().makeQualified(self._hadoop(*p)) for p in (beside, parts))
        try:
            if target.toUri().getScheme() != "file":
                return self._fs().rename(source, target)
            path = self._jvm.java.io.File
            self._jvm.java.nio.file.Files.createLink(path(target.toUri().getPath()).toPath(), path(source.toUri().getPath()).toPath())
            return True
        except Py4JJavaError:
            if self.exists(*parts):
                return False
            raise
        finally:
            self.remove(*beside)

    def publish(self, source, target):
        """Rename a finished folder to its final name; an existing target is never replaced."""
        if self.exists(*target):
            raise FileExistsError(self.path(*target))
        self._fs().mkdirs(self._hadoop(*target).getParent())
        if not self._fs().rename(self._hadoop(*source), self._hadoop(*target)):
            raise OSError(f"could not publish {self.path(*target)}")

    def remove(self, *parts):
        self._fs().delete(self._hadoop(*parts), True)


class Revisions:
    """A small JSON value kept as numbered revisions, of which the highest counts.

    A revision is written whole or not at all, and of several writers that make the same one a single one does; the others
    read it and apply their change to it. A writer that dies leaves no revision, or a whole one: nothing to recover.
    """

    def __init__(self, folder: Folder, name: str, empty):
        self.folder, self.name, self.empty = folder, name, empty

    def _latest(self) -> int:
        numbers = [n.removesuffix(".json") for n in self.folder.names(self.name) if n.endswith(".json")]
        return max((int(n) for n in numbers if n.isdigit()), default=0)

    def read(self):
        for _ in range(KEPT_REVISIONS):
            number = self._latest()
            if not number:
                return self.empty() | {"revision": 0}
            try:
                return self.folder.read_json(self.name, f"{number}.json")
            except Py4JJavaError:
                if self._latest() == number:
                    raise
        raise OSError(f"{self.name} changes faster than it can be read")

    def change(self, change, attempts=100):
        """Make ``change`` of the present value the next revision."""
        for attempt in range(attempts):
            value = self.read()
            number = value["revision"] + 1
            updated = {**change(value), "revision": number}
            text = json.dumps(updated, ensure_ascii=False, sort_keys=True, indent=2) + "\n"
            if self.folder.write_new(text, self.name, f"{number}.json"):
                if number > KEPT_REVISIONS:
                    self.folder.remove(self.name, f"{number - KEPT_REVISIONS}.json")
                return updated
            time.sleep(0.05 * (1 + attempt % 10))
        raise OSError(f"{self.name}: {attempts} other changes came first")
