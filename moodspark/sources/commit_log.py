"""Version files that several writers may add at once.

A version is one small file, written whole under a temporary name and then published
under the next number only if nobody else has: a hard link on a local file system, a
rename that doesn't overwrite elsewhere (atomic on file systems with a name node;
an object store must be given one that is).  A writer that finds the number taken tries
the next one, so some writer always gets on, and readers never see half a version.
"""

from __future__ import annotations

import os
import re
import uuid
from urllib.parse import quote, unquote

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

_NAME = re.compile(r"^(.+)\.v(\d{12})\.parquet$")


class CommitLog:
    """Files ``<name>.v<number>.parquet`` in one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.jvm = spark._jvm
        self.path = self.jvm.org.apache.hadoop.fs.Path(folder)
        conf = spark._jsparkSession.sessionState().newHadoopConf()
        self.fs = self.path.getFileSystem(conf)
        self.path = self.fs.makeQualified(self.path)
        self.context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.path.toUri(), conf)
        self.local = self.path.toUri().getPath() if self.fs.getScheme() == "file" else None

    def _child(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(self.path, name)

    def versions(self, name: str) -> list[int]:
        """The numbers of ``name``, ascending.  A folder that doesn't exist has none; one
        that holds anything else than versions isn't a log."""
        if not self.fs.exists(self.path):
            return []
        found = []
        for status in self.fs.listStatus(self.path):
            file = status.getPath().getName()
            if file.startswith((".", "_")):
                continue
            m = _NAME.match(file)
            if m is None:
                raise ValueError(f"{self.path.toString()} holds {file}, which is no version file")
            if unquote(m[1]) == name:
                found.append(int(m[2]))
        return sorted(found)

    def _publish(self, hidden: str, public: str) -> bool:
        if self.local is not None:
            try:
                os.link(os.path.join(self.local, hidden), os.path.join(self.local, public))
                return True
            except FileExistsError:
                return False
        no_overwrite = self.jvm.org.apache.hadoop.fs.Options.Rename.NONE
        modes = self.jvm.java.lang.reflect.Array.newInstance(no_overwrite.getClass(), 1)
        modes[0] = no_overwrite
        try:
            self.context.rename(self._child(hidden), self._child(public), modes)
            return True
        except Py4JJavaError as e:
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                return False
            raise

    def append(self, name: str, content) -> int:
        """Adds the bytes ``content(version)`` as the next version of ``name``."""
        version = (self.versions(name) or [0])[-1] + 1
        self.fs.mkdirs(self.path)
        while True:
            hidden = f".{uuid.uuid4().hex}.tmp"
            out = self.fs.create(self._child(hidden), False)
            try:
                out.write(bytearray(content(version)))
            finally:
                out.close()
            done = self._publish(hidden, f"{quote(name, safe='')}.v{version:012d}.parquet")
            if not done or self.local is not None:
                self.fs.delete(self._child(hidden), False)
            if done:
                return version
            version = max((self.versions(name) or [0])[-1], version) + 1
