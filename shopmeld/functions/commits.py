"""A folder of numbered commits: whoever creates the next number first has committed."""

from __future__ import annotations

import json
import os
import uuid
from typing import Any
from urllib.parse import urlparse

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class CommitLog:
    """Every commit is one small file that holds the whole state, so readers need the newest one only.

    A commit appears with all its content at once and never replaces another: the file is written aside and
    then named by a rename that fails where the name is taken (on a local folder by a hard link). Two writers
    that start from one state want the same next number; one gets it, the other reads the new state and decides.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self._jvm = spark._jvm
        self._gateway = spark.sparkContext._gateway
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._folder = self._jvm.org.apache.hadoop.fs.Path(folder)
        self._fs = self._folder.getFileSystem(self._conf)

    def _path(self, name: str) -> Any:
        return self._jvm.org.apache.hadoop.fs.Path(self._folder, name)

    def newest(self) -> tuple[int, dict]:
        """The number and the state of the newest commit; 0 and an empty state before the first."""
        if not self._fs.exists(self._folder):
            return 0, {}
        names = (str(s.getPath().getName()) for s in self._fs.listStatus(self._folder))
        numbers = [int(name[:-5]) for name in names if name.endswith(".json") and name[:-5].isdigit()]
        if not numbers:
            return 0, {}
        number = max(numbers)
        stream = self._fs.open(self._path(f"{number:010d}.json"))
        try:
            return number, json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def commit(self, number: int, state: dict) -> bool:
        """Create a commit; False where another writer has created that number."""
        aside, final = self._path(f"_{uuid.uuid4().hex}"), self._path(f"{number:010d}.json")
        out = self._fs.create(aside, True)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        try:
            if self._fs.getScheme() == "file":
                try:
                    os.link(urlparse(aside.toUri().toString()).path, urlparse(final.toUri().toString()).path)
                except FileExistsError:
                    return False
                return True
            fs = self._jvm.org.apache.hadoop.fs
            context = fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
            try:
                context.rename(aside, final, self._gateway.new_array(fs.Options.Rename, 0))
            except Py4JJavaError as error:
                if "FileAlreadyExistsException" in error.java_exception.getClass().getName():
                    return False
                raise
            return True
        finally:
            self._fs.delete(aside, False)
