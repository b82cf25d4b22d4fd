"""Stores that change in one step: new files first, then a small file that names them.

A store is a folder with data in folders `version=<id>` and states in
`_states/<number>.json`, each of which names the data that it stands for. Files
are never changed: a commit writes its data, then the next state. A state that
breaks off doesn't count, so whatever ends a commit midway leaves the state
before; and of two commits on one state the later finds its number taken and
fails, or starts again from the other's. Readers of a state keep its data until
`vacuum` has let go of it.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..functions.tables import _file_system


class Conflict(RuntimeError):
    """Somebody else has committed."""


class Versions:
    #: States that a commit leaves behind the new one, for readers.
    KEEP = 2

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.fs, _ = _file_system(spark, self.root)

    def _path(self, rel: str):
        return _file_system(self.spark, f"{self.root}/{rel}")[1]

    def _names(self, rel: str) -> list[str]:
        p = self._path(rel)
        return [s.getPath().getName() for s in self.fs.listStatus(p)] if self.fs.exists(p) else []

    def _state(self, number: int) -> dict | None:
        stream = self.fs.open(self._path(f"_states/{number:012d}.json"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        try:
            found = json.loads(text)
        except ValueError:
            return None
        return found["state"] if found.get("whole") else None

    def numbers(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self._names("_states") if n.endswith(".json"))

    def current(self) -> tuple[int, dict | None]:
        """(number of the last file, state of the last that is whole)."""
        numbers = self.numbers()
        for n in reversed(numbers):
            if (state := self._state(n)) is not None:
                return numbers[-1], state
        return (numbers[-1] if numbers else 0), None

    def commit(self, state: dict, after: int) -> None:
        """The state, unless a number after `after` is taken."""
        at = self._path(f"_states/{after + 1:012d}.json")
        try:
            stream = self.fs.create(at, False)
        except Exception as e:
            if self.fs.exists(at):
                raise Conflict(f"state {after + 1} of {self.root} is taken") from e
            raise
        try:
            stream.write(bytearray(json.dumps({"state": state, "whole": True}, sort_keys=True, default=str).encode()))
        finally:
            stream.close()

    def change(self, fn: Callable[[dict | None], dict], tries: int = 20) -> dict:
        """Commits fn of the current state, again from the new one if somebody else has committed meanwhile."""
        for _ in range(tries):
            number, state = self.current()
            try:
                self.commit(new := fn(state), number)
            except Conflict:
                continue
            self.vacuum()
            return new
        raise Conflict(f"{self.root} has changed {tries} times meanwhile")

    def fresh(self) -> str:
        """A folder for new data, below the store's."""
        return f"version={uuid.uuid4().hex}"

    def parts(self, folder: str) -> dict[str, str]:
        """Partitions that lie in a folder: name=value and where."""
        return {n: f"{folder}/{n}" for n in self._names(folder) if "=" in n}

    def read(self, folders: list[str], schema: StructType) -> DataFrame:
        """The rows of partition folders; partition columns have the types of the schema."""
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.option("basePath", self.root).schema(schema).parquet(*[f"{self.root}/{f}" for f in sorted(folders)]).select(*schema.names)

    def vacuum(self, keep: int | None = None) -> int:
        """Deletes data that none of the last states names, and older states; returns how many folders went."""
        keep = self.KEEP if keep is None else keep
        numbers = self.numbers()
        whole = [n for n in numbers if self._state(n) is not None][-keep:]
        text = "".join(json.dumps(self._state(n)) for n in whole)
        gone = [n for n in self._names("") if n.startswith("version=") and n not in text] if whole else []
        for n in gone:
            self.fs.delete(self._path(n), True)
        for n in numbers:
            if whole and n < whole[0]:
                self.fs.delete(self._path(f"_states/{n:012d}.json"), False)
        return len(gone)
