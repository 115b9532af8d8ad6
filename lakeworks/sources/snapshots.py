"""Small numbered documents in a folder: the newest counts, and a number is taken once."""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

from . import files


class Snapshots:
    """``commit`` is a compare-and-set: of two writers that read the same newest number, one succeeds.

    A document is written beside the others and moved to its name, which fails where the name exists, so
    readers never see half of one. That holds on storage whose move is atomic, such as HDFS.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, number: int) -> str:
        return f"{self.folder}/{number:012d}.json"

    def numbers(self) -> list[int]:
        found = files.names(self.spark, self.folder, "")
        return [int(n[:-5]) for n in found if n.endswith(".json") and n[:-5].isdigit()]

    def read(self, number: int) -> dict:
        return json.loads(files.read_text(self.spark, self._path(number)))

    def newest(self) -> tuple[int, dict | None]:
        """Number and document, (0, None) before the first."""
        while numbers := self.numbers():
            try:
                return numbers[-1], self.read(numbers[-1])
            except Py4JJavaError:
                # Pruned since it was listed, if there is a newer one.
                if self.numbers()[-1:] == numbers[-1:]:
                    raise
        return 0, None

    def commit(self, number: int, document: dict) -> bool:
        """Write the document under the number; False if another writer took it."""
        beside = f"{self.folder}/_{uuid.uuid4().hex}"
        files.write_text(self.spark, beside, json.dumps(document))
        if files.move_new(self.spark, beside, self._path(number)):
            return True
        files.delete(self.spark, beside)
        return False

    def prune(self, keep: int) -> list[int]:
        """Delete all but the newest ``keep``; returns the numbers left."""
        numbers = self.numbers()
        for number in numbers[:-keep]:
            files.delete(self.spark, self._path(number))
        return numbers[-keep:]
