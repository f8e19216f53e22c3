"""A catalogue of stored indexes: what is in a folder can be opened by name in a later session, with its definitions."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import defs
from ..operators.defs import Facet
from ..operators.index import FacetIndex, read_index
from ..operators.text import TextIndex

_STATUS = "table string, key string, language string, facet_count int, total_documents long, avg_document_length double"


def definition(facet: Facet) -> dict:
    return {"id": facet.id, "name": facet.name, "kind": facet.kind, "column": facet.column, "multi": facet.multi, "parent": facet.parent, "params": facet.params}


def facet_of(d: dict) -> Facet:
    """The facet of a definition. What is made of an expression or another table can be read and counted, but takes changes only if it is given to ``open`` again."""
    number = lambda x: float(x) if "." in x else int(x)
    column, name, parent = d["column"], d["name"], d["parent"]
    known = {
        "plain": lambda: defs.plain(column, name, parent),
        "datetrunc": lambda: defs.datetrunc(column, d["params"]["precision"], name),
        "bucket": lambda: defs.bucket(column, [number(x) for x in d["params"]["buckets"].split(",")], name),
        "array": lambda: defs.array(column, name),
        "boolean": lambda: defs.boolean(column, name),
        "rating": lambda: defs.rating(column, name),
    }
    bare = Facet(name, d["kind"], None, column, d["multi"], parent, d["params"])
    return (known[d["kind"]]() if column and d["kind"] in known else bare).numbered(d["id"])


class Catalog:
    """Tables under path/name: facets, text if there is one, and a definition, written last."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _at(self, name: str = ""):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def save(self, name: str, index: FacetIndex, text: TextIndex | None = None) -> tuple[FacetIndex, TextIndex | None]:
        """Store both under a name, in the place of what it named, and go on from the stored ones."""
        self.drop(name)
        index = index.write(f"{self.path}/{name}/facets")
        text = text.write(f"{self.path}/{name}/text") if text is not None else None
        told = {"table": name, "key": index.key, "facets": [definition(f) for f in index.facets], "text": text is not None}
        self.spark.createDataFrame([(json.dumps(told),)], "definition string").coalesce(1).write.parquet(f"{self.path}/{name}/definition")
        return index, text

    def _definition(self, name: str) -> dict:
        return json.loads(self.spark.read.parquet(f"{self.path}/{name}/definition").first()["definition"])

    def names(self) -> list[str]:
        folder, fs = self._at()
        if not fs.exists(folder):
            return []
        return sorted(n for n in (s.getPath().getName() for s in fs.listStatus(folder)) if self.is_registered(n))

    def is_registered(self, name: str) -> bool:
        path, fs = self._at(f"{name}/definition/_SUCCESS")
        return fs.exists(path)

    def open(self, name: str, *facets: Facet) -> tuple[FacetIndex, TextIndex | None]:
        """The indexes of a name; ``facets`` replace those of their names, for the ones that are made of expressions or other tables."""
        if not self.is_registered(name):
            raise KeyError(f"no table {name}")
        told, given = self._definition(name), {f.name: f for f in facets}
        found = [given[d["name"]].numbered(d["id"]) if d["name"] in given else facet_of(d) for d in told["facets"]]
        index = read_index(self.spark, f"{self.path}/{name}/facets", found, told["key"], name)
        return index, TextIndex.read(self.spark, f"{self.path}/{name}/text") if told["text"] else None

    def drop(self, name: str) -> bool:
        """True also for a name that isn't there."""
        path, fs = self._at(name)
        fs.delete(path, True)
        return True

    def status(self) -> DataFrame:
        """A row for each table; one of nulls if there is none."""
        rows = []
        for name in self.names():
            index, text = self.open(name)
            rows.append((name, index.key, text.analyzer.name if text else None, len(index.facets), *(text.numbers() if text else (None, None))))
        return self.spark.createDataFrame(rows or [(None,) * 6], _STATUS)
