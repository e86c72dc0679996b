"""A stored collection: queries over its view, and mutations that append to its log.

A bulk update or delete is one batch: all of its rows are committed or none. Every update row
holds the whole document after it.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldlake.errors import EngineError
from foldlake.functions.codecs import uuid7
from foldlake.operators.patch import merge_patch, patch_json
from foldlake.operators.query import Query
from foldlake.sources.ndjson import MAX_ID_BYTES, id_ok, read_ndjson, write_ndjson
from foldlake.sources.store import NAME, Store, retrying


class Collection:
    """``schema``: a function from a document to issues, or from the JSON text column to an issues column."""

    def __init__(self, store: Store, schema: Callable[[dict], list[str]] | None = None):
        self.store, self.schema, self.spark = store, schema, store.spark

    def query(self) -> Query:
        return Query(self.store.view(), "_id", "body")

    def where(self, predicate) -> Query:
        return self.query().where(predicate)

    def order(self, spec: dict[str, str]) -> Query:
        return self.query().order(spec)

    def limit(self, n: int) -> Query:
        return self.query().limit(n)

    def all(self) -> DataFrame:
        return self.query().all()

    def first(self) -> DataFrame:
        return self.query().first()

    def count(self) -> int:
        return self.query().count()

    def get(self, doc_id: str) -> dict | None:
        row = self.query().get(doc_id).select(F.to_json("body").alias("b")).first()
        return json.loads(row.b) if row else None

    def _check(self, documents: Iterable[dict]) -> None:
        if self.schema is None:
            return
        issues = [i for d in documents for i in self.schema(d)]
        if issues:
            raise EngineError("SchemaError", f"{len(issues)} issues", issues)

    def _commit(self, rows: list[tuple[str, str, str | None]], head: dict | None, token: str) -> None:
        df = self.spark.createDataFrame(rows, "op string, doc_id string, text string").coalesce(1)
        self.store.append(df.select("op", "doc_id", F.parse_json("text").alias("after")), token=token, head=head)

    def _attempt(self, run: Callable[[dict | None, str], dict]) -> dict:
        """Try a mutation until it wins: each time it looks at the newest head, and the commit loses to any later one.

        All tries have one token: a commit whose answer was lost is found, and its result returned.
        """
        token, last = uuid.uuid4().hex, {}

        def once() -> dict:
            head = self.store.head()
            if last and head and token in head.get("commits", {}):
                return last
            last.clear()
            last.update(run(head, token))
            return dict(last)

        return retrying(once)

    def _found(self, head: dict | None, doc_id: str) -> dict | None:
        if head is None:
            return None
        row = Query(self.store.view(head), "_id", "body").get(doc_id).select(F.to_json("body").alias("b")).first()
        return json.loads(row.b) if row else None

    def insert(self, document: dict) -> dict:
        doc_id = document.get("_id") or uuid7()
        if not isinstance(doc_id, str) or not NAME.match(doc_id) or len(doc_id.encode("utf-8", "surrogatepass")) > MAX_ID_BYTES:
            raise EngineError("InvalidConfig", f"bad document id {doc_id!r}")
        document = {**document, "_id": doc_id}
        self._check([document])

        def run(head, token):
            if self._found(head, doc_id) is not None:
                raise EngineError("Conflict", f"{doc_id!r} exists")
            self._commit([("I", doc_id, json.dumps(document))], head, token)
            return {"_id": doc_id}

        return self._attempt(run)

    def _check_frame(self, rows: DataFrame, text: Column) -> None:
        if self.schema is None:
            return
        bad = rows.select(validator(self.schema)(text).alias("issues")).filter(F.size("issues") > 0).limit(20).collect()
        if bad:
            raise EngineError("SchemaError", f"{len(bad)} documents or more would be invalid", [i for r in bad for i in r.issues])

    def conflicts(self, rows: DataFrame, head: dict | None = None) -> DataFrame:
        """(_id) of (_id, …) rows that the collection has already, or that are there twice."""
        twice = rows.groupBy("_id").count().filter("count > 1").select("_id")
        known = self.store.view(head).select("_id")
        return rows.select("_id").join(known, "_id", "left_semi").unionAll(twice).distinct()

    def insert_frame(self, rows: DataFrame) -> dict:
        """Insert (_id, body) rows in one batch; no id may be bad, exist or be twice, and every body must pass the schema.

        Bodies are stored as they are given.
        """
        if rows.filter(~id_ok(F.col("_id"))).limit(1).count():
            raise EngineError("InvalidConfig", "a document id is missing or bad")
        if rows.filter(F.col("body").isNull() | ~F.startswith(F.schema_of_variant("body"), F.lit("OBJECT"))).limit(1).count():
            raise EngineError("SchemaError", "a document is no object")
        self._check_frame(rows, F.to_json("body"))

        def run(head, token):
            if self.conflicts(rows, head).limit(1).count():
                raise EngineError("Conflict", "an id exists or is there twice")
            low, high = self.store.append(rows.select(F.lit("I").alias("op"), F.col("_id").alias("doc_id"), F.col("body").alias("after")), token=token, head=head)
            return {"inserted": high - low}

        return self._attempt(run)

    def update(self, doc_id: str, patch: dict) -> dict:
        def run(head, token):
            found = self._found(head, doc_id)
            if found is None:
                return {"modified": 0}
            new = merge_patch(found, patch)
            self._check([new])
            self._commit([("U", doc_id, json.dumps(new))], head, token)
            return {"modified": 1}

        return self._attempt(run)

    def _matching(self, head: dict | None, predicate) -> DataFrame:
        return Query(self.store.view(head), "_id", "body").where(predicate).all()

    def update_where(self, predicate, patch: dict) -> dict:
        def run(head, token):
            rows = self._matching(head, predicate).select("_id", patch_json(F.to_json("body"), patch).alias("text"))
            self._check_frame(rows, F.col("text"))
            low, high = self.store.append(rows.select(F.lit("U").alias("op"), F.col("_id").alias("doc_id"), F.parse_json("text").alias("after")), token=token, head=head)
            return {"modified": high - low}

        return self._attempt(run)

    def replace(self, doc_id: str, document: dict) -> dict:
        document = {**document, "_id": doc_id}
        self._check([document])

        def run(head, token):
            if self._found(head, doc_id) is None:
                raise EngineError("NotFound", f"no document {doc_id!r}")
            self._commit([("U", doc_id, json.dumps(document))], head, token)
            return {"modified": 1}

        return self._attempt(run)

    def delete(self, doc_id: str) -> dict:
        def run(head, token):
            if self._found(head, doc_id) is None:
                return {"deleted": 0}
            self._commit([("D", doc_id, None)], head, token)
            return {"deleted": 1}

        return self._attempt(run)

    def delete_where(self, predicate) -> dict:
        def run(head, token):
            rows = self._matching(head, predicate).select(F.lit("D").alias("op"), F.col("_id").alias("doc_id"), F.lit(None).cast("variant").alias("after"))
            low, high = self.store.append(rows, token=token, head=head)
            return {"deleted": high - low}

        return self._attempt(run)

    def restore(self, path: str, force: bool = False) -> None:
        """Load NDJSON. Into a collection that has been written only with ``force``, which starts a new generation."""
        rows = read_ndjson(self.spark, path)
        if rows.groupBy("_id").count().filter("count > 1").limit(1).count():
            raise EngineError("SchemaError", "an id is there twice")
        if self.store.head() is None:
            self.store.append(rows.select(F.lit("I").alias("op"), F.col("_id").alias("doc_id"), F.col("body").alias("after")))
        elif force:
            self.store.reseed(rows)
        else:
            raise EngineError("Conflict", "the collection is not empty")

    def dump(self, path: str) -> None:
        write_ndjson(self.store.view(), path)


def validator(schema: Callable[[dict], list[str]]):
    """A validator as a function of a JSON text column, in Arrow batches."""
    import pandas as pd

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [str(i) for i in schema(json.loads(t))])

    run.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "array<string>")


def rule_issues(rules: dict[str, tuple[str, Any]]):
    """A validator as column expressions over typed columns: {path: (message, condition)} to an array of issues."""
    issues = [F.when(~F.coalesce(cond, F.lit(False)), F.struct(F.split(F.lit(path), r"\.").alias("path"), F.lit(message).alias("message"))) for path, (message, cond) in rules.items()]
    return F.filter(F.array(*issues), lambda x: x.isNotNull())
