"""The change feed: pages after a cursor, a streaming source, and a live view."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import VariantVal

from foldlake.errors import EngineError
from foldlake.functions.codecs import cursor, lsn, parse_cursor
from foldlake.operators.fold import latest
from foldlake.sources.store import Store

PAGE = 1024
#: Rows of one task of the streaming source.
SPAN = 50_000


def since(log: DataFrame, after: int, page: int = PAGE) -> DataFrame:
    """The next ``page`` rows after a number, in order: a top-k, so nothing is sorted whole."""
    return log.filter(F.col("seq") > after).orderBy("seq").limit(page)


def since_page(store: Store, text: str = "", page: int = PAGE) -> tuple[list, str]:
    """(rows, next cursor). An empty page gives the cursor back.

    Without a cursor the page starts at the first row that no snapshot holds. A cursor that is not of this
    generation, also one without any, is an error, as numbers are used anew in another; so
    is one whose row was folded into a snapshot.
    """
    if text:
        parse_cursor(text)
    head = store.head()
    if head is None:
        return [], text
    generation, seq = parse_cursor(text)
    low = head["log_seq_start"]
    if text:
        if (generation or "") != head["generation"]:
            raise EngineError("SchemaError", "the cursor is of another generation; start anew")
        if seq is not None and seq < low:
            raise EngineError("SchemaError", "the cursor's row has been folded into a snapshot; start anew")
        low = low if seq is None else seq + 1
    rows = since(store.log(head, low), low - 1, page).select("seq", "op", "doc_id", "session", "commit_ts", F.to_json("after").alias("after")).collect()
    if not rows:
        return [], text or cursor(head["generation"], None)
    return rows, cursor(head["generation"], lsn(0, rows[-1]["session"], rows[-1]["seq"]))


def long_poll(store: Store, text: str = "", timeout: float = 25.0, interval: float = 0.5, page: int = PAGE, cancelled: Callable[[], bool] = lambda: False) -> tuple[list, str]:
    """The first page that has rows, or, after ``timeout`` seconds or when cancelled, none and the cursor as it was."""
    end = time.monotonic() + timeout
    while True:
        rows, at = since_page(store, text, page)
        left = end - time.monotonic()
        if rows or left <= 0 or cancelled():
            return (rows, at) if rows else ([], text)
        time.sleep(min(interval, left))


class _Span(InputPartition):
    def __init__(self, files: list[str], low: int, high: int):
        self.files, self.low, self.high = files, low, high


class FeedSource(DataSource):
    """``spark.readStream.format("changefeed").option("path", <log folder>)``: rows of log batches in number order.

    Batch names carry their numbers, so offsets come from a listing and each micro-batch reads only the
    batches it needs. The offset holds the generation; another one fails the stream.
    Options: path (the collection's root), maxRows for a micro-batch.
    """

    @classmethod
    def name(cls):
        return "changefeed"

    def schema(self):
        return "seq bigint, op string, doc_id string, commit_ts string, after string"

    def streamReader(self, schema):  # noqa: N802
        return FeedReader(self.options)


class FeedReader(DataSourceStreamReader):
    def __init__(self, options):
        self.root, self.most = options["path"], int(options.get("maxrows", options.get("maxRows", 1 << 40)))
        self.at = None

    def _fs(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.root)

    def _head(self) -> dict:
        import json

        from pyarrow import fs

        where, root = self._fs()
        names = sorted(f.path for f in where.get_file_info(fs.FileSelector(f"{root}/head")) if f.path.endswith(".json"))
        with where.open_input_stream(names[-1]) as f:
            return json.loads(f.read())

    def initialOffset(self):  # noqa: N802
        head = self._head()
        self.at = {"generation": head["generation"], "seq": head["log_delete_floor"]}
        return self.at

    def latestOffset(self):  # noqa: N802
        """At most ``maxRows`` beyond what was read; after a restart Spark tells that by planning the last batch again."""
        head = self._head()
        start = self.at["seq"] if self.at else head["log_delete_floor"]
        return {"generation": head["generation"], "seq": min(head["tail"], start + self.most)}

    def partitions(self, start, end):
        if start["generation"] != end["generation"]:
            raise EngineError("SchemaError", "the stream's cursor is of another generation; start anew")
        self.at = end
        out = []
        for b in self._head()["batches"]:
            low, high = (int(x) for x in b.split("-")[:2])
            low, high = max(low, start["seq"]), min(high, end["seq"])
            # A batch of any size is cut into spans of bounded rows; Parquet statistics skip what a span does not need.
            out += [_Span([b], at, min(high, at + SPAN)) for at in range(low, high, SPAN)]
        return out or [_Span([], 0, 0)]

    def commit(self, end):
        pass

    def read(self, partition):
        import pyarrow.parquet as pq
        from pyarrow import fs

        where, root = self._fs()
        rows = []
        for b in partition.files:
            for f in where.get_file_info(fs.FileSelector(f"{root}/log/{b}")):
                if f.path.endswith(".parquet"):
                    part = pq.ParquetFile(f.path, filesystem=where)
                    place = part.schema_arrow.names.index("seq")
                    for g in range(part.num_row_groups):
                        seen = part.metadata.row_group(g).column(place).statistics
                        if seen is None or not seen.has_min_max or (seen.min < partition.high and seen.max >= partition.low):
                            for chunk in part.iter_batches(2048, [g], ["seq", "op", "doc_id", "commit_ts", "after"]):
                                rows += [r for r in chunk.to_pylist() if partition.low <= r["seq"] < partition.high]
        for r in sorted(rows, key=lambda r: r["seq"]):
            a = r["after"]
            body = VariantVal(a["value"], a["metadata"]).toJson() if a and a["value"] is not None else None
            yield r["seq"], r["op"], r["doc_id"], r["commit_ts"], body


def log_stream(spark: SparkSession, root: str, schema, max_files: int = 100) -> DataFrame:
    """The log folder as a file stream, with bodies: the form for large logs."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).option("recursiveFileLookup", "true").parquet(root)


def live_view(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = True):
    """Start a stream that hands each micro-batch's last row of each document to ``apply``, which must be idempotent by batch id."""

    def each(batch: DataFrame, batch_id: int) -> None:
        apply(latest(batch.filter(F.col("doc_id").isNotNull())), batch_id)

    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


class LiveQueries:
    """Queries that are run again when a collection that they read has changed."""

    def __init__(self):
        self.queries: dict[str, tuple[frozenset[str], Callable[[], object]]] = {}
        self.results: dict[str, object] = {}
        self.states: dict[str, str] = {}

    def add(self, name: str, collections: set[str], run: Callable[[], object] | None) -> None:
        """``run`` None: the query is skipped, as long as its parameters are not known."""
        if run is None:
            self.queries.pop(name, None)
            self.states[name] = "skipped"
            return
        self.queries[name] = (frozenset(collections), run)
        self._run(name)

    def _run(self, name: str) -> None:
        self.states[name] = "refreshing" if name in self.results else "loading"
        try:
            self.results[name] = self.queries[name][1]()
            self.states[name] = "ok"
        except EngineError:
            self.states[name] = "error"

    def changed(self, collection: str) -> list[str]:
        hit = [n for n, (c, _) in self.queries.items() if collection in c]
        for n in hit:
            self._run(n)
        return hit
