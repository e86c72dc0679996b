"""Where tables live: bucket addresses, the head record, the log and snapshots on any Hadoop file system.

A commit appends one Parquet batch of log rows with contiguous numbers and then creates the head's
next version, which no file system lets two writers do; the one that comes second takes its
batch back and raises a retriable ``Conflict``. A commit carries a token, which the head keeps for a while: a
commit that is tried again after its answer was lost finds its own entry and returns that. Readers take the newest
head, so they see whole batches or none of them.

A snapshot is a folder of Parquet files named by the SHA-256 of its files' SHA-256 sums; it is checked
once, before a store first reads it.
"""

from __future__ import annotations

import hashlib
import json
import os
import random
import re
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from typing import TypeVar
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldlake.errors import EngineError
from foldlake.operators import fold as folding
from foldlake.operators.snapshots import PROFILES, Profile, assert_head_step, compact_decision, pass_steps, snapshot_key

LOG = T.StructType(
    [
        T.StructField("collection", T.StringType()),
        T.StructField("seq", T.LongType()),
        T.StructField("commit_ts", T.StringType()),
        T.StructField("op", T.StringType()),
        T.StructField("doc_id", T.StringType()),
        T.StructField("session", T.StringType()),
        T.StructField("after", T.VariantType()),
    ]
)
SNAPSHOT = T.StructType([T.StructField("_id", T.StringType()), T.StructField("body", T.VariantType())])


@dataclass(frozen=True)
class Bucket:
    scheme: str
    bucket: str
    prefix: str

    def path(self) -> str:
        """Address that Spark's readers take."""
        if self.scheme == "file":
            return "file:///" + self.prefix.lstrip("/")
        names = {"s3": "s3a", "r2": "s3a", "minio": "s3a", "gcs": "gs", "gs": "gs"}
        return f"{names[self.scheme]}://{self.bucket}/{self.prefix}".rstrip("/")


def parse_bucket(uri: str) -> Bucket:
    """``s3://b/p``, ``gcs://b/p``, ``file:///p`` or ``memory://name`` (a folder under /tmp, for tests)."""
    u = urlparse(uri)
    if u.scheme == "memory":
        return Bucket("file", "", f"/tmp/foldlake-memory/{u.netloc or 'default'}{u.path}".rstrip("/"))
    if u.scheme == "file" and not u.netloc and u.path.startswith("/"):
        return Bucket("file", "", u.path.rstrip("/"))
    if u.scheme in ("s3", "r2", "minio", "gcs", "gs") and u.netloc:
        return Bucket(u.scheme, u.netloc, u.path.strip("/"))
    raise EngineError("InvalidConfig", f"not a bucket address: {uri!r}")


NAME = re.compile(r"[^/\x00-\x1f\x7f_][^/\x00-\x1f\x7f]*\Z")


#: Head versions that stay for readers that have just listed them, and commit tokens that a head keeps.
KEEP_HEADS = 32
KEEP_TOKENS = 64
OBJECT_STORES = ("s3a", "gs", "abfs", "abfss")
Result = TypeVar("Result")


def scratch(spark: SparkSession, name: str) -> str:
    """The address of a fresh folder in ``spark.checkpoint.dir``, deleted when the driver's JVM ends; under /tmp for a local session without one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise EngineError("InvalidConfig", "spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = f"file:///tmp/foldlake-scratch-{os.getpid()}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}")
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(path)
    files.deleteOnExit(path)
    return files.makeQualified(path).toString()


def retrying(run: Callable[[], Result], attempts: int = 6, base: float = 0.05, most: float = 2.0, sleep: Callable[[float], None] = time.sleep) -> Result:
    """``run()``, again after a retriable error; waits are drawn from 0 to a bound that doubles."""
    for attempt in range(attempts):
        try:
            return run()
        except EngineError as e:
            if not e.retriable or attempt == attempts - 1:
                raise
            sleep(random.uniform(0, min(most, base * 2**attempt)))
    raise EngineError("InvalidConfig", "at least one attempt")


class Files:
    """The few file operations that need the driver."""

    def __init__(self, spark: SparkSession, root: str):
        jvm = self._jvm = spark.sparkContext._jvm
        self._gateway, self._conf = spark.sparkContext._gateway, spark.sparkContext._jsc.hadoopConfiguration()
        self.Path, self.root = jvm.org.apache.hadoop.fs.Path, root.rstrip("/")
        self.fs = self.Path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._utils = jvm.org.apache.commons.io.IOUtils

    def _at(self, key: str):
        return self.Path(f"{self.root}/{key}" if key else self.root)

    def exists(self, key: str) -> bool:
        return self.fs.exists(self._at(key))

    def list(self, key: str) -> list[str]:
        """Names in a folder, in UTF-8 order."""
        p = self._at(key)
        return sorted((s.getPath().getName() for s in self.fs.listStatus(p)), key=str.encode) if self.fs.exists(p) else []

    def read(self, key: str) -> bytes:
        stream = self.fs.open(self._at(key))
        try:
            return bytes(self._utils.toByteArray(stream))
        finally:
            stream.close()

    def create(self, key: str, data: bytes) -> bool:
        """Write a file that is not there yet, whole or not at all; false if it is there."""
        from py4j.protocol import Py4JJavaError

        target = self._at(key)
        if self.fs.exists(target):
            return False
        if self.fs.getScheme() in OBJECT_STORES:  # whose rename replaces; they create on condition
            try:
                out = self.fs.createFile(target).overwrite(False).opt("fs.option.create.conditional.overwrite", "true").build()
                out.write(bytearray(data))
                out.close()
                return True
            except Py4JJavaError:
                return False
        temp = self._at(f"{key}.{uuid.uuid4().hex}.tmp")
        out = self.fs.create(temp, False)
        try:
            out.write(bytearray(data))
        finally:
            out.close()
        # Without an option to overwrite, this rename fails if the target is there.
        none = self._gateway.new_array(getattr(self._jvm, "org.apache.hadoop.fs.Options$Rename"), 0)
        try:
            self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self._conf).rename(temp, target, none)
            return True
        except Py4JJavaError:
            self.fs.delete(temp, False)
            return False

    def move(self, key: str, to: str) -> None:
        self.fs.mkdirs(self._at(to).getParent())
        if not self.fs.rename(self._at(key), self._at(to)):
            raise EngineError("NetworkError", f"cannot move {key!r}", retriable=True)

    def size(self, key: str) -> int:
        return self.fs.getContentSummary(self._at(key)).getLength()

    def delete(self, key: str) -> None:
        self.fs.delete(self._at(key), True)


def snapshot_digest(name: str) -> str:
    return name.rpartition("-")[2].partition(".")[0]


def _address(root: str) -> str:
    """A bucket address as Spark takes it, any other address that Spark knows as it is, and a path as a local file's."""
    if re.match(r"(s3|r2|minio|gcs|gs|memory)://|file:///", root):
        return parse_bucket(root).path()
    return root.rstrip("/") if re.match(r"[a-z][a-z0-9+.-]+:/", root) else f"file://{root}"


class Store:
    """One collection: head, log batches and snapshots under ``app=…/tenant=…/<name>``."""

    def __init__(self, spark: SparkSession, root: str, name: str, app: str = "app", tenant: str = "main"):
        if not NAME.match(name) or len(name.encode()) > 256:
            raise EngineError("InvalidConfig", f"bad collection name {name!r}")
        base = _address(root)
        self.spark, self.name = spark, name
        self.root = f"{base}/app={app}/tenant={tenant}/{name}"
        self.files = Files(spark, self.root)
        self._checked: set[str] = set()

    def head(self) -> dict | None:
        """The newest head; None if the collection was never written."""
        names = [n for n in self.files.list("head") if re.fullmatch(r"\d{20}\.json", n)]
        return json.loads(self.files.read(f"head/{names[-1]}")) if names else None

    def _advance(self, old: dict | None, **changes) -> dict:
        base = old or {"version": 0, "snapshot": None, "tail": 0, "log_seq_start": 0, "log_delete_floor": 0, "generation": uuid.uuid4().hex[:12], "snapshot_bytes": 0, "snapshot_rows": 0, "batches": []}
        new = {**base, **changes, "version": base["version"] + 1}
        if old and new["generation"] == old["generation"]:
            assert_head_step(old, new)
        if not self.files.create(f"head/{new['version']:020d}.json", json.dumps(new).encode()):
            raise EngineError("Conflict", "another writer committed first", retriable=True)
        if new["version"] > KEEP_HEADS:
            self.files.delete(f"head/{new['version'] - KEEP_HEADS:020d}.json")
        return new

    def append(self, rows: DataFrame, session: str | None = None, token: str | None = None, head: dict | None = None) -> tuple[int, int]:
        """Commit (op, doc_id, after VARIANT) rows; returns [from, to) of their numbers.

        Numbers follow the rows' partitions: counts of each partition come first, so that no
        row passes through one task. A ``token`` that a commit had before gives that commit's numbers. With a
        ``head`` that the rows were made from, the commit loses to any that came after it.
        """
        token, newest = token or uuid.uuid4().hex, self.head()
        if newest and token in newest.get("commits", {}):
            return tuple(newest["commits"][token])
        head = head or newest
        start = head["tail"] if head else 0
        stamp = time.strftime("%Y-%m-%dT%H:%M:%S", time.gmtime()) + f".{int(time.time() * 1000) % 1000:03d}Z"
        session = session or uuid.uuid4().hex[:6]
        staged = f"{self.root}/staged/{uuid.uuid4().hex}"
        place = F.monotonically_increasing_id()
        rows.select("op", "doc_id", "after", place.alias("_place")).write.parquet(staged)
        kept = self.spark.read.parquet(staged)
        parts = kept.groupBy(F.shiftright("_place", 33).alias("p")).agg(F.count(F.lit(1)).alias("n")).orderBy("p").collect()  # one row a partition
        total = sum(r.n for r in parts)
        if not total:
            self.files.delete(staged[len(self.root) + 1 :])
            return start, start
        offsets, at = [], start
        for r in parts:
            offsets.append((r.p, at))
            at += r.n
        low = self.spark.createDataFrame(offsets, "p bigint, o bigint")
        rank = F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
        out = kept.withColumn("p", F.shiftright("_place", 33)).join(low, "p").select(
            F.lit(self.name).alias("collection"), (F.col("o") + rank).alias("seq"), F.lit(stamp).alias("commit_ts"), "op", "doc_id", F.lit(session).alias("session"), "after"
        )
        batch = f"{start:016d}-{at:016d}-{uuid.uuid4().hex[:8]}"
        # Log bodies are not shredded, so that readers other than Spark find them whole.
        shred = "spark.sql.variant.inferShreddingSchema"
        before = self.spark.conf.get(shred)
        self.spark.conf.set(shred, "false")
        try:
            out.write.parquet(f"{self.root}/log/{batch}")
        finally:
            self.spark.conf.set(shred, before)
        self.files.delete(staged[len(self.root) + 1 :])
        batches = (head["batches"] if head else []) + [batch]
        commits = dict([*(head.get("commits", {}) if head else {}).items(), (token, [start, at])][-KEEP_TOKENS:])
        try:
            self._advance(head, tail=at, batches=batches, commits=commits)
        except EngineError as e:
            if e.code == "Conflict":
                self.files.delete(f"log/{batch}")
            raise
        return start, at

    def log(self, head: dict | None = None, since: int | None = None) -> DataFrame:
        """Committed log rows; batches that end at or before ``since`` are not read."""
        head = head or self.head()
        names = [b for b in (head["batches"] if head else []) if since is None or int(b.split("-")[1]) > since]
        if not names:
            return self.spark.createDataFrame([], LOG)
        rows = self.spark.read.schema(LOG).parquet(*[f"{self.root}/log/{b}" for b in names])
        return rows if since is None else rows.filter(F.col("seq") >= since)

    def snapshot(self, head: dict | None, check: bool = True) -> DataFrame | None:
        """The head's snapshot; an error if its files are not those that its name was made from."""
        if not head or not head["snapshot"]:
            return None
        name = head["snapshot"]
        if check and name not in self._checked:
            if self._digest(name) != snapshot_digest(name):
                raise EngineError("Internal", f"snapshot {name!r} is damaged")
            self._checked.add(name)
        return self.spark.read.schema(SNAPSHOT).parquet(f"{self.root}/{name}")

    def _digest(self, folder: str) -> str:
        """SHA-256 of the sorted SHA-256 sums of a folder's Parquet files, which the executors make."""
        from foldlake.operators.maintenance import file_sums

        names = [n for n in self.files.list(folder) if n.endswith(".parquet")]
        if not names:
            return ""
        sums = file_sums(self.spark.read.format("binaryFile").load([f"{self.root}/{folder}/{n}" for n in names]))
        return hashlib.sha256("".join(sorted(r.sum for r in sums.collect())).encode()).hexdigest()  # one row a file

    def _write_snapshot(self, rows: DataFrame, low: int, high: int) -> dict:
        """Write (_id, body) rows as a snapshot named by its content; the head's fields for it."""
        staged = f"staged/{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.root}/{staged}")
        name = snapshot_key(low, high, self._digest(staged))
        if self.files.exists(name):
            self.files.delete(staged)
        else:
            self.files.move(staged, name)
        self._checked.add(name)
        n = self.spark.read.schema(SNAPSHOT).parquet(f"{self.root}/{name}").count()
        return {"snapshot": name, "snapshot_rows": n, "snapshot_bytes": self.files.size(name)}

    def view(self, head: dict | None = None) -> DataFrame:
        head = head or self.head()
        if head is None:
            return self.spark.createDataFrame([], SNAPSHOT)
        return folding.fold(self.log(head, head["log_seq_start"]), self.snapshot(head))

    def compact(self, least: int = 1, most: int = 1 << 60) -> str:
        """Fold the log into the next snapshot and move the head; why not, if it was not done."""
        head = self.head()
        reason, end = compact_decision(head, head["tail"] if head else 0, least, most)
        if reason != "ok":
            return reason
        log = self.log(head, head["log_seq_start"])
        made = self._write_snapshot(folding.compact(log, self.snapshot(head), end), head["log_seq_start"], end - 1)
        try:
            self._advance(head, log_seq_start=end, **made)
        except EngineError as e:
            if e.code != "Conflict":
                raise
            if made["snapshot"] != head["snapshot"]:
                self.files.delete(made["snapshot"])
            return "lost-race"
        return "ok"

    def maintain(self, profile: Profile = PROFILES["cluster"], entry_bytes: int = 1024, before: int | None = None, now: str | None = None, least: int = 1, most: int = 1 << 60) -> list[str]:
        """Run a pass after commits moved the tail on from ``before``; the names of the steps that were done.

        A fold takes the whole log, as it is distributed, and garbage collection and retention do all that is due. A
        profile with ceilings defers the fold of a larger snapshot; ``compact`` and a pass without ceilings make it up.
        """
        head, done = self.head(), []
        if head is None:
            return done
        for step in pass_steps(head, head["tail"], entry_bytes, profile, before):
            if step == "fold":
                done.append(f"fold:{self.compact(least, most)}")
            elif step == "gc":
                done.append(f"gc:{self.collect_garbage(now)}")
            elif step == "retention":
                low, high = self.retire()
                done.append(f"retention:{high - low}")
            else:
                done.append(step)
        return done

    def snapshot_files(self) -> DataFrame:
        """(key) of all snapshots in the store."""
        names = [(f"snapshot/L9/{n}",) for n in self.files.list("snapshot/L9")]
        return self.spark.createDataFrame(names, "key string")

    def collect_garbage(self, now: str | None = None) -> int:
        """Mark snapshots that the head no longer names, sweep those whose time has come; how many went.

        The ledger of candidates is a field of the head, so a pass that lost a race has marked nothing. It takes
        all candidates: like the list of the store's snapshots, it is a row a snapshot.
        """
        from foldlake.operators import maintenance as M

        head = self.head()
        at = F.lit(now).cast("timestamp") if now else F.current_timestamp()
        ledger = self.spark.createDataFrame([tuple(x) for x in head.get("gc", [])], "key string, due string, reason string, generation string")
        ledger = ledger.select("key", F.col("due").cast("timestamp").alias("due_at"), "reason", "generation")
        due, stays = M.sweep(M.classify_candidates(ledger, head["generation"], head["snapshot"], head["log_seq_start"], at), most=None)
        gone = [r.key for r in due.collect()]
        marks = M.mark_orphans(self.snapshot_files(), head["snapshot"], ledger, at, head["generation"], most=None)
        kept = M.merge_ledger(stays, marks, cap=None).select("key", F.col("due_at").cast("string"), "reason", "generation").collect()
        self._advance(head, gc=[list(r) for r in kept])
        for key in gone:
            self.files.delete(key)
        return len(gone)

    def retire(self, retain: int = 1024, step: int = 1 << 60) -> tuple[int, int]:
        """Publish the new delete floor, then delete batches wholly below it."""
        from foldlake.operators.maintenance import retention_range

        head = self.head()
        low, high = retention_range(head["log_delete_floor"], head["log_seq_start"], retain, step)
        gone = [b for b in head["batches"] if int(b.split("-")[1]) <= high]
        self._advance(head, log_delete_floor=high, batches=[b for b in head["batches"] if b not in gone])
        for b in gone:
            self.files.delete(f"log/{b}")
        return low, high

    def reseed(self, rows: DataFrame) -> None:
        """Replace all by (_id, body) rows under a new generation; old cursors are dead."""
        head = self.head()
        start = head["tail"] if head else 0
        made = self._write_snapshot(rows.select("_id", "body").sortWithinPartitions("_id"), 0, max(0, start - 1))
        old = head["batches"] if head else []
        self._advance(head, generation=uuid.uuid4().hex[:12], log_seq_start=start, log_delete_floor=start, batches=[], gc=[], **made)
        for b in old:  # no cursor of the new generation reaches them
            self.files.delete(f"log/{b}")
