"""Token IDs in sorted-string-table shards.

File format (integers little-endian unless said; varints are LEB128):

    block*  zstd frame of entries; entry: varint shared, varint unshared, varint values,
            key suffix, values as 16- or 32-bit ids (the footer's width)
    index   for each block: varint length of first key, first key, u64 offset, u32 stored
            bytes, u32 plain bytes, u32 crc32 of the stored bytes, u64 ids before the block
    bloom   bit array
    footer  u64 index offset, u64 bloom offset, u32 bloom bits, u32 hashes, u32 blocks,
            u32 id width in bytes, u64 entries, u64 ids, 8-byte magic

Keys are a document's id: byte 0 for null, else byte 1 and eight big-endian bytes with the sign
flipped, so that byte order is id order. Each key drops the prefix that it shares with the key
before it; a block starts with a whole key. A lookup asks the Bloom filter, finds the block by
binary search in the index and reads that block only.

Building: documents are ranged by id, sorted within ranges, and each task encodes its texts and
writes one shard to the shared folder under a name of its own try; a manifest row is returned
for it, so files of tries that were lost are never read. Reading streams block by block.

Defined cases: a null text is the empty text: the end id alone; a null id comes before all
others; rows with one id are separate entries, ordered by the first 64 characters of the text and
then by its hash, and may lie in several shards; equal rows are entries of their own; an empty
table gives no shard and no row; a text of any length is one entry, held whole by its task;
columns other than the id and the text are ignored, whatever their names. The string of a special
token in a text is that token, as the library's own call gives it.
"""

from __future__ import annotations

import bisect
import json
import os
import re
import struct
import uuid
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldlake.llm.common import batched, documents, new_folder, saved, text_of

MAGIC = b"SSTIDS01"
FOOTER = struct.Struct("<QQIIIIQQ8s")
BLOCK = 1 << 18
HASHES = 7
BITS_PER_KEY = 10
END = 0


def key_of(doc_id: int | None) -> bytes:
    return b"\0" if doc_id is None else b"\1" + (int(doc_id) + (1 << 63)).to_bytes(8, "big")


def id_of(key: bytes) -> int | None:
    return None if key[0] == 0 else int.from_bytes(key[1:], "big") - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(b: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        x = b[at]
        at += 1
        n |= (x & 127) << shift
        if x < 128:
            return n, at
        shift += 7


def _bloom_bits(key: bytes, bits: int, hashes: int) -> list[int]:
    a, b = crc32(key), crc32(key, 0x9E3779B9) | 1
    return [(a + i * b) % bits for i in range(hashes)]


class Writer:
    """Writes entries, given in key order, to a binary file object."""

    def __init__(self, out, width: int = 2, block: int = BLOCK):
        self.out, self.width, self.block = out, width, block
        self.codec = pa.Codec("zstd", 1)
        self.plain, self.index, self.keys = bytearray(), [], []
        self.last, self.first, self.at, self.entries, self.ids, self.before = b"", None, 0, 0, 0, 0

    def add(self, key: bytes, values: bytes) -> None:
        """``values``: ids in the file's width."""
        if self.first is None:
            self.first, self.last, self.before = key, b"", self.ids
        shared = len(os.path.commonprefix([self.last, key]))
        count = len(values) // self.width
        self.plain += _varint(shared) + _varint(len(key) - shared) + _varint(count) + key[shared:]
        self.plain += values
        self.last = key
        self.keys.append(key)
        self.entries += 1
        self.ids += count
        if len(self.plain) >= self.block:
            self._flush()

    def _flush(self) -> None:
        if self.first is None:
            return
        stored = self.codec.compress(bytes(self.plain), asbytes=True)
        self.index.append((self.first, self.at, len(stored), len(self.plain), crc32(stored), self.before))
        self.out.write(stored)
        self.at += len(stored)
        self.plain, self.first = bytearray(), None

    def close(self) -> None:
        self._flush()
        index = b"".join(_varint(len(k)) + k + struct.pack("<QIIIQ", *rest) for k, *rest in self.index)
        bits = max(64, len(self.keys) * BITS_PER_KEY)
        bloom = np.zeros(bits, bool)
        for k in self.keys:
            bloom[_bloom_bits(k, bits, HASHES)] = True
        packed = np.packbits(bloom, bitorder="little").tobytes()
        self.out.write(index + packed)
        self.out.write(FOOTER.pack(self.at, self.at + len(index), bits, HASHES, len(self.index), self.width, self.entries, self.ids, MAGIC))


class Reader:
    """Reads a shard from a seekable file object. Holds the index, the filter and one block."""

    def __init__(self, file):
        self.file, self.codec = file, pa.Codec("zstd")
        file.seek(0, 2)
        size = file.tell()
        if size < FOOTER.size:
            raise ValueError("not a shard: too short")
        at, bloom_at, self.bits, self.hashes, blocks, self.width, self.entries, self.ids, magic = FOOTER.unpack(self._read(size - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard: wrong magic")
        raw = self._read(at, bloom_at - at)
        self.bloom = self._read(bloom_at, size - FOOTER.size - bloom_at)
        self.blocks, self.firsts, p = [], [], 0
        for _ in range(blocks):
            n, p = _read_varint(raw, p)
            self.firsts.append(raw[p : p + n])
            self.blocks.append(struct.unpack_from("<QIIIQ", raw, p + n))
            p += n + 28

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def _entries(self, k: int) -> Iterator[tuple[bytes, bytes]]:
        at, stored, plain, check, _ = self.blocks[k]
        data = self._read(at, stored)
        if crc32(data) != check:
            raise ValueError(f"block {k} is damaged")
        b, p, key = self.codec.decompress(data, plain, asbytes=True), 0, b""
        while p < len(b):
            shared, p = _read_varint(b, p)
            fresh, p = _read_varint(b, p)
            count, p = _read_varint(b, p)
            key = key[:shared] + b[p : p + fresh]
            p += fresh
            yield key, b[p : p + count * self.width]
            p += count * self.width

    def __iter__(self) -> Iterator[tuple[int | None, np.ndarray]]:
        kind = np.dtype(f"<u{self.width}")
        for k in range(len(self.blocks)):
            for key, values in self._entries(k):
                yield id_of(key), np.frombuffer(values, kind).astype("<u4")

    def may_have(self, doc_id: int | None) -> bool:
        return all(self.bloom[i >> 3] >> (i & 7) & 1 for i in _bloom_bits(key_of(doc_id), self.bits, self.hashes))

    def lookup(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of every entry of that document."""
        if not self.blocks or not self.may_have(doc_id):
            return []
        key, kind, out = key_of(doc_id), np.dtype(f"<u{self.width}"), []
        # Entries with the key may begin in the block before the first one that starts with it.
        k = max(0, bisect.bisect_left(self.firsts, key) - 1)
        while k < len(self.blocks) and self.firsts[k] <= key:
            out += [np.frombuffer(v, kind).astype("<u4") for x, v in self._entries(k) if x == key]
            k += 1
        return out


def _cuts_at_spaces(parts: dict) -> bool:
    """Whether a tokenizers file is a plain byte-level one, whose pattern ``Encoder`` knows."""
    pre, model = parts.get("pre_tokenizer") or {}, parts["model"]
    byte_level = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
    return bool(byte_level and not parts.get("normalizer") and model["type"] == "BPE" and not model.get("dropout") and not model.get("continuing_subword_prefix"))


class Encoder:
    """Token ids of texts by a tokenizer, as bytes of 16- or 32-bit ids.

    A byte-level tokenizer cuts a text before each single space, around each single line feed that
    stands between other characters, and between a letter or digit and a full stop or comma. So
    such pieces are encoded on their own, once, and kept; texts are cut and put together by column
    operations on whole batches. A text with any other white space, with such a mark after another,
    or with the string of a special token is encoded whole, and so is every text if the
    tokenizer is of another kind.

    A piece stands under a key: the piece without its leading space, or with its line feed, or with
    ``MARK`` before a full stop or comma. For a new piece of letters alone, which is one word for the
    tokenizer, only the merges are run; other new pieces go through the whole tokenizer.
    """

    MARK = "\x01"
    #: A full stop or comma that follows no letter or digit.
    ODD = re.compile(r"[.,](?<![^\W_].)")
    #: Pieces kept in each of two generations.
    CACHE = 300_000
    #: What Python calls letters below this, the tokenizer's pattern does too.
    LETTERS = "\u0600"

    def __init__(self, tokenizer: str, width: int):
        """``tokenizer``: the text of a tokenizers file."""
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_str(tokenizer)
        self.kind, self.width = np.dtype(f"<u{width}"), width
        parts = json.loads(tokenizer)
        self.special = [t["content"] for t in parts.get("added_tokens") or []]
        self.pieces = _cuts_at_spaces(parts)
        if self.pieces:
            # Printable bytes stand for themselves in the byte alphabet, the others from 256 on in their order.
            own = {b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173}
            self.alphabet = {chr(b): chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - own))}
            line = {"type": "Split", "pattern": {"String": self.alphabet["\n"]}, "behavior": "Isolated", "invert": False}
            bare = {**parts, "pre_tokenizer": line, "post_processor": None, "decoder": None, "added_tokens": []}
            self.merges = Tokenizer.from_str(json.dumps(bare))
            self.feed = self._whole(["a\nb"])[0][width:-width]
            self.feed_id = int.from_bytes(self.feed, "little")
            self.kept: dict[str, bytes] = {}
            self.older: dict[str, bytes] = {}  # those of the generation before

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _mapped(self, text: str) -> str:
        """A text of letters, spaces and line feeds in the byte alphabet."""
        text = text.encode().decode("latin-1")
        for a, b in self.alphabet.items():
            if a in " \n" or a > "\x7f":
                text = text.replace(a, b)
        return text

    def _lines(self, keys: list[str], texts: list[str], bare: bool, group: int = 500) -> None:
        """Keep new pieces: many are encoded as the lines of one text, whose line feeds' ids cut the ids apart again."""
        groups = [texts[i : i + group] for i in range(0, len(texts), group)]
        joined = ["\n".join(g) for g in groups]
        if bare:
            joined = [self._mapped(t) for t in joined]
        at = 0
        for g, e in zip(groups, (self.merges if bare else self.tokenizer).encode_batch_fast(joined, add_special_tokens=False), strict=True):
            ids = np.array(e.ids, self.kind)
            raw, cuts = ids.tobytes(), (np.flatnonzero(ids == self.feed_id) * self.width).tolist()
            for begin, end in zip([0, *[c + self.width for c in cuts]], [*cuts, len(raw)], strict=True):
                key = keys[at]
                self.kept[key] = self.feed + raw[begin:end] if key[0] == "\n" else raw[begin:end]
                at += 1

    def _learn(self, fresh: list[str]) -> None:
        words, odd = [], []
        for k in fresh:
            if k in self.older:
                self.kept[k] = self.older[k]
            else:
                core = k[1:] if k[0] == "\n" else k
                (words if core.isalpha() and (core.isascii() or max(core) < self.LETTERS) else odd).append(k)
        text = lambda k: k[1:] if k[0] in "\n\x01" else " " + k
        self._lines(words, list(map(text, words)), True)
        self._lines(odd, list(map(text, odd)), False)

    def _plain(self, t: str) -> bool:
        """Whether the only white space is single spaces and line feeds inside the text, and marks stand after words."""
        return (
            t.replace("\n", "").isprintable()  # of white space, only the space is printable
            and t[0] not in " \n"
            and t[-1] not in " \n"
            and not any(x in t for x in ("  ", "\n\n", " \n", "\n ", *self.special))
            and self.ODD.search(t) is None
        )

    def _cut(self, texts: list[str]) -> tuple[pa.Array, np.ndarray]:
        """(pieces of all texts, first piece of each text and the end). The first piece of a text is keyed as after a line feed."""
        rows = ["\n" + t.replace(".", " \x01.").replace(",", " \x01,").replace("\n", " \n") for t in texts]
        lists = pc.split_pattern(pa.array(rows, pa.large_string()), " ")
        return lists.flatten().dictionary_encode(), lists.offsets.to_numpy()

    def _known(self, pieces: pa.Array) -> list[bytes]:
        """The ids of each distinct piece."""
        if len(self.kept) > self.CACHE:
            self.kept, self.older = {}, self.kept
        keys = pieces.dictionary.to_numpy(zero_copy_only=False).tolist()
        self._learn([k for k in keys if k not in self.kept])
        return list(map(self.kept.__getitem__, keys))

    def __call__(self, texts: list[str]) -> list[bytes]:
        out = [b""] * len(texts)
        cut = [i for i, t in enumerate(texts) if t and self.pieces and self._plain(t)]
        there = set(cut)
        whole = [i for i, t in enumerate(texts) if t and i not in there]
        for i, b in zip(whole, self._whole([texts[i] for i in whole]), strict=True):
            out[i] = b
        if cut:
            pieces, first = self._cut([texts[i] for i in cut])
            known = self._known(pieces)
            ends = np.cumsum([0, *map(len, known)]) // self.width
            ids = pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), pa.array(np.frombuffer(b"".join(known), self.kind))).take(pieces.indices)
            flat, at = ids.flatten().to_numpy(), ids.offsets.to_numpy()[first].tolist()
            for i, begin, end in zip(cut, at, at[1:], strict=False):
                out[i] = flat[begin + 1 : end].tobytes()  # without the line feed
        return out

    def count(self, texts: list[str]) -> np.ndarray:
        """The number of ids of each text, without making them."""
        out = np.zeros(len(texts), np.int64)
        cut = [i for i, t in enumerate(texts) if t and self.pieces and self._plain(t)]
        there = set(cut)
        whole = [i for i, t in enumerate(texts) if t and i not in there]
        out[whole] = [len(e.ids) for e in self.tokenizer.encode_batch_fast([texts[i] for i in whole], add_special_tokens=False)]
        if cut:
            pieces, first = self._cut([texts[i] for i in cut])
            sizes = np.array([len(b) for b in self._known(pieces)], np.int64) // self.width
            out[cut] = np.add.reduceat(sizes[pieces.indices.to_numpy()], first[:-1]) - 1
        return out


@lru_cache(maxsize=1)
def encoder(tokenizer: str, width: int) -> Encoder:
    """One for a Python worker, so that what its tasks have learned stays."""
    return Encoder(tokenizer, width)


def vocabulary_of(tokenizer: str) -> tuple[str, int]:
    """(text of a tokenizers file, width of its ids). The text goes to the tasks, whose machines need not have the file."""
    with open(tokenizer, encoding="utf-8") as f:
        text = f.read()
    parts = json.loads(text)
    top = max([*parts["model"]["vocab"].values(), *[t["id"] for t in parts.get("added_tokens") or []]])
    return text, 2 if top < 1 << 16 else 4


def _opened(path: str, mode: str):
    from pyarrow import fs

    where, inner = fs.FileSystem.from_uri(re.sub("^s3[an]://", "s3://", path))
    return where.open_input_file(inner) if mode == "r" else where.open_output_stream(inner)


MANIFEST = "place long, shard string, entries long, ids long, first string, last string"


def build(docs: DataFrame, tokenizer: str, folder: str, shard_bytes: int = 16 << 20) -> DataFrame:
    """Write shards under ``folder``; their manifest, in id order by ``place``."""
    vocabulary, width = vocabulary_of(tokenizer)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(F.col("text")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, end = encoder(vocabulary, width), END.to_bytes(width, "little")
        name = f"{folder}/shard-{uuid.uuid4().hex}.sst"
        writer = file = None
        first = last = None
        for b in batches:
            ids = [None if x is None else int(x) for x in b["id"]]
            for doc_id, values in zip(ids, encode(b["text"].tolist()), strict=True):
                if writer is None:
                    file = _opened(name, "w")
                    writer, first = Writer(file, width), key_of(doc_id)
                writer.add(last := key_of(doc_id), values + end)
        if writer is not None:
            writer.close()
            file.close()
            place = TaskContext.get().partitionId()  # ranges are numbered in order
            yield pd.DataFrame({"place": [place], "shard": [name], "entries": [writer.entries], "ids": [writer.ids], "first": [first.hex()], "last": [last.hex()]})

    parts = max(1, -(-size // shard_bytes))
    # A table may hold a third of its rows under one id, or as one text without an id: the text and the row's place cut such a run.
    order = [F.col("doc_id").asc_nulls_first(), "_begin", F.xxhash64("text"), "_row"]
    rows = rows.withColumn("_begin", F.substring("text", 1, 64)).withColumn("_row", F.monotonically_increasing_id())
    ranged = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    ranged = ranged.select(F.col("doc_id").cast("string").alias("id"), "text")  # pandas would make ids with a null floats
    spark = docs.sparkSession
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    try:
        return saved(batched(ranged).mapInPandas(write, MANIFEST), "manifest")
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def starts(manifest: DataFrame, run: int = 4096) -> DataFrame:
    """``manifest`` with ``start``: the ids in all shards before. Running sums within runs of shards, and over the runs' sums."""
    rows = manifest.withColumn("_run", F.floor(F.col("place") / run))
    sums = rows.groupBy("_run").agg(F.sum("ids").alias("_ids"))  # one row for 4,096 shards
    past = Window.orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_run", F.coalesce(F.sum("_ids").over(past), F.lit(0)).alias("_past"))
    own = Window.partitionBy("_run").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("_own", F.coalesce(F.sum("ids").over(own), F.lit(0))).join(sums, "_run").withColumn("start", F.col("_own") + F.col("_past")).drop("_own", "_past", "_run")


def read(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, shard), read back from the files of a manifest."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, at in zip(b["shard"], b["start"], strict=True):
                with _opened(name, "r") as file:
                    rows, at = [], int(at)
                    for doc_id, ids in Reader(file):
                        rows.append((doc_id, at, len(ids), crc32(ids.tobytes())))
                        at += len(ids)
                        if len(rows) >= 5000:
                            yield _frame(rows, name)
                            rows = []
                    yield _frame(rows, name)

    listed = starts(manifest).select("shard", "start")
    shards = max(1, min(manifest.count(), 10000))
    return listed.repartition(shards, "shard").mapInPandas(parse, "doc_id long, start long, n_tokens long, ids_crc32 long, shard string")


def _frame(rows: list[tuple], name: str) -> pd.DataFrame:
    columns = list(zip(*rows, strict=True)) or [()] * 4
    f = pd.DataFrame({c: pd.array(v, "Int64") for c, v in zip(("doc_id", "start", "n_tokens", "ids_crc32"), columns, strict=True)})
    f["shard"] = name.rsplit("/", 1)[-1]
    return f


def lookup(manifest: DataFrame, doc_id: int | None) -> list[np.ndarray]:
    """The token ids of a document: the manifest names the shards whose range has it, each answers by binary search."""
    key = key_of(doc_id).hex()
    out = []
    for r in manifest.filter((F.col("first") <= key) & (F.col("last") >= key)).orderBy("place").collect():
        with _opened(r["shard"], "r") as file:
            out += Reader(file).lookup(doc_id)
    return out


def op4_token_ids(spark, sf_dir):
    import public_tokenizers

    return read(build(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), new_folder(spark, "sst"))).drop("shard")


QUERIES = {"op4_token_ids": op4_token_ids}
ORACLES: dict[str, str] = {}
