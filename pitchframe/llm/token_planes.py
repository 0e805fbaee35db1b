"""Token ids in files of byte or bit planes: encode, write in id order, read back."""

from __future__ import annotations

import json
import math
import os
import re
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pitchframe.llm.common import table, text_batches, total_bytes
from pitchframe.llm.files import new_folder, open_fs, publish
from pitchframe.plans.session import tune

MAGIC = b"PLANES01"
CHUNK_IDS = 1 << 16
# A file is closed after so many ids, a task gets about so many bytes of text.
FILE_IDS, TASK_BYTES = 1 << 26, 64 << 20
END_ID = 0
CACHED_PIECES = 500_000
# Rows of a batch; its bytes are bounded too. Large batches hold more repeated pieces.
BATCH_ROWS = 4000
# ASCII marks, and a Latin word with the space before it.
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
LATIN = re.compile(r" [A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+")


# ---- encoding


def cuts_at_spaces(tokenizer: dict) -> bool:
    """Whether a tokenizer file splits texts as byte-level BPE does, so that texts may be cut before a single space."""
    pre, model = tokenizer.get("pre_tokenizer") or {}, tokenizer.get("model") or {}
    return (
        pre.get("type") == "ByteLevel"
        and pre.get("use_regex", True)
        and not pre.get("add_prefix_space", True)
        and tokenizer.get("normalizer") is None
        and model.get("type") == "BPE"
        and not model.get("dropout")
        and all(" " not in t["content"] and not (t["lstrip"] or t["rstrip"]) for t in tokenizer.get("added_tokens", []))
    )


class Encoder:
    """Ids of whole texts by a tokenizers file, with the ids of pieces met before kept.

    Byte-level BPE never joins what stands before a single space to what follows, so a text may be cut there. Pieces
    repeat, so most are looked up; those not met yet are encoded together, as one text of many pieces, and the ids dealt
    out by the bytes they stand for. `fast` cuts at every space of texts that hold no two white-space characters in a row;
    other texts are cut only at spaces between two characters that are not white space. Tokenizers of another kind get
    whole texts.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            self.cuts = cuts_at_spaces(json.load(f))
        self.tokenizer = Tokenizer.from_file(path)
        # Byte-level tokens are written with one character for each byte.
        self.bytes = np.zeros(self.tokenizer.get_vocab_size(with_added_tokens=True) + 1, dtype=np.int64)
        for token, k in self.tokenizer.get_vocab(with_added_tokens=True).items():
            if k < len(self.bytes):
                self.bytes[k] = len(token)
        self.known: dict[str, int] = {}
        self.flat, self.ends = np.zeros(0, dtype=np.uint32), np.zeros(1, dtype=np.int64)

    def _keep(self, pieces: list[str], ids: np.ndarray, counts: np.ndarray) -> None:
        """Known pieces are numbered; the ids of number k are flat[ends[k] : ends[k + 1]]."""
        n = len(self.known)
        self.known.update(zip(pieces, range(n, n + len(pieces))))
        self.flat = np.concatenate([self.flat, ids.astype(np.uint32)])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(counts)])

    def _forget(self, pieces: list[str]) -> None:
        """Only pieces of the batch at hand stay known."""
        stay = [p for p in pieces if p in self.known]
        ids, counts = self.gather(np.array([self.known[p] for p in stay], dtype=np.int64))
        self.known, self.flat, self.ends = {}, np.zeros(0, dtype=np.uint32), np.zeros(1, dtype=np.int64)
        self._keep(stay, ids, counts)

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.fromiter((i for ids in found for i in ids), dtype=np.int64), np.fromiter(map(len, found), dtype=np.int64, count=len(found))

    def _learn(self, pieces: list[str], sizes: list[int]) -> None:
        """Encode pieces that each begin with one space and end without; `sizes` are their bytes."""
        ids = np.array(self.tokenizer.encode_batch_fast(["".join(pieces)], add_special_tokens=False)[0].ids, dtype=np.int64)
        ends, stops = np.cumsum(self.bytes[ids]), np.cumsum(sizes)
        at = np.searchsorted(ends, stops)
        if len(ids) and ends[-1] == stops[-1] and (ends[at] == stops).all():
            self._keep(pieces, ids, np.diff(at + 1, prepend=0))
        else:
            self._keep(pieces, *self._encode(pieces))

    def _split_marks(self, pieces: list[str]) -> tuple[list[str], list[tuple[str, str, str]]]:
        """Pieces to be encoded, and (piece, word, marks) of those made of a word and ASCII marks after it.

        Byte-level BPE never joins letters to the marks after them.
        """
        whole, pairs = [], []
        for p in pieces:
            word = p.rstrip(MARKS)
            if len(word) < len(p) and len(word) > 1 and (word[1:].isalpha() if word.isascii() else LATIN.fullmatch(word)):
                pairs.append((p, word, p[len(word) :]))
            else:
                whole.append(p)
        return whole, pairs

    def pieces(self, pieces: list[str]) -> np.ndarray:
        """The number of each piece."""
        get = self.known.get
        missing = [p for p in dict.fromkeys(pieces) if get(p) is None]
        if missing:
            if len(self.known) + len(missing) > CACHED_PIECES:
                self._forget(list(dict.fromkeys(pieces)))
            joined = [p for p in missing if len(p) > 1 and p[0] == " " and not p[1].isspace() and not p[-1].isspace()]
            joined, pairs = self._split_marks(joined)
            joined = [w for w in dict.fromkeys(joined + [w for _, w, _ in pairs]) if w not in self.known]
            for at in range(0, len(joined), 8192):
                some = joined[at : at + 8192]
                self._learn(some, [len(p) if p.isascii() else len(p.encode()) for p in some])
            made = {p for p, _, _ in pairs}
            alone = [p for p in dict.fromkeys(missing + [m for _, _, m in pairs]) if p not in self.known and p not in made]
            if alone:
                self._keep(alone, *self._encode(alone))
            if pairs:
                ids, counts = self.gather(np.array([self.known[x] for _, w, m in pairs for x in (w, m)], dtype=np.int64))
                self._keep([p for p, _, _ in pairs], ids, counts.reshape(-1, 2).sum(1))
        return np.fromiter(map(self.known.__getitem__, pieces), dtype=np.int64, count=len(pieces))

    def gather(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of numbered pieces one after another, and how many each has."""
        start = self.ends[numbers]
        lengths = self.ends[numbers + 1] - start
        before = np.cumsum(lengths) - lengths
        return self.flat[np.arange(int(lengths.sum())) + np.repeat(start - before, lengths)], lengths

    def fast(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        words = pc.split_pattern(texts, " ")
        offsets = words.offsets.to_numpy()
        codes = words.flatten().dictionary_encode()
        names, codes = codes.dictionary, codes.indices.to_numpy().astype(np.int64)
        # The first piece of a text has no space before it.
        first = offsets[:-1] - offsets[0]
        starters = np.unique(codes[first])
        place = np.zeros(len(names), dtype=np.int64)
        place[starters] = np.arange(len(starters)) + len(names)
        codes[first] = place[codes[first]]
        spaced = pc.binary_join_element_wise("", names, " ").to_pylist()
        numbers = self.pieces(spaced + names.take(pa.array(starters)).to_pylist())
        out, lengths = self.gather(numbers[codes])
        return out, np.add.reduceat(lengths, first)

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """An array of ids for each text."""
        if not self.cuts:
            ids, counts = self._encode(texts.to_pylist())
            return np.split(ids.astype(np.uint32), np.cumsum(counts)[:-1])
        double = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]{2}"
        slow = pc.match_substring_regex(texts, double).to_numpy(zero_copy_only=False)
        out: list[np.ndarray | None] = [None] * len(texts)
        if (~slow).any():
            at = np.flatnonzero(~slow)
            ids, counts = self.fast(texts.take(pa.array(at)))
            for i, part in zip(at, np.split(ids, np.cumsum(counts)[:-1])):
                out[i] = part
        for i in np.flatnonzero(slow):
            # The space stays with the piece that follows it.
            parts = re.split(r"(?<=\S)(?= \S)", texts[i].as_py())
            out[i], _ = self.gather(self.pieces(parts))
        return out


ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each Python worker and file, so that its pieces serve all tasks of the worker."""
    # A task has one core: threads of the library would take those of other tasks.
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in ENCODERS:
        ENCODERS[path] = Encoder(path)
    return ENCODERS[path]


# ---- file format: MAGIC, the planes of each chunk, the documents (zstandard), an index in JSON, its length, MAGIC


def pack_planes(ids: np.ndarray, kind: str, press) -> list[bytes]:
    """Planes of one chunk, lowest first, each compressed; empty high planes are left out."""
    raw = np.ascontiguousarray(ids, dtype="<u4").view(np.uint8).reshape(-1, 4)
    top = int(ids.max()).bit_length() if len(ids) else 0
    if kind == "byte":
        planes = [raw[:, k] for k in range((top + 7) // 8)]
    else:
        bits = np.unpackbits(raw, axis=1, bitorder="little")
        planes = [np.packbits(bits[:, k], bitorder="little") for k in range(top)]
    return [press.compress(np.ascontiguousarray(p).tobytes()) for p in planes]


def unpack_planes(planes: list[bytes], n: int, kind: str, unpress) -> np.ndarray:
    if kind == "byte":
        raw = np.zeros((n, 4), dtype=np.uint8)
        for k, p in enumerate(planes):
            raw[:, k] = np.frombuffer(unpress.decompress(p), dtype=np.uint8)
        return raw.view("<u4").reshape(-1)
    bits = np.zeros((n, 32), dtype=np.uint8)
    for k, p in enumerate(planes):
        bits[:, k] = np.unpackbits(np.frombuffer(unpress.decompress(p), dtype=np.uint8), count=n, bitorder="little")
    return np.packbits(bits, axis=1, bitorder="little").view("<u4").reshape(-1)


class PlaneWriter:
    """Holds one chunk of ids at most, and a number triple for each document of the file."""

    def __init__(self, uri: str, kind: str):
        self.uri, self.kind, self.press = uri, kind, zstandard.ZstdCompressor(level=3)
        fs, path = open_fs(uri)
        self.out = fs.open_output_stream(path, compression=None)
        self.out.write(MAGIC)
        self.at, self.ids, self.held, self.waiting = len(MAGIC), 0, [], 0
        self.chunks: list[list[int]] = []
        self.docs: list[int | None] = []
        self.sizes: list[int] = []

    def _flush(self, least: int) -> None:
        if self.waiting < least or not self.waiting:
            return
        flat = np.concatenate(self.held)
        whole = len(flat) // CHUNK_IDS * CHUNK_IDS if least > 1 else len(flat)
        for k in range(0, whole, CHUNK_IDS):
            part = flat[k : min(k + CHUNK_IDS, whole)]
            planes = pack_planes(part, self.kind, self.press)
            self.chunks.append([len(part), self.at, *map(len, planes)])
            for p in planes:
                self.out.write(p)
                self.at += len(p)
        self.held, self.waiting = ([flat[whole:]] if whole < len(flat) else []), len(flat) - whole

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc)
        self.sizes.append(len(ids))
        self.held.append(ids)
        self.waiting += len(ids)
        self.ids += len(ids)
        self._flush(CHUNK_IDS)

    def close(self) -> tuple[int, int, int]:
        """Ids, documents and bytes of the file."""
        self._flush(1)
        null = np.array([d is None for d in self.docs], dtype=np.uint8)
        keys = np.array([d or 0 for d in self.docs], dtype="<i8")
        blob = self.press.compress(null.tobytes() + keys.tobytes() + np.array(self.sizes, dtype="<i8").tobytes())
        index = json.dumps({"planes": self.kind, "chunks": self.chunks, "docs": [len(self.docs), self.at, len(blob)]}).encode()
        self.out.write(blob + index + struct.pack("<Q", len(index)) + MAGIC)
        self.out.close()
        return self.ids, len(self.docs), self.at + len(blob) + len(index) + 8 + len(MAGIC)


class PlaneReader:
    def __init__(self, uri: str):
        fs, path = open_fs(uri)
        self.file, size = fs.open_input_file(path), fs.get_file_info(path).size
        tail = self.file.read_at(8 + len(MAGIC), size - 8 - len(MAGIC))
        if tail[8:] != MAGIC:
            raise ValueError(f"{uri} is not a whole file of planes")
        n = struct.unpack("<Q", tail[:8])[0]
        self.index = json.loads(self.file.read_at(n, size - 8 - len(MAGIC) - n))
        self.unpress = zstandard.ZstdDecompressor()
        self.starts = np.cumsum([0] + [c[0] for c in self.index["chunks"]])

    def docs(self) -> tuple[list[int | None], np.ndarray]:
        """Key and number of ids of each document."""
        n, at, size = self.index["docs"]
        blob = self.unpress.decompress(self.file.read_at(size, at))
        keys = np.frombuffer(blob, dtype="<i8", count=n, offset=n)
        return [None if z else int(k) for z, k in zip(blob[:n], keys)], np.frombuffer(blob, dtype="<i8", count=n, offset=9 * n)

    def chunk(self, k: int) -> np.ndarray:
        n, at, *sizes = self.index["chunks"][k]
        blob, planes = self.file.read_at(sum(sizes), at), []
        for s in sizes:
            planes.append(blob[:s])
            blob = blob[s:]
        return unpack_planes(planes, n, self.index["planes"], self.unpress)

    def ids(self, start: int, n: int) -> np.ndarray:
        """Any run of ids: only the chunks it touches are read."""
        first, last = np.searchsorted(self.starts, [start, start + max(n, 1) - 1], side="right") - 1
        flat = np.concatenate([self.chunk(k) for k in range(first, last + 1)]) if n else np.zeros(0, dtype=np.uint32)
        return flat[start - self.starts[first] : start - self.starts[first] + n]

    def spans(self):
        """(document number, a piece of its ids) in order, chunk by chunk."""
        _, sizes = self.docs()
        ends, doc = np.cumsum(sizes), 0
        for k in range(len(self.index["chunks"])):
            flat, base, at = self.chunk(k), int(self.starts[k]), 0
            while doc < len(sizes) and at < len(flat):
                stop = min(int(ends[doc]) - base, len(flat))
                yield doc, flat[at:stop]
                at = stop
                if int(ends[doc]) <= base + at:
                    doc += 1


# ---- Spark


def write_tokens(
    df: DataFrame, folder: str, tokenizer: str, key: str = "doc_id", text: str = "text", planes: str = "byte", file_ids: int = FILE_IDS
) -> DataFrame:
    """Encode whole texts and write them in ascending `key` order; returns the manifest, a row for each file.

    Texts are sent to range partitions of the key before they are encoded, so ids are never shuffled: each task
    encodes its sorted run and writes files of fixed-size chunks as it goes. NULL texts count as empty and hold the
    end id alone. NULL keys come first; rows of one key follow the hash of their text. An empty table gives an empty
    manifest. Other columns are left out.
    """
    spark = df.sparkSession
    text_batches(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    rows = df.select(F.col(f"`{key}`").cast("bigint").alias("key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    _, size = total_bytes(rows, "text")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / TASK_BYTES))
    order = [F.col("key").asc_nulls_first(), F.col("tie")]
    rows = rows.withColumn("tie", F.xxhash64("text")).repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def write(batches):
        part, seq, out, done = TaskContext.get().partitionId(), 0, None, []

        def finish():
            ids, docs, size = out.close()
            done.append((f"ids-{part:06d}-{seq:05d}.planes", out.uri, part, seq, ids, docs, size))

        for batch in batches:
            for doc, ids in zip(batch.column("key").to_pylist(), encoder(tokenizer).encode(pa.array(batch.column("text"), pa.string()))):
                if out is not None and out.ids >= file_ids:
                    finish()
                    out, seq = None, seq + 1
                out = out or PlaneWriter(f"{folder}/_{uuid.uuid4().hex}", planes)
                out.add(doc, np.append(ids, np.uint32(END_ID)))
        if out is not None:
            finish()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], names=["name", "temp", "part", "seq", "ids", "docs", "size"])

    written = rows.select("key", "text").mapInArrow(write, "name string, temp string, part bigint, seq bigint, ids bigint, docs bigint, size bigint")
    return publish(written, folder)


def _with_base(manifest: DataFrame) -> DataFrame:
    """Ids of all files before each file; the manifest has a row for each file, so one task orders it."""
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("base", F.coalesce(F.sum("ids").over(before), F.lit(0)))


def read_digests(manifest: DataFrame, key: str = "doc_id") -> DataFrame:
    """`key`, start, n_tokens, ids_crc32 of every document, read from the files chunk by chunk."""

    def read(batches):
        for batch in batches:
            for uri, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist()):
                reader = PlaneReader(uri)
                keys, sizes = reader.docs()
                crc = np.zeros(len(keys), dtype=np.int64)
                for doc, ids in reader.spans():
                    crc[doc] = zlib.crc32(np.ascontiguousarray(ids, dtype="<u4"), int(crc[doc]))
                starts = base + np.cumsum(sizes) - sizes
                cols = [pa.array(keys, pa.int64()), pa.array(starts), pa.array(sizes), pa.array(crc)]
                yield pa.RecordBatch.from_arrays(cols, names=[key, "start", "n_tokens", "ids_crc32"])

    files = _with_base(manifest).repartition(max(manifest.count(), 1), "path")
    return files.mapInArrow(read, f"`{key}` bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def read_ids(manifest: DataFrame, key: str = "doc_id") -> DataFrame:
    """`key`, start, ids (array) of every document; a batch of rows at a time."""

    def read(batches):
        for batch in batches:
            for uri, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist()):
                reader = PlaneReader(uri)
                keys, sizes = reader.docs()
                at = 0
                for k, n in zip(keys, sizes):
                    ids = pa.array([reader.ids(at, int(n)).astype(np.int64)], pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([base + at]), ids], names=[key, "start", "ids"])
                    at += int(n)

    files = _with_base(manifest).repartition(max(manifest.count(), 1), "path")
    return files.mapInArrow(read, f"`{key}` bigint, start bigint, ids array<bigint>")


def op7_token_planes(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    tune(spark)
    docs = table(spark, folder, "documents")
    return read_digests(write_tokens(docs, new_folder(spark, "tokens"), public_tokenizers.path("byte_bpe_50k.json")))
