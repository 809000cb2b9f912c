"""Token-id files: independent zstandard frames with a trailing seek table and a checksum for each frame.

Layout of a file: data frames (unsigned 32-bit little-endian ids of whole documents, one after another), a skippable
frame with the index of documents, and the seek table of the public zstd seekable format. Any zstd tool decompresses
the file to the plain stream of ids; a reader of some documents reads the seek table and the index from the end and
then only the frames that hold those documents.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import regex
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, worker_state
from tidemark.session import shared_dir, ship

# Fixed values of the zstd seekable format.
SKIPPABLE_SEEK = 0x184D2A5E
SKIPPABLE_INDEX = 0x184D2A50
SEEKABLE_MAGIC = 0x8F92EAB1
CHECKSUMS = 0x80

FRAME_BYTES = 1 << 18  # a frame is closed once it holds this much
LEVEL = 1
#: Words that a worker keeps encoded; the store is emptied when full, which costs time and changes nothing else.
KEEP_WORDS = 500_000
_SAFE = re.compile("[!-~\u00c0-\u00ff]*").fullmatch
_MARK = regex.compile(r"\p{M}").search


def _sum32(data: bytes) -> int:
    return xxhash.xxh64_intdigest(data) & 0xFFFFFFFF


class TokenWriter:
    """Writes documents' ids to a stream; close() adds the index and the seek table."""

    def __init__(self, stream, frame_bytes: int = FRAME_BYTES, level: int = LEVEL) -> None:
        self.stream, self.frame_bytes = stream, frame_bytes
        self.zstd = zstandard.ZstdCompressor(level=level, write_checksum=False)
        self.pending: list[bytes] = []
        self.held, self.frames, self.docs, self.tokens = 0, [], [], 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.docs.append((doc_id is not None, doc_id or 0, len(self.frames), len(ids) // 4))
        self.tokens += len(ids) // 4
        self.pending.append(ids)
        self.held += len(ids)
        if self.held >= self.frame_bytes:
            self._frame()

    def _frame(self) -> None:
        data = b"".join(self.pending)
        packed = self.zstd.compress(data)
        self.stream.write(packed)
        self.frames.append((len(packed), len(data), _sum32(data)))
        self.pending, self.held = [], 0

    def close(self) -> None:
        if self.docs and self.docs[-1][2] == len(self.frames):
            self._frame()
        cols = list(zip(*self.docs, strict=True)) or [(), (), (), ()]
        index = b"".join(np.array(c, t).tobytes() for c, t in zip(cols, ("u1", "<i8", "<u4", "<u4"), strict=True))
        body = struct.pack("<QI", len(self.docs), _sum32(index)) + self.zstd.compress(index)
        self.stream.write(struct.pack("<II", SKIPPABLE_INDEX, len(body)) + body)
        table = b"".join(struct.pack("<III", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), CHECKSUMS, SEEKABLE_MAGIC)
        self.stream.write(struct.pack("<II", SKIPPABLE_SEEK, len(table)) + table)


class TokenReader:
    """Reads documents from a seekable file; frames_read counts what was decompressed."""

    def __init__(self, stream, size: int) -> None:
        self.stream, self.frames_read = stream, 0
        n, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEKABLE_MAGIC or flags != CHECKSUMS:
            raise ValueError("not a seekable token file")
        table = self._at(size - 9 - 12 * n - 8, 12 * n + 8)
        mark, length = struct.unpack("<II", table[:8])
        if mark != SKIPPABLE_SEEK or length != 12 * n + 9:
            raise ValueError("the seek table is damaged")
        self.frames = np.frombuffer(table[8:], "<u4").reshape(n, 3)
        self.offsets = np.concatenate([[0], np.cumsum(self.frames[:, 0], dtype=np.int64)])
        start = int(self.offsets[-1])
        body = self._at(start + 8, size - 9 - 12 * n - 8 - start - 8)
        docs, check = struct.unpack("<QI", body[:12])
        index = zstandard.ZstdDecompressor().decompress(body[12:], max_output_size=17 * docs)
        if _sum32(index) != check:
            raise ValueError("the index of documents is damaged")
        self.valid = np.frombuffer(index, "u1", docs)
        self.doc_ids = np.frombuffer(index, "<i8", docs, docs)
        self.frame_of = np.frombuffer(index, "<u4", docs, 9 * docs)
        self.counts = np.frombuffer(index, "<u4", docs, 13 * docs)
        before = np.concatenate([[0], np.cumsum(self.counts, dtype=np.int64)])
        self.starts = before[:-1]  # ids before each document, in this file
        opens = np.searchsorted(self.frame_of, np.arange(n))
        self.inside = 4 * (self.starts - self.starts[opens][self.frame_of]) if docs else self.starts

    def _at(self, offset: int, n: int) -> bytes:
        self.stream.seek(offset)
        return self.stream.read(n)

    def frame(self, k: int) -> bytes:
        self.frames_read += 1
        packed, length, check = (int(x) for x in self.frames[k])
        data = zstandard.ZstdDecompressor().decompress(self._at(int(self.offsets[k]), packed), max_output_size=max(1, length))
        if len(data) != length or _sum32(data) != check:
            raise ValueError(f"frame {k} is damaged")
        return data

    def documents(self, positions: Iterable[int] | None = None) -> Iterator[tuple[int | None, int, bytes]]:
        """(doc_id, ids before it in this file, its ids as bytes), all or those at positions (ascending)."""
        held, data = -1, b""
        for p in range(len(self.doc_ids)) if positions is None else positions:
            if self.frame_of[p] != held:
                held = int(self.frame_of[p])
                data = self.frame(held)
            at = int(self.inside[p])
            yield int(self.doc_ids[p]) if self.valid[p] else None, int(self.starts[p]), data[at : at + 4 * int(self.counts[p])]


class _Pieces(dict):
    """Ids of a pre-token in the safe letters, from the library's BPE model."""

    def __init__(self, model) -> None:
        super().__init__()
        self.model = model
        # the public byte-level alphabet: printable Latin-1 characters stand for themselves, others follow from 256 on
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        others = iter(range(256, 512))
        self.letters = {b: b if b in plain else next(others) for b in range(256)}

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= KEEP_WORDS:
            self.clear()
        ids = [t.id for t in self.model.tokenize(piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters))]
        out = self[piece] = struct.pack(f"<{len(ids)}I", *ids)
        return out


class _Words(dict):
    """A white-space-free word's ids as little-endian uint32 bytes, from the tokenizers library.

    Where the tokenizer's steps are the known ones, words never join over ASCII white space, so texts are encoded word by
    word, each new word once. A word of ASCII and Latin-1 letters is cut here by the tokenizer's own pattern and its
    pieces go to the library's model; any other word, and any that holds an added token, goes through the library's
    whole pipeline. Texts of other tokenizers go through it whole.
    """

    def __init__(self, definition: str) -> None:
        super().__init__()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        spec = json.loads(definition)
        added = [x["content"] for x in spec.get("added_tokens") or []]
        self.added = re.compile("|".join(map(re.escape, added)) or "(?!)").search
        self.added_folded = re.compile(b"|".join(re.escape(x.encode().lower()) for x in added) or b"(?!)").search
        kinds = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        splits = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
        self.known = (
            kinds == ["NFC", "Replace", "Lowercase"] and [x.get("type") for x in splits] == ["Split", "ByteLevel"] and splits[0]["behavior"] == "Removed" and splits[0]["invert"]
            and not any(x.get("normalized") for x in spec.get("added_tokens") or []) and not any(re.search(r"\s", x) for x in added)
        )
        self.find = regex.compile(splits[0]["pattern"]["Regex"]).findall if self.known else None
        self.pieces = _Pieces(self.tokenizer.model)

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= KEEP_WORDS:
            self.clear()
        text = word.decode()
        if _SAFE(text) and not self.added(text):
            out = b"".join(map(self.pieces.__getitem__, self.find(text.lower())))
        else:
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
            out = struct.pack(f"<{len(ids)}I", *ids)
        if len(word) <= 64:
            self[word] = out
        return out

    def encode(self, text: str, end: bytes) -> bytes:
        if not self.known:
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
            return struct.pack(f"<{len(ids)}I", *ids) + end
        data = text.encode()
        # ASCII letters may be lowered early where no mark could join with one of them and no added token comes of it
        if text.isascii() or not _MARK(text):
            lowered = data.lower()
            data = data if self.added_folded(lowered) else lowered
        return b"".join([*map(self.__getitem__, data.split()), end])


def write_tokens(docs: DataFrame, tokenizer_path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> DataFrame:
    """Encode whole texts, add end_id to each, and write the ids as files in ascending id order; returns the manifest.

    The manifest has part (in order), file, docs, tokens: one row a file. Files get a name of their own for each
    attempt and their final name by a move, so a repeated task leaves at most a file that no manifest names. Null texts
    count as empty (only end_id); null ids come first; rows that repeat an id are all kept, in the order of a hash of
    the text; other columns are ignored; an empty table gives an empty manifest.
    """
    spark = docs.sparkSession
    ship(spark)
    folder = folder or f"{shared_dir(spark)}/tidemark/tokens-{uuid.uuid4().hex}"
    with open(tokenizer_path, encoding="utf-8") as f:
        definition = spark.sparkContext.broadcast(f.read())
    fs, top = pafs.FileSystem.from_uri(folder)
    fs.create_dir(top)
    end = struct.pack("<I", end_id)

    def work(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        words = worker_state(("words", tokenizer_path), lambda: _Words(definition.value))
        fs, top = pafs.FileSystem.from_uri(folder)
        name = f"part-{part:06d}-{uuid.uuid4().hex[:12]}.zst"
        stream = writer = None
        for whole in batches:
            for batch in cut(whole, "text"):
                if writer is None:
                    stream = fs.open_output_stream(f"{top}/.{name}.open")
                    writer = TokenWriter(stream)
                for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    writer.add(doc_id, words.encode(text or "", end))
        if writer is not None:
            writer.close()
            stream.close()
            fs.move(f"{top}/.{name}.open", f"{top}/{name}")
            yield pa.RecordBatch.from_pydict({"part": [part], "file": [f"{folder}/{name}"], "docs": [len(writer.docs)], "tokens": [writer.tokens]}, pa.schema([("part", pa.int32()), ("file", pa.string()), ("docs", pa.int64()), ("tokens", pa.int64())]))

    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    base = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    ordered = base.repartitionByRange(parts, F.col("doc_id"), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id"), F.xxhash64("text"))
    done = ordered.mapInArrow(work, "part int, file string, docs long, tokens long")
    done.write.parquet(f"{folder}/manifest")
    return spark.read.schema(done.schema).parquet(f"{folder}/manifest")


def read_tokens(manifest: DataFrame, doc_ids: list[int] | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids binary) from the files of a manifest; with doc_ids, only frames that hold those.

    start counts the ids of all documents before this one over all files. The manifest's rows (one a file) pass
    through the driver to place the files one after another.
    """
    spark = manifest.sparkSession
    ship(spark)
    rows, before = [], 0
    for r in sorted(manifest.collect(), key=lambda r: r["part"]):
        rows.append((r["file"], before))
        before += r["tokens"]
    wanted = None if doc_ids is None else np.unique(np.array(doc_ids, np.int64))
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def flush(out):
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    def work(batches):
        for batch in batches:
            for file, offset in zip(batch.column("file").to_pylist(), batch.column("offset").to_pylist(), strict=True):
                fs, path = pafs.FileSystem.from_uri(file)
                with fs.open_input_file(path) as stream:
                    reader = TokenReader(stream, stream.size())
                    picked = None if wanted is None else np.flatnonzero(np.isin(reader.doc_ids, wanted) & (reader.valid == 1)).tolist()
                    out, held = [], 0
                    for doc_id, start, ids in reader.documents(picked):
                        out.append((doc_id, offset + start, len(ids) // 4, ids))
                        held += len(ids)
                        if held > 8_000_000:
                            yield flush(out)
                            out, held = [], 0
                    if out:
                        yield flush(out)

    files = spark.createDataFrame(rows, "file string, offset long")
    return files.repartition(max(1, len(rows))).mapInArrow(work, "doc_id long, start long, n_tokens long, ids binary")
