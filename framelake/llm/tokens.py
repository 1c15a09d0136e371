"""Token ids in flat binary files with 64-bit document offsets.

Documents are sorted by id into range partitions; each partition's task writes, to the shared folder,

* ``NAME.bin``: all token ids, unsigned integers of 16 bits (32 if the vocabulary needs it), little-endian,
* ``NAME.idx``: n + 1 unsigned 64-bit offsets (ids before each document), then n signed 64-bit document ids.

A manifest row per file (order, documents, ids) is committed by Spark, so files of failed attempts are never read;
the base of each file is the prefix sum of the ids before it.  Reading maps the files into memory.

Ids are those of the library for the whole text, control strings included.  Where the tokenizer's own normaliser, pre-tokeniser
and added tokens let no piece span or see ASCII white space (``cuts_at_space``), texts are cut there, and each distinct chunk is
given to the library as it is, once; for any other tokenizer the library gets whole texts.

Defined results: a null or empty text has the end id alone; null ids sort first; repeated rows stay, each a document of
its own; rows of one id are ordered by text; a very long text is one document, encoded whole; other columns, whatever their names, are not
read; empty tables make no files and give no rows.
"""

from __future__ import annotations

import json
import uuid
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import new_folder, open_shared, pieces, shuffle_partitions, stage

END_ID = 2
#: Distinct chunks remembered by a worker: some 220 MB.
REMEMBERED = 1_200_000
#: Bytes of text encoded at a time; one longer text goes alone.
PIECE_BYTES = 4 << 20
NULL_ID = -(2**63)
#: Steps that treat each run between white space by itself.  Fixed values of the public file format.
NORMALISERS = {"NFC", "NFD", "NFKC", "NFKD", "Lowercase", "StripAccents"}
SPLITTERS = {"Whitespace", "WhitespaceSplit", "BertPreTokenizer"}
SPACE_RUN = {"Regex": r"\s+"}
SPACELESS = {r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}

_encoders: dict = {}


def _steps(part: dict | None, inner: str) -> list[dict]:
    if not part:
        return []
    return [x for p in part[inner] for x in _steps(p, inner)] if part["type"] == "Sequence" else [part]


def cuts_at_space(described: dict) -> bool:
    """Whether a tokenizer (its JSON file) gives a text the ids of its runs between ASCII white space, one after another."""
    for n in _steps(described.get("normalizer"), "normalizers"):
        if n["type"] not in NORMALISERS and not (n["type"] == "Replace" and n["pattern"] == SPACE_RUN and n["content"] == " "):
            return False
    first = (_steps(described.get("pre_tokenizer"), "pretokenizers") or [{"type": None}])[0]
    found = first["type"] == "Split" and first["pattern"].get("Regex") in SPACELESS and first["behavior"] == "Removed" and first["invert"]
    if first["type"] not in SPLITTERS and not found:
        return False
    return not any(t["lstrip"] or t["rstrip"] or t["single_word"] or any(c.isspace() for c in t["content"]) for t in described.get("added_tokens") or [])


class Encoder:
    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            self.cut = cuts_at_space(json.load(f))
        self.type = np.dtype("<u2" if max(self.tokenizer.get_vocab().values()) < 1 << 16 else "<u4")
        self.place: dict[str, int] = {}
        self._forget()

    def _forget(self, kept: list[str] | None = None) -> None:
        """Keep these remembered chunks only."""
        old = np.array([self.place[c] for c in kept or []], np.int64)
        size = self.ends[old + 1] - self.ends[old] if kept else old
        ends = np.concatenate([[0], np.cumsum(size)])
        self.flat = self.flat[np.repeat(self.ends[old] - ends[:-1], size) + np.arange(ends[-1])] if kept else np.zeros(0, self.type)
        self.place = {c: i for i, c in enumerate(kept or [])}
        self.ends, self.again = ends, np.zeros(len(old), bool)

    def _library(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, lengths)."""
        ids, lengths = [np.zeros(0, self.type)], [np.zeros(0, np.int64)]
        for at in range(0, len(texts), 8192):
            got = [e.ids for e in self.tokenizer.encode_batch_fast(texts[at : at + 8192], add_special_tokens=False)]
            lengths.append(np.fromiter(map(len, got), np.int64, len(got)))
            ids.append(np.fromiter(chain.from_iterable(got), self.type, lengths[-1].sum()))
        return np.concatenate(ids), np.concatenate(lengths)

    def _places(self, chunks: list[str]) -> np.ndarray:
        """Places of distinct chunks among the remembered ones; new ones are learned."""
        if len(self.place) > REMEMBERED:  # those met again since they were learned, or since the last time
            kept = [c for c, i in self.place.items() if self.again[i]]
            self._forget(kept if 4 * len(kept) < 3 * REMEMBERED else None)
        new = [c for c in chunks if c not in self.place]
        known = len(self.place)
        if new:
            ids, lengths = self._library(new)
            self.place.update(zip(new, range(known, known + len(new)), strict=True))
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(lengths)])
            self.flat = np.concatenate([self.flat, ids])
            self.again = np.concatenate([self.again, np.zeros(len(new), bool)])
        found = np.fromiter(map(self.place.__getitem__, chunks), np.int64, len(chunks))
        self.again[found[found < known]] = True
        return found

    def _cut(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        runs = pc.ascii_split_whitespace(texts)
        chunks = pc.dictionary_encode(runs.flatten())
        at = self._places(chunks.dictionary.to_pylist())[chunks.indices.to_numpy()]
        start, size = self.ends[at], self.ends[at + 1] - self.ends[at]
        before = np.concatenate([[0], np.cumsum(size)])
        ids = self.flat[np.repeat(start - before[:-1], size) + np.arange(before[-1])]
        return ids, np.diff(before[runs.offsets.to_numpy() - runs.offsets[0].as_py()])

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, lengths) of the texts, the end id after each."""
        texts = texts.cast(pa.large_string()).fill_null("")
        ids, lengths = self._cut(texts) if self.cut else self._library(texts.to_pylist())
        return np.insert(ids, np.cumsum(lengths), end_id), lengths + 1


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def write_tokens(docs: DataFrame, tokenizer_path: str, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> DataFrame:
    """Write the files; returns the committed manifest (name, first, part, docs, ids, start) in file order.

    The text is shuffled once, into id ranges.
    """
    folder = folder or new_folder(docs.sparkSession, "tokens")
    ordered = docs.select(F.col(id_col).cast("long").alias("tk_id"), F.col(text_col).alias("tk_text")).repartitionByRange("tk_id").sortWithinPartitions("tk_id", "tk_text")

    def write(batches):
        name, part = uuid.uuid4().hex, None
        fs, root = open_shared(folder)
        lengths, ids, out, enc = [], [], None, None
        for batch in batches:
            for piece in pieces(batch, 1, PIECE_BYTES):
                if out is None:
                    from pyspark import TaskContext

                    part = TaskContext.get().partitionId()
                    fs.create_dir(root, recursive=True)
                    out = fs.open_output_stream(f"{root}/{name}.bin")
                    enc = encoder(tokenizer_path)
                got, n = enc.encode(piece.column(1), end_id)
                out.write(got.astype(enc.type).tobytes())
                lengths.append(n)
                ids.append(piece.column(0).fill_null(NULL_ID).to_numpy().astype("<i8"))
        if out is None:
            return
        out.close()
        offsets = np.concatenate([[0], np.cumsum(np.concatenate(lengths))])
        with fs.open_output_stream(f"{root}/{name}.idx") as idx:
            idx.write(offsets.astype("<u8").tobytes())
            idx.write(np.concatenate(ids).tobytes())
        yield pa.RecordBatch.from_pydict({"name": [name], "part": [part], "docs": [len(offsets) - 1], "ids": [int(offsets[-1])], "width": [enc.type.itemsize]}, schema=pa.schema([("name", pa.string()), ("part", pa.int64()), ("docs", pa.int64()), ("ids", pa.int64()), ("width", pa.int64())]))

    manifest = stage(ordered.mapInArrow(write, "name string, part long, docs long, ids long, width long"), "manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    return manifest.select(F.lit(folder).alias("folder"), "name", "part", "docs", "ids", "width", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("start"))


def open_file(folder: str, name: str, width: int, docs: int):
    """(ids, offsets, document ids) of one file; memory-mapped where the folder is a local path."""
    fs, root = open_shared(folder)
    kind = np.dtype(f"<u{width}")
    if fs.type_name == "local":
        flat = np.memmap(f"{root}/{name}.bin", kind, "r")
        index = np.memmap(f"{root}/{name}.idx", "u1", "r")
    else:
        with fs.open_input_stream(f"{root}/{name}.bin") as f:
            flat = np.frombuffer(f.read(), kind)
        with fs.open_input_stream(f"{root}/{name}.idx") as f:
            index = np.frombuffer(f.read(), "u1")
    cut = 8 * (docs + 1)
    return flat, index[:cut].view("<u8"), index[cut:].view("<i8")


def read_tokens(manifest: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every document, from the files: a task takes whole files."""

    def read(batches):
        for batch in batches:
            for row in batch.to_pylist():
                flat, offsets, ids = open_file(row["folder"], row["name"], row["width"], row["docs"])
                for at in range(0, row["docs"], 4096):
                    own = range(at, min(at + 4096, row["docs"]))
                    crc = [zlib.crc32(flat[offsets[i] : offsets[i + 1]].astype("<u4").tobytes()) for i in own]
                    o = offsets[at : at + len(own) + 1].astype(np.int64)
                    keys = ids[at : at + len(own)].astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64(), mask=keys == NULL_ID), pa.array(o[:-1] + row["start"]), pa.array(np.diff(o)), pa.array(crc, pa.int64())], names=[id_col, "start", "n_tokens", "ids_crc32"])

    # manifest rows are tiny, so their size says nothing of the work
    tasks = max(shuffle_partitions(manifest.sparkSession), min(100_000, manifest.count() // 4))
    return manifest.repartition(tasks, "name").mapInArrow(read, f"`{id_col}` long, start long, n_tokens long, ids_crc32 long")
