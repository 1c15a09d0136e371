"""Benchmark decontamination with one Aho-Corasick automaton over word codes.

Items are lower-cased (A-Z) and cut into words; every window of 13 consecutive words (a shorter
item: all of its words) is a pattern.  Each distinct pattern word has a code, three digits of the automaton's alphabet,
each place with digits of its own, so no node has more than 128 children and matches start at words.  Unknown words get
a code that no pattern has; a match lies in a run of known words, so the automaton takes those runs that are as long as the
shortest pattern, and each text once.  Hit words map back to offsets of the original text.

The executors cut the benchmark into distinct patterns and write them to the shared folder; a Python worker reads them there and builds
the automaton once, so the benchmark passes through neither the driver nor a broadcast.  An automaton takes some 300 bytes a pattern
word, so beyond ``BLOCK_WORDS`` pattern words the patterns are dealt into several files, and the workers take the automata in
turn over larger pieces of text: memory is one automaton and one piece, whatever the benchmark's size.

Defined results: a null text or one without words has no words, no hits and is clean; items without words match nothing; items
of one id count as one; items of null id count as one that is not listed; repeated documents stay, each with its
result; very long texts are scanned whole; other columns, whatever their names, are kept by ``drop_contaminated`` and not read by
``decontaminate``; empty tables give no rows or no hits.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_folder, open_shared, pieces, stage

WINDOW, SHARE = 13, 20
#: Words of the patterns of one automaton: some 150 MB of nodes, and fewer distinct words than there are codes.
BLOCK_WORDS = 500_000
#: Bytes of text scanned at a time, with one automaton and with several.
PIECE_BYTES, TURN_BYTES = 4 << 20, 64 << 20
#: Bytes of words stand for themselves, A-Z for a-z, all others for blanks.
FOLDED = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
RUN = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: First character of each place's digits, and bits of a digit.
DIGITS, DIGIT_BITS = (0x100, 0x200, 0x300), 7
UNKNOWN = "\0" * len(DIGITS)


def words(text: bytes | None) -> list[bytes]:
    return text.translate(FOLDED).split() if text else []


def windows(tokens: list[bytes], width: int = WINDOW) -> Iterator[list[bytes]]:
    """Every width consecutive words, or all of them if they are fewer."""
    if tokens:
        yield from (tokens[i : i + width] for i in range(max(1, len(tokens) - width + 1)))


def write_patterns(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", width: int = WINDOW, block_words: int = BLOCK_WORDS) -> tuple[str, list[str]]:
    """(folder, names of its files): the distinct patterns with their items, in files of some block_words words.

    Only a count of words and the files' names come to the driver.
    """

    def cut(batches):
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                tokens = words(text)
                for at in range(0, max(1, len(tokens) - width + 1), 4096):
                    own = {b" ".join(w) for w in windows(tokens[at : at + 4096 + width - 1], width)}
                    yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.binary()), pa.array([item] * len(own), pa.string())], names=["pattern", "item"])

    cuts = benchmark.select(F.col(item_col).cast("string"), F.col(text_col).cast("string")).mapInArrow(cut, "pattern binary, item string")
    patterns = cuts.groupBy("pattern").agg(F.collect_set("item").alias("items"), F.max(F.col("item").isNull()).alias("nameless"))
    patterns = stage(patterns.withColumn("n", F.size(F.split(F.col("pattern").cast("string"), " ")).cast("long")), "patterns")
    total = patterns.agg(F.sum("n")).first()[0] or 0
    folder = new_folder(benchmark.sparkSession, "automata")

    def write(batches):
        fs, root = open_shared(folder)
        name, out = f"{uuid.uuid4().hex}.patterns", None
        for batch in batches:
            if batch.num_rows and out is None:
                fs.create_dir(root, recursive=True)
                out = fs.open_output_stream(f"{root}/{name}")
                writer = pa.ipc.new_stream(out, batch.schema)
            if out is not None:
                writer.write_batch(batch)
        if out is not None:
            writer.close()
            out.close()
            yield pa.RecordBatch.from_pydict({"name": [name]})

    if not total:
        return folder, []
    dealt = patterns.drop("n").repartition(-(-total // block_words), "pattern").mapInArrow(write, "name string")
    return folder, sorted(r["name"] for r in stage(dealt, "automata-names").collect())


class Automaton:
    """Patterns as strings of word codes."""

    def __init__(self, patterns: list[bytes], items: list[list[str | None]]):
        import ahocorasick

        self.code: dict[bytes, str] = {}
        self.machine = ahocorasick.Automaton()
        least = 1 << 30
        for pattern, own in zip(patterns, items, strict=True):
            tokens = pattern.split(b" ")
            least = min(least, len(tokens))
            self.machine.add_word("".join([self._code(w) for w in tokens]), (len(tokens), own))
        self.machine.make_automaton()
        self.known = re.compile(f"[^\0]{{{len(DIGITS) * least},}}")

    def _code(self, word: bytes) -> str:
        if word not in self.code:
            n = len(self.code)
            self.code[word] = "".join(chr(first + (n >> DIGIT_BITS * k & (1 << DIGIT_BITS) - 1)) for k, first in enumerate(DIGITS))
        return self.code[word]

    def scan(self, tokens: list[bytes], spans: list, items: set) -> None:
        get = self.code.get
        codes = "".join([get(w, UNKNOWN) for w in tokens])
        for run in self.known.finditer(codes):
            for end, (n, found) in self.machine.iter(codes, run.start(), run.end()):
                at = (end + 1) // len(DIGITS)
                spans.append((at - n, at))
                items.update(found)


_built: dict[tuple[str, str], Automaton] = {}


def automaton(folder: str, name: str) -> Automaton:
    """Built once by a worker and kept until it needs another."""
    if (folder, name) not in _built:
        _built.clear()
        fs, root = open_shared(folder)
        with fs.open_input_stream(f"{root}/{name}") as f:
            t = pa.ipc.open_stream(f).read_all()
        items = [own + [None] * nameless for own, nameless in zip(t.column("items").to_pylist(), t.column("nameless").to_pylist(), strict=True)]
        _built[folder, name] = Automaton(t.column("pattern").to_pylist(), items)
    return _built[folder, name]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def scanned(batches: Iterator[pa.RecordBatch], column: int, folder: str, names: list[str]):
    """(rows, [(words, hit runs of words, items) of each row]) for pieces of the batches, of bounded size."""
    for batch in batches:
        for piece in pieces(batch, column, PIECE_BYTES if len(names) < 2 else TURN_BYTES):
            texts = piece.column(column).cast(pa.binary())
            spans, items, n = [[] for _ in range(len(texts))], [set() for _ in range(len(texts))], [0] * len(texts)
            for name in names or [None]:
                machine = automaton(folder, name) if name else None
                for i, text in enumerate(texts):
                    tokens = words(text.as_py())
                    n[i] = len(tokens)
                    if tokens and machine:
                        machine.scan(tokens, spans[i], items[i])
            yield piece, list(zip(n, map(merged, spans), items, strict=True))


def is_contaminated(n_words: int, runs: list[tuple[int, int]], share: int = SHARE) -> bool:
    hit = sum(b - a for a, b in runs)
    return hit > 0 and share * hit >= n_words


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    window: int = WINDOW, share: int = SHARE, block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """One row per document: id, n_words, n_hit, n_items, items_sha256, contaminated, hit_spans (code point offsets into the text).

    One pass over the documents, no shuffle of them.
    """
    folder, names = write_patterns(benchmark, item_col, item_text_col, window, block_words)
    place = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def scan(batches):
        for piece, found in scanned(batches, 1, folder, names):
            rows = []
            for i, (n, runs, items) in enumerate(found):
                at = [m.span() for m in RUN.finditer(piece.column(1)[i].as_py())] if runs else []
                listed = ",".join(sorted(x for x in items if x is not None))
                rows.append((n, sum(b - a for a, b in runs), len(items), hashlib.sha256(listed.encode()).hexdigest(), is_contaminated(n, runs, share), [{"start": at[a][0], "end": at[b - 1][1]} for a, b in runs]))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), place]
            yield pa.RecordBatch.from_arrays([piece.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], names=[id_col, "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "hit_spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(scan, f"`{id_col}` {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, hit_spans array<struct<start: long, end: long>>")


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, share: int = SHARE, block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """docs, all columns, without the contaminated ones; one pass over them, no shuffle of them."""
    folder, names = write_patterns(benchmark, item_col, item_text_col, window, block_words)
    column = docs.columns.index(text_col)

    def scan(batches):
        for piece, found in scanned(batches, column, folder, names):
            yield piece.filter(pa.array([not is_contaminated(n, runs, share) for n, runs, _ in found], pa.bool_()))

    return docs.mapInArrow(scan, docs.schema)
