"""Removal of repeated 50-byte strings, by prefix-free parsing of the corpus.

Texts are parsed into phrases that end where the hash of the last ``TRIGGER`` bytes is a trigger.  Each phrase is taken with the 49
bytes after it, its overlap with the next ones, so it holds every 50-byte string that starts in it:

1. The dictionary: distinct phrases, by a 128-bit cryptographic digest of their bytes.  The parse, texts as rows of
   phrases, gives each the least document that has it.  Occurrences in larger documents are covered as a whole; what is left to
   compare is the dictionary, however repetitive the corpus is.
2. Suffixes of dictionary phrases, cut at 50 bytes, are compared only if they can have an equal one in another document:
   the least hash of the 26-byte grams of a string is the same in equal strings, so strings whose least
   gram occurs in one document alone are left out.
3. The remaining suffixes go, as the stretches of text that share a least gram, to parts by that gram, so equal strings meet.  A part
   expands its stretches and sorts all suffixes: its share of the dictionary's suffix array, with the common prefixes of
   neighbours.  Each interval of common prefixes of 50 bytes is one string; the least document of its phrases covers all others.
4. As phrases overlap by 49 bytes, no string leaves its phrase.  The suffix array of the parse orders equal dictionary suffixes by what
   follows them, so an interval and its least document do not depend on it; ``corpus_order`` combines both arrays into the order of
   all suffixes of the corpus.

Documents are written once, in segments of a few MB, to the shared folder; after that only digests, stretches and
bits move between segments and parts.  Each segment sends a stretch once, however many of its documents have it.  A gram that is
heavy in a sample (that of a passage at the edges of very many phrases) is split: its strings go to parts by their own hashes.  The
number of parts follows the data, so no task grows with it.

Defined results: a null text is empty, nothing is removed from it; rows of one id never cover one another; a null id
is below all others; strings in one document alone stay however often they occur there; a text longer than a segment is one segment
by itself, whole; other columns, whatever their names, are not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import new_folder, open_shared, shuffle_partitions, stage
from .hashing import U, mixed, powers, prefix_sums, span_hashes

LENGTH, TRIGGER, PHRASE, GRAM = 50, 12, 96, 26
SEGMENT_BYTES = 3 << 19
#: Segments whose digests or grams make a hash range, bytes of strings in a part, and the most of each.
RANGE_SEGMENTS, PART_BYTES, MOST_PARTS = 16, 24 << 20, 65_536
#: Strings of a part that are sorted at a time.
PASS_STRINGS = 150_000
#: Most strings of a stretch, so equal stretches are of equal length more often.
STRETCH = LENGTH - GRAM + 1
#: One of so many stretches of a segment is sampled; so many come to the driver at most.
SAMPLE_STEP, SAMPLE_MOST = 256, 500_000
#: A gram is heavy if its strings are this share of a part or more.
HEAVY = 0.25
NULL_ID = -(2**63)
STRING, DIGEST = np.dtype(f"S{LENGTH}"), np.dtype("S16")


@dataclass
class Segment:
    """Documents in ascending order, their bytes in one array."""

    ids: np.ndarray
    ends: np.ndarray
    data: np.ndarray

    @property
    def starts(self) -> np.ndarray:
        return np.concatenate([[0], self.ends[:-1]]).astype(np.int64)

    def docs_at(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, at, side="right")


def _write(folder: str, name: str, columns: dict) -> None:
    fs, root = open_shared(folder)
    fs.create_dir(root, recursive=True)
    batch = pa.record_batch(list(columns.values()), names=list(columns))
    with fs.open_output_stream(f"{root}/{name}") as out, pa.ipc.new_stream(out, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_batch(batch)


def _read(folder: str, name: str) -> pa.Table:
    fs, root = open_shared(folder)
    with fs.open_input_stream(f"{root}/{name}") as f:
        return pa.ipc.open_stream(f).read_all()


def _segment(ids, texts: list[bytes]) -> Segment:
    return Segment(np.asarray(ids, np.int64), np.cumsum([len(t) for t in texts], dtype=np.int64), np.frombuffer(b"".join(texts), np.uint8))


def read_segment(folder: str, name: str) -> Segment:
    t = _read(folder, f"{name}.seg")
    return _segment(t.column("id").to_numpy(), t.column("text").to_pylist())


class Phrases:
    """Phrases of a segment in which a string of LENGTH bytes starts: [start, stop) of such strings' starts, document, and the
    place of its digest among the segment's distinct ones."""

    def __init__(self, seg: Segment, start: np.ndarray, stop: np.ndarray, back: np.ndarray):
        self.start, self.stop, self.back, self.doc = start, stop, back, seg.docs_at(start)
        self.first = np.full(int(back.max()) + 1 if len(back) else 0, len(seg.ids))
        np.minimum.at(self.first, back, self.doc)

    def covered(self, seg: Segment, answer) -> np.ndarray:
        """Whether a smaller document has the phrase: another segment's, or an earlier one of this."""
        ids = seg.ids[self.doc]
        return _bits(answer)[self.back] | (seg.ids[self.first[self.back]] < ids) if len(ids) else np.zeros(0, bool)

    def strings(self, chosen: np.ndarray) -> np.ndarray:
        """Starts of all strings of the chosen phrases."""
        a, n = self.start[chosen], (self.stop - self.start)[chosen]
        return np.repeat(a - np.cumsum(n) + n, n) + np.arange(n.sum())


def parse_segment(seg: Segment, phrase: int = PHRASE) -> tuple[Phrases, np.ndarray]:
    """(phrases, their distinct digests in order)."""
    n, starts, ends = len(seg.data), seg.starts, seg.ends
    marks = np.zeros(n + 1, bool)
    if n > TRIGGER:
        sums = prefix_sums(seg.data)
        own = (sums[TRIGGER:] - sums[:-TRIGGER]) * powers(n + 1)[1][: n - TRIGGER + 1]
        marks[TRIGGER:] = (own * U(0x9E3779B97F4A7C15) >> U(44)) % U(phrase) == 0  # the phrase ends after these bytes
        for s in starts:
            marks[s + 1 : s + TRIGGER] = False  # bytes of two documents
    marks[starts[starts < n]] = True
    marks[n] = False
    cuts = np.flatnonzero(marks)
    stop = np.minimum(np.append(cuts[1:], n), ends[seg.docs_at(cuts)] - LENGTH + 1) if len(cuts) else cuts
    real = stop > cuts
    start, stop = cuts[real], stop[real]
    raw = seg.data.tobytes()
    digests = b"".join([hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(start.tolist(), (stop + LENGTH - 1).tolist(), strict=True)])
    unique, back = np.unique(np.frombuffer(digests, DIGEST), return_inverse=True)
    return Phrases(seg, start, stop, back), unique


def read_phrases(folder: str, name: str, seg: Segment) -> Phrases:
    t = _read(folder, f"{name}.phrases")
    return Phrases(seg, *(t.column(c).to_numpy() for c in ("start", "stop", "back")))


def least_grams(seg: Segment, at: np.ndarray) -> np.ndarray:
    """Least hash of the grams of each string."""
    sums = prefix_sums(seg.data)
    n = len(sums) - GRAM
    x = mixed((sums[GRAM:] - sums[:-GRAM]) * powers(len(sums))[1][:n] + U(GRAM))
    width, have = LENGTH - GRAM + 1, 1
    while have < width:
        step = min(have, width - have)
        x = np.minimum(x[: len(x) - step], x[step:])
        have += step
    return x[at]


def spans_of(seg: Segment, start: np.ndarray, length: np.ndarray, width: int) -> np.ndarray:
    """The bytes of spans of at most width bytes as fixed-width values: the length, then the bytes, then zeros."""
    if not len(start):
        return np.zeros(0, f"S{width + 1}")
    data = np.concatenate([seg.data, np.zeros(width, np.uint8)])
    out = np.empty((len(start), width + 1), np.uint8)
    out[:, 0] = length
    out[:, 1:] = np.lib.stride_tricks.sliding_window_view(data, width)[start]
    out[:, 1:][np.arange(width) >= length[:, None]] = 0
    return out.view(f"S{width + 1}").ravel()


def distinct_spans(seg: Segment, start: np.ndarray, length: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(places of the first of each distinct span, in text order; place of each span's first among them).

    Equal hashes are grouped, then held to their bytes; should two differ, the bytes themselves are sorted.
    """
    if not len(start):
        return start, start
    _, first, back = np.unique(span_hashes(prefix_sums(seg.data), start, start + length), return_index=True, return_inverse=True)
    own = spans_of(seg, start, length, width)
    if not (own == own[first][back]).all():
        _, first, back = np.unique(own, return_index=True, return_inverse=True)
    order = np.argsort(first)
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    return first[order], place[back]


def suffix_array(strings: np.ndarray) -> np.ndarray:
    """Lexicographic order of strings; equal ones in their given order."""
    return np.argsort(strings, kind="stable")


def common_prefixes(ordered: np.ndarray) -> np.ndarray:
    """Bytes that each string shares with the one before it; 0 for the first."""
    b = ordered.view(np.uint8).reshape(len(ordered), ordered.dtype.itemsize)
    differ = b[1:] != b[:-1]
    return np.concatenate([[0], np.where(differ.any(1), differ.argmax(1), b.shape[1])]) if len(b) else np.zeros(0, int)


def _smaller(keys: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Whether a document smaller than the sender's has the key: keys are put in order, and each interval of neighbours that
    agree in all bytes has a least document."""
    order = suffix_array(keys)
    ordered, d = keys[order], docs[order]
    head = np.flatnonzero(common_prefixes(ordered) < keys.dtype.itemsize)
    least = np.repeat(np.minimum.reduceat(d, head), np.diff(np.append(head, len(d)))) if len(d) else d
    out = np.empty(len(keys), bool)
    out[order] = least < d
    return out


def _several(keys: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Whether a key has several senders, or one that has it in several documents."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    same = k[1:] == k[:-1]
    out = np.empty(len(keys), bool)
    out[order] = np.concatenate([[False], same]) | np.concatenate([same, [False]])
    return out | (many > 0)


SENT = "seg string, bucket int, n long, keys binary, vals binary"
BITS = "seg string, bucket int, n long, bits binary"


def _packed(a: np.ndarray) -> bytes:
    return pa.compress(a.tobytes(), codec="zstd", asbytes=True) if len(a) else b""


def _unpacked(b: bytes, n: int, kind) -> np.ndarray:
    kind = np.dtype(kind)
    return np.frombuffer(pa.decompress(b, decompressed_size=n * kind.itemsize, codec="zstd", asbytes=True), kind) if n else np.zeros(0, kind)


def _sent(name: str, cut: np.ndarray, keys: np.ndarray, vals: np.ndarray) -> pa.RecordBatch:
    """Rows of a segment: the slice [cut[k], cut[k + 1]) of its keys and values goes to range k."""
    own = np.flatnonzero(cut[1:] > cut[:-1]).tolist()
    slices = [slice(cut[k], cut[k + 1]) for k in own]
    return pa.RecordBatch.from_arrays(
        [pa.array([name] * len(own), pa.string()), pa.array(own, pa.int32()), pa.array([s.stop - s.start for s in slices], pa.int64()), pa.array([_packed(keys[s]) for s in slices], pa.binary()), pa.array([_packed(vals[s]) for s in slices], pa.binary())],
        names=["seg", "bucket", "n", "keys", "vals"],
    )


def _bits_of(decide, key, val):
    """decide(keys, values) over rows of packed keys and values."""

    def bits(rows: list[dict]) -> list[np.ndarray]:
        keys, vals = (np.concatenate([_unpacked(r[c], r["n"], kind) for r in rows]) for c, kind in (("keys", key), ("vals", val)))
        return np.split(decide(keys, vals), np.cumsum([r["n"] for r in rows])[:-1])

    return bits


def _answer(sent: DataFrame, ranges: int, bits_of) -> DataFrame:
    """For each segment the bits that bits_of(rows) gives for what it sent, in the order sent; a range is one Arrow group."""

    def one(table: pa.Table) -> pa.Table:
        bits = [np.packbits(b).tobytes() for b in bits_of(table.to_pylist())]
        return table.select(["seg", "bucket", "n"]).append_column("bits", pa.array(bits, pa.binary()))

    back = sent.repartition(max(ranges, shuffle_partitions(sent.sparkSession)), "bucket").groupBy("bucket").applyInArrow(one, BITS)
    return back.groupBy("seg").agg(F.array_sort(F.collect_list(F.struct("bucket", "n", "bits"))).alias("answer"))


def _bits(answer) -> np.ndarray:
    return np.concatenate([np.zeros(0, bool)] + [np.unpackbits(np.frombuffer(a["bits"], np.uint8), count=a["n"]).astype(bool) for a in answer or []])


def _hash_cut(top: np.ndarray, ranges: int) -> np.ndarray:
    """Bounds of the hash ranges in ascending 32-bit values."""
    return np.searchsorted(top.astype(U) * U(ranges) >> U(32), np.arange(ranges + 1, dtype=U))


def _anchors(seg: Segment, phrases: Phrases, answer):
    """(starts, heads, least gram of each head): the strings of uncovered phrases; a run of strings in one document with one least
    gram has one head."""
    at = phrases.strings(np.flatnonzero(~phrases.covered(seg, answer)))
    if not len(at):
        return at, at, np.zeros(0, U)
    x, doc = least_grams(seg, at), seg.docs_at(at)
    head = np.flatnonzero(np.concatenate([[True], (x[1:] != x[:-1]) | (doc[1:] != doc[:-1])]))
    return at, head, x[head]


def _in_range(x: np.ndarray, ranges: int) -> np.ndarray:
    """32 bits of a hash within its hash range."""
    return ((x >> U(32)) * U(ranges) >> U(32) << U(32)) | (x & U(0xFFFFFFFF))


def stretches(at: np.ndarray, head: np.ndarray, x: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, strings, least gram) of runs of following starts with one kept gram, of at most STRETCH strings each."""
    sizes = np.diff(np.append(head, len(at)))
    x, at = np.repeat(x[keep], sizes[keep]), at[np.repeat(keep, sizes)]
    if not len(at):
        return at, at, x
    new = np.concatenate([[True], (at[1:] != at[:-1] + 1) | (x[1:] != x[:-1])])
    first = np.flatnonzero(new)
    inside = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
    first = np.flatnonzero(inside % STRETCH == 0)
    return at[first], np.diff(np.append(first, len(at))), x[first]


def _stored(folder: str, name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    t = _read(folder, f"{name}.stretches")
    return tuple(t.column(c).to_numpy() for c in ("start", "n", "gram"))


class Pieces:
    """What a segment sends: its distinct stretches, and the single strings of heavy grams, by part, then in text order."""

    def __init__(self, seg: Segment, start: np.ndarray, n: np.ndarray, gram: np.ndarray, parts: int, heavy: np.ndarray):
        single = np.isin(gram, heavy)
        size = np.where(single, n, 1)
        inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        single, start, n, gram = (np.repeat(v, size) for v in (single, start, n, gram))
        start, n = np.where(single, start + inside, start), np.where(single, 1, n)
        first, self.back = distinct_spans(seg, start, n + LENGTH - 1, LENGTH + STRETCH - 1)
        key = np.where(single[first], span_hashes(prefix_sums(seg.data), start[first], start[first] + LENGTH), gram[first])
        part = ((key >> U(32)) * U(parts) >> U(32)).astype(np.int32)
        order = np.argsort(part, kind="stable")
        self.start, self.n, self.doc = start, n, seg.docs_at(start)  # of every stretch
        self.sent, self.cut = first[order], np.searchsorted(part[order], np.arange(parts + 1))
        self.place = np.empty_like(order)  # of a distinct stretch among the sent ones
        self.place[order] = np.arange(len(order))


def expanded(lengths: np.ndarray, data: np.ndarray, chosen: np.ndarray | slice = slice(None)) -> np.ndarray:
    """The chosen ones of all strings of stretches of so many strings, whose bytes follow one another."""
    size = lengths + LENGTH - 1
    base = np.cumsum(size) - size
    at = (np.repeat(base - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum()))[chosen]
    return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, LENGTH)[at]).view(STRING).ravel()


def mark_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None, segment_bytes: int = SEGMENT_BYTES, sample_step: int = SAMPLE_STEP, part_bytes: int = PART_BYTES):
    """(segments with their answers, folder, parts, heavy grams), for removed_bytes."""
    spark = docs.sparkSession
    folder = new_folder(spark, "segments")
    least = shuffle_partitions(spark)

    def parse(batches):
        ids, texts, size = [], [], 0

        def flush():
            name = uuid.uuid4().hex
            order = sorted(range(len(ids)), key=ids.__getitem__)
            own = [texts[i] for i in order]
            seg = _segment([ids[i] for i in order], own)
            _write(folder, f"{name}.seg", {"id": pa.array(seg.ids), "text": pa.array(own, pa.large_binary())})
            phrases, unique = parse_segment(seg)
            _write(folder, f"{name}.phrases", {"start": pa.array(phrases.start), "stop": pa.array(phrases.stop), "back": pa.array(phrases.back)})
            firsts = seg.ids[phrases.first] if len(unique) else np.zeros(0, np.int64)
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([0], pa.int32()), pa.array([len(unique)], pa.int64()), pa.array([unique.tobytes()], pa.binary()), pa.array([firsts.tobytes()], pa.binary())], names=["seg", "bucket", "n", "keys", "vals"])

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                ids.append(NULL_ID if i is None else i)
                texts.append(text.as_py() or b"")
                size += len(texts[-1])
                if size >= segment_bytes or len(ids) >= 50_000:
                    yield flush()
                    ids, texts, size = [], [], 0
        if ids:
            yield flush()

    parsed = stage(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(parse, SENT), "phrases")
    segs = parsed.select("seg")
    n_segs = parsed.count()
    buckets = buckets or min(MOST_PARTS, max(16, n_segs // RANGE_SEGMENTS))
    # rows are names and bits, so their size says nothing of the work: a few segments make a task
    tasks = max(least, min(100_000, n_segs // 4))

    def deal(batches):
        for batch in batches:
            for row in batch.to_pylist():
                keys, vals = np.frombuffer(row["keys"], DIGEST), np.frombuffer(row["vals"], np.int64)
                top = np.frombuffer(row["keys"], ">u4").reshape(-1, 4)[:, 0]
                yield _sent(row["seg"], _hash_cut(top, buckets), keys, vals)

    answers = [stage(_answer(parsed.mapInArrow(deal, SENT), buckets, _bits_of(_smaller, DIGEST, np.int64)), "phrase-answers")]

    def with_answers():
        out = segs
        for i, a in enumerate(answers):
            out = out.join(a.withColumnRenamed("answer", f"a{i}"), "seg", "left")
        return out.repartition(tasks, "seg")

    def anchors(batches):
        for batch in batches:
            for row in batch.to_pylist():
                seg = read_segment(folder, row["seg"])
                at, head, x = _anchors(seg, read_phrases(folder, row["seg"], seg), row["a0"])
                if not len(at):
                    continue
                own = _in_range(x, buckets)
                order = np.argsort(own, kind="stable")
                own, ids = own[order], seg.ids[seg.docs_at(at[head[order]])]
                edge = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
                # starts ascend within equal anchors, and documents with them: first and last tell whether there are several
                many = ids[edge] != ids[np.append(edge[1:], len(own)) - 1]
                yield _sent(row["seg"], np.searchsorted(own[edge] >> U(32), np.arange(buckets + 1, dtype=U)), own[edge].astype(np.uint32), many.astype(np.uint8))

    answers.append(stage(_answer(with_answers().mapInArrow(anchors, SENT), buckets, _bits_of(_several, np.uint32, np.uint8)), "anchor-answers"))

    def candidates(batches):
        for batch in batches:
            for row in batch.to_pylist():
                seg = read_segment(folder, row["seg"])
                at, head, x = _anchors(seg, read_phrases(folder, row["seg"], seg), row["a0"])
                keep = np.zeros(0, bool)
                if len(at):
                    _, back = np.unique(_in_range(x, buckets), return_inverse=True)
                    keep = _bits(row["a1"])[back]
                start, n, gram = stretches(at, head, x, keep)
                _write(folder, f"{row['seg']}.stretches", {"start": pa.array(start, pa.int64()), "n": pa.array(n, pa.int64()), "gram": pa.array(gram, pa.uint64())})
                first, _ = distinct_spans(seg, start, n + LENGTH - 1, LENGTH + STRETCH - 1)
                some = first[zlib.crc32(row["seg"].encode()) % sample_step :: sample_step]
                yield pa.RecordBatch.from_arrays([pa.array([int(n[first].sum())], pa.int64()), pa.array([gram[some].tobytes()], pa.binary()), pa.array([n[some].astype(np.uint8).tobytes()], pa.binary())], names=["n", "grams", "sizes"])

    counts = stage(with_answers().mapInArrow(candidates, "n long, grams binary, sizes binary"), "candidates")
    total, sampled = (int(x) for x in counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.length("sizes")), F.lit(0))).first())
    stride = -(-sampled // SAMPLE_MOST) or 1
    parts = min(MOST_PARTS, max(least, -(-total * (LENGTH + 8) // part_bytes)))

    def thin(batches):
        for batch in batches:
            for g, k in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = slice(zlib.crc32(g) % stride, None, stride)
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(g, np.int64)[own]), pa.array(np.frombuffer(k, np.uint8)[own].astype(np.int64))], names=["gram", "n"])

    # SAMPLE_MOST stretches or so are counted, of which a heavy gram has 8 at least: a bounded list
    often = counts.select("grams", "sizes").mapInArrow(thin, "gram long, n long").groupBy("gram").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"))
    share = HEAVY * total / parts / sample_step / stride
    heavy = np.array(sorted(r["gram"] for r in often.filter((F.col("k") >= 8) & (F.col("n") >= share)).collect()), np.int64).view(U)

    def suffixes(batches):
        for batch in batches:
            for row in batch.to_pylist():
                seg = read_segment(folder, row["seg"])
                own = Pieces(seg, *_stored(folder, row["seg"]), parts, heavy)
                if len(own.sent):
                    yield _sent_pieces(row["seg"], seg, own)

    answers.append(stage(_answer(with_answers().mapInArrow(suffixes, SENT), parts, _piece_bits), "suffix-answers"))
    return with_answers(), folder, parts, heavy


def _sent_pieces(name: str, seg: Segment, own: Pieces) -> pa.RecordBatch:
    rows = [(k, own.sent[a:b]) for k, (a, b) in enumerate(zip(own.cut, own.cut[1:], strict=False)) if a < b]
    out = {"seg": [], "bucket": [], "n": [], "keys": [], "vals": []}
    for k, sent in rows:
        n, start = own.n[sent], own.start[sent]
        size = n + LENGTH - 1
        data = seg.data[np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())]
        lengths = n.astype(np.uint8).tobytes()
        out["seg"].append(name)
        out["bucket"].append(k)
        out["n"].append(int(n.sum()))
        out["keys"].append(len(n).to_bytes(8, "little") + len(data).to_bytes(8, "little") + pa.compress(lengths + data.tobytes(), codec="zstd", asbytes=True))
        out["vals"].append(_packed(seg.ids[own.doc[sent]]))
    return pa.RecordBatch.from_pydict(out, schema=pa.schema([("seg", pa.string()), ("bucket", pa.int32()), ("n", pa.int64()), ("keys", pa.binary()), ("vals", pa.binary())]))


def _piece_bits(rows: list[dict], most: int = PASS_STRINGS) -> list[np.ndarray]:
    """For the strings of each row's stretches, whether a smaller document has them.

    A part of more than some ``most`` strings is sorted in lexicographic ranges, one after another, so its memory is bounded however
    many strings a part has.
    """
    sent = []
    for r in rows:
        m, size = (int.from_bytes(r["keys"][k : k + 8], "little") for k in (0, 8))
        raw = np.frombuffer(pa.decompress(r["keys"][16:], decompressed_size=m + size, codec="zstd", asbytes=True), np.uint8)
        sent.append((raw[:m].astype(np.int64), raw[m:], _unpacked(r["vals"], m, np.int64)))
    total = sum(r["n"] for r in rows)
    step = max(1, total // 20_000)
    sample = np.sort(np.concatenate([expanded(n, data, slice(None, None, step)) for n, data, _ in sent]))
    count = -(-total // most)
    bounds = np.unique(sample[np.arange(1, count) * len(sample) // count])
    ranges = [np.searchsorted(bounds, expanded(n, data), side="right").astype(np.uint16) for n, data, _ in sent]
    out = [np.zeros(len(x), bool) for x in ranges]
    for k in range(len(bounds) + 1):
        own = [np.flatnonzero(x == k) for x in ranges]
        strings = np.concatenate([expanded(n, data, at) for (n, data, _), at in zip(sent, own, strict=True)])
        docs = np.concatenate([np.repeat(d, n)[at] for (n, _, d), at in zip(sent, own, strict=True)])
        bits, ends = _smaller(strings, docs), np.cumsum([len(at) for at in own])
        for x, at, b in zip(out, own, np.split(bits, ends[:-1]), strict=True):
            x[at] = b
    return out


def removed_bytes(seg: Segment, phrases: Phrases, stored, row, parts: int, heavy: np.ndarray) -> np.ndarray:
    """Whether each byte of the segment is to be removed."""
    covered = phrases.covered(seg, row["a0"])
    steps = np.zeros(len(seg.data) + LENGTH + 1, np.int32)
    np.add.at(steps, phrases.start[covered], 1)
    np.add.at(steps, phrases.stop[covered] + LENGTH - 1, -1)
    own = Pieces(seg, *stored, parts, heavy)
    if len(own.sent):
        bits, size = _bits(row["a2"]), own.n[own.sent]
        base = np.cumsum(size) - size  # of each sent stretch's strings in the answer
        mine = own.place[own.back]
        inside = np.arange(own.n.sum()) - np.repeat(np.cumsum(own.n) - own.n, own.n)
        ids = seg.ids[own.doc]
        earlier = seg.ids[own.doc[own.sent[mine]]] < ids  # the first of equal stretches is in a smaller document
        gone = bits[np.repeat(base[mine], own.n) + inside] | np.repeat(earlier, own.n)
        at = (np.repeat(own.start, own.n) + inside)[gone]
        np.add.at(steps, at, 1)
        np.add.at(steps, at + LENGTH, -1)
    return np.cumsum(steps)[: len(seg.data)] > 0


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, **options) -> DataFrame:
    """One row per row of docs: id, n_bytes, n_removed, n_spans, kept_sha256, and with_text the kept bytes.  Options: see mark_repeats."""
    marked, folder, parts, heavy = mark_repeats(docs, id_col, text_col, **options)

    def apply(batches):
        for batch in batches:
            for row in batch.to_pylist():
                seg = read_segment(folder, row["seg"])
                gone = removed_bytes(seg, read_phrases(folder, row["seg"], seg), _stored(folder, row["seg"]), row, parts, heavy)
                out = {"id": [], "n": [], "removed": [], "spans": [], "sha": [], "kept": []}
                for i, a, b in zip(seg.ids.tolist(), seg.starts, seg.ends, strict=True):
                    g = gone[a:b]
                    kept = seg.data[a:b][~g].tobytes()
                    out["id"].append(None if i == NULL_ID else i)
                    out["n"].append(int(b - a))
                    out["removed"].append(int(b - a) - len(kept))
                    out["spans"].append(int(g[:1].sum() + (g[1:] & ~g[:-1]).sum()))
                    out["sha"].append(hashlib.sha256(kept).hexdigest())
                    out["kept"].append(kept if with_text else None)
                kinds = [pa.int64()] * 4 + [pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)], names=[id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    rows = marked.mapInArrow(apply, f"`{id_col}` long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return rows if with_text else rows.drop("kept")


def _ordered_ids(df: DataFrame, by: list[str], label: str, name: str) -> DataFrame:
    """df with name: longs that ascend with the sort by (partition and place of the range sort), written once."""
    return stage(df.orderBy(*by).withColumn(name, F.monotonically_increasing_id() + 1), label)


def corpus_order(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrase: int = PHRASE) -> DataFrame:
    """(id, at, rank): the order of all suffixes of all texts, by bytes, then id; at: byte offset.  One row per byte of text.

    Phrases overlap by a trigger of ``TRIGGER`` bytes.  The dictionary's phrases are sorted; the parse's suffixes (of each text) by doubling:
    in round k, 2^k phrases from each place.  A suffix of the corpus is a dictionary suffix, up to the end of the next trigger, and
    what follows, a suffix of the parse; as no dictionary suffix is the start of another, that pair is its order.
    """

    def cut(batches):
        from pyspark import TaskContext

        doc = TaskContext.get().partitionId() << 33
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                doc += 1
                b = text.as_py() or b""
                data = np.frombuffer(b, np.uint8)
                if len(data) > TRIGGER:
                    sums = prefix_sums(data)
                    own = (sums[TRIGGER:] - sums[:-TRIGGER]) * powers(len(data) + 1)[1][: len(data) - TRIGGER + 1]
                    ends = np.flatnonzero((own * U(0x9E3779B97F4A7C15) >> U(44)) % U(phrase) == 0) + TRIGGER
                    ends = [e for e in ends.tolist() if TRIGGER < e < len(b)] + [len(b)]
                else:
                    ends = [len(b)] if b else []
                starts = [0, *(e - TRIGGER for e in ends[:-1])]
                if ends:
                    yield pa.RecordBatch.from_arrays([pa.array([i] * len(ends), pa.int64()), pa.array([doc] * len(ends), pa.int64()), pa.array(range(len(ends)), pa.int64()), pa.array(starts, pa.int64()), pa.array([b[s:e] for s, e in zip(starts, ends, strict=True)], pa.binary())], names=["id", "doc", "k", "start", "phrase"])

    parse = stage(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(cut, "id long, doc long, k long, start long, phrase binary"), "parse")
    dictionary = _ordered_ids(parse.select("phrase").distinct(), ["phrase"], "dictionary", "r")
    ranks = stage(parse.join(dictionary, "phrase").select("doc", "k", "r"), "ranks")
    longest, step = ranks.agg(F.coalesce(F.max("k"), F.lit(-1)) + 1).first()[0], 1
    while step < longest:
        later = ranks.select("doc", (F.col("k") - step).alias("k"), F.col("r").alias("next"))
        pairs = ranks.join(later, ["doc", "k"], "left").withColumn("next", F.coalesce("next", F.lit(0).cast("long")))
        order = _ordered_ids(pairs.select("r", "next").distinct(), ["r", "next"], "pair-order", "r2")
        ranks, step = stage(pairs.join(order, ["r", "next"]).select("doc", "k", F.col("r2").alias("r")), "ranks"), 2 * step
    after = ranks.select("doc", (F.col("k") - 1).alias("k"), F.col("r").alias("next"))
    own = parse.join(after, ["doc", "k"], "left").withColumn("next", F.coalesce("next", F.lit(0).cast("long")))
    last = F.when(F.col("next") == 0, 1).otherwise(TRIGGER + 1)  # shorter suffixes begin the next phrase
    suffix = own.select("id", "start", "next", "phrase", F.explode(F.sequence(F.lit(0), F.length("phrase") - last)).alias("x"))
    suffix = suffix.select("id", (F.col("start") + F.col("x")).alias("at"), F.expr("substring(phrase, x + 1)").alias("suffix"), "next")
    rows = _ordered_ids(suffix, ["suffix", "next", "id", "at"], "corpus-order", "row").select("id", "at", "row")
    part, place = F.shiftright(F.col("row") - 1, 33), (F.col("row") - 1).bitwiseAND(F.lit((1 << 33) - 1))
    bases = rows.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    bases = bases.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))  # a row per sort partition
    return rows.withColumn("part", part).join(F.broadcast(bases), "part").select(F.col("id").alias(id_col), "at", (F.col("base") + place).alias("rank"))


def deduplicate_plainly(docs: list[tuple[int, str | None]], length: int = LENGTH) -> dict[int, np.ndarray]:
    """Brute force for tests: the removal mask of each document."""
    first: dict[bytes, int] = {}
    texts = [(i, (t or "").encode()) for i, t in docs]
    for i, b in texts:
        for k in range(len(b) - length + 1):
            s = b[k : k + length]
            first[s] = min(first.get(s, i), i)
    out = {}
    for i, b in texts:
        m = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if first[b[k : k + length]] < i:
                m[k : k + length] = True
        out[i] = m
    return out
