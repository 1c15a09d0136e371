"""Archives that break one rule each, for the queries that hold the gates to SQL.

Each case edits the boxes of a small good archive; payload offsets may be off, as gates read no payload.
"""

from __future__ import annotations

import struct
from collections.abc import Callable

from .functions import synthetic
from .functions.boxes import box, full, u32

SINF = box(b"sinf")
TABLE = (b"moov", b"trak", b"mdia", b"minf", b"stbl")


def plain() -> bytes:
    return synthetic.archive(
        {"timescale": 30, "deltas": [10] * 6, "sizes": [8] * 6, "sync": [0, 3], "cts": [0, 5, 0, 0, 0, 0]}, {"timescale": 48000, "deltas": [16000] * 6, "sizes": [4] * 6}
    )


def _swap(*path: bytes, body: bytes, track: int = 0) -> Callable:
    def edit(boxes):
        own = synthetic.children(boxes, *path[:-1], track=track)
        own[synthetic.place(own, path[-1])][1] = body

    return edit


def _drop(*path: bytes) -> Callable:
    def edit(boxes):
        own = synthetic.children(boxes, *path[:-1])
        del own[synthetic.place(own, path[-1])]

    return edit


def _add(*path: bytes, body: bytes = b"") -> Callable:
    def edit(boxes):
        synthetic.children(boxes, *path[:-1]).append([path[-1], body])

    return edit


def _twice(kind: bytes) -> Callable:
    return lambda boxes: boxes.append(boxes[synthetic.place(boxes, kind)])


def _entry(kind: bytes, children: bytes = b"", count: int = 1, after: bytes = b"") -> bytes:
    return u32(0, count) + synthetic.sample_entry(kind, True, children) + after


def _mp4a(version: int) -> bytes:
    return u32(0, 1) + box(b"mp4a", bytes(6) + struct.pack(">HH6xHH4xI", 1, version, 2, 16, 48000 << 16))


def _counted(*rows: tuple, version: int = 0) -> bytes:
    return u32(version << 24, len(rows)) + b"".join(u32(*r) for r in rows)


#: (name, edit, variant): the gates over boxes.
GATES: list[tuple[str, Callable, str | None]] = [
    ("fine", lambda boxes: None, None), ("no ftyp", _drop(b"ftyp"), "MissingAtom"), ("no moov", _drop(b"moov"), "MissingAtom"), ("two moov", _twice(b"moov"), "MalformedAtom"), ("two ftyp", _twice(b"ftyp"), None),
    ("second ftyp of a bad brand", _add(b"ftyp", body=b"abcd" + u32(0)), "UnsupportedBrand"), ("moof", _add(b"moof"), "FragmentedInput"), ("top senc", _add(b"senc"), "EncryptedInput"), ("top sgpd", _add(b"sgpd"), "EncryptedInput"),
    ("top tenc", _add(b"tenc"), "EncryptedInput"), ("senc in stbl", _add(*TABLE, b"senc"), "EncryptedInput"), ("seig in stbl", _add(*TABLE, b"sgpd", body=u32(0) + b"seig"), "EncryptedInput"),
    ("roll in stbl", _add(*TABLE, b"sgpd", body=u32(0) + b"roll"), None), ("short sbgp in stbl", _add(*TABLE, b"sbgp", body=bytes(7)), "MalformedAtom"), ("two entries", _swap(*TABLE, b"stsd", body=_entry(b"avc1", count=2)), "MalformedAtom"),
    ("bytes after the entry", _swap(*TABLE, b"stsd", body=_entry(b"avc1", after=box(b"free"))), "MalformedAtom"), ("tkhd version", _swap(b"moov", b"trak", b"tkhd", body=u32(2 << 24) + bytes(92)), "MalformedAtom"),
    ("mdhd truncated", _swap(b"moov", b"trak", b"mdia", b"mdhd", body=u32(0) + bytes(11)), "MalformedAtom"), ("mdhd of version 1", _swap(b"moov", b"trak", b"mdia", b"mdhd", body=u32(1 << 24) + bytes(16) + u32(30) + bytes(12)), None),
    ("hdlr truncated", _swap(b"moov", b"trak", b"mdia", b"hdlr", body=bytes(11)), "MalformedAtom"), ("mp4a of version 1", _swap(*TABLE, b"stsd", body=_mp4a(1), track=1), None), ("mp4a of version 2", _swap(*TABLE, b"stsd", body=_mp4a(2), track=1), "MalformedAtom"),
    *[(f"no {k.decode()}", _drop(b"moov", b"trak", *p, k), "MissingAtom") for p, ks in (((), (b"tkhd", b"mdia")), ((b"mdia",), (b"mdhd", b"hdlr", b"minf")), ((b"mdia", b"minf"), (b"stbl",)), ((b"mdia", b"minf", b"stbl"), (b"stsd", b"co64", b"stts", b"stsc", b"stsz"))) for k in ks],
    ("stco and co64", _add(*TABLE, b"stco", body=_counted((0,))), "MalformedAtom"), ("a later mdhd", _add(b"moov", b"trak", b"mdia", b"mdhd", body=u32(0) + bytes(8) + u32(77) + bytes(8)), None),
    ("constant size with a table", _swap(*TABLE, b"stsz", body=u32(0, 8, 6) + bytes(24)), "MalformedAtom"), ("constant size", _swap(*TABLE, b"stsz", body=u32(0, 8, 6)), None), ("sizes missing", _swap(*TABLE, b"stsz", body=u32(0, 0, 6) + bytes(20)), "MalformedAtom"),
    ("ctts version", _swap(*TABLE, b"ctts", body=_counted((6, 0), version=2)), "MalformedAtom"), ("ctts beyond 31 bits", _swap(*TABLE, b"ctts", body=_counted((6, 1 << 31))), "MalformedAtom"), ("negative ctts", _swap(*TABLE, b"ctts", body=_counted((6, 0xFFFFFFF0), version=1)), None),
    ("stts length", _swap(*TABLE, b"stts", body=u32(0, 2) + u32(6, 10)), "MalformedAtom"), ("protected entry", _swap(*TABLE, b"stsd", body=_entry(b"encv", SINF)), "EncryptedInput"), ("other codec", _swap(*TABLE, b"stsd", body=_entry(b"vp09")), "UnsupportedVideoCodec"),
    ("other audio codec", _swap(*TABLE, b"stsd", body=u32(0, 1) + synthetic.sample_entry(b"ac-3", False), track=1), "UnsupportedAudioCodec"),
    ("text track", _swap(b"moov", b"trak", b"mdia", b"hdlr", body=bytes(8) + b"text" + bytes(13)), "UnsupportedTrackLayout"), ("description index", _swap(*TABLE, b"stsc", body=_counted((1, 6, 2))), "MalformedAtom"),
]

#: (name, edit, detail): rules over the sample tables of the video track, which has six samples in one chunk.
TABLES: list[tuple[str, Callable, str | None]] = [
    ("fine", lambda boxes: None, None), ("no stsc entries", _swap(*TABLE, b"stsc", body=_counted()), "stsc empty but there are chunks"), ("first chunk 2", _swap(*TABLE, b"stsc", body=_counted((2, 6, 1))), "stsc does not start at chunk 1"),
    ("first chunk 0", _swap(*TABLE, b"stsc", body=_counted((0, 6, 1))), "stsc does not start at chunk 1"), ("a later chunk 0", _swap(*TABLE, b"stsc", body=_counted((1, 6, 1), (0, 6, 1))), "stsc first_chunk does not ascend"),
    ("the same chunk", _swap(*TABLE, b"stsc", body=_counted((1, 6, 1), (1, 6, 1))), "stsc first_chunk does not ascend"), ("beyond the chunks", _swap(*TABLE, b"stsc", body=_counted((1, 6, 1), (2, 6, 1))), "stsc entry covers no chunk"),
    ("sync sample 0", _swap(*TABLE, b"stss", body=_counted((0,), (1,))), "sync sample number out of range"), ("sync sample 7", _swap(*TABLE, b"stss", body=_counted((1,), (7,))), "sync sample number out of range"),
    ("sync sample 6", _swap(*TABLE, b"stss", body=_counted((1,), (6,))), None), ("stts exceeds", _swap(*TABLE, b"stts", body=_counted((4, 10), (3, 10))), "stts runs exceed the sample count"),
    ("stts falls short", _swap(*TABLE, b"stts", body=_counted((5, 10))), "stts runs fall short of the sample count"), ("run of 0", _swap(*TABLE, b"stts", body=_counted((0, 5), (6, 10))), None),
    ("ctts exceeds", _swap(*TABLE, b"ctts", body=_counted((7, 0))), "ctts runs exceed the sample count"), ("too many in chunks", _swap(*TABLE, b"stsc", body=_counted((1, 7, 1))), "chunks hold more samples than there are sizes"),
    ("too few in chunks", _swap(*TABLE, b"stsc", body=_counted((1, 5, 1))), "chunks hold fewer samples than there are sizes"),
]


def broken(cases: list, k: int) -> bytes:
    boxes = synthetic.taken_apart(plain())
    cases[k][1](boxes)
    return synthetic.put_together(boxes)
