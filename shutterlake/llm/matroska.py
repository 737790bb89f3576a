"""Media columns: Matroska files written from payloads and parsed into packet tables.

``store`` writes each payload as one 8-bit PCM track: frames of up to ``PACKET`` bytes,
laced into SimpleBlocks, grouped into clusters, with a cue for each cluster and a seek head
that tells where the cues are. ``parse`` reads any Matroska file's structure:
variable-length ids and sizes (unknown sizes of the segment and of clusters too),
SimpleBlocks and BlockGroups, the three lacings, and cues; ``track_table`` reads the track
entries. ``seek`` follows seek head and cues to the cluster of a time and reads packets from
there on, without the clusters before it.

A packet's ``timestamp_ns`` is its block's; ``frame_ns`` is its own, later by the track's
default duration for each frame before it in the lace.

Edge cases: a null or empty text counts as no bytes and is stored as 64 zero bytes; a
null, empty or damaged media cell gives the packets, cues and tracks before the damage and
a text in ``error``; a file without cues is read from its first cluster; repeated rows give repeated results; an empty table gives an empty
result; existing columns of an output's name are replaced.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from shutterlake.llm.text_arrays import map_slices, raw

# Fixed values of the format: element ids.
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
TIMESTAMP_SCALE, DURATION = 0x2AD7B1, 0x4489
TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, REFERENCE = 0xE7, 0xA3, 0xA0, 0xA1, 0xFB
CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
SEEK_HEAD, SEEK, SEEK_ID, SEEK_POSITION = 0x114D9B74, 0x4DBB, 0x53AB, 0x53AC
TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE_ID, CODEC, NAME, LANGUAGE, FRAME_DURATION = 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0x536E, 0x22B59C, 0x23E383
AUDIO, RATE_HZ, CHANNELS, BITS, VIDEO, WIDTH, HEIGHT = 0xE1, 0xB5, 0x9F, 0x6264, 0xE0, 0xB0, 0xBA
TOP_LEVEL = {INFO, TRACKS, CLUSTER, CUES, SEEK_HEAD, 0x1043A770, 0x1941A469, 0x1254C367}
NO_LACE, XIPH, FIXED, EBML_LACE = 0, 1, 2, 3
# Our layout: 64 samples are one millisecond.
RATE, PACKET, LACED, BLOCKS = 64_000, 1024, 8, 64

PACKET_TYPE = T.ArrayType(
    T.StructType(
        [T.StructField(n, T.LongType()) for n in ("track", "cluster", "block", "timestamp_ns", "start", "length")]
        + [T.StructField("keyframe", T.BooleanType()), T.StructField("lacing", T.LongType()), T.StructField("frame_ns", T.LongType())]
    )
)
CUE_TYPE = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("timestamp_ns", "track", "cluster_start")]))
TRACK_FIELDS = {
    "track": T.LongType(), "uid": T.LongType(), "type": T.LongType(), "codec": T.StringType(), "name": T.StringType(), "language": T.StringType(), "frame_ns": T.LongType(),
    "rate_hz": T.DoubleType(), "channels": T.LongType(), "bits": T.LongType(), "width": T.LongType(), "height": T.LongType(),
}
TRACK_TYPE = T.ArrayType(T.StructType([T.StructField(n, t) for n, t in TRACK_FIELDS.items()]))


# ---- writing


def number(value: int) -> bytes:
    """A size as variable-length integer: the first set bit tells the length."""
    n = 1
    while value >= (1 << 7 * n) - 1:
        n += 1
    return (value | 1 << 7 * n).to_bytes(n, "big")


def element(ident: int, body: bytes) -> bytes:
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + number(len(body)) + body


def uint(ident: int, value: int) -> bytes:
    return element(ident, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def lace(frames: list[bytes]) -> tuple[int, bytes]:
    """Lacing kind and the laced body: equal frames by count alone, others by size differences."""
    if len(frames) == 1:
        return NO_LACE, frames[0]
    sizes = [len(f) for f in frames]
    if len(set(sizes)) == 1:
        return FIXED, bytes([len(frames) - 1]) + b"".join(frames)
    head = bytes([len(frames) - 1]) + number(sizes[0])
    for before, size in zip(sizes, sizes[1:-1]):
        n = 1
        while abs(size - before) >= 1 << 7 * n - 1:
            n += 1
        head += ((size - before + (1 << 7 * n - 1) - 1) | 1 << 7 * n).to_bytes(n, "big")
    return EBML_LACE, head + b"".join(frames)


HEAD = element(
    EBML,
    uint(0x4286, 1) + uint(0x42F7, 1) + uint(0x42F2, 4) + uint(0x42F3, 8) + element(0x4282, b"matroska") + uint(0x4287, 4) + uint(0x4285, 2),
)
TRACK = element(
    TRACKS,
    element(
        TRACK_ENTRY,
        uint(TRACK_NUMBER, 1) + uint(TRACK_UID, 1) + uint(TRACK_TYPE_ID, 2) + uint(0x9C, 1) + uint(FRAME_DURATION, PACKET * 1_000_000_000 // RATE) + element(CODEC, b"A_PCM/INT/LIT")
        + element(AUDIO, element(RATE_HZ, struct.pack(">d", RATE)) + uint(CHANNELS, 1) + uint(BITS, 8)),
    ),
)


def seek_head(cues: int) -> bytes:
    """Where in the segment the cues are; of the same length for all places."""
    return element(SEEK_HEAD, element(SEEK, element(SEEK_ID, CUES.to_bytes(4, "big")) + element(SEEK_POSITION, cues.to_bytes(8, "big"))))


def store(payload: bytes) -> bytes:
    """One Matroska file whose single PCM track holds the payload."""
    info = uint(TIMESTAMP_SCALE, 1_000_000) + element(DURATION, struct.pack(">d", len(payload) * 1000 / RATE))
    body = [element(INFO, info + element(0x4D80, b"shutterlake") + element(0x5741, b"shutterlake")), TRACK]
    at = len(seek_head(0)) + sum(map(len, body))
    cues = []
    for first in range(0, len(payload), PACKET * LACED * BLOCKS):
        base = first * 1000 // RATE
        blocks = [uint(TIMESTAMP, base)]
        for start in range(first, min(len(payload), first + PACKET * LACED * BLOCKS), PACKET * LACED):
            frames = [payload[i : i + PACKET] for i in range(start, min(len(payload), start + PACKET * LACED), PACKET)]
            kind, laced = lace(frames)
            blocks.append(element(SIMPLE_BLOCK, b"\x81" + struct.pack(">hB", start * 1000 // RATE - base, 0x80 | kind << 1) + laced))
        cluster = element(CLUSTER, b"".join(blocks))
        cues.append(element(CUE_POINT, uint(CUE_TIME, base) + element(CUE_POSITIONS, uint(CUE_TRACK, 1) + uint(CUE_CLUSTER, at))))
        at += len(cluster)
        body.append(cluster)
    return HEAD + element(SEGMENT, b"".join([seek_head(at), *body, element(CUES, b"".join(cues))]))


# ---- parsing


class Damaged(ValueError):
    pass


def _vint(data: bytes, at: int, end: int, keep_mark: bool) -> tuple[int, int, int]:
    """Value, next position and length of the variable-length integer at ``at``."""
    if at >= end or not data[at]:
        raise Damaged(f"no number at byte {at}")
    n = 9 - data[at].bit_length()
    if at + n > end:
        raise Damaged(f"cut number at byte {at}")
    value = int.from_bytes(data[at : at + n], "big")
    return value if keep_mark else value & (1 << 7 * n) - 1, at + n, n


def elements(data: bytes, at: int, end: int, level: set[int] | None = None):
    """(id, body start, body end) of the elements in a range. A body of unknown size
    reaches to the next element of ``level``, or to the end of the range."""
    while at < end:
        ident, at, _ = _vint(data, at, end, True)
        size, at, n = _vint(data, at, end, False)
        stop = at + size
        if size == (1 << 7 * n) - 1:
            stop = end
            if ident == CLUSTER:
                for inner, begin, _ in _heads(data, at, end):
                    if inner in (level or ()):
                        stop = begin
                        break
        if stop > end:
            raise Damaged(f"element {ident:X} at byte {at} passes the end of its parent")
        yield ident, at, stop
        at = stop


def _heads(data: bytes, at: int, end: int):
    while at < end:
        begin = at
        ident, at, _ = _vint(data, at, end, True)
        size, at, _ = _vint(data, at, end, False)
        yield ident, begin, at
        at += size


def unlace(data: bytes, at: int, end: int, kind: int) -> list[tuple[int, int]]:
    """(start, length) of the frames of one block's body."""
    if kind == NO_LACE:
        return [(at, end - at)]
    if at >= end:
        raise Damaged(f"no frame count at byte {at}")
    frames, at = data[at] + 1, at + 1
    sizes: list[int] = []
    if kind == FIXED:
        if (end - at) % frames:
            raise Damaged(f"{end - at} bytes at byte {at} aren't {frames} equal frames")
        sizes = [(end - at) // frames] * (frames - 1)
    elif kind == XIPH:
        for _ in range(frames - 1):
            size = 0
            while True:
                if at >= end:
                    raise Damaged(f"cut lace at byte {at}")
                size, at = size + data[at], at + 1
                if data[at - 1] != 255:
                    break
            sizes.append(size)
    else:
        for k in range(frames - 1):
            value, at, n = _vint(data, at, end, False)
            sizes.append(value if not k else sizes[-1] + value - ((1 << 7 * n - 1) - 1))
    last = end - at - sum(sizes)
    if last < 0 or min([0, *sizes]) < 0:
        raise Damaged(f"frames at byte {at} pass the end of their block")
    out = []
    for size in [*sizes, last]:
        out.append((at, size))
        at += size
    return out


def _integer(data: bytes, at: int, end: int) -> int:
    return int.from_bytes(data[at:end], "big")


def _block(data: bytes, at: int, end: int, simple: bool, key: bool, base: int, scale: int, frame_ns: dict[int, int], place: tuple[int, int]) -> list[tuple]:
    """Packets of one block; ``place`` is its cluster's number and its own."""
    track, after, _ = _vint(data, at, end, False)
    if after + 3 > end:
        raise Damaged(f"cut block at byte {at}")
    relative, flags = struct.unpack_from(">hB", data, after)
    kind = flags >> 1 & 3
    time, step = (base + relative) * scale, frame_ns.get(track) or 0
    keyframe = bool(flags & 0x80) if simple else key
    return [(track, *place, time, start, length, keyframe, kind, time + k * step) for k, (start, length) in enumerate(unlace(data, after + 3, end, kind))]


def _cluster(data: bytes, at: int, end: int, number_: int, scale: int, frame_ns: dict[int, int], packets: list[tuple]) -> None:
    """Appends a cluster's packets, as far as they can be read."""
    base, block = 0, -1
    for ident, a, b in elements(data, at, end):
        if ident == TIMESTAMP:
            base = _integer(data, a, b)
        elif ident == SIMPLE_BLOCK:
            block += 1
            packets += _block(data, a, b, True, True, base, scale, frame_ns, (number_, block))
        elif ident == BLOCK_GROUP:
            block += 1
            inner = list(elements(data, a, b))
            key = all(x != REFERENCE for x, _, _ in inner)
            for x, c, d in inner:
                if x == BLOCK:
                    packets += _block(data, c, d, False, key, base, scale, frame_ns, (number_, block))


def _cues(data: bytes, at: int, end: int, segment: int, scale: int, cues: list[tuple]) -> None:
    for ident, a, b in elements(data, at, end):
        if ident != CUE_POINT:
            continue
        time, places = 0, []
        for x, c, d in elements(data, a, b):
            if x == CUE_TIME:
                time = _integer(data, c, d)
            elif x == CUE_POSITIONS:
                held = {y: _integer(data, e, f) for y, e, f in elements(data, c, d) if y in (CUE_TRACK, CUE_CLUSTER)}
                places.append((held.get(CUE_TRACK), held.get(CUE_CLUSTER)))
        cues += [(time * scale, track, None if place is None else segment + place) for track, place in places]


#: Element, field and kind of what is read of a track entry.
_ENTRY = {TRACK_NUMBER: "track", TRACK_UID: "uid", TRACK_TYPE_ID: "type", CODEC: "codec", NAME: "name", LANGUAGE: "language", FRAME_DURATION: "frame_ns"}
_INNER = {AUDIO: {RATE_HZ: "rate_hz", CHANNELS: "channels", BITS: "bits"}, VIDEO: {WIDTH: "width", HEIGHT: "height"}}


def _value(field: str, body: bytes) -> int | float | str:
    kind = TRACK_FIELDS[field]
    if isinstance(kind, T.StringType):
        return body.rstrip(b"\0").decode(errors="replace")
    if isinstance(kind, T.DoubleType):
        if len(body) not in (0, 4, 8):
            raise Damaged(f"a number of {len(body)} bytes")
        return struct.unpack(">f" if len(body) == 4 else ">d", body or bytes(8))[0]
    value = int.from_bytes(body, "big")
    return value - (1 << 64) if value >= 1 << 63 else value  # ids of 64 bits fill a signed column


def _track_rows(data: bytes, at: int, end: int, rows: list[dict]) -> None:
    for ident, a, b in elements(data, at, end):
        if ident != TRACK_ENTRY:
            continue
        row = dict.fromkeys(TRACK_FIELDS)
        for x, c, d in elements(data, a, b):
            if x in _ENTRY:
                row[_ENTRY[x]] = _value(_ENTRY[x], data[c:d])
            for y, e, f in elements(data, c, d) if x in _INNER else ():
                if y in _INNER[x]:
                    row[_INNER[x][y]] = _value(_INNER[x][y], data[e:f])
        rows.append(row)


def _scale(data: bytes, at: int, end: int, scale: int) -> int:
    for ident, a, b in elements(data, at, end):
        scale = _integer(data, a, b) if ident == TIMESTAMP_SCALE else scale
    return scale


def read(data: bytes | None) -> tuple[list[tuple], list[tuple], list[dict], str | None]:
    """Packets (as PACKET_TYPE), cues (as CUE_TYPE), tracks (as TRACK_TYPE) and what is wrong
    with the file, if anything."""
    packets: list[tuple] = []
    cues: list[tuple] = []
    tracks: list[dict] = []
    scale, cluster = 1_000_000, -1
    try:
        if not data:
            raise Damaged("no media")
        for ident, segment, stop in elements(data, 0, len(data)):
            if ident != SEGMENT:
                continue
            for top, a, b in elements(data, segment, stop, TOP_LEVEL):
                if top == INFO:
                    scale = _scale(data, a, b, scale)
                elif top == TRACKS:
                    _track_rows(data, a, b, tracks)
                elif top == CLUSTER:
                    cluster += 1
                    _cluster(data, a, b, cluster, scale, {t["track"]: t["frame_ns"] for t in tracks}, packets)
                elif top == CUES:
                    _cues(data, a, b, segment, scale, cues)
    except Damaged as e:
        return packets, cues, tracks, str(e)
    return packets, cues, tracks, None


def parse(data: bytes | None) -> tuple[list[tuple], list[tuple], str | None]:
    """Packets, cues and what is wrong with the file, if anything."""
    packets, cues, _, error = read(data)
    return packets, cues, error


def seek(data: bytes | None, time_ns: int) -> tuple[list[tuple], str | None]:
    """Packets from the last cluster on that a cue names at ``time_ns`` or before, and what is
    wrong with the part that was read. The cues are found by the seek head, or behind the
    clusters if it names none; clusters are counted from the first one read."""
    packets: list[tuple] = []
    cues: list[tuple] = []
    tracks: list[dict] = []
    scale, cluster = 1_000_000, -1
    try:
        if not data:
            raise Damaged("no media")
        for ident, segment, stop in elements(data, 0, len(data)):
            if ident != SEGMENT:
                continue
            first, listed, at = None, None, segment
            for top, a, b in elements(data, segment, stop, TOP_LEVEL):
                if top == SEEK_HEAD:
                    for _, c, d in elements(data, a, b):
                        entry = {x: _integer(data, e, f) for x, e, f in elements(data, c, d)}
                        listed = entry.get(SEEK_POSITION) if entry.get(SEEK_ID) == CUES else listed
                elif top == INFO:
                    scale = _scale(data, a, b, scale)
                elif top == TRACKS:
                    _track_rows(data, a, b, tracks)
                elif top == CUES:
                    _cues(data, a, b, segment, scale, cues)
                elif top == CLUSTER and first is None:
                    first = at
                    if listed is not None:
                        break
                at = b
            if listed is not None and not cues:
                ident, a, b = next(elements(data, segment + listed, stop, TOP_LEVEL), (None, 0, 0))
                if ident != CUES:
                    raise Damaged(f"no cues at byte {segment + listed}")
                _cues(data, a, b, segment, scale, cues)
            begin = max((place for time, _, place in cues if place is not None and time <= time_ns), default=first)
            if begin is None:
                continue
            frame_ns = {t["track"]: t["frame_ns"] for t in tracks}
            for top, a, b in elements(data, begin, stop, TOP_LEVEL):
                if top == CLUSTER:
                    cluster += 1
                    _cluster(data, a, b, cluster, scale, frame_ns, packets)
                elif not cluster + 1:
                    raise Damaged(f"no cluster at byte {begin}")
    except Damaged as e:
        return packets, str(e)
    return packets, None


# ---- columns


def payload_of(text: bytes) -> bytes:
    """The text's bytes, filled with zeros to a positive multiple of 64."""
    return text + bytes(-len(text) % 64 or 64 * (not text))


def store_text(df: DataFrame, text: str = "text", out: str = "media", keep: list[str] | None = None) -> DataFrame:
    """Append ``n_bytes`` (of the text) and ``out``, the Matroska file of its payload."""

    def work(column: pa.Array) -> list[pa.Array]:
        data, at = raw(column)
        data = data.tobytes()
        return [pa.array(np.diff(at)), pa.array([store(payload_of(data[a:b])) for a, b in zip(at[:-1], at[1:])], pa.binary())]

    return map_slices(df, text, [("n_bytes", T.LongType()), (out, T.BinaryType())], lambda: work, keep)


def _cells(rows: list[list[tuple]], kind: T.ArrayType) -> pa.Array:
    """Lists of tuples as a column of this type."""
    fields = kind.elementType
    arrow = {T.LongType: pa.int64(), T.BooleanType: pa.bool_(), T.DoubleType: pa.float64(), T.StringType: pa.string()}
    named = [[dict(zip(fields.names, r)) for r in cell] for cell in rows]
    return pa.array(named, pa.list_(pa.struct([(f.name, arrow[type(f.dataType)]) for f in fields])))


def read_structure(df: DataFrame, media: str = "media", keep: list[str] | None = None) -> DataFrame:
    """Append ``packets``, ``cues`` and ``tracks`` (explode them for tables with a row each)
    and ``error``."""
    kinds = {"packets": PACKET_TYPE, "cues": CUE_TYPE, "tracks": TRACK_TYPE}

    def work(column: pa.Array) -> list[pa.Array]:
        found = [read(x) for x in column.to_pylist()]
        parts = [[f[0] for f in found], [f[1] for f in found], [[tuple(t.values()) for t in f[2]] for f in found]]
        return [*map(_cells, parts, kinds.values()), pa.array([f[3] for f in found], pa.string())]

    return map_slices(df, media, [*kinds.items(), ("error", T.StringType())], lambda: work, keep)


def read_from(df: DataFrame, time_ns: int, media: str = "media", keep: list[str] | None = None) -> DataFrame:
    """Append ``packets`` from the cluster of this time on, found by the cues, and ``error``."""

    def work(column: pa.Array) -> list[pa.Array]:
        found = [seek(x, time_ns) for x in column.to_pylist()]
        return [_cells([f[0] for f in found], PACKET_TYPE), pa.array([f[1] for f in found], pa.string())]

    return map_slices(df, media, [("packets", PACKET_TYPE), ("error", T.StringType())], lambda: work, keep)


def media_digest(df: DataFrame) -> DataFrame:
    """Store each document's text as media, read it back by the packets' byte ranges, and
    describe what was read: digests, and packet, cluster, cue, track and sample figures. The
    tail is read from the cluster that the last cue names."""
    stored = store_text(df.select("doc_id", "text"), keep=["doc_id"])

    def work(column: pa.Array) -> list[pa.Array]:
        rows = []
        for media in column.to_pylist():
            packets, cues, tracks, error = read(media)
            last, wrong = seek(media, cues[-1][0]) if cues else ([], "no cues")
            if error or wrong:
                raise ValueError(error or wrong)
            back, tail = (b"".join(media[p[4] : p[4] + p[5]] for p in part) for part in (packets, last))
            samples = np.frombuffer(back, np.uint8)
            sound = tracks[0]
            feature = (
                f"packets={len(packets)} clusters={packets[-1][1] + 1} cues={len(cues)} laced={sum(p[7] != NO_LACE for p in packets)} codec={sound['codec']} "
                f"rate={sound['rate_hz']:.0f} bits={sound['bits']} end_ms={len(back) * 1000 // RATE} last_frame_ms={packets[-1][8] // 1_000_000} last_cluster_bytes={len(tail)} "
                f"sum={int(samples.sum(dtype=np.int64))} peak={samples.max()} changes={int((samples[1:] != samples[:-1]).sum())}"
            )
            rows.append((len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(tail[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature))
        columns = list(zip(*rows))
        return [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()))]

    long, text = T.LongType(), T.StringType()
    return map_slices(
        stored, "media", [("payload_bytes", long), ("payload_sha256", text), ("tail_crc32", long), ("media_bytes", long), ("media_sha256", text), ("feature", text)], lambda: work, ["doc_id", "n_bytes"]
    )
