"""Matroska columns: packet tables from files in a binary column, and a writer for them.

The parser walks EBML elements (identifiers and sizes of variable length, unknown
sizes included) over the bytes in place, keeps the track table and the cues, and
gives one row per packet: track, timestamp in nanoseconds, and the byte range of
its payload.  All kinds of lacing are resolved to packets of their own.

Scale: a file is parsed where its row is; nothing is shuffled, and payloads are
not copied (the rows have byte ranges).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from docwarden.llm.base import doc_columns

EBML, SEGMENT, INFO, TRACKS, TRACK, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0xAE, 0x1F43B675, 0x1C53BB6B
SCALE, NUMBER, KIND, CODEC, DEFAULT_DURATION = 0x2AD7B1, 0xD7, 0x83, 0x86, 0x23E383
TIME, SIMPLE, GROUP, BLOCK, DURATION, REFERENCE = 0xE7, 0xA3, 0xA0, 0xA1, 0x9B, 0xFB
CUE_POINT, CUE_TIME, CUE_PLACES, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
#: what ends a cluster or segment of unknown size
_TOP = {EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES, 0x114D9B74, 0x1941A469, 0x1043A770, 0x1254C367}
LACINGS = ("none", "xiph", "fixed", "ebml")


class Damaged(ValueError):
    """The bytes end or make no sense at this place."""


def read_id(data: bytes, at: int, end: int) -> tuple[int, int]:
    """Element identifier, its marker included, and the place behind it."""
    if at >= end:
        raise Damaged("identifier")
    size = 9 - data[at].bit_length()
    if size > 4 or at + size > end:
        raise Damaged("identifier")
    return int.from_bytes(data[at : at + size], "big"), at + size


def read_size(data: bytes, at: int, end: int) -> tuple[int | None, int]:
    """Variable-length number and the place behind it; None where all of its bits are set (unknown)."""
    if at >= end or not data[at]:
        raise Damaged("size")
    size = 9 - data[at].bit_length()
    if at + size > end:
        raise Damaged("size")
    value = int.from_bytes(data[at : at + size], "big") & ((1 << 7 * size) - 1)
    return (None if value == (1 << 7 * size) - 1 else value), at + size


@dataclass
class Track:
    number: int = 0
    kind: int = 0
    codec: str = ""
    frame_ns: int = 0


@dataclass
class Packet:
    track: int
    time_ns: int | None
    start: int
    size: int
    lacing: str
    lace_index: int
    is_key: bool
    duration_ns: int | None
    cluster: int


@dataclass
class Media:
    scale: int = 1_000_000
    tracks: dict[int, Track] = field(default_factory=dict)
    packets: list[Packet] = field(default_factory=list)
    cues: set[tuple[int, int, int]] = field(default_factory=set)
    sound: bool = True


def lace_sizes(data: bytes, at: int, end: int, lacing: int) -> tuple[list[int], int]:
    """Sizes of a block's frames and where the first begins."""
    if lacing == 0:
        return [end - at], at
    if at >= end:
        raise Damaged("lacing")
    frames, at = data[at] + 1, at + 1
    if lacing == 2:
        if (end - at) % frames:
            raise Damaged("lacing")
        return [(end - at) // frames] * frames, at
    sizes: list[int] = []
    for i in range(frames - 1):
        if lacing == 1:
            size = 0
            while True:
                if at >= end:
                    raise Damaged("lacing")
                size, at = size + data[at], at + 1
                if data[at - 1] < 255:
                    break
        else:
            first = at
            value, at = read_size(data, at, end)
            if i == 0:
                size = value if value is not None else -1
            else:
                # later sizes are signed differences, biased by half of the number's range
                width = at - first
                value = (1 << 7 * width) - 1 if value is None else value
                size = sizes[-1] + value - ((1 << (7 * width - 1)) - 1)
        if size < 0:
            raise Damaged("lacing")
        sizes.append(size)
    last = end - at - sum(sizes)
    if last < 0:
        raise Damaged("lacing")
    return [*sizes, last], at


class Parser:
    def __init__(self, data: bytes):
        self.data, self.media = data, Media()
        self.segment = 0

    def _elements(self, at: int, end: int) -> Iterator[tuple[int, int, int, int]]:
        """(identifier, element start, content start, content end)."""
        while at < end:
            start = at
            name, at = read_id(self.data, at, end)
            size, at = read_size(self.data, at, end)
            if size is None:
                if name not in (SEGMENT, CLUSTER):
                    raise Damaged("unknown size")
                stop = self._end_of(at, end, _TOP if name == CLUSTER else {EBML, SEGMENT})
            else:
                stop = at + size
                if stop > end:
                    # the content that is there is still read
                    yield name, start, at, end
                    raise Damaged("truncated")
            yield name, start, at, stop
            at = stop

    def _end_of(self, at: int, end: int, stops: set[int]) -> int:
        """Where an element of unknown size ends: at the first element that can't be its child, or where the bytes make no sense."""
        try:
            while at < end:
                name, behind = read_id(self.data, at, end)
                if name in stops:
                    return at
                size, behind = read_size(self.data, behind, end)
                if size is not None:
                    at = behind + size
                elif name == CLUSTER:
                    at = self._end_of(behind, end, _TOP)
                else:
                    break
        except Damaged:
            pass
        return end

    def _number(self, start: int, stop: int) -> int:
        return int.from_bytes(self.data[start:stop], "big")

    def parse(self) -> Media:
        try:
            first, at = read_id(self.data, 0, len(self.data))
            if first != EBML:
                raise Damaged("no EBML header")
            for name, _, start, stop in self._elements(0, len(self.data)):
                if name == SEGMENT:
                    self.segment = start
                    self._segment(start, stop)
        except Damaged:
            self.media.sound = False
        return self.media

    def _segment(self, start: int, stop: int) -> None:
        for name, place, lo, hi in self._elements(start, stop):
            if name == INFO:
                for inner, _, a, b in self._elements(lo, hi):
                    if inner == SCALE:
                        self.media.scale = self._number(a, b)
            elif name == TRACKS:
                for inner, _, a, b in self._elements(lo, hi):
                    if inner == TRACK:
                        self._track(a, b)
            elif name == CLUSTER:
                self._cluster(place, lo, hi)
            elif name == CUES:
                for inner, _, a, b in self._elements(lo, hi):
                    if inner == CUE_POINT:
                        self._cue(a, b)

    def _track(self, start: int, stop: int) -> None:
        track = Track()
        for name, _, a, b in self._elements(start, stop):
            if name == NUMBER:
                track.number = self._number(a, b)
            elif name == KIND:
                track.kind = self._number(a, b)
            elif name == CODEC:
                track.codec = self.data[a:b].rstrip(b"\0").decode("ascii", "replace")
            elif name == DEFAULT_DURATION:
                track.frame_ns = self._number(a, b)
        self.media.tracks[track.number] = track

    def _cue(self, start: int, stop: int) -> None:
        time, places = 0, []
        for name, _, a, b in self._elements(start, stop):
            if name == CUE_TIME:
                time = self._number(a, b)
            elif name == CUE_PLACES:
                place = {n: self._number(x, y) for n, _, x, y in self._elements(a, b)}
                places.append((place.get(CUE_TRACK, 0), place.get(CUE_CLUSTER, 0)))
        self.media.cues |= {(time * self.media.scale, track, cluster) for track, cluster in places}

    def _cluster(self, place: int, start: int, stop: int) -> None:
        time = 0
        for name, _, a, b in self._elements(start, stop):
            if name == TIME:
                time = self._number(a, b)
            elif name == SIMPLE:
                self._block(a, b, time, place - self.segment, None, None)
            elif name == GROUP:
                block, duration, key = None, None, True
                for inner, _, x, y in self._elements(a, b):
                    if inner == BLOCK:
                        block = (x, y)
                    elif inner == DURATION:
                        duration = self._number(x, y) * self.media.scale
                    elif inner == REFERENCE:
                        key = False
                if block:
                    self._block(*block, time, place - self.segment, key, duration)

    def _block(self, start: int, stop: int, cluster_time: int, cluster: int, key: bool | None, duration: int | None) -> None:
        data = self.data
        track, at = read_size(data, start, stop)
        if at + 3 > stop or track is None:
            raise Damaged("block")
        relative = int.from_bytes(data[at : at + 2], "big", signed=True)
        flags = data[at + 2]
        lacing = flags >> 1 & 3
        sizes, at = lace_sizes(data, at + 3, stop, lacing)
        time = (cluster_time + relative) * self.media.scale
        known = self.media.tracks.get(track)
        step = known.frame_ns if known else 0
        if not step and duration and len(sizes) > 1:
            step = duration // len(sizes)
        is_key = bool(flags & 0x80) if key is None else key
        for i, size in enumerate(sizes):
            # the time of a later frame is only known if its track or block says how long a frame is
            when = time + i * step if i == 0 or step else None
            self.media.packets.append(Packet(track, when, at, size, LACINGS[lacing], i, is_key, step or (duration if len(sizes) == 1 else None), cluster))
            at += size


# --- writing -----------------------------------------------------------------


def vint(value: int, width: int = 0) -> bytes:
    """Variable-length number in the least or the given width; all ones is kept for "unknown"."""
    width = width or max(1, -(-(value + 1).bit_length() // 7))
    return (value | 1 << 7 * width).to_bytes(width, "big")


def element(name: int, content: bytes) -> bytes:
    return name.to_bytes((name.bit_length() + 7) // 8, "big") + vint(len(content)) + content


def number(name: int, value: int) -> bytes:
    return element(name, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def lace(frames: Sequence[bytes], lacing: str) -> bytes:
    """Frames of a block behind its flags."""
    if lacing == "none":
        return frames[0]
    head = bytes([len(frames) - 1])
    sizes = [len(f) for f in frames]
    if lacing == "xiph":
        head += b"".join(b"\xff" * (s // 255) + bytes([s % 255]) for s in sizes[:-1])
    elif lacing == "ebml":
        head += vint(sizes[0]) if len(sizes) > 1 else b""
        for a, b in zip(sizes[:-2], sizes[1:-1]):
            change = b - a
            width = 1
            while not -((1 << (7 * width - 1)) - 1) <= change < (1 << (7 * width - 1)) - 1:
                width += 1
            head += vint(change + (1 << (7 * width - 1)) - 1, width)
    return head + b"".join(frames)


def block(track: int, relative: int, frames: Sequence[bytes], lacing: str, key: bool) -> bytes:
    return vint(track) + relative.to_bytes(2, "big", signed=True) + bytes([(0x80 if key else 0) | LACINGS.index(lacing) << 1]) + lace(frames, lacing)


def write_media(tracks: Sequence[Track], blocks: Sequence[tuple[int, int, Sequence[bytes], str, bool]], *, scale: int = 1_000_000, cluster_ticks: int = 5000, live: bool = False) -> bytes:
    """A file of blocks (track, ticks, frames, lacing, key), in order of ticks, with a cue per cluster; ``live``: unknown sizes."""
    head = element(EBML, number(0x4286, 1) + element(0x4282, b"matroska"))
    about = element(INFO, number(SCALE, scale))
    table = b"".join(element(TRACK, number(NUMBER, t.number) + number(KIND, t.kind) + element(CODEC, t.codec.encode()) + (number(DEFAULT_DURATION, t.frame_ns) if t.frame_ns else b"")) for t in tracks)
    body = about + element(TRACKS, table)
    unknown = b"\x01" + b"\xff" * 7
    cues = b""
    at = 0
    while at < len(blocks):
        begin, stop = blocks[at][1], at
        parts = [number(TIME, begin)]
        while stop < len(blocks) and blocks[stop][1] < begin + cluster_ticks:
            track, ticks, frames, lacing, key = blocks[stop]
            parts.append(element(SIMPLE, block(track, ticks - begin, frames, lacing, key)))
            stop += 1
        cues += element(CUE_POINT, number(CUE_TIME, begin) + element(CUE_PLACES, number(CUE_TRACK, blocks[at][0]) + number(CUE_CLUSTER, len(body))))
        content = b"".join(parts)
        body += CLUSTER.to_bytes(4, "big") + (unknown if live else vint(len(content))) + content
        at = stop
    body += element(CUES, cues) if cues else b""
    return head + SEGMENT.to_bytes(4, "big") + (unknown if live else vint(len(body))) + body


# --- columns -----------------------------------------------------------------

PACKETS = "doc_id long, packet long, track long, codec string, time_ns long, byte_offset long, byte_length long, lacing string, lace_index int, is_key boolean, in_cues boolean, cluster_offset long, is_sound boolean"
_ARROW = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.bool_(), pa.bool_(), pa.int64(), pa.bool_()]
_NAMES = [c.split()[0] for c in PACKETS.split(", ")]


def _packet_rows(doc: int | None, data: bytes) -> Iterator[tuple]:
    media = Parser(data).parse()
    for i, p in enumerate(media.packets):
        known = media.tracks.get(p.track)
        cued = p.lace_index == 0 and (p.time_ns, p.track, p.cluster) in media.cues
        yield doc, i, p.track, known.codec if known else None, p.time_ns, p.start, p.size, p.lacing, p.lace_index, p.is_key, cued, p.cluster, media.sound


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[tuple] = []
        for doc, data in zip(batch["doc_id"].to_pylist(), batch["media"]):
            rows += _packet_rows(doc, data.as_py())
            if len(rows) >= 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _ARROW)], names=_NAMES)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _ARROW)], names=_NAMES)


def packets(files: DataFrame, *, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """One row per packet of every file, numbered in file order.

    Byte offsets count from the start of the file, ``cluster_offset`` from the
    segment's content, as cues do.  ``time_ns`` is null for a laced frame whose
    place in time isn't told; ``in_cues``: a cue points at the packet.  Defined
    cases: null media, empty media and bytes that are no Matroska have no rows; of
    a damaged or truncated file the packets before the damage are given with
    ``is_sound`` false; a null id is kept; repeated rows are each parsed; other
    columns are not looked at.
    """
    known = files.select(files[id_col].cast("long").alias("doc_id"), files[media_col].cast("binary").alias("media"))
    return known.filter("media is not null").mapInArrow(_parse, PACKETS)


def text_media(text: str) -> bytes:
    """A file with a text as two tracks: its lines as subtitles, a second apart, and their sentences as laced frames.

    A block laces 256 frames at most, so a line of more sentences has several blocks.
    """
    tracks = [Track(1, 17, "S_TEXT/UTF8"), Track(2, 17, "S_TEXT/ASCII", 1_000_000)]
    blocks: list[tuple[int, int, Sequence[bytes], str, bool]] = []
    for i, line in enumerate(text.split("\n")):
        blocks.append((1, 1000 * i, [line.encode("utf-8")], "none", True))
        sentences = [s.encode("utf-8") for s in line.split(". ") if s]
        for at in range(0, len(sentences), 256):
            frames = sentences[at : at + 256]
            lacing = "fixed" if len({len(f) for f in frames}) == 1 else ("xiph" if i % 2 else "ebml")
            blocks.append((2, 1000 * i, frames, lacing, i % 3 == 0))
    return write_media(tracks, blocks, live=len(text) % 2 == 1)


def _film(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), 500):
            part = batch.slice(at, 500)
            media = [None if t is None else text_media(t) for t in part["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(media, pa.binary())], names=["doc_id", "media"])


def films(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, media): every text as a Matroska file.

    Defined cases: null for a null text; an empty text is one empty line; a null
    id is kept; repeated rows are each muxed; an empty table gives no rows; other
    columns are not looked at.
    """
    return doc_columns(docs).mapInArrow(_film, "doc_id long, media binary")


def document_packets(docs: DataFrame) -> DataFrame:
    """Packets of every document's film; see :func:`films` and :func:`packets` for their cases (a null text has none)."""
    return packets(films(docs))
