"""Matroska: writing and parsing of audio tracks as EBML.

The parser reads variable-length element ids and sizes, walks segments and clusters, takes blocks apart by
their lacing (none, Xiph, fixed size, EBML) and returns the packets of all tracks with timestamps, key flags and
byte ranges, besides tracks and cues. Elements it doesn't know are stepped over; an element of unknown size ends with
its parent or with the next cluster.

The writer stores 8-bit samples losslessly: one PCM track, frames of 192 samples, blocks of up to 32 frames laced
by their fixed size, clusters of up to 32 blocks, and a cue for each cluster.

Defined results: a null or empty text is one frame of spaces; equal texts give equal files; null ids are
carried along; rows of one id are files of their own; other columns are left out and may have any name.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import bound_arrow_batches, trimmed
from .wordids import one_array, slices

# Element ids of the container format (fixed values).
EBML, EBML_VERSION, EBML_READ_VERSION, EBML_MAX_ID, EBML_MAX_SIZE, DOC_TYPE, DOC_TYPE_VERSION, DOC_TYPE_READ_VERSION = 0x1A45DFA3, 0x4286, 0x42F7, 0x42F2, 0x42F3, 0x4282, 0x4287, 0x4285
SEGMENT, INFO, TIMESTAMP_SCALE, DURATION, MUXING_APP, WRITING_APP = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACKS, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, FLAG_LACING, CODEC_ID, AUDIO, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH, DEFAULT_DURATION = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x9C, 0x86, 0xE1, 0xB5, 0x9F, 0x6264, 0x23E383
CLUSTER, TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, REFERENCE_BLOCK = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0xFB
CUES, CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
NO_LACING, XIPH, FIXED, EBML_LACING = 0, 1, 2, 3

FRAME, RATE, LACED, BLOCKS = 192, 8000, 32, 32
FRAME_MS = FRAME * 1000 // RATE


def size_bytes(n: int) -> bytes:
    """A variable-length size in as few bytes as it takes; all ones are reserved."""
    width = 1
    while n >= (1 << (7 * width)) - 1:
        width += 1
    return (n | 1 << (7 * width)).to_bytes(width, "big")


def element(key: int, body: bytes) -> bytes:
    return key.to_bytes((key.bit_length() + 7) // 8, "big") + size_bytes(len(body)) + body


def number(key: int, n: int) -> bytes:
    return element(key, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def lace(frames: list[bytes], lacing: int) -> bytes:
    """What follows a block's flags."""
    if lacing == NO_LACING:
        if len(frames) != 1:
            raise ValueError("a block without lacing holds one frame")
        return frames[0]
    sizes, head = [len(f) for f in frames], bytes([len(frames) - 1])
    if lacing == XIPH:
        head += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    elif lacing == FIXED:
        if len(set(sizes)) != 1:
            raise ValueError("frames of unequal size")
    elif len(sizes) > 1:
        head += size_bytes(sizes[0])
        for before, n in zip(sizes, sizes[1:-1]):
            width = 1
            while not -(1 << (7 * width - 1)) < n - before < (1 << (7 * width - 1)):
                width += 1
            head += (n - before + (1 << (7 * width - 1)) - 1 | 1 << (7 * width)).to_bytes(width, "big")
    return head + b"".join(frames)


def block(track: int, relative: int, frames: list[bytes], lacing: int, key: bool = True) -> bytes:
    return size_bytes(track) + struct.pack(">hB", relative, (0x80 if key else 0) | lacing << 1) + lace(frames, lacing)


_HEAD = element(EBML, number(EBML_VERSION, 1) + number(EBML_READ_VERSION, 1) + number(EBML_MAX_ID, 4) + number(EBML_MAX_SIZE, 8) + element(DOC_TYPE, b"matroska") + number(DOC_TYPE_VERSION, 4) + number(DOC_TYPE_READ_VERSION, 2))
_TRACKS = element(TRACKS, element(TRACK_ENTRY, number(TRACK_NUMBER, 1) + number(TRACK_UID, 1) + number(TRACK_TYPE, 2) + number(FLAG_LACING, 1) + number(DEFAULT_DURATION, FRAME_MS * 1_000_000) + element(CODEC_ID, b"A_PCM/INT/LIT") + element(AUDIO, element(SAMPLING_FREQUENCY, struct.pack(">d", RATE)) + number(CHANNELS, 1) + number(BIT_DEPTH, 8))))


def write_samples(payload: bytes) -> bytes:
    """A file whose only track holds ``payload``, a positive multiple of 192 samples."""
    if not payload or len(payload) % FRAME:
        raise ValueError("the payload is a positive multiple of 192 bytes")
    frames = len(payload) // FRAME
    info = element(INFO, number(TIMESTAMP_SCALE, 1_000_000) + element(DURATION, struct.pack(">d", frames * FRAME_MS)) + element(MUXING_APP, b"palimpsest") + element(WRITING_APP, b"palimpsest"))
    parts, at, cues = [info, _TRACKS], len(info) + len(_TRACKS), []
    for first in range(0, frames, LACED * BLOCKS):
        blocks = [number(TIMESTAMP, first * FRAME_MS)]
        for start in range(first, min(first + LACED * BLOCKS, frames), LACED):
            n = min(LACED, frames - start)
            body = payload[start * FRAME : (start + n) * FRAME]
            head = size_bytes(1) + struct.pack(">hB", (start - first) * FRAME_MS, 0x80 | (FIXED << 1 if n > 1 else 0))
            blocks.append(element(SIMPLE_BLOCK, head + (bytes([n - 1]) if n > 1 else b"") + body))
        cues.append(element(CUE_POINT, number(CUE_TIME, first * FRAME_MS) + element(CUE_TRACK_POSITIONS, number(CUE_TRACK, 1) + number(CUE_CLUSTER_POSITION, at))))
        parts.append(element(CLUSTER, b"".join(blocks)))
        at += len(parts[-1])
    parts.append(element(CUES, b"".join(cues)))
    return _HEAD + element(SEGMENT, b"".join(parts))


@dataclass
class Media:
    """``packets``: rows (track, timestamp in ms, start, end, key); ``cues``: rows (time, track, cluster's start in the file)."""

    doc_type: str = ""
    scale: int = 1_000_000
    duration: float = 0.0
    tracks: list[dict] = field(default_factory=list)
    packets: list[tuple[int, int, int, int, bool]] = field(default_factory=list)
    clusters: list[int] = field(default_factory=list)
    cues: list[tuple[int, int, int]] = field(default_factory=list)


def read_size(raw: bytes, at: int) -> tuple[int | None, int]:
    """(value without its marker, next place); None for the reserved value of unknown size."""
    first = raw[at]
    if not first:
        raise ValueError("a variable-length number of over 8 bytes")
    width = 9 - first.bit_length()
    if at + width > len(raw):
        raise ValueError("the file ends within a number")
    value = int.from_bytes(raw[at : at + width], "big") & (1 << 7 * width) - 1
    return (None if value == (1 << 7 * width) - 1 else value), at + width


def read_id(raw: bytes, at: int) -> tuple[int, int]:
    width = 9 - raw[at].bit_length()
    if width > 4:
        raise ValueError("an element id of over 4 bytes")
    return int.from_bytes(raw[at : at + width], "big"), at + width


def children(raw: bytes, at: int, end: int):
    """(id, start, body, end) of the elements between two places."""
    while at < end:
        start = at
        key, at = read_id(raw, at)
        size, at = read_size(raw, at)
        stop = end if size is None else at + size
        if size is None and key == CLUSTER:  # ends where the next one or the cues start
            stop = at
            while stop < end and read_id(raw, stop)[0] not in (CLUSTER, CUES, TRACKS, INFO):
                n, body = read_size(raw, read_id(raw, stop)[1])
                stop = end if n is None else body + n
        if stop > end:
            raise ValueError(f"element {key:x} reaches over its parent")
        yield key, start, at, stop
        at = stop


def frame_bounds(raw: bytes, at: int, end: int, lacing: int) -> list[tuple[int, int]]:
    """The byte range of each frame of a block whose flags end at ``at``."""
    if lacing == NO_LACING:
        return [(at, end)]
    count, at, sizes = raw[at] + 1, at + 1, []
    if lacing == FIXED:
        if (end - at) % count:
            raise ValueError("frames of a fixed size don't fill their block")
        sizes = [(end - at) // count] * count
    else:
        for k in range(count - 1):
            if lacing == XIPH:
                n = 0
                while raw[at] == 255:
                    n, at = n + 255, at + 1
                n, at = n + raw[at], at + 1
            else:
                width = 9 - raw[at].bit_length()
                n, at = read_size(raw, at)
                if n is None:
                    n = (1 << 7 * width) - 1
                if k:
                    n += sizes[-1] - ((1 << (7 * width - 1)) - 1)
            sizes.append(n)
        sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("frames reach over their block")
    edges = np.cumsum([at, *sizes]).tolist()
    return list(zip(edges, edges[1:]))


def parse(raw: bytes) -> Media:
    media = Media()
    uint = lambda a, b: int.from_bytes(raw[a:b], "big")
    real = lambda a, b: struct.unpack(">f" if b - a == 4 else ">d", raw[a:b])[0] if b > a else 0.0

    def packets_of(a: int, b: int, base: int, key_flag: bool | None) -> None:
        track, at = read_size(raw, a)
        relative, flags = struct.unpack(">hB", raw[at : at + 3])
        frames = frame_bounds(raw, at + 3, b, flags >> 1 & 3)
        key = bool(flags & 0x80) if key_flag is None else key_flag
        # frames of one lace follow each other by their track's default duration
        step = next((t["duration"] / media.scale for t in media.tracks if t["number"] == track), 0)
        media.packets += [(track, base + relative + round(k * step), x, y, key) for k, (x, y) in enumerate(frames)]

    for key, _, a, b in children(raw, 0, len(raw)):
        if key == EBML:
            media.doc_type = next((raw[x:y].decode() for k, _, x, y in children(raw, a, b) if k == DOC_TYPE), "")
        if key != SEGMENT:
            continue
        for part, at, x, y in children(raw, a, b):
            if part == INFO:
                for k, _, p, q in children(raw, x, y):
                    media.scale = uint(p, q) if k == TIMESTAMP_SCALE else media.scale
                    media.duration = real(p, q) if k == DURATION else media.duration
            elif part == TRACKS:
                for k, _, p, q in children(raw, x, y):
                    if k != TRACK_ENTRY:
                        continue
                    track = {"number": 0, "type": 0, "codec": "", "duration": 0, "rate": 0.0, "channels": 1, "bits": 0}
                    for f, _, s, t in children(raw, p, q):
                        if f in (TRACK_NUMBER, TRACK_TYPE):
                            track["number" if f == TRACK_NUMBER else "type"] = uint(s, t)
                        elif f == DEFAULT_DURATION:
                            track["duration"] = uint(s, t)
                        elif f == CODEC_ID:
                            track["codec"] = raw[s:t].decode()
                        elif f == AUDIO:
                            for g, _, u, v in children(raw, s, t):
                                if g == SAMPLING_FREQUENCY:
                                    track["rate"] = real(u, v)
                                elif g in (CHANNELS, BIT_DEPTH):
                                    track["channels" if g == CHANNELS else "bits"] = uint(u, v)
                    media.tracks.append(track)
            elif part == CLUSTER:
                media.clusters.append(at)
                base = 0
                for k, _, p, q in children(raw, x, y):
                    if k == TIMESTAMP:
                        base = uint(p, q)
                    elif k == SIMPLE_BLOCK:
                        packets_of(p, q, base, None)
                    elif k == BLOCK_GROUP:
                        inner = [(f, s, t) for f, _, s, t in children(raw, p, q)]
                        for f, s, t in inner:
                            if f == BLOCK:
                                packets_of(s, t, base, all(g != REFERENCE_BLOCK for g, _, _ in inner))
            elif part == CUES:
                for k, _, p, q in children(raw, x, y):
                    time, places = 0, []
                    for f, _, s, t in children(raw, p, q):
                        if f == CUE_TIME:
                            time = uint(s, t)
                        elif f == CUE_TRACK_POSITIONS:
                            inner = {g: uint(u, v) for g, _, u, v in children(raw, s, t)}
                            places.append((inner.get(CUE_TRACK, 0), a + inner.get(CUE_CLUSTER_POSITION, 0)))
                    media.cues += [(time, track, at) for track, at in places] if k == CUE_POINT else []
    return media


def payload_of(raw: bytes, media: Media, track: int = 1) -> bytes:
    """A track's frames end to end."""
    runs: list[list[int]] = []
    for number_, _, a, b, _ in media.packets:
        if number_ == track:
            if runs and runs[-1][1] == a:
                runs[-1][1] = b
            else:
                runs.append([a, b])
    return b"".join(raw[a:b] for a, b in runs)


def padded(text: str | None) -> tuple[int, bytes]:
    """Bytes of the text, and those filled with spaces to a positive multiple of 192."""
    raw = (text or "").encode()
    return len(raw), raw.ljust(max(FRAME, -(-len(raw) // FRAME) * FRAME), b" ")


def media_of_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media: each text as a file."""
    bound_arrow_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            texts = one_array(batch.column(1))
            for lo, hi in slices(texts):
                sizes, payloads = zip(*map(padded, texts.slice(lo, hi - lo).to_pylist()), strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(sizes, pa.int64()), pa.array(map(write_samples, payloads), pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(trimmed(run), "doc_id long, n_bytes long, media binary")


def packet_table(media: DataFrame) -> DataFrame:
    """A row per packet: doc_id, track, timestamp, start, end, key, error.

    A file that can't be parsed has one row, with the reason in ``error`` and nothing else but its id; the others'
    ``error`` is null. A null or empty file has no row.
    """
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string())
    names = ["doc_id", "track", "timestamp", "start", "end", "key", "error"]

    def rows_of(key, raw) -> list[tuple]:
        try:
            return [(key, *packet, None) for packet in parse(raw).packets] if raw else []
        except (ValueError, LookupError, ArithmeticError, struct.error) as reason:
            return [(key, None, None, None, None, None, f"{type(reason).__name__}: {reason}")]

    def run(batches):
        for batch in batches:
            for key, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                columns = [list(c) for c in zip(*rows_of(key, raw), strict=True)] or [[]] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    return media.select("doc_id", "media").mapInArrow(trimmed(run), "doc_id long, track int, timestamp long, start long, end long, key boolean, error string")


def features(payload: bytes, media: Media) -> str:
    """Facts of the track and integer statistics of its samples."""
    samples = np.frombuffer(payload, dtype=np.uint8)
    track = media.tracks[0]
    turns = int(np.count_nonzero(np.diff(samples.astype(np.int16)) > 0))
    energy = int(np.square(samples.astype(np.int64) - 128).sum())
    cued = sum(at in set(media.clusters) for _, _, at in media.cues) if len(media.cues) < 64 else len({at for _, _, at in media.cues} & set(media.clusters))
    return f"codec={track['codec']};rate={track['rate']:g};channels={track['channels']};bits={track['bits']};packets={len(media.packets)};clusters={len(media.clusters)};cued={cued};ms={media.duration:g};sum={int(samples.sum(dtype=np.int64))};rises={turns};energy={energy}"


DIGESTS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media_digests(media: DataFrame) -> DataFrame:
    """Digests of what the files of ``media_of_documents`` hold, read back from their bytes."""

    def run(batches):
        for batch in batches:
            rows = []
            for key, n, raw in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                read = parse(raw)
                payload = payload_of(raw, read)
                rows.append((key, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(raw), hashlib.sha256(raw).hexdigest(), features(payload, read)))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=[x.split()[0] for x in DIGESTS.split(", ")])

    return media.mapInArrow(trimmed(run), DIGESTS)
