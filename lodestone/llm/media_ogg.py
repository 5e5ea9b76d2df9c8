"""Media columns: Ogg containers written, read back and measured.

``encode`` puts a payload of 8-bit samples into an Ogg physical bitstream with
interleaved logical streams; ``decode`` verifies the checksum of every page,
puts packets together from the lacing values, separates the logical streams and
takes each packet's place in time from the granule positions.

Cases: a null text is empty, and so its payload is 64 zero bytes; equal texts
give equal media, so ties do not matter; repeated rows give repeated rows; a text
of any length is handled, a page holding at most 2,550 bytes (65,025 if asked
for) and a packet going on over pages; an empty table gives no rows; columns
beyond doc_id and text are ignored by ``media_digest`` and kept by ``to_media``,
but for one named ``media``, whose place the new column takes.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.memory import bounded, returned
from lodestone.session import ship

#: Bytes of a packet, and segments of a page (up to 255 bytes each): a packet goes on over the end of a page.
PACKET = 3_000
SEGMENTS = 10
STREAMS = 2
RATE = 8000
MAGIC = b"\x01rawu8\x00\x00"
_HEAD = struct.Struct("<4sBBqIIIB")
_REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


class OggError(ValueError):
    """A stream that breaks the container's rules."""


def checksum(data: bytes) -> int:
    """The CRC of an Ogg page: polynomial 0x04C11DB7, most significant bit first, from zero.

    zlib has the same polynomial with the least significant bit first, so bits
    are mirrored on the way in and out and its inversions are undone.
    """
    low = zlib.crc32(data.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(low.to_bytes(4, "little").translate(_REVERSED), "big")


def _page(flags: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    head = _HEAD.pack(b"OggS", 0, flags, granule, serial, number, 0, len(lacing)) + lacing
    return head[:22] + struct.pack("<I", checksum(head + body)) + head[26:] + body


def _pages_of(serial: int, packets: list[tuple[int, bytes]], most: int) -> list[tuple[int, bytes]]:
    """The pages of a logical stream as (granule of the last packet begun, page)."""
    segments: list[tuple[int, bytes, bool]] = []
    for granule, packet in packets:
        whole, rest = divmod(len(packet), 255)
        for i in range(whole):
            segments.append((granule, packet[255 * i : 255 * (i + 1)], False))
        segments.append((granule, packet[255 * whole :], True))
        assert rest < 255
    pages, number, carried = [], 1, False
    for at in range(0, len(segments), most):
        part = segments[at : at + most]
        ended = [g for g, _, last in part if last]
        flags = (1 if carried else 0) | (4 if at + most >= len(segments) else 0)
        page = _page(flags, ended[-1] if ended else -1, serial, number, bytes(len(s) for _, s, _ in part), b"".join(s for _, s, _ in part))
        pages.append((part[-1][0], page))
        number, carried = number + 1, not part[-1][2]
    return pages


def encode(payload: bytes, packet: int = PACKET, streams: int = STREAMS, rate: int = RATE, segments: int = SEGMENTS) -> bytes:
    """An Ogg bitstream of the payload: packet i goes to logical stream i mod streams.

    A granule position is the count of samples of the whole payload up to the end
    of the packet, so streams can be put on one time line again.
    """
    parts: list[list[tuple[int, bytes]]] = [[] for _ in range(streams)]
    for i, at in enumerate(range(0, len(payload), packet)):
        piece = payload[at : at + packet]
        parts[i % streams].append((at + len(piece), piece))
    used = [(k + 1, p) for k, p in enumerate(parts) if p]
    out = [_page(2, 0, serial, 0, bytes([len(MAGIC) + 12]), MAGIC + struct.pack("<III", rate, streams, packet)) for serial, _ in used]
    pages = [(granule, serial, n, page) for serial, p in used for n, (granule, page) in enumerate(_pages_of(serial, p, segments))]
    pages.sort(key=lambda x: x[:3])
    return b"".join(out + [x[3] for x in pages])


def decode(media: bytes) -> tuple[bytes, dict]:
    """The payload and what the container says of it; OggError for broken media."""
    at, pages = 0, 0
    open_: dict[int, bytearray] = {}
    expect: dict[int, int] = {}
    state: dict[int, dict] = {}
    pieces: list[tuple[int, int, bytes]] = []
    while at < len(media):
        if len(media) - at < 27 or media[at : at + 4] != b"OggS":
            raise OggError(f"no page at byte {at}")
        _, version, flags, granule, serial, number, said, count = _HEAD.unpack_from(media, at)
        lacing = media[at + 27 : at + 27 + count]
        begin = at + 27 + count
        end = begin + sum(lacing)
        if version or end > len(media):
            raise OggError(f"bad page at byte {at}")
        if checksum(media[at : at + 22] + b"\0\0\0\0" + media[at + 26 : end]) != said:
            raise OggError(f"checksum of page {number} of stream {serial}")
        if expect.get(serial, 0) != number or bool(flags & 2) != (number == 0):
            raise OggError(f"page {number} of stream {serial} is out of order")
        if bool(flags & 1) != (serial in open_):
            raise OggError(f"continuation of stream {serial}")
        expect[serial], pages = number + 1, pages + 1
        done: list[bytes] = []
        current = open_.pop(serial, bytearray())
        where, whole = begin, True
        for n in lacing:
            current += media[where : where + n]
            where, whole = where + n, n < 255
            if whole:
                done.append(bytes(current))
                current = bytearray()
        if not whole:
            open_[serial] = current
        if flags & 2:
            if len(done) != 1 or not done[0].startswith(MAGIC):
                raise OggError(f"stream {serial} is of another kind")
            rate, streams, size = struct.unpack_from("<III", done[0], len(MAGIC))
            state[serial] = {"rate": rate, "stride": size * streams, "packets": 0, "last": 0, "ended": False}
        elif serial not in state:
            raise OggError(f"stream {serial} has no head")
        else:
            s, ends = state[serial], granule
            stride = s["stride"]
            # only the last packet of a stream can be short, so earlier ends follow from the page's granule
            for back, packet in enumerate(reversed(done)):
                stop = ends if back == 0 else (ends - len(done[-1])) - stride * back + len(packet)
                pieces.append((stop - len(packet), serial, packet))
            s["packets"] += len(done)
            s["last"] = granule if done else s["last"]
            s["ended"] = bool(flags & 4)
        at = end
    if open_ or not all(s["ended"] for s in state.values()):
        raise OggError("a stream is cut off")
    pieces.sort()
    payload = b"".join(p for _, _, p in pieces)
    stop = 0
    for begin, _, p in pieces:
        if begin != stop:
            raise OggError(f"samples {stop} to {begin} are missing")
        stop += len(p)
    times = [begin / next(iter(state.values()))["rate"] for begin, _, _ in pieces]
    return payload, {"pages": pages, "streams": len(state), "packets": len(pieces), "samples": stop, "times": times, "rate": next(iter(state.values()))["rate"] if state else RATE}


def feature(payload: bytes, info: dict) -> str:
    """Length, level and crossings of the samples, in integers, so equal everywhere."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    return (
        f"pages={info['pages']};streams={info['streams']};packets={info['packets']};ms={info['samples'] * 1000 // info['rate']};"
        f"last_ms={int(info['times'][-1] * 1000) if info['times'] else 0};sum={int(x.sum())};energy={int((x * x).sum())};crossings={crossings}"
    )


SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _payload(text: str | None) -> bytes:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))


def digest(text: str | None) -> tuple:
    """The contract's columns for one text, from the media as read back."""
    media = encode(_payload(text))
    payload, info = decode(media)
    n = len((text or "").encode("utf-8", "surrogatepass"))
    return (n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature(payload, info))


def to_media(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of docs with a binary column ``media`` in place of the text."""
    bounded(ship(docs.sparkSession))
    rest = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in (text.lower(), "media")]
    # the row goes along as one struct, whatever its columns are named
    docs = docs.select(F.struct(*rest).alias("row"), F.col(f"`{text}`").cast("string").alias("text"))
    schema = T.StructType([docs.schema["row"], T.StructField("media", T.BinaryType())])

    def run(batches):
        for b in batches:
            media = pa.array([encode(_payload(t)) for t in b.column(1).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), media], names=["row", "media"])

    return docs.mapInArrow(lambda batches: returned(run(batches)), schema).select("row.*", "media")


def media_digest(docs: DataFrame) -> DataFrame:
    """One row a document: the stored media's size and hash, and what was read from it."""
    bounded(ship(docs.sparkSession))
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def run(batches):
        for b in batches:
            rows = [digest(t) for t in b.column(1).to_pylist()]
            cols = list(zip(*rows)) or [[] for _ in names[1:]]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([b.column(0)] + [pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(lambda batches: returned(run(batches)), SCHEMA)
