"""Ogg media columns: pages with checksums, packets from lacing values, logical streams, times from granule positions.

A payload of bytes is stored as 8-bit samples in two logical streams, whose packets of PACKET samples alternate; each
stream begins with a header packet (signature, rate, total samples, stream number). Reading verifies every page's checksum
and sequence number, puts packets together from lacing values (across pages where they continue), sorts them by stream,
and gives each packet the time that its page's granule position implies. Serial numbers depend on nothing but the stream,
so equal payloads give equal files.

Defined cases: null text counts as empty; any payload is padded with zero bytes to a positive multiple of 64; a damaged
page, a gap in a sequence or a packet that never ends raises ValueError (`features_of` gives such media a null feature).
Rows that repeat get equal results; an empty table gives an empty result; extra columns play no part.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy

RATE, PACKET, STREAMS, MAGIC = 8000, 5120, 2, b"u8mono\0\0"
#: Lacing values of a page. A whole packet has 21 of them, so packets of long payloads run on from page to page.
SEGMENTS = 255
_REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def checksum(data: bytes) -> int:
    """The page checksum (polynomial 04c11db7, no reflection, zero start) by the reflected one of zlib on mirrored bytes."""
    mirrored = zlib.crc32(data.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(mirrored.to_bytes(4, "little").translate(_REVERSED), "big")


def page(serial: int, sequence: int, granule: int, lacing: bytes, body: bytes, flags: int) -> bytes:
    head = struct.pack("<4sBBqIII", b"OggS", 0, flags, granule, serial, sequence, 0) + bytes([len(lacing)]) + lacing
    data = head + body
    return data[:22] + struct.pack("<I", checksum(data)) + data[26:]


def lacing_of(packets: list[bytes]) -> bytes:
    """Lacing values: 255 for each such piece of a packet, then what is left, 0 to 254."""
    return b"".join(b"\xff" * (len(p) // 255) + bytes([len(p) % 255]) for p in packets)


def paged(serial: int, sequence: int, packets: list[bytes], segments: int = SEGMENTS) -> list[bytes]:
    """The pages of a stream's data packets; a page's granule is the samples of the packets that are whole by its end, -1 if none ends on it."""
    lacing, body = lacing_of(packets), b"".join(packets)
    out, at, samples, whole = [], 0, 0, 0
    for k in range(0, max(1, len(lacing)), segments):
        own = lacing[k : k + segments]
        size = sum(own)
        ended = sum(v < 255 for v in own)
        samples += sum(map(len, packets[whole : whole + ended]))
        whole += ended
        flags = (1 if k and lacing[k - 1] == 255 else 0) | (4 if k + segments >= len(lacing) else 0)
        out.append(page(serial, sequence + len(out), samples if ended or not own else -1, own, body[at : at + size], flags))
        at += size
    return out


def encode(payload: bytes, segments: int = SEGMENTS) -> bytes:
    """The Ogg form of a payload."""
    chunks = [payload[i : i + PACKET] for i in range(0, len(payload), PACKET)]
    own = [chunks[s::STREAMS] for s in range(STREAMS)]
    heads = [MAGIC + struct.pack("<IQB", RATE, sum(map(len, own[s])), s) for s in range(STREAMS)]
    out = [page(s + 1, 0, 0, lacing_of([h]), h, 2) for s, h in enumerate(heads)]
    pages = [paged(s + 1, 1, own[s], segments) for s in range(STREAMS)]
    for k in range(max(map(len, pages))):
        out += [pages[s][k] for s in range(STREAMS) if k < len(pages[s])]
    return b"".join(out)


def pages(data: bytes):
    """(serial, sequence, granule, flags, lacing values, body) of each page, checksums verified."""
    at = 0
    while at < len(data):
        if data[at : at + 4] != b"OggS" or len(data) < at + 27 or data[at + 4]:
            raise ValueError(f"no page at byte {at}")
        _, _, flags, granule, serial, sequence, crc = struct.unpack_from("<4sBBqIII", data, at)
        n = data[at + 26]
        lacing = data[at + 27 : at + 27 + n]
        end = at + 27 + n + sum(lacing)
        if len(lacing) < n or len(data) < end:
            raise ValueError(f"the page at byte {at} is cut off")
        if checksum(data[at : at + 22] + b"\0\0\0\0" + data[at + 26 : end]) != crc:
            raise ValueError(f"the page at byte {at} fails its checksum")
        yield serial, sequence, granule, flags, lacing, data[at + 27 + n : end]
        at = end


def demultiplex(data: bytes) -> dict[int, list[tuple[bytes, int | None]]]:
    """Packets of each logical stream with the granule position of the page that ends them (on a page's last packet)."""
    streams: dict[int, list] = {}
    partial: dict[int, list[bytes]] = {}
    due: dict[int, int] = {}
    ended: set[int] = set()
    for serial, sequence, granule, flags, lacing, body in pages(data):
        if serial in ended or sequence != due.get(serial, 0) or bool(flags & 2) != (sequence == 0):
            raise ValueError(f"stream {serial} is out of order at page {sequence}")
        if bool(flags & 1) != bool(partial.get(serial)):
            raise ValueError(f"stream {serial}: a packet's continuation is missing at page {sequence}")
        due[serial] = sequence + 1
        packets, parts = streams.setdefault(serial, []), partial.setdefault(serial, [])
        at, last = 0, None
        for x in lacing:
            parts.append(body[at : at + x])
            at += x
            if x < 255:
                packets.append((b"".join(parts), None))
                parts.clear()
                last = len(packets) - 1
        if last is not None:
            packets[last] = (packets[last][0], granule)
        if flags & 4:
            ended.add(serial)
    if any(partial.values()) or ended != set(streams):
        raise ValueError("a stream does not end")
    return streams


def timed(packets: list[tuple[bytes, int | None]]) -> list[float]:
    """Seconds at which each packet of 8-bit samples begins, counted back from the granule positions of page ends."""
    times, k = [], 0
    while k < len(packets):
        end = next((i for i in range(k, len(packets)) if packets[i][1] is not None), None)
        if end is None:
            raise ValueError("the last packets have no granule position")
        at = packets[end][1] - sum(len(p) for p, _ in packets[k : end + 1])
        for p, _ in packets[k : end + 1]:
            times.append(at / RATE)
            at += len(p)
        k = end + 1
    return times


def decode(data: bytes) -> tuple[bytes, list[float]]:
    """The payload, and the start of each of its packets in seconds of its own stream."""
    streams = {}
    for packets in demultiplex(data).values():
        head = packets[0][0]
        if head[:8] != MAGIC:
            raise ValueError("unknown codec")
        _, total, number = struct.unpack("<IQB", head[8:])
        body = packets[1:]
        times = timed(body)
        if sum(len(p) for p, _ in body) != total:
            raise ValueError(f"stream {number} has lost samples")
        streams[number] = (body, times)
    order = sorted((i, s) for s, (body, _) in streams.items() for i in range(len(body)))
    return b"".join(streams[s][0][i][0] for i, s in order), [streams[s][1][i] for i, s in order]


def padded(text: str | None) -> tuple[bytes, int]:
    data = (text or "").encode("utf-8", "surrogatepass")
    return data + b"\0" * (64 if not data else -len(data) % 64), len(data)


def encoded(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """(doc_id, n_bytes, media): each text's Ogg form."""

    def store(batches):
        for batch in batches:
            for k in range(0, len(batch), 500):
                b = batch.slice(k, 500)
                forms = [padded(t) for t in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([n for _, n in forms], type=pa.int64()), pa.array([encode(p) for p, _ in forms], type=pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col(f"`{id_column}`").cast("long").alias("doc_id"), "text").mapInArrow(tidy(store), "doc_id long, n_bytes long, media binary")


def features_of(media: bytes) -> tuple[bytes | None, str | None]:
    """The payload and its features: streams, packets, seconds, mean, deviation and zero crossings of the samples."""
    try:
        payload, times = decode(media)
    except (ValueError, struct.error):
        return None, None
    x = np.frombuffer(payload, dtype=np.uint8).astype(np.int16) - 128
    crossings = int((np.diff(np.signbit(x)) != 0).sum())
    seconds = len(payload) / RATE
    return payload, f"streams={STREAMS};packets={len(times)};seconds={seconds:.6f};last={times[-1]:.6f};mean={x.mean():.6f};rms={np.sqrt((x.astype(np.float64) ** 2).mean()):.6f};crossings={crossings}"


def decoded(media: DataFrame) -> DataFrame:
    """Digests and features of the stored media, read back; columns as in the query."""

    def load(batches):
        names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        for b in batches:
            stored = b.column(2).to_pylist()
            got = [features_of(m) for m in stored]
            one = lambda f, kind: pa.array([None if p is None else f(p) for p, _ in got], type=kind)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), one(len, pa.int64()), one(lambda p: hashlib.sha256(p).hexdigest(), pa.string()), one(lambda p: zlib.crc32(p[-64:]), pa.int64()),
                                              pa.array([len(m) for m in stored], type=pa.int64()), pa.array([hashlib.sha256(m).hexdigest() for m in stored]), pa.array([f for _, f in got], type=pa.string())], names)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(tidy(load), "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def query(spark, sf_dir: str) -> DataFrame:
    return decoded(encoded(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))
