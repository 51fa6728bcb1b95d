"""Ogg containers: pages, packets, multiplexed streams and their times."""

from __future__ import annotations

import hashlib
import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._common import batched, rows

#: Fixed values of the container format.
CAPTURE = b"OggS"
CONTINUED, FIRST, LAST = 1, 2, 4
NO_PACKET_ENDS = 0xFFFFFFFFFFFFFFFF
MOST_SEGMENTS = 255

_MIRROR = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def checksum(page: bytes) -> int:
    """The format's CRC-32: polynomial 0x04C11DB7, most significant bit first, no inversion. zlib's runs the other way round, so bits are mirrored before and after."""
    raw = zlib.crc32(page.translate(_MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int(f"{raw:032b}"[::-1], 2)


def write_stream(packets: list[bytes], granules: list[int], serial: int) -> list[bytes]:
    """The pages of one logical stream: packets laced into segments of up to 255 bytes, 255 segments a page.

    ``granules`` has the position reached at the end of each packet; a page says
    that of the last packet that ends in it.
    """
    lacing: list[tuple[bytes, int | None]] = []
    for packet, granule in zip(packets, granules, strict=True):
        whole = len(packet) // 255
        lacing += [(packet[255 * i : 255 * i + 255], None) for i in range(whole)]
        lacing.append((packet[255 * whole :], granule))
    pages, open_packet = [], False
    for number, i in enumerate(range(0, len(lacing), MOST_SEGMENTS)):
        part = lacing[i : i + MOST_SEGMENTS]
        ends = [g for _, g in part if g is not None]
        kind = CONTINUED * open_packet | FIRST * (i == 0) | LAST * (i + MOST_SEGMENTS >= len(lacing))
        head = CAPTURE + struct.pack("<BBQIII", 0, kind, ends[-1] if ends else NO_PACKET_ENDS, serial, number, 0) + bytes([len(part)]) + bytes(len(x) for x, _ in part)
        page = head + b"".join(x for x, _ in part)
        pages.append(page[:22] + struct.pack("<I", checksum(page)) + page[26:])
        open_packet = part[-1][1] is None
    return pages


def interleave(*streams: list[bytes]) -> bytes:
    """Multiplex streams: all first pages, then the rest in turn."""
    out = [s[0] for s in streams if s]
    for i in range(1, max((len(s) for s in streams), default=0)):
        out += [s[i] for s in streams if i < len(s)]
    return b"".join(out)


def read_streams(data: bytes) -> dict[int, dict]:
    """Demultiplex a file: for each serial its packets and, for each packet, the granule position of its page if it is the last that ends there, else None.

    Every page's capture pattern, checksum and number must hold, continued
    packets must have a beginning and an end, and each stream a first and a last
    page; else ValueError.
    """
    streams: dict[int, dict] = {}
    at = 0
    while at < len(data):
        if data[at : at + 4] != CAPTURE or at + 27 > len(data):
            raise ValueError(f"no page at byte {at}")
        version, kind, granule, serial, number, said, n = struct.unpack_from("<BBQIIIB", data, at + 4)
        sizes = data[at + 27 : at + 27 + n]
        body = at + 27 + n
        end = body + sum(sizes)
        page = data[at:end]
        if version or len(sizes) < n or end > len(data) or checksum(page[:22] + b"\0\0\0\0" + page[26:]) != said:
            raise ValueError(f"bad page at byte {at}")
        s = streams.setdefault(serial, {"packets": [], "granules": [], "pages": 0, "open": None, "ended": False})
        if number != s["pages"] or bool(kind & FIRST) != (number == 0) or bool(kind & CONTINUED) != (s["open"] is not None) or s["ended"]:
            raise ValueError(f"page out of order at byte {at}")
        held, ended = s["open"] or [], False
        for size in sizes:
            held.append(data[body : body + size])
            body += size
            if size < 255:
                s["packets"].append(b"".join(held))
                s["granules"].append(None)
                ended = True
                held = []
        if ended:
            s["granules"][-1] = granule
        open_ = held or (n and sizes[-1] == 255)
        s |= {"pages": number + 1, "open": held if open_ else None, "ended": bool(kind & LAST)}
        at = end
    if any(s["open"] is not None or not s["ended"] for s in streams.values()):
        raise ValueError("a stream does not end")
    return streams


#: A sound stream's first packet: marker, bits a sample, channels, samples a second; an index stream's: marker.
SOUND_HEAD, INDEX_HEAD = b"\x01samples8", b"\x01index000"
SOUND, INDEX = 1, 2


def encode_samples(payload: bytes, rate: int = 8000, packet_samples: int = 4096) -> bytes:
    """8-bit samples as an Ogg file: a sound stream, and an index stream with the checksum of each sound packet."""
    parts = [payload[i : i + packet_samples] for i in range(0, len(payload), packet_samples)] or [b""]
    ends = [min(len(payload), (i + 1) * packet_samples) for i in range(len(parts))]
    sound = write_stream([SOUND_HEAD + struct.pack("<BBI", 8, 1, rate), *parts], [0, *ends], SOUND)
    index = write_stream([INDEX_HEAD, *(struct.pack("<I", zlib.crc32(p)) for p in parts)], [0, *ends], INDEX)
    return interleave(sound, index)


def packet_ends(granules: list[int | None], durations: list[int]) -> list[int]:
    """The granule position at the end of each packet.

    A page says that of the last packet that ends in it; a packet before ends
    where the next begins, by the durations of packets in granules.
    """
    ends, begin = [], 0
    for granule, duration in zip(reversed(granules), reversed(durations), strict=True):
        end = begin if granule is None else granule
        ends.append(end)
        begin = end - duration
    return ends[::-1]


def decode_samples(media: bytes) -> dict:
    """What an Ogg file of :func:`encode_samples` holds: payload, rate, when each packet ends and how long all last, in seconds."""
    streams = read_streams(media)
    by_head = {s["packets"][0][:9]: s for s in streams.values() if s["packets"]}
    sound, index = by_head[SOUND_HEAD], by_head[INDEX_HEAD]
    _, _, rate = struct.unpack("<BBI", sound["packets"][0][9:])
    parts = sound["packets"][1:]
    if [zlib.crc32(p) for p in parts] != [struct.unpack("<I", x)[0] for x in index["packets"][1:]]:
        raise ValueError("the sound is not what its index says")
    payload = b"".join(parts)
    ends = packet_ends(sound["granules"], [0, *map(len, parts)])[1:]  # a sample is a byte
    if ends != np.cumsum([len(p) for p in parts]).tolist():
        raise ValueError("samples are missing")
    return {"payload": payload, "rate": rate, "seconds": ends[-1] / rate, "ends": [x / rate for x in ends], "packets": len(parts), "pages": sum(s["pages"] for s in streams.values())}


def describe(sound: dict) -> str:
    """Features of decoded samples, as JSON: duration, level, loudness, sign changes about the middle, packets, pages and the mean end of a packet."""
    x = np.frombuffer(sound["payload"], np.uint8).astype(np.int64) - 128
    total, squares = int(x.sum()), int((x * x).sum())
    crossings = int(((x[1:] < 0) != (x[:-1] < 0)).sum())
    n = max(1, len(x))
    return json.dumps({"seconds": round(sound["seconds"], 6), "mean": round(total / n, 6), "rms": round((squares / n) ** 0.5, 6), "crossings": crossings, "packets": sound["packets"], "pages": sound["pages"], "mean_end": round(sum(sound["ends"]) / len(sound["ends"]), 6)})


def store_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", multiple: int = 192, rate: int = 8000) -> DataFrame:
    """Each text's bytes, padded with spaces to a positive multiple of ``multiple``, as an Ogg column.

    Returns id_col, n_bytes, media. Null text counts as empty; ids may be null or
    repeat. Equal texts give equal bytes: serials are fixed.
    """
    from pyspark.sql import functions as F
    from pyspark.sql.pandas.types import to_arrow_type

    kind = docs.schema[id_col].dataType
    schema = pa.schema([("id", to_arrow_type(kind)), ("n_bytes", pa.int64()), ("media", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            for key, raw in rows(batches):
                raw = raw or b""
                yield key, len(raw), encode_samples(raw.ljust(max(1, -(-len(raw) // multiple)) * multiple, b" "), rate)

        yield from batched(each(), schema, 256)

    return docs.select(F.col(id_col), F.col(text_col).cast("binary").alias("raw")).mapInArrow(run, f"`{id_col}` {kind.simpleString()}, n_bytes long, media binary")


def read_media(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """Read an Ogg column back: id_col, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature.

    Passes other columns on. Null media give null values; damaged ones fail.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    others = [f for f in media.schema if f.name != media_col]
    made = [("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]
    schema = pa.schema([*((f.name, to_arrow_type(f.dataType)) for f in others), *made])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            for *kept, data in rows(batches):
                if data is None:
                    yield *kept, *[None] * len(made)
                    continue
                sound = decode_samples(data)
                payload = sound["payload"]
                yield *kept, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), describe(sound)

        yield from batched(each(), schema)

    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in others), "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"])
    return media.select(*[f.name for f in others], media_col).mapInArrow(run, ddl)
