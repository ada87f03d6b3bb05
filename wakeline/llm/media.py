"""MPEG audio columns: frame index, tags, variable-bitrate tables, checksums, exact durations.

``index_audio`` works on any bytes: it skips ID3v2/ID3v1/APEv2 tags, finds frame
headers again after garbage, reads Xing/Info tables and the byte and frame counts of
VBRI tables (not their seek entries), verifies the 16-bit checksums of Layer III frames
(those of Layers I and II are not verified), and reports the exact number of samples and the offset of every
frame.  ``pack_payload`` / ``unpack_payload`` store arbitrary bytes losslessly in
the main data of valid Layer III frames, with the payload length in a tag.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import widened

# Fixed values of the MPEG audio format: kbit/s by (MPEG-1?, layer), sample rates, Xing offsets.
BITRATES = {
    (True, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
SIDE_INFO = {(True, False): 32, (True, True): 17, (False, False): 17, (False, True): 9}  # (MPEG-1?, mono?)


@lru_cache(4096)
def header(word: int) -> dict | None:
    """The fields of a 32-bit frame header, or None if it is not a usable one."""
    version, layer = word >> 19 & 3, 4 - (word >> 17 & 3)
    rate, bits = word >> 10 & 3, word >> 12 & 15
    if word >> 21 != 0x7FF or version == 1 or layer == 4 or rate == 3 or bits in (0, 15):
        return None
    one, mono = version == 3, word >> 6 & 3 == 3
    kbps, hz, pad = BITRATES[one, layer][bits], RATES[version][rate], word >> 9 & 1
    if layer == 1:
        size, samples = (12000 * kbps // hz + pad) * 4, 384
    else:
        samples = 576 if layer == 3 and not one else 1152
        size = samples // 8 * kbps * 1000 // hz + pad
    return {"mpeg1": one, "layer": layer, "version": version, "kbps": kbps, "hz": hz, "size": size, "samples": samples,
            "mono": mono, "crc": not word >> 16 & 1, "side": SIDE_INFO[one, mono], "kind": (version, layer, rate)}


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 8
        for _ in range(8):
            c = c << 1 ^ (0x8005 if c & 0x8000 else 0)
        out.append(c & 0xFFFF)
    return out


_CRC = _crc_table()


@lru_cache(4096)
def frame_crc(protected: bytes) -> int:
    c = 0xFFFF
    for b in protected:
        c = (c << 8 & 0xFFFF) ^ _CRC[c >> 8 ^ b]
    return c


def _syncsafe(b: bytes) -> int:
    return b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]


def _text(raw: bytes) -> str:
    coding = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(raw[0] if raw else 0, "latin-1")
    return raw[1:].decode(coding, "replace").rstrip("\0")


def _stated_end(data: bytes, start: int) -> int:
    """Where the audio ends by the byte count of a table in the frame at ``start``; without one, ``start``."""
    h = header(int.from_bytes(data[start : start + 4], "big"))
    stated = start + ((_table(data, start, h) or {}).get("bytes", 0) if h else 0)
    return stated if stated <= len(data) else start


def read_tags(data: bytes) -> tuple[dict[str, str], int, int]:
    """(tags, where audio starts, where it ends).  Bytes that a table counts as audio are no closing tag."""
    tags: dict[str, str] = {}
    start, end = 0, len(data)
    while data[start : start + 3] == b"ID3" and start + 10 <= end:
        major, flags, size = data[start + 3], data[start + 5], _syncsafe(data[start + 6 : start + 10])
        at, stop = start + 10, min(end, start + 10 + size)
        if flags & 0x40 and at + 4 <= stop:  # extended header
            at += _syncsafe(data[at : at + 4]) if major >= 4 else 4 + struct.unpack(">I", data[at : at + 4])[0]
        while at + 10 <= stop and data[at : at + 1].isalnum():
            name, raw = data[at : at + 4].decode("latin-1"), data[at + 4 : at + 8]
            n = _syncsafe(raw) if major >= 4 else struct.unpack(">I", raw)[0]
            value = data[at + 10 : min(stop, at + 10 + n)]
            if name == "TXXX":
                what, _, text = _text(value).partition("\0")
                tags[what] = text
            elif name[0] == "T":
                tags[name] = _text(value)
            at += 10 + n
        start = min(end, start + 10 + size + (10 if flags & 0x10 else 0))
    audio = _stated_end(data, start)
    if end - audio >= 128 and data[end - 128 : end - 125] == b"TAG":
        end -= 128
        for name, a, b in (("title", 3, 33), ("artist", 33, 63), ("album", 63, 93), ("year", 93, 97)):
            if value := data[end + a : end + b].split(b"\0")[0].decode("latin-1").strip():
                tags.setdefault(name, value)
    if end - audio >= 32 and data[end - 32 : end - 24] == b"APETAGEX":
        size, flags = struct.unpack("<I", data[end - 20 : end - 16])[0], struct.unpack("<I", data[end - 12 : end - 8])[0]
        end = max(audio, end - size - (32 if flags >> 31 else 0))
    return tags, start, end


def _table(data: bytes, at: int, h: dict) -> dict | None:
    """The Xing/Info or VBRI table in the frame at ``at``."""
    x = at + 4 + h["side"] + (2 if h["crc"] and data[at + 6 + h["side"] : at + 10 + h["side"]] in (b"Xing", b"Info") else 0)
    if (name := data[x : x + 4]) in (b"Xing", b"Info") and x + 8 <= len(data):
        flags, x, out = struct.unpack(">I", data[x + 4 : x + 8])[0], x + 8, {"table": name.decode()}
        for bit, key in ((1, "frames"), (2, "bytes")):
            if flags & bit and x + 4 <= len(data):
                out[key], x = struct.unpack(">I", data[x : x + 4])[0], x + 4
        if flags & 4:
            out["toc"], x = list(data[x : x + 100]), x + 100
        x += 4 if flags & 8 else 0
        if data[x : x + 4] == b"LAME" and x + 24 <= len(data):
            d = data[x + 21 : x + 24]
            out["delay"], out["padding"] = d[0] << 4 | d[1] >> 4, (d[1] & 15) << 8 | d[2]
        return out
    if data[at + 36 : at + 40] == b"VBRI" and at + 54 <= len(data):
        size, frames = struct.unpack(">II", data[at + 46 : at + 54])
        return {"table": "VBRI", "bytes": size, "frames": frames}
    return None


_SYNC = re.compile(rb"\xff[\xe0-\xff]")


def index_audio(data: bytes | None) -> dict:
    """Index of an MPEG audio stream; never raises.

    ``samples / hz`` is the exact duration (encoder delay and padding taken off where a
    table states them); a cut last frame is not counted but sets ``truncated``.
    Null and empty bytes give an index without frames.
    """
    data = data or b""
    tags, at, end = read_tags(data)
    out = {"tags": tags, "table": None, "kind": None, "hz": 0, "channels": 0, "samples": 0, "seek": [], "crc_checked": 0, "crc_failed": 0, "skipped": 0, "resyncs": 0, "kbps_min": 0, "kbps_max": 0, "truncated": False, "audio_start": at, "audio_end": end}
    kind = None
    seek = out["seek"]
    while at + 4 <= end:
        h = header(int.from_bytes(data[at : at + 4], "big"))
        synced = h is not None and (kind is None or h["kind"] == kind)
        if synced and (not seek or out["lost"]):  # a first or found-again header must be followed by another, or by the end
            nxt = at + h["size"]
            after = header(int.from_bytes(data[nxt : nxt + 4], "big")) if nxt + 4 <= end else None
            synced = nxt == end or after is not None and after["kind"] == h["kind"]
        if not synced:
            found = _SYNC.search(data, at + 1, end)
            to = found.start() if found else end
            out["skipped"] += to - at
            out["lost"], at = True, to
            continue
        if at + h["size"] > end:
            out["truncated"] = True
            break
        if out.pop("lost", False) and seek:
            out["resyncs"] += 1
        out["lost"] = False
        if h["crc"] and h["layer"] == 3:
            out["crc_checked"] += 1
            protected = data[at + 2 : at + 4] + data[at + 6 : at + 6 + h["side"]]
            out["crc_failed"] += frame_crc(protected) != data[at + 4] << 8 | data[at + 5]
        first = kind is None
        if first:
            kind = h["kind"]
            out |= {"kind": f"mpeg{ {3: '1', 2: '2', 0: '2.5'}[h['version']] }-l{h['layer']}".replace(" ", ""), "hz": h["hz"], "channels": 1 if h["mono"] else 2}
            out["table"] = _table(data, at, h)
        if not (first and out["table"]):
            seek.append(at)
            out["samples"] += h["samples"]
            out["kbps_min"] = min(out["kbps_min"] or h["kbps"], h["kbps"])
            out["kbps_max"] = max(out["kbps_max"], h["kbps"])
        elif first:
            out["table"]["at"] = at
        at += h["size"]
    out.pop("lost", None)
    if out["table"] and out["samples"]:
        out["samples"] = max(0, out["samples"] - out["table"].get("delay", 0) - out["table"].get("padding", 0))
    return out


_SIDE = bytes(32)


def _head(bits: int) -> tuple[bytes, int]:
    """Header, checksum and empty side information of an MPEG-1 Layer III stereo frame; room left in it."""
    word = 0x7FF << 21 | 3 << 19 | 1 << 17 | bits << 12
    raw = word.to_bytes(4, "big")
    return raw + frame_crc(raw[2:4] + _SIDE).to_bytes(2, "big") + _SIDE, header(word)["size"] - 38


_HEADS = {bits: _head(bits) for bits in range(1, 15)}
_BY_ROOM = sorted(_HEADS, key=lambda b: _HEADS[b][1])


def pack_payload(payload: bytes) -> bytes:
    """A variable-bitrate stream whose frames carry ``payload`` in their main data."""
    big, room = _HEADS[14]
    frames = [big + payload[i : i + room] for i in range(0, len(payload) - len(payload) % room, room)]
    if rest := payload[len(payload) - len(payload) % room :]:
        head, n = next(_HEADS[b] for b in _BY_ROOM if _HEADS[b][1] >= len(rest))
        frames.append(head + rest + bytes(n - len(rest)))
    body = b"".join(frames)
    head, n = _HEADS[5]
    total = len(head) + n + len(body)
    ends = [0]
    for f in frames:
        ends.append(ends[-1] + len(f))
    toc = bytes(min(255, ends[len(frames) * i // 100] * 256 // max(1, len(body))) for i in range(100))
    xing = b"Xing" + struct.pack(">III", 7, len(frames), total) + toc
    text = b"\3payload_bytes\0" + str(len(payload)).encode()
    tag = b"TXXX" + struct.pack(">IH", len(text), 0) + text
    size = len(tag)
    id3 = b"ID3\4\0\0" + bytes((size >> 21 & 127, size >> 14 & 127, size >> 7 & 127, size & 127))
    # version 2.4 frame sizes are syncsafe; below 128 both codings agree
    return id3 + tag + head + xing + bytes(n - len(xing)) + body


def unpack_payload(media: bytes, index: dict | None = None) -> bytes:
    index = index or index_audio(media)
    parts = [media[at + 38 : at + header(int.from_bytes(media[at : at + 4], "big"))["size"]] for at in index["seek"]]
    return b"".join(parts)[: int(index["tags"].get("payload_bytes", 0))]


def payload_of(text: bytes | None, unit: int = 64) -> bytes:
    """The text's bytes with zeros appended up to a positive multiple of ``unit``."""
    raw = text or b""
    return raw + bytes(-len(raw) % unit if raw else unit)


def store_texts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with a ``media`` column holding each whole text as an audio stream (null: empty text)."""
    docs = docs.drop("media")
    wide = docs.select(F.col(text).cast("binary").alias("__wl_text"), "*")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            media = pa.array([pack_payload(payload_of(t.as_py())) for t in b.column(0)], pa.binary())
            yield pa.record_batch([*b.columns, media], names=[*b.schema.names, "media"])

    return wide.mapInArrow(pack, widened(wide, "media binary")).drop("__wl_text")


INDEX = "kind string, hz int, channels int, samples long, duration_s double, n_frames long, seek_offsets array<long>, table string, table_frames long, crc_checked long, crc_failed long, resyncs long, skipped long, truncated boolean, tags map<string,string>"
PAYLOAD = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _feature(x: dict) -> str:
    table = x["table"] or {}
    return f"{x['kind']};{x['hz']}Hz;ch={x['channels']};frames={len(x['seek'])};samples={x['samples']};kbps={x['kbps_min']}-{x['kbps_max']};table={table.get('table')}:{table.get('frames')};crc={x['crc_checked']}/{x['crc_failed']}"


def read_media(df: DataFrame, media: str = "media", payload: bool = False) -> DataFrame:
    """``df`` with the index columns of its audio bytes, and with ``payload`` those of the bytes they carry.

    Null, empty or foreign bytes give zero frames, a null ``kind`` and an empty
    payload; nothing raises.  Columns named like the outputs are replaced.
    """
    ddl = f"{INDEX}, {PAYLOAD}" if payload else INDEX
    added = T.StructType.fromDDL(ddl)
    df = df.drop(*added.names)
    wide = df.select(F.col(media).alias("__wl_media"), "*")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        types = to_arrow_schema(added)
        for b in batches:
            rows = []
            for cell in b.column(0):
                raw = cell.as_py() or b""
                x = index_audio(raw)
                t = x["table"] or {}
                row = [x["kind"], x["hz"], x["channels"], x["samples"], x["samples"] / x["hz"] if x["hz"] else 0.0, len(x["seek"]), x["seek"], t.get("table"), t.get("frames"), x["crc_checked"], x["crc_failed"], x["resyncs"], x["skipped"], x["truncated"], list(x["tags"].items())]
                if payload:
                    p = unpack_payload(raw, x)
                    row += [len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(raw), hashlib.sha256(raw).hexdigest(), _feature(x)]
                rows.append(row)
            cols = list(zip(*rows, strict=True)) if rows else [[]] * len(types)
            yield pa.record_batch([*b.columns, *(pa.array(c, f.type) for c, f in zip(cols, types, strict=True))], names=[*b.schema.names, *types.names])

    return wide.mapInArrow(read, widened(wide, ddl)).drop("__wl_media")
