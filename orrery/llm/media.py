"""Media columns: MPEG audio. A payload is stored in the frames of an MPEG-1 Layer III stream, and read back with its durations and seek offsets.

The writer makes an ID3v2.4 tag (with the payload's length), a frame with a Xing table (frames, bytes and 100 seek points), then frames with CRC whose side
information declares silence and whose main data carries the payload, octet by octet. Bit rates vary to fit what is left. The reader works on any stream: it
skips tags, synchronises on frame headers (at the start, after any loss and at a change, a header counts only if it and those that follow where frames say, four in all or up to the
end, agree in version, layer and rate), parses the variable-bitrate table (Xing, Info or VBRI), verifies the checksums of all layers, and gives exact
durations and the offset of each frame.

A null text counts as empty; payloads are padded with zero bytes to a positive multiple of 64. Rows are independent: repeated rows keep a row each, equal texts have equal
results. Frames are handled one by one, whatever the text's length. A null stream counts as an empty one, and a payload length that is no number as none. Empty tables give empty results. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from fractions import Fraction
from functools import cache, lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm._shared import slices, utf8

# Fixed values of the format (ISO/IEC 11172-3 and 13818-3): kbit/s by bit-rate index, samples a second by rate index.
RATES_V1 = {1: (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448), 2: (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384), 3: (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320)}
RATES_V2 = {1: (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256), 2: (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160), 3: (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160)}
HERTZ = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
SIDE = 17  # octets of side information of a mono MPEG-1 Layer III frame
# Bits of each subband's allocation in Layer II: MPEG-1 at high, higher and low rates (the last at 32 kHz), and MPEG-2.
LAYER_II = {"a": [4] * 11 + [3] * 12 + [2] * 4, "b": [4] * 11 + [3] * 12 + [2] * 7, "c": [4] * 2 + [3] * 6, "d": [4] * 2 + [3] * 10, "lsf": [4] * 4 + [3] * 7 + [2] * 19}


@lru_cache(1 << 16)
def header(word: bytes) -> tuple[int, int, int, int, int, bool] | None:
    """(version, layer, octets of the frame, samples, hertz, has a CRC) of a frame header; None if it isn't one."""
    if len(word) < 4 or word[0] != 0xFF or word[1] & 0xE0 != 0xE0:
        return None
    version, layer, rate, hz = word[1] >> 3 & 3, 4 - (word[1] >> 1 & 3), word[2] >> 4, word[2] >> 2 & 3
    if version == 1 or layer == 4 or rate in (0, 15) or hz == 3 or word[3] & 3 == 2:
        return None
    kbit = (RATES_V1 if version == 3 else RATES_V2)[layer][rate - 1]
    hertz, padding = HERTZ[version][hz], word[2] >> 1 & 1
    if layer == 1:
        return version, layer, (12_000 * kbit // hertz + padding) * 4, 384, hertz, not word[1] & 1
    samples = 576 if layer == 3 and version != 3 else 1152
    return version, layer, samples // 8 * 1000 * kbit // hertz + padding, samples, hertz, not word[1] & 1


@lru_cache(1 << 14)
def crc16(data: bytes) -> int:
    """The format's checksum: polynomial 0x8005, from 0xFFFF."""
    crc = 0xFFFF
    for octet in data:
        crc ^= octet << 8
        for _ in range(8):
            crc = (crc << 1 ^ 0x8005 if crc & 0x8000 else crc << 1) & 0xFFFF
    return crc


def crc16_bits(data: bytes, bits: int) -> int:
    """The checksum of so many leading bits."""
    crc = crc16(data[: bits // 8])
    for k in range(bits // 8 * 8, bits):
        bit = data[k // 8] >> 7 - k % 8 & 1
        crc = (crc << 1 ^ 0x8005 if (crc >> 15) ^ bit else crc << 1) & 0xFFFF
    return crc


def guarded_bits(frame: bytes, version: int, layer: int) -> int:
    """How many bits after a frame's checksum it guards, besides the end of the header."""
    mode, extension = frame[3] >> 6, frame[3] >> 4 & 3
    channels = 1 if mode == 3 else 2
    if layer == 3:
        return 8 * ((SIDE if channels == 1 else 32) if version == 3 else (9 if channels == 1 else 17))
    if layer == 1:
        bound = 4 * (extension + 1) if mode == 1 else 32
        return 4 * (channels * bound + 32 - bound)
    if version == 3:
        kbit, hertz = RATES_V1[2][(frame[2] >> 4) - 1] // channels, HERTZ[3][frame[2] >> 2 & 3]
        widths = LAYER_II[("d" if hertz == 32000 else "c") if kbit <= 48 else "a" if hertz == 48000 or kbit <= 80 else "b"]
    else:
        widths = LAYER_II["lsf"]
    bound = min(4 * (extension + 1), len(widths)) if mode == 1 else len(widths)
    word, at, used = int.from_bytes(frame[6:102].ljust(96, b"\0"), "big"), 0, 0
    for subband, width in enumerate(widths):
        for _ in range(channels if subband < bound else 1):
            some = word >> 768 - at - width & (1 << width) - 1
            at += width
            used += 2 * (some > 0) * (1 if subband < bound else channels)
    return at + used


def _head(kbit: int) -> bytes:
    """An MPEG-1 Layer III header with CRC, 32 kHz, mono."""
    return bytes((0xFF, 0xFA, RATES_V1[3].index(kbit) + 1 << 4 | 2 << 2, 0xC0))


@cache
def _frames() -> tuple[tuple[int, bytes], ...]:
    """(octets of main data, everything before them) for each bit rate."""
    out = []
    for kbit in RATES_V1[3]:
        head, side = _head(kbit), bytes(SIDE)
        out.append((header(head)[2] - 6 - SIDE, head + crc16(head[2:] + side).to_bytes(2, "big") + side))
    return tuple(out)


def _syncsafe(n: int) -> bytes:
    return bytes(n >> s & 0x7F for s in (21, 14, 7, 0))


def write(payload: bytes) -> bytes:
    """The payload as an MPEG audio stream."""
    note = b"\x03PAYLOAD\x00" + str(len(payload)).encode()
    body = b"TXXX" + _syncsafe(len(note)) + b"\x00\x00" + note
    tag = b"ID3\x04\x00\x00" + _syncsafe(len(body)) + body
    sizes, (most, start) = _frames(), _frames()[-1]
    whole = max(0, len(payload) // most)
    parts = [start + payload[i * most : (i + 1) * most] for i in range(whole)]
    if rest := payload[whole * most :]:
        room, begin = next(x for x in sizes if x[0] >= len(rest))
        parts.append(begin + rest.ljust(room, b"\x00"))
    ends, at = [], 0
    for p in parts:
        ends.append(at)
        at += len(p)
    head = _head(64)
    table_size = header(head)[2]
    total = at + table_size
    seek = bytes(min(255, (ends[k * len(parts) // 100] + table_size) * 256 // total) for k in range(100)) if parts else bytes(100)
    table = b"Xing" + (7).to_bytes(4, "big") + len(parts).to_bytes(4, "big") + total.to_bytes(4, "big") + seek
    first = (head + crc16(head[2:] + bytes(SIDE)).to_bytes(2, "big") + bytes(SIDE) + table).ljust(table_size, b"\x00")
    return b"".join((tag, first, *parts))


def _kin(word: bytes) -> tuple[int, int, int] | None:
    """What the headers of a stream agree in: version, layer and rate."""
    h = header(word)
    return h and (h[0], h[1], h[4])


def _agree(data: bytes, at: int, end: int, note: int, headers: int = 4) -> bool:
    """Whether so many headers in a row agree, or all up to the end."""
    kin = _kin(data[at : at + 4])
    for _ in range(headers):
        h = header(data[at : at + 4])
        if not h or (h[0], h[1], h[4]) != kin:
            return False
        at += h[2]
        if at in (end, note):
            return True
    return at < end


def _tags(data: bytes) -> tuple[int, dict[str, str]]:
    """The end of the leading ID3v2 tags, and their user-defined texts."""
    at, texts = 0, {}
    while data[at : at + 3] == b"ID3" and len(data) >= at + 10:
        size = int.from_bytes(bytes(4), "big")
        for octet in data[at + 6 : at + 10]:
            size = size << 7 | octet & 0x7F
        end, pos, version = min(len(data), at + 10 + size), at + 10, data[at + 3]
        while pos + 10 <= end and data[pos]:
            n = 0
            for octet in data[pos + 4 : pos + 8]:
                n = n << 7 | octet if version >= 4 else n << 8 | octet
            if data[pos : pos + 4] == b"TXXX" and pos + 10 + n <= end and data[pos + 10] == 3:
                name, _, value = data[pos + 11 : pos + 10 + n].partition(b"\x00")
                texts[name.decode("utf-8", "replace")] = value.decode("utf-8", "replace")
            pos += 10 + n
        at = end + (10 if data[at + 5] & 0x10 else 0)
    return at, texts


def read(data: bytes) -> dict:
    """What a stream holds: payload, frame offsets, duration (Fraction of seconds), frames with a failing checksum, octets skipped, table."""
    at, texts = _tags(data)
    offsets: list[int] = []
    bad = skipped = 0
    duration, table, main, hertz, samples = Fraction(0), None, [], 0, 0
    end, note, synced, kin = len(data), len(data) - 128 if data[-128:-125] == b"TAG" else -1, False, None
    while at + 4 <= end:
        if at == note:  # an ID3v1 tag, as frames end where it begins; elsewhere these octets are payload
            end = at
            break
        h = header(data[at : at + 4])
        nxt = at + h[2] if h else 0
        own = h and (h[0], h[1], h[4])
        if not h or nxt > end or not (synced and own == kin) and not _agree(data, at, end, note):
            synced = False
            sync = data.find(b"\xff", at + 1, end)
            to = sync if sync >= 0 else end
            skipped += to - at
            at = to
            continue
        synced, kin = True, own
        version, layer, size, n, hz, has_crc = h
        mono = data[at + 3] >> 6 == 3
        side = (SIDE if mono else 32) if version == 3 else (9 if mono else 17)
        begin = at + 4 + 2 * has_crc
        if has_crc:
            guarded = guarded_bits(data[at:nxt], version, layer)
            bad += crc16_bits(data[at + 2 : at + 4] + data[begin : begin + -(-guarded // 8)], 16 + guarded) != int.from_bytes(data[at + 4 : at + 6], "big") if begin + guarded / 8 <= nxt else 1
        body = begin + (side if layer == 3 else 0)
        if not offsets and table is None and data[body : body + 4] in (b"Xing", b"Info"):
            flags, pos = int.from_bytes(data[body + 4 : body + 8], "big"), body + 8
            table = {}
            for bit, name in ((1, "frames"), (2, "bytes")):
                if flags & bit:
                    table[name] = int.from_bytes(data[pos : pos + 4], "big")
                    pos += 4
            if flags & 4:
                table["seek"] = data[pos : pos + 100]
        elif not offsets and table is None and layer == 3 and data[at + 36 : at + 40] == b"VBRI":  # at a fixed place, whatever the side information's size
            entries, scale, width = (int.from_bytes(data[at + 36 + k : at + 38 + k], "big") for k in (18, 20, 22))
            table = {"bytes": int.from_bytes(data[at + 46 : at + 50], "big"), "frames": int.from_bytes(data[at + 50 : at + 54], "big"), "scale": scale, "width": width, "seek": data[at + 62 : at + 62 + entries * width]}
        else:
            offsets.append(at)
            main.append(data[body:nxt])
            if hz != hertz and hertz:
                duration += Fraction(samples, hertz)
                samples = 0
            hertz = hz
            samples += n
        at = nxt
    if hertz:
        duration += Fraction(samples, hertz)
    payload = b"".join(main)
    if re.fullmatch("[0-9]{1,18}", texts.get("PAYLOAD", "")):
        payload = payload[: int(texts["PAYLOAD"])]
    return {"payload": payload, "offsets": offsets, "duration": duration, "bad": bad, "skipped": skipped + max(0, end - at), "table": table}


def padded(text: bytes) -> bytes:
    return text.ljust(max(64, -(-len(text) // 64) * 64), b"\x00")


def feature(found: dict) -> str:
    """Frames, exact duration in seconds, failing checksums, octets skipped, the table's frames, and a digest of all seek offsets."""
    table = found["table"] or {}
    seeks = hashlib.sha256(",".join(map(str, found["offsets"])).encode()).hexdigest()[:16]
    return f"frames={len(found['offsets'])};seconds={found['duration']};bad={found['bad']};skipped={found['skipped']};table={table.get('frames', '-')};seek={seeks}"


def stored(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media (the stream) for every row of docs."""

    def of(batches):
        for batch in slices(batches, 1):
            texts = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, texts), pa.int64()), pa.array([write(padded(t)) for t in texts], pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8("text").alias("text")).mapInArrow(of, "doc_id long, n_bytes long, media binary")


def probe(media: DataFrame) -> DataFrame:
    """The features of streams in column media: frame offsets, duration, checks and digests; doc_id and n_bytes pass through."""

    def of(batches):
        for batch in slices(batches, 2):
            rows = []
            for data in batch.column(2).to_pylist():
                data = data or b""
                x = read(data)
                p = x["payload"]
                rows.append((len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(data), hashlib.sha256(data).hexdigest(), float(x["duration"]), x["offsets"], feature(x)))
            cols = list(zip(*rows, strict=True)) or [()] * 8
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.list_(pa.int64()), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "seconds", "offsets", "feature"])

    kinds = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, seconds double, offsets array<long>, feature string"
    return media.select("doc_id", "n_bytes", "media").mapInArrow(of, kinds)
