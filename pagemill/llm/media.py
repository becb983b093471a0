"""Media columns: MPEG transport streams, written, and read back packet by packet."""

from __future__ import annotations

import hashlib
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import Stash, map_batches
from .words import flat

PACKET, BODY = 188, 184
PAT_PID, PMT_PID, ES_PID = 0, 0x100, 0x101
PROGRAM, STREAM_TYPE, STREAM_ID = 1, 0x06, 0xBD  # private data in PES packets
UNIT = 16384  # payload bytes of an access unit
TICKS = 3600  # of the 90 kHz clock, from one unit to the next
GROUP = 8  # units from one random-access point to the next

UNITS = "array<struct<pts: long, random_access: boolean, offset: long, size: long>>"


@lru_cache(1)
def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = (c << 1 ^ (0x04C11DB7 if c & 0x80000000 else 0)) & 0xFFFFFFFF
        out.append(c)
    return out


def crc_mpeg(data: bytes) -> int:
    c, t = 0xFFFFFFFF, _crc_table()
    for b in data:
        c = (c << 8 & 0xFFFFFFFF) ^ t[c >> 24 ^ b]
    return c


def _section(table: int, number: int, body: bytes) -> bytes:
    head = bytes([table, 0xB0 | (len(body) + 9) >> 8, (len(body) + 9) & 255, number >> 8, number & 255, 0xC1, 0, 0])
    return head + body + crc_mpeg(head + body).to_bytes(4, "big")


@lru_cache(1)
def _tables() -> tuple[bytes, bytes]:
    """Bodies of the packets that hold the program association and the program map."""
    pat = _section(0, 1, bytes([PROGRAM >> 8, PROGRAM & 255, 0xE0 | PMT_PID >> 8, PMT_PID & 255]))
    pmt = _section(2, PROGRAM, bytes([0xE0 | ES_PID >> 8, ES_PID & 255, 0xF0, 0, STREAM_TYPE, 0xE0 | ES_PID >> 8, ES_PID & 255, 0xF0, 0]))
    return tuple((b"\0" + x).ljust(BODY, b"\xff") for x in (pat, pmt))


def _stamp(pts: int) -> bytes:
    return bytes([0x21 | (pts >> 29 & 0x0E), pts >> 22 & 255, 0x01 | (pts >> 14 & 0xFE), pts >> 7 & 255, 0x01 | (pts << 1 & 0xFE)])


def mux(payload: bytes) -> bytes:
    """A stream of one program whose one elementary stream carries the payload, UNIT bytes to a PES
    packet. Each GROUP-th unit is a random-access point, with a clock reference, and follows the tables."""
    out, counts = [], {PAT_PID: 0, PMT_PID: 0, ES_PID: 0}

    def packet(pid: int, first: bool, field: bytes, body: bytes) -> None:
        head = bytes([0x47, 0x40 * first | pid >> 8, pid & 255, (0x30 if field else 0x10) | counts[pid] & 15])
        counts[pid] += 1
        out.append(head + field + body)

    for u in range(max(1, -(-len(payload) // UNIT))):
        data, pts = payload[u * UNIT : (u + 1) * UNIT], u * TICKS & 0x1FFFFFFFF
        pes = b"\0\0\1" + bytes([STREAM_ID]) + (len(data) + 8).to_bytes(2, "big") + b"\x84\x80\5" + _stamp(pts) + data
        point, at = u % GROUP == 0, 0
        if point:
            for pid, body in zip((PAT_PID, PMT_PID), _tables()):
                packet(pid, True, b"", body)
        while at < len(pes):
            # flags, then 33 bits of clock, 6 spare and 9 of extension
            flags = (b"\x50" + (pts << 15 | 0x7E00).to_bytes(6, "big")) if point and not at else b""
            room = BODY - (len(flags) + 1 if flags else 0)
            body = pes[at : at + room]
            field = bytes([len(flags)]) + flags if flags else b""
            if len(body) < room:  # the field also pads the last packet
                pad = BODY - len(body) - 1
                flags = flags or (b"\0" if pad else b"")
                field = bytes([pad]) + flags + b"\xff" * (pad - len(flags))
            packet(ES_PID, not at, field, body)
            at += len(body)
    return b"".join(out)


def _sections(packets: np.ndarray) -> tuple[list[bytes], int]:
    """Table sections of one PID's packets, joined from each unit start on and cut by their lengths, one of
    each; and how many are incomplete or fail their checksum."""
    out, bad, part, last = [], 0, b"", None

    def cut(part: bytes) -> bytes:
        nonlocal bad
        while len(part) >= 3 and part[0] != 0xFF:
            size = 3 + (int.from_bytes(part[1:3], "big") & 0xFFF)
            if len(part) < size:
                break
            section, part = part[:size], part[size:]
            if not section[1] & 0x80 or section in out:  # without the long form there is no checksum
                continue
            if size >= 12 and crc_mpeg(section) == 0:
                out.append(section)
            else:
                bad += 1
        return part if part[:1] != b"\xff" else b""

    for p in packets[packets[:, 3] & 0x10 > 0]:
        if last is not None and (p == last).all():
            continue  # a duplicate
        if part and (int(p[3]) - int(last[3])) & 15 != 1:
            bad, part = bad + 1, b""
        last = p
        body = p[4 + (int(p[4]) + 1 if p[3] & 0x20 else 0) :].tobytes()
        if p[1] & 0x40 and body:
            if part:
                bad += len(cut(part + body[1 : 1 + body[0]])) > 0
            part = cut(body[1 + body[0] :])
        elif part:
            part = cut(part + body)
    return out, bad + (len(part) > 0)


def demux(media: bytes | None) -> dict:
    """What a transport stream holds: program tables, elementary streams, the access units with their
    timestamps and random-access points, and the payload, in order of the packets.

    A packet without its sync byte or with the error flag, and bytes after the last whole packet, count
    as errors and are passed over; so do table sections that are incomplete or fail their checksum. A packet whose counter does not follow its stream's last counts as a continuity
    error; one that repeats it is a duplicate and is dropped. Null or empty: nothing found."""
    raw = np.frombuffer(media or b"", np.uint8)
    packets = raw[: len(raw) // PACKET * PACKET].reshape(-1, PACKET)
    good = (packets[:, 0] == 0x47) & (packets[:, 1] & 0x80 == 0)
    errors, packets = int((~good).sum()) + (len(raw) % PACKET > 0), packets[good]
    pid = (packets[:, 1] & 0x1F).astype(np.int64) << 8 | packets[:, 2]
    programs, streams, units, parts, broken, offset = [], [], [], [], 0, 0
    sections, bad = _sections(packets[pid == PAT_PID])
    errors += bad
    for s in sections:
        if s[0] == 0:
            pairs = [(s[i] << 8 | s[i + 1], (s[i + 2] & 0x1F) << 8 | s[i + 3]) for i in range(8, len(s) - 4, 4)]
            programs += [p for p in pairs if p[0] and p not in programs]
    for pmt in dict.fromkeys(p for _, p in programs):
        sections, bad = _sections(packets[pid == pmt])
        errors += bad
        for s in sections:
            i = 12 + ((s[10] & 0x0F) << 8 | s[11])
            while s[0] == 2 and i + 5 <= len(s) - 4:
                found = ((s[i + 1] & 0x1F) << 8 | s[i + 2], s[i])
                streams += [found] * (found not in streams)
                i += 5 + ((s[i + 3] & 0x0F) << 8 | s[i + 4])
    for es, _ in streams:
        mine = packets[pid == es]
        mine = mine[mine[:, 3] & 0x10 > 0]
        count = (mine[:, 3] & 0x0F).astype(np.int64)
        step = (count[1:] - count[:-1]) & 15
        broken += int((step > 1).sum())
        mine = mine[np.append(True, step != 0)] if len(mine) else mine
        field = np.where(mine[:, 3] & 0x20 > 0, mine[:, 4].astype(np.int64) + 1, 0)
        access = (field > 1) & (mine[:, 5] & 0x40 > 0)
        inside = np.arange(PACKET) >= 4 + field[:, None]
        body, size = mine[inside], inside.sum(axis=1)
        ends = np.cumsum(size)
        heads = np.flatnonzero(mine[:, 1] & 0x40)
        for k, h in enumerate(heads):
            a, b = ends[h] - size[h], ends[heads[k + 1] - 1] if k + 1 < len(heads) else len(body)
            pes = body[a:b]
            if len(pes) < 9 or bytes(pes[:3]) != b"\0\0\1":
                errors += 1
                continue
            length, head = int(pes[4]) << 8 | int(pes[5]), 9 + int(pes[8])
            t = [int(x) for x in pes[9:14]]
            pts = (t[0] >> 1 & 7) << 30 | t[1] << 22 | t[2] >> 1 << 15 | t[3] << 7 | t[4] >> 1 if pes[7] & 0x80 and len(t) == 5 else None
            data = pes[head : 6 + length] if length else pes[head:]
            units.append({"pts": pts, "random_access": bool(access[h]), "offset": offset, "size": len(data)})
            parts.append(data.tobytes())
            offset += len(data)
    return {
        "programs": [{"number": n, "pmt_pid": p} for n, p in programs], "streams": [{"pid": p, "type": t} for p, t in streams],
        "packets": len(packets), "continuity_errors": broken, "errors": errors, "units": units, "payload": b"".join(parts),
    }


def store_media(docs: DataFrame, column: str = "text") -> DataFrame:
    """Adds media, a transport stream of each value's UTF-8 bytes (or bytes), with zeros appended up to a positive
    multiple of 64, and n_bytes, their number before. Null: as empty, so 64 zeros. Equal values give
    equal streams. No rows give no rows. All columns of docs stay; one named media or n_bytes is replaced. A worker
    holds the values of an Arrow batch and their streams, which are a few hundredths larger."""

    def run(batches):
        for batch in batches:
            data, at = flat(batch.column(batch.schema.get_field_index(column)))
            raw = data.tobytes()
            texts = [raw[a:b] for a, b in zip(at[:-1], at[1:])]
            media = [mux(t.ljust(max(64, -(-len(t) // 64) * 64), b"\0")) for t in texts]
            cols = {"media": pa.array(media, pa.binary()), "n_bytes": pa.array(np.diff(at), pa.int64())}
            yield pa.RecordBatch.from_arrays([cols.get(n, batch.column(i)) for i, n in enumerate(batch.schema.names)], names=batch.schema.names)

    return map_batches(docs, run, {"media": F.lit(b"").cast("binary"), "n_bytes": F.lit(0).cast("long")}, column)


def write_media(docs: DataFrame, column: str = "text") -> DataFrame:
    """``store_media`` without the value itself, written to the shared folder and read from there."""
    stored = store_media(docs, column).drop(column)
    return Stash(docs.sparkSession, "media").keep(stored, "media", compression="zstd")


def read_media(stored: DataFrame) -> DataFrame:
    """Adds what demux finds in each stored stream (column media, null as empty): checksums of the payload
    and of the stream, packet and error counts, program and stream numbers, and the timestamps and
    random-access points of the units. Columns with those names are replaced."""
    fields = dict.fromkeys(("payload_bytes", "tail_crc32", "media_bytes", "packets", "continuity_errors", "errors"), "long")
    fields |= {"payload_sha256": "string", "media_sha256": "string", "programs": "array<int>", "streams": "array<int>", "units": UNITS}

    def run(batches):
        for batch in batches:
            rows = []
            for m in batch.column("media"):
                media = m.as_py() or b""
                x = demux(media)
                load = x["payload"]
                rows.append({
                    "payload_bytes": len(load), "payload_sha256": hashlib.sha256(load).hexdigest(), "tail_crc32": zlib.crc32(load[-64:]), "media_bytes": len(media), "media_sha256": hashlib.sha256(media).hexdigest(),
                    "packets": x["packets"], "continuity_errors": x["continuity_errors"], "errors": x["errors"], "programs": [p["pmt_pid"] for p in x["programs"]], "streams": [s["pid"] for s in x["streams"]], "units": x["units"],
                })
            cols = {n: pa.array([r[n] for r in rows], batch.schema.field(n).type) for n in fields}
            yield pa.RecordBatch.from_arrays([cols.get(n, batch.column(i)) for i, n in enumerate(batch.schema.names)], names=batch.schema.names)

    return map_batches(stored, run, {n: F.lit(None).cast(t) for n, t in fields.items()}, "media")
