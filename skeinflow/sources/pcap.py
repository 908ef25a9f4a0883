"""Packet captures as a Spark data source.

``spark.dataSource.register(PcapSource)`` and then
``spark.read.format("pcap").load("/captures/*/*.pcap")``. One input partition per file; the
label is the file's folder. Both classic captures (either byte order, micro- and nanoseconds) and the
blocks of the next-generation format are read; IPv4 packets only, payload included, in one pass.
"""

from __future__ import annotations

import glob
import os
import struct
import uuid
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from skeinflow.schemas import ICMP, OTHER, PACKETS, TCP, UDP

#: Magic numbers and link types of the formats.
CLASSIC = {b"\xd4\xc3\xb2\xa1": ("<", 1e6), b"\xa1\xb2\xc3\xd4": (">", 1e6), b"\x4d\x3c\xb2\xa1": ("<", 1e9), b"\xa1\xb2\x3c\x4d": (">", 1e9)}
NEXT_GENERATION = b"\x0a\x0d\x0d\x0a"
ETHERNET, RAW, RAW_OLD, COOKED = 1, 101, 12, 113
VLAN = (0x8100, 0x88A8)


def network_layer(frame: bytes, link: int) -> bytes | None:
    """The IPv4 datagram of a frame, or None."""
    if link in (RAW, RAW_OLD):
        body = frame
    elif link == COOKED:
        body = frame[16:] if frame[14:16] == b"\x08\x00" else b""
    elif link == ETHERNET:
        at = 12
        while len(frame) >= at + 2 and int.from_bytes(frame[at : at + 2], "big") in VLAN:
            at += 4
        body = frame[at + 2 :] if frame[at : at + 2] == b"\x08\x00" else b""
    else:
        return None
    return body if len(body) >= 20 and body[0] >> 4 == 4 else None


def packet(ip: bytes, ts: float, seq: int, label: str, limit: int) -> tuple:
    """One row of the packet table; ports are -1 where the protocol has none."""
    head, total = (ip[0] & 15) * 4, int.from_bytes(ip[2:4], "big")
    rest = ip[head : total if total >= head else None]
    kind = {6: TCP, 17: UDP, 1: ICMP}.get(ip[9], OTHER)
    sport = dport = -1
    flags, payload = 0, rest
    if kind == TCP and len(rest) >= 20:
        sport, dport = struct.unpack(">HH", rest[:4])
        flags, payload = rest[13], rest[(rest[12] >> 4) * 4 :]
    elif kind == UDP and len(rest) >= 8:
        sport, dport = struct.unpack(">HH", rest[:4])
        payload = rest[8:]
    elif kind == ICMP:
        payload = rest[8:] if len(rest) >= 8 else b""
    src, dst = (".".join(map(str, ip[a : a + 4])) for a in (12, 16))
    return seq, ts, src, dst, sport, dport, kind, flags, total, len(payload), label, payload[:limit]


def _classic(data: bytes, order: str, unit: float) -> Iterator[tuple[float, int, bytes]]:
    link, at = struct.unpack_from(order + "I", data, 20)[0] & 0xFFFF, 24
    while at + 16 <= len(data):
        sec, part, kept, _ = struct.unpack_from(order + "IIII", data, at)
        frame = data[at + 16 : at + 16 + kept]
        if len(frame) < kept:  # cut off file: the last packet is dropped
            return
        yield sec + part / unit, link, frame
        at += 16 + kept


def _blocks(data: bytes) -> Iterator[tuple[float, int, bytes]]:
    at, order, links = 0, "<", []
    while at + 12 <= len(data):
        if data[at : at + 4] == NEXT_GENERATION:
            order = "<" if data[at + 8 : at + 12] == b"\x4d\x3c\x2b\x1a" else ">"
            links = []
        kind, size = struct.unpack_from(order + "II", data, at)
        if size < 12 or at + size > len(data):
            return
        body = data[at + 8 : at + size - 4]
        if kind == 1:
            unit, o = 1e6, 8
            while o + 4 <= len(body):
                code, n = struct.unpack_from(order + "HH", body, o)
                if code == 0:
                    break
                if code == 9 and n:
                    r = body[o + 4]
                    unit = 2.0 ** (r & 127) if r & 128 else 10.0**r
                o += 4 + (n + 3) // 4 * 4
            links.append((struct.unpack_from(order + "H", body)[0], unit))
        elif kind == 6 and len(body) >= 20:
            i, high, low, kept, _ = struct.unpack_from(order + "IIIII", body)
            if i < len(links):
                yield ((high << 32) | low) / links[i][1], links[i][0], body[20 : 20 + kept]
        at += size


def read_capture(data: bytes, label: str, first_seq: int = 0, limit: int = 65535, most: int | None = None) -> Iterator[tuple]:
    """Rows of one capture in order; not a capture: no rows."""
    if data[:4] in CLASSIC and len(data) >= 24:
        frames = _classic(data, *CLASSIC[data[:4]])
    elif data[:4] == NEXT_GENERATION:
        frames = _blocks(data)
    else:
        return
    n = 0
    for ts, link, frame in frames:
        if most is not None and n >= most:
            return
        ip = network_layer(frame, link)
        if ip is not None:
            yield packet(ip, ts, first_seq + n, label, limit)
            n += 1


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options.get("path", "")
        self.limit = int(options.get("payloadbytes", "65535"))
        self.most = int(options["maxpackets"]) if "maxpackets" in options else None

    def partitions(self) -> list[InputPartition]:
        found = sorted(f for f in glob.glob(self.path, recursive=True) if os.path.isfile(f)) if not os.path.isdir(self.path) else sorted(
            os.path.join(base, f) for base, _, files in os.walk(self.path) for f in files if f.endswith((".pcap", ".pcapng"))
        )
        return [InputPartition((i, f)) for i, f in enumerate(found)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition is None or partition.value is None:
            return
        index, path = partition.value
        with open(path, "rb") as f:
            data = f.read()
        yield from read_capture(data, os.path.basename(os.path.dirname(path)), index << 40, self.limit, self.most)


def frame(row) -> bytes | None:
    """The IPv4 datagram of a row of the packet table; a missing payload is zeros. None if a field does not fit the format."""
    body = bytes(row["payload"]) if row["payload"] is not None else bytes(max(0, row["payload_len"] or 0))
    ports = (row["src_port"], row["dst_port"])
    if row["proto"] in (TCP, UDP) and not all(p is not None and 0 <= p < 65536 for p in ports):
        return None
    if row["proto"] == TCP:
        number, head = 6, struct.pack(">HHIIBBHHH", *ports, 0, 0, 0x50, (row["flags"] or 0) & 0xFF, 0, 0, 0)
    elif row["proto"] == UDP:
        number, head = 17, struct.pack(">HHHH", *ports, (8 + len(body)) & 0xFFFF, 0)
    elif row["proto"] == ICMP:
        number, head = 1, struct.pack(">BBHHH", 8, 0, 0, 0, 0)
    else:
        return None
    total = 20 + len(head) + len(body)
    ends = [bytes(map(int, row[c].split("."))) for c in ("src_ip", "dst_ip")]
    return struct.pack(">BBHHHBBH4s4s", 0x45, 0, total, 0, 0, 64, number, 0, *ends) + head + body if total < 65536 else None


class _Writer(DataSourceWriter):
    """Each task writes one classic capture per label, in folders named after the labels; rows that fit no datagram are refused."""

    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        name, files = f"part-{uuid.uuid4().hex}.pcap", {}
        try:
            for row in iterator:
                body = frame(row)
                if body is None:
                    raise ValueError(f"no datagram holds packet {row['seq']}: filter ports, protocols and sizes first")
                label = row["label"] or "unknown"
                if label not in files:
                    os.makedirs(os.path.join(self.path, label), exist_ok=True)
                    files[label] = open(os.path.join(self.path, label, name), "wb")  # noqa: SIM115
                    files[label].write(struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, RAW))
                micros = round(row["ts"] * 1e6)
                files[label].write(struct.pack("<IIII", micros // 1_000_000, micros % 1_000_000, len(body), len(body)) + body)
        finally:
            for f in files.values():
                f.close()
        return WriterCommitMessage()


class PcapSource(DataSource):
    """Reading: path (file, folder or glob), payloadBytes, maxPackets per file. Writing (append): path of a folder all executors share."""

    @classmethod
    def name(cls) -> str:
        return "pcap"

    def schema(self) -> StructType:
        return PACKETS

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"])
