"""Captures: pcap files to frames, and frames to packets.

Files are read by Spark's own reader, so any store that Spark reads will do; a file is one row, its frames many.
"""

from __future__ import annotations

import ipaddress
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from netlume.operators.windows import key_changes

FRAMES = "path string, frame_no bigint, ts_us bigint, link_type int, frame_len int, raw binary"
PACKETS = (
    "ts_us bigint, src string, dst string, ip_version int, protocol int, src_port int, dst_port int, tcp_flags int, tcp_seq bigint, tcp_window int, "
    "icmp_type int, icmp_code int, payload binary, frame_len int, vlan_id int, is_fragment boolean, ip_id bigint, frag_offset int, more_fragments boolean, tunnels int"
)
# Link types, ether types, protocol numbers, tunnel port, and limits.
ETHERNET, RAW_IP, NULL_LOOP, LOOP, LINUX_SLL, LINUX_SLL2 = 1, 101, 0, 108, 113, 276
IPV4, IPV6, VLAN_TYPES, BRIDGED = 0x0800, 0x86DD, (0x8100, 0x88A8, 0x9100), 0x6558
ICMP, IPIP, TCP, UDP, IP6IN4, GRE, ICMPV6 = 1, 4, 6, 17, 41, 47, 58
VXLAN_PORT, PAYLOAD_CAP, MOST_TUNNELS, MOST_TAGS = 4789, 9216, 4, 3
EXTENSIONS = (0, 43, 60, 51, 44)


def frames_of(data: bytes) -> Iterator[tuple[int, int, int, bytes]]:
    """(microseconds, link type, length on the wire, bytes) of a classic pcap file; a cut last frame is left out."""
    if len(data) < 24:
        return
    magic = data[:4]
    order = {b"\xd4\xc3\xb2\xa1": "<", b"\xa1\xb2\xc3\xd4": ">", b"\x4d\x3c\xb2\xa1": "<", b"\xa1\xb2\x3c\x4d": ">"}.get(magic)
    if order is None:
        return
    fine = magic in (b"\x4d\x3c\xb2\xa1", b"\xa1\xb2\x3c\x4d")
    link = struct.unpack(order + "I", data[20:24])[0] & 0xFFFF
    at = 24
    while at + 16 <= len(data):
        sec, part, kept, wire = struct.unpack(order + "4I", data[at : at + 16])
        if at + 16 + kept > len(data):
            return
        yield sec * 1_000_000 + (part // 1000 if fine else part), link, wire, data[at + 16 : at + 16 + kept]
        at += 16 + kept


def read_pcap(spark: SparkSession, path: str) -> DataFrame:
    """Frames of all captures under a path, numbered by file."""
    return frames_in(spark.read.format("binaryFile").option("pathGlobFilter", "*.pcap").option("recursiveFileLookup", "true").load(path))


def frames_in(files: DataFrame) -> DataFrame:
    """Frames of capture files (path, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path_, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                held: list[tuple] = []
                for n, (ts, link, wire, raw) in enumerate(frames_of(data.as_py())):
                    held.append((path_, n, ts, link, wire, raw))
                    if len(held) == 4096:
                        yield _batch(held, FRAMES)
                        held = []
                if held:
                    yield _batch(held, FRAMES)

    return files.select("path", "content").mapInArrow(run, FRAMES)


_ARROW = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, _ARROW[f[1]]) for c, f in zip(zip(*rows, strict=True), fields, strict=True)], [f[0] for f in fields])


@dataclass
class Packet:
    src: str
    dst: str
    ip_version: int
    protocol: int
    src_port: int = 0
    dst_port: int = 0
    tcp_flags: int = 0
    tcp_seq: int = 0
    tcp_window: int = 0
    icmp_type: int | None = None
    icmp_code: int | None = None
    payload: bytes = b""
    vlan_id: int | None = None
    is_fragment: bool = False
    ip_id: int = 0
    frag_offset: int = 0
    more_fragments: bool = False
    tunnels: int = 0
    #: What follows the IP header; for fragments and tunnels.
    body: bytes = b""


def network_layer(link: int, raw: bytes) -> tuple[int, int, int | None] | None:
    """(ether type, offset, outermost VLAN id) of what the link layer carries."""
    if link == ETHERNET:
        return ethernet(raw)
    if link == RAW_IP and raw:
        return {4: (IPV4, 0, None), 6: (IPV6, 0, None)}.get(raw[0] >> 4)
    if link in (NULL_LOOP, LOOP) and len(raw) >= 4:
        family = struct.unpack("<I" if link == NULL_LOOP and raw[0] else ">I", raw[:4])[0]
        return (IPV4, 4, None) if family == 2 else (IPV6, 4, None) if family in (10, 24, 28, 30) else None
    if link == LINUX_SLL and len(raw) >= 16:
        return int.from_bytes(raw[14:16], "big"), 16, None
    if link == LINUX_SLL2 and len(raw) >= 20:
        return int.from_bytes(raw[0:2], "big"), 20, None
    return None


def ethernet(raw: bytes) -> tuple[int, int, int | None] | None:
    if len(raw) < 14:
        return None
    kind, at, vlan = int.from_bytes(raw[12:14], "big"), 14, None
    for _ in range(MOST_TAGS):
        if kind not in VLAN_TYPES:
            break
        if len(raw) < at + 4:
            return None
        tag = int.from_bytes(raw[at : at + 2], "big") & 0x0FFF
        vlan = tag if vlan is None else vlan
        kind, at = int.from_bytes(raw[at + 2 : at + 4], "big"), at + 4
    return kind, at, vlan


def ip_layer(kind: int, data: bytes) -> Packet | None:
    if kind == IPV4 and len(data) >= 20 and data[0] >> 4 == 4:
        size = (data[0] & 15) * 4
        if size < 20 or len(data) < size:
            return None
        total = int.from_bytes(data[2:4], "big")
        end = min(len(data), total) if total >= size else len(data)
        part = int.from_bytes(data[6:8], "big")
        p = Packet(str(ipaddress.IPv4Address(data[12:16])), str(ipaddress.IPv4Address(data[16:20])), 4, data[9])
        p.ip_id, p.frag_offset, p.more_fragments = int.from_bytes(data[4:6], "big"), (part & 0x1FFF) * 8, bool(part & 0x2000)
        p.body = data[size:end]
    elif kind == IPV6 and len(data) >= 40 and data[0] >> 4 == 6:
        end = min(len(data), 40 + int.from_bytes(data[4:6], "big")) if data[4:6] != b"\0\0" else len(data)
        p = Packet(str(ipaddress.IPv6Address(data[8:24])), str(ipaddress.IPv6Address(data[24:40])), 6, data[6])
        at = 40
        for _ in range(8):
            if p.protocol not in EXTENSIONS or at + 8 > end:
                break
            here = p.protocol
            p.protocol = data[at]
            if here == 44:
                part = int.from_bytes(data[at + 2 : at + 4], "big")
                p.frag_offset, p.more_fragments, p.ip_id = part & 0xFFF8, bool(part & 1), int.from_bytes(data[at + 4 : at + 8], "big")
                at += 8
            else:
                at += (data[at + 1] + 2) * 4 if here == 51 else (data[at + 1] + 1) * 8
        p.body = data[at:end]
    else:
        return None
    p.is_fragment = p.more_fragments or p.frag_offset > 0
    return p


def transport(p: Packet, cap: int = PAYLOAD_CAP) -> Packet:
    """Fills in ports, flags and payload; fragments show none of the first two, and their payload is whole for reassembly."""
    b = p.body
    if p.is_fragment:
        p.payload = b
    elif p.protocol == TCP and len(b) >= 20:
        p.src_port, p.dst_port, p.tcp_seq = struct.unpack(">HHI", b[:8])
        p.tcp_flags, p.tcp_window = b[13], int.from_bytes(b[14:16], "big")
        p.payload = b[max((b[12] >> 4) * 4, 20) :][:cap]
    elif p.protocol == UDP and len(b) >= 8:
        p.src_port, p.dst_port = struct.unpack(">HH", b[:4])
        p.payload = b[8:][:cap]
    elif p.protocol in (ICMP, ICMPV6) and len(b) >= 4:
        p.icmp_type, p.icmp_code, p.payload = b[0], b[1], b[8:][:cap]
    else:
        p.payload = b[:cap]
    return p


def inner(p: Packet) -> tuple[int, bytes] | None:
    """What a tunnel packet carries: (ether type, bytes)."""
    b = p.body
    if p.is_fragment:
        return None
    if p.protocol == IPIP:
        return IPV4, b
    if p.protocol == IP6IN4:
        return IPV6, b
    if p.protocol == GRE and len(b) >= 4:
        flags, kind = struct.unpack(">HH", b[:4])
        at = 4 + 4 * bool(flags & 0xC000) + 4 * bool(flags & 0x2000) + 4 * bool(flags & 0x1000)
        if kind in (IPV4, IPV6):
            return kind, b[at:]
        if kind == BRIDGED and (e := ethernet(b[at:])):
            return e[0], b[at + e[1] :]
    if p.protocol == UDP and len(b) >= 16 and int.from_bytes(b[2:4], "big") == VXLAN_PORT and b[8] & 8 and (e := ethernet(b[16:])):
        return e[0], b[16 + e[1] :]
    return None


def decode(link: int, raw: bytes) -> Packet | None:
    """The innermost packet of a frame, or None."""
    found = network_layer(link, raw)
    if found is None:
        return None
    kind, at, vlan = found
    p = ip_layer(kind, raw[at:])
    depth = 0
    while p is not None and depth < MOST_TUNNELS and (below := inner(p)) and (q := ip_layer(*below)):
        p, depth = q, depth + 1
    if p is None:
        return None
    p.vlan_id, p.tunnels = vlan, depth
    return transport(p)


def decode_frames(frames: DataFrame, keep: list[str] = ()) -> DataFrame:
    """Packets of frames (ts_us, link_type, frame_len, raw), and their columns in `keep`; frames that cannot be decoded give none."""
    kinds, names = dict(frames.dtypes), [x.split()[0] for x in PACKETS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, rows = [], []
            for k, (ts, link, size, raw) in enumerate(zip(*(c.to_pylist() for c in b.columns[:4]), strict=True)):
                if (p := decode(link, raw or b"")) is not None:
                    at.append(k)
                    rows.append((ts, p.src, p.dst, p.ip_version, p.protocol, p.src_port, p.dst_port, p.tcp_flags, p.tcp_seq, p.tcp_window, p.icmp_type, p.icmp_code, p.payload, size, p.vlan_id, p.is_fragment, p.ip_id, p.frag_offset, p.more_fragments, p.tunnels))
            if rows:
                place = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays([*_batch(rows, PACKETS).columns, *(b.column(4 + k).take(place) for k in range(len(keep)))], [*names, *keep])

    schema = ", ".join([PACKETS, *(f"`{c}` {kinds[c]}" for c in keep)])
    return frames.select("ts_us", "link_type", "frame_len", "raw", *keep).mapInArrow(run, schema)


def defragment(pieces: list[tuple[int, bool, bytes]], last_wins: bool = False) -> bytes | None:
    """A datagram from (offset, more to come, bytes) in order of arrival, or None if it has gaps or no end."""
    ends = [at + len(b) for at, more, b in pieces if not more]
    if not ends or min(ends) > 65_535:
        return None
    size = ends[0]
    out, known = bytearray(size), bytearray(size)
    for at, _, b in pieces if last_wins else reversed(pieces):
        b = b[: max(size - at, 0)]
        out[at : at + len(b)] = b
        known[at : at + len(b)] = b"\1" * len(b)
    return bytes(out) if all(known) else None


class Rebuilding:
    """The pieces of one key's datagrams as they come.

    A new one begins after one that is complete, and when the first piece is older than the timeout.
    """

    #: Pieces of one datagram at most; a further one begins anew.
    MOST = 128

    def __init__(self, last_wins: bool, timeout_us: int):
        self.last_wins, self.timeout_us = last_wins, timeout_us
        self.held: list[tuple[int, bool, bytes]] = []
        self.begun, self.end, self.size = 0, None, 0

    def take(self, ts: int, at: int, more: bool, data: bytes) -> bytes | None:
        """The datagram that a piece completes."""
        if at + len(data) > 65_535:
            return None
        if not self.held or ts - self.begun > self.timeout_us or len(self.held) >= self.MOST:
            self.held, self.begun, self.end, self.size = [], ts, None, 0
        self.held.append((at, more, data))
        self.size += len(data)
        if not more and self.end is None:
            self.end = at + len(data)
        if self.end is not None and self.size >= self.end and (body := defragment(self.held, self.last_wins)) is not None:
            self.held = []
            return body
        return None


def defragmented(packets: DataFrame, last_wins: bool = False, timeout_us: int = 30_000_000, keep: list[str] = ()) -> DataFrame:
    """src, dst, protocol, ip_id, ts_us and body of each datagram whose pieces came within the timeout of its first one.

    ts_us and the columns in `keep` are those of the piece that completes it.  Pieces stream by key in order of time; at
    most those of one datagram are held.
    """
    keys, kinds = ["src", "dst", "protocol", "ip_id"], dict(packets.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, None
        for b in batches:
            if not b.num_rows:
                continue
            fresh, last = key_changes([b.column(k) for k in range(4)], last)
            at, bodies = [], []
            for k, (new, *piece) in enumerate(zip(fresh.tolist(), *(b.column(4 + n).to_pylist() for n in range(4)), strict=True)):
                if new:
                    state = Rebuilding(last_wins, timeout_us)
                if (body := state.take(piece[0], piece[1], piece[2], piece[3] or b"")) is not None:
                    at.append(k)
                    bodies.append(body)
            place = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(k).take(place) for k in (0, 1, 2, 3, 4)), pa.array(bodies, pa.binary()), *(b.column(8 + k).take(place) for k in range(len(keep)))], [*keys, "ts_us", "body", *keep])

    rows = packets.filter("is_fragment").select(*keys, "ts_us", "frag_offset", "more_fragments", "payload", *keep)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in [*keys, "ts_us"]) + ", body binary" + "".join(f", `{c}` {kinds[c]}" for c in keep)
    return rows.repartition(*keys).sortWithinPartitions(*keys, "ts_us", "frag_offset").mapInArrow(run, schema)


def whole_packets(packets: DataFrame, keep: list[str] = (), last_wins: bool = False) -> DataFrame:
    """All packets, with rebuilt datagrams in the place of their fragments; the columns of decode_frames() and `keep`."""
    names = [x.split()[0] for x in PACKETS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for src, dst, protocol, ip_id, ts, body in zip(*(b.column(k).to_pylist() for k in range(6)), strict=True):
                p = transport(Packet(src, dst, 6 if ":" in src else 4, protocol, ip_id=ip_id, body=body))
                rows.append((ts, p.src, p.dst, p.ip_version, p.protocol, p.src_port, p.dst_port, p.tcp_flags, p.tcp_seq, p.tcp_window, p.icmp_type, p.icmp_code, p.payload, len(body), None, False, ip_id, 0, False, 0))
            if rows:
                yield pa.RecordBatch.from_arrays([*_batch(rows, PACKETS).columns, *b.columns[6:]], [*names, *keep])

    kinds = dict(packets.dtypes)
    schema = ", ".join([PACKETS, *(f"`{c}` {kinds[c]}" for c in keep)])
    rebuilt = defragmented(packets, last_wins, keep=keep).mapInArrow(run, schema)
    return packets.filter("NOT is_fragment").select(*names, *keep).unionByName(rebuilt)


def write_pcap_bytes(frames: list[tuple[int, bytes]], link: int = ETHERNET) -> bytes:
    """A capture file of (microseconds, bytes)."""
    out = bytearray(struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65_535, link))
    for ts, raw in frames:
        out += struct.pack("<4I", ts // 1_000_000, ts % 1_000_000, len(raw), len(raw)) + raw
    return bytes(out)


def around_alerts(frames: DataFrame, alerts: DataFrame, last: int = 50, keep: int = 1500) -> DataFrame:
    """alert_id, path, frame_no and bytes of the `last` frames up to each alert's frame (alert_id, path, at_frame).

    Frames are numbered by file, so an alert names its file.
    """
    wanted = alerts.select("alert_id", "path", F.explode(F.sequence(F.greatest(F.col("at_frame") - last + 1, F.lit(0)), F.col("at_frame"))).alias("frame_no"))
    return frames.join(wanted, ["path", "frame_no"]).select("alert_id", "path", "frame_no", "ts_us", F.substring("raw", 1, keep).alias("raw"))


def follow_pcap(spark: SparkSession, path: str, files: int = 16) -> DataFrame:
    """Frames of captures as they are dropped into a folder (a rotating capture tool writes them there), as a stream.

    At most `files` captures make a micro-batch, so a burst waits in the folder and nothing is shed.
    """
    found = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("maxFilesPerTrigger", files).option("pathGlobFilter", "*.pcap").load(path)
    return frames_in(found)


#: Why a frame gave a packet or none, in the order in which it is told.
OUTCOMES = ("unsupported_link", "short_frame", "non_ip", "bad_ip_header", "fragment", "tunnelled", "encrypted", "decoded")
ESP = 50


def outcome(link: int, raw: bytes) -> tuple[str, bool]:
    """What became of a frame, and whether it had a VLAN tag."""
    if link not in (ETHERNET, RAW_IP, NULL_LOOP, LOOP, LINUX_SLL, LINUX_SLL2):
        return "unsupported_link", False
    found = network_layer(link, raw)
    if found is None:
        return "short_frame", False
    kind, _, vlan = found
    if kind not in (IPV4, IPV6):
        return "non_ip", bool(vlan)
    p = decode(link, raw)
    if p is None:
        return "bad_ip_header", bool(vlan)
    return ("fragment" if p.is_fragment else "encrypted" if p.protocol == ESP else "tunnelled" if p.tunnels else "decoded"), bool(vlan)


def decode_counts(frames: DataFrame) -> DataFrame:
    """outcome, frames and vlan_tagged of all frames: counted in the tasks, so that a row for each outcome is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, list[int]] = {}
        for b in batches:
            for link, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                name, tagged = outcome(link, raw or b"")
                held = counts.setdefault(name, [0, 0])
                held[0] += 1
                held[1] += tagged
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), *(pa.array([v[k] for v in counts.values()], pa.int64()) for k in range(2))], ["outcome", "frames", "vlan_tagged"])

    return frames.select("link_type", "raw").mapInArrow(run, "outcome string, frames bigint, vlan_tagged bigint").groupBy("outcome").agg(F.sum("frames").alias("frames"), F.sum("vlan_tagged").alias("vlan_tagged"))
