"""The paged scan-file format: pages, checksums, packets and packed fields, in numpy.

All functions take buffers, so that they serve memory-mapped files and the
content column of Spark's binaryFile source alike.
"""

from __future__ import annotations

import struct
import xml.etree.ElementTree as ET
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np

# Fixed values of the file format.
SIGNATURE = b"ASTM-E57"
PAGE, PAYLOAD = 1024, 1020
HEADER, SECTION = 48, 32
XML_OFFSET, XML_LENGTH = 24, 32
CRC_POLYNOMIAL = 0x82F63B78
INDEX, DATA, IGNORED = 0, 1, 2
RESTART = 1
NAMESPACE = "http://www.astm.org/COMMIT/E57/2010-e57-v1.0"
LONG_MIN, LONG_MAX = -(2**63), 2**63 - 1


class FormatError(ValueError):
    """What is wrong with a file, in words."""


def _table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, t >> 1 ^ np.uint32(CRC_POLYNOMIAL), t >> 1)
    return t


TABLE = _table()


def crc32c(rows: np.ndarray) -> np.ndarray:
    """Checksums of equally long byte rows, all rows a byte at a time."""
    state = np.full(len(rows), 0xFFFFFFFF, np.uint32)
    for column in np.ascontiguousarray(rows.T):
        state = TABLE[(state ^ column) & 0xFF] ^ state >> np.uint32(8)
    return ~state


def to_logical(at: int) -> int:
    return at // PAGE * PAYLOAD + at % PAGE


def to_physical(at: int) -> int:
    return at // PAYLOAD * PAGE + at % PAYLOAD


def pages(data) -> tuple[np.ndarray, np.ndarray]:
    """(stored, computed) checksums of all pages; the stored one is big-endian."""
    raw = np.frombuffer(data, np.uint8)
    if len(raw) % PAGE:
        raise FormatError("file size is not a whole number of pages")
    rows = raw.reshape(-1, PAGE)
    return rows[:, PAYLOAD:].copy().view(">u4").ravel().astype(np.int64), crc32c(rows[:, :PAYLOAD]).astype(np.int64)


class Paged:
    """Reads by logical address, leaving checksums out."""

    def __init__(self, data):
        self.raw = np.frombuffer(data, np.uint8)
        if len(self.raw) < PAGE:
            raise FormatError("file is shorter than a page")

    @property
    def logical_size(self) -> int:
        return len(self.raw) // PAGE * PAYLOAD

    def read(self, at: int, size: int) -> bytes:
        first, last = at // PAYLOAD, -(-(at + size) // PAYLOAD)
        if at < 0 or last * PAGE > len(self.raw):
            raise FormatError("read past the end of the file")
        rows = self.raw[first * PAGE : last * PAGE].reshape(-1, PAGE)[:, :PAYLOAD]
        return rows.reshape(-1)[at - first * PAYLOAD :][:size].tobytes()


def bits_needed(low: int, high: int) -> int:
    """Bits to hold high - low; 0 for a constant, 64 for all longs."""
    return max(0, high - low).bit_length() if high > low else 0


@dataclass
class Field:
    name: str
    type: str = "Float"
    minimum: int = LONG_MIN
    maximum: int = LONG_MAX
    scale: float = 1.0
    offset: float = 0.0
    precision: str = "double"

    @property
    def packed(self) -> bool:
        return self.type in ("Integer", "ScaledInteger")

    @property
    def bits(self) -> int:
        if self.packed:
            return bits_needed(self.minimum, self.maximum)
        return 32 if self.precision == "single" else 64

    def decode(self, raw: np.ndarray) -> np.ndarray:
        """Doubles from raw unsigned values."""
        if self.type == "Float":
            return raw.astype(np.uint32).view(np.float32).astype(np.float64) if self.bits == 32 else raw.view(np.float64)
        whole = (raw + np.uint64(self.minimum & (2**64 - 1))).view(np.int64).astype(np.float64)
        return whole if self.type == "Integer" else self.offset + whole * self.scale

    def encode(self, values: np.ndarray) -> np.ndarray:
        """Raw unsigned values of doubles (of integers for packed fields, before scale and offset)."""
        if self.type == "Float":
            return values.astype(np.float32).view(np.uint32).astype(np.uint64) if self.bits == 32 else values.astype(np.float64).view(np.uint64)
        return values.astype(np.int64).view(np.uint64) - np.uint64(self.minimum & (2**64 - 1))


def unpack(stream: bytes, bits: int, first_bit: int, n: int) -> np.ndarray:
    """n values of some bits each, lowest bit first, from a bit of the stream on."""
    if not bits:
        return np.zeros(n, np.uint64)
    at = first_bit + np.arange(n, dtype=np.int64) * bits
    raw = np.frombuffer(stream + b"\0" * 9, np.uint8).astype(np.uint64)
    byte, shift = at >> 3, (at & 7).astype(np.uint64)
    low = np.zeros(n, np.uint64)
    for k in range(min(8, (bits + 14) // 8)):
        low |= raw[byte + k] << np.uint64(8 * k)
    out = low >> shift
    if bits > 57:
        high = raw[byte + 8] << (np.uint64(64) - shift) % np.uint64(64)
        out |= np.where(shift > 0, high, 0)
    return out if bits == 64 else out & np.uint64((1 << bits) - 1)


def pack(values: np.ndarray, bits: int) -> bytes:
    """The reverse of ``unpack``."""
    if not bits:
        return b""
    if bits in (8, 16, 32, 64):
        return values.astype(f"<u{bits // 8}").tobytes()
    rows = np.unpackbits(values.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")[:, :bits]
    return np.packbits(rows.reshape(-1), bitorder="little").tobytes()


# ---- catalogue -------------------------------------------------------------
@dataclass
class Scan:
    fields: list[Field]
    records: int
    offset: int  # physical address of the points' section
    guid: str = ""
    name: str = ""
    has_pose: bool = False
    q: list[float] = field(default_factory=lambda: [1.0, 0.0, 0.0, 0.0])
    t: list[float] = field(default_factory=lambda: [0.0, 0.0, 0.0])
    index_bounds: list[int] | None = None
    bounds: list[float] | None = None
    grouping: bool = False


def local(tag: str) -> str:
    return tag.rpartition("}")[2].rpartition(":")[2]


def child(node, *names: str):
    for name in names:
        node = next((x for x in node if local(x.tag) == name), None) if node is not None else None
    return node


def number(node, kind, default):
    """A node's text as a number; empty is the default, anything else must be a number."""
    text = (node.text or "").strip() if node is not None else ""
    return kind(text) if text else default


def read_field(node) -> Field:
    kind = node.get("type", "")
    if kind not in ("Integer", "ScaledInteger", "Float", "String"):
        raise FormatError(f"unsupported prototype type {kind!r} of {local(node.tag)}")
    get = lambda name, as_, default: as_(node.get(name)) if node.get(name) else default
    return Field(local(node.tag), kind, get("minimum", int, LONG_MIN) if kind != "Float" else LONG_MIN, get("maximum", int, LONG_MAX) if kind != "Float" else LONG_MAX, get("scale", float, 1.0), get("offset", float, 0.0), node.get("precision", "double"))


def catalogue(file: Paged) -> list[Scan]:
    """All scans that a file declares."""
    head = file.read(0, HEADER)
    if head[:8] != SIGNATURE:
        raise FormatError("bad signature: not a scan file")
    offset, length = struct.unpack_from("<Q", head, XML_OFFSET)[0], struct.unpack_from("<Q", head, XML_LENGTH)[0]
    try:
        root = ET.fromstring(file.read(to_logical(offset), length).rstrip(b"\0"))
    except ET.ParseError as e:
        raise FormatError(f"bad XML: {e}") from e
    data = child(root, "data3D")
    if data is None:
        raise FormatError("no data3D")
    scans = []
    for node in (x for x in data if local(x.tag) == "vectorChild"):
        points = child(node, "points")
        if points is None:
            raise FormatError("scan without points")
        proto = child(points, "prototype")
        if proto is None:
            raise FormatError("scan without a prototype")
        scan = Scan([read_field(x) for x in proto], int(points.get("recordCount", 0)), int(points.get("fileOffset", 0)), (getattr(child(node, "guid"), "text", "") or "").strip(), (getattr(child(node, "name"), "text", "") or "").strip())
        pose = child(node, "pose")
        if pose is not None:
            scan.has_pose = True
            scan.q = [number(child(pose, "rotation", c), float, d) for c, d in zip("wxyz", (1.0, 0.0, 0.0, 0.0))]
            scan.t = [number(child(pose, "translation", c), float, 0.0) for c in "xyz"]
        found = [number(child(node, "indexBounds", c), int, None) for c in ("rowMinimum", "rowMaximum", "columnMinimum", "columnMaximum")]
        scan.index_bounds = found if None not in found else None
        found = [number(child(node, "cartesianBounds", f"{c}{m}"), float, None) for c in "xyz" for m in ("Minimum", "Maximum")]
        scan.bounds = found if None not in found else None
        scan.grouping = child(node, "pointGroupingSchemes") is not None
        scans.append(scan)
    if not scans:
        raise FormatError("no scans")
    return scans


# ---- points ----------------------------------------------------------------
@dataclass
class Packet:
    type: int
    flags: int
    at: int  # logical address
    size: int
    streams: list[tuple[int, int]]  # (logical address, bytes) of each field


def walk(file: Paged, scan: Scan) -> Iterator[Packet]:
    """A walk over packet headers alone."""
    at = to_logical(scan.offset)
    head = file.read(at, SECTION)
    if head[0] != 1:
        raise FormatError("bad section id")
    length, data = struct.unpack_from("<QQ", head, 8)
    at, end = to_logical(data), at + length
    while at < end:
        kind, flags, size = struct.unpack("<BBH", file.read(at, 4))
        size += 1
        streams = []
        if kind == DATA:
            (n,) = struct.unpack("<H", file.read(at + 4, 2))
            if n != len(scan.fields):
                raise FormatError("packet has another number of streams than the prototype")
            place = at + 6 + 2 * n
            for s in struct.unpack(f"<{n}H", file.read(at + 6, 2 * n)):
                streams.append((place, s))
                place += s
            if place > at + size:
                raise FormatError("streams run past their packet")
        elif kind not in (INDEX, IGNORED):
            raise FormatError(f"unknown packet type {kind}")
        yield Packet(kind, flags, at, size, streams)
        at += size


def packets(file: Paged, scan: Scan) -> list[Packet]:
    return list(walk(file, scan))


def by_restart(found: list[Packet]) -> list[list[Packet]]:
    """Data packets between restarts."""
    parts: list[list[Packet]] = []
    for p in (p for p in found if p.type == DATA):
        if not parts or p.flags & RESTART:
            parts.append([])
        parts[-1].append(p)
    return parts


def there(scan: Scan, found: list[Packet], wanted: list[int]) -> int:
    """Records that the packets hold, up to those declared."""
    packed = [i for i in wanted if scan.fields[i].bits]
    if not packed:
        return scan.records
    return min(scan.records, sum(min(sum(p.streams[i][1] for p in part) * 8 // scan.fields[i].bits for i in packed) for part in by_restart(found)))


#: Of each field, where its bytes lie: their addresses by packet, and how many there are up to the end of each.
Places = dict[int, tuple[np.ndarray, np.ndarray]]


def segments(scan: Scan, found: Iterable[Packet], wanted: list[int]) -> list[tuple[int, int, Places]]:
    """(first record, records, places) between restarts, of which each starts its streams anew; packets are not kept."""
    parts: list[dict[int, tuple[array, array]]] = []
    for p in (p for p in found if p.type == DATA):
        if not parts or p.flags & RESTART:
            parts.append({i: (array("q"), array("q")) for i in wanted})
        for i, (at, ends) in parts[-1].items():
            at.append(p.streams[i][0])
            ends.append(p.streams[i][1] + (ends[-1] if ends else 0))
    out, first = [], 0
    for part in parts:
        room = [ends[-1] * 8 // scan.fields[i].bits for i, (_, ends) in part.items() if scan.fields[i].bits]
        n = min([scan.records - first, *room])
        out.append((first, n, {i: (np.array(at, np.int64), np.array(ends, np.int64)) for i, (at, ends) in part.items()}))
        first += n
    if first < scan.records and parts == [] and all(not scan.fields[i].bits for i in wanted):
        out, first = [(0, scan.records, {})], scan.records
    if first < scan.records:
        raise FormatError(f"decoded {first} of {scan.records} records")
    return out


def positions(scan: Scan, names: list[str]) -> list[int]:
    """The fields' places in the prototype."""
    index = {f.name: i for i, f in reversed(list(enumerate(scan.fields)))}
    for name in names:
        if name not in index:
            raise FormatError(f"no field {name}")
        if scan.fields[index[name]].type == "String":
            raise FormatError(f"field {name} is a string")
    return [index[n] for n in names]


def located(file: Paged, scan: Scan, names: list[str]) -> list[tuple[int, int, Places]]:
    """Where fields lie, for any number of calls of ``decode`` after one walk."""
    return segments(scan, walk(file, scan), positions(scan, names))


def decode(file: Paged, scan: Scan, names: list[str], low: int = 0, high: int | None = None, parts: list[tuple[int, int, Places]] | None = None) -> dict[str, np.ndarray]:
    """Columns of records low to high; only the bytes of these fields and records are read."""
    wanted = positions(scan, names)
    high = scan.records if high is None else min(high, scan.records)
    out: dict[str, list[np.ndarray]] = {n: [] for n in names}
    for first, n, part in located(file, scan, names) if parts is None else parts:
        a, b = max(low, first) - first, min(high, first + n) - first
        if a >= b:
            continue
        for name, i in zip(names, wanted):
            bits = scan.fields[i].bits
            start, stop, pieces = a * bits // 8, -(-b * bits // 8), []
            at, ends = part[i] if bits else (np.zeros(0, np.int64),) * 2
            for k in range(int(np.searchsorted(ends, start, "right")), int(np.searchsorted(ends, stop)) + 1) if bits else ():
                edge = int(ends[k - 1]) if k else 0
                x, y = max(start, edge) - edge, min(stop, int(ends[k])) - edge
                if x < y:
                    pieces.append(file.read(int(at[k]) + x, y - x))
            out[name].append(scan.fields[i].decode(unpack(b"".join(pieces), bits, a * bits - start * 8, b - a)))
    return {n: np.concatenate(v) if v else np.zeros(0) for n, v in out.items()}


# ---- writing ---------------------------------------------------------------
def element(name: str, kind: str, value="", **more) -> str:
    rest = "".join(f' {k}="{v}"' for k, v in more.items())
    return f'<{name} type="{kind}"{rest}>{value}</{name}>'


def field_xml(f: Field) -> str:
    more = {}
    if f.packed:
        more |= {"minimum": f.minimum, "maximum": f.maximum}
    if f.type == "ScaledInteger":
        more |= {"scale": repr(f.scale), "offset": repr(f.offset)}
    if f.type == "Float":
        more["precision"] = f.precision
    return element(f.name, f.type, **more)


def scan_xml(s: Scan) -> str:
    from xml.sax.saxutils import escape

    inside = element("guid", "String", escape(s.guid)) + element("name", "String", escape(s.name))
    if s.has_pose:
        inside += element("pose", "Structure", element("rotation", "Structure", "".join(element(c, "Float", repr(v)) for c, v in zip("wxyz", s.q))) + element("translation", "Structure", "".join(element(c, "Float", repr(v)) for c, v in zip("xyz", s.t))))
    if s.index_bounds:
        inside += element("indexBounds", "Structure", "".join(element(c, "Integer", v) for c, v in zip(("rowMinimum", "rowMaximum", "columnMinimum", "columnMaximum"), s.index_bounds)))
    if s.bounds:
        inside += element("cartesianBounds", "Structure", "".join(element(f"{c}{m}", "Float", repr(v)) for (c, m), v in zip(((c, m) for c in "xyz" for m in ("Minimum", "Maximum")), s.bounds)))
    if s.grouping:
        inside += element("pointGroupingSchemes", "Structure")
    inside += element("points", "CompressedVector", element("prototype", "Structure", "".join(map(field_xml, s.fields))), fileOffset=s.offset, recordCount=s.records)
    return element("vectorChild", "Structure", inside)


def encode_packets(scan: Scan, columns: list[np.ndarray], per_packet: int, restart_every: int = 0, extra: bytes = b"") -> bytes:
    """Data packets of so many records' bits each; streams go on across packets but start anew at restarts."""
    n, out, count = len(columns[0]) if columns else 0, [], 0
    span = restart_every * per_packet if restart_every else max(n, 1)
    for a in range(0, n, span):
        b = min(n, a + span)
        streams = [pack(f.encode(c[a:b]), f.bits) for f, c in zip(scan.fields, columns)]
        done = [0] * len(streams)
        for r in range(per_packet, b - a + per_packet, per_packet):
            last = r >= b - a
            ends = [len(s) if last else r * f.bits // 8 for s, f in zip(streams, scan.fields)]
            part = [s[d:e] for s, d, e in zip(streams, done, ends)]
            done = ends
            body = struct.pack(f"<H{len(part)}H", len(part), *map(len, part)) + b"".join(part)
            body += b"\0" * (-(len(body) + 4) % 4)
            flags = RESTART if restart_every and r == per_packet and a else 0
            out.append(struct.pack("<BBH", DATA, flags, len(body) + 3) + body)
            count += 1
            if extra and count == 1:
                out.append(extra)
    return b"".join(out)


def section(at: int, size: int) -> bytes:
    """Head of a section of points whose packets have so many bytes."""
    return struct.pack("<B7xQQQ", 1, SECTION + size, to_physical(at + SECTION), 0)


def header(at: int, xml: bytes) -> bytes:
    """Head of a file whose last bytes are XML from a logical address on."""
    return struct.pack("<8sIIQQQQ", SIGNATURE, 1, 0, -(-(at + len(xml)) // PAYLOAD) * PAGE, to_physical(at), len(xml), PAGE)


def root_xml(scans: list[Scan]) -> bytes:
    return ('<?xml version="1.0" encoding="UTF-8"?>\n' + f'<e57Root type="Structure" xmlns="{NAMESPACE}">' + element("data3D", "Vector", "".join(map(scan_xml, scans)), allowHeterogeneousChildren=1) + "</e57Root>").encode()


def paged(logical: bytes) -> bytes:
    """Whole pages with their checksums, the last one filled up with zeros."""
    rows = np.frombuffer(logical.ljust(-(-len(logical) // PAYLOAD) * PAYLOAD, b"\0"), np.uint8).reshape(-1, PAYLOAD)
    return np.concatenate([rows, crc32c(rows).astype(">u4").view(np.uint8).reshape(-1, 4)], axis=1).tobytes()


def write(scans: list[tuple[Scan, list[np.ndarray]]], per_packet: int = 512, restart_every: int = 0, extra: bytes = b"") -> bytes:
    """A whole file: header, one section per scan, XML; then cut into pages with their checksums."""
    body, at = [], HEADER
    for scan, columns in scans:
        scan.offset = to_physical(at)
        data = encode_packets(scan, columns, per_packet, restart_every, extra)
        body.append(section(at, len(data)) + data)
        pad = -len(body[-1]) % 4
        body.append(b"\0" * pad)
        at += SECTION + len(data) + pad
    xml = root_xml([s for s, _ in scans])
    return paged(header(at, xml) + b"".join(body) + xml)


class ScanFile:
    """A file of one scan, written as its records come, in memory that does not grow with them.

    Its bytes are those of ``write`` if records come in multiples of eight packets' worth.
    """

    def __init__(self, path: str, scan: Scan, per_packet: int = 512):
        self.path, self.scan, self.per_packet = path, scan, per_packet
        scan.offset, scan.records = to_physical(HEADER), 0
        self.first, self.rest, self.size = b"", bytes(HEADER + SECTION), 0

    def add(self, columns: list[np.ndarray], n: int) -> None:
        """n more records: a multiple of eight except at the end, so that every stream goes on at a whole byte."""
        data = encode_packets(self.scan, columns, self.per_packet)
        self.scan.records += n
        self.size += len(data)
        self.put(self.rest + data)

    def put(self, logical: bytes) -> None:
        whole = len(logical) // PAYLOAD * PAYLOAD
        self.first, self.rest = self.first or logical[: min(whole, PAYLOAD)], logical[whole:]
        with open(self.path, "ab") as f:
            f.write(paged(logical[:whole]) if whole else b"")

    def close(self) -> None:
        """What comes after the points, then the heads, which tell how many there were."""
        pad = -self.size % 4
        at, xml = HEADER + SECTION + self.size + pad, root_xml([self.scan])
        rest = self.rest + b"\0" * pad + xml
        self.put(rest.ljust(-(-len(rest) // PAYLOAD) * PAYLOAD, b"\0"))
        heads = header(at, xml) + section(HEADER, self.size)
        with open(self.path, "r+b") as f:
            f.write(paged(heads + self.first[len(heads) :]))
