"""The block format of trace files: reading and writing its parts as bytes.

A file is a run of blocks: a tag byte, a length of 8 bytes (big-endian, itself included), a body. Numbers in bodies are
varints (seven bits a byte, lowest first) or 8 bytes big-endian.
"""

from __future__ import annotations

import gzip
import io
import struct
import zlib
from collections.abc import Callable, Container, Iterable, Iterator
from functools import cached_property
from itertools import accumulate
from typing import BinaryIO, NamedTuple

import pyarrow as pa

# Block tags, hierarchy tags, symbols of a scalar that are neither 0 nor 1.
HEADER, VALUES, BLACKOUT, GEOMETRY, HIERARCHY, VALUES_ALIAS, HIERARCHY_LZ4, HIERARCHY_LZ4_TWICE, VALUES_ALIAS2, WRAPPER, UNFINISHED = 0, 1, 2, 3, 4, 5, 6, 7, 8, 254, 255
ATTR_BEGIN, ATTR_END, SCOPE, UPSCOPE = 252, 253, 254, 255
SYMBOLS = "xzhuwl-?"
TEXT_LENGTH = 0xFFFFFFFF  # in the geometry: a signal of text
_ENDIAN = 2.7182818284590452354
_VERSION, _DATE = 128, 119
REALS = (3, 4, 20, 29)


class FormatError(ValueError):
    """A file that is no trace, or a broken one."""


def varint(data, at: int) -> tuple[int, int]:
    """The number at a place, and the place after it."""
    out = shift = 0
    while True:
        b = data[at]
        at += 1
        out |= (b & 127) << shift
        shift += 7
        if b < 128:
            return out, at


def signed_varint(data, at: int) -> tuple[int, int]:
    out, to = varint(data, at)
    if data[to - 1] & 64:
        out -= 1 << 7 * (to - at)
    return out, to


def put_varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def put_signed_varint(n: int) -> bytes:
    out = bytearray()
    while not -64 <= n < 64:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n & 127])


def fastlz(data: bytes, size: int) -> bytes:
    """Decompresses either level of FastLZ: literal runs, and copies of what came before."""
    level = data[0] >> 5
    if level > 1:
        raise FormatError("unknown FastLZ level")
    out, at, op = bytearray(), 1, data[0] & 31
    while True:
        if op < 32:
            out += data[at : at + op + 1]
            at += op + 1
        else:
            length, back = (op >> 5) - 1, (op & 31) << 8
            if length == 6:
                more = 255
                while more == 255:
                    more = data[at]
                    at += 1
                    length += more
                    if level == 0:
                        break
            low = data[at]
            at += 1
            if level == 1 and low == 255 and back == 31 << 8:
                back = (data[at] << 8 | data[at + 1]) + 8191
                at += 2
            else:
                back += low
            start = len(out) - back - 1
            if start < 0:
                raise FormatError("FastLZ copy from before the start")
            for i in range(length + 3):
                out.append(out[start + i])
        if at >= len(data):
            break
        op = data[at]
        at += 1
    if len(out) != size:
        raise FormatError(f"FastLZ made {len(out)} bytes of {size}")
    return bytes(out)


def unpack(kind: str, data: bytes, size: int) -> bytes:
    try:
        if kind == "4":
            return pa.decompress(data, decompressed_size=size, codec="lz4_raw", asbytes=True)
        return fastlz(data, size) if kind == "F" else zlib.decompress(data)
    except (zlib.error, OSError, pa.ArrowException, IndexError) as e:
        raise FormatError(f"broken {kind} data") from e


def pack(kind: str, data: bytes) -> bytes:
    return pa.compress(data, codec="lz4_raw", asbytes=True) if kind == "4" else zlib.compress(data, 4)


class Block(NamedTuple):
    tag: int
    at: int
    length: int
    begin: int
    end: int


class File:
    """What a file states about itself: header, widths, blocks of values, blackouts, hierarchy. Blocks that are being written end it.

    The header and the places of the blocks are read at once; widths, blackouts and hierarchy when they are asked for, as
    they grow with the trace.
    """

    def __init__(self, f: BinaryIO, side: Callable[[], bytes | None] | None = None):
        """side: reads the hierarchy from a file beside this one, for one that has none inside."""
        self.f, self.side, self.values, self.head, self.geometry = f, None, [], None, None
        self._toggles: list[tuple[int, int]] = []
        self._records: tuple[int, int, int] | None = None
        at = 0
        while True:
            f.seek(at)
            start = f.read(9)
            if len(start) < 9:
                break
            tag, length = start[0], struct.unpack(">Q", start[1:])[0]
            if tag == WRAPPER and at == 0:
                if not length:
                    raise FormatError("the wrapped file is not finished")
                f.seek(17)
                self.__init__(io.BytesIO(gzip.decompress(f.read())), side)
                self.wrapped = True
                return
            if tag == UNFINISHED or length < 8:
                break
            if tag == HEADER:
                self.head = self._header(f.read(321))
            elif tag in (VALUES, VALUES_ALIAS, VALUES_ALIAS2):
                self.values.append(Block(tag, at, length, *struct.unpack(">QQ", f.read(16))))
            elif tag == GEOMETRY:
                self.geometry = at + 9, length - 8
            elif tag == BLACKOUT:
                self._toggles.append((at + 9, length - 8))
            elif tag in (HIERARCHY, HIERARCHY_LZ4, HIERARCHY_LZ4_TWICE):
                self._records = tag, at + 9, length - 8
            at += 1 + length
        self.wrapped = False
        if self._records is None and side is not None:
            self.side = side()
        if self.head is None or not self.values or (self._records is None and self.side is None):
            raise FormatError("no header, no values or no hierarchy")
        if self.head["end_time"]:
            if self.head["max_handle"] < 1:
                raise FormatError("no handles")
            if self.head["vc_sections"]:  # what was appended after the header was written is not of this state
                del self.values[self.head["vc_sections"] :]
        if not self.head["end_time"]:
            self.head |= {"start_time": self.values[0].begin, "end_time": self.values[-1].end}

    def _part(self, at: int, length: int) -> bytes:
        self.f.seek(at)
        return self.f.read(length)

    @property
    def hierarchy(self) -> bytes:
        if self._records is None:
            return self.side
        tag, at, length = self._records
        raw = self._part(at, length)
        size, raw = struct.unpack(">Q", raw[:8])[0], raw[8:]
        if tag == HIERARCHY:
            return gzip.decompress(raw)
        if tag == HIERARCHY_LZ4:
            return unpack("4", raw, size)
        once = struct.unpack(">Q", raw[:8])[0]
        return unpack("4", unpack("4", raw[8:], once), size)

    @cached_property
    def widths(self) -> list[int]:
        if self.geometry is not None:
            return widths(self._part(*self.geometry))
        return [0 if r["type_code"] in REALS else TEXT_LENGTH if r["length"] == 0 else r["length"] for r in hierarchy_rows(self.hierarchy) if r["kind"] == "var" and not r["is_alias"]]

    def toggles(self) -> Iterator[tuple[int, int, bool]]:
        """Number, time, whether recording goes on, one after the other."""
        for place in self._toggles:
            raw = self._part(*place)
            n, p = varint(raw, 0)
            time = 0
            for i in range(n):
                step, q = varint(raw, p + 1)
                time += step
                yield i, time, raw[p] != 0
                p = q

    @property
    def blackouts(self) -> list[tuple[int, int, bool]]:
        return list(self.toggles())

    @staticmethod
    def _header(raw: bytes) -> dict:
        start, end = struct.unpack(">QQ", raw[:16])
        if max(start, end) >= 1 << 63:
            raise FormatError("times beyond 63 bits")
        memory, scopes, variables, handles, blocks = struct.unpack(">5Q", raw[24:64])
        match = struct.unpack("<d", raw[16:24])[0] == _ENDIAN
        if not match and struct.unpack(">d", raw[16:24])[0] != _ENDIAN:
            raise FormatError("the header is broken")
        words = lambda a, n: raw[a : a + n].split(b"\0")[0].decode("utf-8")
        tail = 65 + _VERSION + _DATE
        return {
            "date": words(65 + _VERSION, _DATE), "version": words(65, _VERSION), "file_type": raw[tail], "timescale_exp": struct.unpack("b", raw[64:65])[0],
            "timezero": struct.unpack(">q", raw[tail + 1 : tail + 9])[0], "start_time": start, "end_time": end, "num_scopes": scopes, "num_vars": variables,
            "num_aliases": variables - handles, "max_handle": handles, "vc_sections": blocks, "writer_mem": memory, "endian_match": match,
        }


def widths(body: bytes) -> list[int]:
    """The body of a geometry block: the width of each handle."""
    size, count = struct.unpack(">QQ", body[:16])
    raw = body[16:]
    return unpacked_widths(raw if len(raw) == size else zlib.decompress(raw), count)


def unpacked_widths(raw: bytes, count: int) -> list[int]:
    if len(raw) == count:  # a byte each
        return list(raw)
    out, at = [], 0
    for _ in range(count):
        w, at = varint(raw, at)
        out.append(w)
    return out


class Part(NamedTuple):
    """What block_changes needs of a file."""

    f: BinaryIO
    values: dict[int, Block] | list[Block]
    widths: list[int]
    head: dict


#: The columns of a record in the order of hierarchy_records.
RECORD = "ord kind type_code subtype_code name component direction_code length handle is_alias arg arg_from_name depth path".split()


def hierarchy_records(raw: bytes) -> Iterator[tuple]:
    """The records of a hierarchy in order. path is that of a scope or variable itself, and of the scopes around other records. A surplus end of scope does nothing."""
    at, handle, stack, ord_, inside, size = 0, 0, [], 0, "", len(raw)

    def name() -> str:
        nonlocal at
        end = raw.index(0, at)
        out = raw[at:end]
        at = end + 1
        try:
            return out.decode("utf-8")
        except UnicodeDecodeError as e:
            raise FormatError("a name that is not UTF-8") from e

    while at < size:
        tag = raw[at]
        at += 1
        depth = len(stack)
        if tag == SCOPE:
            code = raw[at]
            at += 1
            own, component = name(), name()
            stack.append(own)
            inside = ".".join(stack)
            yield ord_, "scope", code, None, own, component, None, None, None, None, None, None, depth, inside
        elif tag == UPSCOPE:
            yield ord_, "upscope", None, None, None, None, None, None, None, None, None, None, depth, inside
            if stack:
                stack.pop()
                inside = ".".join(stack)
        elif tag == ATTR_BEGIN:
            code, sub, stem = raw[at], raw[at + 1], None
            at += 2
            if code == 0 and sub in (4, 5):
                stem, end = varint(raw, at)
                at, own = raw.index(0, end) + 1, ""
            else:
                own = name()
            arg, at = varint(raw, at)
            yield ord_, "attr", code, sub, own, None, None, None, None, None, arg, stem, depth, inside
        elif tag == ATTR_END:
            yield ord_, "attr_end", None, None, None, None, None, None, None, None, None, None, depth, inside
        else:
            direction = raw[at]
            at += 1
            own = name()
            length, at = varint(raw, at)
            alias, at = varint(raw, at)
            if tag == 18:
                length = (length - 2) // 3
            handle += not alias
            yield ord_, "var", tag, None, own, None, direction, length, alias or handle, bool(alias), None, None, depth, f"{inside}.{own}" if stack else own
        ord_ += 1


def hierarchy_rows(raw: bytes) -> Iterator[dict]:
    """The records as dicts."""
    return (dict(zip(RECORD, r, strict=True)) for r in hierarchy_records(raw))


class Handles:
    """A set of handles in a bit each."""

    def __init__(self, handles: Iterable[int]):
        bits = bytearray()
        for h in handles:
            if h >> 3 >= len(bits):
                bits.extend(bytes((h >> 3) + 1 - len(bits) + len(bits) // 8))
            bits[h >> 3] |= 1 << (h & 7)
        self.bits = bytes(bits)

    def __contains__(self, handle: int) -> bool:
        return handle >> 3 < len(self.bits) and self.bits[handle >> 3] >> (handle & 7) & 1 == 1


def _chains(tag: int, index: bytes, end: int) -> dict[int, tuple[int, int]]:
    """Handle -> place and length of its chain, by the index of a block; aliases have their target's."""
    starts, alias, at, handle, place, last = {}, {}, 0, 1, 0, 0
    order = []
    while at < len(index):
        if tag == VALUES_ALIAS2 and index[at] & 1:
            n, at = signed_varint(index, at)
            n >>= 1
            if n > 0:
                place += n
                starts[handle] = place
                order.append(handle)
            else:
                last = -n or last
                alias[handle] = last
            handle += 1
        else:
            n, at = varint(index, at)
            if n == 0 and tag != VALUES_ALIAS2:
                alias[handle], at = varint(index, at)
                handle += 1
            elif n & 1:
                place += n >> 1
                starts[handle] = place
                order.append(handle)
                handle += 1
            else:
                handle += n >> 1
    out = {h: (starts[h], (starts[nxt] if nxt else end) - starts[h]) for h, nxt in zip(order, [*order[1:], None][: len(order)], strict=True)}
    for h, a in sorted(alias.items()):
        if a in out and a < h:
            out[h] = out[a]
    return out


def block_changes(file: File | Part, number: int, wanted: Container[int] | None = None, frame: bool | None = False) -> Iterator[tuple]:
    """(time, handle, seq, value, raw, real_value, var_len, is_initial, block) of one block of values.

    frame: whether its frame comes first; None: if the block begins before its first change. seq orders a handle's changes.
    """
    block = file.values[number]
    file.f.seek(block.at + 9)
    body = file.f.read(block.length - 8)
    size, packed, count = struct.unpack(">3Q", body[-24:])
    raw = body[-24 - packed : -24]
    raw = raw if packed == size else zlib.decompress(raw)
    steps, p = [], 0
    for _ in range(count):
        step, p = varint(raw, p)
        steps.append(step)
    times = list(accumulate(steps))
    index_end = len(body) - 24 - packed - 8
    index_size = struct.unpack(">Q", body[index_end : index_end + 8])[0]
    index = body[index_end - index_size : index_end]
    at = 24
    full, at = varint(body, at)
    small, at = varint(body, at)
    holders, at = varint(body, at)
    if (frame or (frame is None and times and block.begin != times[0])) and full:
        shown = body[at : at + small]
        shown, p = shown if small == full else zlib.decompress(shown), 0
        for h, width in enumerate(file.widths[:holders], 1):
            n = 8 if width == 0 else 0 if width == TEXT_LENGTH else width
            if n and (wanted is None or h in wanted):
                yield (block.begin, h, -1, *_value(file, width, shown[p : p + n]), False, True, number)
            p += n
    at += small
    _, at = varint(body, at)
    base, kind = at, chr(body[at])
    for h, (place, length) in _chains(block.tag, index, index_end - index_size - base).items():
        if wanted is not None and h not in wanted:
            continue
        size, start = varint(body, base + place)
        chain = body[start : base + place + length]
        chain = unpack(kind, chain, size) if size else chain
        width, p, i, seq = file.widths[h - 1], 0, 0, number << 40
        while p < len(chain):
            n, p = varint(chain, p)
            if width == 1:
                symbol = SYMBOLS[n >> 1 & 7] if n & 1 else str(n >> 1 & 1)
                i += n >> (4 if n & 1 else 2)
                got = symbol, symbol.encode(), None
            elif width == TEXT_LENGTH:
                i += n >> 1
                m, p = varint(chain, p)
                got = None, chain[p : p + m], None
                p += m
            else:
                i += n >> 1
                if width == 0:
                    m = 8
                    got = _value(file, 0, chain[p : p + 8])
                elif n & 1:
                    m = width
                    got = _value(file, width, chain[p : p + m])
                else:
                    m = (width + 7) // 8
                    text = bin(int.from_bytes(chain[p : p + m], "big") | 1 << 8 * m)[3 : 3 + width]
                    got = text, text.encode(), None
                p += m
            if i >= len(times):
                raise FormatError("a change after the last time of its block")
            yield (times[i], h, seq, *got, width == TEXT_LENGTH, False, number)
            seq += 1


def _value(file: File | Part, width: int, raw: bytes) -> tuple[str, bytes, float | None]:
    if width == 0:
        real = struct.unpack("<d" if file.head["endian_match"] else ">d", raw)[0]
        return f"{real:.16g}", raw, real
    return raw.decode("latin-1"), raw, None


# writing


def hierarchy_bytes(rows: Iterable[dict]) -> bytes:
    """Records (as of hierarchy_rows; numbers clamped as a reader expects) as bytes."""
    out = bytearray()
    name = lambda s: (s or "").encode("utf-8") + b"\0"
    for r in rows:
        if r["kind"] == "scope":
            out += bytes([SCOPE, r["type_code"] if 0 <= r["type_code"] < 22 else 0]) + name(r["name"]) + name(r.get("component"))
        elif r["kind"] == "upscope":
            out.append(UPSCOPE)
        elif r["kind"] == "attr":
            kind, sub = (r["type_code"], r["subtype_code"]) if 0 <= r["type_code"] < 4 else (0, 8)
            sub = sub if 0 <= sub < (9, 4, 16, 4)[kind] else 0
            stem = kind == 0 and sub in (4, 5)
            out += bytes([ATTR_BEGIN, kind, sub]) + (put_varint(r.get("arg_from_name") or 0) + b"\0" if stem else name((r["name"] or "").translate({10: " ", 13: " "}))) + put_varint(r.get("arg") or 0)
        elif r["kind"] == "attr_end":
            out.append(ATTR_END)
        else:
            length = 8 if r["type_code"] in REALS else r["length"]
            length = 0 if r["type_code"] == 21 else length * 3 + 2 if r["type_code"] == 18 else length
            out += bytes([r["type_code"], r.get("direction_code") or 0]) + name(r["name"]) + put_varint(length) + put_varint(r["handle"] if r["is_alias"] else 0)
    return bytes(out)


def block_start(tag: int, size: int) -> bytes:
    """What stands before a body of so many bytes."""
    return bytes([tag]) + struct.pack(">Q", size + 8)


def _block(tag: int, body: bytes) -> bytes:
    return block_start(tag, len(body)) + body


def _record(width: int, step: int, value: bytes) -> bytes:
    if width == 1:
        symbol = value.decode("latin-1").lower()
        if symbol in "01":
            return put_varint(step << 2 | int(symbol) << 1)
        return put_varint(step << 4 | max(SYMBOLS.find(symbol), 6 if symbol not in SYMBOLS else 0) << 1 | 1)
    if width == TEXT_LENGTH:
        return put_varint(step << 1) + put_varint(len(value)) + value
    if width and not value.strip(b"01"):
        n = (width + 7) // 8
        return put_varint(step << 1) + (int(value, 2) << 8 * n - width).to_bytes(n, "big")
    return put_varint(step << 1 | 1) + value


def value_block(begin: int, end: int, changes: list[tuple[int, int, bytes]], frame: list[bytes], widths: list[int], kind: str = "4") -> bytes:
    """A block of changes (time, handle, value bytes) that are in the order of time, with the state before them."""
    times = sorted({begin, end} | {t for t, _, _ in changes})
    number = {t: i for i, t in enumerate(times)}
    by_handle = sorted(((h, number[t], value) for t, h, value in changes), key=lambda c: c[:2])
    return assembled(begin, end, times, chains(by_handle, widths), b"".join(frame), len(widths), kind)


def chains(changes: Iterable[tuple[int, int, bytes]], widths: list[int]) -> Iterator[tuple[int, bytes]]:
    """Changes (handle, number of the time, value bytes) in the order of handle and time -> each handle with its chain."""
    holder, chain, last, width = None, bytearray(), 0, 0
    for h, i, value in changes:
        if h != holder:
            if holder is not None:
                yield holder, bytes(chain)
            holder, chain, last, width = h, bytearray(), 0, widths[h - 1]
        if width not in (0, TEXT_LENGTH) and len(value) != width or width == 0 and len(value) != 8:
            raise FormatError(f"a value of {len(value)} for a signal of {width or 8}")
        chain += _record(width, i - last, value)
        last = i
    if holder is not None:
        yield holder, bytes(chain)


def assembled(begin: int, end: int, times: list[int], chains_: Iterable[tuple[int, bytes]], state: bytes, handles: int, kind: str = "4") -> bytes:
    """A block of chains in the order of handles, over these times, with the state before them."""
    small = zlib.compress(state, 4)
    small = small if len(small) < len(state) else state
    body = struct.pack(">QQQ", begin, end, 0) + put_varint(len(state)) + put_varint(len(small)) + put_varint(handles) + small + put_varint(handles)
    data, index, place, known, target, after = bytearray(kind.encode()), bytearray(), 0, {}, None, 1
    for h, chain in chains_:
        if h > after:
            index += put_varint(h - after << 1)
        after = h + 1
        if chain in known:  # the same activity: an alias
            index += put_signed_varint((0 if known[chain] == target else -known[chain]) << 1 | 1)
            target = known[chain]
            continue
        known[chain] = h
        packed = pack(kind, chain) if len(chain) > 32 else chain
        index += put_signed_varint((len(data) - place) << 1 | 1)
        place = len(data)
        data += put_varint(len(chain)) + packed if len(packed) < len(chain) else put_varint(0) + chain
    if handles >= after:
        index += put_varint(handles + 1 - after << 1)
    steps = b"".join(put_varint(b - a) for a, b in zip([0, *times], times, strict=False))
    packed = zlib.compress(steps, 9)
    packed = packed if len(packed) < len(steps) else steps
    body += bytes(data) + bytes(index) + struct.pack(">Q", len(index)) + packed + struct.pack(">3Q", len(steps), len(packed), len(times))
    return _block(VALUES_ALIAS2, body)


def widths_of(hierarchy: list[dict]) -> list[int]:
    return [0 if r["type_code"] in REALS else TEXT_LENGTH if r["type_code"] == 21 else r["length"] for r in hierarchy if r["kind"] == "var" and not r["is_alias"]]


def first_frame(widths_: list[int]) -> list[bytes]:
    """The state before all changes."""
    return [struct.pack("<d", float("nan")) if w == 0 else b"" if w == TEXT_LENGTH else b"x" * w for w in widths_]


def header_block(meta: dict, hierarchy: list[dict], start: int, end: int, blocks: int) -> bytes:
    count, handles = (sum(r["kind"] == "var" and not (own and r["is_alias"]) for r in hierarchy) for own in (False, True))
    return counted_header(meta, sum(r["kind"] == "scope" for r in hierarchy), count, handles, start, end, blocks)


def counted_header(meta: dict, scopes: int, variables: int, handles: int, start: int, end: int, blocks: int) -> bytes:
    text = lambda s, n: (s or "").encode("utf-8")[: n - 1].ljust(n, b"\0")
    head = struct.pack(">QQ", start, end) + struct.pack("<d", _ENDIAN) + struct.pack(">5Q", 0, scopes, variables, handles, blocks)
    head += struct.pack("b", meta.get("timescale_exp", -9)) + text(meta.get("version", "tracemill"), _VERSION) + text(meta.get("date"), _DATE) + bytes([meta.get("file_type", 0)]) + struct.pack(">q", meta.get("timezero", 0))
    return _block(HEADER, head)


def toggle_steps(toggles: Iterable[tuple[int, bool]], last: int = 0) -> Iterator[bytes]:
    """Toggles in order, after one at the time last."""
    for t, active in toggles:
        if t < last:
            raise FormatError(f"recording goes on or off at {t} after {last}")
        yield bytes([active]) + put_varint(t - last)
        last = t


def blackout_block(toggles: list[tuple[int, bool]]) -> bytes:
    """Times of recording going off and on, in order."""
    return _block(BLACKOUT, put_varint(len(toggles)) + b"".join(toggle_steps(toggles)))


def geometry_block(widths_: bytes, count: int) -> bytes:
    """The widths of so many handles, as varints."""
    small = zlib.compress(widths_, 9)
    return _block(GEOMETRY, struct.pack(">QQ", len(widths_), count) + (small if len(small) < len(widths_) else widths_))


def hierarchy_block(raw: bytes, kind: str) -> bytes:
    return _block(HIERARCHY, struct.pack(">Q", len(raw)) + gzip.compress(raw, mtime=0)) if kind != "4" else _block(HIERARCHY_LZ4, struct.pack(">Q", len(raw)) + pack("4", raw))


def last_blocks(hierarchy: list[dict], blackouts: Iterable[tuple[int, bool]], kind: str) -> Iterator[bytes]:
    """What stands after the values: widths, blackouts, hierarchy."""
    own = widths_of(hierarchy)
    yield geometry_block(b"".join(map(put_varint, own)), len(own))
    toggles = list(blackouts)
    if toggles:
        yield blackout_block(toggles)
    yield hierarchy_block(hierarchy_bytes(hierarchy), kind)


def file_bytes(meta: dict, hierarchy: list[dict], changes: Iterable[tuple[int, int, bytes]], blackouts: Iterable[tuple[int, bool]] = (), kind: str = "4", block_changes_: int = 1_000_000) -> Iterator[bytes]:
    """A whole file for a trace that fits in memory: meta as of File.head, records, changes in the order of time, toggles. Times may not fall."""
    own = widths_of(hierarchy)
    frame = first_frame(own)
    blocks, held, begin, now = [], [], meta.get("start_time"), None
    for t, h, value in changes:
        if now is not None and t < now:
            raise FormatError(f"time {t} after {now}")
        if begin is None:
            begin = t
        if len(held) >= block_changes_ and t != now:
            blocks.append(value_block(begin, now, held, frame, own, kind))
            for _, x, v in held:
                frame[x - 1] = v if own[x - 1] != TEXT_LENGTH else b""
            begin, held = now, []
        held.append((t, h, value))
        now = t
    end = max(meta.get("end_time") or 0, now or 0, begin or 0)
    start = meta["start_time"] if meta.get("start_time") is not None else begin or 0
    blocks.append(value_block(begin or 0, end, held, frame, own, kind))
    yield header_block(meta, hierarchy, start, end, len(blocks))
    yield from blocks
    yield from last_blocks(hierarchy, blackouts, kind)
