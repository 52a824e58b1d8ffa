"""A trace file that grows while a producer runs: each finished block can be read at once, by the live source too."""

from __future__ import annotations

import gzip
import os
import struct

from . import blocks as B
from .records import Records


class LimitError(ValueError):
    """The dump has reached its size limit."""


class LiveWriter:
    """Takes times, values and toggles in order. Widths and hierarchy are written first, the header's times and counts on closing.

    kind: 4 (LZ4) or Z (zlib). A block ends when it has block_changes changes and the time moves on, or at the next time after
    flush() if it has two times or more. Beyond size_limit bytes of blocks no more is taken (LimitError).
    """

    def __init__(self, path: str, records: Records, meta: dict | None = None, kind: str = "4", block_changes: int = 1_000_000, size_limit: int | None = None):
        self.path, self.rows, self.meta, self.kind = path, records.rows, dict(meta or {}), kind
        self.block_changes, self.size_limit = block_changes, size_limit
        self.widths = B.widths_of(self.rows)
        self.frame = B.first_frame(self.widths)
        self.start: int | None = None
        self.now = self.begin = 0
        self.count = self.size = 0
        self.held: list[tuple[int, int, bytes]] = []
        self.toggles: list[tuple[int, bool]] = []
        self.wanted = self.closed = False
        self.f = open(path, "wb")  # noqa: SIM115  the file is open as long as the producer runs
        self.f.write(B.header_block(self.meta, self.rows, 0, 0, 0))
        for block in B.last_blocks(self.rows, (), kind):
            self.f.write(block)
        self.f.flush()

    def __enter__(self) -> LiveWriter:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def _open(self) -> None:
        if self.closed:
            raise ValueError("the file is closed")
        if self.size_limit is not None and self.size >= self.size_limit:
            raise LimitError(f"{self.size} bytes of blocks")

    def time(self, t: int) -> None:
        """Times do not fall. The first one begins the trace, but at 0 if there is a value already."""
        self._open()
        if self.start is None:
            self.start = 0 if self.held else t
            self.now = self.begin = self.start
        if t < self.now:
            raise B.FormatError(f"time {t} after {self.now}")
        if t != self.now and (len(self.held) >= self.block_changes or self.wanted and len({x for x, *_ in self.held} | {self.begin, self.now}) > 1):
            self._finish()
        self.now = t

    def value(self, handle: int, value: bytes | str | int | float | list[int]) -> None:
        """A value of a handle now: symbols, a whole number or words of 32 bits, the least first, for bits; a float for a real; text or bytes."""
        self._open()
        width = self.widths[handle - 1]
        if isinstance(value, list):
            value = sum((w & 0xFFFFFFFF) << 32 * i for i, w in enumerate(value))
        if width == 0 and isinstance(value, int | float):
            value = struct.pack("<d", value)
        elif isinstance(value, int):
            value = f"{value & (1 << width) - 1:0{width}b}"
        raw = value.encode("utf-8") if isinstance(value, str) else value
        if width != B.TEXT_LENGTH and len(raw) != (width or 8):
            raise B.FormatError(f"a value of {len(raw)} for a signal of {width or 8}")
        self.held.append((self.now, handle, raw))

    def record(self, active: bool) -> None:
        """Recording goes off or on now; the same again is nothing."""
        self._open()
        if active != (self.toggles[-1][1] if self.toggles else True):
            self.toggles.append((self.now, active))

    def flush(self) -> None:
        """Asks for the end of the block at the next time."""
        self.wanted = True

    def _finish(self) -> None:
        block = B.value_block(self.begin, self.now, self.held, self.frame, self.widths, self.kind)
        self.f.write(block)
        self.f.flush()
        for _, h, v in self.held:
            self.frame[h - 1] = v if self.widths[h - 1] != B.TEXT_LENGTH else b""
        self.count, self.size, self.begin, self.held, self.wanted = self.count + 1, self.size + len(block), self.now, [], False

    def close(self, repack: bool = False) -> None:
        """Ends the file; repack puts all of it into one gzip wrapper."""
        if self.closed:
            return
        if self.held or not self.count:
            self._finish()
        self.closed = True
        if self.toggles:
            self.f.write(B.blackout_block(self.toggles))
        self.f.seek(0)
        self.f.write(B.header_block(self.meta, self.rows, self.start or 0, self.now, self.count))
        self.f.close()
        if repack:
            with open(self.path, "rb") as f, open(f"{self.path}.part", "wb") as out:
                out.write(bytes(17))
                with gzip.GzipFile(fileobj=out, mode="wb", mtime=0) as z:
                    while some := f.read(1 << 20):
                        z.write(some)
                size = out.tell()
                out.seek(0)
                out.write(bytes([B.WRAPPER]) + struct.pack(">QQ", size - 1, os.path.getsize(self.path)))
            os.replace(f"{self.path}.part", self.path)
