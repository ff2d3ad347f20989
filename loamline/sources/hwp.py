"""HWP 5 files: the compound file around the document, and the records of its sections.

A compound file is a small disk in a file: sectors chained by allocation tables, a directory tree, and a mini stream for small files.
The sections of a document are streams of records, deflated if the header says so; of these the paragraph texts are read, and the
cells of tables, which are lists of paragraphs below a table control.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

MAGIC = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"
END, FREE = 0xFFFFFFFE, 0xFFFFFFFF
#: Fixed values of the format: record tags (paragraph text, list header, table), and the control codes that take eight units of text.
PARA_TEXT, LIST_HEADER, TABLE = 67, 72, 77
LONG_CONTROLS = frozenset((1, 2, 3, 4, 5, 6, 7, 8, 9, 11, 12, 14, 15, 16, 17, 18, 19, 20, 21, 22, 23))
MOST_BYTES = 1 << 28


class Damaged(ValueError):
    """What keeps a file from being read."""


class CompoundFile:
    """Streams by path (names joined by slashes)."""

    def __init__(self, data: bytes):
        if len(data) < 512 or data[:8] != MAGIC:
            raise Damaged("not a compound file")
        major, _, shift, mini_shift = struct.unpack_from("<HHHH", data, 26)
        self.size, self.mini_size, self.data = 1 << shift, 1 << mini_shift, data
        if shift not in (9, 12) or mini_shift > shift:
            raise Damaged("unknown sector size")
        first_dir, _, self.cutoff, first_mini, _, first_difat, n_difat = struct.unpack_from("<IIIIIII", data, 48)
        difat = list(struct.unpack_from("<109I", data, 76))
        seen: set[int] = set()
        while first_difat < END - 1 and n_difat and first_difat not in seen:
            seen.add(first_difat)
            *more, first_difat = struct.unpack(f"<{self.size // 4}I", self._sector(first_difat))
            difat += more
        self.fat = [x for n in difat if n < END - 1 for x in struct.unpack(f"<{self.size // 4}I", self._sector(n))]
        directory = self._chain(first_dir)
        self.entries = [self._entry(directory[i : i + 128], major) for i in range(0, len(directory) - 127, 128)]
        if not self.entries:
            raise Damaged("no directory")
        mini = self._chain(first_mini) if first_mini < END - 1 else b""
        self.mini_fat = struct.unpack(f"<{len(mini) // 4}I", mini)
        self.mini = self._chain(self.entries[0][4])[: self.entries[0][5]] if self.entries[0][4] < END - 1 else b""
        self.streams = dict(self._walk(self.entries[0][3], "", set()))

    def _sector(self, n: int) -> bytes:
        at = (n + 1) * self.size
        found = self.data[at : at + self.size]
        if not found:
            raise Damaged("a sector lies beyond the file")
        return found.ljust(self.size, b"\0")

    def _chain(self, n: int) -> bytes:
        out, seen = [], set()
        while n < END - 1:
            if n in seen or n >= len(self.fat):
                raise Damaged("a chain of sectors does not end")
            seen.add(n)
            out.append(self._sector(n))
            n = self.fat[n]
        return b"".join(out)

    @staticmethod
    def _entry(raw: bytes, major: int) -> tuple:
        """Name, type, siblings, child, first sector and size."""
        length = struct.unpack_from("<H", raw, 64)[0]
        left, right, child = struct.unpack_from("<III", raw, 68)
        first, size = struct.unpack_from("<IQ", raw, 116)
        return raw[: max(0, min(64, length) - 2)].decode("utf-16-le", "replace"), raw[66], (left, right), child, first, size & 0xFFFFFFFF if major == 3 else size

    def _walk(self, n: int, above: str, seen: set[int]) -> Iterator[tuple[str, int]]:
        todo = [(n, above)]
        while todo:
            n, above = todo.pop()
            if n >= len(self.entries) or n in seen:
                continue
            seen.add(n)
            name, kind, siblings, child, _, _ = self.entries[n]
            todo += [(s, above) for s in siblings]
            if kind == 1:
                todo.append((child, f"{above}{name}/"))
            elif kind == 2:
                yield above + name, n

    def read(self, path: str) -> bytes:
        _, _, _, _, first, size = self.entries[self.streams[path]]
        if size >= self.cutoff:
            return self._chain(first)[:size]
        out, seen = [], set()
        while first < END - 1:
            if first in seen or first >= len(self.mini_fat):
                raise Damaged("a chain of small sectors does not end")
            seen.add(first)
            out.append(self.mini[first * self.mini_size : (first + 1) * self.mini_size])
            first = self.mini_fat[first]
        return b"".join(out)[:size]


def records(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(tag, level, body) of each record; a size of 4095 means that the true one follows."""
    at = 0
    while at + 4 <= len(data):
        (head,) = struct.unpack_from("<I", data, at)
        at, size = at + 4, head >> 20
        if size == 0xFFF:
            if at + 4 > len(data):
                raise Damaged("a record is cut")
            (size,) = struct.unpack_from("<I", data, at)
            at += 4
        if at + size > len(data):
            raise Damaged("a record is cut")
        yield head & 0x3FF, (head >> 10) & 0x3FF, data[at : at + size]
        at += size
    if any(data[at:]):
        raise Damaged("a record is cut")


def paragraph(body: bytes) -> str:
    """A paragraph's text: line breaks, tabs, hyphens and fixed spaces become their characters, other controls go."""
    out, i = [], 0
    units = struct.unpack(f"<{len(body) // 2}H", body[: len(body) // 2 * 2])
    while i < len(units):
        u = units[i]
        if u >= 32:
            out.append(u)
        elif u == 9:
            out.append(9)
        elif u == 10:
            out.append(10)
        elif u in (24, 30, 31):
            out.append(ord("-") if u == 24 else ord(" "))
        i += 8 if u in LONG_CONTROLS else 1
    return struct.pack(f"<{len(out)}H", *out).decode("utf-16-le", "replace")


def section(data: bytes, markdown: Callable[[list[list[str]]], str]) -> str:
    """The text of a section: paragraphs by a blank line, a table (its cells given to markdown) where it stands."""
    parts: list[str] = []
    tables: list[dict] = []  # open tables, the innermost last: level, columns, cells
    for tag, level, body in records(data):
        while tables and level < tables[-1]["level"]:
            text = _closed(tables.pop(), markdown)
            (tables[-1]["cells"][-1] if tables and tables[-1]["cells"] else parts).append(text)
        if tag == TABLE:
            rows, columns = struct.unpack_from("<HH", body, 4) if len(body) >= 8 else (0, 0)
            tables.append({"level": level, "columns": max(1, columns), "cells": []})
        elif tag == LIST_HEADER and tables and level == tables[-1]["level"]:
            tables[-1]["cells"].append([])
        elif tag == PARA_TEXT:
            text = paragraph(body)
            if tables and tables[-1]["cells"]:
                tables[-1]["cells"][-1].append(text.rstrip("\n"))
            elif text.strip():
                parts.append(text.strip("\n"))
    while tables:
        text = _closed(tables.pop(), markdown)
        (tables[-1]["cells"][-1] if tables and tables[-1]["cells"] else parts).append(text)
    return "\n\n".join(parts)


def _closed(t: dict, markdown: Callable[[list[list[str]]], str]) -> str:
    cells = ["\n".join(c) for c in t["cells"]]
    return markdown([cells[i : i + t["columns"]] for i in range(0, len(cells), t["columns"])])


def pages(data: bytes, markdown: Callable[[list[list[str]]], str]) -> list[tuple[int, str]]:
    """(number from 0, text) of each section of a document; protected ones are refused."""
    f = CompoundFile(data)
    if "FileHeader" not in f.streams:
        raise Damaged("no HWP document")
    header = f.read("FileHeader")
    flags = struct.unpack_from("<I", header.ljust(40, b"\0"), 36)[0]
    if not header.startswith(b"HWP Document File") or flags & 0b10:
        raise Damaged("password-protected" if flags & 0b10 else "no HWP document")
    names = sorted((n for n in f.streams if n.startswith("BodyText/Section") and n[16:].isdigit()), key=lambda n: int(n[16:]))
    out = []
    for i, name in enumerate(names):
        body = f.read(name)
        if flags & 1:
            d = zlib.decompressobj(-15)
            body = d.decompress(body, MOST_BYTES)
            if d.unconsumed_tail:
                raise Damaged("too large when unpacked")
        out.append((i, section(body, markdown)))
    if not out:
        raise Damaged("no sections")
    return out
