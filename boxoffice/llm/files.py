"""Binary files of named arrays in a folder that all executors share.

Sections follow each other on 8-byte borders; the last bytes give a JSON footer's place. On a shared
file system (no scheme, or ``file:``) they are memory-mapped; elsewhere pyarrow reads them.
"""

from __future__ import annotations

import json
import os
import uuid
from urllib.parse import urlsplit

import numpy as np
from pyarrow import fs

MAGIC = b"BOXARR01"


def local_path(path: str) -> str | None:
    parts = urlsplit(path)
    return parts.path if parts.scheme in ("", "file") else None


def open_output(path: str):
    """A stream for a new file; folders are made."""
    if (here := local_path(path)) is not None:
        os.makedirs(os.path.dirname(here), exist_ok=True)
        return open(here, "wb")
    system, name = fs.FileSystem.from_uri(path)
    system.create_dir(os.path.dirname(name), recursive=True)
    return system.open_output_stream(name)


def open_input(path: str):
    """A file that can seek and read."""
    if (here := local_path(path)) is not None:
        return open(here, "rb")
    system, name = fs.FileSystem.from_uri(path)
    return system.open_input_file(name)


def unique_name(folder: str, label: str) -> str:
    """Attempts of one task never share a file: those of lost attempts are not in any manifest."""
    return f"{folder}/{label}-{uuid.uuid4().hex}"


class Writer:
    """Writes sections as they come; ``close`` adds the footer."""

    def __init__(self, path: str):
        self.path, self.out, self.at, self.sections = path, open_output(path), 0, {}
        self._open = None

    def begin(self, name: str, dtype) -> None:
        self._open = name
        self.sections[name] = [self.at, 0, np.dtype(dtype).str]

    def append(self, values: np.ndarray) -> None:
        raw = np.ascontiguousarray(values).tobytes()
        self.out.write(raw)
        self.at += len(raw)
        self.sections[self._open][1] += len(values)

    def end(self) -> None:
        pad = -self.at % 8
        self.out.write(b"\0" * pad)
        self.at += pad

    def add(self, name: str, values: np.ndarray) -> None:
        self.begin(name, values.dtype)
        self.append(values)
        self.end()

    def add_parts(self, prefix: str, parts: dict[str, np.ndarray]) -> None:
        for name, values in parts.items():
            self.add(f"{prefix}.{name}", values)

    def close(self, **meta) -> None:
        footer = json.dumps({"sections": self.sections, "meta": meta}).encode()
        self.out.write(footer + len(footer).to_bytes(8, "little") + MAGIC)
        self.out.close()


class Reader:
    """Sections by name: memory-mapped, or read from the store when asked for."""

    def __init__(self, path: str):
        self.path = path
        here = local_path(path)
        self._map = np.memmap(here, np.uint8, "r").view(np.ndarray) if here is not None else None
        self._file = None if here is not None else open_input(path)
        size = len(self._map) if self._file is None else self._file.size()
        tail = self.bytes(size - 16, 16).tobytes()
        if tail[8:] != MAGIC:
            raise ValueError(f"{path} is not whole")
        length = int.from_bytes(tail[:8], "little")
        footer = json.loads(self.bytes(size - 16 - length, length).tobytes())
        self.sections, self.meta = footer["sections"], footer["meta"]

    def bytes(self, at: int, count: int) -> np.ndarray:
        if self._map is not None:
            return self._map[at : at + count]
        self._file.seek(at)
        return np.frombuffer(self._file.read(count), np.uint8)

    def get(self, name: str, at: int = 0, to: int | None = None) -> np.ndarray:
        start, count, kind = self.sections[name]
        to, dtype = count if to is None else to, np.dtype(kind)
        if to <= at:
            return np.zeros(0, dtype)
        return self.bytes(start + at * dtype.itemsize, (to - at) * dtype.itemsize).view(dtype)

    def parts(self, prefix: str) -> dict[str, np.ndarray]:
        return {name.removeprefix(f"{prefix}."): self.get(name) for name in self.sections if name.startswith(f"{prefix}.")}
