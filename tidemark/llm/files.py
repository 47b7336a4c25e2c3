"""Byte files in the shared folder, written and read inside tasks through pyarrow's file systems (file, hdfs, s3, gs).

Writers name a file after the attempt that writes it and return index rows; Spark commits those rows once.  A lost or
repeated attempt leaves a file that no index row names, so readers never see it.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator


def open_folder(uri: str):
    """File system and path of a folder URI; plain paths and ``file:/x`` count as local."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" not in uri:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


class Appender:
    """Appends blobs to files of one task and says where each went; a file is closed once it holds ``limit`` bytes."""

    def __init__(self, folder: str, label: str, suffix: str, limit: int, head: bytes = b""):
        self.fs, self.path = open_folder(folder)
        self.fs.create_dir(self.path, recursive=True)
        self.stem, self.suffix, self.limit, self.head = f"{label}-{uuid.uuid4().hex}", suffix, limit, head
        self.count, self.out, self.name, self.at = 0, None, "", 0

    def add(self, blob: bytes) -> tuple[str, int]:
        if self.out is None or self.at >= self.limit:
            self.close()
            self.name, self.at = f"{self.stem}-{self.count:05d}{self.suffix}", len(self.head)
            self.out, self.count = self.fs.open_output_stream(f"{self.path}/{self.name}", compression=None), self.count + 1
            self.out.write(self.head)
        at = self.at
        self.out.write(blob)
        self.at += len(blob)
        return self.name, at

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out = None


def read_ranges(folder: str, wanted: Iterable[tuple[str, int, int]], gap: int = 64 << 10, most: int = 4 << 20) -> Iterator[bytes]:
    """The bytes of each (file, offset, length), in the order given.

    Neighbouring ranges of one file in rising order are fetched by one read, over holes of up to ``gap`` bytes and up to
    ``most`` bytes at a time (a longer record is one read of its own).
    """
    fs, path = open_folder(folder)
    name, source, held = None, None, []

    def fetch():
        if held:
            start, stop = held[0][0], held[-1][0] + held[-1][1]
            source.seek(start)
            block = source.read(stop - start)
            if len(block) != stop - start:
                raise OSError(f"{name}: {stop - start} bytes expected at {start}, {len(block)} read")
            for at, size in held:
                yield block[at - start : at - start + size]
            held.clear()

    try:
        for file, at, size in wanted:
            if file != name:
                yield from fetch()
                if source is not None:
                    source.close()
                name, source = file, fs.open_input_file(f"{path}/{file}")
            elif held:
                end = held[-1][0] + held[-1][1]
                if at < end or at - end > gap or at + size - held[0][0] > most:
                    yield from fetch()
            held.append((at, size))
        yield from fetch()
    finally:
        if source is not None:
            source.close()
