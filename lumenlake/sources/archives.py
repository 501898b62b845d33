"""Entries of archives as a data source: directories of ZIP files by seeking, headers of TAR files as a stream, so that no archive is held in memory."""

from __future__ import annotations

import bz2
import gzip
import io
import lzma
import tarfile
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow
import pyarrow.fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

ENTRY = "archive string, name string, path string, size_bytes long, is_directory boolean, status string"
Entry = tuple[str, str | None, str | None, int | None, bool | None, str]
# Archives whose entries are listed, and those that need a program that is not at hand.
LISTED_ARCHIVES = ("zip", "tar", "tgz", "gz", "bz2", "tbz2", "xz", "txz", "jar", "cbz")
OTHER_ARCHIVES = ("7z", "rar", "iso", "cab")
#: Bytes of archives and number of archives that one partition reads, at most, unless one archive is larger.
PART_BYTES, PART_FILES = 256 << 20, 200
PACKERS = {"gz": gzip.open, "tgz": gzip.open, "bz2": bz2.open, "tbz2": bz2.open, "xz": lzma.open, "txz": lzma.open}
BROKEN = (tarfile.TarError, zipfile.BadZipFile, zlib.error, lzma.LZMAError, EOFError, OSError, RuntimeError, NotImplementedError)


class Seekable(io.RawIOBase):
    """A file of a file system as Python's modules want it: a place before its start is an OSError."""

    def __init__(self, file: pyarrow.NativeFile) -> None:
        self.file, self.length = file, file.size()

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.file.tell()

    def seek(self, offset: int, whence: int = io.SEEK_SET) -> int:
        to = offset + (0, self.file.tell(), self.length)[whence]
        if to < 0:
            raise OSError("a place before the file's start")
        self.file.seek(to)
        return to

    def readinto(self, into: memoryview) -> int:
        data = self.file.read(len(into))
        into[: len(data)] = data
        return len(data)


def _members(path: str, tar: tarfile.TarFile) -> Iterator[Entry]:
    while (e := tar.next()) is not None:
        yield path, e.name.rpartition("/")[2], e.name, e.size, e.isdir(), "ok"
        tar.members.clear()  # headers that were told are not kept


def entries(path: str, file) -> Iterator[Entry]:  # noqa: ANN001
    """The entries of an open archive that can seek; a row with a status and no name if it, or the rest of it, cannot be read.

    A packed file that is no archive inside is one entry, with its name without the ending; it is read through for its size, a piece at a time.
    """
    extension = path.rpartition(".")[2].lower()
    try:
        if zipfile.is_zipfile(file):
            with zipfile.ZipFile(file) as z:
                for e in z.infolist():
                    status = "encrypted" if e.flag_bits & 1 else "ok"
                    yield path, e.filename.rstrip("/").rpartition("/")[2], e.filename, e.file_size, e.is_dir(), status
            return
        file.seek(0)
        if extension not in PACKERS:
            with tarfile.open(fileobj=file, mode="r:") as t:  # contents are passed over by seeking
                yield from _members(path, t)
            return
        with PACKERS[extension](file) as unpacked:
            try:
                tar = tarfile.open(fileobj=unpacked, mode="r|")  # noqa: SIM115  closed below
            except tarfile.ReadError:
                tar = None
            if tar is not None:
                with tar:
                    yield from _members(path, tar)
                return
        file.seek(0)
        with PACKERS[extension](file) as unpacked:
            size = sum(len(part) for part in iter(lambda: unpacked.read(1 << 20), b""))
        name = path.rpartition("/")[2].rpartition(".")[0]
        yield path, name, name, size, False, "ok"
    except BROKEN:
        yield path, None, None, None, None, "unreadable"


class Part(InputPartition):
    """Some archives' paths."""

    def __init__(self, paths: list[str]) -> None:
        self.paths = paths


class ArchiveReader(DataSourceReader):
    """A partition for each group of archives below a root; the driver lists paths and sizes, as for any other file source."""

    def __init__(self, root: str) -> None:
        self.root = root

    def _system(self) -> tuple[pyarrow.fs.FileSystem, str, str]:
        uri = self.root.replace("file:/", "/", 1) if self.root.startswith("file:/") and not self.root.startswith("file://") else self.root
        system, path = pyarrow.fs.FileSystem.from_uri(uri)
        return system, path, "file:" if system.type_name == "local" else self.root[: -len(path)] if self.root.endswith(path) else ""

    def partitions(self) -> list[Part]:
        system, path, _ = self._system()
        found = system.get_file_info(pyarrow.fs.FileSelector(path, recursive=True))
        groups, held, size = [], [], 0
        for f in sorted((f for f in found if f.is_file and f.extension.lower() in LISTED_ARCHIVES + OTHER_ARCHIVES), key=lambda f: f.path):
            if held and (size + f.size > PART_BYTES or len(held) >= PART_FILES):
                groups.append(Part(held))
                held, size = [], 0
            held.append(f.path)
            size += f.size
        return [*groups, Part(held)]

    def read(self, partition: Part) -> Iterator[Entry]:
        system, _, scheme = self._system()
        for path in partition.paths:
            if path.rpartition(".")[2].lower() in OTHER_ARCHIVES:
                yield f"{scheme}{path}", None, None, None, None, "unsupported"
                continue
            with system.open_input_file(path) as opened, io.BufferedReader(Seekable(opened), 1 << 16) as file:
                for _, *rest in entries(path, file):
                    yield (f"{scheme}{path}", *rest)


class ArchiveSource(DataSource):
    """spark.read.format("archives").load(root), once registered."""

    @classmethod
    def name(cls) -> str:
        return "archives"

    def schema(self) -> str:
        return ENTRY

    def reader(self, schema) -> ArchiveReader:  # noqa: ANN001
        return ArchiveReader(self.options["path"])
