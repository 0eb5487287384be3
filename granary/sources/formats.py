"""Spark data sources for .npy matrices and FASTA files: executors read byte ranges by themselves.

    spark.dataSource.register(NpyDataSource)
    spark.read.format("npy").load("/data/matrix.npy")        # position long, embedding array<...>
    spark.read.format("fasta").load("/data/sequences.fasta")  # id, description, sequence

The driver reads a file's header or size only. Paths without a scheme are files that every executor sees; other schemes go
through pyarrow's file systems.
"""

from __future__ import annotations

import ast
import os
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SPLIT_BYTES, CHUNK = 32 << 20, 1 << 20


def open_input(path: str):
    """A seekable binary stream, and its length."""
    if "://" not in path or path.startswith("file:"):
        local = path.removeprefix("file://").removeprefix("file:")
        return open(local, "rb"), os.path.getsize(local)
    from pyarrow import fs

    system, inside = fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1).replace("s3n://", "s3://", 1))
    return system.open_input_file(inside), system.get_file_info(inside).size


@dataclass
class Range(InputPartition):
    """Bytes [start, end) of a file; first: the number of the first row there."""

    start: int
    end: int
    first: int = 0


def npy_header(stream) -> tuple[str, tuple[int, ...], int]:
    """(dtype, shape, bytes before the numbers) of a matrix in row order."""
    magic = stream.read(8)
    if magic[:6] != b"\x93NUMPY":
        raise ValueError("not an .npy file")
    size = 2 if magic[6] == 1 else 4
    length = int.from_bytes(stream.read(size), "little")
    told = ast.literal_eval(stream.read(length).decode("latin1"))
    if told["fortran_order"] and len(told["shape"]) > 1:
        raise ValueError("a matrix in column order can't be read by rows")
    return told["descr"], told["shape"], 8 + size + length


#: Element types that are read, by numpy's kind and size.
ELEMENTS = {"f4": "float", "f8": "double", "f2": "float", "i1": "int", "i2": "int", "i4": "int", "i8": "long", "u1": "int", "u2": "int", "u4": "long"}


class NpyReader(DataSourceReader):
    def __init__(self, path: str, split_bytes: int):
        self.path = path
        stream, _ = open_input(path)
        with stream:
            self.dtype, shape, self.offset = npy_header(stream)
        if len(shape) != 2:
            raise ValueError(f"{path} holds {len(shape)} dimensions, not 2")
        if self.dtype[1:] not in ELEMENTS:
            raise ValueError(f"{path} holds {self.dtype}, which isn't read")
        self.rows, self.dim = shape
        self.width = self.dim * int(self.dtype[2:])
        self.step = max(1, split_bytes // max(1, self.width))

    def partitions(self) -> list[Range]:
        return [Range(at, min(self.rows, at + self.step), at) for at in range(0, self.rows, self.step)]

    def read(self, part: Range) -> Iterator:
        import numpy as np
        import pyarrow as pa

        to = {"float": np.float32, "double": np.float64, "int": np.int32, "long": np.int64}[ELEMENTS[self.dtype[1:]]]
        stream, _ = open_input(self.path)
        with stream:
            stream.seek(self.offset + part.start * self.width)
            batch = max(1, CHUNK // max(1, self.width))
            for at in range(part.start, part.end, batch):
                n = min(batch, part.end - at)
                data = stream.read(n * self.width)
                if len(data) < n * self.width:
                    raise ValueError(f"{self.path} ends before row {at + n}")
                flat = np.frombuffer(data, dtype=self.dtype).astype(to)
                lists = pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * self.dim, pa.array(flat))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + n, dtype=np.int64)), lists], ["position", "embedding"])


class NpyDataSource(DataSource):
    """Rows of a 2-D .npy matrix with their positions. Option splitBytes: bytes of a partition."""

    @classmethod
    def name(cls) -> str:
        return "npy"

    def _reader(self) -> NpyReader:
        return NpyReader(self.options["path"], int(self.options.get("splitbytes", SPLIT_BYTES)))

    def schema(self) -> str:
        return f"position long, embedding array<{ELEMENTS[self._reader().dtype[1:]]}>"

    def reader(self, schema) -> DataSourceReader:
        return self._reader()


class FastaReader(DataSourceReader):
    """A record belongs to the range that its > lies in; a range's reader goes on to the end of its last record."""

    def __init__(self, path: str, split_bytes: int):
        self.path, self.step = path, split_bytes

    def partitions(self) -> list[Range]:
        stream, size = open_input(self.path)
        stream.close()
        return [Range(at, min(size, at + self.step)) for at in range(0, size, self.step)]

    def read(self, part: Range) -> Iterator[tuple]:
        stream, _ = open_input(self.path)
        with stream:
            at = part.start
            if at:  # a line that began before this range is the range before's
                stream.seek(at - 1)
                at += len(stream.readline()) - 1
            head, letters = None, []
            for line in iter(stream.readline, b""):
                start, at = at, at + len(line)
                if line.startswith(b">"):
                    if head is not None:
                        yield self._record(head, letters)
                    head, letters = None, []
                    if start >= part.end:
                        return
                    head = line[1:]
                elif head is not None:
                    letters.append(line.strip())
                elif start >= part.end:
                    return
            if head is not None:
                yield self._record(head, letters)

    def _record(self, head: bytes, letters: list[bytes]) -> tuple:
        name, _, rest = head.decode().strip().partition(" ")
        return name, rest.strip() or None, b"".join(letters).decode()


class FastaDataSource(DataSource):
    """Records of a FASTA file: id (up to the first blank), description, sequence. Option splitBytes: bytes of a partition."""

    @classmethod
    def name(cls) -> str:
        return "fasta"

    def schema(self) -> str:
        return "id string, description string, sequence string"

    def reader(self, schema) -> DataSourceReader:
        return FastaReader(self.options["path"], int(self.options.get("splitbytes", SPLIT_BYTES)))
