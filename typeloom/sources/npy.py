"""Python data source ``npy``: rows of ``.npy`` shards or header-less arrays.

Options: ``path`` (file or folder), ``pattern`` (default ``*.npy``), ``raw`` (``true`` for files without a header),
``dtype`` (of raw files), ``width`` (values in a row of raw files). One partition a file. Columns: ``row_id bigint`` (over all
files in name order), ``file string``, ``v array<bigint|double>``.
"""

from __future__ import annotations

import fnmatch
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

BATCH = 4096


class Shard(InputPartition):
    def __init__(self, path: str, first: int):
        self.path, self.first = path, first


def listed(path: str, pattern: str) -> list[str]:
    if os.path.isfile(path):
        return [path]
    return [os.path.join(path, f) for f in sorted(os.listdir(path)) if fnmatch.fnmatch(f, pattern)]


class NpySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        files = listed(self.options["path"], self.options.get("pattern", "*.npy"))
        kind = np.dtype(self.options.get("dtype", "uint8"))
        if self.options.get("raw", "false") != "true" and files:
            kind = np.load(files[0], mmap_mode="r").dtype
        return f"row_id bigint, file string, v array<{'double' if kind.kind == 'f' else 'bigint'}>"

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return NpyReader(self.options)


class NpyReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = dict(options)

    def _open(self, path: str) -> np.ndarray:
        if self.options.get("raw", "false") == "true":
            flat = np.memmap(path, np.dtype(self.options.get("dtype", "uint8")), "r") if os.path.getsize(path) else np.zeros(0)
            width = int(self.options.get("width", "1"))
            if len(flat) % width:
                raise ValueError(f"{path}: {len(flat)} values are no whole rows of {width}")
            return flat.reshape(-1, width)
        array = np.load(path, mmap_mode="r")
        return array.reshape(len(array), -1)

    def partitions(self) -> list[InputPartition]:
        out, first = [], 0
        for path in listed(self.options["path"], self.options.get("pattern", "*.npy")):
            out.append(Shard(path, first))
            first += len(self._open(path))
        return out

    def read(self, shard: Shard) -> Iterator[pa.RecordBatch]:
        array = self._open(shard.path)
        kind = np.float64 if array.dtype.kind == "f" else np.int64
        for at in range(0, len(array), BATCH):
            part = np.asarray(array[at : at + BATCH]).astype(kind)  # 64-bit masks keep their bits
            offsets = pa.array(np.arange(len(part) + 1, dtype=np.int32) * part.shape[1])
            ids = pa.array(np.arange(at, at + len(part), dtype=np.int64) + shard.first)
            files = pa.array([os.path.basename(shard.path)] * len(part))
            yield pa.RecordBatch.from_arrays([ids, files, pa.ListArray.from_arrays(offsets, pa.array(part.ravel()))], ["row_id", "file", "v"])
