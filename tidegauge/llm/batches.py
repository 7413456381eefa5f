"""Stretches of a table as compressed files in the shared folder.

Operators that ask and answer in rounds read their texts once in each round. Here a
table is cut into batches of bounded bytes where it is scanned; each is written
once and read by its number, so that only what the rounds exchange is shuffled.
A task writes batches under numbers of its own and reports them when it is
complete; only reported numbers are read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame

from .scratch import Scratch
from .textvec import slices


class Batches:
    """The batches of one table, below the folder ``name`` of ``scratch``."""

    def __init__(self, scratch: Scratch, name: str):
        self.folder = scratch.path(name)

    def _file(self, b: int) -> tuple[fs.FileSystem, str]:
        store, path = fs.FileSystem.from_uri(self.folder)
        return store, f"{path}/{b:016x}.arrow"

    def put(self, held: list[pa.RecordBatch]) -> int:
        """Write one batch; its number."""
        b = uuid.uuid4().int >> 65
        store, path = self._file(b)
        store.create_dir(path.rpartition("/")[0], recursive=True)
        with store.open_output_stream(path) as raw, pa.ipc.new_stream(raw, held[0].schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))) as out:
            out.write_table(pa.Table.from_batches(held).combine_chunks())
        return b

    def write(self, rows: DataFrame, text: str, most: int) -> DataFrame:
        """(b): the numbers of the batches, of about ``most`` bytes of the column ``text`` or one row; not written yet."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, size, made = [], 0, []
            for batch in slices(batches, text, most):
                held.append(batch)
                size += batch.column(text).nbytes + 64 * batch.num_rows
                if size >= most:
                    made.append(self.put(held))
                    held, size = [], 0
            if held:
                made.append(self.put(held))
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.int64())], names=["b"])

        return rows.mapInArrow(run, "b long")

    def read(self, of: pa.Table | int) -> pa.Table:
        """The rows of a batch, named by its number or by the only row of a table."""
        store, path = self._file(of if isinstance(of, int) else of.column("b")[0].as_py())
        with store.open_input_stream(path) as raw, pa.ipc.open_stream(raw) as got:
            return got.read_all().combine_chunks()


def dealt(files: DataFrame):
    """The batches, each a group of its own, dealt to about as many tasks."""
    return files.repartition(max(1, 2 * files.count()), "b").groupBy("b")
