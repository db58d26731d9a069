"""A sink that writes one named CSV file of any size, in the order of the rows.

Each task writes its part beside the target; when all have, the driver joins the parts in order, as streams of bytes,
under another name, and gives the file its own name last. It never holds the rows. A job that fails leaves no file, and
an earlier one stays. Paths are those of `sources.tree`.

    df.orderBy("path").write.format("single_csv").mode("overwrite").option("bom", "true").save("out/predictions.csv")
"""

from __future__ import annotations

import csv
import io
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from corvane.sources.tree import located

CHUNK = 8 << 20


@dataclass
class Written(WriterCommitMessage):
    part: int
    path: str
    rows: int


class SingleCsvWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str], schema: StructType):
        self.target, self.bom, self.names = options["path"], options.get("bom", "true").lower() == "true", schema.names
        self.mark = uuid.uuid4().hex

    def _places(self) -> tuple[pafs.FileSystem, str, str]:
        fs, path = located(self.target)
        folder, _, name = path.rpartition("/")
        return fs, path, f"{folder}/.{name}.{self.mark}"

    @staticmethod
    def _line(values) -> str:
        out = io.StringIO()
        csv.writer(out, lineterminator="\n").writerow(values)
        return out.getvalue()

    def write(self, iterator: Iterator[Row]) -> Written:
        fs, _, parts = self._places()
        context = TaskContext.get()
        path = f"{parts}/{context.partitionId():09d}-{context.taskAttemptId()}"
        fs.create_dir(parts, recursive=True)
        rows = 0
        with fs.open_output_stream(path, compression=None) as out:
            held, size = io.StringIO(), 0
            lines = csv.writer(held, lineterminator="\n")
            for row in iterator:
                lines.writerow(row)
                rows += 1
                if held.tell() >= CHUNK:
                    out.write(held.getvalue().encode())
                    held.seek(0), held.truncate()
            out.write(held.getvalue().encode())
        return Written(context.partitionId(), path, rows)

    def commit(self, messages: list[Written | None]) -> None:
        fs, path, parts = self._places()
        fs.create_dir(parts, recursive=True)
        whole = f"{parts}/whole"
        with fs.open_output_stream(whole, compression=None) as out:
            out.write((b"\xef\xbb\xbf" if self.bom else b"") + self._line(self.names).encode())
            for m in sorted((m for m in messages if m and m.rows), key=lambda m: m.part):
                with fs.open_input_stream(m.path, compression=None) as part:
                    while chunk := part.read(CHUNK):
                        out.write(chunk)
        fs.move(whole, path)
        fs.delete_dir(parts)

    def abort(self, messages: list[Written | None]) -> None:
        fs, _, parts = self._places()
        if fs.get_file_info(parts).type == pafs.FileType.Directory:
            fs.delete_dir(parts)


class SingleCsv(DataSource):
    @classmethod
    def name(cls) -> str:
        return "single_csv"

    def writer(self, schema: StructType, overwrite: bool) -> SingleCsvWriter:
        return SingleCsvWriter(self.options, schema)


def write_single_csv(df: DataFrame, path: str, by: tuple[str, ...] | list[str] = (), bom: bool = True) -> None:
    df.sparkSession.dataSource.register(SingleCsv)
    (df.orderBy(*by) if by else df).write.format("single_csv").mode("overwrite").option("bom", str(bom).lower()).save(str(path))
