"""A stream of recorded messages: text files of one message a line, a file a session."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

# Spark opens the source in processes of its own, which need not find this package: it goes by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Piece(InputPartition):
    """One recorded file."""

    def __init__(self, path: str) -> None:
        self.path = path


class RecordedReader(DataSourceStreamReader):
    """An offset is the name of the last file read: names rise with the order of recording, and a file is complete when it has its name."""

    def __init__(self, folder: str) -> None:
        self.folder, self.reached = folder, ""

    def _names(self, after: str) -> list[str]:
        system, path = fs.FileSystem.from_uri(self.folder)
        found = system.get_file_info(fs.FileSelector(path, allow_not_found=True))
        return sorted(f.base_name for f in found if f.type == fs.FileType.File and not f.base_name.startswith(("_", ".")) and f.base_name > after)

    def initialOffset(self) -> dict:
        return {"file": ""}

    def latestOffset(self) -> dict:
        self.reached = max(self._names(self.reached), default=self.reached)
        return {"file": self.reached}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [Piece(f"{self.folder.rstrip('/')}/{n}") for n in self._names(start["file"]) if n <= end["file"]]

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        system, path = fs.FileSystem.from_uri(partition.path)
        session = partition.path.rpartition("/")[2].rpartition(".")[0] or partition.path.rpartition("/")[2]
        with system.open_input_stream(path) as stream:
            index, left = 0, b""
            while block := stream.read(1 << 20):
                *lines, left = (left + block).split(b"\n")
                if lines:
                    yield self._batch(session, index, lines)
                    index += len(lines)
            if left:
                yield self._batch(session, index, [left])

    def _batch(self, session: str, first: int, lines: list[bytes]) -> pa.RecordBatch:
        text = pa.array([x.decode("utf-8", "replace") for x in lines], pa.string())
        return pa.RecordBatch.from_arrays([pa.array([session] * len(lines)), pa.array(range(first, first + len(lines)), pa.int64()), text], names=["session_id", "message_index", "raw"])

    def commit(self, end: dict) -> None:
        pass


class RecordedMessages(DataSource):
    """``spark.readStream.format("recorded_messages").option("path", folder)``: session_id, message_index, raw.

    Files are sessions, read in order of their names, each once; a message's index
    is its line. A new file must have a name after all read before. A query that
    starts again from its checkpoint goes on after the last file that it
    committed.
    """

    @classmethod
    def name(cls) -> str:
        return "recorded_messages"

    def schema(self) -> str:
        return "session_id string, message_index long, raw string"

    def streamReader(self, schema) -> RecordedReader:
        return RecordedReader(self.options["path"])
