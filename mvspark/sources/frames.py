"""Frames of a stream of JPEGs by their byte ranges."""

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import types as T

FIRST, LAST = b"\xff\xd8", b"\xff\xd9"
#: A batch of frames is handed on when it holds so many bytes.
BATCH_BYTES = 1 << 24


def _state(data: bytes | None, length: int | None) -> str:
    if data is None:
        return "missing"
    if len(data) < length:
        return "short"
    return "whole" if data.startswith(FIRST) and data.endswith(LAST) and len(data) >= 4 else "damaged"


def read_frames(ranges: DataFrame, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """``ranges`` (path, offset, length and any other columns, as of byte_offsets() with the recordings' paths) with ``jpeg``, the bytes of each range, and ``state``:
    whole; damaged, if they don't start and end with the JPEG markers (a frame that was logged but not written shifts all later ones); short, if the file ends before;
    missing, if there is no such file or a value is null or negative. Columns of the result's names are replaced.

    Ranges are dealt and sorted by path and offset, so that a task reads on in few files and has one open at a time. The files' store must be one that pyarrow opens."""
    carried = ranges.drop("jpeg", "state")
    schema = T.StructType([*carried.schema.fields, T.StructField("jpeg", T.BinaryType()), T.StructField("state", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, file = None, None

        def read(path: str | None, offset: int | None, length: int | None) -> bytes | None:
            nonlocal now, file
            if path is None or offset is None or length is None or min(offset, length) < 0:
                return None
            if path != now:
                if file is not None:
                    file.close()
                now, file = path, None
                store, place = pa.fs.FileSystem.from_uri(path)
                if store.get_file_info(place).type == pa.fs.FileType.File:
                    file = store.open_input_file(place)
            return None if file is None else b"" if offset >= file.size() else file.read_at(min(length, file.size() - offset), offset)

        for batch in batches:
            start, data, held = 0, [], 0
            lengths = batch.column("length").to_pylist()
            for i, at in enumerate(zip(batch.column("path").to_pylist(), batch.column("offset").to_pylist(), lengths, strict=True), 1):
                data.append(read(*at))
                held += len(data[-1] or b"")
                if held >= batch_bytes or i == batch.num_rows:
                    states = [_state(d, n) for d, n in zip(data, lengths[start:i], strict=True)]
                    part = batch.slice(start, i - start)
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(data, pa.binary()), pa.array(states, pa.string())], names=[*part.schema.names, "jpeg", "state"])
                    start, data, held = i, [], 0

    return carried.repartitionByRange("path", "offset").sortWithinPartitions("path", "offset").mapInArrow(run, schema)
