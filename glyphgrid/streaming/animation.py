"""Frames from bytes that arrive in chunks of any size, and the same as a Structured Streaming operator.

A stream is, little-endian:

    magic ``FRS1``, canvas width u32, height u32
    for each frame: flags u8 (1: disposes, 2: last), duration u32, x, y, w, h u32, payload bytes u32, payload

A frame is given out when its last byte is there. What is read is taken back if the rest of a step hasn't
arrived, so the result doesn't depend on how the bytes are cut.
"""

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

MAGIC, HEAD, FRAME = b"FRS1", struct.Struct("<4sII"), struct.Struct("<B6I")
HEADER, FRAME_HEADER, PAYLOAD, DONE, FAILED = range(5)
COLUMNS = ["frame_idx", "duration_ms", "disposes", "x", "y", "w", "h", "num_bytes"]
OUTPUT = "anim_id long, frame_idx long, duration_ms long, disposes boolean, x long, y long, w long, h long, num_bytes long"
STATE = "stage int, frame_idx long, width long, height long, held binary, next_seq long, waiting binary"


class Source:
    """Bytes that grow. Reads are kept apart until they are committed, or taken back."""

    def __init__(self, held: bytes = b""):
        self._held, self._from, self._read = bytes(held), 0, 0

    def append(self, data: bytes) -> None:
        ahead = self._read - self._from
        self._held, self._from, self._read = self._held[self._from :] + bytes(data), 0, ahead

    def try_read(self, n: int) -> bytes | None:
        """The next n bytes, or None as long as there are fewer."""
        if len(self._held) - self._read < n:
            return None
        out = self._held[self._read : self._read + n]
        self._read += n
        return out

    def commit(self) -> None:
        """What is read goes with the next bytes that come, so that a long rest isn't copied for each step."""
        self._from = self._read

    def take_back(self) -> None:
        self._read = self._from

    @property
    def held(self) -> bytes:
        return self._held[self._from :]


class Reader:
    """The stages of a stream. Its state is a few numbers and the bytes that aren't committed."""

    def __init__(self, stage: int = HEADER, frame_idx: int = 0, width: int = 0, height: int = 0, held: bytes = b""):
        self.stage, self.frame_idx, self.width, self.height, self._source = stage, frame_idx, width, height, Source(held)

    @property
    def held(self) -> bytes:
        return self._source.held

    def feed(self, data: bytes) -> Iterator[tuple]:
        """The frames that these bytes complete."""
        self._source.append(data)
        while self.stage not in (DONE, FAILED):
            found = self._step()
            if found is None:
                self._source.take_back()
                return
            self._source.commit()
            if found:
                yield found

    def _step(self) -> tuple | None:
        """None if bytes are missing; a frame if it is complete; else the empty tuple."""
        if self.stage == HEADER:
            head = self._source.try_read(HEAD.size)
            if head is None:
                return None
            magic, self.width, self.height = HEAD.unpack(head)
            self.stage = FRAME_HEADER if magic == MAGIC and self.width and self.height else FAILED
            return ()
        head = self._source.try_read(FRAME.size)
        if head is None:
            return None
        flags, duration, x, y, w, h, size = FRAME.unpack(head)
        inside = x + w <= self.width and y + h <= self.height
        if not inside or (self.frame_idx == 0 and not flags & 1) or (flags & 2 and not duration):
            self.stage = FAILED
            return ()
        if self._source.try_read(size) is None:
            return None
        frame = (self.frame_idx, duration, bool(flags & 1), x, y, w, h, size)
        self.frame_idx += 1
        if flags & 2:
            self.stage = DONE
        return frame


def encoded(frames: list[tuple], width: int, height: int) -> bytes:
    """frames as (duration, disposes, x, y, w, h, payload)."""
    out = [HEAD.pack(MAGIC, width, height)]
    for k, (duration, disposes, x, y, w, h, payload) in enumerate(frames):
        out += [FRAME.pack(disposes + 2 * (k == len(frames) - 1), duration, x, y, w, h, len(payload)), payload]
    return b"".join(out)


def streams(frames: DataFrame, width: int, height: int) -> DataFrame:
    """frames of animations to (anim_id, content), with zeros as payload. The last frame lasts 1 ms at least."""

    def write(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("frame_idx")
        rows = [(int(r.duration_ms), bool(r.disposes), int(r.x), int(r.y), int(r.w), int(r.h), bytes(int(r.num_bytes))) for r in f.itertuples(index=False)]
        rows[-1] = (max(1, rows[-1][0]), *rows[-1][1:])
        return pd.DataFrame({"anim_id": f["anim_id"].iloc[:1], "content": [encoded(rows, width, height)]})

    return frames.groupBy("anim_id").applyInPandas(write, "anim_id long, content binary")


def chunks(contents: DataFrame, size: int) -> DataFrame:
    """(anim_id, seq, bytes): each content cut into pieces of so many bytes."""
    n = F.ceil(F.octet_length("content") / size).cast("int")
    rows = contents.filter(F.octet_length("content") > 0).select("anim_id", "content", F.explode(F.sequence(F.lit(0), n - 1)).alias("seq"))
    return rows.select("anim_id", F.col("seq").cast("long").alias("seq"), F.substring("content", F.col("seq") * size + 1, F.lit(size)).alias("bytes"))


#: Chunks are put together up to about so many bytes before they are shuffled.
JOINED = 1 << 16


def joined(pieces: DataFrame) -> DataFrame:
    """(anim_id, seq, bytes): chunks that follow each other in a batch as one, with the first one's number.

    For readers whose result doesn't depend on how the bytes are cut: single bytes are no rows of a shuffle any more.
    """

    def run(batches):
        for batch in batches:
            anim, seq = (batch.column(k).fill_null(-1 << 63).to_numpy() for k in (0, 1))
            data = batch.column(2).cast(pa.binary())
            ends = np.frombuffer(data.buffers()[1], np.int32)[data.offset : data.offset + len(data) + 1] if len(data) else np.zeros(1, np.int32)
            starts = np.ones(len(seq), bool)
            starts[1:] = (anim[1:] != anim[:-1]) | (seq[1:] != seq[:-1] + 1) | (ends[1:-1] // JOINED != ends[:-2] // JOINED)
            first = np.flatnonzero(starts)
            cuts = pa.py_buffer(np.append(ends[:-1][first], ends[-1]).astype(np.int32))
            runs = pa.Array.from_buffers(pa.binary(), len(first), [None, cuts, data.buffers()[2]])
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(pa.array(first)) for k in (0, 1)), runs], names=["anim_id", "seq", "bytes"])

    return pieces.select(F.col("anim_id").cast("long").alias("anim_id"), F.col("seq").cast("long").alias("seq"), "bytes").mapInArrow(run, "anim_id long, seq long, bytes binary")


def in_turn(pieces: DataFrame, begin: Callable, read: Callable, schema: str) -> DataFrame:
    """The rows that read(stream, anim_id, seq, bytes) yields for each chunk, in turn, with stream from begin() for each key.

    The chunks of a key come in order to one task, which holds a batch of them and one stream's state, not a whole stream.
    """
    names = [c.strip().split()[0] for c in schema.split(",")]

    def run(batches):
        known, stream, rows, held = None, None, [], 0
        for batch in batches:
            for anim_id, seq, data in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if stream is None or anim_id != known:
                    known, stream = anim_id, begin()
                for row in read(stream, anim_id, seq, data):
                    rows.append(row)
                    held += len(row[-1]) if isinstance(row[-1], bytes) else 8
                    if held >= JOINED << 6:
                        yield _batch(rows, names, schema)
                        rows, held = [], 0
        yield _batch(rows, names, schema)

    ordered = pieces.select("anim_id", F.col("seq").cast("long").alias("seq"), "bytes").repartition("anim_id").sortWithinPartitions("anim_id", "seq")
    return ordered.mapInArrow(run, schema)


def _batch(rows: list, names: list, schema: str) -> pa.RecordBatch:
    kinds = [{"long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}[c.split()[1]] for c in schema.split(",")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * len(names), kinds)], names=names)


def read_frames(pieces: DataFrame) -> DataFrame:
    """The frames of chunks that are all there."""

    def read(reader, anim_id, seq, data):
        for frame in reader.feed(data):
            yield anim_id, *frame

    return in_turn(joined(pieces), Reader, read, OUTPUT)


def read_frames_as_they_come(pieces: DataFrame) -> DataFrame:
    """The same of a streaming DataFrame, in append mode: a frame is a row as soon as its last byte has arrived.

    Chunks of a stream may come in any order and more than once: those ahead of their turn wait in the state, and
    those that were read already are passed over.
    """
    from pyspark.sql.streaming.state import GroupStateTimeout

    def pack(waiting: dict) -> bytes:
        return b"".join(struct.pack("<qI", k, len(v)) + v for k, v in sorted(waiting.items()))

    def unpack(data: bytes) -> dict:
        out, at = {}, 0
        while at < len(data):
            k, n = struct.unpack_from("<qI", data, at)
            out[k] = data[at + 12 : at + 12 + n]
            at += 12 + n
        return out

    def run(key, batches, state):
        stage, idx, width, height, held, turn, waiting = state.get if state.exists else (HEADER, 0, 0, 0, b"", 0, b"")
        reader, ahead = Reader(stage, idx, width, height, bytes(held)), unpack(bytes(waiting))
        for f in batches:
            for seq, data in zip(f["seq"], f["bytes"]):
                if seq >= turn:
                    ahead[int(seq)] = bytes(data)
        out = []
        while turn in ahead:
            out.extend(reader.feed(ahead.pop(turn)))
            turn += 1
        state.update((reader.stage, reader.frame_idx, reader.width, reader.height, reader.held, turn, pack(ahead)))
        got = pd.DataFrame(out, columns=COLUMNS)
        got.insert(0, "anim_id", key[0])
        yield got

    return pieces.groupBy("anim_id").applyInPandasWithState(run, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)
