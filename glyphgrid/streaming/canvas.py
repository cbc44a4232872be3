"""The canvas of an animation while its bytes arrive: rows are painted as they come, frames given out when they are whole.

The streams are those of ``animation``; a frame's payload is its pixels row by row, four bytes each (a, r, g, b, premultiplied),
and of its flags 4 says that it is blended with the canvas instead of replacing it. A frame that disposes begins on a canvas of
the background's colour. A frame of no duration is a part of the next one that has a duration.

What is known of a stream between two chunks is a few numbers, less than a row of bytes, and the canvas, so a long
payload is never held. Rows are painted in strips of ``STRIP``: the decoded area is all whole strips and at most one begun strip,
which goes on where it stopped. It never shrinks within a frame.
"""

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from glyphgrid.streaming.animation import FRAME, HEAD, MAGIC, Source, in_turn, joined

HEADER, FRAME_HEADER, ROWS, DONE, FAILED = range(5)
STRIP = 2
BACKGROUND = (255, 255, 255, 255)
#: A canvas may have so many pixels, as it is the state of one key.
MOST_PIXELS = 1 << 24

FRAMES = "anim_id long, final_idx long, frame_idx long, duration_ms long, width long, height long, canvas binary"
AREAS = "anim_id long, seq long, frame_idx long, strips long, begun_rows long, area_rows long"
_NUMBERS = struct.Struct("<14q")


class Canvas:
    """One stream's state; see above."""

    def __init__(self, background: tuple = BACKGROUND):
        self.stage, self.frame_idx, self.final_idx, self.width, self.height = HEADER, 0, 0, 0, 0
        self.frame, self.rows = (0,) * 7, 0
        self.background, self.pixels, self._source = background, np.zeros((0, 0, 4), np.uint8), Source()

    def packed(self) -> tuple:
        """(numbers and bytes that are held, pixels), as binary."""
        numbers = _NUMBERS.pack(self.stage, self.frame_idx, self.final_idx, self.width, self.height, *self.frame, self.rows, 0)
        return numbers + self._source.held, self.pixels.tobytes()

    @classmethod
    def unpacked(cls, known: bytes, pixels: bytes, background: tuple = BACKGROUND) -> "Canvas":
        out = cls(background)
        out.stage, out.frame_idx, out.final_idx, out.width, out.height, *frame, out.rows, _ = _NUMBERS.unpack_from(known)
        out.frame, out._source = tuple(frame), Source(known[_NUMBERS.size :])
        out.pixels = np.frombuffer(pixels, np.uint8).reshape(out.height if len(pixels) else 0, -1, 4).copy() if len(pixels) else out.pixels
        return out

    @property
    def area(self) -> tuple:
        """(frame, whole strips, rows of the begun one, rows of the canvas that are final): nothing is final within a frame of no duration."""
        if self.stage != ROWS:
            done = self.stage == DONE
            return max(0, self.frame_idx - 1) if done else self.frame_idx, 0, 0, self.height if done else 0
        _, duration, _, y, _, h, _ = self.frame
        final = 0 if not duration else y + self.rows if 0 < self.rows < h else self.height if self.rows == h else y
        return self.frame_idx, self.rows // STRIP, self.rows % STRIP, final if duration else 0

    def feed(self, data: bytes) -> Iterator[tuple]:
        """(final_idx, frame_idx, duration) of the frames that these bytes complete; the canvas is theirs until the next step."""
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
        if self.stage == HEADER:
            head = self._source.try_read(HEAD.size)
            if head is None:
                return None
            magic, self.width, self.height = HEAD.unpack(head)
            fits = magic == MAGIC and 0 < self.width * self.height <= MOST_PIXELS
            self.stage = FRAME_HEADER if fits else FAILED
            if fits:
                self.pixels = np.tile(np.array(self.background, np.uint8), (self.height, self.width, 1))
            return ()
        if self.stage == FRAME_HEADER:
            head = self._source.try_read(FRAME.size)
            if head is None:
                return None
            flags, duration, x, y, w, h, size = self.frame = FRAME.unpack(head)
            inside = x + w <= self.width and y + h <= self.height and size == 4 * w * h
            if not inside or (self.frame_idx == 0 and not flags & 1) or (flags & 2 and not duration):
                self.stage = FAILED
                return ()
            if flags & 1:
                self.pixels[:] = self.background
            self.rows, self.stage = 0, ROWS
            return ()
        flags, duration, x, y, w, h, _ = self.frame
        if self.rows < h:
            data = self._source.try_read(4 * w)
            if data is None:
                return None
            self._paint(np.frombuffer(data, np.uint8).reshape(w, 4), y + self.rows, x, bool(flags & 4))
            self.rows += 1
            return ()
        out = (self.final_idx, self.frame_idx, duration) if duration else ()
        self.frame_idx, self.final_idx, self.stage = self.frame_idx + 1, self.final_idx + bool(duration), DONE if flags & 2 else FRAME_HEADER
        return out

    def _paint(self, row: np.ndarray, y: int, x: int, blends: bool) -> None:
        under = self.pixels[y, x : x + len(row)]
        if blends:
            v = (255 - row[:, :1].astype(np.int64)) * under
            row = np.minimum(255, row + ((v + (v >> 8) + 128) >> 8))  # a division by 255 in whole numbers
        self.pixels[y, x : x + len(row)] = row


def _frame_rows(anim_id, canvas: Canvas, data: bytes) -> Iterator[tuple]:
    for final_idx, frame_idx, duration in canvas.feed(data):
        yield anim_id, final_idx, frame_idx, duration, canvas.width, canvas.height, canvas.pixels.tobytes()


def _named(rows: list, schema: str) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.strip().split()[0] for c in schema.split(",")])


def canvases(pieces: DataFrame) -> DataFrame:
    """The canvas at each frame with a duration, of chunks (anim_id, seq, bytes) that are all there. A stream's chunks meet in one task, in their order."""

    return in_turn(joined(pieces), Canvas, lambda canvas, anim_id, seq, data: _frame_rows(anim_id, canvas, data), FRAMES)


def areas(pieces: DataFrame) -> DataFrame:
    """The decoded area after each chunk."""

    def read(canvas, anim_id, seq, data):
        for _ in canvas.feed(data):
            pass
        yield anim_id, seq, *canvas.area

    return in_turn(pieces, Canvas, read, AREAS)


class CanvasProcessor(StatefulProcessor):
    """A stream's canvas as state. Chunks may come in any order and more than once.

    At most ``most_waiting`` chunks wait for one that is missing; beyond, and where nothing has come for ``idle_ms``, the stream is given
    up and its state goes. Of a finished or given-up stream only a mark stays, for ``idle_ms``, so that chunks that come again are passed over.
    Without ``idle_ms`` there are no timers and marks stay.
    """

    def __init__(self, idle_ms: int | None, most_waiting: int):
        self._idle_ms, self._most_waiting = idle_ms, most_waiting

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        binary = lambda *names: StructType([StructField(n, BinaryType()) for n in names])
        self._known = handle.getValueState("known", StructType([*binary("numbers", "pixels"), StructField("turn", LongType())]))
        self._waiting = handle.getMapState("waiting", StructType([StructField("seq", LongType())]), binary("bytes"))
        self._ended = handle.getValueState("ended", StructType([StructField("at", LongType())]), **({"ttlDurationMs": self._idle_ms} if self._idle_ms else {}))

    def _wake(self, at: int | None) -> None:
        """The one timer of the key."""
        if self._idle_ms:
            for before in list(self._handle.listTimers()):
                self._handle.deleteTimer(before)
            if at is not None:
                self._handle.registerTimer(at)

    def _end(self, now: int) -> None:
        self._known.clear()
        self._waiting.clear()
        self._wake(None)
        self._ended.update((now,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs() if self._idle_ms else 0
        if self._ended.exists():
            for _ in rows:
                pass
            return
        if self._known.exists():
            numbers, pixels, turn = self._known.get()
            canvas = Canvas.unpacked(bytes(numbers), bytes(pixels))
        else:
            canvas, turn = Canvas(), 0
        ahead = {int(k[0]): bytes(v[0]) for k, v in self._waiting.iterator()}
        held = set(ahead)
        for f in rows:
            for seq, data in zip(f["seq"], f["bytes"]):
                if seq >= turn:
                    ahead[int(seq)] = bytes(data)
        out = []
        while turn in ahead:
            out.extend(_frame_rows(key[0], canvas, ahead.pop(turn)))
            turn += 1
        if canvas.stage in (DONE, FAILED) or len(ahead) > self._most_waiting:
            self._end(now)
        else:
            self._known.update((*canvas.packed(), turn))
            for seq in held - set(ahead):
                self._waiting.removeKey((seq,))
            for seq in set(ahead) - held:
                self._waiting.updateValue((seq,), (ahead[seq],))
            self._wake(now + (self._idle_ms or 0))
        yield _named(out, FRAMES)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._end(timerValues.getCurrentProcessingTimeInMs())
        yield _named([], FRAMES)

    def close(self) -> None:
        pass


def canvases_as_they_come(pieces: DataFrame, idle_ms: int | None = 3_600_000, most_waiting: int = 10_000) -> DataFrame:
    """The same rows of a streaming DataFrame, in append mode, as soon as a frame's last byte has arrived.

    The session's state store has to be RocksDB's, which these states need. Timers keep a query with the trigger availableNow
    from ending, as Spark goes on to ask for expired ones; for such a query idle_ms is None.
    """
    return pieces.groupBy("anim_id").transformWithStateInPandas(CanvasProcessor(idle_ms, most_waiting), outputStructType=FRAMES, outputMode="append", timeMode="ProcessingTime" if idle_ms else "None")


def _head_bytes(width: int, height: int) -> bytes:
    return HEAD.pack(MAGIC, width, height)


def _frame_bytes(row: tuple, last: bool) -> tuple:
    _, disposes, blends, duration, x, y, w, h, pixels = row
    return FRAME.pack(disposes + 2 * last + 4 * blends, max(duration, int(last)), x, y, w, h, len(pixels)), pixels


def painted_streams(frames: DataFrame, width: int, height: int) -> DataFrame:
    """frames (anim_id, frame_idx, duration_ms, disposes, blends, x, y, w, h, pixels) to (anim_id, content). pixels: (a, r, g, b) bytes, row by row.

    The last frame lasts 1 ms at least. A stream's frames come in order to one task, which holds one content at a time.
    """
    names = ("anim_id", "disposes", "blends", "duration_ms", "x", "y", "w", "h", "pixels")

    def write(batches):
        parts, before = [], None

        def ended():
            parts.extend(_frame_bytes(before, True))
            return pa.RecordBatch.from_arrays([pa.array([before[0]], pa.int64()), pa.array([b"".join(parts)], pa.binary())], names=["anim_id", "content"])

        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(len(names)))):
                if before is not None and row[0] == before[0]:
                    parts += _frame_bytes(before, False)
                else:
                    if before is not None:
                        yield ended()
                    parts = [_head_bytes(width, height)]
                before = row
        if before is not None:
            yield ended()

    ordered = frames.repartition("anim_id").sortWithinPartitions("anim_id", "frame_idx")
    return ordered.select(*names).mapInArrow(write, "anim_id long, content binary")


#: Bytes of a frame's header.
FRAME_BYTES = FRAME.size


def smallest_deltas(rectangles: DataFrame) -> DataFrame:
    """Of frames (key, w, h, rects: the changed rectangles as (x, y, w, h)) what takes the fewest bytes: the rectangles as they are, their bounding
    rectangle, or the whole frame on a new canvas; of equal ones the first. Where nothing changes, the first pixel."""
    area = lambda r: r["w"] * r["h"]
    rects = F.when(F.size("rects") > 0, F.col("rects")).otherwise(F.array(F.struct(*[F.lit(v).cast("long").alias(n) for n, v in zip("xywh", (0, 0, 1, 1))])))
    rows = rectangles.withColumn("rects", rects)
    x0, y0 = (F.array_min(F.col(f"rects.{n}")) for n in "xy")
    x1, y1 = (F.array_max(F.transform("rects", f)) for f in (lambda r: r["x"] + r["w"], lambda r: r["y"] + r["h"]))
    whole = F.col("w") * F.col("h")
    own = F.aggregate("rects", F.lit(0).cast("long"), lambda s, r: s + FRAME_BYTES + 4 * area(r))
    free = (F.size("rects") == 1) & (area(F.col("rects")[0]) == whole)
    rows = rows.withColumns({"as_is": own, "bounding": FRAME_BYTES + 4 * (x1 - x0) * (y1 - y0), "full": FRAME_BYTES + 4 * whole})
    choice = F.when(free, "full").when((F.size("rects") > 1) & (F.col("bounding") < F.col("as_is")) & (F.col("bounding") <= F.col("full")), "bounding").when(F.col("full") < F.col("as_is"), "full").otherwise("as_is")
    return rows.withColumn("kept", choice).withColumn("n_bytes", F.when(F.col("kept") == "full", F.col("full")).when(F.col("kept") == "bounding", F.col("bounding")).otherwise(F.col("as_is")))
