"""Sources of frames: event tables, generated frames, image and video files, messages; each in batch and, where Spark can, as a stream."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import functions as fn
from ..schema import FRAME


def mock_frames(spark: SparkSession, count: int, interval_ns: int = 100_000_000, stream_id: str = "main") -> DataFrame:
    """``count`` frames at a fixed interval."""
    return spark.range(count).select(F.lit(stream_id).alias("stream_id"), F.col("id").alias("frame_id"), (F.col("id") * interval_ns).alias("t_ns"), F.col("id").alias("seq"))


def mock_stream(spark: SparkSession, rows_per_second: int = 10) -> DataFrame:
    s = spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load()
    return s.select(F.lit("main").alias("stream_id"), F.col("value").alias("frame_id"), (F.unix_micros("timestamp") * 1000).alias("t_ns"), F.col("value").alias("seq"))


def from_events(events: DataFrame, id_col: str = "event_id", time: str = "ts", stream: str | None = "user_id", keep: tuple = ("event_type", "value", "props")) -> DataFrame:
    """A table of events as frames. Times without a zone are taken as UTC (set the session's zone so); arrival order is (time, id)."""
    t = (F.unix_micros(F.col(time).cast("timestamp")) * 1000).alias("t_ns")
    s = (F.col(stream).cast("string") if stream else F.lit("main")).alias("stream_id")
    return events.select(s, F.col(id_col).cast("bigint").alias("frame_id"), t, F.col(id_col).cast("bigint").alias("seq"), *keep)


def decimate(frames: DataFrame, source_fps: float, fps: float, keys=("stream_id",), order=("t_ns", "frame_id")) -> DataFrame:
    """Every max(1, int(source_fps / fps))-th frame (the source's rate counts as 30 if unknown), numbered anew from 0."""
    skip = max(1, int((source_fps or 30) / fps))
    w = Window.partitionBy(*keys).orderBy(*order)
    kept = frames.withColumn("_n", F.row_number().over(w)).where(F.col("_n") % skip == 0).drop("_n")
    return kept.withColumn("frame_id", (F.row_number().over(w) - 1).cast("bigint"))


def image_files(spark: SparkSession, path: str, interval_ns: int = 100_000_000) -> DataFrame:
    """Image files as frames of a stream for each folder, in order of name."""
    b = spark.read.format("binaryFile").load(path)
    folder, name = F.regexp_extract("path", "^(.*)/[^/]*$", 1), F.regexp_extract("path", "([^/]*)$", 1)
    w = Window.partitionBy("stream_id").orderBy("name")
    b = b.select(folder.alias("stream_id"), name.alias("name"), F.col("content").alias("data")).withColumn("frame_id", (F.row_number().over(w) - 1).cast("bigint"))
    return b.select("stream_id", "frame_id", (F.col("frame_id") * interval_ns).alias("t_ns"), F.col("frame_id").alias("seq"), "data")


def video_files(spark: SparkSession, path: str, fps: float = 10.0, decode: Callable[[bytes], Iterator[tuple[float, bytes, int, int]]] | None = None) -> DataFrame:
    """Video files as frames. ``decode`` yields (milliseconds, bytes, width, height) of every frame, with the source's rate as its first item's
    attribute or 30; without one OpenCV is used, if it is installed. One task decodes a file, a frame at a time."""

    def frames(batches):
        for b in batches:
            for path_, content in zip(b.column(0).to_pylist(), b.column(1)):
                source = (decode or _opencv)(content.as_py())
                rate = getattr(source, "fps", 0) or 30
                skip, read, made = max(1, int(rate / fps)), 0, 0
                for ms, data, width, height in source:
                    read += 1
                    if read % skip:
                        continue
                    yield pa.record_batch({
                        "stream_id": pa.array([path_]), "frame_id": pa.array([made], pa.int64()), "t_ns": pa.array([int(ms * 1e6)], pa.int64()), "seq": pa.array([made], pa.int64()),
                        "data": pa.array([data], pa.binary()), "width": pa.array([width], pa.int32()), "height": pa.array([height], pa.int32()),
                    })
                    made += 1

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(frames, FRAME + ", data binary, width int, height int")


class _opencv:  # noqa: N801  used as a function
    def __init__(self, content: bytes):
        import tempfile

        try:
            import cv2
        except ImportError as e:
            raise ImportError("decoding video needs OpenCV, or a decode function") from e
        self._file = tempfile.NamedTemporaryFile(suffix=".video")  # read back by this task only
        self._file.write(content)
        self._file.flush()
        self._cv2, self._video = cv2, cv2.VideoCapture(self._file.name)
        if not self._video.isOpened():
            raise ValueError("the video cannot be opened")
        self.fps = self._video.get(cv2.CAP_PROP_FPS)

    def __iter__(self):
        while True:
            ok, image = self._video.read()
            if not ok:
                break
            ms = self._video.get(self._cv2.CAP_PROP_POS_MSEC)
            yield ms, self._cv2.imencode(".jpg", image, [self._cv2.IMWRITE_JPEG_QUALITY, 95])[1].tobytes(), image.shape[1], image.shape[0]
        self._video.release()


def messages(spark: SparkSession, path: str) -> DataFrame:
    """Text files of messages, a line each: the line, its header's fields and, where it is JSON, its observation."""
    return parse_messages(spark.read.text(path))


def message_stream(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    return parse_messages(spark.readStream.format("text").option("maxFilesPerTrigger", max_files).load(path))


def parse_messages(lines: DataFrame, column: str = "value") -> DataFrame:
    h = fn.header(F.col(column))
    return lines.select(F.col(column).alias("message"), h["frame_id"].alias("frame_id"), h["source"].alias("source"), h["t_ns"].alias("t_ns"), fn.from_message(F.col(column)).alias("observation"))


def duration_sec(frame_count: int, fps: float) -> float:
    return frame_count / fps if fps > 0 else 0.0
