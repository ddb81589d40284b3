"""Image files as tables: metadata, pixels, chunks and boxes, in batch or streaming.

Files come through Spark's ``binaryFile`` source, so any file system works and paths are
listed and split by Spark. Decoding runs in Arrow batches of one file's bytes at a time; what a
query does not select is not decoded. A file that can't be read gives a row with ``error``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..codecs import containers, jpeg, raster, registry

META = "path string, length long, format string, width int, height int, depth int, n_frames int, crc_ok boolean, error string, extra map<string,string>"
PIX = "path string, frame_idx int, left int, top int, width int, height int, n_channels int, delay_cs int, data binary, error string"
CHUNKS = "path string, idx int, type string, offset long, length long, crc_ok boolean, data binary"
BOXES = "path string, box_id int, parent_id int, depth int, type string, offset long, size long, fields map<string,string>"
_ERRORS = (ValueError, IndexError, KeyError, OverflowError, ArithmeticError)


def files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Whole files: path and content."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path).select("path", "content")


def stream_files(spark: SparkSession, path: str, per_trigger: int = 1000) -> DataFrame:
    """The same as a stream of files that arrive in a folder."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", per_trigger).load(path).select("path", "content")


def _each(content: DataFrame, schema: str, rows: Callable[[str, bytes], Iterable[dict]]) -> DataFrame:
    """Rows of every file, file by file."""

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                path, raw = batch.column(0)[i].as_py(), batch.column(1)[i].as_py() or b""
                if found := list(rows(path, raw)):
                    yield pa.RecordBatch.from_pylist(found, schema=arrow)

    return content.select("path", "content").mapInArrow(run, schema)


def metadata(content: DataFrame) -> DataFrame:
    """One row a file: what its header says."""

    def rows(path: str, raw: bytes) -> list[dict]:
        row = {"path": path, "length": len(raw)}
        try:
            i = registry.info(raw)
            return [row | {"format": i.format, "width": i.width, "height": i.height, "depth": i.depth, "n_frames": i.frames, "crc_ok": i.crc_ok, "extra": list(i.extra.items())}]
        except Exception as e:  # whatever broken bytes lead to, the row says so
            codec = registry.probe(raw)
            return [row | {"format": codec.name if codec else None, "error": f"{type(e).__name__}: {e}"[:200]}]

    return _each(content, META, rows)


def pixels(content: DataFrame, most_frames: int | None = None) -> DataFrame:
    """One row a picture: packed grey or BGR(A) bytes, top row first. ``most_frames``: of each file."""

    def rows(path: str, raw: bytes) -> list[dict]:
        try:
            frames = registry.decode(raw)[:most_frames]
        except Exception as e:
            return [{"path": path, "frame_idx": 0, "error": f"{type(e).__name__}: {e}"[:200]}]
        out = []
        for k, f in enumerate(frames):
            h, w = f.pixels.shape[:2]
            out.append({"path": path, "frame_idx": k, "left": f.left, "top": f.top, "width": w, "height": h, "n_channels": f.pixels.shape[2], "delay_cs": f.delay, "data": np.ascontiguousarray(f.pixels).tobytes()})
        return out

    return _each(content, PIX, rows)


def chunks(content: DataFrame) -> DataFrame:
    """Chunks of PNG and WebP, segments of JPEG, directory entries of ICO."""

    def rows(path: str, raw: bytes) -> list[dict]:
        codec = registry.probe(raw)
        try:
            if codec and codec.name == "png":
                found = raster.png_chunks(raw)
            elif codec and codec.name == "webp":
                found = containers.webp_chunks(raw)
            elif codec and codec.name == "jpeg":
                found = [s | {"type": f"{s['code']:02X}"} for s in jpeg.segments(raw)]
            else:
                found = []
        except _ERRORS:
            found = []
        return [{"path": path, "idx": k, "type": c["type"], "offset": c["offset"], "length": len(c["data"]), "crc_ok": c.get("crc_ok"), "data": c["data"]} for k, c in enumerate(found)]

    return _each(content, CHUNKS, rows)


def boxes(content: DataFrame) -> DataFrame:
    """Boxes of HEIF, AVIF and JP2 files with the fields that are known."""

    def rows(path: str, raw: bytes) -> list[dict]:
        codec, out = registry.probe(raw), []
        for b in containers.boxes(raw) if codec and codec.name in ("heif", "avif", "jp2") else []:
            try:
                fields = containers.box_fields(raw, b)
            except Exception:
                fields = {}
            out.append({k: b[k] for k in ("box_id", "parent_id", "depth", "type", "offset", "size")} | {"path": path, "fields": list(fields.items())})
        return out

    return _each(content, BOXES, rows)


def explode_pixels(pix: DataFrame) -> DataFrame:
    """One row a pixel, for pixel statistics: path, frame_idx, y, x, b, g, r, a."""
    byte = F.transform(F.regexp_extract_all(F.hex("data"), F.lit(".."), F.lit(0)), lambda h: F.conv(h, 16, 10).cast("int"))
    flat = pix.where("error IS NULL").select("path", "frame_idx", "width", "n_channels", byte.alias("s"))
    n = F.col("n_channels")
    one = flat.select("path", "frame_idx", "width", n, F.posexplode(F.transform(F.sequence(F.lit(0), (F.size("s") / n).cast("int") - 1), lambda i: F.slice("s", (i * n + 1).cast("int"), n))).alias("i", "p"))
    wide = n >= 3
    return one.select("path", "frame_idx", F.floor(F.col("i") / F.col("width")).cast("int").alias("y"), F.pmod("i", "width").alias("x"), F.get("p", F.lit(0)).alias("b"), F.when(wide, F.get("p", F.lit(1))).otherwise(F.get("p", F.lit(0))).alias("g"), F.when(wide, F.get("p", F.lit(2))).otherwise(F.get("p", F.lit(0))).alias("r"), F.coalesce(F.get("p", F.lit(3)), F.lit(255)).alias("a"))


def encoded(pix: DataFrame, codec: str) -> DataFrame:
    """Every picture as a file's bytes in another format: path, frame_idx, content, error."""
    registry.named(codec)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, errors = [], []
            for w, h, n, data in zip(*(batch.column(k).to_pylist() for k in range(2, 6)), strict=True):
                try:
                    out.append(registry.encode(np.frombuffer(data or b"", np.uint8).reshape(h, w, n), codec))
                    errors.append(None)
                except Exception as e:
                    out.append(None)
                    errors.append(f"{type(e).__name__}: {e}"[:200])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary()), pa.array(errors, pa.string())], names=["path", "frame_idx", "content", "error"])

    return pix.select("path", "frame_idx", "width", "height", "n_channels", "data").mapInArrow(run, "path string, frame_idx int, content binary, error string")


def best_icons(content: DataFrame) -> DataFrame:
    """The deepest, then widest picture of every icon file."""

    def rows(path: str, raw: bytes) -> list[dict]:
        try:
            entries = raster.ico_entries(raw)
        except Exception:
            return []
        k = raster.best_entry(entries)
        return [{"path": path, "frame_idx": k, "width": entries[k]["width"], "height": entries[k]["height"], "depth": entries[k]["depth"]}]

    return _each(content, "path string, frame_idx int, width int, height int, depth int", rows)
