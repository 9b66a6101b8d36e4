"""Images of the simple FITS primary array, read as tiles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Block and card lengths of the format, and the sample types.
BLOCK, CARD = 2880, 80
KINDS = {8: ">u1", 16: ">i2", 32: ">i4", 64: ">i8", -32: ">f4", -64: ">f8"}
TILES = "image string, tile_id int, x0 int, y0 int, w int, h int, pix array<double>"


def parse_header(data: bytes) -> tuple[dict[str, str], int]:
    """Keyword values as text, and where the array begins. Raises without an END card."""
    cards: dict[str, str] = {}
    for at in range(0, len(data), CARD):
        card = data[at : at + CARD].decode("ascii", "replace")
        key = card[:8].strip()
        if key == "END":
            return cards, -(-(at + CARD) // BLOCK) * BLOCK
        if card[8:10] == "= ":
            raw = card[10:].strip()
            cards[key] = raw[1 : raw.find("'", 1)].strip() if raw.startswith("'") else raw.split("/")[0].strip()
    raise ValueError("no END card")


def parse_image(data: bytes) -> tuple[dict[str, str], np.ndarray]:
    """Header and native array of the primary image, scaled by BSCALE and BZERO."""
    head, at = parse_header(data)
    shape = [int(head[f"NAXIS{i}"]) for i in range(int(head.get("NAXIS", 0)), 0, -1)]
    kind = np.dtype(KINDS[int(head["BITPIX"])])
    n = int(np.prod(shape)) if shape else 0
    if len(data) < at + n * kind.itemsize:
        raise ValueError("the array is cut off")
    img = np.frombuffer(data, kind, n, at).reshape(shape).astype(np.float64)
    return head, img * float(head.get("BSCALE", 1)) + float(head.get("BZERO", 0))


def read_tiles(spark: SparkSession, paths: str | list[str], tile: int = 512, on_error: str = "raise") -> DataFrame:
    """Rows of ``TILES``; ``image`` is the file's name. A file that is no FITS image, or is cut off, fails the job and is named; with ``on_error="skip"`` it gives no rows. A task holds a file, which the format bounds to one mosaic."""
    if on_error not in ("raise", "skip"):
        raise ValueError("on_error must be 'raise' or 'skip'")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, data in zip(b["path"], b["content"]):
                try:
                    _, img = parse_image(bytes(data))
                except (ValueError, KeyError) as e:
                    if on_error == "raise":
                        raise ValueError(f"{path}: no readable image ({e})") from e
                    continue
                if img.ndim != 2:
                    continue
                rows = []
                for k, (y, x) in enumerate((y, x) for y in range(0, img.shape[0], tile) for x in range(0, img.shape[1], tile)):
                    part = img[y : y + tile, x : x + tile]
                    rows.append((path.rsplit("/", 1)[-1], k, x, y, part.shape[1], part.shape[0], part.ravel()))
                    if len(rows) == 8:
                        yield pd.DataFrame(rows, columns=["image", "tile_id", "x0", "y0", "w", "h", "pix"])
                        rows = []
                yield pd.DataFrame(rows, columns=["image", "tile_id", "x0", "y0", "w", "h", "pix"])

    files = spark.read.format("binaryFile").load(paths).select("path", "content")
    return files.mapInPandas(run, TILES)


def read_headers(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``(image, header map<string,string>)``; what cannot be read has no row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, data in zip(b["path"], b["content"]):
                try:
                    rows.append((path.rsplit("/", 1)[-1], parse_header(bytes(data))[0]))
                except ValueError:
                    continue
            yield pd.DataFrame(rows, columns=["image", "header"])

    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInPandas(run, "image string, header map<string,string>")


def with_weights(science: DataFrame, weight: DataFrame | None) -> DataFrame:
    """``(image, x, y, v, variance)``: variance 1/w, infinite where the weight is not positive; null without a weight map."""
    if weight is None:
        return science.withColumn("variance", F.lit(None).cast("double"))
    w = weight.select("image", "x", "y", F.col("v").alias("w"))
    j = science.join(w, ["image", "x", "y"], "left")
    return j.select("image", "x", "y", "v", F.when(F.col("w") > 0, 1.0 / F.when(F.col("w") > 0, F.col("w"))).otherwise(float("inf")).alias("variance"))
