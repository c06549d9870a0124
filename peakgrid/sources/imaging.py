"""Imaging spectra as a source: pixels of imzML files, with the arrays of the binary file beside each.

The XML goes through Spark's text source, split at </spectrum>, and is parsed by column expressions. Only the ranges of the binary file that
a task's pixels name are read, by pyarrow's file systems on the executors; no file and no image is ever held whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import splits

PEAKS = "array<struct<mz:double,intensity:double>>"
BATCH_PEAKS = 1 << 20  # peaks of an Arrow batch; a longer spectrum is a batch of its own

# Accessions of the imzML and mzML vocabularies.
MZ_ARRAY, INTENSITY_ARRAY, ZLIB = "MS:1000514", "MS:1000515", "MS:1000574"
TYPES = {"MS:1000521": "<f4", "MS:1000523": "<f8", "MS:1000519": "<i4", "MS:1000522": "<i8", "IMS:1000141": "<i4", "IMS:1000142": "<i8"}
POSITION = {"x": "IMS:1000050", "y": "IMS:1000051", "z": "IMS:1000052"}
OFFSET, LENGTH, ENCODED = "IMS:1000102", "IMS:1000103", "IMS:1000104"


def read(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(source_file, pixel, x, y, z, peaks): a row per spectrum; pixel is its index in the file, a missing z is 1. The binary file has the same name, ending in .ibd.

    Peaks stand in the order of the file; a spectrum of no peaks has an empty array. Arrays may be floats or whole numbers of 32 or 64 bits,
    plain or by zlib. An array that lies beyond the binary file, or of an unknown type, is an error that names the pixel.
    """
    text = spark.read.option("lineSep", "</spectrum>").text(paths).select("value", F.col("_metadata.file_path").alias("source_file"))
    group = r"(?s)<referenceableParamGroup\s[^>]*?\bid=[\"']([^\"']*)[\"'][^>]*>(.*?)</referenceableParamGroup>"
    groups = F.arrays_zip(F.regexp_extract_all("value", F.lit(group), F.lit(1)).alias("id"), F.regexp_extract_all("value", F.lit(group), F.lit(2)).alias("body"))
    # a row per file: the head stands before the file's first spectrum
    heads = text.where(F.col("value").contains("<referenceableParamGroup ")).select("source_file", groups.alias("groups"))
    body = text.where(F.col("value").rlike(r"<spectrum\s")).select("source_file", F.regexp_extract("value", r"(?s)(<spectrum\s.*)", 1).alias("s"))
    both = body.join(heads, "source_file", "left")
    arrays = F.regexp_extract_all("s", F.lit(r"(?s)(<binaryDataArray\s.*?</binaryDataArray>)"), F.lit(1))
    filled = F.transform(arrays, lambda a: F.concat(a, F.array_join(F.transform(F.filter(F.coalesce("groups", F.array().cast("array<struct<id:string,body:string>>")), lambda g: a.contains(F.concat(F.lit('ref="'), g["id"], F.lit('"')))), lambda g: g["body"]), "")))

    def array_of(kind: str) -> F.Column:
        a = F.try_element_at(F.filter(filled, lambda x: x.contains(kind)), F.lit(1))
        dtype = F.coalesce(*[F.when(a.contains(accession), F.lit(t)) for accession, t in TYPES.items()])
        return F.struct(value_of(a, OFFSET).cast("long").alias("offset"), value_of(a, LENGTH).cast("long").alias("length"), value_of(a, ENCODED).try_cast("long").alias("encoded"), dtype.alias("type"), a.contains(ZLIB).alias("zlib"))

    pixel = F.regexp_extract("s", r"<spectrum\s[^>]*?\bindex=[\"']([0-9]+)", 1).try_cast("long")
    at = [value_of(F.col("s"), accession).try_cast("int").alias(name) for name, accession in POSITION.items()]
    rows = both.select("source_file", pixel.alias("pixel"), *at, array_of(MZ_ARRAY).alias("m"), array_of(INTENSITY_ARRAY).alias("i")).withColumn("z", F.coalesce("z", F.lit(1)))
    return rows.mapInArrow(_fetch, f"source_file string, pixel long, x int, y int, z int, peaks {PEAKS}")


def value_of(text: F.Column, accession: str) -> F.Column:
    """The value of the first cvParam with this accession; null if there is none."""
    tag = F.regexp_extract(text, rf"(<cvParam\s[^>]*[\"']{accession}[\"'][^>]*>)", 1)
    return F.nullif(F.regexp_extract(tag, r"\bvalue=[\"']([^\"']*)", 1), F.lit(""))


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    name, handle = None, None
    rows, parts, peaks = [], [], 0
    try:
        for batch in batches:
            for row in batch.to_pylist():
                if row["source_file"] != name:
                    if handle is not None:
                        handle.close()
                    name = row["source_file"]
                    system, path = fs.FileSystem.from_uri(name[: -len(".imzML")] + ".ibd")
                    handle = system.open_input_file(path)
                mz, intensity = (_array(handle, row[k], name, row["pixel"]) for k in "mi")
                if len(mz) != len(intensity):
                    raise ValueError(f"{name}, pixel {row['pixel']}: {len(mz)} m/z values, {len(intensity)} intensities")
                if rows and peaks + len(mz) > BATCH_PEAKS:
                    yield _batch(rows, parts)
                    rows, parts, peaks = [], [], 0
                rows.append(row)
                parts.append((mz, intensity))
                peaks += len(mz)
        if rows:
            yield _batch(rows, parts)
    finally:
        if handle is not None:
            handle.close()


def _array(handle: pa.NativeFile, a: dict, name: str, pixel: int) -> np.ndarray:
    if not a["length"]:
        return np.empty(0)
    if a["type"] is None or a["offset"] is None or (a["zlib"] and a["encoded"] is None):
        raise ValueError(f"{name}, pixel {pixel}: no type or place of an array")
    dtype = np.dtype(a["type"])
    size = a["encoded"] if a["zlib"] else a["length"] * dtype.itemsize
    data = handle.read_at(size, a["offset"])
    values = np.frombuffer(zlib.decompress(data) if a["zlib"] and len(data) == size else data, np.uint8)
    if len(data) < size or len(values) != a["length"] * dtype.itemsize:
        raise ValueError(f"{name}, pixel {pixel}: an array isn't in the binary file as described")
    return values.view(dtype).astype(np.float64)


def _batch(rows: list[dict], parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    offsets = np.cumsum([0, *(len(m) for m, _ in parts)]).astype(np.int32)
    values = pa.StructArray.from_arrays([pa.array(np.concatenate([p[k] for p in parts])) for k in (0, 1)], ["mz", "intensity"])
    columns = [pa.array([r[c] for r in rows], t) for c, t in (("source_file", pa.string()), ("pixel", pa.int64()), ("x", pa.int32()), ("y", pa.int32()), ("z", pa.int32()))]
    return pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(offsets, values)], ["source_file", "pixel", "x", "y", "z", "peaks"])


def spectra(pixels: DataFrame, low: float = 50.0, high: float = 500.0, title: str = "") -> DataFrame:
    """Spectra of pixels that have peaks, with the columns of MGF files: a precursor between low and high by the place in the image (one image per source_file) and precursor_intensity, that of the nearest peak (the first of equally near ones)."""
    placed = splits.spatial_mass(pixels, low, high, "source_file").where(F.size("peaks") > 0)
    near = F.array_min(F.transform("peaks", lambda p, i: F.struct(F.abs(p["mz"] - F.col("pseudo_mass")).alias("d"), i.alias("i"), p["intensity"].alias("intensity"))))
    name = F.format_string("spectrum_%d_x%d_y%d_z%d_%s", "pixel", "x", "y", "z", F.lit(title))
    stem = F.regexp_extract("source_file", r"([^/]*)\.[^./]*$", 1)
    return placed.select(
        stem.alias("identifier"), name.alias("title"), (F.col("pixel") + 1).cast("int").alias("scan"), F.lit(0.0).alias("retention_time"),
        F.col("pseudo_mass").alias("precursor_mz"), near["intensity"].alias("precursor_intensity"), F.lit(1).alias("precursor_charge"), "peaks", "source_file",
    )
