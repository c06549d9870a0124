"""MGF text as a source and a sink.

Reading goes through Spark's text source, split at END IONS: any file system that Spark reads will do, and large files are dealt over
tasks. Parsing is column expressions alone, in batches and on streams. `mgf` is also registered as a Python data source for
spark.read.format("mgf").
"""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.streaming.readwriter import DataStreamWriter

SCHEMA = "identifier string, title string, scan int, retention_time double, precursor_mz double, precursor_charge int, peaks array<struct<mz:double,intensity:double>>, source_file string"


def resolve(spark: SparkSession, paths: str | list[str], recursive: bool = False) -> list[str]:
    """Files that the paths name: a folder stands for its *.mgf files in either case; each file once, sorted. A path that doesn't exist, or is neither, is an error."""
    out: set[str] = set()
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for p in [paths] if isinstance(paths, str) else paths:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
        fs = path.getFileSystem(conf)
        if not fs.exists(path):
            raise FileNotFoundError(p)
        todo = [path]
        whole = fs.getFileStatus(path).isFile()
        while todo:
            at = todo.pop()
            status = fs.getFileStatus(at)
            if status.isFile():
                if whole or at.getName().lower().endswith(".mgf"):
                    out.add(status.getPath().toString())
            elif at.equals(path) or recursive:
                todo += [s.getPath() for s in fs.listStatus(at)]
    if not out:
        raise FileNotFoundError(f"no MGF files in {paths}")
    return sorted(out)


def peak_of_line(line: F.Column) -> F.Column:
    """(mz, intensity) of a peak line: its first two numbers, parted by white space; what is no number is null."""
    parts = F.split(F.trim(F.regexp_replace(line, "\\s+", " ")), " ")
    return F.struct(F.get(parts, F.lit(0)).try_cast("double").alias("mz"), F.get(parts, F.lit(1)).try_cast("double").alias("intensity"))


def read(spark: SparkSession, paths: str | list[str], mode: str = "tolerant", recursive: bool = False, anomaly_paths: list[str] | None = None, raw: bool = False) -> DataFrame:
    """Spectra of MGF files.

    strict: header lines are known by their first letters, TITLE is left out, peaks are the lines between CHARGE and the end.
    tolerant: headers in any order, TITLE kept, any line of two numbers without `=` is a peak. Lines that are comments (#) or can't be
    read are skipped. A missing scan, retention time or charge is -1, -1 or 1; the identifier is the file's stem. With anomaly_paths
    there is a label, 1 for spectra of these files.
    """
    files = [paths] if raw and isinstance(paths, str) else list(paths) if raw else resolve(spark, paths, recursive)
    out = parse(spark.read.option("lineSep", "END IONS").text(files), mode)
    if anomaly_paths is not None:
        marked = resolve(spark, anomaly_paths, recursive)
        plain = lambda c: F.regexp_replace(c, "^file:/+", "/")
        out = out.withColumn("label", plain(F.col("source_file")).isin([m.replace("file:", "", 1) if m.startswith("file:/") else m for m in marked]).cast("int"))
    return out


def read_stream(spark: SparkSession, folder: str, mode: str = "tolerant", recursive: bool = False, max_files: int | None = None) -> DataFrame:
    """Spectra of the MGF files of a folder, as read() gives them, as a stream: each new *.mgf file, in either case, is read once, at most max_files of them in a batch. Which ones have been read is kept in the query's checkpoint. Files are to be moved into the folder whole."""
    source = spark.readStream.option("lineSep", "END IONS").option("pathGlobFilter", "*.[mM][gG][fF]").option("recursiveFileLookup", recursive)
    if max_files:
        source = source.option("maxFilesPerTrigger", max_files)
    return parse(source.text(folder), mode)


def parse(blocks: DataFrame, mode: str = "tolerant") -> DataFrame:
    """Spectra of text read with END IONS as its line's end, by a batch or a stream; see read()."""
    text = blocks.select("value", F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_name").alias("_name"))
    body = text.where(F.col("value").contains("BEGIN IONS"))
    lines = F.filter(F.transform(F.split(F.element_at(F.split("value", "BEGIN IONS"), -1), "\\r?\\n"), lambda x: F.trim(F.regexp_replace(x, "\\s+", " "))), lambda x: (x != "") & ~x.startswith("#"))
    rows = body.select("source_file", F.regexp_replace("_name", "(?i)\\.mgf$", "").alias("identifier"), lines.alias("l"))

    def head(start: str) -> F.Column:
        found = F.filter("l", lambda x: F.upper(x).startswith(start))
        return F.element_at(F.split(F.try_element_at(found, F.lit(1)), "=", 2), 2)

    number = "([-+]?[0-9]*\\.?[0-9]+(?:[eE][-+]?[0-9]+)?)"
    charge = F.regexp_extract(head("CHARGE"), "([0-9]+)", 1)
    after = F.slice("l", F.greatest(F.lit(1), F.coalesce(F.array_position(F.transform("l", lambda x: F.upper(x).startswith("CHARGE")), F.lit(True)), F.lit(0)).cast("int") + 1), F.size("l"))
    pool = after if mode == "strict" else F.col("l")
    pool = F.when(F.array_position(F.transform("l", lambda x: F.upper(x).startswith("CHARGE")), F.lit(True)) > 0, pool).otherwise(F.array().cast("array<string>")) if mode == "strict" else pool
    pairs = F.transform(F.filter(pool, lambda x: ~x.contains("=")), peak_of_line)
    return rows.select(
        "identifier",
        (F.lit(None).cast("string") if mode == "strict" else head("TITLE")).alias("title"),
        F.coalesce(F.regexp_extract(head("SCANS"), "([0-9]+)", 1).try_cast("int"), F.lit(-1)).alias("scan"),
        F.coalesce(F.regexp_extract(head("RTINS"), number, 1).try_cast("double"), F.lit(-1.0)).alias("retention_time"),
        F.regexp_extract(head("PEPMA"), number, 1).try_cast("double").alias("precursor_mz"),
        F.coalesce(charge.try_cast("int"), F.lit(1)).alias("precursor_charge"),
        F.filter(pairs, lambda p: p["mz"].isNotNull() & p["intensity"].isNotNull()).alias("peaks"),
        "source_file",
    )


def count_spectra(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(source_file, n_spectra): lines that begin a spectrum, per file."""
    return count_of_lines(spark.read.text(resolve(spark, paths)).select("value", F.col("_metadata.file_path").alias("source_file")))


def count_of_lines(lines: DataFrame) -> DataFrame:
    """As count_spectra(), of lines with value and source_file."""
    return lines.groupBy("source_file").agg(F.count_if(F.trim("value").startswith("BEGIN IONS")).alias("n_spectra"))


def as_text(df: DataFrame, title: F.Column | None = None, cluster: bool = False) -> DataFrame:
    """(spectrum_id, value): each spectrum as an MGF block."""
    heading = F.concat_ws(":", "identifier", "spectrum_id", "scan") if title is None else title
    peaks = F.array_join(F.transform("peaks", lambda p: F.format_string("%.5f %.1f", p["mz"], p["intensity"])), "\n")
    lines = [F.lit("BEGIN IONS"), F.concat(F.lit("TITLE="), heading), F.concat(F.lit("SCANS="), F.col("scan").cast("string")), F.format_string("RTINSECONDS=%f", F.col("retention_time").cast("double")), F.format_string("PEPMASS=%f", F.col("precursor_mz").cast("double")), F.concat(F.lit("CHARGE="), F.col("precursor_charge").cast("string"), F.lit("+"))]
    if cluster:
        lines.insert(2, F.concat(F.lit("CLUSTER="), F.col("cluster").cast("string")))
    body = F.concat_ws("\n", *lines, F.when(peaks != "", peaks), F.lit("END IONS"), F.lit(""))
    return df.select("spectrum_id", body.alias("value"))


def write(df: DataFrame, path: str, title: F.Column | None = None, cluster: bool = False, cap_bytes: int | None = None) -> None:
    """Write spectra as MGF text files under path. With cap_bytes files hold about so many bytes at most: rows are dealt into parts by running size."""
    text = as_text(df, title, cluster)
    if cap_bytes is None:
        text.select("value").write.mode("overwrite").text(path)
        return
    from ..plans.scratch import running

    sized = running(text.withColumn("_size", F.octet_length("value") + 1), ["spectrum_id"], {"_upto": "_size"})
    parts = sized.withColumn("part", F.floor((F.col("_upto") - 1) / cap_bytes).cast("int"))
    parts.repartition("part").sortWithinPartitions("part", "spectrum_id").select("part", "value").write.mode("overwrite").partitionBy("part").text(path)


def write_stream(df: DataFrame, path: str, checkpoint: str, title: F.Column | None = None, cluster: bool = False) -> DataStreamWriter:
    """A writer of a stream of spectra as MGF text files under path, to be started with any trigger. Files of a batch count once the batch is whole: what a task that failed has left isn't seen by read(..., raw=True) of the folder, and a batch that is run again is written once."""
    return as_text(df, title, cluster).select("value").writeStream.format("text").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")


def write_representatives(raw: DataFrame, clusters: DataFrame, path: str, key: list[str]) -> None:
    """Write the representatives' spectra: raw spectra joined with flagged cluster rows by the natural key. Raw spectra without a spectrum_id take that of the cluster row."""
    own = [] if "spectrum_id" in raw.columns else ["spectrum_id"]
    reps = clusters.where("is_representative").select(*key, *own, "cluster")
    write(raw.join(reps, key), path, cluster=True)


class Files(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


class Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"].removeprefix("file://")
        self.fail = options.get("failfast", "false").lower() == "true"

    def partitions(self) -> list[InputPartition]:
        if os.path.isdir(self.path):
            return [Files(os.path.join(self.path, f)) for f in sorted(os.listdir(self.path)) if f.lower().endswith(".mgf")]
        return [Files(self.path)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        assert isinstance(partition, Files)
        stem = os.path.splitext(os.path.basename(partition.path))[0]
        head: dict[str, str] | None = None
        peaks: list[tuple[float, float]] = []
        with open(partition.path, encoding="utf-8", errors="replace") as file:
            for line in map(str.strip, file):
                if not line or line[0] == "#":
                    continue
                if line == "BEGIN IONS":
                    head, peaks = {}, []
                elif line == "END IONS":
                    if head is not None:
                        yield self.row(stem, head, peaks, partition.path)
                    head = None
                elif head is not None and "=" in line:
                    name, value = line.split("=", 1)
                    head.setdefault(name.upper()[:5], value)
                elif head is not None:
                    try:
                        mz, intensity = map(float, line.split()[:2])
                        peaks.append((mz, intensity))
                    except ValueError:
                        if self.fail:
                            raise
            if head is not None:
                yield self.row(stem, head, peaks, partition.path)

    @staticmethod
    def row(stem: str, head: dict[str, str], peaks: list[tuple[float, float]], path: str) -> tuple:
        digits = lambda s: int("".join(c for c in s if c.isdigit()) or -1)
        mass = head.get("PEPMA", "").split()
        return stem, head.get("TITLE"), digits(head.get("SCANS", "")), float(head.get("RTINS", -1)), float(mass[0]) if mass else None, digits(head["CHARG"]) if "CHARG" in head else 1, peaks, path


class MGF(DataSource):
    """spark.read.format("mgf").load(path): a file, or a folder's files, one task each, on a file system that every executor mounts. read() above has no such need."""

    @classmethod
    def name(cls) -> str:
        return "mgf"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return Reader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(MGF)
