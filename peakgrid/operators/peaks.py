"""Peak cleaning, scaling and bucketing as column expressions over spectra.

A spectrum is a row with spectrum_id, precursor_mz, precursor_charge, retention_time, identifier, scan and peaks, an array of
struct<mz, intensity> in order of m/z. None of these operators shuffles. The whole chain, preprocess(), takes the same steps over Arrow
batches instead, since the optimizer copies what makes the peaks into each filter that follows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..params import Params

#: Masses of hydrogen and of an isotope step.
HYDROGEN, ISOTOPE = 1.007825, 1.003355
#: Fixed values of the neutral-mass bucket.
PROTON, BIN = 1.00794, 1.0005079


def mz(i: int) -> F.Column:
    return F.try_element_at("peaks", F.lit(i))["mz"]


def filter_mz_range(df: DataFrame, low: float | None = None, high: float | None = None) -> DataFrame:
    """Keep peaks with low <= m/z <= high; a bound that is None is the spectrum's own first or last peak."""
    lo = mz(1) if low is None else F.lit(float(low))
    hi = mz(-1) if high is None else F.lit(float(high))
    return df.withColumn("peaks", F.filter("peaks", lambda p: (p["mz"] >= lo) & (p["mz"] <= hi)))


def valid_spectra(df: DataFrame, min_peaks: int, min_mz_range: float) -> DataFrame:
    """Keep spectra with enough peaks that span enough m/z."""
    return df.where((F.size("peaks") >= min_peaks) & (mz(-1) - mz(1) >= min_mz_range))


def remove_precursor(df: DataFrame, tol: float, mode: str = "Da", isotopes: int = 0) -> DataFrame:
    """Drop peaks within tol of the precursor at any charge from its own down to 1 and any isotope step up to isotopes. A spectrum of charge 0 or less loses none."""
    z = F.greatest(F.col("precursor_charge").cast("int"), F.lit(0))
    neutral = (F.col("precursor_mz") - HYDROGEN) * F.col("precursor_charge")
    steps = F.when(z > 0, F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(z, F.lit(1))), lambda c: F.array(*[(neutral + iso * ISOTOPE) / c + HYDROGEN for iso in range(isotopes + 1)])))).otherwise(F.array().cast("array<double>"))

    def near(t: F.Column, p: F.Column) -> F.Column:
        gap = F.abs(t - p["mz"]) if mode == "Da" else F.abs((t - p["mz"]) / t * 1e6)
        return gap <= tol

    held = df.withColumn("_removed", steps)
    return held.withColumn("peaks", F.filter("peaks", lambda p: ~F.exists("_removed", lambda t: near(t, p)))).drop("_removed")


def top_peaks(df: DataFrame, max_peaks: int | None, min_intensity: float) -> DataFrame:
    """Of the max_peaks most intense peaks (ties: the lower m/z first) keep those over min_intensity times the greatest, in order of m/z."""
    ranked = F.array_sort(F.transform("peaks", lambda p: F.struct((-p["intensity"]).alias("i"), p["mz"].alias("mz"))))
    ranked = ranked if max_peaks is None else F.slice(ranked, 1, max_peaks)
    held = df.withColumn("_ranked", ranked).withColumn("_least", -F.try_element_at("_ranked", F.lit(1))["i"] * min_intensity)
    kept = F.filter("_ranked", lambda p: -p["i"] > F.col("_least"))
    return held.withColumn("peaks", F.array_sort(F.transform(kept, lambda p: F.struct(p["mz"].alias("mz"), (-p["i"]).alias("intensity"))))).drop("_ranked", "_least")


def scale_intensity(df: DataFrame, how: str = "off", max_rank: int | None = None, max_intensity: float | None = None, degree: int = 2, base: float = 2) -> DataFrame:
    """Scale intensities: off, root (x^(1/degree)), log (log_base(1 + x)) or rank (max_rank less the place in falling order, from 0; ties: the later peak is higher). Then, if given, up to max_intensity."""
    held = df
    if how == "root":
        held = df.withColumn("peaks", each(lambda p, _: F.pow(p["intensity"], F.lit(1 / degree)) if degree != 2 else F.sqrt(p["intensity"])))
    elif how == "log":
        held = df.withColumn("peaks", each(lambda p, _: F.log1p(p["intensity"]) / F.log(F.lit(float(base)))))
    elif how == "rank":
        falling = F.transform(F.array_sort(F.transform("peaks", lambda p, i: F.struct((-p["intensity"]).alias("x"), (-i).alias("i")))), lambda s: -s["i"])
        n = F.size("peaks") if max_rank is None else F.lit(max_rank)
        if max_rank is not None:
            n = F.when(F.size("peaks") <= max_rank, n).otherwise(F.raise_error(F.lit("max_rank is less than the number of peaks")).cast("int"))
        held = df.withColumn("_order", falling).withColumn("peaks", each(lambda p, i: (n - (F.array_position("_order", i) - 1)).cast("double"))).drop("_order")
    elif how != "off":
        raise ValueError(f"unknown scaling {how!r}")
    if max_intensity is not None:
        most = F.array_max(F.transform("peaks", lambda p: p["intensity"]))
        held = held.withColumn("_most", most).withColumn("peaks", each(lambda p, _: p["intensity"] * max_intensity / F.col("_most"))).drop("_most")
    return held


def each(value) -> F.Column:
    """Peaks with new intensities: value(peak, place from 0)."""
    return F.transform("peaks", lambda p, i: F.struct(p["mz"].alias("mz"), value(p, i).alias("intensity")))


def normalize(df: DataFrame) -> DataFrame:
    """Divide intensities by their Euclidean norm; a spectrum whose norm is 0 keeps its own."""
    norm = F.sqrt(F.aggregate("peaks", F.lit(0.0), lambda a, p: a + p["intensity"] * p["intensity"]))
    return df.withColumn("_norm", norm).withColumn("peaks", each(lambda p, _: F.when(F.col("_norm") > 0, p["intensity"] / F.col("_norm")).otherwise(p["intensity"]))).drop("_norm")


def pad(df: DataFrame, width: int, value: float = -1.0) -> DataFrame:
    """Columns mz and intensity as arrays of a fixed width, filled up with value."""
    fill = lambda name: F.concat(F.transform("peaks", lambda p: p[name]), F.array_repeat(F.lit(value), F.greatest(F.lit(0), width - F.size("peaks"))))
    return df.withColumn("mz", fill("mz")).withColumn("intensity", fill("intensity"))


def bucket(precursor_mz: F.Column, interval: float) -> F.Column:
    """Bucket of a precursor: its tenths, truncated, divided by interval and rounded down."""
    return F.floor((precursor_mz * 10).cast("long") / F.lit(float(interval))).cast("int")


def neutral_bucket(precursor_mz: F.Column, charge: F.Column, interval: float) -> F.Column:
    """Bucket of a precursor's neutral mass in bins of 1.0005079, rounded half to even."""
    bins = F.bround((precursor_mz - PROTON) * F.greatest(F.abs(charge), F.lit(1)) / BIN, 0)
    return F.floor(bins / F.lit(float(interval))).cast("int")


def assign_bucket(df: DataFrame, interval: float) -> DataFrame:
    return df.withColumn("bucket", bucket(F.col("precursor_mz"), interval))


def filter_charges(df: DataFrame, charges: tuple[int, ...] = ()) -> DataFrame:
    """Keep these charges; none given keeps all."""
    return df.where(F.col("precursor_charge").isin(list(charges))) if charges else df


def by_bucket(df: DataFrame) -> DataFrame:
    """The layout that grouped work wants: rows of a charge and bucket in one partition, sorted. Written tables keep it within files."""
    return df.repartition("precursor_charge", "bucket").sortWithinPartitions("bucket", "precursor_charge", "spectrum_id")


PEAKS = T.ArrayType(T.StructType([T.StructField("mz", T.DoubleType()), T.StructField("intensity", T.DoubleType())]))


def clean(b: pa.RecordBatch, p: Params) -> pa.RecordBatch:
    """Range, validity, precursor removal, validity, strongest peaks, validity and, if nothing is to be scaled, norm, of a batch at once. Nulls and NaN are judged as the expressions above judge them."""
    n, peaks = b.num_rows, b.column("peaks")
    flat = peaks.flatten()
    mzs, strength = flat.flatten()
    row = np.repeat(np.arange(n), pc.fill_null(pc.list_value_length(peaks), 0).to_numpy(zero_copy_only=False))
    # a null m/z becomes NaN, which lies in no range
    mz, x, unknown = (c.to_numpy(zero_copy_only=False) for c in (mzs, strength, strength.is_null()))
    mz, x = mz.astype(float), x.astype(float)
    good = np.ones(n, bool)

    def keep(which: np.ndarray) -> None:
        """Only these peaks, and of them those of valid spectra."""
        nonlocal row, mz, x, unknown, good
        row, mz, x, unknown = row[which], mz[which], x[which], unknown[which]
        count = np.bincount(row, minlength=n)
        end = count.cumsum()
        good = good & (count >= max(p.min_peaks, 1))
        some = np.flatnonzero(good)
        good[some] = mz[end[some] - 1] - mz[(end - count)[some]] >= p.min_mz_range
        which = good[row]
        row, mz, x, unknown = row[which], mz[which], x[which], unknown[which]

    keep((mz >= p.min_mz) & (mz <= p.max_mz))
    charge, precursor = b.column("precursor_charge"), b.column("precursor_mz")
    z = np.maximum(pc.fill_null(charge, 0).to_numpy(zero_copy_only=False).astype(np.int64), 0)
    neutral = (pc.fill_null(precursor, np.nan).to_numpy(zero_copy_only=False) - HYDROGEN) * z
    near = (precursor.is_null().to_numpy(zero_copy_only=False) & (z > 0))[row]
    for c in range(1, int(z.max(initial=0)) + 1):
        near |= (z[row] >= c) & (np.abs((neutral / c + HYDROGEN)[row] - mz) <= p.remove_precursor_tol)
    keep(~near)
    good[row[unknown]] = False  # a null would be the first in the order of intensity
    order = np.lexsort((mz, -x, row))
    row, mz, x, unknown = row[order], mz[order], x[order], unknown[order]
    count = np.bincount(row, minlength=n)
    first = (count.cumsum() - count)[row]
    least = x[first] * p.min_intensity
    strong = good[row] & ((x > least) | (np.isnan(x) & ~np.isnan(least)))
    if p.max_peaks_used is not None:
        strong &= np.arange(len(row)) - first < p.max_peaks_used
    order = np.lexsort((x, mz, row))
    row, mz, x, unknown, strong = row[order], mz[order], x[order], unknown[order], strong[order]
    keep(strong)
    if p.scaling == "off":
        norm = np.sqrt(np.bincount(row, x * x, n))[row]  # added up in order
        x = np.where(norm <= 0, x, np.divide(x, norm, where=norm != 0, out=x.copy()))
    at = np.r_[0, np.bincount(row, minlength=n)[good].cumsum()]
    made = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.StructArray.from_arrays([pa.array(mz), pa.array(x)], ["mz", "intensity"]))
    kept = b.filter(pa.array(good))
    return pa.RecordBatch.from_arrays([made if c == "peaks" else kept.column(c) for c in b.schema.names], names=b.schema.names)


def by_expressions(df: DataFrame, p: Params) -> DataFrame:
    """The steps of clean() by the operators above, for peaks or precursors of other types."""
    check = lambda d: valid_spectra(d, p.min_peaks, p.min_mz_range)
    df = check(filter_mz_range(df, p.min_mz, p.max_mz))
    df = check(remove_precursor(df, p.remove_precursor_tol))
    df = check(top_peaks(df, p.max_peaks_used, p.min_intensity))
    return normalize(scale_intensity(df, p.scaling))


def preprocess(df: DataFrame, p: Params) -> DataFrame:
    """The whole chain: range, validity, precursor removal, validity, strongest peaks, validity, scaling, norm, charges, bucket."""
    kinds = dict(df.dtypes)
    plain = (kinds["peaks"], kinds["precursor_mz"], kinds["precursor_charge"]) == (PEAKS.simpleString(), "double", "int")
    if not plain or p.min_mz is None or p.max_mz is None:
        return assign_bucket(filter_charges(by_expressions(df, p), p.cluster_charges), p.mz_interval)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(all="ignore"):
            for b in batches:
                yield clean(b, p)

    schema = T.StructType([T.StructField("peaks", PEAKS) if f.name == "peaks" else f for f in df.schema.fields])
    made = filter_charges(df, p.cluster_charges).mapInArrow(run, schema)
    if p.scaling != "off":
        made = normalize(scale_intensity(made, p.scaling))
    return assign_bucket(made, p.mz_interval)


def baseline_filter(df: DataFrame, low: float = 0.0, high: float = 1500.0, least_range: float = 5.0) -> DataFrame:
    """Peaks within [low, high]; spectra that keep none or span less than least_range are dropped."""
    df = filter_mz_range(df, low, high)
    span = F.array_max(F.transform("peaks", lambda p: p["mz"])) - F.array_min(F.transform("peaks", lambda p: p["mz"]))
    return df.where((F.size("peaks") > 0) & (span >= least_range))


def bin_spectra(df: DataFrame, low: float, high: float, width: float) -> DataFrame:
    """(spectrum_id, bin, intensity): intensities summed per bin of width, truncated from low; peaks beyond the last whole bin are left out."""
    bins = int((high - low) / width)
    long = df.select("spectrum_id", F.explode("peaks").alias("p")).select("spectrum_id", ((F.col("p.mz") - low) / width).cast("int").alias("bin"), F.col("p.intensity").alias("intensity"))
    return long.where((F.col("bin") >= 0) & (F.col("bin") < bins)).groupBy("spectrum_id", "bin").agg(F.sum("intensity").alias("intensity"))


def log_magnitude(binned: DataFrame) -> DataFrame:
    """Binned intensities as log1p, with the spectrum's log1p of their sum beside them."""
    whole = binned.groupBy("spectrum_id").agg(F.log1p(F.sum("intensity")).alias("magnitude"))
    return binned.join(whole, "spectrum_id").select("spectrum_id", "bin", F.log1p("intensity").alias("log_intensity"), "magnitude")


def base_peak(df: DataFrame) -> DataFrame:
    """(spectrum_id, base_mz, base_intensity): the most intense peak, the first of equal ones."""
    best = F.array_max(F.transform("peaks", lambda p: F.struct(p["intensity"].alias("intensity"), (-p["mz"]).alias("mz"))))
    return df.where(F.size("peaks") > 0).select("spectrum_id", (-best["mz"]).alias("base_mz"), best["intensity"].alias("base_intensity"))


def nearest_peak(df: DataFrame, target: float) -> DataFrame:
    """(spectrum_id, near_mz, near_intensity): the peak nearest to target, the lower of equally near ones, then the more intense."""
    best = F.array_min(F.transform("peaks", lambda p: F.struct(F.abs(p["mz"] - target).alias("d"), p["mz"].alias("mz"), (-p["intensity"]).alias("i"))))
    return df.where(F.size("peaks") > 0).select("spectrum_id", best["mz"].alias("near_mz"), (-best["i"]).alias("near_intensity"))


def remass(df: DataFrame, low: float, high: float) -> DataFrame:
    """Spectra with a new precursor m/z between low and high, drawn by a hash of their id; the old one is kept as original_mz. Peaks stay."""
    u = F.conv(F.substring(F.md5(F.col("spectrum_id").cast("string")), 1, 8), 16, 10).cast("double") / 4294967296.0
    return df.withColumn("original_mz", F.col("precursor_mz")).withColumn("precursor_mz", low + u * (high - low))


def natural_key(df: DataFrame) -> DataFrame:
    """The key columns in canonical form: identifier trimmed, scan whole, retention time to four places."""
    return df.withColumn("identifier", F.trim("identifier")).withColumn("scan", F.col("scan").cast("int")).withColumn("retention_time", F.round("retention_time", 4))


def overwrite_charge(df: DataFrame, marker: str, charge: int) -> DataFrame:
    """df with this charge for spectra whose identifier contains the marker."""
    return df.withColumn("precursor_charge", F.when(F.col("identifier").contains(marker), charge).otherwise(F.col("precursor_charge")))
