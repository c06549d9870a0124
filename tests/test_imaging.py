import zlib

import numpy as np
import pytest
from peakgrid.sources import imaging, mgf
from pyspark.sql import functions as F

HEAD = """<?xml version="1.0"?><mzML><referenceableParamGroupList count="2">
<referenceableParamGroup id="mzs"><cvParam cvRef="MS" accession="MS:1000514" name="m/z array" value=""/><cvParam accession="MS:1000523" value=""/>{mz}</referenceableParamGroup>
<referenceableParamGroup id="ints"><cvParam accession="MS:1000515" value=""/><cvParam accession="MS:1000521" value=""/></referenceableParamGroup>
</referenceableParamGroupList><run><spectrumList count="9">"""
ARRAY = '<binaryDataArray encodedLength="0"><referenceableParamGroupRef ref="{ref}"/><cvParam accession="IMS:1000103" name="n" value="{n}"/><cvParam accession="IMS:1000104" value="{size}"/><cvParam name="at" value="{at}" accession="IMS:1000102"/><binary/></binaryDataArray>'


def image(folder, name, pixels, packed=False):
    """Write name.imzML and name.ibd of (x, y, m/z values, intensities)."""
    data, xml = bytearray(16), [HEAD.format(mz='<cvParam accession="MS:1000574" value=""/>' if packed else "")]
    for k, (x, y, mz, intensity) in enumerate(pixels):
        arrays = []
        for ref, values, dtype in (("mzs", mz, "<f8"), ("ints", intensity, "<f4")):
            raw = np.array(values, dtype).tobytes()
            raw = zlib.compress(raw) if packed and ref == "mzs" else raw
            arrays.append(ARRAY.format(ref=ref, n=len(values), size=len(raw), at=len(data)))
            data += raw
        at = f'<cvParam accession="IMS:1000050" value="{x}"/><cvParam accession="IMS:1000051" value="{y}"/>'
        xml.append(f'\n<spectrum id="s{k}" defaultArrayLength="0" index="{k}"><scan>{at}</scan><binaryDataArrayList count="2">{"".join(arrays)}</binaryDataArrayList></spectrum>')
    (folder / f"{name}.imzML").write_text("".join(xml) + "</spectrumList></run></mzML>")
    (folder / f"{name}.ibd").write_bytes(bytes(data))
    return str(folder / f"{name}.imzML")


def pixels(n, seed):
    rng = np.random.default_rng(seed)
    return [(k % 4 + 1, k // 4 + 1, np.sort(rng.uniform(50, 500, m := int(rng.integers(0, 9)))), rng.integers(1, 99, m).astype(float)) for k in range(n)]


@pytest.mark.parametrize("packed", [False, True])
def test_pixels_come_back(spark, tmp_path, packed):
    wanted = {name: pixels(12, k) for k, name in enumerate(["a", "b c"])}
    paths = [image(tmp_path, name, p, packed) for name, p in wanted.items()]
    rows = imaging.read(spark, paths).collect()
    assert len(rows) == 24
    for r in rows:
        x, y, mz, intensity = wanted["a" if r.source_file.endswith("/a.imzML") else "b c"][r.pixel]
        assert (r.x, r.y, r.z) == (x, y, 1)
        assert [(p.mz, p.intensity) for p in r.peaks] == list(zip(mz.tolist(), intensity.tolist()))


def test_spectra_of_pixels(spark, tmp_path):
    wanted = {"a": pixels(12, 1), "b": pixels(8, 2)}
    got = imaging.spectra(imaging.read(spark, [image(tmp_path, n, p) for n, p in wanted.items()]), 50, 500, "t")
    rows = got.collect()
    assert len(rows) == sum(len(p[2]) > 0 for ps in wanted.values() for p in ps)
    for r in rows:
        ps = wanted[r.identifier]
        x, y, mz, intensity = ps[r.scan - 1]
        x0, x1, y0, y1 = (f(p[k] for p in ps) for k in (0, 1) for f in (min, max))
        mass = 50 + (((y - y0) / max(y1 - y0, 1) + (x - x0) / max(x1 - x0, 1) / max(x1 - x0 + 1, 1)) % 1) * 450
        assert r.precursor_mz == pytest.approx(mass)
        assert r.precursor_intensity == intensity[int(np.argmin(np.abs(mz - mass)))]
        assert r.title == f"spectrum_{r.scan - 1}_x{x}_y{y}_z1_t"
    mgf.write(got.withColumn("spectrum_id", F.xxhash64("title", "identifier")), str(tmp_path / "out"), F.col("title"))
    assert mgf.read(spark, str(tmp_path / "out"), raw=True).count() == len(rows)


def test_an_image_without_spectra_and_a_cut_file(spark, tmp_path):
    assert imaging.read(spark, image(tmp_path, "none", [])).collect() == []
    path = image(tmp_path, "cut", [(1, 1, [60.0, 70.0], [1.0, 2.0])])
    (tmp_path / "cut.ibd").write_bytes((tmp_path / "cut.ibd").read_bytes()[:-4])
    with pytest.raises(Exception, match="pixel 0"):
        imaging.read(spark, path).collect()
