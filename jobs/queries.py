"""The jobs as queries: each runs its job twice into a new folder under the shared one, leaves the files and returns the output read back; with the same result in SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peakgrid.plans.queries import BIT, FULL, TOL, WIDE, P, rounded
from peakgrid.plans.scratch import shared_dir

from . import spectral_library, text_watch


def folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def job1_spectral_library(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = folder(spark, "job1")
    for _ in range(2):
        spectral_library.run(spark, sf_dir, out)
    return rounded(spectral_library.read(spark, out))


def job2_text_watch(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = folder(spark, "job2")
    for _ in range(2):
        text_watch.run(spark, f"{sf_dir}/documents.parquet", f"{out}/out", f"{out}/checkpoint")
    return text_watch.read(spark, f"{out}/out").withColumn("anomaly_eps", F.round("anomaly_eps", 6))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (job1_spectral_library, job2_text_watch)}

_S = text_watch.Settings.read(text_watch.CONFIG)
_DIM = _S.p.hd_dim

SQL: dict[str, str] = {
    "job1_spectral_library": f"""WITH RECURSIVE {WIDE},
enc AS (SELECT clean.* FROM clean JOIN (SELECT DISTINCT spectrum_id FROM pk) USING (spectrum_id)),
pair AS (SELECT a.spectrum_id AS id_a, b.spectrum_id AS id_b FROM enc a JOIN enc b ON a.precursor_charge = b.precursor_charge AND a.bucket = b.bucket AND a.spectrum_id < b.spectrum_id WHERE abs(a.precursor_mz - b.precursor_mz) / b.precursor_mz < {TOL!r}),
edge AS (SELECT id_a, id_b, sum(bit_count(xor(a.word, b.word))) / {FULL}::DOUBLE AS dist FROM pair JOIN wide a ON a.spectrum_id = id_a JOIN wide b ON b.spectrum_id = id_b AND a.w = b.w GROUP BY ALL),
both_ways AS (SELECT id_a AS a, id_b AS b FROM edge WHERE dist <= {P.eps} UNION ALL SELECT id_b, id_a FROM edge WHERE dist <= {P.eps}),
reach AS (SELECT a AS n, a AS r FROM both_ways UNION SELECT b.b, reach.r FROM reach JOIN both_ways b ON b.a = reach.n),
comp AS (SELECT n AS spectrum_id, min(r) AS cluster FROM reach GROUP BY n),
clu AS (SELECT enc.*, cluster FROM enc LEFT JOIN comp USING (spectrum_id)),
size AS (SELECT cluster, count(*) AS n, min(spectrum_id) AS first FROM clu WHERE cluster IS NOT NULL GROUP BY cluster),
close AS (SELECT e.id_a AS spectrum_id, sum(1 - dist) AS near FROM (SELECT id_a, id_b, dist FROM edge UNION ALL SELECT id_b, id_a, dist FROM edge) e JOIN clu a ON a.spectrum_id = e.id_a JOIN clu b ON b.spectrum_id = e.id_b WHERE a.cluster = b.cluster GROUP BY 1),
mean AS (SELECT clu.spectrum_id, clu.cluster, n, first, round((n - 1 - coalesce(near, 0)) / n, 9) AS m FROM clu JOIN size USING (cluster) LEFT JOIN close USING (spectrum_id)),
rep AS (SELECT cluster, CASE WHEN n <= 2 THEN first ELSE spectrum_id END AS rep FROM mean QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY m, spectrum_id) = 1)
SELECT spectrum_id, bucket, round(precursor_mz, 6) AS precursor_mz, clu.cluster, dense_rank() OVER (ORDER BY precursor_charge, bucket, clu.cluster IS NULL, coalesce(clu.cluster, spectrum_id)) - 1 AS label,
  coalesce(n, 1) AS n_spectra, clu.cluster IS NULL OR rep = spectrum_id AS is_representative, precursor_charge
FROM clu LEFT JOIN size USING (cluster) LEFT JOIN rep USING (cluster)""",
    "job2_text_watch": f"""WITH letter AS (SELECT unnest(string_split('{_S.letters}', '')) AS letter, {text_watch.FIRST_MZ} + generate_subscripts(string_split('{_S.letters}', ''), 1) - 1 AS m),
doc AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(nullif(lang, ''), 'und') AS lang, lower(coalesce(text, '')) AS t FROM documents),
cnt AS (SELECT rid, lang, m, (length(t) - length(replace(t, letter, '')))::DOUBLE AS x FROM doc, letter),
ranked AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY x DESC, m) AS r, max(x) OVER (PARTITION BY rid) AS top FROM cnt WHERE x > 0),
kept AS (SELECT rid, lang, m, x / sqrt(sum(x * x) OVER (PARTITION BY rid)) AS x FROM ranked WHERE r <= {_S.p.max_peaks_used} AND x > {_S.p.min_intensity}::DOUBLE * top),
pk AS (SELECT rid, lang, m, cast(floor(x * {_S.p.hd_q}) AS INTEGER) AS l FROM kept),
lv AS (SELECT l, d, 2 * ({BIT.format("'lv' || l")}) - 1 AS v FROM (SELECT DISTINCT l FROM pk), range({_DIM}) r(d)),
iv AS (SELECT m, d, 2 * ({BIT.format("'id' || m")}) - 1 AS v FROM (SELECT DISTINCT m FROM pk), range({_DIM}) r(d)),
bits AS (SELECT rid, lang, lv.d, sum(lv.v * iv.v) > 0 AS up FROM pk JOIN lv USING (l) JOIN iv ON iv.m = pk.m AND iv.d = lv.d GROUP BY ALL),
prof AS (SELECT lang, d, count_if(up) > count(*) // 2 AS up FROM bits GROUP BY ALL),
far AS (SELECT rid, bits.lang, count_if(bits.up <> prof.up) / {_DIM}::DOUBLE AS dist FROM bits JOIN prof USING (lang, d) GROUP BY ALL),
hist AS (SELECT lang, dist, count(*) AS n FROM far GROUP BY ALL),
cum AS (SELECT *, sum(n) OVER (PARTITION BY lang ORDER BY dist) AS c, sum(n) OVER (PARTITION BY lang) AS a FROM hist),
eps AS (SELECT lang, least(min(dist) + {_S.p.anomaly_margin}::DOUBLE, {_S.p.anomaly_cap}::DOUBLE) AS anomaly_eps FROM cum WHERE c >= {_S.p.anomaly_percentile}::DOUBLE / 100 * a GROUP BY lang)
SELECT doc_id, source, dist, round(anomaly_eps, 6) AS anomaly_eps, coalesce(dist > anomaly_eps, true) AS anomaly, 0 AS batch, doc.lang
FROM doc LEFT JOIN far USING (rid) LEFT JOIN eps ON eps.lang = doc.lang""",
}
