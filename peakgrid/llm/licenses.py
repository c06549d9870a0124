"""License scans: MinHash bands over overlapping text windows retrieve templates, exact shingle containment verifies them.

A template is cut into segments of up to SEGMENT shingles and a document into blocks of BLOCK shingles, which overlap in their words;
each gets one minimum per hash function. A band is one function: a block that holds the segment's least shingle retrieves it unless one
of the block's at most BLOCK - 1 foreign shingles is smaller. So a segment of s shingles of which m are present is retrieved by a band
with a probability of at least m / (s + BLOCK - 1): one of the m must be the least of all of them. A text that holds LEAST of a
template has most of it in most segments (see bands_for), and as many bands are taken as bring the chance to miss a segment of these
to MISS at most. A document and a template become a candidate if a quarter of the segments are retrieved. Candidates are verified once, on
shingles as words, not as hashes: each place of a shingle counts for the windows that begin in one range, and adding up the ranges' ends
gives every window's containment.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, native
from .license_texts import NOTICES, WHOLE

WIDTH, BLOCK, SEGMENT = 3, 4, 8
#: Chance to miss a segment that holds enough, at most.
MISS = 2.0**-14
#: Least share of a template's shingles in a window.
LEAST = 0.8
TEMPLATES = NOTICES | WHOLE
#: Bytes of a row of the segments' keys, about, and of a template's shingles.
KEY_BYTES, SHINGLE_BYTES = 96, 128


def bands_for(shingles: int, least: float = LEAST, segment: int = SEGMENT, block: int = BLOCK, miss: float = MISS) -> int:
    """Bands that a template of so many shingles needs.

    A template of one segment has at least least * shingles present. Of a longer one at most (1 - least) of the shingles are missing; a
    segment with less than m present lacks over segment - m, so that there are at most (1 - least) * segment / (segment + 1 - m) such segments
    of all: the greatest m is taken that leaves half of them, twice as many as make a candidate.
    """
    if shingles <= segment:
        present, size = math.ceil(least * shingles - 1e-9), shingles
    else:
        present = max((m for m in range(1, segment + 1) if (1 - least) * segment / (segment + 1 - m) <= 0.5 + 1e-9), default=1)
        size = segment
    hit = present / (size + block - 1)
    return 1 if hit >= 1 else math.ceil(math.log(miss) / math.log(1 - hit))


def banded(df: DataFrame, size: int, bands: int) -> DataFrame:
    """df with a row per block of so many of the hashes in column hs, and per band: at is the block's place, key the least of its hashes under the band's hash function, marked with the band's number. An empty or null hs gives no row."""
    n = F.size("hs")
    blocks = F.when(n > 0, F.sequence(F.lit(0), F.floor((n - 1) / size).cast("int") * bands + bands - 1))
    each = df.select("*", F.explode(blocks).alias("_i"))
    each = each.select(*df.columns, F.expr(f"cast(_i div {bands} as int) * {size}").alias("at"), (F.col("_i") % bands).alias("_band"))
    first = F.get("hs", F.col("at"))
    least = F.least(*[F.xxhash64(F.coalesce(F.get("hs", F.col("at") + k), first) if k else first, "_band") for k in range(size)])
    return each.select(*df.columns, "at", F.xxhash64(least, F.col("_band")).alias("key"))


def hashes(array: str, width: int) -> F.Column:
    """Hashes of all shingles of the words in a column; null if there are too few words."""
    n = F.size(array) - width + 1
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: native.shingle(array, i, width)))


def template_words(spark: SparkSession, texts: dict[str, str], width: int) -> DataFrame:
    """(license, tw, tn): words of each template and the number of its shingles."""
    named = spark.range(1).select(F.explode(F.create_map(*[F.lit(x) for both in texts.items() for x in both])).alias("license", "text"))
    return named.select("license", native.words("text").alias("tw")).withColumn("tn", F.size("tw") - width + 1).where("tn > 0")


def segments(held: DataFrame, width: int, segment: int, bands: int) -> DataFrame:
    """(license, need, off, key): a row per segment and band. need is the number of segments that make a candidate."""
    need = F.greatest(F.lit(1), F.floor(F.ceil(F.col("tn") / segment) / 4)).cast("int")
    return banded(held.select("license", need.alias("need"), hashes("tw", width).alias("hs")), segment, bands).select("license", "need", F.col("at").alias("off"), "key")


def shingle_words(array: str, width: int) -> F.Column:
    """All shingles of the words in a column, as text."""
    n = F.size(array) - width + 1
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(array, i, width), " ")))


def read_templates(spark: SparkSession, path: str) -> dict[str, str]:
    """Licence texts of a folder of text files, by file name without its ending; one text per file, of files of equal names one. They come to the driver, which is to hold them all: some hundreds of texts of up to 100 KB. A folder without files gives no texts."""
    rows = spark.read.text(path, wholetext=True).select(F.regexp_replace(F.col("_metadata.file_name"), "\\.[^.]*$", "").alias("name"), "value").collect()
    return {r["name"]: r["value"] for r in rows}


def scan(docs: DataFrame, texts: dict[str, str] | None = None, least: float = LEAST, width: int = WIDTH, block: int = BLOCK, segment: int = SEGMENT, bands: int | None = None, broadcast_rows: int = native.BROADCAST_ROWS) -> DataFrame:
    """Per document and template that it holds: doc_id, license, containment (the greatest share of the template's distinct shingles in a window of the template's length), first_word (where the first such window begins) and n_places (separate runs of window starts that reach `least`).

    Words are compared with A-Z lower-cased. A null or short text holds nothing; repeated rows are one document, and so are rows with a
    null doc_id and equal texts; ties in containment go to the first window. Texts of any length are read whole. Other columns of docs,
    whatever their names, are left alone; an empty table gives no rows. Templates must have width words at least. Their keys are broadcast,
    as many at a time as are within the limits of rows and bytes; a single template beyond them is joined by a shuffle. bands are those that
    the templates need if not given.
    """
    texts = TEMPLATES if texts is None else texts
    sizes = {name: len(text.split()) for name, text in texts.items()}
    for name, n in sizes.items():
        if n < width:
            raise ValueError(f"template {name!r} has fewer than {width} words")
    bands = bands or max((bands_for(n - width + 1, least, segment, block) for n in sizes.values()), default=1)
    parts: list[dict[str, str]] = [{}]
    rows = 0
    most = min(broadcast_rows, native.BROADCAST_BYTES // KEY_BYTES)
    for name, text in texts.items():
        more = bands * (2 * sizes[name] // segment + 1)  # marks may part more words than white space does
        if parts[-1] and rows + more > most:
            parts.append({})
            rows = 0
        parts[-1][name] = text
        rows += more
    return reduce(DataFrame.unionByName, [scan_part(docs, part or {"none": " ".join(["-"] * width)}, least, width, block, segment, bands, broadcast_rows) for part in parts])


def scan_part(docs: DataFrame, texts: dict[str, str], least: float, width: int, block: int, segment: int, bands: int, broadcast_rows: int) -> DataFrame:
    held = common.table(template_words(docs.sparkSession, texts, width))
    near = lambda df, size: F.broadcast(df) if native.few(df, size, broadcast_rows) else df
    src = common.pick(docs, "doc_id", "text").withColumn("key", F.xxhash64("text"))
    worded = src.select("doc_id", F.col("key").alias("text_key"), native.words("text").alias("w"))
    keys = banded(worded.select("doc_id", "text_key", hashes("w", width).alias("hs")), block, bands)
    met = keys.join(near(common.table(segments(held, width, segment, bands)), KEY_BYTES), "key").select("doc_id", "text_key", "license", "need", "off")
    found = met.groupBy("doc_id", "text_key", "license", "need").agg(F.countDistinct("off").alias("n")).where("n >= need")
    found = common.table(found.select(F.col("doc_id").alias("_id"), "text_key", "license"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("text_key"))
    few = native.few(found, KEY_BYTES, broadcast_rows)
    pairs = src.join(F.broadcast(found), same).select("doc_id", "key", "license", "text") if few else src
    marked = ["license"] if few else []
    placed = pairs.select("doc_id", "key", *marked, native.words("text").alias("w"))
    placed = placed.select("doc_id", "key", *marked, (F.size("w") - width + 1).alias("n"), F.posexplode(shingle_words("w", width)).alias("p", "shingle"))
    theirs = held.select("license", "tn", F.array_distinct(shingle_words("tw", width)).alias("s")).select("license", "tn", F.size("s").alias("distinct"), F.explode("s").alias("shingle"))
    hits = placed.join(near(common.table(theirs), SHINGLE_BYTES), [*marked, "shingle"])
    if not few:  # so many candidates aren't broadcast, and texts aren't shuffled to meet them: hits alone are
        hits = hits.join(found.withColumnRenamed("license", "_license"), same & (F.col("license") == F.col("_license")), "left_semi")
    one = ["doc_id", "key", "license"]  # one exchange by these serves all that follows
    hits = hits.repartition(*one).dropDuplicates([*one, "p"])
    before = F.lag("p").over(Window.partitionBy(*one, "shingle").orderBy("p"))
    # the windows that begin from low to high hold this place of the shingle and none before it
    last = F.greatest(F.lit(0), F.col("n") - F.col("tn"))
    low = F.greatest(F.lit(0), F.col("p") - F.col("tn") + 1, F.coalesce(before + 1, F.lit(0)))
    spans = hits.select(*one, "distinct", low.alias("low"), F.least("p", last).alias("high")).where("low <= high")
    ends = spans.select(*one, "distinct", F.explode(F.array(F.struct(F.col("low").alias("at"), F.lit(1).alias("by")), F.struct((F.col("high") + 1).alias("at"), F.lit(-1).alias("by")))).alias("e"))
    steps = ends.groupBy(*one, "distinct", "e.at").agg(F.sum("e.by").alias("by"))
    line = Window.partitionBy(*one).orderBy("at")
    shares = steps.withColumn("share", F.sum("by").over(line) / F.col("distinct"))
    shares = shares.withColumn("begins", (F.col("share") >= least) & (F.coalesce(F.lag("share").over(line), F.lit(0.0)) < least))
    best = shares.groupBy(*one).agg(F.max(F.struct("share", (-F.col("at")).alias("f"))).alias("b"), F.count_if("begins").alias("n_places")).where(F.col("b.share") >= least)
    return best.select("doc_id", "license", F.round("b.share", 6).alias("containment"), (-F.col("b.f")).cast("long").alias("first_word"), F.col("n_places").cast("long").alias("n_places"))


def sql(texts: dict[str, str], least: float = LEAST) -> str:
    """scan() of documents with three-word shingles, straight from the definition, for all documents and templates."""
    quoted = ", ".join("('{}', '{}')".format(*(x.replace("'", "''") for x in both)) for both in texts.items())
    words = "list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^0-9a-z\\x{80}-\\x{10FFFF}]+'), lambda x: x <> '') AS w"
    return f"""
WITH tw AS (SELECT license, {words} FROM (VALUES {quoted}) t(license, text)),
ts AS (SELECT DISTINCT license, len(w) - 2 AS tn, array_to_string(w[s:s + 2], ' ') AS shingle FROM (SELECT license, w, unnest(range(1, len(w) - 1)) AS s FROM tw)),
td AS (SELECT license, count(*) AS d FROM ts GROUP BY license),
doc AS (SELECT row_number() OVER () AS r, doc_id, {words} FROM (SELECT DISTINCT doc_id, text FROM documents)),
pos AS (SELECT r, doc_id, n, p, array_to_string(w[p + 1:p + 3], ' ') AS shingle FROM (SELECT r, doc_id, w, len(w) - 2 AS n, unnest(range(0, len(w) - 2)) AS p FROM doc)),
hit AS (SELECT r, doc_id, license, n, tn, p, lag(p) OVER (PARTITION BY r, license, shingle ORDER BY p) AS before FROM pos JOIN ts USING (shingle)),
span AS (SELECT r, doc_id, license, greatest(0, p - tn + 1, coalesce(before + 1, 0)) AS low, least(p, greatest(0, n - tn)) AS high FROM hit),
step AS (
  SELECT r, doc_id, license, spot, sum(change) AS change
  FROM (SELECT r, doc_id, license, low AS spot, 1 AS change FROM span WHERE low <= high UNION ALL SELECT r, doc_id, license, high + 1, -1 FROM span WHERE low <= high) GROUP BY ALL),
share AS (SELECT r, doc_id, license, spot, sum(change) OVER (PARTITION BY r, license ORDER BY spot) / d::DOUBLE AS share FROM step JOIN td USING (license)),
run AS (SELECT *, share >= {least}::DOUBLE AND coalesce(lag(share) OVER (PARTITION BY r, license ORDER BY spot), 0) < {least}::DOUBLE AS begins, max(share) OVER (PARTITION BY r, license) AS top FROM share)
SELECT doc_id, license, round(max(share), 6) AS containment, cast(min(CASE WHEN share = top THEN spot END) AS BIGINT) AS first_word, cast(count(*) FILTER (begins) AS BIGINT) AS n_places
FROM run GROUP BY r, doc_id, license HAVING max(share) >= {least}::DOUBLE
"""
