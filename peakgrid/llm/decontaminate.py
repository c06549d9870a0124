"""Benchmark decontamination as a prefix-filtered set join.

The sets are the word shingles of item-sized windows. Shingles are ordered by rarity, counted over all documents. A document that
holds a whole window holds every shingle of it, so that a prefix of one shingle, the rarest, is necessary and enough to find it; only
those are joined. The shingle's place in the window gives the one position at which the window can begin: it must lie within the
document (positional and length bounds), and there the words themselves are compared.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, native

WINDOW = 13
#: Words of a shingle; an item of fewer words is one shingle.
WIDTH = 3


def windows(benchmark: DataFrame, window: int = WINDOW, width: int = WIDTH) -> DataFrame:
    """(win, len, k, items, at, h): each distinct window's words, their number, its shingles' width, the items that hold it, and a row for each of its shingles with its place and hash. Items without words have none."""
    items = common.pick(benchmark, "item_id", "text").select("item_id", native.words("text").alias("w"), F.size(native.words("text")).alias("n")).where("n > 0")
    starts = items.select("item_id", "w", F.least("n", F.lit(window)).alias("len"), F.explode(F.sequence(F.lit(0), F.greatest(F.col("n") - window, F.lit(0)))).alias("s"))
    win = starts.select("item_id", "len", F.slice("w", F.col("s") + 1, F.col("len")).alias("win")).groupBy("win", "len").agg(F.collect_set("item_id").alias("items"))
    win = win.withColumn("k", F.least("len", F.lit(width)))
    each = win.select("*", F.explode(F.sequence(F.lit(0), F.col("len") - F.col("k"))).alias("at"))
    return each.withColumn("h", hashed("win", F.col("at"), F.col("k"), width))


def hashed(array: str, at: F.Column, k: F.Column, width: int) -> F.Column:
    """Hash of the k words from at on, 1 to width of them."""
    out = native.shingle(array, at, width)
    for n in range(1, width):
        out = F.when(k == n, native.shingle(array, at, n)).otherwise(out)
    return out


def positions(docs: DataFrame, widths: list[int]) -> DataFrame:
    """(…, w, n, at, k, h): a row for each document's shingle of each width, and one with at = -1 and no hash for the document itself."""
    made = docs.withColumn("w", native.words("text")).withColumn("n", F.size("w"))
    rest = [c for c in made.columns if c != "text"]
    made = made.select(*rest, F.explode(F.sequence(F.lit(-1), F.col("n") - 1)).alias("at"))
    inside = lambda k: (F.col("at") >= 0) & (F.col("at") + k <= F.col("n"))
    if len(widths) == 1:
        (k,) = widths
        return made.withColumn("k", F.lit(k)).withColumn("h", F.when(inside(k), native.shingle("w", F.col("at"), k)))
    made = made.withColumn("k", F.explode(F.array(*map(F.lit, widths)))).where((F.col("at") >= 0) | (F.col("k") == widths[0]))
    h = F.lit(None).cast("long")
    for k in widths:
        h = F.when((F.col("k") == k) & inside(k), native.shingle("w", F.col("at"), k)).otherwise(h)
    return made.withColumn("h", h)


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, width: int = WIDTH, broadcast_rows: int = native.BROADCAST_ROWS) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_hit (words inside any occurrence of a window), items (sorted ids, as strings, of the items with occurring windows), n_items.

    A null text has no words. An item with a null id marks words but isn't listed. Repeated rows, and rows with a null doc_id, each
    get a row of their own. Texts of any length are read whole; an empty table of documents gives no rows, an empty benchmark no hits;
    other columns of either, whatever their names, are left alone. The prefix is broadcast if its counted rows are within broadcast_rows and the byte limit. Beyond that only
    positions and hashes are shuffled to it, the bounds are applied, and the words of the few documents that are left are joined again.
    """
    win = common.table(windows(benchmark, window, width))
    widths = [r[0] for r in win.select("k").distinct().orderBy("k").collect()] or [width]
    src = common.pick(docs, "doc_id", "text")
    # how often each of the benchmark's shingles stands in the documents
    wanted = win.select("h").distinct()
    every = positions(src.select("text"), widths).where("h is not null").select("h")
    if native.few(wanted, 64, broadcast_rows):
        often = every.join(F.broadcast(wanted), "h").groupBy("h").agg(F.count("*").alias("df"))
    else:  # counted before joining, so that a common line's shingles are not dealt to one task
        often = every.groupBy("h").agg(F.count("*").alias("df")).join(wanted, "h")
    ranked = win.join(common.table(often), "h").withColumn("rank", F.row_number().over(Window.partitionBy("win", "len").orderBy("df", "h", "at")))
    # a window one of whose shingles stands nowhere can't occur
    whole = win.groupBy("win", "len").agg(F.count("*").alias("all")).join(ranked.groupBy("win", "len").agg(F.count("*").alias("found")), ["win", "len"]).where("all = found").select("win", "len")
    prefix = common.table(ranked.where("rank = 1").join(whole, ["win", "len"]).select("h", F.col("at").alias("off"), "len", "win", "items", "df"))
    keyed = positions(src.withColumn("key", F.xxhash64("text")), widths)
    start = F.col("at") - F.col("off")
    begins = (start >= 0) & (start + F.col("len") <= F.col("n"))
    same = F.slice("w", start + 1, F.col("len")) == F.col("win")
    hit = F.when((F.col("at") >= 0) & begins, same)
    own = (F.col("at") == -1).alias("own")
    if native.few(prefix, 64 + 24 * window, broadcast_rows):
        # own is the document's row itself; verifying stands in the projection, so that it is evaluated for joined rows alone
        met = keyed.join(F.broadcast(prefix), "h", "left").where("at = -1 or win is not null")
        met = met.select("doc_id", "key", "n", own, hit.alias("hit"), start.alias("s"), "len", "items").where("own or hit")
    else:
        narrow = keyed.select("doc_id", "key", "n", "at", "h")
        # the prefix's most frequent shingles are broadcast, as many as may be; the others are rare enough to be shuffled
        rare = prefix.agg(F.percentile_approx("df", F.lit(max(0.0, 1 - broadcast_rows / 2 / max(prefix.count(), 1))), 10_000)).first()[0] or 0
        placed = narrow.where("h is not null")
        both = placed.join(F.broadcast(prefix.where(F.col("df") > rare)), "h").unionByName(placed.join(prefix.where(F.col("df") <= rare), "h"))
        near = both.where(begins).select("doc_id", "key", "n", start.alias("s"), "len", "win", "items")
        words = src.select(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_key"), native.words("text").alias("w")).dropDuplicates(["_id", "_key"])
        again = near.join(words, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key")))
        found = again.where(F.slice("w", F.col("s") + 1, F.col("len")) == F.col("win")).select("doc_id", "key", "n", F.lit(False).alias("own"), F.lit(True).alias("hit"), "s", "len", "items")
        alone = narrow.where("at = -1").select("doc_id", "key", "n", F.lit(True).alias("own"), F.lit(None).cast("boolean").alias("hit"), F.lit(None).cast("int").alias("s"), F.lit(None).cast("int").alias("len"), F.lit(None).cast(prefix.schema["items"].dataType).alias("items"))
        met = alone.unionByName(found)
    span = F.when(F.col("hit"), F.struct("s", (F.col("s") + F.col("len")).alias("e")))
    doc = met.groupBy("doc_id", "key", "n").agg(F.count_if("own").alias("rows"), F.array_sort(F.collect_set(span)).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.transform("items", lambda x: x.cast("string")))))).alias("items"))
    zero = F.struct(F.lit(0).cast("long").alias("hit"), F.lit(0).alias("end"))

    def add(a: F.Column, x: F.Column) -> F.Column:
        return F.struct((a["hit"] + F.greatest(F.lit(0), x["e"] - F.greatest(x["s"], a["end"]))).cast("long").alias("hit"), F.greatest(a["end"], x["e"]).alias("end"))

    out = doc.select("doc_id", F.col("n").cast("long").alias("n_words"), F.aggregate("spans", zero, add)["hit"].alias("n_hit"), "items", "rows")
    return out.select("doc_id", "n_words", "n_hit", "items", F.size("items").cast("long").alias("n_items"), F.explode(F.expr("sequence(1, cast(rows as int))")).alias("_")).drop("_")


def contaminated() -> F.Column:
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, width: int = WIDTH) -> DataFrame:
    """docs without contaminated documents. A document without an id is judged like any other."""
    cols = docs.columns
    text = f"_{cols.index('text')}"
    bad = scan(common.pick(docs, "doc_id", "text").select(F.xxhash64("text").alias("doc_id"), "text"), benchmark, window, width).where(contaminated()).select(F.col("doc_id").alias("key")).distinct()
    return common.numbered(docs).withColumn("key", F.xxhash64(text)).join(bad, "key", "left_anti").drop("key").toDF(*cols)


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), contaminated().alias("contaminated"))


#: The same result, straight from the definition.
SQL = """
WITH it AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^0-9a-z\\x{80}-\\x{10FFFF}]+'), lambda x: x <> '') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[s:s + least(len(w), 13) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS s FROM it WHERE len(w) > 0)),
doc AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^0-9a-z\\x{80}-\\x{10FFFF}]+'), lambda x: x <> '') AS w FROM documents),
gram AS (
  SELECT r, s, n, array_to_string(w[s:s + n - 1], ' ') AS win
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM doc, (SELECT DISTINCT n FROM win))),
hit AS (SELECT r, s, gram.n, item_id FROM gram JOIN win ON gram.win = win.win AND gram.n = win.n),
word AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS p FROM hit) GROUP BY r),
item AS (SELECT r, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT r, cast(item_id AS VARCHAR) AS i FROM hit WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, cast(len(w) AS BIGINT) AS n_words, cast(coalesce(n_hit, 0) AS BIGINT) AS n_hit, cast(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN word USING (r) LEFT JOIN item USING (r)
"""
