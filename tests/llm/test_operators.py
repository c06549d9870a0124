import base64
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from peakgrid.llm import common, decontaminate, gbt, html_text, language, licenses, near_duplicates, packing, quality_pu, quality_rules, sharding, simhash, textstats, warc
from peakgrid.llm.queries import tokenizer
from pyspark.sql import functions as F

from . import helpers as H


@pytest.fixture(scope="module")
def rows():
    return H.documents()


@pytest.fixture(scope="module")
def docs(spark, rows):
    """With extra columns whose names clash with results and helpers."""
    df = spark.createDataFrame(rows, H.DOCS)
    return df.select("*", F.lit("x").alias("fp"), F.lit(1).alias("score"), F.lit(2).alias("Text"), F.lit(3).alias("a.b"), F.lit(4).alias("key"), F.lit(5).alias("shard"), F.lit(6).alias("_0"))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], H.DOCS)


def near(a, b):
    return (a ^ b).bit_count() <= 3


def test_simhash_against_brute_force(docs, rows, empty):
    got = simhash.groups(docs).collect()
    assert len(got) == len(rows)
    fp = {id(r): H.fingerprint(r[1]) for r in rows}
    roots = H.components(sorted(set(fp.values())), near)
    least = {}
    for r in rows:
        k = roots[fp[id(r)]]
        if r[0] is not None:
            least[k] = min(least.get(k, r[0]), r[0])
    want = sorted((repr(r[0]), f"{fp[id(r)]:016x}", least.get(roots[fp[id(r)]])) for r in rows)
    assert sorted((repr(r.doc_id), r.fingerprint, r.component_id) for r in got) == want
    assert simhash.groups(empty).count() == 0


def test_simhash_small_trees_lose_no_link(spark):
    """Hot shards are dealt out in blocks; every link survives."""
    r = random.Random(3)
    base = r.getrandbits(64)
    values = {base}
    while len(values) < 120:
        values.add(r.choice(sorted(values)) ^ 1 << r.randrange(64) ^ 1 << r.randrange(64))
    values |= {r.getrandbits(64) for _ in range(80)}
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    for most in (7, 2048):
        edges = simhash.links(spark.createDataFrame(signed, "fp long"), 3, most).collect()
        up = H.components(sorted(values), near)
        pairs = {(a % (1 << 64), b % (1 << 64)) for a, b in edges}
        assert all(near(a, b) for a, b in pairs)
        mine = H.components(sorted(values), lambda a, b: (a, b) in pairs or (b, a) in pairs)
        assert mine == up


def test_bk_tree_finds_all():
    r = random.Random(5)
    values = [r.getrandbits(16) for _ in range(400)]
    tree = simhash.BKTree()
    for v in values:
        tree.add(v)
    for q in values[:50]:
        assert sorted(tree.near(q, 3)) == sorted({v for v in values if (v ^ q).bit_count() <= 3})


def test_long_text_in_blocks(monkeypatch):
    text = H.say(random.Random(1), 500).encode()
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "BLOCK", 100)
    assert simhash.fingerprint(text) == whole == H.fingerprint(text.decode())


def test_flat_tree_and_tiles():
    r = np.random.default_rng(12)
    base = r.integers(0, 1 << 63, (6, 4), dtype=np.uint64)
    values = np.unique(np.concatenate([base ^ (np.uint64(1) << r.integers(0, 64, (6, 4), dtype=np.uint64)) for _ in range(40)] + [base]), axis=0)
    tree = near_duplicates.Tree(values)
    distance = np.bitwise_count(values[:, None] ^ values[None]).sum(2, dtype=np.int64)
    for radius in (0, 3, 8, 120):
        q, at, d = tree.near(values, radius)
        assert sorted(zip(q.tolist(), at.tolist(), d.tolist(), strict=True)) == [(i, j, distance[i, j]) for i, j in zip(*np.nonzero(distance <= radius), strict=True)]
    side = np.arange(len(values)) >= 100
    for some in (np.zeros(len(values), bool), side):
        order = np.lexsort((*values.T[::-1], some))
        twice = np.sort(np.concatenate([order, order[:7]]))
        u, v, d = near_duplicates.pairs_of_tile(values[twice], some[twice], 90)
        assert sorted(zip(u.tolist(), v.tolist(), strict=True)) == [(i, j) for i in range(len(twice)) for j in range(i + 1, len(twice)) if distance[twice[i], twice[j]] <= 90 and (not some.any() or some[twice[i]] != some[twice[j]])]
        assert (d == distance[twice[u], twice[v]]).all()
    assert len(near_duplicates.Tree(values[:0]).near(values, 3)[0]) == 0


def similar_roots(rows):
    """Brute force: the least document of each group of texts whose sets of five-word shingles overlap by 0.8."""
    texts = sorted({t or "" for _, t, *_ in rows})
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    roots = H.components(list(range(len(texts))), lambda a, b: 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]))
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(roots[texts.index(t or "")], []).append(i)
    return groups


def near_copies(r, n):
    """Texts with none to many changed words, some of which reach others only through a chain."""
    out = []
    for _ in range(n):
        words = H.say(r, r.choice([6, 30, 120])).split()
        for _ in range(r.choice([1, 2, 6])):
            out.append(" ".join(words))
            for _ in range(r.choice([0, 1, 1, 2, 4])):
                words[r.randrange(len(words))] = "x" + str(r.randint(0, 99))
    return out


@pytest.mark.parametrize("tile", [4096, 5])
def test_near_duplicates_against_brute_force(spark, rows, empty, tile):
    r = random.Random(15)
    more = [(10_000 + k, t, "en", "s", 1) for k, t in enumerate(near_copies(r, 50))]
    more += [(20_000, more[0][1].upper(), "en", "s", 1), (20_001, "  ".join(more[0][1].split()), "en", "s", 1), (None, "nobody " * 9 + "knows", "en", "s", 1), (None, "nobody " * 9 + "knows it", "en", "s", 1), more[3], more[3], (more[4][0], more[4][1], "de", None, None)]
    every = [x for x in rows + more if len(x[1] or "") < 5_000]
    df = spark.createDataFrame(every, H.DOCS).withColumn("key", F.lit(1)).withColumn("group", F.lit(2)).withColumn("n", F.lit(4)).select("*", F.lit(3).alias("Doc_ID"))
    got = near_duplicates.keep_one(df, tile=tile)
    assert got.columns == df.columns
    ids = [repr(x[0]) for x in got.collect()]
    want = [repr(min((i for i in g if i is not None), default=None)) for g in similar_roots(every).values()]
    assert sorted(ids) == sorted(want)
    assert near_duplicates.keep_one(empty).count() == 0


def test_near_duplicates_of_very_long_texts(spark, monkeypatch):
    r = random.Random(16)
    words = H.say(r, 60_000).split()
    other = [w if r.random() > 0.01 else "other" for w in words]
    far = [w if r.random() > 0.2 else "other" for w in words]
    df = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(other)), (3, " ".join(far))], "doc_id long, text string")
    assert sorted(x.doc_id for x in near_duplicates.keep_one(df).collect()) == [1, 3]
    whole = near_duplicates.shingles(" ".join(words).encode())
    from peakgrid.llm import simhash as parts

    monkeypatch.setattr(parts, "BLOCK", 1_000)
    assert np.array_equal(near_duplicates.shingles(" ".join(words).encode()), whole)


def test_hilbert_shards(docs, rows, empty):
    got = sharding.place(docs, ["lang", "source", "n_chars"]).collect()
    assert len(got) == len(rows)
    counts = {}
    for r in got:
        counts.setdefault(r.shard, []).append(r.slot)
    assert set(counts) == set(range(16))
    assert max(map(len, counts.values())) - min(map(len, counts.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in counts.values())
    want = sorted((repr(r[0]), len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert sorted((repr(r.doc_id), r["size"], r.text_crc32) for r in got) == want
    ordered = [r.hilbert for r in sorted(got, key=lambda r: (r.shard, r.slot))]
    assert ordered == sorted(ordered)
    assert sharding.place(empty, ["lang"]).count() == 0


@pytest.mark.parametrize("dims", [1, 2, 3, 4])
def test_hilbert_curve_visits_neighbours(spark, dims):
    bits = 2
    cells = spark.range(1 << bits * dims)
    coordinates = [F.shiftright("id", bits * i).bitwiseAND(F.lit((1 << bits) - 1)).cast("int") for i in range(dims)]
    got = sorted((r[0], r[1:]) for r in cells.select(sharding.index(coordinates, bits), *coordinates).collect())
    assert [h for h, _ in got] == list(range(1 << bits * dims))
    assert all(sum(abs(a - b) for a, b in zip(x, y, strict=True)) == 1 for (_, x), (_, y) in zip(got, got[1:], strict=False))


def test_shards_against_plain_cells(spark):
    """Quantile cells, curve places, shards and slots of a small table, worked out in plain Python; ties, nulls and repeated rows included."""
    r = random.Random(77)
    rows = [(i, f"text {i}", r.choice(["en", "de", "fr", None]), f"https://example.org/a/long/common/prefix/{r.randint(0, 50):03d}", r.choice([None, 5, 5, *range(40)])) for i in range(400)]
    rows += rows[:3] + [(None, None, None, None, None)]
    got = sharding.place(spark.createDataFrame(rows, H.DOCS), ["lang", "source", "n_chars"], 7).collect()
    points = 30

    def cell(values, v):
        some = sorted(x for x in values if x is not None)
        bounds = [some[-(-k * len(some) // (points + 1)) - 1] for k in range(1, points + 1)]
        return 0 if v is None else 1 + sum(v > b for b in bounds)

    columns = [[x[k] for x in rows] for k in (2, 3, 4)]
    digit, after = sharding.curve(3)

    def place(x):
        cells, state, h = [cell(c, x[k]) for c, k in zip(columns, (2, 3, 4), strict=True)], 0, 0
        for level in reversed(range(sharding.BITS)):
            bits = sum((c >> level & 1) << i for i, c in enumerate(cells))
            h, state = h * 8 + digit[state * 8 + bits], after[state * 8 + bits]
        return h

    want = sorted((place(x), -1 if x[0] is None else x[0], zlib.crc32((x[1] or "").encode())) for x in rows)
    at = lambda g: (g.hilbert, -1 if g.doc_id is None else g.doc_id, g.text_crc32)
    assert sorted(map(at, got)) == want
    assert list(map(at, sorted(got, key=lambda g: (g.shard, g.slot)))) == want
    assert len({cell(columns[1], v) for v in columns[1]}) > 25


def test_shards_prune(spark, data):
    """Files of a shard hold about two of four languages, and half of the sources."""
    import os

    folder = data.replace("sf0.001", "sf0.1")
    if not os.path.exists(folder):
        pytest.skip("no larger tables")
    docs = common.read(spark, folder, "documents")
    found = sharding.place(docs, ["lang", "source", "n_chars"]).join(docs, "doc_id")
    shards = found.groupBy("shard").agg(F.countDistinct("lang").alias("langs"), F.countDistinct("source").alias("sources")).collect()
    assert sum(x.langs for x in shards) <= 33 and max(x.langs for x in shards) <= 3
    assert sum(x.sources for x in shards) / 16 < 10


def test_sharded_files(spark, rows, tmp_path):
    df = spark.createDataFrame(rows, H.DOCS)
    sharding.write(df, str(tmp_path / "s"), ["lang", "n_chars"])
    back = spark.read.parquet(str(tmp_path / "s"))
    assert sorted(map(repr, back.select(df.columns).collect())) == sorted(map(repr, df.collect()))


def windows_of(words, n):
    return [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)]


@pytest.mark.parametrize("limit", [10**6, 3])
def test_licences_against_brute_force(spark, rows, empty, limit):
    r = random.Random(2)
    extra = []
    for k, (_, text) in enumerate(licenses.TEMPLATES.items()):
        words = text.split()
        extra.append((1000 + k, f"{H.say(r, 30)} {text.upper()} {H.say(r, 30)}", "en", "s", 1))
        broken = words[:]
        broken[len(broken) // 2] = "otherwise"
        extra.append((2000 + k, f"{H.say(r, 9)} {' '.join(broken)} {H.say(r, 9)}", "en", "s", 1))
        extra.append((3000 + k, f"{H.say(r, 9)} {' '.join(words[: len(words) // 2])} {H.say(r, 9)}", "en", "s", 1))
    extra += [(4000, None, "en", "s", 1), (4001, licenses.TEMPLATES["MIT line"], None, None, None), (4002, "Released under", "en", "s", 1)]
    extra += [(4003, " and ".join([licenses.TEMPLATES["MIT"]] * 2) + H.say(r, 60) + licenses.TEMPLATES["MIT"], "en", "s", 1)]
    extra += [(4000, licenses.TEMPLATES["MIT line"], "en", "s", 1)] + extra[5:6] * 3
    df = spark.createDataFrame(extra + rows, H.DOCS).withColumn("w", F.lit(1)).withColumn("key", F.lit(1)).withColumn("license", F.lit(1))
    found = licenses.scan(df, broadcast_rows=limit).collect()
    got = {(x.doc_id, x.license): (x.containment, x.first_word, x.n_places) for x in found}
    assert len(got) == len(found)
    want = {}
    for doc, text, *_ in extra:
        shingles = windows_of(H.item_words(text), 3)
        for name, body in licenses.TEMPLATES.items():
            t = windows_of(H.item_words(body), 3)
            shares = [len(set(shingles[i : i + len(t)]) & set(t)) / len(set(t)) for i in range(max(1, len(shingles) - len(t) + 1))]
            if max(shares, default=0) >= licenses.LEAST:
                runs = sum(x >= licenses.LEAST > y for x, y in zip(shares, [0, *shares], strict=False))
                want[doc, name] = (round(max(shares), 6), shares.index(max(shares)), runs)
    assert {k: v for k, v in got.items() if k[0] is not None and k[0] >= 1000} == want
    assert not [k for k in got if k[0] is None or k[0] < 1000]
    assert licenses.scan(empty).count() == 0
    assert licenses.scan(df, {}).count() == 0
    with pytest.raises(ValueError):
        licenses.scan(df, {"short": "two words"})


def test_more_licences_than_one_broadcast(spark):
    """Templates are dealt into several scans; a long one that no broadcast takes is joined by a shuffle."""
    df = spark.createDataFrame([(1, licenses.TEMPLATES["ISC"], "en", "s", 1), (2, licenses.TEMPLATES["MIT line"], "en", "s", 1), (3, licenses.TEMPLATES["Apache-2.0"], "en", "s", 1)], H.DOCS)
    want = sorted(map(tuple, licenses.scan(df).collect()))
    assert sorted(map(tuple, licenses.scan(df, broadcast_rows=300).collect())) == want and len(want) >= 3


def test_long_template(spark, tmp_path):
    """5,600 words: copies with and without changes, half of it, and a longer text that holds it; templates are read from files."""
    r = random.Random(44)
    words = H.say(r, 5_600).split()
    (tmp_path / "long-licence.txt").write_text(" ".join(words))
    texts = licenses.read_templates(spark, str(tmp_path))
    assert list(texts) == ["long-licence"]
    changed = [w if r.random() > 0.02 else "other" for w in words]
    broken = [w if r.random() > 0.15 else "other" for w in words]
    docs = [(1, H.say(r, 300) + " " + " ".join(words)), (2, " ".join(changed) + " " + H.say(r, 900)), (3, " ".join(words[:2_800])), (4, " ".join(broken)), (5, H.say(r, 6_000))]
    got = {x.doc_id: x for x in licenses.scan(spark.createDataFrame(docs, "doc_id long, text string"), texts).collect()}
    assert sorted(got) == [1, 2] and got[1].first_word == 300 and got[1].containment == 1.0 and got[1].n_places == 1
    t, d = windows_of(words, 3), windows_of(docs[1][1].split(), 3)
    best = max((len(set(d[i : i + len(t)]) & set(t)) / len(set(t)), -i) for i in range(0, len(d) - len(t) + 1))
    assert (got[2].containment, got[2].first_word) == (round(best[0], 6), -best[1])


@pytest.mark.parametrize("limit", [10**6, 3])
def test_contamination_against_brute_force(spark, docs, rows, empty, limit):
    r = random.Random(7)
    items = [(i, H.say(r, n)) for i, n in enumerate([1, 2, 3, 12, 13, 14, 30, 40])] + [(100, None), (101, ""), (102, "..."), (None, H.say(r, 20)), (5, H.say(r, 25)), (3, "ÉÈ ñandú ßtraße")]
    items += [(103, items[6][1]), (104, rows[8][1])]
    extra = [(5000 + k, f"{H.say(r, a)} {(body or '').upper() if k % 2 else body} {H.say(r, a)}", "en", "s", 1) for k, (_, body) in enumerate(items) for a in (0, 40, 400)]
    extra += [(6000, items[6][1] + " " + items[6][1], "en", "s", 1), (6001, " ".join(items[6][1].split()[:12]), "en", "s", 1), (6002, "alpha1 " * 60, "en", "s", 1)]
    extra.append(extra[4])
    table = spark.createDataFrame(items, "item_id long, text string").withColumn("win", F.lit(1))
    df = spark.createDataFrame(extra + rows, H.DOCS).withColumn("w", F.lit(0)).withColumn("items", F.lit(0))
    got = sorted(map(repr, decontaminate.digest(decontaminate.scan(df, table, broadcast_rows=limit)).collect()))
    names = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    from pyspark.sql import Row

    want = sorted(repr(Row(**dict(zip(names, (x[0], *H.contamination(x[1], items)), strict=True)))) for x in extra + rows)
    assert got == want
    left = decontaminate.clean(df, table)
    assert left.columns == df.columns
    assert left.count() == sum(not H.contamination(x[1], items)[-1] for x in extra + rows)
    assert decontaminate.scan(empty, table).count() == 0
    assert decontaminate.scan(df, spark.createDataFrame([], "item_id long, text string")).where("n_hit > 0").count() == 0


PAGE = """<!DOCTYPE html><html><head><title>no</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href=/a>Home</a><li><a href=/b>About us</a></ul></nav><div class="cookie-notice"><p>We use cookies on this site.</p></div>
<article><h1>Heading of &amp; all</h1><p><b>First  line
goes on<br>here.<p>Second &lt;block&gt; with an <a href=x>inner link</a>, and more text to it than that.</p><div class=ad>Buy now at once!</div>
<p>Third paragraph of the article, which is long enough to be read as one.</p></article>
<section class="comments"><h3>Comments</h3><p>Nice article, thanks for it.</p></section><form class="newsletter"><p>Subscribe to our letter</p><input></form>
<footer>&copy; 2024 somebody</footer></body></html>"""


def test_main_text():
    model = html_text.fit()
    (text,) = html_text.main_texts([PAGE], model)
    assert text == "Heading of & all\nFirst line goes on here.\nSecond <block> with an inner link, and more text to it than that.\nThird paragraph of the article, which is long enough to be read as one."


def test_main_text_of_written_pages():
    model = html_text.fit()
    wrong = nodes = 0
    for k in range(60):
        x, y = html_text.labelled(html_text.Writer(5_000_000 + k).page())
        page = html_text.Page(re.sub(r" data-y=[01]", "", html_text.Writer(5_000_000 + k).page()))
        assert np.allclose(page.features(), x)
        wrong += int((page.decode(model.probability(x)) != (y == 1)).sum())
        nodes += len(y)
    assert wrong / nodes < 0.02


PLAIN = "<article><h1>Title here</h1><p>One paragraph of some length, with words in it.</p><p>Another paragraph follows, also with words.</p></article>"
PLAIN_TEXT = "Title here\nOne paragraph of some length, with words in it.\nAnother paragraph follows, also with words."


def site(body):
    return f"<html><head><title>x</title></head><body><header><a href=/>Home</a></header><nav><ul><li><a href=/a>A</a></li><li><a href=/b>B</a></li></ul></nav>{body}<footer>&copy; someone</footer></body></html>"


@pytest.mark.parametrize("n", [0, 1, 3, 250, 1_000, 10_000])
def test_deep_pages_lose_no_text(n):
    open_, shut = "<div>" * n, "</div>" * n
    pages = [
        open_ + PLAIN + shut,
        PLAIN.replace("<article>", "<article>" + open_).replace("</article>", shut + "</article>"),
        PLAIN.replace("<p>", open_ + "<p>").replace("</p>", "</p>" + shut),
        "<span>" * n + PLAIN + "</span>" * n,
        PLAIN.replace("<p>One", "<p>" + "<b>" * n + "One").replace("it.</p>", "it." + "</b>" * n + "</p>"),
        PLAIN + open_ + "<nav><ul><li><a href=/c>Menu</a></li><li><a href=/d>More</a></li></ul></nav><button>Press</button>" + shut,
    ]
    for got in html_text.main_texts(list(map(site, pages)), html_text.fit()):
        assert got == PLAIN_TEXT


@pytest.mark.parametrize("tag", ["<p title=Don't>", '<p title=5">', "<p title=a\"b'c>", "<p title='it>s'>", "<p data-x=\"a > b\" title='\"'>", '<p title="is hidden here">', '<p title="a" " class=x>', "<p / class = x >", "<p title=>", "<p class=a/b>", "<!-- a > ' --><p>", "<!--><p>", "<!----!><p>", "</3 '><p>", "<?x '><p>"])
def test_quotes_and_odd_markup_lose_no_text(tag):
    assert html_text.main_texts([site(PLAIN.replace("<p>", tag))], html_text.fit()) == [PLAIN_TEXT]


def test_attributes():
    got = html_text.attributes_of(" class='a b' ID=x/ title=\"it's\" class=c hidden data-y=1 /")
    assert got == ({"class": "a b", "id": "x/", "title": "it's", "hidden": "", "data-y": "1"}, True)
    assert html_text.attributes_of(" href=a/") == ({"href": "a/"}, False)


def test_main_text_equals_the_articles(data):
    """Every page of the test table: the article element's blocks without adverts, cut out by patterns."""
    import html

    import pyarrow.parquet as pq

    pages = [x or "" for x in pq.read_table(f"{data}/pages.parquet").column("html").to_pylist()]
    got = html_text.main_texts(pages, html_text.fit())
    for page, text in zip(pages, got, strict=True):
        inner = "".join(re.findall(r"<article\b[^>]*>(.*?)(?:</article>|\Z)", page, re.S))
        inner = re.sub(r"<!--.*?-->|<script.*?</script>|<style.*?</style>|<div class=\"?ad\b.*?</div>", "", inner, flags=re.S)
        blocks = re.split(r"</?(?:p|h[1-6]|div|section|ul|ol|li|blockquote|article|table|tr|td|th|figure|figcaption|pre|header|footer)\b[^>]*>", inner)
        blocks = [" ".join(html.unescape(re.sub(r"<[a-z/][^>]*>", "", re.sub(r"<br[^>]*>", " ", b))).split()) for b in blocks]
        assert text == "\n".join(b for b in blocks if b)


def test_decoding_is_consistent_and_best():
    """Against all labellings of a small tree: outside, inside, cut along every path."""
    from itertools import product

    r = random.Random(4)
    page = html_text.Page("<div><section><p>a</p><p>b</p></section><section><p>c</p></section></div>")
    n = len(page.tag)
    for _ in range(30):
        p = np.array([r.random() for _ in range(n)])
        best = max((s for s in product((0, 1, 2), repeat=n) if s[0] == 0 and all((s[page.parent[i]], s[i]) in {(0, 0), (0, 1), (1, 1), (1, 2), (2, 2)} for i in range(1, n))), key=lambda s: sum(np.log(q if x == 1 else 1 - q) for x, q in zip(s, p, strict=True)))
        got = page.decode(p)
        score = lambda inside: sum(np.log(q if x else 1 - q) for x, q in zip(inside, p, strict=True))
        assert score(got) == pytest.approx(score([x == 1 for x in best]))


def test_pages_of_every_kind(spark):
    odd = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", "no markup"), (5, "u", "<p>" * 5000 + "deep"), (6, "u", "<div>" * 3000 + "x" + "</div>" * 10), (7, "u", "<!-- open"), (8, "u", "<script>never closed"), (None, "u", "<a href='"), (9, "u", "</p></div></html>"), (1, "u", PAGE), (10, "u", f"<article>{'<p>long text of it. ' * 20000}</article>")]
    df = spark.createDataFrame(odd, "page_id long, url string, html string").withColumn("text", F.lit(1))
    got = html_text.extract(df).collect()
    assert len(got) == len(odd) and all(r.text is not None and r.n_chars == len(r.text) for r in got)
    by = {r.page_id: r for r in got}
    assert [by[k].n_chars for k in (2, 3, 7, 8, 9)] == [0] * 5
    assert [by[6].text, by[4].text] == html_text.main_texts(["<div>x</div>", "no markup"], html_text.fit())
    assert sum(r.page_id == 1 and r.text.startswith("Heading of & all\nFirst line") for r in got) == 2
    assert by[10].text.count("\n") == 19_999 and by[10].text.count("long text of it.") == 20_000
    assert html_text.extract(df.limit(0)).count() == 0


WARC_PAGES = [(1, "u1", "a\r\n\r\nWARC/1.0\r\n\r\n"), (2, "u\n2", "a\r\n\r\nWARC/1.0\r\n\r\n"), (3, None, None), (4, "x", ""), (5, "y", "é\n" * 50), (6, "z", "ab\n"), (7, "z", "日本" * 30), (8, "z", "\r"), (9, "z", "\n"), (10, "z", "\n\n\r\n"), (11, "z", "日本" * 30), (12, "z", "x" * 3000)]


@pytest.mark.parametrize("size", [7, 100, 1 << 20])
@pytest.mark.parametrize("least", [0, 10])
def test_warc_roundtrip(spark, size, least):
    df = spark.createDataFrame(WARC_PAGES, "page_id long, url string, html string").withColumn("record", F.lit(1)).withColumn("sha", F.lit(1))
    got = {r.page_id: r for r in warc.roundtrip(df, least, size).collect()}
    assert len(got) == len(WARC_PAGES)
    for i, _, text in WARC_PAGES:
        b = (text or "").encode()
        top = max(j for j, _, t in WARC_PAGES if (t or "") == (text or "")) if len(b) >= least else i
        want = (len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if top == i else "revisit", None if top == i else top)
        assert tuple(got[i])[1:] == want


def test_warc_chunks_hold_the_payload(spark, tmp_path):
    df = spark.createDataFrame(WARC_PAGES, "page_id long, url string, html string")
    path = str(tmp_path / "w")
    warc.write(df, path, size=7)
    table = warc.read(spark, path).where("type = 'response'").collect()
    for i, _, text in WARC_PAGES:
        parts = sorted((r.chunk, bytes(r.data), r.last) for r in table if r.record == str(i))
        if parts:
            assert b"".join(p for _, p, _ in parts) == (text or "").encode()
            assert [c for c, _, _ in parts] == list(range(len(parts))) and [last for *_, last in parts] == [False] * (len(parts) - 1) + [True]
            assert all(len(p) <= 7 for _, p, _ in parts)


def test_warc_copies_beyond_a_broadcast(spark, tmp_path):
    """The way without a broadcast writes the same records."""
    rows = [(i, "u", f"page {i % 7}" * 40) for i in range(60)] + [(None, "u", "page 3" * 40), (5, "u", "page 5" * 40)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    made = []
    for k, limit in enumerate((10**6, 2)):
        warc.write(df, str(tmp_path / str(k)), broadcast_rows=limit)
        made.append(sorted(map(repr, warc.read(spark, str(tmp_path / str(k))).collect())))
    assert made[0] == made[1] and len(made[0]) == len(rows)


def test_warc_nulls_and_repeats(spark):
    df = spark.createDataFrame([(None, "u", "q"), (1, "u", "q"), (1, "u", "q"), (2, "u", "r"), (2, "u", "r"), (None, None, None)], "page_id long, url string, html string").withColumn("refers", F.lit(1)).withColumn("newest", F.lit(1)).withColumn("n", F.lit(1))
    got = sorted((repr(r.page_id), r.record_type, r.refers_to) for r in warc.roundtrip(df).collect())
    assert got == sorted([("None", "revisit", 1), ("1", "response", None), ("1", "response", None), ("2", "response", None), ("2", "response", None), ("None", "response", None)])
    assert warc.roundtrip(df.limit(0)).count() == 0


def test_sharded_files_hold_all_rows(spark, docs, rows, empty, tmp_path):
    df = spark.createDataFrame(rows, H.DOCS).select("*", *[F.lit(i).alias(c) for i, c in enumerate(["fp", "key", "shard", "_0", "_Shard"])])
    sharding.write(df, str(tmp_path / "a"), ["lang", "n_chars"], 4)
    back = spark.read.parquet(str(tmp_path / "a"))
    assert sorted(back.columns) == sorted([*df.columns, "_shard_"]) and back.count() == len(rows)
    assert sorted(map(repr, back.select("doc_id", "text", "lang").collect())) == sorted(map(repr, df.select("doc_id", "text", "lang").collect()))
    placed = {(r.doc_id, r.text_crc32): r.shard for r in sharding.place(docs, ["lang", "n_chars"], 4).orderBy(F.desc("shard")).collect()}
    for r in back.select("doc_id", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("crc"), "_shard_").collect():
        assert placed[r.doc_id, r.crc] == r["_shard_"]
    sharding.write(empty, str(tmp_path / "b"), ["lang"], 4)


def archive(folder, blocks):
    import gzip

    folder.mkdir()
    with gzip.open(folder / "a.warc.gz", "wb") as f:
        f.write(b"".join(b + b"\n" for b in blocks))
    return str(folder)


@pytest.mark.parametrize("cut", [1, 20, 150])
def test_warc_cut_record_is_an_error(spark, tmp_path, cut):
    """A file that ends in the middle of its last record, in the content or in the header."""
    import gzip

    blocks = [b for k in range(3) for b in warc.records(str(k), "u", b"payload %d" % k, hashlib.sha1(b"payload %d" % k).hexdigest(), None, 1 << 20)]
    assert warc.read(spark, archive(tmp_path / "whole", blocks)).where("last").count() == 3
    whole = gzip.decompress((tmp_path / "whole" / "a.warc.gz").read_bytes()).rstrip(b"\r\n")
    (tmp_path / "cut").mkdir()
    (tmp_path / "cut" / "a.warc.gz").write_bytes(gzip.compress(whole[:-cut]))
    with pytest.raises(Exception, match="ends inside a record|doesn't end where"):
        warc.read(spark, str(tmp_path / "cut")).collect()


@pytest.mark.parametrize("followed", [True, False])
def test_warc_missing_last_segment_is_an_error(spark, tmp_path, followed):
    blocks = list(warc.records("1", "u", b"abcdefgh", hashlib.sha1(b"abcdefgh").hexdigest(), None, 3))
    assert len(blocks) == 3
    more = list(warc.records("2", "u", b"x", hashlib.sha1(b"x").hexdigest(), None, 3)) if followed else []
    assert warc.read(spark, archive(tmp_path / "whole", blocks + more)).where("last").count() == 1 + followed
    with pytest.raises(Exception, match="last segment of 1 is missing"):
        warc.read(spark, archive(tmp_path / "cut", blocks[:2] + more)).collect()


def test_license_bands_keep_their_guarantee():
    """Simulated: m of a segment's s shingles stand in a row among foreign ones. A band hits at least as often as the bound says, and the bands together miss no more than MISS."""
    r = np.random.default_rng(0)
    for s, m in ((8, 5), (8, 7), (5, 4), (3, 3), (4, 4)):
        low, hits, n = m / (s + licenses.BLOCK - 1), 0, 20_000
        theirs, ours = r.random((n, s)), r.random((n, m + 2 * licenses.BLOCK))
        start = r.integers(0, licenses.BLOCK, n)  # of the run, within its first block
        first = r.integers(0, s - m + 1, n)
        for k in range(m):
            ours[np.arange(n), start + k] = theirs[np.arange(n), first + k]
        blocks = [ours[:, b : b + licenses.BLOCK].min(1) for b in range(0, ours.shape[1] - licenses.BLOCK + 1, licenses.BLOCK)]
        hits = np.any([b == theirs.min(1) for b in blocks], axis=0).mean()
        assert hits >= low - 0.01, (s, m, hits, low)
    assert licenses.bands_for(3) == 14 and licenses.bands_for(8) == 10 and licenses.bands_for(300) == 17
    assert (1 - 5 / 11) ** licenses.bands_for(300) <= licenses.MISS


def test_repeated_ids_are_one_row_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "some text here")] * 50 + [(1, "another text")] * 50 + [(2, None)], "doc_id long, text string")
    x, got = quality_rules.stat_rows(docs, spark.createDataFrame([(1, 1), (2, 0), (3, 1)], "doc_id long, y int"))
    assert len(x) == 2 and sorted(got["y"].tolist()) == [0, 1]


def test_warc_parser_rejects_a_wrong_length():
    parser = warc.Parser()
    lines = [b"WARC/1.0\r", b"WARC-Type: response\r", b"Content-Length: 2\r", b"\r", b"abc\r", b"\r"]
    with pytest.raises(ValueError):
        for line in lines:
            list(parser.feed(line))


def base_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    w = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = {x for x in w if w.count(x) > 1}
    covered = {p for i, x in enumerate(w) if x in often for p in (i, i + 1, i + 2)}
    return [len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)]


def test_base_counts(docs, rows, empty, spark):
    labels = spark.createDataFrame([(i, int(i % 5 > 0), 0) for i in range(0, 70)] + [(None, 1, 0), (3, None, 0), (4, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality_rules.apply(docs, quality_rules.fit(docs, labels)).collect()
    assert len(got) == len(rows)
    small = [r for r in rows if len(r[1] or "") < 5000]
    want = sorted(repr((r[0], *base_counts(r[1]))) for r in small)
    assert sorted(repr((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)) for r in got if r.n_words < 5000) == want
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)
    assert quality_rules.apply(empty, None).count() == 0
    assert quality_rules.fit(empty, labels) is None
    assert all(r.kept != r.base_failed for r in quality_rules.apply(docs, None).collect())


@pytest.mark.parametrize("text", ["a b c a b c", "x x x x", "a\nb\na\n \n \na", "", "  ", "é#ñ é#ñ é#ñ é#ñ", "l1\r\nl1\r\nl2", "a b c d a b c e"])
def test_base_counts_of_odd_texts(text):
    assert textstats.measure(text.encode())[0] == base_counts(text)


def test_trees_are_monotone_and_flat():
    r = np.random.default_rng(1)
    x = r.random((3000, 3))
    y = (x[:, 0] + 0.05 * r.standard_normal(3000) - 0.8 * x[:, 1] > 0.2).astype(float)
    model = gbt.fit(x, y, {0: 1, 1: -1})
    assert ((model.probability(x) > 0.5) == (y == 1)).mean() > 0.85
    line = np.linspace(0, 1, 50)
    for other in r.random((20, 3)):
        for f, sign in ((0, 1), (1, -1)):
            probe = np.repeat(other[None], 50, 0)
            probe[:, f] = line
            assert (sign * np.diff(model.margin(probe)) >= -1e-9).all()
    # scoring by node arrays equals walking each tree
    for row in x[:20]:
        total = model.base
        for at in model.roots:
            while model.left[at] != at:
                at = model.left[at] if row[model.feature[at]] <= model.cut[at] else model.right[at]
            total += model.value[at]
        assert total == pytest.approx(model.margin(row[None])[0])


def test_trees_without_classes():
    x = np.zeros((5, 2))
    assert (gbt.fit(x, np.ones(5)).probability(x) > 0.5).all()
    assert len(gbt.fit(np.zeros((0, 2)), np.zeros(0)).margin(x)) == 5


LANG = {"en": "the and with this from have which", "nl": "het een van niet zijn deze voor", "fr": "les des une dans avec pour est", "es": "los las una con para está que"}


def test_language_families(spark, empty):
    r = random.Random(9)
    rows = [(i, " ".join(r.choice(LANG[lang].split()) for _ in range(30)), lang, "s", 1) for i, lang in ((i, r.choice(list(LANG))) for i in range(400))]
    odd = [(900, None, "en", "s", 1), (901, "", "en", "s", 1), (902, "12 !? 34", "en", "s", 1), (903, "the", None, "s", 1), (None, "les des une dans", "fr", "s", 1), (904, "x" * 200_000, "en", "s", 1)]
    df = spark.createDataFrame(rows + odd, H.DOCS).withColumn("x", F.lit(1)).withColumn("lang_pred", F.lit(1))
    model = language.fit(df)
    assert sorted(model.families) == ["germanic", "romance"] and sorted(model.families["romance"]) == ["es", "fr"]
    got = language.apply(df, model, ["doc_id", "lang"]).select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang", "lang_pred", "score").collect()
    assert len(got) == len(rows) + len(odd)
    assert all(x.held_out == (H.fold(x.doc_id, 4) == 2) and 0 <= x.score <= 1 for x in got)
    tested = [x for x in got if x.held_out and x.doc_id < 400]
    assert sum(x.lang == x.lang_pred for x in tested) / len(tested) > 0.97
    by = {x.doc_id: x for x in got}
    assert [by[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3
    assert by[903].lang_pred == "en"
    assert language.apply(empty, language.fit(empty), ["doc_id"]).count() == 0
    alone = df.where("lang = 'en'")
    assert {x.lang_pred for x in language.apply(alone, language.fit(alone), ["doc_id"]).collect()} == {"en", "und"}


def test_letters():
    assert not any(language.lettered(t.encode()) for t in ("", "² ½ ①", "Ⅳ ٣ _ 12", "!? \n", "\u0301"))
    assert all(language.lettered(t.encode()) for t in ("²x", "ª", "日", "12 é", "ǅ", "½" * 1000 + "ß"))


def test_three_hundred_languages(spark):
    """None is left out: each has words of its own; half are variants of one family, more than are told apart pair by pair."""
    r = random.Random(31)
    letters = "abcdefghijklmnopqrstuvwxyz"
    langs = [f"q{letters[k // 26]}{letters[k % 26]}" for k in range(240)] + [f"en-{letters[k // 26]}{letters[k % 26]}" for k in range(60)]
    own = {x: ["".join(r.choice(letters) for _ in range(6)) for _ in range(6)] for x in langs}
    rows = [(i, " ".join(r.choice(own[x]) for _ in range(60)), x, "s", 1) for i, x in enumerate(langs * 12)]
    df = spark.createDataFrame(rows + [(90_000 + k, "² ½ ①", langs[k], "s", 1) for k in range(9)], H.DOCS)
    model = language.fit(df)
    assert sorted(x for langs in model.families.values() for x in langs) == sorted(langs) and len(model.families["germanic"]) == 60
    got = language.apply(df, model, ["doc_id", "lang"]).collect()
    tested = [x for x in got if H.fold(x.doc_id, 4) == 2 and x.doc_id < 90_000]
    assert sum(x.lang == x.lang_pred for x in tested) / len(tested) > 0.97
    assert all((x.lang_pred, x.score) == ("und", 0.0) for x in got if x.doc_id >= 90_000)


def test_language_against_a_plain_predictor(spark, rows):
    """Row by row in plain Python: the family of greatest margin, then votes; repeated rows and ties included."""
    r = random.Random(10)
    langs = list(LANG)
    df = spark.createDataFrame([(i, " ".join(r.choice(LANG[x].split()) for _ in range(25)), x, "s", 1) for i, x in enumerate(langs * 40)], H.DOCS)
    model = language.fit(df)

    def plain(text):
        if not any(c.isalpha() for c in text or ""):
            return "und", 0.0
        x = language.grams(text.encode()).astype(float)
        dot = lambda w: float(np.dot(w[:-1].astype(float), x) + w[-1])
        names = list(model.families)
        z = [dot(w) for w in model.top]
        name, margin = names[z.index(max(z))], max(z)
        inner = model.within[name]
        if not isinstance(inner, str):
            wins = [[] for _ in inner.parts]
            for (i, j), w in zip(inner.pairs, inner.weights, strict=True):
                wins[i].append(dot(w))
                wins[j].append(-dot(w))
            votes = [sum((s > 0) + 1e-3 * np.tanh(s) for s in w) for w in wins]
            best = votes.index(max(votes))
            inner, margin = inner.parts[best], min(margin, *wins[best])
        return inner, 1 / (1 + np.exp(-4 * np.clip(margin, -9, 9)))

    tied = [(800, "the les", None, "s", 1), (801, "the les", None, "s", 1), (802, "zzz", None, "s", 1)]
    both = spark.createDataFrame(rows + tied, H.DOCS)
    got = sorted((repr(x.doc_id), x.lang_pred, round(x.score, 3)) for x in language.apply(both, model, ["doc_id"]).collect())
    want = sorted((repr(i), lang, round(float(score), 3)) for i, text, *_ in rows + tied for lang, score in [plain(text)])
    assert [x[:2] for x in got] == [x[:2] for x in want]
    assert all(abs(a[2] - b[2]) < 0.01 for a, b in zip(got, want, strict=True))
    empty_model = language.Model()
    assert {(x.lang_pred, x.score) for x in language.apply(both, empty_model, ["doc_id"]).collect()} == {("und", 0.0)}


def test_pu_classifier(spark, docs, empty):
    r = random.Random(11)
    good = [(i, ". ".join(H.say(r, 12) for _ in range(12)), "en", "s", 1) for i in range(300)]
    bad = [(1000 + i, " ".join("junk###$$$" for _ in range(100)), "en", "s", 1) for i in range(60)]
    df = spark.createDataFrame(good + bad, H.DOCS)
    labels = spark.createDataFrame([(x[0], 1, 0) for x in good[::2]] + [(x[0], 0, 0) for x in bad[::2]] + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    model = quality_pu.fit(df, labels)
    got = quality_pu.apply(df, model, ["doc_id"]).select("doc_id", quality_pu.in_fold(F.col("doc_id")).alias("held_out"), "score", "predicted").collect()
    assert all(x.held_out == (H.fold(x.doc_id, 3) == 1) for x in got)
    tested = [x for x in got if x.held_out]
    assert all(x.predicted == int(x.doc_id < 1000) == int(x.score >= 0.5) for x in tested)
    assert len(quality_pu.apply(docs, model, ["doc_id"]).collect()) == docs.count()
    positives_only = quality_pu.fit(df, labels.where("quality = 1"))
    assert positives_only.prior == model.prior and np.array_equal(positives_only.weights, model.weights)
    twice = quality_pu.apply(df.union(df).withColumn("score", F.lit(7)), model, ["doc_id", "score"])
    assert twice.columns == ["doc_id", "score", "score", "predicted"] and twice.distinct().count() == df.count()
    assert quality_pu.apply(empty, quality_pu.fit(empty, labels.limit(0)), ["doc_id"]).count() == 0


@pytest.mark.parametrize("share", [0.5, 0.7, 0.85, 0.95])
def test_class_prior_from_positives_and_unlabelled(share):
    """Off by 0.05 at most on overlapping classes of a known share."""
    r = np.random.default_rng(int(100 * share))
    y = r.random(6000) < share
    x = r.normal(0, 1, (6000, 4)) + np.where(y[:, None], 1.2, -1.6)
    more = r.normal(0, 1, (2000, 4)) + 1.2
    z = np.r_[x, more]
    edges = [np.quantile(z[:, f], np.linspace(0, 1, 17)[1:-1]) for f in range(4)]
    positive = np.arange(8000) >= 6000
    order = r.permutation(8000)
    assert abs(quality_pu.estimated_prior(quality_pu.expand(z[order], edges), positive[order], ~positive[order]) - share) < 0.05


def test_class_prior_of_the_documents(spark, data):
    """The estimate lies near the share of good labels, which it doesn't see; predictions of held-out rows are right."""
    import os

    folder = data.replace("sf0.001", "sf0.01")
    if not os.path.exists(folder):
        pytest.skip("no larger tables")
    docs, labels = (common.read(spark, folder, t) for t in ("documents", "labels"))
    model = quality_pu.fit(docs, labels.where("quality = 1"))
    assert abs(model.prior - labels.agg(F.avg("quality")).first()[0]) < 0.08
    held = quality_pu.apply(docs, model, ["doc_id"]).where(quality_pu.in_fold(F.col("doc_id"))).join(labels, "doc_id").collect()
    assert sum(x.predicted == x.quality for x in held) / len(held) > 0.97


def test_quality_risk_against_plain_steps():
    """The risk that nn_risk lowers, from its definition, is not above that of weights nearby."""
    r = np.random.default_rng(5)
    p, u = (r.random((200, 3)) < 0.7).astype(np.float32), (r.random((400, 3)) < 0.4).astype(np.float32)
    w, b = quality_pu.nn_risk(p, u, 0.4, steps=2000, rate=0.02)

    def risk(w, b):
        sig = lambda z: 1 / (1 + np.exp(-z))
        good = np.mean([sig(-(row @ w + b)) for row in p])
        bad = np.mean([sig(row @ w + b) for row in u]) - 0.4 * np.mean([sig(row @ w + b) for row in p])
        return 0.4 * good + max(0.0, bad) + 0.5 * 2.5 / 200 * (w @ w + b * b)

    best = risk(w, b)
    assert all(risk(w + 0.5 * r.standard_normal(3), b + 0.5 * r.standard_normal()) > best - 1e-3 for _ in range(200))


def test_encoder_equals_tokenizer():
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(tokenizer())
    odd = ["It's <|endoftext|>x <|STARTOFTEXT|> don't... A b İstanbul ΣΑΣ. é́ ***. x's! 12.5 a1!! \x0bfoo\x1cbar  z ᾴ ǅ ﬁ é '", "", "   ", "we'll we'LL. A.B.C ... 'tis O'Neil's'. 'S", "日本語 テキスト。한국어", "á. b́c é' K"]
    odd += [r[1] or "" for r in H.documents(4, 20)]
    made = packing.Encoder(tokenizer()).encode([t.encode() for t in odd])
    for t, b in zip(odd, made, strict=True):
        assert np.frombuffer(b, "<u4").tolist() == tk.encode(t, add_special_tokens=False).ids


def test_encoder_with_a_full_cache_and_small_blocks(monkeypatch):
    texts = [(r[1] or "").encode() for r in H.documents(5, 30)]
    want = packing.Encoder(tokenizer()).encode(texts)
    monkeypatch.setattr(packing, "CACHE_MAX", 20)
    monkeypatch.setattr(packing, "BLOCK", 50)
    assert packing.Encoder(tokenizer()).encode(texts) == want


def test_fullest_against_brute_force():
    from itertools import product

    r = random.Random(8)
    for _ in range(60):
        counts = {r.randint(1, 20): r.randint(1, 3) for _ in range(4)}
        room = r.randint(0, 40)
        got = packing.fullest(counts, room)
        assert all(n <= counts[k] for k, n in got.items())
        best = max(s for c in product(*[range(n + 1) for n in counts.values()]) if (s := sum(a * b for a, b in zip(c, counts, strict=True))) <= room)
        assert sum(k * n for k, n in got.items()) == best


def test_packing(docs, rows, empty, monkeypatch):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(tokenizer())
    monkeypatch.setattr(packing, "PART", 7)
    for capacity in (64, 4096):
        got = packing.placed(docs, tokenizer(), capacity).collect()
        made = {}
        for r in got:
            made.setdefault((r.doc_id, r.ids_crc32, r.start), []).append(r)
        want = {}
        for row in rows:
            ids = tk.encode(row[1] or "", add_special_tokens=False).ids + [1]
            for k, s in enumerate(range(0, len(ids), capacity)):
                part = ids[s : s + capacity]
                key = (row[0], zlib.crc32(np.array(part, "<u4").tobytes()), s)
                want.setdefault(key, []).append((k, len(part)))
        assert {k: sorted((r.piece, r.length) for r in v) for k, v in made.items()} == {k: sorted(v) for k, v in want.items()}
        bins = {}
        for r in got:
            bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for parts in bins.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= capacity
        total = sum(r.length for r in got)
        assert len(bins) <= -(-total // capacity) * 1.03 + 1
    assert packing.placed(empty, tokenizer()).count() == 0


def test_sequences_hold_the_ids(docs, spark):
    got = packing.sequences(docs, tokenizer(), 512).collect()
    assert sum(len(r.ids) for r in got) == packing.pieces(docs, tokenizer(), 512).agg(F.sum("length")).first()[0]
    assert all(len(r.ids) <= 512 for r in got)


def test_slices_bound_memory():
    import pyarrow as pa

    b = pa.RecordBatch.from_pydict({"t": ["x" * (3 << 20)] * 9 + [None, ""]})
    parts = list(common.slices(b, 0))
    assert sum(p.num_rows for p in parts) == 11 and max(p.num_rows for p in parts) <= 4


def test_blocks_are_the_text():
    r = random.Random(3)
    for text in (b"", b" ", b"word", b"a b", H.say(r, 400).encode(), b"x" * 500 + b" y " + b"z" * 500, b"\n" * 90):
        for size in (1, 7, 64, 10_000):
            parts = list(common.blocks(text, size))
            assert b"".join(parts) == text and [w for p in parts for w in p.split()] == text.split()
            assert all(p[-1:].isspace() for p in parts[:-1])


def test_long_texts_measure_alike(monkeypatch):
    text = (H.say(random.Random(6), 900) + "\nÉé ß").encode()
    whole = textstats.measure(text), language.grams(text)
    monkeypatch.setattr(common.blocks, "__defaults__", (50,))
    assert textstats.measure(text) == whole[0]
    assert np.abs(language.grams(text) - whole[1]).max() < 0.02
    assert language.lettered(text) and not language.lettered(b"12 " * 100)
