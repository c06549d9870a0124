"""Packing along the curve and the Merkle manifest, against plain re-computations."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest
from peakgrid.llm import curve_packing, merkle
from peakgrid.llm.queries import byte_tokenizer
from pyspark.sql import functions as F

from . import helpers as H


@pytest.fixture(scope="module")
def rows():
    return H.documents()


@pytest.fixture(scope="module")
def docs(spark, rows):
    """With extra columns whose names clash with results and helpers."""
    df = spark.createDataFrame(rows, H.DOCS)
    return df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(["n", "ids", "row", "g", "k", "leaf", "digest", "Text", "a.b", "hilbert", "_0"])])


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], H.DOCS)


def plain_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(byte_tokenizer())
    return [[*t.encode(x or "", add_special_tokens=False).ids, 0] for x in texts]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def key(row):
    return tuple((x is not None, x) for x in row)


def test_ids_are_those_of_the_file():
    r = random.Random(2)
    parts = ["a", "B", " ", "  ", "\n", "\t", "\r\n", "'s", "1", "é", "中", "\xa0", " ", "<|endoftext|>", "!", ".", "\x1c", "\0", "\x0b", " the", " word."]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 12))) for _ in range(4_000)]
    made = curve_packing.ByteEncoder(byte_tokenizer())
    texts += ["long" * 3_000, " " * 9_000 + "x", "\n" * 5_000]
    got = [np.frombuffer(made.encode(t.encode()), made.kind).tolist() for t in texts]
    assert got == [x[:-1] for x in plain_ids(texts)]


def test_every_character_is_parted_alike():
    """Both encoders agree on which characters are letters, numbers and spaces: one text for each."""
    made = curve_packing.ByteEncoder(byte_tokenizer())
    texts = [f"a{c}b {c}{c}1{c}" for c in map(chr, [*range(0xD800), *range(0xE000, 0x30000, 3)])]
    got = [np.frombuffer(made.encode(t.encode()), made.kind).tolist() for t in texts]
    assert got == [x[:-1] for x in plain_ids(texts)]


@pytest.mark.parametrize("capacity", [64, 1024])
def test_pieces_hold_each_id_once(docs, rows, capacity):
    got = curve_packing.placed(docs, byte_tokenizer(), capacity).collect()
    # pieces of one row follow each other on the line of all tokens; a row ends where its last piece does
    line = sorted(got, key=lambda p: (p.sequence_id, p.offset))
    found, now = [], []
    for p in line:
        assert p.start == sum(q.length for q in now)
        now.append(p)
        if p.start + p.length == p.doc_tokens:
            found.append(now)
            now = []
    assert not now
    ids = plain_ids([r[1] for r in rows])
    want = {}
    for r, x in zip(rows, ids, strict=True):
        want.setdefault((r[0], len(x)), []).append(x)
    for pieces in found:
        options = want[(pieces[0].doc_id, pieces[0].doc_tokens)]
        fits = [x for x in options if [crc(x[p.start : p.start + p.length]) for p in pieces] == [p.ids_crc32 for p in pieces]]
        options.remove(fits[0])
    assert not any(want.values())
    held = {}
    for p in got:
        held.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for places in held.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at == capacity or at & at - 1 == 0
    assert sum(sum(n for _, n in v) == capacity for v in held.values()) == sum(map(len, ids)) // capacity


def test_line_follows_the_curve(docs):
    got = curve_packing.placed(docs, byte_tokenizer()).collect()
    line = sorted(got, key=lambda p: (p.sequence_id, p.offset))
    keys = [p.hilbert for p in line]
    assert keys == sorted(keys) and len(set(keys)) > 20


def test_neighbours_are_alike(spark, data):
    """On the curve the next document is more often of the same language than one at random."""
    docs = spark.read.parquet(f"{data}/documents.parquet")
    langs = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    line = sorted(curve_packing.placed(docs, byte_tokenizer()).where("start = 0").collect(), key=lambda p: (p.sequence_id, p.offset))
    order = [langs[p.doc_id] for p in line]
    same = sum(a == b for a, b in zip(order, order[1:], strict=False)) / (len(order) - 1)
    by_chance = sum((order.count(x) / len(order)) ** 2 for x in set(order))
    assert same > by_chance + 0.2


def test_bounds():
    for total in (0, 1, 1023, 1024, 1025, 5000):
        full, tail = curve_packing.bounds(total)
        lengths = np.diff(tail).tolist()
        assert full == total // 1024 and full * 1024 + sum(lengths) == total
        assert all(x & x - 1 == 0 for x in lengths) and lengths == sorted(set(lengths), reverse=True)


def test_sequences_give_texts_back(spark, empty):
    from tokenizers import Tokenizer

    docs = spark.createDataFrame([(1, "some words here", "en", "s", 1), (2, None, "en", "s", 1), (3, "more " * 400, "en", "s", 1)], H.DOCS)
    got = sorted(curve_packing.sequences(docs, byte_tokenizer(), 128).collect(), key=lambda s: s.sequence_id)
    ids = {1: [], 2: [], 3: []}
    for s in got:
        assert s.n == sum(p.length for p in s.pieces)
        for p in s.pieces:
            assert p.start == len(ids[p.doc_id])
            ids[p.doc_id] += np.frombuffer(p.ids, "<u4").tolist()
    tokenizer = Tokenizer.from_file(byte_tokenizer())
    assert {k: tokenizer.decode(v[:-1]) for k, v in ids.items()} == {1: "some words here", 2: "", 3: "more " * 400}
    assert curve_packing.placed(empty, byte_tokenizer()).count() == 0
    assert curve_packing.sequences(empty, byte_tokenizer()).count() == 0


def plain_h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(row, text):
    values = [None if v is None else str(v) for v in (row[0], row[3], row[2], row[4], text)]
    return plain_h("".join("-" if v is None else f"{len(v.encode())}:{v}" for v in values))


def plain_manifest(rows):
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) from the definition, with lists."""

    def up(nodes):
        out = [nodes]
        while len(nodes) > 1:
            nodes = [plain_h("".join(nodes[i : i + 16])) for i in range(0, len(nodes), 16)]
            out.append(nodes)
        return out

    def way(tree, k):
        out = []
        for nodes in tree[:-1]:
            run = nodes[k // 16 * 16 : k // 16 * 16 + 16]
            out.append((run[: k % 16], run[k % 16 + 1 :]))
            k //= 16
        return out

    by = {}
    for r in rows:
        by.setdefault(r[3], []).append((r[0], plain_leaf(r, r[1]), r))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in order:
        by[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    trees = {s: up([x[1] for x in by[s]]) for s in order}
    top = up([trees[s][-1][0] for s in order])
    root, out = top[-1][0], []
    for i, s in enumerate(order):
        for k, (doc_id, leaf, r) in enumerate(by[s]):
            path, node = way(trees[s], k) + way(top, i), leaf
            if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0 and r[1] is not None:
                node = plain_leaf(r, "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1]))
            for a, b in path:
                node = plain_h("".join([*a, node, *b]))
            out.append((doc_id, leaf, trees[s][-1][0], root, plain_h("".join("".join(a + b) for a, b in path)), node, node == root))
    return sorted(out, key=key)


@pytest.mark.parametrize("depth", [1, 3])
@pytest.mark.parametrize("sources", [0, 1, 40])
def test_manifest_against_lists(docs, rows, depth, sources):
    """As given, all in one source, and in so many that the tree of sources has two levels. Blocks of one level take several rounds."""
    if sources:
        name = lambda i: f"s{(i or 0) * 7 % sources}é"
        rows = [(*r[:3], name(r[0]), r[4]) for r in rows]
        docs = docs.withColumn("source", F.concat(F.lit("s"), F.pmod(F.coalesce("doc_id", F.lit(0)) * 7, F.lit(sources)).cast("string"), F.lit("é")))
    got = merkle.manifest(docs, depth=depth).collect()
    assert sorted(map(tuple, got), key=key) == plain_manifest(rows)


def test_manifest_finds_tampering(spark):
    rows = [(i, f"{'A' if i % 2 else 'a'} text {i}", "en", f"src{i % 3}", i) for i in range(700)]
    got = merkle.manifest(spark.createDataFrame(rows, H.DOCS)).collect()
    hit = {i for i in range(700) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert {r.doc_id for r in got if not r.verified} == {i for i in hit if i % 2} and hit


def test_proofs_lead_to_the_root(docs):
    for r in merkle.manifest(docs, with_proof=True, depth=1).collect():
        path = [(p.at, p.others) for p in r.proof]
        assert merkle.fold(r.leaf, path) == r.root
        assert hashlib.sha256("".join(o for _, o in path).encode()).hexdigest() == r.proof_sha256


def test_manifest_of_one_row_and_none(spark, empty):
    one = [(5, "Some Text", "en", "s", 9)]
    got = merkle.manifest(spark.createDataFrame(one, H.DOCS)).collect()
    assert list(map(tuple, got)) == plain_manifest(one)
    assert got[0].root == got[0].subroot == got[0].leaf
    assert merkle.manifest(empty).count() == 0


def test_manifest_against_sql(docs, rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", [list(r) for r in rows if r[0] is not None])
    want = sorted(con.sql(merkle.SQL).fetchall(), key=key)
    assert sorted(map(tuple, merkle.manifest(docs.where("doc_id is not null")).collect()), key=key) == want
