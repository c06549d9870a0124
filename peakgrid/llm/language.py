"""Language identification by hierarchical discrimination: first the language family, then one-versus-one linear support vector machines within it."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from itertools import combinations
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Documents that the machines are fitted on, about, over all languages; but at least TRAIN_LEAST of each language that has so many.
TRAIN_MAX = 4_000
TRAIN_LEAST = 20
#: Rows of 4 KB that come to the driver, at most, while there are at least two for each language.
TRAIN_ALL = 40_000
#: Classes that are told apart pair by pair. A larger family is split into so many groups first, and so on.
SPLIT = 24
DIMS = 2048
#: Families of common languages by ISO 639-1 code. A language that isn't listed is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz tk ky",
    "indic": "hi bn ur pa mr gu ne sa si",
    "iranian": "fa ku ps tg",
    "semitic": "ar he am mt",
    "sinitic": "zh yue",
    "celtic": "ga cy gd br",
    "baltic": "lt lv",
    "dravidian": "ta te kn ml",
    "malayic": "id ms",
}
_FAMILY = {lang: family for family, langs in FAMILIES.items() for lang in langs.split()}
_MAYBE_LETTER = re.compile(r"[^\W\d_]")
#: ASCII bytes that aren't letters become spaces; digits and marks say nothing of the language.
_PLAIN = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def family(lang: str) -> str:
    return _FAMILY.get(lang.lower().replace("_", "-").split("-")[0], lang)


def grams(text: bytes) -> np.ndarray:
    """Square roots of the shares of hashed 2- and 3-byte sequences of the lower-cased letters: a unit vector, or zeros. Sequences don't reach over a block's end."""
    half = DIMS // 2
    count = np.zeros(DIMS, np.int64)
    for part in common.blocks(text):
        a = np.frombuffer(b" " + part.decode().lower().encode().translate(_PLAIN) + b" ", np.uint8).astype(np.uint32)
        two = (a[:-1] * np.uint32(0x9E3779B1)) ^ (a[1:] * np.uint32(0x85EBCA77))
        three = two[:-1] * np.uint32(31) + a[2:] * np.uint32(0xC2B2AE3D)
        for k, x in enumerate((two, three)):
            count[k * half : (k + 1) * half] += np.bincount(x >> np.uint32(16) & np.uint32(half - 1), minlength=half)
    return np.sqrt(count / max(count.sum(), 1)).astype(np.float32)


def lettered(text: bytes) -> bool:
    """Whether the text has a letter (a character of Unicode's categories L; numerals like ² or Ⅳ aren't)."""
    return any(m[0].isalpha() for part in common.blocks(text) for m in _MAYBE_LETTER.finditer(part.decode()))


def svm(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 150, rate: float = 0.05) -> np.ndarray:
    """Linear support vector machines with squared hinge loss, one for each column of y; both classes of a machine weigh alike. y: 1, -1, or 0 for rows that a machine leaves out. A row of weights per machine, the last of them the offset."""
    y = y.astype(np.float32)
    w, m, v = np.zeros((x.shape[1] + 1, y.shape[1]), np.float32), np.float32(0), np.float32(0)
    share = (0.5 / np.maximum((y > 0).sum(0), 1) * (y > 0) + 0.5 / np.maximum((y < 0).sum(0), 1) * (y < 0)).astype(np.float32)
    for t in range(1, steps + 1):
        slack = np.maximum(0, 1 - y * (x @ w[:-1] + w[-1]))
        pull = -2 * share * slack * y
        g = np.concatenate([x.T @ pull + ridge * w[:-1], pull.sum(0)[None]])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)
    return w.T.astype(np.float32)


def certain(margin: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-4 * np.clip(margin, -9, 9)))


@dataclass
class Duel:
    """One-versus-one machines between parts, each a language or, in a family of many, a Duel of its own."""

    parts: list[Any]
    pairs: list[tuple[int, int]]
    weights: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, lang: np.ndarray, langs: list[str]) -> Duel | str:
        """Fit on the rows whose lang is one of langs, which are sorted, so that variants of one language fall into one group."""
        if len(langs) == 1:
            return langs[0]
        groups = [list(g) for g in np.array_split(np.array(langs, object), min(SPLIT, len(langs)))]
        rows = np.isin(lang.astype(str), langs)
        x, lang = x[rows], lang[rows]
        of = {name: k for k, g in enumerate(groups) for name in g}
        which = np.array([of[name] for name in lang])
        pairs = list(combinations(range(len(groups)), 2))
        weights = [svm(x[some], np.where(which[some] == i, 1, -1)[:, None]) for i, j in pairs for some in [(which == i) | (which == j)]]
        return cls([cls.fit(x, lang, g) for g in groups], pairs, np.concatenate(weights))

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Language and least margin of each row: most votes win, then the greater margins, then the first part."""
        n = len(self.parts)
        d = x @ self.weights[:, :-1].T + self.weights[:, -1]
        votes, least = np.zeros((len(x), n)), np.full((len(x), n), np.inf)
        for k, (i, j) in enumerate(self.pairs):
            for at, s in ((i, d[:, k]), (j, -d[:, k])):
                votes[:, at] += (s > 0) + 1e-3 * np.tanh(s)
                least[:, at] = np.minimum(least[:, at], s)
        best = votes.argmax(1)
        lang, margin = np.empty(len(x), object), least[np.arange(len(x)), best]
        for k, part in enumerate(self.parts):
            rows = np.flatnonzero(best == k)
            if isinstance(part, str):
                lang[rows] = part
            elif len(rows):
                lang[rows], more = part.predict(x[rows])
                margin[rows] = np.minimum(margin[rows], more)
        return lang, margin


@dataclass
class Model:
    """families: name -> languages. top: a one-versus-rest machine for each family. within: family -> its only language, or the machines of its languages."""

    families: dict[str, list[str]] = field(default_factory=dict)
    top: np.ndarray | None = None
    within: dict[str, Duel | str] = field(default_factory=dict)

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Language and score of each row: the least certainty among the decisions that chose the language. A score below 0.5 means that no family's machine claims the text, or that a language was chosen against a machine's vote."""
        z = x @ self.top[:, :-1].T + self.top[:, -1] if self.top is not None else np.full((len(x), len(self.families)), 9.0)
        chosen, margin = z.argmax(1), z.max(1)
        lang = np.empty(len(x), object)
        for f, name in enumerate(self.families):
            rows, inner = np.flatnonzero(chosen == f), self.within[name]
            if isinstance(inner, str):
                lang[rows] = inner
            elif len(rows):
                lang[rows], more = inner.predict(x[rows])
                margin[rows] = np.minimum(margin[rows], more)
        return lang, certain(margin)


def held_out(doc_id: F.Column) -> F.Column:
    """CRC-32 of the id as text leaves 2 when divided by 4. A null id is not held out."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def fit(docs: DataFrame, train_max: int = TRAIN_MAX, train_least: int = TRAIN_LEAST) -> Model:
    """Fit on texts and non-null languages of documents that aren't held out: of each language about train_max / (number of languages) and at least train_least documents, or all if it has fewer, chosen by a hash of their ids; fewer for each where all would be over TRAIN_ALL. Repeated rows are learned from as often as they are there; a null id isn't held out. Every language is learned that has a text with letters there."""
    known = common.pick(docs, "doc_id", "lang").where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    counts = [(r["lang"], r["n"]) for r in known.groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang").collect()]
    if not counts:
        return Model()
    each, whole = min(max(train_least, train_max // len(counts)), max(2, TRAIN_ALL // (2 * len(counts)))), 1 << 30
    share = docs.sparkSession.createDataFrame([(lang, min(whole, 1 + int(whole * each / n))) for lang, n in counts], "lang string, share long")
    chosen = common.pick(docs, "doc_id", "lang", "text").where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id"))).join(F.broadcast(share), "lang")  # a row per language
    # the expected number is each; the limit bounds what comes to the driver
    chosen = chosen.where(F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(0))), F.lit(whole)) < F.col("share"))

    def fn(rows: list[bytes]) -> list[pa.Array]:
        return [pa.array([grams(t).astype(np.float16).tobytes() for t in rows], pa.binary())]

    got = common.append(chosen, "text", fn, [T.StructField("x", T.BinaryType())], ["doc_id", "lang"]).orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * each * len(counts)).toArrow()
    x = np.frombuffer(b"".join(got.column("x").to_pylist()), np.float16).reshape(-1, DIMS).astype(np.float32)
    lang = np.array(got.column("lang").to_pylist(), object)
    some = x.any(1)
    x, lang = x[some], lang[some]
    families: dict[str, list[str]] = {}
    for name in sorted(set(lang)):
        families.setdefault(family(name), []).append(name)
    if not families:
        return Model()
    which = np.array([family(n) for n in lang], object)
    model = Model(families)
    if len(families) > 1:
        model.top = svm(x, np.where(which[:, None] == np.array(list(families), object)[None], 1, -1))
    model.within = {f: Duel.fit(x, lang, langs) for f, langs in families.items()}
    return model


def apply(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """Columns keep of docs, then lang_pred and score (0 to 1), a row per row of docs, from the text alone.

    A text that is null or has no letter, and any text where no language was learned, is `und` with score 0. Equal texts, and so
    repeated rows, get equal results; ties of families go to the first in order, ties of languages to the first in order among those with
    most votes and greatest margins. Very long texts are read whole, in blocks. An empty table gives no rows. Columns of docs that are
    named lang_pred or score may be kept and stand before the new ones.
    """

    def fn(rows: list[bytes]) -> list[pa.Array]:
        langs, scores = [], []
        for s in range(0, len(rows), 512):
            part = rows[s : s + 512]
            letters = np.array([lettered(t) for t in part])
            if model.families:
                lang, score = model.predict(np.stack([grams(t) for t in part]))
                lang[~letters], score[~letters] = "und", 0.0
            else:
                lang, score = np.full(len(part), "und", object), np.zeros(len(part))
            langs.append(lang)
            scores.append(score)
        return [pa.array(np.concatenate(langs) if langs else [], pa.string()), pa.array(np.concatenate(scores).astype(np.float64) if scores else [], pa.float64())]

    return common.append(docs, "text", fn, [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())], keep)
