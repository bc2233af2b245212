"""Toxicity: gradient-boosted trees over dense features of a text, with isotonic calibration.

Features: densities of a seed lexicon and of a lexicon learned from labelled texts (words and word beginnings), nearness
of second-person words to lexicon words, capitals, punctuation, repetition and obfuscation. A bounded sample of labelled
training rows (max_rows, by hash of doc_id, the same at every size of the corpus) gives the lexicon (one half) and the
trees (the other half); calibration uses scores from trees that did not see the row. Every document is scored whole.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, give_back, per_document

SEED = frozenset(
    "idiot idiots idiotic moron morons moronic stupid trash scum loser losers pathetic worthless disgusting clown dumb dumbass jerk "
    "bastard bitch asshole shit shitty fuck fucking cunt dick prick whore slut retard retarded imbecile vermin filth filthy hate kill die ugly "
    "idioten dumm dummkopf arschloch scheisse scheiße abschaum hure wichser missgeburt versager "
    "connard connasse salope merde imbécile ordure débile crétin abruti pute "
    "estúpido estúpida imbécil puta mierda basura gilipollas cabrón pendejo inútil asqueroso".split()
)
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos ti tú usted ustedes vosotros os".split())
PREFIX = 5
_WORD = re.compile(r"[^\W\d_]+")
_MIXED = re.compile(r"[^\W\d_]+[@$*013457!|][^\W_@$*!|]*[^\W\d_][^\s]*")
_SPACED = re.compile(r"(?<!\w)(?:[^\W\d_][ .\-_*]){3,}[^\W\d_](?!\w)")
_LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l", "*": "", ".": "", "-": "", "_": "", " ": ""})
FEATURES = (
    "log_words", "seed_density", "seed_log", "word_density", "word_log", "word_weight", "word_max", "prefix_density", "prefix_log", "prefix_max",
    "second_density", "near_second", "upper_share", "shout_share", "bang_density", "question_density", "punct_density", "repeat_share", "mixed_density", "hidden_hits",
)


@dataclass
class Lexicon:
    words: dict[str, float] = field(default_factory=dict)
    prefixes: dict[str, float] = field(default_factory=dict)


def features(text: str, lexicon: Lexicon) -> list[float]:
    """The values of FEATURES; an empty text has zeros."""
    words = _WORD.findall(text.lower())
    n = len(words)
    per = 1.0 / (n + 10)
    seed = [i for i, w in enumerate(words) if w in SEED]
    known, pre = lexicon.words, lexicon.prefixes
    hits = [(i, known[w]) for i, w in enumerate(words) if w in known]
    begin = [(i, pre[w[:PREFIX]]) for i, w in enumerate(words) if w[:PREFIX] in pre] if pre else []
    second = [i for i, w in enumerate(words) if w in SECOND_PERSON]
    bad = sorted({*seed, *(i for i, _ in hits), *(i for i, _ in begin)})
    near = 0
    if bad and second:
        at = np.searchsorted(s := np.array(second), bad)
        b = np.array(bad)
        gap = np.minimum(np.where(at > 0, b - s[np.maximum(at - 1, 0)], 99), np.where(at < len(s), s[np.minimum(at, len(s) - 1)] - b, 99))
        near = int((gap <= 5).sum())
    upper, letters = sum(map(text.count, "ABCDEFGHIJKLMNOPQRSTUVWXYZ")), max(1, sum(map(len, words)))
    shout = len(re.findall(r"\b[A-Z]{3,}\b", text)) if upper > 2 else 0
    mixed = _MIXED.findall(text) if any(c in text for c in "@$*013457!|") else []
    spaced = _SPACED.findall(text)
    hidden = sum(w in SEED or w in known for w in (m.lower().strip(".,;:?").translate(_LEET) for m in [*mixed, *spaced]))
    log = np.log1p
    return [
        log(n), len(seed) * per, log(len(seed)), len(hits) * per, log(len(hits)), sum(w for _, w in hits) * per, max((w for _, w in hits), default=0.0),
        len(begin) * per, log(len(begin)), max((w for _, w in begin), default=0.0), len(second) * per, near * per, upper / letters, shout * per,
        text.count("!") * per, text.count("?") * per, sum(map(text.count, ".,;:")) * per, 1 - len(set(words)) / n if n else 0.0, len(mixed) * per, float(hidden),
    ]


class Boosted:
    """Histogram gradient boosting for a 0/1 label, Newton leaves, on the driver over a bounded sample."""

    def __init__(self, trees: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 48, least: float = 2.0):
        self.trees, self.depth, self.rate, self.bins, self.least = trees, depth, rate, bins, least

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) if len(x) else np.zeros(0) for j in range(x.shape[1])]
        codes = self._codes(x)
        p = min(max(float(y.mean()) if len(y) else 0.0, 1e-3), 1 - 1e-3)
        self.base, self.model = float(np.log(p / (1 - p))), []
        if not len(y) or y.min() == y.max():
            return self
        margin = np.full(len(y), self.base)
        for _ in range(self.trees):
            prob = 1 / (1 + np.exp(-margin))
            node, g, h = np.zeros(len(y), np.int64), y - prob, prob * (1 - prob)
            splits: dict[int, tuple[int, int]] = {}
            for level in range(self.depth):
                for k in range(2**level - 1, 2 ** (level + 1) - 1):
                    rows = np.flatnonzero(node == k)
                    if len(rows) and (best := self._split(codes[rows], g[rows], h[rows])):
                        splits[k] = best
                        node[rows] = 2 * k + 1 + (codes[rows, best[0]] > best[1])
            leaves = {int(k): float(self.rate * g[node == k].sum() / (h[node == k].sum() + 1.0)) for k in np.unique(node)}
            self.model.append((splits, leaves))
            margin += np.array([leaves[k] for k in node.tolist()])
        return self

    def _codes(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(self.edges)], 1) if len(x) else np.zeros((0, len(self.edges)), np.int64)

    def _split(self, codes: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[int, int] | None:
        best, gain = None, 1e-6
        for j in range(codes.shape[1]):
            m = len(self.edges[j]) + 1
            gs, hs = np.cumsum(np.bincount(codes[:, j], g, m))[:-1], np.cumsum(np.bincount(codes[:, j], h, m))[:-1]
            if not len(gs):
                continue
            gr, hr = g.sum() - gs, h.sum() - hs
            score = gs**2 / (hs + 1) + gr**2 / (hr + 1) - g.sum() ** 2 / (h.sum() + 1)
            score[(hs < self.least * 0.05) | (hr < self.least * 0.05)] = 0
            if score.max() > gain:
                best, gain = (j, int(score.argmax())), float(score.max())
        return best

    def margin(self, x: np.ndarray) -> np.ndarray:
        codes, out = self._codes(x), np.full(len(x), self.base)
        for splits, leaves in self.model:
            node = np.zeros(len(x), np.int64)
            for k in sorted(splits):
                rows = np.flatnonzero(node == k)
                j, cut = splits[k]
                node[rows] = 2 * k + 1 + (codes[rows, j] > cut)
            out += np.array([leaves.get(k, 0.0) for k in node.tolist()]) if len(x) else 0
        return out


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: (scores, calibrated values), both rising."""
    if not len(score):
        return np.array([0.0]), np.array([0.0])
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []  # sum, weight, lowest, highest score
    for s, v in zip(score[order].tolist(), y[order].tolist()):
        if blocks and blocks[-1][3] == s:  # ties are one point
            blocks[-1][0] += v
            blocks[-1][1] += 1
        else:
            blocks.append([v, 1, s, s])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            v2, w2, _, hi = blocks.pop()
            blocks[-1] = [blocks[-1][0] + v2, blocks[-1][1] + w2, blocks[-1][2], hi]
    return np.array([s for b in blocks for s in (b[2], b[3])]), np.array([b[0] / b[1] for b in blocks for _ in (0, 1)])


@dataclass
class Model:
    lexicon: Lexicon
    trees: Boosted
    points: np.ndarray
    values: np.ndarray

    def score(self, texts: list[str]) -> np.ndarray:
        m = self.trees.margin(np.array([features(t, self.lexicon) for t in texts], float).reshape(len(texts), len(FEATURES)))
        # a thousandth of the margin's own probability keeps the order within a calibrated step
        return 0.999 * np.interp(m, self.points, self.values) + 0.001 / (1 + np.exp(-m))


def _bucket(salt: str, n: int):
    return F.pmod(F.crc32(F.concat(F.lit(salt), F.col("doc_id").cast("string"))), F.lit(n))


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int) -> DataFrame:
    """(doc_id, text, toxic, fold 0..7): labelled documents that are not held out, at most max_rows, the first by a hash of doc_id."""
    chosen = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).filter(~held_out())
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows).withColumn("fold", _bucket("fold", 8).cast("int"))
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most max_rows rows
    again = docs.select("doc_id").join(F.broadcast(chosen.select("doc_id")), "doc_id").groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id")
    if again.isEmpty():
        return rows
    # of repeated doc_ids one text
    several = rows.join(F.broadcast(again), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic"), F.first("fold").alias("fold"))
    return rows.join(F.broadcast(again), "doc_id", "left_anti").unionByName(several)


def learn_lexicon(rows: DataFrame, size: int = 4000) -> Lexicon:
    """Words and word beginnings that set toxic texts apart, of the first half of the folds; at most `size` terms, copies counted once."""
    half = rows.filter("fold < 4").dropDuplicates(["text"]).select("toxic", "text")

    def count(batches):
        import pyarrow as pa

        found: dict[str, list[int]] = {}
        for b in batches:
            for y, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ws = set(_WORD.findall((t or "").lower()))
                for w in ws | {"^" + w[:PREFIX] for w in ws if len(w) >= PREFIX}:
                    if len(w) <= 40:
                        c = found.setdefault(w, [0, 0])
                        c[0 if y else 1] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array([c[0] for c in found.values()], pa.int64()), pa.array([c[1] for c in found.values()], pa.int64())], names=["term", "t", "c"])

    sizes = {r.toxic: r.n for r in half.groupBy((F.col("toxic") > 0).cast("int").alias("toxic")).agg(F.count("*").alias("n")).collect()}
    pos, neg = sizes.get(1, 0), sizes.get(0, 0)
    terms = half.mapInArrow(count, "term string, t long, c long").groupBy("term").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    terms = terms.filter((F.col("t") >= max(4, 0.004 * pos)) & (F.col("t") >= 4 * F.col("c"))).withColumn("weight", F.log((F.col("t") + 0.5) / (pos + 1)) - F.log((F.col("c") + 0.5) / (neg + 1))).filter("weight > 2")
    out = Lexicon()
    for r in terms.orderBy(F.desc(F.col("t") * F.col("weight")), "term").limit(size).collect():
        if r.term[0] == "^":
            out.prefixes[r.term[1:]] = r.weight
        else:
            out.words[r.term] = r.weight
    return out


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000) -> Model:
    """A model from labelled, not held-out rows. Without labels, or with one class only, scores are the base rate."""
    rows = training_rows(docs, labels, max_rows)
    lexicon = learn_lexicon(rows)
    vectors = per_document(rows, lambda texts: [[features(t, lexicon) for t in texts]], "x array<double>", carry=("toxic", "fold"))
    got = vectors.collect()  # at most max_rows rows of len(FEATURES) numbers
    got.sort(key=lambda r: (r.fold, r.toxic, r.x))
    x, y, fold = np.array([r.x for r in got], float).reshape(len(got), len(FEATURES)), np.array([r.toxic > 0 for r in got], float), np.array([r.fold for r in got], int)
    use = fold >= 4
    if y[use].sum() < 20 or len(y[use]) - y[use].sum() < 20:  # too few rows to keep a half for the lexicon alone
        use[:] = True
    x, y, fold = x[use], y[use], fold[use]
    apart = np.zeros(len(y))
    for k in range(3):
        test = fold % 4 % 3 == k
        if test.any():
            apart[test] = Boosted().fit(x[~test], y[~test]).margin(x[test])
    return Model(lexicon, Boosted().fit(x, y), *isotonic(apart, y))


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """One row per row of docs: doc_id, score in 0..1. A null text scores as an empty one; no other column is read."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most 4000 terms and 80 small trees

    return per_document(docs, lambda texts: [np.clip(shared.value.score(texts), 0.0, 1.0)], "score double")


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """docs, all columns, without texts that score at or above the threshold. Order and repeated rows stay as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    @F.pandas_udf("double")
    def score(s):
        import pandas as pd

        texts, out, at = [t or "" for t in s], [], 0
        while at < len(texts):  # whole texts, in bounded groups
            end, chars = at, 0
            while end < len(texts) and (end == at or chars + len(texts[end]) <= 1 << 20):
                chars += len(texts[end])
                end += 1
            out.append(shared.value.score(texts[at:end]))
            at = end
        give_back()
        return pd.Series(np.concatenate(out) if out else np.zeros(0))

    return docs.filter(score("text") < threshold)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score. Null texts score as empty ones; repeated rows and ties score alike; a null doc_id is not held out and
    has no label; an empty table gives no rows; further columns are not read."""
    docs = documents(spark, sf_dir)
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_documents(docs, model).select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
