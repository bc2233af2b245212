"""Secret scans: three fixed patterns, and a token-efficiency test for other random strings.

A byte-pair vocabulary knows words and common strings, so ordinary text takes few tokens; a random string takes a token
for every two characters or less. Runs of key characters with a low ratio of characters to tokens are reported, after
known digests and identifiers are excluded (digest-length hex, UUIDs, numbers, dates, and what has few letters). Runs
whose words are each in one letter case are taken word by word, and against a lower ratio, since they may be words of a
language that the vocabulary knows little of.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .bpe import codec, vocabulary
from .common import documents, per_document

KINDS = ("assign", "access", "hex", "random")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_STEMS = ("passw", "secret", "token", "api_key", "apikey")
_DIGEST = re.compile(r"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128})\Z", re.I | re.A)
_UUID = re.compile(r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\Z", re.I | re.A)
_CASED = re.compile(r"[-_/=+]*(?:(?:[A-Z]?[a-z]+|[A-Z]+)(?:[-_/=+]+|\Z))+\Z", re.A)
_WORDS = re.compile(r"[A-Za-z]+", re.A)
_HEX, _KEY = 1, 2
_FLAGS = np.zeros(128, np.uint8)
for _c in "0123456789abcdef":
    _FLAGS[ord(_c)] |= _HEX
for _c in "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/_=-":
    _FLAGS[ord(_c)] |= _KEY


def _runs(mask: np.ndarray, least: int) -> np.ndarray:
    """(start, end) of the maximal runs of at least that length."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    pairs = edges.reshape(-1, 2)
    return pairs[pairs[:, 1] - pairs[:, 0] >= least]


class Scanner:
    """min_chars: shortest run that is tested; max_ratio: characters per token at or below which it counts as random; word_ratio:
    the same for words in one letter case; min_letters: the share of letters that a run must have."""

    def __init__(self, rank_file: bytes, min_chars: int = 16, max_ratio: float = 2.0, word_ratio: float = 1.75, min_letters: float = 0.2):
        self.codec, self.min_chars, self.max_ratio, self.word_ratio, self.min_letters = codec(rank_file), min_chars, max_ratio, word_ratio, min_letters

    def ratio(self, s: str) -> float:
        return len(s) / (len(self.codec.encode([s])[0]) // 4)

    def is_random(self, s: str) -> bool:
        if _DIGEST.match(s) or _UUID.match(s) or sum(map(str.isalpha, s)) < self.min_letters * len(s):
            return False
        if _CASED.match(s):
            return any(len(w) >= self.min_chars and self.ratio(w) <= self.word_ratio for w in _WORDS.findall(s))
        return self.ratio(s) <= self.max_ratio

    def scan(self, texts: list[str]) -> list[list[tuple[str, int, int]]]:
        """Each text's spans (kind, start, end) in code points, by start, then kind; ends exclusive.

        Base kinds are the leftmost non-overlapping matches of their pattern, less those that are too short. A random
        span has no character in common with a base span.
        """
        joined = "\n".join(texts)
        codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        flags = np.where(codes < 128, _FLAGS[np.minimum(codes, 127)], 0)
        begins = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)])
        out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
        for a, b in _runs(flags & _HEX > 0, 24).tolist():  # maximal runs are what a greedy [0-9a-f]+ matches
            i = int(np.searchsorted(begins, a, "right")) - 1
            out[i].append(("hex", a - int(begins[i]), b - int(begins[i])))
        lowered = joined.lower()
        some_assign, some_access = any(s in lowered for s in _STEMS), "AKIA" in joined
        for text, found in zip(texts, out):
            if some_assign and any(s in (low := text.lower()) for s in _STEMS):
                found += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
            if some_access and "AKIA" in text:
                found += [("access", *m.span()) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
        for a, b in _runs(flags & _KEY > 0, self.min_chars).tolist():
            i = int(np.searchsorted(begins, a, "right")) - 1
            a, b = a - int(begins[i]), b - int(begins[i])
            if not any(x < b and a < y for _, x, y in out[i]) and self.is_random(texts[i][a:b]):
                out[i].append(("random", a, b))
        for found in out:
            found.sort(key=lambda f: (f[1], KINDS.index(f[0]), f[2]))
        return out


_scanners: dict = {}


def _scanner(rank_file: bytes, **options) -> Scanner:
    key = (hashlib.sha256(rank_file).hexdigest(), *sorted(options.items()))
    if key not in _scanners:
        _scanners[key] = Scanner(rank_file, **options)
    return _scanners[key]


def find_secrets(docs: DataFrame, path: str | None = None, **options) -> DataFrame:
    """One row per row of docs: doc_id, found array<struct<kind, start, end, text>>. A null or empty text has none.

    options are Scanner's. Repeated rows are scanned each; an empty table gives no rows; only doc_id and text are read.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(vocabulary(path))

    def compute(texts):
        s = _scanner(ranks.value, **options)
        return [[[{"kind": k, "start": a, "end": b, "text": t[a:b]} for k, a, b in found] for t, found in zip(texts, s.scan(texts))]]

    return per_document(docs, compute, "found array<struct<kind:string,start:int,`end`:int,text:string>>")


_BASE = "filter(found, f -> f.kind <> 'random')"


def _spans(x: str) -> str:
    return f"array_join(transform({x}, f -> concat_ws(':', f.kind, f.start, f.`end`)), ',')"


def _numbers(kinds: tuple[str, ...]) -> list[str]:
    return [f"CAST(size(filter(found, f -> f.kind = '{kind}')) AS long) AS n_{kind}" for kind in kinds]


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's spans. Null texts are empty; ties in start go by kind; repeated rows are scanned each; an empty table gives
    no rows; further columns are not read."""
    found = find_secrets(documents(spark, sf_dir))
    return found.selectExpr("doc_id", *_numbers(KINDS), f"sha2({_spans(_BASE)}, 256) AS base_sha256", f"{_spans('found')} AS spans")


def secrets_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spans of the three fixed patterns alone, which SQL can say."""
    return find_secrets(documents(spark, sf_dir)).selectExpr("doc_id", *_numbers(KINDS[:3]), f"{_spans(_BASE)} AS base_spans")


def _matches(kind: str, pattern: str, test: str) -> str:
    """SQL for (rid, kind, a, b) of a pattern's leftmost non-overlapping matches that pass the test on match m. What stands between
    two matches tells where each begins."""
    return f"""SELECT rid, '{kind}' AS kind, a, a + length(m) AS b FROM (
      SELECT rid, m, CAST(coalesce(sum(length(gap) + length(m)) OVER (PARTITION BY rid ORDER BY i), 0) - length(m) AS BIGINT) AS a FROM (
        SELECT rid, unnest(generate_series(1, len(ms))) AS i, unnest(ms) AS m, unnest(list_resize(gaps, len(ms))) AS gap
        FROM (SELECT rid, regexp_extract_all(body, '{pattern}') AS ms, regexp_split_to_array(body, '{pattern}') AS gaps FROM d) WHERE len(ms) > 0)) WHERE {test}"""


_KEY_SQL = r"""(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?"""
_VALUE_SQL = "[A-Za-z0-9+/_.=-]+"
BASE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS body FROM documents),
s AS ({_matches("assign", _KEY_SQL + _VALUE_SQL, f"length(regexp_extract(m, '^{_KEY_SQL}({_VALUE_SQL})$', 1)) >= 6")}
  UNION ALL {_matches("access", "AKIA[A-Z0-9]+", "length(m) >= 20")}
  UNION ALL {_matches("hex", "[0-9a-f]+", "length(m) >= 24")}),
g AS (SELECT rid, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
   string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, CASE kind WHEN 'assign' THEN 1 WHEN 'access' THEN 2 ELSE 3 END) AS spans FROM s GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, coalesce(spans, '') AS base_spans FROM d LEFT JOIN g USING (rid)
"""
