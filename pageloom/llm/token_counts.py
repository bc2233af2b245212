"""Token counts by section: a document is encoded once, and token character spans are joined to section spans.

Encoding sections apart would count other tokens than the whole text has, since tokens may reach over a boundary. So
spans are made from the whole encoding, joined to sections as intervals, and a token that several sections share is
allocated by a rule: "first" (the section of its first character), "last" (of its last), or "split" (in proportion to
characters, so counts are fractions).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .bpe import codec, vocabulary
from .common import documents, per_document

RULES = ("first", "last", "split")
#: Kinds of the lines that op5 takes for sections, in the order of its columns.
KINDS = ("heading", "table", "body", "blank")


def line_sections(text: str) -> list[tuple[str, int, int]]:
    """A text's lines as (kind, start, end) in characters; the line feed belongs to the line it ends.

    heading: the first line, if another follows; table: has " | "; blank: white space only; body: all others.
    """
    out, at = [], 0
    while at < len(text):
        end = text.find("\n", at) + 1 or len(text)
        line = text[at:end]
        kind = "blank" if not line.strip() else "table" if " | " in line else "heading" if at == 0 and end < len(text) else "body"
        out.append((kind, at, end))
        at = end
    return out


def token_spans(text: str, packed: bytes, c) -> tuple[np.ndarray, np.ndarray]:
    """Characters [start, end) of each token. Of a character that several tokens share, each has it."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    width = 1 + (codes >= 0x80).astype(np.int64) + (codes >= 0x800) + (codes >= 0x10000)
    upto = np.cumsum(width)  # bytes before the end of each character
    ends = c.byte_ends(packed)
    starts = np.concatenate([[0], ends[:-1]])
    return np.searchsorted(upto, starts, "right"), np.searchsorted(upto, ends - 1, "right") + 1


def allocate(starts: np.ndarray, ends: np.ndarray, sections: list[tuple[str, int, int]], rule: str = "first") -> tuple[np.ndarray, int]:
    """(tokens of each section, number of tokens that reach over a boundary). Sections are disjoint, in order, not empty; gaps
    between them are no section. "first" and "last" leave out tokens whose deciding character lies in a gap."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    n = len(sections)
    counts = np.zeros(n, np.float64 if rule == "split" else np.int64)
    if not n or not len(starts):
        return counts, 0
    low, high = (np.array([s[i] for s in sections], np.int64) for i in (1, 2))
    a, b = np.searchsorted(low, starts, "right") - 1, np.searchsorted(low, ends - 1, "right") - 1
    outside = lambda k, at: (k < 0) | (at >= high[np.maximum(k, 0)])
    off_a, off_b = outside(a, starts), outside(b, ends - 1)
    crossing = int(((a != b) | (off_a != off_b)).sum())
    if rule == "split":
        whole = (a == b) & ~off_a & ~off_b
        np.add.at(counts, a[whole], 1.0)
        for i in np.flatnonzero(~whole):
            for k in range(max(a[i], 0), b[i] + 1):
                counts[k] += max(0, min(ends[i], high[k]) - max(starts[i], low[k])) / (ends[i] - starts[i])
    else:
        k, off = (a, off_a) if rule == "first" else (b, off_b)
        np.add.at(counts, k[~off], 1)
    return counts, crossing


def section_token_counts(docs: DataFrame, sections=line_sections, rule: str = "first", path: str | None = None) -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, n_crossing, sections array<struct<kind, start, end, tokens>>.

    A null or empty text has no tokens and no sections. sections is any function of a text as allocate() wants it.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(vocabulary(path))

    def compute(texts):
        c, out = codec(ranks.value), ([], [], [])
        for text, packed in zip(texts, c.encode(texts)):
            parts = sections(text)
            counts, crossing = allocate(*token_spans(text, packed, c), parts, rule)
            for col, v in zip(out, (len(packed) // 4, crossing, [{"kind": k, "start": a, "end": b, "tokens": float(t)} for (k, a, b), t in zip(parts, counts.tolist())])):
                col.append(v)
        return out

    return per_document(docs, compute, "n_tokens long, n_crossing long, sections array<struct<kind:string,start:int,`end`:int,tokens:double>>")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens by kind of line, crossing tokens counted where they start; the kinds add up to n_tokens."""
    parts = section_token_counts(documents(spark, sf_dir))
    of = lambda kind: f"CAST(aggregate(sections, 0D, (a, s) -> a + IF(s.kind = '{kind}', s.tokens, 0D)) AS long) AS {kind}_tokens"
    return parts.selectExpr("doc_id", "n_tokens", "n_crossing", "CAST(size(sections) AS long) AS n_sections", *map(of, KINDS), "transform(sections, s -> CAST(s.tokens AS long)) AS section_tokens")
