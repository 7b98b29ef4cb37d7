"""Token counts: whole documents are encoded once, token spans are joined to fields and sections by their offsets.

A document is one text column, or several, its fields, with a line break between them; sections are
the lines of each field. A token covers bytes [start, end) of the UTF-8 text; the spans of the tokens
and of the sections are both in order, so the join is a binary search. A token over a boundary goes,
by the rule, to the section of its first byte ("start"), of most of its bytes ("most", the earlier
one on a tie), or to each by its share of bytes ("share").

Null fields are left out; null and empty texts have no tokens and no sections. Runs of blanks of any
length are encoded as the pattern cuts them, but without it, since it would overflow. A very long
text is held whole by one task, with about 100 bytes for each of its tokens. A vocabulary comes as a
file of base64 tokens with their ranks, from the path in the session's spark.weftgraph.vocabulary,
which the executors must be able to read, or else from one of this machine. Rows are counted one by
one, whatever their doc_id; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import carried, map_arrow

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
SETTING = "spark.weftgraph.vocabulary"
#: Larger vocabulary files are refused, since each task holds the vocabulary.
MOST_BYTES = 64 << 20
#: The usual pre-tokenising pattern of byte-level BPE.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A run of blanks that is longer is not left to the pattern; the characters are those of its `\\s`.
_LONG_BLANK = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{1000,}")
KINDS = ("blank", "list", "notice", "prose", "table")
_NOTICE = re.compile(r"licen[sc]e|all rights reserved|copyright", re.I)


def read_vocabulary(spark: SparkSession, path: str) -> bytes:
    row = spark.read.format("binaryFile").load(path if "://" in path else f"file://{path}").select("length", "content").first()
    if row.length > MOST_BYTES:
        raise ValueError(f"{path} has {row.length} bytes; at most {MOST_BYTES} are sent to tasks")
    return bytes(row.content)


class Encoder:
    """Tokens of a text with the bytes that each covers."""

    def __init__(self, vocabulary: bytes):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines()) if a}
        self.encoding = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, k in ranks.items():
            self.lengths[k] = len(token)

    def ends(self, text: str) -> np.ndarray:
        """The byte after each token."""
        tokens, done = [], 0
        for blank in _LONG_BLANK.finditer(text):  # the pattern takes all of it but the last character, which goes with what follows
            start, end = blank.start(), blank.end() - (blank.end() < len(text))
            tokens += self.encoding.encode_ordinary(text[done:start]) + self.encoding._core_bpe.encode_single_piece(text[start:end].encode())
            done = end
        return np.cumsum(self.lengths[tokens + self.encoding.encode_ordinary(text[done:])])


def sections(text: str) -> tuple[np.ndarray, list[str]]:
    """Bytes and kind of each section; sections are lines with their line break."""
    lines = text.split("\n")
    kinds = []
    for x in lines:
        kinds.append("blank" if not x.strip() else "table" if " | " in x else "notice" if len(x) < 200 and _NOTICE.search(x) else "list" if x.lstrip()[:2] in ("- ", "* ") else "prose")
    size = np.fromiter((len(x.encode("utf-8", "surrogatepass")) for x in lines), np.int64, len(lines)) + 1
    size[-1] -= 1
    return size, kinds


def allot(token_ends: np.ndarray, section_ends: np.ndarray, rule: str = "start") -> tuple[np.ndarray, int]:
    """Tokens of each section, and how many tokens cross a boundary."""
    n = len(section_ends)
    if not len(token_ends):
        return np.zeros(n), 0
    starts = np.concatenate([[0], token_ends[:-1]])
    first = np.searchsorted(section_ends, starts, "right")
    last = np.searchsorted(section_ends, token_ends, "left")
    crossing = np.flatnonzero(last > first)
    if rule == "start":
        return np.bincount(first, minlength=n).astype(float), len(crossing)
    inside = np.ones(len(starts), bool)
    inside[crossing] = False
    out = np.bincount(first[inside], minlength=n).astype(float)
    for k in crossing:
        a, b = int(first[k]), int(last[k])
        cuts = np.concatenate([[starts[k]], section_ends[a:b], [token_ends[k]]])
        share = np.diff(cuts) / (token_ends[k] - starts[k])
        if rule == "most":
            out[a + int(share.argmax())] += 1
        else:
            out[a : b + 1] += share
    return out, len(crossing)


def count_tokens(docs: DataFrame, vocabulary: str | None = None, rule: str = "start", key: str = "doc_id", fields: tuple[str, ...] = ("text",)) -> DataFrame:
    """key, n_tokens, n_sections, n_crossing, sections (array of field, kind, n_bytes, tokens in order)."""
    if rule not in ("start", "most", "share"):
        raise ValueError(f"unknown rule {rule}")
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(read_vocabulary(spark, vocabulary or spark.conf.get(SETTING, VOCABULARY)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        encoder = Encoder(shared.value)
        for b in batches:
            out: dict[str, list] = {"n_tokens": [], "n_sections": [], "n_crossing": [], "sections": []}
            for row in range(b.num_rows):
                texts = [(f, t) for k, f in enumerate(fields, 1) if (t := b.column(k)[row].as_py()) is not None]
                ends = encoder.ends("\n".join(t for _, t in texts))
                sizes, names, kinds = [], [], []
                for n, (field, text) in enumerate(texts):
                    size, kind = sections(text) if len(texts) > 1 or text else (np.empty(0, np.int64), [])
                    if n + 1 < len(texts):
                        size[-1] += 1  # the break between fields
                    sizes += size.tolist()
                    kinds += kind
                    names += [field] * len(kind)
                counts, crossing = allot(ends, np.cumsum(sizes, dtype=np.int64), rule)
                out["n_tokens"].append(len(ends))
                out["n_sections"].append(len(sizes))
                out["n_crossing"].append(crossing)
                out["sections"].append([{"field": f, "kind": k, "n_bytes": n, "tokens": c} for f, k, n, c in zip(names, kinds, sizes, counts.tolist(), strict=True)])
            yield {"k": b.column(0)} | out

    rows = docs.select(docs[key].alias("k"), *[docs[f"`{f}`"].cast("string").alias(f"t{k}") for k, f in enumerate(fields)])
    more = "n_tokens long, n_sections long, n_crossing long, sections array<struct<field:string,kind:string,n_bytes:long,tokens:double>>"
    return map_arrow(rows, run, carried({"k": rows.schema["k"].dataType}, more)).withColumnRenamed("k", key)
