"""Exact byte-level BPE token counts at every prefix, by dynamic programming.

`PrefixCounter` reads a public tokenizer's file and fills, for each piece that the splitting pattern yields, a
table of the token count of each of its prefixes. Byte-pair merging has one last token for every prefix: the
longest candidate t whose remainder r is itself encoded with a last token that t may follow unchanged. So
count[i] = count[i - len(t)] + 1, found left to right, and no prefix is encoded again. A text's prefix counts
are its pieces' tables added to the running sum, from which truncation and budget questions are looked up.

Where a cut changes how the text is split, the tables hold what the library would give for the cut text: inside
a run of white space the run so far is one piece, inside a contraction the mark and the letters are two, and
inside a special token its characters are ordinary text.

Rows: tasks read whole texts; each row depends on its own text alone, so no shuffle is needed. The table of
pieces is bounded by `memo` entries for each worker; a full one is emptied.

Edges: null and empty texts have 0 tokens and one prefix, the empty one; texts of any length are read whole;
repeated rows give repeated results; empty tables give no rows; further columns are ignored.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from tokenizers import pre_tokenizers
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.llm import _common as C

#: Fixed value: how byte-level BPE splits text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@dataclass(frozen=True)
class Parameters:
    limit: int = 1024
    memo: int = 400_000  # pieces remembered in a worker
    memo_piece: int = 64  # characters of the longest piece that is remembered


#: An unassigned code point: to the pattern neither a letter, nor a number, nor white space.
OTHER = "\u0378"


@lru_cache(maxsize=1)
def newer_characters() -> dict[str, str]:
    """Letters and numbers that the splitting here knows and the installed tokenizer library doesn't yet."""
    library = pre_tokenizers.ByteLevel(add_prefix_space=False)
    everything = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    recent = [m for m in regex.finditer(r"(\p{L})|\p{N}", everything) if unicodedata.category(m[0]) == "Cn"]
    return {m[0]: OTHER for m in recent if len(library.pre_tokenize_str(("a" if m[1] else "1") + m[0])) > 1}


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def read_file(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


class PrefixCounter:
    """Token counts of all prefixes of texts under one tokenizer file."""

    def __init__(self, path: str, p: Parameters = Parameters(), data: bytes | None = None):
        spec = json.loads(read_file(path) if data is None else data)
        kind, model = spec["pre_tokenizer"] or {}, spec["model"]
        if model["type"] != "BPE" or kind.get("type") != "ByteLevel" or kind.get("add_prefix_space") or not kind.get("use_regex", True) or spec.get("normalizer"):
            raise ValueError("only plain byte-level BPE files are supported")
        letters = byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        self.special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        tokens = [raw(s) for s, i in model["vocab"].items() if s not in self.special]
        self.ids = {t: i for i, t in enumerate(tokens)}
        self.bytes = tokens
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}  # merged token -> left, right
        self.made = [-1] * len(tokens)  # the rank of the merge that makes a token; -1 for bytes
        for r, (a, b) in enumerate(pairs):
            left, right = self.ids[raw(a)], self.ids[raw(b)]
            merged = self.ids[raw(a) + raw(b)]
            self.rank[left, right] = r
            if merged not in self.parts:
                self.parts[merged], self.made[merged] = (left, right), r
        self.longest = max(map(len, tokens))
        self.split = regex.compile(PATTERN)
        self.split_ascii = re.compile(PATTERN.replace(r"\s\p{L}\p{N}", r"\sA-Za-z0-9").replace(r"\p{L}", "[A-Za-z]").replace(r"\p{N}", "[0-9]"), re.ASCII).findall
        self.lead = regex.compile(r"\s*")
        self.newer = newer_characters()
        self.newer_set = frozenset(self.newer)
        self.newer_map = str.maketrans(self.newer)
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.p = p
        self.fits: dict[tuple[int, int], bool] = {}
        self.standing: dict[int, bool] = {}
        self.totals: dict[str, int] = {}
        self.tables: dict[str, np.ndarray] = {}

    def follows(self, a: int, b: int) -> bool:
        """Whether the bytes of a then b are encoded as just those two tokens: undo the latest merge of either
        until bytes meet; no pair that meets on the way may merge before the merge that was undone."""
        key = a, b
        found = self.fits.get(key)
        if found is None:
            limit, found = 1 << 60, True
            while True:
                across = self.rank.get((a, b))
                if across is not None and across < limit:
                    found = False
                    break
                if self.made[a] > self.made[b]:
                    limit, a = self.made[a], self.parts[a][1]
                elif self.made[b] >= 0:
                    limit, b = self.made[b] + 1, self.parts[b][0]
                else:
                    break
            if len(self.fits) > 4 * self.p.memo:
                self.fits.clear()
            self.fits[key] = found
        return found

    def _merge(self, data: bytes) -> list[int]:
        """Byte-pair merging as it is defined: the lowest-ranked pair first, leftmost of equals."""
        out = [self.ids[data[i : i + 1]] for i in range(len(data))]
        while len(out) > 1:
            best = min(range(len(out) - 1), key=lambda i: self.rank.get((out[i], out[i + 1]), 1 << 60))
            pair = out[best], out[best + 1]
            if pair not in self.rank:
                break
            merged = self.ids[self.bytes[pair[0]] + self.bytes[pair[1]]]
            out[best : best + 2] = [merged]
        return out

    def byte_prefixes(self, piece: bytes) -> np.ndarray:
        """Token counts of piece[:0], piece[:1], .. piece: count and last token of each prefix from shorter ones."""
        n = len(piece)
        count, last = [0] * (n + 1), [-1] * (n + 1)
        ids, follows, stands = self.ids, self.follows, self.stands
        for end in range(1, n + 1):
            for start in range(end - 1, max(-1, end - self.longest - 1), -1):
                token = ids.get(piece[start:end])
                # one candidate fits, since an encoding is unique
                if token is not None and stands(token) and (not start or follows(last[start], token)):
                    count[end], last[end] = count[start] + 1, token
                    break
        return np.array(count, np.int32)

    def stands(self, token: int) -> bool:
        """Whether the encoding of a token's own bytes is that token."""
        found = self.standing.get(token)
        if found is None:
            found = self.standing[token] = self._merge(self.bytes[token]) == [token]
        return found

    def _remember(self, memo: dict, piece: str, value):
        if len(piece) <= self.p.memo_piece:
            if len(memo) >= self.p.memo:
                memo.clear()
            memo[piece] = value
        return value

    def _total(self, piece: str) -> int:
        found = self.totals.get(piece)
        return found if found is not None else self._remember(self.totals, piece, int(self.byte_prefixes(piece.encode())[-1]))

    def _table(self, piece: str) -> np.ndarray:
        """Counts of piece[:1], piece[:2], .. piece as texts of their own, in characters."""
        found = self.tables.get(piece)
        if found is not None:
            return found
        if piece in ("'re", "'ve", "'ll"):  # a contraction: cut after its first letter, that letter is a word
            table = np.array([self._total("'"), self._total("'") + self._total(piece[1]), self._total(piece)], np.int32)
        else:
            data = piece.encode()
            ends = np.flatnonzero((np.frombuffer(data + b"a", np.uint8)[1:] & 0xC0) != 0x80) + 1
            table = self.byte_prefixes(data)[ends]
        return self._remember(self.tables, piece, table)

    def pieces(self, segment: str) -> list[str]:
        if segment.isascii():
            return self.split_ascii(segment)
        if self.newer_set.isdisjoint(segment):
            return self.split.findall(segment)
        return [segment[m.start() : m.end()] for m in self.split.finditer(segment.translate(self.newer_map))]

    def counts(self, pieces: list[str]) -> list[int]:
        """The last entry of each piece's table."""
        own = list(map(self.totals.get, pieces))
        return [self._total(x) if n is None else n for n, x in zip(own, pieces, strict=True)] if None in own else own

    def segments(self, text: str) -> list[str]:
        """Ordinary text and special tokens in turn."""
        return self.at_special.split(text) if self.at_special else [text]

    def boundaries(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """End (in characters) of each piece, and the token count of the text up to there when it goes on as it does."""
        ends, counts, at, so_far = [], [], 0, 0
        for i, segment in enumerate(self.segments(text)):
            if i % 2:
                pieces, own = [segment], [1]
            else:
                pieces = self.pieces(segment)
                own = self.counts(pieces)
            if pieces:
                ends.append(at + np.cumsum([len(x) for x in pieces]))
                counts.append(so_far + np.cumsum(own))
                at, so_far = int(ends[-1][-1]), int(counts[-1][-1])
        return (np.concatenate(ends), np.concatenate(counts)) if ends else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def total(self, text: str) -> int:
        """The last of the running sums that boundaries() gives."""
        return sum(1 if i % 2 else sum(self.counts(self.pieces(s))) for i, s in enumerate(self.segments(text)))

    def prefixes(self, text: str) -> np.ndarray:
        """out[i] is the token count of text[:i], for every i from 0 to len(text)."""
        out = [np.zeros(1, np.int32)]
        so_far = 0
        parts = self.segments(text)
        for i in range(0, len(parts), 2):
            special = parts[i + 1] if i + 1 < len(parts) else ""
            cut = self._segment(parts[i] + special[:-1]) + so_far
            out.append(cut)
            so_far += int(self._segment(parts[i])[-1]) if parts[i] else 0
            if special:
                so_far += 1
                out.append(np.array([so_far], np.int32))
        return np.concatenate(out)

    def _segment(self, text: str) -> np.ndarray:
        """Counts of text[:1] .. text, without special tokens."""
        out, so_far, run, before_run = [], 0, "", 0
        pieces = self.pieces(text)
        for i, piece in enumerate(pieces):
            lead = self.lead.match(piece).end()
            if not lead:
                run = ""
                out.append(self._table(piece) + so_far)
            else:
                # cut anywhere in a run of white space, the run so far is one piece
                if not run:
                    before_run = so_far
                for c in piece[:lead]:
                    run += c
                    out.append(np.array([before_run + self._total(run)], np.int32))
                if lead < len(piece):
                    out.append(self._table(piece)[lead:] + so_far)
                    run = ""
            so_far += self._total(piece)
        return np.concatenate(out) if out else np.zeros(0, np.int32)

    def truncate(self, text: str, most: int) -> str:
        """The longest prefix of at most `most` tokens."""
        fits = np.flatnonzero(self.prefixes(text) <= most)
        return text[: int(fits[-1])] if len(fits) else ""


_COUNTERS: dict[tuple[str, Parameters], PrefixCounter] = {}


def counter_of(path: str, p: Parameters, shared: Broadcast) -> PrefixCounter:
    """One counter for each worker process, which its tasks share, from the file's bytes, which the driver read."""
    if (path, p) not in _COUNTERS:
        _COUNTERS[path, p] = PrefixCounter(path, p, shared.value)
    return _COUNTERS[path, p]


def with_prefix_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", p: Parameters = Parameters()) -> DataFrame:
    """(id, piece_ends array<int>, piece_tokens array<int>): where each piece ends, in characters, and the token count up to there."""
    rows = docs.select(F.col(id_col), F.col(text_col).alias("text"))
    schema = T.StructType([rows.schema[id_col], T.StructField("piece_ends", T.ArrayType(T.IntegerType())), T.StructField("piece_tokens", T.ArrayType(T.IntegerType()))])

    shared = docs.sparkSession.sparkContext.broadcast(read_file(path))  # a vocabulary file, some MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(path, p, shared)
        for batch in C.sliced(batches, "text"):
            found = [counter.boundaries(t or "") for t in batch.column(1).to_pylist()]
            lists = [pa.array([x[k].astype(np.int32) for x in found], pa.list_(pa.int32())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *lists], names=[id_col, "piece_ends", "piece_tokens"])

    return rows.mapInArrow(run, schema)


def within_budget(counts: DataFrame, most: int, id_col: str = "doc_id") -> DataFrame:
    """(id, n_chars, n_tokens): of each text, the longest run of whole pieces from its start of at most `most` tokens.

    Looked up in what with_prefix_counts() gave, stored or not; no text is read or encoded again. Of a text cut there, the
    library's count is n_tokens unless the next piece is white space that the last one would have taken in."""
    pairs = F.arrays_zip(F.col("piece_ends").alias("n_chars"), F.col("piece_tokens").alias("n_tokens"))
    fits = F.filter(pairs, lambda x: x["n_tokens"] <= most)
    last = F.coalesce(F.try_element_at(fits, F.lit(-1)), F.struct(F.lit(0).alias("n_chars"), F.lit(0).alias("n_tokens")))
    return counts.select(id_col, last.alias("last")).select(id_col, "last.n_chars", "last.n_tokens")


def truncated(docs: DataFrame, path: str, most: int, id_col: str = "doc_id", text_col: str = "text", p: Parameters = Parameters()) -> DataFrame:
    """(id, text): each text's longest prefix of at most `most` tokens."""
    rows = docs.select(F.col(id_col), F.col(text_col).alias("text"))

    shared = docs.sparkSession.sparkContext.broadcast(read_file(path))  # a vocabulary file, some MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.sliced(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([counter_of(path, p, shared).truncate(t or "", most) for t in batch.column(1).to_pylist()], pa.string())], names=[id_col, "text"])

    return rows.mapInArrow(run, T.StructType([rows.schema[id_col], T.StructField("text", T.StringType())]))


def token_counts(docs: DataFrame, path: str, p: Parameters = Parameters()) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit): the last prefix count of every whole text."""
    rows = docs.select("doc_id", "text")
    schema = T.StructType([rows.schema["doc_id"], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])

    shared = docs.sparkSession.sparkContext.broadcast(read_file(path))  # a vocabulary file, some MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(path, p, shared)
        for batch in C.sliced(batches, "text"):
            n_bytes = np.diff(C.utf8_view(batch.column(1))[1])
            n_tokens = np.array([counter.total(t or "") for t in batch.column(1).to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens), pa.array(n_tokens > p.limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return rows.mapInArrow(run, schema)
