"""Byte-pair encoding of whole texts with a public tokenizer's ranks, by per-prefix dynamic programming.

For every prefix of a piece exactly one token can be the last one of its encoding. The candidates are the tokens that
end there (all matches of a suffix-linked automaton over the vocabulary); the right one is the only one whose
predecessor, the stored last token of the shorter prefix, may stand before it. Following the stored tokens backwards
gives the ids. Work is linear in the text times the longest token; only a pair of tokens that is met for the first time
is merged, by the definition of the encoding.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rank file of the vocabulary byte_bpe_50k (byte sequence in base 64, rank).
RANK_FILE = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the vocabulary's public description splits a text into pieces before encoding. Fixed value.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Encoded pieces and tested pairs of tokens that a Python worker remembers.
MEMORY, PAIRS = 200_000, 1_000_000


class PairEncoder:
    """Exact encoder for one rank file. Built once per Python worker."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PIECES):
        import ahocorasick
        import regex

        self.size = max(ranks.values()) + 1
        self.split = regex.compile(pattern).findall
        self.length = [0] * self.size
        automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.length[rank] = len(token)
            automaton.add_word(token.decode("latin-1"), rank)
        automaton.make_automaton()
        self.automaton = automaton
        self.ranks = ranks
        self.bytes = {rank: token for token, rank in ranks.items()}
        self.pairs: dict[int, bool] = {}
        self.memory: dict[str, list[int]] = {}

    def merged(self, raw: bytes) -> list[bytes]:
        """The encoding of a few bytes by its definition: the neighbours whose union has the lowest rank are merged, the
        first ones of equals, until no union of neighbours is a token."""
        parts = [raw[i : i + 1] for i in range(len(raw))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(x + y, self.size), i) for i, (x, y) in enumerate(zip(parts, parts[1:])))
            if rank == self.size:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, a: int, b: int) -> bool:
        """Whether ``b`` may directly follow ``a``: the two together are encoded as these two."""
        key = a * self.size + b
        known = self.pairs.get(key)
        if known is None:
            x, y = self.bytes[a], self.bytes[b]
            known = self.merged(x + y) == [x, y]
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            self.pairs[key] = known
        return known

    def piece(self, piece: str) -> list[int]:
        raw = piece.encode("utf-8", "surrogatepass")
        text = raw.decode("latin-1")
        n = len(raw)
        last = [-1] * n  # the last token of the encoding of raw[: i + 1]
        length = self.length
        for end, token in self.automaton.iter(text):
            if last[end] >= 0:
                continue
            start = end + 1 - length[token]
            if start == 0 or (last[start - 1] >= 0 and self.compatible(last[start - 1], token)):
                last[end] = token
        out, at = [], n - 1
        while at >= 0:
            token = last[at]
            out.append(token)
            at -= length[token]
        out.reverse()
        return out

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text without special tokens; null and '' give []."""
        if not text:
            return []
        memory, out = self.memory, []
        for p in self.split(text):
            ids = memory.get(p)
            if ids is None:
                ids = self.piece(p)
                if len(p) <= 64:
                    if len(memory) >= MEMORY:
                        memory.clear()
                    memory[p] = ids
            out += ids
        return out


def read_ranks(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (x.split() for x in raw.splitlines() if x.strip())}


_BUILT: dict[tuple[int, str], PairEncoder] = {}


def _encoder(raw: bytes, pattern: str) -> PairEncoder:
    key = (hash(raw), pattern)
    if key not in _BUILT:
        _BUILT[key] = PairEncoder(read_ranks(raw), pattern)
    return _BUILT[key]


def encoded(documents: DataFrame, rank_file: str = RANK_FILE, pattern: str = PIECES, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), count_only: bool = False) -> DataFrame:
    """(key, kept columns, ids ARRAY<INT>): the ids of every whole text; [] for null and empty texts.

    The rank file (a vocabulary of fixed size, under 2 MB) is read on the driver and broadcast. No shuffle. With
    ``count_only`` the column is ``tokens``, the number of ids. An empty table gives an empty result; other columns
    are left out, so their names cannot clash.
    """
    with open(rank_file, "rb") as f:
        raw = f.read()
    shared = documents.sparkSession.sparkContext.broadcast(raw)
    last = "tokens" if count_only else "ids"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = _encoder(shared.value, pattern)
        for pdf in batches:
            ids = [enc.encode(t if isinstance(t, str) else None) for t in pdf[text].tolist()]
            out = pdf[[key, *keep]].copy()
            out[last] = [len(x) for x in ids] if count_only else ids
            yield out

    fields = [f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in (key, *keep)]
    return documents.select(key, *keep, text).mapInPandas(run, ", ".join([*fields, "tokens bigint" if count_only else "ids array<int>"]))


def token_counts(documents: DataFrame, rank_file: str = RANK_FILE, pattern: str = PIECES, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, kept columns, tokens BIGINT): number of ids of every text; 0 for null and empty texts."""
    return encoded(documents, rank_file, pattern, key, text, keep, count_only=True)
