"""Token counts by rank-synchronous merging of ragged arrays.

Texts are cut into pre-tokens as the vocabulary's library does. The distinct ones
that are not known yet are held together as one flat array of symbols; each round
applies, in every pre-token at once, that pre-token's lowest-ranked pair, until no
pair has a rank. The surviving symbols are the tokens.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from logloom.llm.base import schema, small_batches

#: Fixed value: the pattern of byte-level pre-tokens.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LIMIT = 1024
#: Counts that a worker remembers; beyond it forgets them and goes on.
REMEMBERED = 300_000
_SHIFT = np.int64(20)


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in shown}
    hidden = [b for b in range(256) if b not in out]
    return out | {b: chr(256 + i) for i, b in enumerate(hidden)}


@dataclass
class Merges:
    """Pairs as sorted keys, their ranks and what they become; the symbols of single bytes; special strings."""

    keys: np.ndarray
    ranks: np.ndarray
    became: np.ndarray
    bytes_: np.ndarray
    specials: list[str]

    @classmethod
    def load(cls, path: str) -> Merges:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or (spec["pre_tokenizer"] or {}).get("type") != "ByteLevel" or spec["normalizer"]:
            raise ValueError("a byte-level BPE vocabulary without normalisation is needed")
        ids = model["vocab"]
        pairs = [tuple(x) if isinstance(x, list) else tuple(x.split(" ")) for x in model["merges"]]
        keys = np.array([(ids[a] << 20) | ids[b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        became = np.array([ids[a + b] for a, b in pairs], np.int64)
        letters = byte_letters()
        return cls(keys[order], order.astype(np.int64), became[order], np.array([ids[letters[b]] for b in range(256)], np.int64), [x["content"] for x in spec["added_tokens"]])

    def counts(self, pieces: list[bytes]) -> np.ndarray:
        """Tokens of each piece."""
        sizes = np.array([len(p) for p in pieces], np.int64)
        out = sizes.copy()
        symbol = self.bytes_[np.frombuffer(b"".join(pieces), np.uint8)]
        owner = np.repeat(np.arange(len(pieces)), sizes)
        none = np.int64(len(self.keys))
        while len(symbol) > 1:
            key = (symbol[:-1] << _SHIFT) | symbol[1:]
            at = np.minimum(np.searchsorted(self.keys, key), none - 1)
            rank = np.where((self.keys[at] == key) & (owner[1:] == owner[:-1]), self.ranks[at], none)
            rank = np.append(rank, none)
            first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            lowest = np.minimum.reduceat(rank, first)
            length = np.diff(np.append(first, len(owner)))
            out[owner[first]] = length
            wanted = np.repeat(lowest, length)
            hit = (rank == wanted) & (rank < none)
            if not hit.any():
                break
            # in a run such as aaaa the pairs overlap: every other one from the run's start merges
            place = np.flatnonzero(hit)
            new_run = np.append(True, np.diff(place) > 1)
            run = np.flatnonzero(new_run)
            in_run = np.arange(len(place)) - np.repeat(run, np.diff(np.append(run, len(place))))
            place = place[in_run % 2 == 0]
            symbol = symbol.copy()
            symbol[place] = self.became[at[place]]
            stay = wanted < none  # finished pieces leave the array
            stay[place + 1] = False
            symbol, owner = symbol[stay], owner[stay]
        return out


class Counter:
    """Counts texts, remembering the pre-tokens that it has merged."""

    def __init__(self, merges: Merges):
        self.merges, self.known = merges, {}
        self.find = regex.compile(PATTERN).findall
        self.special = regex.compile("|".join(map(regex.escape, sorted(merges.specials, key=len, reverse=True)))) if merges.specials else None

    def pieces(self, text: str) -> tuple[list[str], int]:
        """Pre-tokens outside special strings, and the number of those."""
        if self.special is None or not any(s in text for s in self.merges.specials):
            return self.find(text), 0
        parts = self.special.split(text)
        return [x for part in parts for x in self.find(part)], len(parts) - 1

    def counts(self, texts: list[str | None]) -> list[int]:
        cut = [self.pieces(t or "") for t in texts]
        if len(self.known) > REMEMBERED:
            self.known = {}
        known = self.known
        unseen = list(set().union(*(p for p, _ in cut)) - known.keys())
        for i in range(0, len(unseen), 20_000):
            some = unseen[i : i + 20_000]
            known.update(zip(some, self.merges.counts([s.encode() for s in some]).tolist(), strict=True))
        return [sum(map(known.__getitem__, p)) + n for p, n in cut]


_COUNTERS: dict = {}


def count(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row of ``(doc_id, text)``.

    ``path`` names the vocabulary's JSON file, read once on the driver and sent
    to the workers (its size is that of the vocabulary). A null text is an empty
    one. Special strings in texts are single tokens, as the library has it by
    default; none are added. Other columns are ignored, repeated rows repeated, an
    empty table stays empty. Of a very long text the pre-tokens are held beside it.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(Merges.load(path))
    name = uuid.uuid4().hex

    def run(batches):
        if name not in _COUNTERS:  # a worker serves many tasks
            _COUNTERS.clear()
            _COUNTERS[name] = Counter(shared.value)
        counter = _COUNTERS[name]
        for batch in batches:
            texts, sizes, n = batch.column(1), [], []
            for i in range(0, batch.num_rows, 64):
                some = texts.slice(i, 64).to_pylist()
                n += counter.counts(some)
                sizes += [len((t or "").encode()) for t in some]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, schema(docs, "doc_id", n_bytes="bigint", n_tokens="bigint", over_limit="boolean"))
