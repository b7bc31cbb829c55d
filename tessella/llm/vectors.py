"""Token vectors from random walks over a record-attribute-token graph, record vectors, and hyperplane hashing.

A walk goes from a record over one of its attributes (title, authors) to a token and on to another record that holds
the token; the tokens it meets form a sentence, and skip-gram with negative sampling is trained on the sentences.
Every record is walked from and every token counted. Records are trained on shard by shard, all shards from the same
starting vectors, and a token's vector is the mean of its shards' vectors by the records that hold it there. The sums
are whole numbers, so neither the order of the rows nor the number of tasks changes the model. A token of a single
record leads nowhere and has the vector of its spelling alone, as misspelt ones have: character n-grams, whose vectors
every token has.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import xxhash

TRAINED, SPELT = 16, 48
DIMS = TRAINED + SPELT
NGRAM_ROWS = 1 << 13


def keys_of(tokens: list[str]) -> np.ndarray:
    """The 64-bit hashes that tokens are known by."""
    return np.fromiter(map(xxhash.xxh64_intdigest, tokens), dtype=np.uint64, count=len(tokens)).view(np.int64)


def walks(tokens: np.ndarray, sizes: np.ndarray, n_walks: int, length: int, rng: np.random.Generator) -> np.ndarray:
    """Sentences of token numbers, (n_walks, length); the walks start at the records in turn, so that each is walked from.

    ``sizes`` (records, attributes) says how many of ``tokens`` are each attribute's, record by record; none is empty.
    """
    n, n_attributes = sizes.shape
    start = (np.cumsum(sizes.ravel()) - sizes.ravel()).reshape(sizes.shape)
    filled, n_filled = np.argsort(sizes == 0, axis=1, kind="stable"), (sizes > 0).sum(1)
    holder = np.repeat(np.arange(n), sizes.sum(1))[np.argsort(tokens, kind="stable")]
    held = np.bincount(tokens)
    first = np.cumsum(held) - held
    at, out = np.arange(n_walks) % n, np.empty((n_walks, length), dtype=np.int64)
    for step in range(length):
        draw = rng.random((3, n_walks))
        attribute = filled[at, (draw[0] * n_filled[at]).astype(np.int64)]
        out[:, step] = t = tokens[start[at, attribute] + (draw[1] * sizes[at, attribute]).astype(np.int64)]
        at = holder[first[t] + (draw[2] * held[t]).astype(np.int64)]
    return out


def _descend(table: np.ndarray, rows: np.ndarray, gradient: np.ndarray, rate: float) -> None:
    """One step of the rows of a table; rows met more than 8 times move by eight times their mean."""
    n, dims = table.shape
    total = np.bincount((rows[:, None] * dims + np.arange(dims)).ravel(), weights=gradient.ravel(), minlength=n * dims).reshape(n, dims)
    count = np.bincount(rows, minlength=n)
    table -= total * (rate * np.minimum(count, 8) / np.maximum(count, 1))[:, None]


def skip_gram(sentences: np.ndarray, vectors: np.ndarray, rng: np.random.Generator, window: int = 2, negatives: int = 3, epochs: int = 1, rate: float = 0.1, batch: int = 4096, group: int = 64, pool: int = 16) -> np.ndarray:
    """Input vectors of skip-gram with negative sampling, trained by mini-batches from the given ones on.

    ``group`` pairs share a pool of negatives, each of which weighs ``negatives / pool``.
    """
    vectors, context = vectors.astype(np.float32), np.zeros_like(vectors, dtype=np.float32)
    pairs = np.concatenate([np.stack((a.ravel(), b.ravel()), 1) for d in range(1, window + 1) for a, b in ((sentences[:, :-d], sentences[:, d:]), (sentences[:, d:], sentences[:, :-d]))])
    counts = np.bincount(sentences.ravel(), minlength=len(vectors)).astype(np.float64) ** 0.75
    cumulated = np.cumsum(counts / counts.sum())
    share = np.float32(negatives / pool)
    for _ in range(epochs):
        order = rng.permutation(len(pairs))
        for at in range(0, len(order), batch):
            centre, near = pairs[order[at : at + batch]].T
            n = len(centre)
            groups = -(-n // group)
            others = np.minimum(np.searchsorted(cumulated, rng.random((groups, pool))), len(vectors) - 1)
            v, c, o = vectors[centre], context[near], context[others]
            filled = np.concatenate((v, np.zeros((groups * group - n, v.shape[1]), dtype=np.float32))).reshape(groups, group, -1)
            good = (1 / (1 + np.exp(-np.clip((v * c).sum(1), -8, 8))) - 1)[:, None]
            bad = share / (1 + np.exp(-np.clip(filled @ o.transpose(0, 2, 1), -8, 8)))
            change = good * c + (bad @ o).reshape(-1, v.shape[1])[:n]
            away = (bad.transpose(0, 2, 1) @ filled).reshape(-1, v.shape[1])
            _descend(vectors, centre, change, rate)
            _descend(context, np.concatenate((near, others.ravel())), np.concatenate((good * v, away)), rate)
    return vectors


def train_shard(records: list[list[list[str]]], shard: int, seed: int, least_walks: int = 8000, length: int = 8) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, number of records with each, trained vectors) of the tokens of one shard of records, all walked from."""
    sizes = np.array([[len(attribute) for attribute in record] for record in records], dtype=np.int64)
    live = sizes.sum(1) > 0
    flat = [t for record in records for attribute in record for t in attribute]
    tokens, distinct = pd.factorize(np.array(flat, dtype=object))
    keys = keys_of(distinct.tolist())
    if not len(keys):
        return keys, np.zeros(0, dtype=np.int64), np.zeros((0, TRAINED), dtype=np.float32)
    of = np.repeat(np.arange(len(records)), sizes.sum(1))
    both = np.sort(of * len(keys) + tokens)
    held = np.bincount(both[np.flatnonzero(np.diff(both, prepend=-1))] % len(keys), minlength=len(keys))
    rng = np.random.default_rng([seed, shard])
    sentences = walks(tokens, sizes[live], max(least_walks, int(live.sum())), length, rng)
    first = np.random.default_rng(seed).random((NGRAM_ROWS, TRAINED), dtype=np.float32) - np.float32(0.5)
    return keys, held, skip_gram(sentences, first[keys % NGRAM_ROWS], rng)


MET: dict[str, tuple[dict[str, int], np.ndarray]] = {}  # of the model last used in this process: token -> row, and the rows


@dataclass
class Model:
    """Everything a worker needs to turn token lists into record vectors and hashes, 44 bytes for each token that two
    records hold: ``keys`` in order, their trained vectors (rows of length 0.4) and their weights.
    """

    keys: np.ndarray
    trained: np.ndarray
    weight: np.ndarray
    default_weight: float
    seed: int = 17
    name: str = field(default_factory=lambda: uuid.uuid4().hex)

    def __post_init__(self) -> None:
        rng = np.random.default_rng(self.seed)
        self.ngrams = rng.standard_normal((NGRAM_ROWS, SPELT)).astype(np.float32)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "ngrams"}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.__post_init__()

    def token_rows(self, tokens: list[str]) -> np.ndarray:
        """The weighted vectors of distinct tokens: their trained parts and their spelling."""
        grams = [{t[i : i + n] for n in (2, 3) for i in range(len(t) - n + 1)} for t in (f"<{t}>" for t in tokens)]
        sizes = np.fromiter(map(len, grams), dtype=np.int64, count=len(grams))
        digest = xxhash.xxh32_intdigest
        spelt = np.add.reduceat(self.ngrams[np.fromiter((digest(g) % NGRAM_ROWS for each in grams for g in each), dtype=np.int64, count=int(sizes.sum()))], np.cumsum(sizes) - sizes)
        spelt /= np.linalg.norm(spelt, axis=1, keepdims=True) + 1e-9
        trained = np.zeros((len(tokens), TRAINED), dtype=np.float32)
        weight = np.full(len(tokens), self.default_weight, dtype=np.float32)
        if len(self.keys):
            key = keys_of(tokens)
            row = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            known = self.keys[row] == key
            trained[known], weight[known] = self.trained[row[known]], self.weight[row[known]]
        return np.concatenate((trained, spelt), 1).astype(np.float32) * weight[:, None]

    def vectors(self, lists: list[list[str]]) -> np.ndarray:
        """Unit vectors of token lists (zero for an empty list); tokens met before are looked up."""
        out = np.zeros((len(lists), DIMS), dtype=np.float32)
        flat = [t for tokens in lists for t in tokens]
        if flat:
            met, matrix = MET.get(self.name, ({}, None))
            if len(met) > 200_000:
                met, matrix = {}, None
            if new := list(set(flat).difference(met)):
                met.update(zip(new, range(len(met), len(met) + len(new))))
                matrix = self.token_rows(new) if matrix is None else np.concatenate((matrix, self.token_rows(new)))
                MET.clear()
                MET[self.name] = met, matrix
            rows = np.fromiter(map(met.__getitem__, flat), dtype=np.int64, count=len(flat))
            sizes = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
            full = np.flatnonzero(sizes)
            out[full] = np.add.reduceat(matrix[rows], (np.cumsum(sizes) - sizes)[full])
            out /= np.linalg.norm(out, axis=1, keepdims=True) + 1e-9
        return out


@dataclass
class Hyperplanes:
    """Bucket keys of several tables with probes at the least certain bits, and a 128-bit sketch."""

    tables: int
    bits: int
    flips: int = 3
    seed: int = 23

    def __post_init__(self) -> None:
        rng = np.random.default_rng(self.seed)
        self.planes = rng.standard_normal((DIMS, self.tables * self.bits)).astype(np.float32)
        self.sketch_planes = rng.standard_normal((DIMS, 128)).astype(np.float32)

    def sketch(self, v: np.ndarray) -> np.ndarray:
        """(n, 2) 64-bit integers."""
        return np.packbits(v @ self.sketch_planes > 0, axis=1).view(np.int64)

    def keys(self, v: np.ndarray) -> np.ndarray:
        """(n, tables) bucket numbers, the table's number in the upper part."""
        signs = (v @ self.planes > 0).reshape(len(v), self.tables, self.bits)
        return signs @ (1 << np.arange(self.bits, dtype=np.int64)) + (np.arange(self.tables, dtype=np.int64) << 40)

    def probes(self, v: np.ndarray) -> np.ndarray:
        """(n, tables * 2**flips) bucket numbers: the record's own and those beyond its nearest planes."""
        margin = (v @ self.planes).reshape(len(v), self.tables, self.bits)
        own = (margin > 0) @ (1 << np.arange(self.bits, dtype=np.int64))
        near = np.int64(1) << np.argpartition(np.abs(margin), min(self.flips, self.bits - 1), axis=2)[:, :, : self.flips].astype(np.int64)
        masks = np.array([[(m >> f) & 1 for f in range(self.flips)] for m in range(1 << self.flips)], dtype=np.int64)
        flipped = own[:, :, None] ^ (near @ masks.T)
        return (flipped + (np.arange(self.tables, dtype=np.int64) << 40)[None, :, None]).reshape(len(v), -1)
