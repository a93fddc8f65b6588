"""Token counts by a longest-match automaton, without building the pieces."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import text as tx
from tidemark.llm.work import unused

#: The automaton is broadcast; a larger vocabulary is refused.
MAX_PIECES = 2_000_000
#: Word starts carry this mark in the vocabulary.
MARK = b" "


def read_ranks(path: str) -> list[bytes]:
    """Pieces of a vocabulary file of lines `base64 rank`."""
    with open(path, "rb") as f:
        return [base64.b64decode(line.split()[0]) for line in f if line.strip()]


@dataclass
class Automaton:
    """A trie of the pieces whose nodes know what to do when no child fits.

    fail[v] is the node reached, and popped[v] the number of pieces given out, when the longest
    pieces are taken off the front of the string of v as long as nothing longer can still match; fail -1:
    no piece fits, the word is unknown.  Children are kept as one sorted array of node * 256 + byte.
    """

    edges: np.ndarray
    targets: np.ndarray
    fail: np.ndarray
    popped: np.ndarray

    def children(self, nodes: np.ndarray, bytes_: np.ndarray) -> np.ndarray:
        keys = nodes.astype(np.int64) * 256 + bytes_
        at = np.minimum(np.searchsorted(self.edges, keys), len(self.edges) - 1)
        return np.where(self.edges[at] == keys, self.targets[at], -1)

    def lengths(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Pieces of each word; an unknown word is one.  All words advance together, byte by byte, so each byte costs a constant time."""
        n = len(starts)
        counts, node, alive = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int32), np.ones(n, dtype=bool)
        sizes = ends - starts
        order = np.argsort(-sizes, kind="stable")
        active = len(order)
        for step in range(int(sizes.max(initial=0))):
            while active and sizes[order[active - 1]] <= step:
                active -= 1
            now = order[:active]
            now = now[alive[now]]
            self._advance(now, data[starts[now] + step], node, counts, alive)
        # At a word's end the rest is popped until nothing is left.
        left = np.flatnonzero(alive & (node != 0))
        while len(left):
            counts[left] += self.popped[node[left]]
            node[left] = self.fail[node[left]]
            alive[left[node[left] < 0]] = False
            left = left[node[left] > 0]
        counts[~alive] = 1
        return counts

    def _advance(self, now: np.ndarray, bytes_: np.ndarray, node: np.ndarray, counts: np.ndarray, alive: np.ndarray) -> None:
        while len(now):
            child = self.children(node[now], bytes_)
            found = child >= 0
            node[now[found]] = child[found]
            now, bytes_ = now[~found], bytes_[~found]
            stuck = node[now] == 0
            alive[now[stuck]] = False
            now, bytes_ = now[~stuck], bytes_[~stuck]
            counts[now] += self.popped[node[now]]
            node[now] = self.fail[node[now]]
            lost = node[now] < 0
            alive[now[lost]] = False
            now, bytes_ = now[~lost], bytes_[~lost]


def build(pieces: list[bytes]) -> Automaton:
    """The automaton of a vocabulary, level by level: a node's failure follows from its parent's."""
    if len(pieces) > MAX_PIECES:
        raise ValueError(f"more than {MAX_PIECES} pieces")
    child: list[dict[int, int]] = [{}]
    ends = [False]
    for piece in pieces:
        v = 0
        for byte in piece:
            if byte not in child[v]:
                child[v][byte] = len(child)
                child.append({})
                ends.append(False)
            v = child[v][byte]
        ends[v] = bool(piece) or ends[v]
    fail, popped = [-1] * len(child), [0] * len(child)
    level = [0]
    while level:
        below = []
        for u in level:
            for byte, v in child[u].items():
                below.append(v)
                if ends[v]:
                    fail[v], popped[v] = 0, 1
                    continue
                at, count = fail[u], popped[u]
                while at >= 0 and byte not in child[at]:
                    count += popped[at]
                    at = fail[at]
                if at >= 0:
                    fail[v], popped[v] = child[at][byte], count
        level = below
    keys = np.array([u * 256 + byte for u, kids in enumerate(child) for byte in kids], dtype=np.int64)
    targets = np.array([v for kids in child for v in kids.values()], dtype=np.int32)
    order = np.argsort(keys)
    if not len(keys):
        keys, targets, order = np.array([-1]), np.array([-1]), np.array([0])
    return Automaton(keys[order], targets[order], np.array(fail, dtype=np.int32), np.array(popped, dtype=np.int32))


def token_counter(docs: DataFrame, pieces: list[bytes]) -> tuple:
    """Column functions: text to struct(n_words, n_tokens)."""
    shared = docs.sparkSession.sparkContext.broadcast(build(pieces))

    @F.arrow_udf("struct<n_words:bigint,n_tokens:bigint>")
    def count(texts: pa.Array) -> pa.Array:
        words, tokens = [], []
        for _, _, data, offsets in tx.blocks(texts):
            w = tx.split_words(data, offsets)
            distinct, first, at = np.unique(tx.word_hashes(w), return_index=True, return_inverse=True)
            starts, ends = w.starts[first], w.ends[first]
            marked, bounds = _marked(data, starts, ends)
            lengths = shared.value.lengths(marked, bounds[:-1], bounds[1:])
            total = np.concatenate([[0], np.cumsum(lengths[at])]) if len(distinct) else np.zeros(1, dtype=np.int64)
            words.append(w.counts())
            tokens.append(total[w.bounds[1:]] - total[w.bounds[:-1]])
        columns = [pa.array(np.concatenate(x) if x else [], pa.int64()) for x in (words, tokens)]
        return pa.StructArray.from_arrays(columns, names=["n_words", "n_tokens"])

    return count


def _marked(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words' bytes one after the other, each behind MARK, and their bounds."""
    sizes = ends - starts + len(MARK)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    at = np.arange(bounds[-1]) - np.repeat(bounds[:-1], sizes)
    out = data[np.maximum(np.repeat(starts, sizes) + at - len(MARK), 0)] if len(data) else np.zeros(0, np.uint8)
    out[bounds[:-1]] = MARK[0]
    return out, bounds


def with_token_counts(docs: DataFrame, pieces: list[bytes], text_col: str = "text") -> DataFrame:
    """docs with n_words and n_tokens (long; columns of those names are replaced).

    A word, with the mark of a word start before it, is cut greedily into the longest pieces of
    the vocabulary; n_tokens is their number over the whole text.  The automaton walks each distinct
    word of a block once and adds up precomputed counts, the pieces themselves are never made.  A word
    that can't be cut is one token.

    Defined cases: a null or wordless text has zero words and tokens; a word may be of any length, and a text
    without white space is one; an empty vocabulary gives one token a word, one of more than MAX_PIECES pieces is refused with a ValueError.  Rows that repeat
    an id are counted each by its own text.  All other columns, whatever their names, are returned as they are.  Empty in, empty out.
    """
    counts: Column = token_counter(docs, pieces)(F.col(text_col).cast("string"))
    names = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("n_words", "n_tokens")]
    (hidden,) = unused(docs.columns, "counts")
    return docs.withColumn(hidden, counts).select(*names, F.col(f"{hidden}.n_words"), F.col(f"{hidden}.n_tokens"))
