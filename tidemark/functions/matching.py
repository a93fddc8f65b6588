"""Many word sequences found in one pass over texts: a trie over word numbers, walked for all places of a batch at once."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


@dataclass(frozen=True)
class Trie:
    """Word sequences by their number in `terms`; a node's children are a sorted range of (node, word) keys.

    As no sequence is longer than a few words, every place of a text is followed down the trie by itself, a step for all
    places at once; places that leave the trie drop out, so a step costs what is still open.
    """

    terms: tuple[tuple[str, ...], ...]

    @cached_property
    def words(self) -> pa.Array:
        return pa.array(sorted({w for t in self.terms for w in t}), pa.string())

    @cached_property
    def _built(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Keys of the steps, the nodes that they lead to, and the terms that end at each node."""
        number = {w: k for k, w in enumerate(self.words.to_pylist())}
        children: dict[tuple[int, int], int] = {}
        ends: list[list[int]] = [[]]
        for k, term in enumerate(self.terms):
            node = 0
            for word in term:
                step = (node, number[word])
                if step not in children:
                    children[step] = len(ends)
                    ends.append([])
                node = children[step]
            if term:
                ends[node].append(k)
        order = sorted(children)
        keys, nodes = [n * len(number) + w for n, w in order], [children[s] for s in order]
        bounds = np.cumsum([0, *map(len, ends)])
        return *(np.array(x, dtype=np.int64) for x in (keys, nodes)), bounds, np.array([t for e in ends for t in e], dtype=np.int64)

    def hits(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, word, term) of every place of every term in texts of words with single spaces, by text, then term, then place."""
        none = np.zeros(0, dtype=np.int64)
        keys, nodes, ends, of_node = self._built
        lists = pc.split_pattern(pc.utf8_trim_whitespace(pc.fill_null(texts, "")), " ")
        flat = lists.flatten()
        if not len(keys) or not len(flat):
            return none, none, none
        word = pc.fill_null(pc.index_in(flat, value_set=self.words), -1).to_numpy().astype(np.int64)
        bounds = lists.offsets.to_numpy().astype(np.int64)
        bounds = bounds - bounds[0]
        text_of = np.repeat(np.arange(len(lists)), np.diff(bounds))
        past = bounds[1:][text_of]
        start = np.flatnonzero(word >= 0)
        node, depth = np.zeros(len(start), dtype=np.int64), 0
        found: list[tuple[np.ndarray, ...]] = []
        while len(start):
            at = start + depth
            inside = at < past[start]
            start, node, at = start[inside], node[inside], at[inside]
            step = node * len(self.words) + word[at]
            slot = np.minimum(np.searchsorted(keys, step), len(keys) - 1)
            known = (keys[slot] == step) & (word[at] >= 0)
            start, node, depth = start[known], nodes[slot[known]], depth + 1
            many = ends[1:][node] - ends[:-1][node]
            here = np.repeat(start, many)
            which = np.arange(len(here)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(ends[:-1][node], many)
            found.append((text_of[here], here - bounds[text_of[here]], of_node[which]))
        if not found:
            return none, none, none
        text, place, term = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((place, term, text))
        return text[order], place[order], term[order]

    @cached_property
    def lengths(self) -> np.ndarray:
        return np.array([len(t) for t in self.terms], dtype=np.int64)

    def counted(self, texts: pa.Array, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, term, n) of terms found, n up to `most`: of the places from left to right each that shares neither a word nor a space with the one before."""
        text, place, term = self.hits(texts)
        if not len(text):
            return text, term, text
        new = np.append(True, (text[1:] != text[:-1]) | (term[1:] != term[:-1]))
        group = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        size = int(place.max()) + int(self.lengths.max()) + 2
        line = group * size + place
        last = np.append(first[1:], len(group))
        count, at = np.zeros(len(first), dtype=np.int64), first.copy()
        open_ = np.arange(len(first))
        for _ in range(most):
            count[open_] += 1
            nxt = np.searchsorted(line, line[at[open_]] + self.lengths[term[first[open_]]] + 1)
            go = nxt < last[open_]
            at[open_[go]] = nxt[go]
            open_ = open_[go]
            if not len(open_):
                break
        return text[first], term[first], count


def sums_by_text(n: int, text: np.ndarray, worth: np.ndarray) -> np.ndarray:
    """worth added up by text, in the order given."""
    return np.bincount(text, weights=worth, minlength=n) if len(text) else np.zeros(n)


def names_by_text(n: int, text: np.ndarray, term: np.ndarray, names: Sequence[str]) -> pa.Array:
    """The names of each text's terms as lists; text ascends."""
    bounds = np.searchsorted(text, np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(bounds), pa.array(names, pa.string()).take(pa.array(term, pa.int64())))


def in_blocks(titles: pa.Array, bodies: pa.Array, limit: int, work: Callable[[pa.Array, pa.Array], pa.Array]) -> pa.Array:
    """work over runs of rows whose bodies have about `limit` bytes, put together."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(bodies), 0).to_numpy())
    out, first, n = [], 0, len(bodies)
    while first < n:
        before = int(sizes[first - 1]) if first else 0
        past = max(first + 1, int(np.searchsorted(sizes, before + limit, side="right")))
        out.append(work(titles.slice(first, past - first), bodies.slice(first, past - first)))
        first = past
    return pa.concat_arrays(out) if out else work(titles, bodies)
