"""A word-pair model with modified Kneser-Ney discounts in sorted hash arrays, dealt by context: what it counts grows with the corpus.

Nothing of it is broadcast.  Tasks send their texts' pairs as packed arrays to the shard of the pair's context; there the
arrays of all texts are added up to the shard's part of the model and the same pairs are scored against it.  Shards are
worked off in PASSES, so that only the pairs of one pass lie on disk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import text as tx
from tidemark.llm.work import whole_groups, written

#: Words that a task packs together, and documents: a place within a block has 16 bits.
BLOCK_WORDS, BLOCK_DOCS = 500_000, 1 << 16
#: Words for which there is a shard; the number of shards is a power of two.
SHARD_WORDS = 500_000
PASSES = 2
#: A pair that the model doesn't know is one of so many words.
WORDS = float(1 << 20)
#: Bits of a context within its shard and of a word within its context.
CONTEXT_BITS, WORD_BITS = 40, 32


def _planes(x: np.ndarray, width: int) -> bytes:
    """The lowest `width` bytes of each number, byte by byte: zeros stand together and compress."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _numbers(data: memoryview, at: int, count: int, width: int) -> tuple[np.ndarray, int]:
    out = np.zeros((count, 8), dtype=np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8, count * width, at).reshape(width, count).T
    return out.reshape(-1).view("<u8"), at + count * width


def packed(context: np.ndarray, word: np.ndarray, doc: np.ndarray, n: np.ndarray) -> bytes:
    """Entries sorted by context, word and document as bytes: distinct contexts, words of each, documents of each of those, counts."""
    new_c = np.concatenate([[True], context[1:] != context[:-1]])
    new_w = new_c | np.concatenate([[True], word[1:] != word[:-1]])
    c_at, w_at = np.flatnonzero(new_c), np.flatnonzero(new_w)
    words_of = np.diff(np.append(np.searchsorted(w_at, c_at), len(w_at)))
    head = np.array([len(c_at), len(w_at), len(doc)], dtype="<u8").tobytes()
    parts = [
        _planes(np.diff(context[c_at], prepend=np.uint64(0)), 5), _planes(words_of, 4), _planes(word[w_at], 4),
        _planes(np.diff(np.append(w_at, len(doc))), 4), _planes(doc, 2), _planes(n, 4),
    ]
    return head + b"".join(parts)


def unpacked(data: memoryview) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """context, word, document and count of each entry."""
    contexts, pairs, entries = np.frombuffer(data, "<u8", 3).tolist()
    gaps, at = _numbers(data, 24, contexts, 5)
    words_of, at = _numbers(data, at, contexts, 4)
    word, at = _numbers(data, at, pairs, 4)
    docs_of, at = _numbers(data, at, pairs, 4)
    doc, at = _numbers(data, at, entries, 2)
    n, _ = _numbers(data, at, entries, 4)
    context = np.repeat(np.cumsum(gaps, dtype=np.uint64), words_of.astype(np.int64))
    docs_of = docs_of.astype(np.int64)
    return np.repeat(context, docs_of), np.repeat(word, docs_of), doc.astype(np.int64), n.astype(np.int64)


def _send(shard_bits: int, lo: int, hi: int):
    """Texts (lang, text) to rows (shard, block, data): a block's entries for each shard from lo to hi, and with shard -1 its documents' hashes."""

    def sent(held: list[tuple[np.ndarray, ...]], docs: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        hashes = np.concatenate(docs)
        block = int(tx.mix(np.array([tx.mix(hashes + np.arange(len(hashes), dtype=np.uint64)).sum(dtype=np.uint64)]))[0].view(np.int64))
        rows = [(-1, block, hashes.tobytes())]
        if any(len(x[0]) for x in held):
            context, word, doc = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((doc, word, context))
            context, word, doc = context[order], word[order], doc[order]
            starts = np.flatnonzero(np.concatenate([[True], (context[1:] != context[:-1]) | (word[1:] != word[:-1]) | (doc[1:] != doc[:-1])]))
            n = np.diff(np.append(starts, len(order)))
            context, word, doc = context[starts], word[starts], doc[starts]
            shard = (context >> np.uint64(CONTEXT_BITS)).astype(np.int64)
            ends = np.append(np.flatnonzero(np.diff(shard)) + 1, len(shard))
            first = 0
            for end in ends.tolist():
                own = slice(first, end)
                rows.append((int(shard[first]), block, packed(context[own] & np.uint64((1 << CONTEXT_BITS) - 1), word[own], doc[own], n[own])))
                first = end
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())], names=["shard", "block", "data"])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, docs, count, texts = [], [], 0, 0
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for first, past, data, offsets in tx.blocks(batch.column(1)):
                if texts + past - first > BLOCK_DOCS or count > BLOCK_WORDS:
                    yield from sent(held, docs)
                    held, docs, count, texts = [], [], 0, 0
                w = tx.split_words(data, offsets)
                h = tx.word_hashes(w)
                of = np.repeat(np.arange(past - first), w.counts())
                own = np.array([tx.mix(np.frombuffer(x.encode().ljust(8, b"\0")[:8], np.uint64))[0] for x in dict.fromkeys(langs[first:past])], dtype=np.uint64)
                places = {x: k for k, x in enumerate(dict.fromkeys(langs[first:past]))}
                salt = own[np.array([places[x] for x in langs[first:past]])]
                before = np.concatenate([np.zeros(min(1, len(h)), np.uint64), h[:-1]])
                before[w.bounds[:-1][w.counts() > 0]] = 0
                context = tx.mix(before ^ salt[of]) >> np.uint64(64 - CONTEXT_BITS - shard_bits)
                shard = (context >> np.uint64(CONTEXT_BITS)).astype(np.int64)
                mine = (shard >= lo) & (shard < hi)
                held.append((context[mine], (h >> np.uint64(64 - WORD_BITS))[mine], of[mine] + texts))
                docs.append(tx.sequence_hashes(h, w.bounds)[0] ^ salt)
                count, texts = count + int(mine.sum()), texts + past - first
        if docs:
            yield from sent(held, docs)

    return send


def discounts(counts: np.ndarray) -> np.ndarray:
    """0, D1, D2 and D3+ from counts of counts; plain values where those are missing or out of range."""
    n = np.bincount(np.minimum(counts, 5), minlength=6)[1:5].astype(float)
    found = np.array([0.5, 1.0, 1.5])
    if n[0] and n[1]:
        y = n[0] / (n[0] + 2 * n[1])
        with np.errstate(divide="ignore", invalid="ignore"):
            d = np.array([1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2]])
        found = np.where(np.isfinite(d) & (d > 0) & (d < [1, 2, 3]), d, found)
    return np.concatenate([[0.0], found])


def shard_bits_of(context: np.ndarray, word: np.ndarray, doc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """-log2 of each entry's word after its context, times its count, by the counts of all other documents.

    The shard's counts without the document's own, so that a text doesn't vouch for itself: the discounted share of the context,
    and what discounting frees, with an even share over WORDS.  A context of which the rest knows nothing gives that even share.
    """
    order = np.lexsort((word, context))
    c, w, k = context[order], word[order], n[order]
    new_c = np.concatenate([[True], c[1:] != c[:-1]])
    new_w = new_c | np.concatenate([[True], w[1:] != w[:-1]])
    pair_of, context_of = np.cumsum(new_w) - 1, np.cumsum(new_c) - 1
    pair, total = np.bincount(pair_of, weights=k).astype(np.int64), np.bincount(context_of, weights=k).astype(np.int64)
    d = discounts(pair)
    cut = d[np.minimum(pair, 3)]
    freed = np.bincount(context_of[np.flatnonzero(new_w)], weights=cut)
    # What the document itself adds to the context.
    ids = context_of * (int(doc.max(initial=0)) + 1) + doc[order]
    _, at = np.unique(ids, return_inverse=True)
    own = np.bincount(at, weights=k)[at].astype(np.int64)
    left, others = pair[pair_of] - k, total[context_of] - own
    seen = np.maximum(left - d[np.minimum(left, 3)], 0) / np.maximum(others, 1)
    back = np.minimum(freed[context_of] / total[context_of], 1.0)
    p = np.where(others > 0, seen + np.maximum(back, 1e-6) / WORDS, 1 / WORDS)
    out = np.empty(len(n))
    out[order] = -np.log2(p) * k
    return out


def _score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole shards of packed entries to rows (block, sums, docs): for each block the bits of its documents, or their hashes."""
    for rows, starts in whole_groups(batches, ["shard"]):
        for a, b in zip(starts, [*starts[1:], rows.num_rows], strict=True):
            blocks, data = rows["block"].slice(a, b - a).to_pylist(), [x.as_buffer() for x in rows["data"].slice(a, b - a)]
            if rows["shard"][a].as_py() < 0:
                sums, docs = [None] * len(data), [bytes(x) for x in data]
            else:
                parts = [unpacked(memoryview(x)) for x in data]
                sizes = [int(p[2].max(initial=-1)) + 1 for p in parts]
                base = np.concatenate([[0], np.cumsum(sizes)])
                context, word, doc, n = (np.concatenate(x) for x in zip(*parts, strict=True))
                doc = doc + np.repeat(base[:-1], [len(p[0]) for p in parts])
                bits = np.bincount(doc, weights=shard_bits_of(context, word, doc, n), minlength=base[-1]).astype(np.float32)
                sums, docs = [bits[i:j].tobytes() for i, j in zip(base[:-1], base[1:], strict=True)], [None] * len(data)
            yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array(sums, pa.binary()), pa.array(docs, pa.binary())], names=["block", "sums", "docs"])


def _by_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of whole blocks to (doc, bits).  A block that several tasks sent alike has its documents several times, with equal sums."""
    for rows, starts in whole_groups(batches, ["block"]):
        for a, b in zip(starts, [*starts[1:], rows.num_rows], strict=True):
            docs = [x.as_buffer() for x in rows["docs"].slice(a, b - a) if x.is_valid]
            hashes = np.frombuffer(docs[0], np.uint64) if docs else np.zeros(0, np.uint64)
            bits = np.zeros(len(hashes))
            for x in rows["sums"].slice(a, b - a):
                if x.is_valid:
                    part = np.frombuffer(x.as_buffer(), np.float32)
                    bits[: len(part)] += part / len(docs)
            yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(bits)], names=["doc", "bits"])


def doc_key(lang: str, sequence: np.ndarray) -> np.ndarray:
    """The key under which word_bits tells of texts of a language with these sequence hashes."""
    return sequence ^ tx.mix(np.frombuffer(lang.encode().ljust(8, b"\0")[:8], np.uint64))[0]


def word_bits(base: DataFrame, words: int) -> DataFrame:
    """doc (see doc_key) and bits for the texts (lang, text), of `words` words in all: the sum of -log2 of each word after the word before, at
    a text's begin after none, in the model of its language and of all other texts.  Copies of a text have one row.
    """
    shard_bits = max(0, (max(words, 1) // SHARD_WORDS).bit_length())
    shards, found = 1 << shard_bits, None
    passes = min(PASSES, shards)
    for k in range(passes):
        send = _send(shard_bits, k * shards // passes, (k + 1) * shards // passes)
        sent = base.select("lang", "text").mapInArrow(send, "shard long, block long, data binary")
        # Documents' hashes are dealt by block, entries by shard.
        sent = sent.withColumn("deal", F.when(F.col("shard") < 0, F.col("block")).otherwise(F.col("shard")))
        sent = sent.repartition("deal", "shard").sortWithinPartitions("shard", "deal").select("shard", "block", "data")
        sums = written(sent.mapInArrow(_score, "block long, sums binary, docs binary"), "word-sums")
        own = sums.repartition("block").sortWithinPartitions("block").mapInArrow(_by_document, "doc long, bits double")
        own = own.groupBy("doc").agg(F.max("bits").alias("bits"))
        found = own if found is None else found.unionByName(own)
    return written(found.groupBy("doc").agg(F.sum("bits").alias("bits")), "word-bits")
