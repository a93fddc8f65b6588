"""The library's word splitting and hashing over Arrow string batches, by one short name."""

from tidemark.functions.wordhash import (
    BLOCK_BYTES, WORD_BASE, WORD_BASE_2, Words, blocks, inside, list_array, mix, powers, rolling_hashes, sequence_hashes, split_words, word_hashes,
)

__all__ = [
    "BLOCK_BYTES", "WORD_BASE", "WORD_BASE_2", "Words", "blocks", "inside", "list_array", "mix", "powers", "rolling_hashes", "sequence_hashes", "split_words", "word_hashes",
]
