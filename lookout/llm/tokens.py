"""Exact token counts with the whole-token shortcut."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F

from lookout.llm.common import documents

LIMIT = 1024
FILE = "byte_bpe_50k.json"
# Counts of pre-tokens that aren't whole tokens, kept by each worker until so many.
MEMO = 200_000
MEMO_CHARS = 100
# How the byte-level pre-tokenizer cuts (fixed pattern of this tokenizer).
PRE_TOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
# Characters whose classes no version of Unicode has changed: Latin, Greek, Cyrillic,
# general punctuation. A text with others is cut by the tokenizer library itself.
SETTLED = regex.compile(r"[\x00-ɏΑ-ΡΣ-ωА-я -⁤₠-₵←-⏧]*+")


class Counts(dict):
    """Tokens of a pre-token: whole tokens from the start, others merged when first met."""

    def __init__(self, proven: dict[str, int], merge: Callable[[str], int]):
        super().__init__(proven)
        self.proven, self.merge = proven, merge

    def __missing__(self, piece: str) -> int:
        if len(self) >= len(self.proven) + MEMO:
            self.clear()
            self.update(self.proven)
        n = self.merge(piece)
        if len(piece) <= MEMO_CHARS:
            self[piece] = n
        return n


class Counting:
    """Tokens of a text: proven whole tokens by look-up, merges only for the rest."""

    def __init__(self, path: str):
        from tiktoken import Encoding
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.cut = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        decoder = {self.byte_char(b): b for b in range(256)}
        vocab = {bytes(decoder[c] for c in t): i for t, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if t not in special}
        merges = Encoding("merges", pat_str=r"[\s\S]+", mergeable_ranks=vocab, special_tokens={})
        self.counts = Counts(self.whole_tokens(vocab), lambda piece: len(merges._encode_single_piece(piece)))

    def whole_tokens(self, vocab: dict[bytes, int]) -> dict[str, int]:
        """Tokens of each vocabulary entry that is valid text and is cut as one piece.

        The library encodes them all once: one token where it gives just the entry's own
        id, which is the proof; an entry that merges never reach keeps its real count.
        """
        entries = []
        for token, i in vocab.items():
            try:
                text = token.decode()
            except UnicodeDecodeError:
                continue
            if self.pieces(text) == [text]:
                entries.append((text, i))
        found = self.tokenizer.encode_batch([t for t, _ in entries], add_special_tokens=False)
        return {t: 1 if e.ids == [i] else len(e.ids) for (t, i), e in zip(entries, found)}

    @staticmethod
    @lru_cache(512)
    def byte_char(b: int) -> str:
        """The printable character that stands for a byte in the vocabulary: itself if
        it is printable Latin-1, else the next free one from U+0100 on."""
        plain = lambda x: 0x21 <= x <= 0x7E or 0xA1 <= x <= 0xAC or 0xAE <= x <= 0xFF
        return chr(b) if plain(b) else chr(0x100 + sum(not plain(x) for x in range(b)))

    def pieces(self, text: str) -> list[str]:
        if SETTLED.fullmatch(text):
            return PRE_TOKEN.findall(text)
        cut = self.tokenizer.pre_tokenizer.pre_tokenize_str(text)
        return [text[a:b] for _, (a, b) in cut]

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        parts = self.cut.split(text) if self.cut and self.cut.search(text) else [text]
        return len(parts) - 1 + sum(sum(map(self.counts.__getitem__, self.pieces(p))) for p in parts)


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row of ``docs(doc_id, text)``.

    Strings of added tokens inside a text count as one token each, as the library's
    default has it. A null text is empty and has no tokens, a null doc_id gives a row
    with a null doc_id, repeated rows repeat, an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        counting = Counting(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = part.column("text").to_pylist()
                n = [counting.count(t) for t in texts]
                size = [len(t.encode()) if t else 0 for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                    names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
                )

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(documents(spark, sf_dir), str(public_tokenizers.path(FILE)))
