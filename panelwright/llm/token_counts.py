"""Token counts by the whole-token shortcut."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from panelwright.llm._bpe import Words, WordTokenizer, per_worker
from panelwright.llm._store import arrow_rows, pick, text_offsets

LIMIT = 2048


def whole_tokens(tokenizer: WordTokenizer) -> frozenset[str]:
    """The pre-tokens that encode alone as one token, proved by encoding every vocabulary string by itself.

    A string of the vocabulary need not survive as one token: its merges can go another way, and splitting can change
    it. Only those stay that are one pre-token, unchanged, and come out as their own single id.
    """
    vocab, suffix = tokenizer.library.get_vocab(with_added_tokens=False), tokenizer.suffix
    texts = [t.removesuffix(suffix) for t in vocab if t.endswith(suffix) and t != suffix]
    texts = [t for t in texts if t.isascii() and tokenizer.normal(t) == [t] and tokenizer.pre_tokens(t) == [t]]
    return frozenset(t for t in texts if tokenizer.merge(t) == [vocab[t + suffix]])


class Counting:
    """Token counts of texts with what one worker knows of words."""

    def __init__(self, path: str):
        self.tokenizer = WordTokenizer(path)
        self.whole = whole_tokens(self.tokenizer)
        self.known = Words(self.tokenizer.pre_tokens, lambda p: 1 if p in self.whole else len(self.tokenizer.merge(p)), sum)

    def count(self, text: str) -> int:
        count = self.known.__getitem__
        return sum(1 if special is not None else sum(map(count, found)) for special, found in self.tokenizer.words(text))


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of each row, as the tokenizers library counts a whole text with the file at ``path``.

    Begin, end and other added tokens do not count; special strings inside a text count as the one token that the
    library makes of them. Pre-tokens that are one whole token are counted directly; only the rest is merged, each
    distinct one once in a worker. A null text counts as empty: 0 bytes, 0 tokens. Row order, repeated rows and null ids
    stay as they are; other columns are ignored; an empty table gives an empty one. One narrow stage, no shuffle.
    """
    arrow_rows(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counting: Counting = per_worker(("count", path), lambda: Counting(path))
        for b in batches:
            size = np.diff(text_offsets(b.column(1)))
            n = pa.array([counting.count(str(t)) if t.is_valid else 0 for t in b.column(1)], pa.int64())
            yield pa.record_batch([b.column(0), pa.array(size, pa.int64()), n, pa.array(np.asarray(n) > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[id_col].dataType.simpleString()
    return pick(docs, id_col, text_col).mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
