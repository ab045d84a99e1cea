"""Vector bin packing of token sequences under simultaneous limits on tokens, segments and loss-bearing tokens.

Every example is a vector (tokens, 1 segment, loss-bearing tokens); every open sequence has a residual vector. The dot-product
heuristic gives the open sequence the example with the largest dot product of (demand / limit) and (residual / limit) among
those that fit, so an example that is heavy where the sequence has most room comes first. An example that fits nowhere in the
window of waiting examples is cut at the largest length that all three limits allow. Packing runs where the rows lie: each
task keeps a bounded window of waiting examples, so no shuffle and no group is needed; a task that is run again over the same
rows makes the same sequences. What is left when a task ends is laid out as sequences whose lengths are powers of two.

Defined cases: a null text is empty; an empty document is its separator alone; null ids are kept; repeated rows are packed
again each time; an empty table gives no pieces; further columns are ignored.
"""

from __future__ import annotations

import base64
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import slices, utf8_views

TOKENIZER = "byte_bpe_50k"
MAX_TOKENS, MAX_SEGMENTS, MAX_LOSS = 1024, 256, 1024
#: Waiting examples of one task.
WINDOW = 256


class Packer:
    """Fills sequences one after the other from a window of waiting pieces [doc, start, length, loss_from, loss_to].

    Loss-bearing tokens of a document are its positions [loss_from, loss_to); the loss of a piece is its overlap with them.
    ``emit(doc, start, length, sequence, offset)`` receives the pieces.
    """

    def __init__(self, emit, limits=(MAX_TOKENS, MAX_SEGMENTS, MAX_LOSS), window: int = WINDOW):
        self.emit, self.window = emit, window
        self.tokens, self.segments, self.loss = limits
        self.inv = np.array([1.0 / x for x in limits])
        self.need = np.zeros((2 * window, 3))
        self.piece: list = [None] * (2 * window)
        self.free = list(range(2 * window - 1, -1, -1))
        self.count, self.sequence = 0, 0
        self.room, self.open = None, []

    def _loss(self, p) -> int:
        return max(0, min(p[1] + p[2], p[4]) - max(p[1], p[3]))

    def add(self, doc, length: int, loss_from: int = 0, loss_to: int | None = None) -> None:
        loss_to = length if loss_to is None else loss_to
        start = 0
        while length - start >= self.tokens and self._loss((doc, start, self.tokens, loss_from, loss_to)) <= self.loss:
            self.emit(doc, start, self.tokens, self.sequence, 0)  # full by itself
            self.sequence += 1
            start += self.tokens
        if start < length:
            self._wait((doc, start, length - start, loss_from, loss_to))
        while self.count >= self.window:
            self._fill()

    def _wait(self, p) -> None:
        if not self.free:
            more = len(self.piece)
            self.need, self.piece = np.vstack((self.need, np.zeros_like(self.need))), self.piece + [None] * more
            self.free = list(range(2 * more - 1, more - 1, -1))
        i = self.free.pop()
        self.piece[i], self.need[i] = p, (p[2], 1, self._loss(p))
        self.count += 1

    def _take(self, i: int):
        p, self.piece[i] = self.piece[i], None
        self.need[i] = 0
        self.free.append(i)
        self.count -= 1
        return p

    def _place(self, p) -> None:
        self.open.append(p)
        self.room -= (p[2], 1, self._loss(p))

    def _fill(self) -> None:
        """Fill one sequence."""
        self.room, self.open = np.array([self.tokens, self.segments, self.loss], float), []
        live = self.need[:, 1] > 0
        while self.count and self.room[0] >= 1 and self.room[1] >= 1:
            fits = live & (self.need <= self.room).all(axis=1)
            if fits.any():
                score = np.where(fits, self.need @ (self.inv * self.inv * self.room), -1.0)
                i = int(score.argmax())
                live[i] = False
                self._place(self._take(i))
                continue
            i = int(np.where(live, self.need[:, 0], -1).argmax())
            doc, start, length, lo, hi = self._take(i)
            live[i] = False
            cut = int(min(length, self.room[0]))
            while cut and self._loss((doc, start, cut, lo, hi)) > self.room[2]:
                cut -= int(self._loss((doc, start, cut, lo, hi)) - self.room[2])
            if cut:
                self._place((doc, start, cut, lo, hi))
            if length - cut:
                self._wait((doc, start + cut, length - cut, lo, hi))
            if cut < 1 or self.room[2] < 1:
                break
            live = self.need[:, 1] > 0
        self._close()

    def _close(self) -> None:
        """Number the open sequence; one that is not full is cut into sequences whose lengths are powers of two."""
        total = sum(p[2] for p in self.open)
        left = total if total < self.tokens else 0
        size = self.tokens if not left else 1 << (left.bit_length() - 1)
        offset = 0
        for doc, start, length, _, _ in self.open:
            while length:
                part = min(length, size - offset)
                self.emit(doc, start, part, self.sequence, offset)
                start, length, offset = start + part, length - part, offset + part
                if offset == size:
                    self.sequence, offset = self.sequence + 1, 0
                    if left:
                        left -= size
                        size = 1 << (left.bit_length() - 1) if left else self.tokens
        self.open = []

    def close(self) -> None:
        while self.count:
            self._fill()


PIECES = StructType([StructField(n, LongType()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])


class DocumentEncoder:
    """text -> ids as a uint32 array, by the byte-level tokenizer called ``name`` (of the public set, or a path without ending).

    Ordinary texts go through the ranks of the vocabulary, which give the ids of the tokenizer file three times as fast; a text
    with the string of a special token goes through the file itself.
    """

    def __init__(self, name: str = TOKENIZER):
        import public_tokenizers
        import tiktoken
        import tokenizers

        at = (lambda end: name + end) if os.path.isabs(name) else (lambda end: public_tokenizers.path(name + end))
        self.tokenizer = tokenizers.Tokenizer.from_file(at(".json"))
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        with open(at(".tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.ranks = tiktoken.Encoding(os.path.basename(name), pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, "<u4")
        if any(s in text for s in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")
        return self.ranks.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False)


def pack_documents(docs: DataFrame, max_tokens: int = MAX_TOKENS, max_segments: int = MAX_SEGMENTS, max_loss: int = MAX_LOSS,
                   tokenizer: str = TOKENIZER, separator: int = 0, window: int = WINDOW) -> DataFrame:
    """Pieces of all documents: the columns of ``PIECES``.

    A document is its ids and the separator, which bears no loss. Sequence ids are unique, ascending within a task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = DocumentEncoder(tokenizer)
        base = TaskContext.get().partitionId() << 40
        rows: list[tuple] = []
        ids_of: dict[int, tuple] = {}
        number = 0

        def emit(doc, start, length, sequence, offset):
            doc_id, ids, left = ids_of[doc]
            rows.append((doc_id, start, length, zlib.crc32(ids[start:start + length].tobytes()), len(ids), base + sequence, offset))
            if left == length:
                del ids_of[doc]
            else:
                ids_of[doc] = (doc_id, ids, left - length)

        packer = Packer(emit, (max_tokens, max_segments, max_loss), window)

        def ready():
            cols = list(zip(*rows)) if rows else [[] for _ in PIECES]
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=PIECES.names)

        for batch in batches:
            for part in (batch.slice(a, b - a) for a, b in slices(utf8_views(batch.column(1))[1])):
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    ids = np.append(encode(text), np.uint32(separator)).astype("<u4")
                    ids_of[number] = (doc_id, ids, len(ids))
                    packer.add(number, len(ids), 0, len(ids) - 1)
                    number += 1
                yield ready()
        packer.close()
        yield ready()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES)


EXAMPLES = StructType([*(StructField(n, LongType()) for n in ("example_id", "start", "length", "sequence_id", "offset"))])


def pack_examples(examples: DataFrame, max_tokens: int = MAX_TOKENS, max_segments: int = MAX_SEGMENTS, max_loss: int = MAX_LOSS,
                  window: int = WINDOW) -> DataFrame:
    """Instruction data: ``examples`` has example_id, tokens and loss_tokens (the last tokens bear the loss). A null or
    negative count is 0, an example without tokens gives no piece, and loss_tokens above tokens count as tokens."""

    def run(batches):
        base = TaskContext.get().partitionId() << 40
        rows: list[tuple] = []
        packer = Packer(lambda d, s, n, q, o: rows.append((d, s, n, base + q, o)), (max_tokens, max_segments, max_loss), window)
        for batch in batches:
            for i, n, loss in zip(*(batch.column(j).to_pylist() for j in range(3))):
                n = max(0, n or 0)
                packer.add(i, n, n - min(n, max(0, loss or 0)), n)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (list(zip(*rows)) or [[]] * 5)], names=EXAMPLES.names)
            rows.clear()
        packer.close()
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (list(zip(*rows)) or [[]] * 5)], names=EXAMPLES.names)

    cols = [F.col(c).cast("long") for c in ("example_id", "tokens", "loss_tokens")]
    return examples.select(*cols).mapInArrow(run, EXAMPLES)
