"""Token ids of documents as binary blocks of separately compressed frames that share one zstandard dictionary.

The file format, a folder with three parts (each in Parquet, so that any store that Spark reads and writes can hold it, and lost
executors are the business of Spark's commit protocol):

* ``dictionary``: one row: ``dictionary_hash`` (SHA-256 of the dictionary), ``dictionary``, ``tokenizer``, ``end_id``, ``width``.
* ``blocks``: ``block``, ``dictionary_hash``, ``payload``, and the entries of its documents as arrays. A payload is MAGIC, the first 8 bytes of the dictionary's hash, the width of
  an id in bytes (one byte), the number of frames n (four bytes), n + 1 frame offsets (eight bytes each, from the payload's start),
  then the frames. A frame is the zstandard compression of one document's ids, little-endian and unsigned, each ``width`` bytes.
  Blocks ascend by doc_id, and so do the frames of a block. All numbers are little-endian.
* ``index``: ``doc_id``, ``ordinal`` (among the documents of a block), ``start`` (ids of all documents before it), ``n_tokens``,
  ``block``, ``at``, ``size`` (place of its frame in the payload). Reading a few documents takes their index rows, cuts their frames
  out of the payloads on the JVM and decompresses only those.

``write_tokens`` range-partitions documents by doc_id, sorts, and encodes each partition once as a stream; a block is closed at
``BLOCK_BYTES``. Ids before a partition come from one row per partition. The dictionary is trained on the ids of at most
``SAMPLE_DOCUMENTS`` documents with the least hash of their id, of each at most the first ``SAMPLE_IDS`` ids; it only affects the size
of the files. If there is too little to train on, the dictionary is empty and frames are plain.

Defined cases: a null text is empty; an empty document is its end id; documents of one id (and rows without an id, which come
first) are ordered by their text and kept one by one; an empty table gives an empty file; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import materialise, slices, small_side, utf8_views

TOKENIZER, END_ID = "word_bpe_49k", 1
MAGIC = b"TIDB"
HEAD = "<4s8sBI"
BLOCK_BYTES = 1 << 20
DICTIONARY_BYTES, SAMPLE_DOCUMENTS, SAMPLE_IDS = 64 << 10, 2000, 2000
LEVEL = 3
#: Words whose ids a task remembers.
REMEMBERED = 400_000
_LATIN = "".join(map(chr, range(256)))
_LETTERS = "".join(c for c in _LATIN if c.isalpha())
_NUMBERS = "".join(c for c in _LATIN if c.isnumeric())
_SPACES = "\t\n\x0b\x0c\r \x85\xa0"
#: Words of the tokenizer: contractions, letters, single digits, and runs of anything else but white space.
_LATIN_WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^{_SPACES}{_LETTERS}{_NUMBERS}]+")
#: Bytes as the characters of byte-level vocabularies: visible characters stand for themselves, the others for 256 and on in order.
_HIDDEN = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b)]
_BYTE_LETTERS = {b: chr(256 + i) for i, b in enumerate(_HIDDEN) if b != 32}


class TextEncoder:
    """text -> ids by the tokenizer called ``name`` (of the public set, or a path without ending).

    With ``by_word`` the ids of words are remembered. A text in Latin script is lowered and cut into the tokenizer's own words
    (``_LATIN_WORDS`` is its rule for the first 256 characters); new ones go many at a time through the tokenizer file without its
    steps of lowering and cutting, told apart by the tokens that end a word. Any other text is cut at blanks and line feeds, which
    this tokenizer drops and never joins over, and new pieces go through the whole tokenizer. So does a text that may hold a special
    token, in one piece.
    """

    @classmethod
    def of_process(cls, name: str, by_word: bool) -> "TextEncoder":
        """The encoder of this worker process, kept from task to task with the words it remembers."""
        held = vars(sys).setdefault("_token_store_encoders", {})
        if (name, by_word) not in held:
            held[name, by_word] = cls(name, by_word)
        return held[name, by_word]

    def __init__(self, name: str = TOKENIZER, by_word: bool = True):
        import public_tokenizers

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task is one thread
        import tokenizers

        self.file = tokenizers.Tokenizer.from_file(name + ".json" if os.path.isabs(name) else public_tokenizers.path(name + ".json"))
        self.special = [t.content for t in self.file.get_added_tokens_decoder().values()]
        self.size = self.file.get_vocab_size()
        self.by_word, self.known = by_word, {"": b""}
        if by_word:
            self.ends = np.zeros(self.size, bool)
            self.ends[[i for token, i in self.file.get_vocab().items() if token.endswith("</w>")]] = True
            self.bare = tokenizers.Tokenizer(self.file.model)
            self.bare.pre_tokenizer = tokenizers.pre_tokenizers.WhitespaceSplit()

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.file.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn_words(self, fresh: list[str]) -> None:
        for a in range(0, len(fresh), 1000):
            part = fresh[a:a + 1000]
            line = " ".join(part)
            if not (line.isascii() and line.isprintable()):
                line = line.encode().decode("latin-1").translate(_BYTE_LETTERS)
            ids = np.array(self.bare.encode_batch_fast([line], add_special_tokens=False)[0].ids, "<u4")
            cuts = [0, *(4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()]
            data = ids.tobytes()
            self.known.update((w, data[i:j]) for w, i, j in zip(part, cuts[:-1], cuts[1:], strict=True))

    def many(self, texts: list[str]) -> list[np.ndarray]:
        cut: list = []
        words: set[str] = set()
        pieces: set[str] = set()
        for text in texts:
            if not self.by_word or any(s in text for s in self.special):
                cut.append(None)
            elif text.isascii() or _is_latin(text):
                cut.append(_LATIN_WORDS.findall(text.lower()))
                words.update(cut[-1])
            else:
                cut.append(text.replace("\n", " ").split(" "))
                pieces.update(cut[-1])
        if len(self.known) > REMEMBERED:  # frequent words are met again in any run of texts
            self.known = {"": b"", **{w: self.known[w] for w in words | pieces if w in self.known}}
        words.difference_update(self.known)
        self._learn_words([w for w in words if w.isascii()])
        self._learn_words([w for w in words if not w.isascii()])
        fresh = list(pieces.difference(self.known))
        for a in range(0, len(fresh), 5000):
            self.known.update(zip(fresh[a:a + 5000], self._ids(fresh[a:a + 5000])))
        known = self.known.__getitem__
        return [np.frombuffer(self._ids([t])[0] if c is None else b"".join(map(known, c)), "<u4") for t, c in zip(texts, cut)]


def _is_latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def text_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list]]:
    """(first column, texts of the second) in runs of bounded size; a null text is empty."""
    for batch in batches:
        for a, b in slices(utf8_views(batch.column(1))[1]):
            part = batch.slice(a, b - a)
            yield part.column(0).to_pylist(), [t or "" for t in part.column(1).to_pylist()]


def dictionary_of(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A zstandard dictionary; empty if the samples do not suffice."""
    samples = [s for s in samples if len(s) >= 8]
    if len(samples) < 16 or sum(map(len, samples)) < 8192:
        return b""
    try:
        return zstandard.train_dictionary(min(size, sum(map(len, samples)) // 8), samples).as_bytes()
    except zstandard.ZstdError:  # too uniform for the trainer
        return b""


def _codec(dictionary: bytes):
    shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    return (zstandard.ZstdCompressor(level=LEVEL, dict_data=shared, write_content_size=True, write_dict_id=False),
            zstandard.ZstdDecompressor(dict_data=shared))


def train_dictionary(docs: DataFrame, tokenizer: str = TOKENIZER, by_word: bool = True, width: int = 2,
                     sample_documents: int = SAMPLE_DOCUMENTS, sample_ids: int = SAMPLE_IDS) -> bytes:
    """Dictionary of the serialized ids of a bounded sample, chosen by the hash of the id."""
    chosen = (docs.select("doc_id", F.substring("text", 1, 16 * sample_ids).alias("text"), F.xxhash64("doc_id", "text").alias("by"))
              .orderBy("by", "doc_id", "text").limit(sample_documents))

    def run(batches):
        encoder = TextEncoder.of_process(tokenizer, by_word)
        for _, texts in text_batches(batches):
            yield pa.RecordBatch.from_arrays([pa.array([ids[:sample_ids].astype(f"<u{width}").tobytes() for ids in encoder.many(texts)], pa.binary())], names=["ids"])

    rows = chosen.select("doc_id", "text").mapInArrow(run, "ids binary").collect()
    return dictionary_of([r.ids for r in rows])


def encode_block(frames: list[bytes], dictionary_hash: bytes, width: int) -> tuple[bytes, list[int]]:
    """The payload of a block, and the places of its frames."""
    first = struct.calcsize(HEAD) + 8 * (len(frames) + 1)
    places = np.concatenate(([0], np.cumsum([len(f) for f in frames], dtype=np.int64))).astype("<u8") + np.uint64(first)
    return b"".join([struct.pack(HEAD, MAGIC, dictionary_hash[:8], width, len(frames)), places.tobytes(), *frames]), [int(p) for p in places]


def frames_of_block(payload: bytes, dictionary_hash: bytes) -> tuple[int, list[bytes]]:
    """(width, frames) of a payload; an error if it was not written with this dictionary."""
    magic, mark, width, n = struct.unpack_from(HEAD, payload)
    if magic != MAGIC or mark != dictionary_hash[:8]:
        raise ValueError("not a block of this dictionary")
    places = np.frombuffer(payload, "<u8", n + 1, struct.calcsize(HEAD)).astype(np.int64)
    if places[-1] != len(payload):
        raise ValueError("a block is cut short")
    return width, [payload[a:b] for a, b in zip(places[:-1], places[1:])]


#: One row per block. Blocks ascend: partition number above, number in the partition below. ``start`` counts the ids of the partition.
_BLOCKS = "block long, dictionary_hash string, payload binary, doc_id array<bigint>, start array<bigint>, n_tokens array<bigint>, at array<bigint>, size array<bigint>"
_NAMES = ["block", "dictionary_hash", "payload", "doc_id", "start", "n_tokens", "at", "size"]


def write_tokens(docs: DataFrame, path: str, tokenizer: str = TOKENIZER, end_id: int = END_ID, by_word: bool = True,
                 block_bytes: int = BLOCK_BYTES) -> str:
    """Write the ids of all documents, each followed by ``end_id``, in ascending doc_id order; returns ``path``."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    width = 2 if max(TextEncoder(tokenizer).size - 1, end_id) < 1 << 16 else 4
    dictionary = train_dictionary(docs, tokenizer, by_word, width)
    mark = hashlib.sha256(dictionary).digest()
    one = spark.createDataFrame([(mark.hex(), bytearray(dictionary), tokenizer, end_id, width)],
                                "dictionary_hash string, dictionary binary, tokenizer string, end_id long, width int")
    one.coalesce(1).write.mode("overwrite").parquet(f"{path}/dictionary")
    shipped = spark.sparkContext.broadcast(dictionary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, (packer, _) = TextEncoder.of_process(tokenizer, by_word), _codec(shipped.value)
        block, held, waiting, start = TaskContext.get().partitionId() << 32, [], 0, 0
        end = np.array([end_id], "<u4")

        def close():
            payload, places = encode_block([h[3] for h in held], mark, width)
            lists = [*zip(*(h[:3] for h in held)), places[:-1], [b - a for a, b in zip(places, places[1:])]]
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([mark.hex()]), pa.array([payload], pa.binary()),
                                               *(pa.array([list(x)], pa.list_(pa.int64())) for x in lists)], names=_NAMES)

        for doc_ids, texts in text_batches(batches):
            for doc_id, ids in zip(doc_ids, encoder.many(texts)):
                ids = np.append(ids, end)
                frame = packer.compress(ids.astype(f"<u{width}").tobytes())
                held.append((doc_id, start, len(ids), frame))
                start += len(ids)
                waiting += len(frame)
                if waiting >= block_bytes:
                    yield close()
                    block, held, waiting = block + 1, [], 0
        if held:
            yield close()

    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    (docs.repartitionByRange(*order).sortWithinPartitions(*order, "text").mapInArrow(run, _BLOCKS)
     .write.mode("overwrite").parquet(f"{path}/blocks"))
    blocks = _blocks(spark, path).withColumn("part", F.shiftright("block", 32))
    totals = materialise(blocks.groupBy("part").agg(F.max(F.element_at("start", -1) + F.element_at("n_tokens", -1)).alias("ids")))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition of the write
    bases = totals.select("part", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("base"))
    entry = F.posexplode(F.arrays_zip("doc_id", "start", "n_tokens", "at", "size"))
    (blocks.join(small_side(bases), "part").select("block", "base", entry.alias("ordinal", "e"))
     .select("e.doc_id", "ordinal", (F.col("base") + F.col("e.start")).alias("start"), "e.n_tokens", "block", "e.at", "e.size")
     .write.mode("overwrite").parquet(f"{path}/index"))
    return path


def _blocks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_BLOCKS).parquet(f"{path}/blocks")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("doc_id long, ordinal int, start long, n_tokens long, block long, at long, size long").parquet(f"{path}/index")


def _opened(spark: SparkSession, path: str) -> tuple[bytes, bytes, int]:
    """(dictionary, its hash, width of an id); an error if the dictionary is not the one its hash names."""
    one = spark.read.parquet(f"{path}/dictionary").first()
    dictionary, mark = bytes(one.dictionary), bytes.fromhex(one.dictionary_hash)
    if hashlib.sha256(dictionary).digest() != mark:
        raise ValueError("the dictionary does not match its hash")
    return dictionary, mark, one.width


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from all blocks: their frames are decompressed and counted again."""
    dictionary, mark, _ = _opened(spark, path)
    shipped = spark.sparkContext.broadcast(dictionary)

    def run(batches):
        _, opener = _codec(shipped.value)
        for batch in batches:
            for i in range(batch.num_rows):
                width, frames = frames_of_block(batch.column(1)[i].as_py(), mark)
                ids = [np.frombuffer(opener.decompress(f), f"<u{width}").astype("<u4") for f in frames]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([batch.column(0)[i].as_py()] * len(ids), pa.int64()), pa.array(range(len(ids)), pa.int32()),
                     pa.array([len(x) for x in ids], pa.int64()), pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64())],
                    names=["block", "ordinal", "n", "ids_crc32"])

    found = _blocks(spark, path).select("block", "payload").mapInArrow(run, "block long, ordinal int, n long, ids_crc32 long")
    return (read_index(spark, path).join(found, ["block", "ordinal"])
            .select("doc_id", "start", F.col("n").alias("n_tokens"), "ids_crc32"))


def read_documents(spark: SparkSession, path: str, doc_ids: DataFrame) -> DataFrame:
    """doc_id, start, ids of the documents whose id is in ``doc_ids``; only their frames are cut out and decompressed."""
    dictionary, _, width = _opened(spark, path)
    shipped = spark.sparkContext.broadcast(dictionary)

    def run(batches):
        _, opener = _codec(shipped.value)
        for batch in batches:
            ids = [np.frombuffer(opener.decompress(f), f"<u{width}").astype(np.int64) for f in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.list_(pa.int64()))], names=["doc_id", "start", "ids"])

    wanted = read_index(spark, path).join(small_side(materialise(doc_ids.select("doc_id").distinct())), "doc_id", "left_semi")
    frames = (_blocks(spark, path).select("block", "payload").join(small_side(wanted), "block")
              .select("doc_id", "start", F.expr("substring(payload, cast(at + 1 as int), cast(size as int))").alias("frame")))
    return frames.mapInArrow(run, "doc_id long, start long, ids array<bigint>")
