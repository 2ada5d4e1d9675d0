"""Token-ID output: documents in id order as shards of entropy-coded blocks, and the reader for them.

Documents are range-partitioned by id, and each partition writes a shard. A shard consists of
sections: the ids of many documents are gathered, their frequencies make the table that all blocks
of the section share, then the blocks follow. So each text is encoded once, nothing but the texts is
shuffled, and a section bounds what a task holds. Reading deals groups of blocks out to tasks by their
offsets; with its table a block is checked and decoded on its own.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from rollmark.llm.common import Scratch, prepare
from rollmark.llm.rans import Table, block, blocks, frequencies
from rollmark.llm.texts import batch_bytes, slices
from rollmark.sources.files import filesystem

END_ID = 1
#: Tokens in a block; a document that is longer goes on in further blocks.
BLOCK_TOKENS = 1 << 18
#: Bytes of text in a shard, on average.
SHARD_BYTES = 32 << 20
#: Tokens in a section at most, but for a longer document's last block.
SECTION_TOKENS = 1 << 23
#: Bytes of text that are split into words at once.
SPLIT_BYTES = 2 << 20
#: Words whose ids a worker remembers at most: as many new ones, and as many of those before.
CACHED_WORDS = 400_000

MANIFEST = (
    "shard int, uri string, n_docs long, n_tokens long, n_bytes long, "
    "units array<struct<offset:long,length:long,first_token:long,table_offset:long,table_length:long>>"
)
DOCUMENTS = "doc_id long, first_token long, n_tokens long, ids_crc32 long"


#: Words of which the tokenizer makes one piece: lower-case Latin letters. Unchanged by normalisation.
_PLAIN = re.compile("[a-zß-öø-ÿ]+")
#: ASCII punctuation.
_MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum())
#: Byte-level models name the bytes that aren't printable Latin-1 by the characters from 256 on.
_BYTE_NAMES = {b: 256 + i for i, b in enumerate([*range(33), *range(127, 161), 173])}


class _Known(dict):
    """Ids by word; what is missing is taken over from the ``old`` words or encoded."""

    def __init__(self, encode: Callable[[bytes], bytes], old: dict[bytes, bytes]):
        self.encode, self.old = encode, old

    def __missing__(self, word: bytes) -> bytes:
        ids = self.old[word] if word in self.old else self.encode(word)
        self[word] = ids
        return ids


class WordIds:
    """Ids of white-space separated words, as bytes of little-endian 32-bit numbers.

    A word's ids are looked up when it comes again. That rests on facts about the tokenizer, which
    are tried on probes when it is loaded and tested at length: white space is dropped and nothing
    is joined over it; it lower-cases; punctuation is never in one piece with an ASCII letter
    before it; and a word of letters is one piece for the model. Where a fact doesn't hold,
    words or whole texts are encoded as they are. When there are ``CACHED_WORDS`` words, they become
    the old ones, of which those that come again are taken over; the older ones are forgotten.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks already use all cores
        from tokenizers import Tokenizer

        self.forget()
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        one, words = self._encode, ("then", "word", "zürich", "naïve", "qxv")
        self.by_word = all(one(f"{a} {b}\n") == one(a) + one(b) for a in words for b in ("then,", "9.5", "--"))
        self.by_stem = all(one(w.capitalize() + m) == one(w) + one(m) for w in words for m in (".", ",", "!!", "&&&", "'", ")."))
        self.direct = all(one(w) == self._direct(w) for w in words)

    def _encode(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _direct(self, word: str) -> list[int]:
        named = word if word.isascii() else word.encode().decode("latin-1").translate(_BYTE_NAMES)
        return [t.id for t in self.model.tokenize(named)]

    def forget(self) -> None:
        """Drop all words; a worker that waits for its next task holds none."""
        self.ids = _Known(self._word, {})

    def text(self, text: bytes) -> bytes:
        return self.texts([text])[0]

    def texts(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text."""
        if not self.by_word:
            return [np.array(self._encode(text.decode()), dtype="<u4").tobytes() for text in texts]
        if len(self.ids) > CACHED_WORDS:
            old, old.old = self.ids, {}
            self.ids = _Known(self._word, old)
        look_up = self.ids.__getitem__
        return [b"".join(map(look_up, text.split())) for text in texts]

    def _word(self, word: bytes) -> bytes:
        """The ids of a new word, those that may be special tokens as they are."""
        if self.by_stem and b"<|" not in word:
            lowered = word.lower()
            stem = lowered.rstrip(_MARKS)
            # only behind an ASCII letter punctuation is surely a piece of its own
            if len(stem) < len(lowered) and stem and 97 <= stem[-1] <= 122:
                return self.ids[stem] + self.ids[lowered[len(stem) :]]
            if lowered != word:
                return self.ids[lowered]
        if self.direct and word.isalpha() and word.islower():  # ASCII letters
            return array("I", [t.id for t in self.model.tokenize(word.decode())]).tobytes()
        text = word.decode()
        return array("I", self._direct(text) if self.direct and _PLAIN.fullmatch(text) else self._encode(text)).tobytes()


_WORDS: dict[str, WordIds] = {}


def _encoder(path: str) -> WordIds:
    if path not in _WORDS:
        _WORDS[path] = WordIds(path)
    return _WORDS[path]


def _ids(encoder: WordIds, texts: pa.Array) -> Iterator[np.ndarray]:
    """Token ids of each text, the end id included."""
    end = np.array([END_ID], dtype="<u4").tobytes()
    data, offsets = batch_bytes(texts)
    whole = data.tobytes()
    for ids in encoder.texts([whole[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]):
        yield np.frombuffer(ids + end, dtype="<u4")


class _Writer:
    """A shard on its way into its file, under another name until it is whole."""

    def __init__(self, uri: str, vocabulary: int, block_tokens: int, section_tokens: int):
        self.store, self.path = filesystem(uri)
        self.draft = f"{self.path}.{uuid.uuid4().hex[:12]}"
        self.out = None
        self.vocabulary, self.block_tokens, self.section_tokens = vocabulary, block_tokens, section_tokens
        self.docs = self.tokens = self.bytes = 0
        self.units: list[dict[str, int]] = []
        self.waiting: list[tuple[list, list[int], np.ndarray, bool]] = []  # blocks of the section: ids, sizes, tokens, continues
        self.waiting_tokens = 0
        self.continuing = False
        self._new_block()

    def _new_block(self) -> None:
        self.ids, self.sizes, self.held, self.held_tokens = [], [], [], 0

    def add(self, doc_id: int | None, tokens: np.ndarray) -> None:
        self.docs += 1
        if self.held and self.held_tokens + len(tokens) > self.block_tokens:
            self._end_block(False)
        for i in range(0, len(tokens), self.block_tokens):
            part = tokens[i : i + self.block_tokens]
            self.ids.append(doc_id)
            self.sizes.append(len(part))
            self.held.append(part)
            self.held_tokens += len(part)
            if i + self.block_tokens < len(tokens):
                self._end_block(True)

    def _end_block(self, continues: bool) -> None:
        # block by block, so that neither the texts' own arrays nor a second copy of the section wait
        tokens = np.concatenate(self.held).astype(np.uint16 if self.vocabulary <= 1 << 16 else np.uint32)
        self.waiting.append((self.ids, self.sizes, tokens, continues))
        self.waiting_tokens += self.held_tokens
        self._new_block()
        if self.waiting_tokens >= self.section_tokens:
            self._end_section()

    def _write(self, data: bytes) -> None:
        if self.out is None:
            self.store.create_dir(self.path.rpartition("/")[0], recursive=True)
            self.out = self.store.open_output_stream(self.draft)
        self.out.write(data)
        self.bytes += len(data)

    def _end_section(self) -> None:
        if not self.waiting:
            return
        counts = np.zeros(self.vocabulary, dtype=np.int64)
        blocks_, self.waiting, self.waiting_tokens = self.waiting, [], 0
        for _, _, tokens, _ in blocks_:
            counts += np.bincount(tokens, minlength=self.vocabulary)
        table = Table.of(frequencies(counts))
        record, at = table.pack(), self.bytes
        self._write(record)
        if self.continuing:  # the unit before goes on behind this table
            self.units[-1]["length"] += len(record)
        for ids, sizes, tokens, continues in blocks_:
            made = block(table, ids, sizes, tokens, continues)
            if self.continuing:
                self.units[-1]["length"] += len(made)
            else:
                self.units.append({"offset": self.bytes, "length": len(made), "first_token": self.tokens, "table_offset": at, "table_length": len(record)})
            self._write(made)
            self.tokens += len(tokens)
            self.continuing = continues

    def close(self) -> bool:
        """Finish the file; false if there was nothing to write."""
        if self.held:
            self._end_block(False)
        self._end_section()
        if self.out is None:
            return False
        self.out.close()
        self.store.move(self.draft, self.path)
        return True


def _encode(path: str, vocabulary: int, folder: str, block_tokens: int, section_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        shard = TaskContext.get().partitionId()
        uri = f"{folder}/shard-{shard:06d}.rma"
        writer = _Writer(uri, vocabulary, block_tokens, section_tokens)
        try:
            for batch in (part for some in batches for part in slices(some, SPLIT_BYTES, column=1)):
                for doc_id, tokens in zip(batch.column(0).to_pylist(), _ids(encoder, batch.column(1)), strict=True):
                    writer.add(doc_id, tokens)
            whole = writer.close()
        finally:
            encoder.forget()
        if whole:
            kind = pa.list_(pa.struct([(n, pa.int64()) for n in ("offset", "length", "first_token", "table_offset", "table_length")]))
            totals = [pa.array([n], type=pa.int64()) for n in (writer.docs, writer.tokens, writer.bytes)]
            row = [pa.array([shard], type=pa.int32()), pa.array([uri]), *totals, pa.array([writer.units], type=kind)]
            yield pa.RecordBatch.from_arrays(row, names=["shard", "uri", "n_docs", "n_tokens", "n_bytes", "units"])

    return run


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at_table, table = None, None
    for batch in batches:
        for row in batch.to_pylist():
            store, path = filesystem(row["uri"])
            with store.open_input_file(path) as source:
                if at_table != (row["uri"], row["table_offset"]):
                    source.seek(row["table_offset"])
                    table, _ = Table.unpack(source.read(row["table_length"]))
                    at_table = (row["uri"], row["table_offset"])
                source.seek(row["offset"])
                data = source.read(row["length"])
            docs: list[list] = []
            going, at = False, row["first_token"]
            for ids, sizes, tokens, continues in blocks(table, data):
                raw, end = tokens.astype("<u4"), np.cumsum(sizes)
                for k, (doc_id, size, stop) in enumerate(zip(ids, sizes.tolist(), end.tolist(), strict=True)):
                    part = raw[stop - size : stop].tobytes()
                    if going and k == 0:
                        docs[-1][2] += size
                        docs[-1][3] = zlib.crc32(part, docs[-1][3])
                    else:
                        docs.append([doc_id, at, size, zlib.crc32(part)])
                    at += size
                going = continues
            columns = zip(*docs, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in columns], names=["doc_id", "first_token", "n_tokens", "ids_crc32"])


def write_tokens(
    docs: DataFrame,
    tokenizer: str,
    folder: str,
    shard_bytes: int = SHARD_BYTES,
    block_tokens: int = BLOCK_TOKENS,
    section_tokens: int = SECTION_TOKENS,
) -> DataFrame:
    """Encode ``docs`` into ``folder``; the manifest of the shards, which is also kept there as Parquet.

    Shards follow each other in ascending ``doc_id``, null ids first.
    """
    from tokenizers import Tokenizer

    spark = prepare(docs.sparkSession)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    vocabulary = max(Tokenizer.from_file(tokenizer).get_vocab_size(), END_ID + 1)
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-size // shard_bytes))
    ordered = source.repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", "text")
    made = ordered.mapInArrow(_encode(tokenizer, vocabulary, folder, block_tokens, section_tokens), MANIFEST)
    made.write.mode("overwrite").parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, decoded from the files in ``folder``."""
    prepare(spark)
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    before = F.coalesce(F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each shard
    units = manifest.withColumn("before", before).select("uri", "before", F.explode("units").alias("u"))
    units = units.select("uri", "u.offset", "u.length", "u.table_offset", "u.table_length", (F.col("before") + F.col("u.first_token")).alias("first_token"))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    units = units.repartition(tasks, "uri", "offset").sortWithinPartitions("uri", "table_offset")
    return units.mapInArrow(_decode, DOCUMENTS).withColumnRenamed("first_token", "start")


def token_output(docs: DataFrame, tokenizer: str, folder: str | None = None) -> DataFrame:
    """Write the ids of all texts and read them back: ``doc_id, start, n_tokens, ids_crc32``.

    ``start`` is the number of ids of all documents before it, ``ids_crc32`` the unsigned crc32 of the
    ids as little-endian unsigned 32-bit numbers; the end id counts. A null text is empty and has
    the end id alone. Null ids come first; rows with the same id follow each other in the order of
    their texts, and each keeps its own result. An empty table gives an empty result.
    """
    spark = prepare(docs.sparkSession)
    folder = folder or Scratch(spark, "tokens").root
    write_tokens(docs, tokenizer, folder)
    return read_tokens(spark, folder)
