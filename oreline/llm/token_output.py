"""Token ids as binary files: frequency-ranked, byte-aligned, with separate control bytes.

Ids are replaced by their frequency rank over the whole corpus, so that common ids take one
byte.  A block holds whole documents in ascending id order: one control byte per four ranks
(two bits each, the number of bytes less one) and, apart from them, the ranks' bytes (Lemire
et al., 2017).  Decoding looks control bytes up in numpy tables.

Files: ``<path>/blocks``, Parquet rows ``shard, block, doc_ids, n_tokens, control, data``, and
``<path>/ranks``, the id of each rank.  Spark writes them, so a lost executor's files are
written again and only whole ones count.  Shards are ranges of ids: the text is shuffled once,
by id (repeated ids by text as well), sorted, encoded and streamed into blocks.  As ranks need
all counts first, the blocks wait in the scratch folder, compressed, and each is then counted
and packed by itself.

What reaches the driver is the count of each id, at most the vocabulary.  A null text is
empty and has just the end id.  Rows without an id come first; repeated ids are ordered by
text and each keep a row.
"""

from __future__ import annotations

import os
import string
import unicodedata
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from oreline.llm.common import arrow_map, give_back
from oreline.sources.paths import stored

END_ID = 1
BLOCK_TOKENS = 1 << 20
# Remembered words, in bytes: of a word itself, its ids and the entry; some million words.
_CACHE_BYTES, _ENTRY_BYTES = 1 << 28, 200

_BYTES = np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3
_LENGTH = (_BYTES + 1).astype(np.int64)
_OFFSET = np.cumsum(_LENGTH, 1) - _LENGTH
_TOTAL = _LENGTH.sum(1)
_MASK = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)


def _ends_in_letter(word: str) -> bool:
    """Also when normalised and lower-cased, which may part a mark from its letter."""
    return (word if word.isascii() else unicodedata.normalize("NFC", word).lower())[-1].isalpha()


class _Words(dict):
    """Ids of words, looked up or else worked out.  When half full with new ones it forgets those
    that were not met since it was half full before, and the frequent ones stay."""

    def __init__(self, tokenizer):
        super().__init__()
        self._size, self._before = 0, {}
        self._tokenizer, self._model = tokenizer, tokenizer.model

    def __missing__(self, word: str) -> bytes:
        ids = self._before.get(word)
        if ids is None:
            ids = self._worked_out(word)
        size = _ENTRY_BYTES + 4 * len(word) + len(ids)
        if size > _CACHE_BYTES // 64:
            return ids
        if self._size + size > _CACHE_BYTES // 2:
            self._before = dict(self)
            self.clear()
            self._size = 0
        self._size += size
        self[word] = ids
        return ids

    def _worked_out(self, word: str) -> bytes:
        # What is spelt out here the tokenizer does itself: it lower-cases, marks after a
        # letter are a piece of their own, and a-z go to its model as they are.  Most words
        # thereby come from one already known, or cost a third of a whole encoding.  (Special
        # tokens are told by case and marks, so words that may hold one are left alone.)
        stem = word.rstrip(string.punctuation)
        if word.isascii() and word.isalpha():
            if word.islower():
                return array("I", [t.id for t in self._model.tokenize(word)]).tobytes()
            return self[word.lower()]
        if stem and stem != word and _ends_in_letter(stem) and "<|" not in word:
            return self[stem] + self[word[len(stem) :]]
        return array("I", self._tokenizer.encode(word, add_special_tokens=False).ids).tobytes()


class Encoder:
    """Texts to ids.  ``by_word`` is for tokenizers that lower-case, drop white space, split
    marks from letters and take a-z unchanged, as the default does: each word between blanks is worked out once
    and remembered.  Any other tokenizer gets whole texts."""

    _made: dict = {}

    def __init__(self, path: str, by_word: bool):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._words = _Words(self._tokenizer) if by_word else None

    @classmethod
    def of(cls, path: str, by_word: bool) -> Encoder:
        """One per worker process."""
        if (path, by_word) not in cls._made:
            cls._made[path, by_word] = cls(path, by_word)
        return cls._made[path, by_word]

    def ids(self, text: str | None, end_id: int) -> np.ndarray:
        end = np.array([end_id], "<u4").tobytes()
        if not text:
            return np.frombuffer(end, "<u4")
        if self._words is None:
            found = self._tokenizer.encode(text, add_special_tokens=False).ids
            return np.array([*found, end_id], "<u4")
        words = text.replace("\n", " ").split(" ")
        return np.frombuffer(b"".join(map(self._words.__getitem__, words)) + end, "<u4")


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of 32-bit numbers."""
    ranks = np.ascontiguousarray(ranks, "<u4")
    code = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    padded = np.zeros(-(-len(code) // 4) * 4, np.uint8)
    padded[: len(code)] = code
    quads = padded.reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    data = ranks.view(np.uint8).reshape(-1, 4)[np.arange(4) <= code[:, None]]
    return control.astype(np.uint8).tobytes(), data.tobytes()


def unpack(control: bytes, data: bytes, count: int) -> np.ndarray:
    """The numbers again, by table lookup on the control bytes."""
    control = np.frombuffer(control, np.uint8)
    total = _TOTAL[control]
    at = ((np.cumsum(total) - total)[:, None] + _OFFSET[control]).ravel()[:count]
    length = _LENGTH[control].ravel()[:count]
    data = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(4, np.uint8)])
    out = data[at].astype(np.uint32)
    for k in (1, 2, 3):
        more = length > k
        if more.any():
            out[more] |= data[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out & _MASK[length]


_BLOCK = "shard int, block int, doc_ids array<bigint>, n_tokens array<bigint>, "


def _encoded(docs: DataFrame, path: str, by_word: bool, end_id: int) -> DataFrame:
    """``docs`` (doc_id, text, shard; sorted) as blocks of compressed ids."""
    names = ["shard", "block", "doc_ids", "n_tokens", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, pack_ids = Encoder.of(path, by_word), zstandard.ZstdCompressor(level=3)
        shard, block, held, parts, waiting = 0, 0, [], [], 0

        def full() -> pa.RecordBatch:
            columns = [
                pa.array([shard], pa.int32()),
                pa.array([block], pa.int32()),
                pa.array([held], pa.list_(pa.int64())),
                pa.array([[len(p) for p in parts]], pa.list_(pa.int64())),
                pa.array([pack_ids.compress(np.concatenate(parts).tobytes())]),
            ]
            return pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            shard = batch.column(2)[0].as_py()
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                parts.append(encoder.ids(text.as_py(), end_id))
                held.append(doc)
                waiting += len(parts[-1])
                if waiting >= BLOCK_TOKENS:
                    yield full()
                    block, held, parts, waiting = block + 1, [], [], 0
        if held:
            yield full()
        give_back()

    return docs.mapInArrow(run, _BLOCK + "ids binary")


def _unpacked_ids(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    unpack_ids = zstandard.ZstdDecompressor()
    for value in batch.column("ids"):
        yield np.frombuffer(unpack_ids.decompress(value.as_py()), "<u4")


def _count(blocks: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for ids in _unpacked_ids(batch):
                n = np.bincount(ids, minlength=len(total))
                n[: len(total)] += total
                total = n
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total[ids])], ["id", "n"])

    counts = blocks.select("ids").mapInArrow(run, "id bigint, n bigint")
    return counts.groupBy("id").agg(F.sum("n").alias("n"))


def _ranked(blocks: DataFrame, shared) -> DataFrame:
    def run(batch):
        packed = [pack(shared.value[ids]) for ids in _unpacked_ids(batch)]
        return {
            **{c: batch.column(c) for c in ("shard", "block", "doc_ids", "n_tokens")},
            "control": [c for c, _ in packed],
            "data": [d for _, d in packed],
        }

    return arrow_map(blocks, run, _BLOCK + "control binary, data binary")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def write_tokens(
    docs: DataFrame,
    path: str,
    tokenizer: str | None = None,
    by_word: bool = True,
    end_id: int = END_ID,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> None:
    """Encode ``docs`` into the files described above, below ``path`` on shared storage."""
    spark, tokenizer = docs.sparkSession, tokenizer or default_tokenizer()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = dealt.withColumn("shard", F.spark_partition_id())
    blocks = stored(_encoded(dealt, tokenizer, by_word, end_id), "encoded")
    counts = _count(blocks).toPandas().sort_values(["n", "id"], ascending=[False, True])
    ids = counts["id"].to_numpy(np.int64)
    rank = np.zeros(int(ids.max(initial=0)) + 1, np.uint32)
    rank[ids] = np.arange(len(ids))
    table = spark.createDataFrame([(i, int(d)) for i, d in enumerate(ids)], "rank int, id bigint")
    table.coalesce(1).write.parquet(f"{path}/ranks")
    ranked = _ranked(blocks, spark.sparkContext.broadcast(rank))
    ranked.write.option("compression", "zstd").parquet(f"{path}/blocks")


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` per document, from the files; ``with_ids`` adds
    the ids (little-endian, 32 bits each)."""
    ranks = spark.read.schema("rank int, id bigint").parquet(f"{path}/ranks").toPandas()
    ids = np.zeros(len(ranks), "<u4")
    ids[ranks["rank"].to_numpy()] = ranks["id"].to_numpy()
    shared = spark.sparkContext.broadcast(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                sizes = np.array(row["n_tokens"], np.int64)
                ends = np.cumsum(sizes)
                back = shared.value[unpack(row["control"], row["data"], int(ends[-1]))]
                pieces = [back[e - n : e].tobytes() for e, n in zip(ends, sizes)]
                n = len(sizes)
                columns = [
                    pa.array(np.full(n, row["shard"], np.int32)),
                    pa.array(np.full(n, row["block"], np.int32)),
                    pa.array(row["doc_ids"], pa.int64()),
                    pa.array(ends - sizes),
                    pa.array(sizes),
                    pa.array([zlib.crc32(p) for p in pieces], pa.int64()),
                ]
                names = ["shard", "block", "doc_id", "within", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array(pieces, pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    blocks = spark.read.schema(_BLOCK + "control binary, data binary").parquet(f"{path}/blocks")
    schema = "shard int, block int, doc_id bigint, within bigint, n_tokens bigint, ids_crc32 bigint"
    docs = blocks.mapInArrow(run, schema + (", ids binary" if with_ids else ""))
    size = F.aggregate("n_tokens", F.lit(0).cast("bigint"), lambda a, n: a + n)
    each = blocks.select("shard", "block", size.alias("size"))
    inside = F.sum("size").over(Window.partitionBy("shard").orderBy("block")) - F.col("size")
    shards = each.groupBy("shard").agg(F.sum("size").alias("whole"))
    before = F.sum("whole").over(Window.orderBy("shard")) - F.col("whole")
    shards = shards.select("shard", before.alias("before"))
    base = each.select("shard", "block", inside.alias("inside")).join(shards, "shard")
    base = base.select("shard", "block", (F.col("before") + F.col("inside")).alias("base"))
    return docs.join(base, ["shard", "block"]).select(
        "doc_id",
        (F.col("base") + F.col("within")).alias("start"),
        "n_tokens",
        "ids_crc32",
        *(["ids"] if with_ids else []),
    )
