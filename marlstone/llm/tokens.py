"""Token ids as ORC files.

Documents are dealt by ranges of their id, encoded in that order and written as ORC: the integer writer run-length
encodes ids, row indexes and a Bloom filter on the id let a reader skip stripes, and stripes can be read in parallel.
Each row carries its shard, its place in the shard and the tokens before it there, so positions in the whole stream
need only one total per shard.

Edge cases: a null text is an empty text, so its row holds only the end id; a null id sorts first; repeated ids are
separate rows, ordered by a hash of their text; an empty table gives a folder without rows; other columns are not read.
"""

from __future__ import annotations

import zlib
from unicodedata import is_normalized

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.common import text_batches, utf8

#: Distinct words of each of two generations whose ids a worker remembers, and the longest that it remembers, in bytes.
REMEMBERED, LONGEST = 350_000, 64
#: Bytes of text that are encoded at once; the arrays of a piece take several times as much.
PIECE_BYTES = 2 << 20

#: Byte-level models write bytes as characters: printable ones as themselves, the others as characters from U+0100 on.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_CHARACTERS = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}
_PLAIN_END = b".,;:!?"
#: Ids as four bytes.
_FOUR = [k.to_bytes(4, "little") for k in range(1 << 16)]
_ENCODERS: dict[str, Encoder] = {}


class _Ids(dict):
    """Ids of chunks, as bytes; a chunk that is missing is encoded when it is asked for. Long chunks are not kept."""

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenizer, self.before, self.remembered = tokenizer, {}, REMEMBERED

    def __missing__(self, chunk: bytes) -> bytes:
        ids = self.before.get(chunk)
        if ids is None:
            stem = chunk.rstrip(_PLAIN_END)
            if len(stem) != len(chunk) and stem[-1:].isalpha():
                ids = self[stem] + self[chunk[len(stem) :]]
            else:
                ids = b"".join([_FOUR[i] for i in self._encoded(chunk)])
        if len(chunk) <= LONGEST:
            self[chunk] = ids
        return ids

    def _encoded(self, chunk: bytes) -> list[int]:
        """A lower-case Latin word that is composed already passes the normaliser unchanged and is one piece, so the
        tokenizer's model can encode it at once."""
        text = chunk.decode("utf-8", "replace")
        if len(chunk) <= LONGEST and text.isalpha() and text.islower():
            if chunk.isascii():
                return [t.id for t in self.tokenizer.model.tokenize(text)]
            if max(text) < "\u0250" and is_normalized("NFC", text):
                return [t.id for t in self.tokenizer.model.tokenize(chunk.decode("latin-1").translate(_BYTE_CHARACTERS))]
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def forget(self) -> None:
        """Begin a new generation of known chunks once there are many."""
        if len(self) > self.remembered:
            self.before = {}  # freed before the copy is made
            self.before = dict(self)
            self.clear()


class Encoder:
    """Encodes whole texts by their chunks between ASCII white space.

    The tokenizer turns white space into one space and drops it, and no token spans it, so the ids of a text are those
    of its chunks in order. It lower-cases, so A-Z may be lower-cased before, but for texts that could hold the name of
    a special token in other case; and it parts letters from punctuation, so plain punctuation after a letter can be
    encoded apart. A tokenizer that does not is refused when it is loaded. The distinct chunks of a batch are encoded
    once, those seen in one of the last batches not at all: a chunk not seen since the generation before last is
    forgotten."""

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        check_tokenizer(tokenizer)
        self.ids = _Ids(tokenizer)

    @classmethod
    def of(cls, path: str) -> Encoder:
        """The encoder of this worker process, which outlives a task."""
        if path not in _ENCODERS:
            _ENCODERS[path] = cls(path)
        return _ENCODERS[path]

    def __call__(self, texts, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """For an Arrow array of strings: how many ids each text has, and the ids of all in order, each text's end id included."""
        import pyarrow as pa
        import pyarrow.compute as pc

        self.ids.forget()
        plain = pc.fill_null(pc.ascii_lower(texts), "")
        special = pc.match_substring(texts, "<|")
        if pc.any(special).as_py():
            plain = pc.if_else(pc.fill_null(special, False), pc.fill_null(texts, ""), plain)
        chunks = pc.ascii_split_whitespace(plain)
        offsets = chunks.offsets.to_numpy()
        flat = chunks.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
        offsets = offsets - offsets[0]
        words = flat.dictionary.cast(pa.large_binary())
        edges = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1].tolist()
        data = words.buffers()[2].to_pybytes() if len(words) else b""
        distinct = list(map(self.ids.__getitem__, [data[a:b] for a, b in zip(edges, edges[1:])]))
        #: one more chunk, the end, behind those of each text
        at = np.insert(flat.indices.to_numpy().astype(np.int64), offsets[1:], len(distinct))
        distinct.append(_FOUR[end_id])
        sizes = np.fromiter(map(len, distinct), np.int64, len(distinct)) // 4
        starts = np.cumsum(sizes) - sizes
        many = sizes[at]
        upto = np.cumsum(many)
        values = np.frombuffer(b"".join(distinct), "<i4")[np.repeat(starts[at] - (upto - many), many) + np.arange(upto[-1] if len(upto) else 0)]
        ends = np.concatenate([[0], upto])[offsets[1:] + np.arange(1, len(offsets))]
        return np.diff(ends, prepend=0), values


#: Texts on which the assumptions of `Encoder` are tried.
_TRIALS = ("Some Words, AND more; of them!", "a\tb\n c  d.", "x.y z?", "naïve ÉTÉ. Straße:", "end.. of")


def check_tokenizer(tokenizer) -> None:
    """Refuse a tokenizer that keeps letter case or white space, or whose tokens span white space or a word's end."""
    encode = lambda t: tokenizer.encode(t, add_special_tokens=False).ids
    for text in _TRIALS:
        lower = text.encode().lower().decode()
        parts = [i for c in lower.split() for p in (c.rstrip(".,;:!?"), c[len(c.rstrip(".,;:!?")) :]) for i in encode(p)]
        if not encode(text) == encode(lower) == parts:
            raise ValueError("the tokenizer must lower-case, drop white space and part words from the punctuation behind them")


def _pieces(batch, column: int):
    """Slices of a batch, of about PIECE_BYTES of text each and of one row at least."""
    import pyarrow.compute as pc

    upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    edges = [0, *(np.flatnonzero(np.diff(upto // PIECE_BYTES)) + 1).tolist(), len(batch)]
    for a, b in zip(edges, edges[1:]):
        yield batch.slice(a, b - a)


def _encode(path: str, end_id: int, id_col: str, text_col: str, remembered: int):
    import pyarrow as pa

    def run(batches):
        from pyspark import TaskContext

        encoder, shard, row, before = Encoder.of(path), TaskContext.get().partitionId(), 0, 0
        encoder.ids.remembered = remembered
        for batch in (piece for whole in batches for piece in _pieces(whole, whole.schema.names.index(text_col))):
            sizes, values = encoder(batch.column(batch.schema.names.index(text_col)), end_id)
            n, starts = len(sizes), np.concatenate([[0], np.cumsum(sizes)])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(batch.schema.names.index(id_col)),
                    pa.array(np.full(n, shard, np.int32)),
                    pa.array(np.arange(row, row + n)),
                    pa.array(before + starts[:-1]),
                    pa.array(sizes),
                    pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(values)),
                ],
                [id_col, "shard", "row_in_shard", "start_in_shard", "n_tokens", "ids"],
            )
            row, before = row + n, before + int(starts[-1])

    return run


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", stripe_bytes: int = 64 << 20, shards: int | None = None, remembered: int = REMEMBERED) -> None:
    """Encode every document and write `path`, in ascending id order over shards (by default as many as shuffle partitions).

    A worker remembers the ids of up to about twice `remembered` words, at some 170 bytes each; others are encoded again."""
    text_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    dealt = docs.select(id_col, text_col).repartitionByRange(*([shards] if shards else []), F.col(id_col), F.xxhash64(text_col)).sortWithinPartitions(F.col(id_col), F.xxhash64(text_col))
    rows = dealt.mapInArrow(
        _encode(tokenizer_path, end_id, id_col, text_col, remembered),
        f"`{id_col}` {kind}, shard int, row_in_shard long, start_in_shard long, n_tokens long, ids array<int>",
    )
    rows.write.options(
        **{
            "compression": "zstd",
            "orc.create.index": "true",
            "orc.row.index.stride": "1000",
            "orc.stripe.size": str(stripe_bytes),
            "orc.bloom.filter.columns": id_col,
            "orc.bloom.filter.fpp": "0.01",
        }
    ).orc(path)


def read_token_files(spark: SparkSession, path: str, id_col: str = "doc_id", kind: str = "bigint") -> DataFrame:
    schema = f"`{id_col}` {kind}, shard int, row_in_shard long, start_in_shard long, n_tokens long, ids array<int>"
    return spark.read.schema(schema).orc(path)


def _digest(id_col: str):
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            lists = batch.column(batch.schema.names.index("ids"))
            values = lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
            at = lists.offsets.to_numpy()
            sums = np.array([zlib.crc32(values[a:b]) for a, b in zip(at[:-1], at[1:])], np.int64)
            keep = [batch.column(batch.schema.names.index(c)) for c in (id_col, "shard", "start_in_shard")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(np.diff(at).astype(np.int64)), pa.array(sums)], [id_col, "shard", "start_in_shard", "n_tokens", "ids_crc32"])

    return run


def token_index(files: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row a document, from the files: id, start (tokens of all documents before it), n_tokens, ids_crc32.

    The driver sums one total per shard; there are as many shards as tasks that wrote."""
    spark, kind = files.sparkSession, files.schema[id_col].dataType.simpleString()
    text_batches(spark)
    totals = files.groupBy("shard").agg(F.sum("n_tokens").alias("n")).orderBy("shard").collect()
    before, offsets = 0, []
    for shard, n in totals:
        offsets.append((shard, before))
        before += n
    table = spark.createDataFrame(offsets, "shard int, shard_offset long")
    rows = files.select(id_col, "shard", "start_in_shard", "ids").mapInArrow(_digest(id_col), f"`{id_col}` {kind}, shard int, start_in_shard long, n_tokens long, ids_crc32 long")
    return rows.join(F.broadcast(table), "shard").select(id_col, (F.col("shard_offset") + F.col("start_in_shard")).alias("start"), "n_tokens", "ids_crc32")
