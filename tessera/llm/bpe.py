"""Byte-level BPE encoding and decoding with a local rank file."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession

from .common import long_array, map_columns, table, texts

#: Texts are encoded in pieces of about this many code points.
PIECE = 1 << 16
#: No token of the pattern reaches over the place between a word character and a space or line feed: only white space
#: at a token's start is ever matched, and what a token before that place matches doesn't depend on what follows it.
_SAFE = re.compile(r"(?<=\w)(?=[ \n])")


def read_ranks(spark: SparkSession, path: str) -> dict[bytes, int]:
    """The ranks of a file in tiktoken's format (about 1 MB), by any path that Spark reads."""
    rows = spark.read.text(path).collect() if "://" in path else [(x,) for x in open(path, encoding="ascii")]
    return {base64.b64decode(a): int(b) for a, b in (row[0].split() for row in rows if row[0].strip())}


def pieces(text: str, size: int = PIECE) -> list[str]:
    """text, cut at safe boundaries; a stretch without one stays whole, however long."""
    out, at = [], 0
    while len(text) - at > size:
        cut = _SAFE.search(text, at + size)
        if cut is None:
            break
        out.append(text[at : cut.start()])
        at = cut.start()
    return [*out, text[at:]]


class Codec:
    """Encodes and decodes; a worker builds it once from the broadcast ranks."""

    _held: tuple = (None, None)

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.encoding = tiktoken.Encoding("local ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.bytes_of = {i: b for b, i in ranks.items()}

    @classmethod
    def of(cls, shared, pattern: str) -> Codec:
        if cls._held[0] is not shared:
            cls._held = (shared, cls(shared.value, pattern))
        return cls._held[1]

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        for piece in pieces(text):
            ids += self.encoding.encode_ordinary(piece)
        return ids

    def decode(self, ids: list[int]) -> bytes:
        """The bytes of ids. They need not be valid UTF-8: a cut of a text's ids decodes too."""
        return b"".join(map(self.bytes_of.__getitem__, ids))


def _coder(spark: SparkSession, path: str, pattern: str) -> Callable[[], Codec]:
    # The rank file's size is the bound of this broadcast: it holds one entry per id of the vocabulary.
    shared = spark.sparkContext.broadcast(read_ranks(spark, path))
    return lambda: Codec.of(shared, pattern)


def _encoded(coder: Callable[[], Codec]) -> Callable[[pa.RecordBatch], pa.RecordBatch]:
    """Batches (id, text) to batches (id, ids); a document's ids are Python integers only while it is encoded."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        codec, parts = coder(), [np.zeros(0, np.int32)]
        for text in texts(batch.column(1)):
            parts.append(np.array(codec.encode(text), np.int32))
        offsets = np.cumsum([len(p) for p in parts]).astype(np.int32)
        ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(parts), pa.int32()))
        return pa.RecordBatch.from_arrays([batch.column(0), ids], names=["id", "ids"])

    return run


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, ids array<int>), a row for each of docs. A null text has no ids; an id may be null or repeat; rows stay
    apart. Other columns are not read."""
    kind = docs.select(id_col).dtypes[0][1]
    return map_columns(docs.select(id_col, text_col), _encoded(_coder(docs.sparkSession, path, pattern)), f"id {kind}, ids array<int>")


def decode(tokens: DataFrame, path: str, pattern: str) -> DataFrame:
    """Rows (id, bytes binary) of rows (id, ids); null ids are none."""
    coder = _coder(tokens.sparkSession, path, pattern)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        codec = coder()
        out = pa.array([codec.decode(x or []) for x in batch.column(1).to_pylist()], pa.binary())
        return pa.RecordBatch.from_arrays([batch.column(0), out], names=["id", "bytes"])

    return map_columns(tokens.select("id", "ids"), run, f"id {tokens.select('id').dtypes[0][1]}, bytes binary")


def default_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document the number of ids, their digest (little-endian unsigned 32-bit integers), and that of what they decode to.
    Digests are taken where the ids are made, batch by batch."""
    path, pattern = default_vocabulary()
    coder = _coder(spark, path, pattern)
    encoded = _encoded(coder)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        codec, tokens, n, hashes, decoded = coder(), encoded(batch), [], [], []
        for ids in tokens.column(1):
            held = ids.values.to_numpy(zero_copy_only=False)
            n.append(len(held))
            hashes.append(hashlib.sha256(held.astype("<u4").tobytes()).hexdigest())
            decoded.append(hashlib.sha256(codec.decode(held.tolist())).hexdigest())
        return pa.RecordBatch.from_arrays([tokens.column(0), long_array(n), pa.array(hashes, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return map_columns(docs, run, f"doc_id {docs.dtypes[0][1]}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pipeline's last stage: (doc_id, n_tokens, ids) of every document."""
    from pyspark.sql import functions as F

    coded = encode(docs, *default_vocabulary())
    return coded.select(F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"), "ids")
