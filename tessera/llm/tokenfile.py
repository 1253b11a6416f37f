"""Token-id files of byte or bit planes.

A file holds the ids of a range of documents in ascending doc_id order. Blocks of BLOCK ids are transposed into planes (plane k
has byte k, or bit k, of every id), each plane is compressed with zstandard, and an index at the file's end says where each block
and plane lies and how many ids it has; planes of zeros take no space. The documents' ids and lengths are two more sections.

    b"TPLANES1" | block planes ... | doc_ids | lengths | index (JSON) | index length (8 bytes) | b"TPLANES1"

Files are written by the executors under a name of their own and then renamed, so a task that runs twice leaves one file."""

from __future__ import annotations

import json
import os
import re
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import long_array, new_folder, raw_texts, table, written

MAGIC, BLOCK, LEVEL = b"TPLANES1", 1 << 16, 1
#: Pre-tokens of a generation whose ids a worker keeps; it keeps two.
MOST_WORDS = 300_000

# ---------------------------------------------------------------- planes


def to_planes(ids: np.ndarray, bits: bool = False) -> list[bytes]:
    """The planes of 32-bit ids, lowest first; a plane of zeros is empty."""
    raw = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if bits:
        rows = np.packbits(np.unpackbits(raw, axis=1, bitorder="little").T, axis=1, bitorder="little")
    else:
        rows = np.ascontiguousarray(raw.T)
    return [r.tobytes() if r.any() else b"" for r in rows]


def from_planes(planes: list[bytes], n: int) -> np.ndarray:
    if len(planes) == 32:
        rows = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little") if p else np.zeros(n, np.uint8) for p in planes])
        return np.packbits(rows.T, axis=1, bitorder="little").reshape(-1).view("<u4")
    rows = np.stack([np.frombuffer(p, np.uint8) if p else np.zeros(n, np.uint8) for p in planes])
    return np.ascontiguousarray(rows.T).reshape(-1).view("<u4")


class Writer:
    """Writes one file from a stream of (doc_id, ids as little-endian 32-bit integers); memory is bounded by a block and a
    document, besides 16 bytes a document."""

    def __init__(self, out, bits: bool = False):
        self.out, self.bits, self.at = out, bits, len(MAGIC)
        self.blocks: list[dict] = []
        self.docs: list[int | None] = []
        self.lengths: list[int] = []
        self.held, self.size, self.squeeze = [], 0, zstandard.ZstdCompressor(level=LEVEL)
        out.write(MAGIC)

    def _put(self, data: bytes) -> int:
        packed = self.squeeze.compress(data) if data else b""
        self.out.write(packed)
        self.at += len(packed)
        return len(packed)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.docs.append(doc_id)
        self.lengths.append(len(ids) // 4)
        self.held.append(ids)
        self.size += len(ids) // 4
        if self.size >= BLOCK:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.frombuffer(b"".join(self.held), "<u4")
        end = len(ids) if last else len(ids) // BLOCK * BLOCK
        for k in range(0, end, BLOCK):
            block, start = ids[k : min(k + BLOCK, end)], self.at
            self.blocks.append({"at": start, "n": len(block), "planes": [self._put(p) for p in to_planes(block, self.bits)]})
        self.held, self.size = [ids[end:].tobytes()], len(ids) - end

    def close(self) -> tuple[int, int]:
        """(documents, ids) written."""
        self._flush(True)
        index: dict = {"blocks": self.blocks, "n_docs": len(self.docs), "n_ids": sum(self.lengths), "null_docs": [k for k, d in enumerate(self.docs) if d is None]}
        for name, values in (("doc_ids", [d or 0 for d in self.docs]), ("lengths", self.lengths)):
            index[name] = {"at": self.at, "size": self._put(np.array(values, "<i8").tobytes())}
        tail = json.dumps(index).encode()
        self.out.write(tail + len(tail).to_bytes(8, "little") + MAGIC)
        return len(self.docs), index["n_ids"]


def read_index(file) -> dict:
    size = file.size()
    end = file.read_at(16, size - 16)
    if end[8:] != MAGIC or file.read_at(len(MAGIC), 0) != MAGIC:
        raise ValueError("not a token-id file")
    n = int.from_bytes(end[:8], "little")
    return json.loads(file.read_at(n, size - 16 - n))


def read_block(file, block: dict) -> np.ndarray:
    """The ids of one block; the index makes each block readable alone."""
    open_up, data, planes, k = zstandard.ZstdDecompressor(), file.read_at(sum(block["planes"]), block["at"]), [], 0
    for size in block["planes"]:
        planes.append(open_up.decompress(data[k : k + size]) if size else b"")
        k += size
    return from_planes(planes, block["n"])


def read_docs(file) -> Iterator[tuple[int | None, list[bytes]]]:
    """(doc_id, its ids as bytes, in parts) in the file's order; one block is held at a time."""
    index, open_up = read_index(file), zstandard.ZstdDecompressor()

    def section(name: str) -> np.ndarray:
        size = index[name]["size"]
        return np.frombuffer(open_up.decompress(file.read_at(size, index[name]["at"])), "<i8") if size else np.zeros(0, np.int64)

    nulls, blocks = set(index["null_docs"]), iter(index["blocks"])
    ids, at = np.zeros(0, "<u4"), 0
    for k, (doc, n) in enumerate(zip(section("doc_ids").tolist(), section("lengths").tolist(), strict=True)):
        parts = []
        while n:
            if at == len(ids):
                ids, at = read_block(file, next(blocks)), 0
            take = min(n, len(ids) - at)
            parts.append(ids[at : at + take].tobytes())
            at, n = at + take, n - take
        yield (None if k in nulls else doc), parts


# ---------------------------------------------------------------- encoding

#: Texts of these characters alone are plain: composing them changes nothing and lowering them keeps their number.
#: They hold for vocabularies whose JSON says so; of others the whole tokenizer takes every text.
_PLAIN = re.compile(r"[\t-\r -~À-ÖØ-öø-ÿ]*")
#: The tokenizer's pre-tokens in lowered plain text.
_PRE_TOKENS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[!-/:-@\[-`{-~]+")


#: Fixed values of the tokenizer's JSON that the two patterns above follow.
_FOLLOWED = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
_FOLLOWED_MODEL = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": "</w>"}


def follows(model: dict) -> bool:
    """Whether a tokenizer's JSON cuts texts as _PLAIN and _PRE_TOKENS say, and marks the ends of words."""
    return all(model.get(k) == v for k, v in _FOLLOWED.items()) and all(model["model"].get(k) == v for k, v in _FOLLOWED_MODEL.items())


def _byte_letters() -> list[str]:
    """The printable character that stands for each byte in vocabularies of byte-level BPE."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    more = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(more)) for b in range(256)]


class WordEncoder:
    """Encodes with the tokenizers library, each different pre-token once.

    The tokenizer drops white space and encodes pre-tokens apart, so a plain text's ids are those of its pre-tokens one after
    another. New ones go to the library's model together, in its byte letters; each one's ids end in a vocabulary entry with the
    end-of-word mark, which tells them apart. Words with other characters go to the whole tokenizer, and so do whole texts with a
    string of an added token, and all texts if the vocabulary's JSON isn't as follows() wants it. Of the known pre-tokens the newest
    MOST_WORDS, and those used since as many came in, are kept."""

    _held: tuple = (None, None)

    def __init__(self, model: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(model)
        parts = json.loads(model)
        self.apart = follows(parts)
        added = parts.get("added_tokens") or []
        self.added = [t["content"] for t in added if not t.get("normalized")]  # found in the text as it is
        folded = [re.escape(t["content"]) for t in added if t.get("normalized")]
        self.folded = re.compile("|".join(folded), re.I) if folded else None
        if not self.apart:
            return
        parts |= {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "added_tokens": []}
        self.merger = Tokenizer.from_str(json.dumps(parts))
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        letters = _byte_letters()
        self.letters = {c: "".join(letters[b] for b in chr(c).encode()) for c in range(0xDF, 0x100)}
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    @classmethod
    def of(cls, shared) -> WordEncoder:
        if cls._held[0] is not shared:
            cls._held = (shared, cls(shared.value))
        return cls._held[1]

    def learn(self, tokens: Iterable[str]) -> None:
        """Makes pre-tokens of plain text known."""
        new = []
        for t in tokens:
            if (ids := self.older.get(t)) is None:
                new.append(t)
            else:
                self.known[t] = ids
        for k in range(0, len(new), 4096):
            part = new[k : k + 4096]
            ids = np.array(self.merger.encode_batch_fast([" ".join(part).translate(self.letters)], add_special_tokens=False)[0].ids, "<u4")
            last = np.flatnonzero(self.ends[ids])
            if len(last) != len(part):
                raise ValueError("a pre-token's ids have no end")
            data, ends = ids.tobytes(), (4 * (last + 1)).tolist()
            self.known.update(zip(part, map(data.__getitem__, map(slice, [0, *ends[:-1]], ends)), strict=True))

    def encode(self, text: bytes) -> bytes:
        """The ids of a text as little-endian 32-bit integers."""
        s = text.decode()
        if not self.apart or any(t in s for t in self.added) or (self.folded and self.folded.search(s)):
            return self._whole(s)
        if not _PLAIN.fullmatch(s):
            return b"".join([self.encode(w) if _PLAIN.fullmatch(w.decode()) else self._whole(w.decode()) for w in text.split()])
        tokens = _PRE_TOKENS.findall(s.lower())
        try:
            return b"".join(map(self.known.__getitem__, tokens))
        except KeyError:
            if len(self.known) > MOST_WORDS:
                self.known, self.older = {}, self.known
            self.learn(set(tokens).difference(self.known))
            return b"".join(map(self.known.__getitem__, tokens))

    def _whole(self, word: str) -> bytes:
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()


# ---------------------------------------------------------------- tables


def write_files(docs: DataFrame, folder: str, model: str, end_id: int = 1, bits: bool = False) -> DataFrame:
    """Writes docs (doc_id, text) as files into folder; returns their manifest (part, file, n_docs, n_ids, start), a row per
    file, start the ids in all files before it. Files hold ranges of doc_id (null first), rows of the same doc_id go by their
    texts' hash; a null text is empty and has end_id alone. Ranges are cut from all rows and split repeated ids too."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # the vocabulary file, some MB

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, end, part = WordEncoder.of(shared), end_id.to_bytes(4, "little"), TaskContext.get().partitionId()
        store, path = fs.FileSystem.from_uri(folder)
        store.create_dir(path, recursive=True)
        name, draft, writer = f"{path}/part-{part:06d}.planes", f"{path}/.draft-{part:06d}-{uuid.uuid4().hex}", None
        for batch in batches:
            # The rows of a part are in order; a task's batches may be many.
            for doc, text in zip(batch.column(0).to_pylist(), raw_texts(batch.column(1)), strict=True):
                if writer is None:
                    out = store.open_output_stream(draft)
                    writer = Writer(out, bits)
                writer.add(doc, coder.encode(text) + end)
        if writer is not None:
            n_docs, n_ids = writer.close()
            out.close()
            store.move(draft, name)
            yield pa.RecordBatch.from_arrays([long_array([part]), pa.array([f"part-{part:06d}.planes"]), long_array([n_docs]), long_array([n_ids])], names=["part", "file", "n_docs", "n_ids"])

    rows = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("tie"))
    ordered = rows.repartitionByRange(F.asc_nulls_first("doc_id"), "tie").sortWithinPartitions(F.asc_nulls_first("doc_id"), "tie").select("doc_id", "text")
    manifest = written(ordered.mapInArrow(write, "part long, file string, n_docs long, n_ids long"), "manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    return written(manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0))), "manifest")


def read_files(manifest: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, ids binary) of each document in the files: its ids as little-endian 32-bit integers, and how many ids all
    documents before it have. A task for each file, which holds a block and a few documents."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with store.open_input_file(f"{path}/{name}") as file:
                    rows, size = [], 0
                    for doc, parts in read_docs(file):
                        ids = b"".join(parts)
                        rows.append((doc, start, ids))
                        start, size = start + len(ids) // 4, size + len(ids)
                        if len(rows) == 10_000 or size > 1 << 24:
                            yield _rows(rows)
                            rows, size = [], 0
                    if rows:
                        yield _rows(rows)

    files = max(1, manifest.count())
    return manifest.select("file", "start").repartition(files).mapInArrow(read, "doc_id long, start long, ids binary")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*(pa.array([r[k] for r in rows], pa.int64()) for k in range(2)), pa.array([r[2] for r in rows], pa.binary())], names=["doc_id", "start", "ids"])


def op7_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per row of documents, read back from the files, where its ids start, how many there are, and their checksum. A null text
    has the end id alone; repeated and null ids have a row each; an empty table gives none and no file."""
    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        model = f.read()
    folder = new_folder(spark, "token-planes")
    back = read_files(write_files(table(spark, sf_dir, "documents"), folder, model), folder)
    return back.select("doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
