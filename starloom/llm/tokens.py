"""Token-ID output: one compressed frame per document, a shared zstandard dictionary and an offset index.

File format (all integers little-endian)::

    "TOKSHRD1"  sha256 of the dictionary (32 bytes)  width of an id in bytes (u1)
    frame ... frame          one zstandard frame per document, made with the shared dictionary
    index                    valid u1[n]  doc_id i8[n]  offset u8[n]  length u8[n]  n_tokens u8[n]
    index offset u8, n u8, "TOKSHRD1"

The dictionary lies beside the shards and is found and verified by its hash, so a reader can fetch one
short document with two small reads: its index entry and its frame.
"""

from __future__ import annotations

import hashlib
import os
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom.llm import files, workers
from starloom.llm.sampling import first_by_hash
from starloom.plans.durable import new_path

MAGIC = b"TOKSHRD1"
HEAD = len(MAGIC) + 32 + 1
#: Bytes of pieces and their ids that a worker remembers, from task to task, before it starts afresh.
MEMO_BYTES = 24 << 20
#: New pieces that are encoded as one text.
JOINED = 4096
#: Bytes of text encoded at a time; a longer text is one slice.
SLICE = 4 << 20
#: A task closes a shard and begins another at so many bytes of frames, or documents.
SHARD_BYTES, SHARD_DOCS = 256 << 20, 1_000_000
#: Bytes of frames, or of the ids in them, that are read back at a time; a longer document is read on its own.
READ_BYTES = 8 << 20
#: White space other than lone blanks and line feeds: such texts are handed to the tokenizer as they are.
_BLANKS = (*range(9, 10), *range(11, 14), *range(28, 32), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)


class Encoder:
    """Whole texts to id arrays, with the ids of blank-separated pieces remembered.

    A byte-level BPE never merges across a lone blank, so ``a b`` has the ids of ``a`` and of `` b``. Texts are
    cut at blanks, each distinct piece is encoded once, and a text's ids are gathered from those of its
    pieces. New pieces are encoded as one text; every piece of it begins with a token that begins with a
    blank, and no other token does. Texts where blanks meet other white space, and vocabularies that are no
    plain byte-level BPE, go whole through the tokenizer.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.kind = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.opens = np.zeros(size, bool)  # tokens that begin with a blank
        for token, i in self.tokenizer.get_vocab(with_added_tokens=True).items():
            self.opens[i] = token.startswith("Ġ")
        special = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.odd = "|".join(["[" + "".join(f"\\x{{{c:X}}}" for c in _BLANKS) + "]", "  ", " \n", "\n ", *special])
        cut, model = self.tokenizer.pre_tokenizer, self.tokenizer.model
        self.piecewise = (
            self.tokenizer.normalizer is None
            and type(cut).__name__ == "ByteLevel"
            and cut.use_regex
            and not cut.add_prefix_space
            and type(model).__name__ == "BPE"
            and not (model.dropout or model.continuing_subword_prefix or model.end_of_word_suffix)
        )
        self.forget()

    def forget(self) -> None:
        self.known = pa.array([], pa.large_string())
        self.ids, self.lengths = np.empty(0, self.kind), np.empty(0, np.int64)

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.asarray(e.ids, self.kind) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def _learn(self, new: pa.Array) -> np.ndarray:
        """Remember the ids of pieces that stand after a blank; the places that they are kept at."""
        lone = np.asarray(pc.or_(pc.equal(pc.binary_length(new), 0), pc.ends_with(new, "\n")))  # these end their text
        rest, ends = new.filter(pa.array(~lone)), new.filter(pa.array(lone))
        cuts = np.minimum(np.arange(0, len(rest) + JOINED, JOINED), len(rest)).tolist()
        ids, lengths = [], []
        for lo, hi, text in zip(cuts, cuts[1:], pc.binary_join(pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), rest), pa.scalar(" ", rest.type)), strict=False):
            got = self._whole([" " + text.as_py()])[0]
            starts = np.flatnonzero(self.opens[got])
            if len(starts) != hi - lo:
                one = self._whole([" " + p for p in rest.slice(lo, hi - lo).to_pylist()])
                got, starts = np.concatenate(one), np.cumsum([0, *map(len, one[:-1])])
            ids.append(got)
            lengths.append(np.diff(np.append(starts, len(got))))
        last = self._whole([" " + p for p in ends.to_pylist()])
        ids += last
        lengths.append(np.array([len(x) for x in last], np.int64))
        place = np.empty(len(new), np.int64)
        place[np.concatenate([np.flatnonzero(~lone), np.flatnonzero(lone)])] = len(self.known) + np.arange(len(new))
        self.known = pa.concat_arrays([self.known, rest, ends])
        self.ids, self.lengths = np.concatenate([self.ids, *ids]), np.concatenate([self.lengths, *lengths])
        return place

    def _gathered(self, texts: pa.Array) -> list[np.ndarray]:
        if self.known.nbytes + self.ids.nbytes + self.lengths.nbytes > MEMO_BYTES:
            self.forget()
        lists = pc.split_pattern(texts, " ")
        begins = np.asarray(lists.offsets).astype(np.int64)
        words = lists.values
        first = np.zeros(len(words), bool)
        first[begins[:-1]] = True
        rest = words.filter(pa.array(~first)).dictionary_encode()
        at = pc.index_in(rest.dictionary, value_set=self.known).to_numpy(zero_copy_only=False)  # a hash table of all that is known: once a slice
        missing = np.isnan(at) if at.dtype.kind == "f" else np.zeros(len(at), bool)
        if missing.any():
            at[missing] = self._learn(rest.dictionary.filter(pa.array(missing)))
        at = at.astype(np.int64)[rest.indices.to_numpy()]
        heads = self._whole(words.filter(pa.array(first)).to_pylist())
        pool, sizes = np.concatenate([self.ids, *heads]), np.array([len(h) for h in heads], np.int64)
        length, start = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
        length[first], start[first] = sizes, len(self.ids) + np.cumsum(sizes) - sizes
        length[~first], start[~first] = self.lengths[at], (np.cumsum(self.lengths) - self.lengths)[at]
        ends = np.cumsum(length)
        place = np.repeat(start - ends + length, length)
        place += np.arange(len(place))
        cuts = np.append(0, ends)[begins].tolist()
        ids = pool[place]
        return [ids[a:b] for a, b in zip(cuts, cuts[1:])]

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text of a string column, slice by slice."""
        texts = texts.cast(pa.large_string())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        lo = 0
        while lo < len(texts):
            hi = min(len(texts), max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + SLICE, "right")) - 1))
            part = texts.slice(lo, hi - lo)
            whole = pc.match_substring_regex(part, self.odd) if self.piecewise else pa.array([True] * len(part))
            odd = iter(self._whole(part.filter(whole).to_pylist()))
            plain = part.filter(pc.invert(whole))
            even = iter(self._gathered(plain) if len(plain) else ())
            for w in whole.to_pylist():
                yield next(odd) if w else next(even)
            lo = hi


@lru_cache(maxsize=1)
def _encoder(path: str) -> Encoder:
    """One for a worker: the vocabulary takes as long to load as megabytes of text to encode, and what one task learns the next needs not. It is bounded (``MEMO_BYTES``)."""
    return Encoder(path)


@lru_cache(maxsize=2)
def _dictionary(uri: str, digest: str) -> zstandard.ZstdCompressionDict:
    with files.open_random(uri) as f:
        data = f.read()
    if hashlib.sha256(data).hexdigest() != digest:
        raise ValueError(f"the dictionary {uri} is not the one that the shards name")
    return zstandard.ZstdCompressionDict(data)


def train_dictionary(docs: DataFrame, encoder: Encoder, end_id: int, sample: int = 2000, sample_bytes: int = 8192, size: int = 65536) -> bytes:
    """A dictionary trained on serialised id arrays.

    Fitted on a bounded sample: documents of 1 to ``sample_bytes`` UTF-8 bytes with the ``sample`` doc_ids that come
    first by hash. Dictionaries help short documents only; every document is
    encoded with it. Too few samples to train on give an empty dictionary.
    """
    fit = docs.where(F.octet_length("text").between(1, sample_bytes))
    chosen = F.broadcast(first_by_hash(fit, "doc_id", sample))  # ids alone are sorted, not texts
    rows = fit.join(chosen, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text")).orderBy("doc_id").collect()
    end = np.asarray([end_id], encoder.kind).tobytes()
    arrays = [ids.tobytes() + end for ids in encoder.encode(pa.array([r.text for r in rows], pa.large_string()))]
    if len(arrays) < 16 or sum(map(len, arrays)) < 4 * size:
        size = max(256, min(size, sum(map(len, arrays)) // 8))
    try:
        return zstandard.train_dictionary(size, arrays).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def write_tokens(docs: DataFrame, tokenizer_path: str, end_id: int = 2, level: int = 3, partitions: int | None = None, shard_bytes: int = SHARD_BYTES, shard_docs: int = SHARD_DOCS) -> tuple[list, tuple[str, str]]:
    """Encode every whole text, append ``end_id``, and write shards in ascending doc_id order.

    Ids take two bytes where the vocabulary allows it, else four. Null texts count as empty. Documents with the same
    doc_id, however many, are ordered by a hash of their texts, then the texts; a null doc_id comes
    first and is kept as null. A task writes shards of ``shard_bytes`` of frames or ``shard_docs`` documents, so what it
    holds of an index is bounded. Returns the manifest, one row per shard in order
    ``(part, path, n_docs, n_tokens)``, and (URI, sha256) of the dictionary.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    folder = new_path(spark, "tokens")
    data = train_dictionary(docs, Encoder(tokenizer_path), end_id)
    digest = hashlib.sha256(data).hexdigest()
    dictionary = files.write_bytes(folder, "dictionary", ".zdict", data)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))

    @workers.released
    def write(batches):
        from pyspark import TaskContext

        encoder = _encoder(tokenizer_path)
        width = encoder.kind.itemsize
        end = np.asarray([end_id], encoder.kind).tobytes()
        packer = zstandard.ZstdCompressor(level=level, dict_data=_dictionary(dictionary, digest), write_content_size=True)
        part, number, out = TaskContext.get().partitionId(), 0, None

        def closed() -> pa.RecordBatch:
            out.write(np.asarray(valid, "u1").tobytes() + b"".join(np.asarray(c, "<i8").tobytes() for c in columns))
            out.write(np.asarray([at, len(valid)], "<u8").tobytes() + MAGIC)
            out.close()
            return pa.RecordBatch.from_pylist([{"part": part, "number": number, "path": uri, "n_docs": len(valid), "n_tokens": sum(columns[3])}])

        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1)), strict=True):
                if out is None:
                    uri, out = files.create(folder, f"shard-{part:06d}-{number:06d}", ".tok")
                    out.write(MAGIC + bytes.fromhex(digest) + bytes([width]))
                    at, valid, columns = HEAD, array("B"), [array("q") for _ in range(4)]
                frame = packer.compress(ids.tobytes() + end)
                valid.append(doc_id is not None)
                for column, value in zip(columns, (doc_id or 0, at, len(frame), len(ids) + 1), strict=True):
                    column.append(value)
                at += len(frame)
                out.write(frame)
                if at >= shard_bytes or len(valid) >= shard_docs:
                    yield closed()
                    number, out = number + 1, None
        if out is not None:
            yield closed()

    schema = "part long, number long, path string, n_docs long, n_tokens long"
    order = ["doc_id", F.xxhash64("text")]  # what range sampling takes to the driver: 16 bytes a row of it, never a text
    # One row per shard reaches the driver, whatever the number of documents.
    with workers.small_batches(spark):
        shards = docs.repartitionByRange(n, *order).sortWithinPartitions(*order, "text").mapInArrow(write, schema).collect()
    return [(r.part, r.path, r.n_docs, r.n_tokens) for r in sorted(shards, key=lambda r: (r.part, r.number))], (dictionary, digest)


def _shard(f, digest: str):
    """(width, [valid, doc_id, offset, length, n_tokens]) of an open shard, whose dictionary hash is checked."""
    head = f.read_at(HEAD, 0)
    at, n = np.frombuffer(f.read_at(16, f.size() - 24), "<u8").tolist()
    if head[:8] != MAGIC or f.read_at(8, f.size() - 8) != MAGIC or head[8:40].hex() != digest:
        raise ValueError("not a token shard of this dictionary")
    raw = f.read_at(n * 33, at)
    return head[40], [np.frombuffer(raw, "u1", n), *(np.frombuffer(raw, "<i8", n, n + 8 * n * k) for k in range(4))]


def read_document(path: str, dictionary: tuple[str, str], k: int) -> np.ndarray:
    """The ids of the k-th document of a shard, by its index entry alone."""
    with files.open_random(path) as f:
        width, (_, _, offset, length, _) = _shard(f, dictionary[1])
        frame = f.read_at(int(length[k]), int(offset[k]))
    raw = zstandard.ZstdDecompressor(dict_data=_dictionary(*dictionary)).decompress(frame)
    return np.frombuffer(raw, f"<u{width}").astype(np.uint32)


def _runs(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """(from, to) of runs of at most ``most`` bytes and 1,024 documents; a larger document is a run of its own."""
    ends, lo = np.cumsum(sizes), 0
    while lo < len(sizes):
        hi = int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, "right"))
        hi = max(lo + 1, min(hi, lo + 1024))
        yield lo, hi
        lo = hi


def read_tokens(spark, manifest: list, dictionary: tuple[str, str]) -> DataFrame:
    """Read the shards back: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    uri, digest = dictionary
    rows, start = [], 0
    for part, path, _, n_tokens in manifest:
        rows.append((part, path, start))
        start += n_tokens

    def read(batches):
        unpack = zstandard.ZstdDecompressor(dict_data=_dictionary(uri, digest)).decompress
        for batch in batches:
            for path, base in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                with files.open_random(path) as f:
                    width, (valid, doc_id, offset, length, n_tokens) = _shard(f, digest)
                    starts = base + np.cumsum(n_tokens) - n_tokens
                    for lo, hi in _runs(np.maximum(length, n_tokens * width), READ_BYTES):
                        first = int(offset[lo])
                        raw = memoryview(f.read_at(int(offset[hi - 1] + length[hi - 1]) - first, first))
                        crcs = []
                        for at, size, n in zip((offset[lo:hi] - first).tolist(), length[lo:hi].tolist(), n_tokens[lo:hi].tolist(), strict=True):
                            ids = np.frombuffer(unpack(raw[at : at + size]), f"<u{width}")
                            if len(ids) != n:
                                raise ValueError(f"{path}: a document has {len(ids)} ids, its index entry says {n}")
                            crcs.append(zlib.crc32(ids.astype("<u4").tobytes()))
                        ids = pa.array(doc_id[lo:hi], pa.int64(), mask=valid[lo:hi] == 0)
                        yield pa.RecordBatch.from_arrays([ids, pa.array(starts[lo:hi], pa.int64()), pa.array(n_tokens[lo:hi], pa.int64()), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.one_row_a_task(spark, rows, "part long, path string, base long").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_output(docs: DataFrame, tokenizer_path: str, end_id: int = 2) -> DataFrame:
    """Write all ``docs`` as token shards and return what the shards hold, one row per document.

    Edge cases: a null or empty text has the end id alone; a very long text is one document like any other; repeated rows are kept; an
    empty table gives no shard and no row; columns other than doc_id and text are ignored.
    """
    manifest, dictionary = write_tokens(docs, tokenizer_path, end_id)
    return read_tokens(docs.sparkSession, manifest, dictionary)
