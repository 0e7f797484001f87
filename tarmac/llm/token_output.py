"""Token ids in bit-plane shuffled, zstandard-compressed binary files.

Documents are range-partitioned and sorted by doc_id; each partition is a
shard, tokenised and cut into blocks of a fixed number of ids. A block is
transposed into its byte planes (or bit planes) and each plane is compressed
by itself: the high planes of small ids are nearly constant. The file format
is a Parquet table written by Spark, so any store that Spark can write will
do and lost executors only repeat their own shard. A row is one block:

    shard, block      place of the block; shards ascend in doc_id
    first, n_ids      id offset in the shard, ids in the block
    planes            compressed planes, lowest significance first
    doc_seq           number in the shard of the first document in the block
    doc_ids, pieces   the documents that have ids in the block, and how many
    piece_no          number of the first piece: over 0 if its document began in an earlier block

``doc_seq`` .. ``piece_no`` are the chunk index: a reader needs only the block
to give back its documents.
"""

from __future__ import annotations

import gc
import os
import re
import zlib
from array import array
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarmac.llm.common import arrow_rows, shared_path, shuffle_partitions, text_of, worker_cache

BLOCK_IDS = 65_536
END_ID = 0
ZSTD_LEVEL = 3
#: Characters from which on texts are encoded, at once, words encoded as the lines of one text, and other pieces kept with their ids in a worker.
BATCH_CHARS, LINE_WORDS, CACHE_PIECES = 8_000_000, 100, 250_000
ARROW_ROWS = 400

BLOCKS = ("shard int, block int, first bigint, n_ids int, planes array<binary>, doc_seq bigint, "
          "doc_ids array<bigint>, pieces array<int>, piece_no int")
PIECES = "shard int, doc_seq bigint, doc_id bigint, piece_no int, at bigint, n int, crc bigint"

_two_spaces = re.compile(r"\s\s")
_marks = frozenset(".,")
_before_word = re.compile(r"(?<=\S)(?= \S)")
#: Words with a letter, digit, mark or symbol at both ends: as lines of one text they have the ids that they have alone.
_clear_ends = r"(?s)^[\p{L}\p{N}\p{P}\p{S}](?:.*[\p{L}\p{N}\p{P}\p{S}])?$"


class Pieces:
    """The ids of pieces of text as little-endian bytes, encoded once each."""

    def __init__(self, tokenizer):
        self.tokenizer, self.ids = tokenizer, {}
        self.marks = {c: array("I", tokenizer.encode(c, add_special_tokens=False).ids).tobytes() for c in ".,"}

    def of(self, pieces: list[str]) -> list[bytes]:
        """The ids of different ``pieces``. A full cache keeps its older half, where the frequent pieces are."""
        new = [p for p in pieces if p not in self.ids]
        if len(self.ids) + 2 * len(new) > CACHE_PIECES:
            self.ids = dict(islice(self.ids.items(), CACHE_PIECES // 2))
            new = [p for p in pieces if p not in self.ids]
        # A token never spans a letter and the full stop or comma after it.
        marked = [p for p in new if p[-1:] in _marks and p[-2:-1].isalpha()]
        self._encode([p for p in new if p[-1:] not in _marks or not p[-2:-1].isalpha()])
        self._encode(list({p[:-1] for p in marked if p[:-1] not in self.ids}))
        self.ids.update([(p, self.ids[p[:-1]] + self.marks[p[-1]]) for p in marked])
        return list(map(self.ids.__getitem__, pieces))

    def _encode(self, new: list[str]) -> None:
        for k in range(0, len(new), 10_000):
            some = new[k:k + 10_000]
            found = self.tokenizer.encode_batch_fast(some, add_special_tokens=False)
            self.ids.update(zip(some, [array("I", e.ids).tobytes() for e in found]))


class Encoder:
    """Encodes whole texts; of those encoded together, what stands between single spaces is encoded once.

    The byte-level pre-tokeniser always starts a new token at a single space
    or line feed between two characters other than white space (a space
    belongs to the word after it), so a text's ids are those of its pieces in
    order. Texts with longer white space are cut only at their single spaces.
    """

    def __init__(self, path: str):
        # Tasks already use all cores; threads of a task would only hold memory of their own.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.pieces = Pieces(self.tokenizer)
        self.feed = np.array(self.tokenizer.encode("\n", add_special_tokens=False).ids, "<u4")
        if len(self.feed) != 1:
            raise ValueError("the tokenizer has no token for a line feed")

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The unsigned 32-bit ids of each text."""
        plain = [i for i, t in enumerate(texts) if not _two_spaces.search(t)]
        out: list = [None] * len(texts)
        for i, ids in zip(plain, self._plain([texts[i] for i in plain])):
            out[i] = ids
        odd = {i: _before_word.split(t) for i, t in enumerate(texts) if out[i] is None}
        every = list({x for pieces in odd.values() for x in pieces})
        ids_of = dict(zip(every, self.pieces.of(every))).__getitem__
        for i, pieces in odd.items():
            out[i] = np.frombuffer(b"".join(map(ids_of, pieces)), "<u4")
        return out

    def _words(self, words: pa.Array, before: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of different words, each after ``before``: in one row, where each word's begin there, and how many they are."""
        size, starts, ids = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), []
        clear = pc.match_substring_regex(words, _clear_ends)
        at = np.flatnonzero(clear.to_numpy(zero_copy_only=False))
        if len(at):
            own = words.filter(clear)
            own = pc.binary_join_element_wise(pa.scalar(before, own.type), own, pa.scalar("", own.type)) if before else own
            cuts = np.append(np.arange(0, len(at), LINE_WORDS), len(at))
            lines = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(cuts, pa.int64()), own), pa.scalar("\n", own.type)).to_pylist()
            found = [np.array(array("I", e.ids), "<u4") for e in self.tokenizer.encode_batch_fast(lines, add_special_tokens=False)]
            joined = np.concatenate([x for f in found for x in (f, self.feed)])
            ends = np.flatnonzero(joined == self.feed[0])
            if len(ends) != len(at):
                raise ValueError("the tokenizer joins a line feed with its neighbours")
            starts[at] = np.concatenate([[0], ends[:-1] + 1])
            size[at] = ends - starts[at]
            ids.append(joined)
        rest = np.flatnonzero(~clear.to_numpy(zero_copy_only=False))
        if len(rest):
            other = [np.frombuffer(x, "<u4") for x in self.pieces.of([before + w for w in words.take(pa.array(rest)).to_pylist()])]
            size[rest] = [len(x) for x in other]
            starts[rest] = sum(map(len, ids)) + np.cumsum(size[rest]) - size[rest]
            ids += other
        pool = np.concatenate(ids) if ids else np.zeros(0, "<u4")
        return pool, starts, size

    def _plain(self, texts: list[str]) -> list[np.ndarray]:
        """Texts whose white space stands alone: split, numbered and put together by whole columns."""
        if not texts:
            return []
        lines = pc.split_pattern(pa.array(texts, pa.large_string()), "\n")
        words = pc.split_pattern(lines.flatten(), " ")
        numbered = words.flatten().dictionary_encode()
        n, code = len(numbered.dictionary), numbered.indices.to_numpy().astype(np.int64)
        line_at, word_at = lines.offsets.to_numpy().astype(np.int64), words.offsets.to_numpy().astype(np.int64)
        # A piece is the first word of a line, a later one, or a line feed before all lines but a text's first.
        first = np.zeros(len(code), bool)
        first[word_at[:-1]] = True
        feeds = np.ones(len(word_at) - 1, np.int64)
        feeds[line_at[:-1]] = 0
        before = np.cumsum(feeds)
        pieces = np.full(len(code) + before[-1], 2 * n)
        pieces[np.arange(len(code)) + np.repeat(before, np.diff(word_at))] = code + n * first
        pools, start, size = [self.feed], np.zeros(2 * n + 1, np.int64), np.zeros(2 * n + 1, np.int64)
        size[-1] = len(self.feed)
        for lead, at, which in ((" ", 0, ~first), ("", n, first)):
            seen = np.zeros(n, bool)
            seen[code[which]] = True
            ids, starts, sizes = self._words(numbered.dictionary.filter(pa.array(seen)), lead)
            start[at + np.flatnonzero(seen)] = sum(map(len, pools)) + starts
            size[at + np.flatnonzero(seen)] = sizes
            pools.append(ids)
        pool = np.concatenate(pools)
        sizes = size[pieces]
        end = np.cumsum(sizes)
        every = pool[np.repeat(start[pieces] - end + sizes, sizes) + np.arange(end[-1])]
        # A text's pieces end with its last line's words.
        cuts = np.concatenate([[0], end])[word_at[line_at[1:]] + before[line_at[1:] - 1]]
        return np.split(every, cuts[:-1])


def encoder(path: str) -> Encoder:
    held = worker_cache("token output", dict)
    if path not in held:
        held[path] = Encoder(path)
    return held[path]


def to_planes(ids: np.ndarray, bits: bool = False) -> list[bytes]:
    """The ids' four byte planes or 32 bit planes, each compressed."""
    import zstandard

    z = zstandard.ZstdCompressor(level=ZSTD_LEVEL)
    planes = np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    if bits:
        planes = np.packbits(np.unpackbits(planes[:, None, :], axis=1, bitorder="little"), axis=2).reshape(32, -1)
    return [z.compress(p.tobytes()) for p in planes]


def from_planes(planes: list[bytes], n: int) -> np.ndarray:
    import zstandard

    z = zstandard.ZstdDecompressor()
    rows = [np.frombuffer(z.decompress(p, max_output_size=max(1, n)), np.uint8) for p in planes]
    if len(rows) == 32:
        flat = np.unpackbits(np.stack(rows).reshape(4, 8, -1), axis=2)[:, :, :n]
        rows = list(np.packbits(flat, axis=1, bitorder="little")[:, 0, :])
    return np.ascontiguousarray(np.stack(rows).T).reshape(-1).view("<u4")


def _together(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[list, list[str]]]:
    """The ids and texts of several batches: as few texts as reach ``BATCH_CHARS``, so that a word is looked up once for many texts."""
    ids, texts, chars = [], [], 0
    for pdf in batches:
        for doc_id, text in zip(pdf["doc_id"], pdf["text"]):
            ids.append(doc_id)
            texts.append(text)
            chars += len(text)
            if chars >= BATCH_CHARS:
                yield ids, texts
                ids, texts, chars = [], [], 0
    if ids:
        yield ids, texts


def _blocks(batches: Iterator[pd.DataFrame], path: str, size: int, bits: bool) -> Iterator[pd.DataFrame]:
    """The blocks of one shard, from its documents in order. Holds one block
    and the ids of the texts that are encoded at once."""
    shard, enc = TaskContext.get().partitionId(), encoder(path)
    names = [x.split()[0] for x in BLOCKS.split(", ")]
    parts, held, index = [], 0, []  # of the open block: arrays, ids, [doc_seq, doc_id, n, piece_no]
    block = seq = first = 0

    def closed() -> pd.DataFrame:
        nonlocal parts, held, index, block, first
        ids = np.concatenate(parts)
        row = (shard, block, first, len(ids), to_planes(ids, bits), index[0][0], [x[1] for x in index], [x[2] for x in index], index[0][3])
        block, first, parts, held, index = block + 1, first + len(ids), [], 0, []
        return pd.DataFrame([row], columns=names)

    for doc_ids, texts in _together(batches):
        gc.disable()  # nothing cyclic is made while encoding; collecting would walk the whole cache
        found = enc.encode(texts)
        gc.enable()
        for doc_id, ids in zip(doc_ids, found):
            ids, piece = np.append(ids, np.uint32(END_ID)).astype("<u4"), 0
            while len(ids):
                now, ids = ids[:size - held], ids[size - held:]
                parts.append(now)
                index.append((seq, None if pd.isna(doc_id) else int(doc_id), len(now), piece))
                held, piece = held + len(now), piece + 1
                if held == size:
                    yield closed()
            seq += 1
    if held:
        yield closed()


def write_tokens(docs: DataFrame, path: str, tokenizer: str, block_ids: int = BLOCK_IDS, bits: bool = False) -> None:
    """Tokenise every row of ``docs`` (needs doc_id, text) into block files at ``path``.

    Ascending doc_id, null first; rows of equal doc_id by their text. Null
    text counts as empty; every document ends with id ``END_ID``. An empty
    table writes an empty block table. ``tokenizer`` is a file that all
    executors have.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    order = ["doc_id", F.xxhash64("text")]
    dealt = slim.repartitionByRange(shuffle_partitions(docs.sparkSession), *order).sortWithinPartitions(*order)
    blocks = dealt.mapInPandas(lambda batches: _blocks(batches, tokenizer, block_ids, bits), BLOCKS)
    with arrow_rows(docs.sparkSession, ARROW_ROWS):
        blocks.write.option("compression", "none").parquet(path)


def shift_crc(crc: int, n: int) -> int:
    """``crc`` after ``n`` zero bytes, without the final inversions: x^(8n) times crc mod the CRC-32 polynomial."""
    def times(a: int, b: int) -> int:
        out = 0
        for k in range(31, -1, -1):
            if b >> k & 1:
                out ^= a
            a = (a >> 1) ^ (0xEDB88320 if a & 1 else 0)
        return out

    power = 1 << 23  # x^8
    while n:
        if n & 1:
            crc = times(crc, power)
        power, n = times(power, power), n >> 1
    return crc


def _crc_of(pieces) -> int:
    crc = None
    for p in pieces or ():
        crc = p["crc"] if crc is None else shift_crc(crc, 4 * p["n"]) ^ p["crc"]
    return crc


def documents_of(row) -> Iterator[tuple]:
    """(doc_seq, doc_id, piece_no, offset in the shard, ids) of a block's documents."""
    ids, at = from_planes(list(row.planes), row.n_ids), 0
    for k, (doc_id, n) in enumerate(zip(row.doc_ids, row.pieces)):
        yield row.doc_seq + k, doc_id, row.piece_no if k == 0 else 0, row.first + at, ids[at:at + n]
        at += n


def _pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [x.split()[0] for x in PIECES.split(", ")]
    for pdf in batches:
        found = [(row.shard, seq, doc_id, no, at, len(ids), zlib.crc32(ids.tobytes())) for row in pdf.itertuples() for seq, doc_id, no, at, ids in documents_of(row)]
        yield pd.DataFrame(found, columns=names).astype({"doc_id": "Int64"})


def read_digest(blocks: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, shard) of every document, decoded from the block table.

    A document over several blocks has its checksums combined; its ids are
    never brought together. Shard offsets are sums over one row per shard.
    """
    pieces = blocks.mapInPandas(_pieces, PIECES)
    docs = pieces.groupBy("shard", "doc_seq").agg(
        F.first("doc_id").alias("doc_id"), F.min("at").alias("at"), F.sum("n").alias("n_tokens"),
        F.sort_array(F.collect_list(F.struct("piece_no", "n", "crc"))).alias("all"))
    combined = F.udf(_crc_of, "bigint")(F.when(F.size("all") > 1, F.col("all")))
    crc = F.coalesce(combined, F.col("all")[0]["crc"])
    shards = blocks.groupBy("shard").agg(F.sum("n_ids").alias("ids"))
    base = shards.select("shard", (F.sum("ids").over(Window.orderBy("shard")) - F.col("ids")).alias("base"))
    return docs.join(base, "shard").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", crc.alias("ids_crc32"), "shard")


def _ids(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for row in pdf.itertuples():
            yield pd.DataFrame([(row.shard, seq, doc_id, no, ids.tolist()) for seq, doc_id, no, _, ids in documents_of(row)],
                               columns=["shard", "doc_seq", "doc_id", "piece_no", "ids"]).astype({"doc_id": "Int64"})


def read_tokens(blocks: DataFrame) -> DataFrame:
    """(shard, doc_seq, doc_id, piece_no, ids): the ids themselves, a row per piece of a document in a block."""
    return blocks.mapInPandas(_ids, "shard int, doc_seq bigint, doc_id bigint, piece_no int, ids array<int>")


def token_output(docs: DataFrame, tokenizer: str, block_ids: int = BLOCK_IDS, bits: bool = False) -> DataFrame:
    """Write ``docs`` as token blocks into the shared folder and digest the files read back."""
    spark = docs.sparkSession
    path = shared_path(spark, "tokens")
    write_tokens(docs, path, tokenizer, block_ids, bits)
    return read_digest(spark.read.parquet(path))
