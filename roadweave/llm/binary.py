"""Token-id files coded by a static range asymmetric numeral system (rANS).

Documents are range-sorted by id and tokenized in their partition. A segment is a
row of a Parquet file: about SEGMENT ids of whole documents, one frequency table
that its blocks share, and blocks of up to LANES x STEPS ids. A block has its
lanes' states (the checkpoint at which decoding starts), the words that its lanes
take up in turn, and a CRC-32 of its ids; blocks decode without one another.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from roadweave.llm.tokens import tokenizer_path
from roadweave.session import shared_dir

SEGMENT = 1 << 20
WORDS = 60_000  # stems of a generation, about 200 bytes each; a task remembers two generations
LONG = 64  # characters of a stem that is remembered
CHUNK = 4_000_000  # bytes of text encoded at once, in whole texts
TOGETHER = 1000  # words that are encoded as one text
LANES, STEPS = 1024, 256
SCALE = 17
LOW = np.uint64(1 << 31)
END_ID = 2
SIGNS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
LETTERS = np.array([chr(b).isalpha() for b in range(128)] + [False] * 128)
EDGES = np.array([b <= 32 or b >= 128 for b in range(256)])  # bytes at which a word's white space may begin or end


def whole_rows(sizes: list[int], most: int):
    """Bounds of runs of rows of some most bytes together; each row is in one run."""
    begin = size = 0
    for i, n in enumerate(sizes, 1):
        size += n
        if size >= most or i == len(sizes):
            yield begin, i
            begin, size = i, 0


def strings(words: pa.Array) -> list[str]:
    """The words, which hold no space, as one string that is split again: so each costs a fraction of a scalar's conversion."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), pa.scalar(" ", pa.large_string()))[0].as_py().split(" ") if len(words) else []


class Encoder:
    """text -> token ids of the library, as bytes of 32-bit numbers.

    A space after a printed character starts a new word for byte-level vocabularies,
    and a line break between printed characters stands alone, so a text is its first
    word followed by words that begin with a space or a line break. Signs that end a
    word after a letter stand apart from it too. So the library encodes each distinct
    stem and each distinct ending of some CHUNK characters once, words are parted and
    numbered in Arrow, and the texts' ids are gathered by word number. Texts where white space stands beside a space or a line
    break are encoded as a whole.

    Words of up to LONG characters are remembered, for one or two generations: a full
    generation becomes the old one, from which words in use move on to the new one.
    Longer words are encoded wherever they stand, so that memory stays bounded.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.marks = {t.content[0] for t in self.tokenizer.get_added_tokens_decoder().values()}
        vocabulary = self.tokenizer.get_vocab()
        self.begins = np.zeros(max(vocabulary.values()) + 1, bool)
        self.begins[[i for t, i in vocabulary.items() if self.tokenizer.decode([i], skip_special_tokens=False)[:1] in (" ", "\n")]] = True
        self.memo: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of clean words after a space (or after their own line break): many make one text, whose ids are
        cut where a token begins with a space or a line break."""
        out = []
        for a in range(0, len(words), TOGETHER):
            part = words[a : a + TOGETHER]
            text = "".join([w if w[0] == "\n" else " " + w for w in part])
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            edges, data = [*(np.flatnonzero(self.begins[ids]) * 4).tolist(), 4 * len(ids)], ids.tobytes()
            out += [data[x:y] for x, y in zip(edges, edges[1:])] if len(edges) == len(part) + 1 else self.encode([w if w[0] == "\n" else " " + w for w in part])
        return out

    def stems(self, words: pa.Array) -> tuple[pa.Array, pa.Array, np.ndarray]:
        """Each word's stem (null for words that aren't clean), the endings of those words that have one, and which do."""
        edges = np.frombuffer(words.buffers()[1], np.int64, len(words) + 1)
        text = np.frombuffer(words.buffers()[2], np.uint8) if edges[-1] else np.zeros(1, np.uint8)
        bare = pc.ascii_rtrim(words, SIGNS)
        sizes = pc.binary_length(bare).to_numpy()
        last = np.where(sizes > 0, text[np.maximum(edges[:-1] + sizes - 1, 0)], 0)
        cut = (sizes < np.diff(edges)) & (LETTERS[last] | (last >= 128))
        for mark in self.marks:
            cut &= ~pc.match_substring(words, mark).to_numpy(zero_copy_only=False)
        other = np.flatnonzero(cut & (last >= 128))
        cut[other] = [w[-1].isalpha() for w in strings(bare.take(pa.array(other)))]
        # white space beyond ASCII begins and ends with bytes of 128 and more
        ends = text[np.minimum(edges[:-1], len(text) - 1)], text[np.maximum(edges[1:] - 1, 0)]
        unclean = np.diff(edges) == 0
        other = np.flatnonzero(~unclean & (EDGES[ends[0]] | EDGES[ends[1]]))
        unclean[other] = [w[-1].isspace() or w[0].isspace() and (w[0] != "\n" or w[1].isspace()) for w in strings(words.take(pa.array(other)))]
        cut &= ~unclean
        parted = words.filter(pa.array(cut))
        bounds = np.frombuffer(parted.buffers()[1], np.int64, len(parted) + 1)
        both = np.repeat(bounds, 2)[: 2 * len(parted) + 1]
        both[1::2] += sizes[cut]
        endings = pa.LargeStringArray.from_buffers(2 * len(parted), pa.py_buffer(both), parted.buffers()[2]).take(pa.array(np.arange(1, 2 * len(parted), 2)))
        return pc.if_else(pa.array(unclean), None, pc.if_else(pa.array(cut), bare, words)), endings, cut

    def learn(self, words: pa.Array) -> pa.Array:
        """Each distinct word's ids after a space or line break; null for words that aren't clean."""
        stems, endings, cut = self.stems(words)
        coded, tails = stems.dictionary_encode(), endings.dictionary_encode()
        found = pa.array(self.ids_of(strings(coded.dictionary)), pa.large_binary()).take(coded.indices)
        at = np.zeros(len(words), np.int64)
        at[cut] = 1 + tails.indices.to_numpy(zero_copy_only=False)
        ended = pa.array([b"", *self.encode(strings(tails.dictionary))], pa.large_binary())
        return pc.binary_join_element_wise(found, ended.take(pa.array(at)), pa.scalar(b"", pa.large_binary()))

    def ids_of(self, stems: list[str]) -> list[bytes]:
        if len(self.memo) > WORDS:
            self.old, self.memo = self.memo, {}
        found = list(map(self.memo.get, stems))
        missing = [i for i, ids in enumerate(found) if ids is None]
        earlier = list(map(self.old.get, [stems[i] for i in missing]))
        fresh = [stems[i] for i, ids in zip(missing, earlier) if ids is None]
        coded = iter(self.encode_words(fresh))
        for i, ids in zip(missing, earlier):
            found[i] = next(coded) if ids is None else ids
            if len(stems[i]) <= LONG:
                self.memo[stems[i]] = found[i]
        return found

    def __call__(self, texts: list[str]) -> list[bytes]:
        return [ids for a, b in whole_rows(list(map(len, texts)), CHUNK) for ids in self.chunk(texts[a:b])]

    def chunk(self, texts: list[str]) -> list[bytes]:
        pieces = pc.split_pattern(pc.replace_substring(pa.array(texts, pa.large_string()), "\n", " \n"), " ")
        edges, values = pieces.offsets.to_numpy(), pieces.values
        first = edges[:-1]
        starts = values.take(pa.array(first)).to_pylist()
        later = np.ones(len(values), bool)
        later[first] = False
        coded = values.filter(pa.array(later)).dictionary_encode()
        words = self.learn(coded.dictionary)
        table = pa.concat_arrays([words, pa.array(self.encode(starts), pa.large_binary())])
        codes = np.empty(len(values), np.int64)
        codes[later] = coded.indices.to_numpy(zero_copy_only=False)
        codes[first] = np.arange(len(words), len(table))
        found = table.take(pa.array(codes))
        whole = [s[-1:].isspace() for s in starts] & (np.diff(edges) > 1)
        if found.null_count:
            whole |= np.add.reduceat(found.is_null().to_numpy(zero_copy_only=False), first, dtype=np.int64) > 0
        cuts, data = np.frombuffer(found.buffers()[1], np.int64, len(found) + 1)[edges].tolist(), found.buffers()[2].to_pybytes()
        out = [data[a:b] for a, b in zip(cuts, cuts[1:])]
        again = np.flatnonzero(whole).tolist()
        for i, ids in zip(again, self.encode([texts[i] for i in again])):
            out[i] = ids
        return out


@lru_cache(1)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def frequencies(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols used, ascending, and their shares of 2^SCALE, each at least 1."""
    count = np.bincount(ids)
    symbols = np.flatnonzero(count)
    share = np.maximum(1, count[symbols] * (1 << SCALE) // len(ids))
    over = int(share.sum()) - (1 << SCALE)
    for i in np.argsort(-share, kind="stable"):
        if not over:
            break
        step = min(over, int(share[i]) - 1) if over > 0 else over
        share[i] -= step
        over -= step
    return symbols, share


def encode_block(ranks: np.ndarray, share: np.ndarray, start: np.ndarray) -> bytes:
    n = len(ranks)
    lanes = min(LANES, max(1, 1 << (max(1, n // 64)).bit_length() - 1))
    grid = np.zeros(-(-n // lanes) * lanes, np.int64)
    grid[:n] = ranks
    grid, x, out = grid.reshape(-1, lanes), np.full(lanes, LOW), []
    top = share << np.uint64(63 - SCALE)
    for row in grid[::-1]:
        f = share[row]
        full = x >= top[row]
        out.append(x[full].astype("<u4"))
        x = np.where(full, x >> np.uint64(32), x)
        q = x // f
        x = (q << np.uint64(SCALE)) + (x - q * f) + start[row]
    words = np.concatenate(out[::-1])
    return struct.pack("<III", n, lanes, len(words)) + x.astype("<u8").tobytes() + words.tobytes()


def decode_block(data: memoryview, slots: np.ndarray, share: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, int]:
    n, lanes, size = struct.unpack_from("<III", data)
    x = np.frombuffer(data, "<u8", lanes, 12).astype(np.uint64)
    words, at, mask = np.frombuffer(data, "<u4", size, 12 + 8 * lanes).astype(np.uint64), 0, np.uint64((1 << SCALE) - 1)
    grid = np.empty((-(-n // lanes), lanes), np.int64)
    for row in grid:
        slot = x & mask
        row[:] = s = slots[slot]
        x = share[s] * (x >> np.uint64(SCALE)) + slot - start[s]
        low = np.flatnonzero(x < LOW)
        x[low] = x[low] << np.uint64(32) | words[at : at + len(low)]
        at += len(low)
    return grid.ravel()[:n], 12 + 8 * lanes + 4 * size


def encode_segment(ids: np.ndarray) -> bytes:
    """Table, then blocks: each its CRC-32, its size, and itself."""
    if not len(ids):
        return struct.pack("<II", 0, 0)
    symbols, share = frequencies(ids)
    place = np.zeros(int(symbols[-1]) + 1, np.int64)
    place[symbols] = np.arange(len(symbols))
    ranks, share = place[ids], share.astype(np.uint64)
    start = np.cumsum(share) - share
    table = zlib.compress(np.diff(symbols, prepend=0).astype("<u4").tobytes() + share.astype("<u4").tobytes())
    out = [struct.pack("<II", len(symbols), len(table)), table]
    for a in range(0, len(ids), LANES * STEPS):
        block = encode_block(ranks[a : a + LANES * STEPS], share, start)
        out += [struct.pack("<II", zlib.crc32(ids[a : a + LANES * STEPS].astype("<u4").tobytes()), len(block)), block]
    return b"".join(out)


def decode_segment(data: bytes) -> np.ndarray:
    """The ids; raises if a block's checksum is wrong."""
    n, size = struct.unpack_from("<II", data)
    if not n:
        return np.empty(0, np.int64)
    raw = np.frombuffer(zlib.decompress(data[8 : 8 + size]), "<u4")
    symbols, share = np.cumsum(raw[:n], dtype=np.int64), raw[n:].astype(np.uint64)
    slots, start = np.repeat(np.arange(n), raw[n:]), np.cumsum(share) - share
    at, out, view = 8 + size, [], memoryview(data)
    while at < len(data):
        checksum, length = struct.unpack_from("<II", data, at)
        ids = symbols[decode_block(view[at + 8 : at + 8 + length], slots, share, start)[0]]
        if zlib.crc32(ids.astype("<u4").tobytes()) != checksum:
            raise ValueError("a block's checksum is wrong")
        out.append(ids)
        at += 8 + length
    return np.concatenate(out)


def write(docs: DataFrame, path: str, tokenizer: str = "byte_bpe_50k.json", end_id: int = END_ID, parts: int | None = None) -> None:
    """Writes the ids of docs(doc_id, text), each document with end_id after it, by ascending doc_id.

    A null text counts as empty: its ids are end_id alone. Null doc_ids come first; rows that repeat a
    doc_id follow one another by text. An empty table gives files without segments.
    """
    parts = parts or 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tail = np.array([end_id], "<u4").tobytes()

    def run(batches):
        encode, part, seq, before, size = encoder(tokenizer_path(tokenizer)), TaskContext.get().partitionId(), 0, 0, 0
        held: list[tuple[int, bytes]] = []

        def segment():
            nonlocal seq, before, held, size
            ids = np.frombuffer(b"".join(d for _, d in held), "<u4").astype(np.int64)
            lengths = [len(d) // 4 for _, d in held]
            row = [[part], [seq], [before], [len(ids)], [[i for i, _ in held]], [lengths], [encode_segment(ids)]]
            seq, before, held, size = seq + 1, before + len(ids), [], 0
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, types)], names=names)

        for batch in batches:
            ids, sizes = batch.column(0).to_pylist(), pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist()
            for a, b in whole_rows(sizes, CHUNK):
                for i, e in zip(ids[a:b], encode.chunk([t or "" for t in batch.column(1).slice(a, b - a).to_pylist()])):
                    held.append((i, e + tail))
                    size += len(e) + len(tail)
                    if size >= 4 * SEGMENT:
                        yield segment()
        if held:
            yield segment()

    names = ["part", "seq", "before", "n_ids", "doc_ids", "lengths", "data"]
    types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    found = rows.mapInArrow(run, "part int, seq int, before long, n_ids long, doc_ids array<long>, lengths array<long>, data binary")
    found.write.option("compression", "none").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32 long) of each document in the files at path."""
    segments = spark.read.schema("part int, seq int, before long, n_ids long, doc_ids array<long>, lengths array<long>, data binary").parquet(path)
    sums = segments.groupBy("part").agg(F.sum("n_ids").alias("n"))
    # a row for each partition that wrote, whatever the number of documents
    ahead = sums.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids = decode_segment(row["data"]).astype("<u4")
                lengths = np.array(row["lengths"], np.int64)
                ends = np.cumsum(lengths)
                starts = ends - lengths
                sums = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts, ends)]
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(starts + row["ahead"] + row["before"]), pa.array(lengths), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    placed = segments.join(F.broadcast(ahead), "part").select("ahead", "before", "doc_ids", "lengths", "data")
    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json") -> DataFrame:
    """Writes docs to a folder of their own in the shared folder, and reads that."""
    path = f"{shared_dir(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    write(docs, path, tokenizer)
    return read(docs.sparkSession, path)
