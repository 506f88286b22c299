"""Token-id files with Re-Pair grammar compression.

Documents are ordered by id over range partitions.  Each task encodes its documents, cuts the id sequence into segments,
and compresses each segment by Re-Pair: in every round the most frequent pairs of neighbouring symbols become nonterminals
and are replaced throughout, until no pair has ``LEAST`` places, or there are ``MOST_RULES`` rules, about as many as two-byte symbols
have numbers for.  A round takes many pairs at once; where chosen pairs overlap, every other one from the left is
replaced.  A segment stores its rules, the expansion length of every rule, the remaining symbols, and the expanded
position of every ``STRIDE``-th symbol; so any range of ids is decoded from the parts of symbols that cover it.

Segment layout (little-endian): magic, six uint64 (base, rules, symbols, ids, bytes of a symbol, stride); rules as pairs
of uint32; expansion lengths uint32; symbols uint16 or uint32; positions uint64.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.batches import held_by, settled, small_batches, text_chunks
from weftline.llm.bpe import byte_alphabet
from weftline.llm.files import RangeReader, ShardWriter, split_by_volume
from weftline.plans.shared import Stash, fresh_path

MAGIC = b"WEFTRP01"
HEAD = struct.Struct("<8s6Q")
SEGMENT_IDS = 1 << 20
SHARD_BYTES = 512 << 20
STRIDE = 256
LEAST = 8
FEW = 4096
AT_ONCE = 4096
MOST_RULES = 16_000
MAX_WORDS = 250_000
CHUNK = 4 << 20
READ = 1 << 16
#: Multipliers of the hash by which pairs are counted.
ODD = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35], np.uint32)


def compress(ids: np.ndarray) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """``(base, rules, lengths, symbols)``: symbols below ``base`` are ids, the others number the rules from it.

    Frequent pairs go first: the frequency asked for falls by half whenever few pairs reach it, down to ``LEAST``, below
    which a rule costs more than it saves; the end is where no pair reaches that.
    """
    base = int(ids.max()) + 1 if len(ids) else 1
    s, rules, lengths = ids.astype(np.uint32), [], np.empty(0, np.int64)
    room = min(MOST_RULES, max(0, (1 << 16) - base)) or MOST_RULES
    asked = max(LEAST, len(s) // 20_000)
    while len(s) >= LEAST and room > 0:
        slot = ((s[:-1] * ODD[0]) ^ (s[1:] * ODD[1])) * ODD[2] >> np.uint32(14)
        at = np.flatnonzero((np.bincount(slot, minlength=1 << 18) >= asked)[slot])
        key = s[at].astype(np.int64) << 32 | s[at + 1]
        pairs, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
        chosen = np.flatnonzero(count >= asked)
        chosen = chosen[np.argsort(-count[chosen], kind="stable")[: min(room, AT_ONCE)]]
        last, asked = asked, max(LEAST, asked // 2) if len(chosen) < FEW else asked
        number = np.full(len(pairs), -1, np.int64)
        number[chosen] = np.arange(len(chosen))
        keep = number[inverse] >= 0
        at, rule = at[keep], number[inverse][keep]
        first = np.diff(at, prepend=-2) > 1
        run = np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
        even = (np.arange(len(at)) - run) % 2 == 0
        at, rule = at[even], rule[even]
        # Of overlapping pairs some lose most of their places; those are left to later rounds.
        worth = np.bincount(rule, minlength=len(chosen)) >= LEAST // 2
        at, rule = at[worth[rule]], rule[worth[rule]]
        if not len(at):
            if last == LEAST:
                break
            asked = max(LEAST, last // 2)
            continue
        used, rule = np.unique(rule, return_inverse=True)
        made = pairs[chosen[used]]
        left, right = made >> 32, made & 0xFFFFFFFF
        size = np.concatenate([np.ones(base, np.int64), lengths])
        s[at] = base + len(lengths) + rule
        stays = np.ones(len(s), bool)
        stays[at + 1] = False
        s = s[stays]
        rules.append(np.stack([left, right], 1))
        lengths = np.concatenate([lengths, size[left] + size[right]])
        room -= len(made)
    return base, np.concatenate([np.empty((0, 2), np.int64), *rules]).astype(np.uint32), lengths.astype(np.uint32), s


def pack(ids: np.ndarray) -> bytes:
    """One segment."""
    base, rules, lengths, s = compress(ids)
    width = 2 if base + len(rules) <= 1 << 16 else 4
    size = np.ones(base + len(rules), np.int64)
    size[base:] = lengths
    ends = np.cumsum(size[s])
    starts = np.concatenate([[0], ends[:-1]])[::STRIDE] if len(s) else np.empty(0, np.int64)
    head = HEAD.pack(MAGIC, base, len(rules), len(s), len(ids), width, STRIDE)
    return head + rules.astype("<u4").tobytes() + lengths.astype("<u4").tobytes() + s.astype(f"<u{width}").tobytes() + starts.astype("<u8").tobytes()


class Segment:
    """A segment read back; ``ids`` decodes any range of it."""

    def __init__(self, data: bytes):
        magic, self.base, rules, n, self.n_ids, width, self.stride = HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a segment")
        at = HEAD.size
        self.rules = np.frombuffer(data, "<u4", 2 * rules, at).reshape(-1, 2).astype(np.int64)
        at += 8 * rules
        self.size = np.ones(self.base + rules, np.int64)
        self.size[self.base :] = np.frombuffer(data, "<u4", rules, at)
        at += 4 * rules
        self.symbols = np.frombuffer(data, f"<u{width}", n, at)
        self.starts = np.frombuffer(data, "<u8", -(-n // self.stride), at + width * n).astype(np.int64)

        # Every symbol's ids one after another; every pass opens the outermost rules of all of them.
        run = np.arange(self.base + rules)
        while (deep := run >= self.base).any():
            out = np.empty(len(run) + int(deep.sum()), np.int64)
            at = np.arange(len(run)) + np.cumsum(deep) - deep
            out[at] = np.where(deep, self.rules[np.where(deep, run - self.base, 0), 0] if rules else 0, run)
            out[at[deep] + 1] = self.rules[run[deep] - self.base, 1]
            run = out
        self.flat, self.place = run.astype("<u4"), np.cumsum(self.size) - self.size

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop`` (not included), from the parts of symbols that cover them."""
        if stop <= start:
            return np.empty(0, "<u4")
        mark = int(np.searchsorted(self.starts, start, "right")) - 1
        after = int(np.searchsorted(self.starts, stop, "left"))
        run = self.symbols[mark * self.stride : after * self.stride]
        size = self.size[run]
        ends = np.cumsum(size) + self.starts[mark]
        a = int(np.searchsorted(ends, start, "right"))
        b = int(np.searchsorted(ends, stop, "left")) + 1
        place, size = self.place[run[a:b]], size[a:b]
        skip = start - int(ends[a]) + int(size[0])
        place[0] += skip
        size[0] -= skip
        size[-1] -= int(ends[b - 1]) - stop
        return self.flat[np.repeat(place - np.cumsum(size) + size, size) + np.arange(stop - start)]


#: Pieces of these characters are normal in form and are cut by PLAIN as the library would; all others are left to it.
SAFE = re.compile(r"[\x21-\x7eÀ-ÖØ-öø-ÿ]+").fullmatch
PLAIN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-z0-9ß-öø-ÿ]+").findall


class _Pieces(dict):
    """Ids of pieces met lately; ``old`` holds those met before that, and what is in use moves over."""

    def __init__(self, encoder: WordEncoder):
        self.encoder, self.old = encoder, {}

    def __missing__(self, piece: str) -> bytes:
        found = self.old.get(piece)
        if found is None:
            found = self.encoder.piece(piece)
        self[piece] = found
        return found


class WordEncoder:
    """Encodes texts with the tokenizers library, each distinct stretch without blanks or line ends once in a while.

    The vocabulary drops white space and no token crosses it, so the ids of a text are those of its stretches.  Stretches
    of plain letters and marks go to the library's merge model directly; all others take its whole way.
    """

    def __init__(self, path: str, most: int = MAX_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model, self.most = self.tokenizer.model, most
        self.shown = {b: c for c, b in byte_alphabet().items()}
        self.pieces = _Pieces(self)

    def word(self, w: str) -> bytes:
        """Ids of what ``PLAIN`` cuts."""
        known = dict.get(self.pieces, w) or self.pieces.old.get(w)
        if known is None:
            ids = [t.id for t in self.model.tokenize(w if w.isascii() else w.encode().decode("latin-1").translate(self.shown))]
            known = struct.pack(f"<{len(ids)}I", *ids)
        return known

    def piece(self, piece: str) -> bytes:
        """Ids of a piece as little-endian uint32; words in it that are known as pieces of their own are looked up."""
        if "<|" in piece or not SAFE(piece):
            ids = self.tokenizer.encode(piece, add_special_tokens=False).ids
            return struct.pack(f"<{len(ids)}I", *ids)
        words = PLAIN(piece.lower())
        return b"".join([self.word(w) for w in words])

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian uint32."""
        if len(self.pieces) > self.most:
            before, self.pieces = self.pieces, _Pieces(self)
            before.old = {}
            self.pieces.old = before
        get = self.pieces.__getitem__
        return [b"".join(map(get, (t or "").replace("\n", " ").split(" "))) for t in texts]


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


held_by("repair", word_encoder.cache_clear)


def write_ids(
    docs: DataFrame, path: str, end_id: int = 1, folder: str | None = None, doc_id: str = "doc_id", text: str = "text", segment_ids: int = SEGMENT_IDS
) -> DataFrame:
    """Encode ``docs`` and write the ids, each document closed by ``end_id``, in ascending order of ids.

    Returns a written table with a row for each document: ``(doc_id, part, at, shard, offset, length, start, n_tokens)``:
    number of the range partition, place among its ids, then the file, the byte range of the segment there, and the range
    of ids within the segment.  Null and empty texts have the end id alone; equal document ids are ordered by a hash of
    the text, null ones come first; an empty table writes nothing.  A segment holds whole documents and ends with the
    first one that fills it.
    """
    spark = docs.sparkSession
    place = folder or fresh_path(spark, "ids")
    base = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    ordered = small_batches(base).repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    end = struct.pack("<I", end_id)
    names = ["doc_id", "part", "at", "shard", "offset", "length", "start", "n_tokens"]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]

    @settled("repair")
    def run(batches):
        encoder, out = word_encoder(path), ShardWriter(place, ".wrp", SHARD_BYTES)
        waiting: list[tuple] = []
        data: list[bytes] = []
        at = held = 0

        def flush():
            nonlocal held
            packed = pack(np.frombuffer(b"".join(data), "<u4"))
            out.room(len(packed))
            offset = out.write(packed)
            rows = [(d, out.partition, p, out.name, offset, len(packed), s, n) for d, p, s, n in waiting]
            waiting.clear()
            data.clear()
            held = 0
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

        try:
            for batch in batches:
                for part in text_chunks(batch, "text", CHUNK):
                    for d, ids in zip(part.column(0).to_pylist(), encoder.encode(part.column(1).to_pylist()), strict=True):
                        n = len(ids) // 4 + 1
                        waiting.append((d, at, held, n))
                        data += (ids, end)
                        at, held = at + n, held + n
                        if held >= segment_ids:
                            yield flush()
            if waiting:
                yield flush()
        finally:
            out.close()

    schema = "doc_id bigint, part int, at bigint, shard string, offset bigint, length bigint, start bigint, n_tokens bigint"
    return Stash(spark).keep(ordered.mapInArrow(run, schema), "id-rows")


def with_starts(refs: DataFrame) -> DataFrame:
    """``refs`` with ``first``, the number of ids of all documents before: partition totals are summed, not documents."""
    totals = refs.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0).cast("bigint")).alias("before"))
    return refs.join(totals, "part").withColumn("first", F.col("before") + F.col("at")).drop("before")


def read_ids(refs: DataFrame, columns: str, types: list, work) -> DataFrame:
    """Append what ``work(ids)`` gives for each document's ids, read back from its file."""
    refs = split_by_volume(refs, ["part", "at"], ("shard", "offset"))
    new = [c.split()[0] for c in columns.split(", ")]
    at = [refs.columns.index(c) for c in ("shard", "offset", "length", "start", "n_tokens")]

    @settled("repair")
    def run(batches):
        reader, held, data, first = RangeReader(), (None, None), np.empty(0, "<u4"), 0
        try:
            for batch in batches:
                rows, known = [], list(zip(*[batch.column(i).to_pylist() for i in at], strict=True))
                for k, (shard, offset, length, start, n) in enumerate(known):
                    if held[0] != (shard, offset):
                        held, data = ((shard, offset), Segment(reader.read(shard, offset, length))), data[:0]
                    if not first <= start <= start + n <= first + len(data):
                        # The documents that follow at once are decoded with it, up to READ ids.
                        stop = start + n
                        for s, o, _, a, m in islice(known, k + 1, None):
                            if (s, o) != held[0] or a != stop or stop + m - start > READ:
                                break
                            stop += m
                        first, data = start, held[1].ids(start, stop)
                    rows.append(work(data[start - first : start - first + n]))
                more = [pa.array([r[k] for r in rows], t) for k, t in enumerate(types)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, *new])
        finally:
            reader.close()

    return refs.mapInArrow(run, ", ".join(f"`{c}` {t}" for c, t in refs.dtypes) + ", " + columns)


def checksums(refs: DataFrame) -> DataFrame:
    """``refs`` with the number of ids read back and their CRC-32 as little-endian uint32."""
    return read_ids(refs, "n_read bigint, ids_crc32 bigint", [pa.int64(), pa.int64()], lambda ids: (len(ids), zlib.crc32(ids.tobytes())))
