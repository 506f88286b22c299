"""Benchmark decontamination by the q-gram lemma and banded alignment.

A passage of length L that occurs in a document with at most e edits shares at least L - q + 1 - q * e of its character
q-grams with it, and all of them lie on diagonals (document position minus passage position) no further apart than e.
So shared q-grams are counted in overlapping bands of diagonals, each as wide as two budgets, which means that some band
holds the whole of any occurrence.  Bands that meet the bound and touch are one region, and regions are verified by an
alignment: confined to their diagonals where a text has few of them, else many passages side by side in bit vectors.

The passages are indexed once and shipped to the executors only while their total length is below a stated bound;
a larger benchmark is worked through in parts, one after another, each below the bound.  Documents are never shuffled.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.batches import settled, small_batches, text_chunks
from weftline.plans.shared import Stash

Q = 8
EDITS = 0.1  # edit budget as a share of a passage's length
SHORTEST = 40  # characters below which a passage is looked for without edits
WINDOW = 600  # longer passages are looked for in windows of this length, overlapping by half
MAX_INDEX_CHARS = 8_000_000  # benchmark characters indexed in one pass
MAX_HITS = 1 << 21  # pairs of equal grams held at once
MAX_CHARS = 1 << 16  # characters of a text looked at together
NEAR = 4  # lengths of a passage between bands that are aligned as one region
TOGETHER, MAX_TOGETHER = 12, 1024  # regions of one text from which on, and up to which, they are aligned side by side
CHUNK = 1 << 20
U = np.uint64
MIX = 0x9E3779B97F4A7C15


def normal(text: str | None) -> str:
    """Lower case, each run of white space as one blank."""
    return " ".join(text.lower().split()) if text else ""


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def grams(c: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of the ``q`` characters from each position (``q`` a power of two)."""
    h, width = (c.astype(U) + U(1)) * U(MIX), 1
    factor = MIX
    while width < q:
        h = h[:-width] * U(factor) + h[width:] if len(h) > width else h[:0]
        width, factor = 2 * width, factor * factor & 0xFFFFFFFFFFFFFFFF | 1
    return h ^ (h >> U(29))


class Index:
    """Passages, or windows of long ones, by their q-grams; those shorter than a q-gram by their words."""

    def __init__(self, items: list[tuple], q: int = Q, edits: float = EDITS, shortest: int = SHORTEST, window: int = WINDOW):
        self.q, self.units = q, []
        #: Passages shorter than a q-gram: words joined by blanks -> numbers of units.
        self.tiny: dict[str, list[int]] = {}
        for item, text in items:
            text = normal(text)
            if not text:
                continue
            if len(text) < q:
                self.tiny.setdefault(text, []).append(len(self.units))
            starts = range(0, max(1, len(text) - window // 2), window // 2) if len(text) > window else [0]
            for s in starts:
                part = text[s : s + window] if len(text) > window else text
                budget = min(int(edits * len(part)), (len(part) - q) // q) if len(text) >= shortest else 0
                self.units.append((item, s, part, max(0, budget)))
        self.shortest = shortest
        self.words = sorted({t.count(" ") + 1 for t in self.tiny})
        self.length = np.array([len(u[2]) for u in self.units], np.int64)
        self.budget = np.array([u[3] for u in self.units], np.int64)
        self.need = np.maximum(self.length - q + 1 - q * self.budget, 1)
        self.reach = int((self.length + self.budget).max()) if self.units else 0
        found = [grams(codes(u[2]), q) for u in self.units]
        keys = np.concatenate(found) if found else np.empty(0, U)
        unit = np.repeat(np.arange(len(found)), [len(f) for f in found])
        at = np.concatenate([np.arange(len(f)) for f in found]) if found else np.empty(0, np.int64)
        #: Distinct grams in order; entries are ordered by gram and unit, so a range of units of a gram is a range of them.
        self.keys, rank = np.unique(keys, return_inverse=True)
        place = rank * max(1, len(found)) + unit
        order = np.argsort(place, kind="stable")
        self.place, self.at = place[order], at[order].astype(np.int32)
        self.bits = max(16, min(26, int(2 * len(keys) + 1).bit_length() + 4))
        self.seen = np.zeros(1 << self.bits, bool)
        self.seen[self.keys >> U(64 - self.bits)] = True


def banded(unit: np.ndarray, segment: np.ndarray, low: int, width: int) -> tuple[int, int]:
    """Fewest edits turning ``unit`` into a substring of ``segment``, and where that ends.

    Only alignments whose diagonals (segment position minus unit position) lie in ``low .. low + width - 1`` count.
    """
    big = 1 << 30
    band = np.arange(width)
    j = low + band
    row = np.where((j >= 0) & (j <= len(segment)), 0, big)
    for i in range(1, len(unit) + 1):
        j = low + band + i
        inside = (j >= 1) & (j <= len(segment))
        same = np.zeros(width, bool)
        same[inside] = segment[j[inside] - 1] == unit[i - 1]
        step = np.where(inside, row + ~same, big)
        step[:-1] = np.minimum(step[:-1], row[1:] + 1)
        step = np.where((j >= 0) & (j <= len(segment)), step, big)
        row = np.minimum(np.minimum.accumulate(step - band) + band, big)
        row = np.where((j >= 0) & (j <= len(segment)), row, big)
    best = int(np.argmin(row))
    return int(row[best]), low + best + len(unit)


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def fewest(patterns: list[np.ndarray], segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each pattern the fewest edits that turn it into a substring of ``segment``, and where the first such one ends.

    The columns of all alignments are held as bit vectors of vertical differences (Myers 1999, Hyyrö 2003), a row of
    words for all patterns together.  Patterns are filled up in front with characters that match everything, and so is
    the segment, which leaves the distances as they are.
    """
    words = max(1, -(-max(map(len, patterns)) // 64))
    wide, n = 64 * words, len(patterns)
    cells = np.full((n, wide), -1, np.int64)
    for i, p in enumerate(patterns):
        cells[i, wide - len(p) :] = p
    free = cells < 0

    def bits(match: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(np.packbits(match, axis=1, bitorder="little").view(U).T)

    equal = {int(c): bits((cells == c) | free) for c in np.unique(segment)}
    filler = bits(free)
    up, down = np.full((words, n), ~U(0)), np.zeros((words, n), U)
    score = np.full(n, wide, np.int64)
    best, end = np.full(n, 1 << 30, np.int64), np.zeros(n, np.int64)
    for j in range(-wide, len(segment) + 1):
        if j >= 0:
            better = score < best
            best[better], end[better] = score[better], j
            if j == len(segment):
                break
        eq = equal[int(segment[j])] if j >= 0 else filler
        xv, add = eq | down, eq & up
        xh = add + up
        for w in range(words - 1):  # the sum's carry from one word to the next
            over = xh[w] < up[w]
            if w and carry.any():
                over |= carry & (xh[w] == ~U(0))
                xh[w] += carry
            carry = over
        if words > 1:
            xh[-1] += carry
        xh = (xh ^ up) | eq
        more, less = down | ~(xh | up), up & xh
        score += (more[-1] >> U(63)).astype(np.int64)
        score -= (less[-1] >> U(63)).astype(np.int64)
        for v in (more, less):
            top = v[:-1] >> U(63)
            v <<= U(1)
            v[1:] |= top
        up, down = less | ~(xv | more), more & xv
    return best, end


def _regions(index: Index, h: np.ndarray, at: np.ndarray, base: np.ndarray, docs: tuple[int, int], units: tuple[int, int]) -> list[tuple[int, int, int, int]]:
    """``(text, unit, low, high)``: diagonals (position in the text minus position in the unit) to be aligned.

    ``h`` are the ranks of known grams at positions ``at`` of the joined texts.  More pairs of equal grams than a bound
    are worked through in halves of the texts, then of the units; for one text and one unit the whole text is aligned.
    """
    n_units = len(index.units)
    a, z = np.searchsorted(at, base[docs[0]]), np.searchsorted(at, base[docs[1]])
    if a == z:
        return []
    r, where = h[a:z], at[a:z]
    lo, hi = np.searchsorted(index.place, r * n_units + units[0]), np.searchsorted(index.place, r * n_units + units[1])
    n = hi - lo
    if (total := int(n.sum())) > MAX_HITS:
        if docs[1] - docs[0] > 1:
            half = (docs[0] + docs[1]) // 2
            parts = [((docs[0], half), units), ((half, docs[1]), units)]
        elif units[1] - units[0] > 1:
            half = (units[0] + units[1]) // 2
            parts = [(docs, (units[0], half)), (docs, (half, units[1]))]
        else:
            d, u = docs[0], units[0]
            return [(d, u, -int(index.length[u]), int(base[d + 1] - base[d]))]
        return [x for d, u in parts for x in _regions(index, h, at, base, d, u)]
    if not total:
        return []
    entry = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(total)
    where, unit, inner = np.repeat(where, n), index.place[entry] % n_units, index.at[entry].astype(np.int64)
    doc = np.searchsorted(base, where, "right") - 1
    diagonal = where - base[doc] - inner + index.length[unit]  # not negative
    step = index.budget[unit] + 1
    band = diagonal // step
    # A gram of the passage counts once in a band, however often it occurs there.
    spread = int(band.max()) + 2
    group = ((doc - docs[0]) * n_units + unit) * spread + band
    group = np.concatenate([group, group[band > 0] - 1])
    inner = np.concatenate([inner, inner[band > 0]])
    width = int(index.length.max())
    if int(group.max()) < (1 << 62) // width:
        group = distinct(group * width + inner) // width
    else:
        group = np.unique(np.stack([group, inner]), axis=1)[0]
    begin = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    group, count = group[begin], np.diff(np.concatenate([begin, [len(group)]]))
    pair = group // spread
    good = count >= index.need[pair % n_units]
    pair, band = pair[good], (group % spread)[good]
    if not len(pair):
        return []
    # Bands of one passage in one text that lie near each other are one region.
    near = 2 + NEAR * index.length[pair % n_units] // (index.budget[pair % n_units] + 1)
    first = np.flatnonzero(np.concatenate([[True], (pair[1:] != pair[:-1]) | (band[1:] > band[:-1] + near[1:])]))
    last = np.concatenate([first[1:], [len(pair)]]) - 1
    unit = pair[first] % n_units
    step, length = index.budget[unit] + 1, index.length[unit]
    low, high = band[first] * step - length, (band[last] + 2) * step - length
    return list(zip((pair[first] // n_units + docs[0]).tolist(), unit.tolist(), low.tolist(), high.tolist(), strict=True))


def _aligned(index: Index, text: str, wanted: list[tuple[int, int, int]]) -> list[tuple]:
    """Verified ``(unit, edits, start, end)`` among regions ``(unit, low, high)`` of one text."""
    out, open_ = [], []
    for u, low, high in wanted:
        _, _, passage, budget = index.units[u]
        first = max(0, low - budget)
        to = min(len(text), high + len(passage) + budget)
        if (exact := text.find(passage, first, to)) >= 0:
            out.append((u, 0, exact, exact + len(passage)))
        elif budget:
            open_.append((u, first, to, low, high))
    found = []
    if len(open_) < TOGETHER:
        for u, first, to, low, high in open_:
            _, _, passage, budget = index.units[u]
            edits, end = banded(codes(passage), codes(text[first:to]), low - first - budget, high - low + 2 * budget)
            found.append((u, edits, first + end))
    else:
        for k in range(0, len(open_), MAX_TOGETHER):
            part = sorted(open_, key=lambda x: int(index.length[x[0]]))[k : k + MAX_TOGETHER]
            first, to = min(x[1] for x in part), max(x[2] for x in part)
            edits, end = fewest([codes(index.units[x[0]][2]) for x in part], codes(text[first:to]))
            found += [(x[0], int(e), first + int(z)) for x, e, z in zip(part, edits, end, strict=True)]
    for u, edits, end in found:
        _, _, passage, budget = index.units[u]
        if edits <= budget:
            tail = codes(text[max(0, end - len(passage) - budget) : end])[::-1]
            _, size = banded(codes(passage)[::-1], tail, -budget, 2 * budget + 1)
            out.append((u, edits, end - size, end))
    return out


def leaks(index: Index, texts: list[str | None]) -> list[list[tuple]]:
    """For each text the verified occurrences ``(unit, edits, start, end)`` in its normal form, best one per passage.

    Long texts are cut into windows that overlap by more than any occurrence, so memory does not follow their length.
    """
    out: list[list[tuple]] = [[] for _ in texts]
    q, norm = index.q, [normal(t) for t in texts]
    if not index.units or not norm:
        return out
    pieces = []  # (text, where it begins)
    for d, t in enumerate(norm):
        step = max(MAX_CHARS, 4 * index.reach)
        pieces += [(d, s) for s in range(0, max(1, len(t) - 2 * index.reach), step)]
    cut = [norm[d][s : s + max(MAX_CHARS, 4 * index.reach) + 2 * index.reach] for d, s in pieces]
    base = np.cumsum([0] + [len(t) + 1 for t in cut])
    h = grams(codes("\0".join(cut)), q)
    at = np.flatnonzero(index.seen[h >> U(64 - index.bits)]) if len(h) else np.empty(0, np.int64)
    h = h[at]
    rank = np.minimum(np.searchsorted(index.keys, h), max(0, len(index.keys) - 1))
    real = index.keys[rank] == h if len(index.keys) else np.zeros(len(h), bool)
    regions: dict[int, list] = {}
    for piece, u, low, high in _regions(index, rank[real], at[real], base, (0, len(cut)), (0, len(index.units))):
        regions.setdefault(piece, []).append((u, low, high))
    for piece, wanted in regions.items():
        d, s = pieces[piece]
        out[d] += [(u, e, s + a, s + b) for u, e, a, b in _aligned(index, cut[piece], wanted)]
    if index.tiny:
        for d, t in enumerate(norm):
            out[d] += _tiny(index, t)
    for d, found in enumerate(out):
        best: dict[int, tuple] = {}
        for x in sorted(found, key=lambda x: (x[1], x[2], x[3], x[0])):
            best.setdefault(index.units[x[0]][0], x)
        out[d] = sorted(best.values())
    return out


def _tiny(index: Index, text: str) -> list[tuple]:
    """Whole-word occurrences of passages shorter than a q-gram."""
    words, out = text.split(" "), {}
    starts = np.cumsum([0] + [len(w) + 1 for w in words])
    for k in index.words:
        for i in range(len(words) - k + 1):
            run = " ".join(words[i : i + k])
            if run in index.tiny and run not in out:
                out[run] = int(starts[i])
    return [(u, 0, at, at + len(run)) for run, at in out.items() for u in index.tiny[run]]


def _indexes(benchmark: DataFrame, item_id: str, text: str, **options):
    """One index for each part of the benchmark; a part is collected only below the bound."""
    items = benchmark.select(F.col(f"`{item_id}`").alias("item"), F.col(f"`{text}`").cast("string").alias("text"))
    items = items.where("text IS NOT NULL AND item IS NOT NULL").distinct()
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = math.ceil(2 * total / MAX_INDEX_CHARS) if total > MAX_INDEX_CHARS else 1
    for p in range(parts):
        part = items.where(F.pmod(F.xxhash64("text"), F.lit(parts)) == p).orderBy("item", "text")
        yield Index([(r.item, r.text) for r in part.toLocalIterator()], **options)


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", **options
) -> DataFrame:
    """Passages of ``benchmark`` that occur in ``docs`` with at most 10 % edits.

    Returns ``(doc_id, item_id, edits, start, end)``, the best occurrence of each passage in each document; positions
    are characters of the normal form (lower case, one blank for each run of white space).  Documents without a leak
    have no row; null and empty texts have none.  Passages under 40 characters are looked for without edits, those
    shorter than a q-gram as whole words; null and empty ones are not looked for.
    Repeated documents give repeated rows, a passage that occurs under several ids gives one row for each; an empty
    table on either side gives none.  Other columns are ignored.
    """
    spark, stash = docs.sparkSession, Stash(docs.sparkSession)
    base = small_batches(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text")))
    kinds = dict(base.dtypes) | {"item": dict(benchmark.dtypes)[item_id]}
    schema = f"doc_id {kinds['doc_id']}, item_id {kinds['item']}, edits bigint, start bigint, end bigint"

    def search(index: Index) -> DataFrame:
        held = spark.sparkContext.broadcast(index)

        @settled("decontaminate")
        def run(batches):
            ix = held.value
            for batch in batches:
                for part in text_chunks(batch, "text", CHUNK):
                    found = leaks(ix, part.column(1).to_pylist())
                    rows = [(i, x) for i, xs in enumerate(found) for x in xs]
                    who = part.column(0).take(pa.array([i for i, _ in rows], pa.int64()))
                    cols = [pa.array([x[k] for _, x in rows], pa.int64()) for k in (1, 2, 3)]
                    yield pa.RecordBatch.from_pydict({"doc_id": who, "item_id": [ix.units[x[0]][0] for _, x in rows], "edits": cols[0], "start": cols[1], "end": cols[2]}) if rows else _empty(part)

        return base.mapInArrow(run, schema)

    def _empty(part):
        none = pa.array([], pa.int64())
        return pa.RecordBatch.from_arrays([part.column(0).slice(0, 0), none, none, none, none], names=["doc_id", "item_id", "edits", "start", "end"])

    return _one_by_one(_indexes(benchmark, item_id, item_text, **options), lambda index, out: out.union(search(index)) if out is not None else search(index), None, stash)


def _one_by_one(indexes, step, out, stash: Stash):
    """Apply ``step(index, out)`` for each index; all results but the last are written, so a worker holds one index."""
    at, before = next(indexes), None
    for index in indexes:
        out = stash.keep(step(at, out), "leaks")
        stash.drop(before)
        at, before = index, out
    return step(at, out)


def without_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` whose text holds no passage of ``benchmark``, with all their columns and no shuffle.

    Rows with a null or empty text stay; repeated rows are judged alike.
    """
    spark, stash = docs.sparkSession, Stash(docs.sparkSession)
    position = docs.columns.index(text)

    def clean(index: Index, rows: DataFrame) -> DataFrame:
        held = spark.sparkContext.broadcast(index)

        @settled("decontaminate")
        def run(batches):
            for batch in batches:
                if not batch.num_rows:
                    continue
                sized = batch.rename_columns([f"c{i}" for i in range(batch.num_columns)])
                for part in text_chunks(sized, f"c{position}", CHUNK):
                    found = leaks(held.value, part.column(position).to_pylist())
                    good = part.filter(pa.array([not x for x in found]))
                    yield good.rename_columns(batch.schema.names)

        return small_batches(rows).mapInArrow(run, rows.schema)

    return _one_by_one(_indexes(benchmark, item_id, item_text, **options), clean, docs, stash)
