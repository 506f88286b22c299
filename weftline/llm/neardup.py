"""Near-duplicate groups by SuperMinHash, banding, exact verification and union-find.

1.  One pass over the texts turns each document into its set of distinct word n-grams (64-bit hashes), a 128-bit digest
    of that set, and a SuperMinHash signature (Ertl 2017): element x takes the registers in the order of its own random
    permutation and offers register p(j) the value j + r, so ranks within a signature are correlated, estimates have
    less variance than with independent hashes, and a document stops as soon as every register is filled from lower
    ranks.
2.  Documents with equal sets collapse into one class, named by the digest.
3.  Bands of registers put classes into buckets.  Buckets never expand into all pairs: each class is first compared
    with one leader, links are grouped by union-find, and a bucket whose members then agree on their group is done.
    In the others more members become leaders, in growing numbers, until the bucket is settled, so
    every pair of a bucket is compared, already connected, or too far apart by its items beside those of a common
    leader, whatever the size of the bucket.  Buckets whose members have several leaders are given a common one.
4.  A pair is a link only if its full sets confirm it.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.batches import settled, small_batches, text_chunks
from weftline.operators.components import components
from weftline.plans.shared import Stash

ROWS, BANDS = 4, 32
U = np.uint64
CHUNK = 1 << 20
BLOCK = 1 << 18
FIRST_LEADERS = 32
SPACE = re.compile(rb"[\x20\x09-\x0D]").search


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words (the finaliser of splitmix64)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def shingles(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct hashes of the word ``n``-grams of a text: A-Z lower-cased, cut at ASCII white space.

    Fewer than ``n`` words give one shingle of them all; no words or a null text give none.  A text is cut into words by
    stretches, so beside it only eight bytes a word are held.
    """
    raw = text.encode("utf-8", "surrogatepass").lower() if text else b""
    found, at = [], 0
    while at < len(raw):
        cut = SPACE(raw, at + CHUNK)
        to = cut.start() if cut else len(raw)
        words = raw[at:to].split()
        found.append(np.fromiter(map(xxhash.xxh3_64_intdigest, words), U, len(words)))
        at = to
    h = np.concatenate(found) if found else np.empty(0, U)
    if not len(h):
        return h
    k = min(n, len(h))
    out = np.full(len(h) - k + 1, U(k))
    for i in range(k):
        out = mix(out ^ h[i : len(h) - k + 1 + i]) + U(0x9E3779B97F4A7C15)
    return np.unique(out)


def signatures(sets: list[np.ndarray], m: int) -> np.ndarray:
    """SuperMinHash signatures of many sets at once, one row each; empty sets have a row of the largest value.

    Elements are taken by blocks, which bounds memory whatever the length of a text.  Round j handles the j-th rank of a
    block's elements together; sets whose registers all hold values of that rank or less drop out, as later ranks can
    only offer larger ones.
    """
    out = np.full((len(sets), m), U(0xFFFFFFFFFFFFFFFF), U)
    sizes = np.array([len(s) for s in sets])
    if not sizes.sum():
        return out
    all_x, all_owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    for at in range(0, len(all_x), BLOCK):
        _offer(out, all_x[at : at + BLOCK], all_owner[at : at + BLOCK], m)
    return out


def _offer(out: np.ndarray, x: np.ndarray, owner: np.ndarray, m: int) -> None:
    """Let a block of elements offer their values to the registers of their sets."""
    flat = out.reshape(-1)
    perm = np.tile(np.arange(m, dtype=np.uint8), (len(x), 1))
    for j in range(m):
        z = mix(x + U((j + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        k = j + ((z >> U(32)) * U(m - j) >> U(32)).astype(np.int64)
        rows = np.arange(len(x))
        slot = perm[rows, k]
        perm[rows, k] = perm[:, j]
        perm[:, j] = slot
        np.minimum.at(flat, owner * m + slot, (U(j) << U(56)) | (mix(z) >> U(8)))
        low = owner[0]
        open_ = ((out[low : owner[-1] + 1].max(axis=1) >> U(56)) > U(j))[owner - low]
        if not open_.any():
            break
        if not open_.all():
            owner, x, perm = owner[open_], x[open_], perm[open_]


def _sign(n: int, rows: int, bands: int):
    @settled("neardup")
    def run(batches):
        for batch in batches:
            for part in text_chunks(batch, "text", CHUNK):
                sets = [shingles(t, n) for t in part.column(1).to_pylist()]
                sig = signatures(sets, rows * bands).reshape(len(sets), bands, rows)
                keys = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=U)), (len(sets), bands))
                for i in range(rows):
                    keys = mix(keys ^ sig[:, :, i])
                digests = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                lists = [k.tolist() if d else None for k, d in zip(keys.view(np.int64), digests, strict=True)]
                cols = [part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array(lists, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([*cols, *part.columns[2:]], names=["doc_id", "n_shingles", "digest", "bands", *part.schema.names[2:]])

    return run


def _sets(n: int):
    @settled("neardup")
    def run(batches):
        for batch in batches:
            for part in text_chunks(batch, "text", CHUNK):
                sets = [shingles(t, n).tobytes() for t in part.column(1).to_pylist()]
                names = [xxhash.xxh3_128_digest(s) for s in sets]
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(sets, pa.binary())], names=["rep", "items"])

    return run


def _verify(percent: int, rest: bool):
    """Pairs whose full sets are similar enough; with ``rest`` all pairs, a flag, and the items of b that a lacks."""

    @settled("neardup")
    def run(batches):
        for batch in batches:
            left, right = batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1)
            good, lacking = np.zeros(batch.num_rows, bool), []
            for i in range(batch.num_rows):
                a, b = np.frombuffer(left[i].as_buffer(), U), np.frombuffer(right[i].as_buffer(), U)
                shared = a[np.minimum(np.searchsorted(a, b), len(a) - 1)] == b
                same = int(shared.sum())
                good[i] = 100 * same >= percent * (len(a) + len(b) - same)
                if rest:
                    lacking.append(b[~shared].view(np.int64))
            mask = pa.array(good)
            if rest:
                cols = [*batch.columns[:-2], mask, pa.array(lacking, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(cols, names=["a", "b", "size", "pull", "linked", "rest"])
            else:
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])

    return run


def base_columns(doc_id: str, text: str) -> list[Column]:
    return [F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text")]


def near_duplicates(
    docs: DataFrame, n: int = 5, percent: int = 80, rows: int = ROWS, bands: int = BANDS, doc_id: str = "doc_id", text: str = "text",
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """Group documents whose sets of word ``n``-grams have a Jaccard similarity of ``percent`` / 100 or more.

    Returns ``(doc_id, n_shingles, component_id, kept)``, one row per row of ``docs``; other columns are left out.
    ``component_id`` is the smallest id reachable over links, ``kept`` marks the document that bears it.  With the
    default bands a link at exactly 0.8 is found with probability 1 - 5e-8, closer ones more surely.

    A null or empty text has no shingles and is linked with nothing: its component is its own id.  Rows are grouped by
    text, so repeated rows fall into one group and all bear the smallest id (all are kept; they are one document), and
    rows of one id with different texts are grouped by their own texts.  A row without id takes the component of its
    text, which is null where no row of the group has an id, and is kept only there.  An empty table gives no rows.
    Long texts are read by stretches; a document needs some 40 bytes of memory a word.

    ``carry`` names further columns to return; with them comes ``group``, which is equal for the rows of one component,
    with or without ids, and null for rows without shingles.
    """
    stash = Stash(docs.sparkSession)
    base = small_batches(docs.select(*base_columns(doc_id, text)))
    carried = docs.select(*base_columns(doc_id, text), *[F.col(f"`{c}`").alias(f"carried_{c}") for c in carry])
    kinds = "".join(f", `{c}` {t}" for c, t in carried.dtypes[2:])
    signed = carried.mapInArrow(_sign(n, rows, bands), "doc_id bigint, n_shingles bigint, digest binary, bands array<bigint>" + kinds)
    signed = stash.keep(signed, "signed")
    classes = signed.where("digest IS NOT NULL").groupBy(F.col("digest").alias("rep"))
    classes = stash.keep(
        classes.agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("size"), F.first("bands").alias("bands")), "classes"
    )
    group = classes.select("rep", "id").join(_groups(stash, base, classes, n, percent), "rep", "left")
    group = stash.keep(group.select("rep", "id", F.coalesce("comp", "rep").alias("comp")), "groups")
    least = group.groupBy("comp").agg(F.min("id").alias("component_id"))
    named = group.join(least, "comp").select(F.col("rep").alias("digest"), "component_id", F.col("comp").alias("group"))
    out = signed.drop("bands").join(named, "digest", "left")
    component = F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    extra = [F.col("group")] * bool(carry) + [F.col(f"`carried_{c}`").alias(c) for c in carry]
    out = out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), *extra)
    return stash.only(stash.keep(out, "near-duplicates"))


def _groups(stash: Stash, base: DataFrame, classes: DataFrame, n: int, percent: int) -> DataFrame:
    """``(rep, comp)`` of the classes with a verified link, over links that connect all that the buckets can connect."""
    spread = classes.select("rep", "size", F.explode("bands").alias("key"))
    shared = spread.groupBy("key").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    drawn = stash.keep(spread.join(shared, "key"), "drawn")
    # The class whose buckets hold most others is the centre of a group of copies and leads its buckets.
    pull = drawn.groupBy("rep").agg(F.sum("k").alias("pull"))
    member = stash.keep(drawn.select("key", "rep", "size").join(pull, "rep"), "buckets")
    stash.drop(drawn)
    wanted = classes.join(member.select("rep").distinct(), "rep", "left_semi").select(F.col("id").alias("doc_id")).distinct()
    # Candidates grow with the input: both sides are shuffled at every size, never broadcast.
    texts = base.join(wanted.hint("merge"), base["doc_id"].eqNullSafe(wanted["doc_id"]), "left_semi")
    sets = stash.keep(texts.mapInArrow(_sets(n), "rep binary, items binary").dropDuplicates(["rep"]), "sets")

    def alike(a: str, b: str):
        return (F.least(a, b) * 100 >= F.greatest(a, b) * percent) & (F.least(a, b) > 0)

    def verified(pairs: DataFrame, rest: bool = False) -> DataFrame:
        left = sets.select(F.col("rep").alias("a"), F.col("items").alias("x"))
        right = sets.select(F.col("rep").alias("b"), F.col("items").alias("y"))
        both = pairs.join(left, "a").join(right, "b").select(*pairs.columns, "x", "y")
        return both.mapInArrow(_verify(percent, rest), "a binary, b binary" + ", size bigint, pull bigint, linked boolean, rest array<bigint>" * rest)

    def within(size: str, own: str, other: str, more=0):
        """Whether an overlap of all but the own items, and ``more`` of those, would do for a partner of that size."""
        overlap = F.col(size) - F.col(own) + more
        return overlap * 100 >= (F.col(other) + F.col(size) - overlap) * percent

    def grouped(links: DataFrame) -> DataFrame:
        comp = components(links, "a", "b")
        return stash.keep(comp.select(F.col("v").alias("rep"), "comp"), "components")

    def unsettled(rows: DataFrame, comp: DataFrame) -> DataFrame:
        """Members of the buckets that hold more than one component, with what is said of their bucket."""
        named = rows.drop("comp", "low", "closed", "main").join(comp, "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
        named = stash.keep(named, "named")
        keys = named.groupBy("key").agg(
            F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("size").alias("low"),
            (F.min("ref") == F.max("ref")).alias("closed"), F.max(F.struct("pull", "ref", "linked", "comp"))["comp"].alias("main"),
        )
        open_ = stash.keep(named.join(keys.where("lo <> hi").drop("lo", "hi"), "key"), "open")
        stash.drop(named)
        return open_

    # First each class against one leader, the greatest that its buckets offer, of a size that allows a link if there is one.
    lead = member.groupBy("key").agg(F.max(F.struct("pull", "rep", "size")).alias("lead"))
    first = member.join(lead, "key").where(F.col("rep") != F.col("lead.rep"))
    offer = F.struct(alike("size", "lead.size").alias("near"), F.col("lead.pull").alias("pull"), F.col("lead.rep").alias("rep"))
    first = first.groupBy("rep").agg(F.max(offer).alias("lead"), F.first("size").alias("size"))
    first = first.select(F.col("lead.rep").alias("a"), F.col("rep").alias("b"), "size", F.col("lead.pull").alias("pull"))
    star = stash.keep(verified(first, rest=True), "star")
    comp = grouped(star.where("linked"))
    ref = star.select(F.col("b").alias("rep"), F.col("a").alias("ref"), F.col("pull").alias("above"), "linked")
    placed = member.join(ref, "rep", "left").select(
        "key", "rep", "size", F.coalesce("above", "pull").alias("pull"), F.coalesce("ref", "rep").alias("ref"), F.coalesce("linked", F.lit(True)).alias("linked")
    )
    open_ = unsettled(placed, comp)
    stash.drop(member)
    # The reference of a leader's classes is what it holds and what most of them hold besides.  Two classes share at most
    # what both have of the reference and what both have beside it.  So a pair that needs a share of the latter to be a
    # link meets in an index over the rarest of those items (a class of s items, t of them its own, must share all but
    # (100 - percent) % of s, so one of its first (100 - percent) % of s + 1 own items), and remains if the shared ones
    # and those outside the index would do.  Only leaders met in open buckets matter.
    def indexed(about: DataFrame) -> tuple[DataFrame, DataFrame]:
        """How many own items the classes of each reference have, and the pairs ``(a, b)`` that remain by the index.

        ``about`` has ``(ref, rep, size, minor, comp, rest)``, where ``rest`` are items beside those of the reference that
        are not yet told from what most hold.  Pairs without a minor class, or of one ``comp``, are left out.
        """
        spare = about.select("ref", "rep", "size", "minor", F.col("comp").alias("side"), F.explode("rest").alias("x"))
        tally = spare.groupBy("ref", "x").agg(F.count(F.lit(1)).alias("c")).join(about.groupBy("ref").agg(F.count(F.lit(1)).alias("k")), "ref")
        spare = stash.keep(spare.join(tally.where("2 * c <= k").select("ref", "x", "c"), ["ref", "x"]), "spare")
        own = stash.keep(spare.groupBy("ref", "rep").agg(F.count(F.lit(1)).alias("own")), "own")
        rarest = spare.withColumn("place", F.row_number().over(Window.partitionBy("ref", "rep").orderBy("c", "x")))
        room = F.floor(F.col("size") * (100 - percent) / 100) + 1
        rarest = rarest.where((F.col("c") > 1) & (F.col("place") <= room)).join(own, ["ref", "rep"])
        rarest = rarest.select("ref", "x", "rep", "size", "minor", "side", "own", F.greatest(F.lit(0), F.col("own") - room).alias("out"))
        rarest = stash.keep(rarest, "rarest")
        left = rarest.where("minor").select("ref", "x", *[F.col(c).alias(f"l_{c}") for c in ("rep", "size", "side", "own", "out")])
        met = left.join(rarest, ["ref", "x"]).where((F.col("side") != F.col("l_side")) & alike("size", "l_size"))
        met = met.groupBy("ref", "l_rep", "rep", "l_size", "size", "l_own", "own", "l_out", "out").agg(F.count(F.lit(1)).alias("c"))
        most = F.least(F.col("c") + F.col("l_out") + F.col("out"), F.col("own"), F.col("l_own"))
        met = met.where(within("size", "own", "l_size", most) & within("l_size", "l_own", "size", most))
        met = stash.keep(met.select(F.least("l_rep", "rep").alias("a"), F.greatest("l_rep", "rep").alias("b")).distinct(), "pairs")
        stash.drop(spare, rarest)
        return own, met

    ahead = F.when(F.col("linked"), F.col("a")).otherwise(F.col("b"))
    about = star.select(F.col("b").alias("rep"), F.col("a").alias("ref"), "size", (~F.col("linked")).alias("minor"), ahead.alias("comp"), "rest")
    about = stash.keep(about.join(open_.select("ref").distinct(), "ref", "left_semi"), "about")
    own, met = indexed(about)

    def joined(comp: DataFrame, pairs: DataFrame) -> DataFrame:
        """Components after the links among ``pairs``; those known so far count as links themselves."""
        links = stash.keep(verified(pairs), "links")
        after = grouped(links.union(comp.select(F.col("rep").alias("a"), F.col("comp").alias("b"))))
        stash.drop(comp, pairs, links)
        return after

    comp = joined(comp, met)
    member = open_.join(own.drop("ref"), "rep", "left").withColumn("own", F.coalesce("own", F.lit(0)))
    member, before = unsettled(member, comp), open_
    stash.drop(before, star, about, own)

    leaders = FIRST_LEADERS
    while True:
        # In a bucket whose members have one leader, a member whose own items rule out even the smallest partner has no
        # partner left there: what members share of those items has been counted above.  It leaves the bucket.
        fresh = member.where(~(F.col("closed") & ~within("size", "own", "low")))
        minors = fresh.where("comp <> main").groupBy("key").agg(F.count(F.lit(1)).alias("minors"))
        fresh = stash.keep(fresh.join(minors, "key").drop("low", "closed"), "fresh")
        stash.drop(member)
        if fresh.isEmpty():
            stash.drop(sets, fresh)
            return comp
        # The members nearest to the reference lead first, as others most likely link to them; members outside the
        # main component lead when they have become few.  Who has led meets nobody again.
        order = Window.partitionBy("key").orderBy("own", F.xxhash64("rep"), "rep")
        inner = fresh.where("comp = main").withColumn("turn", F.row_number().over(order)).where(F.col("turn") <= leaders).drop("turn")
        lead = inner.union(fresh.where((F.col("comp") != F.col("main")) & (F.col("minors") <= leaders)))
        lead = stash.keep(lead.select("key", *[F.col(c).alias(f"l_{c}") for c in ("rep", "size", "comp", "ref", "own")]), "lead")
        apart = (F.col("comp") != F.col("l_comp")) & alike("size", "l_size") & (F.col("ref") != F.col("l_rep")) & (F.col("rep") != F.col("l_ref"))
        bound = (F.col("ref") != F.col("l_ref")) | (within("size", "own", "l_size") & within("l_size", "l_own", "size"))
        pairs = lead.join(fresh, "key").where(apart & bound)
        pairs = stash.keep(pairs.select(F.least("l_rep", "rep").alias("a"), F.greatest("l_rep", "rep").alias("b")).distinct(), "pairs")
        comp = joined(comp, pairs)
        rest = fresh.drop("minors").join(lead.select("key", F.col("l_rep").alias("rep")), ["key", "rep"], "left_anti")
        member = unsettled(rest, comp)
        stash.drop(fresh, lead)
        leaders *= 4
        # Classes of several leaders that are still together share, say, a passage.  Such buckets with what other buckets
        # they share classes with form an area, whose classes get one leader as their reference and an index of their own.
        mixed = member.where("NOT closed")
        if mixed.isEmpty():
            continue
        bucket = F.concat(F.lit("bucket "), F.col("key").cast("string")).cast("binary")
        area = components(mixed.select(bucket.alias("u"), F.col("rep").alias("v"))).select(F.col("v").alias("rep"), F.col("comp").alias("area"))
        each = stash.keep(mixed.select("rep", "size", "pull", "ref", "linked", "comp").distinct().join(area, "rep"), "areas")
        hub = each.groupBy("area").agg(F.max(F.struct("pull", "ref", "linked", "comp")).alias("hub"))
        hub = each.join(hub, "area").select("rep", "size", "pull", "comp", F.col("hub.ref").alias("hub"), (F.col("comp") != F.col("hub.comp")).alias("minor"))
        hub = stash.keep(hub, "hubs")
        star = hub.where("hub <> rep").select(F.col("hub").alias("a"), F.col("rep").alias("b"), "size", "pull")
        star = stash.keep(verified(star, rest=True), "star")
        about = star.select(F.col("b").alias("rep"), F.col("a").alias("ref"), "size", "rest").join(hub.select("rep", "minor", "comp"), "rep")
        about = stash.keep(about, "about")
        own, met = indexed(about)
        comp = joined(comp, met.union(star.where("linked").select("a", "b")))
        before = member
        member = member.withColumnRenamed("own", "known").join(hub.select("rep", "hub"), "rep", "left")
        member = member.withColumn("ref", F.when(F.col("closed"), F.col("ref")).otherwise(F.col("hub"))).join(own, ["ref", "rep"], "left")
        member = member.withColumn("own", F.when(F.col("closed"), F.col("known")).otherwise(F.coalesce("own", F.lit(0))))
        member = unsettled(member.drop("known", "hub"), comp)
        stash.drop(before, each, hub, star, about, own, met)
