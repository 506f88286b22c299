"""The training-data operators against libraries, brute force, round trips and held-out labels; edge cases."""

from __future__ import annotations

import hashlib
import random
import time
import re
import struct
import tarfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from oracle import agree, connection
from weftline.llm import bpe, chat, decontaminate, licenses, media, neardup, quality, repair, token_counts, urls
from weftline.llm.queries import ORACLE, QUERIES, URL_RULES, tokenizer

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
ALPHABET = list("ab \n\t'stré1² .,🙂") + ["<|endoftext|>", "  ", "　", "\x1c", "don't", " the"]


def docs_of(spark, texts, start=0):
    return spark.createDataFrame([(start + i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], DOCS)


def odd_texts(n=150, seed=1):
    rng = random.Random(seed)
    out = ["", None, " ", "\n\n x", "a" * 3000, ("word " * 4000).strip(), "<|endoftext|>", "x<|endoftext|> y"]
    return out + ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 50))) for _ in range(n)]


@pytest.fixture(scope="module")
def con(sf):
    return connection(sf)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, sf, con, name):
    agree(spark, con, sf, QUERIES[name], ORACLE[name])


# BPE ----------------------------------------------------------------------------------------------------------------


def test_bpe_is_the_library(spark, sf):
    from tokenizers import Tokenizer

    path, texts = tokenizer("byte_bpe_50k.json"), odd_texts()
    texts += [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect()]
    lib = Tokenizer.from_file(path)
    got = {r.doc_id: r for r in bpe.encode_decode(docs_of(spark, texts).repartition(3), path).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        ids = lib.encode(t or "", add_special_tokens=False).ids
        assert got[i].ids == ",".join(map(str, ids)) and got[i].n_tokens == len(ids)
        assert got[i].decoded == lib.decode(ids, skip_special_tokens=False)


def test_bpe_pair_test_is_the_merge_definition():
    m, rng = bpe.Merges(tokenizer("byte_bpe_50k.json")), random.Random(2)
    known = [i for i in m.surface if m._spines(i)]
    for _ in range(3000):
        a, b = rng.choice(known), rng.choice(known)
        left, right = m.surface[a], m.surface[b]
        assert m.stable(a, b) == (m.merged(left + right) == [left, right])


def test_bpe_decodes_arrays_and_generations_do_not_matter(spark):
    path = tokenizer("byte_bpe_50k.json")
    df = bpe.encode_decode(docs_of(spark, ["Hello world", None]), path).select("doc_id", bpe.ids_array().alias("ids"))
    back = dict(map(tuple, bpe.decode_ids(df, path, "ids").collect()))
    assert back == {0: "Hello world", 1: ""}
    small, whole = bpe.Codec(path, max_pieces=3), bpe.Codec(path)
    texts = odd_texts(60, 5)
    for t in texts:
        assert [list(x) for x in small.round_trip([t])] == [list(x) for x in whole.round_trip([t])]


def test_bpe_walk_asks_the_vocabulary_once_a_step(monkeypatch):
    class Asked(dict):
        n = 0

        def get(self, *a):
            Asked.n += 1
            return super().get(*a)

        def __contains__(self, k):
            Asked.n += 1
            return super().__contains__(k)

    m, rng = bpe.Merges(tokenizer("byte_bpe_50k.json")), random.Random(3)
    words = sorted({"Ġ" + "".join(rng.choice(["the", "tion", "an", "er", "x", "Ã©"]) for _ in range(rng.randint(1, 6))) for _ in range(400)})
    m.opening = Asked(m.opening)
    first = list(bpe.encode_words(m, words))
    assert [[m.surface[i] for i in ids] for ids in first] == [m.merged(w) for w in words]
    asked, Asked.n = Asked.n, 0
    again = list(bpe.encode_words(m, words))
    assert again == first and asked and not Asked.n
    monkeypatch.setattr(bpe, "MAX_STEPS", 7)  # steps are made anew time and again
    few = bpe.Merges(tokenizer("byte_bpe_50k.json"))
    again, states = list(bpe.encode_words(few, words)), len(few._states)
    assert again == first and states <= 8


def test_token_counts(spark):
    from tokenizers import Tokenizer

    path, texts = tokenizer("byte_bpe_50k.json"), odd_texts(40)
    lengths = [len(Tokenizer.from_file(path).encode(t or "", add_special_tokens=False).ids) for t in texts]
    h = token_counts.length_histogram(docs_of(spark, texts), path)
    assert dict(map(tuple, h.collect())) == {n: lengths.count(n) for n in set(lengths)}
    for limits in (None, [0, 7, 100_000]):
        rows = token_counts.at_limits(h, limits).collect()
        assert sorted(r.context for r in rows) == sorted(set(lengths) if limits is None else limits)
        for r in rows:
            assert r.tokens_kept == sum(min(n, r.context) for n in lengths)
            assert r.docs_over == sum(n > r.context for n in lengths) and r.tokens_cut == sum(lengths) - r.tokens_kept
    q = dict(map(tuple, token_counts.quantiles(h, [0.5, 1.0]).collect()))
    assert q[1.0] == max(lengths) and q[0.5] == sorted(lengths)[(len(lengths) + 1) // 2 - 1]
    empty = token_counts.length_histogram(docs_of(spark, []), path)
    assert token_counts.at_limits(empty).count() == 0 and token_counts.at_limits(empty, [5]).first().share_within is None


def test_counts_encode_a_word_of_letters_without_a_cut():
    from tokenizers import Tokenizer

    path = tokenizer("byte_bpe_50k.json")
    c, text = bpe.Codec(path), "Once the quick foxes jump over the lazy dogs"
    c._cut = None  # not called
    n = sum(x[2] for x in next(c.round_trip([text])))
    assert n == len(Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids)


# near-duplicates ----------------------------------------------------------------------------------------------------


def brute_components(texts, n, percent):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    comp = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            same = len(sets[i] & sets[j])
            if same and 100 * same >= percent * (len(sets[i]) + len(sets[j]) - same):
                a, b = comp[i], comp[j]
                comp = [min(a, b) if c in (a, b) else c for c in comp]
    return [len(s) for s in sets], comp


def near_texts():
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    base = [[word() for _ in range(60)] for _ in range(6)]
    texts = [" ".join(b) for b in base]
    for b in base[:3]:  # chains of copies that drift apart, so that far ends are only linked through the middle
        w = list(b)
        for _ in range(12):
            w[rng.randrange(60)] = word()
            texts.append(" ".join(w))
    return texts + ["", None, "one two", "ONE two", "one  two", "a", "\x1c a b c d"] + texts[:3] + [texts[0].upper()]


@pytest.mark.parametrize("n, percent", [(4, 80), (5, 80)])
def test_near_duplicates_are_the_exact_components(spark, n, percent):
    texts = near_texts()
    sizes, comp = brute_components(texts, n, percent)
    out = neardup.near_duplicates(docs_of(spark, texts).repartition(5), n, percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in out} == {i: (sizes[i], comp[i], comp[i] == i) for i in range(len(texts))}


def test_rounds_carry_only_members_that_may_still_link(spark, monkeypatch):
    rng = random.Random(12)
    base, texts = [f"w{i}" for i in range(200)], []
    for i in range(70):  # one large group of copies, from near the base to too far from all others
        w = list(base[: rng.choice([162, 175, 200])])
        for k in rng.sample(range(len(w)), i % 15):
            w[k] = f"x{i}_{k}"
        texts.append(" ".join(w))
    rows, keep = [], neardup.Stash.keep

    def counted(stash, df, label):
        out = keep(stash, df, label)
        if label in ("fresh", "lead", "named"):
            rows.append((label, out.count()))
        return out

    monkeypatch.setattr(neardup.Stash, "keep", counted)
    monkeypatch.setattr(neardup, "FIRST_LEADERS", 1)
    sizes, comp = brute_components(texts, 4, 80)
    out = neardup.near_duplicates(docs_of(spark, texts), 4, 80).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == {i: (sizes[i], comp[i]) for i in range(len(texts))}
    rounds = [(rows[i][1], rows[i + 1][1], rows[i + 2][1]) for i in range(len(rows) - 2) if rows[i][0] == "fresh" and rows[i + 1][0] == "lead"]
    assert rounds and all(carried == fresh - lead for fresh, lead, carried in rounds)


def test_texts_that_share_a_passage_are_not_compared_one_by_one(spark, monkeypatch):
    rng = random.Random(21)
    passage, texts = [f"p{i}" for i in range(80)], []
    for i in range(150):
        tail = [f"t{i}_{k}" for k in range(rng.randint(15, 120))]
        texts.append(" ".join(passage + tail))
        if i % 10 == 0:  # chains of copies, and copies that are just too far
            for step in (1, 2, 3):
                tail[-4 * step] = f"x{i}_{step}"
                texts.append(" ".join(passage + tail))
            texts.append(" ".join(passage + tail[: len(tail) // 2]))
    rows, keep = {"pairs": 0, "about": 0}, neardup.Stash.keep

    def counted(stash, df, label):
        out = keep(stash, df, label)
        if label in rows:
            rows[label] += out.count()
        return out

    monkeypatch.setattr(neardup.Stash, "keep", counted)
    monkeypatch.setattr(neardup, "FIRST_LEADERS", 1)
    sizes, comp = brute_components(texts, 4, 80)
    out = neardup.near_duplicates(docs_of(spark, texts).repartition(3), 4, 80).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == {i: (sizes[i], comp[i]) for i in range(len(texts))}
    assert rows["pairs"] < 4 * len(texts), rows


def test_near_duplicates_edges(spark):
    df = spark.createDataFrame([(1, "a b c d e"), (1, "a b c d e"), (2, "a b c d e"), (None, "a b c d e"), (None, "z z"), (3, None)], "doc_id bigint, text string")
    got = sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in neardup.near_duplicates(df.withColumn("digest", F.lit(1)).withColumn("rep", F.lit(2))).collect())
    assert got == sorted([(1, 1, True), (1, 1, True), (2, 1, False), (-1, 1, False), (-1, -1, True), (3, 3, True)])
    assert neardup.near_duplicates(docs_of(spark, [])).count() == 0


def test_super_minhash_estimates_similarity_and_stops_exactly():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 1 << 63, 900, dtype=np.int64).astype(np.uint64)
    a, b = np.unique(x[:600]), np.unique(x[300:])
    s = neardup.signatures([a, b, a[:3], np.empty(0, np.uint64)], 256 - 1)
    assert abs((s[0] == s[1]).mean() - 1 / 3) < 0.1
    assert (s[2] != np.uint64(2**64 - 1)).all() and (s[3] == np.uint64(2**64 - 1)).all()
    assert (neardup.signatures([a], 255)[0] == s[0]).all()
    assert (np.sort(s[2] >> np.uint64(56)) <= 254).all()


# decontamination ----------------------------------------------------------------------------------------------------


def distance_in(passage, text):
    """Fewest edits between the passage and any substring of the text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(passage, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


@pytest.mark.parametrize("bounds", [{}, {"TOGETHER": 1}, {"MAX_HITS": 60}, {"MAX_HITS": 4, "TOGETHER": 2, "MAX_CHARS": 50}])
def test_leaks_are_those_of_full_alignment(bounds, monkeypatch):
    for k, v in bounds.items():
        monkeypatch.setattr(decontaminate, k, v)
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("etaoins") for _ in range(rng.randint(1, 7)))
    items = [(i, " ".join(word() for _ in range(rng.randint(12, 30)))) for i in range(8)]
    index, texts = decontaminate.Index(items), []
    for _ in range(60):
        t = list(rng.choice(items)[1])
        for _ in range(rng.randint(0, len(t) // 6)):
            k = rng.randrange(len(t))
            t[k : k + 1] = rng.choice(["", "x", t[k] + "y"])
        texts.append(" ".join(word() for _ in range(20)) + " " + "".join(t) + "  " + " ".join(word() for _ in range(rng.randint(0, 20))))
    found = decontaminate.leaks(index, texts)
    hits = 0
    for t, got in zip(texts, found, strict=True):
        n = decontaminate.normal(t)
        for u, (_, _, passage, budget) in enumerate(index.units):
            d = distance_in(passage, n)
            mine = [x for x in got if x[0] == u]
            assert bool(mine) == (d <= budget)
            if mine:
                hits += 1
                assert mine[0][1] == d and distance_in(passage, n[mine[0][2] : mine[0][3]]) == d
    assert hits > 20


def test_passages_that_share_a_repeated_sentence():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(5))
    shared = "choose the one best answer to the question that follows below "
    items = [(i, shared + " ".join(word() for _ in range(9))) for i in range(2000)]
    index = decontaminate.Index(items)
    began = time.time()
    found = decontaminate.leaks(index, [shared * 120, shared * 40 + items[77][1] + " " + shared * 40])
    assert time.time() - began < 60
    assert found[0] == [] and [(index.units[x[0]][0], x[1]) for x in found[1]] == [(77, 0)]


def test_short_passages_are_found_without_edits():
    items = [(1, "Yes"), (2, "so it goes"), (3, "a quick brown fox ran"), (4, "q")]
    index = decontaminate.Index(items)
    got = decontaminate.leaks(index, ["oh  YES and so it\ngoes on", "yesterday so it went", "see a quick brown fox ran off", "a quick brown fix ran q"])
    assert [sorted((index.units[x[0]][0], *x[1:]) for x in xs) for xs in got] == [[(1, 0, 3, 6), (2, 0, 11, 21)], [], [(3, 0, 4, 25)], [(4, 0, 22, 23)]]


def test_decontamination_edges(spark):
    passage = "the quick brown fox jumps over the lazy dog and runs far away from the noisy crowd"
    bench = spark.createDataFrame([(1, passage), (2, None), (3, "too short"), (4, passage), (None, passage)], "item_id bigint, text string")
    long = "filler words here " * 30_000 + passage.upper().replace(" ", "\n") + " more " * 10
    docs = docs_of(spark, [long, None, "", "nothing", passage[:40], passage, passage])
    got = sorted((r.doc_id, r.item_id, r.edits) for r in decontaminate.find_leaks(docs, bench).collect())
    assert got == [(d, i, 0) for d in (0, 5, 6) for i in (1, 4)]
    kept = decontaminate.without_leaks(docs.withColumn("item_id", F.lit(7)), bench)
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 4] and kept.columns[-1] == "item_id"
    assert decontaminate.find_leaks(docs, bench.limit(0)).count() == 0
    assert decontaminate.find_leaks(docs.limit(0), bench).count() == 0


def test_long_passages_and_parts(spark, monkeypatch):
    rng = random.Random(6)
    item = " ".join("".join(rng.choice("abcdefghijkl") for _ in range(6)) for _ in range(300))
    bench = spark.createDataFrame([(i, item[i:]) for i in range(3)], "item_id bigint, text string")
    docs = docs_of(spark, ["intro " + item[500:1500], "other " * 50])
    monkeypatch.setattr(decontaminate, "MAX_INDEX_CHARS", 3000)
    assert {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs, bench).collect()} == {(0, 0), (0, 1), (0, 2)}


# quality ------------------------------------------------------------------------------------------------------------


def test_classifier_on_held_out_labels(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    test = labels.where("pmod(xxhash64(doc_id, 1), 4) = 0")
    model = quality.train(docs, labels.join(test, "doc_id", "left_anti"))
    rows = quality.score(docs, model).join(test, "doc_id").select("score", "quality").collect()
    right = sum((r.score >= 0.5) == bool(r.quality) for r in rows)
    assert len(rows) > 60 and right >= 0.93 * len(rows)
    good = [r.score >= 0.5 for r in rows if r.quality]
    assert sum(good) >= 0.95 * len(good)


def test_classifier_edges(spark):
    docs = docs_of(spark, ["good text here", None, "", "x" * 100_000, "good text here"]).union(spark.createDataFrame([(None, None, None, None, None)], DOCS))
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    assert quality.score(docs, quality.train(docs, none)).count() == 6
    some = spark.createDataFrame([(0, 1), (1, 0), (2, None), (None, 1), (0, 0), (77, 1)], "doc_id bigint, quality int")
    model = quality.train(docs, some)
    assert quality.score(docs.limit(0), model).count() == 0
    kept = quality.keep_good(docs.withColumn("score", F.lit(3)), model)
    assert kept.columns == [*docs.columns, "score"] and kept.count() <= 6
    same = [r.score for r in quality.score(docs, model).where("doc_id IN (0, 4)").collect()]
    assert same[0] == same[1]


def test_exchange_covers_every_unlabelled_document(spark):
    """The counts and gradients of a round, and the model, against one pass in plain numpy; dealt in other ways, the same."""
    d = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet").orderBy("doc_id").limit(60)
    ones = [quality.train(docs.repartition(k), labels) for k in (1, 7)]
    given = {r.doc_id: r.quality for r in labels.collect()}
    rows = docs.collect()
    assert len(rows) > len(given)

    def views(some):
        return [quality.content_features([r.text for r in some]), quality.meta_features([[r.source for r in some], [r.lang for r in some]], [r.n_chars for r in some])]

    free = views([r for r in rows if r.doc_id not in given])
    seen = []

    def others(models, confident):
        out = []
        for v, other in ((0, 1), (1, 0)):
            slope, offset = models[other].platt
            p = 1 / (1 + np.exp(-(slope * models[other].margin(free[other]) + offset)))
            q = 1 / (1 + np.exp(-models[v].margin(free[v])))
            z = models[v].design(free[v])
            for side in (0, 1):
                rows_of = [i for i in range(len(p)) if (p[i] if side else 1 - p[i]) >= confident]
                pull = sum((np.rint(z[i] * (q[i] - side) * 2**20) for i in rows_of), np.zeros(z.shape[1]))
                out += [[len(rows_of)], pull]
        seen.append(np.concatenate(out))
        return seen[-1]

    known = sorted((r for r in rows if r.doc_id in given), key=lambda r: (quality.xxhash.xxh3_64_intdigest(str(r.doc_id)), r.doc_id))
    plain = quality.CoTrained().fit(*views(known), np.array([given[r.doc_id] for r in known]), others)
    alone = quality.CoTrained().fit(*views(known), np.array([given[r.doc_id] for r in known]))
    for one in ones:
        assert one.taught == plain.taught and len(one.taught) == quality.ROUNDS and sum(one.taught[0]) > 0
        for m, p, a in zip(one.models, plain.models, alone.models, strict=True):
            assert np.allclose(m.w, p.w, atol=1e-4)
            assert not np.allclose(m.w, a.w, atol=1e-3)


def test_labelled_id_with_several_texts_has_one_defined_row(spark):
    rows = [(i % 20, f"text {'good ' * (i % 7)} number {i}", "en", "s", 9 + i) for i in range(200)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id bigint, quality int")
    a, b = (quality.train(spark.createDataFrame(r, DOCS).repartition(k), labels) for r, k in ((rows, 2), (rows[::-1], 5)))
    assert all(np.array_equal(m.w, o.w) for m, o in zip(a.models, b.models, strict=True)) and not any(map(sum, a.taught))


# id files -----------------------------------------------------------------------------------------------------------


def test_id_files_against_the_library(spark):
    from tokenizers import Tokenizer

    path = tokenizer("word_bpe_49k.json")
    texts = odd_texts(80) + ["ΣΑΣ Σ", "é ́x", "the cat " * 500]
    lib = Tokenizer.from_file(path)
    refs = repair.write_ids(docs_of(spark, texts).repartition(4), path, segment_ids=500)
    start = 0
    rows = repair.checksums(repair.with_starts(refs)).orderBy("doc_id").collect()
    assert [r.doc_id for r in rows] == list(range(len(texts)))
    for r, t in zip(rows, texts, strict=True):
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 1]
        assert (r["first"], r.n_read) == (start, len(ids))
        assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))
        start += len(ids)
    assert repair.checksums(repair.with_starts(repair.write_ids(docs_of(spark, []), path))).count() == 0
    twice = spark.createDataFrame([(None, "a b"), (5, "b"), (5, "a"), (5, "a")], "doc_id bigint, text string")
    assert sorted(r["first"] for r in repair.with_starts(repair.write_ids(twice, path)).collect()) == [0, 3, 5, 7]


def test_grammar_round_trip_and_random_access():
    rng = np.random.default_rng(3)
    for ids in (np.array([], "<u4"), np.array([7], "<u4"), np.full(5000, 3, "<u4"), rng.integers(0, 9, 20_000).astype("<u4"), rng.integers(0, 1 << 20, 3000).astype("<u4")):
        data = repair.pack(ids)
        s = repair.Segment(data)
        assert (s.ids(0, len(ids)) == ids).all()
        for _ in range(60):
            a, b = sorted(rng.integers(0, len(ids) + 1, 2))
            assert (s.ids(int(a), int(b)) == ids[a:b]).all()
    assert len(repair.pack(np.tile(rng.integers(0, 50, 100), 200).astype("<u4"))) < 20_000


@pytest.mark.parametrize("ids", [np.full(1 << 18, 1), np.tile(np.arange(700), 300), np.random.default_rng(5).integers(0, 4, 50_000)], ids=["one id", "copies", "noise"])
def test_grammar_ends_where_no_pair_saves(ids):
    """No pair is left with eight places side by side of each other, whatever the depth; deep symbols are read in parts."""
    base, rules, lengths, rest = repair.compress(ids.astype("<u4"))
    places, last = {}, {}
    for i, pair in enumerate(zip(rest[:-1].tolist(), rest[1:].tolist(), strict=True)):
        if last.get(pair) != i - 1:
            places[pair], last[pair] = places.get(pair, 0) + 1, i
    assert max(places.values(), default=0) < 2 * repair.LEAST
    assert lengths.max(initial=1) > 64 or len(set(ids.tolist())) == 4
    s = repair.Segment(repair.pack(ids.astype("<u4")))
    for a in range(0, len(ids), 997):
        assert (s.ids(a, min(a + 3, len(ids))) == ids[a : a + 3]).all()


# chats --------------------------------------------------------------------------------------------------------------

CHAT = "conv_id bigint, turn bigint, role string, text string"


def test_snapshots_collapse(spark):
    a = [("user", "hi"), ("assistant", "hello"), ("user", "more"), (None, None)]
    rows = [(c, t, *a[t]) for c, n in ((1, 2), (2, 4), (3, 4), (4, 3), (5, 1)) for t in range(n)]
    rows += [(6, 0, "user", "other"), (7, 0, "user", "hi"), (7, 1, "assistant", "no"), (8, 0, "user", None), (9, 0, "user", "")]
    rows += [(2, 0, "user", "hi"), (None, 0, "user", "hi"), (10, None, "system", "s"), (10, 0, "user", "q")]
    df = spark.createDataFrame(rows, CHAT).repartition(3)
    out = {(r.conv_id, r.part): r for r in chat.format_chats(df.withColumn("blk", F.lit(0))).collect()}
    assert sorted({c for c, _ in out}) == [2, 6, 7, 8, 9, 10]
    assert out[2, 0].rendered.startswith("<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nhello<|im_end|>\n") and out[2, 0].n_turns == 4
    assert out[10, 0].rendered.startswith("<|im_start|>system") and out[10, 1].n_turns == 1
    assert chat.format_chats(df.limit(0)).count() == 0


def test_long_chats_are_cut_into_parts(spark, monkeypatch):
    monkeypatch.setattr(chat, "BLOCK", 4)
    rows = [(c, t, "user", f"t{t}") for c, n in ((1, 11), (2, 8), (3, 9), (4, 30)) for t in range(n)] + [(5, t, "user", f"t{t}") for t in (0, 1, 3)]
    out = chat.format_chats(spark.createDataFrame(rows, CHAT)).orderBy("conv_id", "part").collect()
    assert sorted({r.conv_id for r in out}) == [4, 5]
    assert "".join(r.rendered for r in out if r.conv_id == 4) == "".join(f"<|im_start|>user\nt{t}<|im_end|>\n" for t in range(30))


# licenses -----------------------------------------------------------------------------------------------------------


def test_license_scan_finds_edited_templates(spark):
    mit = dict(licenses.TEMPLATES)["MIT"]
    words = mit.split()
    edited = " ".join(w if i % 40 else "changed" for i, w in enumerate(words))
    broken = " ".join(w if i % 4 else "changed" for i, w in enumerate(words))
    texts = [mit, "x y z " * 3000 + edited + " end" * 50, broken, None, "", "All Rights  Reserved", "released under the MIT license", "MIT", mit]
    df = docs_of(spark, texts).withColumn("grams", F.lit(1)).withColumn("w", F.lit(2))
    got = {}
    for r in licenses.scan(df).collect():
        got.setdefault(r.doc_id, set()).add(r.license)
    assert got == {0: {"MIT"}, 1: {"MIT"}, 5: {"proprietary-notice"}, 6: {"MIT-notice"}, 8: {"MIT"}}
    assert licenses.scan(df.limit(0)).count() == 0 and licenses.scan(df, []).count() == 0
    assert licenses.scan(df, [("q'", "it's \\ one"), ("none", "--")]).count() == 0


def test_license_passes(spark, monkeypatch):
    df = docs_of(spark, [t for _, t in licenses.TEMPLATES])
    whole = sorted(map(tuple, licenses.scan(df).collect()))
    monkeypatch.setattr(licenses, "MAX_KEYS", 40)
    assert sorted(map(tuple, licenses.scan(df).collect())) == whole
    assert {(r[0], r[1]) for r in whole} >= {(i, i) for i in range(len(licenses.TEMPLATES))}


# URLs ---------------------------------------------------------------------------------------------------------------


def test_url_decisions_travel(spark):
    link = '<LINK href="{}" rel="canonical">'
    rows = [
        (0, "http://A.com/en/1?x#f", None), (1, "https://b.info/a", link.format("http://a.com/en/1?x")), (2, "https://b.info/b", link.format("/a")),
        (3, "https://c.info/", '<meta http-equiv="refresh" content="0; url=https://b.info/b">'), (4, "no host", link.format("http://a.com/en/1")),
        (5, None, None), (6, "https://d.info/x/y", link.format("z")), (7, "https://d.info/x/z", link.format("https://example.com/en/7")),
        (8, "https://d.info/w", link.format("https://a.com/en/1?x")), (9, "https://d.info/w2", link.format("https://d.info/w")), (10, "https://e.net/de/8", ""),
        (11, "https://x.example.net/de/8?q", ""), (12, "https://notcom/en/", ""), (13, "https://com/en/", ""), (14, "ftp://E.ORG/ES/", ""), (15, "http://h.org", ""),
        (0, "http://A.com/en/1?x#f", None), (None, "https://b.info/a", None),
    ]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("key", F.lit(1))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict, r.by) for r in urls.filter_urls(df, URL_RULES).collect()}
    assert got[0] == ("a.com", "/en/1", "com/en/", "block", "rule")
    for i in (1, 2, 3, 8, 9, None):
        assert got[i][2:] == (None, "block", "alias"), i
    assert got[4] == got[5] == ("", "", None, "allow", "default")
    assert got[6][2:] == got[7][2:] == (None, "allow", "alias")
    assert got[10][2:] == ("net/de/", "allow", "rule") and got[11][2:] == ("example.net/de/8", "block", "rule")
    assert got[12][2:] == (None, "allow", "default") and got[13][2] == "com/en/" and got[14][:3] == ("e.org", "/ES/", None)
    both = [(20, "https://f.info/1", link.format("https://a.com/en/1")), (21, "https://f.info/1", link.format("https://example.com/en/7"))]
    mixed = urls.filter_urls(spark.createDataFrame(both, "page_id bigint, url string, html string"), URL_RULES).collect()
    assert {r.verdict for r in mixed} == {"allow"}
    assert urls.filter_urls(df.limit(0), URL_RULES).count() == 0 and urls.filter_urls(df, []).where("rule IS NOT NULL").count() == 0


def test_every_link_of_a_page_is_resolved(spark):
    from urllib.parse import urljoin

    bases = ["http://a.net/b/c/d?q", "http://a.net", "http://a.net/", "http://a.net/x"]
    forms = ["g", "./g", "g/", "/g", "//h.org/g", "?y", "g?y#s", "../g", "../../g", "../../../g", "..", ".", "./", "/../g", "/./g/.", "https://k.com/p"]
    pages = [(b, f'<LINK rel="canonical" href="{f}"><link rel=canonical href="/second"><meta http-equiv="refresh" content="5;url=/third">') for b in bases for f in forms]
    got = urls.links(spark.createDataFrame(pages, "url string, html string"), "url", "html").collect()
    want = [(b, urljoin(b, x)) for b in bases for f in forms for x in (f, "/second", "/third")]
    plain = lambda rows: sorted((u, t.rstrip("/") if t.count("/") == 3 else t) for u, t in rows)
    assert plain(got) == plain(want)


def test_long_rule_lists_decide_alike(spark, monkeypatch):
    rng = random.Random(8)
    hosts, paths = ["com", "a.com", "b.a.com", "net", "x.net", "A.com"], ["/", "/e", "/en/", "/en/7", "", "/d"]
    rules = [(rng.choice(["allow", "block"]), rng.choice(hosts[:5]), rng.choice(paths)) for _ in range(12)]
    rows = [(i, f"http://{rng.choice(hosts + ['q.com', 'org', ''])}{rng.choice(paths)}{rng.choice(['', 'x', '/en/77', '?q', '#f'])}", None) for i in range(120)]
    df = spark.createDataFrame([*rows, (500, None, None)], "page_id bigint, url string, html string")
    short = sorted(map(str, urls.filter_urls(df, rules).collect()))
    monkeypatch.setattr(urls, "COMPILED", 3)
    assert sorted(map(str, urls.filter_urls(df, rules).collect())) == short


# media --------------------------------------------------------------------------------------------------------------


def test_media_round_trip(spark, tmp_path):
    texts = odd_texts(40) + ["ab" * 96, "same", "same", "é" * 500]
    refs = media.store(docs_of(spark, texts).repartition(2), str(tmp_path / "m"), shard_bytes=20_000)
    rows = media.with_features(media.with_metadata(refs)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        payload = media.payload_of(texts[r.doc_id])
        assert len(payload) % 192 == 0 and payload and r.n_bytes == len((texts[r.doc_id] or "").encode())
        assert (r.payload_bytes, r.width * r.height) == (len(payload), len(payload)) and r.bits == 8
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-16:])
        assert r.digest == r.media_sha256 and r.feature == media.feature_of(payload)
    shards = {r.shard for r in rows}
    assert len(shards) > 1
    for s in shards:
        with tarfile.open(s.removeprefix("file://")) as t:
            for m in t.getmembers():
                assert hashlib.sha256(t.extractfile(m).read()).hexdigest() + ".png" == m.name
    assert media.with_metadata(media.store(docs_of(spark, []))).count() == 0


# pipeline -----------------------------------------------------------------------------------------------------------


def test_pipeline_stages_chain(spark, sf):
    import corpus_pipeline as p

    docs, columns = spark.read.parquet(f"{sf}/documents.parquet"), None
    for name, stage in p.STAGES[:-1]:
        after = stage(spark, docs, sf)
        assert after.columns == docs.columns, name
        rows, before = [r.doc_id for r in after.collect()], {r.doc_id for r in docs.collect()}
        assert set(rows) <= before and len(rows) == len(set(rows))
        if name == "near_dedup":
            held = docs.orderBy("doc_id").collect()
            _, comp = brute_components([r.text for r in held], 5, 80)
            assert sorted(rows) == sorted({held[c].doc_id for c in comp})
        if name == "decontaminate":
            items = [decontaminate.normal(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
            assert not any(i in decontaminate.normal(r.text) for r in after.collect() for i in items)
        docs = after
        columns = after.columns
    assert columns == ["doc_id", "text", "lang", "source", "n_chars"]
    out = p.run(spark, sf)
    assert sorted(r.doc_id for r in out.collect()) == sorted(rows)


def test_dedup_stage_keeps_one_of_repeated_rows(spark):
    import corpus_pipeline as p

    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, "A b c d e f"), (None, "q"), (3, None), (3, "other text")], "doc_id bigint, text string")
    got = sorted((r.doc_id or -1, r.text or "") for r in p.near_dedup(spark, df, "").collect())
    assert got == [(-1, "q"), (1, "a b c d e f"), (3, ""), (3, "other text")]
