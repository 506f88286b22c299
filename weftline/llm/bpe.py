"""BPE encoding and decoding over a prefix-sharing trie.

The encoding of a word is fixed by the last token of each of its prefixes: a token sequence is what the merges produce
exactly when every two neighbours, merged by themselves, stay those two tokens.  So a prefix ends in the one token
``t`` (a suffix of it) for which the pair (last token of what precedes ``t``, ``t``) is stable.  Distinct words are
inserted into a trie, a node holds the last token of its prefix and the node where that token begins, and a node's state
follows from its ancestors alone: a prefix shared by many words is encoded once.  A word's ids are read by walking the
token starts back to the root.  The cost is linear in the trie's nodes, whatever the length of a word.

Texts are cut into pieces at single blanks and line ends, where no token of these vocabularies can cross; a piece that
was met before is a dictionary look-up.  The dictionaries of a worker have two generations of a stated size, which
bounds memory and changes nothing in the results.
"""

from __future__ import annotations

import gc
import json
import re
import sys
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.batches import give_back, held_by, settled, small_batches, text_chunks

MAX_PIECES = 100_000
MAX_WORDS = 60_000
MAX_PAIRS = 150_000
MAX_SPINES = 6_000
MAX_STEPS = 150_000
CHUNK = 1 << 20
NEVER = 1 << 60


class Merges:
    """Vocabulary and merge ranks of a byte-level BPE file, with the pair test that the trie rests on."""

    def __init__(self, path: str):
        self._grown: dict[int, tuple] = {}
        self._old_grown: dict[int, tuple] = {}
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.vocab: dict[str, int] = dict(spec["model"]["vocab"])
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.rank = {(a, b): r for r, (a, b) in enumerate(pairs)}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.surface = {i: t for t, i in self.vocab.items()}
        #: Every beginning of a token, with the token's id where it is a whole token that merges to itself, else -1.
        self.opening: dict[str, int] = {}
        for token, i in self.vocab.items():
            for k in range(1, len(token)):
                self.opening.setdefault(token[:k], -1)
            self.opening[token] = i
        for token, i in self.vocab.items():
            if len(token) > 1 and self._grow(i) is None:
                self.opening[token] = -1
        #: Of pairs of tokens, whether they are stable, as far as was asked.
        self.known: dict[int, bool] = {}
        self._states: dict[str, State] = {}
        self._steps = 0
        self.root = self._state("")
        del spec, pairs
        give_back()

    def _state(self, text: str) -> State:
        if (found := self._states.get(text)) is None:
            found = self._states[text] = State(self, text)
        return found

    def step(self, state: State, c: str, text: str) -> State:
        """Note that ``c`` leads from ``state`` to the state of ``text``; beyond a stated number all steps are made anew."""
        if self._steps >= MAX_STEPS:
            for x in self._states.values():
                x.clear()
            self._states, self._steps = {"": self.root}, 0
        self._steps += 1
        found = state[c] = self._state(text)
        return found

    def merged(self, text: str) -> list[str]:
        """The merges applied by definition, lowest rank first and leftmost first; for short strings and tests."""
        parts = list(text)
        while len(parts) > 1:
            ranked = [(self.rank[p], i) for i, p in enumerate(zip(parts, parts[1:], strict=False)) if p in self.rank]
            if not ranked:
                break
            _, i = min(ranked)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _spines(self, t: int):
        """How the first and the last part of token ``t`` grow as it is merged: (part, rank that ends it), in order.

        Held for the tokens in use; two generations bound how many.
        """
        if (found := self._grown.get(t)) is None:
            found = self._old_grown.get(t) or self._grow(t)
            if len(self._grown) > MAX_SPINES:
                self._old_grown, self._grown = self._grown, {}
            self._grown[t] = found
        return found

    def _grow(self, t: int):
        """The spines of a token, None where it does not merge to itself."""
        parts, shown = list(self.surface[t]), sys.intern
        first, last = [], []
        while len(parts) > 1:
            ranked = [(self.rank[p], i) for i, p in enumerate(zip(parts, parts[1:], strict=False)) if p in self.rank]
            if not ranked:
                return None
            r, i = min(ranked)
            if i == 0:
                first.append((shown(parts[0]), r))
            if i == len(parts) - 2:
                last.append((shown(parts[-1]), r))
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        whole = (shown(parts[0]), NEVER)
        return (*first, whole), (*last, whole)

    def stable(self, a: int, b: int) -> bool:
        """Whether tokens ``a b`` side by side stay as they are: no merge ever wins across the boundary.

        Merges happen in the order of their ranks, so the part of ``a`` at the boundary and that of ``b`` each live
        until a known rank.  A merge of the two wins if its rank comes before either ends; of equal merges the left one
        goes first.
        """
        if (known := self.known.get(a << 32 | b)) is None:
            left, right = self._spines(a)[1], self._spines(b)[0]
            i = j = 0
            known = True
            while True:
                (x, x_ends), (y, y_ends) = left[i], right[j]
                r = self.rank.get((x, y), NEVER)
                if r < x_ends and r <= y_ends and r < NEVER:
                    known = False
                    break
                if x_ends == y_ends == NEVER:
                    break
                if x_ends <= y_ends:
                    i += 1
                else:
                    j += 1
            if len(self.known) > MAX_PAIRS:
                self.known.clear()
            self.known[a << 32 | b] = known
        return known


class State(dict):
    """The longest open beginning of a token at the end of what was read; the next states by character, made as needed.

    ``ends`` are the tokens that end there, the longest first, each with its length.
    """

    __slots__ = ("ends", "merges", "text")

    def __init__(self, merges: Merges, text: str):
        tails = [(merges.opening.get(text[i:], -1), len(text) - i) for i in range(len(text))]
        self.merges, self.text, self.ends = merges, text, tuple([x for x in tails if x[0] >= 0])

    def __repr__(self) -> str:
        return f"State({self.text!r})"

    def __missing__(self, c: str) -> State:
        text, opening = self.text + c, self.merges.opening
        while text and text not in opening:
            text = text[1:]
        return self.merges.step(self, c, text)


def encode_words(merges: Merges, words: list[str]) -> Iterator[list[int]]:
    """Token ids of each word of a sorted list.

    Sorted words are the depth-first order of their trie: what a word shares with the one before is the path from the
    root that both hang on.  The stack keeps, for each node of the current path, its last token, the depth at which
    that token begins, and the state that names the tokens which end there.
    """
    known, stable = merges.known, merges.stable
    last, start, states = [-1], [0], [merges.root]
    before = ""
    for word in words:
        n, d = min(len(word), len(before)), 0
        while d < n and word[d] == before[d]:
            d += 1
        del last[d + 1 :], start[d + 1 :], states[d + 1 :]
        state = states[d]
        for c in word[d:]:
            d += 1
            state = state[c]
            for t, k in state.ends:
                if k == d:
                    break
                a = last[d - k]
                if (fits := known.get(a << 32 | t)) is None:
                    fits = stable(a, t)
                if fits:
                    break
            else:
                raise ValueError(f"no encoding ends at {d} of {word[:40]!r}")
            last.append(t)
            start.append(d - k)
            states.append(state)
        before = word
        ids, d = [], len(word)
        while d:
            ids.append(last[d])
            d = start[d]
        yield ids[::-1]


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies: itself if printable, else the next free code."""
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


#: Pieces of these characters are cut by PLAIN as the library would cut them; all others are left to the library.
SAFE = re.compile(r"\n?[\x21-\x7eÀ-ÖØ-öø-ÿ]+").fullmatch
PLAIN = re.compile(r"'(?:s|t|re|ve|m|ll|d)| ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+| ?[^\sA-Za-z0-9À-ÖØ-öø-ÿ]+|\n").findall
Entry = tuple[str, bytes, int]


class Codec:
    """Encoder and decoder of whole texts for one byte-level vocabulary file, one per Python worker."""

    def __init__(self, path: str, max_pieces: int = MAX_PIECES):
        from tokenizers import pre_tokenizers

        self.merges = Merges(path)
        self.split = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
        self.max_pieces = max_pieces
        #: What was met lately, and what was met before that: a word in use moves from the old table to the new one.
        self.pieces: dict[str, Entry | None] = {}
        self.old_pieces: dict[str, Entry | None] = {}
        self.words: dict[str, Entry] = {}
        self.old_words: dict[str, Entry] = {}
        alphabet = byte_alphabet()
        self.shown = {b: c for c, b in alphabet.items()}
        self.bytes = {i: bytes(alphabet[c] for c in t) for i, t in self.merges.surface.items()}
        self.bytes |= {i: t.encode() for t, i in self.merges.special.items()}
        self.digits = {i: str(i) for i in self.bytes}

    def _shown(self, word: str) -> str:
        """A pre-token in the alphabet of the vocabulary."""
        if word.isascii():
            return word.replace(" ", "Ġ").replace("\n", "Ċ")
        return word.encode().decode("latin-1").translate(self.shown)

    def _cut(self, piece: str) -> list[str]:
        """Pre-tokens of a piece as it stands in its text."""
        if SAFE(piece, piece[0] == " "):
            return [self._shown(w) for w in PLAIN(piece)]
        return [w for w, _ in self.split(piece)]

    def _encoded(self, words: list[str]) -> Iterator[Entry]:
        """Entries of distinct pre-tokens in the alphabet of the vocabulary, sorted, by one depth-first walk."""
        digit, data = self.digits.__getitem__, self.bytes.__getitem__
        for ids in encode_words(self.merges, words):
            if len(ids) == 1:
                yield digit(ids[0]), data(ids[0]), 1
            else:
                yield ",".join(map(digit, ids)), b"".join(map(data, ids)), len(ids)

    def _learn_words(self, words: set[str], plain: list[str] = ()) -> None:
        """Encode the pre-tokens that are new and, by the same depth-first walk, pieces that are one pre-token after a blank."""
        if len(self.words) > MAX_WORDS:
            self.old_words, self.words = self.words, {}
        now, old, pieces = self.words, self.old_words, self.pieces
        new = set()
        for w in words.difference(now):
            if w in old:
                now[w] = old[w]
            else:
                new.add(w)
        ones = {"Ġ" + p: p for p in plain}
        walk = sorted(new.union(ones))
        for w, entry in zip(walk, self._encoded(walk), strict=True):
            if w in new:
                now[w] = entry
            if w in ones:
                pieces[ones[w]] = entry

    @staticmethod
    def _join(found: list[Entry]) -> Entry:
        if len(found) == 1:
            return found[0]
        return ",".join([x[0] for x in found]), b"".join([x[1] for x in found]), sum([x[2] for x in found])

    def learn(self, pieces: set[str]) -> None:
        """Encode pieces that are not known yet.  A piece stands after a blank, or after nothing if it begins a line."""
        if len(self.pieces) > self.max_pieces:
            self.old_pieces, self.pieces = self.pieces, {}
        now, old = self.pieces, self.old_pieces
        plain, cut = [], {}
        for p in pieces.difference(now):
            if p in old:
                now[p] = old[p]
            elif p.isalpha() and p.isascii():
                plain.append(p)
            elif not p or p == "\n" or p[p[0] == "\n"].isspace():
                now[p] = None
            else:
                cut[p] = self._cut(p if p[0] == "\n" else " " + p)
        self._learn_words({w for ws in cut.values() for w in ws}, plain)
        words = self.words
        for p, ws in cut.items():
            now[p] = self._join([words[w] for w in ws])

    def segment(self, text: str) -> Entry:
        """A stretch without special tokens, cut by the library's own pattern."""
        if not text:
            return "", b"", 0
        cut = [w for w, _ in self.split(text)]
        self._learn_words(set(cut))
        return self._join([self.words[w] for w in cut])

    def entry(self, text: str) -> Entry:
        """One text; the strings of special tokens count as those tokens, as they do in the library."""
        found: list[str | int] = [text]
        for mark, token in self.merges.special.items():
            cut: list[str | int] = []
            for x in found:
                if isinstance(x, str):
                    for k, part in enumerate(x.split(mark)):
                        cut += [token] * (k > 0) + [part] * bool(part)
                else:
                    cut.append(x)
            found = cut
        parts = [self.segment(x) if isinstance(x, str) else (self.digits[x], self.bytes[x], 1) for x in found]
        return self._join(parts) if parts else ("", b"", 0)

    def encode(self, text: str | None) -> list[int]:
        """Ids of one text as the library gives them without special tokens of its own; null and empty give none."""
        ids = self.entry(text or "")[0]
        return [int(x) for x in ids.split(",")] if ids else []

    def decode(self, ids: list[int]) -> str:
        """The text of ids, special tokens included; bytes that are no UTF-8 become replacement characters."""
        return b"".join([self.bytes.get(i, b"") for i in ids]).decode("utf-8", "replace")

    def round_trip(self, texts: list[str | None]) -> Iterator[list[Entry]]:
        """For each text its entries (ids joined by commas, decoded bytes, count) in order."""
        texts = [t or "" for t in texts]
        parts = [t.replace("\n", " \n").split(" ") for t in texts]
        special = tuple(self.merges.special)
        self.learn({p for split in parts for p in split[1:]})
        get = self.pieces.__getitem__
        for text, split in zip(texts, parts, strict=True):
            found = [*map(get, split[1:])]
            if None in found or any([s in text for s in special]):
                yield [self.entry(text)]  # the cut at white space depends on what follows it
            elif split[0]:
                yield [self.segment(split[0]), *found]
            else:
                yield found


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def _forget() -> None:
    if codec.cache_info().currsize:
        codec.cache_clear()
        gc.collect()  # states refer to each other


held_by("bpe", _forget)


@contextmanager
def _no_cycles() -> Iterator[None]:
    """Without the collector of cycles, which would go through all tables again and again; entries form none."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()


def _kernel(path: str, want: tuple[str, ...], kept: tuple[str, ...], text: str):
    @settled("bpe")
    def run(batches):
        c = codec(path)
        for batch in batches:
            for part in text_chunks(batch, text, CHUNK):
                n, ids, back = [], [], []
                with _no_cycles():
                    for found in c.round_trip(part.column(part.schema.get_field_index(text)).to_pylist()):
                        n.append(sum([x[2] for x in found]))
                        if "ids" in want:
                            ids.append(",".join([x[0] for x in found if x[2]]))
                        if "decoded" in want:
                            back.append(b"".join([x[1] for x in found]).decode("utf-8", "replace"))
                cols = [part.column(part.schema.get_field_index(k)) for k in kept] + [pa.array(n, pa.int64())]
                cols += [pa.array(ids, pa.string())] * ("ids" in want) + [pa.array(back, pa.string())] * ("decoded" in want)
                yield pa.RecordBatch.from_arrays(cols, names=[*kept, "n_tokens", *want])

    return run


def encode_decode(
    docs: DataFrame, path: str, want: tuple[str, ...] = ("ids", "decoded"), keep: tuple[str, ...] = ("doc_id",), text: str = "text"
) -> DataFrame:
    """Encode every whole text of ``docs`` and decode the ids again, in one pass over the texts and without a shuffle.

    Returns ``keep`` columns, ``n_tokens`` and, as asked for, ``ids`` (decimal ids joined by commas: compact to move
    and to hash; ``ids_array`` gives the array) and ``decoded`` (the text decoded from those ids).  A null text counts
    as empty: no ids, empty text.  Repeated rows give repeated rows, other columns of ``docs`` are left out, an empty
    table gives an empty one, and a text of any length is read to its end.
    """
    want = tuple(w for w in ("ids", "decoded") if w in want)
    cols = [F.col(f"`{k}`") for k in keep] + [F.col(f"`{text}`").cast("string").alias("__text")]
    kinds = dict(docs.select(*keep).dtypes)
    schema = ", ".join([f"`{k}` {kinds[k]}" for k in keep] + ["n_tokens bigint"] + [f"{w} string" for w in want])
    return small_batches(docs.select(*cols)).mapInArrow(_kernel(path, want, tuple(keep), "__text"), schema)


def ids_array(ids: str = "ids"):
    """Column expression: the ids as ``array<int>``; no ids give an empty array."""
    return F.when(F.length(ids) > 0, F.split(ids, ",").cast("array<int>")).otherwise(F.array().cast("array<int>"))


def decode_ids(df: DataFrame, path: str, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Decode an ``array<int>`` column; a null array gives a null text, ids outside the vocabulary give nothing."""
    kinds = dict(df.select(*keep).dtypes)
    schema = ", ".join([f"`{k}` {kinds[k]}" for k in keep] + ["text string"])

    @settled("bpe")
    def run(batches):
        c = codec(path)
        for batch in batches:
            found = [None if x is None else c.decode(x) for x in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(found, pa.string())], names=[*keep, "text"])

    return df.select(*keep, ids).mapInArrow(run, schema)
