"""Byte-level BPE by a tokenization automaton.

The automaton reads tokens: its paths are exactly the token strings that BPE yields.  It starts
as one state with a loop per byte.  Merging (u, v) puts a gadget into it: wherever an arc u
leads to a state with an arc v, an arc uv to v's target is added, and u's target becomes a copy
without the arc v.  All arcs of one token lead to one state, so the state after a token is
named by the token, and its row of the transition table has a bit for each token that may follow.

The table of the bytes and the first ``COMPILED`` merges, which nearly all tokens of a text are among, is
compiled by putting in gadget after gadget: merging (u, v) gives the column uv, a copy of column u, and the row
uv, a copy of row v, and clears the bit (u, v).  The full table would be the vocabulary squared, so arcs to
and from later tokens follow their gadgets one by one the first time that a word needs them, and are kept:

* a later merge of (a, t) takes the arc away;
* an arc t = uv, added when uv was merged, needs the arc u at that time;
* a state made for a = uv copies the arcs that v's state had at that time;
* if a = u = v, then (a, uv) has no arc, because the leftmost pair merges first.

A pre-split word is encoded by following arcs over its bytes: exactly one path spells it.  Arc labels decode: a token emits its bytes.
The words of many texts that are not known yet are encoded side by side, one numpy step for all of them.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import pandas_udf

#: How byte-level vocabularies split text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes with: printable Latin-1 as itself, the rest from U+0100 on."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(kept)]
    return {chr(b): b for b in kept} | {chr(256 + k): b for k, b in enumerate(rest)}


#: Merges whose gadgets are compiled into the table.
COMPILED = 4096


def compile_gadgets(merges: list[tuple[int, int, int]], loops: list[int], size: int) -> np.ndarray:
    """The packed transition table (row: state, bit: next token) over ``size`` tokens, numbered from 0.

    ``loops`` are the bytes' tokens; merges (u, v, uv) are put in one after the other.
    """
    table = np.zeros((size, -(-size // 8)), dtype=np.uint8)

    def put(row: int, column: int, on: bool) -> None:
        bit = np.uint8(1 << column % 8)
        table[row, column // 8] = table[row, column // 8] | bit if on else table[row, column // 8] & ~bit

    first = np.zeros(size, dtype=np.uint8)
    first[loops] = 1
    table[loops] = np.packbits(first, bitorder="little")
    for u, v, uv in merges:
        # whoever could read u, and v behind it, can read uv
        table[:, uv // 8] |= ((table[:, u // 8] >> np.uint8(u % 8)) & np.uint8(1)) << np.uint8(uv % 8)
        table[uv] = table[v]  # behind uv stands what may stand behind v
        if u == v:  # of three in a row the first two merge
            put(u, uv, False)
        put(u, v, False)
    return table


#: Stands behind each word where many are encoded; no text in UTF-8 has this byte.
SEPARATOR = 0xFF
#: Fewer words than this are encoded one by one.
SIDE_BY_SIDE = 24
#: Bytes of words that are encoded side by side; a longer word is encoded alone.
WORD_BYTES = 1 << 17
#: About the bytes of texts whose words are looked up together.
TEXT_BYTES = 1 << 20
#: Marks that are one pre-split word where only they follow letters.
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


class _Table(dict):
    """What keys are read as.  Keys met in one call wait in a short table and are forgotten with it; keys met
    in another call, too, stay, so the many that never return take no memory.  Either starts anew at its limit.

    Values are ids in four bytes each.  Keys of over ``LONGEST`` characters are read each time, so that the limits bound bytes, too.
    """

    LONGEST = 128

    def __init__(self, read, limit: int, waiting: int):
        self.read, self.limit, self.most, self.waiting = read, limit, waiting, {}

    def all(self, keys: set[str]) -> dict[str, bytes]:
        """What each key is read as; those not known are read in one call."""
        unknown = keys.difference(self)
        found = {key: self[key] for key in keys.difference(unknown)}
        again = unknown.intersection(self.waiting)
        for key in again:
            if len(self) >= self.limit:
                self.clear()
            self[key] = found[key] = self.waiting.pop(key)
        fresh = self.read(list(unknown.difference(again)))
        found.update(fresh)
        short = {key: value for key, value in fresh.items() if len(key) <= self.LONGEST}
        if len(self.waiting) + len(short) > self.most:
            self.waiting.clear()
        self.waiting.update(islice(short.items(), self.most))
        return found


class _Lookup:
    """Values of many keys at once: a hash table in arrays, with the next free place where a key's own is taken."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, (4 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, dtype=np.int64), np.full(1 << bits, -1, dtype=np.int32)
        at = self._place(keys)
        while len(keys):
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[free]
            mine = self.keys[at] == keys
            self.values[at[mine]] = values[mine]
            keys, values, at = keys[~mine], values[~mine], at[~mine] + 1 & self.mask

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).view(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The value of each key, -1 where there is none."""
        at = self._place(keys)
        there = self.keys[at]
        found = np.where(there == keys, self.values[at], np.int32(-1))
        more = np.flatnonzero((there != keys) & (there >= 0))
        at = at[more]
        while len(more):
            at = at + 1 & self.mask
            there = self.keys[at]
            hit = there == keys[more]
            found[more[hit]] = self.values[at[hit]]
            on = ~hit & (there >= 0)
            more, at = more[on], at[on]
        return found


class _Trie:
    """The beginnings of all tokens, numbered; an arc's key is its node and byte."""

    def __init__(self, prefixes: dict[bytes, int]):
        nodes = {b"": 0} | {label: k for k, label in enumerate(prefixes, 1)}
        self.token = np.array([-1, *prefixes.values()], dtype=np.int32)
        labels = [label for label in prefixes if SEPARATOR not in label]
        keys = np.fromiter((nodes[label[:-1]] << 8 | label[-1] for label in labels), np.int64, len(labels))
        self.arcs = _Lookup(keys, np.fromiter((nodes[label] for label in labels), np.int32, len(labels)))

    def longest(self, text: np.ndarray) -> np.ndarray:
        """The longest token at each place of bytes that end in a separator, over none; -1: none."""
        best = np.full(len(text), -1, dtype=np.int32)
        place, node, depth = np.arange(len(text)), np.zeros(len(text), dtype=np.int64), 0
        while len(place):
            found = self.arcs.get(node << 8 | text[place + depth])
            on = found >= 0
            place, node, depth = place[on], found[on].astype(np.int64), depth + 1
            token = self.token[node]
            best[place[token >= 0]] = token[token >= 0]
        return best


class Automaton:
    """Compiled from a vocabulary file of the ``tokenizers`` library (byte-level BPE, lossless split)."""

    def __init__(self, tokenizer_file: str, word_limit: int = 80_000, arc_limit: int = 100_000, compiled: int = COMPILED):
        with open(tokenizer_file, encoding="utf-8") as f:
            spec = json.load(f)
        model, letters = spec["model"], byte_letters()
        if spec["normalizer"] or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError("only byte-level vocabularies without a normalizer or a prefix space")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        as_bytes = lambda s: bytes(letters[c] for c in s)
        vocab = model["vocab"]
        self.label = {i: as_bytes(s) for s, i in vocab.items() if all(c in letters for c in s)}
        self.label |= {i: s.encode() for s, i in self.special.items()}
        self.by_bytes: dict[bytes, int] = {}
        #: By token: when it was merged (-1: a byte), from which two.
        self.time: dict[int, int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        for b in range(256):
            token = vocab[next(c for c, x in letters.items() if x == b)]
            self.by_bytes[bytes([b])], self.time[token] = token, -1
        for when, (left, right) in enumerate(m.split(" ") if isinstance(m, str) else m for m in model["merges"]):
            u, v, uv = vocab[left], vocab[right], vocab[left + right]
            self.merged.setdefault((u, v), when)
            if uv not in self.time:
                self.time[uv], self.parts[uv] = when, (u, v)
                self.by_bytes[as_bytes(left + right)] = uv
        self.end = len(model["merges"])
        #: Places of the compiled tokens in the table; tokens are numbered by when they were merged.
        early = [t for t, when in self.time.items() if when < compiled]
        self.place = {t: k for k, t in enumerate(early)}
        steps = [(self.place[self.parts[t][0]], self.place[self.parts[t][1]], self.place[t]) for t in early if t in self.parts]
        self.width = -(-len(early) // 8)
        self.table = compile_gadgets(steps, [k for t, k in self.place.items() if t not in self.parts], len(early)).tobytes()
        self._clear_late(merges=[(u, v) for (u, v), when in self.merged.items() if when >= compiled and u in self.place and v in self.place])
        self.made = {t: True for t, when in self.time.items() if when < 0}
        #: Of each beginning of a token: the token that it is, or -1.
        self.prefixes: dict[bytes, int] = {}
        for label, token in self.by_bytes.items():
            for k in range(1, len(label)):
                self.prefixes.setdefault(label[:k], -1)
            self.prefixes[label] = token
        self.sizes = {token: len(label) for label, token in self.by_bytes.items()}
        #: Of each token: the longest other token that begins it, or -1.
        self.shorter = {token: next((self.by_bytes[label[:k]] for k in range(len(label) - 1, 0, -1) if label[:k] in self.by_bytes), -1) for label, token in self.by_bytes.items()}
        self.split = regex.compile(PATTERN)
        self.specials = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.risky = regex.compile(r"\s ")
        self.arcs: dict[int, bool] = {}
        self.arc_limit = arc_limit
        #: What a piece at the start of a section, one behind a space, and a pre-split word is read as.
        self.heads = _Table(self.read, word_limit // 8, word_limit // 8)
        self.words = _Table(lambda pieces: self.read(pieces, " "), word_limit, word_limit // 2)
        self.pretokens = _Table(lambda words: dict(zip(words, self.read_words(words))), word_limit, word_limit // 2)
        self._lay_out()

    def _clear_late(self, merges: list[tuple[int, int]]) -> None:
        """Later gadgets, too, clear the bit of their pair; what else they do concerns later tokens."""
        table = bytearray(self.table)
        for u, v in merges:
            a, t = self.place[u], self.place[v]
            table[a * self.width + t // 8] &= ~(1 << t % 8) & 0xFF
        self.table = bytes(table)

    def _lay_out(self) -> None:
        """By token in arrays, for steps of many words at once: place, size, next shorter token, and how ids are written."""
        top = max(self.label) + 1
        by_token = lambda of, other: np.array([of.get(t, other) for t in range(top + 1)], dtype=np.int32)  # noqa: E731  # the last: no token, -1
        self.trie = _Trie(self.prefixes)
        self.places, self.lengths, self.shorter_of = by_token(self.place, -1), by_token(self.sizes, 0), by_token(self.shorter, -1)
        self.times = by_token(self.time, -1)
        self.lefts, self.rights = (by_token({t: p[k] for t, p in self.parts.items()}, -1).astype(np.int64) for k in (0, 1))
        pairs = np.array(list(self.merged), dtype=np.int64).reshape(-1, 2)
        self.when_merged = _Lookup(pairs[:, 0] << 32 | pairs[:, 1], np.array(list(self.merged.values()), dtype=np.int32))
        #: Whether BPE makes the token of its own bytes: 1, 0, or -1 where nobody asked yet.
        self.makes_of = np.full(top, -1, dtype=np.int8)
        self.bits = np.frombuffer(self.table, dtype=np.uint8)
        self.decimals = np.array([f"{t}," for t in range(top)], dtype=bytes)
        labels = [self.label.get(t, b"") for t in range(top)]
        self.label_bytes = np.frombuffer(b"".join(labels), dtype=np.uint8)
        self.label_sizes = np.array(list(map(len, labels)))
        self.label_starts = np.cumsum(self.label_sizes) - self.label_sizes

    def arc(self, a: int, t: int) -> bool:
        """Whether the arc t leaves the state after a, once all gadgets are in: by the table, else by what is kept."""
        row, column = self.place.get(a), self.place.get(t)
        if row is not None and column is not None:
            return bool(self.table[row * self.width + (column >> 3)] >> (column & 7) & 1)
        found = self.arcs.get(a << 32 | t)
        if found is None:
            if len(self.arcs) >= self.arc_limit:
                self.arcs.clear()
            found = self.arcs[a << 32 | t] = self._arc(a, t)
        return found

    def _arc(self, a: int, t: int, now: int | None = None) -> bool:
        """The same just before merge ``now`` (None: after the last one)."""
        now = self.end if now is None else now
        while True:
            if self.merged.get((a, t), now) < now:
                return False
            at, tt = self.time[a], self.time[t]
            if at < 0 and tt < 0:
                return True
            if at > tt:
                now, a = at, self.parts[a][1]
            else:
                left, right = self.parts[t]
                if left == a == right:
                    return False
                now, t = tt, left

    def encode_word(self, word: bytes) -> list[int]:
        """The tokens of one pre-split word: the automaton's one path that spells it.

        From each place the longest arc label is tried first, then its shorter prefixes; a place
        from which no arc leads on is never entered again, so the work is linear in the word.
        """
        whole = self.by_bytes.get(word)
        if whole is not None and self.makes(whole):
            return [whole]
        n, place, table, width, shorter, sizes = len(word), self.place, self.table, self.width, self.shorter, self.sizes
        path: list[int] = []
        dead: set[int] = set()
        at, token = 0, self._longest(word, 0)
        while True:
            if token < 0:  # nothing leads on from here: go back and take a shorter label
                dead.add(at)
                last = path.pop()
                at -= sizes[last]
                token = shorter[last]
                continue
            end = at + sizes[token]
            if end not in dead:
                if path:
                    row, column = place.get(path[-1]), place.get(token)
                    if row is not None and column is not None:
                        ok = table[row * width + (column >> 3)] >> (column & 7) & 1
                    else:
                        ok = self.arc(path[-1], token)
                else:
                    ok = self.makes(token)
                if ok:
                    path.append(token)
                    if end == n:
                        return path
                    at, token = end, self._longest(word, end)
                    continue
            token = shorter[token]

    def _longest(self, word: bytes, at: int) -> int:
        """The longest token that the word has at a place."""
        found, end, prefixes = -1, at + 1, self.prefixes
        token = prefixes.get(word[at:end])
        n = len(word)
        while token is not None:
            if token >= 0:
                found = token
            end += 1
            if end > n:
                break
            token = prefixes.get(word[at:end])
        return found

    def makes(self, token: int) -> bool:
        """Whether BPE turns a token's own bytes into it: its parts do, and their arc stood when they merged."""
        found = self.made.get(token)
        if found is None:
            u, v = self.parts[token]
            found = self.made[token] = self.makes(u) and self.makes(v) and self._arc(u, v, self.time[token])
        return found

    def _follows(self, last: np.ndarray, token: np.ndarray) -> np.ndarray:
        """:meth:`arc` of each pair; where ``last`` is -1, :meth:`makes` of the token."""
        row, column = self.places[last], self.places[token]
        ok = (self.bits[row * self.width + (column >> 3)] >> (column & 7).astype(np.uint8) & 1).astype(bool)
        first = last < 0
        asked = token[first]
        for t in np.unique(asked[self.makes_of[asked] < 0]).tolist():
            self.makes_of[t] = self.makes(t)
        ok[first] = self.makes_of[asked] > 0
        late = np.flatnonzero(((row < 0) | (column < 0)) & ~first)
        ok[late] = self._arcs(last[late].astype(np.int64), token[late].astype(np.int64))
        return ok

    def _arcs(self, a: np.ndarray, t: np.ndarray) -> np.ndarray:
        """:meth:`_arc` of each pair, after the last merge."""
        found, which, now = np.zeros(len(a), dtype=bool), np.arange(len(a)), np.full(len(a), self.end)
        while len(which):
            when = self.when_merged.get(a << 32 | t)
            at, tt = self.times[a], self.times[t]
            stands = (when < 0) | (when >= now)
            found[which[stands & (at < 0) & (tt < 0)]] = True
            copied = at > tt
            left = self.lefts[t]
            on = stands & ((at >= 0) | (tt >= 0)) & (copied | (left != a) | (self.rights[t] != a))
            now = np.where(copied, at, tt)[on]
            a, t, which = np.where(copied, self.rights[a], a)[on], np.where(copied, t, left)[on], which[on]
        return found

    def _encode_side_by_side(self, words: list[bytes]) -> list[bytes]:
        """:meth:`encode_word` of each word, all taking one step at a time; the ids in four bytes each.

        What a word keeps is kept by its places in the joined words: the token that starts there (on the path only), where
        the token before it starts, and whether no arc leads on from there.
        """
        ends = np.cumsum(np.array(list(map(len, words))) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        text = np.frombuffer(b"".join([w + b"\xff" for w in words]), dtype=np.uint8)
        best = self.trie.longest(text)
        path, before, dead = np.full(len(text), -1, dtype=np.int32), np.zeros(len(text), dtype=np.int32), np.zeros(len(text), dtype=bool)
        before[starts] = -1
        word, at = np.arange(len(words)), starts
        token, last = best[at], np.full(len(words), -1, dtype=np.int32)
        while len(word) >= SIDE_BY_SIDE:
            end = at + self.lengths[token]
            ok = (token >= 0) & ~dead[end]
            tried = np.flatnonzero(ok)
            ok[tried] = self._follows(last[tried], token[tried])
            back = np.flatnonzero(token < 0)
            shorter = self.shorter_of[token]
            # those whose arc stands go on behind it
            on = np.flatnonzero(ok)
            path[at[on]], before[end[on]] = token[on], at[on]
            # those from which nothing leads on go back and take a shorter label
            dead[at[back]] = True
            came = before[at[back]]
            shorter[back], path[came] = self.shorter_of[path[came]], -1
            earlier = before[came]
            last[on] = token[on]
            last[back] = np.where(earlier < 0, -1, path[earlier])
            token = np.where(ok, best[np.where(ok, end, 0)], shorter)
            at = np.where(ok, end, at)
            at[back] = came
            left = at < ends[word]
            if not left.all():
                word, at, token, last = word[left], at[left], token[left], last[left]
        ids = np.flatnonzero(path >= 0)
        raw = path[ids].astype(np.uint32).tobytes()
        stops = (4 * np.searchsorted(ids, ends)).tolist()
        out = [raw[a:b] for a, b in zip([0, *stops], stops)]
        for k in word.tolist():  # the last few take fewer steps alone
            out[k] = array("I", self.encode_word(words[k])).tobytes()
        return out

    def read_words(self, words: list[str]) -> list[bytes]:
        """What pre-split words are read as."""
        out: list[bytes] = []
        some: list[bytes] = []
        size = 0

        def flush() -> None:
            out.extend(self._encode_side_by_side(some) if len(some) >= SIDE_BY_SIDE else [array("I", self.encode_word(w)).tobytes() for w in some])
            some.clear()

        for w in map(str.encode, words):
            if size + len(w) > WORD_BYTES:
                flush()
                size = 0
            some.append(w)
            size += len(w)
        flush()
        return out

    def read(self, pieces: list[str], lead: str = "") -> dict[str, bytes]:
        """The ids of pieces behind ``lead``, four bytes each."""
        plain, parts = [], {}
        for p in pieces:
            if p.isalpha():  # one pre-split word
                plain.append(p)
            elif (stem := p.rstrip(MARKS)).isalpha():  # two
                parts[p] = lead + stem, p[len(stem) :]
            else:
                parts[p] = self.split.findall(lead + p)
        found = dict(zip(plain, self.read_words([lead + p for p in plain])))
        known = self.pretokens.all(set(chain.from_iterable(parts.values())))
        for p, words in parts.items():
            found[p] = b"".join([known[w] for w in words])
        return found

    def cut(self, text: str) -> list[tuple[_Table, list[str]]]:
        """The pieces of a text, with the tables that keep what they are read as.

        A text is cut before each space that follows no white space, where no pre-split word
        crosses; such pieces repeat much more than texts do.
        """
        if self.risky.search(text):
            return [(self.pretokens, self.split.findall(text))]
        first, *rest = text.split(" ")
        return [(self.heads, [first]), (self.words, rest)]

    def sections(self, text: str) -> Iterator[tuple[str, bool]]:
        """A text cut at the vocabulary's special tokens; True marks one."""
        at = 0
        for m in self.specials.finditer(text) if self.specials else ():
            if m.start() > at:
                yield text[at : m.start()], False
            yield m[0], True
            at = m.end()
        if at < len(text):
            yield text[at:], False

    def encode(self, text: str | None) -> list[int]:
        """The ids of a text; null is empty."""
        out: list[int] = []
        for part, special in self.sections(text or ""):
            out += [self.special[part]] if special else [i for w in self.split.findall(part) for i in self.encode_word(w.encode())]
        return out

    def decode(self, ids: list[int]) -> str:
        """The labels of the arcs, in order; bytes that are not UTF-8 become U+FFFD.  Special tokens stay."""
        return b"".join([self.label[i] for i in ids]).decode("utf-8", "replace")

    def read_all(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text; null is empty."""
        cuts = [[cut for part, special in self.sections(text or "") for cut in ([(None, [part])] if special else self.cut(part))] for text in texts]
        known = {id(None): {t: array("I", [i]).tobytes() for t, i in self.special.items()}}
        for table in (self.heads, self.words, self.pretokens):
            known[id(table)] = table.all(set(chain.from_iterable(pieces for cut in cuts for t, pieces in cut if t is table)))
        read = lambda cut: b"".join([b"".join(map(known[id(t)].__getitem__, pieces)) for t, pieces in cut])
        return [np.frombuffer(read(cut), dtype=np.uint32) for cut in cuts]

    def digest_all(self, texts: list[str | None]) -> list[tuple[int, str, str]]:
        """:meth:`digest` of each text."""
        return [self._digest(ids) for ids in self.read_all(texts)]

    def digest(self, text: str | None) -> tuple[int, str, str]:
        """(tokens, sha256 of the ids joined by commas, sha256 of the decoded text)."""
        return self.digest_all([text])[0]

    def _digest(self, ids: np.ndarray) -> tuple[int, str, str]:
        written, spelled = hashlib.sha256(), []
        for first in range(0, len(ids), WORD_BYTES):
            some = ids[first : first + WORD_BYTES]
            decimals = self.decimals[some].view(np.uint8)
            joined = decimals[decimals != 0]
            written.update(joined if first + WORD_BYTES < len(ids) else joined[:-1])
            sizes = self.label_sizes[some]
            stops = np.cumsum(sizes)
            places = np.repeat(self.label_starts[some] - stops + sizes, sizes) + np.arange(stops[-1])
            spelled.append(self.label_bytes[places].tobytes())
        return len(ids), written.hexdigest(), hashlib.sha256(b"".join(spelled).decode("utf-8", "replace").encode()).hexdigest()


_MACHINES: dict[str, Automaton] = {}


def machine(tokenizer_file: str) -> Automaton:
    """One per Python worker."""
    if tokenizer_file not in _MACHINES:
        _MACHINES[tokenizer_file] = Automaton(tokenizer_file)
    return _MACHINES[tokenizer_file]


def encode(df: DataFrame, tokenizer_file: str, text: str = "text", into: str = "token_ids") -> DataFrame:
    """Add the ids of ``text`` as array<int> (null text: empty array); replaces a column of that name."""
    @pandas_udf("array<int>")
    def ids(texts: pd.Series) -> pd.Series:
        return texts.map(machine(tokenizer_file).encode)

    return df.withColumn(into, ids(df[text]))


def decode(df: DataFrame, tokenizer_file: str, ids: str = "token_ids", into: str = "decoded") -> DataFrame:
    """Add the text that ``ids`` decode to (null: empty)."""
    @pandas_udf("string")
    def back(rows: pd.Series) -> pd.Series:
        return rows.map(lambda x: machine(tokenizer_file).decode([] if x is None else [int(i) for i in x]))

    return df.withColumn(into, back(df[ids]))


def digests(docs: DataFrame, tokenizer_file: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each row of (doc_id, text), whole texts; no shuffle.

    Null and empty texts have no tokens and the digest of no bytes.  Repeated rows each give a row.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = machine(tokenizer_file)
        for batch in batches:
            size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
            stops = [*(np.flatnonzero(np.diff(size // TEXT_BYTES)) + 1).tolist(), batch.num_rows]
            for first, stop in zip([0, *stops], stops):
                some = batch.slice(first, stop - first)
                got = m.digest_all(some.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.string()), pa.array([g[2] for g in got], pa.string())],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(read, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op7_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the tokens of every whole text of ``documents`` and of what they decode to; edge cases as in :func:`digests`."""
    import public_tokenizers

    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES = {"op7_bpe_automaton": op7_bpe_automaton}
ORACLE_SQL: dict[str, str] = {}
