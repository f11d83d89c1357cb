"""Pairs of records by rules 1 to 9, a block of records against another: scores of all names at once by numpy.

The longest common subsequences of one text with all texts of a block are worked out together, a
character at a time, and go on from where the text before, which stands before it in order, parted from it.
Names that this cannot score (of over 64 characters, with a token twice, with two tokens in common,
or with a token that may be another's initial) are scored one by one by :mod:`similarity`.  Nothing is left out.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from os.path import commonprefix

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from mergewell.functions import similarity as sim

#: Names of one side that are scored together with all of the other block.
CHUNK = 128
#: Up to so many pairs of distinct company lists are scored beforehand; beyond, only those that names let count.
TABLE = 10_000
WIDE = 64


def letter_masks(texts: list[str]) -> tuple[type, dict[str, np.ndarray]]:
    """Per character the places where it stands in each text, as bits; texts have ``WIDE`` characters at most."""
    kind = np.uint32 if max(map(len, texts), default=0) <= 32 else np.uint64
    found: dict[str, list[int]] = {}
    for i, text in enumerate(texts):
        for at, ch in enumerate(text):
            if ch not in found:
                found[ch] = [0] * len(texts)
            found[ch][i] |= 1 << at
    return kind, {ch: np.array(bits, dtype=kind) for ch, bits in found.items()}


def lcs_matrix(n: int, masked: tuple[type, dict[str, np.ndarray]], rights: list[str], low: np.ndarray | None = None) -> np.ndarray:
    """Lengths of the longest common subsequences of n texts, given by their masks, a row for each right text.

    Rights in order are the fastest, as neighbours share their beginnings.  ``low`` are the bits that count, if not
    all: a text's first places give the length for its beginning.
    """
    kind, masks = masked
    states = [np.full(n, np.iinfo(kind).max, dtype=kind)]
    hit, total = np.empty(n, dtype=kind), np.empty(n, dtype=kind)
    out, before = np.empty((len(rights), n), dtype=np.uint8), ""
    for j, text in enumerate(rights):
        k = 0
        for x, y in zip(before, text, strict=False):
            if x != y:
                break
            k += 1
        before = text
        for at in range(k, len(text)):
            if at + 1 == len(states):
                states.append(np.empty(n, dtype=kind))
            row, mask = states[at], masks.get(text[at])
            if mask is None:
                states[at + 1][:] = row
                continue
            np.bitwise_and(row, mask, out=hit)
            np.add(row, hit, out=total)
            np.bitwise_xor(row, hit, out=hit)
            np.bitwise_or(total, hit, out=states[at + 1])
        np.bitwise_not(states[len(text)], out=hit)
        if low is not None:
            np.bitwise_and(hit, low, out=hit)
        np.bitwise_count(hit, out=out[j])
    return out


class Block:
    """Records (idx, name, first and last record of the name, companies, skills, keys) in order of their names' texts."""

    def __init__(self, table: pa.Table):
        self.table = table
        rows = table.to_pylist()
        texts = {r["name"]: " ".join(sorted(r["name"].split())) for r in rows}
        rows.sort(key=lambda r: (texts[r["name"]], r["name"], r["record_idx"]))
        self.names = list(dict.fromkeys(r["name"] for r in rows))
        place = {n: i for i, n in enumerate(self.names)}
        self.of = np.array([place[r["name"]] for r in rows], dtype=np.int64)
        self.idx = np.array([r["record_idx"] for r in rows], dtype=np.int64)
        self.first = np.array([r["record_idx"] == r["first"] for r in rows], dtype=bool)
        self.last = np.array([r["record_idx"] == r["last"] for r in rows], dtype=bool)
        self.texts = [texts[n] for n in self.names]
        self.tokens = [n.split() for n in self.names]
        self.sizes = np.array([len(t) for t in self.texts], dtype=np.int64)
        self.odd = np.array([len(x) > WIDE or len(set(t)) < len(t) for x, t in zip(self.texts, self.tokens, strict=True)], dtype=bool)
        self.masks = letter_masks([t if len(t) <= WIDE else "" for t in self.texts])
        self.end = _shared_end(self.texts)
        self.rests: dict[str, tuple] = {}
        self.by_token, self.short, self.firsts = defaultdict(list), defaultdict(list), defaultdict(list)
        for i, tokens in enumerate(self.tokens):
            for t in set(tokens):
                self.by_token[t].append(i)
                if len(t) == 1:
                    self.short[t].append(i)
            for c in {t[0] for t in tokens}:
                self.firsts[c].append(i)
        self.companies, self.company_of = _coded(tuple(sorted(set(r["companies"] or ()))) for r in rows)
        self.skills, self.skill_of = _coded(tuple(sorted(set(r["skills"] or ()), key=str)) for r in rows)
        self.keys = defaultdict(list)
        for i, r in enumerate(rows):
            for k in r["keys"] or ():
                self.keys[k["rule"], k["key"], k["first"]].append(i)

    def part(self, idx: np.ndarray) -> "Block":
        """A block of some of the records."""
        return Block(self.table.filter(pc.is_in(self.table["record_idx"], pa.array(idx))))

    def without(self, token: str) -> tuple[list[int], np.ndarray, tuple[type, dict[str, np.ndarray]]]:
        """Names with a token that are not odd, and of what else they hold the lengths and the masks; worked out once."""
        if token not in self.rests:
            names = [i for i in self.by_token[token] if not self.odd[i]]
            rests = [_rest(self.tokens[i], token) for i in names]
            self.rests[token] = names, np.array([len(x) for x in rests], dtype=np.float64), letter_masks(rests)
        return self.rests[token]


def _rest(tokens: list[str], token: str) -> str:
    return " ".join(sorted(x for x in tokens if x != token))


def _shared_end(texts: list[str]) -> str:
    """The longest text that all end in."""
    return commonprefix([t[::-1] for t in texts])[::-1]


def _coded(values) -> tuple[list, np.ndarray]:
    seen: dict = {}
    codes = [seen.setdefault(v, len(seen)) for v in values]
    return list(seen), np.array(codes, dtype=np.int64)


def _skill_table(a: Block, b: Block) -> np.ndarray:
    """Per list of b and list of a: shared skills as a share of the shorter list, 0 to 100; 0 if none is shared."""
    words = {w: i for i, w in enumerate({w for x in a.skills for w in x} & {w for x in b.skills for w in x})}

    def has(lists: list) -> np.ndarray:
        out = np.zeros((len(lists), len(words)), dtype=np.float32)
        for i, x in enumerate(lists):
            out[i, [words[w] for w in x if w in words]] = 1
        return out

    sizes = lambda lists: np.array([max(1, len(x)) for x in lists], dtype=np.float64)
    shared = (has(b.skills) @ has(a.skills).T).astype(np.float64)
    return 100.0 * shared / np.minimum(sizes(b.skills)[:, None], sizes(a.skills)[None, :])


class _Companies:
    """Per list of b and list of a the best token set score, -1 if either is empty; each pair is scored when first needed."""

    def __init__(self, a: Block, b: Block):
        self.a, self.b = a.companies, b.companies
        self.known: dict[tuple[str, str], float] = {}
        self.table = np.full((len(self.b), len(self.a)), np.nan)
        if self.table.size <= TABLE:
            self.get(*np.indices(self.table.shape).reshape(2, -1))

    def get(self, y: np.ndarray, x: np.ndarray) -> np.ndarray:
        got = self.table[y, x]
        for code in np.unique((y * len(self.a) + x)[np.isnan(got)]):
            j, i = divmod(int(code), len(self.a))
            self.table[j, i] = max((self._one(p, q) for p in self.a[i] for q in self.b[j]), default=-1.0)
        return self.table[y, x]

    def _one(self, p: str, q: str) -> float:
        if (p, q) not in self.known:
            self.known[p, q] = sim.token_set(p, q)
        return self.known[p, q]


def _cells(rows, columns) -> tuple:
    """An index for all cells of rows and columns; slices where they ascend without a gap, which are faster."""
    rows, columns = (np.asarray(x, dtype=np.int64) for x in (rows, columns))
    if len(rows) and len(columns) and all(x[-1] - x[0] + 1 == len(x) and (np.diff(x) == 1).all() for x in (rows, columns)):
        return slice(rows[0], rows[-1] + 1), slice(columns[0], columns[-1] + 1)
    return np.ix_(rows, columns)


def _name_scores(a: Block, b: Block, lo: int, hi: int, floor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For names lo to hi of b (rows) and all of a: by token set, by token sort, by initials with a's name left, with b's left.

    Scores under ``floor`` may come out too low, others are exact; equal names have 100, blank ones 0.
    """
    n = hi - lo
    texts = b.texts[lo:hi]
    # what all texts end in is common to them, and the longest common subsequences of what stands before it are the rest
    end = len(_shared_end([a.end, *texts]))
    low = np.array([(1 << max(0, len(t) - end)) - 1 if len(t) <= WIDE else 0 for t in a.texts], dtype=a.masks[0]) if end else None
    common = lcs_matrix(len(a.names), a.masks, [t[: len(t) - end] if len(t) <= WIDE else "" for t in texts], low)
    sort = np.add(common, end, dtype=np.float64)
    sort *= 200.0
    sort /= np.maximum(a.sizes.astype(np.float64)[None, :] + b.sizes[lo:hi, None], 1.0)
    by_set = sort.copy()
    alone = np.zeros(sort.shape, dtype=bool)
    # a letter in the place of a token
    for mine, theirs in ((a.short, b.firsts), (a.firsts, b.short)):
        for c in mine.keys() & theirs.keys():
            rows = [j - lo for j in theirs[c] if lo <= j < hi]
            if rows:
                alone[np.ix_(rows, mine[c])] = True
    seen = np.zeros(sort.shape, dtype=bool)
    here = defaultdict(list)
    for j in range(lo, hi):
        for t in set(b.tokens[j]):
            if t in a.by_token:
                here[t].append(j)
    for t, rows in here.items():
        cells = _cells([j - lo for j in rows], a.by_token[t])
        alone[cells] |= seen[cells]
        seen[cells] = True
    if a.odd.any() or b.odd[lo:hi].any():
        odd = a.odd[None, :] | b.odd[lo:hi, None]
        # without a token in common both scores are ratios of whole texts, which lengths bound
        shorter = lambda x: np.array([len(" ".join(dict.fromkeys(t))) for t in x.tokens], dtype=np.int64)
        ua, ub = shorter(a)[None, :], shorter(b)[lo:hi, None]
        fits = lambda x, y: 200.0 * np.minimum(x, y) >= (floor - 1e-6) * (x + y)
        alone |= odd & (seen | fits(a.sizes[None, :], b.sizes[lo:hi, None]) | fits(ua, ub))
    for t, rows in here.items():
        rows = [j for j in rows if not b.odd[j]]
        columns, la, masks = a.without(t)
        if not rows or not columns:
            continue
        if len(rows) * len(columns) <= 8:
            for j in rows:
                for i in columns:
                    if a.names[i] != b.names[j]:
                        alone[j - lo, i] = True
            continue
        rb = [_rest(b.tokens[j], t) for j in rows]
        order = sorted(range(len(rows)), key=rb.__getitem__)
        rows, rb = [rows[k] for k in order], [rb[k] for k in order]
        lb = np.array([len(x) for x in rb], dtype=np.float64)
        size = len(t)
        both = np.add(lcs_matrix(len(la), masks, rb), size + 1, dtype=np.float64)
        both *= 200.0
        both /= 2 * size + 2 + la[None, :] + lb[:, None]
        # the token against all of the shorter name; 100 if that has nothing else
        for n_rest in (la[None, :], lb[:, None]):
            np.maximum(both, np.where(n_rest == 0, 100.0, 200.0 * size / (2 * size + 1 + n_rest)), out=both)
        by_set[_cells([j - lo for j in rows], columns)] = both
    in_a = {x: i for i, x in enumerate(a.names)}
    for j in range(lo, hi):
        i = in_a.get(b.names[j])
        if i is not None:
            by_set[j - lo, i] = sort[j - lo, i] = 100.0 if b.tokens[j] else 0.0
            alone[j - lo, i] = False
    ab = ba = None
    rows, columns = np.nonzero(alone)
    if len(rows):
        ab, ba = np.zeros(sort.shape), np.zeros(sort.shape)
        for j, i in zip(rows.tolist(), columns.tolist(), strict=True):
            p, q = a.names[i], b.names[lo + j]
            by_set[j, i], sort[j, i], ab[j, i], ba[j, i] = sim.token_set(p, q), sim.token_sort(p, q), sim.initials(p, q), sim.initials(q, p)
    assert by_set.shape == (n, len(a.names))
    return by_set, sort, ab, ba


def found_pairs(a: Block, b: Block, same: bool, rules: tuple[float, float, float], labels: list | None = None, with_keys: bool = True, complete: bool = False) -> Iterator[tuple]:
    """(record of a, record of b, rule, score, key): every pair by its first rule; ``same`` if both are one block.

    Rule 6 joins the last record of a name with the first of another, and every record of a name with its first one; with ``complete`` all of them.
    Of rules on shared keys, pairs with a key's first record count by themselves, others only with ``complete`` or if another rule finds them;
    without ``with_keys`` only other rules are looked at.  With ``labels`` (arrays of a and b, which may change between
    what is yielded) pairs of the same label are left out.
    """
    name, company, skill = rules
    floor = min(name, (company - 35) / 0.65, (skill - 30) / 0.7)
    shares = _skill_table(a, b)
    companies = _Companies(a, b)
    tabled = companies.table.size <= TABLE
    best = star = None
    ranked = sorted(a.keys.keys() & b.keys.keys()) if with_keys else []
    if ranked:
        best, star = np.full((len(b.idx), len(a.idx)), len(ranked), dtype=np.int32), np.zeros((len(b.idx), len(a.idx)), dtype=bool)
        for rank in range(len(ranked) - 1, -1, -1):
            first = ranked[rank][2]
            rows, columns = np.array(b.keys[ranked[rank]]), np.array(a.keys[ranked[rank]])
            best[np.ix_(rows, columns)] = rank
            if complete:
                star[np.ix_(rows, columns)] = True
                continue
            star[np.ix_(rows[b.idx[rows] == first], columns)] = True
            star[np.ix_(rows, columns[a.idx[columns] == first])] = True
    in_a = {x: i for i, x in enumerate(a.names)}
    same_name = np.array([in_a.get(x, -1) for x in b.names])
    blank_a, blank_b = (np.array([not t for t in side.tokens], dtype=bool) for side in (a, b))
    eps = 1e-6
    for lo in range(0, len(b.names), CHUNK):
        hi = min(lo + CHUNK, len(b.names))
        r0, r1 = np.searchsorted(b.of, [lo, hi])
        open_ = None
        if labels is not None:
            open_ = labels[1][r0:r1, None] != labels[0][None, :]
            if not open_.any():
                continue
        by_set, sort, ab, ba = _name_scores(a, b, lo, hi, floor)
        at = np.ix_(b.of[r0:r1] - lo, a.of)
        later = b.idx[r0:r1, None] > a.idx[None, :]
        n = by_set[at]
        if ab is not None:
            n = np.maximum(n, np.where(later, ba[at], ab[at]))
        s = np.maximum(n, sort[at])
        k = shares[np.ix_(b.skill_of[r0:r1], a.skill_of)]
        passes = (s >= name) | ((k > 0) & (0.7 * n + 0.3 * k >= skill - eps))
        if tabled:
            passes |= 0.65 * n + 0.35 * companies.table[np.ix_(b.company_of[r0:r1], a.company_of)] >= company - eps
        else:
            passes |= n >= (company - 35) / 0.65 - eps
        if blank_b[lo:hi].any():
            passes |= blank_b[b.of[r0:r1], None] & blank_a[a.of][None, :]
        if star is not None:
            passes |= star[r0:r1]
        if same:
            passes &= np.arange(r0, r1)[:, None] > np.arange(len(a.idx))[None, :]
        if open_ is not None:
            passes &= open_
        y, x = np.nonzero(passes)
        if not len(y):
            continue
        n, s, k, later = n[y, x], s[y, x], k[y, x], later[y, x]
        y = y + r0
        equal = same_name[b.of[y]] == a.of[x]
        if complete:
            six = equal | (s >= name)
        else:
            to_first = np.where(later, a.first[x], b.first[y])
            six = np.where(equal, to_first, (s >= name) & to_first & np.where(later, b.last[y], a.last[x]))
        named = ~blank_a[a.of[x]] & ~blank_b[b.of[y]]
        eight_s = 0.7 * n + 0.3 * k
        eight = named & (k > 0) & (eight_s >= skill)
        c = np.full(len(x), -1.0)
        may = named & ~six & (n >= (company - 35) / 0.65 - eps)
        c[may] = companies.get(b.company_of[y[may]], a.company_of[x[may]])
        seven_s = 0.65 * n + 0.35 * c
        seven = (c >= 0) & (seven_s >= company)
        rule = np.select([six, seven, eight], [6, 7, 8], 99)
        score = np.select([six & equal, six, seven, eight], [100.0, s, seven_s, eight_s], 0.0)
        key = np.full(len(x), -1, dtype=np.int64)
        if best is not None:
            rank = best[y, x]
            of_rule = np.array([r[0] for r in ranked] + [100])[rank]
            by_key = (of_rule < rule) & ((rule < 99) | star[y, x])
            rule, key = np.where(by_key, of_rule, rule), np.where(by_key, rank, -1)
        good = np.flatnonzero(rule < 99)
        if len(good):
            yield x[good], y[good], rule[good], score[good], [ranked[i][1] if i >= 0 else None for i in key[good].tolist()] if ranked else None


def scored_pairs(a: Block, b: Block, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(indexes of b, offsets, indexes of a, scores): every pair of a record of b and one of a; ``same`` if both are one block.

    The n-th index of b is paired with the indexes of a between the n-th offset and the next one.  The score is the best
    of token sort, token set and initials, with the name of the lesser index left.  Records of the same index are no pair.
    """
    width = len(a.idx)
    shared = same or len(np.intersect1d(a.idx, b.idx)) > 0
    blank_a, blank_b = (np.array([not t for t in side.tokens], dtype=bool) for side in (a, b))
    for lo in range(0, len(b.names), CHUNK):
        hi = min(lo + CHUNK, len(b.names))
        by_set, sort, ab, ba = _name_scores(a, b, lo, hi, 0.0)
        scores = np.maximum(by_set, sort, out=sort)
        # token sort takes two blank names for equal
        scores[np.ix_(blank_b[lo:hi], blank_a)] = 100.0
        end = int(np.searchsorted(b.of, hi))
        for r0 in range(int(np.searchsorted(b.of, lo)), end, CHUNK):
            r1 = min(r0 + CHUNK, end)
            of = lambda x: x[_cells(b.of[r0:r1] - lo, a.of)]  # noqa: B023, E731
            score = of(scores)
            if ab is not None:
                score = np.maximum(score, np.where(a.idx[None, :] < b.idx[r0:r1, None], of(ab), of(ba)))
            if not shared:
                yield b.idx[r0:r1], np.arange(0, (r1 - r0) * width + 1, width), np.tile(a.idx, r1 - r0), score.ravel()
                continue
            kept = a.idx[None, :] != b.idx[r0:r1, None]
            if same:
                kept &= np.arange(width)[None, :] < np.arange(r0, r1)[:, None]
            yield b.idx[r0:r1], np.concatenate(([0], np.cumsum(kept.sum(axis=1)))), np.broadcast_to(a.idx, kept.shape)[kept], score[kept]


class Groups:
    """Which records of two blocks hang together: labels of either side, the least of a group for all of it, changed in place."""

    def __init__(self, a: np.ndarray, b: np.ndarray):
        self.a, self.b = a.copy(), b.copy()

    def add(self, x: np.ndarray, y: np.ndarray) -> None:
        """Unite the groups of each pair."""
        parent: dict[int, int] = {}

        def top(v: int) -> int:
            while parent.setdefault(v, v) != v:
                parent[v] = parent[parent[v]]
                v = parent[v]
            return v

        known, codes = np.unique(np.concatenate((self.a, self.b)), return_inverse=True)
        p, q = codes[: len(self.a)][x], codes[len(self.a) :][y]
        for code in np.unique((p * len(known) + q)[p != q]).tolist():
            low, high = sorted((top(int(known[code // len(known)])), top(int(known[code % len(known)]))))
            parent[high] = low
        if not parent:
            return
        old = np.array(sorted(parent), dtype=np.int64)
        new = np.array([top(v) for v in old.tolist()], dtype=np.int64)
        for side in (self.a, self.b):
            at = np.minimum(np.searchsorted(old, side), len(old) - 1)
            hit = old[at] == side
            side[hit] = new[at[hit]]
