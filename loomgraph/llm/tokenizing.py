"""Exact, memoised use of a public tokenizer file.

No token of these tokenizers crosses from a character that isn't white space to one that is, so
a text can be cut there and each piece encoded alone; pieces repeat, so their ids are kept, and
new pieces are encoded many at a time, between separators that have a token of their own.
Texts with control characters on whose class regular-expression libraries differ, or with the
strings of special tokens, are encoded whole."""

from __future__ import annotations

import re
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from loomgraph.llm.common import KEPT, compact

_ODD = ("\x1c", "\x1d", "\x1e", "\x1f", "<|")
_PIECES = re.compile(r"\s*\S+|\s+").findall
#: pieces between single spaces that need a closer look: empty, next to more white space, or odd
_WHITE = r"\s\p{Z}\x0b\x1c-\x1f\x{85}"
_CLOSER = rf"^\n?$|^[\t-\x09\x0b-\r\x1c-\x1f\x{{85}}\p{{Z}}]|^\n[{_WHITE}]|[{_WHITE}]$|[\x1c-\x1f]|<\|"
_LOADED: dict[str, "MemoTokenizer"] = KEPT


def public_path(name: str) -> str:
    """Place of a public tokenizer file, resolved where it is used."""
    import public_tokenizers

    return public_tokenizers.path(name)


class _Numbers(dict):
    """Numbers pieces in the order they are first seen, and lists new ones."""

    def __init__(self):
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, piece: str) -> int:
        n = self[piece] = len(self)
        self.fresh.append(piece)
        return n


class MemoTokenizer:
    """name: file of the public tokenizers, or a path.  limit: pieces whose ids are kept."""

    def __init__(self, name: str, limit: int = 700_000):
        from tokenizers import Tokenizer

        path = name if "/" in name else public_path(name)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.limit, self.numbers = limit, _Numbers()
        self.ids = np.zeros(0, np.uint32)
        self.sizes, self.starts, self.uses = (np.zeros(0, np.int64) for _ in range(3))
        # where white space never becomes a token, pieces need not carry it
        spaced, plain = self._direct(["ab \n cd", "ab cd"])
        self.cut = str.split if np.array_equal(spaced, plain) else _PIECES
        self.joint = next(((s, i) for s in ("\n", " \x01 ") if (i := self._separator(s)) is not None), None)

    def _direct(self, texts: list[str]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, np.uint32) for x in found]

    def _separator(self, s: str) -> int | None:
        a, b, c, d, both, spaced = self._direct(["of.", "the", " the", "\x01", f"of.{s}the", f"of.{s} the"])
        i = both[len(a) : len(both) - len(b)]
        fits = len(i) == 1 and np.array_equal(both, [*a, *i, *b]) and np.array_equal(spaced, [*a, *i, *c]) and i[0] not in (*a, *b, *c)
        return int(i[0]) if fits and (s == "\n" or len(d) == 1) else None

    def _learn(self) -> None:
        fresh, self.numbers.fresh = self.numbers.fresh, []
        if not fresh:
            return
        mark = self.joint[0].strip(" ") if self.joint else ""
        alone = [k for k, p in enumerate(fresh) if not self.joint or mark in p or len(p) > 100]
        kept = set(alone)
        rest = [k for k in range(len(fresh)) if k not in kept] if kept else range(len(fresh))
        sizes, starts = np.zeros(len(fresh), np.int64), np.zeros(len(fresh), np.int64)
        parts, held = [self.ids], len(self.ids)
        for i in range(0, len(rest), 20_000):
            some = rest[i : i + 20_000]
            groups = [some[j : j + 200] for j in range(0, len(some), 200)]
            got = self._direct([self.joint[0].join([fresh[k] for k in g]) for g in groups])
            end = np.array([self.joint[1]], np.uint32)
            ids = np.concatenate([x for pair in zip(got, [end] * len(got), strict=True) for x in pair])
            at = np.flatnonzero(ids == self.joint[1])
            if len(at) != len(some):  # a piece has the separator's token
                alone += some
                continue
            n = np.diff(at, prepend=-1) - 1
            where = np.asarray(some)
            sizes[where], starts[where] = n, held + np.cumsum(n) - n
            parts.append(ids[ids != self.joint[1]])
            held += len(parts[-1])
        for k, ids in zip(alone, self._direct([fresh[k] for k in alone]) if alone else [], strict=True):
            sizes[k], starts[k] = len(ids), held
            parts.append(ids)
            held += len(ids)
        self.ids = np.concatenate(parts)
        self.sizes, self.starts = np.concatenate([self.sizes, sizes]), np.concatenate([self.starts, starts])
        self.uses = np.concatenate([self.uses, np.zeros(len(fresh), np.int64)])

    def _make_room(self) -> None:
        """When full, keeps the pieces used most."""
        if len(self.numbers) <= self.limit and len(self.ids) <= 16 * self.limit:
            return
        keep = np.argsort(-self.uses, kind="stable")[: self.limit // 3]
        keep = np.sort(keep[(self.uses[keep] > 1) & (self.sizes[keep] < 64)])
        pieces = list(self.numbers)
        self.numbers = _Numbers()
        self.numbers.update(zip([pieces[i] for i in keep.tolist()], range(len(keep)), strict=True))
        sizes = self.sizes[keep]
        ends = np.cumsum(sizes)
        self.ids = self.ids[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.starts[keep] - ends + sizes, sizes)]
        self.sizes, self.starts, self.uses = sizes, ends - sizes, self.uses[keep] // 2

    def encode_array(self, texts: pa.Array) -> list[bytes]:
        """As encode(), of an Arrow array: where pieces carry their white space, cut at single spaces
        and line ends without making a Python string of every piece; texts with other white
        space take the other way."""
        if self.cut is str.split:
            return self.encode(texts.to_pylist())
        self._make_room()
        text = pc.replace_substring(compact(texts), "\n", " \n")
        lists = pc.split_pattern(text, " ")
        lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
        counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        if not len(counts):
            return []
        coded = lists.flatten().dictionary_encode()
        index = coded.indices.to_numpy(zero_copy_only=False)
        closer = pc.match_substring_regex(coded.dictionary, _CLOSER).to_numpy(zero_copy_only=False)
        begin = np.cumsum(counts) - counts
        odd = np.logical_or.reduceat(closer[index], begin)
        words = coded.dictionary.to_pylist()
        keys = [w if w[:1] == "\n" else " " + w for w in words]
        firsts = [words[i] for i in index[begin]]
        known, numbers = self.numbers.get, self.numbers
        number = np.fromiter(map(known, keys, repeat(-1)), np.int64, len(keys))
        new = np.flatnonzero((number < 0) & ~closer)
        number[new] = np.arange(len(numbers), len(numbers) + len(new))
        wanted = [keys[i] for i in new.tolist()]
        numbers.update(zip(wanted, number[new].tolist(), strict=True))
        more = list(dict.fromkeys(k for k, o in zip(firsts, odd.tolist(), strict=True) if not o and k not in numbers))
        numbers.update(zip(more, range(len(numbers), len(numbers) + len(more)), strict=True))
        numbers.fresh += wanted + more
        self._learn()
        number[number < 0] = 0
        which = number[index]
        which[begin] = [known(k, 0) for k in firsts]
        full = np.repeat(~odd, counts)
        out = self._gather(which[full], np.where(odd, 0, counts))
        rest = np.flatnonzero(odd).tolist()
        if rest:
            for i, coded in zip(rest, self.encode(texts.take(pa.array(rest)).to_pylist()), strict=True):
                out[i] = coded
        return out

    def _gather(self, which: np.ndarray, counts) -> list[bytes]:
        """Ids of each text from its pieces' numbers, a part of the texts at a time."""
        self.uses += np.bincount(which, minlength=len(self.uses))
        cut, out, first = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64), [], 0
        while first < len(cut) - 1:
            last = max(first + 1, int(np.searchsorted(cut, cut[first] + 400_000, "right")) - 1)
            part = which[cut[first] : cut[last]]
            sizes = self.sizes[part]
            ends = np.cumsum(sizes)
            take = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.starts[part] - ends + sizes, sizes)
            raw = memoryview(self.ids[take].astype("<u4").tobytes())
            limits = 4 * np.concatenate([[0], ends])[cut[first : last + 1] - cut[first]]
            out += [bytes(raw[a:b]) for a, b in zip(limits[:-1].tolist(), limits[1:].tolist(), strict=True)]
            first = last
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text (null: empty) as little-endian unsigned 32-bit integers."""
        self._make_room()
        whole = {i: t for i, t in enumerate(texts) if t and any(o in t for o in _ODD)}
        cut, number, flat, counts = self.cut, self.numbers.__getitem__, [], []
        for i, t in enumerate(texts):
            pieces = cut(t) if t and i not in whole else ()
            flat.extend(map(number, pieces))
            counts.append(len(pieces))
        self._learn()
        out = self._gather(np.array(flat, np.int64), counts)
        for i, t in whole.items():
            out[i] = self._direct([t])[0].astype("<u4").tobytes()
        return out


def tokenizer(name: str, limit: int = 700_000) -> MemoTokenizer:
    """One per Python worker, kept between tasks until one of another operator needs the room (alone())."""
    if name not in _LOADED:
        _LOADED[name] = MemoTokenizer(name, limit)
    return _LOADED[name]
