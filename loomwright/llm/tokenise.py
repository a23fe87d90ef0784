"""Whole-text tokenisation with a public tokenizer file, memoised on white-space-led words.

Both vocabularies split a text with a regular expression in which nothing but white space follows white space, so a
white-space character after a non-space character always begins a new token. Each text is cut there, a distinct
piece goes through the tokenizers library once per worker, and a text's ids are the joined ids of its pieces. Texts
for which that cut is not proven (special-token markers, white space other than space and line feed) go through
the library whole. The result is the library's own for every text.
"""

from __future__ import annotations

import functools
import hashlib
import os
import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A piece: white space, then what follows it; the last may be white space alone.
_PIECE = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
#: White space or control characters on which Python and the tokenizers could disagree, and special-token markers.
_ASCII_ODD = ["\0", "\t", "\v", "\f", "\r", "\x1c", "\x1d", "\x1e", "\x1f", "<|"]
_WIDE_ODD = ["\x85", "\xa0", "\u1680", *map(chr, range(0x2000, 0x200B)), "\u2028", "\u2029", "\u202f", "\u205f", "\u3000"]
_RUNS = ["  ", "\n\n", " \n", "\n "]
#: A word that parts others where a vocabulary drops white space; words that contain it are encoded alone.
_PART = "|"


def _odd(text: str) -> bool:
    return any(c in text for c in _ASCII_ODD) or not text.isascii() and any(c in text for c in _WIDE_ODD)


def _runs(text: str) -> bool:
    return text[0] in " \n" or text[-1] in " \n" or any(c in text for c in _RUNS)


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Encodes texts to 16- or 32-bit little-endian ids.

    max_memo bounds what it remembers, and so its memory. Words met often are kept in Arrow and numpy tables, at most a
    quarter of max_memo, in which all words of a batch are looked up at once; other words of late are in a dict, which
    is emptied when it is full.
    """

    def __init__(self, path: str, max_memo: int = 400_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.path, self.tokenizer = path, Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.max_memo = max_memo
        #: Ids of tokens that begin with a space or line feed, where the vocabulary writes them into its tokens.
        self.leads = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.leads[[i for t, i in vocabulary.items() if t[0] in "\u0120\u010a"]] = True
        same = lambda a, b: self.tokenizer.encode(a).ids == self.tokenizer.encode(b).ids
        if same(" a", "a"):
            self.leads[:] = False
        #: Whether white space only parts words, so that what leads a word makes no difference.
        self.bare = not self.leads.any() and all(same(x + "a", "a") and same("a" + x, "a") for x in (" ", "\n", " \n"))
        #: Ids of tokens that end a run of letters, where the vocabulary marks word ends instead.
        self.ends = np.zeros(len(self.leads), bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        part = self.tokenizer.encode(_PART, add_special_tokens=False).ids
        #: The id of a word that parts others, in a vocabulary without leads.
        self.part = part[0] if self.bare and self.ends.any() and len(part) == 1 else None
        self.forget()

    @functools.cached_property
    def digest(self) -> str:
        """SHA-256 of the tokenizer's file."""
        with open(self.path, "rb") as f:
            return hashlib.file_digest(f, "sha256").hexdigest()

    def forget(self) -> None:
        self.memo: dict[str, bytes] = {}
        self.often = pa.array([], pa.large_string())
        self.often_ids: list[bytes] = []
        self.next_often: dict[str, bytes] = {}
        self.flat, self.size = np.zeros(0, self.dtype), np.zeros(0, np.int64)

    def _whole(self, texts: list[str]) -> list[bytes]:
        if not texts:
            return []
        done = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, self.dtype).tobytes() for x in done]

    def _pieces(self, pieces: list[str], lettered: bool, most: int = 200) -> list[bytes]:
        """Ids of words, joined, encoded many at once and parted: before the tokens that begin with white space, with
        which each word begins; behind the tokens that end a run of letters, if lettered, of which each word is one; or
        else at a word of one token that is put between them and that no word may contain."""
        parts = [pieces[at : at + most] for at in range(0, len(pieces), most)]
        leads = bool(self.leads.any())
        if leads:
            joined = ["".join([k if k[0] == "\n" else " " + k for k in part]) for part in parts]
        else:
            joined = [(" " if lettered else f" {_PART} ").join(part) for part in parts]
        out, size = [], self.dtype.itemsize
        for part, done in zip(parts, self.tokenizer.encode_batch_fast(joined, add_special_tokens=False), strict=True):
            ids = np.array(done.ids, self.dtype)
            if leads:
                first = np.flatnonzero(self.leads[ids])
                last = np.append(first[1:], len(ids))
            elif lettered:
                last = np.flatnonzero(self.ends[ids]) + 1
                first = np.append(0, last[:-1])
            else:
                last = np.append(np.flatnonzero(ids == self.part), len(ids))
                first = np.append(0, last[:-1] + 1)
            if len(first) != len(part) or first[0] or last[-1] != len(ids):  # not parted as they were joined
                out += self._whole([" " + k if leads and k[0] != "\n" else k for k in part])
                continue
            raw = ids.tobytes()
            out += [raw[a:b] for a, b in zip((first * size).tolist(), (last * size).tolist(), strict=True)]
        return out

    @staticmethod
    def _cut(text: str) -> list[str]:
        """Pieces as memo keys: one that isn't led by a single space or line feed is marked by a zero character."""
        pieces = _PIECE.findall(text)
        return [p[1:] if p[0] == " " and len(p) > 1 and p[1] not in " \n" else p if p[0] == "\n" and len(p) > 1 and p[1] not in " \n" else "\0" + p for p in pieces]

    def _ids(self, keys: list[str]) -> tuple[list[bytes], list[bool]]:
        """Ids of distinct keys, and which of them the memo had. A key is "\0" + a piece, a piece led by a line feed, or
        a piece without the one space that leads it."""
        found = list(map(self.memo.get, keys))
        new = [k for k, v in zip(keys, found, strict=True) if v is None]
        lettered, joint, alone = [], [], []
        if self.leads.any():
            joint = [k for k in new if k[0] != "\0"]
            alone = [k for k in new if k[0] == "\0"]
        elif self.part is None:
            alone = new
        else:
            for k in new:
                (lettered if k.isalpha() and (k.isascii() or max(k) < "\u0100") else alone if not k or k[0] == "\0" or _PART in k else joint).append(k)
        made = dict(zip(alone, self._whole([k.removeprefix("\0") for k in alone]), strict=True))
        made.update(zip(joint, self._pieces(joint, False), strict=True))
        made.update(zip(lettered, self._pieces(lettered, True), strict=True))
        known = [v is not None for v in found]
        if made:
            found = [made[k] if v is None else v for k, v in zip(keys, found, strict=True)]
            if len(self.memo) + len(made) > self.max_memo * 3 // 4:
                self.memo.clear()
            self.memo.update(made)
        return found, known

    def _remember(self, keys: list[str], ids: list[bytes], again: np.ndarray) -> None:
        """Puts the keys that were met again into the tables, many at a time."""
        room = self.max_memo // 4 - len(self.often_ids) - len(self.next_often)
        for i in np.flatnonzero(again)[: max(room, 0)].tolist():
            if keys[i][:1] != "\0":
                self.next_often[keys[i]] = ids[i]
        if len(self.next_often) > max(1000, len(self.often_ids) // 4):
            self.often = pa.concat_arrays([self.often, pa.array(list(self.next_often), pa.large_string())])
            self.often_ids += self.next_often.values()
            self.flat = np.frombuffer(b"".join(self.often_ids), self.dtype)
            self.size = np.fromiter(map(len, self.often_ids), np.int64, len(self.often_ids)) // self.dtype.itemsize
            self.next_often = {}

    def _plain(self, texts: list[str]) -> list[bytes]:
        """Ids of texts without runs of white space (if it only parts words, of any texts)."""
        column = pa.array(texts, pa.large_string())
        if self.bare:
            lists = pc.ascii_split_whitespace(column)
        else:
            lists = pc.split_pattern(pc.replace_substring(column, "\n", " \n"), " ")
        offs, words = lists.offsets.to_numpy(), lists.values
        at = pc.fill_null(pc.index_in(words, value_set=self.often), -1).to_numpy().astype(np.int64)
        if not self.bare:  # no white space leads a text's first piece
            at[offs[:-1]] = -1
        rest = np.flatnonzero(at < 0)
        coded = words.take(pa.array(rest)).dictionary_encode()
        keys, code = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)
        if not self.bare:
            first = np.searchsorted(rest, offs[:-1])
            heads = ["\0" + keys[k] for k in code[first].tolist()]
            place = {k: len(keys) + i for i, k in enumerate(dict.fromkeys(heads))}
            code[first] = [place[k] for k in heads]
            keys += place
        met = np.bincount(code, minlength=len(keys))
        used = np.flatnonzero(met)  # a word that only heads texts is asked for in that form alone
        if len(used) < len(keys):
            code = np.searchsorted(used, code)
            keys, met = [keys[k] for k in used.tolist()], met[used]
        ids, known = self._ids(keys)
        size = np.append(self.size, np.fromiter(map(len, ids), np.int64, len(ids)) // self.dtype.itemsize)
        flat = np.append(self.flat, np.frombuffer(b"".join(ids), self.dtype))
        at[rest] = code + len(self.size)
        n, start = size[at], np.cumsum(size) - size
        upto = np.append(0, np.cumsum(n))
        out = flat[np.repeat(start[at] - upto[:-1], n) + np.arange(upto[-1])]
        self._remember(keys, ids, np.array(known, bool) | (met >= 3))
        ends = upto[offs].tolist()
        return [out[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]

    def encode(self, texts: Iterable[str | None]) -> list[bytes]:
        """The ids of each text as bytes of dtype; a null text has none."""
        texts = [t or "" for t in texts]
        out, plain, whole, cut = [b""] * len(texts), [], [], []
        for i, text in enumerate(texts):
            if _odd(text):
                whole.append(i)
            elif text:
                (plain if self.bare or not _runs(text) else cut).append(i)
        if plain:
            for i, ids in zip(plain, self._plain([texts[i] for i in plain]), strict=True):
                out[i] = ids
        if cut:
            pieces = {i: self._cut(texts[i]) for i in cut}
            keys = list(set().union(*pieces.values()))
            ids_of = dict(zip(keys, self._ids(keys)[0], strict=True))
            for i, keys in pieces.items():
                out[i] = b"".join(map(ids_of.__getitem__, keys))
        for i, ids in zip(whole, self._whole([texts[i] for i in whole]), strict=True):
            out[i] = ids
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str, max_memo: int = 400_000) -> Encoder:
    """This worker's encoder for a tokenizer file. A worker that has remembered more than max_memo words forgets them."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path, max_memo)
    found = _ENCODERS[path]
    if found.max_memo > max_memo and len(found.memo) + len(found.often_ids) > max_memo:
        found.forget()
    found.max_memo = max_memo
    return found
