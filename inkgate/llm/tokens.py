"""Token ids of texts, with a public tokenizer file whose path is a parameter."""

from __future__ import annotations

import functools
import json
import os
import re
from collections.abc import Callable, Iterable
from itertools import compress, pairwise
from operator import not_

import numpy as np
import pyarrow as pa

# Pieces remembered by a Python worker: those met last, in two halves.
KNOWN_PIECES = 400_000
# New words that are encoded as one text.
JOINED_WORDS = 200

_SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
# Letters up to another ASCII character, the rest of a word, or a run of white space; the blank
# before a word belongs to it. Words then repeat whatever mark follows them. U+0130 is no such
# letter: its small form ends in a mark that may join the next one.
_PIECE = re.compile(
    r" ?[A-Za-zÀ-ÖØ-öø-įı-ɏ]++(?=[\t-\r -@\[-`{-~]|\Z)"
    f"| ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
)
# A blank and letters: one pre-token each, also where many of them follow each other.
_LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-įı-ɏ]+")
_WORD = re.compile(f" {_LETTERS.pattern}")
# Bytes of UTF-8: white space, other ASCII characters that are neither letters nor digits, ASCII letters,
# and the first of two bytes of a letter from U+00C0 to U+017F; U+0130 as above and two signs are none.
_IS_SPACE = np.isin(np.arange(256), list(b"\t\n\x0b\x0c\r "))
_IS_MARK = np.array([33 <= b < 127 and not chr(b).isalnum() for b in range(256)])
_IS_LETTER = np.array([b < 128 and chr(b).isalpha() for b in range(256)])
_IS_LEAD = np.isin(np.arange(256), list(b"\xc3\xc4\xc5"))
_NO_LETTERS = ((0xC3, 0x97), (0xC3, 0xB7), (0xC4, 0xB0))


def tokenizer_path(name: str) -> str:
    """Place of one of the public tokenizer files on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def vocabulary_size(path: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size()


class Encoder:
    """ids of whole texts by the tokenizers library, without special tokens.

    Texts repeat their words, so each piece is encoded by the library once and remembered. That
    is exact for pre-tokenizers and normalizers that never join characters across the start of a
    piece; for any other kind whole texts are encoded. Strings of special tokens are ordinary text.
    Where white space is dropped, texts are parted as bytes, at ASCII white space and between a
    letter and a mark; only new ones of these lumps are parted into pieces.
    """

    def __init__(self, path: str, known_pieces: int = KNOWN_PIECES):
        self.most = known_pieces
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.bounds = self._bounds()
        described = json.loads(self.tokenizer.to_str())
        keeps = self._keeps_bounds(described["normalizer"])
        self.in_pieces = keeps and self._splits_at_space(described["pre_tokenizer"])
        self.lowers = "Lowercase" in [k["type"] for k in self._kinds(described["normalizer"], "normalizers")]
        self.in_lumps = keeps and self._drops_space(described["pre_tokenizer"])

    @staticmethod
    def _kinds(kind: dict | None, of: str = "pretokenizers") -> list[dict]:
        return [kind, *kind.get(of, [])] if kind else []

    def _splits_at_space(self, kind: dict | None) -> bool:
        whole = any(k["type"] == "ByteLevel" and k["use_regex"] and not k["add_prefix_space"] for k in self._kinds(kind))
        return whole or self._drops_space(kind)

    def _drops_space(self, kind: dict | None) -> bool:
        return any(
            k["type"] == "Split" and k["behavior"] == "Removed" and k["invert"] and r"[^\s" in k["pattern"].get("Regex", "")
            for k in self._kinds(kind)
        )

    @staticmethod
    def _keeps_bounds(kind: dict | None) -> bool:
        """Only normalizers that are known to change nothing across the start of a piece."""
        kinds = kind.get("normalizers", [kind]) if kind else []
        return all(
            k["type"] in ("NFC", "Lowercase")
            or (k["type"] == "Replace" and k["pattern"] == {"Regex": r"\s+"} and k["content"] == " ")
            for k in kinds
        )

    def _ids(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch(texts, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def _bounds(self) -> tuple[np.ndarray, int]:
        """Is an id the first (0) or the last (1) of a piece like ``_WORD``, by how its token is written?"""
        vocabulary = self.tokenizer.get_vocab()
        end = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        out = np.zeros(max(vocabulary.values()) + 1, bool)
        # a blank is the character G with a dot in byte-level vocabularies
        out[[i for token, i in vocabulary.items() if (token.endswith(end) if end else token.startswith("\u0120"))]] = True
        return out, int(bool(end))

    def _ids_of_words(self, words: list[str]) -> list[bytes]:
        """ids of pieces like ``_WORD``: joined, encoded and parted again at the bounds of pieces."""
        groups = [words[at : at + JOINED_WORDS] for at in range(0, len(words), JOINED_WORDS)]
        bound, after = self.bounds
        out = []
        for group, e in zip(groups, self.tokenizer.encode_batch_fast(list(map("".join, groups)), add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            at = np.flatnonzero(bound[ids]) + after
            cuts = (4 * np.append(0, at) if after else 4 * np.append(at, len(ids))).tolist()
            if len(at) == len(group) and cuts[0] == 0 and cuts[-1] == 4 * len(ids):
                whole = ids.tobytes()
                out += [whole[a:b] for a, b in pairwise(cuts)]
            else:
                out += self._ids(group)
        return out

    def _make_room(self) -> None:
        if len(self.known) > self.most // 2:
            self.older, self.known = self.known, {}

    def _new(self, pieces: Iterable[Iterable[str]]) -> set[str]:
        """The pieces that are not remembered; ``known`` holds the others."""
        new = set().union(*pieces).difference(self.known)
        again = {p: self.older[p] for p in new if p in self.older}
        self.known.update(again)
        new.difference_update(again)
        return new

    def _add(self, pieces: list[str], ids_of: Callable[[list[str]], list[bytes]]) -> None:
        for at in range(0, len(pieces), 20_000):
            part = pieces[at : at + 20_000]
            self.known.update(zip(part, ids_of(part), strict=True))

    def _learn(self, pieces: list[list[str]]) -> None:
        """Make ``known`` hold every piece."""
        self._make_room()
        new = self._new(pieces)
        words = list(filter(_WORD.fullmatch, new))
        self._add(words, self._ids_of_words)
        self._add(list(new.difference(words)), self._ids)

    def _learn_lumps(self, lumps: list[str]) -> None:
        """Make ``known`` hold every lump, and the pieces of new ones."""
        self._make_room()
        parted = {lump: _PIECE.findall(lump) for lump in self._new([lumps])}
        new = self._new(parted.values())
        words = list(filter(_LETTERS.fullmatch, new))
        self._add(words, lambda some: self._ids_of_words([f" {w}" for w in some]))
        self._add(list(new.difference(words)), self._ids)
        ids = self.known.__getitem__
        self.known.update({lump: b"".join(map(ids, pieces)) for lump, pieces in parted.items() if len(pieces) > 1})

    def _small(self, text: str) -> str:
        """In small letters where the tokenizer makes them so and no step before that tells them apart:
        not where letters and marks may be put together."""
        if not self.lowers:
            return text
        if not text.isascii():
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                return text
        return text.lower()

    def _ids_by_lumps(self, texts: list[str]) -> list[bytes]:
        """Like ``__call__``. Each different lump of ``texts`` is looked up once."""
        encoded = [self._small(t).encode() for t in texts]
        data = np.frombuffer(b"\n".join([*encoded, b""]), np.uint8)
        inside = ~_IS_SPACE[data]
        letter = _IS_LETTER[data]
        lead = np.flatnonzero(_IS_LEAD[data])
        letter[lead + 1] = True
        for first, second in _NO_LETTERS:
            letter[lead[(data[lead] == first) & (data[lead + 1] == second)] + 1] = False
        begins = inside.copy()
        begins[1:] &= ~inside[:-1] | (_IS_MARK[data[1:]] & letter[:-1])
        offsets = np.append(np.flatnonzero(begins[inside]), np.count_nonzero(inside)).astype(np.int32)
        lumps = pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(data[inside]))
        coded = lumps.dictionary_encode()
        which, different = coded.indices.to_numpy(), coded.dictionary.to_numpy(zero_copy_only=False).tolist()

        ids = list(map(self.known.get, different))
        self._learn_lumps(list(compress(different, map(not_, ids))))
        ids = [self.known[lump] if found is None else found for lump, found in zip(different, ids, strict=True)]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        each = sizes[which]
        ends = np.cumsum(each)
        moved = (np.cumsum(sizes) - sizes)[which] - (ends - each)
        out = np.frombuffer(b"".join(ids), "<u4")[np.repeat(moved, each) + np.arange(each.sum())]
        # lumps, then ids, before the end of each text
        last = np.cumsum([len(t) + 1 for t in encoded], dtype=np.int64) - 1
        cuts = np.append(0, ends)[np.cumsum(begins)[last]].tolist()
        return [out[a:b].tobytes() for a, b in pairwise([0, *cuts])]

    def rest(self) -> None:
        """Give back what a worker need not hold between tasks: the pieces not met lately."""
        self.older = {}

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if not self.in_pieces:
            return self._ids(texts)
        if self.in_lumps:
            return self._ids_by_lumps(texts)
        pieces = [_PIECE.findall(t) for t in texts]
        self._learn(pieces)
        return [b"".join(map(self.known.__getitem__, p)) for p in pieces]


@functools.lru_cache(maxsize=2)
def encoder(path: str, known_pieces: int = KNOWN_PIECES) -> Encoder:
    """The encoder of a Python worker, with what its earlier tasks have learned."""
    return Encoder(path, known_pieces)
