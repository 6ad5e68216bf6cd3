"""Token ids by the tokenizers library, each distinct word encoded once per worker.

The library's plain call takes about a microsecond a character. Its pipeline (NFC, white space
to one blank, lower case, split by pattern, merges inside a split part) treats every part
alone, so the ids of a text are the ids of its parts in order. Texts are cut at white space,
known chunks are looked up, new ones are split by the pattern, and new parts are encoded by the
library's model. Texts outside Latin-1 take whole
chunks as parts; texts with special token strings or with control characters that Python alone
counts as white space go to the library whole, and so does every text when the vocabulary's
pipeline is not the known one. Tests compare ids with the library's plain call.
"""

from __future__ import annotations

import json
import re
import sys
from array import array
from itertools import compress
from operator import not_

import numpy as np

#: fixed values: the normaliser and split pattern this shortcut is proven for
KNOWN_NORMALIZERS = ["NFC", "Replace", "Lowercase"]
KNOWN_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: the same pattern over lower-case Latin-1
LATIN = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff]+|[0-9\xb2\xb3\xb9\xbc-\xbe]|[^\\sa-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff0-9\xb2\xb3\xb9\xbc-\xbe]+")
#: the byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on
_SELF = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_SIGNS = {b: 256 + i for i, b in enumerate(sorted(set(range(256)) - set(_SELF)))}


class WordEncoder:
    """``encode_many(texts)`` gives one little-endian id buffer per text (``dtype``)."""

    def __init__(self, path: str, chunk_cap: int = 400_000, part_cap: int = 500_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 65536 else "<u4")
        self.special = sorted(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.fast = self._known(spec) and sys.byteorder == "little"
        self.chunks: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.chunk_cap, self.part_cap = chunk_cap, part_cap

    @staticmethod
    def _known(spec: dict) -> bool:
        norm, pre = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
        steps, cuts = norm.get("normalizers", []), pre.get("pretokenizers", [])
        return ([s.get("type") for s in steps] == KNOWN_NORMALIZERS and steps[1].get("pattern") == {"Regex": r"\s+"} and steps[1].get("content") == " "
                and [c.get("type") for c in cuts] == ["Split", "ByteLevel"] and cuts[0].get("pattern") == {"Regex": KNOWN_PATTERN}
                and cuts[0].get("behavior") == "Removed" and cuts[0].get("invert") is True
                and cuts[1].get("add_prefix_space") is False and cuts[1].get("use_regex") is False)

    def plain(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _learn(self, new: set[str]) -> None:
        """Encode split parts by the library's model; they are lower case and normalised."""
        if len(self.parts) + len(new) > self.part_cap:
            self.parts.clear()
        call, parts, code = self.tokenizer.model.tokenize, self.parts, "H" if self.dtype.itemsize == 2 else "I"
        for p in new:
            spelt = p if p.isascii() and p.isprintable() else p.encode().decode("latin-1").translate(BYTE_SIGNS)
            parts[p] = array(code, [t.id for t in call(spelt)]).tobytes()

    def encode_many(self, texts: list[str]) -> list[bytes]:
        if not self.fast:
            return [self.plain(t) for t in texts]
        get = self.chunks.get
        found: list[tuple[list[str], list] | None] = []
        missing: set[str] = set()
        for t in texts:
            if any(c in t for c in "\x1c\x1d\x1e\x1f") or ("<" in t and any(s in t for s in self.special)):
                found.append(None)
                continue
            words = t.split()
            ids = list(map(get, words))
            missing.update(compress(words, map(not_, ids)))
            found.append((words, ids))
        local = self._chunk_ids(missing)
        out = []
        for t, f in zip(texts, found):
            if f is None:
                out.append(self.plain(t))
            elif None in f[1]:
                out.append(b"".join([v or local[c] for c, v in zip(*f)]))
            else:
                out.append(b"".join(f[1]))
        return out

    def _chunk_ids(self, chunks: set[str]) -> dict[str, bytes]:
        """Ids of chunks without white space, from the ids of their split parts."""
        parts, local, cut, new = self.parts, {}, {}, set()
        for c in chunks:
            if not c.isascii():
                try:
                    c.encode("latin-1")
                except UnicodeEncodeError:  # several split parts in one, or none
                    local[c] = self.plain(c)
                    continue
            low = c.lower()
            if low.isalpha():
                mine = (low,)
            elif low[:-1].isalpha() and low[-1] in ",.;:!?":
                mine = (low[:-1], low[-1])
            else:
                mine = LATIN.findall(low)
            cut[c] = mine
            for p in mine:
                if p not in parts:
                    new.add(p)
        if new:
            full = len(parts) + len(new) > self.part_cap
            held = {p: parts[p] for mine in cut.values() for p in mine if p in parts} if full else {}
            self._learn(new)
            parts.update(held)
        room = self.chunk_cap - len(self.chunks)
        for c, mine in cut.items():
            ids = local[c] = parts[mine[0]] if len(mine) == 1 else b"".join([parts[p] for p in mine])
            if room > 0 and new.isdisjoint(mine):  # parts seen before: likely a frequent chunk
                self.chunks[c] = ids
                room -= 1
        return local


_KEPT: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder per worker process; its tables are bounded."""
    if path not in _KEPT:
        _KEPT.clear()
        _KEPT[path] = WordEncoder(path)
    return _KEPT[path]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
