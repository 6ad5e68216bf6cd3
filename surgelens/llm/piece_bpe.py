"""SentencePiece merge-type (BPE) encoding by backtracking, and decoding.

A piece sequence is the merge result exactly if each pair of neighbours, merged alone, gives
that pair again. So the encoder walks over a text with the longest piece first (all pieces
found by an Aho-Corasick automaton), checks the new piece against the one before by re-merging the
pair (kept in a bounded table), takes the next shorter piece where that fails, and steps back
where none fits; a bitfield marks positions that failed, so none is tried twice and the work is
linear. Characters outside the vocabulary become byte pieces.

Texts are first cut where no piece of the vocabulary could span, and each distinct unit is
encoded once per worker (bounded table). Decoding puts piece texts and bytes together and drops
the blank that encoding had added in front.

Rows: null text counts as empty and gives no ids; null doc_id stays null; repeated rows are encoded
each; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from surgelens.llm.common import schema, text_rows, text_slices

BLANK = "▁"
#: Latin-1 signs other than letters and general punctuation: runs of them and runs of all else are units, each with the blanks before
SIGNS = "\x00-@\\[-`{-\xa9\xab-\xb4\xb6-\xb9\xbb-\xbf\xd7\xf7\\u2010-\\u206f"
UNIT = re.compile(f"{BLANK}*(?:[^{SIGNS}{BLANK}]+|[{SIGNS}]+)|{BLANK}+")
SIGN = re.compile(f"[{SIGNS}]")


class PieceCodec:
    def __init__(self, path: str, unit_cap: int = 300_000, pair_cap: int = 400_000):
        import ahocorasick
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        if model.trainer_spec.model_type != model.trainer_spec.BPE:
            raise ValueError("not a merge-type model")
        norm = model.normalizer_spec
        self.prefix, self.plain = norm.add_dummy_prefix, not norm.precompiled_charsmap and norm.escape_whitespaces and not norm.remove_extra_whitespaces and not model.trainer_spec.treat_whitespace_as_suffix
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        kinds = sentencepiece_model_pb2.ModelProto.SentencePiece
        self.ids, self.score, self.text, self.byte, self.unknown = {}, {}, [], {}, 0
        for i, p in enumerate(model.pieces):
            self.text.append(b"")
            if p.type == kinds.BYTE:
                self.byte[int(p.piece[3:5], 16)] = i
                self.text[i] = bytes([int(p.piece[3:5], 16)])
            elif p.type == kinds.UNKNOWN:
                self.unknown, self.text[i] = i, " ⁇ ".encode()
            elif p.type in (kinds.UNUSED, kinds.USER_DEFINED):
                raise ValueError("unused and user-defined pieces are not supported")
            elif p.type == kinds.NORMAL:
                self.ids[p.piece], self.score[p.piece] = i, p.score
                self.text[i] = p.piece.replace(BLANK, " ").encode()
        self.found = ahocorasick.Automaton()
        for piece in self.ids:
            self.found.add_word(piece, len(piece))
        self.found.make_automaton()
        self.cuts = self._can_cut()
        self.pairs: dict[tuple[str, str], bool] = {}
        self.units: dict[str, tuple[bytes, bytes]] = {}
        self.unit_cap, self.pair_cap = unit_cap, pair_cap

    def _can_cut(self) -> bool:
        """No piece spans two units: none has a blank after another character, or a sign beside a character that is none."""
        for p in self.ids:
            inner = p.lstrip(BLANK)
            if BLANK in inner or len({bool(SIGN.match(c)) for c in inner}) > 1:
                return False
        return True

    def merged(self, text: str) -> list[str]:
        """The plain merge procedure: best score first, leftmost among equals."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fits(self, a: str, b: str) -> bool:
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) >= self.pair_cap:
                self.pairs.clear()
            known = self.pairs[a, b] = self.merged(a + b) == ([a, b] if a else [b])
        return known

    def split(self, unit: str) -> list[str]:
        """The pieces of one unit, by backtracking."""
        if unit in self.ids and self.fits("", unit):
            return [unit]
        n = len(unit)
        ends: list[list[int]] = [[] for _ in range(n)]  # ends of the pieces that start here, ascending
        for last, size in self.found.iter(unit):
            ends[last + 1 - size].append(last + 1)
        failed, stack, at, k, fits, pairs = bytearray(n // 8 + 1), [], 0, None, self.fits, self.pairs
        while at < n:
            here = ends[at]
            if not here or here[0] != at + 1:
                here.insert(0, at + 1)  # a sign outside the vocabulary
            if k is None:
                k = len(here) - 1
            before = stack[-1][2] if stack else ""
            while k >= 0:
                end = here[k]
                if not failed[end >> 3] >> (end & 7) & 1:
                    piece = unit[at:end]
                    ok = pairs.get((before, piece))
                    if ok or ok is None and fits(before, piece):
                        break
                k -= 1
            if k >= 0:
                stack.append((at, k, piece))
                at, k = end, None
            else:
                if not stack:
                    raise ValueError("no encoding")
                failed[at >> 3] |= 1 << (at & 7)
                at, k, _ = stack.pop()
                k -= 1
        return [s[2] for s in stack]

    def encode_unit(self, unit: str) -> list[int]:
        out: list[int] = []
        for piece in self.split(unit):
            i = self.ids.get(piece)
            if i is not None:
                out.append(i)
            elif self.byte:
                out.extend(self.byte[b] for b in piece.encode())
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
        return out

    def escaped(self, text: str) -> str:
        if not self.plain:
            return self.library.normalize(text)
        return (BLANK if self.prefix and text else "") + text.replace(" ", BLANK)

    def cut(self, text: str) -> list[str]:
        s = self.escaped(text)
        return UNIT.findall(s) if self.cuts else [s] if s else []

    def encode(self, text: str) -> list[int]:
        return [i for u in self.cut(text) for i in self.encode_unit(u)]

    def joined(self, ids: list[int]) -> bytes:
        return b"".join([self.text[i] for i in ids])

    def decode(self, ids: list[int]) -> str:
        return self._trimmed(self.joined(ids)).decode("utf-8", "replace")

    def _trimmed(self, raw: bytes) -> bytes:
        return raw[1:] if self.prefix and raw[:1] == b" " else raw

    def digest(self, text: str) -> tuple[int, str, str]:
        """(ids, sha256 of the ids joined by commas, sha256 of the decoded text)."""
        units = self.cut(text)
        got = list(map(self.units.get, units))
        if None in got:
            for i, v in enumerate(got):
                if v is None:
                    ids = self.encode_unit(units[i])
                    got[i] = v = self.units.get(units[i]) or (",".join(map(str, ids)).encode(), self.joined(ids))
                    if len(self.units) < self.unit_cap:
                        self.units[units[i]] = v
        ids = b",".join([v[0] for v in got])
        raw = self._trimmed(b"".join([v[1] for v in got]))
        return ids.count(b",") + 1 if got else 0, hashlib.sha256(ids).hexdigest(), hashlib.sha256(raw.decode("utf-8", "replace").encode()).hexdigest()


_KEPT: dict[str, PieceCodec] = {}


def codec(path: str) -> PieceCodec:
    if path not in _KEPT:
        _KEPT.clear()
        _KEPT[path] = PieceCodec(path)
    return _KEPT[path]


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encoded(docs: DataFrame, model: str | None = None) -> DataFrame:
    """(doc_id, ids array, decoded) of every text: the operator's full output."""
    model = model or default_model()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        c = codec(model)
        for some in text_slices(batches):
            ids = [c.encode(t) for t in some.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([some.column("doc_id"), pa.array(ids, pa.list_(pa.int32())), pa.array([c.decode(i) for i in ids])], ["doc_id", "ids", "decoded"])

    return text_rows(docs).mapInArrow(run, schema("doc_id long, ids array<int>, decoded string"))


def op7(docs: DataFrame, model: str | None = None) -> DataFrame:
    model = model or default_model()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        c = codec(model)
        for some in text_slices(batches):
            n, ids, raw = zip(*map(c.digest, some.column("text").to_pylist()))
            yield pa.RecordBatch.from_arrays([some.column("doc_id"), pa.array(np.array(n, np.int64)), pa.array(ids), pa.array(raw)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return text_rows(docs).mapInArrow(run, schema("doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"))
