"""Whole-text encoding by public tokenizer files, with a bounded memo of words.

A tokenizer of the tokenizers library first cuts a text into pieces by a pattern and
then encodes each piece by its model, so a piece's ids don't depend on its neighbours.
For files whose pattern is one of two known ones, and texts in Latin script without rare
white space or control characters, the same cut is made here and the library's model is
asked once for each piece that the memo doesn't hold; for the byte-level pattern many texts
are cut and looked up at once, in arrays (_Table). All other files and texts go
through the library's `encode_batch` as they are. Either way the ids are those of
`Tokenizer.encode(text, add_special_tokens=False)`.
"""

from __future__ import annotations

import json
import os
import re
import struct

import numpy as np

#: Texts of these characters only are cut here: ASCII without controls but tab and line
#: ends, Latin-1, Latin Extended-A and -B but the dotted capital I, and common punctuation.
_PLAIN = re.compile("[\t\n\r -~¡-įı-ɏ–—‘’“”…€]*")
#: In ASCII texts, what is left without these bytes must be nothing.
_ASCII = bytes([9, 10, 13, *range(32, 127)])
_LETTER = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
_DIGIT = "0-9²³¹¼½¾"
_SPACE = r"\t\n\r "
_SUFFIX = "'s|'t|'re|'ve|'m|'ll|'d"
_CUT = {
    "byte": re.compile(rf"{_SUFFIX}| ?[{_LETTER}]+| ?[{_DIGIT}]+| ?[^{_SPACE}{_LETTER}{_DIGIT}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"),
    "word": re.compile(rf"{_SUFFIX}|[{_LETTER}]+|[{_DIGIT}]|[^{_SPACE}{_LETTER}{_DIGIT}]+"),
}


def _byte_characters() -> dict[int, str]:
    """The character that byte-level models write for each byte: itself if printable in
    Latin-1, else the next from 256 on."""
    out, free = {}, 256
    for b in range(256):
        if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b:
            out[b] = chr(b)
        else:
            out[b], free = chr(free), free + 1
    return out


_BYTES = _byte_characters()
_PACK = [struct.Struct(f"<{n}I").pack for n in range(24)]


def _kind(spec: dict) -> str | None:
    """Which of the known cuts the file makes."""
    pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
    if spec["model"].get("type") != "BPE" or spec["model"].get("dropout") or spec["model"].get("continuing_subword_prefix"):
        return None
    if norm is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space"):
        return "byte"
    steps = pre.get("pretokenizers") or []
    shape = [s.get("type") for s in steps] == ["Split", "ByteLevel"] and not steps[1].get("use_regex", True) and not steps[1].get("add_prefix_space")
    pattern = shape and steps[0]["pattern"].get("Regex") == _SUFFIX + r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+" and steps[0].get("invert") and steps[0].get("behavior") == "Removed"
    if pattern and [n.get("type") for n in (norm or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]:
        return "word"
    return None


class _Memo(dict):
    """piece -> ids as little-endian uint32 bytes; asks the library's model when it misses.
    There are two generations of at most `most` pieces: one that is asked for again while
    it is old moves up, so frequent pieces outlive rare ones."""

    def __init__(self, model, most: int, longest: int = 48):
        super().__init__()
        self.tokenize, self.most, self.longest, self.old = model.tokenize, most, longest, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            if piece.isascii() and piece[-1] > " ":  # its only blank is the first character
                written = piece.replace(" ", _BYTES[32])
            else:
                written = piece.encode().decode("latin-1").translate(_BYTES)
            tokens = [t.id for t in self.tokenize(written)]
            ids = _PACK[len(tokens)](*tokens) if len(tokens) < len(_PACK) else np.array(tokens, "<u4").tobytes()
            if len(piece) > self.longest:
                return ids
        if len(self) >= self.most:
            self.old = self.copy()
            self.clear()
        self[piece] = ids
        return ids


#: What a byte of UTF-8 is: a letter, a digit, white space, the end of a text, another
#: character, or the rest of a character. Of C2 and C3 the next byte decides (_classes).
_L, _D, _W, _END, _O, _REST = range(6)
_CLASS = np.full(256, _O, np.uint8)
_CLASS[[*range(65, 91), *range(97, 123), *range(0xC3, 0xCA)]] = _L
_CLASS[48:58], _CLASS[[9, 10, 13, 32]], _CLASS[0], _CLASS[0x80:0xC0] = _D, _W, _END, _REST


def _classes(data: np.ndarray) -> np.ndarray:
    """The class of each byte's character, for texts that _PLAIN allows."""
    cls = _CLASS[data]
    if data.max(initial=0) < 0x80:
        return cls
    lead = np.flatnonzero(data == 0xC2)
    second = data[lead + 1]
    cls[lead[np.isin(second, [0xAA, 0xB5, 0xBA])]] = _L
    cls[lead[np.isin(second, [0xB2, 0xB3, 0xB9, 0xBC, 0xBD, 0xBE])]] = _D
    lead = np.flatnonzero(data == 0xC3)
    cls[lead[np.isin(data[lead + 1], [0x97, 0xB7])]] = _O
    for _ in range(2):  # characters of three bytes at most
        rest = np.flatnonzero(cls == _REST)
        cls[rest] = cls[rest - 1]
    return cls


def _piece_starts(data: np.ndarray) -> np.ndarray:
    """Where the pieces of _CUT["byte"] begin in texts that each end with a zero, which is a
    piece of its own."""
    cls = _classes(data)
    start = np.ones(len(data), bool)
    start[1:] = (cls[1:] != cls[:-1]) | (cls[1:] == _END)
    # the last character of white space before another one: a blank goes with what follows
    last = np.flatnonzero((cls[:-1] == _W) & (cls[1:] != _W) & (cls[1:] != _END))
    start[last] = True
    start[last[data[last] == 32] + 1] = False
    # a suffix, where a piece begins with its apostrophe
    at = np.flatnonzero(data == 39)
    at = at[start[at]]
    a = data[at + 1]  # a zero at least
    b = data[np.minimum(at + 2, len(data) - 1)]
    two = ((a == 114) & (b == 101)) | ((a == 118) & (b == 101)) | ((a == 108) & (b == 108))
    one = np.isin(a, np.frombuffer(b"stmd", np.uint8))
    at, end = at[one | two], (at + 2 + two)[one | two]
    start[at + 1] = False
    start[end[cls[end] == _L]] = True
    return np.flatnonzero(start)


class _Table:
    """Pieces of at most 24 bytes, as three integers each, in a table of open addressing that
    is asked for those of many texts at once. What it lacks goes to the library's model, 64
    pieces in a call with a zero byte between them, which no merge of the model takes. It
    begins anew when it holds `most` pieces."""

    PROBES = 6

    def __init__(self, tokenizer, most: int):
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer(tokenizer.model), most
        self.zero = tokenizer.token_to_id(_BYTES[0])
        self.bits = max(8, (2 * most - 1).bit_length())
        self.clear()

    @staticmethod
    def fits(spec: dict) -> bool:
        model = spec["model"]
        merges = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        odd = any(model.get(k) for k in ("ignore_merges", "end_of_word_suffix", "unk_token", "fuse_unk"))
        return not odd and all(c in model["vocab"] for c in _BYTES.values()) and not any(_BYTES[0] in a + b for a, b in merges)

    def clear(self) -> None:
        slots = (1 << self.bits) + self.PROBES
        self.keys, self.code = np.zeros((slots, 3), np.uint64), np.zeros(slots, np.int32)
        # piece 0 is the end of a text and has no ids
        self.begin, self.length, self.ids = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64), np.zeros(1 << 14, np.uint32)
        self.n, self.used, self.held = 1, 0, 0

    def slots(self, keys: np.ndarray) -> np.ndarray:
        h = keys[:, 0] * np.uint64(0x9E3779B97F4A7C15)
        for k in (1, 2):
            h = ((h ^ (h >> np.uint64(29))) + keys[:, k]) * np.uint64(0xD6E8FEB86659FD93)
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def learn(self, pieces: list[bytes]) -> int:
        """The code of the first of these new pieces; the others follow it."""
        groups = [b"\0".join(pieces[i : i + 64] + [b""]).decode("latin-1").translate(_BYTES) for i in range(0, len(pieces), 64)]
        ids = np.concatenate([np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(groups, add_special_tokens=False)])
        ends = np.flatnonzero(ids == self.zero)
        first, size = self.n, self.used + len(ids)
        while size > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while first + len(pieces) > len(self.begin):
            self.begin, self.length = (np.concatenate([x, np.zeros_like(x)]) for x in (self.begin, self.length))
        self.ids[self.used : size] = ids
        begin = np.concatenate([[0], ends[:-1] + 1])
        self.begin[first : first + len(pieces)] = self.used + begin
        self.length[first : first + len(pieces)] = ends - begin
        self.n, self.used = first + len(pieces), size
        return first

    def keep(self, keys: np.ndarray, codes: np.ndarray) -> None:
        """Puts new keys, none twice, in free places; those that find none stay unknown."""
        slot = self.slots(keys)
        for _ in range(self.PROBES):
            free = np.flatnonzero(self.code[slot] == 0)
            _, one = np.unique(slot[free], return_index=True)
            put = free[one]
            self.keys[slot[put]], self.code[slot[put]] = keys[put], codes[put]
            self.held += len(put)
            left = np.ones(len(slot), bool)
            left[put] = False
            keys, codes, slot = keys[left], codes[left], slot[left] + 1

    def find(self, keys: np.ndarray) -> np.ndarray:
        def same(at: np.ndarray, keys: np.ndarray) -> np.ndarray:
            there = self.keys[at]
            return (there[:, 0] == keys[:, 0]) & (there[:, 1] == keys[:, 1]) & (there[:, 2] == keys[:, 2])

        slot = self.slots(keys)
        there = self.code[slot]
        code = there * same(slot, keys)
        open_ = np.flatnonzero(code != there)  # a free place ends the search, as none becomes free again
        for k in range(1, self.PROBES):
            if not len(open_):
                break
            at = slot[open_] + k
            there = self.code[at]
            found = there * same(at, keys[open_])
            code[open_] = found
            open_ = open_[found != there]
        return code

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of plain texts in UTF-8."""
        if self.held >= self.most or self.used >= 32 * self.most:
            self.clear()
        whole = b"\0".join(texts) + b"\0"
        padded = whole + bytes(32)
        data = np.frombuffer(whole, np.uint8)
        start = _piece_starts(data)
        size = np.diff(start, append=len(data))
        words = np.ndarray(len(whole) + 24, "<u8", padded, strides=(1,))
        keys = np.empty((len(start), 3), np.uint64)
        for k in range(3):
            keys[:, k] = words[start + 8 * k] & _LOW[np.clip(size - 8 * k, 0, 8)]
        code, ends = self.find(keys), data[start] == 0
        code[size > 24] = 0
        code[ends] = 0
        asked = np.flatnonzero((code == 0) & ~ends)
        if len(asked):
            new: dict[bytes, int] = {}
            places = [new.setdefault(whole[i : i + n], len(new)) for i, n in zip(start[asked].tolist(), size[asked].tolist(), strict=True)]
            code[asked] = self.learn(list(new)) + np.array(places, np.int32)
            _, one = np.unique(places, return_index=True)
            one = asked[one]
            one = one[size[one] <= 24]
            self.keep(keys[one], code[one])
        n = self.length[code]
        stop = np.cumsum(n)
        ids = self.ids[np.repeat(self.begin[code] - (stop - n), n) + np.arange(stop[-1])].astype("<u4").tobytes()
        cuts = [0, *(4 * stop[ends]).tolist()]
        return [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


_LOW = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


class Encoder:
    """encode(texts) gives each text's ids as little-endian uint32 bytes."""

    #: Characters of the texts that go through the table at once; a longer text goes alone,
    #: and one of LONG and more by the memo, as arrays on each of its bytes would be large.
    MANY = 1 << 18
    LONG = 1 << 22

    def __init__(self, path: str, pieces: int = 90_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        spec = json.loads(self.tokenizer.to_str())
        self.kind = _kind(spec)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.memo = _Memo(self.tokenizer.model, pieces)
        self.table = _Table(self.tokenizer, 2 * pieces) if self.kind == "byte" and _Table.fits(spec) else None

    def direct(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        if self.kind is None:
            return self.direct(texts)
        out, cut, get = [], _CUT[self.kind].findall, self.memo.__getitem__
        together: list[tuple[int, bytes]] = []
        size = 0

        def look_up():
            for (k, _), ids in zip(together, self.table.encode([t for _, t in together]), strict=True):
                out[k] = ids

        for text in texts:
            plain = not text.encode().translate(None, _ASCII) if text.isascii() else _PLAIN.fullmatch(text)
            plain = plain and not any(s in text for s in self.special)
            if plain and self.table and len(text) < self.LONG:
                if size + len(text) > self.MANY and together:
                    look_up()
                    together, size = [], 0
                together.append((len(out), text.encode()))
                out.append(b"")
                size += len(text)
            elif plain:
                out.append(b"".join(map(get, cut(text if self.kind == "byte" else text.lower()))))
            else:
                out += self.direct([text])
        if together:
            look_up()
        return out


_encoders: dict[tuple[str, int, int], Encoder] = {}


def encoder(path: str, pieces: int = 90_000) -> Encoder:
    """The worker's encoder for this file and size of memo, loaded once a process."""
    if (key := (path, pieces, os.getpid())) not in _encoders:
        _encoders[key] = Encoder(path, pieces)
    return _encoders[key]


def encoded(batches, path: str, id_column: str = "doc_id", text_column: str = "text", pieces: int = 90_000):
    """From Arrow batches: (doc_id, ids as bytes) of each row in order. Null text is empty.
    The memo has twice `pieces` pieces at most, of about 200 bytes each (100 in a table)."""
    enc = encoder(path, pieces)
    for batch in batches:
        for at in range(0, batch.num_rows, 128):
            part = batch.slice(at, 128)
            texts = [text or "" for text in part.column(text_column).to_pylist()]
            yield from zip(part.column(id_column).to_pylist(), enc.encode(texts), strict=True)
