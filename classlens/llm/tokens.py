"""Byte-level BPE ids of texts, by public tokenizer files whose paths are parameters."""

from __future__ import annotations

import base64
import re
import unicodedata
from functools import cached_property
from itertools import compress

import numpy as np
import pyarrow as pa

#: Texts of these characters alone are encoded from the vocabulary's ranks, several times faster; classes of all other
#: characters depend on a library's Unicode version, so such texts go to the tokenizer itself. Same ids either way.
_OTHER = re.compile("[^\t\n\r -~¡-ɏ]")
#: What the tokenizer's pattern tells apart: white space, letters, digits and other signs, by code point. The zero
#: character, which no such text holds, ends a text.
_END, _SPACE, _LETTER, _DIGIT, _SIGN = range(5)
_CLASSES = np.zeros(0x250, np.uint8)
for _c in [*map(ord, "\t\n\r"), *range(0x20, 0x7F), *range(0xA1, 0x250)]:
    _kind = {"L": _LETTER, "N": _DIGIT}.get(unicodedata.category(chr(_c))[0], _SIGN)
    _CLASSES[_c] = _SPACE if chr(_c).isspace() else _kind
_BYTES = np.zeros(0x100, np.uint8)
_BYTES[:0x80] = _CLASSES[:0x80]


def _starts(data: np.ndarray) -> np.ndarray:
    """Offsets of the pieces that the tokenizer's pattern cuts out of texts that end with a zero byte each, and the end.

    A zero byte is a piece of its own. A word takes the blank before it along; other white space directly before a word is
    a piece of its own. An apostrophe that starts a piece takes the letters of a contraction along.
    """
    kind = _BYTES[data]
    lead = np.flatnonzero(data >= 0xC0)
    kind[lead] = kind[lead + 1] = _CLASSES[(data[lead].astype(np.int64) & 31) << 6 | data[lead + 1] & 63]
    last = (kind[:-1] == _SPACE) & (kind[1:] > _SPACE)
    start = np.ones(len(data) + 1, bool)
    start[1:-1] = ((kind[1:] != kind[:-1]) & ~(last & (data[:-1] == 32))) | (kind[1:] == _END)
    start[:-2] |= last
    quote = np.flatnonzero((data == 39) & start[:-1])
    one, two = data[quote + 1], data[np.minimum(quote + 2, len(data) - 1)]
    short = quote[np.isin(one, list(b"stmd"))]
    long = quote[((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108)]
    start[short + 1] = start[long + 1] = False
    start[short + 2] = start[long + 3] = True
    return np.flatnonzero(start)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class Encoder:
    """Ids of a text without special tokens; their strings inside a text are ordinary text.

    ``ranks`` is the tokenizer's vocabulary as ranks, or None.
    """

    def __init__(self, path: str, ranks: str | None):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.fast = None
        if ranks:
            import tiktoken
            from public_tokenizers import PATTERN

            with open(ranks, "rb") as lines:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            # The zero character is in none of these texts; without a special token arrays are not given.
            self.fast = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=table, special_tokens={"\0": max(table.values()) + 1})

    def encode(self, text: str) -> list[int]:
        if self.fast is None or _OTHER.search(text):
            return self.tokenizer.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)

    def _plain(self, texts: list[str], end: bytes) -> list[bytes]:
        """Texts are cut all at once, and their distinct pieces are encoded as one text.

        A line feed between two words is a piece of its own, as the pattern cuts, and its id occurs in no word; white space
        is encoded by itself.
        """
        data = np.frombuffer(("\0".join(texts) + "\0").encode(), np.uint8)
        starts = _starts(data)
        parts = [None, pa.py_buffer(starts.astype(np.int64)), pa.py_buffer(data)]
        pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts) - 1, parts).dictionary_encode()
        distinct = pieces.dictionary.to_numpy(zero_copy_only=False).tolist()
        blank = np.array([p.isspace() or p == b"\0" for p in distinct])
        place = np.where(blank, len(blank) - blank.sum() + np.cumsum(blank), np.cumsum(~blank)) - 1
        words = list(compress(distinct, ~blank))
        blanks = [end if p == b"\0" else self._bytes(p.decode()) for p in compress(distinct, blank)]
        feed = np.frombuffer(self._bytes("\n"), self.kind)
        found = np.frombuffer(self._bytes((b"\n".join(words) + b"\n").decode()), self.kind) if words else feed[:0]
        ends = np.flatnonzero(found == feed)
        sizes = [np.diff(ends, prepend=-1) - 1, [len(b) // self.kind.itemsize for b in blanks]]
        offsets = np.cumsum(np.concatenate([[0], *sizes]), dtype=np.int64) * self.kind.itemsize
        parts = [None, pa.py_buffer(offsets), pa.py_buffer(b"".join([found[found != feed].tobytes(), *blanks]))]
        ids = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(place), parts)
        ids = ids.take(pa.array(place[pieces.indices.to_numpy()]))
        ends = np.frombuffer(ids.buffers()[1], np.int64)[1 : len(ids) + 1][data[starts[:-1]] == 0].tolist()
        blob = memoryview(ids.buffers()[2])
        return [bytes(blob[a:b]) for a, b in zip([0, *ends], ends)]

    def encode_all(self, texts: list[str | None], end: int) -> list[bytes]:
        """Ids of each text and ``end``, as numbers of ``kind``; a null text has no ids."""
        last = np.array([end], self.kind).tobytes()
        out = [last if not t else None for t in texts]
        plain = [i for i, t in enumerate(texts) if t and self.fast is not None and not _OTHER.search(t)]
        for i, ids in zip(plain, self._plain([texts[i] for i in plain], last) if plain else ()):
            out[i] = ids
        return [self._bytes(t) + last if x is None else x for x, t in zip(out, texts)]

    def _bytes(self, text: str) -> bytes:
        if self.fast is None or _OTHER.search(text):
            return np.array(self.encode(text), self.kind).tobytes()
        return self.fast.encode_to_numpy(text, disallowed_special=()).astype(self.kind).tobytes()

    @cached_property
    def kind(self) -> np.dtype:
        """The smallest type that holds every id."""
        return np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")


_encoders: dict[tuple, Encoder] = {}


def encoder(path: str, ranks: str | None) -> Encoder:
    if (path, ranks) not in _encoders:
        _encoders[path, ranks] = Encoder(path, ranks)
    return _encoders[path, ranks]
