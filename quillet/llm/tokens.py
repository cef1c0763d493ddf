"""Token ids of many whole texts, by the tokenizers library, encoding each distinct piece once.

Both vocabularies here split a text into pieces before they merge. For texts of usual characters (KINDS) the
pieces are found for whole batches at once, as byte offsets; the distinct ones are looked up among those that
an encoder remembers, and the library's model merges the rest. Texts with other characters, or with a string of
an added token, go whole through the library's own pipeline. What an encoder remembers is bounded by MEMO
pieces, held as flat arrays of about 30 bytes a piece.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are cut in pieces together; pieces that an encoder remembers before it starts anew.
CHUNK, MEMO = 1 << 20, 700_000
_held: dict[tuple[str, str], "Encoder"] = {}
# The usual characters, the endings that both files cut off, and the pieces that the files define.
USUAL = "\t\n\r -~¡-±´-¸º»¿-ɏ‐-‧‰-⁞₠-₿"
ENDINGS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
PIECES = {
    "byte": re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"),
    "word": re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+"),
}
#: Kinds of characters: white space, letters, digits, others.
SPACE, LETTER, DIGIT, OTHER = range(4)
_kinds: list[np.ndarray] = []


def usual() -> list[str]:
    """The usual characters, each with a lower case that is usual too and that Arrow and Python agree on."""
    found = [c for c in map(chr, range(0x2100)) if re.fullmatch(f"[{USUAL}]", c)]
    lows = pc.utf8_lower(pa.array(found)).to_pylist()
    return [c for c, low in zip(found, lows) if low == c.lower() and re.fullmatch(f"[{USUAL}]", low)]


def _table() -> np.ndarray:
    """The kind of a character by its first two bytes (a plain one by its byte alone)."""
    if not _kinds:
        table = np.full(1 << 16, OTHER, np.uint8)
        for c in usual():
            b = c.encode()
            kind = SPACE if c.isspace() else DIGIT if re.fullmatch(r"\d", c) else LETTER if re.fullmatch(r"[^\W\d_]", c) else OTHER
            table[b[0] if len(b) == 1 else b[0] << 8 | b[1]] = kind
        _kinds.append(table)
    return _kinds[0]


def _byte_names() -> dict[int, str]:
    """How byte-level vocabularies write bytes: printable ones as they are, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def kinds_of(data: np.ndarray) -> np.ndarray:
    """The kind of each byte's character."""
    table = _table()
    kind = table[data]
    lead = np.flatnonzero(data >= 0xC2)
    if len(lead):
        of = table[data[lead].astype(np.uint16) << 8 | data[lead + 1]]
        kind[lead] = kind[lead + 1] = of
        three = data[lead] >= 0xE0
        kind[lead[three] + 2] = of[three]
    return kind


def begins(data: np.ndarray, starts: np.ndarray, style: str) -> np.ndarray:
    """Where pieces begin in documents laid end to end (starts: where each non-empty one begins). Pieces tile the bytes."""
    n, kind = len(data), kinds_of(data)
    edge = np.zeros(n + 1, bool)  # a document begins here, or all end
    edge[starts] = edge[n] = True
    char = (data & 0xC0) != 0x80  # the first byte of a character
    cut = np.zeros(n, bool)
    white = kind == SPACE
    changes = kind[1:] != kind[:-1]
    if style == "byte":
        # a blank belongs to what follows it; of several white characters before something, the last stands apart
        cut[1:] = (changes & ~((data[:-1] == 32) & ~white[1:])) | (white[1:] & white[:-1] & ~np.concatenate([white[2:], [True]]) & ~edge[2 : n + 1])
    else:
        cut[1:] = changes | ((kind[1:] == DIGIT) & char[1:])
    cut |= edge[:n]
    marks = np.flatnonzero((data == 39) & cut)
    if len(marks):
        docs_end = np.append(starts[1:], n)[np.searchsorted(starts, marks, side="right") - 1]
        for ending in ENDINGS:
            more = np.frombuffer(ending[1:].encode(), np.uint8)
            at = marks[marks + len(ending) <= docs_end]
            for i, b in enumerate(more, 1):
                at = at[data[at + i] == b]
            cut[at + 1] = False
            after = at + len(ending)
            cut[after[after < n]] = True
            marks = np.setdiff1d(marks, at, assume_unique=True)
            docs_end = np.append(starts[1:], n)[np.searchsorted(starts, marks, side="right") - 1]
    return np.flatnonzero(cut)


class Encoder:
    """ids(texts) -> uint32 arrays; style `byte` (byte-level, blanks kept) or `word` (word ends, blanks dropped)."""

    def __init__(self, path: str, style: str):
        from tokenizers import Tokenizer

        self.tool = Tokenizer.from_file(path)
        self.added = [t.content.lower() for t in self.tool.get_added_tokens_decoder().values()]
        self.model, self.names, self.style = self.tool.model, _byte_names(), style
        self.blanks = {self.names[b] for b in b" \t\n\r"}
        self.odd = "[^" + "".join(re.escape(c) if c in "\\]^-[" else c for c in usual()) + "]"
        self._forget()

    def _forget(self) -> None:
        self.words, self.flat, self.ends = pa.array([], pa.binary()), np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _merged(self, pieces: pa.Array) -> list[list[int]]:
        """The ids of each piece, by the library's model; white space counts nothing in style `word`."""
        ends = pc.cumulative_sum(pc.binary_length(pieces)).to_pylist()
        written = b"".join(pieces.to_pylist()).decode("latin-1").translate(self.names)
        tokenize, blank = self.model.tokenize, self.style == "word"
        return [[] if blank and written[a] in self.blanks else [t.id for t in tokenize(written[a:b])] for a, b in zip([0, *ends], ends)]

    def _places(self, pieces: pa.Array) -> np.ndarray:
        """Where distinct pieces stand among the remembered ones; new ones are learned first."""
        at = pc.index_in(pieces, value_set=self.words)
        if at.null_count and len(self.words) and len(self.words) + at.null_count > MEMO:
            self._forget()
            return self._places(pieces)
        if not at.null_count:
            return at.to_numpy()
        new = pieces.filter(at.is_null())
        found = self._merged(new)
        place = at.fill_null(-1).to_numpy().copy()
        place[place < 0] = len(self.words) + np.arange(len(new))
        self.flat = np.concatenate([self.flat, np.array([i for f in found for i in f], np.uint32)])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum([len(f) for f in found])])
        self.words = pa.concat_arrays([self.words, new])
        return place

    def _together(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of non-empty texts of usual characters (in lower case for style `word`)."""
        body = b"".join(texts)
        starts = np.cumsum([0] + [len(t) for t in texts])[:-1]
        begin = begins(np.frombuffer(body, np.uint8), starts, self.style)
        offsets = np.append(begin, len(body)).astype(np.int32)
        coded = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(body)]).dictionary_encode()
        place = self._places(coded.dictionary)[coded.indices.to_numpy()]
        first, n = self.ends[place], self.ends[place + 1] - self.ends[place]
        stop = np.cumsum(n)
        ids = self.flat[np.repeat(first - (stop - n), n) + np.arange(stop[-1])]
        heads = np.searchsorted(begin, starts)
        return np.split(ids, (stop - n)[heads][1:])

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tool.encode(text, add_special_tokens=False).ids, np.uint32)

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(texts)
        if not texts:
            return out
        column = pa.array([t.encode("utf-8", "surrogatepass") for t in texts], pa.large_binary()).cast(pa.large_string(), safe=False)
        strange = pc.match_substring_regex(column, self.odd)
        low = pc.ascii_lower(column)
        for token in self.added:
            strange = pc.or_(strange, pc.match_substring(low, token))
        plain = (pc.utf8_lower(column) if self.style == "word" else column).cast(pa.large_binary()).to_pylist()
        held: list[int] = []
        size = 0

        def flush():
            for i, found in zip(held, self._together([plain[i] for i in held])):
                out[i] = found

        for i, aside in enumerate(strange.to_pylist()):
            if aside:
                out[i] = self._whole(texts[i])
            elif plain[i]:
                if held and size + len(plain[i]) > CHUNK:
                    flush()
                    held, size = [], 0
                held.append(i)
                size += len(plain[i])
        if held:
            flush()
        return out


def encoder(path: str, style: str) -> Encoder:
    """One encoder for each Python worker, kept from task to task."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    os.environ.setdefault("RAYON_NUM_THREADS", "1")
    if (path, style) not in _held:
        _held[path, style] = Encoder(path, style)
    return _held[path, style]
