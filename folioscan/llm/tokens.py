"""Encoding whole texts with public tokenizers, a table of known chunks in front.

Byte-level pre-tokenisation cuts a text by PATTERN, and what it cuts does not
depend on what stands further away. So texts are cut, in numpy over their
bytes, at places where the pattern always cuts: around white space, and between
letters, digits and other characters where the class of both is plain from the
bytes (after an apostrophe nothing is cut, as contractions start there). Each
distinct chunk is encoded once by the library and stays in a table under its
own bytes; a text's ids are its chunks' ids in order, gathered by index.
"""
from __future__ import annotations

import json
import os
from collections.abc import Callable

import numpy as np

from .common import KEPT

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # executors' cores are Spark's

#: The pre-tokenisation that the cuts below are right for.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_LETTER, _DIGIT, _OTHER, _QUOTE, _BLANK, _SPACE, _HIGH, _REST = range(8)  # _BLANK: white space but the space; _REST: its further bytes
#: Lead bytes of two-byte characters that are all letters (U+00C0 to U+027F but two signs, U+0400 to U+047F).
_LEADS = (*range(0xC3, 0xCA), 0xD0, 0xD1)
_SIGNS = (0x97, 0xB7)  # after 0xC3: the multiplication and the division sign
#: Longest chunk that is its own key, in bytes; the last byte of three words holds the length.
_SHORT = 23
#: New chunks that the library encodes as one text; longer texts take it more time a chunk.
JOINED = 64


def _classes() -> np.ndarray:
    kind = np.full(256, _OTHER, "u1")
    kind[[*range(65, 91), *range(97, 123)]] = _LETTER
    kind[48:58] = _DIGIT
    kind[39] = _QUOTE
    kind[9:14] = _BLANK
    kind[32] = _SPACE
    kind[128:] = _HIGH
    return kind


_CLASS = _classes()
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], "u8")


def _kinds(raw: np.ndarray) -> np.ndarray:
    """The class of every byte; raw ends with padding."""
    kind = _CLASS[raw]
    if not (high := raw >= 0x80).any():
        return kind
    at = np.flatnonzero(high)
    lead = raw[at]
    two = at[np.isin(lead, _LEADS)]
    two = two[~((raw[two] == 0xC3) & np.isin(raw[two + 1], _SIGNS))]
    kind[two] = kind[two + 1] = _LETTER
    # white space beyond ASCII: U+0085, U+00A0; U+1680, U+2000 to U+200A, U+2028, U+2029, U+202F, U+205F, U+3000
    pairs = at[lead == 0xC2]
    pairs = pairs[np.isin(raw[pairs + 1], (0x85, 0xA0))]
    kind[pairs], kind[pairs + 1] = _BLANK, _REST
    if len(three := at[(lead >= 0xE1) & (lead <= 0xE3)]):
        code = (raw[three].astype("u4") & 15) << 12 | (raw[three + 1].astype("u4") & 63) << 6 | raw[three + 2] & 63
        blank = ((code >= 0x2000) & (code <= 0x200A)) | np.isin(code, (0x1680, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))
        three = three[blank]
        kind[three], kind[three + 1], kind[three + 2] = _BLANK, _REST, _REST
    return kind


def chunk_starts(raw: np.ndarray, begins: np.ndarray, n: int) -> np.ndarray:
    """Where chunks start among the first n bytes: texts start at ``begins``; raw has padding after n."""
    kind = _kinds(raw)[:n]
    start = np.zeros(n + 1, bool)
    plain = kind <= _QUOTE
    group = np.minimum(kind, _OTHER)
    start[1:n] = plain[1:] & plain[:-1] & (group[1:] != group[:-1]) & (kind[:-1] != _QUOTE)
    blank = (kind == _BLANK) | (kind == _SPACE) | (kind == _REST)
    # a run of white space goes up to a text's end or to what follows it
    first = np.zeros(n + 1, bool)
    first[begins] = True
    run = np.flatnonzero(blank)
    if len(run):
        opens = np.ones(len(run), bool)
        opens[1:] = (run[1:] != run[:-1] + 1) | first[run[1:]]
        start[run[opens]] = True
        closes = np.ones(len(run), bool)
        closes[:-1] = opens[1:]
        last = run[closes]
        last = last[~first[last + 1] & (last + 1 < n)]  # something follows in its text
        after = last[kind[last] != _SPACE]
        start[after + 1] = True
        while len(back := np.flatnonzero(kind[last] == _REST)):
            last[back] -= 1
        start[last] = True
    start |= first
    return np.flatnonzero(start[:n])


class ChunkEncoder:
    """texts -> ids of each, as little-endian unsigned 32-bit integers.

    ``learn`` maps a list of chunks to (all their ids in order, how many each
    has). At most about ``limit`` chunks are known at a time; when there are
    more, those that were used least are forgotten. So memory is bounded by
    ``limit`` and the longest text.
    """

    def __init__(self, learn: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], limit: int = 400_000, batch: int = 1 << 20):
        self.learn, self.limit, self.batch = learn, limit, batch
        self.bits = max(10, (2 * limit).bit_length())
        self.slots = np.full(1 << self.bits, -1, "i4")
        self.size = self.filled = 0
        self.keys = np.empty((3, 1024), "u8")
        self.hash = np.empty(1024, "u8")
        self.at, self.count, self.uses = np.empty(1024, "i8"), np.empty(1024, "i4"), np.empty(1024, "u4")
        self.pool = np.empty(4096, "u4")
        self.far: dict[bytes, int] = {}  # chunks of more than _SHORT bytes

    def _append(self, keys: np.ndarray, hashes: np.ndarray, chunks: list[bytes]) -> np.ndarray:
        """New entries for the chunks; their numbers."""
        ids, counts = self.learn(chunks)
        n, end = len(chunks), self.filled + len(ids)
        if self.size + n > len(self.hash):
            more = max(1024, len(self.hash), n)
            self.keys = np.concatenate([self.keys, np.empty((3, more), "u8")], 1)
            self.hash, self.at, self.count, self.uses = (np.concatenate([x, np.empty(more, x.dtype)]) for x in (self.hash, self.at, self.count, self.uses))
        if end > len(self.pool):
            self.pool = np.concatenate([self.pool, np.empty(max(4096, len(self.pool), len(ids)), "u4")])
        own = slice(self.size, self.size + n)
        self.keys[:, own], self.hash[own], self.uses[own] = keys, hashes, 0
        self.at[own], self.count[own] = self.filled + np.cumsum(counts) - counts, counts
        self.pool[self.filled : end] = ids
        self.size, self.filled = self.size + n, end
        return np.arange(own.start, own.stop)

    def _forget(self) -> None:
        """Keep the entries of most uses, no more than half the limit of them; uses count half from then on."""
        keep = np.flatnonzero(self.uses[: self.size] > 1)
        if len(keep) > self.limit // 2:
            keep = np.sort(keep[np.argpartition(-self.uses[keep].astype("i8"), self.limit // 2)[: self.limit // 2]])
        self.uses = self.uses[keep] // 2
        count = self.count[keep]
        where = np.repeat(self.at[keep] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        pool = self.pool[where]
        n = len(keep)
        self.keys, self.hash, self.count = self.keys[:, keep], self.hash[keep], count
        self.at = np.cumsum(count) - count
        self.pool, self.size, self.filled = pool, n, len(pool)
        place = dict(zip(keep.tolist(), range(n), strict=True))
        self.far = {k: place[e] for k, e in self.far.items() if e in place}
        short = self.keys[2] != 0
        self.slots[:] = -1
        self.slots[self.hash[short] >> np.uint64(64 - self.bits)] = np.flatnonzero(short)

    def _entries(self, data: bytes, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The entry of every chunk."""
        size = ends - starts
        words = np.ndarray((len(raw) - 7,), "<u8", data, 0, (1,))  # eight bytes from any place
        key = np.empty((3, len(starts)), "u8")
        for j in range(3):
            key[j] = words[starts + 8 * j] & _MASKS[np.clip(size - 8 * j, 0, 8)]
        key[2] |= size.astype("u8") << np.uint64(56)
        h = key[0] * np.uint64(0x9E3779B97F4A7C15) ^ (key[1] + np.uint64(0x632BE59BD9B4E019)) * np.uint64(0xD6E8FEB86659FD93) ^ key[2] * np.uint64(0xA0761D6478BD642F)
        h = (h ^ h >> np.uint64(32)) * np.uint64(0xE7037ED1A0B428DB)
        short = size <= _SHORT
        found = self.slots[h >> np.uint64(64 - self.bits)].astype("i8")
        known = (found >= 0) & short
        for j in range(3):
            known &= self.keys[j][np.maximum(found, 0)] == key[j]
        rest = np.flatnonzero(~known & short)
        while len(rest):  # a second round only if hashes collide
            _, first, inverse = np.unique(h[rest], return_index=True, return_inverse=True)
            one = rest[first]
            new = self._append(key[:, one], h[one], [data[a:b] for a, b in zip(starts[one].tolist(), ends[one].tolist(), strict=True)])
            self.slots[h[one] >> np.uint64(64 - self.bits)] = new
            found[rest] = new[inverse]
            rest = rest[(self.keys[:, found[rest]] != key[:, rest]).any(0)]
        long = np.flatnonzero(~short)
        if len(long):
            chunks = [data[a:b] for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True)]
            if new := list(set(chunks).difference(self.far)):
                self.far.update(zip(new, self._append(np.zeros((3, len(new)), "u8"), np.zeros(len(new), "u8"), new).tolist(), strict=True))
            found[long] = [self.far[c] for c in chunks]
        return found

    def _some(self, texts: list[bytes]) -> list[bytes]:
        begins = np.cumsum([0, *map(len, texts)])
        n = int(begins[-1])
        data = b"".join([*texts, bytes(40)])
        raw = np.frombuffer(data, "u1")
        starts = chunk_starts(raw, begins, n)
        entry = self._entries(data, raw, starts, np.append(starts[1:], n))
        self.uses[: self.size] += np.bincount(entry, minlength=self.size).astype("u4")
        count = self.count[entry]
        total = np.concatenate([[0], np.cumsum(count)])
        out = self.pool[np.repeat(self.at[entry] - total[:-1], count) + np.arange(total[-1])].tobytes()
        at = (4 * total[np.searchsorted(starts, begins)]).tolist()
        if self.size > self.limit or self.filled > 8 * self.limit:
            self._forget()
        for c in [c for c in self.far if len(c) > 256]:  # not kept, so that memory does not follow the longest chunk
            del self.far[c]
        return [out[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        out: list[bytes] = []
        some: list[bytes] = []
        size = 0
        for t in texts:
            code = (t or "").encode("utf-8", "replace")
            if len(code) > 2 * self.batch:
                out += self._some(some)
                some, size = [], 0
                out.append(b"".join(self._some([part])[0] for part in self._parts(code)))
                continue
            some.append(code)
            size += len(code)
            if size > self.batch:
                out += self._some(some)
                some, size = [], 0
        return out + self._some(some)

    def _parts(self, code: bytes):
        """A very long text in parts, cut before single spaces between ASCII letters."""
        at = 0
        while len(code) - at > 2 * self.batch:
            cut = code.find(b" ", at + self.batch)
            while cut >= 0 and not (code[cut - 1 : cut] + code[cut + 1 : cut + 2]).isalpha():
                cut = code.find(b" ", cut + 1)
            if cut < 0:
                break
            yield code[at:cut]
            at = cut
        yield code[at:]


def byte_characters() -> list[str]:
    """A printable character for each byte, as byte-level vocabularies have them."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


def _cuts_by_pattern(path: str) -> bool:
    """Whether the file's tokenizer takes texts as they are and cuts them by PATTERN, which byte-level ones do."""
    with open(path, encoding="utf-8") as f:
        d = json.load(f)
    pre = d.get("pre_tokenizer") or {}
    return not d.get("normalizer") and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space", True)


def library_encoder(path: str) -> Callable[[list], list[bytes]]:
    """Encoder for a tokenizers file: little-endian unsigned 32-bit ids. One for each worker and file.

    Strings of special tokens in a text are ordinary text.
    """
    if ("library", path) in KEPT:
        return KEPT["library", path]
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    each = lambda texts: [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def plain(texts: list[str | None]) -> list[bytes]:
        return [np.array(ids, "<u4").tobytes() for ids in each([t or "" for t in texts])]

    one_newline = len(each(["\n"])[0]) == 1
    # of byte-level tokens each character is a byte; of added ones, the text is itself
    own = {i: len(t) for t, i in tokenizer.get_vocab(with_added_tokens=False).items()}
    own |= {i: len(t.content.encode()) for i, t in tokenizer.get_added_tokens_decoder().items()}
    width = np.zeros(max(own, default=-1) + 1, "i8")
    width[list(own)] = list(own.values())

    def together(chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids and counts of chunks that do not end in white space, or None if tokens do not add up to their bytes.

        What ends in another character is cut off before white space. So a chunk that starts with a space follows
        the one before as it is, others follow a line feed, which is a pre-token of its own, and many are one text.
        The bytes of tokens tell the chunks' ids apart.
        """
        apart = np.array([c[:1] != b" " for c in chunks])
        apart[::JOINED] = False
        parts = [b"\n" + c if f else c for c, f in zip(chunks, apart.tolist(), strict=True)]
        ids = [i for e in each([b"".join(parts[at : at + JOINED]).decode() for at in range(0, len(parts), JOINED)]) for i in e]
        ids = np.array(ids, "u4")
        last = np.cumsum([len(p) for p in parts])
        upto = np.cumsum(width[ids])
        end = np.searchsorted(upto, last) + 1
        feeds = np.concatenate([[0], end[:-1]])[apart]  # places of line feeds
        if not len(upto) or upto[-1] != last[-1] or (upto[end - 1] != last).any() or (width[ids[feeds]] != 1).any():
            return None
        return np.delete(ids, feeds), np.diff(end, prepend=0) - apart

    def learn(chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        blank = [c.decode()[-1:].isspace() for c in chunks]
        words = [c for c, f in zip(chunks, blank, strict=True) if not f]
        got = together(words) if words else None
        if got and len(words) == len(chunks):
            return got
        parts = iter(np.split(got[0], np.cumsum(got[1])[:-1])) if got else None
        rest = iter(each([c.decode() for c, f in zip(chunks, blank, strict=True) if f or not got]))
        found = [next(rest) if f or not got else next(parts) for f in blank]
        return np.concatenate([np.array(x, "u4") for x in found]), np.array([len(x) for x in found], "i8")

    KEPT["library", path] = ChunkEncoder(learn) if one_newline and _cuts_by_pattern(path) else plain
    return KEPT["library", path]
