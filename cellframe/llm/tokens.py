"""Token ids of whole texts by the ``tokenizers`` library, with a cache of the pieces between spaces."""

from __future__ import annotations

import ctypes
import os
import re
from codecs import charmap_decode
from functools import lru_cache
from itertools import compress
from os.path import commonprefix

import numpy as np
import pyarrow as pa


def one_thread() -> None:
    """A task has one core: the library's own threads would share the other tasks' cores and each keep memory."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: ASCII marks but the apostrophe, with which a pre-token may begin.
_MARKS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c != "'")
#: Code points that are white space, and whether a byte is one or ends a longer one.
_WHITE = np.array([chr(c).isspace() for c in range(0x10000)])
_WHITE_END = np.zeros(256, bool)
_WHITE_END[[chr(c).encode()[-1] for c in np.flatnonzero(_WHITE)]] = True

#: Byte-level alphabets write printable Latin-1 characters as they are and the other 68 bytes as U+0100 and on.
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = {b: 256 + i for i, b in enumerate(sorted(set(range(256)) - set(_PLAIN)))}
#: The same as a table of all bytes, in which 1 stays, to part what is joined.
_ALPHABET = "".join(chr(1 if b == 1 else _BYTES.get(b, b)) for b in range(256))


class _Index(dict):
    """Piece -> number; a piece not met before gets the next number and is noted in ``fresh``."""

    def __init__(self, pieces=()):
        super().__init__(zip(pieces, range(len(pieces))))
        self.fresh: list[str] = []

    def __missing__(self, piece: str) -> int:
        self[piece] = n = len(self)
        self.fresh.append(piece)
        return n


def _folded(text: str) -> str:
    """Lower case and spaces for line ends, as the other kind of tokenizer makes them, where case goes character by character."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return text
    return text.lower().replace("\n", " ")


def _cuts(raw: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Where pieces begin in the UTF-8 bytes of texts that begin at ``begins``: there, and at spaces that follow no white space."""
    spaces = np.flatnonzero(raw == 32)
    white = _WHITE_END[raw[spaces - 1]]  # whatever is before the first byte of a text, that byte is a cut
    at = spaces[white]
    b = [raw[np.maximum(at - k, 0)].astype(np.int64) for k in (3, 2, 1)]  # bytes before the first are of no character that ends here
    two, three = b[1] >> 5 == 6, (b[0] >> 4 == 14) & (b[1] >> 6 == 2)
    code = np.where(b[2] < 128, b[2], np.where(two, (b[1] & 31) << 6 | b[2] & 63, np.where(three, (b[0] & 15) << 12 | (b[1] & 63) << 6 | b[2] & 63, 0)))
    white[white] = _WHITE[code]
    cut = np.zeros(len(raw), bool)
    cut[spaces[~white]] = True
    cut[begins] = True
    return np.flatnonzero(cut)


class PieceEncoder:
    """Ids of a text as the concatenation of the ids of its pieces.

    Both supported kinds of tokenizer cut at a space that follows a character other than white space, and no merge
    crosses such a cut, so a piece always has the same ids: ``lead`` kinds keep the space with what follows it, the
    others drop it. Pieces repeat, so most are found in the cache; when it holds ``limit`` pieces, those met only
    once are forgotten, which changes memory and time but no ids. A text that may hold an added token of the vocabulary,
    such as ``<|endoftext|>``, goes through the library whole.
    """

    GROUP = 128

    def __init__(self, path: str, lead: bool, limit: int = 500_000):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import CharDelimiterSplit

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.model = Tokenizer(self.tokenizer.model)
        self.model.pre_tokenizer = CharDelimiterSplit("\x01")
        self.lead, self.limit = lead, limit
        self.index = _Index()
        self.ids, self.starts, self.sizes, self.met = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        self.added = re.compile("|".join(map(re.escape, added)) or r"(?!)", re.I)  # in any case: the library decides
        prefix = commonprefix(added)
        self.prefix = prefix[: next((i for i, c in enumerate(prefix) if c.isalpha()), len(prefix))]  # quick to look for
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.edges = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that begin or end a piece
        self.edges[[i for token, i in vocabulary.items() if (token.startswith("\u0120") if lead else token.endswith("</w>"))]] = True

    def _forget(self) -> None:
        keep = np.flatnonzero(self.met > 1)
        if 2 * len(keep) > self.limit:
            keep = keep[np.argsort(-self.met[keep], kind="stable")[: self.limit // 2]]
        sizes = self.sizes[keep]
        self.ids = self._gather(self.ids, self.starts, self.sizes, keep)
        self.starts, self.sizes, self.met = np.cumsum(sizes) - sizes, sizes, self.met[keep]
        kept = np.zeros(len(self.index), bool)
        kept[keep] = True
        order = np.empty(len(kept), np.int64)
        order[keep] = np.arange(len(keep))
        pieces: list[str] = [""] * len(keep)
        for piece, n in self.index.items():
            if kept[n]:
                pieces[order[n]] = piece
        self.index = _Index(pieces)

    def _sizes(self, ids: np.ndarray, n: int) -> np.ndarray:
        """Numbers of ids of n pieces whose first (lead) or last id is an edge, the only one."""
        edge = np.flatnonzero(self.edges[ids])
        sizes = np.diff(np.concatenate([edge, [len(ids)]])) if self.lead else np.diff(np.concatenate([[-1], edge]))
        if len(sizes) != n:
            raise RuntimeError("pieces and ids do not line up")
        return sizes

    def _coded(self, tokenizer, texts: list[str], at_once: int):
        """Ids of each text; what the library says beside them is large and goes after ``at_once`` texts."""
        for i in range(0, len(texts), at_once):
            for c in tokenizer.encode_batch_fast(texts[i : i + at_once], add_special_tokens=False):
                yield c.ids

    def _many(self, tokenizer, texts: list[str]) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.uint32), *(np.array(ids, np.uint32) for ids in self._coded(tokenizer, texts, 64))])

    def _code(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces and how many each has.

        Words of letters alone are one pre-token, so they go to the library's model in its own alphabet, many at a
        time; other pieces go through the whole tokenizer, together where their ids tell where a piece begins.
        """
        joined, alone = [], []
        if self.lead:
            words = [i for i, p in enumerate(pieces) if p.isalpha()]
            rest = [i for i, p in enumerate(pieces) if not p.isalpha()] if len(words) < len(pieces) else []
        else:
            words, rest = [], []
            for i, p in enumerate(pieces):
                (words if p.isalpha() and (p.isascii() or max(p) < "\u0100") else rest).append(i)
        for i in rest:
            p = pieces[i]
            (joined if self.lead and p and " " not in p and "\u0120" not in p else alone).append(i)
        own = pieces if not rest else [pieces[i] for i in words]
        starts = range(0, len(own), self.GROUP)
        if self.lead:
            texts = [charmap_decode((" " + "\x01 ".join(own[a : a + self.GROUP])).encode(), "strict", _ALPHABET)[0] for a in starts]
        else:
            own = [p if p.isascii() else p.encode().decode("latin-1").translate(_BYTES) for p in map(str.lower, own)]
            texts = ["\x01".join(own[a : a + self.GROUP]) for a in starts]
        ids = [self._many(self.model, texts)]
        sizes = [self._sizes(ids[0], len(words))]
        if joined:
            ids.append(self._many(self.tokenizer, [" " + " ".join(pieces[i] for i in joined[a : a + self.GROUP]) for a in range(0, len(joined), self.GROUP)]))
            sizes.append(self._sizes(ids[-1], len(joined)))
        if alone:
            coded = [np.array(c, np.uint32) for c in self._coded(self.tokenizer, [" " + pieces[i] if self.lead else pieces[i] for i in alone], 4096)]
            ids.append(np.concatenate(coded))
            sizes.append(np.fromiter(map(len, coded), np.int64, len(coded)))
        lengths, flat = np.concatenate(sizes).astype(np.int64), np.concatenate(ids)
        if not joined and not alone:
            return flat, lengths
        order = np.argsort(np.array(words + joined + alone, np.int64))
        return self._gather(flat, np.cumsum(lengths) - lengths, lengths, order), lengths[order]

    @staticmethod
    def _gather(ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray, order: np.ndarray) -> np.ndarray:
        n = sizes[order]
        ends = np.cumsum(n)
        return ids[np.repeat(starts[order] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)]

    def _split(self, piece: str) -> tuple[str, str]:
        """A piece as another piece that it shares its ids with, and closing marks, which are one pre-token."""
        base, mark = piece.rstrip(_MARKS), ""
        if base.isalpha():
            mark = piece[len(base) :]
        else:
            base = piece
        if not self.lead and base.isascii() and base.isalpha():
            base = base.lower()
        return base, mark

    def _learn(self) -> None:
        """Codes the pieces in ``index.fresh``; those made of another piece and a mark take its ids."""
        fresh, known = self.index.fresh, len(self.met)
        at_made, bases, marks = [], [], []
        # most pieces are words; bases not met before join the end of the list
        for i, piece in [(i, p) for i, p in enumerate(fresh) if not p.isalpha()] if self.lead else enumerate(fresh):
            base, mark = self._split(piece)
            if mark or base != piece:
                at_made.append(i)
                bases.append(self.index[base])
                marks.append(mark)
        own = np.ones(len(fresh), bool)
        own[at_made] = False
        at_plain = np.flatnonzero(own)
        plain = list(compress(fresh, own.tolist()))
        starts, sizes = np.empty(len(fresh), np.int64), np.empty(len(fresh), np.int64)
        flat = np.zeros(0, np.uint32)
        if plain:
            flat, n = self._code(plain)
            sizes[at_plain] = n
            starts[at_plain] = len(self.ids) + np.cumsum(n) - n
        self.ids = np.concatenate([self.ids, flat])
        if at_made:
            tails = {m: np.array(self.tokenizer.encode(m, add_special_tokens=False).ids if m else [], np.uint32) for m in set(marks)}
            order = np.array(bases, np.int64)
            old = order < known
            from_, n = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
            from_[old], n[old] = self.starts[order[old]], self.sizes[order[old]]
            from_[~old], n[~old] = starts[order[~old] - known], sizes[order[~old] - known]
            extra = np.fromiter((len(tails[m]) for m in marks), np.int64, len(marks))
            ends = np.cumsum(n + extra)
            out = np.empty(int(ends[-1]), np.uint32)
            out[np.repeat(ends - n - extra - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))] = self._gather(self.ids, from_, n, np.arange(len(n)))
            out[np.repeat(ends - extra - (np.cumsum(extra) - extra), extra) + np.arange(int(extra.sum()))] = np.concatenate([tails[m] for m in marks])
            sizes[at_made] = n + extra
            starts[at_made] = len(self.ids) + ends - n - extra
            self.ids = np.concatenate([self.ids, out])
        self.starts, self.sizes = np.concatenate([self.starts, starts]), np.concatenate([self.sizes, sizes])
        self.met = np.concatenate([self.met, np.zeros(len(fresh), np.int64)])
        self.index.fresh = []

    def _numbers(self, parts: list[str], times: np.ndarray | None = None) -> np.ndarray:
        """Numbers of the pieces; those met ``times``, if given, are all different."""
        if len(self.index) > self.limit:
            self._forget()
        at = np.fromiter(map(self.index.__getitem__, parts), np.int64, len(parts))
        if self.index.fresh:
            self._learn()
        if times is None:
            self.met += np.bincount(at, minlength=len(self.met))
        else:
            self.met[at] += times
        return at

    def _led(self, texts: dict[int, str], firsts: dict[int, list[int]], counts: np.ndarray) -> np.ndarray:
        """Numbers of the pieces of texts whose pieces keep the space before them.

        Pieces are cut out of the texts' bytes and the different ones found by Arrow, so that only these become strings.
        A first piece without a space before it goes to ``firsts``, the number of the others to ``counts``.
        """
        blobs = [t.encode() for t in texts.values()]
        lengths = np.fromiter(map(len, blobs), np.int64, len(blobs))
        joined = b"".join(blobs)
        raw, begins = np.frombuffer(joined, np.uint8), np.cumsum(lengths) - lengths
        cuts = _cuts(raw, begins)
        of_text = np.searchsorted(cuts, begins)  # the first piece of each text
        bare = raw[begins] != 32
        ends = np.append(cuts, len(raw))
        for i, k in zip(np.array(list(texts), np.int64)[bare].tolist(), of_text[bare].tolist()):
            firsts[i] = self.tokenizer.encode(joined[ends[k] : ends[k + 1]].decode(), add_special_tokens=False).ids
        counts[list(texts)] = np.diff(np.append(of_text, len(cuts))) - bare
        led = np.ones(len(cuts), bool)
        led[of_text[bare]] = False
        mask = pa.py_buffer(np.packbits(led, bitorder="little").tobytes())
        pieces = pa.Array.from_buffers(pa.large_string(), len(cuts), [mask, pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(joined)]).dictionary_encode()
        each = pieces.indices.drop_null().to_numpy()
        found = pieces.dictionary
        last = int(np.frombuffer(found.buffers()[1], np.int64)[len(found)]) if len(found) else 0
        parts = found.buffers()[2][:last].to_pybytes().decode().split(" ")[1:] if last else []
        if len(parts) != len(found):  # spaces inside pieces
            parts = [p[1:] for p in found.to_pylist()]
        return self._numbers(parts, np.bincount(each, minlength=len(parts)))[each]

    def encode(self, texts: list[str | None], end: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, each text followed by ``end``, and the number of ids of each text with it."""
        parts: list[str] = []
        counts = np.zeros(len(texts), np.int64)
        firsts: dict[int, list[int]] = {}
        led: dict[int, str] = {}
        for i, text in enumerate(texts):
            if not text:
                continue
            if self.prefix in text and self.added.search(text):
                firsts[i] = self.tokenizer.encode(text, add_special_tokens=False).ids
            elif self.lead:
                led[i] = text
            else:
                cut = _folded(text).split(" ")
                parts += cut
                counts[i] = len(cut)
        at = self._led(led, firsts, counts) if led else self._numbers(parts)
        # ids per text: first piece, other pieces, end
        begin = self.starts[at]
        sizes = self.sizes[at]
        ends = np.cumsum(counts)
        before = np.concatenate([[0], np.cumsum(sizes)])
        body = before[ends] - before[ends - counts]
        head = np.zeros(len(texts), np.int64)
        for i, ids in firsts.items():
            head[i] = len(ids)
        lengths = head + body + 1
        out_end = np.cumsum(lengths)
        out = np.empty(int(out_end[-1]) if len(texts) else 0, np.uint32)
        out[out_end - 1] = end
        shift = np.repeat(out_end - lengths + head - before[ends - counts], counts)  # piece position -> output position
        each = np.arange(int(before[-1]))
        out[each + np.repeat(shift, sizes)] = self.ids[each + np.repeat(begin - before[:-1], sizes)]
        for i, ids in firsts.items():
            s = int(out_end[i] - lengths[i])
            out[s : s + len(ids)] = ids
        return out, lengths


@lru_cache(maxsize=2)
def encoder(path: str, lead: bool) -> PieceEncoder:
    """One encoder per Python worker, kept between tasks."""
    one_thread()
    return PieceEncoder(path, lead)


def release_encoders() -> None:
    """For tasks of another kind: drops the encoders that the Python worker kept and gives their memory back to the system."""
    if not encoder.cache_info().currsize:
        return
    encoder.cache_clear()
    give_back()


def give_back() -> None:
    """Gives memory that is free in this Python worker back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)
