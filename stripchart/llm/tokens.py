"""Whole texts to token ids with a public tokenizer, fast: a slice of texts is cut at single
blanks between words, where all tokenizers here always cut, Arrow finds the distinct pieces, and
each of these is looked up among those the worker has met before, or encoded. The ids of the
whole slice are then gathered at once."""

from __future__ import annotations

import functools
import itertools
import operator
import os
import unicodedata
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: Pieces a worker keeps in each of two generations, and marks by which it knows a piece it has
#: met once.
CACHE, MET = 300_000, 1 << 23
#: Longer pieces are not kept.
LONG = 64
#: Pieces encoded together.
JOINED = 128
#: Words with larger characters than those of the Latin, Greek and Cyrillic alphabets go through
#: the whole library.
ALPHABETS = "\u0530"
#: Between two characters that no Unicode rule counts as white space, a blank ends a piece.
_CUT = regex.compile(r"(?<=\S) (?=\S)")

#: Marks that follow words, and that the tokenizers with `words` split from them.
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Matches all before the marks at the end.
NO_TAIL = r"^(?s:.*)[^!-&(-/:-@\[-`{-~]"
#: Letters whose small form has an accent of its own, which is no letter.
ACCENTED = frozenset(c for c in map(chr, range(ord(ALPHABETS))) if c.isalpha() and not c.lower()[-1].isalpha())
#: Stands between pieces that are encoded together; pieces that hold it are encoded alone.
MARK = "|"
FEED = "\n"

Encoder = Callable[[list[str]], list[bytes]]


def file_of(name: str) -> str:
    """Path of a public vocabulary; a path is taken as it is."""
    if os.path.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class PieceCache:
    """Encodes texts as little-endian unsigned 32-bit ids, piece by piece.

    encode: ids (as bytes) of each of a list of strings, as if each stood in a text of its own.
    words: the same, faster, for strings of letters, each with or without a blank before it.
    A piece that follows another is encoded with the blank before it. Texts with pieces that may
    not end where they do (empty, or with white space at an edge) are cut by the slower, exact
    rule.
    lines: a line feed between two other characters is a piece of its own too.
    folds: the tokenizer drops white space, brings texts into composed form and lower-cases
    them, so pieces are cut at line feeds too and A-Z are lower-cased first.

    A piece is kept when it is met in a second slice: many are never met again. When a
    generation is full it becomes the older one, from which pieces still in use come back.
    """

    def __init__(self, encode: Encoder, limit: int = CACHE, words: Callable[[list[str], bool], tuple[np.ndarray, np.ndarray]] | None = None, lines: bool = False, folds: bool = False):
        self.encode, self.limit, self.words, self.lines, self.folds = encode, limit, words, lines, folds
        self.kept: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.met, self.marked = np.zeros(MET, bool), 0
        self.feed = np.frombuffer(encode([FEED])[0], "<u4")

    def _learned(self, names: list[str], plain: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, starts, sizes) of distinct pieces, with a blank before each that does not begin
        with a line feed, which only says so. plain: those of letters."""
        found = list(map(self.kept.get, names))
        new = [i for i, data in enumerate(found) if data is None]
        if self.older:
            for i in new:
                if (data := self.older.get(names[i])) is not None:
                    found[i] = self.kept[names[i]] = data
            new = [i for i in new if found[i] is None]
        if len(self.kept) > self.limit:
            self.kept, self.older = {}, self.kept
        for i in new:
            found[i] = b""
        sizes = np.fromiter(map(len, found), np.int64, len(found)) >> 2
        starts = np.cumsum(sizes) - sizes
        flat = [np.frombuffer(b"".join(found), "<u4")]
        held = len(flat[0])

        def add(at: np.ndarray, ids: np.ndarray, size: np.ndarray) -> None:
            nonlocal held
            sizes[at] = size
            starts[at] = held + np.cumsum(size) - size
            flat.append(ids)
            held += len(ids)

        new = np.array(new, np.int64)
        unknown = np.array(names, object)[new]
        loose = np.fromiter((x[:1] == FEED for x in unknown), bool, len(new))
        letters = plain[new]
        if len(at := np.flatnonzero(letters & ~loose)):
            add(new[at], *self.words(unknown[at].tolist(), True))
        if len(at := np.flatnonzero(letters & loose)):
            add(new[at], *self.words([x[1:] for x in unknown[at]], False))
        if len(at := np.flatnonzero(~letters)):
            data = self.encode([x[1:] if x[:1] == FEED else " " + x for x in unknown[at]])
            add(new[at], np.frombuffer(b"".join(data), "<u4"), np.array([len(x) >> 2 for x in data], np.int64))
        ids = np.concatenate(flat)
        mark = np.fromiter(map(hash, unknown), np.int64, len(new)) % len(self.met)
        again = self.met[mark]
        self.met[mark] = True
        for i, p in zip(new[again].tolist(), unknown[again]):
            if len(p) <= LONG:
                self.kept[p] = ids[starts[i] : starts[i] + sizes[i]].tobytes()
        self.marked += len(new)
        if self.marked > len(self.met) // 2:
            self.met[:], self.marked = False, 0
        return ids, starts, sizes

    def _distinct(self, pieces: pa.Array, heads: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids, starts, sizes, odd) of distinct pieces, then of distinct first pieces of texts.
        Marks after letters are always apart (but for a letter whose small form has an accent of
        its own), so words and their ends are learned on their own."""
        n = len(pieces)
        array = lambda x: x.to_numpy(zero_copy_only=False)
        fed = np.zeros(n + len(heads), bool)  # pieces after a line feed; heads may hold one inside
        if self.lines:
            fed[:n] = array(pc.starts_with(pieces, FEED))
            pieces = pc.utf8_ltrim(pieces, FEED)
        whole = pa.concat_arrays([pieces, heads])
        plain = np.zeros(len(whole), bool)
        bare = whole
        if self.words is not None:
            bare = pc.utf8_rtrim(whole, MARKS)
            plain = array(pc.utf8_is_alpha(bare)).copy()
            foreign = np.flatnonzero(plain & ~array(pc.string_is_ascii(bare)))
            if len(foreign):
                words = bare.take(pa.array(foreign))
                plain[foreign] = array(pc.match_substring_regex(words, f"^[^{ALPHABETS}-\U0010ffff]*$"))
                words = array(words).tolist()
                if not unicodedata.is_normalized("NFC", MARK.join(words)):
                    plain[foreign] &= [unicodedata.is_normalized("NFC", w) for w in words]
                plain[foreign] &= [ACCENTED.isdisjoint(w) for w in words]
        odd = np.zeros(len(whole), bool)
        rest = np.flatnonzero(~plain)
        for i, p in zip(rest.tolist(), array(whole.take(pa.array(rest))).tolist()):
            if self.folds:  # capitals may compose otherwise than small letters
                odd[i] = not p.isascii() and not unicodedata.is_normalized("NFC", p)
            elif i < n:
                odd[i] = not p or p[0].isspace() or p[-1].isspace()
            else:
                odd[i] = p[-1:].isspace()
        loose = fed.copy()
        loose[n:] = not self.folds
        keys = pc.if_else(pa.array(plain), bare, whole)
        if loose.any():
            keys = pc.if_else(pa.array(loose), pc.binary_join_element_wise(pa.scalar(FEED), keys, ""), keys)
        tailed = np.flatnonzero(plain & (array(pc.binary_length(whole)) != array(pc.binary_length(bare))))
        tails = pc.replace_substring_regex(whole.take(pa.array(tailed)), NO_TAIL, FEED)
        if odd.any():
            keys = pc.if_else(pa.array(odd), FEED, keys)
        coded = pa.concat_arrays([keys, tails, pa.array(["", FEED])]).dictionary_encode()
        names = array(coded.dictionary).tolist()
        where = array(coded.indices).astype(np.int64)
        letters = np.zeros(len(names), bool)
        letters[where[: len(whole)][plain]] = True
        ids, starts, sizes = self._learned(names, letters)
        # an empty piece and one of a line feed alone stand for nothing; a line feed's own ids come last
        nothing, feed = where[-2], len(names)
        sizes[where[-2:]] = 0
        starts, sizes = np.append(starts, len(ids)), np.append(sizes, len(self.feed))
        parts = np.full((len(whole), 3), nothing)
        parts[fed & ~odd, 0] = feed
        parts[:, 1] = where[: len(whole)]
        parts[tailed, 2] = where[len(whole) : -2]
        ids, n_parts = gathered(np.concatenate([ids, self.feed]), starts, sizes, parts.ravel())
        size = n_parts.reshape(-1, 3).sum(axis=1)
        return ids, np.cumsum(size) - size, size, odd

    def __call__(self, texts: list[str] | pa.Array) -> list[bytes]:
        texts = pa.array(texts, pa.string()) if isinstance(texts, list) else texts
        if not len(texts):
            return []
        if self.folds:
            plain = pc.replace_substring(pc.ascii_lower(texts), FEED, " ")
        else:
            plain = pc.replace_substring(texts, FEED, " " + FEED) if self.lines else texts
        cut = pc.split_pattern(plain, " ")
        ends = cut.offsets.to_numpy().astype(np.int64) - cut.offsets[0].as_py()
        pieces = cut.flatten().dictionary_encode()
        place = pieces.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        heads = pieces.dictionary.slice(0, 0)
        if not self.folds:  # no blank stands before the first piece
            firsts, where = np.unique(place[ends[:-1]], return_inverse=True)
            heads = pieces.dictionary.take(pa.array(firsts))
            place[ends[:-1]] = len(pieces.dictionary) + where
        ids, starts, sizes, odd = self._distinct(pieces.dictionary, heads)
        ids, n = gathered(ids, starts, sizes, place)
        data = ids.tobytes()
        stops = np.r_[0, 4 * np.cumsum(n)[ends[1:] - 1]].tolist()
        out = [data[a:b] for a, b in zip(stops, stops[1:])]
        if odd.any():
            for i in np.flatnonzero(np.add.reduceat(odd[place].astype(np.int64), ends[:-1])).tolist():
                out[i] = self._exactly(texts[i].as_py())
        return out

    def _exactly(self, text: str) -> bytes:
        if self.folds:
            return self.encode([text])[0]
        head, *rest = _CUT.split(text)
        new = list(dict.fromkeys(rest))
        own = dict(zip(new, self.encode([" " + p for p in new])))
        return self.encode([head])[0] + b"".join(map(own.__getitem__, rest))


def gathered(ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches of ids numbered in `place`, one after the other, and the size of each."""
    n = sizes[place]
    total = np.cumsum(n)
    shift = starts[place] - total + n
    return ids[np.repeat(shift, n) + np.arange(total[-1] if len(total) else 0)], n


def ids_of(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<u4")


def _byte_letters() -> dict[int, str]:
    """The characters that byte-level models write bytes as: printable ones as they are, the
    others in order from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def _word_encoder(model) -> Callable[[list[str], bool], tuple[np.ndarray, np.ndarray]] | None:
    """(ids of all, number of each) for words of letters, with or without a blank before each,
    straight from the model's merges; None where that does not agree with the whole library on
    some words."""
    letters, normal, tokenize, own_id = _byte_letters(), model.normalizer, model.model.tokenize, operator.attrgetter("id")

    def encoder(start: str) -> Callable[[list[str], bool], tuple[np.ndarray, np.ndarray]]:
        def ids(words: list[str], blank: bool) -> tuple[np.ndarray, np.ndarray]:
            if normal is not None:  # costs more than the ids do, so it is left out where it does nothing
                foreign = [i for i, w in enumerate(words) if not (w.isascii() and w.islower())]
                for i, w in zip(foreign, normal.normalize_str(MARK.join(words[i] for i in foreign)).split(MARK)):
                    words[i] = w
            joined = MARK.join(words)
            if not joined.isascii():
                joined = joined.encode("utf-8").decode("latin-1").translate(letters)
            if before := start if blank else "":
                joined = before + joined.replace(MARK, MARK + before)
            found = list(map(tokenize, joined.split(MARK)))
            return np.fromiter(map(own_id, itertools.chain.from_iterable(found)), "<u4"), np.fromiter(map(len, found), np.int64, len(found))

        return ids

    if normal is not None and normal.normalize_str("abcdefghijklmnopqrstuvwxyz") != "abcdefghijklmnopqrstuvwxyz":
        return None
    probe = ["a", "word", "Word", "naïve", "Straße", "Žižek", "слово", "ABC", "unquestionably"]
    whole = lambda words: [i for w in words for i in model.encode(w, add_special_tokens=False).ids]
    if whole(["Word.,$*"]) != whole(["Word", ".,$*"]):
        return None
    for start in (letters[0x20], ""):
        if encoder(start)([*probe], True)[0].tolist() == whole([" " + w for w in probe]) and encoder(start)([*probe], False)[0].tolist() == whole(probe):
            return encoder(start)
    return None


@functools.lru_cache(maxsize=4)
def tokenizers_cache(name: str) -> PieceCache:
    """For a file of the tokenizers library; special tokens' strings are ordinary text."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(file_of(name))
    model.encode_special_tokens = True
    model.no_padding()
    model.no_truncation()
    if hasattr(model.model, "_resize_cache"):
        model.model._resize_cache(0)  # pieces come once: keeping them again costs a third of the time

    mark = model.encode(" " + MARK, add_special_tokens=False).ids
    alone = lambda pieces: [np.array(e.ids, "<u4").tobytes() for e in model.encode_batch_fast(pieces, add_special_tokens=False)]

    def encode(pieces: list[str]) -> list[bytes]:
        """Short pieces go through the whole library as one text, with a mark between them that
        it always keeps apart; those in which the mark or odd white space stands go alone."""
        out: list[bytes | None] = [None] * len(pieces)
        apart = [i for i, p in enumerate(pieces) if len(p) > LONG or MARK in p or p[:1] != " " or p[1:2].isspace() or p[-1].isspace()]
        for i, data in zip(apart, alone([pieces[i] for i in apart])):
            out[i] = data
        short = [i for i, data in enumerate(out) if data is None]
        for at in range(0, len(short), JOINED):
            joined = short[at : at + JOINED]
            ids = np.array(model.encode_batch_fast([(" " + MARK).join(pieces[i] for i in joined)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(ids == mark[-1]) - len(mark) + 1
            if len(ends) == len(joined) - 1:
                data, starts, ends = ids.tobytes(), [0, *(4 * (ends + len(mark))).tolist()], [*(4 * ends).tolist(), 4 * len(ids)]
                between = [data[a:b] for a, b in zip(starts, ends)]
            else:  # not seen; the plain way is always right
                between = alone([pieces[i] for i in joined])
            for i, data in zip(joined, between):
                out[i] = data
        return out

    same = lambda text, *parts: model.encode(text, add_special_tokens=False).ids == [i for p in parts for i in model.encode(p, add_special_tokens=False).ids]
    folds = model.normalizer is not None and same("aB  Cd,\ne\t", "ab", "cd", ",", "e") and same(" \r\n\t")
    return PieceCache(encode, words=_word_encoder(model), lines=not folds and same("Ab,\nCd\nE.", "Ab,", "\n", "Cd", "\n", "E."), folds=folds)
