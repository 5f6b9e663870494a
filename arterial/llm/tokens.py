"""Token ids of a public byte-level BPE vocabulary, by the tokenizers library.

A word's ids do not depend on its neighbours: the pre-tokenizer gives a single
space to the word after it, keeps a line feed between two words apart, and
parts letters from the marks after them. So texts are split and their distinct
words found in Arrow, each of these is looked up once, and numpy lays out the
ids. A task keeps bounded memos of words, and forgets them at its end, as its
worker goes on with other work. Words that they lack go to the library many at
a time, joined by line feeds: plain letters, parted from their marks in Arrow
and spelt as byte-level BPE spells them, to its BPE model with nothing before
it but a split at the line feeds; others to ``encode``. A text with any other
white space is encoded directly, as a whole. All ways give the ids of ``encode``.
"""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence
from itertools import islice
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The vocabulary file that the queries take.
VOCABULARY = "byte_bpe_50k.json"
#: The id that ends each document.
END_ID = 0
#: Words that each of a task's memos holds at most.
MEMO_WORDS = 400_000
#: Bytes of text to encode at a time: more share more lookups.
SLICE_BYTES = 16 << 20
#: Missing words joined into one call of encode, and into one of the model.
JOINED, SPELT = 2000, 20_000
#: Latin letters, then ASCII marks other than the apostrophe, which begins contractions.
PLAIN = r"^(?P<feed>\n?)(?P<word>[A-Za-zÀ-ÖØ-öø-ɏ]+)(?P<tail>[!-&(-/:-@\[-`{-~]*)$"
STRING = pa.large_string()

_encoders: dict[str, Encoder] = {}


def _byte_letters() -> dict[int, str]:
    """The letter by which byte-level BPE writes each byte: printable bytes
    stand for themselves, the others for the code points from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Memo(dict):
    """Ids of words, of at most ``limit`` words; ``fresh`` has what did not fit.
    A word whose ids depend on its neighbours has none here."""

    def __init__(self, limit: int):
        super().__init__()
        self.limit, self.fresh = limit, {}

    def __missing__(self, key: str) -> bytes:
        return self.fresh[key]

    def learn(self, found: dict[str, bytes]) -> None:
        room = self.limit - len(self)
        self.update(found if len(found) <= room else islice(found.items(), max(0, room)))
        self.fresh = found

    def forget(self) -> None:
        self.clear()
        self.fresh = {}


class Ids(NamedTuple):
    """Ids of many words, end to end, and how many each word has."""

    sizes: np.ndarray
    flat: np.ndarray

    @staticmethod
    def of(words: list[bytes]) -> Ids:
        return Ids(np.fromiter(map(len, words), np.int64, len(words)) // 4, np.frombuffer(b"".join(words), "<u4"))

    @staticmethod
    def joined(many: list[Ids]) -> Ids:
        return Ids(np.concatenate([m.sizes for m in many]), np.concatenate([m.flat for m in many]))

    def take(self, which: np.ndarray) -> np.ndarray:
        """The ids of these words, end to end."""
        counts = self.sizes[which]
        after, starts = np.cumsum(counts), np.cumsum(self.sizes) - self.sizes
        return self.flat[np.repeat(starts[which] - after + counts, counts) + np.arange(counts.sum())]


class Encoder:
    """Encodes texts into arrays of ids without special tokens or end id."""

    def __init__(self, vocabulary: str, memo_words: int = MEMO_WORDS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import Split

        if not os.path.isabs(vocabulary):
            import public_tokenizers

            vocabulary = public_tokenizers.path(vocabulary)
        self.tokenizer = Tokenizer.from_file(vocabulary)
        letters = _byte_letters()
        self.letters = np.array([ord(letters[b]) for b in range(256)], "<u4")
        self.speller = Tokenizer(self.tokenizer.model)  # one model for both
        self.speller.pre_tokenizer = Split(letters[10], "isolated")
        self.chunks, self.tails = Memo(memo_words), Memo(10_000)
        self.memo_words = memo_words
        self.line_feed = self._ids("\n")
        (self.feed,) = np.frombuffer(self.line_feed, "<u4")
        self.forget()

    def forget(self) -> None:
        """Empty the memos, which is what a task does at its end."""
        self.chunks.forget()
        self.tails.forget()
        self.words, self.word_ids = pa.array([], STRING), Ids.of([])

    def _ids(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return np.array(ids, dtype="<u4").tobytes()

    def _model_ids(self, words: pa.Array) -> Ids:
        """Ids of words of letters, each with or without a space before it."""
        many = [Ids.of([])]
        for at in range(0, len(words), SPELT):
            some = words.slice(at, SPELT)
            text = pc.binary_join(pa.LargeListArray.from_arrays([0, len(some)], some), pa.scalar("\n", STRING))[0].as_buffer()
            spelt = self.letters[np.frombuffer(text, np.uint8)].tobytes().decode("utf-32-le")
            (coded,) = self.speller.encode_batch_fast([spelt], add_special_tokens=False)
            ids = np.array(coded.ids, "<u4")
            cuts = np.flatnonzero(ids == self.feed)
            many.append(Ids(np.diff(cuts, prepend=-1, append=len(ids)) - 1, np.delete(ids, cuts)))
        return Ids.joined(many)

    def _joined(self, words: list[str], lead: str) -> dict[str, bytes]:
        """Ids of lead + word for each word, where no word holds white space."""
        found: dict[str, bytes] = {}
        for at in range(0, len(words), JOINED):
            some = words[at : at + JOINED]
            text = "\n".join([lead + w for w in some])
            ids = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")
            cuts = np.flatnonzero(ids == self.feed)
            if len(cuts) == len(some) - 1:
                begins, ends = [0, *(cuts + 1).tolist()], [*cuts.tolist(), len(ids)]
                raw = ids.tobytes()
                found.update((w, raw[4 * b : 4 * e]) for w, b, e in zip(some, begins, ends))
            else:
                found.update((w, self._ids(lead + w)) for w in some)
        return found

    def _learn(self, missing: list[str]) -> dict[str, bytes]:
        """Ids of chunks that are not plain."""
        fresh: dict[str, bytes] = {}
        after_space, line_start = [], []
        for c in missing:
            word = c[1:] if c[:1] == "\n" else c
            if word.split() != [word]:
                fresh[c] = b""
            elif c is word:
                after_space.append(c)
            else:
                line_start.append(word)
        fresh.update(self._joined(after_space, " "))
        for word, ids in self._joined(line_start, "").items():
            fresh["\n" + word] = self.line_feed + ids
        return fresh

    def _plain(self, words: pa.Array) -> tuple[np.ndarray, Ids]:
        """Where each of the distinct words is among known ids, and these."""
        at = pc.index_in(words, value_set=self.words)
        new = words.filter(pc.is_null(at))
        known, room = len(self.words), max(0, self.memo_words - len(self.words))
        ids = Ids.joined([self.word_ids, own := self._model_ids(new)])
        if room and len(new):
            kept = own.sizes[:room]
            self.words = pa.concat_arrays([self.words, new.slice(0, room)])
            self.word_ids = Ids.joined([self.word_ids, Ids(kept, own.flat[: kept.sum()])])
        place = pc.fill_null(at, -1).to_numpy().astype(np.int64)
        place[place < 0] = known + np.arange(len(new))
        return place, ids

    def _distinct(self, chunks: pa.Array) -> Ids:
        """Ids of distinct chunks."""
        parts = pc.extract_regex(chunks, PLAIN)
        plain = pc.is_valid(parts)
        feed, word, tail = (parts.field(k).filter(plain) for k in ("feed", "word", "tail"))
        lead = pc.if_else(pc.equal(feed, ""), pa.scalar(" ", STRING), pa.scalar("", STRING))
        words = pc.binary_join_element_wise(lead, word, pa.scalar("", STRING)).dictionary_encode()
        place, known = self._plain(words.dictionary)
        tails = tail.dictionary_encode()
        marks = tails.dictionary.to_pylist()
        self.tails.learn({t: self._ids(t) for t in marks if t not in self.tails})
        odd = chunks.filter(pc.invert(plain)).to_pylist()
        self.chunks.learn(self._learn([c for c in odd if c not in self.chunks]))
        # nothing, a line feed, the tails and the odd chunks follow the known words; a chunk is up to three of all these
        ids = Ids.joined([known, Ids.of([b"", self.line_feed]), Ids.of([self.tails[t] for t in marks]), Ids.of([self.chunks[c] for c in odd])])
        none = len(known.sizes)
        pieces = np.full((len(chunks), 3), none, np.int64)
        is_plain = plain.to_numpy(zero_copy_only=False)
        pieces[is_plain, 0] = none + pc.not_equal(feed, "").to_numpy(zero_copy_only=False)
        pieces[is_plain, 1] = place[words.indices.to_numpy()]
        pieces[is_plain, 2] = none + 2 + tails.indices.to_numpy()
        pieces[~is_plain, 1] = none + 2 + len(marks) + np.arange(len(odd))
        return Ids(ids.sizes[pieces].sum(axis=1), ids.take(pieces.ravel()))

    def encode(self, texts: Sequence[str] | pa.Array) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text; of a null, none."""
        column = texts if isinstance(texts, pa.Array) else pa.array(texts, STRING)
        column = pc.fill_null(column.cast(STRING), "")
        # a chunk "\nword" begins a line; any other chunk follows one space
        none, feed = (pa.scalar(v, STRING) for v in ("", "\n"))
        lines = pc.binary_join_element_wise(feed, pc.replace_substring(column, "\n", " \n"), none)
        split = pc.split_pattern(lines, " ")
        ends = split.offsets.to_numpy()
        coded = split.flatten().dictionary_encode()
        del lines, split
        ids, codes = self._distinct(coded.dictionary), coded.indices.to_numpy()
        starts = np.cumsum(ids.sizes) - ids.sizes
        lead, out = len(self.line_feed) // 4, []
        for first, last in _runs(ends):
            some = codes[ends[first] : ends[last]]
            counts = ids.sizes[some]
            after = np.cumsum(counts)
            laid = ids.flat[np.repeat(starts[some] - after + counts, counts) + np.arange(counts.sum())]
            places = np.concatenate([[0], after])[ends[first : last + 1] - ends[first]].tolist()
            whole = np.logical_or.reduceat(counts == 0, ends[first:last] - ends[first]).tolist()
            for row, begin, end, alone in zip(range(first, last), places, places[1:], whole):
                out.append(self._ids(column[row].as_py()) if alone else laid[begin + lead : end].tobytes())
        return out


def _runs(ends: np.ndarray, chunks: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Runs of rows of about so many chunks, or of one row."""
    first, n = 0, len(ends) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + chunks, "right")) - 1)
        yield first, last
        first = last


def encoder(vocabulary: str = VOCABULARY) -> Encoder:
    """This process's encoder for a vocabulary: a file name among the public
    ones or a full path."""
    if vocabulary not in _encoders:
        _encoders[vocabulary] = Encoder(vocabulary)
    return _encoders[vocabulary]
