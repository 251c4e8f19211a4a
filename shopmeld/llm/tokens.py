"""Token ids of whole texts with a public tokenizer, for use inside tasks.

Byte-pair merges never cross a boundary of the pre-tokenizer, and there always is one before a space that
a visible Latin character follows. Texts are cut there, and each distinct piece is encoded once per worker:
natural text repeats its words, and the library spends most of its time on merging them anew.

Cutting and telling pieces apart are Arrow's work on whole columns. New pieces are encoded many to a text, with a
mark between two whose ids no other piece has; where the marks do not come back, each piece is a text of its own.

Runs of Latin letters are one word to most pre-tokenizers, and punctuation after one is another. Where a file's own
says so, new pieces are parted there, and each distinct run goes to the file's model without the search for words.
"""

from __future__ import annotations

import os
import re
import string
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Cut before a space only if one of these follows: visible ASCII or a Latin letter, never a mark or white space.
VISIBLE = "!-~À-ɏ"
#: A single line break between two of them is a piece of its own.
PIECE = re.compile(
    f"(?<=[{VISIBLE}])\n(?=[{VISIBLE}])| ?[^ \n]*(?:(?: (?![{VISIBLE}])|(?<![{VISIBLE}])\n|\n(?![{VISIBLE}]))[^ \n]*)*"
)
#: Where the pieces are not simply words with the space before them, and single line breaks.
UNUSUAL = f" (?:[^{VISIBLE}]|\\z)|(?:\\A|[^{VISIBLE}])\n|\n(?:[^{VISIBLE}]|\\z)|\x01"
#: Pieces that can be encoded side by side in one text.
PLAIN = f"\\A ?[{VISIBLE}]+\\z"
#: Marks between such pieces, which hold none of their characters.
MARKS = ("\n", "\n°\n")
JOINED_PIECES = 512
#: Pieces that are a run of letters and the punctuation after it; an apostrophe may belong to the letters after it.
REST = "!-&(-/:-@\\[-`{-~"
LETTERS = f"\\A(?P<run> ?[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<rest>[{REST}]*)\\z"
#: A line break as byte-level models write it: the mark between runs of letters.
BREAK = "Ċ"
#: Longer pieces are encoded each time.
CACHED_CHARS = 64
CACHED_PIECES = 1_000_000
STEP_BYTES = 4 << 20

_ENCODERS: dict[str, Encoder] = {}


def strings(values: pa.Array) -> list[str]:
    return values.to_numpy(zero_copy_only=False).tolist()


def _taken(pool: np.ndarray, starts: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of pool with the numbers at, one after the other, and the size of each."""
    begin = starts[at]
    sizes = starts[at + 1] - begin
    ends = np.cumsum(sizes)
    return pool[np.repeat(begin - ends + sizes, sizes) + np.arange(sizes.sum())], sizes


def cut(texts: pa.Array) -> pa.Array:
    """The pieces of each text, in order: a list per text."""
    unusual = pc.match_substring_regex(texts, UNUSUAL)
    lists = pc.split_pattern(pc.replace_substring(pc.replace_substring(texts, "\n", "\x01\n\x01"), " ", "\x01 "), "\x01")
    odd = np.flatnonzero(unusual.to_numpy(zero_copy_only=False))
    if not len(odd):
        return lists
    found = pa.array([PIECE.findall(t) for t in strings(texts.take(pa.array(odd)))], lists.type)
    at = np.arange(len(texts))
    at[odd] = len(texts) + np.arange(len(odd))
    return pa.concat_arrays([lists, found]).take(pa.array(at))


class Encoder:
    """Encodes texts with one tokenizer file; keeps the ids of pieces that it has seen."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.mark, self.mark_id = next(filter(None, map(self._marks, MARKS)), (None, None))
        self._runs_alone(path)
        self._forget()

    def _ids(self, texts: list[str], tokenizer=None) -> list[list[int]]:
        return [x.ids for x in (tokenizer or self.tokenizer).encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, text: str) -> list[str]:
        """What the model is given of a text."""
        own = self.tokenizer
        text = own.normalizer.normalize_str(text) if own.normalizer else text
        return [word for word, _ in own.pre_tokenizer.pre_tokenize_str(text)] if own.pre_tokenizer else [text]

    def _runs_alone(self, path: str) -> None:
        """self.bare: the model alone, which takes runs of letters, divided by BREAK, as self.shown writes them. None
        where a run may be more than one word, be written otherwise, or go on with the punctuation after it."""
        from tokenizers import Tokenizer, pre_tokenizers

        self.bare = None
        letters = string.ascii_letters + "".join(c for c in map(chr, range(0xC0, 0x100)) if c not in "×÷")
        punctuation = [c for c in string.punctuation if c != "'"]
        alone = {c: self._words(c) for c in [*letters, *punctuation]}
        pairs = "".join(x + y for x in letters for y in letters)
        shown = ["".join(alone[c][0] for c in pairs)] if all(len(alone[c]) == 1 for c in letters) else []
        spaced = self._words(" " + pairs)
        if self._words(pairs) != shown or len(spaced) != 1 or not spaced[0].endswith(shown[0]):
            return
        if not all(x.special for x in self.tokenizer.get_added_tokens_decoder().values()):
            return
        if any(self._words(x + c) != alone[x] + alone[c] for x in letters for c in punctuation):
            return
        self.shown = str.maketrans({c: alone[c][0] for c in letters} | {" ": spaced[0].removesuffix(shown[0])})
        bare = Tokenizer.from_file(path)
        bare.encode_special_tokens = True
        bare.normalizer, bare.pre_tokenizer = None, pre_tokenizers.Split(BREAK, "isolated")
        (ids,) = self._ids([BREAK], bare)
        if len(ids) == 1 and BREAK in bare.id_to_token(ids[0]) and BREAK not in spaced[0]:
            self.bare, self.break_id = bare, ids[0]

    def _marks(self, mark: str) -> tuple[str, int] | None:
        """The mark and its id, if it is one id that stays apart from what is before and after it."""
        sides = ["a", " a", "?", " ?", "1", " 'a", "é", " é,"]
        (ids,), alone = self._ids([mark]), self._ids(sides)
        if len(ids) != 1 or any(ids[0] in x for x in alone):
            return None
        pairs = [(i, j) for i in range(len(sides)) for j in range(len(sides))]
        met = self._ids([sides[i] + mark + sides[j] for i, j in pairs])
        same = all(x == alone[i] + ids + alone[j] for (i, j), x in zip(pairs, met, strict=True))
        return (mark, ids[0]) if same else None

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.pool = np.zeros(0, np.uint32)
        self.starts = np.zeros(1, np.int64)

    def _alone(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces, and how many each has."""
        encoded = self._ids(pieces)
        return np.fromiter(chain.from_iterable(encoded), np.uint32), np.fromiter(map(len, encoded), np.int64, len(encoded))

    def _joined(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for plain pieces, encoded many to a text."""
        found = self._between(pieces, self.mark, self.mark_id) if self.mark is not None else None
        return found or self._alone(pieces)

    def _between(self, pieces: list[str], mark: str, mark_id: int, tokenizer=None) -> tuple[np.ndarray, np.ndarray] | None:
        texts = [mark.join([*pieces[i : i + JOINED_PIECES], ""]) for i in range(0, len(pieces), JOINED_PIECES)]
        ids = np.fromiter(chain.from_iterable(self._ids(texts, tokenizer)), np.uint32)
        marks = ids == mark_id
        ends = np.flatnonzero(marks)
        if len(ends) != len(pieces):
            return None
        return ids[~marks], np.diff(ends, prepend=-1) - 1

    def _runs(self, runs: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The same for runs of letters, by the bare model."""
        shown = pa.array([run.translate(self.shown) for run in strings(runs)], runs.type).dictionary_encode()
        ids, sizes = self._between(strings(shown.dictionary), BREAK, self.break_id, self.bare)
        return _taken(ids, np.concatenate([[0], np.cumsum(sizes)]), shown.indices.to_numpy())

    def _learn(self, pieces: pa.Array) -> None:
        """Gives new pieces the next numbers, in their order."""
        parts = pc.extract_regex(pieces, LETTERS if self.bare else "\\A(?P<run>)(?P<rest>)\\z")
        lettered = parts.is_valid().to_numpy(zero_copy_only=False)
        runs, rests = (pc.struct_field(parts.filter(pa.array(lettered)), i) for i in (0, 1))
        runs = runs.dictionary_encode()
        rests = pc.if_else(pc.equal(rests, ""), pa.scalar(None, rests.type), rests).dictionary_encode()
        plain = ~lettered & pc.match_substring_regex(pieces, PLAIN).to_numpy(zero_copy_only=False)
        others = ~lettered & ~plain
        simple, odd = (strings(pieces.filter(pa.array(x))) for x in (plain, others))
        # Every piece is two parts: one of these and the rest after it, the last being nothing.
        found = [self._runs(runs.dictionary)] if self.bare else []
        found += [self._joined(simple + strings(rests.dictionary)), self._alone(odd)]
        first_simple = len(runs.dictionary) if self.bare else 0
        first_rest = first_simple + len(simple)
        first_odd = first_rest + len(rests.dictionary)
        nothing = first_odd + len(odd)
        at = np.full((len(pieces), 2), nothing)
        at[plain, 0] = first_simple + np.arange(len(simple))
        at[others, 0] = first_odd + np.arange(len(odd))
        at[lettered, 0] = runs.indices.to_numpy()
        rest = rests.indices.fill_null(-1).to_numpy()
        at[lettered, 1] = np.where(rest < 0, nothing, first_rest + rest)
        ids, sizes = (np.concatenate(x) for x in zip(*found, strict=True))
        ids, sizes = _taken(ids, np.concatenate([[0], np.cumsum(sizes), [sizes.sum()]]), at.ravel())
        self.known.update(zip(strings(pieces), range(len(self.starts) - 1, len(self.starts) - 1 + len(pieces)), strict=True))
        self.pool = np.concatenate([self.pool, ids])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(sizes.reshape(-1, 2).sum(1))])

    def encode(self, texts: pa.Array | list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (no nulls), and where each text's ids start (one more for the end)."""
        if len(self.known) > CACHED_PIECES:
            self._forget()
        split = cut(pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string()))
        counts = pc.list_value_length(split).to_numpy()
        coded = split.flatten().dictionary_encode()
        pieces = coded.dictionary
        places = np.fromiter(map(self.known.get, strings(pieces), repeat(-1)), np.int64, len(pieces))
        missing = np.flatnonzero(places < 0)
        if len(missing):
            fresh = pieces.take(pa.array(missing))
            places[missing] = len(self.starts) - 1 + np.arange(len(missing))
            self._learn(fresh)
            for p in strings(fresh.filter(pc.greater(pc.utf8_length(fresh), CACHED_CHARS))):
                del self.known[p]
        ids, sizes = _taken(self.pool, self.starts, places[coded.indices.to_numpy()])
        ends = np.concatenate([[0], np.cumsum(sizes)])
        return ids, ends[np.concatenate([[0], np.cumsum(counts)])]

    def encode_steps(self, texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """encode() over runs of texts of bounded length: first row, end row, ids, starts. Null is empty."""
        texts = pc.fill_null(texts, "")
        ends = np.cumsum(pc.binary_length(texts).to_numpy().astype(np.int64))
        start = before = 0
        while start < len(texts):
            stop = max(start + 1, int(np.searchsorted(ends, before + STEP_BYTES, "right")))
            yield start, stop, *self.encode(texts.slice(start, stop - start))
            start, before = stop, int(ends[stop - 1])


def encoder(path: str) -> Encoder:
    """This worker's encoder for a file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def public_file(name: str) -> str:
    """Place of a public tokenizer file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
