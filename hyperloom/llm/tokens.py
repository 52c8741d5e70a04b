"""Token ids by the tokenizers library, with a bounded memo of words."""

from __future__ import annotations

import os
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc

from .shared import trim

#: A word longer than this is encoded without being remembered.
LONG_WORD = 48
#: Words remembered by a worker, at some 25 bytes each; at this number the memo starts anew.
MEMO = 1 << 20
#: Words that are encoded in one call, bytes of text that are split at once, and groups after which memory is given back.
CALL, GROUP, TRIM = 1000, 500_000, 32
#: Marks that may follow a word and never join a letter or digit in one piece.
MARKS = "!*#$%&.,|;:?()"
#: Ends of words that stay letters or digits when lowered and normalised, so that marks after them are pieces apart.
CLEAR = r"[0-9\p{Ll}]$"

_encoders: dict[str, "WordEncoder"] = {}


def _hashes(words: pa.Array):
    """64-bit hashes of words (large strings): two multilinear hashes of the bytes, each exact to 32 bits. Two words up to
    LONG_WORD bytes have the same with a probability of 2 ** -64; longer ones get that of their first bytes."""
    import numpy as np

    tables = np.random.default_rng(20_111).integers(0, 1 << 64, (2, LONG_WORD + 1), "u8")
    ends = np.frombuffer(words.buffers()[1], "i8")[words.offset : words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2] or b"", "u1")[ends[0] : ends[-1]].astype("u8") + 1
    ends = ends - ends[0]
    at = np.minimum(np.arange(len(data)) - np.repeat(ends[:-1], np.diff(ends)), LONG_WORD)
    out = []
    for table in tables:
        upto = np.concatenate((np.zeros(1, "u8"), np.cumsum(data * table[at])))
        out.append((upto[ends[1:]] - upto[ends[:-1]]) >> np.uint64(32))
    return out[0] << np.uint64(32) | out[1]


class Memo:
    """Sorted hashes of words with the place and number of their ids in one flat array."""

    def __init__(self) -> None:
        import numpy as np

        self.key, self.start, self.size, self.flat = np.zeros(0, "u8"), np.zeros(0, "i8"), np.zeros(0, "i4"), np.zeros(0, "u4")

    def find(self, key):
        """Positions of keys, and which are known."""
        import numpy as np

        if not len(self.key):
            return np.zeros(len(key), "i8"), np.zeros(len(key), bool)
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return at, self.key[at] == key

    def add(self, key, start, size, flat) -> None:
        """Words' keys, and the place and number of their ids in ``flat``."""
        import numpy as np

        order = np.argsort(key, kind="stable")
        start = start + len(self.flat)
        self.flat = np.concatenate((self.flat, flat))
        place = np.searchsorted(self.key, key[order])
        self.key, self.start, self.size = (np.insert(a, place, b[order]) for a, b in ((self.key, key), (self.start, start), (self.size, size)))


class WordEncoder:
    """Encodes texts word by word; right for tokenizers whose pieces never cross white space or join letters and marks.

    Such a tokenizer drops white space and lowers case, so a text's ids are its words' ids one after another. A memo keeps
    the ids of short words without their trailing marks, by hash. A-Z are lowered first, except in texts with "<|", where
    a special token may stand.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import numpy as np
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self.size = self._tokenizer.get_vocab_size()
        self._ends = np.zeros(self.size, bool)
        if suffix := getattr(self._tokenizer.model, "end_of_word_suffix", None):
            self._ends[[i for t, i in self._tokenizer.get_vocab(with_added_tokens=False).items() if t.endswith(suffix)]] = True
        self._memo = Memo()

    def _encode(self, words: list[str]) -> tuple:
        """The place and number of each word's ids, and the ids. Words that are one run of letters go in one call, where
        each ends with its only end-of-word token."""
        import numpy as np

        start, size, found, upto = np.zeros(len(words), "i8"), np.zeros(len(words), "i8"), [np.zeros(0, "u4")], 0
        run = [w.isalpha() and (w.isascii() or unicodedata.normalize("NFC", w).lower().isalpha()) for w in words]
        plain, other = np.flatnonzero(run), [np.flatnonzero(~np.array(run, bool))]
        for at in range(0, len(plain), CALL):
            some = plain[at : at + CALL]
            ids = self._tokenizer.encode_batch_fast([" ".join([words[i] for i in some])], add_special_tokens=False)[0].ids
            ids = np.array(ids, "u4")
            ends = np.flatnonzero(self._ends[ids]) + 1
            if len(ends) == len(some) and ends[-1] == len(ids):
                size[some] = np.diff(ends, prepend=0)
                start[some] = upto + ends - size[some]
                found.append(ids)
                upto += len(ids)
            else:
                other.append(some)
        rest = np.concatenate(other)
        for at in range(0, len(rest), CALL):
            some = rest[at : at + CALL]
            lists = [c.ids for c in self._tokenizer.encode_batch_fast([words[i] for i in some], add_special_tokens=False)]
            size[some] = [len(x) for x in lists]
            start[some] = upto + np.cumsum(size[some]) - size[some]
            found.append(np.array([i for x in lists for i in x], "u4"))
            upto += len(found[-1])
        return start, size, np.concatenate(found)

    def _stems(self, words: pa.Array) -> tuple:
        """For different words (large strings) their stems' hashes and marks' numbers, and the marks. A word whose marks
        may join what is before them is its own stem."""
        import numpy as np

        stems = pc.ascii_rtrim(words, characters=MARKS)
        rest = np.flatnonzero(pc.less(pc.binary_length(stems), pc.binary_length(words)).to_numpy(zero_copy_only=False))
        rest = rest[pc.match_substring_regex(stems.take(rest), CLEAR).to_numpy(zero_copy_only=False)]
        apart = np.zeros(len(words), bool)
        apart[rest] = True
        tails = [w[len(s) :] for w, s in zip(words.take(rest).to_pylist(), stems.take(rest).to_pylist())]
        stems = pc.if_else(pa.array(apart), stems, words)
        names = sorted(set(tails))
        number = dict(zip(names, range(len(names))))
        mark = np.full(len(words), -1, "i8")
        mark[rest] = [number[t] for t in tails]
        return stems, mark, names

    def _learn(self, words: pa.Array) -> tuple:
        """Places and numbers, in the memo's flat array, of the ids of words; those that are too long for the memo come
        after its own."""
        import numpy as np

        memo, key = self._memo, _hashes(words)
        long = pc.greater(pc.binary_length(words), LONG_WORD).to_numpy(zero_copy_only=False)
        _, known = memo.find(key)
        new = np.flatnonzero(~known & ~long)
        if len(new):
            _, first = np.unique(key[new], return_index=True)
            new = new[first]
            memo.add(key[new], *self._encode(words.take(new).to_pylist()))
        at, _ = memo.find(key)
        start, size = (memo.start[at], memo.size[at].astype("i8")) if len(memo.key) else (np.zeros(len(key), "i8"), np.zeros(len(key), "i8"))
        return start, size, np.flatnonzero(long)

    def _of(self, words: pa.Array) -> tuple:
        """For different words the place and number of their stems' ids and of their marks' ids, and the flat array."""
        import numpy as np

        if len(self._memo.key) > MEMO:
            self._memo = Memo()
        stems, mark, names = self._stems(words)
        every = pa.concat_arrays([stems, pa.array(names, pa.large_string())])
        start, size, long = self._learn(every)
        flat = self._memo.flat
        if len(long):
            place, size[long], ids = self._encode(every.take(long).to_pylist())
            start[long] = len(flat) + place
            flat = np.concatenate((flat, ids))
        n = len(words)
        start, size = np.append(start, 0), np.append(size, 0)
        second = np.where(mark < 0, len(start) - 1, n + mark)
        return np.stack((start[:n], start[second]), 1), np.stack((size[:n], size[second]), 1), flat

    def encode(self, texts: pa.Array) -> Iterator[memoryview]:
        """For each text its ids as little-endian unsigned 32-bit integers; null counts as empty."""
        import numpy as np

        for n, group in enumerate(_groups(texts), 1):
            if n % TRIM == 0:
                trim()
            group = pa.concat_arrays([pc.fill_null(group, "").cast(pa.large_string())])  # of offset 0
            lowered = pc.if_else(pc.match_substring(group, "<|"), group, pc.ascii_lower(group))
            lists = pc.ascii_split_whitespace(lowered)
            ends = lists.offsets.to_numpy()
            coded = lists.values.slice(ends[0], ends[-1] - ends[0]).dictionary_encode()
            start, size, flat = self._of(coded.dictionary)
            word = coded.indices.to_numpy()
            start, size = start[word].ravel(), size[word].ravel()
            upto = np.concatenate(([0], np.cumsum(size)))
            out = memoryview(flat[np.repeat(start - upto[:-1], size) + np.arange(upto[-1])].astype("<u4").tobytes())
            cuts = (upto[2 * (ends - ends[0])] * 4).tolist()
            yield from (out[a:b] for a, b in zip(cuts, cuts[1:]))


def _groups(texts: pa.Array, most: int = GROUP) -> Iterator[pa.Array]:
    """Slices of about ``most`` bytes, of one text at least."""
    import numpy as np

    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    ends, at = np.concatenate(([0], np.cumsum(size, dtype="i8"))), 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + most, "right")) - 1)
        yield texts.slice(at, to - at)
        at = to


def encoder(path: str) -> WordEncoder:
    """The worker's encoder for a vocabulary file; it lasts as long as the worker."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """The place of a public vocabulary file; it is installed on every machine and never copied."""
    import public_tokenizers

    return public_tokenizers.path(name)
