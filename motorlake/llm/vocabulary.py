"""Encoding by a tokenizer file, whole slices of texts at once, with the ids of frequent words kept."""

from __future__ import annotations

import os
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words kept at once in a worker, and the longest word kept, in bytes.
KEPT_WORDS = 200_000
KEPT_BYTES = 64
#: Plain words that are encoded as one string.
JOINED = 1024
#: Letters whose lower case and composed form need no context, and ASCII marks that form a token of their own behind a letter.
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
MARKS = r"!-&(-/:;=>?@\[-`{-~"

_encoders: dict[tuple[str, bool], "WordEncoder"] = {}


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def vocabulary_size(path: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size()


def gather(source: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs of ``source`` that begin at ``starts``, one after the other."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return source[np.repeat(starts - (ends - sizes), sizes) + np.arange(total)]


class KeptRuns:
    """The runs of ids of words; those of words that came twice or more in the last slices are kept, KEPT_WORDS of them at most."""

    def __init__(self, kind: type = np.uint32) -> None:
        self.words = pa.array([], pa.string())
        self.ids, self.sizes = np.zeros(0, kind), np.zeros(0, np.int64)

    def runs(self, words: pa.Array, places: np.ndarray, encode: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, sizes): the runs of ``words`` at ``places``, one after the other; ``encode`` gives these of words that aren't kept."""
        known = pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy(zero_copy_only=False)
        new = known < 0
        new_ids, new_sizes = encode(words.filter(pa.array(new)))
        before = np.cumsum(self.sizes) - self.sizes
        source = np.concatenate([self.ids, new_ids])
        starts, sizes = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        starts[~new], sizes[~new] = before[known[~new]], self.sizes[known[~new]]
        starts[new], sizes[new] = len(self.ids) + np.cumsum(new_sizes) - new_sizes, new_sizes
        found = gather(source, starts[places], sizes[places]), sizes[places]
        self._keep(words, np.bincount(places, minlength=len(words)), starts, sizes, source, known[~new], before)
        return found

    def _keep(self, words: pa.Array, counts: np.ndarray, starts: np.ndarray, sizes: np.ndarray, source: np.ndarray, used: np.ndarray, before: np.ndarray) -> None:
        short = pc.less_equal(pc.binary_length(words), KEPT_BYTES).to_numpy(zero_copy_only=False)
        chosen = np.flatnonzero(short & (counts > 1))
        if len(chosen) > KEPT_WORDS:
            chosen = chosen[np.argsort(-counts[chosen], kind="stable")[:KEPT_WORDS]]
        older = np.ones(len(self.words), bool)
        older[used] = False
        older = np.flatnonzero(older)[: KEPT_WORDS - len(chosen)]
        self.words = pa.concat_arrays([words.take(pa.array(chosen)), self.words.take(pa.array(older))])
        kept_starts, self.sizes = np.concatenate([starts[chosen], before[older]]), np.concatenate([sizes[chosen], self.sizes[older]])
        self.ids = gather(source, kept_starts, self.sizes)


class WordEncoder:
    """For tokenizers that drop white space: a text's ids are those of its words, one after the other.

    Distinct words of a slice are found as Arrow dictionaries, letters A-Z in lower case;
    only those that aren't kept from earlier slices are encoded. Plain words, letters with
    marks behind, are joined to long strings first and cut apart by the tokens that end a
    word.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.plain = Tokenizer.from_file(path)
        self.plain.normalizer = None
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        names = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(names.values()) + 1, bool)
        self.ends_word[[i for name, i in names.items() if name.endswith("</w>")]] = True
        self.kept = KeptRuns()

    def _singly(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [x.ids for x in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        return np.array([i for x in ids for i in x], np.uint32), np.array([len(x) for x in ids], np.int64)

    def _joined(self, words: list[str], parts: int) -> tuple[np.ndarray, np.ndarray]:
        """Of plain words in lower case that are ``parts`` tokens of the pre-tokenizer each, a space between them."""
        strings = [" ".join(words[at : at + JOINED]) for at in range(0, len(words), JOINED)]
        ids = np.concatenate([np.zeros(0, np.uint32), *(np.array(x.ids, np.uint32) for x in self.plain.encode_batch_fast(strings, add_special_tokens=False))])
        ends = np.flatnonzero(self.ends_word[ids])
        if len(ends) != parts * len(words):
            return self._singly([w.replace(" ", "") for w in words])
        return ids, np.diff(ends[parts - 1 :: parts], prepend=-1)

    def _encode(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each word)."""
        if not len(words):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        one = pc.match_substring_regex(words, f"^[{LETTERS}]+$").to_numpy(zero_copy_only=False)
        two = pc.match_substring_regex(words, f"^[{LETTERS}]+[{MARKS}]+$").to_numpy(zero_copy_only=False)
        rest = ~(one | two)
        small = lambda mask: pc.utf8_lower(words.filter(pa.array(mask)))
        found = [
            (one, *self._joined(small(one).to_pylist(), 1)),
            (two, *self._joined(pc.replace_substring_regex(small(two), f"^([{LETTERS}]+)", r"\1 ").to_pylist(), 2)),
            (rest, *self._singly(words.filter(pa.array(rest)).to_pylist())),
        ]
        sizes = np.zeros(len(words), np.int64)
        starts = np.zeros(len(words), np.int64)
        base = 0
        for mask, ids, own in found:
            sizes[mask], starts[mask] = own, base + np.cumsum(own) - own
            base += len(ids)
        return gather(np.concatenate([ids for _, ids, _ in found]), starts, sizes), sizes

    def encode(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets): uint32 ids of all texts one after the other, and where each text's begin, with the total at last.

        Null is empty; ``end`` is put after each text.
        """
        lists = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.string()), ""))
        coded = lists.flatten().dictionary_encode()
        folded = pc.if_else(pc.match_substring(coded.dictionary, "<|"), coded.dictionary, pc.ascii_lower(coded.dictionary)).dictionary_encode()
        words, places = folded.dictionary, folded.indices.to_numpy()[coded.indices.to_numpy()]
        ids, sizes = self.kept.runs(words, places, self._encode)
        ends = np.concatenate(([0], np.cumsum(sizes)))[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
        if end is None:
            return ids, ends
        offsets = ends + np.arange(len(ends))
        closed = np.full(offsets[-1], end, np.uint32)
        inside = np.ones(len(closed), bool)
        inside[offsets[1:] - 1] = False
        closed[inside] = ids
        return closed, offsets


def encoder(path: str, special: bool = True) -> WordEncoder:
    """The encoder of this worker; without ``special``, the names of special tokens are ordinary text."""
    if (path, special) not in _encoders:
        _encoders[path, special] = WordEncoder(path)
        _encoders[path, special].tokenizer.encode_special_tokens = not special
    return _encoders[path, special]
