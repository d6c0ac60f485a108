"""Subword ids of whole texts by a public tokenizer file.

The tokenizer splits at white space before anything else, so a text's ids are those of its words in turn. Each distinct
word of some texts is encoded once and its ids are gathered for all its places, so nothing is kept between texts. Words
of Latin letters, digits and marks go through a byte-pair coder that knows the same merges; all others (and long ones)
through the tokenizer itself. Both give the same ids: the coder sees each piece with an end mark, as the vocabulary has
its last characters apart, and merges by rank, which is the order of the ids.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 21  # of texts whose words are told apart together
LONG_WORD = 200  # characters beyond which a word is left to the tokenizer
_PLAIN = re.compile("(?!.*<\\|)[\x21-\x7e¡-įı-ɏ]{0,%d}" % LONG_WORD).fullmatch
_END, _GAP = "\x01", "\x02"  # end of a piece, and a piece between words: no plain word holds them


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable ones for themselves, the others from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Encoder:
    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        suffix, byte = told["model"]["end_of_word_suffix"], _byte_alphabet()
        ranks = {}
        for token, i in told["model"]["vocab"].items():
            last = token.endswith(suffix)
            ranks[bytes(byte[c] for c in token.removesuffix(suffix)) + _END.encode() * last] = i
        split = next(p["pattern"]["Regex"] for p in told["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pieces = regex.compile(rf"{_GAP}|(?:(?!{_GAP})(?:{split.replace('[^', f'[^{_GAP}')}))").findall
        self.coder = tiktoken.Encoding("word-ends", pat_str=rf"[^{_END}]+{_END}", mergeable_ranks=ranks, special_tokens={})
        self.gap = ranks[(_GAP + _END).encode()]

    def _plain(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of plain words, and how many of them each has."""
        if not words:
            return np.empty(0, np.uint16), np.empty(0, np.int64)
        marked = _END.join(self.pieces(_GAP.join(words).lower() + _GAP)) + _END
        ids = self.coder.encode_to_numpy(marked, disallowed_special=())
        gaps = np.flatnonzero(ids == self.gap)
        return ids[ids != self.gap], np.diff(gaps, prepend=-1) - 1

    def _other(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same of any words, told apart by the places of their ids."""
        ids, sizes = [np.empty(0, np.uint16)], [np.empty(0, np.int64)]
        for at in range(0, len(words), 4096):
            part = words[at : at + 4096]
            found = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            starts = np.cumsum([0, *(len(w) + 1 for w in part)])
            where = np.array([s for s, _ in found.offsets], np.int64)
            ids.append(np.array(found.ids, np.uint32))
            sizes.append(np.diff(np.searchsorted(where, starts)))
        return np.concatenate(ids), np.concatenate(sizes)

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words (which hold no ASCII white space) one after another, and how many each has."""
        plain = np.fromiter((m is not None for m in map(_PLAIN, words)), bool, len(words))
        if plain.all():
            return self._plain(words)
        some, n_some = self._plain([w for w, p in zip(words, plain, strict=True) if p])
        rest, n_rest = self._other([w for w, p in zip(words, plain, strict=True) if not p])
        size = np.empty(len(words), np.int64)
        size[plain], size[~plain] = n_some, n_rest
        ids = np.empty(len(some) + len(rest), np.uint32)
        of_plain = np.repeat(plain, size)
        ids[of_plain], ids[~of_plain] = some, rest
        return ids, size

    def encode(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """texts: UTF-8 as binary, without nulls. (ids, where each text's end) of some texts after another, whole texts."""
        size = np.diff(np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, 4 * texts.offset)) if len(texts) else np.empty(0)
        part = np.cumsum(size) // CHUNK_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(texts)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a:
                yield self._chunk(texts.slice(a, b - a))
        pa.default_memory_pool().release_unused()

    def texts(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each whole text."""
        for ids, ends in self.encode(texts):
            yield from np.split(ids, ends[:-1])

    def _chunk(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        try:
            texts = texts.cast(pa.string())
        except pa.ArrowInvalid:  # not UTF-8
            texts = pa.array([t.decode("utf-8", "replace") for t in texts.to_pylist()], pa.string())
        if not pc.any(pc.match_substring(texts, "<|")).as_py():  # special tokens are told by case
            texts = pc.ascii_lower(texts)
        split = pc.ascii_split_whitespace(texts)
        coded = split.values.dictionary_encode()
        ids, size = self.words(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        at, starts = coded.indices.to_numpy(), np.cumsum(size) - size
        own = size[at]
        ends = np.cumsum(own)
        out = ids[np.repeat(starts[at] - (ends - own), own) + np.arange(int(own.sum()))]
        return out, np.concatenate([[0], ends])[split.offsets.to_numpy()[1:]]


@lru_cache(4)
def encoder(path: str) -> Encoder:
    """One encoder for each worker process, kept between tasks."""
    return Encoder(path)
