"""Token ids by a public tokenizer, with a cache of white-space separated chunks.

The tokenizer is used as its file loads: strings of its special tokens have the ids of these tokens.
It (word BPE: lower case, white space dropped) never joins across ASCII white space, so the ids of a
text are those of its chunks. Arrow splits a batch and numbers its distinct chunks; each
of these is encoded by the library once, and the ids of the texts are gathered from the kept ones. The
cache lives until the Python worker gets a task of another operator; when it is full, what few batches had goes.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer, normalizers, pre_tokenizers

from rallylake.llm.common import kept

#: Chunks that a Python worker keeps at most, beside those of the batch at hand.
CACHE = 400_000
#: Chunks whose ids are gathered at once.
BLOCK = 1 << 18
#: A character with ids of its own that separates the chunks encoded in one call.
MARK = "\x01"
#: A chunk that ends in a letter and then ASCII punctuation (no apostrophe): tokens never join these two.
TAILED = re.compile(r"(.*[a-zß-öø-ÿ])([!-&(-/:-@\[-`{-~]+)", re.S)
#: Chunks of composed lower-case letters only: the normaliser leaves them as they are and nothing splits them.
PLAIN = re.compile("[a-zß-öø-ÿ]+")


class ChunkEncoder:
    def __init__(self, path: str, cache: int = CACHE):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.plain = Tokenizer.from_file(path)
        self.plain.normalizer = normalizers.Sequence([])
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.size = cache
        # strings of special tokens count as written: a batch with one, in any case, is not lower-cased first
        self.special = "|".join(re.escape(x.content) for x in self.tokenizer.get_added_tokens_decoder().values())
        self.mark = self.tokenizer.encode(MARK, add_special_tokens=False).ids
        assert len(self.mark) == 1
        self._clear()

    def _clear(self) -> None:
        """Known chunks by number, where their ids stand, and in how many batches each was; the empty one has no ids."""
        self.known: dict[str, int] = {"": 0}
        self.ids, self.starts, self.lengths_of, self.uses = np.zeros(0, "<u4"), np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(1, np.int32)

    def _shrink(self) -> None:
        """Forget chunks that few batches had, half of them at least; the others' counts are halved."""
        least = max(2, int(np.partition(self.uses, len(self.uses) // 2)[len(self.uses) // 2]) + 1)
        names, numbers = list(self.known), np.flatnonzero((self.uses >= least) | (np.arange(len(self.uses)) == 0))
        lengths, starts = self.lengths_of[numbers], self.starts[numbers]
        self.known = {names[k]: n for n, k in enumerate(numbers.tolist())}
        self.ids, self.uses = self._gathered(starts, lengths), self.uses[numbers] >> 1
        self.starts, self.lengths_of = np.cumsum(lengths) - lengths, lengths

    def _gathered(self, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The ids of some runs of ``self.ids``, one run after another."""
        ends = np.cumsum(lengths)
        return self.ids[np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)]

    def _add(self, chunks: list[str], lengths: np.ndarray, ids: np.ndarray) -> None:
        self.known.update(zip(chunks, range(len(self.known), len(self.known) + len(chunks)), strict=True))
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(lengths) - lengths])
        self.lengths_of, self.uses = np.concatenate([self.lengths_of, lengths]), np.concatenate([self.uses, np.zeros(len(chunks), np.int32)])
        self.ids = np.concatenate([self.ids, ids])

    def _library(self, chunks: list[str], tokenizer: Tokenizer) -> list[bytes]:
        if any(MARK in x for x in chunks):
            return [np.array(x.ids, "<u4").tobytes() for x in tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]
        ids = np.array(tokenizer.encode_batch_fast([f" {MARK} ".join(chunks)], add_special_tokens=False)[0].ids, "<u4")
        ends = [*np.flatnonzero(ids == self.mark[0]).tolist(), len(ids)]
        if len(ends) != len(chunks):
            raise ValueError("the tokenizer joined chunks across white space")
        raw, begins = ids.tobytes(), [0, *(x + 1 for x in ends[:-1])]
        return [raw[4 * a : 4 * b] for a, b in zip(begins, ends, strict=True)]

    def _learn(self, fresh: list[str]) -> None:
        # a word with its full stop or comma has the ids of the word and those of the mark
        tails = {x: m.groups() for x in fresh if (m := TAILED.fullmatch(x)) and not (self.special and re.search(self.special, x))}
        new = list(set(fresh).difference(tails).union(*tails.values()).difference(self.known))
        plain = [x for x in new if PLAIN.fullmatch(x)]
        for part, tokenizer in ((plain, self.plain), (list(set(new).difference(plain)), self.tokenizer)):
            made = []
            for at in range(0, len(part), 128):
                made += self._library(part[at : at + 128], tokenizer)
            self._add(part, np.fromiter(map(len, made), np.int64, len(made)) // 4, np.frombuffer(b"".join(made), "<u4"))
        parts = np.array([self.known[x] for pair in tails.values() for x in pair], np.int64)
        lengths = self.lengths_of[parts]
        self._add(list(tails), lengths.reshape(-1, 2).sum(axis=1), self._gathered(self.starts[parts], lengths))

    def _chunks(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the chunks of all texts, one after another, and where each text's chunks begin and end."""
        texts = texts.fill_null("")
        if not self.special or not pc.any(pc.match_substring_regex(texts, self.special, ignore_case=True)).as_py():
            texts = pc.ascii_lower(texts)
        split = pc.ascii_split_whitespace(texts)
        coded = split.flatten().dictionary_encode()
        names = coded.dictionary.to_numpy(zero_copy_only=False)
        numbers = list(map(self.known.get, names))
        fresh = [x for x, k in zip(names, numbers, strict=True) if k is None] if None in numbers else []
        if fresh:
            if len(self.known) + len(fresh) > self.size and len(self.known) > 1:
                self._shrink()
                fresh = [x for x in names if x not in self.known]
            self._learn(fresh)
            numbers = list(map(self.known.__getitem__, names))
        numbers = np.array(numbers, np.int64)
        self.uses[numbers] += 1
        offsets = split.offsets.to_numpy()
        return numbers[coded.indices.to_numpy()], offsets - offsets[0]

    def lengths(self, texts: pa.Array) -> np.ndarray:
        """How many ids each text of a string column has."""
        chunks, offsets = self._chunks(texts)
        return np.diff(np.concatenate([[0], np.cumsum(self.lengths_of[chunks])])[offsets])

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids (uint32) of each text of a string column, without special tokens; null is empty."""
        chunks, offsets = self._chunks(texts)
        ends = np.concatenate([[0], np.cumsum(self.lengths_of[chunks])])
        ids = np.empty(ends[-1], "<u4")
        for at in range(0, len(chunks), BLOCK):
            part = chunks[at : at + BLOCK]
            ids[ends[at] : ends[at + len(part)]] = self._gathered(self.starts[part], self.lengths_of[part])
        return np.split(ids, ends[offsets[1:-1]]) if len(texts) else []


def encoder(path: str) -> ChunkEncoder:
    """The worker's encoder for a vocabulary file; maps that use it keep "tokens"."""
    return kept("tokens", path, lambda: ChunkEncoder(path))
