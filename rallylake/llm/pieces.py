"""Ids of a merge-type (BPE) piece vocabulary by a score-ordered agenda, and the way back to text.

A text is normalised as its model says (by the library: dummy prefix, white space as ``▁``). Its
characters are the first symbols. The agenda holds every adjacent pair of symbols whose concatenation
is a piece, best score first and of equal scores the leftmost; the top pair becomes one symbol, its
new neighbours enter the agenda, and a pair whose symbols have changed since is passed over. Symbols
that are no piece become the ids of their UTF-8 bytes where the model has these, else the unknown id.

A merge makes a piece, so none crosses from a character to the next where no piece holds the two side by
side (a word and the white space, comma or full stop behind it, two digits): the ids of a text are those of its
chunks between such places, and a worker keeps the ids of chunks that it has seen. Without ids for bytes a run of
unknown characters is one id, so that chunks begin only at the white space before a word.

Numpy finds these places for a portion of the texts at once, Arrow numbers the distinct chunks. Short ones are merged
side by side as columns of a matrix, the best pair of each in each step; long ones have a heap as agenda. Decoding
gathers the bytes of all pieces. In every Arrow batch the library encodes each chunk that is new, many a call between
characters that join none, and some whole texts; a difference is an error.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator, Sequence
from itertools import repeat

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rallylake.llm.common import arrow_map, kept, portions
from rallylake.llm.tokens import ChunkEncoder

SPACE = "▁"
#: What the library prints for an unknown id where the model does not say.
UNKNOWN = " ⁇ "
#: Chunks that one call of the library checks.
MARKED = 256
#: Chunks that are merged side by side, the places in them that are told apart, and what a pair that makes no piece has as rank.
COLUMNS, PLACES, NONE = 4096, 64, 1 << 62


def agenda(text: str, costs: dict[str, float]) -> list[str]:
    """The symbols of ``text`` after all merges; ``costs`` has the negative score of each piece."""
    symbols = list(text)
    n = len(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    pairs = [(c, k, k + 1, 2) for k in range(n - 1) if (c := costs.get(symbols[k] + symbols[k + 1])) is not None]
    heapq.heapify(pairs)
    while pairs:
        _, left, right, size = heapq.heappop(pairs)
        a, b = symbols[left], symbols[right]
        if not a or not b or len(a) + len(b) != size:
            continue
        symbols[left], symbols[right] = a + b, ""
        then = after[left] = after[right]
        if then < n:
            before[then] = left
            both = a + b + symbols[then]
            if (c := costs.get(both)) is not None:
                heapq.heappush(pairs, (c, left, then, len(both)))
        if (first := before[left]) >= 0:
            both = symbols[first] + a + b
            if (c := costs.get(both)) is not None:
                heapq.heappush(pairs, (c, first, left, len(both)))
    return [x for x in symbols if x]


class PieceEncoder(ChunkEncoder):
    """Ids and texts by one model file; the cache of chunks is that of the word tokenizer."""

    #: Chunks of up to so many characters (at most ``PLACES`` less 2) are merged side by side, longer ones by :func:`agenda`.
    SHORT = 48

    def __init__(self, path: str, cache: int = 300_000, checked: bool = True):
        self.checked = checked
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        sp, self.size = self.library, cache
        ids = range(sp.get_piece_size())
        names = [sp.id_to_piece(k) for k in ids]
        self.single, self.silent = (np.array([f(k) for k in ids]) for f in (sp.is_byte, sp.is_control))
        unknown = np.array([sp.is_unknown(k) for k in ids])
        special = self.single | self.silent | unknown
        if any(sp.is_unused(k) for k in ids):
            raise ValueError("vocabularies with unused pieces are not supported")
        self.bytes_of = {int(names[k][3:5], 16): k for k in ids if self.single[k]}
        self.id_of = {names[k]: k for k in ids if not special[k]}
        self.costs = {x: -sp.get_score(k) for x, k in self.id_of.items()}
        self.prefixed = sp.normalize("a") == SPACE + "a"
        raw = [b"" if self.silent[k] else UNKNOWN.encode() if unknown[k] else bytes([int(names[k][3:5], 16)]) if self.single[k] else names[k].replace(SPACE, " ").encode() for k in ids]
        self.widths = np.fromiter(map(len, raw), np.int64, len(raw))
        self.begins, self.raw = np.cumsum(self.widths) - self.widths, np.frombuffer(b"".join(raw), np.uint8)
        self.opens = np.array([x.startswith(SPACE) for x in names]) & ~special
        self._pairs()
        self._neighbours()
        self._clear()

    def _neighbours(self) -> None:
        """Which characters some piece holds side by side, as a table of numbers of left and right ones (0: any other)."""
        joined = {x[k : k + 2] for x in self.id_of for k in range(len(x) - 1)}
        self.left_of, self.right_of = np.zeros(0x110000, np.int32), np.zeros(0x110000, np.int32)
        for numbers, k in ((self.left_of, 0), (self.right_of, 1)):
            chars = sorted({ord(x[k]) for x in joined})
            numbers[chars] = np.arange(1, len(chars) + 1)
        pairs = np.array([(ord(a), ord(b)) for a, b in joined], np.int64).reshape(-1, 2)
        self.joins = np.zeros((self.left_of.max() + 1, self.right_of.max() + 1), bool)
        self.joins[self.left_of[pairs[:, 0]], self.right_of[pairs[:, 1]]] = True
        # what stands between chunks in a call of the library: a character of one id that no piece joins to another
        alone = (c for c in map(chr, range(1, 128)) if not self.left_of[ord(c)] and not self.right_of[ord(c)])
        self.mark = None
        for c in alone if self.prefixed and self.bytes_of else ():
            ids = self.library.encode(c + c)
            if self.library.normalize(c + c) == SPACE + c + c and len(ids) == 3 and ids[1] == ids[2]:
                self.mark, self.marked = c, ids[:2]
                break

    def _pairs(self) -> None:
        """Numbers of symbols (pieces, then characters that are only parts of pieces, then any others by
        code point) and, by pair of numbers, the piece that the two make and its cost."""
        symbols = dict(self.id_of)
        first = self.library.get_piece_size()
        for c in sorted(set("".join(self.id_of)) - set(symbols)):
            symbols[c] = first
            first += 1
        self.symbols, self.first = symbols, first
        self.of_char = np.arange(first, first + 0x110000, dtype=np.int64)
        for c, k in symbols.items():
            if len(c) == 1:
                self.of_char[ord(c)] = k
        self.wide = first + 0x110000
        made = sorted((symbols[x[:n]] * self.wide + symbols[x[n:]], k) for x, k in self.id_of.items() for n in range(1, len(x)) if x[:n] in symbols and x[n:] in symbols)
        self.keys, self.made = (np.array(c, np.int64) for c in zip(*made, strict=True))
        cost = np.array([-self.library.get_score(k) for k in self.made.tolist()])
        self.rank = np.unique(cost, return_inverse=True)[1].astype(np.int64)

    def _best(self, a: np.ndarray, b: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per pair of symbols (-1: none) the piece that they make, and the rank of its cost with the pair's
        place behind it, so that the least is the best and of equal ones the leftmost; ``NONE`` where they make none."""
        key = a * self.wide + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return self.made[at], np.where(self.keys[at] == key, self.rank[at] * PLACES + place, NONE)

    def _side_by_side(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge the columns of ``x``, texts as symbols between -1s (one at least before and behind each): in
        each step every column's best pair, the leftmost of equal ones. How many symbols each has then, and all of them."""
        n, m = x.shape
        every = np.repeat(np.arange(n), m)
        made, best = np.zeros(n * m, np.int64), np.full(n * m, NONE)
        x, before, after = x.ravel(), every - 1, every + 1
        made[:-m], best[:-m] = self._best(x[:-m], x[m:], every[:-m])
        while True:
            least = best.reshape(n, m).min(axis=0)
            column = np.flatnonzero(least < NONE)
            if not len(column):
                break
            place = least[column] % PLACES
            left = place * m + column
            right = after[left] * m + column
            x[left], x[right], best[right] = made[left], -1, NONE
            after[left] = after[right]
            then, first = after[left] * m + column, before[left] * m + column
            before[then] = place
            made[left], best[left] = self._best(x[left], x[then], place)
            made[first], best[first] = self._best(x[first], x[left], before[left])
        x = x.reshape(n, m).T
        return (x >= 0).sum(axis=1), x[x >= 0]

    def _merged(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each chunk has, and the ids of all."""
        lengths = np.fromiter(map(len, chunks), np.int64, len(chunks))
        flat = self.of_char[np.frombuffer("".join(chunks).encode("utf-32-le"), "<u4")]
        begins, done = np.cumsum(lengths) - lengths, []
        order = np.argsort(lengths, kind="stable")[: np.count_nonzero(lengths <= self.SHORT)]
        for at in range(0, len(order), COLUMNS):
            rows = order[at : at + COLUMNS]
            place = np.arange(lengths[rows[-1]])[:, None]
            x = np.full((len(place) + 2, len(rows)), -1)
            x[1:-1] = np.where(place < lengths[rows], flat[np.minimum(begins[rows] + place, len(flat) - 1)], -1)
            counts, symbols = self._side_by_side(x)
            done.append((np.repeat(rows, counts), symbols))
        for k in np.flatnonzero(lengths > self.SHORT).tolist():
            symbols = np.array([self.symbols.get(x, self.first + ord(x[0])) for x in agenda(chunks[k], self.costs)])
            done.append((np.repeat(k, len(symbols)), symbols))
        rows = np.concatenate([np.zeros(0, np.int64), *(r for r, _ in done)])
        ids = np.concatenate([np.zeros(0, np.int64), *(x for _, x in done)])
        order = np.argsort(rows, kind="stable")
        rows, ids = rows[order], ids[order]
        rows, ids = self._spelled(rows, ids)
        return np.bincount(rows, minlength=len(chunks)), ids.astype("<u4")

    def _spelled(self, rows: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols that are no piece become the ids of their bytes, or the unknown id once for a run of them."""
        other = ids >= self.library.get_piece_size()
        if not other.any():
            return rows, ids
        if not self.bytes_of:
            ids = np.where(other, self.library.unk_id(), ids)
            again = other & np.concatenate([[False], other[:-1] & (rows[1:] == rows[:-1])])
            return rows[~again], ids[~again]
        parts, names = {x: c for c, x in self.symbols.items() if x >= self.library.get_piece_size()}, []
        kinds, at = np.unique(ids[other], return_inverse=True)
        for x in kinds.tolist():
            names.append([self.bytes_of[b] for b in (parts[x] if x < self.first else chr(x - self.first)).encode()])
        sizes = np.ones(len(ids), np.int64)
        sizes[other] = np.array([len(x) for x in names])[at]
        out, ends = np.repeat(ids, sizes), np.cumsum(sizes)
        flat, starts = np.array([k for x in names for k in x]), np.cumsum([0, *(len(x) for x in names)])[:-1]
        spelled = np.repeat(other, sizes)
        within = np.arange(len(out)) - np.repeat(ends - sizes, sizes)
        which = np.zeros(len(ids), np.int64)
        which[other] = starts[at]
        out[spelled] = flat[(np.repeat(which, sizes) + within)[spelled]]
        return np.repeat(rows, sizes), out

    def _split(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The chunks of all texts, one after another, and where each text's chunks begin and end."""
        lines = self.library.normalize(texts.fill_null("").to_pylist())
        whole = "".join(lines)
        points = np.frombuffer(whole.encode("utf-32-le"), "<u4")
        ends = np.concatenate([[0], np.cumsum(np.fromiter(map(len, lines), np.int64, len(lines)))])
        cut = np.ones(len(points) + 1, bool)
        cut[1:-1] = ~self.joins.ravel()[self.left_of[points[:-1]] * self.joins.shape[1] + self.right_of[points[1:]]]
        if not self.bytes_of:
            cut[1:-1] &= (points[1:] == ord(SPACE)) & (points[:-1] != ord(SPACE))
        cut[ends] = True
        raw = whole.encode()
        begins = np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)[np.flatnonzero(cut[:-1])]
        chunks = pa.LargeStringArray.from_buffers(len(begins), pa.py_buffer(np.append(begins, len(raw))), pa.py_buffer(raw))
        return chunks, np.concatenate([[0], np.cumsum(cut[:-1])])[ends]

    def _chunks(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        split, offsets = self._split(texts)
        coded = split.dictionary_encode()
        names = coded.dictionary.to_numpy(zero_copy_only=False)
        numbers = self._numbers(names)
        new = numbers < 0
        if new.any():
            if len(self.known) + np.count_nonzero(new) > self.size and len(self.known) > 1:
                self._shrink()
                numbers = self._numbers(names)
                new = numbers < 0
            fresh = names[new].tolist()
            lengths, ids = self._merged(fresh)
            if self.checked and self.mark:
                self._check(fresh, lengths, ids)
            numbers[new] = np.arange(len(self.known), len(self.known) + len(fresh))
            self._add(fresh, lengths, ids)
        self.uses[numbers] += 1
        return numbers[coded.indices.to_numpy()], offsets

    def _numbers(self, names: np.ndarray) -> np.ndarray:
        """The number of each chunk, -1 for those not known."""
        return np.fromiter(map(self.known.get, names, repeat(-1)), np.int64, len(names))

    def _check(self, chunks: list[str], lengths: np.ndarray, ids: np.ndarray) -> None:
        """Raise unless the library has the same ids for every chunk, each between marks that join none."""
        ends, (first, mark) = np.cumsum(lengths), self.marked
        for at in range(0, len(chunks), MARKED):
            part = chunks[at : at + MARKED]
            begins = ends[at : at + len(part)] - lengths[at : at + len(part)]
            own = ids[begins[0] : ends[at + len(part) - 1]]
            own = np.concatenate([[first], np.insert(own, begins - begins[0], mark), [mark]])
            if np.array_equal(own, self.library.encode(self.mark.join(["", *part, ""]))):
                continue
            for x, a, n in zip(part, begins.tolist(), lengths[at : at + len(part)].tolist(), strict=True):
                if self.library.encode(self.mark + x + self.mark) != [first, mark, *ids[a : a + n].tolist(), mark]:
                    raise ValueError(f"chunk {x!r}: ids differ from the library's")
            raise ValueError(f"chunks {part[0]!r} to {part[-1]!r}: ids differ from the library's")

    def compare(self, names: pa.Array, texts: pa.Array, rows: Sequence[np.ndarray], decoded: list[str], every: int = 1) -> None:
        """Raise unless the library has the same ids and text for every text, or for one in ``every`` by its CRC."""
        for k, text in enumerate(texts.fill_null("").to_pylist()):
            if zlib.crc32(text.encode()) % every:
                continue
            ids = self.library.encode(text)
            if len(ids) != len(rows[k]) or not (rows[k] == np.array(ids, "<u4")).all() or self.library.decode(ids) != decoded[k]:
                raise ValueError(f"row {names[k]}: ids or text differ from the library's")

    def decode(self, rows: Sequence[np.ndarray]) -> list[str]:
        """The text of each row of ids, as the library gives it."""
        ids = np.concatenate([np.zeros(0, np.int64), *rows]).astype(np.int64)
        widths = self.widths[ids]
        ends = np.cumsum(widths)
        flat = self.raw[np.repeat(self.begins[ids] - (ends - widths), widths) + np.arange(ends[-1] if len(ends) else 0)].tobytes()
        out, at, place = [], 0, 0
        for row in rows:
            to, first = at + int(widths[place : place + len(row)].sum()), int(row[0]) if len(row) else 0
            part = flat[at:to]
            try:
                if self.silent[row].any():
                    raise ValueError
                out.append(part[int(self.prefixed and len(row) > 0 and self.opens[first]) :].decode())
            except ValueError:
                out.append(self._decode(row.tolist()))
            at, place = to, place + len(row)
        return out

    def _decode(self, ids: list[int]) -> str:
        """One row with control pieces or bytes that are no UTF-8: each such byte is U+FFFD."""
        out, run, bos = [], b"", True

        def flush(run: bytes) -> None:
            while run:
                n = 1 if run[0] < 0xC0 else 2 if run[0] < 0xE0 else 3 if run[0] < 0xF0 else 4
                try:
                    out.append(run[:n].decode())
                except UnicodeDecodeError:
                    n = 1
                    out.append("\ufffd")
                run = run[n:]

        for k in ids:
            text = self.raw[self.begins[k] : self.begins[k] + self.widths[k]].tobytes()
            if self.single[k]:
                run += text
                continue
            flush(run)
            run = b""
            bos = bos and not any(out)
            if bos and self.prefixed and self.opens[k]:
                text, bos = text[1:], False
            out.append(text.decode())
        flush(run)
        return "".join(out)


def encoder(path: str, checked: bool) -> PieceEncoder:
    """The worker's encoder for a model file; maps that use it keep "pieces"."""
    return kept("pieces", (path, checked), lambda: PieceEncoder(path, checked=checked))


def encode_decode(docs: DataFrame, model: str | None = None, id_col: str = "doc_id", text_col: str = "text", check: bool = True, whole_every: int = 16) -> DataFrame:
    """doc_id, ids array<int>, decoded: the ids of every whole text and the text that these ids give.

    ``model`` is the path of a model file (default: the public BPE with byte fallback), which every
    worker must see. No ids for begin or end are added, nothing is sampled, and strings of control
    pieces in a text are ordinary text. Null and empty texts have no ids and decode to the empty text. Rows with
    equal ids or texts are encoded each for itself; an empty table gives no rows. With ``check`` the library
    encodes every chunk of an Arrow batch that the worker has not met, and encodes and decodes one whole text in
    ``whole_every`` (1: all; all for a model that puts no ``▁`` before a text or has no ids for bytes); a difference raises an error that names the chunk or row.
    """
    path = model or public_tokenizers.path("piece_bpe_32k.model")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, check)
        for batch in batches:
            for part in portions(batch, 1, 1 << 20):
                rows = own.encode(part.column(1))
                decoded = own.decode(rows)
                if check:
                    own.compare(part.column(0), part.column(1), rows, decoded, whole_every if own.mark else 1)
                flat = pa.array(np.concatenate([np.zeros(0, "<u4"), *rows]).astype(np.int32))
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rows)]), pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([part.column(0), lists, pa.array(decoded, pa.string())], names=["doc_id", "ids", "decoded"])
            pa.default_memory_pool().release_unused()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).transform(arrow_map, run, "doc_id long, ids array<int>, decoded string", "pieces")
