"""Sum-of-squares online packing of token sequences into windows.

A document's full windows stand alone. Its rest, of s ids, goes to the partially filled window whose
level h makes the sum of N(level)^2 over all levels smallest, where N counts the partially filled windows of
each level: an array of that length is all the state the choice needs (Csirik et al., "On the Sum-of-Squares
Algorithm for Bin Packing"). Windows still open when a task's documents end, or when more than MAX_OPEN are
open, are filled by cutting the pieces of the emptiest to top up the fullest, which leaves one short window.

A task packs the documents of its own partition, so there is no shuffle and no state besides the open
windows. sequence_id has the task's partition in its upper bits.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm._common import bound_batches, buffers, id_and_text_columns, runs_of_rows, unsigned_crc32

WINDOW = 2048
END_ID = 1
#: Open windows a task may hold (8 KB each) before it closes them.
MAX_OPEN = 8192
#: Pieces of text whose ids a worker remembers, and bytes of text it encodes at a time.
MAX_MEMO, STEP_BYTES = 600_000, 4 << 20
OUT_BYTES = 8 << 20
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"

# Byte-level pre-tokenizers always cut before white space that follows a visible character, and between a letter and
# a stop or comma; so the pieces between such places can be encoded one by one.
_ASCII = np.arange(256)
_BLANK = np.isin(_ASCII, [32, 9, 10, 13])
_VISIBLE = (_ASCII > 32) & (_ASCII < 127)
_LETTER = ((_ASCII | 32) >= 97) & ((_ASCII | 32) <= 122)
_STOP = np.isin(_ASCII, [44, 46])


def piece_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of pieces that tokenize independently: those of documents, and the safe places inside them."""
    cut = np.zeros(len(data) + 1, bool)
    latin = np.zeros(len(data), bool)  # last bytes of U+00C0 to U+00FF
    latin[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80)
    cut[1:-1] = _BLANK[data[1:]] & (_VISIBLE[data[:-1]] | latin[:-1]) | _STOP[data[1:]] & _LETTER[data[:-1]]
    cut[offsets] = True
    cut[len(data)] = False
    return np.flatnonzero(cut)


class ByteLevelIds:
    """Token ids of whole texts as 32-bit integers, as a byte-level BPE file of `tokenizers` gives them.

    Each distinct piece of a batch is encoded once and remembered. ranks: the same vocabulary as a rank file of
    tiktoken, which encodes short pieces faster; pieces that may hold a special token always go to `tokenizers`.
    """

    def __init__(self, path: str, ranks: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import tokenizers

        self.library = tokenizers.Tokenizer.from_file(path)
        special = [re.escape(t.content.encode()) for t in self.library.get_added_tokens_decoder().values()]
        self.slow = re.compile(b"|".join([b"[\x1c-\x1f]", *special]))  # on U+001C to U+001F libraries differ
        self.fast = None
        if ranks:
            import tiktoken

            with open(ranks, "rb") as lines:
                table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})._core_bpe
        self._forget()

    def _forget(self) -> None:
        self.memo: dict[bytes, int] = {}
        self.pool, self.used = np.empty(1 << 16, "<u4"), 0
        self.first, self.length = np.empty(0, np.int64), np.empty(0, np.int64)

    def _encoded(self, piece: bytes) -> bytes:
        if self.fast is None or self.slow.search(piece):
            return np.asarray(self.library.encode(piece.decode(), add_special_tokens=False).ids, "<u4").tobytes()
        return bytes(self.fast.encode_to_tiktoken_buffer(piece.decode(), set()))

    def _places_of(self, pieces: list[bytes]) -> np.ndarray:
        """The number of each piece in what is remembered; unknown ones are learned."""
        memo, encoded, ids = self.memo, self._encoded, []
        known = np.fromiter(map(memo.get, pieces, repeat(-1)), np.int64, len(pieces))
        for k in np.flatnonzero(known < 0).tolist():
            known[k] = memo[pieces[k]] = len(memo)
            ids.append(encoded(pieces[k]))
        if ids:
            n = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
            ends = self.used + np.cumsum(n)
            self.first, self.length = np.concatenate([self.first, ends - n]), np.concatenate([self.length, n])
            if ends[-1] > len(self.pool):
                self.pool = np.resize(self.pool, 2 * ends[-1])
            self.pool[self.used : ends[-1]] = np.frombuffer(b"".join(ids), "<u4")
            self.used = int(ends[-1])
        return known

    def ids(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all documents, end to end, and where each document's begin (n + 1 places)."""
        if not len(data):
            return np.empty(0, "<u4"), np.zeros(len(offsets), np.int64)
        if len(self.memo) > MAX_MEMO:
            self._forget()
        starts = piece_starts(data, offsets)
        ends = np.append(starts[1:], len(data))
        tokens, lengths = [], []
        for a, b in runs_of_rows(np.append(starts, len(data)), STEP_BYTES):  # a long text goes by parts too
            # Arrow's dictionary compares bytes, so each distinct piece is one entry.
            bounds = np.append(starts[a:b], ends[b - 1]) - starts[a]
            part = data[starts[a] : ends[b - 1]]
            pieces = pa.Array.from_buffers(pa.large_binary(), b - a, [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(part.tobytes())]).dictionary_encode()
            k = self._places_of(pieces.dictionary.to_pylist())[pieces.indices.to_numpy()]
            n, first = self.length[k], self.first[k]
            upto = np.concatenate([[0], np.cumsum(n)])
            tokens.append(self.pool[np.arange(upto[-1]) + np.repeat(first - upto[:-1], n)])
            lengths.append(n)
        upto = np.concatenate([[0], np.cumsum(np.concatenate(lengths))])
        return np.concatenate(tokens), upto[np.searchsorted(starts, offsets)]


_ready: dict[str, ByteLevelIds] = {}


class LevelPacker:
    """Places rests of documents by the sum-of-squares rule; emit(sequence, pieces) gets every closed window."""

    def __init__(self, window: int, first: int, max_open: int = MAX_OPEN):
        self.window, self.next, self.max_open = window, first, max_open
        self.count = np.zeros(window + 1, np.int64)
        self.at_level: dict[int, list] = {}
        self.n_open = 0
        self.closed: list[tuple[int, list]] = []

    def _fresh(self) -> int:
        self.next += 1
        return self.next - 1

    def add(self, doc: tuple | int | None, ids: bytes) -> None:
        total, w = len(ids) // 4, self.window
        whole = total - total % w
        for start in range(0, whole, w):
            self.closed.append((self._fresh(), [(doc, start, ids[4 * start : 4 * (start + w)], total)]))
        if total > whole:
            self._place((doc, whole, ids[4 * whole :], total), total - whole)

    def best_level(self, s: int) -> int:
        """The level with the smallest rise of the sum of squares; ties to the fullest window, and 0 opens a new one."""
        n, w = self.count, self.window
        levels = np.flatnonzero(n[1 : w - s + 1]) + 1
        opening = 2 * n[s] + 1 if s < w else 0
        if not len(levels):
            return 0
        rise = 2 * (n[levels + s] - n[levels]) + 2
        if levels[-1] + s == w:
            rise[-1] = 1 - 2 * n[levels[-1]]
        k = len(rise) - 1 - int(np.argmin(rise[::-1]))
        return int(levels[k]) if rise[k] <= opening else 0

    def _place(self, piece: tuple, s: int) -> None:
        h = self.best_level(s)
        if h:
            self.count[h] -= 1
            window = self.at_level[h].pop()
        else:
            window = (self._fresh(), [])
            self.n_open += 1
        window[1].append(piece)
        if h + s == self.window:
            self.n_open -= 1
            self.closed.append(window)
        else:
            self.count[h + s] += 1
            self.at_level.setdefault(h + s, []).append(window)
        if self.n_open > self.max_open:
            self.close(last=False)

    def close(self, last: bool = True) -> None:
        """Fill the fullest open windows with cut pieces of the emptiest; the one that stays short closes with the last, else stays open."""
        open_ = [[level, *window] for level in sorted(self.at_level) for window in self.at_level[level]]
        self.count[:], self.n_open = 0, 0
        self.at_level.clear()
        low, high = 0, len(open_) - 1
        while low < high:
            donor, taker = open_[low], open_[high]
            doc, start, ids, total = donor[2].pop()
            take = min(self.window - taker[0], len(ids) // 4)
            taker[2].append((doc, start, ids[: 4 * take], total))
            if 4 * take < len(ids):
                donor[2].append((doc, start + take, ids[4 * take :], total))
            donor[0], taker[0] = donor[0] - take, taker[0] + take
            if taker[0] == self.window:
                self.closed.append((taker[1], taker[2]))
                high -= 1
            if not donor[2]:
                low += 1
        if low == high and last:
            self.closed.append((open_[low][1], open_[low][2]))
        elif low == high:
            level, sequence, pieces = open_[low]
            self.count[level], self.at_level[level], self.n_open = 1, [(sequence, pieces)], 1


def _arrow(closed: list[tuple[int, list]], more: list[str]) -> pa.RecordBatch:
    """Rows of SCHEMA and the further columns; a piece's document is its id and what it has in these."""
    rows = []
    for sequence, pieces in closed:
        offset = 0
        for (doc, *carried), start, ids, total in pieces:
            rows.append((doc, start, len(ids) // 4, ids, total, sequence, offset, *carried))
            offset += len(ids) // 4
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), *[pa.string()] * len(more)]
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", *more]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def pack_sum_of_squares(docs: DataFrame, *, window: int = WINDOW, tokenizer: str | None = None, ranks: str | None = None, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Pieces of token ids with their places in windows of at most `window` ids.

    tokenizer: path of a byte-level BPE file (of `tokenizers`) on the executors; ranks: its rank file, if there is
    one; end_id follows each document's ids. Null and empty texts are a piece of the one end id; repeated rows are
    packed each by itself; a document of any length is cut into full windows and a rest; an empty table gives no
    row. carry: string columns of docs that each piece has, too; others are not read. Sequence ids are gapless within a task's range and unique among all; they
    follow the partitions of docs.
    """
    if tokenizer is None:
        tokenizer, ranks = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
    bound_batches(docs.sparkSession)
    end = np.asarray([end_id], "<u4").tobytes()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _ready.get(tokenizer) or _ready.setdefault(tokenizer, ByteLevelIds(tokenizer, ranks))  # serves the worker's later tasks too
        packer = LevelPacker(window, TaskContext.get().partitionId() << 33)
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            names = list(zip(*(batch.column(c).to_pylist() for c in ("doc_id", *carry)), strict=True))
            for a, b in runs_of_rows(offsets, STEP_BYTES):
                tokens, first = encoder.ids(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                raw, first = tokens.tobytes(), (4 * first).tolist()
                for k in range(b - a):
                    packer.add(names[a + k], raw[first[k] : first[k + 1]] + end)
                if 4 * window * len(packer.closed) > OUT_BYTES:
                    yield _arrow(packer.closed, list(carry))
                    packer.closed.clear()
        packer.close()
        if packer.closed:
            yield _arrow(packer.closed, list(carry))

    rows = docs.select(*id_and_text_columns(id_col, text_col), *(F.col(c).cast("string").alias(c) for c in carry))
    return rows.mapInArrow(pack, ", ".join([SCHEMA, *(f"`{c}` string" for c in carry)]))


def piece_digests(pieces: DataFrame) -> DataFrame:
    """The columns of the contract: each piece's ids as a checksum."""
    return pieces.select("doc_id", "start", "length", unsigned_crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", F.col("offset"))
