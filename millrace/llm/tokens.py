"""Token counts by a compiled finite-state transducer.

A BPE encoding is fixed by its neighbours: a row of pieces is the encoding of its text if, and only if, each two
neighbouring pieces are the encoding of their own text. So each prefix of a text has one last piece, and that
depends only on the last pieces of the prefixes from which a piece still can reach the end. These, with the
counts up to them relative to the count here, are the transducer's state; a transition on a character carries the
number of tokens it adds (which may be negative, as a longer piece can replace several). States and transitions
are compiled from the vocabulary when first met.

Texts are cut into chunks, and a chunk is a map from entry state to (exit state, tokens). No piece has white space
after another character, so a chunk that begins with white space resets the state: its map is a constant. Most chunks
are such words, equal ones of a batch are one entry of an Arrow dictionary, and only entries are run. A longer word is
cut every CHUNK characters; the maps of its chunks compose by a prefix scan in rounds of neighbours. As the states are
without number, a map holds those entries it was asked for: first the state that the characters before the chunk lead
to from a reset, which is nearly always right, and any other when a composition brings it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm._common import bound_batches, buffers, id_and_text, runs_of_rows

SPACE = "▁"
#: Characters of a chunk inside a word, and characters before it from which its first entry state is guessed.
CHUNK, BEFORE = 64, 24
#: Words, states and pairs a worker keeps before it starts afresh.
MAX_WORDS, MAX_STATES, MAX_PAIRS = 600_000, 400_000, 600_000
LIMIT = 4096
#: Bytes of text cut into words at a time.
STEP_BYTES = 8 << 20

START = (("", None, 0),)
_ready: dict[str, "PieceTransducer"] = {}


class ChunkMap:
    """The map of one chunk: its text, and (exit state, tokens) by entry state as far as known."""

    __slots__ = ("known", "text", "transducer")

    def __init__(self, transducer: PieceTransducer, text: str):
        self.transducer, self.text, self.known = transducer, text, {}

    def at(self, state: dict) -> tuple[dict, int]:
        if (found := self.known.get(id(state))) is None:
            found = self.known[id(state)] = self.transducer.run(state, self.text)
        return found


class Composed:
    """The map of two neighbouring maps, one after the other."""

    __slots__ = ("known", "left", "right")

    def __init__(self, left: ChunkMap | Composed, right: ChunkMap | Composed):
        self.left, self.right, self.known = left, right, {}

    def at(self, state: dict) -> tuple[dict, int]:
        if (found := self.known.get(id(state))) is None:
            middle, n = self.left.at(state)
            out, more = self.right.at(middle)
            found = self.known[id(state)] = out, n + more
        return found


class PieceTransducer:
    """Counts tokens as a sentencepiece BPE model with byte fallback, identity normalizer and dummy prefix gives them."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.score = {model.id_to_piece(i): model.get_score(i) for i in plain}
        inner = [p for p in self.score if SPACE in p.lstrip(SPACE)]
        if inner:
            raise ValueError(f"pieces with white space inside: {inner[:3]}")
        self.chars = {p for p in self.score if len(p) == 1}
        self.prefixes = {piece[:k] for piece in self.score for k in range(1, len(piece))}
        in_order = sorted(self.score.values(), reverse=True)
        rank_of = dict(zip(in_order, range(len(in_order)), strict=True))
        rank = {p: rank_of[s] for p, s in self.score.items()}
        self.made = {p: -1 if len(p) == 1 else r for p, r in rank.items()}
        #: Rank of the piece that two pieces make together, by the first and then the second.
        self.joins: dict[str, dict[str, int]] = {p: {} for p in self.score}
        for piece, r in rank.items():
            for k in range(1, len(piece)):
                if piece[:k] in self.score and piece[k:] in self.score:
                    self.joins[piece[:k]][piece[k:]] = r
        #: Pieces whose rows of white space share one score, where ties to the left decide.
        self.tied = {p for p in self.score if p.startswith(SPACE * 2)}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.halves: dict[str, list[str]] = {}
        self.words: dict[bytes, int] = {}
        self._reset()

    def _reset(self) -> None:
        """A state is a dict: its arcs by character, and under the empty string what it stands for."""
        self.start: dict = {"": START}
        self.states: dict[tuple, dict] = {START: self.start}

    def merged(self, text: str, until: int = 1) -> list[str]:
        """The encoding of a short text by the merges themselves, or `until` parts of it: best score first, ties to the left."""
        parts = list(text)
        while len(parts) > until:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _split(self, piece: str) -> list[str]:
        """The two parts that the last merge joins to the piece; more than two if the merges don't lead there."""
        if piece not in self.halves:
            self.halves[piece] = self.merged(piece, 2)
        return self.halves[piece]

    def _neighbours(self, a: str, b: str) -> bool:
        """Whether no merge across the border comes before those that make a and b; seen backwards from the last merges."""
        if a in self.tied or b in self.tied or a == SPACE:
            return self.merged(a + b) == [a, b]
        made, joins, limit = self.made, self.joins, 1 << 30
        from_a, made_a, made_b = joins[a], made[a], made[b]
        while True:
            if from_a.get(b, limit) < limit:
                return False
            if made_a > made_b:
                limit = made_a
                a = self._split(a)[1]
                from_a, made_a = joins[a], made[a]
            elif made_b < 0:
                return True
            else:
                limit = made_b + 1
                b = self._split(b)[0]
                made_b = made[b]

    def _fits(self, last: str | None, piece: str) -> bool:
        if last is not None and (found := self.pairs.get((last, piece))) is not None:
            return found
        reached = len(piece) == 1 or len(self._split(piece)) == 2
        if last is None:
            return reached
        if len(self.pairs) > MAX_PAIRS:
            self.pairs.clear()
        found = self.pairs[last, piece] = reached and self._neighbours(last, piece)
        return found

    def _compile(self, state: dict, c: str) -> tuple[dict, int]:
        if c not in self.chars:
            target, emitted = START, len(c.encode())
        else:
            last, emitted, grown = None, 0, []
            for s, before, count in state[""]:
                s += c
                if last is None and s in self.score and self._fits(before, s):
                    last, emitted = s, count + 1
                if s in self.prefixes:
                    grown.append((s, before, count))
            target = (*((s, before, count - emitted) for s, before, count in grown), ("", last, 0))
        arc = state[c] = (self.states.setdefault(target, {"": target}), emitted)
        return arc

    def run(self, state: dict, text: str) -> tuple[dict, int]:
        """Exit state and tokens of a text without a reset inside, from a state."""
        total = 0
        for c in text:
            state, n = state.get(c) or self._compile(state, c)
            total += n
        return state, total

    def count_word(self, word: str, chunk: int = CHUNK) -> int:
        """Tokens of a word: white space, and what follows up to the next."""
        maps: list[ChunkMap | Composed] = []
        for at in range(0, len(word), chunk):
            maps.append(ChunkMap(self, word[at : at + chunk]))
            maps[-1].at(self.run(self.start, word[max(at - BEFORE, 0) : at])[0])
        while len(maps) > 1:
            maps = [Composed(*maps[at : at + 2]) if at + 1 < len(maps) else maps[at] for at in range(0, len(maps), 2)]
        return maps[0].at(self.start)[1] if maps else 0

    def count_words(self, words: list[bytes], chunk: int = CHUNK) -> np.ndarray:
        """Tokens of each word, whose white space is spaces; those of one chunk are remembered."""
        out, memo = np.empty(len(words), np.int64), self.words
        if len(memo) > MAX_WORDS:
            memo.clear()
        for k, word in enumerate(words):
            if (n := memo.get(word)) is None:
                if len(self.states) > MAX_STATES:
                    self._reset()
                text = word.decode().replace(" ", SPACE)
                if len(text) <= chunk:
                    n = memo[word] = self.run(self.start, text)[1]
                else:
                    n = self.count_word(text, chunk)
            out[k] = n
        return out

    def count_texts(self, texts: pa.Array, chunk: int = CHUNK) -> np.ndarray:
        """Tokens of each whole text of a string array without nulls."""
        data, offsets = buffers(pc.replace_substring(texts, SPACE, " "))
        counts = np.zeros(len(offsets) - 1, np.int64)
        for a, b in runs_of_rows(offsets, STEP_BYTES):
            own = offsets[a : b + 1] - offsets[a]
            full = np.flatnonzero(np.diff(own))
            # A space before each text that isn't empty, as the model adds one.
            spaced = np.insert(data[offsets[a] : offsets[b]], own[full], 32)
            blank = spaced == 32
            begins = blank.copy()
            begins[1:] &= ~blank[:-1]
            begins[own[full] + np.arange(len(full))] = True
            starts = np.flatnonzero(begins)
            ends = np.append(starts, len(spaced))
            words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(spaced.tobytes())]).dictionary_encode()
            n = self.count_words(words.dictionary.to_pylist(), chunk)[words.indices.to_numpy()]
            if len(full):
                counts[a + full] = np.add.reduceat(n, np.searchsorted(starts, own[full] + np.arange(len(full))))
        return counts

    def count(self, text: str, chunk: int = CHUNK) -> int:
        """Tokens of one whole text."""
        return int(self.count_texts(pa.array([text]), chunk)[0])


def count_tokens(docs: DataFrame, *, tokenizer: str | None = None, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every whole text.

    tokenizer: path of a sentencepiece BPE model on the executors. Null and empty texts have 0 bytes and 0 tokens; a
    text of any length is counted whole, in one task; repeated rows give repeated rows; an empty table gives none.
    Other columns are not read.
    """
    path = tokenizer or public_tokenizers.path("piece_bpe_32k.model")
    bound_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # What a worker process has compiled serves its later tasks.
        transducer = _ready.get(path) or _ready.setdefault(path, PieceTransducer(path))
        for batch in batches:
            n = transducer.count_texts(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pc.binary_length(batch.column("text")).cast(pa.int64()), pa.array(n)], ["doc_id", "n_bytes", "n_tokens"])

    counted = id_and_text(docs, id_col, text_col).mapInArrow(count, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
