"""Token counts by a compiled finite-state tokenizer (byte-level BPE with the usual split into pieces).

Compilation, on the driver: the vocabulary file's split rule becomes a deterministic transducer over classes of code points.
Its transitions say whether a piece begins at the current or the previous character; the piece a transition closes emits the
number of tokens that its merges leave. Counting: a stream of texts is cut into chunks of equal length, each chunk's map from
entry to exit state is computed for all states at once, the maps are composed by a parallel prefix scan, and a second pass from
the now known states marks the pieces. Pieces are counted once per distinct piece of a slice; nothing is truncated.

A null text is empty and has no tokens. Empty input gives no rows; extra columns pass through; ``n_bytes`` and ``n_tokens`` of
the input, if any, are replaced.
"""
from __future__ import annotations

import heapq
import json
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventloom.llm.arrays import buffers, slices
from eventloom.llm.shared import shared

CHUNK = 512
SLICE = 1 << 21
#: Distinct pieces whose counts a Python worker remembers; more are counted again.
REMEMBERED = 400_000
END = 0x110000

# classes of characters: other letters, digits, other, apostrophe, space, other white space, letters of contractions, end
LETTER, DIGIT, OTHER, QUOTE, SPACE, WHITE, STMD, RV, E, L, STOP = range(11)
# states: what the piece so far is
START, IN_LETTERS, IN_DIGITS, IN_OTHER, QUOTED, QUOTED_RV, QUOTED_L, CONTRACTED, SPACE_1, WHITE_1, SPACE_N, WHITE_N = range(12)
BEGINS, BEGAN = 1, 2   # a piece begins at this character; one began at the character before


def _transition(state: int, c: int) -> tuple[int, int]:
    letter = c in (LETTER, STMD, RV, E, L)
    white = c in (SPACE, WHITE)
    if c == STOP:
        return START, BEGINS | (BEGAN if state in (QUOTED_RV, QUOTED_L) else 0)
    if state == QUOTED:
        if c in (STMD, RV, L):
            return {STMD: CONTRACTED, RV: QUOTED_RV, L: QUOTED_L}[c], 0
        state = IN_OTHER
    elif (state, c) in ((QUOTED_RV, E), (QUOTED_L, L)):
        return CONTRACTED, 0
    elif state in (QUOTED_RV, QUOTED_L):      # no contraction: the letter began a piece after all
        to, out = _transition(IN_LETTERS, c)
        return to, out | BEGAN
    if white and state in (SPACE_1, WHITE_1, SPACE_N, WHITE_N):
        return (SPACE_N if c == SPACE else WHITE_N), 0
    if white:
        return (SPACE_1 if c == SPACE else WHITE_1), BEGINS
    own = IN_LETTERS if letter else IN_DIGITS if c == DIGIT else IN_OTHER
    if state in (SPACE_1, SPACE_N):           # the last space of a run goes with what follows
        return own, (BEGAN if state == SPACE_N else 0)
    if state == own:
        return own, 0
    return (QUOTED if c == QUOTE else own), BEGINS | (BEGAN if state == WHITE_N else 0)


def _classes(split) -> np.ndarray:
    """The class of each code point, as the library's own split shows it: which neighbour it stays with."""
    out = np.full(END + 1, WHITE, np.uint8)
    for lo in range(0, END, 1 << 16):
        points = [p for p in range(lo, lo + (1 << 16)) if not 0xD800 <= p < 0xE000]
        if not points:
            continue
        for before, kind in (("a", LETTER), ("1", DIGIT), ("!", OTHER)):
            after = "!" if kind != OTHER else "a"
            begins = {a for _, (a, _) in split("".join(before + chr(p) + after for p in points))}
            out[[p for i, p in enumerate(points) if 3 * i + 1 not in begins]] = kind
    for chars, kind in (("'", QUOTE), (" ", SPACE), ("stmd", STMD), ("rv", RV), ("e", E), ("l", L)):
        out[[ord(x) for x in chars]] = kind
    out[END] = STOP
    return out


class Transducer:
    """The compiled tokenizer: tables of a bounded size (code points, states, merges), sent to the executors once."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        spec = json.load(open(path, encoding="utf-8"))
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in merges]
        library = Tokenizer.from_file(path)
        self.classes = _classes(library.pre_tokenizer.pre_tokenize_str)
        self.special = [t["content"].encode() for t in spec["added_tokens"]]
        tables = np.zeros((2, 256), np.uint8)
        for s in range(12):
            for c in range(11):
                to, out = _transition(s, c)
                tables[0, s << 4 | c], tables[1, s << 4 | c] = to << 4, out
        self.next, self.out = tables[0].tobytes(), tables[1].tobytes()
        # bytes stand in the vocabulary as printable characters
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        shown = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(plain))}
        self.byte = [vocab[shown[b]] for b in range(256)]
        self.rank = {vocab[a] << 20 | vocab[b]: i for i, (a, b) in enumerate(merges)}
        self.made = [vocab[a + b] for a, b in merges]
        self.known: dict[bytes, int] = {}

    def pieces(self, classes: np.ndarray) -> np.ndarray:
        """Where pieces begin in a stream of character classes."""
        n = len(classes)
        k = -(-n // CHUNK)
        padded = np.full(k * CHUNK, STOP, np.uint8)
        padded[:n] = classes
        steps = np.ascontiguousarray(padded.reshape(k, CHUNK).T)
        state = np.tile(np.arange(12, dtype=np.uint8) << 4, (k, 1))
        for c in steps:
            state = np.frombuffer((state | c[:, None]).tobytes().translate(self.next), np.uint8).reshape(k, 12)
        maps, reach = (state >> 4).astype(np.intp), 1
        while reach < k:                       # maps[i] becomes the map of all chunks up to i
            later = maps.copy()
            later[reach:] = np.take_along_axis(maps[reach:], maps[:-reach], 1)
            maps, reach = later, 2 * reach
        state = np.concatenate([[START], maps[:-1, START]]).astype(np.uint8) << 4
        taken = np.empty((CHUNK, k), np.uint8)
        for i, c in enumerate(steps):
            taken[i] = state | c
            state = np.frombuffer(taken[i].tobytes().translate(self.next), np.uint8)
        out = np.frombuffer(np.ascontiguousarray(taken.T).tobytes().translate(self.out), np.uint8)
        begins = (out & BEGINS).astype(bool)
        begins[:-1] |= (out[1:] & BEGAN).astype(bool)
        return begins[:n]

    def tokens(self, piece: bytes) -> int:
        """Tokens of a piece after all merges, lowest rank first, leftmost first."""
        ids, rank = [self.byte[b] for b in piece], self.rank
        if len(ids) > 48:
            return self._tokens_long(ids)
        while len(ids) > 1:
            best, at = 1 << 30, -1
            for i in range(len(ids) - 1):
                r = rank.get(ids[i] << 20 | ids[i + 1], 1 << 30)
                if r < best:
                    best, at = r, i
            if at < 0:
                break
            ids[at:at + 2] = [self.made[best]]
        return len(ids)

    def _tokens_long(self, ids: list[int]) -> int:
        n, left = len(ids), len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := self.rank.get(ids[i] << 20 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = self.made[r], -1, after[j]
            left -= 1
            if after[i] < n:
                before[after[i]] = i
            for x in (before[i], i):
                if x >= 0 and after[x] < n and (r := self.rank.get(ids[x] << 20 | ids[after[x]])) is not None:
                    heapq.heappush(heap, (r, x, ids[x], ids[after[x]]))
        return left

    def _count(self, piece: bytes) -> int:
        n = self.known.get(piece)
        if n is None:
            n = self.tokens(piece)
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            if len(piece) <= 64:
                self.known[piece] = n
        return n

    def count(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Tokens of each text of a slice."""
        n = len(offsets) - 1
        if not len(data):
            return np.zeros(n, np.int64)
        raw = data.tobytes()
        points = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
        chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]    # where each text begins
        classes = self.classes[points]
        extra = np.zeros(n, np.int64)
        for s in self.special:
            at = raw.find(s)
            while at >= 0:
                row = int(np.searchsorted(offsets, at, "right")) - 1
                if at + len(s) <= offsets[row + 1]:
                    extra[row] += 1
                    lo = int(np.count_nonzero((data[:at] & 0xC0) != 0x80))
                    classes[lo:lo + len(s.decode())] = STOP
                    at = raw.find(s, at + len(s))
                else:
                    at = raw.find(s, at + 1)
        stream = np.insert(classes, chars[1:-1], STOP)
        width = np.insert(1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF), chars[1:-1], 0)
        begins = np.flatnonzero(self.pieces(stream) & (width > 0))
        place = np.cumsum(width)[begins] - width[begins]
        ends = pa.py_buffer(np.append(place, len(raw)).astype(np.int32))
        coded = pa.Array.from_buffers(pa.binary(), len(begins), [None, ends, pa.py_buffer(raw)]).dictionary_encode()
        each = np.fromiter(map(self._count, coded.dictionary.to_pylist()), np.int64, len(coded.dictionary))
        of = each[coded.indices.to_numpy()]
        of[stream[begins] == STOP] = 0
        return np.add.reduceat(np.append(of, 0), np.searchsorted(place, offsets[:-1])) * (np.diff(offsets) > 0) + extra


@cache
def compiled(path: str) -> Transducer:
    return Transducer(path)


def count_tokens(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """The rows of ``docs`` with ``n_bytes`` and ``n_tokens``; ``path``: the tokenizer's file, read by the driver."""
    model = shared(docs.sparkSession, compiled(path))
    kept = [c for c in docs.columns if c not in ("n_bytes", "n_tokens")]
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def counted(batches):
        transducer = model()
        for b in batches:
            data, at = buffers(b.column(text))
            n = np.zeros(b.num_rows, np.int64)
            for lo, hi in slices(at, SLICE):
                n[lo:hi] = transducer.count(data[at[lo]:at[hi]], at[lo:hi + 1] - at[lo])
            yield pa.RecordBatch.from_arrays([b.column(c) for c in kept] + [pa.array(np.diff(at)), pa.array(n)], names=[*kept, "n_bytes", "n_tokens"])

    return docs.mapInArrow(counted, schema)
