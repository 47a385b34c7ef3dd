"""Sum-of-squares online packing of tokenised documents into windows of fixed length.

A document's ids are cut into whole windows and a rest. A whole window is a sequence by itself. The rest of s tokens goes
where the sum of squares of N(h) over all levels h becomes least, N(h) being how many windows are filled to h: into a window of
level h, which turns N(h) into N(h)-1 and N(h+s) into N(h+s)+1, or into a new window (h = 0). ``Levels`` holds N and the open
windows of each level. Windows leave as soon as they are full. When a task has read all of its rows, or holds ``open_limit`` open windows,
the open ones are closed by cutting pieces freely so that they fill each other: at the end, a task leaves one padded window at most.

Each task packs its own rows, so nothing is shuffled and memory is bounded by the open windows. The sequence number holds the task's
partition number in its upper bits; the rows of a scanned partition come in the same order when a lost task runs again.

Ids come from a public tokenizer whose pre-tokenizer never joins a visible character with white space after it. So a text may be cut
before each run of white space, and each distinct cut of a batch is encoded once.
"""

from __future__ import annotations

import json
import re
from functools import cached_property
from itertools import pairwise
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintmill.llm.common import mapped

CAPACITY = 1024
END_ID = 0
OPEN_LIMIT = 4096
EMIT_IDS = 1 << 20
#: So many texts are encoded at once.
ENCODE_ROWS = 512
PIECES = "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"

#: White_Space of Unicode, as the tokenizer's own pattern has it. Fixed values.
_WS = "\t-\r \x85\xa0  -     　"
#: How byte-level vocabularies of this kind are cut before merging. Fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_SPACE = re.compile(f"[{_WS}]")
_ENDS = frozenset(["", *(chr(c) for c in range(0x3001) if _SPACE.match(chr(c)))])
_CUT = re.compile(f"[{_WS}]*[^{_WS}]+|[{_WS}]+")


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit integers, equal to those of the tokenizer file.

    Texts are cut at blanks, and all distinct words of a batch, each with a blank before it, are encoded as one text by a second implementation of
    byte-level BPE, which takes the same vocabulary and is faster; a word's ids begin with the one id that starts with a blank. Words with a special
    token's string, and files of another kind, go to the tokenizer itself. Nothing is kept from batch to batch.
    """

    def __init__(self, path: str, end_id: int = END_ID):
        self.path = path
        self.end = np.array([end_id], dtype="<u4")
        spec = json.loads(Path(path).read_text())
        self.special = [x["content"] for x in spec["added_tokens"]]
        plain = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
        self.cuts = spec["normalizer"] is None and spec["model"]["type"] == "BPE" and plain.items() <= (spec["pre_tokenizer"] or {}).items()
        if self.cuts:
            import tiktoken

            vocabulary, shown = spec["model"]["vocab"], _shown_bytes()
            ranks = {bytes(shown[c] for c in token): i for token, i in vocabulary.items() if token not in self.special}
            self.fast = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
            self.blank = np.zeros(max(ranks.values()) + 1, dtype=bool)
            self.blank[[i for token, i in ranks.items() if token[:1] == b" "]] = True

    @cached_property
    def tokenizer(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def encode(self, texts: pa.Array | list[str | None]) -> list[bytes]:
        """The ids of each text and one end id; a null text is empty."""
        texts = pc.fill_null(pa.array(texts, pa.string()) if isinstance(texts, list) else texts, "")
        if not self.cuts:
            return [np.array([*e.ids, *self.end], dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
        if not len(texts):
            return []
        lists = pc.split_pattern(texts, " ")
        at = lists.offsets.to_numpy().astype(np.int64)
        coded = lists.values.slice(at[0], at[-1] - at[0]).dictionary_encode()
        at -= at[0]
        code, distinct, first = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist(), at[:-1]
        opening = coded.dictionary.take(coded.indices.take(pa.array(first))).to_pylist()
        # the next blank begins a run of white space only if no white space is before it
        open_end = np.fromiter((x[-1:] in _ENDS for x in distinct), dtype=bool, count=len(distinct))
        loose = open_end[code]
        loose[at[1:] - 1] = False
        loose[first] &= np.fromiter(map(bool, opening), dtype=bool, count=len(opening))
        odd = np.add.reduceat(loose, first) > 0
        # entries: the distinct words after a blank, each text's beginning, none, and the end
        flat, size = self._words(distinct, open_end)
        begun = [self._cut(texts[i].as_py()) if odd[i] else self._cut(x) for i, x in enumerate(opening)]
        flat = np.concatenate([flat, *begun, self.end])
        size = np.concatenate([size, np.fromiter(map(len, begun), dtype=np.int64, count=len(begun)), [0, 1]])
        code[np.repeat(odd, np.diff(at))] = len(size) - 2
        code[first] = len(distinct) + np.arange(len(opening))
        code = np.insert(code, at[1:], len(size) - 1)
        length = size[code]
        stop = np.cumsum(length)
        ids = flat[np.repeat((np.cumsum(size) - size)[code] - (stop - length), length) + np.arange(stop[-1])].astype("<u4").tobytes()
        edge = (np.concatenate([[0], stop[at[1:] + np.arange(len(opening))]]) * 4).tolist()
        return [ids[x:y] for x, y in pairwise(edge)]

    def _words(self, distinct: list[str], open_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of each word after a blank, in turn, and how many each has."""
        joined = " " + " ".join(distinct) if distinct else ""
        if open_end.any() or any(x in joined for x in self.special):
            alone = [i for i, x in enumerate(distinct) if open_end[i] or any(s in x for s in self.special)]
            left = open_end.copy()
            left[alone] = True
            ids, size = self._words([x for x, no in zip(distinct, left, strict=True) if not no], np.zeros(0, dtype=bool))
            parts, sizes = dict(zip(alone, (self._cut(" " + distinct[i]) for i in alone), strict=True)), np.zeros(len(distinct), dtype=np.int64)
            sizes[~left] = size
            places = (np.cumsum(sizes) - sizes)[alone]
            for i, part in parts.items():
                sizes[i] = len(part)
            return np.insert(ids, np.repeat(places, sizes[alone]), np.concatenate(list(parts.values()))), sizes
        ids = np.asarray(self.fast.encode_to_numpy(joined, disallowed_special=()))
        starts = np.flatnonzero(self.blank[ids])
        if len(starts) != len(distinct):
            raise ValueError("this vocabulary has no id that begins with a blank for some word")
        return ids, np.diff(np.append(starts, len(ids)))

    def _cut(self, text: str) -> np.ndarray:
        return np.array([i for x in _CUT.findall(text) for i in self._ids(x)], dtype="<u4")

    def _ids(self, cut: str) -> list[int]:
        if any(x in cut for x in self.special):
            return self.tokenizer.encode(cut, add_special_tokens=False).ids
        return self.fast.encode_ordinary(cut)


def _shown_bytes() -> dict[str, int]:
    """How byte-level vocabularies write bytes: printable Latin-1 characters as themselves, the others from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Levels:
    """Open windows by fill level, and where the next rest goes."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.count = np.zeros(capacity + 1, dtype=np.int64)
        self.windows: list[list[list]] = [[] for _ in range(capacity + 1)]
        self.open = 0

    def place(self, piece: tuple, s: int) -> list | None:
        """Put a piece of s < capacity ids in; gives the window if it is full then."""
        n, c = self.count, self.capacity
        # growth of the sum of squares for each level h in 1..c-s, up to a common factor of 2
        growth = n[1 + s : c + 1] - n[1 : c - s + 1] + 1
        growth[-1] = -n[c - s]  # a full window is no level any more: its square falls by 2 N - 1
        growth = np.where(n[1 : c - s + 1] > 0, growth, np.iinfo(np.int64).max)
        best = int(growth.argmin())
        level = best + 1 if growth[best] <= n[s] else 0
        window = self.windows[level].pop() if level else []
        if level:
            n[level] -= 1
            self.open -= 1
        window.append((piece, level))
        if level + s == c:
            return window
        self.windows[level + s].append(window)
        n[level + s] += 1
        self.open += 1
        return None

    def drain(self) -> list[tuple]:
        """All pieces of the open windows, fullest windows first; none stays open."""
        out = [p for level in range(self.capacity, 0, -1) for window in self.windows[level] for p, _ in window]
        self.windows = [[] for _ in range(self.capacity + 1)]
        self.count[:] = 0
        self.open = 0
        return out


class Packer:
    """Turns (doc id, ids) into rows of PIECES."""

    def __init__(self, partition: int, capacity: int = CAPACITY, open_limit: int = OPEN_LIMIT):
        self.capacity, self.open_limit = capacity, open_limit
        self.levels, self.next_sequence = Levels(capacity), partition << 36
        self.rows: list[tuple] = []

    def _sequence(self, pieces: list[tuple[tuple, int]]) -> None:
        for (doc, start, ids, total), offset in pieces:
            self.rows.append((doc, start, len(ids) // 4, ids, total, self.next_sequence, offset))
        self.next_sequence += 1

    def add(self, doc: int | None, ids: bytes) -> None:
        c, total = self.capacity, len(ids) // 4
        for start in range(0, total, c):
            piece = (doc, start, ids[4 * start : 4 * (start + c)], total)
            if start + c <= total:
                self._sequence([(piece, 0)])
            elif window := self.levels.place(piece, total - start):
                self._sequence(window)
        if self.levels.open >= self.open_limit:
            self.close()

    def close(self) -> None:
        """Fill the open windows from each other, cutting freely."""
        window, fill = [], 0
        for doc, start, ids, total in self.levels.drain():
            while ids:
                part, ids = ids[: 4 * (self.capacity - fill)], ids[4 * (self.capacity - fill) :]
                window.append(((doc, start, part, total), fill))
                start, fill = start + len(part) // 4, fill + len(part) // 4
                if fill == self.capacity:
                    self._sequence(window)
                    window, fill = [], 0
        if window:
            self._sequence(window)


def _batch(rows: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
    kinds = [id_type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    columns = zip(*rows, strict=True) if rows else [[] for _ in kinds]
    return pa.RecordBatch.from_arrays([pa.array(list(c), type=k) for c, k in zip(columns, kinds, strict=True)], names=names)


def pack(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, open_limit: int = OPEN_LIMIT) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    A null or empty text is the end id alone. Repeated rows are packed each by itself. An empty table gives no pieces. Other
    columns of ``docs`` are not read.
    """

    def run(batches):
        packer, encoder = Packer(TaskContext.get().partitionId(), capacity, open_limit), Encoder(tokenizer_path)
        held = 0
        for batch in batches:
            names, texts = batch.column(0).to_pylist(), batch.column(1)
            step = ENCODE_ROWS
            for at in range(0, len(names), step):
                for name, ids in zip(names[at : at + step], encoder.encode(texts.slice(at, step)), strict=True):
                    packer.add(name, ids)
                    held += len(ids) // 4
                if held >= EMIT_IDS:
                    yield _batch(packer.rows, pa.int64())
                    packer.rows, held = [], 0
        packer.close()
        yield _batch(packer.rows, pa.int64())

    return mapped(docs.select(F.col(id_col).cast("bigint"), F.col(text_col).cast("string")), run, PIECES)
