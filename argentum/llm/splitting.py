"""Splitting long documents into pieces of limited size where the text pauses.

Agglomerative merging: a text falls into atoms at its pauses, and neighbouring
atoms are merged again, across the weakest pause first and among equal ones the
smallest pair first, as long as the merged piece fits. What remains are cuts at
the strongest pauses. Only atoms that alone are too large fall apart at weaker
pauses: paragraph, line, sentence, clause, word, and at last between any two
characters that the tokenizer separates.

A piece after the first begins with the last tokens of the piece before it.
Sizes are those of a piece's own text: each piece is encoded again, and one
that is too large is split further.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from argentum.llm import tokens
from argentum.session import ship

#: Tokens within which a piece that shares tokens looks for a better beginning.
BACK = 8
SCHEMA = "limit_name string, doc_id bigint, piece int, text string, tokens int, shared int"

# Where texts pause, from the strongest pause to the weakest; a cut is at the end of a match.
PAUSES = tuple(
    re.compile(p)
    for p in (
        r"(?:\r?\n[^\S\n]*){2,}|\r{2,}|\f",
        r"\r\n|[\n\r\u0085\u2028\u2029]",
        r"[.!?…]+[\"'”’»)\]]*(?=\s)|[。！？]+[」』）]*",
        r"[,;:)\]–—]+(?=\s)|[、，；：]",
        r"\S(?=\s)",
    )
)


class Text:
    """A text with its tokens, the byte that each token begins at, and the characters that tokens begin with."""

    def __init__(self, text: str, encode, widths: np.ndarray):
        self.text, raw = text, text.encode("utf-8", "surrogatepass")
        self.ids = encode(text)
        ends = np.concatenate(([0], np.cumsum(widths[np.asarray(self.ids, dtype=np.int64)]))) if self.ids else np.zeros(1, np.int64)
        begins = np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)
        self.chars = np.searchsorted(begins, ends)  # the character at each token's beginning, where one begins there
        whole = np.append(begins, len(raw))
        self.whole = whole[np.minimum(self.chars, len(whole) - 1)] == ends  # whether a character begins there

    def slice(self, a: int, b: int) -> str:
        return self.text[self.chars[a] : self.chars[b]]


def pauses(text: Text) -> list[np.ndarray]:
    """The token positions of the pauses of each strength, the strongest first; last those between any two characters."""
    out = []
    inner = np.flatnonzero(text.whole[1:-1]) + 1
    for pattern in PAUSES:
        at = np.unique(np.fromiter((m.end() for m in pattern.finditer(text.text)), dtype=np.int64))
        out.append(inner[np.isin(text.chars[inner], at)])
    return [*out, inner]


def atoms(size: int, levels: list[np.ndarray], room: int) -> list[tuple[int, int]]:
    """The inner borders of the atoms with the strength of each: the smaller, the stronger."""
    borders: list[tuple[int, int]] = []
    large = [(0, size)]
    for level, at in enumerate(levels):
        rest = []
        for a, b in large:
            own = at[np.searchsorted(at, a, "right") : np.searchsorted(at, b, "left")].tolist()
            borders += [(x, level) for x in own]
            rest += [(x, y) for x, y in zip([a, *own], [*own, b], strict=True) if y - x > room]
        large = rest
        if not large:
            break
    return sorted(borders)


def merge(size: int, borders: list[tuple[int, int]], room: int) -> list[int]:
    """The borders that remain when all that fit into room are merged."""
    n = len(borders)
    at = [0, *(b for b, _ in borders), size]
    before, after, gone = list(range(-1, n + 1)), list(range(1, n + 3)), [False] * (n + 2)
    heap = [(-borders[i - 1][1], at[i + 1] - at[i - 1], i) for i in range(1, n + 1)]
    heapq.heapify(heap)
    while heap:
        strength, width, i = heapq.heappop(heap)
        now = at[after[i]] - at[before[i]]
        if gone[i] or now > room:
            continue
        if now > width:  # a neighbour has grown since
            heapq.heappush(heap, (strength, now, i))
            continue
        gone[i] = True
        after[before[i]], before[after[i]] = after[i], before[i]
    return [at[i] for i in range(1, n + 1) if not gone[i]]


def split(text: str, capacity: int, overlap: int, encode, widths: np.ndarray) -> list[tuple[str, int, int]]:
    """text, tokens, shared of the pieces of a text; none if it is within the capacity.

    shared: the tokens of the piece before that it begins with, overlap or the
    few more that make it begin with a whole character and the same tokens.
    """
    known = Text(text, encode, widths)
    size = len(known.ids)
    if size <= capacity:
        return []
    levels = pauses(known)

    def ranges(a: int, b: int, room: int, first: bool = False) -> list[tuple[int, int]]:
        cuts = [a + c for c in merge(b - a, atoms(b - a, [x[(x > a) & (x < b)] - a for x in levels], room), room)]
        if first and cuts and cuts[0] < overlap and (cuts[1:2] or [b])[0] <= capacity:  # too short to be shared
            cuts = cuts[1:]
        return list(zip([a, *cuts], [*cuts, b], strict=True))

    todo, out, begin = ranges(0, size, capacity - overlap, True)[::-1], [], 0
    while todo:
        a, b = todo.pop()
        start = shared_from(known, begin, a, overlap, encode)
        piece = known.slice(start, b)
        count = len(encode(piece))
        if count <= capacity:
            out.append((piece, count, a - start))
            begin = start
            continue
        finer = ranges(a, b, b - a - 1)
        if len(finer) < 2:
            raise ValueError(f"no split within {capacity} tokens")
        todo += finer[::-1]
    return out


def shared_from(text: Text, begin: int, a: int, overlap: int, encode) -> int:
    """Where the piece that goes on at a begins: at the last whole character that leaves overlap tokens before a.

    Within BACK tokens before it, a place from which the tokens are the same
    when encoded alone is preferred.
    """
    if not a or not overlap:
        return a
    whole = [s for s in range(max(begin, a - overlap), max(begin, a - overlap - BACK) - 1, -1) if text.whole[s]]
    return next((s for s in whole if encode(text.slice(s, a)) == text.ids[s:a]), whole[0] if whole else a)


def pieces(documents: DataFrame, limits: DataFrame, path: str = tokens.TOKENIZER) -> DataFrame:
    """limit_name, doc_id, piece, text, tokens, shared of every document that exceeds a `split` capacity.

    Pieces are numbered from 0 in the order of the text; without what they
    share, they make up the whole text. Null and empty texts and those within
    the capacity give no rows.
    """
    wanted = [(r[0], int(r[1]), int(r[2] or 0)) for r in limits.filter("purpose = 'split' and capacity_tokens > 0").select("limit_name", "capacity_tokens", "overlap_tokens").orderBy("limit_name").collect()]
    for name, capacity, overlap in wanted:
        if not 0 <= overlap < capacity:
            raise ValueError(f"{name}: an overlap of {overlap} tokens leaves no room in {capacity}")
    least = min((c for _, c, _ in wanted), default=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokens.encoding(path)
        widths = np.zeros(coder.n_vocab, dtype=np.int64)
        for rank in range(coder.n_vocab):
            try:
                widths[rank] = len(coder.decode_single_token_bytes(rank))
            except KeyError:
                pass
        schema = pa.schema([("limit_name", pa.string()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("text", pa.string()), ("tokens", pa.int32()), ("shared", pa.int32())])
        for batch in batches:
            rows, held = [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for name, capacity, overlap in wanted:
                    for i, (piece, count, shared) in enumerate(split(text, capacity, overlap, coder.encode_ordinary, widths)):
                        rows.append((name, doc_id, i, piece, count, shared))
                        held += len(piece)
                if held > 4_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    # A token has a byte at least, so a shorter text is within every capacity.
    long = documents.filter(F.octet_length("text") > least).select("doc_id", "text")
    if not wanted:
        return documents.sparkSession.createDataFrame([], SCHEMA)
    ship(documents.sparkSession)
    return long.mapInArrow(run, SCHEMA)
