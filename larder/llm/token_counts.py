"""Token counts with edits (operator 1).

The text of a document is cut into pre-tokens (byte-level BPE never merges
across them). Their token counts are the leaves of a segment tree: leaves of
``LEAF`` pre-tokens, each inner node the sum (characters, pre-tokens, tokens)
of two below. An edit replaces characters [start, end) of the current text:
the tree finds the leaves it touches, the text from a safe boundary before it
to the first old boundary behind it is cut and encoded again, and the sums on
the paths to the root are renewed. Everything else keeps its counts.

Why that is exact: the pattern looks back at nothing and ahead by one
character beyond a run of white space. So a cut at an old boundary whose next
pre-tokens hold a character that is no white space, all before the edit,
stands; and as soon as a new cut falls on an old boundary behind the edit, all
later cuts are the old ones.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import slices

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern that splits text before the merges of the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LEAF = 64
CACHE_PRETOKENS = 300_000

EDITS = "array<struct<start:int,end:int,replacement:string>>"


def read_vocabulary(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Counter(dict):
    """Tokens of a pre-token, remembered."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.encoding = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.split = regex.compile(PATTERN).findall

    def __missing__(self, piece: str) -> int:
        n = len(self.encoding.encode_ordinary(piece))
        if len(self) >= CACHE_PRETOKENS:
            self.clear()
        if len(piece) <= 64:
            self[piece] = n
        return n

    def tokens(self, pieces: list[str]) -> int:
        return sum(map(self.__getitem__, pieces))


class SegmentTree:
    """Pre-tokens of a text in leaves, with sums above them.

    ``level[0]`` holds (characters, pre-tokens, tokens) of the leaves,
    ``level[-1]`` the whole text. A leaf may grow or empty with edits; one that
    grows past four times ``LEAF`` has the tree built again over its pieces.
    """

    def __init__(self, pieces: list[str], count: Counter):
        self.count = count
        self.encoded = len(pieces)
        self._build(pieces)

    def _build(self, pieces: list[str]) -> None:
        self.leaves = [pieces[i:i + LEAF] for i in range(0, len(pieces), LEAF)] or [[]]
        rows = np.array([self._sums(p) for p in self.leaves], np.int64)
        self.level = [rows]
        while len(rows) > 1:
            if len(rows) % 2:
                rows = np.vstack([rows, np.zeros((1, 3), np.int64)])
                self.level[-1] = rows
            rows = rows[0::2] + rows[1::2]
            self.level.append(rows)

    def _sums(self, pieces: list[str]) -> tuple[int, int, int]:
        return sum(map(len, pieces)), len(pieces), self.count.tokens(pieces)

    @property
    def chars(self) -> int:
        return int(self.level[-1][0, 0])

    @property
    def pretokens(self) -> int:
        return int(self.level[-1][0, 1])

    @property
    def tokens(self) -> int:
        return int(self.level[-1][0, 2])

    def _find(self, at: int) -> tuple[int, int]:
        """Leaf that holds character ``at`` and the leaf's first character, from the root down."""
        node, start = 0, 0
        for rows in reversed(self.level[:-1]):
            node *= 2
            left = int(rows[node, 0])
            if at >= start + left and node + 1 < len(rows) and rows[node + 1, 0] > 0:
                node, start = node + 1, start + left
        return min(node, len(self.leaves) - 1), start

    def _set(self, leaf: int, pieces: list[str], known: tuple[int, int, int]) -> None:
        self.leaves[leaf] = pieces
        change = np.array(known, np.int64) - self.level[0][leaf]
        node = leaf
        for rows in self.level:
            rows[node] += change
            node //= 2

    def text(self) -> str:
        return "".join(p for leaf in self.leaves for p in leaf)

    def replace(self, start: int, end: int, new: str) -> int:
        """Replace characters [start, end); returns the number of pre-tokens encoded again."""
        start = max(0, min(start, self.chars))
        end = max(start, min(end, self.chars))
        if start == end and not new:
            return 0
        first, at = self._find(max(0, start - 1))
        # Back to a leaf whose kept pre-tokens before the edit end in a safe boundary.
        while True:
            head, cut = self._safe(self.leaves[first], at, start)
            if cut is not None or first == 0:
                break
            first -= 1
            at -= int(self.level[0][first, 0])
        kept, kept_end = (head, cut) if cut is not None else ([], at)
        last, last_at = self._find(max(start, end))
        after = [p for leaf in range(first, last + 1) for p in self.leaves[leaf]][len(kept):]
        fresh, rest = self._recut(after, kept_end, start, end, new, last)
        while fresh is None:  # the new cuts meet no old boundary here: take in one more leaf
            last += 1
            after = after + self.leaves[last]
            fresh, rest = self._recut(after, kept_end, start, end, new, last)
        self.encoded += len(fresh)
        pieces = kept + fresh + rest
        for leaf in range(first + 1, last + 1):
            if self.leaves[leaf]:
                self._set(leaf, [], (0, 0, 0))
        self._set(first, pieces, self._sums(pieces))
        if len(pieces) > 4 * LEAF:
            self._build([p for leaf in self.leaves for p in leaf])
        return len(fresh)

    @staticmethod
    def _safe(pieces: list[str], at: int, start: int) -> tuple[list[str], int | None]:
        """The pre-tokens up to the last boundary that an edit at ``start`` cannot move."""
        ends, pos = [], at
        for p in pieces:
            pos += len(p)
            if pos >= start:
                break
            ends.append(pos)
        for k in range(len(ends) - 1, -1, -1):
            # The piece behind the boundary, as far as it lies before the edit, must not be all white space.
            behind = "".join(pieces[k + 1:len(ends) + 1])[:start - ends[k]]
            if behind.strip():
                return pieces[:k + 1], ends[k]
        return [], None

    def _recut(self, after: list[str], base: int, start: int, end: int, new: str, last: int):
        """New pieces up to an old boundary behind the edit, and the old pieces from there on."""
        old = "".join(after)
        text = old[:start - base] + new + old[end - base:]
        shift = len(new) - (end - start)
        bounds, pos = {}, 0
        for k, p in enumerate(after):
            if pos >= end - base:
                bounds[pos + shift] = k
            pos += len(p)
        final = all(not leaf for leaf in self.leaves[last + 1:])
        fresh, pos = [], 0
        for m in regex.finditer(PATTERN, text):
            if pos in bounds and pos >= start - base + len(new):
                return fresh, after[bounds[pos]:]
            fresh.append(m.group())
            pos = m.end()
        # The end of the text at hand is no end of the document unless no leaf follows.
        return (fresh, []) if final else (None, [])


def _count_task(ranks, edits_of: Callable[[str], list] | None, text_at: int, edits_at: int | None,
                n_keep: int, names: list[str]):
    def run(batches: Iterable[pa.RecordBatch]):
        count = Counter(ranks.value)
        for batch in batches:
            for part in slices(batch, text_at):
                cols: list[list[int]] = [[], [], [], [], []]
                given = part.column(edits_at).to_pylist() if edits_at is not None else None
                for k, text in enumerate(part.column(text_at).to_pylist()):
                    text = text or ""
                    edits = [(e["start"], e["end"], e["replacement"]) for e in (given[k] or []) if e] \
                        if given is not None else edits_of(text) if edits_of else []
                    pieces = count.split(text)
                    if not edits:
                        row = (len(pieces), count.tokens(pieces), 0, 0)
                        after = row[1]
                    else:
                        tree = SegmentTree(pieces, count)
                        n, before, again = tree.pretokens, tree.tokens, 0
                        for s, e, new in edits:
                            again += tree.replace(s or 0, s or 0 if e is None else e, new or "")
                        row, after = (n, before, len(edits), again), tree.tokens
                    for c, v in zip(cols, (*row, after)):
                        c.append(v)
                yield pa.RecordBatch.from_arrays([part.column(i) for i in range(n_keep)]
                                                 + [pa.array(c, pa.int64()) for c in cols], names=names)
    return run


# Personal data that the standard edits replace: mail addresses, IPv4 addresses,
# long hexadecimal secrets and long digit runs.
_PRIVATE = regex.compile(r"(?P<MAIL>[\w.+-]+@[\w-]+(?:\.[\w-]+)+)|(?P<IP>\b\d{1,3}(?:\.\d{1,3}){3}\b)"
                         r"|(?P<SECRET>\b[0-9a-fA-F]{32,}\b)|(?P<NUMBER>\b\d{12,19}\b)")

# A secret may hold letters only; the other kinds need an @ or a digit.
_HEX = regex.compile(r"[0-9a-fA-F]{32}")


def redactions(text: str) -> list[tuple[int, int, str]]:
    """Edits that replace personal data by its kind, last first, so earlier positions hold."""
    if not ("@" in text or any(c.isdigit() for c in text) or _HEX.search(text)):
        return []
    return [(m.start(), m.end(), f"<{m.lastgroup}>") for m in _PRIVATE.finditer(text)][::-1]


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY, text: str = "text", edits: str | None = None,
                 edits_of: Callable[[str], list] | None = None, carry: list[str] | None = None) -> DataFrame:
    """``docs`` with n_pretokens, n_tokens, n_edits, n_reencoded, n_tokens_after.

    Edits come from a column (``edits``: array of start, end, replacement, in
    characters of the text as the edits before left it) or from a function of
    the text. Positions beyond the text are moved to its end. Null texts count
    as empty; null edits are none. Rows are independent: repeated rows, null
    ids and extra columns pass through; columns named like a result are replaced.
    """
    out = ["n_pretokens", "n_tokens", "n_edits", "n_reencoded", "n_tokens_after"]
    keep = [c for c in (carry or docs.columns) if c not in out]
    ranks = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))  # one file of fixed size
    need = [text] + ([edits] if edits else [])
    cols = keep + [f"__{c}" for c in need]
    task = _count_task(ranks, edits_of, len(keep), len(keep) + 1 if edits else None, len(keep), keep + out)
    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep] + [f"{c} long" for c in out])
    picked = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias(f"__{text}"),
                         *([F.col(f"`{edits}`").cast(EDITS).alias(f"__{edits}")] if edits else []))
    return picked.select(*[F.col(f"`{c}`") for c in cols]).mapInArrow(task, schema)


def attach_edits(docs: DataFrame, edits: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with an ``edits`` column from rows (doc_id, seq, start, end,
    replacement), applied in order of seq (ties: start, end, replacement)."""
    listed = edits.where(F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("__doc")).agg(
        F.sort_array(F.collect_list(F.struct("seq", "start", "end", "replacement"))).alias("edits"))
    listed = listed.select("__doc", F.transform("edits", lambda e: F.struct(
        e["start"].cast("int").alias("start"), e["end"].cast("int").alias("end"),
        e["replacement"].alias("replacement"))).alias("edits"))
    return docs.drop("edits").join(listed, F.col(doc_id) == F.col("__doc"), "left").drop("__doc")
