"""Byte-level BPE encoding and decoding by prefix dynamic programming.

For every prefix of a piece the table keeps one number: the last token of the prefix's
encoding. The encoding of a prefix is unique, so its last token is too, and the whole
encoding is read off by walking back from the end. A token t ending at byte p is the one
exactly when the token before it (already stored at p - len(t)) may stand next to t, that
is, when the merges applied to the two tokens' bytes give the two tokens again.

Appending bytes only adds entries. After an edit the entries before it stay, and as an entry
depends on the entries within one token length only, the rest is taken over once as many
entries in a row as the longest token has bytes agree with the old ones.
"""

from __future__ import annotations

import base64
import hashlib
from itertools import chain

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, map_rows, spread, texts_of


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}


#: The pattern of public byte-level vocabularies for which a match never crosses a space before a non-space.
SPACE_LED = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class PrefixCoder:
    """Encodes one piece (bytes) at a time; pairs that were tested are remembered, up to a bound."""

    PAIRS = 300_000
    #: Prefix lengths whose tables are kept for other pieces with the same beginning, up to a bound.
    STEMS = (5, 8)
    KEPT_STEMS = 150_000

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.size = {v: len(k) for k, v in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        self.pairs: dict[tuple[int, int], bool] = {}
        self.spines: dict[int, tuple[list, list]] = {}
        self.whole: dict[int, bool] = {}
        self.stems: dict[bytes, tuple[int, ...]] = {}

    def merged(self, piece: bytes, below: int | None = None) -> list[bytes]:
        """Merges in rank order over a few bytes, of ranks under `below` only: takes one token apart."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            best, at = below, -1
            for i in range(len(parts) - 1):
                r = self.ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def sides(self, t: int) -> tuple[list, list]:
        """(left, right): the parts t has at its left and right edge while it is built, as (bytes, rank, rank of the merge that takes it)."""
        found = self.spines.get(t)
        if found is None:
            data, never = self.bytes_of[t], 1 << 60
            left, right = [(data, t, never)], [(data, t, never)]
            for side, which in ((left, 0), (right, -1)):
                while len(side[-1][0]) > 1:
                    parts = self.merged(side[-1][0], side[-1][1])
                    if len(parts) < 2:
                        break
                    side.append((parts[which], self.ranks[parts[which]], side[-1][1]))
            found = self.spines[t] = (left, right)
        return found

    def stands(self, t: int) -> bool:
        """Whether the merges give t for t's own bytes."""
        if t not in self.whole:
            self.whole[t] = len(self.merged(self.bytes_of[t])) == 1
        return self.whole[t]

    def fits(self, a: int, b: int) -> bool:
        """Whether b may follow a: no part at a's right edge merges with one at b's left edge before their own merges take them.
        An a of -1 stands for the begin of the data."""
        ok = self.pairs.get((a, b))
        if ok is None:
            get, ok = self.ranks.get, self.stands(b)
            for x, rx, px in self.sides(a)[1] if ok and a >= 0 else ():
                for y, ry, py in self.sides(b)[0]:
                    m = get(x + y)
                    if m is not None and (m := max(m, rx, ry)) < px and m <= py:
                        ok = False
            if len(self.pairs) >= self.PAIRS:
                self.pairs.clear()
            self.pairs[a, b] = ok
        return ok

    def extend(self, data: bytes, last: list[int], to: int) -> None:
        """Add the entries up to prefix length to; last has those before. The order of trial is free, as one token at most fits; most are short."""
        rank, pair, longest = self.ranks.get, self.pairs.get, self.longest
        for p in range(len(last), to + 1):
            for i in range(p - 1, max(-1, p - longest - 1), -1):
                t = rank(data[i:p])
                if t is not None:
                    ok = pair((last[i], t))
                    if ok or ok is None and self.fits(last[i], t):
                        last.append(t)
                        break
            else:
                raise ValueError("a byte has no token")

    def table(self, data: bytes) -> list[int]:
        """The entries of all prefixes, appended to those of the longest beginning that is kept."""
        ends = [k for k in self.STEMS if k < len(data)]
        last, missing = [-1], []
        while ends:
            k = ends.pop()
            if (found := self.stems.get(data[:k])) is not None:
                last = list(found)
                break
            missing.append(k)
        for k in reversed(missing):
            self.extend(data, last, k)
            if len(self.stems) < self.KEPT_STEMS:
                self.stems[data[:k]] = tuple(last)
        self.extend(data, last, len(data))
        return last

    def read(self, last: list[int]) -> list[int]:
        out, p, size = [], len(last) - 1, self.size
        while p:
            out.append(last[p])
            p -= size[last[p]]
        return out[::-1]

    def encode_piece(self, data: bytes) -> list[int]:
        if not data:
            return []
        if (t := self.ranks.get(data)) is not None:  # a piece that is a token is that token
            return [t]
        return self.read(self.table(data))


class PrefixTable:
    """The table of one growing or edited byte string (merges over the whole string, no pattern)."""

    def __init__(self, coder: PrefixCoder, data: bytes = b""):
        self.coder, self.data, self.last, self.computed = coder, b"", [-1], 0
        self.append(data)

    def append(self, more: bytes) -> None:
        self.data += more
        self.computed += len(self.data) + 1 - len(self.last)
        self.coder.extend(self.data, self.last, len(self.data))

    def edit(self, start: int, end: int, new: bytes) -> None:
        """Replace data[start:end]; entries are computed until they agree with the old ones for a token length."""
        if not 0 <= start <= end <= len(self.data):
            raise IndexError("edit outside the data")
        old, shift = self.last, len(new) - (end - start)
        self.data = self.data[:start] + new + self.data[end:]
        self.last, agree = old[: start + 1], 0
        for p in range(start + 1, len(self.data) + 1):
            self.coder.extend(self.data, self.last, p)
            t = self.last[p]
            self.computed += 1
            # only entries wholly behind the edit can be compared with their old places
            agree = agree + 1 if p - shift > end and t == old[p - shift] else 0
            if agree >= self.coder.longest:
                self.last.extend(old[p - shift + 1 :])
                return

    def ids(self) -> list[int]:
        return self.coder.read(self.last)


class _Known(dict):
    """Pieces and their ids; an unknown one is encoded, and kept while there is room."""

    ROOM = 400_000

    def __init__(self, encode):
        self.encode = encode

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = tuple(self.encode(piece))
        if len(self) < self.ROOM and len(piece) <= 64:
            self[piece] = ids
        return ids


class TextCoder:
    """Whole texts: each of the pattern's matches is encoded for itself.

    With SPACE_LED a match starts at every space or line end before a non-space and looks at
    nothing behind the next one, so a text without double spaces falls into words, each known by
    its ids; any other text or pattern is matched as a whole.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.coder = PrefixCoder(ranks)
        self.split = regex.compile(pattern).findall
        self.pieces = _Known(lambda p: self.coder.encode_piece(p.encode()))
        self.words = _Known(self._word)
        self.odd = regex.compile(r"\s\s|^\s|\s$").search if pattern == SPACE_LED else None

    def _word(self, word: str) -> list[int]:
        pieces = self.split(word)
        if len(pieces) == 1:
            return self.coder.encode_piece(word.encode())
        return list(chain.from_iterable(map(self.words.__getitem__, pieces)))

    def encode(self, text: str) -> list[int]:
        if self.odd is None or self.odd(text):
            return list(chain.from_iterable(map(self.pieces.__getitem__, self.split(text))))
        if not text:
            return []
        spaced = text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0") if "\0" not in text else None
        if spaced is None:
            return list(chain.from_iterable(map(self.pieces.__getitem__, self.split(text))))
        return list(chain.from_iterable(map(self.words.__getitem__, spaced)))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.coder.bytes_of.__getitem__, ids))


class EditableText:
    """A text with its pieces and ids; appends and edits encode only pieces near the change.

    A match of the pattern depends on the text from its start on, so pieces before a change stay
    but for the few whose match looked at it, and once a new match starts where an old one did,
    behind the change, the old pieces follow.
    """

    BACK = 3

    def __init__(self, coder: TextCoder, text: str = ""):
        self.coder, self.text = coder, text
        self.pieces = coder.split(text)
        self.ids_of = [coder.encode(p) if p else [] for p in self.pieces]
        self.encoded = len(self.pieces)

    def append(self, more: str) -> None:
        self.edit(len(self.text), len(self.text), more)

    def edit(self, start: int, end: int, new: str) -> None:
        if not 0 <= start <= end <= len(self.text):
            raise IndexError("edit outside the text")
        starts, at = [], 0
        for p in self.pieces:
            starts.append(at)
            at += len(p)
        keep = max(0, sum(s < start for s in starts) - self.BACK)
        text, shift = self.text[:start] + new + self.text[end:], len(new) - (end - start)
        old_at = {s + shift: i for i, s in enumerate(starts) if s >= end}
        p = starts[keep] if keep < len(starts) else (len(self.text) if not starts else starts[-1] if keep else 0)
        keep = min(keep, len(starts) - 1) if starts else 0
        fresh: list[str] = []
        tail: int | None = None
        while p < len(text):
            if p >= start + len(new) and p in old_at:
                tail = old_at[p]
                break
            m = self._match(text, p)
            fresh.append(m)
            p += len(m)
        ids = [self.coder.encode(x) for x in fresh]
        self.encoded += len(fresh)
        rest = slice(tail, None) if tail is not None else slice(len(self.pieces), None)
        self.pieces, self.ids_of, self.text = self.pieces[:keep] + fresh + self.pieces[rest], self.ids_of[:keep] + ids + self.ids_of[rest], text

    def _match(self, text: str, p: int) -> str:
        m = self.coder.split.__self__.match(text, p)
        return m.group() if m and m.group() else text[p]

    def ids(self) -> list[int]:
        return list(chain.from_iterable(self.ids_of))


def text_coder(ranks_path: str, pattern: str) -> TextCoder:
    """The coder of this Python process: a worker's later tasks of this operator find the pieces it knows."""
    return kept("byte_bpe", (ranks_path, pattern), lambda: TextCoder(load_ranks(ranks_path), pattern))


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids (array), ids_sha256, decoded_sha256.

    Null text counts as empty: no ids, the hashes of the empty string. Repeated rows and equal
    doc_ids are encoded each for itself; an empty table gives an empty result; other columns are ignored.
    ids_sha256 is over the decimal ids joined by commas, decoded_sha256 over the bytes decoded from the ids.
    """

    def run(batches):
        coder = text_coder(ranks_path, pattern)
        decimal = {i: str(i) for i in coder.coder.bytes_of}.__getitem__
        for b in batches:
            out = {"doc_id": b["doc_id"], "n_tokens": [], "ids_sha256": [], "decoded_sha256": []} | ({"ids": []} if with_ids else {})
            for text in b["text"]:
                ids = coder.encode(text)
                out["n_tokens"].append(len(ids))
                if with_ids:
                    out["ids"].append(ids)
                out["ids_sha256"].append(hashlib.sha256(",".join(map(decimal, ids)).encode()).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(coder.decode(ids)).hexdigest())
            yield out

    schema = "doc_id long, n_tokens long, " + "ids array<int>, " * with_ids + "ids_sha256 string, decoded_sha256 string"
    return map_rows(spread(texts_of(docs, id_col, text_col)), run, schema, owner="byte_bpe")


def decode_documents(df: DataFrame, ranks_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, data (binary): the bytes of each row's ids; null ids give no bytes, an unknown id raises."""

    def run(batches):
        coder = PrefixCoder(load_ranks(ranks_path))
        for b in batches:
            yield {"doc_id": b["doc_id"], "data": [b"".join(coder.bytes_of[i] for i in ids or ()) for ids in b["ids"]]}

    return map_rows(df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")), run, "doc_id long, data binary")
