"""Merge-type piece encoding by backtracking, and decoding.

An encoding of the merge process is the one sequence of pieces that covers the text and
whose neighbours are all compatible: two pieces are compatible if merging their joined
text again gives the same two pieces. The encoder takes the longest piece that starts at
the position (found by an Aho-Corasick automaton over all pieces), falls back to shorter
prefixes while the piece does not fit its predecessor, and steps back when none fits. A
field of bits marks positions from which no way on was found, so that none is tried twice.
"""

from __future__ import annotations

import functools
import hashlib
import re
import struct
from collections.abc import Iterable

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import map_batches

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Encoded stretches of a generation, of which a Python worker remembers two (about 220 bytes a stretch), and the
#: characters of the longest of them. Only speed depends on these.
REMEMBERED, LONGEST = 150_000, 48
NO_RANK = float("inf")


def _fields(data: bytes) -> Iterable[tuple[int, int | bytes]]:
    """Field numbers and values of one protocol-buffer message."""
    at, end = 0, len(data)

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < end:
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
        else:
            size = {1: 8, 5: 4}.get(kind) or number()
            yield key >> 3, data[at : at + size]
            at += size


class PieceModel:
    """Pieces, scores and text rules of a model file of the merge type."""

    def __init__(self, data: bytes):
        pieces, rules, kind = [], {}, 1
        for field, value in _fields(data):
            if field == 1:
                own = dict(_fields(value))
                score = struct.unpack("<f", own[2])[0] if 2 in own else 0.0
                pieces.append((own.get(1, b"").decode(), score, own.get(3, NORMAL)))
            elif field == 2:
                kind = dict(_fields(value)).get(3, 1)
            elif field == 3:
                rules = dict(_fields(value))
        if kind != 2:
            raise ValueError("not a model of the merge type")
        if rules.get(2) or rules.get(4, 1) or not rules.get(5, 1):
            raise ValueError("only models that leave the text as it is, but for marked spaces, are supported")
        if any(k in (USER_DEFINED, UNUSED) for _, _, k in pieces):
            raise ValueError("user-defined and unused pieces are not supported")
        self.dummy_prefix = bool(rules.get(3, 1))
        self.pieces = [p for p, _, _ in pieces]
        self.kinds = [k for _, _, k in pieces]
        self.unknown = self.kinds.index(UNKNOWN)
        self.id_of = {p: i for i, (p, _, k) in enumerate(pieces) if k == NORMAL}
        self.rank_of = {p: -pieces[i][1] for p, i in self.id_of.items()}
        self.byte_ids = {int(p[3:5], 16): i for i, (p, _, k) in enumerate(pieces) if k == BYTE}
        self.byte_of = {i: b for b, i in self.byte_ids.items()}
        automaton = ahocorasick.Automaton()
        for piece, i in self.id_of.items():
            automaton.add_word(piece, i)
        automaton.make_automaton()
        self.automaton = automaton
        # The longest proper prefix of each piece that is a piece.
        self.shorter = {
            i: next((self.id_of[p[:n]] for n in range(len(p) - 1, 0, -1) if p[:n] in self.id_of), -1)
            for p, i in self.id_of.items()
        }
        self.length = {i: len(p) for p, i in self.id_of.items()}
        self.fits: dict[int, bool] = {}
        self.known_chars = {p for p in self.id_of if len(p) == 1}
        self.remembered: dict[str, str] = {}
        self.older: dict[str, str] = {}
        self.reach = max(map(len, self.id_of), default=1)
        # No piece goes on after a letter with a space, and none holds a line break: texts fall apart there.
        apart = all(SPACE not in p.lstrip(SPACE) for p in self.id_of) and not any("\n" in p for p in self.id_of)
        self.stretches = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n" if apart else r"(?s).+").findall

    def _merged(self, text: str) -> list[int]:
        """Ids of a short text by merging the best-ranked neighbours again and again, leftmost first; -1: no piece."""
        parts, rank = list(text), self.rank_of.get
        best = [rank(a + b, NO_RANK) for a, b in zip(parts, parts[1:], strict=False)]
        while best and (least := min(best)) < NO_RANK:
            k = best.index(least)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            del best[k]
            if k < len(best):
                best[k] = rank(parts[k] + parts[k + 1], NO_RANK)
            if k:
                best[k - 1] = rank(parts[k - 1] + parts[k], NO_RANK)
        return [self.id_of.get(p, -1) for p in parts]

    def compatible(self, left: int, right: int) -> bool:
        """Whether the two pieces stay apart when their text is merged anew; left -1: the piece alone."""
        key = left << 32 | right
        known = self.fits.get(key)
        if known is None:
            if len(self.fits) > 4 * REMEMBERED:
                self.fits.clear()
            want = [right] if left < 0 else [left, right]
            known = self.fits[key] = self._merged("".join(self.pieces[i] for i in want)) == want
        return known

    def _known_stretch(self, text: str) -> list[int]:
        """Ids of a text whose every character is a piece."""
        n = len(text)
        fits, length, shorter, scan, reach = self.fits.get, self.length, self.shorter, self.automaton.iter_long, self.reach
        # A scan gives the longest matches one after the other; another one starts where the way leaves it.
        longest = {end - length[i] + 1: i for end, i in scan(text)}
        open_at = bytearray(b"\x01") * (n + 1)
        ids: list[int] = []
        at, piece, before = 0, longest[0], -1
        while at < n:
            while piece >= 0:
                end = at + length[piece]
                if open_at[end]:
                    good = fits(before << 32 | piece)
                    if good or good is None and self.compatible(before, piece):
                        break
                piece = shorter[piece]
            if piece >= 0:
                ids.append(piece)
                before, at = piece, end
                if at not in longest and at < n:
                    # A window shows the longest matches that start well before its end.
                    sure = n if at + 4 * reach >= n else at + 3 * reach
                    for stop, i in scan(text[at : at + 4 * reach]):
                        start = at + stop - length[i] + 1
                        if start in longest or start > sure:
                            break
                        longest[start] = i
                piece = longest[at] if at < n else -1
            else:
                open_at[at] = 0
                piece = ids.pop()
                at -= length[piece]
                before = ids[-1] if ids else -1
                piece = shorter[piece]
        return ids

    def _stretch(self, text: str) -> list[int]:
        if self.known_chars.issuperset(text):
            return self._known_stretch(text)
        ids: list[int] = []
        known: list[str] = []
        for char in text:
            if char in self.id_of:
                known.append(char)
                continue
            if known:
                ids += self._known_stretch("".join(known))
                known = []
            if self.byte_ids:
                ids += [self.byte_ids[b] for b in char.encode()]
            elif not ids or ids[-1] != self.unknown:
                ids.append(self.unknown)
        return ids + (self._known_stretch("".join(known)) if known else [])

    def encode_joined(self, text: str | None) -> str:
        """The ids, in decimals joined by commas. Null counts as empty; an empty text has no ids."""
        if not text:
            return ""
        text = text.replace(" ", SPACE)
        parts = self.stretches(SPACE + text if self.dummy_prefix else text)
        known, older = self.remembered, self.older
        out = list(map(known.get, parts))
        if None in out:
            for k, part in enumerate(parts):
                if out[k] is None:
                    ids = known.get(part) or older.get(part) or ",".join(map(str, self._stretch(part)))
                    if len(part) <= LONGEST:
                        known[part] = ids
                    out[k] = ids
            if len(known) > REMEMBERED:
                # What is used again moves on from the older generation to the next one.
                self.older, self.remembered = known, {}
        return ",".join(out)

    def encode(self, text: str | None) -> list[int]:
        joined = self.encode_joined(text)
        return [int(i) for i in joined.split(",")] if joined else []

    @functools.cached_property
    def _surface(self) -> dict[str, bytes]:
        """By the id in decimals: the bytes that a piece stands for inside a text."""
        return {
            str(i): bytes([self.byte_of[i]])
            if kind == BYTE
            else b""
            if kind == CONTROL
            else " ⁇ ".encode()
            if kind == UNKNOWN
            else self.pieces[i].replace(SPACE, " ").encode()
            for i, kind in enumerate(self.kinds)
        }

    def decode_joined(self, joined: str) -> str:
        """The text of ids in decimals joined by commas."""
        if not joined:
            return ""
        ids = joined.split(",")
        surface = self._surface
        try:
            text = b"".join([surface[i] for i in ids]).decode()
        except UnicodeDecodeError:
            return self._decode_broken(ids)
        first = next((i for i in ids if self.kinds[int(i)] != CONTROL), None) if text[:1] == " " else None
        drop = self.dummy_prefix and first is not None and self.kinds[int(first)] == NORMAL
        return text[1:] if drop else text

    def _decode_broken(self, ids: list[str]) -> str:
        """As above where byte pieces do not make up whole characters: each such byte becomes U+FFFD."""
        out: list[str] = []
        run = bytearray()
        seen = False

        def flush() -> None:
            while run:
                for size in (1, 2, 3, 4):
                    try:
                        out.append(run[:size].decode())
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    size = 1
                    out.append("�")
                del run[:size]

        for text in ids:
            i = int(text)
            if self.kinds[i] == BYTE:
                run.append(self.byte_of[i])
                continue
            flush()
            piece = self._surface[text].decode()
            if self.dummy_prefix and not seen and not any(out) and self.kinds[i] == NORMAL and piece[:1] == " ":
                piece, seen = piece[1:], True
            out.append(piece)
        flush()
        return "".join(out)

    def decode(self, ids: Iterable[int]) -> str:
        return self.decode_joined(",".join(map(str, ids)))


@functools.lru_cache(maxsize=2)
def _model(data: bytes) -> PieceModel:
    return PieceModel(data)


def load(path: str) -> bytes:
    """The bytes of a model file, read where the query is written; tasks get them with their code (under 1 MB)."""
    with open(path, "rb") as file:
        return file.read()


def encoded(docs: DataFrame, model: bytes, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``ids`` array<int>, ``decoded`` string: every whole text encoded, and its ids decoded again.

    Null and empty texts have no ids and decode to the empty text. Each row is handled for itself:
    repeated rows stay, a null key stays, other columns are not read.
    """
    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, ids array<int>, decoded string"

    def work(batch: pa.RecordBatch):
        own = _model(model)
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            joined = [own.encode_joined(t) for t in part.column(1).to_pylist()]
            ids = [[int(i) for i in j.split(",")] if j else [] for j in joined]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([own.decode_joined(j) for j in joined])],
                names=[key, "ids", "decoded"],
            )

    return map_batches(docs.select(key, text), schema, work)


def digests(docs: DataFrame, model: bytes, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` of every whole text, as ``encoded`` has them."""
    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"

    def sha(value: str) -> str:
        return hashlib.sha256(value.encode()).hexdigest()

    def work(batch: pa.RecordBatch):
        own = _model(model)
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            rows = []
            for value in part.column(1):
                joined = own.encode_joined(value.as_py())
                rows.append((joined.count(",") + 1 if joined else 0, sha(joined), sha(own.decode_joined(joined))))
            n, a, b = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(n, pa.int64()), pa.array(a), pa.array(b)],
                names=[key, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return map_batches(docs.select(F.col(key), F.col(text)), schema, work)
