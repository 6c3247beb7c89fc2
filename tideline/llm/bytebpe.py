"""Byte-level BPE encoding by speculation and verification, and decoding.

Greedy longest match proposes the tokens of all distinct words of a batch at once. A
proposal is the encoding of the merge process exactly if every token alone encodes to
itself and every two neighbours are compatible: undoing their merges, latest first, never
comes to a place where an earlier merge joins across the border. All neighbours are
checked together, as arrays. Only words with an incompatible pair are merged step by step.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import re
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tideline.llm.common import map_batches

#: The split into words of byte-level vocabularies, with letters, numbers and other characters.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?{letter}+| ?{number}+| ?{other}+|\s+(?!\S)|\s+"
#: Letters and numbers of Unicode 17 and later, which the split (Unicode 16) takes for other characters.
LATER = """558 58b-58c 88f c5c cdc 208f 209d-209f a7ce-a7cf a7d2 a7d4 a7dd a7e2 a7f1 ab6c-ab6d 107bb-107bf 10940-10959
10ec5-10ec7 10ed9-10eee 11b0a 11db0-11ddb 11de0-11de9 11df1 1246f 12475-1247f 12550-12686 16ea0-16eb8 16ebb-16ed3
16ff2-16ff6 187f8-187ff 18cd6-18cda 18d09-18d20 18d80-18df2 18e00-19191 191a0-191d2 1b123-1b128 1b168 1d6a6
1df1f-1df24 1df2b-1df81 1df90-1df96 1dfcd-1dfff 1e6c0-1e6de 1e6e0-1e6e2 1e6e4-1e6e5 1e6e7-1e6ed 1e6f0-1e6f4
1e6fe-1e6ff 2b73a-2b73f 2b81e 2cea2-2cead 323b0-33479 3d000-3fc3f"""
#: Encoded words a Python worker remembers, and the longest of them. Only speed depends on these.
REMEMBERED, LONGEST = 200_000, 48
#: Characters of text encoded at a time.
SLICE_CHARS = 1 << 20
#: Stands between words; no byte is mapped to it.
BORDER = "Ā"
NEVER = np.iinfo(np.int64).max


def byte_of_char() -> dict[str, int]:
    """The visible character that stands for each byte: itself where it is one, else the next from U+0100."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = sorted(set(range(256)) - set(visible))
    return {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(hidden)}


def _splitters() -> tuple:
    """Finders of words: of texts without later letters and numbers, of any text, and of those letters."""
    later = "".join("-".join(rf"\U{int(end, 16):08X}" for end in part.split("-")) for part in LATER.split())
    plain = WORDS.format(letter=r"\p{L}", number=r"\p{N}", other=r"[^\s\p{L}\p{N}]")
    exact = WORDS.format(
        letter=rf"[\p{{L}}--[{later}]]", number=rf"[\p{{N}}--[{later}]]", other=rf"(?:[^\s\p{{L}}\p{{N}}]|[{later}])"
    )
    return regex.compile(plain).findall, regex.compile(exact, regex.V1).findall, regex.compile(f"[{later}]").search


class ByteBPE:
    """Vocabulary, merges and text rules of a byte-level BPE file."""

    def __init__(self, data: bytes):
        file = json.loads(data)
        model, before = file["model"], file.get("pre_tokenizer") or {}
        if model.get("type") != "BPE" or before.get("type") != "ByteLevel" or (file.get("decoder") or {}).get("type") != "ByteLevel":
            raise ValueError("not a byte-level BPE file")
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix") if model.get(k)]
        odd += [k for k in ("fuse_unk", "byte_fallback", "ignore_merges") if model.get(k)]
        if odd or file.get("normalizer") or before.get("add_prefix_space") or not before.get("use_regex", True):
            raise ValueError(f"rules that are not supported: {odd or 'normalizer or prefix space'}")
        added = file.get("added_tokens") or []
        if any(t.get(k) for t in added for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError("added tokens that look beyond their own text are not supported")

        byte_of = byte_of_char()
        surface = {bytes(byte_of[c] for c in token): i for token, i in model["vocab"].items()}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        merges = [tuple(bytes(byte_of[c] for c in part) for part in m) for m in merges]
        # Own numbers: bytes by value, then the tokens in the order of their merges, which is their rank.
        tokens = [bytes([b]) for b in range(256)] + [a + b for a, b in merges]
        number = {token: i for i, token in enumerate(tokens)}
        if len(number) != len(tokens) or set(tokens) - set(surface):
            raise ValueError("tokens without an id, or with several merges")
        self.tokens = tokens
        self.id_of = np.array([surface[t] for t in tokens], np.int64)
        self.joined_id = [str(i) for i in self.id_of]
        self.left, self.right = (
            np.array([*range(256), *(number[m[side]] for m in merges)], np.int64) for side in (0, 1)
        )
        key = self.left[256:] << 32 | self.right[256:]
        order = np.argsort(key)
        self.pairs, self.pair_token = key[order], order + 256
        if (np.maximum(self.left, self.right)[256:] >= np.arange(256, len(tokens))).any():
            raise ValueError("merges of tokens that come later")
        self.alone = self._alone()
        self.automaton = ahocorasick.Automaton()
        for i in np.flatnonzero(self.alone):
            self.automaton.add_word(tokens[i].decode("latin-1"), int(i))
        self.automaton.make_automaton()
        self.surface_of = {str(i): t for t, i in surface.items()} | {str(t["id"]): t["content"].encode() for t in added}
        special = sorted((t["content"] for t in added), key=len, reverse=True)
        self.special_id = {t["content"]: str(t["id"]) for t in added}
        self.special = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None
        self.plain, self.exact, self.later = _splitters()
        self.far = re.compile("[\u0558-\U0010ffff]").search
        self.remembered: dict[str, str] = {}

    def _joined_rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Number of the token that a merge makes of each pair; ``NEVER`` where there is none."""
        if not len(self.pairs):
            return np.full(len(left), NEVER)
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.pair_token[at], NEVER)

    def compatible(self, left: np.ndarray, right: np.ndarray, limit: np.ndarray | None = None) -> np.ndarray:
        """Whether each two tokens, both encodings of themselves, stay apart when their text is merged anew.

        Undoing merges, latest first (of one kind the right one, as merging goes from the left), shows what stood
        at the border before them. A merge across it that comes earlier than the undone ones would have been done.
        ``limit`` bounds the first one, in half ranks.
        """
        good = np.ones(len(left), bool)
        rows, left, right = np.arange(len(left)), left.copy(), right.copy()
        limit = np.full(len(left), NEVER) if limit is None else limit.copy()
        while len(rows):
            across = self._joined_rank(left, right)
            bad = (across < NEVER) & (np.where(across < NEVER, across, 0) * 2 < limit)
            good[rows[bad]] = False
            of_left = left > right
            going = ~bad & (np.maximum(left, right) >= 256)
            limit = np.where(of_left, 2 * left, 2 * right + 1)
            left, right = np.where(of_left, self.right[left], left), np.where(of_left, right, self.left[right])
            rows, left, right, limit = rows[going], left[going], right[going], limit[going]
        return good

    def _alone(self) -> np.ndarray:
        """Tokens whose own text is encoded as this one token."""
        own = np.arange(256, len(self.tokens))
        good = np.ones(len(self.tokens), bool)
        good[256:] = self.compatible(self.left[256:], self.right[256:], 2 * own)
        while True:
            both = good & good[self.left] & good[self.right]
            if (both == good).all():
                return good
            good = both

    def merged(self, word: bytes) -> list[int]:
        """Own numbers of a word by merging the first-ranked neighbours again and again, leftmost first."""
        part = list(word)
        after, before = list(range(1, len(part) + 1)), list(range(-1, len(part) - 1))
        rank = self._rank
        queue = [(r, k, a, b) for k, (a, b) in enumerate(zip(part, part[1:], strict=False)) if (r := rank.get((a, b)))]
        heapq.heapify(queue)
        while queue:
            token, k, a, b = heapq.heappop(queue)
            n = after[k]
            # An entry counts if its two parts are still there, side by side.
            if part[k] != a or n >= len(part) or part[n] != b:
                continue
            part[k], part[n] = token, -1
            after[k] = after[n]
            if after[k] < len(part):
                before[after[k]] = k
                if r := rank.get((token, part[after[k]])):
                    heapq.heappush(queue, (r, k, token, part[after[k]]))
            if before[k] >= 0 and (r := rank.get((part[before[k]], token))):
                heapq.heappush(queue, (r, before[k], part[before[k]], token))
        return [p for p in part if p >= 0]

    @functools.cached_property
    def _rank(self) -> dict[tuple[int, int], int]:
        return {(int(k >> 32), int(k & 0xFFFFFFFF)): int(t) for k, t in zip(self.pairs, self.pair_token, strict=True)}

    def merged_together(self, words: list[bytes]) -> list[np.ndarray]:
        """As ``merged``, of many short words at once: each round does the first merge of every word."""
        part = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        word = np.repeat(np.arange(len(words)), [len(w) for w in words])

        def rank_at(at: np.ndarray) -> np.ndarray:
            found = np.full(len(at), NEVER)
            inside = np.flatnonzero((at >= 0) & (at + 1 < len(part)))
            inside = inside[word[at[inside]] == word[at[inside] + 1]]
            found[inside] = self._joined_rank(part[at[inside]], part[at[inside] + 1])
            return found

        rank = rank_at(np.arange(len(part)))
        done: list[np.ndarray] = [np.zeros(0, np.int64)] * len(words)
        while len(part):
            starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            least = np.minimum.reduceat(rank, starts)
            if (ended := np.flatnonzero(least == NEVER)).size:
                bounds = np.concatenate([starts, [len(part)]])
                for k in ended.tolist():
                    done[word[starts[k]]] = part[bounds[k] : bounds[k + 1]]
                going = np.repeat(least < NEVER, np.diff(bounds))
                part, word, rank = part[going], word[going], rank[going]
                continue
            hits = np.flatnonzero(rank == np.repeat(least, np.diff(np.concatenate([starts, [len(part)]]))))
            hits = hits[np.concatenate([[True], word[hits[1:]] != word[hits[:-1]]])]
            part[hits] = rank[hits]
            stays = np.ones(len(part), bool)
            stays[hits + 1] = False
            part, word, rank = part[stays], word[stays], rank[stays]
            hits = hits - np.arange(len(hits))
            for at in (hits, hits[hits > 0] - 1):
                rank[at] = rank_at(at)
        return done

    def encoded_words(self, words: list[str]) -> list[str]:
        """Ids of each word, in decimals joined by commas."""
        raw = [w.encode() for w in words]
        size = np.array([len(r) for r in raw], np.int64)
        start = np.concatenate([[0], np.cumsum(size + 1)])
        found = list(self.automaton.iter_long(BORDER.join([r.decode("latin-1") for r in raw])))
        end, token = np.array(found, np.int64).reshape(-1, 2).T
        word = np.searchsorted(start, end, side="right") - 1
        inside = np.flatnonzero(word[1:] == word[:-1])
        pairs, back = np.unique(token[inside] << 32 | token[inside + 1], return_inverse=True)
        wrong = ~self.compatible(pairs >> 32, pairs & 0xFFFFFFFF)[back]
        names = self.joined_id
        proposed = [names[t] for t in token.tolist()]
        bounds = np.searchsorted(word, np.arange(len(words) + 1)).tolist()
        out = [",".join(proposed[a:b]) for a, b in zip(bounds, bounds[1:], strict=False)]
        failing = np.unique(word[inside[wrong]])
        short = failing[size[failing] <= LONGEST].tolist()
        for k, own in zip(short, self.merged_together([raw[k] for k in short]), strict=True):
            out[k] = ",".join([names[t] for t in own.tolist()])
        for k in failing[size[failing] > LONGEST].tolist():
            out[k] = ",".join([names[t] for t in self.merged(raw[k])])
        return out

    def words(self, text: str) -> list[str]:
        return (self.exact if self.far(text) and self.later(text) else self.plain)(text)

    def encode_all(self, texts: list[str | None]) -> list[str]:
        """The ids of each text, in decimals joined by commas. Null counts as empty; an empty text has no ids."""
        split: list[list[str]] = []
        for text in texts:
            text = text or ""
            if not any(token in text for token in self.special_id):
                split.append(self.words(text))
                continue
            parts = self.special.split(text)
            # The parts at odd places are added tokens; a border keeps them from being taken for words.
            split.append([w for k, p in enumerate(parts) for w in ([BORDER + p] if k % 2 else self.words(p))])
        known = self.remembered
        new = [w for w in set().union(*split) if w not in known]
        special = {w: self.special_id[w[1:]] for w in new if w[0] == BORDER and w[1:] in self.special_id}
        words = [w for w in new if w not in special]
        known.update(special)
        known.update(zip(words, self.encoded_words(words), strict=True) if words else ())
        out = [",".join([known[w] for w in words]) for words in split]
        if len(known) > REMEMBERED:
            known.clear()
        for w in new:
            if len(w) > LONGEST:
                known.pop(w, None)
        return out

    def encode(self, text: str | None) -> list[int]:
        joined = self.encode_all([text])[0]
        return [int(i) for i in joined.split(",")] if joined else []

    def decode_joined(self, joined: str) -> str:
        """The text of ids in decimals joined by commas. Unknown ids are left out, broken characters become U+FFFD."""
        surface = self.surface_of
        ids = joined.split(",") if joined else []
        try:
            raw = b"".join([surface[i] for i in ids])
        except KeyError:
            raw = b"".join([surface.get(i, b"") for i in ids])
        return raw.decode("utf-8", "replace")

    def decode(self, ids: Iterable[int]) -> str:
        return self.decode_joined(",".join(map(str, ids)))


@functools.lru_cache(maxsize=1)
def _model(data: bytes) -> ByteBPE:
    return ByteBPE(data)


def load(path: str) -> bytes:
    """The bytes of a vocabulary file, read where the query is written; tasks get them with their code (1 to 3 MB)."""
    with open(path, "rb") as file:
        return file.read()


def _slices(column: pa.Array) -> Iterator[tuple[int, list[str | None]]]:
    """First row and texts of slices of about ``SLICE_CHARS`` characters; a longer text is a slice of its own."""
    texts, first, chars = [], 0, 0
    for at, value in enumerate(column):
        text = value.as_py()
        if texts and chars + len(text or "") > SLICE_CHARS:
            yield first, texts
            texts, first, chars = [], at, 0
        texts.append(text)
        chars += len(text or "")
    if texts:
        yield first, texts


def encoded(docs: DataFrame, model: bytes, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``ids`` array<int>, ``decoded`` string: every whole text encoded, and its ids decoded again.

    Null and empty texts have no ids and decode to the empty text. Each row is handled for itself: repeated rows
    stay, a null key stays, other columns are not read. A very long text is held a few times over while it is
    encoded; a word without a break in it is merged in time about proportional to its length.
    """
    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, ids array<int>, decoded string"

    def work(batch: pa.RecordBatch):
        own = _model(model)
        for first, texts in _slices(batch.column(1)):
            joined = own.encode_all(texts)
            ids = [[int(i) for i in j.split(",")] if j else [] for j in joined]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(first, len(texts)),
                    pa.array(ids, pa.list_(pa.int32())),
                    pa.array([own.decode_joined(j) for j in joined], pa.string()),
                ],
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
        for first, texts in _slices(batch.column(1)):
            joined = own.encode_all(texts)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(first, len(texts)),
                    pa.array([j.count(",") + 1 if j else 0 for j in joined], pa.int64()),
                    pa.array([sha(j) for j in joined], pa.string()),
                    pa.array([sha(own.decode_joined(j)) for j in joined], pa.string()),
                ],
                names=[key, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return map_batches(docs.select(key, text), schema, work)
