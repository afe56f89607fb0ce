"""The lower-case word vocabulary inside tasks: pieces of a text, their ids, their counts."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

from .tables import held

# Chunks and words a Python worker remembers; beyond it the memory starts anew.
REMEMBERED = 1_000_000
# Words the library encodes in one call, which takes memory for each until it returns.
LEARNED = 20_000

# What the vocabulary file declares, for which the quick path below holds.
KNOWN_NORMALIZER = {
    "type": "Sequence",
    "normalizers": [
        {"type": "NFC"},
        {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "},
        {"type": "Lowercase"},
    ],
}
KNOWN_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"

# Texts of these characters alone are normalised by lower() and cut as the pattern above
# cuts them, because every letter in them is composed and lower-cases to one character.
_PLAIN = re.compile("[\t-\r -~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]*")
_PLAIN_PIECE = re.compile(
    "'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^a-z0-9\u00df-\u00f6\u00f8-\u00ff]+"
)
_PLAIN_TEXT = r"^[\t-\r -~\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{ff}]*$"
_NO_IDS = np.zeros(0, "<u4")
# All characters that \s means to the normaliser; no piece reaches across them.
_CHUNK = re.compile("[^\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


class _Memory(dict):
    def __init__(self, make: Callable):
        super().__init__()
        self._make = make

    def __missing__(self, key):
        value = self._make(key)
        if len(self) >= REMEMBERED:
            self.clear()
        self[key] = value
        return value


def _byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    places = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [places[b] for b in range(256)]


class Merges:
    """Byte-pair merging by a heap and a linked list, on numbered symbols."""

    def __init__(self, pairs: list[tuple[str, str]]):
        self._number: dict[str, int] = {}
        self._rank: dict[int, int] = {}
        self._made: list[int] = []
        for rank, (a, b) in enumerate(pairs):
            self._rank.setdefault(self.number(a) << 32 | self.number(b), rank)
            self._made.append(self.number(a + b))

    def number(self, symbol: str) -> int:
        return self._number.setdefault(symbol, len(self._number))

    def left(self, symbols: list[int]) -> int:
        """How many symbols are left after all merges; ``symbols`` is used up.

        The heap holds adjacent pairs by (rank, place of the left symbol), the linked
        list the symbols that are left. The lowest pair is popped and merged until none
        has a rank; a pair that is no longer at its place is skipped. The count is the
        number of symbols at the start less the merges; no ids are made.
        """
        rank_of, made = self._rank, self._made
        n = left = len(symbols)
        heap = []
        for i in range(n - 1):
            rank = rank_of.get(symbols[i] << 32 | symbols[i + 1])
            if rank is not None:
                heap.append(rank << 32 | i)
        if not heap:
            return left
        heapify(heap)
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        symbols.append(-1)
        while heap:
            top = heappop(heap)
            rank, i = top >> 32, top & 0xFFFFFFFF
            j = after[i]
            if symbols[i] < 0 or symbols[j] < 0 or rank_of.get(symbols[i] << 32 | symbols[j]) != rank:
                continue
            new = symbols[i] = made[rank]
            symbols[j] = -1
            left -= 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                rank = rank_of.get(new << 32 | symbols[k])
                if rank is not None:
                    heappush(heap, rank << 32 | i)
            h = before[i]
            if h >= 0:
                rank = rank_of.get(symbols[h] << 32 | new)
                if rank is not None:
                    heappush(heap, rank << 32 | h)
        return left


class Vocabulary:
    """A byte-pair vocabulary file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        model, special = spec["model"], spec["added_tokens"]
        if model["type"] != "BPE" or model.get("dropout") or model.get("ignore_merges") or model.get("unk_token"):
            raise ValueError("Only plain byte-pair vocabularies are counted")
        if any(t.get("normalized") or t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in special):
            raise ValueError("Special strings must stand for themselves")
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        if not (
            spec.get("normalizer") == KNOWN_NORMALIZER
            and len(steps) == 2
            and steps[0].get("pattern") == {"Regex": KNOWN_SPLIT}
            and steps[1].get("type") == "ByteLevel"
        ):
            raise ValueError("Another normaliser or another way of cutting words")
        self._marks = re.compile("|".join(re.escape(t["content"]) for t in special) or "(?!)")
        self._merges = Merges([tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]])
        symbols, suffix = _byte_symbols(), model.get("end_of_word_suffix")
        if not suffix:
            raise ValueError("A vocabulary without word ends")
        self._ends_word = np.zeros(max(model["vocab"].values()) + 1, bool)
        self._ends_word[[i for token, i in model["vocab"].items() if token.endswith(suffix)]] = True
        self._inner = [self._merges.number(c) for c in symbols]
        self._last = [self._merges.number(c + suffix) for c in symbols]
        self._symbol_byte = {c: b for b, c in enumerate(symbols)}
        self._word_counts = _Memory(lambda word: self._merged(word.encode()))
        self._word_ids = _Memory(self._encode)
        self._chunk_counts = _Memory(self._count_chunk)
        self._chunk_ids = _Memory(self._encode_chunk)

    def _cut(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str], np.ndarray, np.ndarray]:
        """The distinct chunks of many texts: parts between blanks, which the library never joins.

        (rows of plain texts, rows of others, distinct chunks of the plain ones, the
        chunks of each in order as numbers, where each plain text begins among them).
        """
        plain = pc.and_(
            pc.match_substring_regex(texts, _PLAIN_TEXT), pc.invert(pc.match_substring(texts, "<|"))
        ).to_numpy(zero_copy_only=False)
        rows = np.flatnonzero(plain)
        lists = pc.ascii_split_whitespace(pc.utf8_lower(texts.take(pa.array(rows))))
        coded = lists.flatten().dictionary_encode()
        begins = lists.offsets.to_numpy()
        return rows, np.flatnonzero(~plain), coded.dictionary.to_pylist(), coded.indices.to_numpy(), begins - begins[0]

    def _plain_words(self, chunk: str) -> list[str] | None:
        if "<|" in chunk or not _PLAIN.fullmatch(chunk):
            return None
        return _PLAIN_PIECE.findall(chunk.lower())

    # Counting

    def counts(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each whole text."""
        out = np.zeros(len(texts), np.int64)
        rows, others, chunks, codes, begins = self._cut(texts)
        each = np.fromiter(map(self._chunk_counts.__getitem__, chunks), np.int64, len(chunks))
        upto = np.concatenate(([0], np.cumsum(each[codes])))
        out[rows] = upto[begins[1:]] - upto[begins[:-1]]
        for r in others.tolist():
            out[r] = sum(map(self._chunk_counts.__getitem__, _CHUNK.findall(texts[r].as_py())))
        return out

    def _count_chunk(self, chunk: str) -> int:
        plain = self._plain_words(chunk)
        if plain is not None:
            return sum(map(self._word_counts.__getitem__, plain))
        total, start = 0, 0
        for found in self._marks.finditer(chunk):
            total += 1 + self._count_other(chunk[start : found.start()])
            start = found.end()
        return total + self._count_other(chunk[start:])

    def _count_other(self, part: str) -> int:
        if not part:
            return 0
        usual = self.library.normalizer.normalize_str(part)
        byte = self._symbol_byte
        return sum(
            self._merged(bytes([byte[c] for c in word]))
            for word, _ in self.library.pre_tokenizer.pre_tokenize_str(usual)
        )

    def _merged(self, word: bytes) -> int:
        symbols = [self._inner[b] for b in word]
        symbols[-1] = self._last[word[-1]]
        return self._merges.left(symbols)

    # Ids

    def ids(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each whole text."""
        out = [_NO_IDS] * len(texts)
        rows, others, chunks, codes, begins = self._cut(texts)
        self._learn([c for c in chunks if c not in self._chunk_ids])
        each = [self._chunk_ids[c] for c in chunks]
        data = np.frombuffer(b"".join(each), "<u4")
        length = np.fromiter(map(len, each), np.int64, len(each)) // 4
        first = np.cumsum(length) - length
        wide = length[codes]
        upto = np.concatenate(([0], np.cumsum(wide)))
        places = np.repeat(first[codes] - upto[:-1], wide) + np.arange(upto[-1])
        found = data[places]
        ends = upto[begins]
        for i, r in enumerate(rows.tolist()):
            out[r] = found[ends[i] : ends[i + 1]]
        for r in others.tolist():
            own = b"".join(map(self._chunk_ids.__getitem__, _CHUNK.findall(texts[r].as_py())))
            out[r] = np.frombuffer(own, "<u4")
        return out

    def _learn(self, chunks: list[str]) -> None:
        """Let the library encode all plain words not seen yet, many in one call."""
        words = {w for c in chunks for w in self._plain_words(c) or ()}
        fresh = [w for w in words if w.isalpha() and w not in self._word_ids]
        for i in range(0, len(fresh), LEARNED):
            self._learn_words(fresh[i : i + LEARNED])

    def _learn_words(self, fresh: list[str]) -> None:
        if len(fresh) < 2:
            return
        found = self.library.encode_batch_fast([" ".join(fresh)], add_special_tokens=False)[0]
        ids = np.array(found.ids, "<u4")
        ends = np.flatnonzero(self._ends_word[ids]) + 1  # only the last token of a word ends it
        if len(ends) != len(fresh):
            raise ValueError("The library cuts words in another way")
        data, ends = ids.tobytes(), (ends * 4).tolist()
        if len(self._word_ids) + len(fresh) > REMEMBERED:
            self._word_ids.clear()
        self._word_ids.update(zip(fresh, map(data.__getitem__, map(slice, [0, *ends], ends))))

    def _encode_chunk(self, chunk: str) -> bytes:
        plain = self._plain_words(chunk)
        if plain is None:
            return self._encode(chunk)
        return b"".join(map(self._word_ids.__getitem__, plain))

    def _encode(self, part: str) -> bytes:
        return np.array(self.library.encode(part, add_special_tokens=False).ids, "<u4").tobytes()


def held_as(path: str) -> tuple[str, str]:
    return "vocabulary", path


def vocabulary(path: str) -> Vocabulary:
    """The vocabulary at ``path``, read once by every Python worker that keeps it."""
    return held(held_as(path), None, lambda: Vocabulary(path))
