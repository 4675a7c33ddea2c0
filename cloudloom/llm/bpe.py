"""Byte-level byte-pair encoding: exact text chunks, and token counts by a heap over a linked list.

A text is first cut at white space into chunks, each a union of whole pre-tokens, so that counts and
identifiers of a text are those of its chunks one after the other. Chunks repeat, so each worker
process keeps a bounded table of those it has seen.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterable

import regex

from cloudloom.llm.common import kept

#: The white space of the pre-tokeniser, and its pattern.
SPACE = r"\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PRETOKEN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: `` ?word`` or a run of white space that leaves its last blank to the word behind it.
_CHUNK = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
_PRETOKEN = regex.compile(PRETOKEN)
_BLANKS = frozenset(c for c in map(chr, range(0x3001)) if re.match(f"[{SPACE}]", c))


def chunks(text: str) -> list[str]:
    """Cut ``text`` where the pre-tokeniser always cuts; ``"".join`` of the result is the text."""
    return _CHUNK.findall(text)


def byte_letters() -> dict[int, str]:
    """The printable letter by which byte-level vocabularies write each byte: itself if printable, else 256 and up."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Bounded(dict):
    """A table of what ``make`` gave for a key, in two generations of ``most`` entries: when the young one is full it
    becomes the old one, and what is met again moves back. Keys over ``longest`` letters are never kept."""

    def __init__(self, make, most: int, longest: int = 48):
        super().__init__()
        self.make, self.most, self.longest, self.old = make, most, longest, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= self.longest:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


class Untidy(Exception):
    """A text has blanks next to white space, so it isn't cut at every blank."""


def pretokens(chunk: str) -> list[str]:
    return _PRETOKEN.findall(chunk)


class WordTable:
    """Values of a text's units one after the other, kept by unit.

    In a text whose blanks and line ends all stand between other letters the pre-tokeniser cuts before each
    of them, so the units are the words with the blank or line end before them. ``str.split`` finds those;
    any other text goes by ``chunks``.
    """

    def __init__(self, owner: str, of_chunk, join, most: int):
        self.of_chunk, self.join = of_chunk, join
        self.units = kept(owner, Bounded(self._of_unit, most))

    def _of_unit(self, word: str):
        unit = word if word[:1] == "\n" else " " + word
        if len(unit) < 2 or unit[1] in _BLANKS or unit[-1] in _BLANKS:
            raise Untidy
        return self.join(map(self.of_chunk, _CHUNK.findall(unit)))

    def of_text(self, text: str):
        words = text.replace("\n", " \n").split(" ")
        first = words[0]
        if first and first[0] not in _BLANKS and first[-1] not in _BLANKS:
            words[0] = first = self.join(map(self.of_chunk, _CHUNK.findall(first)))
            try:
                return self.join((first, *map(self.units.__getitem__, words[1:])))
            except Untidy:
                pass
        return self.join(map(self.of_chunk, _CHUNK.findall(text)))


def require_plain(spec: dict, path: str) -> None:
    """Refuse a tokenizer file with a setting that would change the tokens and isn't followed here."""
    model, pre = spec["model"], spec["pre_tokenizer"] or {}
    if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or spec["normalizer"]:
        raise ValueError(f"{path} is not a byte-level BPE vocabulary without normaliser")
    if pre.get("add_prefix_space") or pre.get("use_regex") is False or model.get("ignore_merges") or model.get("dropout") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"):
        raise ValueError(f"{path} changes how words are cut or merged")
    if any(t.get(k) for t in spec["added_tokens"] for k in ("lstrip", "rstrip", "single_word")):
        raise ValueError(f"{path} has added tokens that take in the blanks around them or match whole words only")


class HeapMerger:
    """Counts tokens of a byte-level BPE vocabulary without making identifiers.

    Adjacent pairs wait in a heap by (rank, place); the lowest is popped, its right symbol is unlinked
    from a doubly linked list, and the two new neighbours are pushed. Popped pairs that no longer exist
    are skipped. The count is the number of initial symbols less the number of merges, in
    O(n log n) for a chunk of n bytes however long.
    """

    def __init__(self, path: str, cached: int = 250_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        require_plain(spec, path)
        pairs = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.rank = {pair: i for i, pair in enumerate(pairs)}
        self.letters = byte_letters()
        self.specials = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self._special = re.compile("|".join(map(re.escape, self.specials))) if self.specials else None
        self._pieces = kept("token_counts", Bounded(self.merged, cached))
        self._table = WordTable("token_counts", self._of_chunk, sum, cached)

    def merged(self, piece: str) -> int:
        """Tokens of one pre-token."""
        rank = self.rank.get
        symbols = [self.letters[b] for b in piece.encode("utf-8")]
        n = len(symbols)
        heap = [(r, i) for i, pair in enumerate(zip(symbols, symbols[1:])) if (r := rank(pair)) is not None]
        heapq.heapify(heap)
        after, before, merges = list(range(1, n + 1)), list(range(-1, n - 1)), 0
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if j >= n or symbols[i] is None or rank((symbols[i], symbols[j])) != r:
                continue
            merges += 1
            symbols[i] += symbols[j]
            symbols[j] = None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (s := rank((symbols[i], symbols[k]))) is not None:
                    heapq.heappush(heap, (s, i))
            if (h := before[i]) >= 0 and (s := rank((symbols[h], symbols[i]))) is not None:
                heapq.heappush(heap, (s, h))
        return n - merges

    def _of_chunk(self, chunk: str) -> int:
        return sum(map(self._pieces.__getitem__, pretokens(chunk)))

    def _plain(self, text: str) -> int:
        return self._table.of_text(text)

    def count(self, text: str | None) -> int:
        """Tokens of a whole text; a special string inside it counts as its one token, as the library's default has it."""
        if not text:
            return 0
        if self._special and any(s in text for s in self.specials):
            parts = self._special.split(text)
            return sum(map(self._plain, parts)) + len(parts) - 1
        return self._plain(text)

    def counts(self, texts: Iterable[str | None]) -> list[int]:
        return [self.count(t) for t in texts]


_MERGERS: dict[str, HeapMerger] = {}


def merger(path: str) -> HeapMerger:
    """One merger for a vocabulary file in each worker process."""
    if path not in _MERGERS:
        _MERGERS[path] = HeapMerger(path)
    return _MERGERS[path]
