"""Token ids of whole texts, as the tokenizers library gives them.

A text is cut at white space, which no token of the vocabulary crosses, and the distinct chunks
of a batch into words, each encoded once and remembered while it is in use: invented, repeated
and inflected words make up most of the work otherwise. Chunks of Latin-1 characters are
normalised and split here by the tokenizer's own stated rules and their words go to the
library's model in one batch; any other chunk, and any text with a special string or a
separator that the rules treat apart, goes to the library's full pipeline. A tokenizer with other rules always takes the full pipeline.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# The letters and numbers among the Latin-1 characters, and the contractions
# that the vocabulary's split rule names.
_LETTER = "A-Za-zªµºÀ-ÖØ-öø-ÿ"
_NUMBER = "0-9²³¹¼½¾"
_WORDS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^\s{_LETTER}{_NUMBER}]+")
_RULE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_APART = ("<|", "\x1c", "\x1d", "\x1e", "\x1f")

#: Letters that a chunk in lower case may consist of, with one end mark, to be a word as it stands.
_MARKS = ".,!?;:"
_PLAIN = f"^[a-zªµºß-öø-ÿ]+[{_MARKS}]?$"

MEMO_WORDS = 250_000
PIECE_CHARS = 1 << 20
BATCH_BYTES = 1 << 23


class Encoder:
    """Encodes with one .json tokenizer; ids come as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.full = Tokenizer.from_file(path)
        kinds = [n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        split = ((spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
        special = [t["content"] for t in spec.get("added_tokens", [])]
        self.by_word = (
            kinds == ["NFC", "Replace", "Lowercase"]
            and split.get("pattern") == {"Regex": _RULE}
            and all(s.startswith("<|") for s in special)
        )
        if self.by_word:
            self.words = Tokenizer.from_file(path)
            self.words.normalizer = None
            self.words.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.known, self.other = Memo(self._model), Memo(self._whole)

    def _whole(self, texts: list[str]) -> list[bytes]:
        done = self.full.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in done]

    def _model(self, words: list[str]) -> list[bytes]:
        done = self.words.encode_batch_fast(words, add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in done]

    def _chunk_ids(self, chunks: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of distinct chunks one after another, and how many each has."""
        low = pc.utf8_lower(chunks)
        plain = pc.match_substring_regex(low, _PLAIN).to_numpy(zero_copy_only=False)
        stems = pc.utf8_rtrim(low, _MARKS)
        marked = plain & (pc.binary_length(low).to_numpy() != pc.binary_length(stems).to_numpy())
        words = stems.filter(pa.array(plain)).dictionary_encode()
        names = [*words.dictionary.to_pylist(), *_MARKS]
        # of each chunk the numbers of its words; a whole chunk of other characters counts as one
        first = np.zeros(len(chunks), np.int64)
        first[plain] = words.indices.to_numpy(zero_copy_only=False)
        mark = pc.index_in(pc.utf8_slice_codeunits(low.filter(pa.array(marked)), -1), pa.array(list(_MARKS))).to_numpy(zero_copy_only=False)
        size = 1 + marked.astype(np.int64)
        at, rare, others = np.flatnonzero(~plain), [], []
        for chunk in chunks.filter(pa.array(~plain)).to_pylist():
            try:
                chunk.encode("latin-1")
            except UnicodeEncodeError:
                rare.append([~len(others)])
                others.append(chunk)
            else:
                found = _WORDS.findall(chunk.lower())
                rare.append(range(len(names), len(names) + len(found)))
                names += found
        size[at] = np.fromiter(map(len, rare), np.int64, len(rare))
        start = np.cumsum(size) - size
        unit = np.zeros(int(size.sum()), np.int64)
        unit[start[plain]] = first[plain]
        unit[start[marked] + 1] = len(words.dictionary) + mark
        of_rare = np.array([x for own in rare for x in own], np.int64)
        unit[np.repeat(start[at] - (np.cumsum(size[at]) - size[at]), size[at]) + np.arange(len(of_rare))] = np.where(of_rare < 0, len(names) + ~of_rare, of_rare)
        ids = [*self.known.of(names), *self.other.of(others)]
        pool, n = np.frombuffer(b"".join(ids), "<u4"), np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat = _laid_out(pool, n, unit)
        ends = np.concatenate([[0], np.cumsum(n[unit])])
        return flat, ends[start + size] - ends[start]

    def _split(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Per text the border of its chunks, per chunk the number of a distinct one; of these all ids, and how many each has."""
        lists = pc.ascii_split_whitespace(texts)
        found = lists.flatten().dictionary_encode()
        borders = lists.offsets.to_numpy().astype(np.int64)
        return borders - borders[0], found.indices.to_numpy(zero_copy_only=False), *self._chunk_ids(found.dictionary)

    def _apart(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray, list[bytes]]:
        """Texts that need the full pipeline, taken out and encoded by it."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        if self.by_word:
            mask = np.zeros(len(texts), bool)
            for s in _APART:
                mask |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        else:
            mask = np.ones(len(texts), bool)
        at = np.flatnonzero(mask)
        if not len(at):
            return texts, at, []
        return pc.if_else(pa.array(mask), "", texts), at, self._whole(texts.take(pa.array(at)).to_pylist())

    def lengths(self, texts: pa.Array) -> np.ndarray:
        """How many ids each text has."""
        plain, at, whole = self._apart(texts)
        borders, which, _, size = self._split(plain)
        total = np.concatenate([[0], np.cumsum(size[which])])[borders]
        n = np.diff(total)
        n[at] = [len(x) // 4 for x in whole]
        return n

    def encode(self, texts: pa.Array | list) -> list[bytes]:
        """Ids of each text; a null text has none."""
        plain, at, whole = self._apart(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()))
        borders, which, pool, size = self._split(plain)
        total = np.concatenate([[0], np.cumsum(size[which])])
        flat = _laid_out(pool, size, which).tobytes()
        ends = 4 * total[borders]
        out = [flat[a:b] for a, b in zip(ends[:-1], ends[1:])]
        for i, x in zip(at, whole):
            out[i] = x
        return out


class Memo:
    """Values of words, learned in batches. What was not asked for while MEMO_WORDS others were is forgotten."""

    def __init__(self, learn: Callable[[list[str]], list[bytes]]):
        self.learn, self.new, self.old = learn, {}, {}

    def of(self, words: list[str]) -> list[bytes]:
        new, old = self.new, self.old
        out = list(map(new.get, words))
        missing = [i for i, x in enumerate(out) if x is None]
        if missing:
            asked = [words[i] for i in missing]
            new.update((w, old[w]) for w in asked if w in old)
            unknown = list(dict.fromkeys(w for w in asked if w not in new))
            if unknown:
                new.update(zip(unknown, self.learn(unknown)))
            for i in missing:
                out[i] = new[words[i]]
        if len(new) > MEMO_WORDS:
            self.old, self.new = new, {}
        return out


def _laid_out(pool: np.ndarray, size: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The runs of a pool, of the given sizes, one after another in the order of `which`."""
    begin, n = np.cumsum(size) - size, size[which]
    before = np.cumsum(n) - n
    return pool[np.repeat(begin[which] - before, n) + np.arange(int(n.sum()))]


def pieces(text: str, most: int = PIECE_CHARS) -> list[str]:
    """Cut a long text between a character and the white space after it: no token spans that."""
    if len(text) <= most:
        return [text]
    out, at = [], 0
    while len(text) - at > most:
        cut = _BREAK.search(text, at + most)
        if cut is None:
            break
        out.append(text[at:cut.start() + 1])
        at = cut.start() + 1
    return [*out, text[at:]]


_BREAK = re.compile(r"\S(?=\s)")


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One encoder per worker process and file."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Encoder(path)


def parts_by_bytes(texts: pa.Array, most: int) -> list[tuple[int, int]]:
    """Runs [a, b) of rows of about the same number of bytes, at least one row each."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    out, at = [], 0
    while at < len(sizes):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + most, "right")))
        out.append((at, to))
        at = to
    return out
