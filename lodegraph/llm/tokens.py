"""Token ids of whole texts by a `tokenizers` file, as Arrow batches.

White space never joins two tokens under a tokenizer whose pre-tokenizer splits at it, so a text's ids are those of
its words in a row, and only the distinct words of a run of texts are encoded. Closing points and commas are split off
a word that ends in a letter or digit before them, as the tokenizer does; what is left and holds letters alone is one
pre-token, so it needs neither normalizer nor splitting, and its last id is the one that ends a word. Other words take
the whole tokenizer, a mark between them. `check_splits` tells whether a tokenizer file works so; any other is encoded
text by text.
"""

from __future__ import annotations

import hashlib
import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import Words

#: Words met twice in a run of texts are kept for the next ones, up to so many; beyond, a worker starts anew.
KEEP = 300_000
#: Words per string that is encoded.
JOINED = 256
#: A word that is a token of its own and marks word borders.
MARK = "|"
#: Closing characters that are split off.
CLOSING = ".,;:!?"
#: A last character after which closing ones begin a token of their own: a digit, or a Latin letter but U+0130.
BORDER = r"[0-9A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{12F}\x{131}-\x{24F}]$"

_loaded: dict[str, Encoder] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def read_file(path: str | None) -> str:
    """The tokenizer's description, read on the driver; a vocabulary file, so of bounded size."""
    with open(path or default_path(), encoding="utf-8") as f:
        return f.read()


def check_splits(spec: dict) -> bool:
    """Whether ids of a text are those of its words: white space folded, words split at it, no prefix, no template."""
    steps = (spec.get("normalizer") or {}).get("normalizers", [])
    kinds = [s["type"] for s in steps]
    pre = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    split = pre and pre[0]["type"] == "Split" and pre[0].get("behavior") == "Removed" and pre[0].get("invert") and r"[^\s\p{L}\p{N}]+" in pre[0]["pattern"].get("Regex", "")
    rest = len(pre) == 2 and pre[1]["type"] == "ByteLevel" and not pre[1]["add_prefix_space"] and not pre[1]["use_regex"]
    return kinds == ["NFC", "Replace", "Lowercase"] and bool(split and rest) and spec["model"]["type"] == "BPE" and not spec["model"]["dropout"]


def _latin(word: str) -> bool:
    """Whether a word is made of Latin letters that lower-casing keeps letters and that NFC leaves alone."""
    return word.isalpha() and (word.isascii() or (max(word) < "\u0250" and "\u0130" not in word))


def _split(words: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Words without their closing characters, in lower case (A-Z), and those, where a border lies between.

    A border lies after a digit or a letter that `_latin` knows. Words with a mark, so special tokens, stay whole.
    """
    trimmed = pc.ascii_rtrim(words, CLOSING)
    cut = pc.and_(pc.and_(pc.match_substring_regex(trimmed, BORDER), pc.less(pc.binary_length(trimmed), pc.binary_length(words))), pc.invert(pc.match_substring(words, MARK)))
    closing = pc.struct_field(pc.extract_regex(words, f"(?P<closing>[{CLOSING}]+)$"), "closing")
    tails = pc.if_else(cut, pc.fill_null(closing, ""), "").cast(pa.large_string())
    whole = pc.match_substring(words, MARK)
    cores = pc.if_else(cut, trimmed, words)
    return pc.if_else(whole, cores, pc.ascii_lower(cores)), tails


class Table:
    """Ids by word: words in a dictionary, their ids one after another."""

    def __init__(self) -> None:
        self.at: dict[bytes, int] = {}
        self.flat = np.zeros(0, np.uint32)
        self.begin = np.zeros(1, np.int64)

    def add(self, words: list[bytes], flat: np.ndarray, sizes: np.ndarray) -> None:
        self.at.update(zip(words, range(len(self.at), len(self.at) + len(words))))
        self.flat = np.concatenate([self.flat, flat])
        self.begin = np.concatenate([self.begin, self.begin[-1] + np.cumsum(sizes, dtype=np.int64)])

    def gathered(self, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the entries `of` in a row, where each begins and the last ends)."""
        return _gathered(self.flat, self.begin, of)


def _gathered(flat: np.ndarray, begin: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    size = begin[of + 1] - begin[of]
    ends = np.concatenate([[0], np.cumsum(size)])
    return flat[np.arange(ends[-1]) + np.repeat(begin[of] - ends[:-1], size)], ends


class Encoder:
    """Encodes runs of texts; `vocab_size` is the number of ids."""

    def __init__(self, description: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(description)
        self.vocab_size = self.tokenizer.get_vocab_size()
        spec = json.loads(description)
        marked = self.tokenizer.encode(MARK, add_special_tokens=False).ids
        suffix = spec["model"].get("end_of_word_suffix")
        self.by_word = check_splits(spec) and len(marked) == 1 and bool(suffix)
        if self.by_word:
            self.mark = marked[0]
            byte_level = spec["pre_tokenizer"]["pretokenizers"][1]
            bare = spec | {"normalizer": None, "added_tokens": [], "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, byte_level]}}
            self.bare = Tokenizer.from_str(json.dumps(bare))
            self.closes = np.zeros(self.vocab_size, bool)
            self.closes[[i for t, i in spec["model"]["vocab"].items() if t.endswith(suffix)]] = True
            self.known = Table()

    def _direct(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encoded(self, words: list[bytes]) -> Table:
        """A table of words, none of them met before."""
        letters, mixed, odd = [], [], []
        for w in words:
            text = w.decode("utf-8", "replace")
            (letters if _latin(text) else odd if MARK in text else mixed).append((w, text))
        found = Table()
        joined = [" ".join([t.lower() for _, t in letters[i : i + JOINED]]) for i in range(0, len(letters), JOINED)]
        ids = np.concatenate([np.zeros(0, np.uint32), *[np.array(e.ids, np.uint32) for e in self.bare.encode_batch_fast(joined, add_special_tokens=False)]])
        found.add([w for w, _ in letters], ids, np.diff(np.flatnonzero(self.closes[ids]), prepend=-1))
        for i in range(0, len(mixed), JOINED):
            some = mixed[i : i + JOINED]
            ids = self._direct([f" {MARK} ".join([t for _, t in some])])[0]
            cuts = np.flatnonzero(ids == self.mark)
            found.add([w for w, _ in some], np.delete(ids, cuts), np.diff(np.concatenate([[-1], cuts, [len(ids)]])) - 1)
        own = self._direct([t for _, t in odd])
        found.add([w for w, _ in odd], np.concatenate([np.zeros(0, np.uint32), *own]), np.array([len(x) for x in own], np.int64))
        return found

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row as uint32, where each text's ids begin and the last end)."""
        if not self.by_word:
            own = self._direct(pc.fill_null(texts, "").to_pylist())
            return np.concatenate([np.zeros(0, np.uint32), *own]), np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype(np.int64)
        words = Words(texts)
        if len(self.known.at) > KEEP:
            self.known = Table()
        cores, tails = _split(words.distinct)
        parts = pa.chunked_array([cores, tails]).dictionary_encode().unify_dictionaries()
        of_part = np.concatenate([c.indices.to_numpy(zero_copy_only=False) for c in parts.chunks]) if len(words.distinct) else np.zeros(0, np.int64)
        names = parts.chunk(0).dictionary.cast(pa.large_binary()).to_pylist() if len(words.distinct) else []
        known, base = self.known.at, len(self.known.at)
        held = np.fromiter((known.get(w, -1) for w in names), np.int64, len(names))
        missing = np.flatnonzero(held < 0)
        new = self._encoded([names[i] for i in missing.tolist() if names[i]])
        held[missing] = [base + new.at[names[i]] if names[i] else -1 for i in missing.tolist()]
        flat = np.concatenate([self.known.flat, new.flat])
        begin = np.concatenate([self.known.begin, self.known.begin[-1] + new.begin[1:], [self.known.begin[-1] + new.begin[-1]]])  # the last entry is empty
        of = held[of_part]
        of[of < 0] = len(begin) - 2
        n = len(words.distinct)
        by_word = np.empty(2 * n, np.int64)
        by_word[0::2], by_word[1::2] = of[:n], of[n:]
        by_part, part_ends = _gathered(flat, begin, by_word)
        ids, ends = _gathered(by_part, part_ends[::2], words.codes)
        counts = np.bincount(words.codes, minlength=n)
        own = of < len(begin) - 2
        self._keep(new, of[own] - base, np.concatenate([counts, counts])[own])
        return ids, ends[words.offsets]

    def _keep(self, new: Table, of: np.ndarray, counts: np.ndarray) -> None:
        """Keeps the new words that the run of texts holds at least twice."""
        own = of >= 0
        often = np.bincount(of[own], counts[own], len(new.at)) >= 2
        chosen = np.flatnonzero(often)
        names = list(new.at)
        flat, ends = new.gathered(chosen)
        self.known.add([names[i] for i in chosen.tolist()], flat, np.diff(ends))


def encoder(description: str) -> Encoder:
    """The encoder of this worker process for a description."""
    name = hashlib.sha256(description.encode()).hexdigest()
    if name not in _loaded:
        _loaded[name] = Encoder(description)
    return _loaded[name]


def with_end(ids: np.ndarray, offsets: np.ndarray, end: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Appends the end id to each text's ids."""
    if end is None:
        return ids, offsets
    return np.insert(ids, offsets[1:], end).astype(np.uint32), offsets + np.arange(len(offsets))
