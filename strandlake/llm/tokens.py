"""Token ids of whole texts for the word-level tokenizer files of the ``tokenizers`` library."""

from __future__ import annotations

import json
import os
import re
import unicodedata
from itertools import repeat

import numpy as np
import pyarrow as pa

from strandlake.llm import kernel
from strandlake.llm.store import held

#: Texts of these characters alone are in NFC as they are, have one lower-case form in every library, and one class each.
_PLAIN = [chr(c) for c in [*range(0x21, 0x7F), *range(0xA1, 0x17F)] if c not in (0x130, 0x149)]
#: Distinct words whose ids a worker remembers. Where there would be more, those met once go, and all but the most frequent half; results don't depend on it.
WORDS_KEPT = 400_000


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordEncoder:
    """Ids of texts as ``Tokenizer.encode(text, add_special_tokens=False)`` gives them, each distinct word encoded once.

    For tokenizers that drop white space before they look for words, so that no token reaches across it: then a text's ids
    are those of its white-space separated words one after another. ``exact_by_word`` tells whether a file is of that kind;
    for another kind texts are encoded whole.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.by_word = exact_by_word(spec)
        if self.by_word:
            self.model = self.tokenizer.model
            self.pieces = re.compile(plain_pattern(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]) + "|\n")
            self.marks = [t["content"][:2].encode() for t in spec.get("added_tokens", [])]
            starts = "".join("|" + re.escape(t["content"][:2]) for t in spec.get("added_tokens", []))
            self.odd = re.compile(f"[^{re.escape(''.join(_PLAIN))}\n]{starts}")
            self.visible = byte_characters()
        self.clear()

    def clear(self) -> None:
        self.place: dict[bytes, int] = {}
        self.count = np.zeros(1 << 12, dtype=np.int64)
        self.first = np.zeros(1 << 12, dtype=np.int64)
        self.ids = np.zeros(1 << 14, dtype=np.uint32)
        self.used = 0
        self.met = np.zeros(1 << 12, dtype=np.int64)

    def _trim(self) -> None:
        """Forget words that have been met once since they were learnt or kept, and the least frequent ones beyond half the room."""
        names, met = list(self.place), self.met[: len(self.place)]
        keep = np.flatnonzero(met > 1)
        if len(keep) > WORDS_KEPT // 2:
            keep = np.sort(keep[np.argsort(-met[keep], kind="stable")[: WORDS_KEPT // 2]])
        n, first, ids = self.count[keep], self.first[keep], self.ids
        self.clear()
        self._put([names[i] for i in keep.tolist()], n, ids[np.repeat(first - np.cumsum(n) + n, n) + np.arange(int(n.sum()))])

    def _put(self, words: list[bytes], n: np.ndarray, ids: np.ndarray) -> None:
        """Remember words, how many ids each has, and all of them in a row."""
        start = len(self.place)
        self.place.update(zip(words, range(start, start + len(words)), strict=True))
        while len(self.count) < start + len(words):
            self.count, self.first, self.met = (np.append(a, np.zeros_like(a)) for a in (self.count, self.first, self.met))
        while len(self.ids) < self.used + len(ids):
            self.ids = np.append(self.ids, np.zeros_like(self.ids))
        self.count[start : start + len(words)] = n
        self.first[start : start + len(words)] = self.used + np.cumsum(n) - n
        self.ids[self.used : self.used + len(ids)] = ids
        self.used += len(ids)

    def _plain(self, words: list[str]) -> list[list[int]]:
        """Ids of words of plain characters, each piece once through the library's BPE model."""
        pieces = self.pieces.findall("\n".join(words).lower())
        tokenize, seen = self.model.tokenize, self.visible
        ids = {p: [t.id for t in tokenize(p if p.isascii() else "".join([seen[b] for b in p.encode()]))] for p in dict.fromkeys(pieces) if p != "\n"}
        found, own = [], []
        for p in pieces:
            if p == "\n":
                found.append(own)
                own = []
            else:
                own += ids[p]
        return [*found, own]

    def _learn(self, words: list[bytes]) -> None:
        texts = [w.decode("utf-8", "replace") for w in words]
        odd = [i for i, t in enumerate(texts) if self.odd.search(t)] if self.odd.search("\n".join(texts)) else []
        there = set(odd)
        plain = iter(self._plain([t for i, t in enumerate(texts) if i not in there] if odd else texts))
        whole = iter(self.tokenizer.encode_batch_fast([texts[i] for i in odd], add_special_tokens=False))
        found = [next(whole).ids if i in there else next(plain) for i in range(len(texts))]
        n = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        self._put(words, n, np.fromiter((x for f in found for x in f), dtype=np.uint32, count=int(n.sum())))

    def _words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row, and how many each word has."""
        at = np.fromiter(map(self.place.get, words, repeat(-1)), dtype=np.int64, count=len(words))
        lacking = np.flatnonzero(at < 0)
        if len(lacking):
            missed = [words[i] for i in lacking.tolist()]
            new = list(dict.fromkeys(missed))
            if self.place and len(self.place) + len(new) > WORDS_KEPT:
                self._trim()
                return self._words(words)
            self._learn(new)
            place = self.place
            at[lacking] = np.fromiter([place[w] for w in missed], dtype=np.int64, count=len(missed))
        self.met[: len(self.place)] += np.bincount(at, minlength=len(self.place))
        n = self.count[at]
        end = np.cumsum(n)
        source = np.arange(int(end[-1]) if len(end) else 0) + np.repeat(self.first[at] - end + n, n)
        return self.ids[source], n

    def _parted(self, buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Texts of the same ids with fewer distinct words: A-Z lower-cased, a space between a letter and a full stop or comma.

        Words are lower-cased and parted there anyway. Added tokens are looked for in the text as it is, so where the first
        characters of one occur nothing is lower-cased.
        """
        if not any(m in buf.tobytes() for m in self.marks):
            buf = kernel.FOLD[buf]
        stop = (buf[1:] == 46) | (buf[1:] == 44)
        stop &= (buf[:-1] >= 97) & (buf[:-1] <= 122)
        where = np.flatnonzero(stop) + 1
        out = np.full(len(buf) + len(where), 32, dtype=np.uint8)
        keep = np.ones(len(out), dtype=bool)
        keep[where + np.arange(len(where))] = False
        out[keep] = buf
        return out, at + np.searchsorted(where, at, "right")

    def encode(self, col: pa.Array, last: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a column of texts in a row (uint32), with each text's begin and the end; null is empty.

        ``last`` is appended to each text's ids if it is given.
        """
        buf, at = kernel.text_bytes(col)
        if self.by_word:
            buf, at = self._parted(buf, at)
        raw = buf.tobytes()
        texts = [raw[lo:hi] for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        tail = b"" if last is None else None
        ids, sizes = [], []
        i = 0
        while i < len(texts):  # some megabytes at a time
            j = max(i + 1, int(np.searchsorted(at, at[i] + (1 << 21), "right")) - 1)
            if self.by_word:
                words, many = [], []
                for t in texts[i:j]:
                    before = len(words)
                    words += t.split()
                    many.append(len(words) - before)
                got, n = self._words(words)
                size = np.diff(np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], np.cumsum(many)])])
            else:
                found = [e.ids for e in self.tokenizer.encode_batch_fast([t.decode("utf-8", "replace") for t in texts[i:j]], add_special_tokens=False)]
                size = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
                got = np.fromiter((x for f in found for x in f), dtype=np.uint32, count=int(size.sum()))
            if tail is None:
                got = np.insert(got, np.cumsum(size), np.uint32(last))
                size = size + 1
            ids.append(got)
            sizes.append(size)
            i = j
        none = [np.zeros(0, dtype=np.int64)]
        return np.concatenate(ids or [np.zeros(0, np.uint32)]).astype(np.uint32, copy=False), np.concatenate([[0], np.cumsum(np.concatenate(sizes or none))])


def byte_characters() -> list[str]:
    """The printable character that byte-level tokenizers write for each byte: itself, or the next free one from U+0100 on."""
    kept = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b if b in kept else next(free)) for b in range(256)]


def plain_pattern(pattern: str) -> str:
    """The tokenizer's pattern for texts of plain characters, with their letters and digits spelled out."""
    of = lambda kind: re.escape("".join(c for c in _PLAIN if unicodedata.category(c)[0] == kind))
    return pattern.replace(r"[\p{L}]", r"\p{L}").replace(r"[\p{N}]", r"\p{N}").replace(r"[^\s\p{L}\p{N}]", f"[^\\s{of('L')}{of('N')}]").replace(r"\p{L}", f"[{of('L')}]").replace(r"\p{N}", f"[{of('N')}]")


def exact_by_word(spec: dict) -> bool:
    """Whether a text's ids are those of its ASCII-white-space separated words: white space only separates, and added tokens hold none."""
    steps = lambda x, many: (x or {}).get(many, [x] if x else [])
    clean = all(s["type"] in ("NFC", "Lowercase") or s["type"] == "Replace" and s["pattern"] == {"Regex": r"\s+"} and s["content"] == " " for s in steps(spec.get("normalizer"), "normalizers"))
    split = steps(spec.get("pre_tokenizer"), "pretokenizers")
    first = bool(split) and split[0]["type"] == "Split" and split[0]["behavior"] == "Removed" and split[0]["invert"] and r"[^\s\p{L}\p{N}]+" in split[0]["pattern"].get("Regex", "")
    rest = len(split) == 2 and split[1]["type"] == "ByteLevel" and not split[1]["add_prefix_space"] and not split[1]["use_regex"]
    added = not any(t["lstrip"] or t["rstrip"] or t["single_word"] or any(c.isspace() for c in t["content"]) for t in spec.get("added_tokens", []))
    lower = {"type": "Lowercase"} in steps(spec.get("normalizer"), "normalizers")
    return clean and lower and first and rest and added and spec.get("post_processor") is None


def encoder(path: str) -> WordEncoder:
    """The worker's encoder of a file."""
    return held(f"encoder {path}", lambda: WordEncoder(path))
