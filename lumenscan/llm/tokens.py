"""Token ids of tokenizer files, exactly as the tokenizers library gives them for whole texts, at a fraction of its time.

The file's vocabulary is turned into merge ranks for the faster tiktoken engine. Both engines merge the pair of lowest rank first; they
can only part ways at a token that the file's own merges do not make from its bytes alone, and the tests show that there is none.
Texts with a special token's string, or with characters outside the plain Latin ranges, on whose classes the engines' tables might
differ, go to the tokenizers library itself.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

#: Everything else goes to the library: ASCII but for NUL and the odd separators 1C-1F, Latin letters without U+0130, common punctuation.
_ODD = re.compile("[^\x01-\x1b\x20-\x7e\xa0-įı-ɏ‐-‧‰-›€]")
#: Fixed value: the pattern of the byte-level pre-tokenizer.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Fixed value: the pattern of the word tokenizer, and the part of it that goes before the classes.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_CONTRACTION = re.compile("'(?:s|t|re|ve|m|ll|d)")
#: Stands for the end of a word; texts that hold it go to the library.
WORD_END = "\0"
#: Texts of more characters are encoded in parts, shorter ones together up to so many.
LONG_TEXT = 1_000_000
#: Where a long text may be cut: at white space if the tokenizer drops it, else at a single space before a word.
_WHITE_SPACE, _BEFORE_WORD = re.compile(r"\s"), re.compile(r"(?<=\S) (?=\S)")


def byte_of_char() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}


def ranks_of(vocabulary: dict[str, int], suffix: str) -> dict[bytes, int]:
    """Ranks by token bytes; a word-end suffix becomes WORD_END, so `x</w>` is x and WORD_END merged, which comes before all else."""
    of, out = byte_of_char(), {}
    for token, i in vocabulary.items():
        ended = bool(suffix) and token.endswith(suffix)
        body = token[: len(token) - len(suffix)] if ended else token
        if body and all(c in of for c in body):
            out[bytes(of[c] for c in body) + (WORD_END.encode() if ended else b"")] = i
    return out


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """By code point, for the characters that plain texts hold: 0 white space, 1 letter, 2 number, 3 other."""
    import regex

    kinds = [regex.compile(x).fullmatch for x in (r"\s", r"\p{L}", r"\p{N}")]
    return np.array([next((k for k, is_of in enumerate(kinds) if is_of(chr(i))), 3) for i in range(0x20AD)], np.uint8)


class _Words:
    """Ids of many texts by WORD_PATTERN at once: the ends of words are found by character classes, and the engine splits there."""

    def __init__(self, encode, ranks: dict[bytes, int]):
        self.encode, self.classes = encode, _classes()
        self.ended = np.zeros(max(ranks.values()) + 1, bool)
        self.ended[[i for token, i in ranks.items() if token.endswith(WORD_END.encode())]] = True

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        whole = "\n".join([*texts, ""]).lower()
        chars = np.frombuffer(whole.encode("utf-32-le"), "<u4")
        kind = self.classes[chars]
        end = (kind != 0) & ((kind == 2) | np.append(kind[1:] != kind[:-1], True))
        for x in _CONTRACTION.finditer(whole):
            if not x.start() or kind[x.start() - 1] != 3:  # inside a run of marks it is none
                end[x.start()], end[x.end() - 1] = False, True
        upto = np.cumsum((kind != 0) + end.astype(np.int64))
        kept = kind != 0
        out = np.zeros(upto[-1], "<u4")  # WORD_END where nothing else is put
        out[(upto - end)[kept] - 1] = chars[kept]
        ids = np.array(self.encode(out.tobytes().decode("utf-32-le")), "<u4")
        # each word's last id is one of a word end, so the words before a text's end tell where its ids end
        words = np.cumsum(end)[np.cumsum([len(t) + 1 for t in texts]) - 1]
        cuts = np.concatenate([[0], np.flatnonzero(self.ended[ids]) + 1])[words]
        return np.split(ids, cuts[:-1])


class FastTokenizer:
    """library: the tokenizers object as its file describes it."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        added = spec.get("added_tokens", [])
        self.specials = [x["content"] for x in added]
        pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
        suffix = model.get("end_of_word_suffix") or ""
        ranks = ranks_of({t: i for t, i in model["vocab"].items() if t not in self.specials}, suffix)
        self.many, self.cut = None, None
        able = len({k for k in ranks if len(k) == 1}) == 256 and not any(x.get("normalized") for x in added)
        if able and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer") and not suffix:
            encode = tiktoken.Encoding("byte-level", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
            self.many, self.cut = lambda texts: [np.array(encode(t), "<u4") for t in texts], _BEFORE_WORD
        elif able and suffix and pre.get("type") == "Sequence" and pre["pretokenizers"][0].get("behavior") == "Removed" and _spaces_and_lower_case(spec.get("normalizer")) and pre["pretokenizers"][0]["pattern"].get("Regex") == WORD_PATTERN:
            encode = tiktoken.Encoding("words", pat_str=r"[^\x00]+\x00", mergeable_ranks=ranks, special_tokens={}).encode_ordinary
            self.many, self.cut = _Words(encode, ranks).ids, _WHITE_SPACE

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """For each text its ids as an uint32 array: those of library.encode(text, add_special_tokens=False)."""
        out: list = [None] * len(texts)
        plain = []
        for i, text in enumerate(texts):
            if self.many is None or _ODD.search(text) or any(s in text for s in self.specials):
                out[i] = np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4")
            elif len(text) > LONG_TEXT:
                out[i] = np.concatenate([self.many([x])[0] for x in self._parts(text)])
            else:
                plain.append(i)
        for part in slices([texts[i] for i in plain], LONG_TEXT):
            for i, ids in zip(plain[part], self.many([texts[i] for i in plain[part]]), strict=True):
                out[i] = ids
        return out

    def _parts(self, text: str) -> Iterator[str]:
        """A long text in parts, cut where no token can cross."""
        at = 0
        while at < len(text):
            found = self.cut.search(text, at + LONG_TEXT)
            end = found.start() if found else len(text)
            yield text[at:end]
            at = end


def _spaces_and_lower_case(normalizer: dict | None) -> bool:
    """NFC, runs of white space as one space, lower case: nothing else is done to plain texts but to lower their case."""
    steps = (normalizer or {}).get("normalizers", [])
    return [x["type"] for x in steps] == ["NFC", "Replace", "Lowercase"] and (steps[1]["pattern"], steps[1]["content"]) == ({"Regex": r"\s+"}, " ")


@lru_cache(maxsize=2)
def tokenizer(path: str) -> FastTokenizer:
    """One per worker process and file; Python workers are reused between tasks."""
    return FastTokenizer(path)


def slices(texts: list, most: int = 4_000_000) -> list[slice]:
    """Runs of texts of about `most` characters together, so that a batch of long texts is encoded piece by piece."""
    out, start, held = [], 0, 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= most:
            out.append(slice(start, i + 1))
            start, held = i + 1, 0
    return [*out, slice(start, len(texts))] if start < len(texts) else out
