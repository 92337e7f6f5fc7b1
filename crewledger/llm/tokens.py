"""Token ids with public tokenizer files, equal to the tokenizers library's and faster.

For a tokenizer that drops white space every distinct word is encoded once per worker: words between
blanks do not touch each other there, so that their ids, put end to end, are those of the text.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from crewledger.llm.frames import kept_for_task, segment_starts

# Distinct pieces a worker remembers before it forgets the rarer ones, about 100 bytes each beside their own, and the bytes of all of them.
REMEMBERED, REMEMBERED_BYTES = 200_000, 16 << 20
PER_CALL = 4096

def public_path(name: str) -> str:
    """Where a public tokenizer file is installed."""
    import public_tokenizers

    return public_tokenizers.path(name)


@kept_for_task
def tokenizer(path: str):
    """The library's tokenizer of a file, without truncation and padding."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark gives each task its core
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


def byte_alphabet() -> dict[str, int]:
    """Printable bytes stand for themselves, the others for characters from U+0100 onwards."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + n): b for n, b in enumerate(others)}


@kept_for_task
def byte_table(path: str) -> tuple[list[bytes], np.ndarray]:
    """The bytes every id of a byte-level tokenizer stands for, and their lengths."""
    byte_of = byte_alphabet()
    found = tokenizer(path)
    table = [b""] * found.get_vocab_size()
    for token, number in found.get_vocab().items():
        known = all(c in byte_of for c in token)
        table[number] = bytes(byte_of[c] for c in token) if known else token.encode()
    return table, np.fromiter(map(len, table), np.int64, len(table))


@kept_for_task
def special_ids(path: str) -> dict[str, int]:
    with open(path) as file:
        return {t["content"]: t["id"] for t in json.load(file)["added_tokens"]}


# The faster library splits by backtracking, which overflows its stack on very long runs of blanks; these go to the other one.
LONG_BLANKS = regex.compile(r"\p{White_Space}{4096,}")
# The splitting rule of byte-level tokenizers.
BYTE_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@kept_for_task
def byte_encoder(path: str) -> Callable[[str], list[int]]:
    """Ids of a text with a byte-level tokenizer file, by the faster of the two installed BPE libraries.

    Both give the same ids where ids count up in the order of the merges and the splitting is the usual
    one; for any other file the first library encodes.
    """
    import tiktoken

    with open(path) as file:
        made = json.load(file)
    table = byte_table(path)[0]
    special = special_ids(path)
    model, cut = made["model"], made["pre_tokenizer"] or {}
    merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["merges"]]
    usual = (
        made["normalizer"] is None and cut.get("type") == "ByteLevel" and cut.get("use_regex") and not cut.get("add_prefix_space")
        and all(model["vocab"].get(m) == 256 + n for n, m in enumerate(merged)) and not model.get("ignore_merges")
        and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in made["added_tokens"])
    )
    if not usual:
        return lambda text: tokenizer(path).encode(text, add_special_tokens=False).ids
    ranks = {token: number for number, token in enumerate(table) if number not in special.values()}
    fast = tiktoken.Encoding("file", pat_str=BYTE_SPLIT, mergeable_ranks=ranks, special_tokens=special)

    def part(text: str) -> list[int]:
        if any(s in text for s in special):
            return fast.encode(text, allowed_special="all")
        return fast.encode_ordinary(text)

    def encode(text: str) -> list[int]:
        found = LONG_BLANKS.search(text)
        if found is None:
            return part(text)
        ids, done = [], 0
        while found:
            # A run of blanks is cut off from what stands before it, and its last one goes with what follows.
            end = found.end() - (found.end() < len(text))
            ids += part(text[done : found.start()])
            ids += tokenizer(path).encode(text[found.start() : end], add_special_tokens=False).ids
            done = end
            found = LONG_BLANKS.search(text, end)
        return ids + part(text[done:])

    return encode


# How a lower-casing word tokenizer splits simple words, here set apart by U+0001.
WORD_SPLIT = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[^\\W\\d_²³¹¼½¾]+|[0-9²³¹¼½¾]|(?:[^\\w\x01]|_)+")
# Words of characters below U+0250 are in normal form, and everybody splits and lower-cases them alike.
SIMPLE_WORD = re.compile(rb"(?:[\x02-\x3b\x3d-\x7f]|<(?!\|)|\xc2[\x80-\x84\x86-\x9f\xa1-\xbf]|[\xc3-\xc9][\x80-\xbf])*")
WORD_END, APART = b"\x00", b"\x01"


@kept_for_task
def word_encoder(path: str) -> Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]] | None:
    """Ids of distinct simple words with a tokenizer file that marks word ends; None if it works otherwise.

    The end of a word is one more byte that joins its neighbour before anything else; from there on the
    merges are those of the file.
    """
    import tiktoken

    with open(path) as file:
        made = json.load(file)
    model, vocab, end = made["model"], made["model"]["vocab"], made["model"].get("end_of_word_suffix")
    steps = [n["type"] for n in (made["normalizer"] or {}).get("normalizers", [])]
    if not end or steps != ["NFC", "Replace", "Lowercase"] or model.get("dropout"):
        return None
    alphabet = byte_alphabet()

    def raw(token: str) -> bytes:
        marked = token.endswith(end)
        return bytes(alphabet[c] for c in (token[: -len(end)] if marked else token)) + WORD_END * marked

    order = [bytes([b]) for b in range(256)] + [bytes([b]) + WORD_END for b in range(2, 256)]
    order += [raw("".join(m) if isinstance(m, list) else m.replace(" ", "")) for m in model["merges"]]
    ranks = {token: rank for rank, token in enumerate(dict.fromkeys(order))}
    special = special_ids(path)
    number = {raw(t): n for t, n in vocab.items() if t not in special}
    to_id = np.array([number.get(token, 0) for token in ranks], np.uint32)
    fast = tiktoken.Encoding("file", pat_str=r"\x01|[^\x00\x01]+\x00", mergeable_ranks=ranks, special_tokens={})

    def encode(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        marked = WORD_SPLIT.sub("\\g<0>\x00", APART.join(words).decode().lower())
        found = np.array(fast.encode_ordinary(marked), np.int64)
        apart = np.concatenate([[-1], np.flatnonzero(found == ranks[APART]), [len(found)]])
        return to_id[found[found != ranks[APART]]], np.diff(apart) - 1

    return encode


class Pieces:
    """Encodes words with a tokenizer that drops white space, and remembers the frequent ones."""

    def __init__(self, path: str) -> None:
        self.path = path
        self.known: dict[bytes, int] = {}
        self.bytes = 0
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.start, self.length, self.hits = (np.zeros(1 << 12, np.int64) for _ in range(3))

    def forget(self) -> None:
        """Keep the words that came up most often, half of what is remembered at most, in number and bytes."""
        count = len(self.known)
        kept = np.argsort(-self.hits[:count], kind="stable")[: REMEMBERED // 2]
        words = list(self.known)
        sizes = np.fromiter((len(words[k]) for k in kept.tolist()), np.int64, len(kept))
        kept = np.sort(kept[(self.hits[kept] > 1) & (np.cumsum(sizes) <= REMEMBERED_BYTES // 2)])
        lengths = self.length[kept]
        ends = np.cumsum(lengths)
        flat = self.flat[np.repeat(self.start[kept] - (ends - lengths), lengths) + np.arange(lengths.sum())]
        self.flat, self.used = np.concatenate([flat, np.zeros(1 << 16, np.uint32)]), len(flat)
        room = np.zeros(1 << 12, np.int64)
        self.start, self.length = np.concatenate([ends - lengths, room]), np.concatenate([lengths, room])
        self.hits = np.concatenate([np.ones(len(kept), np.int64), room])
        self.known = {words[k]: n for n, k in enumerate(kept.tolist())}
        self.bytes = sum(map(len, self.known))

    def _library(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        found = tokenizer(self.path).encode([p.decode() for p in pieces], is_pretokenized=True, add_special_tokens=False)
        ids = np.array(found.ids, np.uint32)
        return ids, np.bincount(np.array(found.word_ids, np.int64), minlength=len(pieces)) if len(ids) else np.zeros(len(pieces), np.int64)

    def _add(self, pieces: list[bytes]) -> None:
        fast = word_encoder(self.path)
        simple = [fast is not None and SIMPLE_WORD.fullmatch(p) is not None for p in pieces]
        plain, other = list(compress(pieces, simple)), [p for p, s in zip(pieces, simple, strict=True) if not s]
        for part, how in ((plain, fast), *((other[at : at + PER_CALL], self._library) for at in range(0, len(other), PER_CALL))):
            if not part:
                continue
            ids, counts = how(part)
            first, total = len(self.known), len(self.known) + len(part)
            while self.used + len(ids) > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
            while total > len(self.start):
                self.start, self.length, self.hits = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.length, self.hits))
            self.flat[self.used : self.used + len(ids)] = ids
            self.start[first:total] = self.used + segment_starts(counts)
            self.length[first:total] = counts
            self.hits[first:total] = 0
            self.used += len(ids)
            self.known.update(zip(part, range(first, total), strict=True))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and how many each text has; null is empty."""
        split = pc.ascii_split_whitespace(texts.cast(pa.string()).fill_null(""))
        counts = np.diff(split.offsets.to_numpy())
        coded = split.flatten().dictionary_encode()
        if not len(coded):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        coded = pa.DictionaryArray.from_arrays(coded.indices, coded.dictionary.cast(pa.binary()))
        distinct: list[bytes] = coded.dictionary.to_pylist()
        if len(self.known) + len(distinct) > max(REMEMBERED, 2 * len(distinct)) or self.bytes > REMEMBERED_BYTES:
            self.forget()
        missing = [p for p in distinct if p not in self.known]
        if missing:
            self._add(missing)
            self.bytes += sum(map(len, missing))
        number = np.fromiter(map(self.known.__getitem__, distinct), np.int64, len(distinct))
        self.hits[number] += 1
        piece = number[coded.indices.to_numpy(zero_copy_only=False)]
        lengths = self.length[piece]
        ends = np.cumsum(lengths)
        ids = self.flat[np.repeat(self.start[piece] - (ends - lengths), lengths) + np.arange(ends[-1])]
        edges = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
        return ids, np.diff(edges)


@kept_for_task
def pieces_of(path: str) -> Pieces:
    return Pieces(path)
