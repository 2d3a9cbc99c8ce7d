"""Ids of a byte-level BPE file of the tokenizers library, remembered per pre-token.

The texts of a slice are cut into pre-tokens by rules on runs of character
classes, the pre-tokens are hashed and looked up together, and the library's
model is asked once per distinct pre-token of a Python worker.  Texts with
special strings or with characters outside ``common.PLAIN`` go through the
library whole, because its Unicode tables and Python's differ there.  Both ways
give the library's ids.
"""

from __future__ import annotations

import json
import os
from functools import lru_cache

import numpy as np

from millrace.llm.common import NOT_PLAIN
from millrace.llm.hashtable import HashTable
from millrace.llm.wordhash import hash_spans

REMEMBERED = 1 << 20  # pre-tokens a worker remembers before it starts anew
STEP = 1 << 20  # bytes of text that are cut at a time

# Classes of bytes: white space, letter, number, anything else, end of a text.
BLANK, LETTER, NUMBER, OTHER, END = range(5)


def _class_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes of single bytes and lead bytes, and of the characters that C2 and C3 lead by their second byte."""
    single = np.full(256, OTHER, np.uint8)
    single[0] = END
    single[[0x20, 0x09, 0x0A, 0x0D]] = BLANK
    for b in range(0x21, 0x7F):
        single[b] = LETTER if chr(b).isalpha() else NUMBER if chr(b).isdigit() else OTHER
    single[[0xC4, 0xC5]] = LETTER
    c2, c3 = np.full(256, OTHER, np.uint8), np.full(256, LETTER, np.uint8)
    c2[[0xAA, 0xB5, 0xBA]] = LETTER
    c2[[0xB2, 0xB3, 0xB9, 0xBC, 0xBD, 0xBE]] = NUMBER
    c3[[0x97, 0xB7]] = OTHER
    return single, c2, c3


SINGLE, AFTER_C2, AFTER_C3 = _class_tables()


def classes(raw: np.ndarray) -> np.ndarray:
    """The class of every byte of plain texts; the bytes of one character share its class."""
    out = SINGLE[raw]
    if raw.max(initial=0) < 0x80:
        return out
    for lead, table in ((0xC2, AFTER_C2), (0xC3, AFTER_C3)):
        at = np.flatnonzero(raw == lead)
        out[at] = table[raw[at + 1]]
    more = (raw & 0xC0) == 0x80
    second = np.flatnonzero(more & ~np.r_[False, more[:-1]])
    out[second] = out[second - 1]
    third = np.flatnonzero(more & np.r_[False, more[:-1]])
    out[third] = out[third - 1]
    return out


def pre_token_starts(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the pre-tokens of plain texts begin, and the class of every byte; each text ends with a zero byte.

    Runs of one class are pre-tokens.  Of white space before other characters, the last one stands
    alone, or, if it is a space, begins what follows.  A lone apostrophe takes
    the ending of an English contraction with it.
    """
    kind = classes(raw)
    begins = np.r_[True, kind[1:] != kind[:-1]]
    begins[kind == END] = True
    blank_ends = np.flatnonzero((kind[:-1] == BLANK) & (kind[1:] != BLANK) & (kind[1:] != END)) + 1
    begins[blank_ends - 1] = True
    spaced = blank_ends[raw[blank_ends - 1] == 0x20]
    begins[spaced] = False
    quote = np.flatnonzero((raw == 0x27) & begins)
    quote = quote[kind[quote + 1] == LETTER]  # a zero byte follows the last text, so two more bytes are there
    if len(quote):
        one, two = raw[quote + 1], raw[quote + 2]
        short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
        long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e")))
        long |= (one == ord("l")) & (two == ord("l"))
        begins[quote[short | long] + 1] = False
        begins[quote[short] + 2] = True
        begins[quote[long] + 3] = True
    return np.flatnonzero(begins), kind


def byte_alphabet() -> dict[int, str]:
    """The printable character byte-level BPE writes for each byte."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(others)}


class ByteIds:
    """Serialised ids (little-endian unsigned 32-bit) of whole texts."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["normalizer"] is not None:
            raise ValueError(f"{path} is not a plain byte-level tokenizer")
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.model = self.tokenizer.model
        self.alphabet = {chr(b): c for b, c in byte_alphabet().items()}
        self.table = str.maketrans(self.alphabet)
        self._forget()

    def _forget(self) -> None:
        self.known = HashTable(REMEMBERED)
        self.ids = np.empty(0, "<u4")
        self.starts = np.zeros(1, np.int64)  # of each entry's ids, and their end

    def _learn(self, hashes: np.ndarray, pre_tokens: list[bytes]) -> None:
        """Asks the model for the ids of new pre-tokens."""
        found = [[t.id for t in self.model.tokenize(p.decode("latin-1").translate(self.table))] for p in pre_tokens]
        self.known.insert(hashes)
        counts = np.fromiter(map(len, found), np.int64, len(found))
        self.ids = np.concatenate([self.ids, np.array([i for ids in found for i in ids], "<u4")])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(counts)])

    def _plain(self, texts: list[bytes]) -> list[bytes]:
        raw = np.frombuffer(b"\0".join([*texts, b""]), np.uint8)
        starts, kind = pre_token_starts(raw)
        ends = np.r_[starts[1:], len(raw)]
        inside = kind[starts] != END
        before = np.cumsum(inside)[~inside]  # pre-tokens up to the end of each text
        starts, ends = starts[inside], ends[inside]
        hashes = hash_spans(raw, starts, ends)
        entries = self.known.find(hashes)
        new = np.flatnonzero(entries < 0)
        if len(new):
            keys, first = np.unique(hashes[new], return_index=True)
            if self.known.size + len(keys) > REMEMBERED:
                self._forget()
                keys, new = np.unique(hashes, return_index=True)
            else:
                new = new[first]
            places = zip(starts[new].tolist(), ends[new].tolist(), strict=True)
            self._learn(keys, [raw[a:b].tobytes() for a, b in places])
            entries = self.known.find(hashes)
        counts = self.starts[entries + 1] - self.starts[entries]
        total = np.r_[0, np.cumsum(counts)]
        ids = self.ids[np.repeat(self.starts[entries] - total[:-1], counts) + np.arange(total[-1])].tobytes()
        edges = (4 * total[np.r_[0, before]]).tolist()
        return [ids[a:b] for a, b in zip(edges, edges[1:], strict=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Serialised ids of each text."""
        out: list[bytes] = [b""] * len(texts)
        run: list[bytes] = []
        places: list[int] = []
        size = 0
        for k, text in enumerate(texts):
            if NOT_PLAIN.search(text) or any(s in text for s in self.special):
                out[k] = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
                continue
            run.append(text.encode())
            places.append(k)
            size += len(run[-1])
            if size >= STEP:
                for place, ids in zip(places, self._plain(run), strict=True):
                    out[place] = ids
                run, places, size = [], [], 0
        for place, ids in zip(places, self._plain(run) if run else [], strict=True):
            out[place] = ids
        return out


@lru_cache(maxsize=2)
def byte_ids(path: str) -> ByteIds:
    """One instance per Python worker and file."""
    return ByteIds(path)
