"""Whole texts to token ids with a public tokenizer file, fast on corpora whose words repeat.

Both kinds of vocabulary split a text into pieces before merging and never merge across a piece. The places used here
are always piece borders, so the ids of a text are the ids of its parts in turn. The distinct parts of a slice of texts are found by hash
with NumPy; then every part is compared with the one that stands for its hash, byte by byte, so equal hashes of different parts do no harm.
Each distinct part goes through the tokenizers library once while its ids are kept. The store has two generations of KEEP bytes:
when the young one is full it becomes the old one, and parts that are met again move back to the young. Parts of more than LONG bytes are not kept.

Strings of special tokens in a text are treated as the library does by default: they become the special token, and the text
before and after is encoded on its own. With ``special_as_text`` they are ordinary text.
"""

from __future__ import annotations

import json
import os
import re
from array import array

import numpy as np
import pyarrow as pa

from evidara.llm.textarrays import LOWER, SPACE, buffers, give_back, word_hashes

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Bytes of kept parts, ids and their overhead in one generation of the store; longer parts than LONG bytes are not kept.
KEEP, LONG, OVERHEAD = 56 << 20, 1024, 190
END_ID = 2
#: Bytes that, after a blank, start a new piece of the byte-level vocabulary: printable ASCII, and first bytes of U+00C0 to U+023F.
OPENS = np.array([0x21 <= b <= 0x7E or 0xC3 <= b <= 0xC8 for b in range(256)])
#: ASCII letters, digits and signs (but the apostrophe, which can begin a piece with letters after it): no piece holds two of these kinds.
KIND = np.array([1 if chr(b).isalpha() else 2 if chr(b).isdigit() else 3 if chr(b).isprintable() and chr(b) not in " '" else 0 for b in range(128)] + [0] * 128, dtype=np.uint8)
#: Words that both vocabularies keep whole, and that a normaliser changes in case alone.
LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")


def _byte_letters() -> dict[int, int]:
    """The character that stands for each byte in byte-level vocabularies: itself if visible, else the next free one from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: b for b in shown} | {b: 256 + i for i, b in enumerate(hidden)}


class Encoder:
    """Token ids of whole texts."""

    letters = _byte_letters()

    def __init__(self, path: str, special_as_text: bool = False, keep: int = KEEP):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        added = json.loads(self.library.to_str())["added_tokens"]
        if any(x["lstrip"] or x["rstrip"] or x["single_word"] or x["normalized"] for x in added):
            raise ValueError("special tokens that reach beyond their own string are not supported")
        self.specials = {} if special_as_text else {x["content"].encode(): x["id"] for x in added}
        self.find_specials = re.compile(b"|".join(map(re.escape, sorted(self.specials, key=len, reverse=True)))) if self.specials else None
        self.library.encode_special_tokens = True  # parts are ordinary text: special strings are cut out before
        # with a normaliser that drops white space words stand alone; else a word keeps the blank before it
        self.drops_space = self.library.normalizer is not None
        # for single words: the same vocabulary and merges without the steps that find words
        self.merges = Tokenizer.from_str(json.dumps(json.loads(self.library.to_str()) | {"normalizer": None, "pre_tokenizer": None}))
        self.size = self.library.get_vocab_size()
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.held, self.keep = 0, keep

    def _marks(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[int]]:
        """Starts, ends and ids of the special strings within rows."""
        found = [(x.start(), x.end(), self.specials[x.group()]) for x in self.find_specials.finditer(data.tobytes())] if self.find_specials else []
        a, b = np.array([x[0] for x in found], dtype=np.int64), np.array([x[1] for x in found], dtype=np.int64)
        whole = np.searchsorted(offsets, a, side="right") == np.searchsorted(offsets, b, side="left")
        return a[whole], b[whole], [x[2] for x, ok in zip(found, whole.tolist(), strict=True) if ok]

    def _spans(self, data: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the parts; borders: where texts (or what stands for one) begin and end."""
        kind = KIND[data]
        opens = np.zeros(len(data) + 1, dtype=bool)
        opens[1:-1] = (kind[1:] != kind[:-1]) & (kind[1:] > 0) & (kind[:-1] > 0)
        opens[borders] = True
        if self.drops_space:
            space = SPACE[data]
            opens[1:-1] |= space[:-1] & ~space[1:]
            starts = np.flatnonzero(opens[:-1] & ~space)
            opens[:-1] |= space
            ends = np.flatnonzero(opens)
            return starts, ends[np.searchsorted(ends, starts, side="right")]
        blank = np.zeros(len(data) + 1, dtype=bool)
        blank[: max(len(data) - 1, 0)] = (data[:-1] == 0x20) & OPENS[data[1:]]
        blank[np.maximum(borders - 1, 0)] = False  # the last blank of a text leads no word
        opens |= blank
        opens[borders] = True
        opens[2:-1] |= (kind[:-2] > 0) & (data[1:-1] == 0x0A) & (kind[2:] == 1)
        starts = np.flatnonzero(opens[:-1])
        return starts, np.append(starts[1:], len(data))[: len(starts)]

    def _learn(self, parts: list[bytes]) -> list[bytes]:
        whole, words, is_word = [], [], []
        for x in parts:
            led = not self.drops_space and x[:1] == b" "
            if (x[1:] if led else x).isalpha():  # ASCII letters stand for themselves
                words.append("Ġ" + x[1:].decode() if led else x.decode())
                is_word.append(True)
                continue
            text = x.decode()
            is_word.append(LETTERS.fullmatch(text, 1 if led else 0) is not None)
            if is_word[-1]:
                words.append((text.lower() if self.drops_space else text).encode().decode("latin-1").translate(self.letters))
            else:
                whole.append(text)
        made = iter(self.merges.encode_batch_fast(words, add_special_tokens=False)), iter(self.library.encode_batch_fast(whole, add_special_tokens=False))
        return [array("I", next(made[not w]).ids).tobytes() for w in is_word]

    def _ids(self, parts: list[bytes]) -> list[bytes]:
        found = list(map(self.young.get, parts))
        missing = [i for i, x in enumerate(found) if x is None]
        if missing:
            if self.held > self.keep:
                self.old, self.young, self.held = self.young, {}, 0
            parts = [parts[i] for i in missing]
            back = list(map(self.old.get, parts))
            learnt = iter(self._learn([x for x, ids in zip(parts, back, strict=True) if ids is None]))
            back = [next(learnt) if ids is None else ids for ids in back]
            for i, ids in zip(missing, back, strict=True):
                found[i] = ids
            if max(map(len, parts)) > LONG:
                back = [ids for x, ids in zip(parts, back, strict=True) if len(x) <= LONG]
                parts = [x for x in parts if len(x) <= LONG]
            self.young.update(zip(parts, back, strict=True))
            self.held += sum(map(len, parts)) + sum(map(len, back)) + OVERHEAD * len(parts)
        return found

    def _codes(self, data: np.ndarray, raw: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which parts stand for all (indices), and for each part the number of the one that stands for it: equal in every byte."""
        hashes = word_hashes(data, starts, ends)
        order = np.argsort(hashes)
        head = np.ones(len(order), dtype=bool)
        head[1:] = hashes[order[1:]] != hashes[order[:-1]]
        index, code = order[head], np.empty(len(order), dtype=np.int32)
        code[order] = np.cumsum(head, dtype=np.int32) - 1
        # the parts that stand for all must spell the text again
        spelt = pa.array([raw[x:y] for x, y in zip(starts[index].tolist(), ends[index].tolist(), strict=True)], pa.large_binary()).take(pa.array(code))
        sizes = ends - starts
        bounds = np.frombuffer(spelt.buffers()[1], dtype=np.int64)[: len(code) + 1] if len(code) else np.zeros(1, np.int64)
        got = np.frombuffer(spelt.buffers()[2], dtype=np.uint8)[: bounds[-1]] if bounds[-1] else np.zeros(0, np.uint8)
        text = data[~SPACE[data]] if self.drops_space and len(got) < len(data) else data
        if len(got) == len(text) == sizes.sum() and np.array_equal(bounds[1:], np.cumsum(sizes)) and np.array_equal(got, text):
            return index, code
        alike = [raw[x:y] == z for x, y, z in zip(starts.tolist(), ends.tolist(), spelt.to_pylist(), strict=True)]
        alone = np.flatnonzero(~np.array(alike, dtype=bool))
        code[alone] = len(index) + np.arange(len(alone), dtype=np.int32)
        return np.concatenate([index, alone]), code

    def encode(self, column: pa.Array, end: int = END_ID) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows back to back (unsigned 32-bit), each row's end id after them; token offsets of the rows."""
        data, offsets = buffers(column)
        a, b, special = self._marks(data, offsets)
        if self.drops_space:
            data = LOWER[data]
        starts, ends = self._spans(data, np.concatenate([offsets, a, b]) if len(a) else offsets)
        if len(a):
            mark = np.searchsorted(a, starts, side="right") - 1
            keep = (mark < 0) | (starts >= b[mark]) | (starts == a[mark])
            starts, ends, mark = starts[keep], ends[keep], mark[keep]
            at_mark = np.flatnonzero((mark >= 0) & (starts == a[mark]))
            ends[at_mark] = b
        first = np.searchsorted(starts, offsets)
        raw = data.tobytes()
        index, code = self._codes(data, raw, starts, ends)
        found = self._ids([raw[x:y] for x, y in zip(starts[index].tolist(), ends[index].tolist(), strict=True)])
        if len(a):
            code[at_mark] = len(found) + np.arange(len(a), dtype=np.int32)
            found += [array("I", [x]).tobytes() for x in special]
        found.append(array("I", [end]).tobytes())
        code = np.insert(code, first[1:], len(found) - 1)  # the end of each row is one more part
        joined = pa.array(found, pa.large_binary()).take(pa.array(code))
        if not len(code):
            return np.zeros(0, np.uint32), np.zeros(len(first), np.int64)
        bounds = np.frombuffer(joined.buffers()[1], dtype=np.int64)[: len(code) + 1] // 4
        return np.frombuffer(joined.buffers()[2], dtype="<u4")[: bounds[-1]], bounds[np.concatenate([[0], first[1:] + np.arange(1, len(first))])]


def binary(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """One binary value per row from values of equal width laid back to back."""
    bounds = (offsets * values.dtype.itemsize).astype(np.int64)
    made = pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(values))])
    return made.cast(pa.binary())


def id_width(path: str) -> str:
    """Type of stored ids: two bytes if the vocabulary (and the end id) fits."""
    return "<u2" if encoder(path).size <= 1 << 16 else "<u4"


def release() -> None:
    """Give back the memory of this worker's encoders, for a stage that is not followed by another that encodes."""
    _encoders.clear()
    give_back()


_encoders: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, keep: int = KEEP) -> Encoder:
    """One encoder per worker process, file and store size."""
    if (path, keep) not in _encoders:
        _encoders[path, keep] = Encoder(path, keep=keep)
    return _encoders[path, keep]
