"""Token ids of whole texts by a byte-level BPE of the tokenizers library, each distinct word encoded once.

These tokenizers cut a text into words first and encode each word by itself.  The cut is made here on whole Arrow
buffers; the library encodes the distinct words, and a table of fixed size remembers them.  A text with characters
whose class is not decided here (other than ASCII and Latin letters) goes through the library whole, and so does one that holds the content of an
added token, such as ``<|endoftext|>``, in capitals or small letters.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa

from mapweave.llm.words import VALUE, buffer_of, hashes

OTHER, LETTER, DIGIT, SPACE = 0, 1, 2, 3
_CLASS = np.zeros(256, np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = SPACE
_CLASS[48:58] = DIGIT
_CLASS[65:91] = _CLASS[97:123] = LETTER
_CLASS[128:192] = _CLASS[0xC3] = LETTER  # continuation bytes and the lead byte of A-grave to y-diaeresis
_SLOTS = 1 << 20
_POOL = 8 << 20


class WordEncoder:
    """Ids of texts by one tokenizer file.

    ``spaced`` words keep the space before them (byte-level vocabularies); others drop white space, take digits one
    by one and are lower-cased (word-end vocabularies)."""

    def __init__(self, path: str, spaced: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.added = sorted({t.content.encode().lower() for t in self.whole.get_added_tokens_decoder().values()})
        self.spaced = spaced
        self._forget()

    def _forget(self) -> None:
        self.key = np.zeros(_SLOTS, np.uint64)
        self.start = np.zeros(_SLOTS, np.int64)
        self.count = np.zeros(_SLOTS, np.int64)
        self.pool = np.empty(1 << 16, np.uint32)
        self.used = 0

    def _add(self, ids: np.ndarray) -> int:
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.empty_like(self.pool)])
        at = self.used
        self.pool[at : at + len(ids)] = ids
        self.used += len(ids)
        return at

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and the place of each text's first id (one more at the end); null is empty."""
        if self.used > _POOL:
            self._forget()
        data, at = buffer_of(texts)
        odd = self._odd(data, at)
        begins, ends = self._cut(data, at)
        if not self.spaced:
            data = data.copy()
            upper = ((data >= 65) & (data <= 90)) | ((data >= 0x80) & (data <= 0x9E))
            data[upper] += 32
        word_of = np.searchsorted(begins, at)
        keep = np.ones(len(begins), bool)
        for i in odd:
            keep[word_of[i] : word_of[i + 1]] = False
        begins, ends = begins[keep], ends[keep]
        start, count = self._ids_of(data, begins, ends)
        if len(odd):
            doc = np.searchsorted(at, begins, "right") - 1
            more = [self.whole.encode(texts[int(i)].as_py(), add_special_tokens=False).ids for i in odd]
            start = np.concatenate([start, [self._add(np.array(x, np.uint32)) for x in more]]).astype(np.int64)
            count = np.concatenate([count, [len(x) for x in more]]).astype(np.int64)
            doc = np.concatenate([doc, odd])
            order = np.argsort(doc, kind="stable")
            start, count, doc = start[order], count[order], doc[order]
            first = np.searchsorted(doc, np.arange(len(at)))
        else:
            first = np.searchsorted(begins, at)
        total = np.zeros(len(count) + 1, np.int64)
        np.cumsum(count, out=total[1:])
        ids = self.pool[np.repeat(start - total[:-1], count) + np.arange(total[-1])]
        return ids, total[first]

    def _odd(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Numbers of the texts that hold a character other than ASCII and Latin letters from A-grave on, or an added token."""
        low, found = data.tobytes().lower(), []
        for token in self.added:
            place = low.find(token)
            while place >= 0:
                found.append(place)
                place = low.find(token, place + 1)
        high = np.flatnonzero(data >= 0x80)
        byte = data[high]
        lead, tail = byte >= 0xC0, byte < 0xC0
        bad = lead & (byte != 0xC3) | tail & ((byte == 0x97) | (byte == 0xB7))
        return np.unique(np.searchsorted(at, np.concatenate([high[bad], np.array(found, np.int64)]), "right") - 1)

    def _cut(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begin and end of the words of all texts."""
        n = len(data)
        if n == 0:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        kind = _CLASS[data]
        new = np.empty(n, bool)  # a run of one class begins here
        new[0] = True
        new[1:] = kind[1:] != kind[:-1]
        text = np.zeros(n + 1, bool)
        text[at] = True
        new |= text[:-1]
        space = kind == SPACE
        if not self.spaced:
            new |= kind == DIGIT
        mark = np.flatnonzero((data == 39) & new)
        if self.spaced:
            # The last of a run of white space, with a text going on behind it, stands alone or leads the next word.
            last = np.flatnonzero(space[:-1] & ~space[1:] & ~text[1:-1])
            new[last] = True
            joins = last[data[last] == 32] + 1
            new[joins] = False
            mark = mark[new[mark]]
        if len(mark):
            end = np.concatenate([data, np.zeros(3, np.uint8)])
            stop = np.concatenate([text, np.ones(3, bool)])
            a, b = end[mark + 1], end[mark + 2]
            if not self.spaced:
                a, b = a | 32, b | 32
            one = np.isin(a, list(b"stmd")) & ~stop[mark + 1]
            two = ((a == ord("r")) & (b == ord("e")) | (a == ord("v")) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))) & ~stop[mark + 1] & ~stop[mark + 2]
            for at_mark, size in ((mark[one], 1), (mark[two], 2)):
                new[at_mark + 1] = False
                after = at_mark + 1 + size
                after = after[after < n]
                new[after] = True
        begins = np.flatnonzero(new)
        ends = np.append(begins[1:], n)
        if not self.spaced:
            word = ~space[begins]
            begins, ends = begins[word], ends[word]
        return begins, ends

    def _ids_of(self, data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place and number of each word's ids in the pool."""
        h = hashes(data, begins, ends, VALUE) | np.uint64(1)
        slot = ((h >> np.uint64(20)) % np.uint64(_SLOTS)).astype(np.int64)
        start, count = self.start[slot], self.count[slot]
        unknown = np.flatnonzero(self.key[slot] != h)
        if len(unknown):
            new, first, back = np.unique(h[unknown], return_index=True, return_inverse=True)
            places = unknown[first]
            raw = data.tobytes()
            words = [raw[b:e].decode() for b, e in zip(begins[places].tolist(), ends[places].tolist())]
            found = [x.ids for x in self.whole.encode_batch_fast(words, add_special_tokens=False)]
            sizes = np.array([len(x) for x in found], np.int64)
            base = self._add(np.array([i for x in found for i in x], np.uint32))
            starts = base + np.cumsum(sizes) - sizes
            start[unknown], count[unknown] = starts[back], sizes[back]
            at = slot[places]
            self.key[at], self.start[at], self.count[at] = new, starts, sizes
        return start, count
