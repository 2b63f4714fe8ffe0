"""Token ids of whole texts, by a public word-level BPE tokenizer.

The tokenizer's rules never join what ASCII white space separates, so the ids of
a text are those of its words in a row. Each distinct word of a slice goes to the
tokenizers library once; a bounded per-worker cache keeps the ids of known words.
Texts are never cut, and a cache that is full starts anew.
"""

from __future__ import annotations

import os

import numpy as np

from talkweave.llm import bytetext, workers

CACHE_WORDS = 1 << 21
CACHE_BYTES = 64 << 20
END_ID = 2
#: Larger slices repeat more words.
SLICE_BYTES = 4 << 20


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordTokenizer:
    """Encodes slices of texts. Words are looked up by a 64-bit hash and compared byte by byte with the word that
    is known under it; one that differs is encoded by itself."""

    def __init__(self, path: str, cache_words: int = CACHE_WORDS) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.cache_words = Tokenizer.from_file(path), cache_words
        self._clear()

    def _clear(self) -> None:
        self.names = np.zeros(0, np.uint64)
        # by place in names: first id and number of ids, first byte and number of bytes
        self.first = self.count = self.byte = self.size = np.zeros(0, np.int32)
        self.ids, self.bytes = np.zeros(0, np.uint32), np.zeros(0, np.uint8)

    def _ids(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        got = [e.ids for e in self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in words], add_special_tokens=False)]
        count = np.fromiter(map(len, got), np.int64, len(got))
        return np.fromiter((i for ids in got for i in ids), np.uint32, int(count.sum())), count

    def _learn(self, names: np.ndarray, words: list[bytes]) -> None:
        ids, count = self._ids(words)
        size = np.fromiter(map(len, words), np.int64, len(words))
        first, byte = np.cumsum(count) - count + len(self.ids), np.cumsum(size) - size + len(self.bytes)
        at = np.searchsorted(self.names, names)
        for field, new in (("names", names), ("first", first), ("count", count), ("byte", byte), ("size", size)):
            setattr(self, field, np.insert(getattr(self, field), at, new))  # of the field's type; a full cache is far from 2^31 ids or bytes
        self.ids = np.concatenate([self.ids, ids])
        self.bytes = np.concatenate([self.bytes, np.frombuffer(b"".join(words), np.uint8)])

    def encode(self, data: np.ndarray, offsets: np.ndarray, end_id: int | None = END_ID) -> tuple[np.ndarray, np.ndarray]:
        """Ids (uint32) of all texts in a row, each closed by end_id, and the ids before each text."""
        starts, ends, before = bytetext.words(data, offsets)
        names = bytetext.span_hashes(bytetext.prefix_hashes(data), starts, ends)
        distinct, example, which = bytetext.distinct(names)
        if len(self.names) + len(distinct) > self.cache_words or max(len(self.bytes), len(self.ids)) > CACHE_BYTES:
            self._clear()
        at = np.searchsorted(self.names, distinct)
        known = np.zeros(len(distinct), bool)
        known[at < len(self.names)] = self.names[at[at < len(self.names)]] == distinct[at < len(self.names)]
        if not known.all():
            raw, miss = data.tobytes(), example[~known]
            self._learn(distinct[~known], [raw[s:e] for s, e in zip(starts[miss].tolist(), ends[miss].tolist(), strict=True)])
            at = np.searchsorted(self.names, distinct)
        # every word against the first of its name here, and that against the known one
        view, size = bytetext.wide(data), ends - starts
        first = example[which]
        same = size == size[first]
        same[same] = bytetext.equal_spans(view, starts[same], view, starts[first[same]], size[same])
        alike = size[example] == self.size[at]
        alike[alike] = bytetext.equal_spans(view, starts[example[alike]], bytetext.wide(self.bytes), self.byte[at[alike]].astype(np.int64), size[example[alike]])
        same &= alike[which]
        at = at[which]
        begin, count, pool = self.first[at].astype(np.int64), self.count[at].astype(np.int64), self.ids
        if not same.all():
            odd = np.flatnonzero(~same)
            more, n = self._ids([data[starts[k] : ends[k]].tobytes() for k in odd.tolist()])
            begin[odd], count[odd] = np.cumsum(n) - n + len(pool), n
            pool = np.concatenate([pool, more])
        total = int(count.sum())
        word_first = np.cumsum(count) - count
        ids = pool[np.repeat(begin - word_first, count) + np.arange(total)]
        tokens = bytetext.sums(count, before)
        closing = end_id is not None
        ids_before = np.zeros(len(offsets), np.int64)
        np.cumsum(tokens + closing, out=ids_before[1:])
        if not closing:
            return ids, ids_before
        out = np.full(total + len(tokens), end_id, np.uint32)
        out[np.arange(total) + np.repeat(np.arange(len(tokens)), tokens)] = ids
        return out, ids_before


def tokenizer(path: str) -> WordTokenizer:
    """One tokenizer a worker process, with its cache of words."""
    return workers.hold(("tokenizer", path), lambda: WordTokenizer(path))
