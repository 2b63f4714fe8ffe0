"""Language identification by cross-parsing entropy.

A suffix automaton of labelled text of each language tells how far a text can be
matched from any place. A text is parsed greedily into longest matches; the fewer
phrases per character a language's automaton needs, the closer the text is to it
(Ziv-Merhav cross entropy: phrases * log2(training length) / length).

Training is the one bounded part: a sample of TRAIN_DOCS labelled rows a language at most, whole texts, chosen by hash
among those of at most TRAIN_CHARS characters (a language that has none such gives its shortest row). The
sample is taken by top-k per language before the shuffle. Parsing covers every whole text; texts are cut into lanes of LANE
characters that are parsed side by side, so a phrase ends at least every LANE characters.

Automata are rebuilt by each worker from the training texts. A state's transitions by one of the COMMON most frequent letters of
all training texts stand in a dense table, all others in a hash table with open addressing; there are at most three
transitions a training character whatever the alphabet, so a worker's memory depends on the sample's length alone.

Defined results: null text or text without a letter is `und` with score 0; ties go to
the language that sorts first; rows with null lang or doc_id are never learned from; without any
labelled row every text is `und`; repeated rows get equal results; lang, source and doc_id never
enter a prediction.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkweave.llm import bytetext, storage, workers

TRAIN_DOCS = 16
TRAIN_CHARS = 3000
LANE = 1024
SLICE_BYTES = 2 << 20
#: Letters with a column of their own in the dense table.
COMMON = 64


@functools.lru_cache(1)
def letters() -> tuple[np.ndarray, np.ndarray]:
    """Of all code points: is it a letter, and its simple lower case."""
    is_letter, lower = np.zeros(0x110000, bool), np.arange(0x110000, dtype=np.int32)
    for c in range(0x110000):
        s = chr(c)
        if s.isalpha():
            is_letter[c] = True
            low = s.lower()
            if len(low) == 1:
                lower[c] = ord(low)
    return is_letter, lower


def normalised(points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case letters with one blank (0) for each run of anything else: points, offsets."""
    is_letter, lower = letters()
    out = np.where(is_letter[points], lower[points], 0)
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != 0) | (out[:-1] != 0)
    begin = offsets[:-1][offsets[:-1] < offsets[1:]]
    keep[begin] = True
    total = np.zeros(len(out) + 1, np.int64)
    np.cumsum(keep, out=total[1:])
    return out[keep], total[offsets]


class SuffixAutomaton:
    """All substrings of a string of small positive integers; state 0 is the root."""

    def __init__(self, text: np.ndarray) -> None:
        going: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in text.tolist():
            current = len(going)
            going.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in going[p]:
                going[p][c] = current
                p = link[p]
            if p >= 0:
                q = going[p][c]
                if length[p] + 1 == length[q]:
                    link[current] = q
                else:
                    clone = len(going)
                    going.append(dict(going[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and going[p].get(c) == q:
                        going[p][c] = clone
                        p = link[p]
                    link[q] = link[current] = clone
            last = current
        self.size = len(going)
        n = sum(map(len, going))
        #: transitions: state, letter, next state
        self.state, self.letter, self.next = (np.fromiter(x, np.int64, n) for x in ((s for s, to in enumerate(going) for _ in to), (c for to in going for c in to), (t for to in going for t in to.values())))


class HashTable:
    """A fixed map from non-negative 64-bit keys to non-negative numbers, looked up for arrays at once."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.bits = max(4, (4 * len(keys)).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int64)
        left, place = np.arange(len(keys)), self._place(keys)
        while len(left):
            at = place[left]
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[left[free]]  # one of those that want a place gets it
            got = self.keys[at] == keys[left]
            self.values[at[got]] = values[left[got]]
            left = left[~got]
            place[left] = (place[left] + 1) & ((1 << self.bits) - 1)

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The values, -1 for keys that aren't there."""
        out = np.full(len(keys), -1, np.int64)
        left, place = np.arange(len(keys)), self._place(keys)
        while len(left):
            at = place[left]
            found = self.keys[at] == keys[left]
            out[left[found]] = self.values[at[found]]
            left = left[~found & (self.keys[at] >= 0)]
            place[left] = (place[left] + 1) & ((1 << self.bits) - 1)
        return out


class CrossParser:
    """Parses texts against every language's automaton. States of all automata are numbered in one row."""

    def __init__(self, training: tuple[tuple[str, str], ...]) -> None:
        self.names = [name for name, _ in training]
        if not training:
            return
        parts = []
        for _, text in training:
            points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
            parts.append(normalised(points, np.array([0, len(points)]))[0])
        alphabet, count = np.unique(np.concatenate([*parts, np.zeros(1, np.int32)]), return_counts=True)
        alphabet = alphabet[np.argsort(-count, kind="stable")]
        self.code = np.zeros(0x110000, np.int32)  # 0: not in the training texts; the most frequent letters come first
        self.code[alphabet] = np.arange(1, len(alphabet) + 1)
        self.scale = np.array([math.log2(max(2, len(p))) for p in parts])
        self.letters = len(alphabet) + 1
        self.width = min(COMMON, len(alphabet)) + 1
        automata = [SuffixAutomaton(self.code[p]) for p in parts]
        self.root = np.cumsum([0, *(a.size for a in automata)])[:-1]
        state, letter, following = (np.concatenate(x) for x in zip(*((a.state + r, a.letter, a.next + r) for a, r in zip(automata, self.root, strict=True)), strict=True))
        common = letter < self.width
        self.dense = np.full((sum(a.size for a in automata), self.width), -1, np.int32)
        self.dense[state[common], letter[common]] = following[common]
        self.dense = self.dense.ravel()
        self.rare = HashTable(state[~common] * self.letters + letter[~common], following[~common])

    def step(self, state: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """Next states, -1 where there is no transition. state: by language (rows) and lane; letter: by lane."""
        common = letter < self.width
        out = self.dense[state * self.width + np.where(common, letter, 0)]  # letter 0 leads nowhere
        if not common.all():
            at = np.flatnonzero(~common)
            keys = state[:, at] * self.letters + letter[at]
            out[:, at] = self.rare.get(keys.ravel()).reshape(keys.shape)
        return out

    def phrases(self, codes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Phrases by language (rows) and text (columns)."""
        lanes = -(-np.diff(offsets) // LANE)
        of = np.repeat(np.arange(len(lanes)), lanes)
        start = offsets[of] + (np.arange(len(of)) - np.repeat(np.cumsum(lanes) - lanes, lanes)) * LANE
        size = np.minimum(offsets[of + 1] - start, LANE)
        order = np.argsort(-size, kind="stable")
        start, size = start[order], size[order]
        count = np.zeros((len(self.names), len(of)), np.int64)
        state = np.repeat(self.root[:, None], len(of), axis=1)
        root = self.root[:, None]
        for step in range(int(size[0]) if len(size) else 0):
            live = int(np.searchsorted(-size, -step))
            c = codes[start[:live] + step].astype(np.int64)
            following = self.step(state[:, :live], c)
            failed = following < 0
            fresh = np.maximum(self.step(np.broadcast_to(root, (len(root), live)), c), root)  # a letter that never occurs is a phrase of its own
            count[:, :live] += failed | (state[:, :live] == root)  # a phrase begins here
            state[:, :live] = np.where(failed, fresh, following)
        out = np.zeros((len(self.names), len(lanes)), np.int64)
        for k in range(len(self.names)):
            out[k] = np.bincount(of[order], count[k], minlength=len(lanes))
        return out

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Language and score (relative distance of the runner-up) of every text."""
        text = data.tobytes().decode("utf-8", "replace")
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        begins = np.zeros(len(data) + 1, np.int64)
        np.cumsum((data & 0xC0) != 0x80, out=begins[1:])
        is_letter, _ = letters()
        some = np.zeros(len(points) + 1, np.int64)
        np.cumsum(is_letter[points], out=some[1:])
        offsets = begins[offsets]
        lettered = some[offsets[1:]] > some[offsets[:-1]]
        if not self.names:
            return ["und"] * len(lettered), np.zeros(len(lettered))
        normal, offsets = normalised(points, offsets)
        n = np.maximum(np.diff(offsets), 1)
        rate = self.phrases(self.code[normal], offsets) * self.scale[:, None] / n
        best = rate.argmin(axis=0)
        low = rate[best, np.arange(len(n))]
        ranked = np.sort(rate, axis=0)
        second = ranked[1] if len(ranked) > 1 else np.full(len(n), np.inf)
        score = np.where(lettered, 1 - low / np.maximum(second, 1e-9), 0.0) if len(ranked) > 1 else lettered.astype(float)
        return [self.names[b] if ok else "und" for b, ok in zip(best.tolist(), lettered.tolist(), strict=True)], np.clip(score, 0, 1)


def parser(training: tuple[tuple[str, str], ...]) -> CrossParser:
    """One parser a worker process."""
    return workers.hold(("parser", training), lambda: CrossParser(training))


def held_out() -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(3)) == 1


def training_text(docs: DataFrame, train_docs: int = TRAIN_DOCS, train_chars: int = TRAIN_CHARS) -> tuple[tuple[str, str], ...]:
    """(lang, text) of each labelled language, from documents that aren't held out: train_docs rows of whole texts a language at most."""
    known = docs.select("doc_id", "lang", "text").where(F.col("doc_id").isNotNull() & ~held_out() & F.col("lang").isNotNull() & (F.length("text") > 0))
    # the rank is by two numbers a row; Spark keeps the first rows of each language in a task before it shuffles them
    size = F.char_length("text")
    keys = known.select("lang", F.xxhash64("doc_id", "text").alias("at"), F.when(size <= train_chars, 0).otherwise(size).alias("size"))
    ranked = keys.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("size", "at")))
    some = ranked.where(F.col("n") <= train_docs).where("n = 1 or size = 0").select("lang", "at").collect()
    if not some:
        return ()
    wanted = F.broadcast(docs.sparkSession.createDataFrame(some, "lang string, at long").distinct())  # train_docs rows a language
    rows = known.withColumn("at", F.xxhash64("doc_id", "text")).join(wanted, ["lang", "at"], "left_semi").groupBy("lang", "at").agg(F.first("text").alias("text")).collect()
    texts: dict[str, list] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["at"])):
        texts.setdefault(r["lang"], []).append(r["text"])
    return tuple((lang, " ".join(dict.fromkeys(t))) for lang, t in sorted(texts.items()))


def identified(docs: DataFrame, training: tuple[tuple[str, str], ...] | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every whole text."""
    training = training_text(docs) if training is None else training

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = parser(training)
        for batch in batches:
            for row, end, data, offsets in bytetext.slices(batch.column("text"), SLICE_BYTES):
                names, score = found.predict(data, offsets)
                yield pa.record_batch([batch.column("doc_id").slice(row, end - row), batch.column("held_out").slice(row, end - row), pa.array(names, pa.string()), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])

    storage.bounded_batches(docs.sparkSession)
    kept = docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), F.col("text").cast("string"))
    return kept.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
