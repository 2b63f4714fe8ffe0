"""The overlap merge of chunk transcripts as a stream: chunks come in any order, and are merged in theirs.

A row is the result of one chunk with its window. Segments are placed by native expressions; the state of a
recording is the chunks that came before their turn (a map by number), the number whose turn it is, and the last kept segment,
which the next chunk may still replace. When a chunk is there whose turn it is, it and all that follow it without a gap go through
the same walk as in batch, so dispositions are final when they are given out. After its last chunk nothing of a recording is kept but that it has ended.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from talkweave.config import ChunkConfig
from talkweave.operators import merge

SEGMENTS = "array<struct<start: double, end: double, text: string, avg_logprob: double, no_speech_prob: double, compression_ratio: double, temperature: double>>"
#: One row per chunk; is_last: the recording has no further one.
CHUNKS = f"recording_id string, chunk_idx int, is_last boolean, raw_start long, raw_end long, main_start long, main_end long, segments {SEGMENTS}"
FLOATS = ("raw_from", "raw_to", "start", "end", *merge.METRICS)


def _plain(row: dict) -> dict:
    """A placed segment as JSON can hold it."""
    own = {c: row[c] for c in ("recording_id", "text", "bare")} | {c: int(row[c]) for c in ("chunk_idx", "seq")} | {c: bool(row[c]) for c in ("boundary", "contained")}
    own |= {c: None if pd.isna(row[c]) else float(row[c]) for c in FLOATS}
    return own | {"score": [None if pd.isna(v) else float(v) for v in row["score"]]}


class Merger(StatefulProcessor):
    """M1 to M5 for one recording."""

    def __init__(self, cfg: ChunkConfig) -> None:
        self.cfg = cfg

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.waiting = handle.getMapState("waiting", "chunk_idx int", "is_last boolean, segments string")
        self.turn = handle.getValueState("turn", "next int, last string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        turn, last = self.turn.get() if self.turn.exists() else (0, None)
        arrived: dict[int, tuple[bool, list[dict]]] = {}
        for pdf in rows:
            for row in pdf.to_dict("records"):
                segments = arrived.setdefault(int(row["chunk_idx"]), (bool(row["is_last"]), []))[1]
                if row["seq"] is not None and not pd.isna(row["seq"]):
                    segments.append(_plain(row))
        for chunk, (is_last, segments) in arrived.items():
            if turn is not None and chunk >= turn and not self.waiting.containsKey((chunk,)):  # else it has come before
                self.waiting.updateValue((chunk,), (is_last, json.dumps(sorted(segments, key=lambda s: s["seq"]))))
        walk, out = merge.Walk(self.cfg, None if last is None else tuple(json.loads(last))), []
        while turn is not None and self.waiting.containsKey((turn,)):
            is_last, segments = self.waiting.getValue((turn,))
            self.waiting.removeKey((turn,))
            for s in json.loads(segments):
                out += walk.feed(s)
            turn += 1
            if is_last:
                out += walk.end()
                turn = None
                for (late,) in list(self.waiting.keys()):
                    self.waiting.removeKey((late,))
        self.turn.update((turn, None if walk.last is None else json.dumps(walk.last)))
        yield merge._disposed("recording_id", out)

    def close(self) -> None:
        pass


def disposition_stream(chunks: DataFrame, cfg: ChunkConfig = ChunkConfig()) -> DataFrame:
    """merge.dispositions of a stream of CHUNKS, a segment's row once it is settled. A chunk that comes twice counts once. Needs the RocksDB state store."""
    each = chunks.select("*", F.posexplode_outer("segments").alias("seq", "_s")).select("recording_id", "chunk_idx", "is_last", "raw_start", "raw_end", "main_start", "main_end", "seq", "_s.*")
    placed = merge.placed_rows(each, cfg, keep=("is_last",))
    return placed.groupBy("recording_id").transformWithStateInPandas(Merger(cfg), merge.DISPOSED.format(key="recording_id string"), outputMode="append", timeMode="none")
