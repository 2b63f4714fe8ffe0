"""Explicit schemas; JSON readers that use them drop unknown keys."""

from __future__ import annotations

SEGMENT = "struct<id: int, seek: int, start: double, end: double, text: string, tokens: array<int>, temperature: double, avg_logprob: double, compression_ratio: double, no_speech_prob: double>"
FLAGGED = "struct<start: double, end: double, text: string, reasons: array<string>, avg_logprob: double, compression_ratio: double, no_speech_prob: double>"
DIAGNOSTICS = f"struct<flags: array<string>, flagged_segments: array<{FLAGGED}>, metrics: map<string, double>>"
RESULT = f"struct<filename: string, text: string, language: string, duration: double, window_start_seconds: double, window_end_seconds: double, segments: array<{SEGMENT}>, diagnostics: {DIAGNOSTICS}>"
PAYLOAD = f"struct<text: string, language: string, duration: double, segments: array<{SEGMENT}>>"

RECORDINGS = "recording_id string, filename string, sample_rate int, pcm binary"
SPEECH = "recording_id string, seg_idx int, start_sample bigint, end_sample bigint, start double, end double"
CHUNKS = "recording_id string, chunk_idx int, raw_start bigint, raw_end bigint, main_start bigint, main_end bigint"
KEY_TERMS = "id string, audio_path string, key_terms array<string>"
VIDEO_DESCRIPTIONS = "video_id string, title string, description string, published_at string"

#: Knowledge base. entities and relations are a property graph; units and tags meet in unit_tags.
KNOWLEDGE_BASE = {
    "notes": "id bigint, title string, body string, source string, lang string, hash string, created_at timestamp, updated_at timestamp",
    "units": "id bigint, note_id bigint, utype string, text string, span struct<lower: int, upper: int>, parent_id bigint, embed array<float>, created_at timestamp",
    "entities": "id bigint, name string, etype string, attributes map<string, string>",
    "relations": "id bigint, head_id bigint, tail_id bigint, rtype string, evidence_unit_id bigint",
    "tags": "id bigint, skos_uri string, pref_label string, alt_labels array<string>",
    "unit_tags": "unit_id bigint, tag_id bigint",
}
