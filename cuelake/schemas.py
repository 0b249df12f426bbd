"""Schemas of timed text.  Times are whole milliseconds; order is always an explicit column."""

WORD = "struct<symbol: string, start_ms: bigint, end_ms: bigint, score: double>"
SEGMENTS = f"doc_id bigint, track string, seg_idx int, start_ms bigint, end_ms bigint, text string, speaker string, language string, score double, translation string, target_lang string, words array<{WORD}>, custom map<string, string>"
DOCS = "doc_id bigint, language string, kind string, source_format string, source_path string, metadata map<string, string>"
INTERVALS = "doc_id bigint, tier string, start_ms bigint, end_ms bigint, label string"
FRAMES = "doc_id bigint, frame_idx int, max_prob double, aligned_prob double"
GROUPS = "doc_id bigint, group_idx int, start_ms bigint, end_ms bigint, skip boolean, seg_lo int, seg_hi int"
CHAPTERS = "doc_id bigint, ch_idx int, title string, start_ms bigint, end_ms bigint, summary string, quotes array<string>"
