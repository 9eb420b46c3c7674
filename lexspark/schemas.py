"""Schemas of the stored tables."""

from __future__ import annotations

ARTICLE = (
    "item_index long, category string, source string, revision string, file string, chapter string, article string, "
    "article_no int, article_sub int, article_title string, body string, is_supplementary boolean"
)
ATTACHMENT = (
    "item_index long, category string, source string, revision string, file string, kind string, label string, "
    "number string, title string, body string, deleted boolean"
)
CHUNK = "kind string, item_index long, chunk_no int, start int, end int, text string"
MANIFEST = "name string, type string, file string, revision string, file_no string, origin string"
QUESTION = (
    "id string, category string, source string, question string, options array<string>, answer string, explanation string"
)
USAGE_EVENT = "ts timestamp, tool string, lang string"
