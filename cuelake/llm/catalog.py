"""Named queries of this subpackage and their SQL twins."""

from __future__ import annotations

from cuelake.llm import areas, events, languages, leakage, lookalikes, repetition, sentences, tokens

QUERIES = {
    "p1_found": repetition.p1_found,
    "p2_found": events.p2_found,
    "p3_found": lookalikes.p3_found,
    "p3_classes": lookalikes.p3_classes,
    "p5_found": sentences.p5_found,
    "p6_found": languages.p6_found,
    "p7_ids": tokens.p7_ids,
    "p8_found": leakage.p8_found,
    "p9_found": areas.p9_found,
}
SQL: dict[str, str] = {}
