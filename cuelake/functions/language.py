"""Language tags, scripts and the recognisers' languages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Recogniser tags of language choices, and regional forms of two-letter codes.
ALIASES = {
    "zh": ["zh-Hans", "zh-Hant"], "zh-cn": ["zh-Hans"], "zh-sg": ["zh-Hans"], "zh-hans": ["zh-Hans"], "zh-tw": ["zh-Hant"], "zh-hk": ["zh-Hant"],
    "zh-mo": ["zh-Hant"], "zh-hant": ["zh-Hant"], "en": ["en-US"], "es": ["es-ES"], "pt": ["pt-BR", "pt-PT"],
}
REGIONAL = {"ar": "ar-SA", "de": "de-DE", "fr": "fr-FR", "hi": "hi-IN", "it": "it-IT", "ja": "ja-JP", "ko": "ko-KR", "ru": "ru-RU", "th": "th-TH", "tr": "tr-TR", "vi": "vi-VN"}
# Languages that the second recogniser reads.
READABLE = ["zh", "en", "es", "ja", "fr", "de", "pt", "it", "vi"]
# Characters that tell simplified from traditional script, in pairs.
SIMPLIFIED = "爱边变场处发个国还后会仅开来里领门区让时说台体万为现学亿应与长这种"
TRADITIONAL = "愛邊變場處發個國還後會僅開來裡領門區讓時說臺體萬為現學億應與長這種"
# Tags that a request for one Chinese script accepts besides itself.
HANS, HANT = ["zh", "zh-cn", "zh-sg", "zh-chs"], ["zh", "zh-tw", "zh-hk", "zh-mo", "zh-cht"]
# Order of preference of languages by platform.
PRIORITY = {"youtube": ["en", "zh-Hans", "zh-Hant", "zh", "es", "ja", "ko", "fr", "de", "pt", "it"], "bilibili": ["zh-Hans", "zh-Hant", "zh", "en", "ja", "ko"]}


def language_key(tag: Column) -> Column:
    return F.lower(F.replace(F.trim(tag), F.lit("_"), F.lit("-")))


def primary_tag(key: Column) -> Column:
    return F.split_part(key, F.lit("-"), F.lit(1))


def language_matches(candidate: Column, requested: Column) -> Column:
    """Equal keys; else, for a Chinese script, the tags that imply it and no others; else the same primary subtag."""
    c, r = language_key(candidate), language_key(requested)
    return F.when(c == r, True).when(r == "zh-hans", c.isin(HANS)).when(r == "zh-hant", c.isin(HANT)).otherwise(primary_tag(c) == primary_tag(r))


def base_language(tag: Column, automatic: str | None = "auto") -> Column:
    """Primary subtag; ``automatic`` stands for no choice (null for engines that detect by themselves)."""
    key = language_key(F.coalesce(tag, F.lit("")))
    return F.when(key.isin("", "auto"), F.lit(automatic)).otherwise(primary_tag(key))


def recogniser_tags(tag: Column) -> Column:
    """Tags to hand to a recogniser: aliases, regional forms, else the tag itself; empty for no choice."""
    code = F.replace(F.trim(F.coalesce(tag, F.lit(""))), F.lit("_"), F.lit("-"))
    low = F.lower(code)
    out = F.when(low.isin("", "auto"), F.array().cast("array<string>"))
    for k, v in ALIASES.items():
        out = out.when(low == k, F.array(*map(F.lit, v)))
    for k, v in REGIONAL.items():
        out = out.when(low == k, F.array(F.lit(v)))
    return out.when(F.length(code) == 2, F.array(low)).otherwise(F.array(code))


def readable(tag: Column) -> Column:
    """The second recogniser covers the language, or there is no choice to cover."""
    key = language_key(F.coalesce(tag, F.lit("")))
    return key.isin("", "auto") | primary_tag(key).isin(READABLE)


def _count_of(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def detected_script(requested: Column, text: Column) -> Column:
    """An explicit request stands; else no Han gives ``und``, and the characters of one script only decide."""
    t = F.coalesce(text, F.lit(""))
    s, z = _count_of(t, SIMPLIFIED), _count_of(t, TRADITIONAL)
    found = F.when(~t.rlike("[㐀-鿿]"), "und").when(z > s, "zh-Hant").when(s > z, "zh-Hans").otherwise("zh")
    return F.when(F.lower(F.trim(requested)) != "auto", requested).otherwise(found)


def reading_order(title: Column, author: Column, platform: Column) -> Column:
    """Languages to read burned-in captions with, where none was chosen, as one comma-separated list."""
    context = F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(author, F.lit("")))
    script = detected_script(F.lit("auto"), context)
    return (
        F.when(script == "zh-Hant", "zh-Hant,zh-Hans,en-US,es-ES")
        .when((script == "zh-Hans") | F.coalesce(platform == "bilibili", F.lit(False)), "zh-Hans,zh-Hant,en-US,es-ES")
        .when(script != "und", "zh-Hant,zh-Hans,en-US,es-ES")
        .otherwise("en-US,zh-Hant,zh-Hans,es-ES")
    )


def resolved_language(requested: Column, detected: Column) -> Column:
    return F.when(F.lower(F.trim(requested)) == "auto", detected).otherwise(requested)
