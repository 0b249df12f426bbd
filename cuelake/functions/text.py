"""Text rules as columns: normalising, tokens, markers, tags, names, URLs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

# The characters that count as punctuation, and those that end a sentence.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~。，、？！：；·￥…—～“”‘’《》〈〉【】〔〕〖〗（）「」『』・〃〆〇〒〓〘〙〚〛〜〝〞〟،؛؟๏๚๛־׀׃׆¡¿«»‹›‐‑‒–―‚„†‡•‣′″‴‰‱"
END_PUNCTUATION = ".!?\"']）。！？”】」』〗〙〛｡؟…"

# Fixed value: alternatives of a token, first match wins.  (?d): only a line feed ends a line.
TOKEN = (
    r"(\[[^\]]+\]"
    r"|[$€£¥￥＄₹₩₽฿₪₺₴₦₫₱₡﷼](?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?(?:[KkMmBbTt]\b)?"
    r"|(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?%"
    r"|\d{1,3}(?:,\d{3})+(?:\.\d+)?"
    r"|[a-zA-Z0-9À-ɏ]+(?:'[a-zA-Z]{1,2})?"
    r"|[一-鿿]|.)"
)
#: White space is a token of one character.
BLANKS = [" ", "\t", "\n", "\x0b", "\f", "\r"]
# Fixed value: names of a song's parts.
SECTION = r"(?i)\[\s*((?:pre[-\s]?|post[-\s]?)?(?:verse|chorus|hook|bridge|outro|intro|refrain|interlude|instrumental|coda|drop|breakdown|reprise))\b[^\]]*\]"


def one_of(c: Column, values) -> Column:
    return c.isin(*values)


def tokens(c: Column, keep_spaces: bool = False) -> Column:
    """Bracketed notes, amounts, numbers, words with their contraction, single CJK characters, single other characters."""
    found = F.regexp_extract_all(c, F.lit("(?d)" + TOKEN), F.lit(1))
    return found if keep_spaces else F.filter(found, lambda t: ~t.isin(*BLANKS))


def is_punctuation(token: Column) -> Column:
    return (F.length(token) == 1) & ~token.rlike(r"[\s\p{L}\p{N}一-鿿À-ɏ]")


def attach_punctuation(words: Column) -> Column:
    """Each punctuation token joined to the token before it; a lone token stays."""

    def put(acc: Column, t: Column) -> Column:
        last = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.concat(F.element_at(acc, -1), t)))
        return F.when((F.size(acc) > 0) & is_punctuation(t), last).otherwise(F.concat(acc, F.array(t)))

    return F.aggregate(words, F.array().cast("array<string>"), put)


def normalize(c: Column) -> Column:
    """Entities decoded, tags dropped, apostrophes straightened, white space collapsed."""
    out = F.regexp_replace(c, r"<[^<>]*>", "")
    for entity, plain in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(plain))
    out = F.translate(out, "’‘", "''")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def match_normalize(c: Column) -> Column:
    """For matching: link texts alone, lower case, letters and digits and single spaces."""
    out = F.regexp_replace(c, r"\[([^\]]+)\]\([^)]+\)", "$1")
    out = F.regexp_replace(F.lower(out), r"[^\p{L}\p{M}\p{N}_\s]", "")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def match_keys(norm: Column) -> Column:
    """First 8, 5, 3 words, then first 20, 12, 6 characters, as far as there are so many, without repeats."""
    words = F.split(norm, " ")
    by_words = [F.when(F.size(words) >= n, F.array_join(F.slice(words, 1, n), " ")) for n in (8, 5, 3)]
    by_chars = [F.when(F.length(norm) >= n, F.substring(norm, 1, n)) for n in (20, 12, 6)]
    return F.array_distinct(F.filter(F.array(*by_words, *by_chars), lambda k: k.isNotNull()))


def is_event_marker(c: Column) -> Column:
    t = F.trim(c)
    return t.startswith("[") & t.endswith("]")


def ends_sentence(c: Column) -> Column:
    return F.coalesce(one_of(F.right(F.rtrim(c), F.lit(1)), list(END_PUNCTUATION)), F.lit(False))


def has_timestamp_word(c: Column) -> Column:
    """Whether a whole word is a time like 1:02:03 or 02:03.500."""
    return F.exists(F.split(c, r"\s+"), lambda w: w.rlike(r"^[\[(]?\d{1,2}:\d{2}(?::\d{2})?(?:[.,]\d{1,3})?[\])]?$"))


def song_sections(c: Column) -> Column:
    """Kinds of song section that the text marks, lower case, without repeats."""
    return F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(SECTION), F.lit(1)), lambda s: F.replace(F.lower(s), F.lit(" "), F.lit("-"))))


def asr_tag(c: Column) -> Column:
    """(language, text) of recogniser output with a language tag in front."""
    t = F.trim(c)
    named, coded = r"(?s)^language\s+(\S+?)\s*<asr_text>(.*?)(?:</asr_text>)?$", r"(?s)^<\|([A-Za-z-]+)\|>(.*)$"
    out = F.when(t.rlike(named), F.struct(F.regexp_extract(t, named, 1).alias("language"), F.trim(F.regexp_extract(t, named, 2)).alias("text")))
    out = out.when(t.rlike(coded), F.struct(F.regexp_extract(t, coded, 1).alias("language"), F.trim(F.regexp_extract(t, coded, 2)).alias("text")))
    return out.otherwise(F.struct(F.lit(None).cast("string").alias("language"), t.alias("text")))


def video_id(url: Column) -> Column:
    patterns = (r"(?:youtube\.com/watch\?v=|youtu\.be/|youtube\.com/shorts/)([a-zA-Z0-9_-]{11})", r"youtube\.com/embed/([a-zA-Z0-9_-]{11})", r"youtube\.com/v/([a-zA-Z0-9_-]{11})")
    return F.coalesce(*(F.nullif(F.regexp_extract(url, p, 1), F.lit("")) for p in patterns), F.lit("youtube_media"))


def is_url(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/\s]+"), F.lit(False))


def extension(url: Column) -> Column:
    """Lower-cased extension of the last part of a path, null if it has none."""
    path = F.regexp_replace(url, r"[?#].*$", "")
    return F.nullif(F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]{1,8})$", 1)), F.lit(""))


# Texts of pages that stand in for another page.
HIJACK_MARKERS = ("ERR_CERT_COMMON_NAME_INVALID", "NET::ERR_CERT", "您的连接不是私密连接", "Your connection is not private", "-----BEGIN CERTIFICATE-----", "PEM encoded chain")


def is_hijacked(html: Column) -> Column:
    return F.coalesce((F.length(html) >= 100) & reduce(Column.__or__, [html.contains(m) for m in HIJACK_MARKERS]), F.lit(False))


def transcript_url(lines: Column) -> Column:
    """The first URL that a label line points to: on one of the two lines after it, or behind the label on its own line."""
    label = r"transcript|show\s*notes|rescript"

    def at(i: Column) -> Column:
        line = F.element_at(lines, i)
        low = F.lower(F.trim(line))
        after = [F.trim(F.try_element_at(lines, i + k)) for k in (1, 2)]
        below = F.when(low.rlike(rf"^[*_]*(?:{label})[\s:]*[*_]*\s*$"), F.coalesce(*(F.when(x.startswith("http"), x) for x in after)))
        inline = F.when(low.rlike(rf"(?:{label})\s*[:\-–]\s*https?://\S+"), F.nullif(F.regexp_extract(line, r"(https?://\S+)", 1), F.lit("")))
        return F.coalesce(below, inline)

    found = F.filter(F.transform(F.sequence(F.lit(1), F.size(lines)), at), lambda u: u.isNotNull())
    return F.when(F.size(lines) > 0, F.try_element_at(found, F.lit(1)))


# Words that a person's name doesn't start with, that mark organisations, and that no name contains.
NAME_STARTERS = [
    "the", "a", "an", "we", "he", "she", "it", "they", "this", "that", "how", "what", "why", "when", "where", "who", "which", "is", "are",
    "was", "were", "will", "can", "do", "does", "did", "not", "no", "and", "or", "but", "if", "so", "follow", "subscribe", "watch", "join",
    "apply", "listen", "get", "read", "see",
]
ORGANISATIONS = [
    "capital", "ventures", "partners", "news", "media", "network", "networks", "inc", "llc", "ltd", "corp", "corporation", "group", "labs",
    "studio", "studios", "show", "shows", "podcast", "productions", "foundation", "institute", "university", "fund", "holdings",
    "technologies", "systems",
]
NAME_STOPS = [
    "our", "your", "us", "we", "you", "they", "this", "that", "these", "those", "his", "her", "their", "its", "the", "a", "an",
]


def looks_like_person(c: Column) -> Column:
    """Two to four CJK characters; or two to six words in the manner of a name."""
    words = F.filter(F.split(c, r"\s+"), lambda w: w != "")
    plain = F.transform(words, lambda w: F.lower(F.regexp_replace(w, r"^[.,]+|[.,]+$", "")))
    first = F.try_element_at(words, F.lit(1))
    western = F.size(words).between(2, 6) & ~F.lower(first).isin(NAME_STARTERS) & first.rlike(r"^\p{Lu}") & ~c.contains("&") & ~c.rlike(r"(?i)\band\b")
    western = western & ~F.exists(plain, lambda w: w.isin(*ORGANISATIONS, *NAME_STOPS)) & ~F.exists(words, lambda w: w.endswith("-"))
    return F.coalesce(c.rlike(r"^[一-鿿]{2,4}$") | western, F.lit(False))


# Kinds of role and the phrases that go with them, in order.
ROLE_PHRASES = {
    "engineering": [
        "engineering", "engineer", "infra", "infrastructure", "code", "codebase", "system", "architecture", "stack", "deploy", "build",
        "review the pr", "reviewing the pr", "pr review", "approve the pr", "merge", "scaling", "latency", "ops", "uptime", "reliability",
    ],
    "product": [
        "product", "users", "user-facing", "customer", "customers", "roadmap", "prioritize", "feature", "release", "ship", "go-to-market",
        "gtm", "pricing", "positioning", "segment", "use case", "user research",
    ],
    "research": [
        "research", "experiment", "paper", "model training", "training", "rlhf", "eval", "scaling laws", "ablation", "benchmark",
    ],
    "design": [
        "design", "designer", "ux", "ui", "user experience", "wireframe", "mock", "prototype",
    ],
    "sales": [
        "sales", "deal", "pipeline", "enterprise", "account", "quota", "rep", "outbound",
    ],
    "marketing": [
        "marketing", "campaign", "brand", "comms", "pr team", "press", "social", "growth marketing",
    ],
    "ceo": [
        "fundrais", "board", "investor", "strategy", "vision", "hiring", "company-wide", "leadership team",
    ],
    "legal": [
        "legal", "compliance", "contract", "policy", "regulation", "regulatory",
    ],
}


def mentions_role(c: Column, bucket: str) -> Column:
    low = F.lower(c)
    return reduce(Column.__or__, [low.contains(p) for p in ROLE_PHRASES[bucket]])


def role_bucket(role: Column) -> Column:
    """The kind that the role names (first in order), else the kind of the longest phrase in it."""
    low = F.lower(role)
    named = F.coalesce(*(F.when(low.contains(b), F.lit(b)) for b in ROLE_PHRASES))
    ranked = sorted(((p, b) for b, ps in ROLE_PHRASES.items() for p in ps), key=lambda x: -len(x[0]))
    return F.coalesce(named, *(F.when(low.contains(p), F.lit(b)) for p, b in ranked))


def clean_role(role: Column) -> Column:
    return F.substring(F.trim(F.regexp_replace(F.trim(role), r"(?i)[\s,;&]*\b(?:and|or)?[\s,;&]*$", "")), 1, 80)


def json_payload(c: Column) -> Column:
    """A model's answer without its thoughts, fences and surrounding words, lightly repaired."""
    t = F.trim(F.regexp_replace(c, r"(?s)<think>.*?</think>", ""))
    t = F.when(t.startswith("```"), F.regexp_replace(F.regexp_replace(t, r"^```[^\n]*\n?", ""), r"\n?```\s*$", "")).otherwise(t)
    inner = F.regexp_extract(t, r"(?s)(\{[^{}]*\}|\[.*\])", 1)
    t = F.when(t.rlike(r"^[{\[]") | (inner == ""), t).otherwise(inner)
    t = F.regexp_replace(F.regexp_replace(t, r",\s*([}\]])", "$1"), r"\}\s*\{", "},{")
    unclosed = F.ltrim(t).startswith("[") & ~F.rtrim(t).endswith("]")
    return F.when(unclosed & t.contains("}"), F.concat(F.regexp_extract(t, r"(?s)^(.*\})", 1), F.lit("]"))).otherwise(t)


def auto_length(chars: Column) -> Column:
    return F.when(chars < 13000, "short").when(chars < 60000, "medium").otherwise("long")


def timeout_ms(seconds: Column) -> Column:
    """A sixth of the audio's length, between 30 and 1800 seconds."""
    return F.least(F.greatest((seconds * 1000 / 6).cast("long"), F.lit(30_000)), F.lit(1_800_000))


# Seconds of audio that a family of recognisers takes, the first name contained wins.
AUDIO_LIMITS = {"whisper": 30, "gemma": 30, "sensevoice": 30, "canary": 40, "qwen3-asr": 1200, "parakeet": 1440, "voxtral": 2400, "fun-asr": 30, "glm": 30}


def audio_limit(model: Column) -> Column:
    return F.coalesce(*(F.when(F.lower(model).contains(k), F.lit(v)) for k, v in AUDIO_LIMITS.items()))


def audio_quality(c: Column) -> Column:
    """best, low, medium or a bit rate up to 320."""
    q = F.lower(F.trim(c))
    return F.when(q.rlike(r"^\d+$"), F.when(q.cast("int") > 320, "best").otherwise(q)).when(q.isin("best", "low", "medium", "high", "lowest"), q).otherwise("best")


def video_quality(c: Column) -> Column:
    """best or a height; low is 360, medium 720; heights up to 320 are taken for bit rates."""
    q = F.lower(F.trim(c))
    return F.when(q.rlike(r"^\d+$"), F.when(q.cast("int") <= 320, "best").otherwise(q)).when(q == "low", "360").when(q == "medium", "720").otherwise("best")


def yaml_escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))


def provider(model: Column) -> Column:
    return F.when(F.lower(model).startswith("gemini"), "gemini").otherwise("openai")
