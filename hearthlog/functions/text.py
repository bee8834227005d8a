"""Column expressions over message, transcript and caption text."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

# ---- fixed values: these must equal the archive format's for equal results ----
WHITESPACE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
SPACES = "[ \\t\\n\\r\\x0b\\x0c\\x1c-\\x1f\\x85\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+"
INVISIBLE_MARKS = "\u200e\u200f\ufeff"
EDITED_NOTE = r"(?i)\s*<This message was edited>\s*"
INLINE_MEDIA = r"(?i)\s*<(?:Media omitted|attached:[^>]*)>\s*"
MEDIA_TEXTS = [
    "<media omitted>", "null", "image omitted", "video omitted", "audio omitted",
    "sticker omitted", "gif omitted", "document omitted", "contact card omitted",
    "voice message omitted",
]
DELETED_TEXTS = [
    "this message was deleted", "you deleted this message", "this message was edited",
]
MEDIA_TOKEN = r"(?i)\[media\]\s*"
SENSITIVE_WORDS = [
    "password", "otp", "account number", "aadhaar", "pan card", "cvv",
    "bank", "salary", "loan", "upi", "पासवर्ड", "खाता",
]
FORWARD_SIGNS = [
    r"\b(?:FB|WWW)\.[A-Z0-9]+\.(?:COM|IN)\b",
    r"\bwatermark(?:ed)?\b",
    r"\b(?:meme|joke|cartoon|comic strip|caption reads)\b",
    r"\b(?:overlaid|overlay(?:ing)?|superimposed)\s+(?:\w+\s+){0,2}text\b",
    r"\btext\s+(?:overlay|superimposed)\b|\bimpact font\b",
    r"\btext (?:at the (?:top|bottom)|across the (?:top|image))\b",
    r"\bscreenshot\b|\bwhatsapp (?:chat|conversation)\b|\bsocial media post\b",
    r"\b(?:fake )?tweet\b|\bfacebook post\b|\binstagram post\b",
    r"\bgood\s*morning\b|\bgreeting card\b|\bmotivational (?:poster|quote)\b",
]
PHOTO_WORDS = (
    r"\b(?:photo|photos|pic|pics|picture|pictures|image|images|selfie|album)\b"
    "|फोटो|तस्वीर|ਫੋਟੋ|ਤਸਵੀਰ"
)
OWN_WORDS = r"\b(?:meri|mere|mera|apni|apne|apna|khud|my|mine|our)\b"
ROMAN_HINDI = [
    "yaar", "bhai", "bro", "hai", "hain", "nahi", "nahin", "kya", "kaise", "kaisa", "mujhe", "mera", "meri", "tera",
    "teri", "tu", "tum", "aap", "kar", "karna", "raha", "rha", "tha", "thi", "hoga", "chal", "thik", "theek",
    "acha", "accha", "koi", "kuch", "abhi", "phir", "fir", "bas", "matlab", "yeh", "woh", "wo", "ke", "ka", "ki",
    "ko", "se", "me", "mein", "par", "aur", "toh", "to", "ho", "hu", "hun", "gya", "gaya", "diya", "liya", "pta",
    "pata", "bol",
]
TRANSCRIPT_BOILERPLATE = (
    r"(?i)(?:thanks? for watching|please subscribe|terima kasih|amara\.org|subtitles? by|www\.[\w.]+)"
)
KEEP_HEADINGS = [
    "voice", "rhythm", "language", "tone", "style", "signature phrase", "phrases", "humor", "humour",
    "writing", "speech", "register",
]
DROP_HEADINGS = [
    "people", "relationship", "family", "friend", "work", "career", "value", "belief", "history",
    "timeline", "background", "interest", "concern", "fact", "detail",
]
ABSENCE_SENTENCE = (
    r"(?i)(?:^|(?<=[.!?])\s*)(?:"
    r"(?:There\s+(?:is|are)\s+)?no\s+(?:other\s+|readable\s+|discernible\s+)?"
    r"(?:people|person|text|labels?|writing|signage|occasion|words?)\b[^.!?]*"
    r"|only\s+one\s+person\s+is\s+(?:visible|present)\b[^.!?]*"
    r"|no\s+\w+\s+or\s+\w+\s+(?:is|are)\s+(?:visible|present|discernible)\b[^.!?]*"
    r")[.!?]\s*"
)
UNREMARKABLE_FOLDERS = ["camera", "camera roll", "sent"]
LANGUAGE_FOLDS = {"ur": "hi", "sa": "hi", "ne": "hi", "mr": "hi", "bn": "hi", "gu": "hi"}
LANGUAGES_KEPT = ["en", "hi", "pa"]
SNIPPET_CHARS = 700
# ---- end of fixed values ----


def strip(c: Column) -> Column:
    """Trim Unicode whitespace at both ends."""
    return F.trim(c, F.lit(WHITESPACE))


def squeeze(c: Column) -> Column:
    """Whitespace runs become one space, ends trimmed."""
    return strip(F.regexp_replace(c, SPACES, " "))


def words(c: Column) -> Column:
    """Whitespace-separated tokens; empty array for blank text."""
    return F.filter(F.split(c, SPACES), lambda w: w != "")


def any_substring(c: Column, needles: list[str]) -> Column:
    found = F.lit(False)
    for needle in needles:
        found = found | F.contains(c, F.lit(needle))
    return found


# ---- chat text ----------------------------------------------------------------


def clean_chat(c: Column) -> Column:
    """Drop direction marks and the appended "edited" note."""
    return strip(F.regexp_replace(F.translate(c, INVISIBLE_MARKS, ""), EDITED_NOTE, " "))


def is_media_text(c: Column) -> Column:
    low = F.lower(clean_chat(c))
    return low.isin(MEDIA_TEXTS) | F.startswith(low, F.lit("<attached:"))


def is_deleted_text(c: Column) -> Column:
    return F.lower(clean_chat(c)).isin(DELETED_TEXTS)


def message_text(c: Column) -> Column:
    """Stored form of a chat text: `[media]`, or the caption without inline markers."""
    return F.when(is_media_text(c), "[media]").otherwise(
        strip(F.regexp_replace(clean_chat(c), INLINE_MEDIA, " "))
    )


def strip_media_markers(c: Column) -> Column:
    return strip(F.regexp_replace(c, MEDIA_TOKEN, ""))


# ---- transcripts --------------------------------------------------------------


def collapse_repeats(c: Column) -> Column:
    """Any 1..6-word unit said more than twice in a row is kept twice.

    One pass of a single pattern whose alternatives list the shorter units first.
    """
    alternatives = []
    for n in range(1, 7):
        more = r"(?: \S++){%d}" % (n - 1) if n > 1 else ""
        alternatives.append(rf"(\S++{more})(?: \{n}(?!\S)){{2,}}")
    # exactly one group captures; the others are empty in the replacement
    once = "".join(f"${n}" for n in range(1, 7))
    return F.regexp_replace(squeeze(c), rf"(?<!\S)(?:{'|'.join(alternatives)})", f"{once} {once}")


def clean_transcript(c: Column) -> Column:
    text = F.regexp_replace(c, r"(?iU)\bforeign\b", " ")
    text = F.regexp_replace(text, TRANSCRIPT_BOILERPLATE, " ")
    text = collapse_repeats(text)
    return F.when((F.size(words(text)) <= 1) & (F.length(text) <= 3), "").otherwise(text)


# ---- classification -----------------------------------------------------------


def target_problem(c: Column, min_words: int = 2, max_words: int = 250) -> Column:
    """Why a reply cannot be a training target; NULL when it can."""

    def by_words(w: Column) -> Column:
        n = F.size(w)
        few = F.greatest(F.lit(2), F.floor(n / 4).cast("int"))
        return (
            F.when(n < min_words, "too_short")
            .when(n > max_words, "too_long")
            .when((n >= 6) & (F.size(F.array_distinct(w)) <= few), "repetitive")
        )

    # the one-row array holds the words, so that a text is split once
    checked = F.get(F.transform(F.array(words(c)), by_words), F.lit(0))
    return F.when(c.rlike(r"(?U)^\W*$") | (F.lower(c) == "[media]"), "empty_or_media").otherwise(checked)


def trust_tier(c: Column) -> Column:
    return F.when(any_substring(F.lower(c), SENSITIVE_WORDS), "secret").otherwise("personal")


def looks_forwarded(c: Column) -> Column:
    return F.coalesce(c.rlike("(?iU)" + "|".join(FORWARD_SIGNS)), F.lit(False))


def is_cut_off(c: Column) -> Column:
    """Text that stops mid-sentence."""
    last = F.right(F.rtrim(c, F.lit(WHITESPACE)), F.lit(1))
    return ~last.isin(".", "!", "?", '"', "”")


def wants_photos(c: Column) -> Column:
    return c.rlike("(?iU)" + PHOTO_WORDS)


def wants_own_photos(c: Column) -> Column:
    return wants_photos(c) & c.rlike("(?iU)" + OWN_WORDS)


def keeps_heading(c: Column) -> Column:
    """Style headings are kept; anything biographical or unknown is not."""
    low = F.lower(c)
    return any_substring(low, KEEP_HEADINGS) & ~any_substring(low, DROP_HEADINGS)


def _char_count(c: Column, char_class: str) -> Column:
    return F.length(F.regexp_replace(c, f"[^{char_class}]+", ""))


def script_of(c: Column) -> Column:
    dev = _char_count(c, "ऀ-ॿ")
    gur = _char_count(c, "਀-੿")
    lat = _char_count(c, "A-Za-z")
    low = F.lower(c)
    total = F.regexp_count(low, F.lit("[a-z']+"))
    hits = F.regexp_count(low, F.lit(rf"(?<![a-z'])(?:{'|'.join(ROMAN_HINDI)})(?![a-z'])"))
    return (
        F.when(c.isNull() | (strip(c) == ""), "unknown")
        .when((gur > 0) & (gur >= dev), "gurmukhi")
        .when((dev > 0) & (dev * 3 >= lat), "devanagari")
        .when(lat == 0, "unknown")
        .when(hits / total >= 0.2, "hinglish")
        .otherwise("english")
    )


def token_estimate(c: Column) -> Column:
    indic = _char_count(c, "ऀ-ൿ")
    return F.floor(indic + (F.length(c) - indic) / 3.5).cast("int") + 2


def language_hint(c: Column) -> Column:
    folds = F.create_map(*[F.lit(x) for pair in LANGUAGE_FOLDS.items() for x in pair])
    lang = F.coalesce(F.element_at(folds, c), c)
    return F.when(lang.isin(LANGUAGES_KEPT), lang)


# ---- rendering ----------------------------------------------------------------


def strip_absence(c: Column) -> Column:
    """Drop sentences that only state what is missing, unless little remains."""
    cleaned = squeeze_pairs(F.regexp_replace(c, ABSENCE_SENTENCE, " "))
    return F.when(F.length(cleaned) >= 30, cleaned).otherwise(strip(c))


def squeeze_pairs(c: Column) -> Column:
    """Runs of two or more whitespace characters become one space; ends trimmed."""
    return strip(F.regexp_replace(c, r"\s{2,}", " "))


def counterpart_name(conversation_id: Column) -> Column:
    """Contact part of a conversation id without the call-file date or sort junk."""
    colon = F.instr(conversation_id, ":")
    raw = strip(F.when(colon > 0, F.substr(conversation_id, colon + 1)).otherwise(conversation_id))
    name = strip(F.regexp_replace(raw, r"\s*\d{4}-\d{2}-\d{2}[\s\d:-]*$", ""))
    bare = F.trim(name, F.lit(" .-_"))
    return F.when(bare == "", raw).otherwise(bare)


def counterpart_label(name: Column, known_label: Column) -> Column:
    return F.coalesce(
        known_label,
        F.when(name.rlike(r"^[+\d][\d\s-]{6,}$"), "an unsaved number").otherwise(name),
    )


def memory_sentence(
    taken_at: Column, folder: Column, caption: Column, faces: Column, is_forward: Column
) -> Column:
    folder_part = F.when(
        (F.coalesce(folder, F.lit("")) != "") & ~F.lower(folder).isin(UNREMARKABLE_FOLDERS), folder
    )
    prefix = F.concat_ws(", ", F.date_format(taken_at, "dd MMM yyyy"), folder_part)
    body = F.when(prefix == "", caption).otherwise(F.concat(prefix, F.lit(": "), caption))
    who = F.when(faces == 1, "1 person").otherwise(F.concat(faces.cast("string"), F.lit(" people")))
    return (
        F.when(is_forward, F.concat(F.lit("[forwarded image, not his own photo] "), body))
        .when(faces > 0, F.concat(F.lit("[photo of "), who, F.lit("] "), body))
        .otherwise(body)
    )


def diary_sentence(day: Column, text: Column) -> Column:
    return F.concat(F.lit("Diary, "), F.date_format(day, "dd MMM yyyy"), F.lit(": "), text)


def snippet(kind: Column, day: Column, counterpart: Column, text: Column) -> Column:
    head = F.concat(
        F.lit("["), kind, F.lit(" "), day,
        F.when(F.coalesce(counterpart, F.lit("")) != "", F.concat(F.lit(" · "), counterpart)).otherwise(""),
        F.lit("] "),
    )
    body = squeeze(text)
    cut = F.left(body, F.lit(SNIPPET_CHARS))
    last_word = F.substring_index(cut, " ", -1)
    at_word = F.when(F.contains(cut, F.lit(" ")), F.left(cut, F.lit(SNIPPET_CHARS - 1) - F.length(last_word))).otherwise(cut)
    return F.concat(head, F.when(F.length(body) > SNIPPET_CHARS, F.concat(at_word, F.lit("…"))).otherwise(body))


def strip_code_fence(c: Column) -> Column:
    text = F.regexp_replace(strip(c), r"^```json", "")
    text = F.regexp_replace(text, r"^```", "")
    return strip(F.regexp_replace(text, r"```$", ""))


def tolerant_json(c: Column, schema: str) -> Column:
    """struct(value, unparsed): the parsed document, or the text when it is not JSON."""
    text = strip_code_fence(c)
    value = F.from_json(text, schema)
    valid = F.try_parse_json(text).isNotNull()
    return F.struct(F.when(valid, value).alias("value"), F.when(~valid, text).alias("unparsed"))
