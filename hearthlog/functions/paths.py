"""Column expressions over file paths and names."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

# ---- fixed values ----
CHAT_FILE_PREFIX = r"^(?:WhatsApp Chat with |WhatsApp Chat - |Chat with )"
AUDIO_SUFFIXES = ["opus", "ogg", "mp3", "m4a", "wav", "aac", "flac", "wma", "amr"]
DUMP_AUDIO_SUFFIXES = AUDIO_SUFFIXES + ["3ga"]
TEXT_SUFFIXES = ["txt", "json", "csv", "md", "zip", "html", "vcf", "xml"]
DOCUMENT_SUFFIXES = ["pdf", "docx", "doc", "pptx", "xlsx"]
PHOTO_SUFFIXES = ["jpg", "jpeg", "png", "webp", "heic"]
SERVED_SUFFIXES = ["jpg", "jpeg", "png", "webp"]
VIDEO_SUFFIXES = ["mp4", "mov", "3gp", "avi", "mkv", "webm", "m4v"]
MIN_PHOTO_BYTES = 20_000
OWN_CAMERA = "camera|dcim|100nikon|my ?photo|captured"
FOLDER_RANKS = [
    (r"whatsapp images[\\/]sent", 3),
    (r"picasa|collage|wedding", 2),
    (r"whatsapp images", 1),
    (r"facebook|/fb/|screenshot|scrss|telegram|download", 0),
]
WANTED_MEDIA_ROOTS = ["videos"]
WANTED_MEDIA = r"(?i)Captured Videos|(^|/)video(/|$)"
SORT_RULES = [
    (r"(?i)whatsapp chat.*\.txt$", "whatsapp"),
    (r"(?i)(^|/)(PTT-\d{8}|WhatsApp Voice Notes)", "voice_notes"),
    (r"(?i)(call ?rec|recordings|\bcall\b|callrecord)", "calls"),
]
# ---- end of fixed values ----


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, r"[\\/]"), -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def suffix(path: Column) -> Column:
    """Lower-cased extension without the dot; '' when there is none."""
    return F.lower(F.regexp_extract(file_name(path), r".\.([^.]*)$", 1))


def parent(path: Column) -> Column:
    return F.regexp_replace(path, r"[\\/][^\\/]*$", "")


def folder_hint(path: Column) -> Column:
    """Name of the parent folder."""
    return F.coalesce(F.get(F.split(path, r"[\\/]"), F.size(F.split(path, r"[\\/]")) - 2), F.lit("."))


def conversation_id(path: Column) -> Column:
    return F.concat(F.lit("whatsapp:"), F.trim(F.regexp_replace(stem(path), CHAT_FILE_PREFIX, "")))


def folder_rank(path: Column, owner_names: list[str] = ()) -> Column:
    """How likely a photo is a personal memory: 3 best, 0 worst, 1 when nothing matches."""
    own = "|".join([OWN_CAMERA, *owner_names])
    rank = F.when(path.rlike(f"(?i)({own})"), 3)
    for pattern, value in FOLDER_RANKS:
        rank = rank.when(path.rlike(f"(?i)({pattern})"), value)
    return rank.otherwise(1)


def download_class(name: Column) -> Column:
    """0 chats, 1 audio, 2 text, 3 documents, 4 media and the rest."""
    ext = suffix(name)
    return (
        F.when(F.contains(F.lower(name), F.lit("whatsapp chat")) | (ext == "txt"), 0)
        .when(ext.isin(DUMP_AUDIO_SUFFIXES), 1)
        .when(ext.isin(TEXT_SUFFIXES), 2)
        .when(ext.isin(DOCUMENT_SUFFIXES), 3)
        .otherwise(4)
    )


def skip_media(path: Column, klass: Column, roots: list[str] = WANTED_MEDIA_ROOTS) -> Column:
    """Class-4 files outside the wanted roots and folders."""
    root = F.substring_index(path, "/", 1)
    return (klass == 4) & ~root.isin(roots) & ~path.rlike(WANTED_MEDIA)


def route(path: Column) -> Column:
    """Bucket a dumped file belongs to; NULL leaves it where it is."""
    bucket = F.when(F.lit(False), F.lit(""))
    for pattern, name in SORT_RULES:
        bucket = bucket.when(path.rlike(pattern), name)
    return bucket.when(
        suffix(path).isin(DUMP_AUDIO_SUFFIXES),
        F.when(F.contains(F.lower(path), F.lit("voice")), "voice_notes").otherwise("calls"),
    )


def under_roots(path: Column, roots: list[str], suffixes: list[str] = SERVED_SUFFIXES) -> Column:
    """Path lies under an allowed root, has an allowed suffix and no `..` step."""
    inside = F.lit(False)
    for root in roots:
        inside = inside | F.startswith(path, F.lit(root.rstrip("/") + "/"))
    return F.coalesce(inside & suffix(path).isin(suffixes) & ~path.rlike(r"(^|[\\/])\.\.([\\/]|$)"), F.lit(False))
