"""Text functions as Spark expressions: chunks, sentences, routing by extension, previews and the like."""

from __future__ import annotations

import posixpath

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions by kind of file.
AUDIO = (".mp3", ".wav", ".m4a", ".ogg", ".flac")
VIDEO = (".mp4", ".mkv", ".avi", ".mov", ".webm", ".lrf")
IMAGES = (".jpg", ".jpeg", ".png", ".bmp", ".gif", ".tiff", ".tif", ".heic", ".webp")
RAW = (".dng", ".cr2", ".nef", ".arw", ".orf", ".rw2", ".raw")
PLAIN = (".txt", ".md", ".go", ".py", ".json")
# Extensions by tag of a preview.
TAG_IMAGE = (".png", ".jpg", ".jpeg", ".tiff", ".tif", ".bmp")
TAG_VIDEO = (".mp4", ".mkv", ".webm")
TAG_AUDIO = (".mp3", ".wav", ".m4a", ".ogg", ".flac")

#: Bytes that a text needs, after trimming, to be indexed; bytes of a sentence.
MIN_TEXT, MIN_SENTENCE = 10, 10
CHUNK_SIZE, CHUNK_OVERLAP = 512, 50


def fields(text: Column) -> Column:
    """The words between runs of white space of any script."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(fields(text))


def chunk_params(size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> tuple[int, int]:
    """Size and overlap as they take effect: none given means the defaults, an overlap as large as the size a tenth of it."""
    size = size if size > 0 else CHUNK_SIZE
    overlap = overlap if overlap > 0 else CHUNK_OVERLAP
    return size, size // 10 if overlap >= size else overlap


def chunk_count(n: Column, size: int, overlap: int) -> Column:
    """How many chunks n words give: closed form."""
    step = max(size - overlap, 1)
    return F.when(n == 0, 0).when(n <= size, 1).otherwise(1 + F.ceil((n - size) / step)).cast("int")


def smart_chunk(words: Column, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> Column:
    """Array of chunks from an array of words: ``size`` words each, every next one ``size - overlap`` further on."""
    step = max(size - overlap, 1)

    def cut(own: Column) -> Column:
        n = chunk_count(F.size(own), size, overlap)
        starts = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(own, i * step + 1, F.lit(size)), " "))

    # the words are bound to a variable, else every chunk would split the text anew
    return F.get(F.transform(F.array(words), cut), 0)


def sentences(text: Column) -> Column:
    """Sentences by their ends (full stop, question or exclamation mark before a space, empty line), trimmed, 10 bytes or more."""
    marked = text
    for end in (". ", "? ", "! ", "\n\n"):
        marked = F.replace(marked, F.lit(end), F.lit(end + "\x01"))
    return F.filter(F.transform(F.split(marked, "\x01"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: F.octet_length(s) >= MIN_SENTENCE)


def enrich(context: Column, chunk: Column) -> Column:
    """The chunk behind its document's context, if there is one."""
    return F.when(F.coalesce(context, F.lit("")) == "", chunk).otherwise(F.concat(F.lit("[Context: "), context, F.lit("]\n"), chunk))


def first_bytes(text: Column, most: int) -> Column:
    """The longest start of a text that has at most so many bytes: a code point across the cut goes as a whole."""
    data = F.encode(text, "utf-8")
    # a byte 10xxxxxx goes on with a code point; of the up to four bytes of one, three at most stand before the cut
    goes_on = lambda i: F.coalesce(F.hex(F.substring(data, i, 1)).rlike("^[89AB]"), F.lit(False))
    end = F.lit(max(most - 3, 0))
    for i in range(max(most - 2, 1), most + 1):
        end = F.when(goes_on(i + 1), end).otherwise(F.lit(i))
    return F.when(F.octet_length(text) <= most, text).otherwise(F.decode(F.substring(data, F.lit(1), end), "utf-8"))


def excerpt(text: Column, least: int = 200, most: int = 4000) -> Column:
    """The first bytes of a text for a context request; empty if the text is short. A code point cut in two goes."""
    return F.when(F.octet_length(text) < least, "").otherwise(F.trim(first_bytes(text, most)))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def skipped_extensions(whisper: bool, vision: bool, frames: bool, ocr: bool) -> list[str]:
    """Extensions that no enabled extractor can read."""
    return [*(() if whisper else AUDIO), *(() if whisper or frames else VIDEO), *(() if vision or ocr else IMAGES), *RAW]


def glob_regex(pattern: str) -> str:
    """A shell pattern over one path segment as a regular expression."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        close = pattern.find("]", i + 1) if c == "[" else -1
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif close > 0:
            out += pattern[i : close + 1]
            i = close
        else:
            out += "\\" + c if not c.isalnum() and c != "_" else c
        i += 1
    return f"^{out}$"


def excluded(path: Column, patterns: list[str]) -> Column:
    """Whether a pattern fits the name as a glob or stands anywhere in the path."""
    hits = [basename(path).rlike(glob_regex(p)) | path.contains(p) for p in patterns if p.strip()]
    out = F.lit(False)
    for h in hits:
        out = out | h
    return out


def media_tag(path: Column) -> Column:
    ext = extension(path)
    return F.when(ext.isin(*TAG_IMAGE), "[Image] ").when(ext.isin(*TAG_VIDEO), "[Video] ").when(ext.isin(*TAG_AUDIO), "[Audio] ").when(ext == ".pdf", "[PDF] ").otherwise("")


def preview(path: Column, text: Column) -> Column:
    return F.concat(media_tag(path), F.when(F.coalesce(text, F.lit("")) == "", "").otherwise(F.concat(F.left(text, F.lit(100)), F.lit("..."))))


def strip_control(text: Column) -> Column:
    return F.regexp_replace(text, r"[\x00-\x1f\x7f]", "")


def truncate_bytes(text: Column, most: int) -> Column:
    """At most so many bytes, marked if cut. A code point cut in two goes."""
    return F.when(F.octet_length(text) > most, F.concat(first_bytes(text, most), F.lit("..."))).otherwise(text)


def truncate_chars(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit("..."))).otherwise(text)


def pad_right(text: Column, width: int) -> Column:
    return F.when(F.length(text) >= width, text).otherwise(F.rpad(text, width, " "))


def normalised_query(query: Column) -> Column:
    return F.lower(F.trim(query))


def size_in_bytes(text: Column) -> Column:
    """"10MB", "2GB" or a plain number, in bytes; null if neither."""
    n = F.regexp_extract(F.upper(F.trim(text)), r"^([0-9]+)\s*(MB|GB)?$", 1)
    unit = F.regexp_extract(F.upper(F.trim(text)), r"^([0-9]+)\s*(MB|GB)?$", 2)
    return F.when(n == "", None).otherwise(n.cast("long") * F.when(unit == "MB", 1 << 20).when(unit == "GB", 1 << 30).otherwise(1))


def match_tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits: what a text-match query is held against."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def matches(tokens: Column, query: list[str]) -> Column:
    """Whether all of the query's tokens occur."""
    return F.size(F.array_except(F.array(*map(F.lit, query)).cast("array<string>"), tokens)) == 0


def streamed_words(text: Column) -> Column:
    """The pieces in which a text is streamed: each word with the space behind it."""
    return F.transform(fields(text), lambda w: F.concat(w, F.lit(" ")))


def plugin_meta(source: Column) -> Column:
    """Name and extensions from the head comments of a plugin's source, first 30 lines."""
    lines = F.transform(F.slice(F.split(source, "\n"), 1, 30), lambda x: F.trim(F.replace(x, F.lit("\r"), F.lit(""))))
    names = F.filter(F.transform(lines, lambda x: F.regexp_extract(x, r"^# name:(.*)$", 1)), lambda x: x != "")
    lists = F.filter(F.transform(lines, lambda x: F.regexp_extract(x, r"^# extensions:(.*)$", 1)), lambda x: x != "")
    exts = F.filter(F.transform(F.split(F.array_join(lists, ","), ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.struct(F.trim(F.coalesce(F.element_at(names, -1), F.lit(""))).alias("name"), exts.alias("extensions"))


def is_private_address(host: Column) -> Column:
    """Loopback, link-local (multicast too) and RFC 1918 addresses; IPv4 ones may be written as IPv6."""
    return host.rlike(r"(?i)^(::ffff:)?(127\.|10\.|192\.168\.|169\.254\.|224\.0\.0\.|172\.(1[6-9]|2[0-9]|3[01])\.)|^(::1$|fe[89ab][0-9a-f]:|ff[0-9a-f]2:)")


def is_auth_error(message: Column) -> Column:
    return message.rlike("403|401|PERMISSION_DENIED|API_KEY_INVALID")


def embedding_error(message: Column) -> Column:
    """By status, or by the words that services use for it."""
    return F.when(message.rlike("401|Unauthorized"), "unauthorised").when(message.rlike("429|Rate Limit|RESOURCE_EXHAUSTED"), "rate limited").when(message.rlike("403|Forbidden"), "forbidden").otherwise("other")


def clean_archive_path(path: str | None) -> str | None:
    """The path inside an archive without detours; null if it is absolute or leads out."""
    if path is None:
        return None
    clean = posixpath.normpath(path.replace("\\", "/"))
    return None if clean.startswith("/") or clean == ".." or clean.startswith("../") else clean


def safe_archive_path(path: Column) -> Column:
    """``clean_archive_path`` as an expression: segments one by one, ``..`` taking one back; null if absolute or leading out."""
    parts = F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda s: ~s.isin("", "."))
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(False).alias("out"))

    def step(a: Column, s: Column) -> Column:
        back = s == ".."
        return F.struct(F.when(~back, F.concat(a["kept"], F.array(s))).when(F.size(a["kept"]) > 0, F.slice(a["kept"], 1, F.size(a["kept"]) - 1)).otherwise(a["kept"]).alias("kept"), (a["out"] | (back & (F.size(a["kept"]) == 0))).alias("out"))

    done = F.aggregate(parts, start, step)
    absolute = F.replace(path, F.lit("\\"), F.lit("/")).startswith("/")
    return F.when(~absolute & ~done["out"], F.when(F.size(done["kept"]) == 0, ".").otherwise(F.array_join(done["kept"], "/")))
