"""Text functions as native column expressions.

Python's white space is Unicode's, so patterns carry (?U); SQL trim strips blanks only
and is not used. `\\z` is the end of text; Java's `$` would also match before a line end.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Japanese fillers, from a minimal set that seldom misfires.
FILLERS = r"(?:え[ー〜]*っと|え[ー〜]*と|うーん|あの|[んン][ー〜]+|[あア][ー〜]+|[えエ][ー〜]+)"
#: Dictionary of services (needle, label), in order.
SERVICES = (
    ("figma", "Figma"),
    ("google docs", "Google Docs"),
    ("google slides", "Google Slides"),
    ("slides", "Slides"),
    ("notion", "Notion"),
    ("slack", "Slack"),
    ("zoom", "Zoom"),
    ("chrome", "Chrome"),
    ("safari", "Safari"),
    ("vscode", "VS Code"),
    ("visual studio code", "VS Code"),
    ("xcode", "Xcode"),
    ("github", "GitHub"),
)
#: Default style guidance by language.
STYLE = {
    "ja": "英数字は半角、技術用語は英語綴り、句点は「。」読点は「、」。要約せず、話した内容をできるだけそのまま書き起こしてください。",
    "en": "Use ASCII for alphanumerics, keep technical terms in original spelling, and use standard punctuation. Do not summarize; transcribe verbatim.",
}
#: Headings of a prompt's parts, in order.
PROMPT_PARTS = (("products", "製品・サービス"), ("agenda", "議題"), ("participants", "参加者"), ("terms", "重要語彙"), ("dictionary", "表記固定"))
PROMPT_CHARS = 224 * 4


def strip(text: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")


def without_space(text: Column) -> Column:
    """All white space removed."""
    return F.regexp_replace(text, r"(?U)\s+", "")


def squeezed(text: Column) -> Column:
    """Stripped, inner white space as one blank."""
    return F.regexp_replace(strip(text), r"(?U)\s+", " ")


def dedup_tokens(text: Column) -> Column:
    """Lower-case tokens between white space; without any, the raw text alone."""
    tokens = F.filter(F.split(F.regexp_replace(F.lower(text), r"(?U)\s+", " "), " "), lambda t: t != "")
    return F.when(F.size(tokens) > 0, tokens).otherwise(F.array(text))


def _tail(text: Column, chars: int) -> Column:
    """The end of a text without blanks and line breaks."""
    return F.right(F.regexp_replace(text, "[\\n\\r ]", ""), F.lit(chars))


def short_repeat_tail(text: Column) -> Column:
    """One to three characters, five times or more, at the end."""
    return F.coalesce(_tail(text, 15).rlike(r"(?s)(.{1,3})\1{4}\z"), F.lit(False))


def repeated_tail(text: Column) -> Column:
    """a unit of 6 to 30 characters three times, or of 1 to 3 five times, at the end."""
    return F.coalesce(_tail(text, 90).rlike(r"(?s)(?:(.{6,30})\1\1|(.{1,3})\2{4})\z"), F.lit(False))


def garbled(text: Column) -> Column:
    """F8: five characters or more, of two kinds at most, that end in a short repeat."""
    bare = F.regexp_replace(text, "[\\n\\r ]", "")
    kinds = F.size(F.array_distinct(F.split(bare, "")))
    return F.coalesce((F.char_length(bare) >= 5) & (kinds <= 2), F.lit(False)) & short_repeat_tail(text)


def has_phrase(text: Column, phrases: tuple[str, ...]) -> Column:
    """any phrase occurs."""
    found = F.lit(False)
    for p in phrases:
        found = found | F.coalesce(F.contains(text, F.lit(p)), F.lit(False))
    return found


def without_fillers(text: Column) -> Column:
    """Fillers at the start (again and again) and between delimiters go; what is only punctuation becomes empty.

    A leading filler must end the text or be followed by a separator, and, as the rest of
    the line must follow it, one in front of an inner line break stays.
    """
    space = F.regexp_extract(text, r"(?U)^\s*", 0)
    body = F.regexp_replace(text, r"(?U)^\s*", "")
    after = r"(?:[、,。\s…ー〜]+|\z)"
    lead = rf"(?Ud)\A{FILLERS}{after}(?=[^\n]*\n?\z)"
    body = F.when(body.rlike(lead), F.regexp_replace(F.regexp_replace(body, rf"(?Ud)\A(?:{FILLERS}{after})++", ""), r"\n\z", "")).otherwise(body)
    body = F.regexp_replace(body, rf"(?Ud)(^|[、。,\s]){FILLERS}($|[、。,\s])", "$1$2")
    body = F.regexp_replace(F.regexp_replace(body, "[、,]{2,}", "、"), r"(?U)\s{2,}", " ")
    whole = F.concat(space, body)
    return F.when(whole.rlike(r"(?U)\A[\s、。,.!?…ー〜]*\z"), F.lit("")).otherwise(whole)


def term_hit(transcript: Column, term: Column) -> Column:
    """ASCII terms as whole words, others anywhere; case counts."""
    quoted = F.concat(F.lit(r"(?<![A-Za-z0-9_])\Q"), term, F.lit(r"\E(?![A-Za-z0-9_])"))
    return F.when(term.rlike(r"\A[A-Za-z0-9_ ]+\z"), F.regexp_like(transcript, quoted)).otherwise(F.contains(transcript, term))


def prompt_items(raw: Column) -> Column:
    """Items between commas, slashes and line breaks; null has none."""
    return F.coalesce(F.filter(F.transform(F.split(raw, r"[,/\n]+"), strip), lambda x: x != ""), F.array().cast("array<string>"))


def language_key(language: Column, default: str = "ja") -> Column:
    """Lower case, before the first - or _; the default if that is blank."""
    head = F.element_at(F.split(F.lower(strip(language)), "[-_]"), 1)
    return F.when(F.coalesce(head, F.lit("")) == "", F.lit(default)).otherwise(head)


def style_guidance(language: Column) -> Column:
    """Guidance of the language; English for those without their own."""
    return F.when(language_key(language) == "ja", F.lit(STYLE["ja"])).otherwise(F.lit(STYLE["en"]))


def truncated_prompt(prompt: Column, chars: int = PROMPT_CHARS) -> Column:
    """Whole clauses up to the first that doesn't fit."""
    clauses = F.regexp_extract_all(prompt, F.lit("[^。、,]+|[。、,]"), 0)
    start = F.struct(F.lit("").alias("kept"), F.lit(False).alias("full"))
    add = lambda s, c: F.when(s["full"] | (F.char_length(s["kept"]) + F.char_length(c) > chars), F.struct(s["kept"].alias("kept"), F.lit(True).alias("full"))).otherwise(F.struct(F.concat(s["kept"], c).alias("kept"), F.lit(False).alias("full")))
    return F.when(F.char_length(prompt) <= chars, prompt).otherwise(strip(F.aggregate(clauses, start, add, lambda s: s["kept"])))


def initial_prompt(style: Column, **parts: Column) -> Column:
    """Style guidance, then the parts that have items, in a fixed order; null if there is nothing. parts: arrays by the names in PROMPT_PARTS."""
    lines = [F.when(strip(style) != "", strip(style))]
    for name, heading in PROMPT_PARTS:
        if name in parts:
            lines.append(F.when(F.size(parts[name]) > 0, F.concat(F.lit(f"{heading}: "), F.array_join(parts[name], ", "))))
    joined = F.concat_ws(" ", *lines)
    return F.when(joined != "", truncated_prompt(strip(joined)))


def request_prompt(language: Column, default_style: bool = True, style: Column | None = None, **parts: Column) -> Column:
    """The initial prompt of a request. Metadata of any kind makes it, with the language's style unless one is given; without any it is
    the style alone, or null where default_style is off. parts: raw texts by the names in PROMPT_PARTS."""
    blank = lambda c: F.coalesce(strip(c), F.lit("")) == ""
    given = F.lit(None).cast("string") if style is None else F.when(~blank(style), style)
    items = {name: prompt_items(raw) for name, raw in parts.items()}
    some = given.isNotNull()
    for name, raw in parts.items():  # terms and dictionary count by their items, the others by their text
        some = some | (F.size(items[name]) > 0 if name in ("terms", "dictionary") else ~blank(raw))
    prompt = initial_prompt(F.coalesce(given, style_guidance(language)), **items)
    return F.when(some | F.lit(default_style), prompt)


def screen_keywords(text: Column) -> Column:
    """Labels of services in the text, then other alphabetic words of five letters or more, sorted; ten at most."""
    low = F.lower(text)
    labels = F.array_compact(F.array(*(F.when(F.contains(low, F.lit(needle)), F.lit(label)) for needle, label in SERVICES)))
    words = F.filter(F.split(F.regexp_replace(low, "\n", " "), " "), lambda w: (F.char_length(w) >= 5) & w.rlike(r"\A\p{L}+\z") & ~w.isin(*(n for n, _ in SERVICES)))
    return F.slice(F.array_distinct(F.concat(labels, F.array_sort(F.array_distinct(words)))), 1, 10)


def screen_label(tags: Column, ocr_text: Column, frame_index: Column) -> Column:
    """Two tags, else the first line of text (40 characters), else the frame's number."""
    line = F.substring(F.element_at(F.split(ocr_text, "\r\n|[\\n\\r]"), 1), 1, 40)
    return F.when(F.size(tags) > 0, F.array_join(F.slice(tags, 1, 2), ", ")).when(F.coalesce(ocr_text, F.lit("")) != "", line).otherwise(F.concat(F.lit("frame#"), frame_index.cast("string")))


def base_name(path: Column) -> Column:
    """What follows the last slash."""
    return F.regexp_extract(path, r"[^/]+\z", 0)


def stem(path: Column) -> Column:
    """The base name without its last suffix."""
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]*\z", "")


def bare_handle(handle: Column) -> Column:
    """Without leading @."""
    return F.ltrim(handle, F.lit("@"))
