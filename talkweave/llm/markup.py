"""Markup of HTML pages as a sequence of texts and tags, in one scan whose time is linear in the page, however broken that is.

A tag ends at the next > outside quotes. A quote that doesn't come again is a character like any other, and where no tag ends outside
quotes any more, the next > ends it: both are found out once for the rest of the page. A < that no > follows, or no letter, is text.
Comments and declarations are left out; content of elements of raw text (scripts, titles) is one text.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
OPENING = re.compile(r"<(?:!--|[!?]|/?[a-zA-Z])")
TAG_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
STOP = re.compile(r"[>\"']")
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")


def attributes(raw: str) -> dict[str, str]:
    """Names, in lower case, and values of what stands in a tag behind its name."""
    return {m[1].lower(): entities.unescape(next((g for g in m.groups()[1:] if g is not None), "")) for m in ATTRIBUTE.finditer(raw)}


class Scanner:
    """What is known of the rest of a page."""

    def __init__(self, source: str) -> None:
        self.source = source
        self.odd: set[str] = set()  # quotes that don't come again
        self.unquoted = False  # no further tag ends outside quotes

    def _tag_end(self, at: int) -> int:
        """The place of the > of the tag whose name ends at `at`, -1 if there is none."""
        inside = at
        while not self.unquoted:
            m = STOP.search(self.source, inside)
            if not m:
                self.unquoted = True
            elif m[0] == ">":
                return m.start()
            else:
                end = -1 if m[0] in self.odd else self.source.find(m[0], m.end())
                if end < 0:
                    self.odd.add(m[0])
                inside = end + 1 if end >= 0 else m.end()
        return self.source.find(">", at)

    def events(self) -> Iterator[tuple[str, str, str]]:
        """("text", text, ""), ("start", tag, what stands behind its name) and ("end", tag, "")."""
        source, at, end = self.source, 0, len(self.source)
        while at < end:
            m = OPENING.search(source, at)
            start = m.start() if m else end
            name, stop = None, end
            if m and m[0] == "<!--":
                stop = source.find("-->", start + 4)
                stop = stop + 3 if stop >= 0 else end
            elif m and m[0][1] in "!?":
                stop = source.find(">", start) + 1 or end
            elif m:
                name = TAG_NAME.match(source, start)
                close = self._tag_end(name.end())
                if close < 0:  # no tag any more
                    name, start = None, end
                else:
                    stop = close + 1
            if text := source[at:start]:
                yield "text", entities.unescape(text) if "&" in text else text, ""
            at = stop
            if not name:
                continue
            tag = name[1].lower()
            if source[start + 1] == "/":
                yield "end", tag, ""
                continue
            yield "start", tag, source[name.end() : stop - 1]
            if tag in RAW:
                close = re.compile(f"</{re.escape(tag)}(?=[\\s/>]|\\Z)", re.IGNORECASE).search(source, at)
                stop = close.start() if close else end
                if text := source[at:stop]:
                    yield "text", entities.unescape(text) if "&" in text and tag in ("title", "textarea") else text, ""
                at = stop
