"""Main text of HTML pages by equivalence-class template deduction.

A page becomes tokens: start and end tags with their path (tags and classes from the root) and text blocks with their
path, of all its parts alike. Pages of one host are a site; hosts of fewer than MIN_PAGES distinct pages are put
together with pages of the same layout (paths down to DEPTH). Tokens of a site that share their
occurrence vector (count in each distinct page) form an equivalence class; vectors are compared by a
commutative 64-bit hash, so those of a site of any size are aggregated before the shuffle, never gathered.

A class is valid if it is large (MIN_TOKENS), frequent (on all of a site's distinct pages, or on ALL_PAGES of
them and MIN_SHARE), and ordered: in every page its tokens come round in one and the same order. Valid
classes are taken from the largest on; one whose rounds cross those of a class taken before, on any page, is left out, so what
is taken is nested. Order and crossings are found page by page and come together as flags and pairs of classes.

The tokens of these classes are the site's template, and text between two of them in a page lies in the slot of the first. Slots are ranked
over all pages of the site: if slots that mostly hold text of articles (article and main elements, roles and microdata) hold a
third of what isn't boilerplate, these are the main text, else all slots that don't mostly hold text of menus, headers, footers, sidebars, notices, adverts, forms
or comments, told by tag, role or class name. Of a main slot's text, the template's own (unless it stands in an article: headings that all
articles share) and that of such regions inside it (comments in an article) are left out. A page whose site has no template, or which has nothing in its main slots,
is taken by its own elements, by the same two rules.

Names count whole ("sidebar", "site-footer", not "has-sidebar"), never on html, body, main and article
elements, and inside an article only on elements that aren't parts of a text (a paragraph, a table) and only if they can't name a part of it (not "header", "warning", "side" or "social").
An element that contains an article or main is no boilerplate, whatever its name; only sidebars, lists of comments and the like
stay so if the page has an article elsewhere. Nor is a form or a named element that holds most of a page without articles (a form around everything, a
"widget" with the text in it), unless its name is that of comments.

Every page is parsed once, whole. Tokens and blocks go to the shared folder; templates are small and are broadcast only
if they have BROADCAST_ROWS rows at most, else joined by site.

Defined results: null or empty html gives an empty text; a null or hostless url makes a page of its own
host ''; repeated pages (equal html) count once in a vector, so copies never turn an article into a template; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkweave.llm import markup, storage

#: A template needs MIN_PAGES distinct pages. Its tokens are on all of them, on ALL_PAGES pages at least where there are more, and on MIN_SHARE of them.
MIN_PAGES = 4
ALL_PAGES = 8
MIN_SHARE = 0.5
MIN_TOKENS = 3
#: Articles are the main text if they hold the 1 / ARTICLE_SHARE part of the text outside boilerplate.
ARTICLE_SHARE = 3
#: Elements from the root whose paths are a page's layout.
DEPTH = 3
BROADCAST_ROWS = 20_000

#: Elements of HTML and their roles.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
REGION_TAGS = frozenset("nav footer aside header form".split())
BOILERPLATE_TAGS = frozenset("head script style noscript template iframe svg canvas object button select option textarea input dialog menu title audio video".split())
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
BOILERPLATE_NAMES = frozenset(
    "nav navbar navigation menu menus submenu breadcrumb breadcrumbs header masthead topbar banner footer bottombar sidebar side aside widget widgets ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion "
    "cookie cookies consent gdpr notice notices alert warning newsletter subscribe subscription signup login signin register share sharing social related recommended recommendations comment comments commentlist respond reply replies disqus discussion "
    "popup modal overlay lightbox toolbar pagination pager pagenav copyright legal disclaimer skip search searchform form hidden".split()
)
#: Names that may as well name a part of an article, and don't count there.
AMBIGUOUS_NAMES = frozenset("header masthead banner footer side aside promo promotion notice notices alert warning register related recommended recommendations discussion respond reply replies copyright legal disclaimer skip search form social".split())
#: Elements that are parts of an article, whatever their names.
PARTS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th tr tbody table blockquote pre figure figcaption".split())
#: Names of comments by readers, which may well be most of a page.
COMMENT_NAMES = frozenset("comment comments commentlist respond reply replies disqus discussion".split())
#: Regions whose articles are not the page's, if it has one elsewhere.
CARD_NAMES = frozenset("sidebar side aside widget widgets related recommended recommendations comment comments commentlist respond reply replies disqus discussion popup modal overlay lightbox".split())
#: Words that may stand before one of BOILERPLATE_NAMES in a name.
QUALIFIERS = frozenset("site page main top global primary secondary left right bottom".split())
ARTICLE_TAGS = frozenset(["article", "main"])
CLOSED_BY = {"p": frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()), "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option"])}
SCOPES = frozenset("ul ol dl table article section div main body".split())

#: What an element of this name ends.
CLOSES = {tag: [name for name, by in CLOSED_BY.items() if tag in by] for tag in frozenset().union(*CLOSED_BY.values())}

NAME = re.compile(r"[a-z0-9]+")
HOST = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)")


def _kinds(names: str) -> set[str]:
    """The BOILERPLATE_NAMES that whole names end in, where all before that is one of them or a qualifier."""
    parts = [NAME.findall(x) for x in names.lower().split()]
    return {x[-1] for x in parts if x and x[-1] in BOILERPLATE_NAMES and all(y in BOILERPLATE_NAMES or y in QUALIFIERS for y in x[:-1])}


def _attributes(raw: str) -> tuple[str, frozenset[str], bool, bool, bool]:
    return _known_attributes(raw) if len(raw) < 1000 else _read_attributes(raw)


def _read_attributes(raw: str) -> tuple[str, frozenset[str], bool, bool, bool]:
    """Class for the path, boilerplate names, is it of a boilerplate role, is it hidden, is it an article, by attributes."""
    at = markup.attributes(raw)
    names = frozenset(_kinds(f"{at.get('class', '')} {at.get('id', '')}"))
    roles = set(at.get("role", "").lower().split())
    style = re.sub(r"\s", "", at.get("style", "").lower())
    hidden = "hidden" in at or at.get("aria-hidden", "").lower() == "true" or "display:none" in style or "visibility:hidden" in style
    article = bool(roles & {"main", "article"} or at.get("itemprop", "").lower() == "articlebody")
    return ".".join(sorted(at.get("class", "").split())), names, bool(roles & BOILERPLATE_ROLES), hidden, article


_known_attributes = functools.lru_cache(4096)(_read_attributes)


class Page:
    """Tokens and text blocks of a page, by one scan over its markup. Time is linear in the page, however broken it is: open
    elements are found by tag and scope, not by walking up."""

    def __init__(self, source: str) -> None:
        self.tokens: list[int] = []  # start tags, end tags and blocks, in order
        self.layout: set[int] = set()
        self.blocks: list[tuple[int, int, str, bool, bool]] = []  # place and token, text, in an article, in a boilerplate region
        self.words: list[str] = []
        # open elements: tag, hash of the path, never shown, innermost region around, article, path of the innermost block
        self.open: list[tuple[str, int, bool, int, bool, int]] = [("", 0, False, -1, False, 0)]
        self.places: dict[str, list[int]] = {}  # of each tag, where it is open
        self.scopes: list[int] = []
        self.parents: list[int] = []  # of each region, the one around it
        self.cards: list[bool] = []  # do its articles count only if there is none elsewhere
        self.loose: list[bool] = []  # is it no region if it holds most of the page
        self.holding: set[int] = set()  # regions that contain an article
        self.free = False  # is there an article outside regions
        self.found: list[tuple[int, int, str, bool, int]] = []
        self._scan(source)
        inside = self._regions()
        self.blocks = [(at, token, text, article, region >= 0 and inside[region]) for at, token, text, article, region in self.found]

    def _regions(self) -> list[bool]:
        """Which regions are boilerplate, or in one that is."""
        size = [0] * len(self.parents)
        for *_, text, _, region in self.found:
            if region >= 0:
                size[region] += len(text)
        for k in range(len(size) - 1, -1, -1):  # parents come first
            if self.parents[k] >= 0:
                size[self.parents[k]] += size[k]
        shown = sum(len(text) for *_, text, _, _ in self.found)
        inside: list[bool] = []
        for k, parent in enumerate(self.parents):
            clear = k in self.holding and not (self.free and self.cards[k]) or self.loose[k] and not self.free and 2 * size[k] > shown
            inside.append(not clear or parent >= 0 and inside[parent])
        return inside

    def _close(self, k: int) -> None:
        """Elements from the k-th open one on end here."""
        for tag, path, *_ in reversed(self.open[k:]):
            if tag not in INLINE:
                self.tokens.append(hash_of((path, "/")))
            self.places[tag].pop()
            if tag in SCOPES:
                self.scopes.pop()
        del self.open[k:]

    def _flush(self) -> None:
        if not self.words:
            return
        text = " ".join("".join(self.words).split())
        self.words = []
        if text:
            _, _, unseen, region, article, block = self.open[-1]
            token = hash_of((block, text))
            if not unseen:
                self.found.append((len(self.tokens), token, text, article, region))
            self.tokens.append(token)

    def _start(self, tag: str, raw: str) -> None:
        if tag not in INLINE:
            self._flush()
            k = max((self.places[name][-1] for name in CLOSES.get(tag, ()) if self.places.get(name)), default=0)
            if k > (self.scopes[-1] if self.scopes else 0):
                self._close(k)
        kind, names, role, hidden, article = _attributes(raw) if raw and raw != "/" else ("", frozenset(), False, False, False)
        _, path, was_unseen, was_in, was_article, block = self.open[-1]
        path = hash_of((path, tag, kind))
        if tag not in INLINE:
            self.tokens.append(path)
            if len(self.open) <= DEPTH:
                self.layout.add(path)
        if tag in VOID:
            return
        unseen = was_unseen or hidden and tag not in ("html", "body", "main") or tag in BOILERPLATE_TAGS
        article = article or tag in ARTICLE_TAGS
        if was_article:
            names = frozenset() if tag in PARTS else names - AMBIGUOUS_NAMES
        region = was_in
        if not unseen and article:
            while was_in >= 0 and was_in not in self.holding:
                self.holding.add(was_in)
                was_in = self.parents[was_in]
            self.free |= region < 0 and tag != "main"
        elif not unseen and tag not in ("html", "body") and (names or role or tag in REGION_TAGS and not (tag == "header" and was_article)):
            region = len(self.parents)
            self.parents.append(was_in)
            self.cards.append(bool(names & CARD_NAMES or role or tag in ("nav", "footer", "aside")))
            self.loose.append(not role and (tag == "form" or tag not in REGION_TAGS) and not names & COMMENT_NAMES)
        if unseen and not was_unseen or region != self.open[-1][3]:
            self._flush()
        self.places.setdefault(tag, []).append(len(self.open))
        if tag in SCOPES:
            self.scopes.append(len(self.open))
        self.open.append((tag, path, unseen, region, (was_article or article) and not unseen, block if tag in INLINE else path))

    def _end(self, tag: str) -> None:
        k = self.places[tag][-1] if self.places.get(tag) else 0
        if not k or tag in INLINE and self.scopes and self.scopes[-1] > k:
            return
        if tag not in INLINE or self.open[k][2:4] != self.open[k - 1][2:4]:
            self._flush()
        self._close(k)

    def _scan(self, source: str) -> None:
        for kind, value, raw in markup.Scanner(source).events():
            if kind == "text":
                if self.open[-1][0] not in markup.RAW or not self.open[-1][2]:  # scripts have no words
                    self.words.append(value)
                continue
            if value == "br":
                self.words.append(" ")
            if kind == "start":
                self._start(value, raw)
            else:
                self._end(value)
        self._flush()


def hash_of(value: tuple) -> int:
    """A signed 64-bit hash that is the same in every process."""
    import xxhash

    h = xxhash.xxh3_64_intdigest("\0".join(map(str, value)).encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >> 63 else h


def host_of(url: str | None) -> str:
    m = HOST.match(url or "")
    return m[1].lower() if m else ""


BLOCK = "array<struct<at: int, token: long, text: string, article: boolean, region: boolean>>"


def parsed(pages: DataFrame) -> DataFrame:
    """page_id, url, host, layout, digest (of the html), tokens, blocks."""
    block = pa.struct([("at", pa.int32()), ("token", pa.int64()), ("text", pa.string()), ("article", pa.bool_()), ("region", pa.bool_())])
    names = ["page_id", "url", "host", "layout", "digest", "tokens", "blocks"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows = []
                for url, source in zip(part.column("url").to_pylist(), part.column("html").to_pylist(), strict=True):
                    page = Page(source or "")
                    blocks = [dict(zip(("at", "token", "text", "article", "region"), b, strict=True)) for b in page.blocks]
                    rows.append((host_of(url), hash_of(tuple(sorted(page.layout))), hash_of((source or "",)), page.tokens, blocks))
                types = (pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(block))
                yield pa.record_batch([part.column("page_id"), part.column("url"), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True))], names=names)

    storage.bounded_batches(pages.sparkSession)
    typed = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return typed.mapInArrow(run, f"page_id long, url string, host string, layout long, digest long, tokens array<long>, blocks {BLOCK}")


def attached(pages: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """pages with the columns of a table of one row per key, null where it has none; broadcast only if it is small."""
    small = table.count() <= BROADCAST_ROWS
    table = table.withColumnRenamed(key, "_key")
    return pages.join(F.broadcast(table) if small else table, pages[key] == F.col("_key"), "left").drop("_key")


def sited(found: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """parsed() with the column site: the host, or the layout where the host has too few distinct pages."""
    large = found.select("host", "digest").distinct().groupBy("host").agg(F.count("*").alias("host_pages")).where(F.col("host_pages") >= min_pages)
    site = F.when(F.col("host_pages").isNotNull(), F.concat(F.lit("host "), "host")).otherwise(F.concat(F.lit("layout "), F.col("layout").cast("string")))
    return attached(found, storage.staged(large, "page-hosts"), "host").withColumn("site", site).drop("host_pages")


def occurrences(pages: DataFrame) -> DataFrame:
    """(site, digest, token, n) of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = batch.column("tokens")
            rows = np.repeat(np.arange(batch.num_rows), tokens.value_lengths().to_numpy(zero_copy_only=False))
            flat = tokens.flatten().to_numpy()
            order = np.lexsort((flat, rows))
            rows, flat = rows[order], flat[order]
            new = np.flatnonzero(np.concatenate([[True], (rows[1:] != rows[:-1]) | (flat[1:] != flat[:-1])])) if len(flat) else np.zeros(0, np.int64)
            of = pa.array(rows[new])
            yield pa.record_batch([batch.column("site").take(of), batch.column("digest").take(of), pa.array(flat[new]), pa.array(np.diff(np.append(new, len(flat))).astype(np.int32))], names=["site", "digest", "token", "n"])

    return pages.select("site", "digest", "tokens").mapInArrow(run, "site string, digest long, token long, n int")


def classes(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """(site, classes): large and frequent equivalence classes of each site, with their tokens."""
    sites = pages.select("site", "digest").distinct().groupBy("site").agg(F.count("*").alias("site_pages")).where(F.col("site_pages") >= min_pages)
    mixed = F.xxhash64("digest", "n").bitwiseAND(F.lit((1 << 44) - 1))  # sums of 2^19 pages fit in 63 bits, of more in a decimal; equal vectors have equal sums
    vectors = occurrences(pages).distinct().groupBy("site", "token").agg(F.count("*").alias("pages"), F.sum(mixed.cast("decimal(38,0)")).alias("vector"))
    # tokens of one page or a few are most of a site's; they needn't meet the number of its pages
    several = vectors.where(F.col("pages") >= min(min_pages, ALL_PAGES))
    frequent = several.join(sites, "site").where((F.col("pages") >= F.least(F.lit(ALL_PAGES), "site_pages")) & (F.col("pages") >= min_share * F.col("site_pages")))
    large = frequent.groupBy("site", F.xxhash64("pages", "vector").alias("id")).agg(F.sort_array(F.collect_list("token")).alias("tokens")).where(F.size("tokens") >= min_tokens)
    return storage.staged(large.groupBy("site").agg(F.sort_array(F.collect_list(F.struct("id", "tokens"))).alias("classes")), "page-classes")


def rounds(tokens: list[int], class_of: dict[int, int], sizes: dict[int, int]) -> tuple[dict[int, int | None], set[tuple[int, int]]]:
    """In one page: of each class the hash of the order in which its tokens come round (None if they don't), and pairs of classes whose rounds cross."""
    place: dict[int, list[int]] = {}
    crossing: set[tuple[int, int]] = set()
    stack: list[int] = []  # classes in the middle of a round, the innermost last
    for t in tokens:
        c = class_of.get(t)
        if c is None:
            continue
        seen = place.setdefault(c, [])
        if len(seen) % sizes[c]:
            at = len(stack) - 1 - stack[::-1].index(c)
            crossing.update((min(c, x), max(c, x)) for x in stack[at + 1 :])  # they began inside this round's slot and haven't ended
        else:
            stack.append(c)
        seen.append(t)
        if not len(seen) % sizes[c]:
            del stack[len(stack) - 1 - stack[::-1].index(c)]
    order = {}
    for c, seen in place.items():
        first = seen[: sizes[c]]
        regular = len(seen) % sizes[c] == 0 and all(seen[k : k + sizes[c]] == first for k in range(0, len(seen), sizes[c]))
        order[c] = hash_of(tuple(first)) if regular else None
    return order, crossing


def taken(found: list[tuple[int, list[int]]], disordered: set[int], crossing: set[tuple[int, int]]) -> list[int]:
    """Tokens of the classes that are ordered and nested, the largest first."""
    kept: list[int] = []
    out: list[int] = []
    for c, tokens in sorted(found, key=lambda x: (-len(x[1]), x[0])):
        if c not in disordered and not any((min(c, x), max(c, x)) in crossing for x in kept):
            kept.append(c)
            out += tokens
    return out


def templates(pages: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """(site, template): the tokens of each site's template. pages: sited()."""
    found = classes(pages, min_pages)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for site, tokens, known in zip(*(batch.column(c).to_pylist() for c in ("site", "tokens", "classes")), strict=True):
                order, crossing = rounds(tokens, {t: c["id"] for c in known for t in c["tokens"]}, {c["id"]: len(c["tokens"]) for c in known})
                out += [(site, c, None, h) for c, h in order.items()] + [(site, a, b, None) for a, b in crossing]
            cols = list(zip(*out, strict=True)) or [()] * 4
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["site", "a", "b", "order"])

    told = attached(pages.select("site", "tokens"), found, "site").where("classes is not null").mapInArrow(check, "site string, a long, b long, order long")
    flags = told.groupBy("site", "a", "b").agg(F.min("order").alias("low"), F.max("order").alias("high"), F.count_if(F.col("order").isNull()).alias("none"))
    broken = F.col("b").isNull() & ((F.col("low") != F.col("high")) | (F.col("none") > 0))
    by_site = flags.groupBy("site").agg(F.collect_list(F.when(broken, F.col("a"))).alias("disordered"), F.collect_list(F.when(F.col("b").isNotNull(), F.struct("a", "b"))).alias("crossing"))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [taken([(c["id"], c["tokens"]) for c in known], set(bad), {(x["a"], x["b"]) for x in pairs}) for known, bad, pairs in zip(*(batch.column(c).to_pylist() for c in ("classes", "disordered", "crossing")), strict=True)]
            yield pa.record_batch([batch.column("site"), pa.array(out, pa.list_(pa.int64()))], names=["site", "template"])

    return storage.staged(found.join(by_site, "site").mapInArrow(choose, "site string, template array<long>").where(F.size("template") > 0), "page-templates")


def slots_of(tokens: list[int], template: set[int], blocks: list[dict]) -> list[int]:
    """The slot of each block: the last token of the template before it (0 before all)."""
    out, slot, at = [], 0, 0
    for b in blocks:
        for t in tokens[at : b["at"]]:
            if t in template:
                slot = t
        at = b["at"]
        out.append(slot)
    return out


def ranked_slots(pages: DataFrame) -> DataFrame:
    """(site, main): the slots that hold the main text. pages: sited() with template."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for site, tokens, template, blocks in zip(*(batch.column(c).to_pylist() for c in ("site", "tokens", "template", "blocks")), strict=True):
                template = set(template)
                of: dict[int, list[int]] = {}
                for slot, b in zip(slots_of(tokens, template, blocks), blocks, strict=True):
                    if b["token"] not in template:
                        n = of.setdefault(slot, [0, 0, 0])
                        n[0] += b["size"]
                        n[1] += b["size"] * (b["article"] and not b["region"])
                        n[2] += b["size"] * b["region"]
                out += [(site, slot, *n) for slot, n in of.items()]
            cols = list(zip(*out, strict=True)) or [()] * 5
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.string(), *[pa.int64()] * 4), strict=True)], names=["site", "slot", "chars", "article", "region"])

    narrow = F.transform("blocks", lambda b: F.struct(b["at"].alias("at"), b["token"].alias("token"), F.char_length(b["text"]).alias("size"), b["article"].alias("article"), b["region"].alias("region")))
    rows = pages.where("template is not null").select("site", "tokens", "template", narrow.alias("blocks")).mapInArrow(run, "site string, slot long, chars long, article long, region long")
    slots = rows.groupBy("site", "slot").agg(*(F.sum(c).alias(c) for c in ("chars", "article", "region")))
    # articles are the main text if they hold a good part of what is not boilerplate: else they are teasers
    article, other = F.when(2 * F.col("article") >= F.col("chars"), F.col("slot")), F.when(2 * F.col("region") < F.col("chars"), F.col("slot"))
    found = slots.groupBy("site").agg(F.collect_list(article).alias("a"), F.collect_list(other).alias("o"), (ARTICLE_SHARE * F.sum("article") >= F.sum(F.col("chars") - F.col("region"))).alias("most"))
    return storage.staged(found.select("site", F.when((F.size("a") > 0) & F.col("most"), F.col("a")).otherwise(F.col("o")).alias("main")), "page-slots")


def chosen(tokens: list[int], blocks: list[dict], template: list[int] | None, main: list[int] | None) -> list[str]:
    """The blocks of a page's main text: those in main slots, or by the page's own elements. The template's own text counts within an article."""
    own = set(template or ())
    if own and main:
        wanted = set(main)
        free = [slot in wanted and b["token"] not in own and not b["region"] for slot, b in zip(slots_of(tokens, own, blocks), blocks, strict=True)]
        articles = any(f and b["article"] for f, b in zip(free, blocks, strict=True))
        if any(free):
            return [b["text"] for f, b in zip(free, blocks, strict=True) if f or articles and b["token"] in own and b["article"] and not b["region"]]
    shown = [b for b in blocks if not b["region"] and (b["token"] not in own or b["article"])]
    articles = [b for b in shown if b["article"]]
    if ARTICLE_SHARE * sum(len(b["text"]) for b in articles) < sum(len(b["text"]) for b in shown):
        articles = []
    return [b["text"] for b in articles or shown]


def main_text(pages: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    found = sited(storage.staged(parsed(pages), "page-blocks"), min_pages)
    template = templates(found, min_pages)
    found = attached(found, template, "site")
    found = attached(found, ranked_slots(found), "site")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = [" ".join(chosen(*row)) for row in zip(*(part.column(c).to_pylist() for c in ("tokens", "blocks", "template", "main")), strict=True)]
                yield pa.record_batch([part.column("page_id"), part.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    text = found.select("page_id", "url", "tokens", "blocks", "template", "main").mapInArrow(run, "page_id long, url string, text string")
    return text.withColumn("n_chars", F.char_length("text").cast("long"))
