"""Main text of web pages, with site templates removed.

Every page is parsed to a tree, and each element's subtree is hashed, twice: by its tags and words, and by its skeleton, that
is its tags, classes and nesting without words, in which repeated siblings count once. Spark counts the hashes by host, over
pages of different content. A subtree whose words recur on several pages of its host is the site's template and is deleted;
so is one without prose whose skeleton recurs on more pages and that is mostly links, such as a menu that lists other things
on each, or, outside articles, a small part of its page, such as a notice or a footer that says another thing on each.
What recurrence leaves is checked by tag, role and class: elements that are no article by these go as well. Plain paragraphs and headings inside an article are
never taken for a template: a licence line or a quoted passage that many articles share belongs to each.

How often a subtree must recur is a number of pages, whatever the host's size, so large hosts are treated like small ones.
"""

from __future__ import annotations

import html as charrefs
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.shared import park, small

#: On how many pages of a host, different in content, a template recurs: one with the same words, plain text (of pages
#: without an article) with the same words, and one of links with the same skeleton.
MIN_PAGES, MIN_PAGES_PLAIN, MIN_PAGES_SKELETON = 5, 20, 10
#: Less than this share of a page's text is a small part of it.
SMALL = 0.25
WORDS, PLAIN, SKELETON = range(3)

_TOKEN = re.compile(r"""<!--(?:.*?-->|.*)|<([a-zA-Z][^\s/>]*)((?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+|["'])*+)>|</([a-zA-Z][^\s/>]*)[^>]*>|<[!?/][^>]*>""", re.S)
_TAIL = re.compile(r"<[a-zA-Z/!?][^>]*\Z")
_ATTRIBUTE = re.compile(r"""(?:^|[\s"'/])(class|id|role|hidden|style|aria-hidden|itemprop)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript iframe xmp textarea title noembed noframes template".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody tfoot thead tr ul".split()
)
_PLAIN = frozenset("p h1 h2 h3 h4 h5 h6 li dd dt blockquote pre figcaption td th tr caption summary".split())
_PROSE = frozenset("p h1 blockquote pre".split())
_IN_P = frozenset("table td th caption button html".split())
_CLOSES = {"li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])), "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])), "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])), "tr": (frozenset(["tr"]), frozenset(["table"])), "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])), "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])), "option": (frozenset(["option"]), frozenset(["select", "datalist"]))}
_DROP = frozenset("head nav footer aside form button select datalist svg math canvas object audio video dialog menu input label fieldset map".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
_WORDS = frozenset(
    "nav navbar navigation menu menubar header masthead banner topbar footer sidebar sidenav aside ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login share sharing social breadcrumb breadcrumbs comment comments commentlist disqus respond reply replies related recommended teaser pagination pager widget skip".split()
)
#: Inside an article these name its own parts or subjects.
_INSIDE = _WORDS - frozenset("header masthead banner topbar alert skip widget login signup social".split())
_COMMENTS = frozenset("comment comments commentlist disqus respond reply replies".split())
_ARTICLE_WORDS = frozenset("comment comments ad ads advert advertisement sponsored promo related recommended teaser reply".split())
_NEVER = frozenset(["html", "body", "main"])


class Page:
    """A tree in arrays: the nodes' parents come before them."""

    def __init__(self, source: str):
        self.tag, self.parent, self.kids = ["html"], [-1], [[]]
        self.boiler, self.named, self.main, self.inside, self.soft = [False], [False], [False], [False], [False]
        self.kind = [""]
        self.parse(source)
        n = len(self.tag)
        self.size = [sum(len(k) for k in kids if isinstance(k, str)) for kids in self.kids]
        for i in range(n - 1, 0, -1):
            self.size[self.parent[i]] += self.size[i]
        for i in range(1, n):  # a class like has-sidebar may stand on what holds most of the page
            if self.soft[i] and 2 * self.size[i] > self.size[0]:
                self.boiler[i] = False
        self.holds = [False] * n  # an article or main element, or within one level or more above it
        for i in range(n - 1, 0, -1):
            if self.holds[i] or self.main[i]:
                self.holds[self.parent[i]] = True

    def parse(self, source: str) -> None:
        tail = _TAIL.search(source, max(0, source.rfind("<")))
        if tail and not source.startswith("<!--", tail.start()):
            source = source[: tail.start()]
        stack, open_ = [0], {}
        at, end = 0, len(source)
        while at < end:
            m = _TOKEN.search(source, at)
            if m is None:
                self.say(stack[-1], source[at:])
                return
            if m.start() > at:
                self.say(stack[-1], source[at : m.start()])
            at = m.end()
            if m[1]:
                tag = m[1].lower()
                self.implied(tag, stack, open_)
                if tag in _VOID:
                    self.kids[stack[-1]].append("\x00" if tag == "hr" else " " if tag in ("br", "wbr") else "")
                elif tag in _RAW:
                    close = re.compile(f"</{re.escape(tag)}(?=[\\s/>])[^>]*>", re.I).search(source, at)
                    at = close.end() if close else end
                elif tag in ("html", "body") and (tag == "html" or open_.get("body")):
                    pass
                else:
                    self.node(tag, m[2], stack)
                    open_[tag] = open_.get(tag, 0) + 1
            elif m[3]:
                tag = m[3].lower()
                if open_.get(tag) and tag not in ("html", "body"):
                    self.close(tag, stack, open_)

    def say(self, node: int, text: str) -> None:
        self.kids[node].append(charrefs.unescape(text).replace("\x00", "") if "&" in text or "\x00" in text else text)

    def node(self, tag: str, attributes: str, stack: list[int]) -> None:
        found = {a.lower(): x or y or z for a, x, y, z in _ATTRIBUTE.findall(attributes)} if attributes else {}
        words = {w for k in ("class", "id") if k in found for w in re.split(r"[^a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", found[k]).lower())}
        role = found.get("role", "").lower()
        is_main = tag in ("article", "main") or role == "main" or "articlebody" in found.get("itemprop", "").lower()
        inside = self.inside[stack[-1]] or self.main[stack[-1]]
        by_name = False
        if tag in _NEVER or is_main and tag != "article":
            boiler = False
        elif tag == "article":
            boiler = bool(words & _ARTICLE_WORDS)
        else:
            boiler = tag in _DROP or role in _ROLES or "hidden" in found or found.get("aria-hidden", "") == "true" or "display:none" in found.get("style", "").replace(" ", "") or tag == "header" and not inside
            by_name = not boiler and bool(words & (_INSIDE if inside else _WORDS))
        self.tag.append(tag)
        self.parent.append(stack[-1])
        self.kids.append([])
        self.boiler.append(boiler or by_name)
        self.soft.append(by_name and not words & _COMMENTS)
        self.inside.append(inside)
        self.named.append(bool(found))
        self.kind.append(f"{' '.join(sorted(words))} {role}")
        self.main.append(is_main and not boiler)
        self.kids[stack[-1]].append(len(self.tag) - 1)
        stack.append(len(self.tag) - 1)

    def implied(self, tag: str, stack: list[int], open_: dict[str, int]) -> None:
        """End tags that the start of `tag` implies."""
        if tag in _BLOCK and open_.get("p"):
            self.close_to(frozenset(["p"]), _IN_P, stack, open_)
        if tag in _CLOSES:
            self.close_to(*_CLOSES[tag], stack, open_)

    def close_to(self, ends: frozenset, stop: frozenset, stack: list[int], open_: dict[str, int]) -> None:
        for k in range(len(stack) - 1, 0, -1):
            t = self.tag[stack[k]]
            if t in ends:
                self.cut(k, stack, open_)
                return
            if t in stop:
                return

    def close(self, tag: str, stack: list[int], open_: dict[str, int]) -> None:
        for k in range(len(stack) - 1, 0, -1):
            t = self.tag[stack[k]]
            if t == tag:
                self.cut(k, stack, open_)
                return
            if t in _BLOCK and tag not in _BLOCK:
                return  # an inline end tag doesn't end a block

    def cut(self, k: int, stack: list[int], open_: dict[str, int]) -> None:
        for i in stack[k:]:
            open_[self.tag[i]] -= 1
        del stack[k:]

    def hashes(self) -> tuple[list[int], list[int]]:
        """Of every subtree the hash of its tags and words, and that of its skeleton, zero where it has prose (a paragraph, quotation
        or first heading that isn't a link) and where it's neither mostly links nor, outside articles, a small part of the page."""
        n = len(self.tag)
        out, bones, linked, prose = [0] * n, [0] * n, [0] * n, [False] * n
        self.empty = [False] * n
        for i in range(n - 1, -1, -1):
            kids = self.kids[i]
            parts = [k if isinstance(k, str) else f"\x01{out[k]:x}\x02" for k in kids]
            self.empty[i] = all(not k.strip() if isinstance(k, str) else self.empty[k] for k in kids)
            out[i] = xxhash.xxh3_64_intdigest(f"{self.tag[i]}\x01{' '.join(' '.join(parts).split())}".encode("utf-8", "surrogatepass")) - 2**63
            below = [k for k in kids if not isinstance(k, str)]
            linked[i] = self.size[i] if self.tag[i] == "a" else sum(linked[k] for k in below)
            prose[i] = any(prose[k] for k in below) or self.tag[i] in _PROSE and 2 * linked[i] < self.size[i]
            shape = [bones[k] for k in below if self.tag[k] in _BLOCK or self.tag[k] == "a"]
            once = [x for j, x in enumerate(shape) if j == 0 or x != shape[j - 1]]
            bones[i] = xxhash.xxh3_64_intdigest(f"{self.tag[i]} {self.kind[i]} {once}", 1) - 2**63
        few = [self.size[i] < SMALL * self.size[0] and not self.inside[i] and not self.main[i] for i in range(n)]
        return out, [x if not prose[i] and (few[i] or linked[i] and 2 * linked[i] >= self.size[i]) else 0 for i, x in enumerate(bones)]

    def scopes(self) -> list[int]:
        """The outermost articles; without any the main elements; without any the whole page."""
        found: dict[bool, list[int]] = {True: [], False: []}
        hidden, within = [False] * len(self.tag), [False] * len(self.tag)
        for i in range(1, len(self.tag)):
            up = self.parent[i]
            hidden[i] = hidden[up] or self.boiler[i] and not self.holds[i]
            is_article = self.tag[i] == "article" and self.main[i]
            within[i] = within[up] or is_article
            if self.main[i] and not hidden[i]:
                if is_article and not within[up]:
                    found[True].append(i)
                elif not is_article and not any(i2 in found[False] for i2 in self.above(i)):
                    found[False].append(i)
        for kind in (True, False):
            if any(not self.blank(i) for i in found[kind]):
                return found[kind]
        return [0]

    def above(self, i: int) -> Iterator[int]:
        while (i := self.parent[i]) > 0:
            yield i

    def blank(self, i: int) -> bool:
        return next(self.lines([i]), None) is None

    def lines(self, scopes: list[int]) -> Iterator[tuple[str, tuple[int, ...]]]:
        """The lines of text under the scopes in page order, white space folded, each with the elements around it within its
        scope that may be a template's. Such elements are blocks, so a line is whole inside or outside of each."""
        line: list[str] = []
        chain: list[int] = []
        for scope in scopes:
            work: list = [scope]
            while work:
                k = work.pop()
                into = None
                if isinstance(k, str):
                    if k != "\x00":
                        line.append(k)
                        continue
                elif k >= 0:
                    block = self.tag[k] in _BLOCK
                    if k != scope and not self.holds[k] and self.boiler[k]:
                        if not block:
                            continue
                    else:
                        if block:
                            into = k if k != scope and self.deletable(k) else None
                            work.append(-1 if into is None else -2)
                        elif self.tag[k] in ("td", "th"):
                            work.append(" ")
                        work.extend(reversed(self.kids[k]))
                        if not block:
                            continue
                text = " ".join("".join(line).split())
                line.clear()
                if text:
                    yield text, tuple(chain)
                if into is not None:
                    chain.append(into)
                elif k == -2:
                    chain.pop()
            text = " ".join("".join(line).split())
            line.clear()
            if text:
                yield text, tuple(chain)

    def deletable(self, k: int) -> bool:
        """Whether the subtree may be a template's: outside articles any block, inside those that aren't plain text."""
        tag = self.tag[k]
        if tag not in _BLOCK or tag in _NEVER or self.main[k] or self.holds[k]:
            return False
        return not self.inside[k] or self.named[k] or tag not in _PLAIN

    def parts(self) -> tuple[list[str], list[list[int]], dict[int, int]]:
        """The main text's lines, for each the hashes that delete it if they are a template's, and of the whole page the hashes of
        subtrees with text that may be a template's, with their kind."""
        words, bones = self.hashes()
        texts, under = [], []
        for text, chain in self.lines(self.scopes()):
            texts.append(text)
            under.append([h for i in chain for h in (words[i], bones[i] if self.light(i) else 0) if h])
        found = {}
        for i in range(1, len(self.tag)):
            if not self.empty[i] and self.deletable(i):
                found[words[i]] = PLAIN if self.tag[i] in _PLAIN and not self.named[i] else WORDS
                if bones[i] and self.light(i):
                    found[bones[i]] = SKELETON
        return texts, under, found

    def light(self, k: int) -> bool:
        """Whether the subtree may be a template's by its skeleton alone: in articles only with a class, id or role."""
        return self.tag[k] not in _PLAIN and (self.named[k] or not self.inside[k])


def main_text(source: str | None, deleted: frozenset = frozenset()) -> str:
    """The page's main text without the deleted subtrees; empty for null and for pages without text."""
    if not source:
        return ""
    texts, under, _ = Page(source).parts()
    return "\n".join(t for t, u in zip(texts, under) if deleted.isdisjoint(u))


def host() -> F.Column:
    """Host of the url in lower case without user and port; empty where there is none."""
    return F.lower(F.coalesce(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1), F.lit("")))


def parsed(pages: DataFrame) -> DataFrame:
    """row, page_id, url, host, page (the html's hash), texts, under, hashes, kinds of every row of pages: see Page.parts. Pages
    are parsed once, here; what follows needs no html."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(it):
            own, texts, under, hashes, kinds = [], [], [], [], []
            for source in b.column(3).to_pylist():
                t, u, found = Page(source).parts() if source else ([], [], {})
                own.append(xxhash.xxh3_64_intdigest((source or "").encode()) - 2**63)
                texts.append(t)
                under.append(u)
                hashes.append(list(found))
                kinds.append(list(found.values()))
            more = [pa.array(own, pa.int64()), pa.array(texts, pa.list_(pa.string())), pa.array(under, pa.list_(pa.list_(pa.int64()))), pa.array(hashes, pa.list_(pa.int64())), pa.array(kinds, pa.list_(pa.int8()))]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *more], ["page_id", "url", "host", "page", "texts", "under", "hashes", "kinds"])

    plain = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", host().alias("host"), "html")
    schema = "page_id long, url string, host string, page long, texts array<string>, under array<array<long>>, hashes array<long>, kinds array<byte>"
    return plain.mapInArrow(run, schema).select(F.monotonically_increasing_id().alias("row"), "*")


def _recurring(found: DataFrame) -> DataFrame:
    """host, hash, kind, pages: the templates among the subtrees of what parsed gives. Copies of a page count once."""
    each = found.select("host", "page", F.explode(F.arrays_zip("hashes", "kinds")).alias("e")).select("host", F.col("e.hashes").alias("hash"), F.col("e.kinds").cast("int").alias("kind"), "page").distinct()
    least = F.element_at(F.array(F.lit(MIN_PAGES), F.lit(MIN_PAGES_PLAIN), F.lit(MIN_PAGES_SKELETON)), F.col("kind") + 1)
    return each.groupBy("host", "hash", "kind").agg(F.count("*").alias("pages")).where(F.col("pages") >= least)


def templates(pages: DataFrame) -> DataFrame:
    """host, hash, kind (WORDS, PLAIN or SKELETON), pages: the subtrees that recur across pages of each host."""
    return _recurring(parsed(pages))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages.

    Null and empty html give the empty text; a null or odd url counts as the empty host; copies of a page each get the same
    text and count once for templates; an empty table gives an empty one; other columns are not looked at. Templates are
    joined by host and hash, a row for each, so that no host's list is ever in one place.
    """
    found, _ = park(parsed(pages), "parsed")
    recurring, _ = park(_recurring(found).select("host", "hash").distinct(), "templates")
    # Most pages have nothing around their main text that could be a template's: they aren't shuffled.
    may = F.exists("under", lambda x: F.size(x) > 0)
    plain, some = found.where(~may), found.where(may)
    around = some.select("row", "host", F.explode(F.array_distinct(F.flatten("under"))).alias("hash"))
    gone = around.join(recurring, ["host", "hash"]).groupBy("row").agg(F.collect_set("hash").alias("gone"))
    left = F.transform(F.filter(F.arrays_zip("texts", "under"), lambda x: ~F.arrays_overlap(x["under"], "gone")), lambda x: x["texts"])
    kept = some.join(gone, "row", "left").withColumn("texts", F.when(F.col("gone").isNull(), F.col("texts")).otherwise(left))
    lines = plain.select("page_id", "url", "texts").union(kept.select("page_id", "url", "texts"))
    return lines.select("page_id", "url", F.array_join("texts", "\n").alias("text")).withColumn("n_chars", F.char_length("text").cast("long"))
