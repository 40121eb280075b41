"""Main text of web pages by removal of site templates.

Every page is parsed to a tree with HTML's implied end tags. Element subtrees
are hashed twice: over tag, class, id and text; and, for groups of blocks, over
their path and shape alone, whatever their text is. Spark counts, for each
host, the pages that hold a hash. Subtrees that recur on many pages of a host
are its template and are deleted. Word lists of tags, roles and class names are
a prior beside the counts: what they name needs no recurrence, as a host may
have few pages.

What is protected: articles and what holds most of a page's words (unless half
of the host's pages have it), text blocks and inline elements of articles, and
elsewhere pieces of text beside text of the page's own. A group that recurs by
shape alone must lie outside the main text, hold no first heading, and be small
or made of links. Of what is left of the whole page, article and main elements
are taken alone if one of them has as many words as all around them. Pages of
one main text count as one, since a host may hold an article many times.

A ``header`` inside an article holds its title and stays; others go.
"""

from __future__ import annotations

import hashlib
import html
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexaspark.llm import common as C

#: A subtree is a template's if so many different pages of the host hold it, and this share of
#: them, or so many whatever the share.
MIN_PAGES, MIN_SHARE, MANY_PAGES = 3, 0.02, 50
#: The share of a host's pages from which a shape is a template, and any other (or one on MANY_PAGES) goes even if it
#: holds most of a page's words; and the part of the main text that the words of a group may be that recurs by shape.
WIDE_SHARE, SMALL_PART = 0.5, 0.05
#: Template hashes that are broadcast at most; beyond, each page's own are joined.
BROADCAST_HASHES = 1_000_000

# HTML's element kinds, and the names that are the prior.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()) - {"html"}
SILENT = frozenset("script style noscript template head title meta link svg math canvas iframe object embed audio video button select option input textarea noembed noframes".split())
LIKELY = frozenset("nav footer aside form fieldset dialog menu search".split())
ROLES = frozenset("navigation banner contentinfo complementary search menu menubar dialog alert alertdialog form".split())
NAMES = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar footer masthead cookie cookies consent gdpr notice banner popup modal newsletter subscribe comment comments disqus share sharing social related recommended widget pagination pager".split())
PROSE = frozenset("article main body html p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd blockquote pre table tbody thead tfoot tr td th caption figure figcaption".split())
GROUPS = frozenset("address article aside center details dir div dl fieldset figure footer form header hgroup main menu nav ol search section table ul".split())
CLOSES_P = BLOCKS - frozenset("body caption li dd dt legend summary tbody td tfoot th thead tr".split())
SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "option": ({"option"}, {"select"})}

NAME, GAP = re.compile(r"[a-zA-Z][^\s/>]*+"), re.compile(r"[\s/]*+")
ATTRIBUTE = re.compile(r"""([^\s/>][^\s/>=]*+)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+))?+""")
RAW_ENDS = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*+(?:>|\Z)", re.I) for tag in RAW}
HIDDEN = re.compile(r"display\s*:\s*none", re.I)
HOST = re.compile(r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)")


class Node:
    """An element: its place in page order, the place after its last descendant, and what it holds."""

    __slots__ = ("tag", "attrs", "children", "at", "end")

    def __init__(self, tag: str, attrs: dict, at: int):
        self.tag, self.attrs, self.children, self.at, self.end = tag, attrs, [], at, 0


class _Open:
    """The open elements, with the places of each kind, so that no tag searches them."""

    def __init__(self, nodes: list[Node]):
        self.nodes, self.stack, self.of, self.blocks, self.walls = nodes, [], {}, [], []

    def push(self, node: Node) -> None:
        k = len(self.stack)
        self.stack.append(node)
        self.of.setdefault(node.tag, []).append(k)
        if node.tag in BLOCKS:
            self.blocks.append(k)
            if node.tag != "p":
                self.walls.append(k)

    def cut(self, k: int) -> None:
        """Closes the k-th open element and all in it."""
        while len(self.stack) > k:
            node = self.stack.pop()
            node.end = len(self.nodes)
            self.of[node.tag].pop()
            if node.tag in BLOCKS:
                self.blocks.pop()
                if node.tag != "p":
                    self.walls.pop()

    def last(self, tag: str) -> int:
        found = self.of.get(tag)
        return found[-1] if found else -1

    def before(self, tag: str) -> None:
        """Closes what a start tag ends without saying so."""
        if tag in CLOSES_P:
            k = self.last("p")
            if k > (self.walls[-1] if self.walls else 0):
                self.cut(k)
        if tag in SIBLINGS:
            tags, bounds = SIBLINGS[tag]
            bound = max(0, *(self.last(b) for b in bounds))
            inside = [found[i] for t in tags if (found := self.of.get(t)) and (i := bisect_right(found, bound)) < len(found)]
            if inside:
                self.cut(min(inside))

    def ended(self, tag: str) -> None:
        """An end tag; an inline one closes no block."""
        k = self.last(tag)
        if k > 0 and (tag in BLOCKS or not self.blocks or self.blocks[-1] < k):
            self.cut(k)


def parse(source: str) -> list[Node]:
    """The elements in page order, the root first; their children are elements and
    strings. Unclosed and stray tags are allowed; what begins as a tag that the page
    never ends is text. The source is read once, from left to right."""
    nodes = [Node("html", {}, 0)]
    held = _Open(nodes)
    held.push(nodes[0])
    stack, at, n, last = held.stack, 0, len(source), source.rfind(">")
    while at < n:
        start = source.find("<", at)
        if start < 0 or start > last:
            stack[-1].children.append(source[at : start if source.startswith("<!--", start) else n])
            break
        sign = source[start + 1] if start + 1 < n else ""
        ending = sign == "/"
        name = NAME.match(source, start + 1 + ending)
        if name is None and sign not in ("!", "?"):
            stack[-1].children.append(source[at : start + 1])
            at = start + 1
            continue
        if start > at:
            stack[-1].children.append(source[at:start])
        if name is None:
            end = "-->" if source.startswith("!--", start + 1) else "]]>" if source.startswith("![CDATA[", start + 1) else ">"
            found = source.find(end, start + (4 if end == "-->" else 2))
            at = n if found < 0 else found + len(end)
            continue
        tag, at = name[0].lower(), name.end()
        if ending:
            at = source.find(">", at) + 1
            held.ended(tag)
            continue
        attrs: dict[str, str] = {}
        while True:
            at = GAP.match(source, at).end()
            if at >= n or source[at] == ">":
                break
            m = ATTRIBUTE.match(source, at)
            at = m.end()
            attrs.setdefault(m[1].lower(), html.unescape(m[2].strip("\"'") if m[2] else ""))
        if at >= n:  # its end stands in an attribute at most
            stack[-1].children.append(source[start:])
            break
        at += 1
        held.before(tag)
        if tag in ("html", "body") and held.last(tag) >= 0:
            stack[held.last(tag)].attrs.update(attrs)
            continue
        node = Node(tag, attrs, len(nodes))
        stack[-1].children.append(node)
        nodes.append(node)
        if tag in RAW:
            node.end = len(nodes)
            found = RAW_ENDS[tag].search(source, at)
            at = found.end() if found else n
        elif tag in VOID:
            node.end = len(nodes)
        else:
            held.push(node)
    held.cut(0)
    return nodes


def _names(node: Node) -> set[str]:
    return set(re.split(r"[^a-z0-9]+", f"{node.attrs.get('class', '')} {node.attrs.get('id', '')}".lower()))


def silent(node: Node) -> bool:
    """Whether the element shows no text to read."""
    a = node.attrs
    return node.tag in SILENT or bool(a) and ("hidden" in a or a.get("aria-hidden", "").lower() == "true" or HIDDEN.search(a.get("style", "")) is not None)


def likely(node: Node, inside: bool) -> bool:
    """Whether the lists name the element as no article text."""
    if node.tag in LIKELY or (node.tag == "header" and not inside):
        return True
    a = node.attrs
    return bool(a) and (a.get("role", "").lower() in ROLES or (node.tag not in ("html", "body", "article", "main") and ("class" in a or "id" in a) and not NAMES.isdisjoint(_names(node))))


#: What may be the main text, the likeliest first.
MAINS = (lambda x: x.tag == "article" or x.attrs.get("role", "").lower() == "article", lambda x: x.tag == "main" or x.attrs.get("role", "").lower() == "main")


class Page:
    """A parsed page: for each element, by place, whether it is deleted whatever the host
    (``gone``), and the words and linked words of what is left of it."""

    def __init__(self, source: str | None, prior: bool = True):
        self.nodes = parse(source or "")
        self.groups = [self._outermost(wanted, prior) for wanted in MAINS]
        self.tops = [n for g in self.groups for n in g]
        inside = bytearray(len(self.nodes))
        for top in self.tops:
            inside[top.at : top.end] = b"\1" * (top.end - top.at)
        self.inside = inside
        tops = {t.at for t in self.tops}
        self.gone = [silent(n) or (prior and n.at > 0 and n.at not in tops and likely(n, bool(inside[n.at]))) for n in self.nodes]
        self.words, self.linked = [0] * len(self.nodes), [0] * len(self.nodes)
        for n in reversed(self.nodes):
            total = links = 0
            for c in n.children:
                if isinstance(c, str):
                    total += len(c.split())
                elif not self.gone[c.at]:
                    total += self.words[c.at]
                    links += self.linked[c.at]
            self.words[n.at], self.linked[n.at] = total, total if n.tag == "a" else links

    def _outermost(self, wanted, prior: bool) -> list[Node]:
        found, k = [], 0
        while k < len(self.nodes):
            n = self.nodes[k]
            if wanted(n):
                found.append(n)
            k = n.end if wanted(n) or silent(n) or (prior and k and likely(n, False)) else k + 1
        return found

    def text(self, deleted: Callable[[int], bool] = lambda at: False) -> str:
        """What stays of the articles, if one of them has as many words as all that stays
        around them; else the same for main elements; else what stays of the page."""
        whole = self._blocks(self.nodes[0], deleted)
        size = len(whole.split())
        for found in self.groups:
            texts = [t for n in found if (t := self._blocks(n, deleted))]
            sizes = [len(t.split()) for t in texts]
            if sizes and 2 * max(sizes) >= max(sizes) + size - sum(sizes):
                return "\n\n".join(texts)
        return whole

    def _blocks(self, top: Node, deleted) -> str:
        blocks: list[list[str]] = [[]]
        todo: list = [top]
        while todo:
            x = todo.pop()
            if x is None:
                blocks.append([])
            elif isinstance(x, str):
                blocks[-1].append(x)
            elif self.gone[x.at] or (x is not top and deleted(x.at)):
                continue
            elif x.tag == "br":
                blocks[-1].append(" ")
            elif x.tag in BLOCKS:
                todo.append(None)
                todo += reversed(x.children)
                blocks.append([])
            else:
                todo += reversed(x.children)
        lines = (" ".join(html.unescape("".join(b)).split()) for b in blocks if b)
        return "\n\n".join(x for x in lines if x)

    def hashes(self) -> list[int]:
        """The subtree's hash by place, 0 for an element that holds nothing."""
        raw: list[bytes] = [b""] * len(self.nodes)
        for n in reversed(self.nodes):
            parts = [self._label(n)]
            parts += [raw[c.at] if isinstance(c, Node) else " ".join(c.split()).encode("utf-8", "surrogatepass") for c in n.children]
            raw[n.at] = _digest(b"\0".join(parts))
        return [_number(raw[n.at]) if n.children else 0 for n in self.nodes]

    def shapes(self) -> dict[int, int]:
        """place -> hash of path and shape, for groups of blocks outside of the prior's:
        runs of children of one shape are one child, and text counts for nothing."""
        below: list[bytes] = [b""] * len(self.nodes)
        for n in reversed(self.nodes):
            if n.tag not in BLOCKS and n.at:  # no block's shape asks for it
                continue
            kinds: list[bytes] = []
            for c in n.children:
                if isinstance(c, Node) and c.tag in BLOCKS and (not kinds or kinds[-1] != below[c.at]):
                    kinds.append(below[c.at])
            below[n.at] = _digest(b"\1".join([self._label(n), *kinds]))
        out, path, k = {}, {0: b""}, 0
        while k < len(self.nodes):
            n = self.nodes[k]
            if n.tag in GROUPS and n.children and k:
                out[k] = _number(_digest(b"\2" + path[k] + below[k]))
            if self.gone[k] and k:
                k = n.end
                continue
            inner = [c.at for c in n.children if isinstance(c, Node)]
            if inner:
                path.update(dict.fromkeys(inner, _digest(path[k] + self._label(n))))
            k += 1
        return out

    @staticmethod
    def _label(n: Node) -> bytes:
        a = n.attrs
        return (f"{n.tag}|{a.get('class', '')}|{a.get('id', '')}" if a else n.tag).encode("utf-8", "surrogatepass")

    def kept(self) -> Iterator[int]:
        """The places of the elements that aren't in one that is deleted whatever the host."""
        k = 0
        while k < len(self.nodes):
            yield k
            k = self.nodes[k].end if self.gone[k] else k + 1

    def content(self) -> int:
        """Hash of the main text, before templates are known."""
        return _number(_digest(self.text().encode("utf-8", "surrogatepass")))

    def without(self, template: dict[int, bool]) -> str:
        """The main text without the host's templates (hash -> whether most of its pages, or very many, have it)."""
        if not template:
            return self.text()
        known = self.hashes()
        recurring = {k for k in self.kept() if known[k] in template}
        wide = {k for k in recurring if template[known[k]]}
        deleted = recurring - self._ancestors() - self._prose() - self._bulk(recurring, wide) - self._beside_own(recurring)
        deleted |= self._by_shape(template, recurring)
        return self.text(deleted.__contains__) or self.text()

    def _ancestors(self) -> set[int]:
        places = sorted(t.at for t in self.tops)
        return {n.at for n in self.nodes if (i := bisect_right(places, n.at - 1)) < len(places) and places[i] < n.end}

    def _prose(self) -> set[int]:
        """Text blocks and inline elements of the articles."""
        return {k for top in self.tops for k in range(top.at, top.end) if (tag := self.nodes[k].tag) in PROSE or tag not in BLOCKS}

    def _bulk(self, recurring: set[int], wide: set[int]) -> set[int]:
        """What holds more than half of the words of an article, or, without one, of the page."""
        out = {k for top in self.tops for k in range(top.at, top.end) if 2 * self.words[k] > self.words[top.at]}
        if not self.tops:
            out |= {k for k in recurring - wide if 2 * self.words[k] > self.words[0]}
        return out

    def _beside_own(self, recurring: set[int]) -> set[int]:
        """Recurring pieces of text (no groups of blocks) beside text of the page's own,
        within one element: a passage of it, or a word that is set apart."""
        own = bytearray(len(self.nodes))
        out: set[int] = set()
        for n in reversed(self.nodes):
            pieces = [c.at for c in n.children if isinstance(c, Node) and c.tag not in GROUPS and not self.gone[c.at]]
            text = n.at not in recurring and any(isinstance(c, str) and not c.isspace() for c in n.children)
            if text or any(own[k] for k in pieces):
                out.update(k for k in pieces if k in recurring)
            own[n.at] = text or (n.at not in recurring and any(isinstance(c, Node) and own[c.at] for c in n.children))
        return out

    def _by_shape(self, template: dict[int, bool], recurring: set[int]) -> set[int]:
        shapes = {k: h for k, h in self.shapes().items() if template.get(h)}
        if not shapes:
            return set()
        novel = [0] * len(self.nodes)  # words that don't recur
        for n in reversed(self.nodes):
            if n.at not in recurring and not self.gone[n.at]:
                novel[n.at] = sum(novel[c.at] if isinstance(c, Node) else len(c.split()) for c in n.children)
        chain = [n for n in self.nodes if 2 * novel[n.at] > novel[0]]
        main = next((n for n in reversed(chain) if n.tag in GROUPS or n.tag in ("body", "html", "td")), self.nodes[0])
        mains = [*self.tops, main] if main.at not in self._ancestors() else self.tops
        like = {shapes.get(n.at) for n in [*chain, *mains]}
        headed = {n.at for n in self.nodes if n.tag == "h1"}
        out = set()
        for k, h in shapes.items():
            n = self.nodes[k]
            apart = all(n.end <= m.at or m.end <= k for m in mains)
            small = self.words[k] <= SMALL_PART * self.words[main.at] or 2 * self.linked[k] >= self.words[k]
            if apart and small and h not in like and headed.isdisjoint(range(k, n.end)):
                out.add(k)
        return out


def _digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=8).digest()


def _number(digest: bytes) -> int:
    return int.from_bytes(digest, "little", signed=True)


def extract(source: str | None, template: dict[int, bool] | None = None, prior: bool = True) -> str:
    """The main text: blocks in page order, two line ends between them."""
    return Page(source, prior).without(template or {})


def host_of(url: str | None) -> str:
    m = HOST.match(url or "")
    return m[1].lower() if m else ""


def _subtrees(page: Page) -> set[int]:
    """What is counted of a page."""
    known = page.hashes()
    return {known[k] for k in page.kept() if known[k]} | set(page.shapes().values())


def site_templates(pages: DataFrame, prior: bool = True) -> DataFrame:
    """host, hash, wide of every subtree that recurs on the host's pages, by content or,
    on half of them, by shape.

    Pages of a host with one main text count as one. A task passes on each
    (host, subtree, main text) once; a page itself has the subtree null. Null urls
    and such without a host are of the host ''."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()

        def out() -> pa.RecordBatch:
            kinds = pa.string(), pa.int64(), pa.int64(), pa.bool_()
            return pa.RecordBatch.from_arrays([pa.array([k[i] for k in seen], kind) for i, kind in enumerate(kinds)], ["host", "hash", "content", "shape"])

        for batch in batches:
            for url, source in zip(batch["url"].to_pylist(), batch["html"].to_pylist()):
                host, page = host_of(url), Page(source, prior)
                content, known = page.content(), page.hashes()
                seen.add((host, None, content, False))
                seen.update((host, known[k], content, False) for k in page.kept() if known[k])
                seen.update((host, h, content, True) for h in page.shapes().values())
                if len(seen) > 200_000:
                    yield out()
                    seen.clear()
        yield out()

    each = pages.select("url", "html").mapInArrow(found, "host string, hash long, content long, shape boolean").distinct()
    counts = C.saved(each.groupBy("host", "hash", "shape").agg(F.count("*").alias("n")).where(F.col("hash").isNull() | (F.col("n") >= MIN_PAGES)), "page_subtrees")
    size = counts.where(F.col("hash").isNull()).select("host", F.col("n").alias("pages"))
    share = F.least(F.col("pages") * MIN_SHARE, F.lit(float(MANY_PAGES)))
    half, many = F.col("n") >= F.col("pages") * WIDE_SHARE, F.col("n") >= MANY_PAGES
    return counts.where(F.col("hash").isNotNull()).join(size, "host").where(F.when(F.col("shape"), half).otherwise(F.col("n") >= share)).select("host", "hash", (half | many).alias("wide"))


def extract_pages(pages: DataFrame, prior: bool = True) -> DataFrame:
    """One row per row of ``pages`` (page_id, url, html): page_id, url, text, n_chars.

    Null, empty and text-less pages give an empty text. A page whose url is
    null or has no host is of the host ''. Repeated rows each get a row; they
    and other pages of the same main text count as one page of the host. No
    page gives no row; other columns are ignored. Without ``prior`` the lists of
    tags, roles and names delete nothing, and templates alone decide.

    Few templates are broadcast. Otherwise each page's own hashes are joined with them
    by host and hash, so that a page gets no more than it can use; pages are
    told apart by two hashes of address and source, and equal ones share.
    """
    spark = pages.sparkSession
    templates = C.saved(site_templates(pages, prior), "page_templates")
    kind = pages.schema["page_id"].dataType.simpleString()
    schema = f"page_id {kind}, url string, text string, n_chars long"

    def rows(batch: pa.RecordBatch, of) -> pa.RecordBatch:
        texts = [extract(h, of(k, u), prior) for k, (u, h) in enumerate(zip(batch["url"].to_pylist(), batch["html"].to_pylist()))]
        return pa.RecordBatch.from_arrays([batch["page_id"], batch["url"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    if templates.count() <= BROADCAST_HASHES:
        known: dict[str, dict] = {}
        for r in templates.collect():  # at most BROADCAST_HASHES
            known.setdefault(r["host"], {})[r["hash"]] = r["wide"]
        sent = spark.sparkContext.broadcast(known)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield rows(batch, lambda k, url: sent.value.get(host_of(url)))

        return pages.select("page_id", "url", "html").mapInArrow(run, schema)

    keyed = pages.select("page_id", "url", "html", F.xxhash64("url", "html").alias("a"), F.xxhash64(F.lit(1), "html", "url").alias("b"))

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, url, source in zip(*(batch[c].to_pylist() for c in ("a", "b", "url", "html"))):
                mine = list(_subtrees(Page(source, prior)))
                n = len(mine)
                yield pa.RecordBatch.from_arrays([pa.array([a] * n, pa.int64()), pa.array([b] * n, pa.int64()), pa.array([host_of(url)] * n, pa.string()), pa.array(mine, pa.int64())], ["a", "b", "host", "hash"])

    wanted = keyed.select("a", "b", "url", "html").mapInArrow(asked, "a long, b long, host string, hash long").distinct()
    own = wanted.join(templates, ["host", "hash"]).groupBy("a", "b").agg(F.collect_list(F.struct("hash", "wide")).alias("own"))  # a page's subtrees at most

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch["own"].to_pylist()
            yield rows(batch, lambda k, url: {x["hash"]: x["wide"] for x in lists[k] or ()})

    return keyed.join(own, ["a", "b"], "left").select("page_id", "url", "html", "own").mapInArrow(joined, schema)


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``extract_pages`` of all ``pages``."""
    return extract_pages(C.table(spark, sf_dir, "pages"))
