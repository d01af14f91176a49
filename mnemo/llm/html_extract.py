"""HTML extraction with site template removal.

A page is read into a tree of elements. Four things are deleted from it:

* elements whose kind says that they are no article text (menus, headers,
  footers, sidebars, notices, adverts, forms, scripts, styles, reader
  comments), by tag, role or the names in class and id (whole names, or
  names made only of such words and ``PARTS``);
* site templates: every block of every page, inside and outside the declared
  main content and of any kind, is hashed with its whole subtree, once
  exactly and, where most of its text is links, once without its text and
  with runs of equal children as one. The hashes are counted per host in
  Spark; subtrees that recur on at least ``MIN_PAGES`` and ``SHARE`` of the
  host's distinct pages are deleted;
* site chrome by its place: a block is named by the tags and class names from
  the root down to it, without its text. The container that holds most of the
  text on most of a host's pages is the host's core; blocks beside it and
  beside what is around it go if their names recur on the host as above, so
  menus, adverts, sidebars and footers are learnt from the site whatever they
  say and whatever they are called. What holds a first heading or declared
  main content stays;
* if the page declares its main content (``article``, ``main`` or the role),
  everything outside of it.

Not by its kind is deleted what holds most of the page's text (``MOST``; the
``SURE`` kinds: nearly all of it), nor, by a name, what holds main content. Main
content inside other deleted elements is kept if the element has no end tag, or
if the page has none elsewhere, except in asides and comments. Inside main
content, a name that may be an article's subject too (``SUBJECTS``) deletes
only what is mostly links.

Inside declared main content, passages that many articles share are text, not
template. There a recurring subtree goes only if it is mostly links or a box
(``BOXES``) of a kind, by tag and class, that no other block of the same main
content has; the same skeleton is enough only for boxes and lists of links
with a class. Where less than ``OWN`` of the text would be left, the page is
a copy of an article and keeps all. Exact copies of a page count as one page.

White space inside a block (line breaks too) becomes one space, blocks are
trimmed and joined in page order by a newline. Null and empty pages give an
empty text; a null url is a host of its own. Repeated rows are extracted one
by one; extra columns are ignored.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemo.llm.words import arrow
from mnemo.sources.snapshot import materialize

MIN_PAGES = 5       # distinct pages of the host that have the subtree
SHARE = 0.2         # ... and their share of the host's distinct pages
LINKS = 0.6         # share of link text from which the skeleton counts
MOST = 0.5          # share of the plain text above which an element is not deleted for its kind
NEARLY = 0.9        # ... for adverts, comments and cookie notices
OWN = 0.2           # share of its text that main content keeps, or nothing is deleted from it
CORE = 0.5          # share of a page's text that its core holds, and of the host's pages on which it does
MAINS = ("article", "main")
CORES = set("article main section div td center body".split())     # elements that can be a core

# Elements of HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style title textarea noscript iframe noembed noframes xmp".split())
BLOCK = set("""address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer
form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td
tfoot th thead title tr ul caption""".split())
ENDS_P = BLOCK - {"body", "html", "head", "option", "legend", "caption", "title"}
IMPLIED = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
           "option": {"option"}, "tbody": {"tbody", "thead", "tr", "td", "th"}, "tfoot": {"tbody", "thead", "tr", "td", "th"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"},
         "option": {"select"}, "tbody": {"table"}, "tfoot": {"table"}}
HEADERS = {"header", "site-header", "page-header"}     # names, outside main content
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
# Elements, roles and names that are not article text.
DROPPED_TAGS = set("""head title script style noscript template iframe object embed svg canvas annotation annotation-xml audio video map nav footer aside form
button select textarea input datalist dialog menu search noembed noframes xmp""".split())
DROPPED_ROLES = set("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
DROPPED_WORDS = set("""ad ads advert adverts advertisement advertising sponsor sponsored promo promotion nav navbar navigation menu
breadcrumb breadcrumbs sidebar footer cookie cookies consent gdpr notice notices popup modal newsletter subscribe comment comments
commentlist disqus replies share sharing social related recommended pagination pager masthead login signup subscription widget
banner alert notification aside topbar toolbar topnav sidenav subnav navlinks sidemenu adbox adslot adsbygoogle""".split())

PARTS = set("""reader user site top bottom left right primary secondary main area box block bar list link links button buttons icon
icons slot unit items form container wrapper sticky mobile""".split())
# Of these, the ones that rule out an article element too; adverts, comments and cookie notices; and
# those that may be what an article or a part of it is about.
ARTICLE_WORDS = set("ad ads advert advertisement sponsored comment comments sidebar related recommended cookie cookies".split())
SURE = set("ad ads advert adverts advertisement comment comments commentlist disqus replies cookie cookies adbox adslot adsbygoogle".split())
SUBJECTS = set("""sponsor promo promotion nav navigation menu notice notices share sharing social related recommended login
subscription widget banner alert notification consent gdpr""".split())
# Tags whose end tag tells whether they hold what follows.
CLOSED = set("nav footer button select datalist".split())
ASIDES = set("aside dialog complementary alertdialog".split())

# Never text, so not hashed; and what may be a box inside main content.
NO_TEXT = set("head title script style noscript template iframe object embed svg canvas audio video map textarea noembed noframes xmp".split())
BOXES = set("div section details fieldset center address".split())
# What goes by its place; headings, paragraphs, figures and the like stay.
BESIDE = BOXES | set("nav header footer aside menu ul ol form dialog search".split())

_TOKEN = re.compile(r"<(?:(!--)|[!?]|(/?)([a-zA-Z][^\s/>]*))")
_STOP = re.compile("[>\"']")
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.S)
_PART = re.compile(r"[-_]+")


def _kinds(names: frozenset, words: set) -> set:
    """The words of a kind that a class or id says: as the whole name, or as
    a name of nothing but such words, parts and numbers."""
    found = set(names & words)
    for name in names - found:
        parts = [x for x in _PART.split(name) if x]
        mine = {x for x in parts if x in words}
        if mine and all(x in words or x in PARTS or x.isdigit() for x in parts):
            found |= mine
    return found


class Element:
    __slots__ = ("tag", "role", "words", "children", "dropped", "main", "exact", "shape", "size", "links", "kind", "ended", "heads", "path")

    def __init__(self, tag: str, attributes: str = ""):
        self.tag = tag
        self.children: list = []
        self.role, names = "", ""
        if attributes:
            found = {m[0].lower(): m[1] or m[2] or m[3] for m in _ATTRIBUTE.findall(attributes)}
            self.role = found.get("role", "").strip().lower()
            names = f"{found.get('class', '')} {found.get('id', '')}".lower()
        self.words = frozenset(names.split())
        self.main = tag in MAINS or bool(self.role) and self.role in MAINS
        self.ended = False
        self.heads = tag == "header" or not HEADERS.isdisjoint(self.words)
        # why it is no text: its tag, its role, or the words that its names say
        self.kind: str | set = ""
        if tag not in ("html", "body"):
            self.kind = ("tag" if tag in DROPPED_TAGS else "role" if self.role in DROPPED_ROLES
                         else _kinds(self.words, ARTICLE_WORDS if self.main else DROPPED_WORDS) if self.words else "")
        self.dropped = bool(self.kind)
        if self.dropped:
            self.main = False


class _Ends:
    """Where tags end; every part of the page is looked at a few times at most."""

    def __init__(self, page: str):
        self.page = page
        self.last = page.rfind(">")
        self.dead: set[int] = set()     # quotes from which no end is found

    def __call__(self, at: int, quoted: bool) -> int:
        """The place of the ``>`` that ends the tag, -1 if nothing does.
        With ``quoted``, values in quotes may hold one."""
        if at > self.last:
            return -1
        if not quoted:
            return self.page.find(">", at)
        met = []
        while True:
            m = _STOP.search(self.page, at)
            if m is None or m.start() in self.dead:
                break
            if m[0] == ">":
                return m.start()
            met.append(m.start())
            at = self.page.find(m[0], m.end()) + 1
            if not at:
                break
        self.dead.update(met)
        return -1


class _Open:
    """The open elements, with the places of each tag among them."""

    def __init__(self, root: Element):
        self.stack = [root]
        self.places: dict[str, list[int]] = {}
        self.blocks = [0]       # places of blocks that no inline end tag closes

    def push(self, e: Element) -> None:
        self.places.setdefault(e.tag, []).append(len(self.stack))
        if e.tag in BLOCK and e.tag != "p":
            self.blocks.append(len(self.stack))
        self.stack.append(e)

    def cut(self, k: int) -> None:
        """Close the elements from place k on."""
        for e in self.stack[k:]:
            self.places[e.tag].pop()
        while self.blocks[-1] >= k:
            self.blocks.pop()
        del self.stack[k:]

    def nearest(self, tags) -> int:
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def imply(self, tags: set, scope: set | None) -> None:
        """Close the nearest open elements of ``tags`` inside the scope
        (None: any block)."""
        while True:
            k = self.nearest(tags)
            if not k or k <= (self.blocks[-1] if scope is None else self.nearest(scope)):
                return
            self.cut(k)
            if not (tags & {"td", "th"} and "tr" in tags):
                return

    def close(self, tag: str) -> None:
        """An end tag; without an open element it is ignored, and inline
        elements and paragraphs do not close the block around them."""
        k = self.nearest((tag,))
        if k and (k > self.blocks[-1] or tag in BLOCK and tag != "p"):
            self.stack[k].ended = True
            self.cut(k)


def parse(page: str) -> Element:
    """The element tree of a page; never fails, whatever the markup, and
    takes time in proportion to the page."""
    root = Element("html")
    open_, ends = _Open(root), _Ends(page)
    at, size, raw_gone = 0, len(page), set()
    while at < size:
        m = _TOKEN.search(page, at)
        if m is None:
            open_.stack[-1].children.append(page[at:])
            break
        if m.start() > at:
            open_.stack[-1].children.append(page[at: m.start()])
        if m[1]:
            at = page.find("-->", m.end())
            at = at + 3 if at >= 0 else size
            continue
        end = ends(m.end(), m[3] is not None and not m[2])
        if end < 0:     # no tag: the sign is text
            open_.stack[-1].children.append("<")
            at = m.start() + 1
            continue
        at, tag = end + 1, (m[3] or "").lower()
        if not tag:
            continue
        if m[2]:
            open_.close(tag)
            continue
        attributes = page[m.end(): end]
        if tag in ("html", "body") and not attributes.strip():
            continue
        if tag in ENDS_P:
            open_.imply({"p"}, None)
        if tag in IMPLIED:
            open_.imply(IMPLIED[tag], SCOPE[tag])
        element = Element(tag, attributes)
        open_.stack[-1].children.append(element)
        if tag in RAW:
            found = None if tag in raw_gone else re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            if found is None:
                raw_gone.add(tag)
            element.children.append(page[at: found.start() if found else size])
            at = found.end() if found else size
        elif tag not in VOID and not (attributes.endswith("/") and tag in ("svg", "math", "path")):
            open_.push(element)
    return root


def _plain(root: Element) -> dict[int, tuple[int, int]]:
    """(characters outside links, all characters) of every element below ``root``."""
    order, todo = [], [root]
    while todo:
        e = todo.pop()
        order.append(e)
        todo.extend(c for c in e.children if isinstance(c, Element) and c.tag not in NO_TEXT)
    size: dict[int, tuple[int, int]] = {}
    for e in reversed(order):
        plain = every = 0
        for c in e.children:
            p, n = size.get(id(c), (0, 0)) if isinstance(c, Element) else (len("".join(c.split())),) * 2
            plain, every = plain + p, every + n
        size[id(e)] = 0 if e.tag == "a" else plain, every
    return size


def _keep_most(top: Element, plain: dict) -> bool:
    """Keep what only its kind deletes but holds most of the text of ``top``."""
    changed = False
    todo = [c for c in top.children if isinstance(c, Element)]
    while todo:
        e = todo.pop()
        if e.tag in NO_TEXT:
            continue
        if e.dropped and e.kind != "place" and not (e.tag in CLOSED and e.ended):
            sure = isinstance(e.kind, set) and e.kind <= SURE
            if plain[id(e)][0] > (NEARLY if sure else MOST) * plain[id(top)][0]:
                e.dropped, changed = False, True
        if not e.dropped:
            todo.extend(c for c in e.children if isinstance(c, Element))
    return changed


def _mains(root: Element) -> tuple[list[Element], list[Element]]:
    """Main content in page order: (seen, inside closed elements whose tag or
    role is no text). A name alone, or a tag that is not closed, hides none."""
    found: list[Element] = []
    hidden: list[Element] = []
    todo = [(root, "")]
    while todo:
        e, state = todo.pop()
        if e.main:
            if state != "own":
                (hidden if state else found).append(e)
            continue
        if e.dropped:
            named = isinstance(e.kind, set)
            if e.tag in NO_TEXT or named and e.kind & ARTICLE_WORDS or e.ended and (e.tag in ASIDES or e.role in ASIDES):
                state = "own"
            elif e.ended and not named:
                state = state or "closed"
        todo.extend((c, state) for c in reversed(e.children) if isinstance(c, Element))
    return found, hidden


def _prune(root: Element) -> list[Element]:
    """The elements to take text from: declared main content, or none for the
    whole page. Says of every element whether it is dropped."""
    mains, hidden = _mains(root)
    plain = {} if mains else _plain(root)
    if not mains and _keep_most(root, plain):
        mains, hidden = _mains(root)
    mains = mains or hidden
    for top in mains or [root]:
        inside = [e for e in _below(top, kinds=True) if e.dropped or e.heads]
        if inside:
            plain = plain or _plain(root)
        for e in inside:
            p, n = plain[id(e)]
            if mains and isinstance(e.kind, set) and e.kind <= SUBJECTS and 2 * p > n and e.tag not in MAINS:
                e.dropped = False
            # nor is a header that was not closed, or holds the text
            if e.heads and (not e.ended or mains and e.tag != "header" or p > NEARLY * plain[id(top)][0]):
                e.heads = False
        if mains and inside:
            _keep_most(top, plain)
    return mains


def _hash(*parts: str) -> int:
    return xxhash.xxh64_intdigest("\x1f".join(parts).encode("utf-8", "surrogatepass")) - (1 << 63)


def _sign(root: Element) -> list[Element]:
    """Hash all subtrees below ``root``, of dropped elements too; returns the
    blocks with text that are not and hold no main content, from the top down.
    A subtree is hashed without the elements of a dropped kind inside it."""
    order, todo = [], [root]
    while todo:
        e = todo.pop()
        order.append(e)
        todo.extend(c for c in e.children if isinstance(c, Element) and c.tag not in NO_TEXT)
    holds: set[int] = set()
    for e in reversed(order):
        size, linked, parts, shapes = 0, 0, [e.tag, *sorted(e.words)], [e.tag, *sorted(e.words)]
        for c in e.children:
            if isinstance(c, str):
                c = " ".join(html.unescape(c).split())
                size += len(c)
                if c:
                    parts.append(c)
            elif c.tag not in NO_TEXT:
                if c.main or id(c) in holds:
                    holds.add(id(e))
                if not c.kind:
                    size, linked = size + c.size, linked + c.links
                    parts.append(str(c.exact))
                    if shapes[-1] != str(c.shape):
                        shapes.append(str(c.shape))
        e.size, e.links = size, size if e.tag == "a" else linked
        e.exact, e.shape = _hash("exact", *parts), _hash("shape", *shapes)
    out = []
    for e in order:
        if e.size and e is not root and e.tag in BLOCK and e.tag not in ("body", "html") and not e.main and id(e) not in holds:
            out.append(e)
            if e.links < LINKS * e.size:
                e.shape = e.exact
    return out


def _name(root: Element) -> None:
    """Give every element that may have text the hash of its place: tags and
    names from the root down."""
    root.path = 0
    todo = [root]
    while todo:
        e = todo.pop()
        for c in e.children:
            if isinstance(c, Element) and c.tag not in NO_TEXT:
                c.path = _hash("place", str(e.path), c.tag, *sorted(c.words))
                todo.append(c)


def _core(root: Element) -> Element | None:
    """The deepest container with most of the text outside links."""
    plain = _plain(root)
    e, core = root, None
    while True:
        inside = [c for c in e.children if isinstance(c, Element) and plain.get(id(c), (0, 0))[0] > CORE * plain[id(root)][0]]
        if not inside:
            return core
        e = inside[0]
        if e.tag in CORES:
            core = e


def places(root: Element) -> tuple[set[int], int | None]:
    """(places of the blocks, place of the core) of a page."""
    _name(root)
    core = _core(root)
    blocks = {e.path for e in _below(root, kinds=True) if e.tag in BLOCK}
    return blocks, core.path if core is not None else None


def _chrome(root: Element, templates: set[int]) -> list[Element]:
    """The blocks beside the host's core, and beside what is around it, whose
    places recur on the host."""
    _name(root)
    around: dict[int, Element] = {}
    core, todo = None, [root]
    while todo and core is None:
        e = todo.pop()
        for c in reversed(e.children):
            if isinstance(c, Element) and c.tag not in NO_TEXT:
                around[id(c)] = e
                todo.append(c)
        if e is not root and e.tag in CORES and _hash("core", str(e.path)) in templates and getattr(e, "exact", None) not in templates:
            core = e
    out = []
    while core is not None and core is not root:
        parent = around[id(core)]
        for c in parent.children:
            if (isinstance(c, Element) and c is not core and c.tag in BESIDE and not c.main
                    and _hash("block", str(c.path)) in templates
                    and not any(x.main or x.tag == "h1" for x in [c, *_below(c, kinds=True)])):
                out.append(c)
        core = parent
    return out


def subtrees(page: str) -> tuple[int, list[int], list[int]]:
    """(hash of the whole page, hashes of its subtrees and block places that
    may be template, hash of its core's place)."""
    root = parse(page)
    found = {h for e in _sign(root) for h in (e.exact, e.shape)}
    blocks, core = places(root)
    found |= {_hash("block", str(p)) for p in blocks}
    return _hash("page", page), sorted(found), [_hash("core", str(core))] if core is not None else []


def _below(top: Element, kinds: bool = False) -> list[Element]:
    """The elements inside ``top`` that are not dropped (or with ``kinds``
    all that may have text), from the top down."""
    order, todo = [], [top]
    while todo:
        e = todo.pop()
        order.append(e)
        todo.extend(c for c in reversed(e.children) if isinstance(c, Element) and (
            c.tag not in NO_TEXT if kinds else not c.dropped))
    return order[1:]


def _length(top: Element) -> int:
    """Characters of text inside ``top`` that are not dropped."""
    return sum(len("".join(c.split())) for e in [top, *_below(top)] for c in e.children if isinstance(c, str))


def _templates(blocks: list[Element], mains: list[Element], templates: set[int]) -> list[Element]:
    """The blocks of a page that go as template: all that recur, or inside
    declared main content those that are no passage of it."""
    if not mains:
        return [e for e in blocks if e.exact in templates or e.shape in templates]
    may = {id(e) for e in blocks}
    out = []
    for top in mains:
        inside = [e for e in _below(top) if id(e) in may]
        kinds = {(e.tag, e.words) for e in inside if e.exact not in templates and e.shape not in templates}
        gone, covered = [], set()
        for e in inside:
            linked = e.links >= LINKS * e.size
            if id(e) not in covered and (
                    e.exact in templates and (linked or e.tag in BOXES and (e.tag, e.words) not in kinds)
                    or e.shape in templates and linked and e.words and (e.tag in BOXES or e.tag in ("ul", "ol"))):
                gone.append(e)
                covered.update(map(id, _below(e)))
        lost = sum(map(_length, gone))
        if gone and _length(top) - lost >= OWN * _length(top):
            out += gone
    return out


def extract(page: str | None, templates: set[int] | None = None) -> str:
    """The main text of one page without the given template subtrees."""
    if not page:
        return ""
    root = parse(page)
    signed = _sign(root) if templates else []
    for e in _chrome(root, templates) if templates else ():
        e.dropped, e.kind = True, e.kind or "place"
    mains = _prune(root)
    for e in _templates(signed, mains, templates) if templates else ():
        e.dropped = True
    blocks: list[str] = []
    line: list[str] = []

    def flush() -> None:
        text = " ".join(html.unescape("".join(line)).split())
        line.clear()
        if text:
            blocks.append(text)

    for top in mains or [root]:
        # (element or text, only headings are wanted, leave)
        todo: list = [(c, False, False) for c in reversed(top.children)]
        while todo:
            c, heads, leave = todo.pop()
            if leave:
                flush()
            elif isinstance(c, str):
                if not heads:
                    line.append(c)
            elif c.dropped:
                if c.tag in BLOCK:
                    flush()
            elif c.tag == "br":
                line.append(" ")
            else:
                heads = (heads or c.heads) and c.tag not in HEADINGS
                if c.tag in BLOCK:
                    flush()
                    todo.append((c, heads, True))
                todo.extend((x, heads, False) for x in reversed(c.children))
        flush()
    return "\n".join(blocks)


def extract_pages(pages: DataFrame, min_pages: int = MIN_PAGES, share: float = SHARE) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    arrow(pages.sparkSession)
    spark = pages.sparkSession
    keyed = pages.select(
        "page_id", "url", "html", F.coalesce(F.lower(F.regexp_extract(F.col("url"), r"^[A-Za-z][\w+.\-]*://([^/?#]*)", 1)), F.lit("")).alias("host"))

    def sign(batches):
        for b in batches:
            hosts, whole, hashes, votes = [], [], [], []
            for host, page in zip(b.column("host").to_pylist(), b.column("html").to_pylist()):
                body, found, core = subtrees(page or "")
                for h in [body, *found, *core]:
                    hosts.append(host)
                    whole.append(body)
                    hashes.append(h)
                votes += [False] * (1 + len(found)) + [True] * len(core)
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(whole, pa.int64()), pa.array(hashes, pa.int64()), pa.array(votes, pa.bool_())],
                                             ["host", "page", "hash", "core"])

    # written first: pages are signed once
    found = materialize(spark, keyed.select("host", "html").mapInArrow(sign, "host string, page long, hash long, core boolean"), "subtrees")
    # one row per page and subtree; copies of a page fall together
    once = found.distinct()
    total = materialize(spark, once.where("page = hash").groupBy("host").agg(F.count("*").alias("pages")), "host-pages")
    least = F.when(F.col("core"), F.lit(CORE)).otherwise(F.lit(share)) * F.col("pages")
    common = (once.where("page <> hash").groupBy("host", "hash", "core").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
              .join(total, "host").where(F.col("n") >= least))
    # one row per host, of at most 1 / share times the subtrees of its average
    # page; written, so that the planner knows its size and, where it is
    # small, sends it to the pages instead of shuffling the pages to meet it
    listed = materialize(spark, common.groupBy("host").agg(F.collect_set("hash").alias("templates")), "templates")

    def text(batches):
        for b in batches:
            out = [extract(page, set(t) if t else None) for page, t in zip(b.column("html").to_pylist(), b.column("templates").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(out, pa.string())], ["page_id", "url", "text"])

    joined = keyed.join(listed, "host", "left").select("page_id", "url", "html", "templates")
    schema = pages.select("page_id", "url").schema.add("text", "string")
    return joined.mapInArrow(text, schema).withColumn("n_chars", F.char_length("text").cast("long"))
