"""Main text of web pages by wrapper induction.

Pages of a host are parsed into trees and aligned with the host's template by simple tree matching: two nodes
match if their labels do, and the children of matching nodes are aligned in order so that most nodes match. Runs of
like siblings (items of a menu, paragraphs) are one node of the aligned tree. Every node of the template has the
number of its pages and of those with each text of its slot, counted exactly. Texts that most pages of the host have in the same slot are
template; slots whose texts vary are content. Two kinds of knowledge about a page's own labels complete
this: menus, adverts, forms and the like are no content though they vary, and an article element bounds
the content where there is one.

Templates are learnt in three steps: every task gives the distinct trees of its pages by host; those of a host, in the order of their
spelling, are aligned with each other in groups by a hash of the tree, then the groups' templates with each other. So a template does not depend on how pages are partitioned. A template has a size of its own, not of the number of
pages, so a host with a third of all pages is no larger a group than others. These templates are trees without
texts. The second pass joins them to pages by host (by broadcast if Spark finds them small, else by a join whose skewed hosts
are split) and aligns each page again; the pages of each slot and of each text in it are summed by host, slot and text, and texts of
half of the slot's pages or more, of which there are few, complete the template. The third pass joins these templates to pages in the same way.

Defined results: a null html or one without content gives an empty text. A null or unreadable url has the host "". A page alone on its host, or among
exact copies, has no varying slots: its labels decide. Repeated rows each give a row. An empty table
gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import html as entities
import json
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.runtime import ship, stored

SALT = 16
WIDE, DEEP = 64, 120
#: Pages of a slot that have a text that is template, at least, and their share.
LEAST_PAGES, LEAST_SHARE = 3, 0.5

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript iframe xmp template noembed noframes".split())
BLOCKS = frozenset("address article aside blockquote body br center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul caption".split())
INLINE = frozenset("a abbr b bdi bdo cite code data del dfn em font i ins kbd label mark q s samp small span strong sub sup time tt u var button".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What an opening tag ends, if that is open.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ENDS_P = BLOCKS - {"br", "td", "th", "tr", "body", "head", "html"}
SCOPES = frozenset("table ul ol dl article section div main body td".split())

NO_CONTENT = frozenset("nav footer aside form script style title noscript template button select iframe textarea dialog menu head svg canvas object".split())
NO_CONTENT_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar form".split())
NO_CONTENT_NAMES = frozenset(
    "ad ads adv advert advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe signup login share sharing social related recommended recommendations sidebar side menu nav navbar navigation breadcrumb breadcrumbs comment comments respond discussion replies disqus footer masthead toolbar widget pagination pager skip toc tags".split()
)
CONTENT_NAMES = frozenset("article content main post entry story".split())

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)([^"'>]*(?:"[^"]*"[^"'>]*|'[^']*'[^"'>]*)*)>""", re.S)
_LOOSE = re.compile(r"<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")


class Node:
    __slots__ = ("tag", "label", "kids", "drop", "content", "depth")

    def __init__(self, tag: str, label: str, depth: int, drop: bool = False, content: bool = False):
        self.tag, self.label, self.depth, self.drop, self.content = tag, label, depth, drop, content
        self.kids: list[Node | str] = []


@lru_cache(20_000)
def _labelled(tag: str, attributes: str) -> tuple[str, bool, bool]:
    """Label, whether its own names bar it from content, whether they make it content."""
    known = tag if tag in BLOCKS or tag in INLINE or tag in RAW or tag in VOID else "x"
    a = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)} if attributes.strip() else {}
    names = re.split(r"[\s_-]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", f"{a.get('class', '')} {a.get('id', '')}").lower().strip())
    role = a.get("role", "").lower()
    hidden = "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in a.get("style", "").replace(" ", "").lower()
    article = tag in ("article", "main") or role in ("main", "article")
    drop = hidden or tag in NO_CONTENT or role in NO_CONTENT_ROLES or not article and tag not in ("body", "html") and not NO_CONTENT_NAMES.isdisjoint(names)
    first = re.sub(r"\d+", "#", (a.get("class") or a.get("id") or "").split(" ")[0])[:40]
    return f"{known}.{first}" if first else known, drop, article


def parse(text: str) -> Node:
    """A tree of any text; never fails. What is nested deeper than DEEP hangs on its ancestor there."""
    root = Node("", "", 0)
    open_ = [root]
    at, n = 0, len(text)
    while at < n:
        lt = text.find("<", at)
        if lt < 0:
            open_[-1].kids.append(text[at:])
            break
        if lt > at:
            open_[-1].kids.append(text[at:lt])
        m = _TAG.match(text, lt) or _LOOSE.match(text, lt)
        if m is None:
            open_[-1].kids.append("<")
            at = lt + 1
            continue
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in BLOCKS or tag in INLINE or tag not in VOID:
                for k in range(len(open_) - 1, 0, -1):
                    if open_[k].tag == tag:
                        del open_[k:]
                        break
            continue
        if tag in ENDS_P:
            for k in range(len(open_) - 1, 0, -1):
                if open_[k].tag == "p":
                    del open_[k:]
                    break
                if open_[k].tag in BLOCKS:
                    break
        if tag in CLOSES:
            for k in range(len(open_) - 1, 0, -1):
                if open_[k].tag in CLOSES[tag]:
                    del open_[k:]
                    break
                if open_[k].tag in SCOPES - CLOSES[tag]:
                    break
        label, drop, content = _labelled(tag, m[3] or "")
        node = Node(tag, label, open_[-1].depth + 1, drop, content)
        open_[-1].kids.append(node)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(text, at)
            node.drop = True
            close = text.find(">", end.end() - 1) if end else -1
            at = close + 1 if close >= 0 else n
        elif tag not in VOID and not (m[3] or "").endswith("/") and node.depth < DEEP:
            open_.append(node)
    return root


class Slot:
    """A node of an aligned tree: label, pages that have it, pages of each text (by hash) and kids."""

    __slots__ = ("label", "pages", "texts", "kids", "own")

    def __init__(self, label: str, pages: int = 1):
        self.label, self.pages = label, pages
        self.texts: dict[int, int] = {}
        self.kids: list[Slot] = []
        self.own: list[tuple[int, object]] = []

    def dump(self) -> list:
        return [self.label, self.pages, list(self.texts.items()), [k.dump() for k in self.kids]]

    @classmethod
    def load(cls, x: list) -> Slot:
        s = cls(x[0], x[1])
        s.texts = {int(h): n for h, n in x[2]}
        s.kids = [cls.load(k) for k in x[3]]
        return s

    def count(self, texts: dict[int, int]) -> None:
        """Adds counts of texts."""
        for h, n in texts.items():
            self.texts[h] = self.texts.get(h, 0) + n

    def slots(self) -> Iterator[Slot]:
        """This and all below, each before its kids."""
        todo = [self]
        while todo:
            s = todo.pop()
            yield s
            todo += reversed(s.kids)


def _narrow(kids: list[Slot]) -> list[Slot]:
    """Runs of like siblings become one; where many kinds alternate, all of a kind do, and at last all of a tag."""
    out: list[Slot] = []
    for s in kids:
        if out and out[-1].label == s.label:
            _absorb(out[-1], s)
        else:
            out.append(s)
    for short in (False, True):
        if len(out) > WIDE:
            by: dict[str, Slot] = {}
            for s in out:
                s.label = s.label.split(".")[0] if short else s.label
                if s.label in by:
                    _absorb(by[s.label], s)
                else:
                    by[s.label] = s
            out = list(by.values())
    return out


def _absorb(a: Slot, b: Slot) -> None:
    a.pages = max(a.pages, b.pages)
    a.own += b.own
    a.count(b.texts)
    a.kids = _narrow(a.kids + b.kids)


def block_text(parts: list[str]) -> str:
    return " ".join(entities.unescape("".join(parts)).split())


class Block:
    __slots__ = ("text", "inside", "barred", "heading", "fixed", "named")

    def __init__(self, text: str, inside: bool, barred: bool, heading: bool, named: bool):
        self.text, self.inside, self.barred, self.heading, self.named, self.fixed = text, inside, barred, heading, named, False


def aligned_tree(root: Node) -> tuple[Slot, list[Block]]:
    """The tree to align, and the blocks of text in page order, hung on its slots."""
    blocks: list[Block] = []

    def walk(node: Node, inside: bool, barred: bool, named: bool, heading: bool) -> Slot:
        slot = Slot(node.label)
        inside = inside or node.content and not barred
        header = node.tag == "header"
        barred = barred or node.drop or header and not inside
        named = named or not CONTENT_NAMES.isdisjoint(re.split(r"[.\s_-]+", node.label))
        in_header = header and inside
        parts: list[str] = []

        def flush(of: Slot) -> None:
            text = block_text(parts) if parts else ""
            parts.clear()
            if text:
                b = Block(text, inside, barred or in_header and not heading, heading, named)
                blocks.append(b)
                of.own.append((zlib.crc32(text.encode("utf-8", "replace")), b))

        def inline(x: Node) -> None:
            for k in x.kids:
                if isinstance(k, str):
                    parts.append(k)
                elif k.drop or k.tag in BLOCKS or k.content:
                    block(k)
                else:
                    inline(k)

        def block(k: Node) -> None:
            flush(slot)
            if k.tag not in VOID:
                slot.kids.append(walk(k, inside, barred, named, heading or k.tag in HEADINGS))

        inline(node)
        flush(slot)
        slot.kids = _narrow(slot.kids)
        return slot

    top = walk(root, False, False, False, False)
    return top, blocks


def matching(a: Slot, b: Slot, memo: dict) -> tuple[int, list[tuple[int, int]]]:
    """Simple tree matching: size of the largest ordered match of two trees with like roots, and the kids paired."""
    key = (id(a), id(b))
    if key in memo:
        return memo[key]
    m, n = len(a.kids), len(b.kids)
    best = [[0] * (n + 1) for _ in range(m + 1)]
    w = [[0] * n for _ in range(m)]
    for i, x in enumerate(a.kids):
        row, above = best[i + 1], best[i]
        for j, y in enumerate(b.kids):
            if x.label == y.label:
                w[i][j] = matching(x, y, memo)[0]
            row[j + 1] = max(above[j + 1], row[j], above[j] + w[i][j])
    pairs, i, j = [], m, n
    while i and j:
        if w[i - 1][j - 1] and best[i][j] == best[i - 1][j - 1] + w[i - 1][j - 1]:
            i, j = i - 1, j - 1
            pairs.append((i, j))
        elif best[i][j] == best[i - 1][j]:
            i -= 1
        else:
            j -= 1
    memo[key] = (best[m][n] + 1, pairs[::-1])
    return memo[key]


def learn(template: Slot, other: Slot) -> None:
    """Aligns ``other`` (a page's tree or a template) with ``template`` and adds what it has."""
    memo: dict = {}
    todo = [(template, other)]
    while todo:
        a, b = todo.pop()
        _, pairs = matching(a, b, memo)
        a.pages += b.pages
        a.count(b.texts)
        matched, kids, at = dict((j, i) for i, j in pairs), [], 0
        for j, y in enumerate(b.kids):
            if j in matched:
                kids += a.kids[at : matched[j] + 1]
                at = matched[j] + 1
                todo.append((kids[-1], y))
            else:
                kids.append(y)
        a.kids = kids + a.kids[at:]
        if len(a.kids) > WIDE:
            while todo and todo[-1][0] in a.kids:  # finish these before kids move
                x, y = todo.pop()
                learn(x, y)
            a.kids = _narrow(a.kids)


def page_tree(text: str) -> tuple[Slot, list[Block]]:
    top, blocks = aligned_tree(parse(text))
    for s in top.slots():
        s.count({h: 1 for h, _ in s.own})
    return top, blocks


def aligned(template: Slot, page: Slot) -> Iterator[tuple[Slot, Slot]]:
    """Slots of the template and of the page that match."""
    memo: dict = {}
    todo = [(template, page)]
    while todo:
        a, b = todo.pop()
        yield a, b
        todo += [(a.kids[i], b.kids[j]) for i, j in matching(a, b, memo)[1]]


def mark_fixed(template: Slot, page: Slot) -> None:
    """Marks the blocks that most pages of the template have in the same slot."""
    for a, b in aligned(template, page):
        for h, block in b.own:
            n = a.texts.get(h, 0)
            block.fixed = n >= 5 and n >= 0.9 * a.pages if block.inside else n >= LEAST_PAGES and n >= LEAST_SHARE * a.pages


def main_text(text: str | None, template: Slot | None = None) -> str:
    if not text:
        return ""
    tree, blocks = aligned_tree(parse(text))
    if template is not None:
        mark_fixed(template, tree)
    open_ = [b for b in blocks if not b.barred]
    for group in ([b for b in open_ if b.inside], open_):
        # a page whose every block is fixed is one of many copies, not all template
        kept = [b for b in group if not b.fixed] or group
        if kept and not group[0].inside:
            named = [b for b in kept if b.named]
            kept = named if 2 * sum(len(b.text) for b in named) >= sum(len(b.text) for b in kept) else kept
        if kept:
            return " ".join(b.text for b in kept)
    return ""


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


_STATE = "host string, salt int, template string"


def _batch(rows: list[tuple[str, int, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows])], ["host", "salt", "template"])


def _learnt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct trees of the pages, without texts."""
    found: set[tuple[str, str]] = set()

    def dump() -> pa.RecordBatch:
        rows = [(h, zlib.crc32(raw.encode()) % SALT, raw) for h, raw in found]
        found.clear()
        return _batch(rows)

    for b in batches:
        for host, text in zip(b.column("host").to_pylist(), b.column("html")):
            text = text.as_py()
            if text:
                found.add((host, json.dumps(aligned_tree(parse(text))[0].dump())))
                if len(found) >= 2000:
                    yield dump()
    if found:
        yield dump()


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Templates in the order of hosts, salts and spelling to one template for each host and salt; like ones count once."""
    key, held, last = None, None, None
    for b in batches:
        for host, salt, raw in zip(*(c.to_pylist() for c in b.columns)):
            if (host, salt, raw) == last:
                continue
            last = host, salt, raw
            t = Slot.load(json.loads(raw))
            if (host, salt) == key:
                learn(held, t)
            else:
                if held is not None:
                    yield _batch([(*key, json.dumps(held.dump()))])
                key, held = (host, salt), t
    if held is not None:
        yield _batch([(*key, json.dumps(held.dump()))])


def shapes(pages: DataFrame) -> DataFrame:
    """Columns host and template (JSON, without texts), one row for each host."""
    parts = pages.select(host_of(F.col("url")).alias("host"), "html").mapInArrow(_learnt, _STATE)
    parts = parts.repartition("host", "salt").sortWithinPartitions("host", "salt", "template").mapInArrow(_united, _STATE)
    whole = parts.withColumn("salt", F.lit(0)).repartition("host").sortWithinPartitions("host", "template").mapInArrow(_united, _STATE)
    return stored(whole.select("host", "template"), "shapes")


_COUNTS = "host string, slot int, text long, n long"


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages of a batch in each slot of their host's template (text null) and with each text there."""
    for b in batches:
        sums: Counter = Counter()
        for host, text, raw in zip(b.column("host").to_pylist(), b.column("html"), b.column("template").to_pylist()):
            text = text.as_py()
            if text:
                template, place = _placed(raw)
                for slot, mine in aligned(template, aligned_tree(parse(text))[0]):
                    k = place[id(slot)]
                    sums[host, k, None] += 1
                    sums.update({(host, k, h) for h, _ in mine.own})
        if sums:
            hosts, slots, texts = zip(*sums)
            yield pa.RecordBatch.from_arrays([pa.array(hosts), pa.array(slots, pa.int32()), pa.array(texts, pa.int64()), pa.array(sums.values(), pa.int64())], ["host", "slot", "text", "n"])


def _completed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for raw, found in zip(b.column("template").to_pylist(), b.column("found").to_pylist()):
            template = Slot.load(json.loads(raw))
            slots = list(template.slots())
            for x in found or ():
                slots[x["slot"]].pages = x["pages"]
                slots[x["slot"]].texts[x["text"]] = x["n"]
            out.append(json.dumps(template.dump()))
        yield pa.RecordBatch.from_arrays([b.column("host"), pa.array(out, pa.string())], ["host", "template"])


def templates(pages: DataFrame) -> DataFrame:
    """Columns host and template (JSON), one row for each host; of the texts of a slot those of its pages' half or more."""
    ship(pages.sparkSession)
    bare = shapes(pages)
    own = pages.select(host_of(F.col("url")).alias("host"), "html").where("html <> ''")
    sums = own.join(bare, "host").select("host", "html", "template").mapInArrow(_counted, _COUNTS).groupBy("host", "slot", "text").agg(F.sum("n").alias("n"))
    sums = stored(sums.where(F.col("text").isNull() | (F.col("n") >= LEAST_PAGES)), "counts")
    of_slot = sums.where("text is null").select("host", "slot", F.col("n").alias("pages"))
    often = sums.where("text is not null").join(of_slot, ["host", "slot"]).where(F.col("n") >= LEAST_SHARE * F.col("pages"))
    found = often.groupBy("host").agg(F.collect_list(F.struct("slot", "text", "n", "pages")).alias("found"))
    return stored(bare.join(found, "host", "left").select("host", "template", "found").mapInArrow(_completed, "host string, template string"), "templates")


@lru_cache(256)
def _loaded(raw: str) -> Slot:
    return Slot.load(json.loads(raw))


@lru_cache(256)
def _placed(raw: str) -> tuple[Slot, dict[int, int]]:
    """A template and the place of each of its slots in their order."""
    template = Slot.load(json.loads(raw))
    return template, {id(s): k for k, s in enumerate(template.slots())}


_TEXT = "page_id long, url string, text string, n_chars long"


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [main_text(h.as_py(), _loaded(t) if t is not None else None) for h, t in zip(b.column("html"), b.column("template").to_pylist())]
        yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """One row for each page: page_id, url, text, n_chars."""
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host_of(F.col("url")).alias("host"))
    return own.join(templates(pages), "host", "left").select("page_id", "url", "html", "template").mapInArrow(_extracted, _TEXT)
