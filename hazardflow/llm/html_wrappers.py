"""Main text of web pages through wrappers that are inferred per host.

A wrapper is a union-free regular expression over nested tokens: tags and text slots, each with a quantifier. It starts as
the token stream of one page, in which adjacent equal elements, or sequences of elements, become repeated groups. Aligning it
with the next stream of the same host turns tokens that only one side has into optional ones, tokens that repeat on one
side into repeated groups, and differing texts into variable slots. Aligning is a pairwise merge, so it runs inside tasks first,
then in salted parts of a host, then per host; a task holds a wrapper, never the pages of a host.

A page is read along its host's wrapper. Tags and class words hint at the slots of the article: inside landmarks, if the wrapper has
any, and outside of menus, footers and the like. Of these slots those count whose text varies: a text that stands in a slot on all
its pages is furniture and is left out, inside a landmark if the slot is not optional there. In a repeated slot each text is
judged by itself.
"""

from __future__ import annotations

import functools
import html
import json
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from hazardflow.llm.storage import stored

# Element names of the HTML standard, and the usual names of page furniture.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style noscript template svg iframe textarea object canvas math select".split())
BLOCKS = frozenset(
    "address article aside blockquote body br center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split()
)
CLOSES = {  # an opening tag ends these elements, up to one of the second set
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}),
    "option": ({"option"}, {"select"}),
}
SCOPES = frozenset("article aside body button div fieldset figure footer form header html li main nav section table td th".split())
FURNITURE = frozenset("nav footer aside form button dialog head title menu".split())
HINTS = frozenset(
    "ad ads adv advert adverts advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr "
    "hidden login menu modal nav navbar navigation newsletter notice pager pagination popup promo promoted recommended related "
    "replies respond share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
COMMENT_HINTS = frozenset("comment comments replies respond".split())
# Words that may stand beside a hint in one name without changing what it says.
GENERIC = frozenset(
    "area bar block bottom box button buttons container content form group header holder icon icons inline inner item items left link "
    "links list main outer panel post posts right row section side site slot space text title top unit wrap wrapper zone".split()
)
# Inside an article these words say furniture only of what is links for the larger part.
WEAK_HINTS = frozenset("recommended related share sharing social widget".split())
# Headings and labels of an article may be the same on all pages of a host.
LABELS = frozenset("h1 h2 h3 h4 h5 h6 th td dt dd li caption figcaption summary".split())
MAIN_HINTS = frozenset("article content entry main post story".split())
# Levels of a wrapper. Deeper elements have no slots; tags and class words alone decide on them.
MAX_DEPTH = 64
PARTS = 16
HELD_HOSTS = 2_000
# A text that stands in a slot on so many different pages or more, and is missing on none that has the slot, is furniture.
SAME_TEXT_PAGES = 3

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<![^>]*>?|<\?[^>]*>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>?",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)


class Element:
    __slots__ = ("tag", "names", "hints", "weak", "children")

    def __init__(self, tag: str, attributes: str = ""):
        self.tag, self.children = tag, []
        self.names, self.hints, self.weak = _names(attributes)

    @property
    def label(self) -> str:
        return " ".join([self.tag, *self.names])


def _names(attributes: str) -> tuple[tuple[str, ...], frozenset[str], bool]:
    """Words of class, id and role, without numbers, in order and once each; those that hint at furniture; and whether all
    of these are weak.

    A name hints by all its words: ``share-box`` does, ``share-theory`` does not, and ``share`` alone is weak.
    """
    if "=" not in attributes:
        return (), frozenset(), False
    names = [n for m in _ATTRIBUTE.finditer(attributes) for n in html.unescape(m[2] or m[3] or m[4] or "").lower().split()]
    words = [[w for w in re.split(r"[^a-z]+", n) if w] for n in names]
    hinting = [own for own in words if all(w in HINTS or w in GENERIC for w in own) and not HINTS.isdisjoint(own)]
    weak = all(len(own) == 1 and own[0] in WEAK_HINTS for own in hinting)
    return tuple(dict.fromkeys(w for own in words for w in own)), frozenset(w for own in hinting for w in own if w in HINTS), weak


def parse(page: str) -> Element:
    """The page as nested elements and texts. Tags that are missing or out of place are closed as browsers do."""
    root = Element("#page")
    stack = [root]
    opened: Counter[str] = Counter()

    def close(names: set[str] | frozenset[str], until: set[str] | frozenset[str]) -> None:
        if not any(opened[name] for name in names):
            return
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in names:
                opened.subtract(e.tag for e in stack[i:])
                del stack[i:]
                return
            if stack[i].tag in until:
                return

    at = 0
    while at < len(page):
        found = _TOKEN.search(page, at)
        begin = found.start() if found else len(page)
        if begin > at:
            stack[-1].children.append(page[at:begin])
        if not found:
            break
        at = found.end()
        tag = (found[2] or found[5] or "").lower()
        if not tag:
            continue
        if found[1] or found[4]:
            close({tag}, frozenset())
            continue
        if tag in CLOSES:
            close(*CLOSES[tag])
        if tag in BLOCKS and tag != "br":
            close({"p"}, SCOPES)
        element = Element(tag, found[3] or found[6] or "")
        stack[-1].children.append(element)
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*[^>]*>?", re.IGNORECASE).search(page, at)
            at = end.end() if end else len(page)
        elif tag not in VOID and not (found[3] or "").rstrip().endswith("/"):
            stack.append(element)
            opened[tag] += 1
    return root


# A wrapper node: [label, least number, repeated, texts on all its pages, the least marks of its pages, children].
TEXT = "#text"


def tokens(element: Element) -> Iterator[Element | tuple[str, bool]]:
    """Content as structure: elements, and runs of text with whether they stand between borders of blocks.

    Inline tags and scripts are no structure.
    """
    block = element.tag in BLOCKS or element.tag == "#page"
    pieces, edge = [], block
    todo = [iter(element.children)]
    while todo:
        item = next(todo[-1], None)
        if item is None:
            todo.pop()
        elif isinstance(item, str):
            pieces.append(item)
        elif item.tag in BLOCKS or item.names or item.tag in FURNITURE:
            if pieces:
                yield "".join(pieces), edge and item.tag in BLOCKS
                pieces = []
            edge = item.tag in BLOCKS
            yield item
        elif item.tag not in RAW:
            todo.append(iter(item.children))
    if pieces:
        yield "".join(pieces), edge and block


def _digest(text: str, whole: bool) -> int:
    """A number of the text; that of a run which is only a part of its block is negative."""
    number = hash_of(" ".join(html.unescape(text).split()))
    return number if whole else -1 - number


def hash_of(text: str) -> int:
    data = text.encode("utf-8", "surrogatepass")
    return zlib.crc32(data) << 32 | zlib.adler32(data)


def skeleton(element: Element, depth: int = 0, pages: list | None = None, seen: list | None = None) -> list:
    """The wrapper of one page: its tokens with repeated groups folded. All its nodes share one list of pages."""
    top = pages is None
    pages, seen = ([], []) if top else (pages, seen)
    seen.append(element.label)
    children: list[list] = []
    for item in tokens(element) if depth < MAX_DEPTH else ():
        if isinstance(item, Element):
            if item.tag != "br":
                children.append(skeleton(item, depth + 1, pages, seen))
        elif not item[0].isspace():
            number = _digest(*item)
            seen.append(str(number))
            children.append([TEXT, 1, False, {number}, pages, []])
    seen.append("/")
    if top:
        pages.append(hash_of("\n".join(seen)))
    return [element.label, 1, False, (), pages, fold(children)]


def joined(a: list, b: list) -> list:
    """The least marks of the pages of two nodes: enough to know whether there are ``SAME_TEXT_PAGES`` different ones."""
    return a if a is b else sorted({*a, *b})[:SAME_TEXT_PAGES]


def _common(a: list, b: list) -> set | tuple:
    """Texts that stand on all pages of two nodes with one label. On one page all texts of a repeated slot do; a part of a block
    only if the others are equal to it."""
    if a[0] != TEXT:
        return ()
    if a[4] is not b[4]:
        return {*a[3]} & {*b[3]}
    if a[3] != b[3]:
        if len(a[3]) == 1 and min(a[3]) < 0:
            a[3].clear()
        a[3].update(t for t in b[3] if t >= 0)
    return a[3]


def merge(a: list, b: list, pages: list) -> list:
    """Two nodes with one label as one. Nodes of one page may be changed."""
    return [a[0], min(a[1], b[1]), a[2] or b[2], _common(a, b), pages, align(a[5], b[5])]


def fold(nodes: list[list]) -> list[list]:
    """Adjacent repeats on one page, of one node or of two or three, become one repeated node."""
    out: list[list] = []
    for node in nodes:
        if out and out[-1][0] == node[0]:
            out[-1] = merge(out[-1], node, node[4])
            out[-1][2] = True
        else:
            out.append(node)
    for size in (2, 3):
        i = 0
        while i + 2 * size <= len(out):
            labels = [n[0] for n in out[i : i + size]]
            if labels != [n[0] for n in out[i + size : i + 2 * size]]:
                i += 1
                continue
            body = out[i : i + size]
            j = i + size
            while [n[0] for n in out[j : j + size]] == labels:
                body = [merge(a, b, b[4]) for a, b in zip(body, out[j : j + size])]
                j += size
            out[i:j] = [[_group(labels), 1, True, (), body[0][4], body]]
            i += 1
    return out


def _group(labels: list[str]) -> str:
    return "(" + "|".join(labels) + ")"


def _regrouped(nodes: list[list], others: list[list]) -> list[list]:
    """A sequence that is a repeated group on the other side becomes that group."""
    for other in others:
        if other[0].startswith("(") and not any(n[0] == other[0] for n in nodes):
            labels = [n[0] for n in other[5]]
            for i in range(len(nodes) - len(labels) + 1):
                if [n[0] for n in nodes[i : i + len(labels)]] == labels:
                    body = nodes[i : i + len(labels)]
                    nodes = [*nodes[:i], [other[0], 1, False, (), body[0][4], body], *nodes[i + len(labels) :]]
                    break
    return nodes


def _optional(node: list) -> list:
    return [node[0], 0, *node[2:]]


def align(left: list[list], right: list[list]) -> list[list]:
    """Longest common subsequence of labels; what only one side has becomes optional."""
    if [n[0] for n in left] != [n[0] for n in right]:
        left, right = _regrouped(left, right), _regrouped(right, left)
    if [n[0] for n in left] == [n[0] for n in right]:
        return [merge(a, b, joined(a[4], b[4])) for a, b in zip(left, right)]
    rows = [[0] * (len(right) + 1)]
    for a in reversed(left):
        below, row = rows[-1], [0] * (len(right) + 1)
        for j in range(len(right) - 1, -1, -1):
            row[j] = below[j + 1] + 1 if a[0] == right[j][0] else max(below[j], row[j + 1])
        rows.append(row)
    rows.reverse()
    out, i, j = [], 0, 0
    while i < len(left) or j < len(right):
        if i < len(left) and j < len(right) and left[i][0] == right[j][0]:
            out.append(merge(left[i], right[j], joined(left[i][4], right[j][4])))
            i, j = i + 1, j + 1
        elif j == len(right) or (i < len(left) and rows[i + 1][j] >= rows[i][j + 1]):
            out.append(_optional(left[i]))
            i += 1
        else:
            out.append(_optional(right[j]))
            j += 1
    return refold(out)


def refold(nodes: list[list]) -> list[list]:
    """Optional neighbours with one label are one repeated, optional node."""
    out: list[list] = []
    for node in nodes:
        if out and out[-1][0] == node[0]:
            least = out[-1][1] + node[1]
            out[-1] = merge(out[-1], node, joined(out[-1][4], node[4]))
            out[-1][1:3] = [min(1, least), True]
        else:
            out.append(node)
    return out


def expression(node: list, many: bool = False) -> str:
    """A wrapper as text, for people: ``?`` optional, ``+`` and ``*`` repeated, ``#text`` a slot, ``#same`` a constant text."""
    label, least, repeated, texts, _, children = node
    sign = ("+" if least else "*") if repeated else ("" if least else "?")
    many = many or repeated
    if label == TEXT:
        return ("#same" if texts and not many else "#text") + sign
    inner = " ".join(expression(c, many) for c in children)
    return (f"({inner}){sign}" if label.startswith("(") else f"<{label}>{inner}</>" if not sign else f"(<{label}>{inner}</>){sign}")


def _furniture(tag: str, hints: Iterable[str], inside: bool) -> bool:
    if tag in ("html", "body", "main"):
        return False
    hinted = not (COMMENT_HINTS if tag == "article" else HINTS).isdisjoint(hints)
    return tag in FURNITURE or tag in RAW or hinted or (tag == "header" and not inside)


def _mostly_links(element: Element) -> bool:
    """Whether at least half of the element's letters stand in links or buttons, or it has a word or two only."""
    linked = total = words = 0
    todo = [(element, False)]
    while todo:
        item, link = todo.pop()
        for c in item.children:
            if isinstance(c, str):
                size = sum(map(len, c.split()))
                words += len(c.split())
                total += size
                linked += size if link else 0
            elif c.tag not in RAW:
                todo.append((c, link or c.tag in ("a", "button")))
    return 2 * linked >= total or words <= 2


def _left_out(element: Element, inside: bool) -> bool:
    """Whether an element is furniture; a weak hint inside an article counts only with the second sign."""
    if not _furniture(element.tag, element.hints, inside):
        return False
    weak = inside and element.weak and not _furniture(element.tag, (), inside)
    return not weak or _mostly_links(element)


def _landmark(tag: str, names: tuple[str, ...], level: int) -> bool:
    if level == 0:
        return tag == "article"
    if level == 1:
        return tag == "main" or "main" in names
    return tag in ("div", "section", "td") and not MAIN_HINTS.isdisjoint(names)


class Slot:
    """A node of a wrapper as pages are read along it: ``fixed`` are the texts that are furniture, ``needed`` says that it is not optional."""

    __slots__ = ("label", "needed", "fixed", "slots")

    def __init__(self, node: list, needed: bool):
        self.label, self.needed = node[0], needed
        self.fixed = frozenset(node[3]) if len(node[4]) >= SAME_TEXT_PAGES else frozenset()
        self.slots = _slots(node)


def _slots(node: list, needed: bool = True) -> list[Slot]:
    """A node's children with groups opened."""
    found = []
    for c in node[5]:
        own = needed and c[1] > 0
        found += _slots(c, own) if c[0].startswith("(") else [Slot(c, own)]
    return found


@functools.lru_cache(maxsize=512)
def plan(wrapper: str) -> tuple[int, list[Slot]]:
    """The slots of the wrapper, and which kind of landmark marks its articles (3: none)."""
    root = json.loads(wrapper)

    def has(node: list, level: int) -> bool:
        tag, *names = node[0].split(" ") if not node[0].startswith(("(", "#")) else [""]
        if tag and _furniture(tag, tuple(names), False):
            return False
        slots = any(c[0] == TEXT or c[5] for c in node[5])
        return bool(tag and slots and _landmark(tag, tuple(names), level)) or any(has(c, level) for c in node[5])

    return next((level for level in range(3) if has(root, level)), 3), _slots(root)


class Place:
    """An element that is being read, and where its wrapper stands."""

    __slots__ = ("items", "slots", "at", "inside", "needed", "block", "label")

    def __init__(self, element: Element, slots: list[Slot], inside: bool, needed: bool, block: bool, label: bool):
        self.items, self.slots, self.at = tokens(element), slots, 0
        self.inside, self.needed, self.block, self.label = inside, needed, block, label

    def slot(self, label: str) -> Slot | None:
        for k in (*range(self.at, len(self.slots)), *range(self.at)):
            if self.slots[k].label == label:
                self.at = k
                return self.slots[k]
        return None


def landmarks(tree: Element) -> set[int]:
    """The kinds of landmark that a page has outside of furniture."""
    found, todo = set(), [tree]
    while todo:
        for c in todo.pop().children:
            if not isinstance(c, str) and not _furniture(c.tag, c.hints, False):
                found.update(kind for kind in range(3) if _landmark(c.tag, c.names, kind))
                todo.append(c)
    return found


def main_text(page: str, wrapper: str) -> str:
    """Text of the article slots: blocks in page order, white space inside a block as one space, joined by one space.

    A page without its wrapper's landmark is read by the next weaker kind that it has. Inside landmarks, headings, list items and
    the labels of tables, lists and figures are never furniture for being the same on all pages.
    """
    tree = parse(page)
    level, slots = plan(wrapper)
    kinds = landmarks(tree)
    while level < 3 and level not in kinds:
        level += 1
    blocks: list[list[str]] = [[]]
    places = [Place(tree, slots, level == 3, True, False, False)]
    while places:
        here = places[-1]
        item = next(here.items, None)
        if item is None:
            if places.pop().block:
                blocks.append([])
            continue
        if not isinstance(item, Element):
            own = None if item[0].isspace() else here.slot(TEXT)
            judged = own is not None and own.fixed and (level == 3 or (here.needed and own.needed and not here.label))
            if here.inside and not (judged and _digest(*item) in own.fixed):
                blocks[-1].append(item[0])
            continue
        if _left_out(item, here.inside and level < 3):
            if item.tag in BLOCKS or item.names:
                blocks.append([])
            continue
        block = item.tag in BLOCKS
        if block:
            blocks.append([])
        own = here.slot(item.label)
        needed = not here.inside or (here.needed and own is not None and own.needed)
        inside = here.inside or _landmark(item.tag, item.names, level)
        places.append(Place(item, own.slots if own else [], inside, needed, block, here.label or item.tag in LABELS))
    texts = (" ".join(html.unescape("".join(b)).split()) for b in blocks)
    return " ".join(t for t in texts if t)


def host_of(url: Column) -> Column:
    """Lower-case host of an address; pages without one share the empty host."""
    return F.lower(F.coalesce(F.regexp_extract(url.cast("string"), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))


def _written(wrapper: list) -> str:
    return json.dumps(wrapper, default=sorted)


def _merged(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Fold the wrappers of equal keys one by one."""
    dealt = rows.repartition(*keys).sortWithinPartitions(*keys, "wrapper")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, total = None, None
        for batch in batches:
            out = []
            for row in zip(*(batch.column(c).to_pylist() for c in (*keys, "wrapper"))):
                node = json.loads(row[-1])
                if here != row[:-1]:
                    if here is not None:
                        out.append((*here[:1], here[-1] if len(here) > 1 else 0, _written(total)))
                    here, total = row[:-1], node
                else:
                    total = merge(total, node, joined(total[4], node[4]))
            if out:
                yield _rows(out)
        if here is not None:
            yield _rows([(*here[:1], here[-1] if len(here) > 1 else 0, _written(total))])

    return dealt.mapInArrow(run, "host string, part int, wrapper string")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    host, part, wrapper = zip(*rows)
    return pa.RecordBatch.from_arrays(
        [pa.array(host, pa.string()), pa.array(part, pa.int32()), pa.array(wrapper, pa.string())], ["host", "part", "wrapper"]
    )


def infer_wrappers(pages: DataFrame) -> DataFrame:
    """``host, wrapper`` from all pages (``host``, ``html``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, held = TaskContext.get().partitionId() % PARTS, {}
        for batch in batches:
            for host, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
                own = skeleton(parse(page))
                before = held.get(host)
                held[host] = own if before is None else merge(before, own, joined(before[4], own[4]))
                if len(held) >= HELD_HOSTS:
                    yield _rows([(h, part, _written(w)) for h, w in held.items()])
                    held.clear()
        if held:
            yield _rows([(h, part, _written(w)) for h, w in held.items()])

    local = pages.select("host", "html").mapInArrow(run, "host string, part int, wrapper string")
    return _merged(_merged(local, ["host", "part"]), ["host"]).select("host", "wrapper")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars``: main text of every page.

    A null page is an empty one; its text is empty. Repeated rows are extracted one by one. Ids and addresses may be null.
    """
    chosen = pages.select(
        F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"),
        F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"), host_of(F.col(url_col)).alias("host"),
    )
    wrappers = stored(infer_wrappers(chosen), "wrappers")
    id_type = chosen.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p, w) for p, w in zip(batch.column("html").to_pylist(), batch.column("wrapper").to_pylist())]
            sizes = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), sizes],
                ["page_id", "url", "text", "n_chars"],
            )

    joined = chosen.join(wrappers, "host").select("page_id", "url", "html", "wrapper")
    return joined.mapInArrow(run, f"page_id {id_type}, url string, text string, n_chars long")
