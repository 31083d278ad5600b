"""HTML extraction by wrapper induction: pages of a host are aligned, what stays the same is template, what varies is content."""

from __future__ import annotations

import hashlib
import json
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache, reduce
from html import unescape
from itertools import accumulate, count
from math import isqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depweave.llm.common import struct_udf
from depweave.llm.url_rules import host
from depweave.plans.staging import stage, unstage

#: Trees that a task merges into one; a host with more of them takes several rounds.
FAN = 64
#: Different pages of a host on which a text must stand in the same slot to be template; besides, it must be on half of all that have the slot.
ALIKE = 6
#: Elements nested deeper belong to the slot of what holds them at this depth.
DEPTH = 64
#: Pairs of children up to which the rows of their matching are all kept, and weights of pairs of subtrees that are remembered. Both change nothing in what is found.
CELLS, KEPT = 1 << 22, 1 << 20
#: Bytes up to which wrappers are broadcast; beyond it they are joined by host.
BROADCAST_BYTES = 8 << 20

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"']|"[^"]*"|'[^']*')*)>""", re.S)
_NAMED = re.compile(r"""(?:^|[\s"'])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
#: Elements by how they are parsed and shown.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: What an element that begins closes if it is open, within its own container.
CLOSES = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option", "thead": "thead tbody tr td th", "tbody": "thead tbody tr td th", "tfoot": "tbody tr td th"}
_CLOSES = {k: frozenset(v.split()) for k, v in CLOSES.items()}
_HOLDS = frozenset("ul ol dl table select body html div article section".split())
#: Elements and words in their class, id or role that mark what is no article.
CHROME = frozenset("head nav footer aside form script style noscript template svg canvas button select option textarea iframe object dialog menu title".split())
CHROME_WORDS = frozenset(
    "ad ads adv advert advertisement adverts banner banners breadcrumb breadcrumbs comment comments consent cookie cookies copyright disqus footer "
    "gdpr header login masthead menu menus modal nav navbar navigation newsletter notice notices notification pagination popup promo promoted related "
    "reply replies respond search share sharing sidebar signup skyscraper social sponsor sponsored subscribe subscription tags toolbar widget widgets "
    "complementary contentinfo alert".split()
)


class Node:
    __slots__ = ("tag", "mark", "kids", "chrome", "slot", "said")

    def __init__(self, tag: str, mark: str = "", chrome: bool = False) -> None:
        self.tag, self.mark, self.chrome = tag, mark, chrome
        self.kids: list[Node | str] = []
        self.slot: Slot | None = None
        self.said = ""


class Slot:
    """A place of a page or wrapper: blocks of one label that follow each other share it.

    ``texts``: hashes of what single blocks of the slot say; in a wrapper those that many pages have.
    """

    __slots__ = ("label", "kids", "texts", "size", "number")

    def __init__(self, label: str, kids: list[Slot] | None = None) -> None:
        self.label, self.kids = label, kids or []
        self.texts: Counter[str] = Counter()
        self.size, self.number = 1 + sum(k.size for k in self.kids), -1


@lru_cache(20_000)
def _attributes(tag: str, text: str) -> tuple[str, bool]:
    """Class, id and role of an element as one mark, and whether they or the element are chrome."""
    found = " ".join(f"{m[1].lower()}={m[2] or m[3] or m[4] or ''}" for m in _NAMED.finditer(text)) if text else ""
    found = re.sub(r"\bid=\S*", lambda m: re.sub("[0-9]+", "", m[0]), found)  # an id often counts pages
    words = set(re.findall(r"[a-z]+", re.sub(r"\b(class|id|role)=", " ", re.sub(r"([a-z])([A-Z])", r"\1 \2", found)).lower()))
    return found, tag in CHROME or bool(words & CHROME_WORDS)


class _Open:
    """The stack of open elements, with the places of each tag, so that nothing searches the stack."""

    def __init__(self, root: Node) -> None:
        self.stack, self.places = [root], defaultdict(list)

    def push(self, node: Node) -> None:
        self.places[node.tag].append(len(self.stack))
        if node.tag in BLOCK and node.tag != "p":
            self.places["#block"].append(len(self.stack))
        self.stack.append(node)

    def cut(self, at: int) -> None:
        while len(self.stack) > at:
            node = self.stack.pop()
            self.places[node.tag].pop()
            if node.tag in BLOCK and node.tag != "p":
                self.places["#block"].pop()

    def last(self, tags: Iterable[str]) -> int:
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def close(self, tags: Iterable[str], barrier: Iterable[str] = ()) -> None:
        """Closes the innermost element of these tags, unless one of the barrier is open within it."""
        at = self.last(tags)
        if at and at > self.last(barrier):
            self.cut(at)


def parse(page: str) -> Node:
    """The tree of a page: open paragraphs, items and cells end where the next begins; unknown end tags are ignored."""
    root = Node("html")
    open_, at, end = _Open(root), 0, len(page)
    while at < end:
        m = _TOKEN.search(page, at)
        if m is None:
            open_.stack[-1].kids.append(page[at:])
            break
        if m.start() > at:
            open_.stack[-1].kids.append(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            open_.close((tag,))
            continue
        if tag == "html":
            continue
        if tag in BLOCK:
            open_.close(("p",), ("#block",))
        if tag in _CLOSES:
            open_.close(_CLOSES[tag], _HOLDS)
        if tag == "body":
            open_.close(("head",), ("#block",))
        node = Node(tag, *_attributes(tag, m[3]))
        open_.stack[-1].kids.append(node)
        if tag in RAW:
            close = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = close.end() if close else end
        elif tag not in VOID and not m[3].rstrip().endswith("/"):
            open_.push(node)
    return root


def _hash(text: str) -> str:
    return hashlib.md5(text.encode("utf-8", "surrogatepass"), usedforsecurity=False).hexdigest()[:16]


def skeleton(root: Node) -> Slot:
    """The tree of slots of a page without its chrome; each block gets its slot and the hash of what it says outside of the blocks in it."""

    def read(node: Node) -> list[Node]:
        """The blocks right in a block, and with them what it says itself; other elements are looked through."""
        said, blocks, todo = [], [], list(reversed(node.kids))
        while todo:
            k = todo.pop()
            if isinstance(k, str):
                said.append(k)
            elif k.chrome:
                continue
            elif k.tag in BLOCK:
                blocks.append(k)
                said.append(" ")
            else:
                todo.extend(reversed(k.kids))
        text = " ".join("".join(said).split())
        node.said = _hash(text) if text else ""
        return blocks

    def fold(nodes: list[Node], label: str, depth: int) -> Slot:
        runs: list[tuple[str, list[Node]]] = []
        known: dict[str, list[Node]] = {}
        slot, done = Slot(label), []
        todo = [(n, depth) for n in reversed(nodes)]
        while todo:
            n, at = todo.pop()
            done.append(n)
            inner = read(n)
            if at >= DEPTH:  # no slots of their own
                todo.extend((k, at + 1) for k in reversed(inner))
                continue
            for k in inner:
                name = f"{k.tag} {k.mark}"
                same = known.get(name) if len(nodes) > 1 else (runs[-1][1] if runs and runs[-1][0] == name else None)
                if same is not None:
                    same.append(k)
                else:
                    runs.append((name, [k]))
                    known[name] = runs[-1][1]
        slot.kids = [fold(ns, name, depth + 1) for name, ns in runs]
        slot.size = 1 + sum(k.size for k in slot.kids)
        if nodes[0].tag in _CLOSES and any(n.said for n in done):  # items, rows and cells are template together or not at all
            together = _hash(" ".join(n.said for n in done))
            for n in done:
                n.said = together
        for n in done:
            n.slot = slot
        slot.texts.update({n.said for n in done if n.said})
        return slot

    return fold([root], "html ", 0)


def match(a: Slot, b: Slot) -> tuple[int, list[tuple[Slot, Slot]]]:
    """Simple tree matching: the weight of the heaviest order-keeping match of two trees with equal roots, and its pairs.

    A pair of slots weighs 1, or 2 if they have a text in common. Only children with equal labels are compared.
    """
    return _Matching(a, b).found() if a.label == b.label else (0, [])


class _Matching:
    """Two trees that are matched. Subtrees that differ only in texts that one of the trees lacks are of one kind; kinds are weighed, not subtrees."""

    def __init__(self, a: Slot, b: Slot) -> None:
        self.roots, self.common = (a, b), _texts(a) & _texts(b)
        self.known: dict[tuple, int] = {}
        self.label: list[str] = []
        self.texts: list[frozenset[str]] = []
        self.kids: list[tuple[int, ...]] = []
        self.most: list[int] = []  # no match of a subtree weighs more
        self.weights: dict[tuple[int, int], int] = {}

    def found(self) -> tuple[int, list[tuple[Slot, Slot]]]:
        kinds = self._kind(self.roots[0]), self._kind(self.roots[1])
        pairs, todo = [], [(*self.roots, *kinds)]
        while todo:
            a, b, x, y = todo.pop()
            pairs.append((a, b))
            chosen = self._aligned(self.kids[x], self.kids[y])[1]
            todo += [(a.kids[i], b.kids[j], self.kids[x][i], self.kids[y][j]) for i, j in reversed(chosen)]
        return sum(self._own(x, y) for x, y in pairs), pairs

    def _own(self, a: Slot, b: Slot) -> int:
        return 1 if a.texts.keys().isdisjoint(b.texts) else 2

    def _kind(self, slot: Slot) -> int:
        kids = tuple([self._kind(k) for k in slot.kids])
        texts = frozenset(self.common.intersection(slot.texts)) if self.common else self.common
        key = slot.label, texts, kids
        found = self.known.get(key)
        if found is None:
            found = self.known[key] = len(self.label)
            self.label.append(slot.label)
            self.texts.append(texts)
            self.kids.append(kids)
            self.most.append((2 if texts else 1) + sum(self.most[k] for k in kids))
        return found

    def _weight(self, x: int, y: int) -> int:
        """The weight of the match of two kinds with equal labels."""
        found = self.weights.get((x, y))
        if found is None:
            found = (1 if self.texts[x].isdisjoint(self.texts[y]) else 2) + self._aligned(self.kids[x], self.kids[y], False)[0]
            if len(self.weights) >= KEPT:
                self.weights.clear()
            self.weights[x, y] = found
        return found

    def _aligned(self, one: tuple[int, ...], two: tuple[int, ...], chosen: bool = True) -> tuple[int, list[tuple[int, int]]]:
        """The weight of the heaviest order-keeping match of children and, if asked for, its pairs of places.

        Row by row over the first children: the heaviest match with as many of the second. Pairs are
        followed back from the last row; of many rows only some are kept, the others are made again.
        """
        if not one or not two:
            return 0, []
        labels = [self.label[x] for x in one]
        if labels == [self.label[y] for y in two]:
            weight = sum(self._weight(x, y) for x, y in zip(one, two, strict=True))
            if len(set(labels)) == len(labels) or weight == min(sum(self.most[x] for x in one), sum(self.most[y] for y in two)):
                return weight, [(i, i) for i in range(len(one))]
        places = defaultdict(list)  # by label, and by label and text
        for j, y in enumerate(two):
            places[self.label[y]].append(j)
            for t in self.texts[y]:
                places[self.label[y], t].append(j)
        kinds = {label: np.unique([two[j] for j in at], return_inverse=True) for label, at in places.items() if isinstance(label, str)}

        def after(best: np.ndarray, x: int) -> np.ndarray:
            row, label = best.copy(), self.label[x]
            at = places.get(label)
            if not at:
                return row
            if self.kids[x]:
                found, which = kinds[label]
                weights = np.array([self._weight(x, int(y)) for y in found])[which]
            else:
                weights = np.ones(len(two), np.int64)
                for t in self.texts[x]:
                    weights[places.get((label, t), [])] = 2
                weights = weights[at]
            to = np.array(at) + 1
            row[to] = np.maximum(row[to], best[to - 1] + weights)
            return np.maximum.accumulate(row)

        step = len(one) if len(one) * len(two) <= CELLS else isqrt(len(one))
        kept = [np.zeros(len(two) + 1, np.int64)]
        if chosen:
            for lo in range(0, len(one) - step, step):
                kept.append(reduce(after, one[lo : lo + step], kept[-1]))
        else:
            return int(reduce(after, one, kept[0])[-1]), []
        pairs, j, weight = [], len(two), None
        for k in range(len(kept) - 1, -1, -1):
            rows = list(accumulate(one[k * step : (k + 1) * step], after, initial=kept[k]))
            weight = int(rows[-1][-1]) if weight is None else weight
            for i in range(len(rows) - 1, 0, -1):
                if rows[i][j] > rows[i - 1][j]:
                    j = int(np.searchsorted(rows[i], rows[i][j])) - 1
                    pairs.append((k * step + i - 1, j))
        return weight, pairs[::-1]


def _texts(slot: Slot) -> frozenset[str]:
    """All texts of a tree."""
    found, todo = set(), [slot]
    while todo:
        slot = todo.pop()
        found.update(slot.texts)
        todo.extend(slot.kids)
    return frozenset(found)


def merge(wrapper: Slot, page: Slot) -> None:
    """Aligns a page with the wrapper: texts of matched slots are counted, new slots are put in at their place."""
    of = {id(p): w for w, p in match(wrapper, page)[1]}

    def take(w: Slot, p: Slot) -> None:
        w.texts += p.texts
        kids, at = [], 0
        for kid in p.kids:
            known = of.get(id(kid))
            if known is None:
                kids.append(kid)
                continue
            while w.kids[at] is not known:
                kids.append(w.kids[at])
                at += 1
            at += 1
            kids.append(known)
            take(known, kid)
        w.kids = kids + w.kids[at:]
        w.size = 1 + sum(k.size for k in w.kids)

    take(wrapper, page)


def _key(path: str, text: str) -> int:
    """A number for a text, odd, or for a place itself, even (no text)."""
    return (int(_hash(f"{path} {text}"), 16) >> 1 & ~1 | bool(text)) - (1 << 62)


def _below(path: str, label: str) -> str:
    return _hash(f"{path} {label}")


def outline(page: str) -> tuple[str, str, list[int]]:
    """A hash of what a page says, its tree of slots as text, and a key for each place and text of a place.

    A place is the chain of labels down to a slot; slots that are aligned have the same.
    """
    root = parse(page)
    said, keys = _hash("\n".join(main_blocks(root))), set()

    def dump(slot: Slot, path: str) -> list:
        path, texts = _below(path, slot.label), sorted(slot.texts)
        keys.update(_key(path, t) for t in ("", *texts))
        return [slot.label, texts, [dump(k, path) for k in slot.kids]]

    tree = json.dumps(dump(skeleton(root), ""))
    return said, tree, sorted(keys)


def prune(tree: str, often: Iterable[int]) -> str | None:
    """A tree without all that is not on several pages: slots with or above frequent texts stay, and as marks of their place the slots beside them, unless these are rare."""
    often = frozenset(often)

    def cut(node: list, path: str) -> list | None:
        path = _below(path, node[0])
        if _key(path, "") not in often:
            return None
        texts, kids = [t for t in node[1] if _key(path, t) in often], [cut(k, path) for k in node[2]]
        if any(k and (k[1] or k[2]) for k in kids):
            return [node[0], texts, [k for k in kids if k]]
        return [node[0], texts, []]

    found = cut(json.loads(tree), "")
    return json.dumps(found) if found and (found[1] or found[2]) else None


def _slots(tree: str) -> Slot:
    turn = count()

    def make(s: list) -> Slot:
        number = next(turn)
        slot = Slot(s[0], [make(k) for k in s[2]])
        slot.number, slot.texts = number, Counter(s[1])
        return slot

    return make(json.loads(tree))


def merged(trees: Iterable[str]) -> str:
    """One tree that all these trees are aligned with, beginning with the largest."""
    first, *others = sorted(trees, key=lambda t: (-len(t), t))
    wrapper = _slots(first)
    for tree in others:
        merge(wrapper, _slots(tree))
    dump = lambda s: [s.label, sorted(s.texts), [dump(k) for k in s.kids]]
    return json.dumps(dump(wrapper))


def induce(pages: Iterable[str], least: int = 2) -> str | None:
    """The wrapper of a few pages, as text: slots and the texts that stand on ``least`` of them in the same place; None if there are none.

    Pages that say the same count once.
    """
    found = [outline(page) for page in pages]
    on = Counter(key for _, key in {(said, key) for said, _, keys in found for key in keys})
    often = {key for key, n in on.items() if n >= least}
    trees = {prune(tree, often) for _, tree, _ in found} - {None}
    return merged(trees) if trees else None


@lru_cache(256)
def _loaded(wrapper: str) -> Slot:
    return _slots(wrapper)


def parts(wrapper: str) -> list[tuple[int, int, int, bool]]:
    """The slots of a wrapper, above before below, as ``key, slot, parent, shown``: one part for the place of a slot, ``shown`` if any text is frequent there, and one for each of its texts."""
    order, todo, often = [], [(_loaded(wrapper), "", -1)], set()
    while todo:
        slot, path, parent = todo.pop()
        path = _below(path, slot.label)
        order.append((slot, path, parent))
        if slot.texts:
            often.add(path)
        todo.extend((k, path, slot.number) for k in reversed(slot.kids))
    return [(_key(path, t), slot.number, parent, path in often and not t) for slot, path, parent in order for t in ("", *sorted(slot.texts))]


def alike(tree: str, found: Iterable[tuple[int, int, int, bool]]) -> list[tuple[int, str, int]]:
    """The slots of a wrapper that a page has where texts are frequent, as ``slot, text, own slot`` of the page: with an empty text, and with each frequent text that it has there.

    ``found``: the parts of the wrapper with keys of the page. Slots without them could be matched with nothing.
    """
    page = _slots(tree)
    places: dict[int, tuple[str, str]] = {}  # by key: label and text
    under: dict[int, int] = {}  # by key of a text: that of its place
    place: dict[int, int] = {}  # by own slot
    todo = [(page, "")]
    while todo:
        slot, path = todo.pop()
        path = _below(path, slot.label)
        here = place[slot.number] = _key(path, "")
        places[here] = slot.label, ""
        for t in slot.texts:
            key = _key(path, t)
            places[key], under[key] = (slot.label, t), here
        todo.extend((k, path) for k in slot.kids)
    known: dict[int, Slot] = {}
    shown, often, above = set(), defaultdict(set), {}
    for key, number, parent, frequent in sorted((f for f in found if f[0] in places), key=lambda f: (f[1], f[0] & 1)):
        label, text = places[key]
        if text:
            known[number].texts[text] += 1
            often[under[key]].add(text)
            continue
        known[number], above[number] = Slot(label), parent
        known[number].number = number
        if parent >= 0:
            known[parent].kids.append(known[number])
        if frequent:
            shown.add(number)
    if 0 not in known:
        return []
    for number in sorted(known, reverse=True):
        if above[number] >= 0:
            known[above[number]].size += known[number].size
    out = []
    for slot, mine in match(known[0], page)[1]:
        if slot.number in shown:
            out.append((slot.number, "", mine.number))
            out += [(slot.number, t, mine.number) for t in sorted(mine.texts) if t in often[place[mine.number]]]
    return out


def main_blocks(root: Node) -> list[str]:
    """The blocks of text of a page in page order, without chrome and template."""
    _unmark(root)
    return _blocks(root)


def _unmark(root: Node) -> None:
    """Class words do not make chrome of body, nor of an element with most of the page's text and all its articles."""
    order, todo = [], [root]
    while todo:
        x = todo.pop()
        order.append(x)
        todo.extend(k for k in x.kids if isinstance(k, Node) and k.tag not in CHROME)
    held: dict[int, tuple[int, int]] = {}
    for x in reversed(order):
        inner = [(len(k.strip()), 0) if isinstance(k, str) else held.get(id(k), (0, 0)) for k in x.kids]
        held[id(x)] = sum(n for n, _ in inner), sum(n for _, n in inner) + (x.tag in ("article", "main"))
    whole, articles = held[id(root)]
    for x in order:
        size, own = held[id(x)]
        if x.chrome and (x.tag == "body" or (2 * size > whole and own == articles)):
            x.chrome = False


def _blocks(root: Node, template: dict[int, set[str]] | None = None) -> list[str]:
    """``template``: by slot (its identity) the hashes of texts that are left out.""" 
    out: list[str] = []
    line: list[str] = []

    def flush() -> None:
        if line:
            if text := " ".join(unescape("".join(line)).split()):
                out.append(text)
            line.clear()

    # With each: is it in an article or main, whose header is content, and does its block say what is template?
    todo: list[tuple[Node | str | None, bool, bool]] = [(root, False, False)]
    while todo:
        x, within, fixed = todo.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            if not fixed:
                line.append(x)
        elif x.chrome or (x.tag == "header" and not within):
            if x.tag in BLOCK:
                flush()
        elif x.tag in ("br", "wbr"):
            line.append(" " if x.tag == "br" else "")
        else:
            if x.tag in BLOCK:
                flush()
                todo.append((None, False, False))
                fixed = False
            if template and x.slot is not None and x.said:
                fixed = x.said in template.get(id(x.slot), ())
            within = within or x.tag in ("article", "main")
            todo.extend((k, within, fixed) for k in reversed(x.kids))
    flush()
    return out


def extract_text(page: str | None, wrapper: str | None = None, fixed: Iterable[str] | None = None) -> str:
    """The article of a page. ``fixed``: the texts that are template, as ``slot:hash`` with slots of the wrapper or, without one, of the page itself."""
    if not page:
        return ""
    root = parse(page)
    _unmark(root)
    if not fixed:
        return "\n".join(_blocks(root))
    texts = defaultdict(set)
    for x in fixed:
        number, _, text = x.partition(":")
        texts[int(number)].add(text)
    mine = skeleton(root)
    if wrapper:
        numbered = [(known.number, slot) for known, slot in match(_loaded(wrapper), mine)[1]]
    else:
        numbered, todo = [], [mine]
        while todo:  # in the order in which trees are written
            slot = todo.pop()
            numbered.append((len(numbered), slot))
            todo.extend(reversed(slot.kids))
    return "\n".join(_blocks(root, {id(slot): texts[n] for n, slot in numbered if n in texts}))


def _small(df: DataFrame, size: Column) -> DataFrame:
    """A staged table, marked for broadcast if its column ``size`` sums to BROADCAST_BYTES or less."""
    return F.broadcast(df) if df.agg(F.coalesce(F.sum(size), F.lit(0)).alias("n")).first()["n"] <= BROADCAST_BYTES else df


def outlines(pages: DataFrame) -> DataFrame:
    """``host, h, page, tree, keys`` of the different pages of ``host, h, html``, staged: ``page`` is a hash of what it says, the rest as ``outline`` has it."""

    def each(values: list[str]) -> list[list]:
        return [list(x) for x in zip(*map(outline, values), strict=True)] or [[], [], []]

    run = struct_udf(each, [("page", pa.string()), ("tree", pa.string()), ("keys", pa.list_(pa.int64()))], "page string, tree string, keys array<bigint>")
    return stage(pages.where("html != ''").select("host", "h", run(F.col("html")).alias("r")).select("host", "h", "r.*").distinct(), "outlines")


def wrappers(read: DataFrame) -> DataFrame:
    """``host, wrapper`` for each host whose pages share texts, from all of its pages and layouts.

    ``read``: see ``outlines``. Slots are aligned only if the labels above them are equal, so a text that
    stands below the same labels on fewer than ALIKE different pages is template nowhere, and is left out
    of the trees; so are slots without others. What remains of all pages is merged in rounds, FAN
    different trees in a task, until each host has one.
    """
    placed = read.select("host", "page", F.explode("keys").alias("key")).distinct()
    often = stage(placed.groupBy("host", "key").agg(F.count("*").alias("n")).where(F.col("n") >= ALIKE).select("host", "key"), "often")
    hits = placed.join(_small(often, F.length("host") + 8), ["host", "key"]).groupBy("host", "page").agg(F.collect_list("key").alias("often"))
    hits = stage(hits.where(F.exists("often", lambda x: x.bitwiseAND(F.lit(1)) == 1)), "hits")
    cut = struct_udf(lambda values: [[prune(v["tree"], v["often"]) for v in values]], [("tree", pa.string())], "tree string")
    pruned = read.select("host", "page", "tree").join(_small(hits, F.length("host") + 16 + 8 * F.size("often")), ["host", "page"]).select("host", cut(F.struct("tree", "often")).alias("r"))
    trees = stage(pruned.select("host", F.col("r.tree").alias("wrapper")).where("wrapper is not null").distinct(), "trees")
    unstage(often)
    unstage(hits)

    def learn(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"host": [key[0]], "wrapper": [merged(group["wrapper"])]})

    while True:
        sizes = stage(trees.groupBy("host").agg(F.count("*").alias("n")), "sizes")
        most = sizes.agg(F.max("n").alias("n")).first()["n"] or 0
        if most > 1:
            dealt = trees.join(_small(sizes, F.length("host") + 8), "host").withColumn("part", F.pmod(F.xxhash64("wrapper"), F.ceil(F.col("n") / FAN)))
            found = stage(dealt.groupBy("host", "part").applyInPandas(learn, "host string, wrapper string"), "wrappers")
            unstage(trees)
            trees = found
        unstage(sizes)
        if most <= FAN:
            return trees


def templates(read: DataFrame, known: DataFrame) -> DataFrame:
    """``host, h, fixed``: for pages that have some, the texts that all pages of their host show to be template, as ``own slot:text``.

    ``read``: see ``outlines``. A text is template in a slot if it stands there on at
    least ALIKE different pages and on half of all that have the slot; pages that say the same are
    one page. A page gets those slots of its host's wrapper whose places it has, so a wrapper may be
    large. Counts are folded by host, slot, text and page, so a large host is dealt over tasks.
    """
    kind = pa.list_(pa.struct([("key", pa.int64()), ("slot", pa.int32()), ("parent", pa.int32()), ("shown", pa.bool_())]))
    names = ("key", "slot", "parent", "shown")
    cut = struct_udf(lambda values: [[[dict(zip(names, p, strict=True)) for p in parts(v)] for v in values]], [("p", kind)], "p array<struct<key bigint, slot int, parent int, shown boolean>>")
    slots = stage(known.select("host", cut(F.col("wrapper")).alias("r")).select("host", F.explode("r.p").alias("p")).select("host", "p.*"), "parts")
    placed = read.select("host", "h", F.explode("keys").alias("key"))
    met = stage(placed.join(_small(slots, F.length("host") + 17), ["host", "key"]).groupBy("host", "h").agg(F.collect_list(F.struct(*names)).alias("met")), "met")

    def each(values: list[dict]) -> list[list]:
        return [[[{"slot": n, "text": t, "own": own} for n, t, own in alike(v["tree"], [tuple(p[x] for x in names) for p in v["met"]])] for v in values]]

    run = struct_udf(each, [("at", pa.list_(pa.struct([("slot", pa.int32()), ("text", pa.string()), ("own", pa.int32())])))], "at array<struct<slot int, text string, own int>>")
    aligned = read.select("host", "h", "page", "tree").join(_small(met, F.length("host") + 32 + 17 * F.size("met")), ["host", "h"])
    aligned = stage(aligned.select("host", "h", "page", run(F.struct("tree", "met")).alias("r")).select("host", "h", "page", F.explode("r.at").alias("at")).select("host", "h", "page", "at.*"), "aligned")
    counts = stage(aligned.select("host", "page", "slot", "text").distinct().groupBy("host", "slot", "text").agg(F.count("*").alias("n")), "counts")
    having = counts.where("text = ''").select("host", "slot", F.col("n").alias("of"))
    template = stage(counts.where((F.col("text") != "") & (F.col("n") >= ALIKE)).join(having, ["host", "slot"]).where("2 * n >= of").select("host", "slot", "text"), "template")
    fixed = aligned.where("text != ''").join(_small(template, F.length("host") + 20), ["host", "slot", "text"]).select("host", "h", F.concat_ws(":", F.col("own").cast("string"), "text").alias("fixed"))
    found = stage(fixed.groupBy("host", "h").agg(F.collect_set("fixed").alias("fixed")), "templates")
    for df in (slots, met, aligned, counts, template):
        unstage(df)
    return found


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row ``page_id, url, text, n_chars`` for each row of pages: the article, its blocks joined by line feeds.

    Content are the slots of the host's wrapper whose text varies, outside of menus, footers, adverts
    and the like. A null or empty page has an empty text. Pages with a null URL or one without a host
    share the empty host. Repeated rows stay repeated, and count once for the wrapper. A host with
    less than ALIKE different pages has no template; then only the elements and marks decide.
    """
    rows = pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"), host(F.col(url)).alias("host"), F.md5(F.col(html)).alias("h"))
    read = outlines(rows)
    known = wrappers(read)
    found = templates(read, known)
    unstage(read)
    unstage(known)
    joined = rows.join(_small(found, F.length("host") + 32 + 24 * F.size("fixed")), ["host", "h"], "left")

    def each(values: list[dict]) -> list[list]:
        return [[extract_text(v["html"], fixed=v["fixed"]) for v in values]]

    run = struct_udf(each, [("text", pa.string())], "text string")
    return joined.select("page_id", "url", run(F.struct("html", "fixed")).alias("r")).select("page_id", "url", "r.text", F.length("r.text").cast("long").alias("n_chars"))


def blocks(page: str) -> Iterator[str]:
    yield from main_blocks(parse(page))
