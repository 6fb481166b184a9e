"""Main text of web pages by wrapper induction (operator 2).

A page is a tree of block elements; inline elements belong to their block, and
following siblings of the same tag, class, id and inner shape are one node.  The
commonest trees of a host are aligned by simple tree matching and merged into the
host's wrapper.  Every page is aligned with its host's wrapper, which gives each
of its nodes a slot: a node of the wrapper or, where the wrapper has none, the
path below the nearest node that it has.  Slots whose text is the same on nearly
all pages of the host that have them are template; varying slots are content, all
over the page.

Some parts never are content, whatever their text: elements that HTML itself
defines as menus, footers, forms, scripts and the like, hidden ones, and those
whose class, id or role is made of the words of a short list (adverts, comments,
...), as their text varies from page to page just as an article's does.

Everything here takes time linear in the page but for the alignment of siblings,
which is exact however many there are: linear in those alike at both ends and
quadratic, in vectors, in what lies between.
"""

from __future__ import annotations

import html
import json
import math
import re
import sys
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Trees of a host that its wrapper is merged from, at most: the commonest.
REFERENCES = 5
#: Distinct pages of a host that a template slot is on, and the share of the pages with the slot that have the same text.
LEAST_PAGES = 2
CONSTANT = 0.9
#: Distinct pages that a slot of several like siblings is on, for one of them to be template by itself.
LEAST_RUN_PAGES = 5
#: Weights that are remembered in matching two trees, of nodes and in rows of siblings; forgotten ones are found anew.
REMEMBERED, REMEMBERED_IN_ROWS = 200_000, 8_000_000
#: Bytes of wrappers that are broadcast at most.
WRAPPER_BYTES = 32 << 20

# Element names as HTML defines them, and class names in common use.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
DROPPED = frozenset("script style noscript template head title nav footer aside form button select option textarea iframe object svg canvas math dialog menu audio video map xmp noembed noframes".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCKS - frozenset("body html caption dd dt legend li option summary tbody td tfoot th thead tr".split())
NOISE_WORDS = frozenset("ad ads advert adverts advertisement advertising adsense sponsor sponsored sponsors promo banner nav navbar navigation menu breadcrumb breadcrumbs sidebar footer masthead cookie cookies consent gdpr notice notices popup modal newsletter subscribe comment comments respond replies disqus share sharing social related pagination".split())
QUALIFIERS = frozenset("site main page top bottom left right primary secondary global box block area list section container wrapper inner outer bar slot unit item items link links header content post posts reader readers user users".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar form".split())
_SAME = {"li": ("li",), "option": ("option",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th")}

_NAME = re.compile(r"[A-Za-z][^\s/>]*")
_ENDS = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>][^\s>]*)))?")
_DIGIT = re.compile("[0-9]")


def tokens(source: str) -> Iterator[tuple[str, str, str]]:
    """The page in order: ("", text, ""), ("<", name, attributes) and ("</", name, "").

    Comments, declarations and what raw-text elements hold are left out.  A quote
    that never closes is an ordinary character; a tag that never ends is left out.
    """
    at, n, text = 0, len(source), 0
    open_quotes: set[str] = set()  # quotes that don't come again
    while (lt := source.find("<", at)) >= 0:
        slash = source.startswith("/", lt + 1)
        name = _NAME.match(source, lt + 1 + slash)
        if name is None:
            if source.startswith("!--", lt + 1):
                end = source.find("-->", lt + 4)
                end = n if end < 0 else end + 3
            elif slash or source.startswith(("!", "?"), lt + 1):
                end = source.find(">", lt)
                end = n if end < 0 else end + 1
            else:  # a bare <
                at = lt + 1
                continue
            if lt > text:
                yield "", source[text:lt], ""
            at = text = end
            continue
        end = name.end()
        while (m := _ENDS.search(source, end)) and m[0] != ">":
            end, before = m.end(), m.start() - 1
            while source[before].isspace():
                before -= 1
            if source[before] == "=" and m[0] not in open_quotes:
                close = source.find(m[0], end)
                if close < 0:
                    open_quotes.add(m[0])
                else:
                    end = close + 1
        if lt > text:
            yield "", source[text:lt], ""
        if m is None:
            return
        at = text = m.end()
        tag, attributes = name[0].lower(), source[name.end() : m.start()]
        yield "</" if slash else "<", tag, attributes
        if not slash and tag in RAW:
            raw = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(source, at)
            at = text = raw.start() if raw else n
    if text < n:
        yield "", source[text:], ""


def attributes_of(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(text):
        out.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    return out


def noisy(word: str) -> bool:
    """Whether a class or id is a noise word, alone or with words that only tell where or whose."""
    parts = [p for p in re.split("[-_]+", word) if p]
    return any(p in NOISE_WORDS for p in parts) and all(p in NOISE_WORDS or p in QUALIFIERS for p in parts)


def is_noise(name: str, attributes: dict[str, str]) -> bool:
    """Whether a hint says that an element holds no content."""
    if name in ("html", "body", "article", "main"):
        return False
    if "hidden" in attributes or attributes.get("role", "").lower() in NOISE_ROLES:
        return True
    return any(map(noisy, attributes.get("class", "").lower().split())) or noisy(attributes.get("id", "").lower())


def kind(attributes: dict[str, str]) -> str:
    """Class and id as written on every page: sorted, without those that have a digit."""
    words = [f"{key[0]}:{w}" for key in ("class", "id") for w in attributes.get(key, "").lower().split()]
    return " ".join(sorted({w for w in words if not _DIGIT.search(w)}))


def clean(pieces: list[str]) -> str:
    return " ".join(html.unescape("".join(pieces)).split())


class Page:
    """A page's blocks and its tree.

    keys and parents describe the tree: a node a run of like siblings, in preorder,
    the root first; blocks has (node, text) in page order.
    """

    def __init__(self, source: str | None) -> None:
        self._names, self._keys, self._parents, self._texts = ["#root"], ["#root"], [-1], []
        self._parse(source or "")
        self._merge()

    def _parse(self, source: str) -> None:
        # open elements: name, its block, whether it is (in) a dropped one, whether it is in an article
        stack = [("#root", 0, False, False)]
        count: Counter[str] = Counter()
        pieces: list[str] = []

        def flush(block: int) -> None:
            if pieces and (text := clean(pieces)):
                self._texts.append((block, text))
            pieces.clear()

        def pop() -> None:
            name, block, dropped, _ = stack.pop()
            count[name] -= 1
            if name in BLOCKS and not dropped:
                flush(block)

        def pop_to(names: tuple[str, ...]) -> None:
            while stack[-1][0] not in names:
                pop()
            pop()

        for what, name, raw in tokens(source):
            _, block, dropped, inside = stack[-1]
            if not what:
                if not dropped:
                    pieces.append(name)
                continue
            if what == "</":
                if count[name]:
                    pop_to((name,))
                continue
            if name in CLOSES_P and count["p"]:
                pop_to(("p",))
            elif name in _SAME and (stack[-1][0] in _SAME[name] or stack[-1][0] == "p" and len(stack) > 2 and stack[-2][0] in _SAME[name]):
                pop_to(_SAME[name])
            _, block, dropped, inside = stack[-1]
            attributes = attributes_of(raw) if raw else {}
            gone = dropped or name in DROPPED or (name == "header" and not inside) or is_noise(name, attributes)
            if name == "br" and not gone:
                pieces.append(" ")
            if name in BLOCKS and not dropped:
                flush(block)
                if not gone and name not in VOID:
                    self._names.append(name)
                    self._keys.append(f"{name}|{kind(attributes)}")
                    self._parents.append(block)
                    block = len(self._keys) - 1
            if name not in VOID and not (raw.endswith("/") and name not in BLOCKS and name not in ("a", "b", "i", "span", "em", "strong")):
                stack.append((name, block, gone, inside or name in ("article", "main")))
                count[name] += 1
        while len(stack) > 1:
            pop()
        flush(0)

    def _merge(self) -> None:
        children: list[list[int]] = [[] for _ in self._keys]
        for i, p in enumerate(self._parents[1:], 1):
            children[p].append(i)
        shape = [0] * len(self._keys)
        runs: list[list[list[int]]] = [[] for _ in self._keys]  # children, like ones that follow each other together
        for i in reversed(range(len(self._keys))):
            for c in children[i]:
                if runs[i] and shape[runs[i][-1][0]] == shape[c]:
                    runs[i][-1].append(c)
                else:
                    runs[i].append([c])
            shape[i] = xxhash.xxh3_64_intdigest(self._keys[i] + "(" + ",".join(str(shape[r[0]]) for r in runs[i]))
        # number the runs in preorder; elements of a run share the numbers of what is inside
        self.keys, self.parents, node = [], [], [0] * len(self._keys)
        size = [1] * len(self._keys)
        for i in reversed(range(len(self._keys))):
            size[i] = 1 + sum(size[r[0]] for r in runs[i])
        for i in range(len(self._keys)):  # parents come before their children
            at = node[i] + 1
            for run in runs[i]:
                for c in run:
                    node[c] = at
                at += size[run[0]]
        self.keys, self.parents = [""] * size[0], [-1] * size[0]
        for i, p in enumerate(self._parents):
            self.keys[node[i]] = self._keys[i]
            self.parents[node[i]] = node[p] if p >= 0 else -1
        self.blocks = [(node[b], text) for b, text in self._texts]

    def tree(self) -> Tree:
        return Tree(self.keys, self.parents)


class Tree:
    """Nodes in preorder: keys, parents, children, sizes of what hangs on them and hashes of its shape."""

    def __init__(self, keys: list[str], parents: list[int]) -> None:
        self.keys, self.parents = keys, parents
        self.children: list[list[int]] = [[] for _ in keys]
        for i, p in enumerate(parents[1:], 1):
            self.children[p].append(i)
        self.size, self.shape = [1] * len(keys), [0] * len(keys)
        for i in reversed(range(len(keys))):
            self.size[i] += sum(self.size[c] for c in self.children[i])
            self.shape[i] = xxhash.xxh3_64_intdigest(keys[i] + "(" + ",".join(str(self.shape[c]) for c in self.children[i]))

    def dump(self) -> str:
        return json.dumps([self.keys, self.parents], separators=(",", ":"))

    @classmethod
    def load(cls, text: str) -> Tree:
        return cls(*json.loads(text))


def match(a: Tree, b: Tree) -> dict[int, int]:
    """Simple tree matching: the node of b for each node of a that has one.

    Nodes match if their keys are equal and their parents match, siblings in
    order, and as many nodes as can.
    """
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 1000 + 8 * min(len(a.keys), len(b.keys))))
    weights: dict[tuple[int, int], int] = {}

    def weight(i: int, j: int) -> int:
        """Nodes that match if a's i and b's j do."""
        if a.keys[i] != b.keys[j]:
            return 0
        at = (a.shape[i], b.shape[j])
        if at[0] == at[1]:
            return a.size[i]
        if at not in weights:
            total = 1 + siblings(a.children[i], b.children[j], False)[0]
            if len(weights) >= REMEMBERED:
                weights.clear()
            weights[at] = total
        return weights[at]

    def siblings(xs: list[int], ys: list[int], traced: bool) -> tuple[int, list[tuple[int, int]]]:
        """The nodes that two lists of siblings match at most and, if traced, the siblings that do so."""
        first, same = 0, min(len(xs), len(ys))
        while first < same and a.shape[xs[first]] == b.shape[ys[first]]:
            first += 1
        last = 0
        while last < same - first and a.shape[xs[-1 - last]] == b.shape[ys[-1 - last]]:
            last += 1
        pairs = [*zip(xs[:first], ys[:first], strict=True), *zip(xs[len(xs) - last :], ys[len(ys) - last :], strict=True)]
        total = sum(a.size[x] for x, _ in pairs)
        xs, ys = xs[first : len(xs) - last], ys[first : len(ys) - last]
        common_keys = {a.keys[x] for x in xs} & {b.keys[y] for y in ys}
        if not common_keys:
            return total, pairs
        xs, ys = [x for x in xs if a.keys[x] in common_keys], [y for y in ys if b.keys[y] in common_keys]
        if len(xs) == len(ys) == 1:
            return total + weight(xs[0], ys[0]), [*pairs, (xs[0], ys[0])]
        places: dict[str, dict[int, list[int]]] = {}  # of ys, by key and shape
        for y, j in enumerate(ys):
            places.setdefault(b.keys[j], {}).setdefault(b.shape[j], []).append(y)
        rows: dict[int, np.ndarray] = {}  # by shape

        def row(x: int) -> np.ndarray:
            """The weights of a sibling with all of ys."""
            i = xs[x]
            if a.shape[i] not in rows:
                alike = places[a.keys[i]]
                found = [weight(i, ys[at[0]]) for at in alike.values()]
                if len(rows) * len(ys) >= REMEMBERED_IN_ROWS:
                    rows.clear()
                out = np.zeros(len(ys), np.int32)
                for n, at in zip(found, alike.values(), strict=True):
                    out[at] = n
                rows[a.shape[i]] = out
            return rows[a.shape[i]]

        most, middle = _best(len(xs), len(ys), row, traced)
        return total + most, pairs + [(xs[x], ys[y]) for x, y in middle]

    out: dict[int, int] = {}
    todo = [(0, 0)] if weight(0, 0) else []
    while todo:
        i, j = todo.pop()
        out[i] = j
        if a.shape[i] == b.shape[j]:
            out.update((i + k, j + k) for k in range(1, a.size[i]))
        else:
            todo += siblings(a.children[i], b.children[j], True)[1]
    return out


def _best(m: int, n: int, row: Callable[[int], np.ndarray], traced: bool) -> tuple[int, list[tuple[int, int]]]:
    """The weight of the heaviest increasing pairs of m and n places and, if traced, the pairs; row has the weights of a place of the m.

    Of the table over all pairs, about the root of m rows are held at a time.
    """

    def after(best: np.ndarray, weights: np.ndarray) -> np.ndarray:
        out = np.zeros_like(best)
        np.maximum.accumulate(np.maximum(best[1:], best[:-1] + weights), out=out[1:])
        return out

    step, held, best = math.isqrt(m) + 1, [], np.zeros(n + 1, np.int32)
    for x in range(m):
        if traced and x % step == 0:
            held.append(best)
        best = after(best, row(x))
    pairs, x, y = [], m, n
    while traced and x and y:
        begin = (x - 1) // step * step
        table = [held[begin // step]]
        for k in range(begin, x):
            table.append(after(table[-1], row(k)))
        while x > begin and y:
            here = table[x - begin]
            if here[y] == table[x - begin - 1][y]:
                x -= 1
            elif here[y] == here[y - 1]:
                y -= 1
            else:
                x, y = x - 1, y - 1
                pairs.append((x, y))
    return int(best[n]), pairs[::-1]


def merged(w: Tree, page: Tree) -> Tree:
    """The wrapper with the nodes of a page that it lacks, each behind the sibling that it follows there."""
    to = match(page, w)
    if len(to) == len(page.keys) or 0 not in to:
        return w
    children: dict[tuple[str, int], list[tuple[str, int]]] = {("w", i): [("w", c) for c in w.children[i]] for i in range(len(w.keys))}
    for i in range(len(page.keys)):
        own = ("w", to[i]) if i in to else ("p", i)
        row = children.setdefault(own, [])
        after = -1
        for c in page.children[i]:
            if c in to:
                after = row.index(("w", to[c]))
            else:
                after += 1
                row.insert(after, ("p", c))
    keys: list[str] = []
    parents: list[int] = []
    todo: list[tuple[tuple[str, int], int]] = [(("w", 0), -1)]
    while todo:
        (tree, i), parent = todo.pop()
        keys.append(w.keys[i] if tree == "w" else page.keys[i])
        parents.append(parent)
        todo += [(c, len(keys) - 1) for c in reversed(children.get((tree, i), []))]
    return Tree(keys, parents)


_WRAPPERS: dict[str, Tree] = {}


def _wrapper(text: str) -> Tree:
    if text not in _WRAPPERS:
        if sum(map(len, _WRAPPERS)) > 4 << 20:
            _WRAPPERS.clear()
        _WRAPPERS[text] = Tree.load(text)
    return _WRAPPERS[text]


def slots(page: Page, wrapper: str | None) -> list[int]:
    """The slot of each node of the page: the wrapper's node, or a hash of the path below the nearest one."""
    to = match(page.tree(), _wrapper(wrapper)) if wrapper else {}
    out: list[int] = []
    seen: Counter[tuple[int, str]] = Counter()
    for i, key in enumerate(page.keys):
        if i in to:
            out.append(to[i])
            continue
        above = out[page.parents[i]] if i else -1
        seen[above, key] += 1
        out.append(xxhash.xxh3_64_intdigest(f"{above}/{key}#{seen[above, key]}") >> 2 | 1 << 62)
    return out


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode()) - (1 << 63)


def by_slot(page: Page, wrapper: str | None) -> dict[int, list[int]]:
    """The places of each slot's blocks."""
    of, out = slots(page, wrapper), defaultdict(list)
    for at, (node, _) in enumerate(page.blocks):
        out[of[node]].append(at)
    return out


def _whole(page: Page, slot: int, places: list[int]) -> int:
    """The hash of a slot's whole text; texts of different slots have different hashes."""
    return _hash(f"{slot}=" + "\n".join(page.blocks[at][1] for at in places))


def _part(page: Page, slot: int, place: int) -> int:
    """The hash of one block of a slot of several."""
    return _hash(f"{slot}~{page.blocks[place][1]}")


def host_of() -> Column:
    """The host of url, lower-cased; "" where there is none."""
    return F.coalesce(F.lower(F.regexp_extract("url", r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def induce(pages: DataFrame, *, references: int = REFERENCES) -> DataFrame:
    """A wrapper for each host of pages (host, html): host, wrapper, template.

    template has the hashes of slots' texts that are constant over the host's
    pages, and of single blocks of slots that have several.
    """
    spark = pages.sparkSession

    def trees(batch: pa.RecordBatch) -> pa.RecordBatch:
        seen = Counter((h, Page(t).tree().dump()) for h, t in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True))
        hosts, dumps = zip(*seen, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(hosts), pa.array(dumps), pa.array([_hash(x) for x in dumps]), pa.array(list(seen.values()))], names=["host", "tree", "h", "n"])

    common_trees = common.arrow_map(pages.select("host", "html"), trees, "host string, tree string, h long, n long")
    counted = common_trees.groupBy("host", "h").agg(F.sum("n").alias("n"), F.first("tree").alias("tree"))
    # the window's limit is taken within partitions first, so a host of many trees is no load
    chosen = counted.withColumn("rank", F.row_number().over(Window.partitionBy("host").orderBy(F.desc("n"), "h"))).where(F.col("rank") <= references)

    def wrap(batches):
        for t in common.groups(batches, ["host"]):
            w = Tree.load(t["tree"][0].as_py())
            for other in t["tree"].to_pylist()[1:]:
                w = merged(w, Tree.load(other))
            yield pa.RecordBatch.from_arrays([pa.array([t["host"][0].as_py()]), pa.array([w.dump()])], names=["host", "wrapper"])

    spread = chosen.select("host", "rank", "tree").repartition(common.partitions(spark), "host").sortWithinPartitions("host", "rank")
    wrappers = common.written(spread.mapInArrow(wrap, "host string, wrapper string"), "wrappers")

    def texts(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for i, (source, w) in enumerate(zip(batch.column("html").to_pylist(), batch.column("wrapper").to_pylist(), strict=True)):
            page = _hash(source or "")
            tree = Page(source)
            for slot, places in by_slot(tree, w).items():
                rows.append((i, page, slot, _whole(tree, slot, places), False))
                rows += [(i, page, slot, _part(tree, slot, x), True) for x in places if len(places) > 1]
        at, page, slot, text, part = zip(*rows, strict=True) if rows else ([], [], [], [], [])
        return pa.RecordBatch.from_arrays([batch.column("host").take(pa.array(at, pa.int64())), pa.array(page, pa.int64()), pa.array(slot, pa.int64()), pa.array(text, pa.int64()), pa.array(part, pa.bool_())], names=["host", "page", "slot", "text", "part"])

    each = common.arrow_map(with_wrappers(pages, wrappers).select("host", "html", "wrapper"), texts, "host string, page long, slot long, text long, part boolean").distinct()
    each = common.written(each.groupBy("host", "slot", "text", "part").agg(F.count("*").alias("n")), "texts")
    # a slot's pages: each has one whole text
    total = each.where("not part").groupBy("host", "slot").agg(F.sum("n").alias("pages")).where(F.col("pages") >= LEAST_PAGES)
    # rare texts go before the join; a slot's constants are 10 of its parts and one whole at most
    often = each.where(F.col("n") >= LEAST_PAGES).join(total, ["host", "slot"])
    often = often.where((F.col("n") >= CONSTANT * F.col("pages")) & (~F.col("part") | (F.col("pages") >= LEAST_RUN_PAGES)))
    fixed = often.groupBy("host").agg(F.collect_list("text").alias("template"))
    return common.written(wrappers.join(fixed, "host", "left").select("host", "wrapper", F.coalesce("template", F.expr("cast(array() as array<bigint>)")).alias("template")), "wrappers")


def with_wrappers(pages: DataFrame, wrappers: DataFrame) -> DataFrame:
    """pages with their host's wrapper; broadcast if all wrappers are small, else by a join that splits large hosts."""
    bytes_ = F.length("wrapper") + 100
    if "template" in wrappers.columns:
        bytes_ += 8 * F.size("template")
    size = wrappers.agg(F.coalesce(F.sum(bytes_), F.lit(0))).head()[0]
    return pages.join(F.broadcast(wrappers) if size <= WRAPPER_BYTES else wrappers, "host", "left")


def main_text(source: str | None, wrapper: str | None, template: list[int]) -> str:
    """A page's blocks that are no template, a line each; a page that is template all over is its own content."""
    page = Page(source)
    kept = set(range(len(page.blocks)))
    if template:
        fixed = set(template)
        for slot, places in by_slot(page, wrapper).items():
            if _whole(page, slot, places) in fixed:
                kept.difference_update(places)
            elif len(places) > 1:
                kept.difference_update(x for x in places if _part(page, slot, x) in fixed)
    return "\n".join(text for at, (_, text) in enumerate(page.blocks) if at in kept or not kept)


def extract(pages: DataFrame, *, references: int = REFERENCES) -> DataFrame:
    """The main text of each row of pages (page_id, url, html): page_id, url, text, n_chars.

    A null html is empty, and so is its text; pages without a host in their url
    count as one host; rows repeat as they come, and equal pages of a host count
    once; no rows give no rows.  Other columns are ignored.
    """
    rows = pages.select("page_id", "url", "html", host_of().alias("host"))
    wrappers = induce(rows.select("host", "html"), references=references)

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(h.as_py(), w.as_py(), t.as_py() or []) for h, w, t in zip(*(batch.column(c) for c in ("html", "wrapper", "template")), strict=True)]
        return pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return common.arrow_map(with_wrappers(rows, wrappers).select("page_id", "url", "html", "wrapper", "template"), each, f"page_id {kind}, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(common.read(spark, sf_dir, "pages"))
