"""HTML extraction by wrappers: union-free regular expressions over the blocks of a host's pages.

The pages of a host are aligned one after the other. Where they agree, the
expression keeps a block; where one lacks it, the block becomes optional; where
it comes again, or blocks come in another order, they become a repeated group;
where texts differ, there is a slot. Beside it an expression counts what its
slots held: so constant text, menus and the article can be told apart on pages
that mark none of them. Expressions merge in any order with the same blocks and
counts (only how repeated groups are drawn may differ), so they are inferred
where the pages lie and only expressions travel.
"""

from __future__ import annotations

import functools
import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .page_tree import Element, parse
from .runtime import Steps, arrow_batches, spread, whole_text

#: Different blocks next to each other, and blocks in all, beyond which an expression tells them apart by less.
MOST_BESIDE, MOST_BLOCKS = 64, 2_000
#: By class and shape, by name, not at all.
FINE, BY_NAME, ALL_ALIKE = 0, 1, 2
#: Blocks of expressions that a task holds before it hands them on, expressions merged into one at a time, bytes that are broadcast.
HELD, FAN, FEW_BYTES = 50_000, 16, 16 << 20
#: Pages before equal text counts as the host's own, and the share of linked characters that makes a menu.
LEAST_PAGES, LINKED = 3, 0.7

SLOT = "#"


def host_of(url: Column) -> Column:
    """The host of an absolute URL in lower case, else the empty string: such pages are one host."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


class Slot:
    """Texts at one place: held by so many blocks, texts in all, pages, characters, linked ones, and the digest if all pages have the same."""

    __slots__ = ("has", "total", "run", "pages", "chars", "linked", "digest")

    def __init__(self, has=1, total=1, run=0, pages=1, chars=0, linked=0, digest=None):
        self.has, self.total, self.run = has, total, run
        self.pages, self.chars, self.linked, self.digest = pages, chars, linked, digest

    def pack(self) -> list:
        return [self.has, self.total, self.run, self.pages, self.chars, self.linked, self.digest]


class Block:
    """A place for elements: held by so many blocks, elements in all, the repeated group it is in, and what may stand inside."""

    __slots__ = ("has", "total", "run", "kind", "items")

    def __init__(self, has=1, total=1, run=0, kind="", items=None):
        self.has, self.total, self.run, self.kind, self.items = has, total, run, kind, items or {}

    def pack(self) -> list:
        return [self.has, self.total, self.run, self.kind, [[k, v.pack()] for k, v in self.items.items()]]


def unpack(x: list) -> Slot | Block:
    return Slot(*x) if len(x) == 7 else Block(*x[:4], {k: unpack(v) for k, v in x[4]})


def size(block: Block) -> tuple[int, int]:
    """(blocks and slots, most of them next to each other)"""
    n, most = 1, len(block.items)
    for v in block.items.values():
        if isinstance(v, Block):
            a, b = size(v)
            n, most = n + a, max(most, b)
        else:
            n += 1
    return n, most


def label(element: Element, level: int) -> str:
    """Under which name a block is aligned. A kind is always told apart."""
    if level == FINE:
        shape = ",".join(sorted({c.tag for c in element.children if isinstance(c, Element)}))[:60] if element.kind != "drop" and element.tag in ("div", "section", "td", "center", "dd") else ""
        return f"{element.tag}|{element.kind}|{element.mark}|{shape}"
    return f"{element.tag if level == BY_NAME else '*'}|{element.kind}"


def coarser(name: str, level: int) -> str:
    tag, kind = name.split("|")[:2]
    return name if level == FINE else f"{tag if level == BY_NAME else '*'}|{kind}"


def _aligned(a: list[str], b: list[str]) -> list[str]:
    """Both sequences in one: a longest common subsequence, and what only one has between; a name comes twice where orders differ."""
    if a == b:
        return a
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            table[i][j] = table[i + 1][j + 1] + 1 if a[i] == b[j] else max(table[i + 1][j], table[i][j + 1])
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out.append(a[i])
            i, j = i + 1, j + 1
        elif table[i + 1][j] >= table[i][j + 1]:
            out.append(a[i])
            i += 1
        else:
            out.append(b[j])
            j += 1
    return out + a[i:] + b[j:]


def _runs(line: list[str], known: list[dict[str, int]]) -> dict[str, int]:
    """The repeated group of each name, 0 for none: what lies between two places of a name, and groups known before, with all between."""
    spans = []
    places: dict[str, list[int]] = {}
    for at, name in enumerate(line):
        places.setdefault(name, []).append(at)
    spans += [(p[0], p[-1]) for p in places.values() if p[-1] > p[0]]
    for runs in known:
        groups: dict[int, list[int]] = {}
        for name, run in runs.items():
            if run:
                groups.setdefault(run, []).extend(places[name])
        spans += [(min(g), max(g)) for g in groups.values()]
    out = dict.fromkeys(places, 0)
    run, reach = 0, -1
    for start, stop in sorted(spans):
        if start > reach:
            run, reach = run + 1, stop
        reach = max(reach, stop)
        for name in line[start : stop + 1]:
            out[name] = run
    return out


def _beside(digest: str | None, other: str | None) -> str | None:
    """The digest of two texts of one page."""
    return hashlib.blake2b(f"{digest} {other}".encode(), digest_size=8).hexdigest()


def merge(a: Block, b: Block, same_page: bool = False) -> Block:
    """One expression for what either describes; blocks of one page also join the texts of a slot."""
    a_runs, b_runs = ({k: v.run for k, v in x.items.items()} for x in (a, b))
    line = _aligned(list(a.items), list(b.items))
    runs = _runs(line, [a_runs, b_runs])
    items: dict = {}
    for name in dict.fromkeys(line):
        x, y = a.items.get(name), b.items.get(name)
        if x is None or y is None:
            items[name] = x or y
        elif isinstance(x, Slot):
            pages = max(x.pages, y.pages) if same_page else x.pages + y.pages
            digest = _beside(x.digest, y.digest) if same_page else x.digest if x.digest == y.digest else None
            items[name] = Slot(x.has + y.has, x.total + y.total, 0, pages, x.chars + y.chars, x.linked + y.linked, digest)
        else:
            items[name] = merge(x, y, same_page)
            items[name].has, items[name].total = x.has + y.has, x.total + y.total
        items[name].run = runs[name]
    return Block(a.has, a.total, a.run, a.kind, items)


def fold(element: Element, level: int) -> Block:
    """The expression of one block of a page: children of one name are one item, repeated if they come again."""
    line, items = [], {}
    for child in element.children:
        if isinstance(child, Element):
            name = label(child, level)
            new = Block(kind=child.kind) if child.kind == "drop" else fold(child, level)
        else:
            text = " ".join("".join(child[0]).split())
            if not text:
                continue
            name, new = SLOT, Slot(chars=len(text), linked=child[1], digest=hashlib.blake2b(text.encode(), digest_size=8).hexdigest())
        if not line or line[-1] != name:
            line.append(name)
        if name not in items:
            items[name] = new
        elif isinstance(new, Slot):
            old = items[name]
            items[name] = Slot(1, old.total + 1, 0, 1, old.chars + new.chars, old.linked + new.linked, _beside(old.digest, new.digest))
        else:
            total = items[name].total + 1
            items[name] = merge(items[name], new, same_page=True)
            items[name].has, items[name].total = 1, total
    for name, run in _runs(line, []).items():
        items[name].run = run
    return Block(kind=element.kind, items=items)


def relabelled(block: Block, level: int) -> Block:
    """The expression with blocks told apart by less."""
    line, items = [], {}
    runs: list[dict[str, int]] = [{}]
    for name, item in block.items.items():
        new = name if name == SLOT else coarser(name, level)
        line.append(new)
        runs[0][new] = max(runs[0].get(new, 0), item.run)
        value = item if isinstance(item, Slot) else relabelled(item, level)
        if new in items:
            has, total = max(items[new].has, value.has), items[new].total + value.total
            items[new] = merge(items[new], value, same_page=True)
            items[new].has, items[new].total = has, total
        else:
            items[new] = value
    for name, run in _runs(line, runs).items():
        items[name].run = run
    return Block(block.has, block.total, block.run, block.kind, items)


class Wrapper:
    """The expression of a host's pages, at the finest level at which it stays small."""

    def __init__(self, pages: int, level: int, root: Block):
        self.pages, self.level, self.root = pages, level, root

    @classmethod
    def of(cls, tree: Element, level: int = FINE) -> Wrapper:
        return cls(1, level, fold(tree, level)).bounded()

    @classmethod
    def read(cls, text: str) -> Wrapper:
        pages, level, root = json.loads(text)
        return cls(pages, level, unpack(root))

    def write(self) -> str:
        return json.dumps([self.pages, self.level, self.root.pack()], separators=(",", ":"))

    def bounded(self) -> Wrapper:
        while self.level < ALL_ALIKE:
            n, most = size(self.root)
            if n <= MOST_BLOCKS and most <= MOST_BESIDE:
                break
            self.level += 1
            self.root = relabelled(self.root, self.level)
        return self

    def add(self, other: Wrapper) -> Wrapper:
        level = max(self.level, other.level)
        a, b = (w.root if w.level == level else relabelled(w.root, level) for w in (self, other))
        root = merge(a, b)
        root.has, root.total = a.has + b.has, a.total + b.total
        return Wrapper(self.pages + other.pages, level, root).bounded()

    def expression(self) -> str:
        """The regular expression, as text: ! for what is dropped, #text for slots, =text for constant ones."""

        def inside(block: Block) -> str:
            parts, open_run = [], 0
            for name, x in [*block.items.items(), ("", None)]:
                run = x.run if x else 0
                if open_run and run != open_run:
                    parts.append(")+ ")
                    open_run = 0
                if x is None:
                    break
                if run and not open_run:
                    parts.append("(")
                    open_run = run
                tag, _, rest = name.partition("|")
                mark = rest.split("|")[1] if rest.count("|") else ""
                if isinstance(x, Slot):
                    word = "=text" if x.digest and x.pages > 1 else "#text"
                else:
                    word = f"{tag}{'.' + mark.replace(' ', '.') if mark else ''}" + ("!" if x.kind == "drop" else f"({inside(x)})" if x.items else "")
                if not run and x.total > x.has:
                    word = f"({word})+"
                parts.append(word + ("?" if x.has < block.total else "") + " ")
            return "".join(parts).replace(" )", ")").strip()

        return inside(self.root)


class Reader:
    """What of a page is its main text, by the wrapper of its host."""

    def __init__(self, wrapper: Wrapper):
        self.wrapper = wrapper
        slots: list[Slot] = []

        def walk(block: Block) -> None:
            for x in block.items.values():
                if isinstance(x, Slot):
                    slots.append(x)
                elif x.kind != "drop":
                    walk(x)

        walk(wrapper.root)
        same = [s for s in slots if s.digest and s.pages >= LEAST_PAGES]
        chars, own = sum(s.chars for s in slots), sum(s.chars for s in same)
        #: Text of the host, not of the page; unless the pages are mostly copies of each other.
        self.constant = {id(s) for s in same} if own * 2 < chars else set()

    def text(self, tree: Element) -> str:
        out: list[str] = []
        goal = next((k for k in ("article", "main") if _has(tree, k)), None)

        def take(element: Element) -> None:
            for c in element.children:
                if not isinstance(c, Element):
                    out.extend(c[0])
                elif c.kind != "drop":
                    take(c)

        def seek(element: Element) -> None:
            for c in element.children:
                if isinstance(c, Element) and c.kind != "drop":
                    (take if c.kind == goal else seek)(c)

        def weigh(element: Element, block: Block | None) -> None:
            for c in element.children:
                if isinstance(c, Element):
                    inner = block.items.get(label(c, self.wrapper.level)) if block else None
                    if c.kind != "drop" and not (inner and _is_menu(inner)):
                        weigh(c, inner)
                elif not block or id(block.items.get(SLOT)) not in self.constant:
                    out.extend(c[0])

        if goal:
            seek(tree)
        else:
            weigh(tree, self.wrapper.root)
        return " ".join("".join(out).split())


def _has(element: Element, kind: str) -> bool:
    return any(c.kind == kind or (c.kind != "drop" and _has(c, kind)) for c in element.children if isinstance(c, Element))


def _is_menu(block: Block) -> bool:
    """A list that is mostly links, on all pages of the host together."""

    def sums(b: Block) -> tuple[int, int]:
        linked = chars = 0
        for x in b.items.values():
            a, c = (x.linked, x.chars) if isinstance(x, Slot) else sums(x) if x.kind != "drop" else (0, 0)
            linked, chars = linked + a, chars + c
        return linked, chars

    items = any(name.startswith("li|") or (isinstance(x, Block) and _is_list(x)) for name, x in block.items.items())
    linked, chars = sums(block) if items else (0, 0)
    return chars > 0 and linked >= LINKED * chars


def _is_list(block: Block) -> bool:
    return any(name.startswith("li|") or (isinstance(x, Block) and _is_list(x)) for name, x in block.items.items())


def _inferred(held: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, known, blocks = TaskContext.get().partitionId(), {}, 0
        for batch in batches:
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                new = Wrapper.of(parse(page), known[host].level if host in known else FINE)
                if host in known:
                    known[host] = known[host].add(new)
                else:
                    known[host] = new
                    blocks += size(new.root)[0]
            if blocks > held:
                yield _rows(known, part)
                known, blocks = {}, 0
        yield _rows(known, part)

    return run


def _rows(known: dict, part: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(list(known), pa.string()), pa.array([part] * len(known), pa.int64()), pa.array([w.pages for w in known.values()], pa.int64()), pa.array([w.write() for w in known.values()], pa.string())],
        names=["host", "part", "pages", "wrapper"],
    )


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One expression for the rows of each host and part, which come in this order."""
    key, wrapper, out = None, None, []
    for batch in batches:
        for host, part, text in zip(*(batch.column(c).to_pylist() for c in ("host", "part", "wrapper"))):
            new = Wrapper.read(text)
            if (host, part) == key:
                wrapper = wrapper.add(new)
                continue
            if key is not None:
                out.append((*key, wrapper))
            key, wrapper = (host, part), new
        for host, part, w in out:
            yield _rows({host: w}, part)
        out = []
    if key is not None:
        yield _rows({key[0]: wrapper}, key[1])


WRAPPERS = "host string, part bigint, pages bigint, wrapper string"


def infer(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """host, pages, wrapper: one row per host, its expression as JSON (see Wrapper).

    Every page counts. Pages with null, relative or broken URLs share the host
    "". Tasks send an expression for each host; these are merged sixteen at a
    time, so that no task gets all of a host with many pages.
    """
    spark = pages.sparkSession
    arrow_batches(spark)
    steps = Steps(spark)
    out = _infer(spread(pages.select(host_of(F.col(url_col)).alias("host"), whole_text(html_col).alias("html"))), steps)
    return steps.end(out.select("host", "pages", "wrapper"), "wrappers")


def _infer(hosted: DataFrame, steps: Steps) -> DataFrame:
    found = steps.cut(hosted.mapInArrow(_inferred(HELD), WRAPPERS), "wrapper-parts")
    while True:
        most = found.groupBy("host").count().agg(F.max("count")).first()[0] or 0
        if most <= 1:
            return found
        slot = F.pmod(F.xxhash64("part", "wrapper"), F.lit(-(-most // FAN)))
        found = steps.next(found.select("host", slot.alias("part"), "pages", "wrapper").repartition("host", "part").sortWithinPartitions("host", "part", "wrapper").mapInArrow(_merged, WRAPPERS), "wrapper-parts")


@functools.lru_cache(64)
def _reader(text: str) -> Reader:
    return Reader(Wrapper.read(text))


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        wrappers = [_reader(w) for w in batch.column("wrapper").to_pylist()]
        texts = [r.text(parse(page)) for r, page in zip(wrappers, batch.column("html").to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars: one row per input row, text being the main text of its page.

    On pages that mark it, that is what their <article> elements hold, or else
    <main>; on others, all of the page but what the host's wrapper shows to be a
    menu (lists of links) or the host's own text (equal on three pages and more).
    Left out in either case: navigation, headers of the page, footers, asides,
    forms, scripts, styles, reader comments, and blocks whose role, class or id
    names them as such, as advertising or as a notice. A block named so that
    holds the page's only article is a frame around it, and stays. Character
    references are decoded, white space in a block becomes one space, and blocks
    are joined by one. Text of hidden elements counts; a page without main text
    has the empty string.

    Null html is empty, null and broken URLs share one host. Repeated rows are
    rows each; an empty table gives an empty result. Other columns are ignored.
    Blocks nested deeper than 60 are taken as text of the 60th.
    """
    spark = pages.sparkSession
    arrow_batches(spark)
    steps = Steps(spark)
    types = {c: pages.schema[c].dataType.simpleString() for c in (id_col, url_col)}
    hosted = spread(pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), host_of(F.col(url_col)).alias("host"), whole_text(html_col).alias("html")))
    wrappers = _infer(hosted.select("host", "html"), steps).select("host", "wrapper")
    held = wrappers.agg(F.coalesce(F.sum(F.octet_length("wrapper") + F.octet_length("host") + 64), F.lit(0))).first()[0]
    both = hosted.join(F.broadcast(wrappers) if held <= FEW_BYTES else wrappers, "host")
    return steps.end(both.select("page_id", "url", "html", "wrapper").mapInArrow(_texts, f"page_id {types[id_col]}, url {types[url_col]}, text string, n_chars bigint"), "page-texts")
