"""Main text of web pages: a style tree per site tells the article from what surrounds it."""

from __future__ import annotations

import functools
import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.llm.common import staged
from kgspark.llm.url_filter import host_and_path
from kgspark.session import spread, tune

# Each further style of an element lets its children count for more, its own look for less.
DAMPING = 0.9
LEAST_IMPORTANCE = 0.35
# Entropy says nothing of what is seen on fewer pages.
LEAST_PAGES = 3

# Elements of HTML by how they take part in a page's layout.
BLOCKS = frozenset(
    """address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form
    frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol optgroup option p pre section
    summary table tbody tfoot thead title tr ul""".split()
)
CELLS = frozenset("td th caption".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HEAD = frozenset("base link meta noscript script style template title".split())
# Elements that a start tag of the same list ends.
SIBLINGS = [frozenset(x.split()) for x in ("li", "dd dt", "option", "optgroup", "tr", "td th", "tbody thead tfoot")]
LIST_OF = {"li": "ul ol menu dir", "dd": "dl", "dt": "dl", "option": "select", "optgroup": "select", "tr": "table", "td": "table tr", "th": "table tr"}
LIST_OF |= dict.fromkeys(("tbody", "thead", "tfoot"), "table")
MAIN = frozenset(["article", "main"])

# What is not the article, by element, by role, and by words in class and id.
ASIDE_TAGS = frozenset(
    """aside audio button canvas datalist dialog embed footer form frameset head iframe input map menu nav noembed noframes
    noscript object script select style svg template textarea title video""".split()
)
ASIDE_ROLES = frozenset(
    "alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search tablist toolbar".split()
)
ASIDE_WORDS = frozenset(
    """ad adbox ads adsense adslot adunit advert advertisement advertising adverts alert announcement banner breadcrumb
    breadcrumbs captcha carousel comment commentlist comments consent cookie cookies copyright disclaimer discussion disqus
    dropdown feedback footer gdpr leaderboard login masthead menu modal nav navbar navigation newsletter notice notices
    notification outbrain overlay pager pagination paywall popup promo promoted promotion recommended related replies reply
    respond search share sharing sidebar sidenav signin signup skyscraper social sponsor sponsored subnav subscribe subscription
    taboola toolbar topbar topnav widget widgets""".split()
)
# Such a word next to these says what a page has, not what an element is.
MODIFIERS = frozenset("has no with without hide is".split())
COMMENT_WORDS = frozenset("comment comments commentlist discussion disqus replies reply respond".split())

_TOKEN = re.compile(
    r"""<!--.*?(?:--!?>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|<[!?/][^>]*(?:>|\Z)"""
    r"""|<([a-zA-Z][^\s/>]*)((?:[^>"'=]+|=\s*"[^"]*"|=\s*'[^']*'|["'=])*+)(?:>|\Z)""",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""")
_DIGITS = re.compile(r"\d+")
# Numbers in names that count pages rather than tell looks apart.
_SERIAL = re.compile(r"\d{2,}")
_LETTERS = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


@functools.lru_cache(10_000)
def _words(names: str) -> frozenset[str]:
    """Words in the classes and the id of an element, and each name as one word; what a name says the page has is left out."""
    out: set[str] = set()
    for name in names.split():
        words = _LETTERS.findall(name)
        if MODIFIERS.isdisjoint(words):
            out.update(words, ["".join(words)])
    return frozenset(out)


class Node:
    __slots__ = ("tag", "label", "parent", "children", "block", "aside", "main", "in_main", "plain", "key")

    def __init__(self, tag: str, names: str, role: str, parent: Node | None):
        self.tag, self.parent = tag, parent
        self.label = f"{tag}.{names}" if names else tag
        self.children: list[Node | str] = []
        self.block = tag in BLOCKS or tag in CELLS or parent is None
        words = _words(names) if names else frozenset()
        named = not words.isdisjoint(ASIDE_WORDS)
        remarks = not words.isdisjoint(COMMENT_WORDS)
        self.main = tag in MAIN and not remarks
        self.in_main = self.main or (parent is not None and parent.in_main)
        # what an element of the article looks like without a class of its own
        self.plain = self.main or (parent is not None and parent.plain and not names)
        header = (tag == "header" or "header" in words and tag not in ("html", "body")) and not self.in_main
        self.aside = tag in ASIDE_TAGS or header or role in ASIDE_ROLES or (named and tag not in ("html", "body", "main") and not self.main)
        self.key = 0


def parse(page: str) -> Node:
    """The elements of a page, as forgiving as browsers are with tags left open or closed twice.

    Comments, declarations and tags cut off by the end of the page are left out.
    """
    root = Node("#root", "", "", None)
    stack = [root]
    is_open: dict[str, int] = {}

    def close_to(depth: int) -> None:
        while len(stack) > depth:
            is_open[stack.pop().tag] -= 1

    def close_among(tags: frozenset[str] | tuple[str, ...], within: str = "") -> None:
        """Close the nearest open one of ``tags``, unless one of ``within`` or a cell's border is nearer."""
        if not any(is_open.get(t) for t in tags):
            return
        borders = within.split()
        for depth in range(len(stack) - 1, 0, -1):
            tag = stack[depth].tag
            if tag in tags:
                close_to(depth)
                return
            if tag in borders or tag in CELLS and not borders:
                return

    at, end = 0, len(page)
    while at < end:
        mark = page.find("<", at)
        if mark < 0:
            mark = end
        if mark > at:
            stack[-1].children.append(page[at:mark])
        if mark == end:
            break
        token = _TOKEN.match(page, mark)
        if token is None:
            stack[-1].children.append("<")
            at = mark + 1
            continue
        at = token.end()
        closes, opens, attributes = token.groups()
        if closes:
            tag = closes.lower()
            if tag == "br":
                stack[-1].children.append(" ")
            elif tag == "p" and not is_open.get("p"):
                stack[-1].children.append(Node("p", "", "", stack[-1]))
            elif is_open.get(tag):
                inline = tag not in BLOCKS and tag not in CELLS
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth].tag == tag:
                        close_to(depth)
                        break
                    # a mark-up tag closes nothing beyond its block
                    if inline and stack[depth].block:
                        break
        elif opens and token.group().endswith(">"):
            tag = opens.lower()
            if tag in BLOCKS and is_open.get("p"):
                close_among(("p",))
            if is_open.get("head") and tag not in HEAD and tag != "head":
                close_among(("head",))
            for group in SIBLINGS:
                if tag in group:
                    close_among(group, LIST_OF[tag])
            if tag in ("html", "body") and is_open.get(tag):
                continue
            names = role = ""
            if attributes and "=" in attributes:
                found = {m[1].lower(): _CAMEL.sub("-", m[2] or m[3] or m[4] or "").lower() for m in _ATTRIBUTE.finditer(attributes)}
                names = " ".join(sorted({*found.get("class", "").split(), *found.get("id", "").split()}))
                names, role = _SERIAL.sub("0", names), found.get("role", "")
            node = Node(tag, names, role, stack[-1])
            stack[-1].children.append(node)
            if tag in VOID or (attributes or "").endswith("/") and tag not in BLOCKS and tag not in RAW:
                continue
            if tag in RAW:
                close = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)", re.I).search(page, at)
                at = close.start() if close else end
            stack.append(node)
            is_open[tag] = is_open.get(tag, 0) + 1
    return root


def _walk(root: Node) -> Iterator[Node]:
    todo = [root]
    while todo:
        node = todo.pop()
        yield node
        todo += [c for c in reversed(node.children) if isinstance(c, Node)]


def mark_containers(root: Node) -> None:
    """If every article stands inside something named as an aside by its class, that is a frame around it.

    The same goes for a form around the whole page.
    """
    mains = [n for n in _walk(root) if n.main]

    def frames(node: Node) -> list[Node]:
        out = []
        while node.parent is not None:
            node = node.parent
            if node.aside:
                out.append(node)
        return out

    around = [frames(n) for n in mains]
    if mains and all(around):
        for node in {n for found in around if all(n.tag == "form" or n.tag not in ASIDE_TAGS for n in found) for n in found}:
            node.aside = False


class _Keys:
    """Places of the style tree: a path of elements, each under one style of the element above."""

    def __init__(self, most: int = 200_000):
        self.known: dict[tuple, int] = {}
        self.most = most

    def of(self, *parts) -> int:
        found = self.known.get(parts)
        if found is None:
            if len(self.known) >= self.most:
                self.known.clear()
            found = self.known[parts] = xxhash.xxh64_intdigest("\x1f".join(map(str, parts))) - (1 << 63)
        return found


def _shown(node: Node) -> list[Node | str]:
    """Children as the style tree takes them: inline mark-up belongs to the text around it."""
    out: list[Node | str] = []
    todo = list(reversed(node.children))
    while todo:
        child = todo.pop()
        if isinstance(child, str) or child.block:
            out.append(child)
        elif child.tag not in ASIDE_TAGS:
            todo += reversed(child.children)
    return out


def place(root: Node, site: int, keys: _Keys) -> Iterator[tuple]:
    """Give block elements their places; yields (place, above, style above, depth, own style or text, letters, linked letters).

    A style is the sequence of the children's looks, repeats of one look taken once, so that articles
    of any length share theirs. Text is a child like others; its letters are compared, digits masked.
    """
    root.key = site
    todo: list[tuple[Node, int, int, int]] = [(root, 0, 0, 0)]
    while todo:
        node, above, above_style, depth = todo.pop()
        shown = _shown(node)
        texts = " ".join(" ".join(c for c in shown if isinstance(c, str)).split())
        looks: list[str] = []
        for child in shown:
            look = child.label if isinstance(child, Node) else "#text" if child.strip() else ""
            if look and look not in looks[-1:]:
                looks.append(look)
        style = keys.of("style", *looks)
        yield node.key, above, above_style, depth, style, 0, 0
        if texts:
            text = _DIGITS.sub("0", texts)
            linked = min(len(texts), sum(len(t) for t in _linked(node)))
            yield keys.of(node.key, style, "#text"), node.key, style, depth + 1, xxhash.xxh64_intdigest(text) - (1 << 63), len(texts), linked
        for child in shown:
            if isinstance(child, Node):
                child.key = keys.of(node.key, style, child.label)
                todo.append((child, node.key, style, depth + 1))


def _linked(node: Node) -> Iterator[str]:
    """Text of the links that stand in an element's own text."""
    todo: list[tuple[Node, bool]] = [(node, False)]
    while todo:
        at, inside = todo.pop()
        for child in at.children:
            if isinstance(child, str):
                if inside:
                    yield " ".join(child.split())
            elif not child.block:
                todo.append((child, inside or child.tag == "a"))


def main_text(root: Node, noise: set[int]) -> str:
    """Blocks of the page outside asides and noise, or of its article alone where it has one."""
    blocks: list[str] = []
    of_main: list[str] = []
    open_block: list[str] = []

    def finish(in_main: bool) -> None:
        text = " ".join(entities.unescape("".join(open_block)).split())
        open_block.clear()
        if text:
            blocks.append(text)
            if in_main:
                of_main.append(text)

    # borders between blocks are told from text by being None
    todo: list[Node | str | None] = [root]
    inside: list[Node] = []
    while todo:
        item = todo.pop()
        if item is None:
            node = inside.pop()
            finish(node.in_main)
        elif isinstance(item, str):
            open_block.append(item)
        elif item.aside or (item.key in noise and not item.plain and item.block):
            if item.block and inside:
                finish(inside[-1].in_main)
        elif item.tag == "br" or item.tag in CELLS:
            open_block.append(" ")
            todo += [" ", *reversed(item.children)] if item.children else []
        elif item.block:
            if inside:
                finish(inside[-1].in_main)
            inside.append(item)
            todo += [None, *reversed(item.children)]
        else:
            todo += reversed(item.children)
    return "\n\n".join(of_main or blocks)


_TREE = "site long, place long, above long, above_style long, depth int, style long, is_text boolean, letters long, linked long, count long"


def _read(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    host, _ = host_and_path(F.col(url_col))
    return spread(pages.select(F.xxhash64(host).alias("site"), F.col(html_col).alias("html")))


def style_tree(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The style trees of all sites: one row per text place, and per element place and style.

    Returns ``site``, ``place``, ``above``, ``above_style`` (the place and style it stands under),
    ``depth``, ``style`` (null for text), ``count`` (how often it is seen), ``count_log`` (for text the
    sum of c ln c over its different texts, else c ln c), ``letters`` and ``linked`` of text. Pages are
    merged by hashes, so a site with a third of all pages is one key to no task.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = _Keys()
        for batch in batches:
            counts: dict[tuple, list[int]] = {}
            for site, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                root = parse(html or "")
                seen = set()
                for key, above, above_style, depth, value, letters, linked in place(root, site, keys):
                    row = (site, key, above, above_style, depth, value, letters > 0)
                    if row not in seen:
                        seen.add(row)
                        sums = counts.setdefault(row, [0, 0, 0])
                        sums[0] += letters
                        sums[1] += linked
                        sums[2] += 1
            columns = list(zip(*[(*row, *sums) for row, sums in counts.items()])) or [[]] * 10
            types = [pa.int64()] * 4 + [pa.int32(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64()]
            names = [c.split()[0] for c in _TREE.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    rows = _read(pages, url_col, html_col).mapInArrow(work, _TREE)
    where = ["site", "place", "above", "above_style", "depth"]
    seen = rows.groupBy("place", "is_text", "style").agg(
        *[F.first(c).alias(c) for c in where if c != "place"], *[F.sum(c).alias(c) for c in ("letters", "linked", "count")]
    )
    return (
        seen.withColumn("style", F.when(~F.col("is_text"), F.col("style")))
        .groupBy("place", "is_text", "style")
        .agg(
            *[F.first(c).alias(c) for c in where if c != "place"],
            *[F.sum(c).alias(c) for c in ("letters", "linked", "count")],
            F.sum(F.col("count") * F.log("count")).alias("count_log"),
        )
    )


def _variety(count, count_log):
    """Entropy over its greatest value: 0 if all are the same, 1 if all differ or few were seen."""
    return F.when(count < LEAST_PAGES, F.lit(1.0)).otherwise(1 - count_log / (count * F.log(count)))


def importance(tree: DataFrame) -> DataFrame:
    """``site``, ``place``, ``importance``, ``highest`` of all places; ``tree`` is staged.

    Text counts by the entropy of its contents, less the share of its letters that are links. An
    element counts by the entropy of its styles and the mean importance of what is in them, weighted
    by how often each is seen: (1 - 0.9 ** l) of the former with l styles, 0.9 ** l of the latter.
    ``highest`` is the greatest importance in the branch. Worked out from the deepest places upwards.
    """
    columns = ["site", "place", "above", "above_style", "importance", "highest"]
    by_text = _variety(F.col("count"), F.col("count_log")) * (1 - F.col("linked") / F.col("letters"))
    texts = tree.filter("is_text").withColumn("importance", by_text).withColumn("highest", F.col("importance"))
    elements = tree.filter("NOT is_text")
    deepest = tree.agg(F.max("depth")).first()[0]
    levels = []
    below = None
    for depth in range(-1 if deepest is None else deepest, -1, -1):
        here = elements.filter(F.col("depth") == depth)
        if below is None:
            here = here.withColumn("inner", F.lit(0.0)).withColumn("top", F.lit(0.0))
        else:
            inner = below.groupBy("above", "above_style").agg(F.avg("importance").alias("inner"), F.max("highest").alias("top"))
            inner = inner.withColumnsRenamed({"above": "place", "above_style": "style"})
            here = here.join(inner, ["place", "style"], "left").fillna(0.0, ["inner", "top"])
        merged = here.groupBy("place").agg(
            *[F.first(c).alias(c) for c in ("site", "above", "above_style")],
            F.sum("count").alias("count"),
            F.sum("count_log").alias("count_log"),
            F.count("*").alias("styles"),
            (F.sum(F.col("count") * F.col("inner")) / F.sum("count")).alias("inner"),
            F.max("top").alias("top"),
        )
        kept = F.pow(F.lit(DAMPING), F.col("styles"))
        own = (1 - kept) * _variety(F.col("count"), F.col("count_log")) + kept * F.col("inner")
        scored = merged.withColumn("importance", own).withColumn("highest", F.greatest("importance", "top"))
        below = staged(scored.select(columns).unionByName(texts.filter(F.col("depth") == depth).select(columns)), "style-level")
        levels.append(below)
    if not levels:
        return texts.select("site", "place", "importance", "highest")
    found = levels[0]
    for level in levels[1:]:
        found = found.unionByName(level)
    return found.select("site", "place", "importance", "highest")


def extract_main_text(
    pages: DataFrame, url_col: str = "url", html_col: str = "html", text_col: str = "text", least: float = LEAST_IMPORTANCE
) -> DataFrame:
    """``pages`` with ``text_col``: the article of each page, blocks joined by an empty line.

    The pages of a host are merged into a style tree: elements under the same look of what is above
    them are one place, with the styles and the texts seen there. Places whose whole branch is of an
    importance below ``least`` are noise, and their branches are taken out of each page. Two things
    stand beside the entropies, as many sites vary their menus and adverts from page to page: branches
    that their element, role, class or id names as menu, header, footer, sidebar, notice, advert, form,
    comments or the like are of no importance; and elements without a class of their own in the page's
    ``article`` or ``main`` are never noise. A page that has such an element gives its text alone. A
    page that would lose all its text to noise keeps what the names leave.

    Character references are decoded, white space in a block becomes one space. Null or empty pages,
    and pages without text, give an empty string. A null URL or one without a host belongs to the site
    of no name. Repeated rows are rows like others, and all columns but ``html_col`` are kept (one
    named like ``text_col`` is replaced). Whole pages are read, each by one task. An empty table gives no rows.
    """
    tune(pages.sparkSession)
    tree = staged(style_tree(pages, url_col, html_col), "style-tree")
    noise = importance(tree).filter(F.col("highest") < least).groupBy("site").agg(F.collect_list("place").alias("noise"))
    noise = staged(noise, "style-noise")
    kept = [c for c in pages.columns if c.lower() != text_col.lower()]
    numbered = [F.col(c).alias(f"c{i}") for i, c in enumerate(kept)]
    host, _ = host_and_path(F.col(url_col))
    rows = spread(pages.select(*numbered, F.xxhash64(host).alias("site"), F.col(html_col).alias("html"))).join(noise, "site", "left")
    inputs = rows.select("site", "html", "noise", *[f"c{i}" for i in range(len(kept)) if kept[i] != html_col])
    fields = inputs.drop("site", "html", "noise").schema.add("text", "string")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = _Keys()
        sets: dict[int, set[int]] = {}
        for batch in batches:
            texts = []
            found = batch.column(2)
            for i, (site, html) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                if site not in sets:
                    if len(sets) >= 1_000:
                        sets.clear()
                    sets[site] = set(found[i].as_py() or ())
                root = parse(html or "")
                mark_containers(root)
                noisy = sets[site]
                if noisy:
                    for _ in place(root, site, keys):
                        pass
                texts.append(main_text(root, noisy) or main_text(root, set()) if noisy else main_text(root, noisy))
            yield pa.RecordBatch.from_arrays([*batch.columns[3:], pa.array(texts, pa.string())], names=[f.name for f in fields])

    out = inputs.mapInArrow(work, fields)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(kept) if c != html_col], F.col("text").alias(text_col))
