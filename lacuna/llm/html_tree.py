"""HTML main text: a style tree per site weighs every branch; what markup itself says enters as a prior."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_narrow, materialise, small_batches, small_slices, table
from .reputation import domain_of, host_of

#: Elements without content, those whose content is raw text, and those whose text is never the page's prose.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template xmp noembed noframes".split())
NEVER = RAW | frozenset("head nav aside footer form button select option datalist dialog menu svg math canvas audio video object map".split())
#: Of these, the ones that stay out even where priors are switched off: they hold no text of the page.
UNSEEN = RAW | {"head"}
#: Dropped inside a word without parting it.
JOINING = frozenset("script style template noscript".split())
#: Elements that run inside a line; all others begin and end a block.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
#: Words of class, id or role that name branches beside the article.
ASIDE = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising banner breadcrumb breadcrumbs comment comments commentlist complementary consent contentinfo cookie cookies "
    "disqus footer gdpr masthead menu modal nav navbar navigation newsletter notice notices notification pagination popup promo promoted promotion related respond search share sharing sidebar signup "
    "skip social sponsor sponsored subscribe subscription toolbar widget".split()
)
COMMENTS = frozenset(("comment", "comments", "commentlist"))
CLOSES_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
#: Block elements that a new element of the kind ends.
ENDS = {**dict.fromkeys(CLOSES_P, ("p",)), "li": ("li", "p"), "td": ("td", "th", "p"), "th": ("td", "th", "p"), "tr": ("td", "th", "tr", "p")}
#: Weight of a node's own style entropy against its children, and the importance under which a branch goes.
GAMMA, LEAST_IMPORTANCE = 0.9, 0.8
#: Pages from which a host has a tree of its own; smaller ones share that of their registered domain.
HOST_PAGES = 256
#: Pages from which on a site's tree decides what its pages' text is.
TREE_PAGES = 256
#: Largest table of node weights (in rows) that is sent to every task; larger ones meet the nodes of pages in a join.
SENT_ROWS = 400_000
#: Counted features that a task holds before it passes them on.
HELD_FEATURES = 300_000
#: Parts into which the weights are dealt where they are joined, so that the nodes of one large site are many keys.
SALTS = 16

_TAG = re.compile(r"(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_PLAIN_TAG = re.compile(r"(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_ATTR = re.compile(r"(class|id|role|itemprop|hidden|aria-hidden|style)(?=[\s=/]|\Z)(?:\s*+=\s*+(\"[^\"]*+\"|'[^']*+'|[^\s\"'>]++))?", re.I)
_WORD = re.compile(r"[a-z]+")
_NONE = re.compile(r"display\s*:\s*none")
_DIGITS = re.compile(r"\d+")

#: What markup says of a node.
HARD, BY_NAME, ARTICLE, NAMED, COMMENT, RAW_MARK = 1, 2, 4, 8, 16, 32


class Page:
    """A page's tree as arrays in page order (a parent stands before its children), and its text pieces with the node that holds each."""

    __slots__ = ("keys", "marks", "owners", "parents", "pieces", "tags")

    def __init__(self, site: str) -> None:
        self.tags, self.parents, self.keys, self.marks = [""], [-1], [xxhash.xxh64_intdigest(site) >> 1], [0]
        self.owners: list[int] = []
        self.pieces: list[str] = []

    def text(self, keep: list[bool] | None = None) -> str:
        """The text of kept nodes: character references decoded, each run of white space one space, trimmed."""
        parts = self.pieces if keep is None else [p for p, o in zip(self.pieces, self.owners, strict=True) if keep[o]]
        return " ".join(html.unescape("".join(parts)).split())


def parse(page: str, site: str = "") -> Page:
    """The page's tree, in time and memory linear in the page. A node's key is a hash of its site and of the elements down to it.

    Forgiving: unclosed elements end with their parent, stray end tags and unfinished comments go, a tag that never ends takes the rest
    of the page with it. Blocks put a blank on both sides into the text of their parent.
    """
    out = Page(site)
    tags, parents, keys, marks, owners, pieces = out.tags, out.parents, out.keys, out.marks, out.owners, out.pieces
    stack, block, article = [0], [0], [False]  # open nodes; the place in the stack of the nearest block; inside an article
    open_tags: Counter = Counter()
    raw_ends: dict[str, re.Pattern] = {}
    at, n, tag_form = 0, len(page), _TAG

    def close(depth: int) -> None:
        while len(stack) > depth:
            node = stack.pop()
            block.pop()
            article.pop()
            open_tags[tags[node]] -= 1
            if tags[node] not in INLINE:
                owners.append(parents[node])
                pieces.append(" ")

    def add(text: str) -> None:
        owners.append(stack[-1])
        pieces.append(text)

    while at < n:
        less = page.find("<", at)
        if less < 0:
            add(page[at:])
            break
        if less > at:
            add(page[at:less])
        after = page[less + 1 : less + 2]
        if after in ("!", "?"):
            if page.startswith("<!--", less):
                end = page.find("-->", less + 4)
                at = n if end < 0 else end + 3
            elif page.startswith("<![CDATA[", less):
                end = page.find("]]>", less + 9)
                add(page[less + 9 : n if end < 0 else end])
                at = n if end < 0 else end + 3
            else:
                end = page.find(">", less)
                at = n if end < 0 else end + 1
            continue
        if not (after == "/" or (after.isascii() and after.isalpha())) or (after == "/" and not page[less + 2 : less + 3].isalpha()):
            add("<")
            at = less + 1
            continue
        found = tag_form.match(page, less + 1)
        if found is None:  # a quote that never ends: from here on quotes don't count
            tag_form = _PLAIN_TAG
            found = tag_form.match(page, less + 1)
        if found is None:
            break
        at, tag, rest = found.end(), found[2].lower(), found[3]
        if found[1]:
            if open_tags[tag] > 0:
                depth = len(stack) - 1
                while tags[stack[depth]] != tag:
                    depth -= 1
                close(depth)
            elif tag == "p":  # stands for an empty paragraph
                add(" ")
            continue
        if tag in ENDS:
            for _ in range(3):
                near = block[-1]
                if near and tags[stack[near]] in ENDS[tag]:
                    close(near)
                else:
                    break
        names, role, hidden, prose = "", "", False, False
        if rest:
            for m in _ATTR.finditer(rest):
                name, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
                if name in ("class", "id"):
                    names += " " + value
                elif name == "role":
                    role = value
                elif name == "itemprop":
                    prose = value == "articlebody"
                elif name == "hidden" or (name == "aria-hidden" and value == "true"):
                    hidden = True
                elif name == "style" and _NONE.search(value):
                    hidden = True
        mark = ARTICLE if tag in ("article", "main") or role == "main" or prose else 0
        if hidden or tag in NEVER or (tag == "header" and not article[-1]):
            mark |= HARD
        shape = ""
        if names or role:
            words = set(_WORD.findall(names)) | set(_WORD.findall(role))
            if words & COMMENTS:
                mark |= COMMENT
            if not mark & HARD and words & ASIDE and tag not in ("html", "body"):
                mark |= BY_NAME
            shape = ".".join(sorted({_DIGITS.sub("0", w) for w in names.split()}))
            if shape:
                mark |= NAMED
        if tag in UNSEEN:
            mark |= RAW_MARK
        node, parent = len(tags), stack[-1]
        tags.append(tag)
        parents.append(parent)
        keys.append(xxhash.xxh64_intdigest(f"{keys[parent]}>{tag}.{shape}") >> 1)
        marks.append(mark)
        if tag not in INLINE and tag not in JOINING:
            owners.append(parent)
            pieces.append(" ")
        if mark & ARTICLE:  # parts it from an article before it
            owners.append(node)
            pieces.append(" ")
        if rest.endswith("/"):
            continue
        if tag in RAW:
            ends = raw_ends.get(tag) or raw_ends.setdefault(tag, re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I))
            end = ends.search(page, at)
            at = end.end() if end else n
        elif tag not in VOID:
            stack.append(node)
            block.append(block[-1] if tag in INLINE else len(stack) - 1)
            article.append(article[-1] or bool(mark & ARTICLE and not mark & (HARD | BY_NAME)))
            open_tags[tag] += 1
    close(1)
    return out


def features(page: Page) -> tuple[dict[int, str], dict[int, set[str]], list[tuple[int, str]]]:
    """What a page gives to its site's tree: (keys of its nodes, words of the text that nodes of a key hold themselves, the styles (tags of the children) under each key)."""
    words: dict[int, set[str]] = {}
    for owner, piece in zip(page.owners, page.pieces, strict=True):
        if not page.marks[owner] & RAW_MARK and (found := html.unescape(piece).lower().split()):
            words.setdefault(page.keys[owner], set()).update(found)
    below: list[list[str]] = [[] for _ in page.tags]
    for tag, parent in zip(page.tags[1:], page.parents[1:], strict=True):
        below[parent].append(tag)
    styles = {(k, " ".join(b)) for k, b, m in zip(page.keys, below, page.marks, strict=True) if not m & RAW_MARK}
    return dict.fromkeys(k for k, _ in styles), words, list(styles)


#: Kinds of counted features: a page that has the node, a style of it, a word of its own text.
PAGES, STYLE, WORDS = 0, 1, 2


def _signed(text: str) -> int:
    return xxhash.xxh64_intdigest(text) - (1 << 63)


def _count_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names, kinds = ["key", "kind", "feature", "c"], (pa.int64(), pa.int32(), pa.int64(), pa.int32())
    held: dict[tuple[int, int], Counter] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for (key, kind), counts in held.items():
            n = len(counts)
            hashed = [_signed(x) for x in counts] if kind else [0] * n
            columns = [pa.repeat(pa.scalar(key, pa.int64()), n), pa.repeat(pa.scalar(kind, pa.int32()), n), pa.array(hashed, pa.int64()), pa.array(list(counts.values()), pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names)
        held.clear()

    def together(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(list(parts), pa.schema(list(zip(names, kinds, strict=True)))).combine_chunks()
        yield from whole.to_batches(max_chunksize=50_000)

    for batch in small_slices(batches):
        for site, page in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            found, words, styles = features(parse(page or "", site))
            for key in found:
                held.setdefault((key, PAGES), Counter())[""] += 1
            for key, style in styles:
                held.setdefault((key, STYLE), Counter())[style] += 1
            for key, of in words.items():
                held.setdefault((key, WORDS), Counter()).update(of)
        if sum(map(len, held.values())) > HELD_FEATURES:
            yield from together(flush())
    if held:
        yield from together(flush())


def node_weights(pages: DataFrame) -> DataFrame:
    """(key, pages, styles, presentation, content) of every node that two or more pages (columns site, html) of a site share.

    presentation is the entropy of the node's styles, to the base of its number of pages; content is 1 minus the mean, over the distinct words that its own
    text ever holds, of the logarithm, to that base, of the pages that hold the word there (null without words): words that all pages share
    have 0, words that one page alone has 1. Tasks pre-aggregate, then counts are summed per feature, then per node: no site is ever gathered.
    """
    rows = pages.select("site", "html").mapInArrow(_count_features, "key long, kind int, feature long, c int")
    counts = rows.groupBy("key", "kind", "feature").agg(F.sum("c").alias("c"))
    style, word = F.col("kind") == STYLE, F.col("kind") == WORDS
    log = F.log(F.col("c").cast("double"))
    nodes = counts.groupBy("key").agg(
        F.max(F.when(F.col("kind") == PAGES, F.col("c"))).alias("pages"),
        F.count(F.when(style, 1)).alias("styles"),
        F.sum(F.when(style, F.col("c"))).alias("n"),
        F.sum(F.when(style, F.col("c") * log)).alias("slog"),
        F.count(F.when(word, 1)).alias("words"),
        F.sum(F.when(word, log)).alias("wlog"),
    )
    nodes = nodes.where("pages >= 2")
    base = F.log(F.col("pages").cast("double"))
    presentation = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.log(F.col("n").cast("double")) - F.col("slog") / F.col("n")) / base))
    content = F.when(F.col("words") > 0, F.greatest(F.lit(0.0), 1 - F.col("wlog") / F.col("words") / base))
    return nodes.select("key", "pages", "styles", presentation.alias("presentation"), content.alias("content"))


Weights = dict[int, tuple[int, float, float | None, int]]  # key -> styles, presentation, content, pages


def noisy_nodes(page: Page, weights: Weights, gamma: float = GAMMA, least: float = LEAST_IMPORTANCE) -> list[bool]:
    """Whether each node and all below it are of composite importance under `least`, on the page's way through its site's tree.

    A node's importance is (1 - gamma^l) of its presentation plus gamma^l of the mean over its children and its own text, l being its number of
    styles in the tree. A node that no other page has, or without text and children, is worth 1. A node is noisy only if it, its own text and all that is below it are.
    """
    n = len(page.tags)
    has_text = [False] * n
    for owner, piece in zip(page.owners, page.pieces, strict=True):
        if not has_text[owner] and not piece.isspace():
            has_text[owner] = True
    total, parts, quiet = [0.0] * n, [0] * n, [True] * n
    for i in range(n - 1, -1, -1):
        told = weights.get(page.keys[i])
        if has_text[i]:
            own = 1.0 if told is None or told[2] is None else told[2]
            total[i], parts[i], quiet[i] = total[i] + own, parts[i] + 1, quiet[i] and own < least
        if parts[i]:
            styles, presentation = told[:2] if told else (1, 1.0)
            share = gamma**styles
            value = (1 - share) * presentation + share * total[i] / parts[i] if told else 1.0
            quiet[i] = quiet[i] and value < least
            up = page.parents[i]
            if up >= 0 and not page.marks[i] & RAW_MARK:
                total[up], parts[up], quiet[up] = total[up] + value, parts[up] + 1, quiet[up] and quiet[i]
        else:
            quiet[i] = False
    return quiet


def _lengths(page: Page) -> list[int]:
    """Characters of text that each node holds itself."""
    out = [0] * len(page.tags)
    for owner, piece in zip(page.owners, page.pieces, strict=True):
        if not piece.isspace():
            out[owner] += len(" ".join(piece.split()))
    return out


def major_branches(page: Page, lengths: list[int], within: list[bool], agreed: list[bool]) -> set[int]:
    """Branches that only a name of ASIDE would drop, but that hold as much of the text within (nodes) as all that no name takes, or more.

    Outermost ones are judged first; the text of those that stay counts with the rest for what stands in them. Branches that the tree finds noisy agree with their name.
    """
    group, order = [-1] * len(page.tags), []  # the innermost named branch around each node (-1: none, -2: dropped in any case)
    own: Counter = Counter()
    for i, up in enumerate(page.parents):
        above = group[up] if up >= 0 and within[up] else -1
        if not within[i] or above == -2 or (page.marks[i] & HARD and up >= 0 and within[up]):
            group[i] = -2 if within[i] else -1
            continue
        if page.marks[i] & BY_NAME and up >= 0 and within[up]:
            order.append((i, above))
            group[i] = i
        else:
            group[i] = above
        own[group[i]] += lengths[i]
    full = Counter(own)
    below: dict[int, list[int]] = {}
    for i, above in reversed(order):
        full[above] += full[i]
        below.setdefault(above, []).append(i)
    base, saved, level = own[-1], set(), below.get(-1, [])
    while level:
        stay = [k for k in level if full[k] and full[k] >= base and not agreed[k]]
        saved.update(stay)
        base += sum(own[k] for k in stay)
        level = [j for k in stay for j in below.get(k, [])]
    return saved


def main_text(page: str | None, weights: Weights | None = None, priors: bool = True, site: str = "") -> str:
    """The article's text, '' if there is none.

    A site of TREE_PAGES pages or more has its tree decide: what goes are the branches that it finds noisy, wherever they stand. Of nodes that no other page of the site has, only those in
    an article or main element stay, where the page has any; nodes of a key that holds half of the text or more, as pages that are copies of one another repeat
    their article as well, go if they neither hold such an element nor stand in one. What is unlike on every page and still no article only markup can tell (reader
    comments, hidden branches, forms: NEVER, ASIDE); it goes, too.

    On smaller sites markup is the prior: all outside of article or main elements goes, and inside the tree drops only branches of a class or id of their own, and never nodes of a key that
    holds half of the text. A name of ASIDE doesn't drop html, body or a branch that holds most of the text (major_branches). priors=False leaves all to the tree.
    """
    at = parse(page or "", site)
    quiet = noisy_nodes(at, weights) if weights else [False] * len(at.tags)
    if priors and weights and (weights.get(at.keys[0]) or (0,))[-1] >= TREE_PAGES and (text := _main_text(at, quiet, quiet, priors, [k in weights for k in at.keys])):
        return text
    return _main_text(at, quiet, quiet, priors) or (_main_text(at, [False] * len(at.tags), quiet, priors) if weights else "")


def _main_text(page: Page, quiet: list[bool], agreed: list[bool], priors: bool, seen: list[bool] | None = None) -> str:
    """seen: whether the site's tree knows a node, where that tree decides."""
    n, marks, parents = len(page.tags), page.marks, page.parents
    around = [False] * n  # in an article, or around one
    lengths = _lengths(page)
    if not priors:
        keep, whole = [True] * n, True
        for i in range(1, n):
            keep[i] = keep[parents[i]] and not marks[i] & RAW_MARK
    else:
        saved = major_branches(page, lengths, [True] * n, agreed)
        closed = lambda i: marks[i] & HARD or (marks[i] & BY_NAME and i not in saved)
        inside = _below(page, lambda i: marks[i] & ARTICLE and not closed(i), closed)
        if not any(inside):  # an article that only broken markup put into a dropped branch still counts
            inside = _below(page, lambda i: page.tags[i] in ("article", "main"), lambda i: marks[i] & (RAW_MARK | COMMENT))
        whole = not any(inside)
        if whole:
            inside = [True] * n
        saved |= major_branches(page, lengths, inside, agreed)
        if seen is not None:
            around = [x and not whole for x in inside]
            for i in range(n - 1, 0, -1):
                around[parents[i]] = around[parents[i]] or around[i]
            inside, whole = [a or b for a, b in zip(inside, seen, strict=True)], True
        keep = [False] * n
        for i in range(n):
            up = parents[i]
            top = inside[i] and (up < 0 or not inside[up])
            keep[i] = inside[i] and (top or (keep[up] and not closed(i)))
    if any(quiet):
        held: Counter = Counter()
        cut, cut_by = [False] * n, [-1] * n
        for i in range(1, n):
            up = parents[i]
            if not keep[i]:
                continue
            cut_by[i] = cut_by[up] if keep[up] and cut_by[up] >= 0 else i if quiet[i] and (whole or marks[i] & NAMED) and keep[up] else -1
            if cut_by[i] >= 0:
                held[page.keys[cut_by[i]]] += lengths[i]
        total = sum(x for x, k in zip(lengths, keep, strict=True) if k)
        cut = [c >= 0 and (2 * held[page.keys[c]] < total or (seen is not None and any(around) and not around[c])) for c in cut_by]
        keep = [k and not c for k, c in zip(keep, cut, strict=True)]
    return page.text(keep)


def _below(page: Page, wanted: Callable[[int], bool], closed: Callable[[int], bool]) -> list[bool]:
    """Nodes that are wanted, or below such a node, and not in a closed branch outside of one."""
    inside, shut = [False] * len(page.tags), [False] * len(page.tags)
    for i in range(1, len(page.tags)):
        up = page.parents[i]
        inside[i] = inside[up] or (not shut[up] and not closed(i) and bool(wanted(i)))
        shut[i] = shut[up] or bool(closed(i))
    return inside


def _extract(weights_of: Callable[[pa.RecordBatch, int], Weights | None], priors: bool):
    """Rows (id, url, site, html, ...) -> (id, url, text, n_chars)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_slices(batches):
            texts = [main_text(page, weights_of(batch, i), priors, site) for i, (site, page) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["id", "url", "text", "n_chars"])

    return run


def _nodes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_slices(batches):
        for row, site, page in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            keys = list(dict.fromkeys(parse(page or "", site).keys))
            for lo in range(0, len(keys), 50_000):
                part = keys[lo : lo + 50_000]
                yield pa.RecordBatch.from_arrays([pa.repeat(row, len(part)), pa.array(part, pa.int64())], ["row", "key"])


def site_of(url: Column, large_host: Column) -> Column:
    """The host where it is large, else its registered domain (after a '~', so that a domain that is a host too isn't taken for it)."""
    host = host_of(url)
    return F.when(large_host, host).otherwise(F.concat(F.lit("~"), domain_of(host)))


def with_sites(pages: DataFrame, host_pages: int = HOST_PAGES) -> DataFrame:
    """pages (with url) with the column site. Only urls are read for it; the list of large hosts is broadcast if it is measured to be small, else joined."""
    at = pages.withColumn("host", host_of(F.col("url")))
    large = materialise(at.groupBy("host").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= host_pages).select("host", F.lit(True).alias("large")))
    at = join_narrow(at, large, "host", "left")
    return at.withColumn("site", site_of(F.col("url"), F.coalesce("large", F.lit(False)))).drop("host", "large")


def extract_text(df: DataFrame, id_col: str, url_col: str, html_col: str, host_pages: int = HOST_PAGES, sent_rows: int = SENT_ROWS, priors: bool = True) -> DataFrame:
    """(id, url, text, n_chars): the main text of each row's whole page, '' if it has none (null, empty, no article text).

    Trees are built over all pages of a site: a host of host_pages pages or more, else all such hosts of a registered domain (null urls share the empty one). Weights of at most
    sent_rows nodes go to every task; more are joined with the distinct nodes of each page, dealt by node and a part of the page's number, so that
    a page only ever holds the weights of its own nodes. Blocks follow one another in page order with one space between; nothing is cut off.
    Repeated rows give repeated rows; null ids are ids like others.
    """
    small_batches(df.sparkSession)
    pages = with_sites(df.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html")), host_pages)
    schema = f"id {pages.schema['id'].dataType.simpleString()}, url string, text string, n_chars long"
    weights = materialise(node_weights(pages))
    if weights.count() <= sent_rows:
        sent: Weights = {}
        for part in weights.select("key", "styles", "presentation", "content", "pages").toArrow().to_batches():
            sent.update((key, tuple(w)) for key, *w in zip(*(c.to_pylist() for c in part.columns), strict=True))
        return pages.select("id", "url", "site", "html").mapInArrow(_extract(lambda batch, i: sent, priors), schema)
    rows = materialise(pages.withColumn("row", F.monotonically_increasing_id()))
    salt = F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int").alias("salt")
    nodes = rows.select("row", "site", "html").mapInArrow(_nodes_of, "row long, key long").select("*", salt)
    dealt = weights.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    met = nodes.join(dealt, ["key", "salt"]).groupBy("row").agg(F.collect_list(F.struct("key", "styles", "presentation", "content", "pages")).alias("weights"))
    own = lambda batch, i: {x["key"]: (x["styles"], x["presentation"], x["content"], x["pages"]) for x in batch.column(4)[i].as_py() or ()}
    return rows.join(met, "row", "left").select("id", "url", "site", "html", "weights").mapInArrow(_extract(own, priors), schema)


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages: null html and pages without an article have the text '', repeated rows stay, other columns aren't read."""
    return extract_text(table(spark, sf_dir, "pages"), "page_id", "url", "html").withColumnRenamed("id", "page_id")
