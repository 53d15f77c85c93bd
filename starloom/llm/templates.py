"""Main text of web pages by template deduction over equivalence classes of tokens (after Arasu and Garcia-Molina 2003).

The tokens of a page are its tags, told apart by their path, and its text runs. Tokens of a host's pages
that occur equally often on every page - that have the same occurrence vector - form a class; classes
that are large and frequent, and whose tokens nest in one another, are the host's template. What
lies between template tokens are slots; the slot that holds the bulk of the varying text is the article.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom.llm import workers
from starloom.plans.durable import durable

# Names from the HTML standard, and words that sites use for what surrounds an article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg object canvas audio video select annotation annotation-xml".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img".split()) | frozenset(
    "math mi mn mo ms mtext mrow mfrac msqrt mroot msub msup msubsup munder mover munderover mmultiscripts mprescripts mtable mtr mtd mstyle mspace mpadded mphantom merror menclose semantics".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 p".split())
TEXT_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 hgroup header li ul ol dl dt dd blockquote pre figure figcaption table thead tbody tfoot tr td th caption address".split())
OUTSIDE = frozenset("nav footer head button menu dialog".split())
DOUBTFUL = frozenset("aside form fieldset".split())
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion promoted cookie cookies consent gdpr notice notices notification alert newsletter subscribe subscription "
    "signup popup modal overlay sidebar widget menu nav navbar navigation breadcrumb breadcrumbs masthead footer share sharing social related recommended recommendations comment comments commentlist respond "
    "discussion disqus replies login pagination pager toolbar topbar skip hidden".split()
)
#: Words that stand beside those in the whole name of a surrounding (``related-posts``, ``site-footer``), but not in a slug's (``related-work``).
BESIDE = frozenset(
    "site page main global top bottom left right upper lower primary secondary inner outer small large mobile desktop sticky fixed inline float floating first last one two three post posts article articles story stories entry entries "
    "link links list lists item items box boxes block blocks wrap wrapper container containers section sections area areas zone zones slot slots unit units row rows col cols column columns grid group groups panel panels module modules "
    "bar bars button buttons icon icons title titles heading header headers body content contents text form forms field count counter user users reader readers visitor visitors more popular latest trending also you may like read next previous prev".split()
)
STATES = frozenset("no not non has have with without free open opened close closed enabled disabled on off is show visible active allow allowed supported ready".split())
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog".split())
#: A page needs this many others of its host for a slot.
LEAST_PAGES = 2
#: Pages of a host from which on what they all say in the slot counts as template.
LEAST_PAGES_FOR_WORDS = 4
#: Tokens that a class must have.
LEAST_TOKENS = 3
#: Share of a host's pages on which a template token occurs.
SUPPORT = 0.6
#: Share of the varying text outside surroundings that the article's slot holds.
BULK = 0.7
#: An element named like a surrounding is one if at least this share of the page's text lies elsewhere; else it wraps the page.
ELSEWHERE = 0.1
#: Characters of a path, beyond which its beginning is replaced by a hash.
LONG_PATH = 400
#: Most contents with copies that are broadcast to leave the copies out; beyond it a shuffle.
BROADCAST_COPIES = 100_000
#: Most hosts whose templates (a few hundred bytes each) are broadcast; beyond it a shuffled join.
BROADCAST_HOSTS = 20_000

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>"']+|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>|<[!?][^>]*>""", re.S)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_TAG_BEGINS = re.compile(r"<[a-zA-Z/!]")
#: Marks of an element: part of the page's text; with a word of a surrounding in its name; named like one; surely one.
PLAIN, HINTED, DOUBTED, SURROUNDING = range(4)


class Block(NamedTuple):
    """An element that is no plain inline one: place of its parent in the page's list, path, mark."""

    parent: int
    path: str
    mark: int


class Seen:
    """What a page has of one path."""

    __slots__ = ("closed", "depth", "opened", "tag")

    def __init__(self, tag: str, depth: int):
        self.opened, self.closed, self.tag, self.depth = 0, 0, tag, depth


def _named_like(name: str) -> int:
    """How far a class or id names a surrounding: not at all, by a word of it, or as a whole; what says that there is one, or none, does not (``no-sidebar``, ``menu-open``)."""
    words = [w for w in re.split(r"[-_]+", name) if w]
    if not any(w in NAMES for w in words) or any(w in STATES for w in words):
        return PLAIN
    return DOUBTED if all(w in NAMES or w in BESIDE or w.isdigit() for w in words) else HINTED


def _marked(tag: str, attributes: str, in_article: bool) -> tuple[int, str]:
    """An element's mark by its tag and attributes, and its label in paths (``>`` separates labels, so none holds it).

    Inside an article or main element, and on headings and paragraphs, only whole names count; an id of a heading or
    paragraph is a place to link to and never counts.
    """
    mark, label = SURROUNDING if tag in OUTSIDE else DOUBTED if tag in DOUBTFUL else PLAIN, tag
    if not attributes.strip():
        return mark, label
    whole, least = tag in ("html", "body", "article", "main"), DOUBTED if in_article or tag in HEADINGS else HINTED
    for m in _ATTRIBUTE.finditer(attributes):
        key, value, doubt = m[1].lower(), (m[2] or m[3] or m[4] or "").lower(), PLAIN
        if key in ("class", "id"):
            words = value.split()
            if key == "class" and words:
                label += "." + words[0].replace("%", "%25").replace(">", "%3e")
            if not whole and (key == "class" or tag not in HEADINGS):
                doubt = max(map(_named_like, words), default=PLAIN)
        elif not whole and (value in ROLES if key == "role" else key == "hidden" or value == "true"):
            doubt = DOUBTED
        mark = max(mark, doubt if doubt >= least else PLAIN)
    return mark, label


def _down(path: str, label: str) -> str:
    """The path of a child; of bounded length however deep the page is."""
    path = f"{path}>{label}"
    return path if len(path) <= LONG_PATH else ">#" + hashlib.md5(path.encode("utf-8", "replace")).hexdigest()


def parsed(page: str) -> tuple[list[tuple[int, str, int]], list[Block], dict[str, Seen]]:
    """(text runs, blocks, paths) of a page.

    A run is (place of its block, text, linked characters): the text between two block boundaries, character
    references decoded, white space made one blank. Block 0 is the page itself.
    """
    cut = _TAG_BEGINS.search(page, page.rfind(">") + 1)  # a tag that never ends
    page = page[: cut.start()] if cut else page
    runs: list[tuple[int, str, int]] = []
    blocks = [Block(-1, "", PLAIN)]
    seen: dict[str, Seen] = {}
    stack: list[tuple[str, int]] = []  # tag, block
    open_tags: dict[str, int] = {}
    text: list[str] = []
    linked, links, at_block = 0, 0, 0

    def flush() -> None:
        nonlocal text, linked
        if text:
            joined = " ".join(entities.unescape("".join(text)).split())
            if joined:
                runs.append((at_block, joined, linked))
        text, linked = [], 0

    def pop() -> None:
        nonlocal at_block, links
        tag, block = stack.pop()
        open_tags[tag] -= 1
        if tag == "a":
            links -= 1
        if tag not in INLINE:
            seen[blocks[block].path].closed += 1
        at_block = stack[-1][1] if stack else 0

    at, n = 0, len(page)
    for m in _TAG.finditer(page):
        start = m.start()
        if start < at:
            continue  # inside a raw element
        if start > at:
            text.append(page[at:start])
            if links:
                linked += start - at
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            continue
        tag, closing, attributes = tag.lower(), m[1] if m[2] else m[4], (m[3] if m[2] else m[6]) or ""
        if tag in RAW:
            if not closing:
                end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
                at = end.end() if end else n
                if tag not in ("script", "style"):
                    text.append(" ")
            continue
        if tag not in INLINE:
            flush()
        elif tag == "br":
            text.append(" ")
        if tag in VOID:
            continue
        if closing:
            if open_tags.get(tag):
                if blocks[at_block].mark != PLAIN:
                    flush()
                while stack[-1][0] != tag:
                    pop()
                pop()
            continue
        if tag not in INLINE:  # an open paragraph, or item of the same list, ends here
            for depth in range(len(stack) - 1, -1, -1):
                inner = stack[depth][0]
                if inner == "p" or (inner == tag and tag in ("li", "dt", "dd", "tr", "td", "th", "option")):
                    while len(stack) > depth:
                        pop()
                    break
                if inner not in INLINE:
                    break
        in_article = bool(open_tags.get("article") or open_tags.get("main"))
        mark, label = _marked(tag, attributes, in_article)
        if tag == "header" and not in_article:  # an article's own is not outside
            mark = SURROUNDING
        if tag not in INLINE:
            path = _down(blocks[at_block].path, label)
            found = seen.get(path) or seen.setdefault(path, Seen(tag, len(stack)))
            found.opened += 1
            blocks.append(Block(at_block, path, mark))
            at_block = len(blocks) - 1
        else:
            links += tag == "a"
            if mark != PLAIN:
                flush()
                blocks.append(Block(at_block, blocks[at_block].path, mark))
                at_block = len(blocks) - 1
        stack.append((tag, at_block))
        open_tags[tag] = open_tags.get(tag, 0) + 1
    if at < n:
        text.append(page[at:])
    flush()
    return runs, blocks, seen


def _summed(blocks: list[Block], own: list[int]) -> list[int]:
    """Sums over each block and all within it; parents stand before their children."""
    for i in range(len(blocks) - 1, 0, -1):
        own[blocks[i].parent] += own[i]
    return own


def outside(runs: list[tuple[int, str, int]], blocks: list[Block], slot: list[bool] | None = None) -> list[bool]:
    """Whether each block is no part of an article.

    A doubted block is outside if at least a share ``ELSEWHERE`` of the page's text lies elsewhere: what holds
    nearly all of it wraps the page, whatever its name. So is one with a mere word of a surrounding in its name, unless it
    lies in the ``slot``. Where that would leave nothing, doubts count for nothing.
    """
    sure = [False] * len(blocks)
    for i, b in enumerate(blocks):
        sure[i] = b.mark == SURROUNDING or (i > 0 and sure[b.parent])
    size = [0] * len(blocks)
    for block, text, linked in runs:
        if not sure[block]:
            size[block] += max(0, len(text) - linked)
    size = _summed(blocks, size)
    out = [False] * len(blocks)
    for i, b in enumerate(blocks):
        doubted = b.mark == DOUBTED or (b.mark == HINTED and not (slot and slot[i]))
        out[i] = sure[i] or (i > 0 and out[b.parent]) or (doubted and size[0] - size[i] >= ELSEWHERE * size[0])
    return out if any(not out[block] for block, _, _ in runs) else sure


def host_of(url):
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)", 1))


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)


def _run_token(path: str, text: str) -> str:
    return f"{path}\x1f{_hash(text):x}"


def _tokens(page: str) -> dict[str, list[int]]:
    """The tokens of a page: [occurrences, depth, rank as a slot (0 none, 1 a container, 2 an article), text inside]."""
    runs, blocks, seen = parsed(page)
    out = outside(runs, blocks)
    size = [0] * len(blocks)
    for block, text, linked in runs:
        if not out[block]:
            size[block] += max(0, len(text) - linked)
    size = _summed(blocks, size)
    tokens: dict[str, list[int]] = {}
    for path, s in seen.items():
        tokens[f"<{path}"] = [s.opened, s.depth, 2 if s.tag == "article" else int(s.tag not in TEXT_BLOCKS), 0]
        if s.closed:
            tokens[f"</{path}"] = [s.closed, s.depth, 0, 0]
    for i, b in enumerate(blocks[1:], 1):
        if b.path and blocks[b.parent].path != b.path:  # not an inline one
            tokens[f"<{b.path}"][3] += size[i]
    for block, text, _ in runs:
        tokens.setdefault(_run_token(blocks[block].path, text), [0, 0, 0, 0])[0] += 1
    return tokens


def token_vectors(pages: DataFrame) -> DataFrame:
    """One row per (host, token): depth, rank as a slot, pages it is on, occurrences, fingerprint of its occurrence vector, text inside.

    The fingerprint is the exclusive or of a hash of (content, count) over pages, so it needs no order
    and is combined before the shuffle: a host of any size is a few sums per token, never a list of pages.
    """

    @workers.released
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[tuple, list] = {}
            for host, page in zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True):
                key, votes = hashlib.blake2b(page.encode("utf-8", "replace"), digest_size=16).hexdigest(), {}
                for token, (n, depth, rank, size) in _tokens(page).items():
                    if n not in votes:
                        votes[n] = _hash(f"{key}/{n}")
                    row = found.setdefault((host, token), [depth, rank, 0, 0, 0, 0])
                    row[2] += 1
                    row[3] += n
                    row[4] ^= votes[n]
                    row[5] += size
            hosts, tokens = (pa.array([k[i] for k in found], pa.string()) for i in range(2))
            numbers = [pa.array([row[i] for row in found.values()], pa.int64()) for i in range(6)]
            yield pa.RecordBatch.from_arrays([hosts, tokens, *numbers], ["host", "token", "depth", "rank", "pages", "occurrences", "vector", "size"])

    counts = pages.select("host", "html").mapInArrow(count, "host string, token string, depth long, rank long, pages long, occurrences long, vector long, size long")
    sums = [F.sum(c).alias(c) for c in ("pages", "occurrences", "size")]
    return counts.groupBy("host", "token").agg(F.max("depth").alias("depth"), F.max("rank").alias("rank"), F.bit_xor("vector").alias("vector"), *sums)


def distinct_contents(pages: DataFrame) -> DataFrame:
    """(host, html) of a host's pages, each content once: copies of a page say nothing about what its host's pages share."""
    keyed = pages.select("host", "html", F.md5("html").alias("digest"))
    copies = durable(keyed.groupBy("host", "digest").agg(F.count("*").alias("n")).where("n > 1").select("host", "digest"), "copies")
    n = copies.count()
    if n > BROADCAST_COPIES:
        return keyed.dropDuplicates(["host", "digest"]).select("host", "html")
    if n == 0:
        return keyed.select("host", "html")
    side = F.broadcast(copies)
    single, repeated = keyed.join(side, ["host", "digest"], "left_anti"), keyed.join(side, ["host", "digest"], "left_semi")
    return single.union(repeated.dropDuplicates(["host", "digest"]).select(single.columns)).select("host", "html")


def host_templates(pages: DataFrame) -> DataFrame:
    """(host, article, fixed): the path of the article's slot, and the text runs that belong to the template.

    Classes are groups of a host's tokens with one vector. A class is valid if it has at least
    ``LEAST_TOKENS`` tokens on a share ``SUPPORT`` of the pages, once a page: then every one of its elements
    holds the same others on all pages, as paths name the elements around them. Of the elements of
    valid classes that hold ``BULK`` of the text outside surroundings, the innermost is the article's slot: an article
    element if there is one, else a container, never a single block of text. Text runs of the slot's own
    class are template. Pages of equal html have one vote.
    """
    pages = distinct_contents(pages)
    vectors = durable(token_vectors(pages).where("pages >= 2"), "vectors")
    n_pages = pages.groupBy("host").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_PAGES)
    frequent = vectors.join(n_pages, "host").where(F.col("pages") >= F.col("n") * SUPPORT)
    key = ["host", "vector", "pages", "occurrences"]
    classes = frequent.groupBy(*key).agg(F.count("*").alias("tokens")).where((F.col("tokens") >= LEAST_TOKENS) & (F.col("occurrences") == F.col("pages"))).drop("tokens")
    template = durable(frequent.join(classes, key), "template")
    opening = template.where(F.col("token").startswith("<>"))
    whole = opening.groupBy("host").agg(F.max("size").alias("all_size"))
    slots = opening.join(whole, "host").where((F.col("rank") > 0) & (F.col("size") > 0) & (F.col("size") >= F.col("all_size") * BULK))
    best = F.max(F.struct("rank", "depth", "size", F.expr("substring(token, 2)").alias("path"), "vector", "pages", "occurrences")).alias("top")
    article = slots.groupBy("host").agg(best).select("host", F.col("top.path").alias("article"), "top.vector", "top.pages", "top.occurrences")
    runs = template.where((F.instr("token", "\x1f") > 0) & (F.col("n") >= LEAST_PAGES_FOR_WORDS))
    fixed = runs.join(article, key, "left_semi").groupBy("host").agg(F.collect_list("token").alias("fixed"))
    return article.join(fixed, "host", "left").select("host", "article", F.coalesce("fixed", F.array().cast("array<string>")).alias("fixed"))


def main_text(page: str, article: str | None, fixed: frozenset) -> str:
    """The slot's text, block by block; pages without the slot give their article or main element, else all that is not outside.

    Where the template's runs would be most of the slot, or all that a page has, they are its article and stay.
    """
    runs, blocks, seen = parsed(page)
    where = article if article and article in seen else next((p for tag in ("article", "main") for p, s in seen.items() if s.tag == tag), None)
    inside = [False] * len(blocks)
    for i, b in enumerate(blocks[1:], 1):
        inside[i] = bool(where) and (inside[b.parent] or b.path == where)
    out = outside(runs, blocks, inside)
    kept = [(block, text) for block, text, _ in runs if not out[block]]
    slot = [(block, text) for block, text in kept if inside[block]]
    kept = slot or kept
    left = [text for block, text in kept if not fixed or _run_token(blocks[block].path, text) not in fixed]
    if not left or (slot and 2 * sum(map(len, left)) < sum(len(text) for _, text in kept)):
        left = [text for _, text in kept]
    return "\n".join(left)


def extract_main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page.

    Templates are deduced from all pages of a host; the only page of a host goes by the names of its elements
    alone. Names of classes and ids only ever take blocks out that leave text elsewhere; inside the article only whole names
    of surroundings do, never a word of a slug. Formulas are text.

    Edge cases: null and empty html give an empty text, as do pages all of whose text is in menus, headers or
    footers; very long and very deep pages take memory in proportion to their length; pages without a URL or
    with an odd one share the host ''; html cut short loses the unfinished tag only; repeated pages each have a
    row; an empty table gives no row; other columns are ignored.
    """
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"), host_of(F.col("url")).alias("host"))
    templates = durable(host_templates(pages), "templates")
    side = F.broadcast(templates) if templates.count() <= BROADCAST_HOSTS else templates

    @workers.released
    def extract(batches):
        known: dict[str, frozenset] = {}
        for batch in batches:
            ids, urls, pages, hosts, articles, fixed = (batch.column(i).to_pylist() for i in range(6))
            texts = []
            for page, host, article, runs in zip(pages, hosts, articles, fixed, strict=True):
                if host not in known:
                    if len(known) > 10_000:
                        known.clear()
                    known[host] = frozenset(runs or ())
                texts.append(main_text(page, article, known[host]) if page else "")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    joined = pages.join(side, "host", "left").select("page_id", "url", "html", "host", "article", "fixed")
    return joined.mapInArrow(extract, "page_id long, url string, text string, n_chars long")
