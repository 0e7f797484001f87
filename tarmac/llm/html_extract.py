"""Main text of web pages by equivalence-class template deduction.

The pages of a host that have one layout share a template. A page is read as
tokens: its tags and its text blocks, each with the path of tags around it, so
that the same tag in different places is a different token; short blocks
outside articles also give their words. Tokens that occur equally often on
every page of a layout (that share their vector of occurrences) form an
equivalence class. Large classes that most pages have are the template when
they are valid: by their places, classes nest into each other, and one that
overlaps another without nesting is none.

What the template does not fix are its slots. A section is a slot when it has
text that varies from page to page; a section in which everything is fixed is
boilerplate, as is a varying block that is mostly fixed words ("Page 3 of 8").
An article is never given up for a class inside it: fixed blocks stay where
their section or the marked article would lose most of its text, and where
the page has no other text of that weight, as on pages that all carry one
article. What is left in the slots, outside navigation and the like, is the
main text.

Occurrence vectors are never brought together: a vector is represented by
the sum over pages of a hash of (page, count), which Spark adds up map-side,
so a host may have any number of pages. Pages with the same tokens count once.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tarmac.llm.common import stage

#: A class is part of the template when it has this many tokens and this share of the host's different pages (and
#: so many at least).
CLASS_TOKENS, SUPPORT, PAGES = 3, 0.9, 4
#: Depth of sections that tell layouts apart, words of a block that are looked at singly, and the share of fixed words (or of fixed text) from which
#: a block is boilerplate (or a slot is an article that all pages have).
LAYOUT_DEPTH, SHORT_BLOCK, MOSTLY = 3, 12, 0.5
#: Rows of the template table that may go to every task.
TEMPLATE_ROWS = 200_000

# Tags of HTML, and names by which pages call their parts.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math object".split())
BLOCK = frozenset("address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure "
                  "footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary table "
                  "tbody td tfoot th thead title tr ul".split())
CLOSED_BY = {"p": BLOCK - {"br"}, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "option": frozenset(["option"]),
             "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"])}
SECTION = frozenset("article aside body div fieldset footer form header html main nav ol section table ul".split())
ASIDE = frozenset("aside button dialog fieldset footer form head header input label menu nav select textarea".split())
ASIDE_ROLE = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())
ASIDE_NAME = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|alert|banner|breadcrumbs?|comments?|consent|cookies?|disclaimer|discussion|footer|gdpr|header|masthead|menu|modal|nav|navbar|"
    r"navigation|newsletter|notices?|notification|overlay|pagination|popup|promo\w*|related|remarks|replies|reply|respond|responses|share|sharing|sidebar|"
    r"sidenav|skip|social|sponsor\w*|subscribe|subscription|tags|toolbar|topbar|widgets?)(?:$|[\s_-])", re.I)
ARTICLE = frozenset(["article", "main"])
ARTICLE_NAME = re.compile(r"(?:^|[\s_-])(?:article|content|entry|main|post|story)(?:[\s_-]?(?:body|content|text))?(?:$|[\s_-])", re.I)

_token = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|$)|([^<]+|<)", re.S)
_attribute = re.compile(r"([^\s=/>\"']+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.S)
_space = re.compile(r"\s+")

TOKENS = "page string, host string, layout bigint, key bigint, n int, at int"
#: The token that every page has once: it counts the pages.
ROOT = 0


def host_of(url: Column) -> Column:
    """The host of a URL, lower-cased, without user and port; empty if there is none."""
    host = F.regexp_extract(url.cast("string"), r"^\s*(?:[A-Za-z][\w+.-]*:)?//(?:[^/?#]*@)?([^/?#:]*)", 1)
    return F.coalesce(F.lower(host), F.lit(""))


class Block:
    """A text block of a page: its path, the number of the section it stands in, what it says, and whether it stands in a part that is no article, or in one."""

    __slots__ = ("path", "section", "text", "aside", "article")

    def __init__(self, path: str, section: int, text: str, aside: bool, article: bool):
        self.path, self.section, self.text, self.aside, self.article = path, section, text, aside, article

    def words(self) -> list[str]:
        """The words of a short block outside articles and the like; else none."""
        found = [] if self.article or self.aside else self.text.split(" ")
        return found if len(found) <= SHORT_BLOCK else []


def _below(path: str, label: str) -> str:
    """A name of bounded length for a section within a path."""
    import xxhash

    return xxhash.xxh3_128_hexdigest(f"{path}/{label}")


def parse(page: str | None) -> Iterator[tuple[str, Block | None]]:
    """The tokens of a page in order: (tag with its path, None) or ("", block). Tolerates unclosed and misplaced tags."""
    page = page or ""
    # tag, name of the path of sections down to it, in an aside part, in an article, number of the section
    stack: list[tuple[str, str, bool, bool, int]] = [("", "", False, False, 0)]
    words: list[str] = []
    sections = 0

    def path() -> str:
        return stack[-1][1]

    def flush() -> Iterator[tuple[str, Block]]:
        text = _space.sub(" ", "".join(words)).strip()
        words.clear()
        if text:
            yield "", Block(path(), stack[-1][4], text, stack[-1][2], stack[-1][3])

    at = 0
    while m := _token.match(page, at):
        at = m.end()
        if m[4] is not None:
            words.append(entities.unescape(m[4]) if "&" in m[4] else m[4])
            continue
        if m[2] is None:
            continue  # a comment, CDATA or declaration
        tag = m[2].lower()
        if m[1]:
            if tag in BLOCK:
                yield from flush()
            open_at = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == tag), None)
            # An inline tag's end does not close the sections opened since.
            if open_at is not None and not (tag not in SECTION and any(x[0] in SECTION for x in stack[open_at + 1:])):
                if tag in SECTION:
                    yield f"{path()}>", None
                del stack[open_at:]
            continue
        if tag in RAW:
            yield from flush()
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(page, at) if not m[0].endswith("/>") else None
            at = end.end() if end else at if m[0].endswith("/>") else len(page)
            yield f"{path()}/{tag}", None
            continue
        if tag in BLOCK:
            yield from flush()
            while tag in CLOSED_BY.get(stack[-1][0], ()):
                stack.pop()
            for i in range(len(stack) - 1, 0, -1):  # <p><b>..<p>: the open paragraph ends with what is open in it
                if stack[i][0] in SECTION:
                    break
                if tag in CLOSED_BY.get(stack[i][0], ()):
                    del stack[i:]
                    break
        if tag in VOID or m[0].endswith("/>"):
            continue
        attrs = {k.lower(): a or b or c for k, a, b, c in _attribute.findall(m[3])} if "=" in m[3] else {}
        name = " ".join(filter(None, (attrs.get("class"), attrs.get("id"))))
        # Within an article, its own header holds the headline; elsewhere a header is the page's.
        inside = stack[-1][3]
        aside = ((tag in ASIDE and not (tag == "header" and inside)) or attrs.get("role", "").lower() in ASIDE_ROLE
                 or "hidden" in re.split(r"[\s=]", m[3].lower()) or attrs.get("aria-hidden") == "true"
                 or (tag not in ("html", "body", *ARTICLE) and bool(ASIDE_NAME.search(name))))
        article = tag in ARTICLE or attrs.get("role") in ARTICLE or (tag in SECTION and tag not in ("html", "body") and bool(ARTICLE_NAME.search(name)))
        label = tag + ("." + attrs["class"] if "class" in attrs else "") + ("#" + attrs["id"] if "id" in attrs else "")
        sections += tag in SECTION
        stack.append((tag, _below(path(), label) if tag in SECTION else path(), aside or stack[-1][2], article or inside, sections if tag in SECTION else stack[-1][4]))
        if tag in SECTION:
            yield path(), None
    yield from flush()


def key_of(tag: str, block: Block | None) -> int:
    """A 64-bit name of a token; blocks of the same text in the same place share theirs."""
    import xxhash

    return xxhash.xxh3_64_intdigest(tag if block is None else f"{block.path}\0{block.text}") - (1 << 63)


def word_key(path: str, word: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(f"{path}\0\0{word}") - (1 << 63)


def layout_of(tokens: list[tuple[str, Block | None]]) -> int:
    """A name of the page's outer sections, articles' own left out."""
    import xxhash

    depth, outer, articles = 0, set(), {b.path for _, b in tokens if b is not None and b.article}
    for tag, block in tokens:
        if block is None and tag.endswith(">"):
            depth -= 1
        elif block is None and "/" not in tag:
            depth += 1
            if depth <= LAYOUT_DEPTH and tag not in articles:
                outer.add(tag)
    return xxhash.xxh3_64_intdigest("".join(sorted(outer))) - (1 << 63)


def _page_tokens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import xxhash

    for pdf in batches:
        out = []
        for host, page in zip(pdf["host"], pdf["html"]):
            tokens = list(parse(page))
            counts: dict[int, list[int]] = {ROOT: [1, 0]}
            names = xxhash.xxh3_128()
            for at, (tag, block) in enumerate(tokens):
                key = key_of(tag, block)
                names.update(key.to_bytes(8, "little", signed=True))
                counts.setdefault(key, [0, at])[0] += 1
                for word in block.words() if block is not None else ():
                    counts.setdefault(word_key(block.path, word), [0, at])[0] += 1
            digest, layout = names.hexdigest(), layout_of(tokens)
            out += [(digest, host, layout, k, n, at) for k, (n, at) in counts.items()]
        yield pd.DataFrame(out, columns=["page", "host", "layout", "key", "n", "at"])


OF = ["host", "layout"]


def classes(pages: DataFrame) -> DataFrame:
    """(host, layout, key, class_id, support, tokens, place): the large classes of each layout.

    ``pages`` has host and html. ``class_id`` stands for the occurrence vector,
    ``place`` is the token's mean place: a class nests in another between whose
    places all its own lie.
    """
    each = pages.mapInPandas(_page_tokens, TOKENS).distinct()  # equal pages give equal rows
    by_token = stage(each.groupBy(*OF, "key").agg(
        F.sum(F.xxhash64("page", "n") % (1 << 40)).alias("class_id"), F.count("*").alias("support"), F.avg("at").alias("place"))
        .where(F.col("support") >= PAGES), "page-tokens")
    counted = by_token.where(F.col("key") == ROOT).select(*OF, F.col("support").alias("pages"))
    large = by_token.where(F.col("key") != ROOT).groupBy(*OF, "class_id", "support").agg(F.count("*").alias("tokens")).where(F.col("tokens") >= CLASS_TOKENS)
    large = large.join(counted, OF).where(F.col("support") >= SUPPORT * F.col("pages")).drop("pages")
    return by_token.where(F.col("key") != ROOT).join(large, [*OF, "class_id", "support"]).select(*OF, "key", "class_id", "support", "tokens", "place")


def template(found: DataFrame) -> DataFrame:
    """(host, layout, class_id, support, tokens, first, last, parent): the valid ones of ``classes``, nested.

    A class whose places lie between those of another is nested in it; a class
    that overlaps another without nesting is not valid and left out. The larger
    class goes first.
    """
    spans = found.groupBy(*OF, "class_id", "support", "tokens").agg(F.min("place").alias("first"), F.max("place").alias("last"))

    def nest(pdf: pd.DataFrame) -> pd.DataFrame:
        kept: list = []
        for r in pdf.sort_values(["tokens", "first", "class_id"], ascending=[False, True, True], kind="stable").itertuples(index=False):
            if all(r.last < k.first or k.last < r.first or (k.first <= r.first and r.last <= k.last) or (r.first <= k.first and k.last <= r.last) for k in kept):
                kept.append(r)
        rows = []
        for r in kept:
            around = [k for k in kept if k is not r and k.first <= r.first and r.last <= k.last and (k.last - k.first, k.tokens) > (r.last - r.first, r.tokens)]
            rows.append((*r, min(around, key=lambda k: k.last - k.first).class_id if around else None))
        return pd.DataFrame(rows, columns=[*pdf.columns, "parent"]).astype({"parent": "Int64"})

    return spans.groupBy(*OF).applyInPandas(nest, StructType([*spans.schema.fields, StructField("parent", LongType())]))


def main_text(page: str | None, fixed: set[int] | frozenset = frozenset()) -> str:
    """The blocks in the slots that the template tokens ``fixed`` leave.

    Where the page marks an article, only blocks in one count. Each block is a
    line; blocks of navigation and the like are left out.
    """
    return _main_text(list(parse(page)), fixed)


def _main_text(tokens: list[tuple[str, Block | None]], fixed: set[int] | frozenset) -> str:
    blocks = [b for _, b in tokens if b is not None and not b.aside]
    marked = any(b.article for b in blocks)
    blocks = [b for b in blocks if b.article or not marked]
    if not fixed:
        return "\n".join(b.text for b in blocks)
    weight: dict[int, list[int]] = {}  # of each slot: characters in fixed blocks, and in others
    known, filler = [], []
    for b in blocks:
        slot = 0 if marked else b.section
        known.append(key_of("", b) in fixed)
        words = b.words()
        filler.append(not known[-1] and bool(words) and sum(word_key(b.path, w) in fixed for w in words) > MOSTLY * len(words))
        weight.setdefault(slot, [0, 0])[0 if known[-1] or filler[-1] else 1] += len(b.text)
    whole = sum(map(sum, weight.values()))
    most = max(weight, key=lambda s: sum(weight[s]), default=None)
    stays = []
    for b, set_in, patterned in zip(blocks, known, filler):
        slot = 0 if marked else b.section
        still, moving = weight[slot]
        # An article that all pages carry: its slot has next to nothing else, and the page has nothing of its weight.
        carried = still > moving if marked or moving else slot == most and still > MOSTLY * whole
        stays.append(carried if set_in else carried or not patterned)
    return "\n".join(b.text for b, s in zip(blocks, stays) if s)


def extract(pages: DataFrame) -> DataFrame:
    """One row per row of ``pages`` (needs page_id, url, html): page_id, url, text, n_chars, template_tokens.

    Null html counts as empty and gives an empty text; a null url or one
    without a host belongs to the host "". Repeated rows are each extracted.
    Layouts of fewer than ``PAGES`` different pages have no template; their
    pages are read by their marks alone. An empty table gives an empty result.
    """
    slim = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    found = stage(classes(slim.where("html != ''")), "template-classes")
    valid = template(found).select(*OF, "class_id", "support", "tokens")
    layouts = found.join(valid, [*OF, "class_id", "support", "tokens"]).groupBy(*OF).agg(F.collect_set("key").alias("fixed"))
    hosts = stage(layouts.groupBy("host").agg(F.map_from_entries(F.collect_list(F.struct("layout", "fixed"))).alias("fixed")), "templates")
    kinds = {c: pages.schema[c].dataType.simpleString() for c in ("page_id", "url")}
    out = f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars bigint, template_tokens int"

    def of(pdf: pd.DataFrame, by_layout: list) -> pd.DataFrame:
        texts, sizes = [], []
        for page, layouts in zip(pdf["html"], by_layout):
            tokens = list(parse(page))
            fixed = layouts.get(layout_of(tokens), frozenset()) if layouts else frozenset()
            texts.append(_main_text(tokens, fixed))
            sizes.append(len(fixed))
        return pd.DataFrame({"page_id": pdf["page_id"], "url": pdf["url"], "text": texts, "n_chars": list(map(len, texts)), "template_tokens": sizes})

    def sets(layouts) -> dict[int, frozenset]:
        return {k: frozenset(v) for k, v in (layouts.items() if isinstance(layouts, dict) else layouts)}

    size = hosts.agg(F.sum(F.aggregate(F.map_values("fixed"), F.lit(0), lambda n, x: n + F.size(x)))).first()[0] or 0
    if size <= TEMPLATE_ROWS:
        known = pages.sparkSession.sparkContext.broadcast({r["host"]: sets(r["fixed"]) for r in hosts.toLocalIterator()})

        def by_host(batches):
            for pdf in batches:
                yield of(pdf, [known.value.get(h) for h in pdf["host"]])

        return slim.mapInPandas(by_host, out)

    def beside(batches):
        for pdf in batches:
            yield of(pdf, [None if f is None else sets(f) for f in pdf["fixed"]])

    return slim.join(hosts.hint("merge"), "host", "left").mapInPandas(beside, out)
