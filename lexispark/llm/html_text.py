"""Main text of web pages by site style trees.

Pages of a host are merged: an element is known by its path of tags and classes, and at each element the style tree
counts the sequences of children that pages show there (presentation) and the texts (content). Presentation is
important where pages differ: the entropy of the child sequences, to the base of the number of pages. A text is
important where it is the page's own: 1 - log(pages with it) / log(pages). A block's importance joins both, less the
share of its text that is links; blocks under LEAST_IMPORTANCE go. Elements that say what they are need no statistics:
navigation, page headers and footers, sidebars, notices, adverts, forms and comments go, and what an article or main
element holds stays, however often it repeats on a site. A class name, id or role counts only if all of its words are names
of such parts, and never against an article or main element on or around which it stands, other than inside an article.

Scale: a page sends a pair of hashes for each block that is in question, counts combine on the map side, and only lists
of blocks to remove return to the pages, which are parsed again where they are.

Defined results: null html is empty; pages without text give ''; broken markup is read as browsers do as far as blocks
go (missing end tags, end tags without start, unclosed comments and scripts up to the end); a null or odd URL is a host
of its own (''); repeated rows are kept.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.llm import common

LEAST_IMPORTANCE = 0.3
#: Weight of the content against the presentation of the element that holds it.
CONTENT_WEIGHT = 0.7

#: Element names of HTML by what they do.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = set("head script style noscript template svg math iframe object canvas audio video textarea select button".split())
BLOCKS = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul br".split())
CLOSES_P = BLOCKS - {"br", "option"}
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
FENCES = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}}
ASIDE_TAGS = set("nav footer aside form dialog menu".split())
#: Words in class, id and role attributes that name parts which are no article.
ASIDE_WORDS = set("ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus footer form gdpr header masthead menu modal nav navbar navigation newsletter notice pagination pager popup promo promoted recommended related replies reply respond share sharing sidebar social sponsor sponsored subscribe toolbar widget alert contentinfo complementary search login signup".split())
CONTENT_TAGS = {"article", "main"}

RAW = "script|style|noscript|template|svg|math|iframe|object|canvas|audio|video|textarea|select"
TOKEN = re.compile(rf"""<!--.*?(?:-->|\Z)|<({RAW})\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<[/!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.S | re.I)
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
WORD = re.compile(r"[A-Za-z]+")


class Block:
    __slots__ = ("text", "links", "path", "keep")

    def __init__(self, text: str, links: int, path: str, keep: bool | None):
        self.text, self.links, self.path, self.keep = text, links, path, keep


def _names(tag: str, attributes: str) -> tuple[str, set[str]]:
    """How the style tree knows an element, and those tokens of its attributes (class names, id, role) that consist of words for asides only: cookie-notice does, search-methods does not."""
    if not attributes or "=" not in attributes:
        return tag, set()
    found = [(a.lower(), v.strip("\"'")) for a, v in ATTRIBUTE.findall(attributes)]
    asides = {x for _, v in found for x in v.lower().split() if (own := WORD.findall(x)) and ASIDE_WORDS.issuperset(own)}
    style = ".".join(sorted(v for a, v in found if a == "class"))
    return f"{tag}.{style}" if style else tag, asides


def parse(page: str) -> tuple[list[Block], dict[str, list[str]]]:
    """Blocks of a page in order, and the children of each element that is in question. keep: True inside articles, False in other parts that say what they are, None if in question."""
    blocks: list[Block] = []
    children: dict[str, list[str]] = {}
    stack: list[tuple[str, str, bool | None, bool]] = [("", "", None, False)]  # tag, path, keep, in a link
    buffer: list[str] = []
    links = at = 0

    def flush() -> None:
        nonlocal links
        if buffer:
            text = " ".join(entities.unescape("".join(buffer)).split())
            if text:
                blocks.append(Block(text, min(links, len(text)), block_path, block_keep))
            buffer.clear()
        links = 0

    block_path, block_keep = "", None
    for m in TOKEN.finditer(page):
        if m.start() > at:
            piece = page[at : m.start()]
            buffer.append(piece)
            if stack[-1][3]:
                links += len(piece)
        at = m.end()
        tag = m[3] or m[6]
        if not tag:
            continue
        tag, closing = tag.lower(), bool(m[2] or m[5])
        if tag in BLOCKS:
            flush()
        if closing:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
            if stack[-1][2] is not block_keep:
                flush()
            block_path, block_keep = stack[-1][1], stack[-1][2]
            continue
        if tag in CLOSES_P:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == "p":
                    del stack[i:]
                    break
                if stack[i][0] in CLOSES_P:
                    break
        if tag in SIBLINGS:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in SIBLINGS[tag]:
                    del stack[i:]
                    break
                if stack[i][0] in FENCES[tag]:
                    break
        if tag in VOID:
            continue
        name, asides = _names(tag, m[4] or m[7] or "")
        _, path, keep, link = stack[-1]
        if tag in SKIPPED:
            own = False
        elif tag in CONTENT_TAGS and (keep is not False or not {"aside", "form", "dialog"} & (around := {s[0] for s in stack}) and ("article" not in around or {"nav", "header", "footer"} & around)):
            own = True
        elif asides and tag not in ("html", "body"):
            own = False
        elif tag in ASIDE_TAGS or tag == "header" and keep is None:
            own = False
        else:
            own = keep
        path = f"{path}>{name}" if tag in BLOCKS or own is not keep else path
        if own is None and tag in BLOCKS:
            children.setdefault(stack[-1][1], []).append(name)
        stack.append((tag, path, own, link or tag == "a"))
        if tag in BLOCKS or own is not keep:
            if own is not keep:
                flush()
            block_path, block_keep = path, own
    if at < len(page):
        buffer.append(page[at:])
    flush()
    return blocks, children


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def _hash(*parts: str) -> int:
    return xxhash.xxh3_64_intdigest("\x00".join(parts)) - (1 << 63)


def text_of(blocks: list[Block], removed: set[int]) -> str:
    return " ".join(b.text for i, b in enumerate(blocks) if b.keep or b.keep is None and i not in removed)


def _page(url: str, html: str):
    """What the tree knows a page by."""
    return F.xxhash64(common.quoted(url).cast("string"), common.quoted(html).cast("binary"))


def importances(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(page, block, importance) of the blocks in question: a page is known by a hash of URL and page, a block by its number in it."""

    def observe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in common.chunks(batches, "html"):
            rows = []
            for raw, link, page in zip(*(table.column(c).to_pylist() for c in ("html", "url", "page")), strict=True):
                blocks, children = parse((raw or b"").decode("utf-8", "replace"))
                host = host_of(link)
                for path, names in children.items():
                    rows.append((page, -1, _hash(host, path), _hash(*names), 0.0))
                for i, b in enumerate(blocks):
                    if b.keep is None:
                        rows.append((page, i, _hash(host, b.path), _hash(b.text), b.links / len(b.text)))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64()], strict=True)], names=["page", "block", "node", "feature", "links"])

    source = pages.select(common.quoted(url).cast("string").alias("url"), common.binary(html).alias("html"), _page(url, html).alias("page"))
    seen = common.table(source.mapInArrow(observe, "page long, block int, node long, feature long, links double"), "observed")
    counts = seen.groupBy("node", (F.col("block") < 0).alias("style"), "feature").agg(F.count("*").cast("double").alias("n"))
    nodes = counts.groupBy("node", "style").agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.log("n")).alias("nlogn"))
    shape = nodes.where("style").select("node", F.when(F.col("m") > 1, (F.log("m") - F.col("nlogn") / F.col("m")) / F.log("m")).otherwise(1.0).alias("presentation"))
    texts = counts.where("not style").join(nodes.where("not style").select("node", "m"), "node").select("node", "feature", F.when(F.col("m") > 1, 1 - F.log("n") / F.log("m")).otherwise(1.0).alias("content"))
    judged = seen.where("block >= 0").join(texts, ["node", "feature"]).join(shape, "node", "left")
    importance = (F.lit(CONTENT_WEIGHT) * F.col("content") + F.lit(1 - CONTENT_WEIGHT) * F.coalesce("presentation", "content")) * (1 - F.col("links"))
    return judged.select("page", "block", importance.alias("importance"))


def removable(pages: DataFrame, url: str = "url", html: str = "html", least: float = LEAST_IMPORTANCE) -> DataFrame:
    """(page, removed): numbers of the blocks of low importance."""
    low = importances(pages, url, html).where(F.col("importance") < least).select("page", "block").distinct()
    return common.table(low.groupBy("page").agg(F.collect_list("block").alias("removed")), "removed")


def extract(pages: DataFrame, url: str = "url", html: str = "html", least: float = LEAST_IMPORTANCE) -> DataFrame:
    """pages with text and n_chars (code points); columns of these names are replaced."""
    common.tune(pages.sparkSession)
    page, low = (common.free_name(pages, x) for x in ("page", "removed"))
    removed = common.sized(removable(pages, url, html, least).select(F.col("page").alias(page), F.col("removed").alias(low)), rows=100_000)
    kept = [c for c in pages.columns if c.lower() not in ("text", "n_chars") and c != html]  # numbered on the way, so names of any kind will do
    numbered = [common.quoted(c).alias(f"c{i}") for i, c in enumerate(kept)]
    schema = common.extended(pages.select(*numbered).schema, "text string, n_chars long")
    source = pages.withColumn(page, _page(url, html)).join(removed, page, "left").select(*numbered, F.col(low).alias("removed"), common.binary(html).alias("raw"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in common.chunks(batches, "raw"):
            texts = [text_of(parse((x or b"").decode("utf-8", "replace"))[0], set(gone or ())) for x, gone in zip(table.column("raw").to_pylist(), table.column("removed").to_pylist(), strict=True)]
            out = table.drop_columns(["raw", "removed"]).append_column("text", pa.array(texts, pa.string())).append_column("n_chars", pa.array([len(t) for t in texts], pa.int64()))
            yield from out.to_batches()

    return source.mapInArrow(run, schema).select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(kept)), "text", "n_chars")


def query(spark, sf_dir: str) -> DataFrame:
    """op8: main text of every page."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "url", "text", "n_chars")
