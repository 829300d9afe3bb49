"""Main text of web pages by deducing each host's template.

Tokens are block tags and pieces of text, each told apart by the path of elements
it stands in. Tokens of a host that occur equally often on every one of its pages
share an occurrence vector and form a class; classes large and frequent enough,
whose places nest, make up the host's template. What the template leaves open are
slots: the innermost template element that holds the varying text is where a
page's article stands, and text that is part of the template is none of it.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import released, utf8_column, written
from tideline.llm.urls import host_of

# Elements that stand inside a line, elements without content, and elements without readable text.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track".split())
UNREAD = "script|style|noscript|template|textarea|iframe|svg|math|object|select|button|canvas|audio|video"
# Elements and words of class or id that mark menus, headers, footers, sidebars, notices, adverts, forms and comments.
CHROME_TAGS = frozenset("head nav footer aside dialog menu".split())
CHROME_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising breadcrumb breadcrumbs consent cookie cookies footer gdpr masthead nav navbar "
    "navigation newsletter popup promo sidebar signup sponsored subscribe toolbar widget".split()
)
# Words that mean furniture only where a name begins with them: share-buttons, not market-share.
LEADING_WORDS = frozenset("banner disclaimer header menu notice notices related respond share sharing social sponsor".split())
COMMENT_WORDS = frozenset("comment comments commentlist discussion disqus replies responses".split())
# Words by which a name says what an element has or how it is set, not what it is.
NO_NOUNS = frozenset("allowed closed disabled enabled has hidden is no off on open show with without".split())
# Elements that say themselves that they are the content, asked only where no template tells it.
CONTENT_TAGS = ("article", "main")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Elements of single paragraphs and titles, too small for a slot.
TEXT_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre blockquote figure figcaption option".split())

# Inside of a tag: quoted values may hold ``>``.
INSIDE = r"""(?:=\s*(?:"[^"]*"|'[^']*')|[^>])*+"""
TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<({UNREAD})\b{INSIDE}>.*?(?:</\1\s*>|\Z)|<[/!?a-zA-Z]{INSIDE}(?:>|\Z)|[^<]+|<", re.S | re.I)
TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
NAMED = re.compile(r"""(?<![\w-])(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
WORD = re.compile(r"[a-z]+")

# A class belongs to the template if it has so many tokens, and so many pages, among them this share of its host's.
CLASS_TOKENS = 2
CLASS_PAGES = 3
CLASS_SHARE = 0.8
# The slot of the article holds at least this share of the host's varying text.
SLOT_SHARE = 0.8
# Templates of this many tokens in all are sent to the tasks; larger ones are joined by host.
SENT_TOKENS = 1_000_000
PAGES_PER_SALT = 5_000


@dataclass
class Block:
    path: str
    text: str
    token: int


def _element(name: str, tag: str) -> str:
    """The name of an element in a path. Before it: ``!`` chrome by its tag, ``^`` a header, ``%`` comments, ``?`` chrome by its words, or a form."""
    given = [WORD.findall(single.lower()) for value in NAMED.findall(tag) for single in value.strip("\"'").split()]
    plain = "#".join([name, *sorted({w for words in given for w in words})])
    if name in ("html", "body"):
        return plain
    if name in CHROME_TAGS:
        return "!" + plain
    if name == "header":
        return "^" + plain
    nouns = [words for words in given if words and NO_NOUNS.isdisjoint(words)]
    if any(not COMMENT_WORDS.isdisjoint(words) for words in nouns):
        return "%" + plain
    # Single paragraphs and titles are named for what they say.
    furniture = name not in TEXT_TAGS and any(words[0] in LEADING_WORDS for words in nouns)
    return ("?" if name == "form" or furniture or any(not CHROME_WORDS.isdisjoint(words) for words in nouns) else "") + plain


def _key(path: str, text: str) -> int:
    return xxhash.xxh3_64_intdigest(f"{path}\x00{text}") - (1 << 63)


def parse(page: str) -> tuple[list[Block], dict[str, int]]:
    """Blocks of text in page order, and how often each path of block elements opens."""
    blocks: list[Block] = []
    opened: dict[str, int] = {}
    names: list[str] = []
    paths = [""]
    line: list[str] = []

    def end_block() -> None:
        text = " ".join(html.unescape("".join(line)).split())
        if text:
            blocks.append(Block(paths[-1], text, _key(paths[-1], text)))
        line.clear()

    for match in TOKEN.finditer(page):
        token = match.group()
        if token[0] != "<" or token == "<":
            line.append(token)
            continue
        if match.group(1) is not None or token.startswith(("<!", "<?")):
            # Unread elements and comments part words but not blocks.
            line.append(" " if match.group(1) is not None else "")
            continue
        found = TAG.match(token)
        if found is None:
            line.append(" ")
            continue
        closing, name = found.group(1), found.group(2).lower()
        if name in INLINE:
            continue
        if name == "br" or name in VOID:
            line.append(" ")
            if name == "hr":
                end_block()
            continue
        end_block()
        if closing:
            if name in names:
                while names.pop() != name:
                    paths.pop()
                paths.pop()
            continue
        if name in ("p", "li", "dt", "dd", "tr", "td", "th", "option") and names and names[-1] == name:
            names.pop()
            paths.pop()
        elif names and names[-1] == "p":
            # A block element ends the paragraph before it.
            names.pop()
            paths.pop()
        names.append(name)
        paths.append(f"{paths[-1]}/{_element(name, token)}")
        opened[paths[-1]] = opened.get(paths[-1], 0) + 1
    end_block()
    return blocks, opened


def _occurrences(pages: DataFrame) -> DataFrame:
    """Per host and token: kind (page, tag, text), path, pages, occurrences, two sums that stand for the vector
    of occurrences by page, place (sum of first places), chars. Added up where pages are read, then by host and token."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str, int], list] = {}
        for batch in batches:
            for page_id, host, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), utf8_column(batch.column(2))):
                blocks, opened = parse(raw.decode("utf-8", "replace"))
                found = {("tag", path, 0): [n, i, 0] for i, (path, n) in enumerate(opened.items())}
                for i, block in enumerate(blocks):
                    own = found.setdefault(("text", block.path, block.token), [0, len(opened) + i, 0])
                    own[0] += 1
                    own[2] += len(block.text)
                found["page", "", 0] = [1, 0, 0]
                for (kind, path, token), (n, place, chars) in found.items():
                    vector = xxhash.xxh3_64_intdigest(f"{page_id} {n}")
                    own = held.setdefault((host, kind, path, token), [0, 0, 0, 0, 0, 0])
                    for at, value in enumerate((1, n, vector >> 32, vector & 0xFFFFFFFF, place, chars)):
                        own[at] += value
                if len(held) >= 100_000:
                    yield _stats(held)
                    held.clear()
        yield _stats(held)

    names = ("pages", "occurrences", "v1", "v2", "place", "chars")
    schema = "host string, kind string, path string, token long, " + ", ".join(f"{n} long" for n in names)
    return pages.mapInArrow(released(count), schema).groupBy("host", "kind", "path", "token").agg(*[F.sum(n).alias(n) for n in names])


def _stats(held: dict) -> pa.RecordBatch:
    keys, values = list(held), list(held.values())
    kinds = [pa.string(), pa.string(), pa.string(), pa.int64()]
    columns = [pa.array([k[i] for k in keys], kinds[i]) for i in range(4)] + [pa.array([v[i] for v in values], pa.int64()) for i in range(6)]
    return pa.RecordBatch.from_arrays(columns, names=["host", "kind", "path", "token", "pages", "occurrences", "v1", "v2", "place", "chars"])


def _nested(classes: list[tuple[float, float, int]]) -> set[int]:
    """Of classes (first place, last place, number) those whose spans nest: a class that crosses one kept before goes."""
    kept: list[tuple[float, float, int]] = []
    for low, high, number in sorted(classes, key=lambda c: (c[0] - c[1], c)):
        if all(high <= a or low >= b or (a <= low and high <= b) for a, b, _ in kept):
            kept.append((low, high, number))
    return {number for _, _, number in kept}


def host_templates(pages: DataFrame, slot_share: float = SLOT_SHARE) -> DataFrame:
    """Per host with a template: host, pages, root (path of the article's slot; empty if none), tokens (its constant texts).

    ``pages`` has page_id, host and html. Classes come from grouping tokens by their vectors; a host's
    template has at most about as many tokens as one of its pages, whatever the number of its pages.
    """
    stats = written(_occurrences(pages))
    totals = stats.where("kind = 'page'").select("host", F.col("pages").alias("host_pages"))
    tokens = stats.where("kind <> 'page'")
    # Tokens on fewer pages can't be in a class that counts; they go before hosts are joined.
    frequent = tokens.where(F.col("pages") >= CLASS_PAGES).join(totals, "host").where(F.col("pages") >= CLASS_SHARE * F.col("host_pages"))
    classes = frequent.groupBy("host", "v1", "v2").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") >= CLASS_TOKENS)
    template = frequent.join(classes, ["host", "v1", "v2"]).select(
        "host", "host_pages", "kind", "path", "token", F.xxhash64("v1", "v2").alias("class"), (F.col("place") / F.col("pages")).alias("place"), F.lit(0).cast("long").alias("chars")
    )
    steps = F.split(F.expr("substring(path, 2)"), "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda n: F.concat(F.lit("/"), F.array_join(F.slice(steps, 1, n), "/")))
    # Text on most pages is part of the template and so no slot; the rest weighs the elements it stands in,
    # whatever words they are named by. Rare texts, nearly all of a host's, are added up without its number of pages.
    texts = tokens.where((F.col("kind") == "text") & (F.col("path") != "") & ~F.col("path").rlike("[!^]"))
    rare = texts.where(F.col("pages") < CLASS_PAGES)
    others = texts.where(F.col("pages") >= CLASS_PAGES).join(totals, "host").where(F.col("pages") < CLASS_SHARE * F.col("host_pages"))
    varying = (
        rare.select("host", "path", "chars")
        .unionByName(others.select("host", "path", "chars"))
        .groupBy("host", "path")
        .agg(F.sum("chars").alias("chars"))
        .select("host", "chars", F.explode(prefixes).alias("path"))
        .groupBy("host", "path")
        .agg(F.sum("chars").alias("chars"))
        .join(totals, "host")
        .select("host", "host_pages", F.lit("slot").alias("kind"), "path", F.lit(0).cast("long").alias("token"), F.lit(0).cast("long").alias("class"), F.lit(0.0).alias("place"), "chars")
    )

    elements = template.where("kind = 'tag'").select("host", "path").distinct()
    varying = varying.join(elements, ["host", "path"], "left_semi")

    def nest(rows: pd.DataFrame) -> pd.DataFrame:
        own = rows[rows.kind != "slot"]
        spans = [(float(g.place.min()), float(g.place.max()), int(c)) for c, g in own.groupby("class")]
        valid = own[own["class"].isin(_nested(spans))]
        elements = set(valid.path[valid.kind == "tag"])
        slots = rows[(rows.kind == "slot") & rows.path.isin(elements)]
        total = rows.chars[rows.kind == "slot"].max() if (rows.kind == "slot").any() else 0
        fitting = sorted(p for p, c in zip(slots.path, slots.chars) if c >= slot_share * total and c > 0 and _tag(p.rsplit("/", 1)[-1]) not in TEXT_TAGS)
        root = max(fitting, key=lambda p: p.count("/"), default="")
        texts = sorted(set(valid.token[valid.kind == "text"].tolist()))
        return pd.DataFrame({"host": [rows.host.iloc[0]], "pages": [int(rows.host_pages.iloc[0])], "root": [root], "tokens": [texts]})

    return template.unionByName(varying).groupBy("host").applyInPandas(nest, "host string, pages long, root string, tokens array<long>")


def _tag(step: str) -> str:
    return step.lstrip("!?^%").split("#")[0]


def _is_content(path: str) -> bool:
    """Whether some element of the path calls itself content."""
    return any(_tag(step) in CONTENT_TAGS for step in path.split("/"))


def _is_chrome(path: str, slot: str) -> bool:
    """Whether the path passes chrome inside the slot, or comments or a header there.

    Other words don't count on the way to an element that calls itself content, nor do headers.
    """
    steps = path[len(slot) :].split("/")[1:]
    last = max((i for i, step in enumerate(steps) if _tag(step) in CONTENT_TAGS), default=-1)
    return any(step[0] in "!%^" for step in steps) or any(step[0] == "?" for step in steps[last + 1 :])


def _is_title(path: str, slot: str) -> bool:
    """Whether the path is that of a heading in an article's own header: one inside content or a slot narrower than the page, and no other chrome."""
    steps = path[len(slot) :].split("/")[1:]
    headers = [i for i, step in enumerate(steps) if step[0] == "^"]
    if not headers or _tag(steps[-1]) not in HEADINGS:
        return False
    narrow = slot.count("/") > 2 or any(_tag(step) in CONTENT_TAGS for step in steps[: headers[0]])
    return narrow and not _is_chrome("/" + "/".join(step for step in steps if step[0] != "^"), "")


def main_text(page: str, root: str, constant: frozenset[int]) -> str:
    """The blocks in the article's slot, without chrome inside it and without the template's own text.

    Without a template, or where a page lacks its host's slot, elements that call themselves
    content are taken alone, else the whole page. Where words of class, id or role leave
    nothing, they are not asked. The title in an article's own header is read where the
    article has no other heading. A page with nothing but the template's text keeps that (its
    host has one text only).
    """
    blocks, _ = parse(page)
    inside = [b for b in blocks if b.path == root or b.path.startswith(root + "/")] if root else []
    slot, all_ = (root, inside) if inside else ("", blocks)
    headed = any(_tag(b.path.rsplit("/", 1)[-1]) in HEADINGS and not _is_chrome(b.path, slot) for b in all_)
    readable = [b for b in all_ if not _is_chrome(b.path, slot) or (not headed and _is_title(b.path, slot))]
    readable = readable or [b for b in all_ if not any(mark in b.path[len(slot) :] for mark in "!^%")]
    chosen = readable if inside else [b for b in readable if _is_content(b.path)] or readable
    own = [b for b in chosen if b.token not in constant]
    return "\n".join(b.text for b in (own or chosen))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", sent_tokens: int = SENT_TOKENS, slot_share: float = SLOT_SHARE) -> DataFrame:
    """Per page: page_id, url, text.

    Pages are read once for their hosts' templates and once for their texts; only
    token counts are exchanged. Templates small enough are sent to the tasks, else
    pages meet them in a join whose hosts are salted by their number of pages.

    Defined for odd input: a null or empty html has an empty text; a null url, or one
    without a host, belongs to the host ''; hosts of fewer than CLASS_PAGES pages have no
    template; repeated rows are extracted each; html cut off anywhere is read as far as it goes.
    """
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), host_of(F.col(url_col)).alias("host"), F.col(html_col).cast("string").alias("html")
    )
    templates = written(host_templates(rows.select("page_id", "host", "html"), slot_share))
    size = templates.agg(F.coalesce(F.sum(F.size("tokens") + 20), F.lit(0)).alias("n")).first()["n"]

    if size <= sent_tokens:
        sent = rows.sparkSession.sparkContext.broadcast({r["host"]: (r["root"], frozenset(r["tokens"])) for r in templates.collect()})

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known, none = sent.value, ("", frozenset())
            for batch in batches:
                texts = [main_text(raw.decode("utf-8", "replace"), *known.get(host, none)) for host, raw in zip(batch.column(2).to_pylist(), utf8_column(batch.column(3)))]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

        return rows.mapInArrow(released(read), "page_id long, url string, text string")

    salts = F.ceil(F.col("pages") / PAGES_PER_SALT).cast("int")
    spread = templates.select("host", salts.alias("salts"), "root", "tokens", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    # Each host's number of salts has to be known on both sides; it is small and grows with hosts, so it is joined too.
    salted = rows.join(templates.select("host", salts.alias("salts")), "host", "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("page_id"), F.col("salts")), F.lit(0)).cast("int"))
    joined = salted.drop("salts").join(spread.drop("salts"), ["host", "salt"], "left").select("page_id", "url", "html", F.coalesce("root", F.lit("")).alias("root"), F.coalesce("tokens", F.array().cast("array<long>")).alias("tokens"))

    def read_joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [
                main_text(raw.decode("utf-8", "replace"), root, frozenset(tokens))
                for raw, root, tokens in zip(utf8_column(batch.column(2)), batch.column(3).to_pylist(), batch.column(4).to_pylist())
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return joined.mapInArrow(released(read_joined), "page_id long, url string, text string")
