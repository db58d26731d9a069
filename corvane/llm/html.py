"""Main text of web pages: marked-up structure first, then a suffix array over the token streams of each host.

A page is parsed once and cut into blocks of text. Blocks inside menus, headers, footers, sidebars, forms, notices,
adverts and reader comments are left out by their element, role, or class or id of which each word says so. If the page
marks its main part, that is the text (only its articles, where they hold most of it), else its articles are. A main
part or article that stands within something left out counts where the page holds no other text, as when a form or a
sidebar's class wraps the whole page; never one in reader comments, a menu, a footer or an aside. An element left out
within a line takes its text away and does not part the block.

Inside an article a class or id that may well be its own ("related", "notice") or that only partly tells ("ad-slot") is
a hint: such blocks join the page's token stream, and what of them repeats on the host goes, the rest stays.

The blocks outside any article form the page's token stream. Streams are concatenated by host; a
string of LEAST tokens that stands on two distinct pages of the host is boilerplate. Where a page marks no article, its
text is what boilerplate does not cover: the unique runs. (Marked articles are not judged by repetition: two pages may
carry the same article, and both are to have its text; only hinted blocks within them are.)

No task holds a host: runs of windows with one least hashed token go to the bucket of host and token, where equal runs
are held once with their least and greatest page, and one suffix array finds what different runs share.

Cases: a null or empty page has an empty text. A null url has an empty host. Rows that share id and html count as one
page. Repeated rows give repeated results. An empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import Scratch, read, slices
from corvane.llm.segments import mix, segment_hashes
from corvane.llm.suffix import shared_groups
from corvane.llm.urls import host_of

LEAST = 12  # tokens
BUCKET_ROWS = 100_000
HELD_RUNS = 100_000  # equal runs that a task merges before it sends them
#: Elements whose content is no text, that hold no text, that end a block, and that are left out.
RAW = ("script", "style", "title", "template", "noscript", "iframe", "svg", "textarea", "select", "object", "canvas", "audio", "video")
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
BLOCK = set(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head "
    "header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
OUT = {"aside", "button", "dialog", "footer", "form", "head", "menu", "nav"}
OUT_ROLES = {"alert", "alertdialog", "banner", "complementary", "contentinfo", "dialog", "form", "menu", "menubar", "navigation", "search"}
OUT_CLASSES = set(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert newsletter subscribe "
    "subscription signup login popup modal overlay sidebar menu nav navbar navigation breadcrumb breadcrumbs masthead footer comment comments disqus reply replies respond "
    "share sharing social related recommended recommendations widget toolbar pagination pager".split()
)
CLOSED_BY_NEXT = {"p", "li", "dt", "dd", "option", "tr", "td", "th"}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>" + "|".join(RAW) + r")\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-z][a-z0-9:-]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|<(?P<end2>/?)(?P<tag2>[a-z][a-z0-9:-]*)[^>]*>|<[!?][^>]*>",
    re.S | re.I,
)
_ATTR = re.compile(r"([^\s=>\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
#: Elements whose id may say that they are left out, and classes of an article that is a comment.
NAMED = {"div", "ol", "section", "span", "table", "ul"}
#: Names of things left out that an article may well give to parts of its own.
OWN_NAMES = set("alert banner login menu notice notices overlay promo promotion recommended recommendations related share sharing social sponsor subscribe subscription toolbar widget".split())
NO_WRAPPER = {"aside", "dialog", "footer", "head", "menu", "nav"}
COMMENT_CLASSES = {"comment", "comments", "disqus", "reply", "replies", "respond"}


def attributes(written: str) -> dict[str, str]:
    """By full name in lower case, the first of each; one without a value has an empty one."""
    found: dict[str, str] = {}
    for name, *values in _ATTR.findall(written):
        found.setdefault(name.lower(), "".join(values).lower())
    return found


def _says_out(name: str, words: set[str] = OUT_CLASSES) -> bool:
    """Whether each word of a class or id is one of things left out: cookie-notice, but not no-sidebar or social-history."""
    return all(w in words for w in re.split(r"[-_]+", name.strip("-_")))


def _is_comment(tag: str, attrs: dict[str, str]) -> bool:
    names = [*attrs.get("class", "").split(), *([attrs["id"]] if tag in NAMED and "id" in attrs else [])]
    return any(_says_out(n, COMMENT_CLASSES | {"list"}) and n != "list" for n in names)


def _hints(tag: str, attrs: dict[str, str]) -> bool:
    """Whether inside an article only a hint says that the element is left out."""
    if tag in HEADINGS or tag in ("html", "body", "main", "article"):
        return False
    names = [*attrs.get("class", "").split(), *([attrs["id"]] if tag in NAMED and "id" in attrs else [])]
    telling = [n for n in names if _says_out(n)]
    return all(n in OWN_NAMES for n in telling) if telling else any(w in OUT_CLASSES for n in names for w in re.split(r"[-_]+", n))


def _left_out(tag: str, attrs: dict[str, str]) -> bool:
    if tag in OUT or "hidden" in attrs or attrs.get("aria-hidden") == "true" or attrs.get("role") in OUT_ROLES:
        return True
    if "display:none" in attrs.get("style", "").replace(" ", ""):
        return True
    if tag in HEADINGS or tag in ("html", "body", "main"):
        return False
    words = COMMENT_CLASSES if tag == "article" else OUT_CLASSES
    return _is_comment(tag, attrs) or any(_says_out(c, words) for c in attrs.get("class", "").split()) or (tag in NAMED and bool(attrs.get("id")) and _says_out(attrs["id"]))


ARTICLE, MAIN, OPEN, GONE, MAIN_ARTICLE, HIDDEN_ARTICLE = range(6)
HINTED = 8  # beside a kind
HELD = {"article", "body", "div", "header", "main", "ol", "section", "table", "ul"}  # elements that others may be closed by


def blocks(page: str) -> Iterator[tuple[int, str]]:
    """(kind, text) of the page's blocks in order: in an article, in the main part, in an article of it, outside all, left
    out, or in an article or main part within something left out; with HINTED, if a hint says it is no text."""
    # tag, left out (2: with all articles in it), article or main, in a line where its text begins, whether a hint says so
    stack: list[list] = []
    parts: list[str] = []

    def block() -> Iterator[tuple[int, str]]:
        cut = next((i for i, s in enumerate(stack) if s[3] is not None), len(stack))
        at = stack[cut][3] if cut < len(stack) else len(parts)
        for texts, over in ((parts[:at], stack[:cut]), (parts[at:], stack)):
            text = " ".join("".join(texts).split())
            if text:
                yield kind(over), text
        parts.clear()
        for s in stack[cut:]:
            s[3] = None if s[3] is None else 0

    def kind(over: list[list]) -> int:
        tags = [s[0] for s in over]
        main = next((i for i, s in enumerate(over) if s[2]), -1)
        article = tags.index("article") if "article" in tags else -1
        inside = main if article < 0 else article if main < 0 else min(main, article)
        gone = [i for i, s in enumerate(over) if (s[1] and not (s[4] and 0 <= inside < i)) or (s[0] == "header" and not 0 <= inside < i)]
        if gone and (inside < 0 or gone[-1] >= inside or any(over[i][1] == 2 for i in gone)):
            return GONE
        if inside < 0:
            return OPEN
        hint = HINTED if any(s[4] for s in over[inside + 1 :]) else 0
        return hint | (HIDDEN_ARTICLE if gone else MAIN_ARTICLE if 0 <= main < article else ARTICLE if main < 0 else MAIN)

    last = 0
    for m in _TOKEN.finditer(page):
        if m.start() > last:
            text = page[last : m.start()]
            parts.append(html.unescape(text) if "&" in text else text)
        last = m.end()
        tag = (m["tag"] or m["tag2"] or "").lower()
        if tag == "br":
            parts.append(" ")
        if not tag or tag in VOID:
            continue
        is_block = tag in BLOCK
        if is_block:
            yield from block()
        if m["end"] or m["end2"]:
            for at in range(len(stack) - 1, -1, -1):
                if stack[at][0] == tag:
                    if stack[at][3] is None:
                        yield from block()
                    else:
                        del parts[stack[at][3] :]
                    del stack[at:]
                    break
                if not is_block and stack[at][0] in BLOCK:
                    break
            continue
        if stack and is_block and (stack[-1][0] == "p" or (stack[-1][0] in CLOSED_BY_NEXT and stack[-1][0] == tag)):
            stack.pop()
        if tag == "body":
            stack[:] = [s for s in stack if s[0] != "head"]
        written = m["attrs"] or ""
        attrs = attributes(written) if written else {}
        gone, hint = int(_left_out(tag, attrs)), bool(written) and _hints(tag, attrs)
        if gone and (tag in NO_WRAPPER or attrs.get("role") in OUT_ROLES or _is_comment(tag, attrs)):
            gone = 2
        if gone and (gone == 2 or tag in OUT or "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in attrs.get("style", "").replace(" ", "")):
            hint = False
        if hint and not is_block:  # a word or two in a line are the article's, if they stand in one
            gone, hint = 0 if any(s[0] == "article" or s[2] for s in stack) else gone, False
        body = attrs.get("itemprop") == "articlebody"
        if (gone or hint or body or tag in HELD or attrs.get("role") == "main") and not written.rstrip().endswith("/"):
            stack.append([tag, gone, body or tag == "main" or attrs.get("role") == "main", len(parts) if gone and not hint and not is_block else None, hint])
    parts.append(html.unescape(page[last:]))
    yield from block()


def marked_kinds(found: list[tuple[int, str]]) -> tuple[int, ...]:
    """The kinds of blocks that are the text of a page that marks its article or main part; none for one that does not."""
    size = {kind: sum(len(t) for k, t in found if k & 7 == kind) for kind in (ARTICLE, MAIN, MAIN_ARTICLE, HIDDEN_ARTICLE)}
    if size[MAIN_ARTICLE] + size[MAIN]:
        return (MAIN_ARTICLE,) if size[MAIN_ARTICLE] >= size[MAIN] else (MAIN, MAIN_ARTICLE)
    if size[ARTICLE]:
        return (ARTICLE,)
    return (HIDDEN_ARTICLE,) if size[HIDDEN_ARTICLE] and not any(k == OPEN for k, _ in found) else ()


def marked_text(found: list[tuple[int, str]]) -> str | None:
    """The text of a page that marks its article or main part, hinted blocks included; None of one that marks none."""
    kinds = marked_kinds(found)
    return "\n\n".join(t for k, t in found if k & 7 in kinds) if kinds else None


def _judged(found: list[tuple[int, str]]) -> tuple[str | None, list[dict]]:
    """The text that stands as it is, if nothing is left to repetition, and the blocks of the page: those of the token
    stream, and in a page with hints the sure ones of its article too."""
    kinds = marked_kinds(found)
    outside = [{"gone": k == GONE, "sure": False, "text": t} for k, t in found if k in (OPEN, GONE)]
    if not kinds or not any(k & HINTED and k & 7 in kinds for k, _ in found):
        return marked_text(found), outside
    mixed = [{"gone": k & 7 not in kinds, "sure": k in kinds, "text": t} for k, t in found if k in (OPEN, GONE) or k & 7 in kinds]
    return None, mixed


def _stream(host: str, outside: list[dict]) -> tuple[list[str], np.ndarray]:
    """The tokens outside articles, and their hashes with the host's in them."""
    seed = xxhash.xxh64_intdigest(host.encode())
    tokens = [w for block in outside if not block["sure"] for w in block["text"].split(" ")]
    return tokens, np.fromiter((xxhash.xxh64_intdigest(w.encode(), seed) for w in tokens), np.uint64, len(tokens))


def _runs(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, least token) of the runs of windows with one least token."""
    if len(tokens) < LEAST:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    least = np.lib.stride_tricks.sliding_window_view(tokens, LEAST).min(axis=1)
    start = np.flatnonzero(np.append(True, least[1:] != least[:-1]))
    return start, np.append(start[1:], len(least)) + LEAST - 1, least[start]


def parsed(pages: DataFrame) -> DataFrame:
    """(page_id, url, html) to (page_id, url, host, page_key, text, outside): the marked text, or null if repetition is to
    judge, and the blocks outside articles or hinted at, each with whether it is left out anyway or is text for sure."""
    pages = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), host_of(F.col("url")).alias("host")).withColumn("page_key", F.xxhash64("page_id", "url", "html"))
    kinds = pa.list_(pa.struct([("gone", pa.bool_()), ("sure", pa.bool_()), ("text", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            texts, outside = zip(*(_judged(list(blocks(h))) for h in batch.column("html").to_pylist()))
            columns = [*(batch.column(c) for c in ("page_id", "url", "host", "page_key")), pa.array(texts, pa.string()), pa.array(outside, kinds)]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "host", "page_key", "text", "outside"])

    return pages.mapInArrow(run, "page_id long, url string, host string, page_key long, text string, outside array<struct<gone: boolean, sure: boolean, text: string>>")


def boilerplate(pages: DataFrame) -> DataFrame:
    """parsed() to (run long, covered binary): which tokens of a run stand on several pages."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list[int]] = {}

        def packed() -> pa.RecordBatch:
            least, most = (pa.array([v[k] for v in held.values()], pa.int64()) for k in (0, 1))
            anchor = pa.array([v[2] for v in held.values()], pa.int64())
            return pa.RecordBatch.from_arrays([anchor, pa.array(held, pa.binary()), least, most], ["anchor", "tokens", "least", "most"])

        for row in (row for batch in batches for row in batch.to_pylist()):
            _, tokens = _stream(row["host"], row["outside"])
            for a, b, anchor in zip(*_runs(tokens)):
                v = held.setdefault(tokens[a:b].tobytes(), [row["page_key"], row["page_key"], int(mix(anchor[None]).view(np.int64)[0])])
                v[0], v[1] = min(v[0], row["page_key"]), max(v[1], row["page_key"])
            if len(held) >= HELD_RUNS:
                yield packed()
                held.clear()
        yield packed()

    runs = pages.select("page_key", "host", "outside").mapInArrow(send, "anchor long, tokens binary, least long, most long")
    n = max(8, (pages.count() * 12) // BUCKET_ROWS)
    bucketed = runs.select(F.pmod("anchor", F.lit(n)).cast("int").alias("bucket"), "tokens", "least", "most")

    def judge(table: pa.Table) -> pa.Table:
        known: dict[bytes, int] = {}
        of = np.array([known.setdefault(t, len(known)) for t in table["tokens"].to_pylist()])
        least, most = np.full(len(known), np.iinfo(np.int64).max), np.full(len(known), np.iinfo(np.int64).min)
        np.minimum.at(least, of, table["least"].to_numpy())
        np.maximum.at(most, of, table["most"].to_numpy())
        size = np.fromiter((len(t) // 8 for t in known), np.int64, len(known))
        tokens = np.frombuffer(b"".join(known), np.uint64)
        begin = np.cumsum(size + 1) - size - 1
        symbols = np.ones(int((size + 1).sum()) + 1, np.int64)
        symbols[-1] = 0
        symbols[np.arange(len(tokens)) + np.repeat(np.arange(len(size)), size)] = np.unique(tokens, return_inverse=True)[1] + 2
        order, group = shared_groups(symbols, LEAST)
        run = np.searchsorted(begin, order, "right") - 1
        window = order - begin[run] + LEAST <= size[run]
        group, run, at = group[window], run[window], order[window]
        heads = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        lengths = np.diff(np.append(heads, len(group)))
        several = np.repeat(np.minimum.reduceat(least[run], heads) < np.maximum.reduceat(most[run], heads), lengths)
        cover = np.zeros(len(symbols) + LEAST, np.int64)
        np.add.at(cover, at[several], 1)
        np.add.at(cover, at[several] + LEAST, -1)
        covered = np.cumsum(cover) > 0
        hit = np.unique(run[several])
        keys = segment_hashes(tokens, (begin - np.arange(len(begin)))[hit], (begin - np.arange(len(begin)) + size)[hit]).view(np.int64)
        masks = [covered[begin[r] : begin[r] + size[r]].tobytes() for r in hit]
        return pa.table({"run": pa.array(keys, pa.int64()), "covered": pa.array(masks, pa.binary())})

    return bucketed.groupBy("bucket").applyInArrow(judge, "run long, covered binary")


def extract(pages: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(page_id, url, html) to (page_id, url, text string)."""
    scratch = scratch or Scratch(pages.sparkSession)
    pages = scratch.table(parsed(pages))
    marked, unmarked = pages.where("text is not null").select("page_id", "url", "text"), pages.where("text is null").drop("text")

    def open_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                tokens = _stream(row["host"], row["outside"])[1]
                start, end, _ = _runs(tokens)
                key = pa.array(np.full(len(start), row["page_key"]), pa.int64())
                yield pa.RecordBatch.from_arrays([key, pa.array(segment_hashes(tokens, start, end).view(np.int64)), pa.array(start, pa.int64())], ["page_key", "run", "start"])

    def unique_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for host, outside, spans in zip(*(batch.column(c).to_pylist() for c in ("host", "outside", "spans"))):
                covered = np.zeros(len(_stream(host, outside)[0]), bool)
                for s in spans or ():
                    mask = np.frombuffer(s["covered"], bool)
                    covered[s["start"] : s["start"] + len(mask)] |= mask
                at, kept = 0, []
                for block in outside:
                    if block["sure"]:
                        kept.append(block["text"])
                        continue
                    words = block["text"].split(" ")
                    left = [w for w, c in zip(words, covered[at : at + len(words)]) if not c]
                    at += len(words)
                    if left and not block["gone"]:
                        kept.append(" ".join(left))
                texts.append("\n\n".join(kept))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    covers = unmarked.mapInArrow(open_runs, "page_key long, run long, start long").distinct().join(boilerplate(pages), "run")
    spans = covers.groupBy("page_key").agg(F.collect_list(F.struct("start", "covered")).alias("spans"))
    rest = unmarked.join(spans, "page_key", "left").select("page_id", "url", "host", "outside", "spans")
    return marked.union(rest.mapInArrow(unique_runs, "page_id long, url string, text string"))


def op5_html(spark, sf_dir: str) -> DataFrame:
    out = extract(read(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
