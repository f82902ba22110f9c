"""Web pages: visible text, where its nodes lie, lists, and URL filters."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosegauge.functions.phrases import with_blanks
from prosegauge.functions.spans import covering

# Elements that end a line, elements that hold no prose, elements without an end tag. dialog, tbody, thead and tfoot are ours.
BLOCKS = frozenset("address article aside blockquote br dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table tbody td tfoot th thead tr ul".split())
#: What a head may hold; any other element ends it, written end tag or not.
HEAD = frozenset("base basefont bgsound head html link meta noscript script style template title".split())
SKIPPED = frozenset("script style noscript template code kbd samp textarea input select option svg math".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_CLOSES_P = BLOCKS - {"br"}
PAGE = "text string, segments array<struct<buf_start:int,len:int,parent_tag:string>>, li_total int, li_bold int"


class _Flattener(HTMLParser):
    """The body's text nodes in order, a newline around blocks, hidden and editable parts left out.

    Hidden: the attribute, or display:none / visibility:hidden in an inline
    style; other style sheets are not applied. List items are counted over the
    whole page, hidden ones too; bold are those whose first element is strong or b.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.size, self.segments = [], 0, []
        self.open: list[tuple[str, bool]] = []  # tag, whether what is inside is left out
        self.in_head = False
        self.same_node = False  # whether only character data came since the last piece of it
        self.li: list[bool | None] = []  # for open items: None until their first element
        self.li_total = self.li_bold = 0

    def _newline(self) -> None:
        if self.size and not self.out[-1].endswith("\n"):
            self.out.append("\n")
            self.size += 1

    def _silent(self) -> bool:
        return self.in_head or bool(self.open and self.open[-1][1])

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a, self.same_node = {k: (v or "") for k, v in attrs}, False
        if tag in ("head", "title"):
            self.in_head = tag == "head" or self.in_head
        elif self.in_head and tag not in HEAD:
            self._close("head")
            self.in_head = False
        if self.li and self.li[-1] is None:
            self.li[-1] = tag in ("strong", "b")
            self.li_bold += self.li[-1]
        if tag in _CLOSES_P and any(t == "p" for t, _ in self.open):
            self._close("p")
        if tag == "li":
            if any(t == "li" for t, _ in self.open) and self.open[-1][0] not in ("ul", "ol"):
                self._close("li")
            self.li_total += 1
        style = a.get("style", "").replace(" ", "").lower()
        hidden = tag in SKIPPED or "hidden" in a or "display:none" in style or "visibility:hidden" in style
        editable = "contenteditable" in a and a["contenteditable"].lower() in ("", "true")
        silent = self._silent() or hidden or editable or tag == "title"
        if tag in BLOCKS and not silent:
            self._newline()
        if tag not in VOID:
            self.open.append((tag, silent))
            if tag == "li":
                self.li.append(None)

    def handle_endtag(self, tag: str) -> None:
        if tag == "head":
            self.in_head = False
        self._close(tag)

    def _close(self, tag: str) -> None:
        if not any(t == tag for t, _ in self.open):
            return  # an end tag of nothing parts no text
        self.same_node = False
        while True:
            own, silent = self.open.pop()
            if own == "li" and self.li:
                self.li.pop()
            if own in BLOCKS and not silent:
                self._newline()
            if own == tag:
                return

    def handle_data(self, data: str) -> None:
        if not data or self._silent():
            return
        if self.same_node:  # a stray < or an end tag of nothing: the parser gives one text in pieces
            self.segments[-1]["len"] += len(data)
        else:
            self.segments.append({"buf_start": self.size, "len": len(data), "parent_tag": self.open[-1][0] if self.open else None})
        self.out.append(data)
        self.size += len(data)
        self.same_node = True

    def handle_comment(self, data: str) -> None:
        self.same_node = False


def flatten_html(html: str | None) -> tuple[str, list[dict], int, int]:
    """(text, segments, list items, bold-lead list items); null and empty pages have an empty text."""
    f = _Flattener()
    f.feed(html or "")
    f.close()
    return "".join(f.out), f.segments, f.li_total, f.li_bold


def flatten(pages: DataFrame) -> DataFrame:
    """pages with text, segments, li_total and li_bold from html. Extra columns stay; those four are replaced."""

    @F.pandas_udf(PAGE)
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            yield pd.DataFrame([flatten_html(h) for h in s], columns=["text", "segments", "li_total", "li_bold"])

    names = ["text", "segments", "li_total", "li_bold"]
    out = pages.drop(*names).select(F.struct("*").alias("row"), of.asNondeterministic()("html").alias("page"))
    return out.select("row.*", *[F.col(f"page.{x}").alias(x) for x in names])


def segment_rows(flat: DataFrame, keys: list[str]) -> DataFrame:
    """One row a text node: keys, seg_idx, buf_start, len, parent_tag."""
    return flat.select(*keys, F.posexplode("segments").alias("seg_idx", "s")).select(*keys, "seg_idx", "s.*")


def in_segments(matches: DataFrame, segments: DataFrame, key: str = "page_id") -> DataFrame:
    """matches with first_seg, first_at, last_seg, last_at: the nodes that hold a match's start and last character.

    Two interval joins on the page's key and bins of places. A match of no length, or one that
    begins or ends on a newline that flattening put in, has no node and drops out.
    """
    out = matches.where("end > start").withColumnsRenamed({"start": "_start", "end": "_end"})
    for name, pos in (("first", F.col("_start")), ("last", F.col("_end") - 1)):
        nodes = segments.select(key, F.col("seg_idx").alias(f"{name}_seg"), F.col("buf_start").alias("start"), (F.col("buf_start") + F.col("len")).alias("end"))
        out = covering(out.withColumn("pos", pos), nodes, key).withColumn(f"{name}_at", F.col("pos") - F.col("start")).drop("pos", "start", "end")
    return out.withColumnsRenamed({"_start": "start", "_end": "end"})


def buffer_offsets(probes: DataFrame, segments: DataFrame, key: str = "page_id") -> DataFrame:
    """probes(key, seg_idx, offset) with buf_offset: the node's start plus the offset, at most its length; -1 for an unknown node."""
    s = segments.select(key, "seg_idx", "buf_start", "len")
    at = F.coalesce(F.col("buf_start") + F.least("offset", "len"), F.lit(-1))
    return probes.join(s, [key, "seg_idx"], "left").withColumn("buf_offset", at).drop("buf_start", "len")


def scannable(url: Column) -> Column:
    return F.coalesce(url.rlike(r"(?i)\Ahttps?:"), F.lit(False))


def origin(url: Column) -> Column:
    """scheme://host[:port], lower-cased, without user and default port; null for what is no http(s) URL."""
    scheme = F.lower(F.regexp_extract(url, r"(?i)\A(https?)://", 1))
    host = F.lower(F.regexp_extract(url, r"(?i)\Ahttps?://(?:[^/?#@]*@)?([^/?#]+)", 1))
    port = F.when(scheme == "http", F.regexp_replace(host, r":80\z", "")).otherwise(F.regexp_replace(host, r":443\z", ""))
    return F.when(scannable(url) & (host != ""), F.concat(scheme, F.lit("://"), port))


def normalised(url: Column) -> Column:
    """Trimmed http(s) URLs as they are, a bare host with https:// before it, anything else empty."""
    u = F.regexp_replace(F.coalesce(url, F.lit("")), with_blanks(r"\A\s+|\s+\z"), "")
    bare = u.rlike(r"(?i)\A[\w.-]+\.[a-z]{2,}(?:[/:?#]|\z)")
    return F.when(u.rlike(r"(?i)\Ahttps?://"), u).when(bare, F.concat(F.lit("https://"), u)).otherwise("")


def allowed(pages: DataFrame, origins: DataFrame, keep: bool = True) -> DataFrame:
    """pages whose url's origin is in origins(origin), or (keep=False) those whose origin isn't."""
    own = pages.withColumn("_origin", origin(F.col("url")))
    listed = origins.select(F.col("origin").alias("_origin")).distinct()
    return own.join(listed, "_origin", "left_semi" if keep else "left_anti").drop("_origin")
