"""Main-text extraction by wrapper induction.

For each host some pages' trees are aligned by simple tree matching and merged into one: the
wrapper.  Every page of the host is then aligned to it, and over all its distinct pages is counted
what stands in each slot.  A text that stays the same in a slot on nearly all of them is template.
Of the text that varies, the article is where most of it is: from the top of the wrapper, always on
to the slot with most of it.  Slots beside that one are no content, whatever they are called.

Elements whose meaning is clear (nav, footer, aside, form, roles) never are content.  Names of classes
are looked at only outside articles, and decide little: what they mark mostly lies beside the article's slot.

Pages are not gathered by host.  They meet their host's wrapper through a broadcast
if all wrappers together are proven small, else through a salted join; the counts are
pre-aggregated, so a host with a third of all pages is no burden to one task.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .domtree import Shapes, blocks_of, dumped, loaded, merged, place_slots, read_tree, region
from .shared import written

#: Pages of a host that are merged into its wrapper, at most; the counts are over all its pages.
WRAPPER_PAGES = 8
#: A text is template if it is in the slot on this share of at least so many distinct pages of the host.
TEMPLATE_SHARE, TEMPLATE_PAGES = 0.8, 3
#: Wrappers and templates are broadcast up to this many bytes in all.
BROADCAST_BYTES = 32 << 20
#: Longer pages become part of a wrapper only where there are no others (all are aligned and extracted).
WRAPPER_CHARS = 50_000
SALTS = 32


class _Aligner:
    """Shapes, and what is known of some thousands of hosts, kept by a worker."""

    def __init__(self) -> None:
        self.shapes, self.wrappers, self.regions = Shapes(), {}, {}

    def tidied(self) -> None:
        if len(self.wrappers) > 5_000 or len(self.regions) > 5_000 or len(self.shapes.parts) > 200_000 or len(self.shapes.scores) > 2_000_000:
            self.__init__()

    def wrapper(self, text: str) -> int:
        if text not in self.wrappers:
            self.wrappers[text] = self.shapes.of(loaded(text))
        return self.wrappers[text]

    def blocks(self, page: str | None, wrapper: str | None):
        """(slot, text, characters of links) of a page's blocks, with slots of the wrapper, or of the page itself if there is none."""
        tree = read_tree(page or "")
        shape = self.shapes.of(tree)
        place_slots(self.shapes, self.wrapper(wrapper) if wrapper else shape, tree)
        return shape, [(node.slot, text, links) for node, text, links in blocks_of(tree)]

    def article(self, page: str | None, wrapper: str | None, masses, template: set[int]) -> str:
        """The article's blocks of one page; where the host's region is empty on it, by the page's own region."""
        self.tidied()
        shape, found = self.blocks(page, wrapper)
        kept = [x for x in found if not template or _mark(x[0], x[1]) not in template]
        if wrapper and masses:
            key = (wrapper, tuple(masses))
            if key not in self.regions:
                self.regions[key] = region(self.shapes, self.wrapper(wrapper), {s: (c, k) for s, c, k in masses})
            if lines := _within(kept, *self.regions[key]):
                return "\n".join(lines)
            template_texts = {x[1] for x in found} - {x[1] for x in kept}
            kept = [x for x in self.blocks(page, None)[1] if x[1] not in template_texts]
        own: dict[str, tuple[int, int]] = {}
        for slot, text, links in kept:
            chars, linked = own.get(slot, (0, 0))
            own[slot] = (chars + len(text), linked + links)
        return "\n".join(_within(kept, *region(self.shapes, shape, own)))


def _within(blocks, slot: str, heads: tuple[str, ...]) -> list[str]:
    """Texts of the blocks in a slot or below it, and of the headings that go with it."""
    below = slot + "/"
    return [text for own, text, _ in blocks if own == slot or own.startswith(below) or own in heads]


_aligners: list[_Aligner] = []


def _aligner() -> _Aligner:
    if not _aligners:
        _aligners.append(_Aligner())
    return _aligners[0]


def _mark(slot: str, text: str) -> int:
    return int.from_bytes(hashlib.blake2b(f"{slot}\0{text}".encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _wrap(batches):
    aligner = _aligner()
    for batch in batches:
        out = []
        for pages in batch.column("samples").to_pylist():
            aligner.tidied()
            out.append(dumped(merged(aligner.shapes, [read_tree(p) for p in pages])))
        yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(out, pa.string())], ["host", "wrapper"])


_MARKS = pa.list_(pa.struct([("mark", pa.int64()), ("slot", pa.string()), ("chars", pa.int64()), ("links", pa.int64())]))


def _marks(batches):
    aligner = _aligner()
    for batch in batches:
        signs, marks = [], []
        for page, wrapper in zip(batch.column("html").to_pylist(), batch.column("wrapper").to_pylist(), strict=True):
            aligner.tidied()
            _, found = aligner.blocks(page, wrapper)
            own = {}
            for slot, text, links in found:
                mark = _mark(slot, text)
                times = own[mark]["chars"] // max(1, len(text)) if mark in own else 0
                own[mark] = {"mark": mark, "slot": slot, "chars": len(text) * (times + 1), "links": links * (times + 1)}
            signs.append(_mark("", "\n".join(x[1] for x in found)))
            marks.append(list(own.values()))
        yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(signs, pa.int64()), pa.array(marks, _MARKS)], ["host", "sign", "marks"])


def _texts(batches):
    aligner = _aligner()
    for batch in batches:
        texts = []
        for page, wrapper, template, masses in zip(*(batch.column(c).to_pylist() for c in ("html", "wrapper", "template", "masses")), strict=True):
            texts.append(aligner.article(page, wrapper, [(m["slot"], m["chars"], m["links"]) for m in masses or ()], set(template or ())))
        texts = [t.encode("utf-8", "replace").decode("utf-8") for t in texts]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def _with_host(rows: DataFrame, by_host: DataFrame, size: int, dealt_by: str = "html") -> DataFrame:
    """rows joined with one row for each host, of `size` bytes in all."""
    if size <= BROADCAST_BYTES:
        return rows.join(F.broadcast(by_host), "host", "left")
    salted = by_host.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64(dealt_by), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], "left").drop("salt")


def _bytes(by_host: DataFrame, text: str | None, *arrays: tuple[str, int]) -> int:
    size = F.octet_length("host") + 64
    if text:
        size = size + F.coalesce(F.octet_length(text), F.lit(0))
    for name, each in arrays:
        size = size + each * F.coalesce(F.size(name), F.lit(0))
    return int(by_host.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0])


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of pages: page_id, url, text, n_chars.

    Null and empty pages give an empty text; pages without a host (null or relative url) are taken as one
    host.  Blocks are in page order, joined by one newline, white space within a block is one space, character
    references are decoded; nothing of the article is cut.  Repeated rows give repeated results, and count once in
    the induction; a host's only page is judged by its own text alone.  Other columns are ignored.
    """
    host = F.lower(F.coalesce(F.regexp_extract(F.col(url_col), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]*)", 1), F.lit("")))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"), host.alias("host"))
    beyond = F.greatest(F.length("html") - WRAPPER_CHARS, F.lit(0))
    hashed = rows.filter(F.length("html") > 0).withColumn("h", F.xxhash64("html"))
    # one page of each share of the hashes, so that equal pages count once and no host is gathered
    samples = hashed.groupBy("host", F.pmod("h", F.lit(WRAPPER_PAGES)).alias("share")).agg(F.min_by("html", F.struct(beyond, "h", "html")).alias("html"), F.min(beyond).alias("beyond"))
    short = F.filter(F.col("all"), lambda x: x["beyond"] == F.array_min(F.transform("all", lambda y: y["beyond"])))
    gathered = samples.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("beyond", "share", "html"))).alias("all")).select("host", F.transform(short, lambda x: x["html"]).alias("samples"))
    wrappers = written(gathered.mapInArrow(_wrap, "host string, wrapper string"), "wrappers")
    counted = _with_host(rows.select("html", "host"), wrappers, _bytes(wrappers, "wrapper")).select("host", "html", "wrapper").mapInArrow(_marks, "host string, sign long, marks array<struct<mark: long, slot: string, chars: long, links: long>>").dropDuplicates(["host", "sign"])
    counted = written(counted, "marks")
    distinct = counted.groupBy("host").agg(F.count("*").alias("n"))
    marks = counted.select("host", F.explode("marks").alias("m")).groupBy("host", "m.mark").agg(F.count("*").alias("seen"), F.min("m.slot").alias("slot"), F.sum("m.chars").alias("chars"), F.sum("m.links").alias("links"))
    constant = (F.col("n") >= TEMPLATE_PAGES) & (F.col("seen") >= TEMPLATE_SHARE * F.col("n"))
    marks = _with_host(marks, distinct, _bytes(distinct, None), "mark").withColumn("constant", constant)
    by_slot = marks.groupBy("host", "slot").agg(F.sum(F.when(~F.col("constant"), F.col("chars"))).alias("chars"), F.sum(F.when(~F.col("constant"), F.col("links"))).alias("links"), F.collect_list(F.when(F.col("constant"), F.col("mark"))).alias("template"))
    mass = F.when(F.col("chars").isNotNull(), F.struct("slot", "chars", "links"))
    of_host = by_slot.groupBy("host").agg(F.sort_array(F.flatten(F.collect_list("template"))).alias("template"), F.sort_array(F.collect_list(mass)).alias("masses"))
    known = written(wrappers.join(of_host, "host", "full"), "templates")
    id_type = rows.schema["page_id"].dataType.simpleString()
    return _with_host(rows, known, _bytes(known, "wrapper", ("template", 8), ("masses", 48))).select("page_id", "url", "html", "wrapper", "template", "masses").mapInArrow(_texts, f"page_id {id_type}, url string, text string, n_chars long")
