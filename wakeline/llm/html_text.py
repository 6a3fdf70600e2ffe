"""Main text of web pages, without the boilerplate that pages of a host share.

1. A page is read into blocks: the text between block-level tags, outside scripts, styles,
   navigation, headers, footers, asides, forms and containers whose class, id or role is the
   name of such a part, a notice, an advert or comments. Names that only say that something
   has such a part (``has-sidebar``, ``share-enabled``) do not count, headings and ``article``
   and ``main`` elements are never set aside for their names, and where names would leave a
   page without text they are not looked at.
2. Blocks inside ``article`` or ``main`` elements are the page's body and stay, unless
   ``OUTSIDE`` times as many words stand outside them (a teaser beside a story); then, and
   without any, all blocks are candidates.
3. A run is the fewest whole blocks, from one on or up to one, with ``PASSAGE`` words or more.
   The runs of all pages of a host without a body element are counted by 128-bit digest, each
   once for every distinct page text, over the whole cluster: no host is cut.
4. A page text counts only if a fifth of its words (``OWN``) or more are outside the runs that
   ``SHARED`` texts have: copies and near copies of a page say nothing of its parts.
5. Blocks of runs that ``SHARED`` such texts or more of the host have are boilerplate and go,
   unless the page would have no text left.

Defined results: null and empty pages have empty text; null or odd URLs are one host; a tag
that is never closed ends where an article begins, or with the page; text that is not markup
is one block; repeated rows are separate pages; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeline.llm.staging import staged
from wakeline.llm.url_model import host_and_path

PASSAGE = 6
SHARED = 3
OWN = 0.2
OUTSIDE = 3

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[|<[!?][^>]*>|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>"']|"[^"]*"|'[^']*')*)>""", re.DOTALL)
_NAMED = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "math", "object", "select"}
_PARTS = {"nav", "footer", "aside", "form", "menu", "dialog", "button", "head"}
_BODY = {"article", "main"}
_INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark meter output picture progress q "
    "rp rt ruby s samp small span strike strong sub sup time tt u var wbr br input source".split()
)
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Words of a class, id or role that say an element is no main text.
_ASIDE_WORDS = set(
    "ad ads adv advert adverts advertisement advertising banner banners breadcrumb breadcrumbs comment comments complementary "
    "consent contentinfo cookie cookies disqus footer gdpr header masthead menu menubar modal nav navbar navigation newsletter notice "
    "notices pagination pager popup promo promoted promotion related reply replies search share sharing sidebar signup "
    "social sponsor sponsored subscribe toolbar widget widgets".split()
)


#: What such a name may be joined with: where a part stands or what it is made of.
_FILLERS = set("area bar block bottom box buttons container content global inner item items left links list main outer page right section site top wrap wrapper".split())
#: Elements that hold a part of a page; others are not set aside for their names.
_HOLDERS = set("div section ul ol dl table header details figure center fieldset p span td tr".split())


def _set_aside(attributes: str) -> bool:
    """Whether a class, id or role is the name of a part that is no main text."""
    for m in _NAMED.finditer(attributes):
        value = re.sub(r"([a-z])([A-Z])", r"\1-\2", m[1] or m[2] or m[3] or "").lower()
        for name in value.split():
            parts = {p for p in re.split(r"[^a-z]+", name) if p}
            if parts & _ASIDE_WORDS and parts <= _ASIDE_WORDS | _FILLERS:
                return True
    return False


def blocks(page: str, by_name: bool = True) -> list[tuple[str, bool]]:
    """Text and whether it is inside a body element, block by block, in page order.

    ``by_name``: set elements aside for their class, id or role too.
    """
    out: list[tuple[str, bool]] = []
    held: list[str] = []
    body = 0
    away: str | None = None  # the element whose end ends what is set aside
    depth, in_body_when_set = 0, 0

    def aside(name: str, attributes: str) -> bool:
        return by_name and name in _HOLDERS and _set_aside(attributes)

    def close() -> None:
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            if text:
                out.append((text, body > 0))
            held.clear()

    at = 0
    while True:
        m = _TAG.search(page, at)
        if away is None:
            held.append(page[at : m.start() if m else len(page)])
        if m is None:
            break
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        closing = bool(m[1])
        single = name in _VOID or m[3].endswith("/") and name in ("svg", "math")
        if away is not None:
            if name == away:
                depth += -1 if closing else not single
                if depth == 0:
                    away = None
            elif name in _BODY and not closing and not in_body_when_set:
                away, body = None, 1
            elif name in _BODY and closing and in_body_when_set:
                away, body = None, max(body - 1, 0)
            continue
        if not closing and name in _RAW and not single:
            if name not in _INLINE:
                close()
            end = re.compile(rf"</{name}\s*>", re.IGNORECASE).search(page, at)
            at = end.end() if end else len(page)
            continue
        if name == "br":
            held.append(" ")
            continue
        if name in _INLINE and (closing or single or not aside(name, m[3])):
            continue
        close()
        if name in _BODY:
            body = max(body + (-1 if closing else 1), 0)
        elif not closing and not single and (name in _PARTS or name == "header" and not body or aside(name, m[3])):
            away, depth, in_body_when_set = name, 1, body
    close()
    return out


def page_blocks(page: str) -> tuple[list[str], bool]:
    """Blocks that may be main text, and whether they are the page's body element."""
    found = blocks(page) or blocks(page, by_name=False)
    inside = [text for text, body in found if body]
    words = sum(len(text.split()) for text in inside)
    outside = sum(len(text.split()) for text, body in found if not body)
    return (inside, True) if inside and outside < OUTSIDE * words else ([text for text, _ in found], False)


def _digest(host: str, blocks: list[str]) -> bytes:
    return hashlib.blake2b("\n".join((host, *blocks)).encode("utf-8", "surrogatepass"), digest_size=16).digest()


def runs(sizes: list[int], passage: int = PASSAGE) -> list[tuple[int, int]]:
    """First and last block of the shortest runs of ``passage`` words from and up to each block."""
    out = set()
    for i in range(len(sizes)):
        for step, stop in ((1, len(sizes)), (-1, -1)):
            words = 0
            for j in range(i, stop, step):
                words += sizes[j]
                if words >= passage:
                    out.add((min(i, j), max(i, j)))
                    break
    return sorted(out)


_RUNS = pa.schema(
    [("content", pa.binary()), ("run", pa.binary()), ("first", pa.int32()), ("words", pa.list_(pa.int32())), ("total", pa.int64())]
)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of the pages without a body element: page text, run, first block, words of its
    blocks, and words of the page."""
    for batch in batches:
        rows: list[tuple] = []
        for host, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
            found, body = page_blocks(page or "")
            if body:
                continue
            sizes = [len(b.split()) for b in found]
            content, total = _digest(host, found), sum(sizes)
            rows += [(content, _digest(host, found[i : j + 1]), i, sizes[i : j + 1], total) for i, j in runs(sizes)]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_RUNS)], schema=_RUNS)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        read = [page_blocks(p.as_py() or "") for p in batch.column("html")]
        # Only equality with the text of a page without a body element matters.
        content = [None if body else _digest(h.as_py(), found) for h, (found, body) in zip(batch.column("host"), read)]
        kept = [n for n in batch.schema.names if n not in ("html", "host")]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(n) for n in kept), pa.array([r[0] for r in read], pa.list_(pa.string())), pa.array(content, pa.binary())],
            names=[*kept, "blocks", "content"],
        )


def _spread(found: DataFrame) -> DataFrame:
    """Runs that enough distinct page texts have."""
    n = found.groupBy(F.col("run").alias("_run")).agg(F.countDistinct("content").alias("n"))
    return n.where(F.col("n") >= SHARED).select("_run")


def _blocks_of(found: DataFrame) -> DataFrame:
    """``content, total, block, n`` of every block in the runs, once."""
    each = found.select("content", "total", "first", F.posexplode("words").alias("at", "n"))
    return each.select("content", "total", (F.col("first") + F.col("at")).alias("block"), "n").distinct()


def boilerplate(rows: DataFrame) -> DataFrame:
    """``content, gone`` (block numbers) of the page texts that have boilerplate, from ``host, html``."""
    found = rows.select("host", "html").mapInArrow(_runs, "content binary, run binary, first int, words array<int>, total bigint")
    found = staged(found.distinct())
    shared = staged(found.join(_spread(found), F.col("run") == F.col("_run"), "left_semi"))
    covered = _blocks_of(shared).groupBy(F.col("content").alias("_c"), "total").agg(F.sum("n").alias("covered"))
    voters = covered.where(F.col("total") - F.col("covered") >= OWN * F.col("total")).select("_c")
    voted = staged(_spread(shared.join(voters, F.col("content") == F.col("_c"), "left_semi")))
    shared = shared.join(voted, F.col("run") == F.col("_run"), "left_semi")
    return staged(_blocks_of(shared).groupBy("content").agg(F.collect_list("block").alias("gone")))


def left_blocks(blocks: list[str], gone: list[int] | None) -> list[str]:
    """Blocks of a page without its boilerplate; all of them if nothing else is there."""
    out = set(gone or ())
    return [b for i, b in enumerate(blocks) if i not in out] or blocks


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pages = zip(batch.column("blocks").to_pylist(), batch.column("gone").to_pylist())
        texts = ["\n".join(left_blocks(b, g)) for b, g in pages]
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            names=["id", "url", "text", "n_chars"],
        )


def main_texts(pages: DataFrame, id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """``id, url, text, n_chars`` of every row."""
    rows = pages.select(
        F.col(id).cast("bigint").alias("id"), F.col(url).cast("string").alias("url"), F.col(page).cast("string").alias("html")
    )
    rows = rows.withColumn("host", host_and_path("url")[0])
    gone = boilerplate(rows).withColumnRenamed("content", "_content")
    read = rows.mapInArrow(_read, "id bigint, url string, blocks array<string>, content binary")
    # Pages with a body element get keys of their own, so that a join by shuffle deals them evenly.
    key = F.coalesce("content", F.encode(F.concat_ws(" ", F.lit("body"), "id", "url"), "UTF-8"))
    read = read.withColumn("content", key).join(gone, F.col("content") == F.col("_content"), "left")
    out = read.select("id", "url", "blocks", "gone").mapInArrow(_write, "id bigint, url string, text string, n_chars bigint")
    return out.withColumnRenamed("id", id)
