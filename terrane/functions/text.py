"""Text functions over columns: normal forms, citations, chunks, paragraphs, tagged spans."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import vocabulary as V


def _accents() -> tuple[str, str]:
    """Lower-case Latin letters that decompose to a base letter and marks, and their bases."""
    pairs = []
    for point in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        base = "".join(c for c in unicodedata.normalize("NFD", chr(point)) if unicodedata.category(c) != "Mn")
        if base != chr(point) and len(base) == 1:
            pairs.append((chr(point), base))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, PLAIN = _accents()


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def norm_ws(c: Column | str) -> Column:
    """White space collapsed and stripped; null stays."""
    return collapse(col(c))


def norm_lower_ws(c: Column | str) -> Column:
    """Lower case, white space collapsed; null is empty; accents stay."""
    return collapse(F.lower(F.coalesce(col(c), F.lit(""))))


def strip_accents(c: Column) -> Column:
    """Without accents; letters such as đ that don't decompose stay."""
    return F.regexp_replace(F.translate(c, ACCENTED, PLAIN), r"\p{Mn}", "")


def norm_link(c: Column | str) -> Column:
    """For entity linking: lower case, no accents, punctuation to blanks."""
    plain = strip_accents(F.lower(col(c)))
    return collapse(F.regexp_replace(F.regexp_replace(plain, "[-_/]", " "), r"(?U)[^\w\s]", " "))


def norm_legacy(c: Column | str) -> Column:
    """As norm_link, but only ASCII letters and digits stay."""
    plain = strip_accents(F.lower(col(c)))
    return collapse(F.regexp_replace(F.regexp_replace(plain, "[-_/]", " "), r"[^a-z0-9\s]", " "))


def norm_cypher(c: Column | str) -> Column:
    return F.translate(F.lower(col(c)), "-_/", "   ")


def strip_citations(c: Column | str) -> Column:
    return F.coalesce(norm_ws(F.regexp_replace(col(c), V.CITATION, "")), F.lit(""))


def contains_any(c: Column, words: list[str]) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | F.contains(c, F.lit(w))
    return found


def first_keyword(c: Column, groups, default: Column | str | None) -> Column:
    """The name of the first group of which a word is contained."""
    out = default if isinstance(default, Column) else F.lit(default)
    for name, words in reversed(groups):
        out = F.when(contains_any(c, words), name).otherwise(out)
    return out


def chunk_spans(text: str, size: int = V.CHUNK, overlap: int = V.OVERLAP) -> list[tuple[int, int]]:
    """(start, end) of chunks of at most size letters that end after a separator if there is one, overlapping."""
    out, start = [], 0
    if not text or not text.strip():
        return out
    while start + size < len(text):
        end = max(text.rfind(sep, start, start + size) for sep in " \n.,!?") + 1 or start
        end = end if end > start else start + size
        out.append((start, end))
        start += max(1, end - start - overlap)
    return [*out, (start, len(text))]


def chunks(docs: DataFrame, size: int = V.CHUNK, overlap: int = V.OVERLAP, section: str = V.DEFAULT_CHUNK_SECTION, few: int = 64) -> DataFrame:
    """(doc_id, chunk_id, ordinal, start, n_chars, section, text) of docs (doc_id, text); the id is a digest of its place.
    few texts of a batch are cut at a time, so that Python holds a batch once and not its chunks."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, few):
                ids, texts = (c.to_pylist() for c in batch.slice(low, few).columns)
                rows = [(i, k, s, t[s:e].strip()) for i, t in zip(ids, texts, strict=True) for k, (s, e) in enumerate(chunk_spans(t or "", size, overlap))]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["doc_id", "ordinal", "start", "text"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, "doc_id long, ordinal long, start long, text string")
    ident = F.sha2(F.concat_ws("|", "doc_id", F.lit(section), "ordinal"), 256)
    return rows.select("doc_id", ident.alias("chunk_id"), "ordinal", "start", F.length("text").cast("long").alias("n_chars"), F.lit(section).alias("section"), "text")


def without_noise(html: Column) -> Column:
    """Html without comments and the removed tags' and classes' elements."""
    out = F.regexp_replace(html, r"(?s)<!--.*?-->", "")
    for tag in V.REMOVED_TAGS:
        out = F.regexp_replace(out, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", "")
    for name in V.REMOVED_CLASSES:
        out = F.regexp_replace(out, rf"""(?is)<(\w+)\b[^>]*\bclass\s*=\s*["'](?:[^"']*\s)?{name}(?:\s[^"']*)?["'][^>]*>.*?</\1\s*>""", "")
    return out


def plain(html: Column) -> Column:
    out = F.regexp_replace(html, r"<[^>]*>", "")
    for entity, letter in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(letter))
    return strip_citations(out)


def page_paragraphs(pages: DataFrame) -> DataFrame:
    """(page_id, ordinal, text) of a page's paragraphs longer than LEAST_PARAGRAPH."""
    found = pages.select("page_id", F.posexplode(F.regexp_extract_all(without_noise(F.col("html")), F.lit(r"(?is)<p\b[^>]*>(.*?)</p\s*>"), F.lit(1))).alias("ordinal", "raw"))
    return found.select("page_id", F.col("ordinal").cast("long").alias("ordinal"), plain(F.col("raw")).alias("text")).where(F.length("text") > V.LEAST_PARAGRAPH)


def page_sections(pages: DataFrame) -> DataFrame:
    """(page_id, ordinal, section, text): paragraphs under their last h2 or h3, or the default one, in their order. A
    page's blocks are folded where they stand; its few sections' texts are joined after."""
    blocks = F.regexp_extract_all(without_noise(F.col("html")), F.lit(r"(?is)(<(?:h2|h3|p)\b[^>]*>.*?</(?:h2|h3|p)\s*>)"), F.lit(1))
    block = F.struct(F.lit(0).alias("n"), F.lit(V.DEFAULT_SECTION).alias("section"), F.array().cast("array<struct<n:int,section:string,text:string>>").alias("out"))

    def step(acc: Column, raw: Column) -> Column:
        text, heading = plain(raw), F.rlike(raw, F.lit(r"(?i)^<h[23]"))
        n = acc.n + heading.cast("int")
        section = F.when(heading, text).otherwise(acc.section)
        kept = ~heading & (F.length(text) > V.LEAST_PARAGRAPH)
        row = F.struct(n.alias("n"), section.alias("section"), text.alias("text"))
        return F.struct(n.alias("n"), section.alias("section"), F.when(kept, F.concat(acc.out, F.array(row))).otherwise(acc.out).alias("out"))

    rows = pages.select("page_id", F.posexplode(F.aggregate(blocks, block, step).out).alias("i", "row"))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("i", "row.text"))), lambda x: x.text)
    whole = rows.groupBy("page_id", F.col("row.n").alias("ordinal"), F.col("row.section").alias("section")).agg(F.array_join(texts, " ").alias("text"))
    return whole.where((F.length("text") > V.LEAST_SECTION) & ~F.col("section").isin(V.IGNORED_SECTIONS)).select("page_id", F.col("ordinal").cast("long").alias("ordinal"), "section", "text")


def bio_spans(tokens: Column, tags: Column) -> Column:
    """array<struct<label,text>> of BIO-tagged tokens: B opens, I of the open type extends, another I opens, O closes.

    Tokens are written in a row with a mark before each that opens a span, and the row is split at the marks; so the
    work is linear in the tokens.
    """
    inside, label = (lambda t: F.substring(t, 1, 2).isin("B-", "I-")), (lambda t: F.substring(t, 3, 100))

    def piece(x: Column, i: Column) -> Column:
        before = F.coalesce(F.get(tags, i - 1), F.lit("O"))
        goes_on = (F.substring(x["t"], 1, 2) == "I-") & inside(before) & (label(before) == label(x["t"]))
        word = F.translate(x["w"], "\x01\x02", "")
        return F.when(~inside(x["t"]), "").when(goes_on, F.concat(F.lit(" "), word)).otherwise(F.concat(F.lit("\x01"), label(x["t"]), F.lit("\x02"), word))

    row = F.array_join(F.transform(F.arrays_zip(tokens.alias("w"), tags.alias("t")), piece), "")
    spans = F.filter(F.split(row, "\x01"), lambda p: p != "")
    return F.transform(spans, lambda p: F.struct(F.substring_index(p, "\x02", 1).alias("label"), F.substring_index(p, "\x02", -1).alias("text")))
