"""Lines, paragraphs, blocks, chunks, sentences and inline signals of texts."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as fx
from ..schema import BLOCKS, CHUNKS, SENTENCES

# Words whose full stop ends no sentence.
ABBREVIATIONS = frozenset({"mr", "mrs", "ms", "dr", "prof", "sr", "jr", "st", "vs", "etc", "no", "fig", "eq", "al", "e.g", "i.e", "u.s", "u.k"})
BREAK = re.compile(r"[.!?](?=[)\"'”]?\s)[)\"'”]?\s+")
NO_BREAK = re.compile(rf"(?<![a-z0-9.])(?:[a-z0-9]|{'|'.join(map(re.escape, sorted(ABBREVIATIONS)))})\.+$", re.IGNORECASE)
CHUNK_TOKENS = 600
STATEMENT = r"\b(SUPERSEDES?|REPLACES?|DEPRECATES?|AMENDS?|PRECEDENT(?:[- ]FOR)?|CAUSED[- ]BY|BECAUSE\s+OF|DUE\s+TO|RESULT\s+OF|INFLUENCED[- ]BY|BUILDS\s+ON)?\s*\bADR[- ]?(\d+)\b"


def lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(key, F.explode(F.split(text, "\n")).alias("line"))


def line_index(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``key, line_no, start, len``: where each line starts, in code points; computed within the row."""
    sizes = F.transform(F.split(text, "\n"), lambda x: F.length(x))
    return docs.select(key, F.posexplode(sizes).alias("line_no", "len"), sizes.alias("all")).select(
        key, F.col("line_no").cast("long").alias("line_no"), F.aggregate(F.slice("all", F.lit(1), F.col("line_no")), F.lit(0).cast("long"), lambda s, x: s + x + 1).alias("start"), "len"
    )


def paragraphs(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``key, n, paragraph``: parts between blank lines, trimmed at the right."""
    parts = docs.select(key, F.posexplode(F.split(text, "\n\n+")).alias("n", "paragraph"))
    return parts.withColumn("paragraph", F.regexp_replace("paragraph", r"\s+$", "")).filter("paragraph <> ''")


def template_counts(rows: DataFrame, key: str, line: str) -> DataFrame:
    """``key, template, occurrences`` of log lines."""
    return rows.select(key, fx.log_template(line).alias("template")).groupBy(key, "template").agg(F.count(F.lit(1)).alias("occurrences"))


def turns(rows: DataFrame, line: str) -> DataFrame:
    """Lines ``[time] Speaker: message`` as columns; other lines go."""
    hit = rows.filter(F.col(line).rlike(fx.TURN) & (F.trim(line) != ""))
    return hit.withColumns({name: F.trim(F.regexp_extract(line, fx.TURN, i)) for i, name in enumerate(("at", "speaker", "message"), 1)})


def json_fields(rows: DataFrame, key: str, column: str) -> DataFrame:
    """``key, path, value`` for the top level of flat JSON objects."""
    return rows.select(key, F.explode(F.from_json(column, "map<string,string>")).alias("path", "value"))


def inline_signals(rows: DataFrame, key: str, body: str) -> DataFrame:
    """``key, kind, value`` of links, citations, references, markers, requirements and terms: one scan."""
    term = F.regexp_extract(body, fx.DEFINITION, 1)
    defined = F.when(F.col(body).rlike(fx.DEFINITION) & ~F.lower(term).isin(*fx.DEFINITION_STOP), F.array(term)).otherwise(F.array().cast("array<string>"))
    found = {
        "wikilink": F.transform(fx.matches(body, fx.WIKILINK, 1), lambda x: F.trim(x)),
        "link": fx.matches(body, fx.MDLINK, 1),
        "url": F.transform(fx.matches(body, fx.URL), lambda x: F.regexp_replace(x, r"[.,);]+$", "")),
        "citation": fx.matches(body, fx.CITATION, 1),
        "xref": fx.matches(body, fx.XREF),
        "rationale": fx.matches(body, fx.RATIONALE),
        "requirement": fx.matches(body, fx.RFC2119),
        "doi": fx.matches(body, fx.DOI),
        "arxiv": fx.matches(body, fx.ARXIV),
        "term": defined,
    }

    def tagged(kind: str, values: Column) -> Column:
        return F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))

    both = F.concat(*(tagged(k, v) for k, v in found.items()))
    return rows.select(key, F.explode(both).alias("x")).select(key, "x.kind", "x.value")


def decisions(marks: DataFrame) -> DataFrame:
    """Rationale marks ``doc_id, id, marker, line`` that are decisions: ``category, adr``.

    A mark ``ADR-n`` is a record where it leads its line and else a mere reference.
    """
    mark = F.upper(F.regexp_replace(F.trim("marker"), r"[:\s]+$", ""))
    number = F.regexp_extract(mark, r"^ADR[- ]?(\d+)$", 1)
    leads = F.startswith(F.upper(F.trim(F.regexp_replace("line", "^#+", ""))), mark)
    category = F.when((number != "") & leads, "adr").when(mark.isin("WHY", "DECISION", "RATIONALE"), F.lower(mark))
    return marks.withColumns({"category": category, "adr": F.when((number != "") & leads, number.cast("int"))}).filter("category is not null")


def causal_links(found: DataFrame) -> DataFrame:
    """``subject, predicate, object``: decision records linked by what their statements refer to.

    A reference counts for its document's own record if there is one; unknown numbers and self-references go.
    """
    records = found.filter("adr is not null").groupBy("adr").agg(F.min("id").alias("object"))
    own = found.filter("adr is not null").groupBy("doc_id").agg(F.min("id").alias("record"))
    words = F.regexp_extract_all("line", F.lit(f"(?i){STATEMENT}"), F.lit(1))
    numbers = F.regexp_extract_all("line", F.lit(f"(?i){STATEMENT}"), F.lit(2))
    refs = found.select("doc_id", "id", F.explode(F.arrays_zip(words.alias("word"), numbers.alias("n"))).alias("r"))
    word = F.upper(F.replace(F.col("r.word"), F.lit("-"), F.lit(" ")))
    predicate = F.when(word.rlike("^(SUPERSEDE|REPLACE|DEPRECATE|AMEND|PRECEDENT)"), "PRECEDENT_FOR").when(word.rlike("^(CAUSED|BECAUSE|DUE|RESULT)"), "CAUSED").otherwise("INFLUENCED")
    linked = refs.select("doc_id", "id", predicate.alias("predicate"), F.col("r.n").cast("int").alias("adr")).join(own, "doc_id", "left").join(records, "adr")
    made = linked.select(F.col("object").alias("subject"), "predicate", F.coalesce("record", "id").alias("object"))
    return made.filter("subject <> object").distinct()


def trace(links: DataFrame, start: str, hops: int = 6, most: int = 64) -> DataFrame:
    """``direction, hop, subject, predicate, object``: causal links before and after a decision, breadth first;
    ``truncated`` tells whether links beyond ``most`` were left out."""
    spark = links.sparkSession
    out = None
    for direction, here, there in (("ancestors", "object", "subject"), ("descendants", "subject", "object")):
        front = spark.createDataFrame([(start,)], "id string")
        seen = front
        for hop in range(1, hops + 1):
            step = links.join(front.withColumnRenamed("id", here), here).select(F.lit(direction).alias("direction"), F.lit(hop).alias("hop"), "subject", "predicate", "object")
            out = step if out is None else out.unionByName(step)
            front = step.select(F.col(there).alias("id")).distinct().join(seen, "id", "left_anti")
            seen = seen.unionByName(front)
    ranked = out.dropDuplicates(["direction", "subject", "predicate", "object"])
    place = F.row_number().over(W.partitionBy("direction").orderBy("hop", "subject", "predicate", "object"))
    return ranked.withColumn("place", place).withColumn("truncated", F.max("place").over(W.partitionBy("direction")) > most).filter(F.col("place") <= most).drop("place")


#: Characters of text that a batch of rows in Python holds at most, beyond one row.
BATCH_CHARS = 1 << 21


def pieces(rows: Iterable[tuple], columns: list[str], text: int) -> Iterator[pd.DataFrame]:
    """Rows as frames of ``BATCH_CHARS`` characters in column ``text``, so that what Python holds follows no input."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[text]) + 64
        if size > BATCH_CHARS:
            yield pd.DataFrame(held, columns=columns)
            held, size = [], 0
    if held:
        yield pd.DataFrame(held, columns=columns)


def paragraph_blocks(docs: DataFrame) -> DataFrame:
    """Plain texts (``doc_id, text``) as paragraph blocks with exact spans."""
    columns = [c.split()[0] for c in BLOCKS.split(", ")]

    def rows(pdf: pd.DataFrame) -> Iterator[tuple]:
        for doc, text in zip(pdf.doc_id, pdf.text, strict=True):
            for n, m in enumerate(re.finditer(r"[^\n](?:[^\n]|\n(?!\n))*", text or "")):
                body = m.group().rstrip()
                if body:
                    yield doc, n, -1, "paragraph", 0, m.start(), m.start() + len(body), body, {}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield from pieces(rows(pdf), columns, 7)

    return docs.select("doc_id", "text").mapInPandas(run, BLOCKS)


def fill_chunks(blocks: list[tuple], target: int) -> list[tuple]:
    """Blocks in order, ``(kind, level, start, end, text)``, gathered up to ``target`` tokens; a heading ends a
    chunk and sets the trail of headings; a block is never split."""
    trail: list[tuple[int, str]] = []
    out: list[tuple] = []
    held: list[tuple] = []
    size = 0

    def close() -> None:
        if held:
            out.append(([t for _, t in trail], held))

    for block in blocks:
        kind, level, _, _, text = block
        if kind == "document":
            continue
        n = len(text.split())
        if kind == "heading" or (held and size + n > target):
            close()
            held, size = [], 0
        if kind == "heading":
            while trail and trail[-1][0] >= level:
                trail.pop()
            trail.append((level, text.strip()))
        else:
            held.append(block)
            size += n
    close()
    return out


def chunks(blocks: DataFrame, target: int = CHUNK_TOKENS, texts: DataFrame | None = None) -> DataFrame:
    """Greedy chunks per document; the text is cut from ``texts(doc_id, text)``, or joined from the blocks."""
    source = blocks.select("doc_id", "ord", "kind", "level", "start", "end", "text")
    columns = [c.split()[0] for c in CHUNKS.split(", ")]

    def documents(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[str, list[tuple]]]:
        # Sorted rows: a document may go on in the next batch.
        doc, items = None, []
        for pdf in batches:
            for own, *block in pdf[["doc_id", "kind", "level", "start", "end", "text"]].itertuples(index=False, name=None):
                if items and own != doc:
                    yield doc, items
                    items = []
                doc = own
                items.append(tuple(block))
        if items:
            yield doc, items

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for doc, items in documents(batches):
            for i, (trail, held) in enumerate(fill_chunks(items, target)):
                body = "\n\n".join(b[4] for b in held)
                yield doc, i, trail, min(b[2] for b in held), max(b[3] for b in held), body, len(body.split()), held[0][0]

    # One stream of sorted rows a task: a call for each document would cost more than its work.
    made = source.repartition("doc_id").sortWithinPartitions("doc_id", "ord").mapInPandas(lambda batches: pieces(rows(batches), columns, 5), CHUNKS)
    if texts is None:
        return made
    cut = F.substring(F.col("whole"), F.col("start") + 1, F.col("end") - F.col("start"))
    return made.drop("text").join(texts.select("doc_id", F.col("text").alias("whole")), "doc_id").withColumn("text", cut).drop("whole")


def split_sentences(text: str) -> list[tuple[int, int]]:
    """Spans that end with ``.!?`` before white space, except after an abbreviation or an initial."""
    breaks = [m.span() for m in BREAK.finditer(text) if not NO_BREAK.search(text, max(0, m.start() - 64), m.start() + 1)]
    starts, ends = [0, *(b for _, b in breaks)], [*(a + 1 for a, _ in breaks), len(text.rstrip())]
    return [span for span in zip(starts, ends, strict=True) if not text[slice(*span)].isspace() and span[0] < span[1]]


def sentences(blocks: DataFrame) -> DataFrame:
    """``doc_id, block, start, end, sentence`` of prose blocks."""
    prose = blocks.filter(F.col("kind").isin("heading", "paragraph", "list_item", "quote", "transcript_turn"))
    columns = [c.split()[0] for c in SENTENCES.split(", ")]

    def rows(pdf: pd.DataFrame) -> Iterator[tuple]:
        for doc, n, base, text in zip(pdf.doc_id, pdf.ord, pdf.start, pdf.text, strict=True):
            for a, b in split_sentences(text or ""):
                yield doc, n, base + a, base + b, text[a:b]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield from pieces(rows(pdf), columns, 4)

    return prose.select("doc_id", "ord", "start", "text").mapInPandas(run, SENTENCES)
