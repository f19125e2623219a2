"""Fill-in-the-middle by a secondary sort: pieces of texts, keyed by document and place in the output, stream into digests.

A text goes out as pieces of at most ``chunk`` code points, each with its document's row and its place in the output.
The pieces are dealt by row and sorted by place inside each partition (DataFrame form of repartitionAndSortWithinPartitions:
one exchange and an external sort), so a task streams them in order into an incremental SHA-256 and holds one piece at a time.
For restoration the same task reads the stream as a stranger would, by form and marks alone, and gives each piece the place it
had in the text; the pieces are sorted again inside their partitions, without a second exchange, and streamed into a digest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlake.llm.work import text_bytes

#: Marks of the forms, fixed values.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Order of the parts in the output of a form, each after its mark.
ORDER = {"psm": (PREFIX, SUFFIX, MIDDLE), "spm": (SUFFIX, PREFIX, MIDDLE)}
PLACES = {PREFIX: 0, MIDDLE: 1, SUFFIX: 2}  # of the parts in the text
PLAIN_PERCENT, SPM_PERCENT = 10, 20
#: Code points of a piece.
CHUNK = 1 << 16
ROWS = 256  # pieces in an Arrow batch

FACTS = "doc_id long, n long, form string, prefix_chars long, middle_chars long"
PIECES = f"row long, place long, {FACTS}, piece string"
STEP = f"row long, part int, place long, {FACTS}, piece string, output_sha256 string"
DONE = f"row long, {FACTS}, output_sha256 string, restored_sha256 string"


def cuts(docs: DataFrame) -> DataFrame:
    """(row, doc_id, text, n, form, prefix_chars, middle_chars): form and cuts of every text, by the hash of its doc_id.

    A null text is empty, a null doc_id hashes as if it were the empty string. Rows are told apart by a number of their own,
    so repeated ids and repeated rows each give a row. Other columns, whatever their names, are left out.
    """
    t = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text_bytes(F.col("text")).alias("text"))
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h1, h2, h3, h4 = (F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4))
    marked = F.lit(False)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | F.contains("text", F.lit(mark))
    n = F.length("text").cast("long")
    form = F.when((n == 0) | marked | (h3 % 100 >= 100 - PLAIN_PERCENT), "plain").when(h4 % 100 < SPM_PERCENT, "spm").otherwise("psm")
    t = t.select("*", n.alias("n"), form.alias("form"), F.least(h1 % (n + 1), h2 % (n + 1)).alias("low"), F.greatest(h1 % (n + 1), h2 % (n + 1)).alias("high"))
    cut = F.col("form") != "plain"
    return t.select("row", "doc_id", "text", "n", "form", F.when(cut, F.col("low")).alias("prefix_chars"), F.when(cut, F.col("high") - F.col("low")).alias("middle_chars"))


def pieces(docs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Pieces of all outputs, at most ``chunk`` code points of text each: place is where a piece begins in the output."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, out = None, []
        for batch in batches:
            columns = batch.to_pydict()
            for row, doc, text, n, form, p, m in zip(*(columns[c] for c in ("row", "doc_id", "text", "n", "form", "prefix_chars", "middle_chars"))):
                if form == "plain":
                    parts = [("", 0, n)]
                else:
                    spans = {PREFIX: (0, p), MIDDLE: (p, p + m), SUFFIX: (p + m, n)}
                    parts = [(mark, *spans[mark]) for mark in ORDER[form]]
                place = 0
                for mark, start, end in parts:
                    at = start
                    while at == start or at < end:
                        piece = text[at : min(at + chunk, end)]
                        if at == start:
                            piece = mark + piece
                        out.append((row, place, doc, n, form, p, m, piece))
                        place, at = place + len(piece), at + chunk
                        if len(out) >= ROWS:
                            yield _batch(out, schema := schema or _schema(PIECES))
                            out = []
        if out:
            yield _batch(out, schema or _schema(PIECES))

    return cuts(docs).mapInArrow(cut, PIECES)


def _schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
    return pa.schema([(name, kinds[kind]) for name, kind in (f.split() for f in ddl.split(", "))])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _told_apart(form: str, pieces: Iterator[str]) -> Iterator[tuple[int, str]]:
    """(place of the part in the text, piece) of an output's pieces, read by form and marks alone; a mark begins its piece's part.

    Marks may be cut by the ends of pieces: up to two characters wait for what follows.
    """
    if form == "plain":
        yield from ((0, p) for p in pieces)
        return
    marks, part, kept = list(ORDER[form]), 0, ""
    for piece in pieces:
        kept += piece
        while marks and (at := kept.find(marks[0])) >= 0:
            if at:
                yield part, kept[:at]
            part, kept = PLACES[marks[0]], kept[at + len(marks[0]) :]
            marks.pop(0)
        wait = 2 if marks else 0
        if len(kept) > wait:
            yield part, kept[: len(kept) - wait]
            kept = kept[len(kept) - wait :]
    if kept:
        yield part, kept


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each output's digest, and its pieces under the places they have in the text; the digest goes last (part 3)."""
    schema, out = _schema(STEP), []
    stream = _rows(batches)
    head = next(stream, None)
    while head is not None:
        row, facts, digest = head[0], head[2:7], hashlib.sha256()
        after: list = []

        def own(first=head, row=row, digest=digest, after=after) -> Iterator[str]:
            item = first
            while item is not None and item[0] == row:
                digest.update(item[7].encode())
                yield item[7]
                item = next(stream, None)
            after.append(item)

        for k, (part, piece) in enumerate(_told_apart(facts[2], own())):
            out.append((row, part, k, None, None, None, None, None, piece, None))
            if len(out) >= ROWS:
                yield _batch(out, schema)
                out = []
        out.append((row, 3, 0, *facts, None, digest.hexdigest()))
        head = after[0]
    if out:
        yield _batch(out, schema)


def _restored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema, out, digest = _schema(DONE), [], hashlib.sha256()
    for row, part, _, doc, n, form, p, m, piece, output in _rows(batches):
        if part < 3:
            digest.update(piece.encode())
            continue
        out.append((row, doc, n, form, p, m, output, digest.hexdigest()))
        digest = hashlib.sha256()
        if len(out) >= ROWS:
            yield _batch(out, schema)
            out = []
    if out:
        yield _batch(out, schema)


def infilled(docs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """One row a document: cuts, form, the digest of its output, and the digest of the text rebuilt from output and form.

    Null text: empty, form plain. Very long texts: pieces, of which a task holds a batch at a time. Repeated ids or rows: a row
    each. Empty table: no rows. Columns other than doc_id and text are left out, whatever their names.
    """
    dealt = pieces(docs, chunk).repartition("row").sortWithinPartitions("row", "place")
    again = dealt.mapInArrow(_digested, STEP).sortWithinPartitions("row", "part", "place")
    return again.mapInArrow(_restored, DONE).drop("row")


def outputs(docs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, form, output): the transformed texts themselves, one row a document, as in ``infilled``."""
    schema = "doc_id long, form string, output string"

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, row, held = _schema(schema), None, []
        for item in _rows(batches):
            if held and item[0] != row:
                yield _batch([(facts[0], facts[2], "".join(held))], kinds)
                held = []
            row, facts = item[0], item[2:7]
            held.append(item[7])
        if held:
            yield _batch([(facts[0], facts[2], "".join(held))], kinds)

    return pieces(docs, chunk).repartition("row").sortWithinPartitions("row", "place").mapInArrow(joined, schema)


def restored(transformed: DataFrame) -> DataFrame:
    """(doc_id, text) of rows (doc_id, form, output), in column expressions; an output without the marks of its form is refused by null."""
    out = F.col("output")
    second = F.when(F.col("form") == "psm", F.lit(SUFFIX)).otherwise(F.lit(PREFIX))
    a, b, n = F.call_function("instr", out, second), F.instr(out, MIDDLE), F.length(out)
    one, two, three = out.substr(F.lit(4), a - 4), out.substr(a + 3, b - a - 3), out.substr(b + 3, n)
    whole = F.when(F.col("form") == "psm", F.concat(one, three, two)).otherwise(F.concat(two, three, one))
    return transformed.select("doc_id", F.when(F.col("form") == "plain", out).when((a > 0) & (b > 0), whole).alias("text"))


def fill_in_middle(docs: DataFrame) -> DataFrame:
    return infilled(docs).select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


INFILL_SQL = """
WITH hashed AS (
    SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS digest FROM documents),
numbers AS (
    SELECT doc_id, text, CAST(length(text) AS BIGINT) AS n,
        CAST('0x' || substr(digest, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(digest, 9, 8) AS BIGINT) AS h2,
        CAST('0x' || substr(digest, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(digest, 25, 8) AS BIGINT) AS h4
    FROM hashed),
cut AS (
    SELECT doc_id, text, n, least(h1 % (n + 1), h2 % (n + 1)) AS low, greatest(h1 % (n + 1), h2 % (n + 1)) AS high,
        CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
             WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
    FROM numbers),
made AS (
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN low END AS prefix_chars, CASE WHEN form <> 'plain' THEN high - low END AS middle_chars,
        CASE form WHEN 'plain' THEN text
            WHEN 'psm' THEN '<P>' || substr(text, 1, low) || '<S>' || substr(text, high + 1) || '<M>' || substr(text, low + 1, high - low)
            ELSE '<S>' || substr(text, high + 1) || '<P>' || substr(text, 1, low) || '<M>' || substr(text, low + 1, high - low) END AS output
    FROM cut),
read AS (
    SELECT *, string_split(string_split(output, '<M>')[1], CASE form WHEN 'psm' THEN '<S>' ELSE '<P>' END) AS ends, string_split(output, '<M>')[2] AS middle FROM made)
SELECT doc_id, n, form, prefix_chars, middle_chars, sha256(output) AS output_sha256,
    sha256(CASE form WHEN 'plain' THEN output WHEN 'psm' THEN substr(ends[1], 4) || middle || ends[2] ELSE ends[2] || middle || substr(ends[1], 4) END) AS restored_sha256
FROM read"""
