"""Derivative WARC records: linked metadata and plain-text conversion records of response records.

``read_responses`` reads the response records of WARC files, ``responses`` makes them of a table of pages. A
response's payload is HTML. Its conversion record holds the text: comments, scripts and styles go (to the end
of the page where they aren't closed), block elements end lines, other tags go with their attributes, numeric
and named character references are resolved once, white space is folded. Its metadata record holds what was
found about it as ``name: value`` lines, among them the source's HTTP headers. Both carry the response's id in
WARC-Refers-To, its URI and, where it has one, its date, and digests of block and payload; record ids are
derived from the response's id, so that a repeated run writes the same records.

``derivatives`` is column expressions alone: no row leaves the JVM. Every pattern matches wherever it starts,
so the time for a page grows with its length alone, also for very long pages and unclosed markup. Null HTML
counts as an empty page, a null URL as an empty URI; an empty page has an empty conversion block and a metadata
block of names without values. A null page id gives an id from the nulls alone; equal rows give equal records.
Other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import gzip
import io
from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Elements that end a line of text.
BLOCKS = "p|div|li|ul|ol|h1|h2|h3|h4|h5|h6|br|tr|table|article|section|header|footer|nav|title|blockquote|pre|main|aside"
#: The rest of a tag after its name; quoted values may hold any character.
REST = r"""[^>"']*(?:(?:"[^"]*(?:"|\z)|'[^']*(?:'|\z))[^>"']*)*[^>]*(?:>|\z)"""
#: Steps of text extraction, in order: pattern and replacement.
STEPS = [
    (r"(?s)<!--.*?(?:-->|\z)", ""),
    (rf"(?is)<script\b{REST}.*?(?:</script[^>]*>|\z)", ""),
    (rf"(?is)<style\b{REST}.*?(?:</style[^>]*>|\z)", ""),
    (rf"(?i)</?(?:{BLOCKS})\b{REST}", "\n"),
    (rf"<[A-Za-z/!]{REST}", ""),
]
FOLDS = [(r"[ \t\r\f]+", " "), (r" ?\n[ \n]*", "\n"), (r"\A[ \n]+|[ \n]+\z", "")]
#: Named references: those of HTML 4 and the apostrophe; a no-break space counts as a space.
NAMES = {**{n: chr(c) for n, c in sorted(name2codepoint.items())}, "apos": "'", "nbsp": " "}
REFERENCE = r"^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,7});"
VERSION = "WARC/1.1"


def _possessive(pattern: str) -> str:
    """The same pattern for a matcher that backtracks: runs that end at a character they exclude give nothing back."""
    for run in ("""[^>"']*""", '[^"]*', "[^']*", "[^>]*", """[^>"']*+)*"""):
        pattern = pattern.replace(run, run + "+")
    return pattern


def _resolved(text: Column) -> Column:
    """A text (a column, which is named several times) with its character references resolved, each once."""
    names = F.create_map(*(F.lit(x) for pair in NAMES.items() for x in pair))
    # Each step names what the one before worked out, so that nothing is worked out twice.
    parts = F.transform(F.split(text, "&", -1), lambda p, i: F.struct(p.alias("p"), F.when(i > 0, F.regexp_extract(p, REFERENCE, 1)).alias("ref")))
    number = lambda r: F.when(r.rlike("^#[xX]"), F.conv(F.substring(r, F.lit(3), F.lit(8)), 16, 10)).when(r.startswith("#"), F.substring(r, F.lit(2), F.lit(8))).cast("int")
    parts = F.transform(parts, lambda x: F.struct(x["p"].alias("p"), x["ref"].alias("ref"), F.when(x["ref"] != "", number(x["ref"])).alias("code")))

    def char(x: Column) -> Column:
        code = x["code"]
        valid = ((code >= 1) & (code < 0xD800)) | ((code > 0xDFFF) & (code <= 0x10FFFF))
        return F.when(code == 160, F.lit(" ")).when(valid, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).when(code.isNull() & (x["ref"] != ""), F.element_at(names, x["ref"]))

    def joined(x: Column) -> Column:
        resolved = F.when(x["ref"] != "", F.concat(char(x), F.substring(x["p"], F.length(x["ref"]) + 2, F.length(x["p"]))))
        return F.when(x["ref"].isNull(), x["p"]).otherwise(F.coalesce(resolved, F.concat(F.lit("&"), x["p"])))

    return F.when(text.contains("&"), F.array_join(F.transform(parts, joined), "")).otherwise(text)


def bare(html: Column) -> Column:
    """HTML without markup; character references stay."""
    for pattern, new in STEPS:
        html = F.regexp_replace(html, _possessive(pattern), new)
    return html


def folded(text: Column) -> Column:
    for pattern, new in FOLDS:
        text = F.regexp_replace(text, pattern, new)
    return text


def record_id(*parts: Column) -> Column:
    """A urn:uuid from the MD5 of the parts."""
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(F.md5(F.concat_ws("|", *parts).cast("binary")), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def digest(block: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(block.cast("binary"), 256))


def responses(pages: DataFrame) -> DataFrame:
    """Response records of a table of pages: page_id, record_id, target_uri, date, http_headers, payload.

    Such a table has no headers or dates of its own: the headers tell the payload's type and length, the date is null.
    """
    html = F.coalesce("html", F.lit(""))
    uri = F.coalesce("url", F.lit(""))
    return pages.select(
        "page_id",
        record_id(F.lit("response"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), uri).alias("record_id"),
        uri.alias("target_uri"),
        F.lit(None).cast("string").alias("date"),
        F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(html).cast("string"), F.lit("\r\n")).alias("http_headers"),
        html.alias("payload"),
    )


def records_of(content: bytes):
    """(headers by lower-case name, block) of each record of a WARC file's bytes, gzip members or plain; a cut last record is left out."""
    file = io.BytesIO(content)
    if content[:2] == b"\x1f\x8b":
        file = gzip.GzipFile(fileobj=file)
    try:
        while line := file.readline():
            if not line.strip():
                continue
            headers: dict[str, str] = {}
            while (line := file.readline()).strip():
                name, _, value = line.decode("utf-8", "replace").partition(":")
                headers[name.strip().lower()] = value.strip()
            size = int(headers.get("content-length") or 0)
            block = file.read(size)
            if len(block) < size:
                return
            yield headers, block
    except EOFError:
        return


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """The response records of WARC files (plain or gzip), as ``responses`` has them; payloads are read as UTF-8, bad bytes replaced.

    A file is one task's; its records stream one after the other. page_id is null: a record's id is its name.
    """
    schema = "page_id bigint, record_id string, target_uri string, date string, http_headers string, payload string"

    def run(batches):
        import pyarrow as pa

        names = [f.split()[0] for f in schema.split(", ")]
        for batch in batches:
            for content in batch.column("content"):
                for headers, block in records_of(content.as_py()):
                    if headers.get("warc-type") == "response":
                        http, found, payload = block.partition(b"\r\n\r\n")
                        row = [None, headers.get("warc-record-id"), headers.get("warc-target-uri", ""), headers.get("warc-date"), http.decode("utf-8", "replace") + "\r\n", (payload if found else b"").decode("utf-8", "replace")]
                        yield pa.RecordBatch.from_arrays([pa.array([row[0]], pa.int64()), *(pa.array([x], pa.string()) for x in row[1:])], names)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, schema)


def derivatives(source: DataFrame) -> DataFrame:
    """Two records of each response: one of type metadata, one of type conversion."""
    named = F.regexp_extract("payload", r"(?is)<title[^<>]*>([^<]*)", 1)
    text = source.select("page_id", "record_id", "target_uri", "date", "http_headers", "payload", bare(F.col("payload")).alias("bare"), named.alias("title"))
    text = text.withColumn("plain", folded(_resolved(F.col("bare"))))
    title = _resolved(F.col("title"))
    lang = F.regexp_extract("payload", r'(?i)<html[^<>]*\slang="([^">]*)"', 1)
    links = F.regexp_count("payload", F.lit(r"(?i)<a\s[^<>]*href="))
    line = lambda c: F.regexp_replace(c, r"\s+", " ")
    facts = F.concat(
        F.lit("title: "), line(title), F.lit("\r\nlanguages-declared: "), line(lang),
        F.lit("\r\noutlinks: "), links.cast("string"), F.lit("\r\ntext-characters: "), F.length("plain").cast("string"),
        F.lit("\r\nsource-headers: "), line(F.regexp_replace(F.regexp_replace("http_headers", "\r\n", "; "), "; $", "")), F.lit("\r\n"),
    )
    kinds = F.array(
        F.struct(F.lit("metadata").alias("record_type"), F.lit("application/warc-fields").alias("block_type"), facts.alias("block")),
        F.struct(F.lit("conversion").alias("record_type"), F.lit("text/plain").alias("block_type"), F.col("plain").alias("block")),
    )
    out = text.select("page_id", "record_id", "target_uri", "date", digest(F.col("payload")).alias("refers_to_payload_digest"), F.explode(kinds).alias("r"))
    return out.select(
        "page_id",
        F.col("r.record_type").alias("record_type"),
        record_id(F.col("r.record_type"), F.col("record_id")).alias("record_id"),
        F.col("record_id").alias("refers_to"),
        "target_uri",
        "date",
        F.col("r.block_type").alias("content_type"),
        F.octet_length("r.block").cast("bigint").alias("content_length"),
        digest(F.col("r.block")).alias("block_digest"),
        "refers_to_payload_digest",
        F.col("r.block").alias("block"),
    )


def _header(name: str, value: Column | str) -> Column:
    """A header line; spaces and control characters of its value are percent-encoded or go, so that it stays one line."""
    value = F.col(value) if isinstance(value, str) else value
    for char, code in ((" ", "%20"), ("\t", "%09"), ("\r", "%0D"), ("\n", "%0A")):
        value = F.replace(value, F.lit(char), F.lit(code))
    return F.coalesce(F.concat(F.lit(f"{name}: "), F.regexp_replace(value, r"[\x00-\x1f\x7f]", ""), F.lit("\r\n")), F.lit(""))


def as_warc(records: DataFrame, written_at: str) -> DataFrame:
    """Each record as the bytes of a WARC file; written one after the other they form a valid file.

    WARC-Date is the response's date, or ``written_at`` where it has none.
    """
    head = F.concat(
        F.lit(f"{VERSION}\r\n"), _header("WARC-Type", "record_type"), _header("WARC-Record-ID", "record_id"), _header("WARC-Refers-To", "refers_to"),
        _header("WARC-Target-URI", "target_uri"), _header("WARC-Date", F.coalesce("date", F.lit(written_at))), _header("WARC-Block-Digest", "block_digest"),
        _header("WARC-Refers-To-Payload-Digest", "refers_to_payload_digest"),
        _header("Content-Type", "content_type"), _header("Content-Length", F.col("content_length").cast("string")), F.lit("\r\n"),
    )
    return records.select(F.concat(head, "block", F.lit("\r\n\r\n")).alias("value"))


def _quoted(s: str) -> str:
    return " || chr(10) || ".join("'" + part.replace("'", "''") + "'" for part in s.split("\n"))


def _sql_resolved(text: str) -> str:
    names = "MAP {" + ", ".join(f"{_quoted(n)}: {_quoted(c)}" for n, c in NAMES.items()) + "}"
    ref = f"regexp_extract(p, '{REFERENCE}', 1)"
    code = f"CASE WHEN regexp_matches({ref}, '^#[xX]') THEN CAST('0x' || substr({ref}, 3) AS INTEGER) WHEN {ref} LIKE '#%' THEN CAST(substr({ref}, 2) AS INTEGER) END"
    char = f"CASE WHEN {ref} LIKE '#%' THEN CASE WHEN ({code}) = 160 THEN ' ' WHEN (({code}) BETWEEN 1 AND 55295) OR (({code}) BETWEEN 57344 AND 1114111) THEN chr({code}) END WHEN {ref} <> '' THEN {names}[{ref}] END"
    part = f"coalesce(({char}) || substr(p, length({ref}) + 2), '&' || p)"
    return f"CASE WHEN contains({text}, '&') THEN string_split({text}, '&')[1] || array_to_string(list_transform(string_split({text}, '&')[2:], lambda p: {part}), '') ELSE {text} END"


def _replaced(text: str, steps: list[tuple[str, str]]) -> str:
    for pattern, new in steps:
        text = f"regexp_replace({text}, {_quoted(pattern)}, {_quoted(new)}, 'g')"
    return text


def _sql_id(*parts: str) -> str:
    return f"""'<urn:uuid:' || regexp_replace(md5(concat_ws('|', {", ".join(parts)})), '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '\\1-\\2-\\3-\\4-\\5') || '>'"""


def sql() -> str:
    crlf = "chr(13) || chr(10)"
    return f"""
WITH r AS (
  SELECT page_id, coalesce(url, '') AS target_uri, coalesce(html, '') AS payload,
         {_sql_id("'response'", "coalesce(CAST(page_id AS VARCHAR), '')", "coalesce(url, '')")} AS rid
  FROM pages
), m AS (
  SELECT *, {_replaced("payload", STEPS)} AS bare, regexp_extract(payload, '(?is)<title[^<>]*>([^<]*)', 1) AS title,
         'HTTP/1.1 200 OK; Content-Type: text/html; charset=utf-8; Content-Length: ' || CAST(octet_length(encode(payload)) AS VARCHAR) AS headers
  FROM r
), e AS (
  SELECT *, {_sql_resolved("bare")} AS resolved, {_sql_resolved("title")} AS name FROM m
), t AS (
  SELECT *, {_replaced("resolved", FOLDS)} AS plain FROM e
), f AS (
  SELECT *, 'title: ' || regexp_replace(name, '\\s+', ' ', 'g')
    || {crlf} || 'languages-declared: ' || regexp_replace(regexp_extract(payload, '(?i)<html[^<>]*\\slang="([^">]*)"', 1), '\\s+', ' ', 'g')
    || {crlf} || 'outlinks: ' || CAST(len(regexp_extract_all(payload, '(?i)<a\\s[^<>]*href=')) AS VARCHAR)
    || {crlf} || 'text-characters: ' || CAST(length(plain) AS VARCHAR)
    || {crlf} || 'source-headers: ' || headers || {crlf} AS facts
  FROM t
), u AS (
  SELECT page_id, rid, target_uri, payload, 'metadata' AS record_type, 'application/warc-fields' AS content_type, facts AS block FROM f
  UNION ALL
  SELECT page_id, rid, target_uri, payload, 'conversion', 'text/plain', plain FROM f
)
SELECT page_id, record_type, {_sql_id("record_type", "rid")} AS record_id, rid AS refers_to, target_uri, CAST(NULL AS VARCHAR) AS date, content_type,
       CAST(octet_length(encode(block)) AS BIGINT) AS content_length, 'sha256:' || sha256(block) AS block_digest,
       'sha256:' || sha256(payload) AS refers_to_payload_digest, block
FROM u
"""
