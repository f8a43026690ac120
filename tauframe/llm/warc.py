"""WARC derivatives: response records become linked metadata and plain-text conversion records.

A response is described by its record id, target address, date, HTTP header and payload. For each
one, a ``metadata`` record (``application/warc-fields``: title, language, links, the source's HTTP
header lines and digests) and a ``conversion`` record (``text/plain``) are made. Both carry
``WARC-Refers-To`` with the response's id; the conversion also names the metadata record in
``WARC-Concurrent-To``. Ids are name-based: the same response always gets the same ids, so a rerun
or a retried task makes the same records.

Text: comments, scripts and styles go, block tags become line ends, other tags go, character
references are decoded in one pass, white space is collapsed. Unclosed comments and scripts reach
to the end, as a browser reads them. All patterns are linear.

Only built-in functions run, without a shuffle: each response is converted where it is read.

Defined results: a null address, body or header counts as empty; the records are still made. Repeated
rows give repeated records with equal ids. An empty table gives no records. Extra columns are not
read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tauframe.llm.text import table, whole

END = "\r\n"
#: Capture time where the source has none.
NO_DATE = "1970-01-01T00:00:00Z"
_QUOTED = "(?:\"[^\"]*+\"|'[^']*+'|[^\"'<>]++)*+>"
HIDDEN = r"(?is)<(?:!--.*?(?:-->|\z)|script\b.*?(?:</script\s*>|\z)|style\b.*?(?:</style\s*>|\z))"
BLOCK = (r"(?i)</?(?:p|div|br|hr|h[1-6]|li|ul|ol|dl|dt|dd|tr|td|th|table|article|section|header|footer"
         r"|nav|main|aside|title|body|head|html|blockquote|pre|form|figure)\b" + _QUOTED)
TAG = r"<(?:/?[A-Za-z]" + _QUOTED + r"|![A-Za-z][^<>]*>)"
REFERENCE = r"&(?:#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z]{2,6});"
#: Fixed values of the HTML standard.
NAMED = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "copy": "©",
         "reg": "®", "middot": "·", "hellip": "…", "mdash": "—", "ndash": "–"}


def _character(ref: Column) -> Column:
    """What a character reference stands for; itself when unknown."""
    body = F.substring(ref, F.lit(2), F.char_length(ref) - 2)
    code = F.when(body.rlike("^#[xX]"), F.conv(F.substring(body, 3, 9), 16, 10).cast("int")).when(
        body.startswith("#"), F.substring(body, 2, 9).cast("int"))
    sound = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    names = F.create_map(*[F.lit(x) for pair in NAMED.items() for x in pair])
    return F.coalesce(F.when(sound, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")),
                      F.try_element_at(names, body), ref)


def decode_references(text: Column) -> Column:
    gaps = F.split(text, REFERENCE)
    refs = F.transform(F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(0)), _character)
    joined = F.array_join(F.zip_with(gaps, refs, lambda g, r: F.concat(g, F.coalesce(r, F.lit("")))), "")
    return F.when(F.contains(text, F.lit("&")), joined).otherwise(text)


def without_tags(html: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(html, HIDDEN, ""), BLOCK, "\n"), TAG, "")


def plain_text(bare: Column) -> Column:
    """Text from what ``without_tags`` leaves (a column, as it is used several times)."""
    blank = "[ \\t\\r\\f\\x0B]"  # single spaces stay as they are
    t = F.regexp_replace(decode_references(bare), f" {blank}+|[\\t\\r\\f\\x0B]{blank}*", " ")
    return F.btrim(F.regexp_replace(t, " ?\n[ \n]*", "\n"), F.lit(" \n"))


def digest(block: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(block, 256))


def record_id(*names: Column) -> Column:
    h = F.sha2(F.concat_ws("\n", *names), 256)
    cut = [F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("8"), F.substring(h, 14, 3)),
           F.concat(F.lit("8"), F.substring(h, 18, 3)), F.substring(h, 21, 12)]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def responses(pages: DataFrame) -> DataFrame:
    """Response records from ``page_id, url, html``: ``page_id, record_id, target_uri, date,
    http_header, payload, payload_digest``."""
    body, url = F.col("_body"), whole("url")
    pages = pages.select("page_id", "url", whole("html").alias("_body"))
    pages = pages.withColumn("payload_digest", digest(body))
    return pages.select(
        "page_id", record_id(F.lit("response"), F.coalesce(F.col("page_id").cast("string"), F.lit("")),
                             url, F.col("payload_digest")).alias("record_id"), "payload_digest",
        url.alias("target_uri"), F.lit(NO_DATE).alias("date"),
        F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "),
                 F.octet_length(body).cast("string"), F.lit(END)).alias("http_header"),
        body.alias("payload"))


def _first(text: Column, pattern: str) -> Column:
    return F.trim(F.regexp_replace(F.regexp_extract(text, pattern, 1), "[ \\t\\r\\n]+", " "))


def derive(source: DataFrame) -> DataFrame:
    """Two rows per response: ``record_type, record_id, refers_to, concurrent_to, target_uri, date,
    content_type, source_digest, block_digest, content_length, block``, and the columns of
    ``source`` that are not part of a record (nor named like one)."""
    used = ("record_id", "target_uri", "date", "http_header", "payload", "payload_digest", "record_type",
            "refers_to", "concurrent_to", "content_type", "source_digest", "block_digest", "content_length",
            "block", "_src", "_bare", "_fields", "_text", "_meta")
    own = [c for c in source.columns if c not in used]
    payload, header = whole("payload"), whole("http_header")
    rows = source.select(
        *own, whole("record_id").alias("_src"), whole("target_uri").alias("target_uri"),
        F.coalesce("date", F.lit(NO_DATE)).alias("date"), F.col("payload_digest").alias("source_digest"),
        without_tags(payload).alias("_bare"),
        F.concat(
            F.lit("title: "), _first(payload, r"(?is)<title\b[^<>]*>([^<]*)"), F.lit(END),
            F.lit("language: "), _first(payload, r"(?is)<html\b[^<>]*?\blang=[\"']?([A-Za-z-]+)"), F.lit(END),
            F.lit("source-bytes: "), F.octet_length(payload).cast("string"), F.lit(END),
            F.array_join(F.transform(F.filter(F.split(header, "\r?\n"), lambda x: x != ""),
                                     lambda x: F.concat(F.lit("source-header: "), x, F.lit(END))), ""),
            F.array_join(F.transform(F.regexp_extract_all(
                payload, F.lit(r"(?i)<a\s[^<>]*?\bhref=[\"']([^\"'<>]*)"), F.lit(1)),
                lambda x: F.concat(F.lit("outlink: "), F.regexp_replace(x, "[\\r\\n]+", " "), F.lit(END))), ""),
        ).alias("_fields"))
    rows = rows.withColumn("_text", plain_text(F.col("_bare"))).withColumn("_meta", record_id(F.lit("metadata"), F.col("_src")))

    def record(kind, rid, other, content, block):
        return F.struct(
            F.lit(kind).alias("record_type"), rid.alias("record_id"), F.col("_src").alias("refers_to"),
            other.alias("concurrent_to"), F.col("target_uri"), F.col("date"),
            F.lit(content).alias("content_type"), F.col("source_digest"), digest(block).alias("block_digest"),
            F.octet_length(block).cast("long").alias("content_length"), block.alias("block"))
    conversion = record_id(F.lit("conversion"), F.col("_src"))
    return rows.select(*own, F.inline(F.array(
        record("metadata", F.col("_meta"), F.lit(None).cast("string"), "application/warc-fields", F.col("_fields")),
        record("conversion", conversion, F.col("_meta"), "text/plain", F.col("_text")))))


def serialised(records: DataFrame, name: str = "record") -> DataFrame:
    """Adds each record as it stands in a WARC file."""
    line = lambda key, value: F.concat(F.lit(f"{key}: "), value, F.lit(END))
    return records.withColumn(name, F.concat(
        F.lit(f"WARC/1.0{END}"), line("WARC-Type", F.col("record_type")), line("WARC-Record-ID", F.col("record_id")),
        line("WARC-Refers-To", F.col("refers_to")),
        F.coalesce(line("WARC-Concurrent-To", F.col("concurrent_to")), F.lit("")),
        line("WARC-Target-URI", F.col("target_uri")), line("WARC-Date", F.col("date")),
        line("Content-Type", F.col("content_type")), line("X-Source-Digest", F.col("source_digest")),
        line("WARC-Block-Digest", F.col("block_digest")),
        line("Content-Length", F.col("content_length").cast("string")), F.lit(END), F.col("block"), F.lit(END + END)))


def parsed(rows: DataFrame, record: str = "record") -> DataFrame:
    """The fields of serialised records, with ``sound``: length and digest fit the block."""
    head = F.substring_index(record, END + END, 1)
    rest = F.substring(F.col(record), F.char_length(head) + 5, F.char_length(record))
    block = F.substring(rest, F.lit(1), F.char_length(rest) - 4)
    field = lambda key: F.regexp_extract(head, f"(?m)^{key}: ([^\\r\\n]*)", 1)
    keys = {"record_type": "WARC-Type", "record_id": "WARC-Record-ID", "refers_to": "WARC-Refers-To",
            "concurrent_to": "WARC-Concurrent-To", "target_uri": "WARC-Target-URI", "date": "WARC-Date",
            "content_type": "Content-Type", "source_digest": "X-Source-Digest", "block_digest": "WARC-Block-Digest"}
    return rows.select(*[field(k).alias(n) for n, k in keys.items()],
                       field("Content-Length").cast("long").alias("content_length"), block.alias("block"),
                       ((field("Content-Length").cast("long") == F.octet_length(block))
                        & (field("WARC-Block-Digest") == digest(block))).alias("sound"))


def op8_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(responses(table(spark, sf_dir, "pages", "page_id", "url", "html")))


def _sql_pattern(p: str) -> str:
    return p.replace("*+", "*").replace("++", "+").replace("'", "''")


_UUID = ("'<urn:uuid:' || {h}[1:8] || '-' || {h}[9:12] || '-8' || {h}[14:16] || '-8' || {h}[18:20] || '-' "
         "|| {h}[21:32] || '>'")
SQL = {"op8_warc_derivatives": rf"""
WITH p AS (SELECT page_id, coalesce(url, '') AS u, coalesce(html, '') AS b FROM pages),
h AS (SELECT *, sha256(concat_ws(chr(10), 'response', page_id::VARCHAR, u, 'sha256:' || sha256(b))) AS h FROM p),
r AS (SELECT *, {_UUID.format(h='h')} AS src,
      regexp_replace(regexp_replace(regexp_replace(b, '{_sql_pattern(HIDDEN)}', '', 'g'),
        '{_sql_pattern(BLOCK)}', chr(10), 'g'), '{_sql_pattern(TAG)}', '', 'g') AS t FROM h),
e AS (SELECT *, array_to_string(list_transform(list_zip(string_split_regex(t, '{REFERENCE}'),
        regexp_extract_all(t, '{REFERENCE}')), lambda z: z[1] || coalesce(CASE
        {' '.join(f"WHEN z[2] = '&{k};' THEN '{v.replace(chr(39), chr(39) * 2)}'" for k, v in NAMED.items())}
        WHEN z[2] LIKE '&#x%' OR z[2] LIKE '&#X%' THEN chr(('0x' || z[2][4:-2])::INT)
        WHEN z[2] LIKE '&#%' THEN chr(z[2][3:-2]::INT) ELSE z[2] END, '')), '') AS d FROM r),
x AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(d, '[ \t\r\f\x0B]+', ' ', 'g'),
        ' ?\n[ \n]*', chr(10), 'g'), '^[ \n]+|[ \n]+$', '', 'g') AS txt,
      sha256('metadata' || chr(10) || src) AS mh, sha256('conversion' || chr(10) || src) AS ch,
      'title: ' || trim(regexp_replace(regexp_extract(b, '(?is)<title\b[^<>]*>([^<]*)', 1), '[ \t\r\n]+', ' ', 'g'))
      || E'\r\nlanguage: ' || trim(regexp_replace(regexp_extract(b,
        '(?is)<html\b[^<>]*?\blang=["'']?([A-Za-z-]+)', 1), '[ \t\r\n]+', ' ', 'g'))
      || E'\r\nsource-bytes: ' || strlen(b)
      || E'\r\nsource-header: HTTP/1.1 200 OK\r\nsource-header: Content-Type: text/html; charset=utf-8'
      || E'\r\nsource-header: Content-Length: ' || strlen(b) || E'\r\n'
      || coalesce(array_to_string(list_transform(regexp_extract_all(b,
        '(?i)<a\s[^<>]*?\bhref=["'']([^"''<>]*)', 1),
        lambda l: 'outlink: ' || regexp_replace(l, '[\r\n]+', ' ', 'g') || E'\r\n'), ''), '') AS f FROM e),
o AS (SELECT *, 'metadata' AS record_type, {_UUID.format(h='mh')} AS record_id, NULL::VARCHAR AS concurrent_to,
        'application/warc-fields' AS content_type, f AS block FROM x
      UNION ALL SELECT *, 'conversion', {_UUID.format(h='ch')}, {_UUID.format(h='mh')}, 'text/plain', txt FROM x)
SELECT page_id, record_type, record_id, src AS refers_to, concurrent_to, u AS target_uri, '{NO_DATE}' AS date,
  content_type, 'sha256:' || sha256(b) AS source_digest, 'sha256:' || sha256(block) AS block_digest,
  strlen(block)::BIGINT AS content_length, block FROM o"""}
