"""WARC derivatives: from response records, linked metadata and plain-text conversion records.

Each response gives two records that refer to it by its id, keep its target and date, and carry its payload digest and HTTP headers:
``metadata`` (application/warc-fields: title, language, links, source headers) and ``conversion`` (the page's plain text). A response's id, date and
headers are columns of the source, or are read from its stored block (headers and payload); where the source has no id, one is made from what the
response holds, so that a task that runs again writes the same records; where it has no headers, none are written. Pages are scanned in time proportional to
their length, whatever is left unclosed in them.

A null page is an empty payload: its records exist, with empty text. A null URL leaves out WARC-Target-URI, a null date is NO_DATE. Repeated rows have
equal records. An empty table gives no records. Columns other than those named are not looked at.
"""

import base64
import hashlib
import html
import re
import uuid
from collections.abc import Iterator
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import out_batch, pieces, table, with_fields

#: The date of responses whose source has none.
NO_DATE = "1970-01-01T00:00:00Z"

_UNSEEN = re.compile(r"(?is)<!--.*?(?:-->|(?P<a>$))|<(script|style|head|template|noscript)\b.*?(?:</\2\s*>|(?P<b>$))|<![^>]*>|<\?[^>]*>")
_OPEN = re.compile(r"(?i)<!--|<(?:script|style|head|template|noscript)\b")
_BREAKS = re.compile(
    r"(?i)</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|header|hr|html|li|main|nav|ol|p|pre|section|table|tbody|td|tfoot|th|thead|tr|ul)\b[^>]*>"
)
_TAG = re.compile(r"</?[A-Za-z][^>]*>")
_TITLE, _TITLE_END = re.compile(r"(?i)<title\b[^>]*>"), re.compile(r"(?i)</title\s*>")
_HTML, _LANG = re.compile(r"(?i)<html\b[^>]*>"), re.compile(r"(?i)\blang\s*=\s*[\"']?([\w-]+)")
_A, _HREF = re.compile(r"(?i)<a\b[^>]*>"), re.compile(r"(?i)\bhref\s*=\s*")
#: Characters of a link in quotes at most, where its tag ends before the quote.
MAX_LINK = 8192


def closed(page: str) -> int:
    """The length of the part of a page in which every tag is closed: in it, a pattern ``<name[^>]*>`` that begins to match ends, so a scan is linear."""
    return page.rfind(">") + 1


def sub(pattern: re.Pattern, by: str, page: str) -> str:
    end = closed(page)
    return pattern.sub(by, page[:end]) + page[end:]


def seen(page: str) -> str:
    """The page without comments, scripts, styles and declarations."""
    end, closes = closed(page), True

    def blank(m: re.Match) -> str:
        nonlocal closes
        closes &= m["a"] is None and m["b"] is None
        return " "

    head, tail = _UNSEEN.sub(blank, page[:end]), page[end:]
    # A comment or a script that isn't closed runs to the page's end.
    begin = _OPEN.search(tail) if closes else None
    return head + (tail[: begin.start()] if begin else tail if closes else "")


def plain_text(page: str) -> str:
    """What a reader sees: a line for each block, blanks run together, character references resolved."""
    page = sub(_TAG, "", sub(_BREAKS, "\n", seen(page)))
    lines = (" ".join(html.unescape(line).split()) for line in page.split("\n"))
    return "\n".join(line for line in lines if line)


def title_of(page: str) -> str | None:
    begin = _TITLE.search(page, 0, closed(page))
    end = _TITLE_END.search(page, begin.end(), closed(page)) if begin else None
    return " ".join(html.unescape(page[begin.end() : end.start()]).split()) if end else None


def language_of(page: str) -> str | None:
    found = (_LANG.search(m[0]) for m in _HTML.finditer(page, 0, closed(page)))
    return next((m[1] for m in found if m), None)


def links_of(page: str) -> list[str]:
    """The hrefs of the links that a reader sees, in order."""
    page, out = seen(page), []
    for tag in _A.finditer(page, 0, closed(page)):
        if at := _HREF.search(tag[0]):
            begin = tag.start() + at.end()
            quote = page[begin]
            if quote in "\"'":
                end = page.find(quote, begin + 1, begin + MAX_LINK)
                out.append(page[begin + 1 : end if end >= 0 else tag.end() - 1])
            else:
                out.append(re.match(r"[^\s>]*", page[begin : tag.end()])[0])
    return out


def parse_response(block: bytes) -> tuple[list[tuple[str, str]], bytes]:
    """Headers and payload of a stored HTTP response; without a blank line all of it is payload."""
    head, blank, payload = block.partition(b"\r\n\r\n")
    if not blank or not head.startswith(b"HTTP/"):
        return [], block
    lines = (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])
    return [(name.strip(), value.strip()) for name, colon, value in lines if colon], payload


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(10).join(parts))}>"


def record(kind: str, block: bytes, content_type: str, rid: str, url: str | None, date: str, extra: list[tuple[str, str]]) -> dict:
    """A record: its WARC headers in order, and its block."""
    headers = [("WARC-Type", kind), ("WARC-Record-ID", rid), *([("WARC-Target-URI", url)] if url else []), ("WARC-Date", date), *extra]
    headers += [("WARC-Block-Digest", digest(block)), ("Content-Type", content_type), ("Content-Length", str(len(block)))]
    return {"record_type": kind, "record_id": rid, "headers": headers, "block": block}


def serialise(one: dict) -> bytes:
    """The record as WARC/1.1 bytes."""
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in one["headers"]).encode("utf-8", "surrogatepass") + b"\r\n" + one["block"] + b"\r\n\r\n"


def derive(payload: bytes, source_headers: list[tuple[str, str]], url: str | None, date: str, refers_to: str) -> list[dict]:
    """The metadata and conversion records of one response."""
    page = payload.decode("utf-8", "replace")
    source = digest(payload)
    text = plain_text(page)
    conversion_id, metadata_id = (record_id(kind, refers_to, source) for kind in ("conversion", "metadata"))
    kept = [("WARC-Refers-To", refers_to), *([("WARC-Refers-To-Target-URI", url)] if url else []), ("WARC-Refers-To-Date", date)]
    fields = [*((f"source-{k.lower()}", v) for k, v in source_headers), ("source-payload-digest", source), ("conversion-record-id", conversion_id)]
    if (title := title_of(page)) is not None:
        fields.append(("title", title))
    if (lang := language_of(page)) is not None:
        fields.append(("language", lang))
    links = links_of(page)
    for link in links:
        link = html.unescape(link).strip()
        try:
            link = urljoin(url or "", link)
        except ValueError:
            pass  # a link that is no URL stays as it stands
        fields.append(("outlink", " ".join(link.split()) + " L a/@href"))
    block = "".join(f"{k}: {v}\r\n" for k, v in fields).encode("utf-8", "surrogatepass")
    body = text.encode("utf-8", "surrogatepass")
    metadata = record("metadata", block, "application/warc-fields", metadata_id, url, date, [*kept, ("WARC-Concurrent-To", conversion_id)])
    conversion = record("conversion", body, "text/plain; charset=utf-8", conversion_id, url, date, [*kept, ("WARC-Payload-Digest", digest(body)), ("WARC-Source-Payload-Digest", source)])
    return [metadata | {"n_links": len(links), "n_chars": None}, conversion | {"n_links": None, "n_chars": len(text)}]


_FIELDS = {
    "record_type": ("string", pa.string()),
    "record_id": ("string", pa.string()),
    "refers_to": ("string", pa.string()),
    "target_uri": ("string", pa.string()),
    "source_digest": ("string", pa.string()),
    "n_links": ("int", pa.int32()),
    "n_chars": ("int", pa.int32()),
}
_RECORD = {"headers": ("array<struct<name:string,value:string>>", pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))), "block": ("binary", pa.binary())}
_DIGEST = {"content_length": ("bigint", pa.int64()), "block_digest": ("string", pa.string()), "record_sha256": ("string", pa.string())}


def derivatives(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", blocks: bool = True,
    date_col: str | None = None, record_id_col: str | None = None, headers_col: str | None = None, block_col: str | None = None,
) -> DataFrame:
    """Two rows for each response: their lengths and digests and, with ``blocks``, the records themselves. Where the source has them: date_col (string), record_id_col,
    headers_col (array of structs name, value) and block_col, a stored HTTP response (binary) from which headers and payload are taken instead of html_col."""
    none = F.lit(None)
    given = lambda name, kind: (F.col(name) if name else none).cast(kind)
    payload = F.coalesce(given(block_col, "binary") if block_col else F.col(html_col).cast("string").cast("binary"), F.lit(b""))
    header = "array<struct<name:string,value:string>>"
    df = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("text"), given(date_col, "string").alias("date"), given(record_id_col, "string").alias("rid"), given(headers_col, header).alias("sent"))
    fields = _FIELDS | (_RECORD if blocks else {}) | _DIGEST

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            schema = pa.schema([batch.schema.field("page_id"), *[pa.field(k, t[1]) for k, t in fields.items()]])
            for part, texts in pieces(batch):
                out: dict[str, list] = {f.name: [] for f in schema}
                for page, url, date, rid, sent, payload in zip(*(part.column(c).to_pylist() for c in ("page_id", "url", "date", "rid", "sent")), texts, strict=True):
                    headers = [(h["name"], h["value"]) for h in sent or () if h and h["name"] is not None and h["value"] is not None]
                    if block_col:
                        own, payload = parse_response(payload)
                        headers = headers or own
                    source = digest(payload)
                    rid = rid or record_id("response", str(page), url or "", source)
                    for one in derive(payload, headers, url, date or NO_DATE, rid):
                        row = {"page_id": page, "refers_to": rid, "target_uri": url, "source_digest": source} | one
                        if blocks:
                            row["headers"] = [{"name": k, "value": v} for k, v in one["headers"]]
                        row |= {"content_length": len(one["block"]), "block_digest": digest(one["block"]), "record_sha256": hashlib.sha256(serialise(one)).hexdigest()}
                        for name, column in out.items():
                            column.append(row[name])
                yield out_batch(schema, out)

    return df.mapInArrow(run, with_fields([df.schema["page_id"]], {k: t[0] for k, t in fields.items()}))


def op2_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derivatives(table(spark, sf_dir, "pages"))


QUERIES = {"op2_warc_derivatives": op2_warc_derivatives}
ORACLE_SQL: dict[str, str] = {}
