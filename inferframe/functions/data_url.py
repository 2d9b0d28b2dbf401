"""Data URLs, MIME types by magic bytes, and object-store addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def data_url(mime_type: Column, content: Column) -> Column:
    """data:MIME;base64,... without line breaks."""
    return F.concat(F.lit("data:"), mime_type, F.lit(";base64,"), F.regexp_replace(F.base64(content), "[\r\n]", ""))


DATA_URL = r"(?s)^data:([^;]+);base64,(.+)$"


def parse_data_url(url: Column) -> Column:
    """Struct of mime_type and data; null if it is no data URL."""
    parsed = F.struct(F.regexp_extract(url, DATA_URL, 1).alias("mime_type"), F.unbase64(F.regexp_extract(url, DATA_URL, 2)).alias("data"))
    return F.when(url.rlike(DATA_URL), parsed)


def mime_type(content: Column) -> Column:
    """MIME type by the first bytes; null if unknown."""
    head = F.hex(F.substring(content, 1, 12))
    return (
        F.when(head.startswith("89504E470D0A1A0A"), "image/png")
        .when(head.startswith("FFD8FF"), "image/jpeg")
        .when(head.startswith("474946383761") | head.startswith("474946383961"), "image/gif")
        .when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), "image/webp")
        .when(head.startswith("255044462D"), "application/pdf")
        .when(head.startswith("49492A00") | head.startswith("4D4D002A"), "image/tiff")
    )


#: Types that are one page by themselves.
PAGE_IMAGES = ("image/png", "image/jpeg", "image/webp", "image/gif")


def sniff(content: bytes) -> str | None:
    """mime_type for bytes in a worker."""
    for start, kind in ((b"\x89PNG\r\n\x1a\n", "image/png"), (b"\xff\xd8\xff", "image/jpeg"), (b"GIF87a", "image/gif"), (b"GIF89a", "image/gif"), (b"%PDF-", "application/pdf"), (b"II*\0", "image/tiff"), (b"MM\0*", "image/tiff")):
        if content.startswith(start):
            return kind
    return "image/webp" if content[:4] == b"RIFF" and content[8:12] == b"WEBP" else None


def parse_s3_uri(uri: Column) -> Column:
    """Struct of bucket and key; null if it is no such address."""
    pattern = "(?s)^s3://([^/]*)/(.*)$"
    return F.when(uri.rlike(pattern), F.struct(F.regexp_extract(uri, pattern, 1).alias("bucket"), F.regexp_extract(uri, pattern, 2).alias("key")))
