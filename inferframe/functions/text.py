"""Tokens of texts, multiset similarity and small text functions, as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Simple tags and Markdown images are no text; a token is a run of letters, digits and underscores.
TAG = r"</?[a-zA-z_]+\s*/?>"
IMAGE = r"!\[.*?\]\(.*?\)"
TOKEN = r"[\p{L}\p{N}_]+"
#: Fixed value: stands for a page without text in a merged document.
NO_TEXT = "**COULD_NOT_OCR_PAGE**"
#: Fixed value: the message of a document with more pages than were asked for.
TOO_MANY_PAGES = "Only %d/%d pages processed (because of --max-pages)"


def tokens(text: Column) -> Column:
    """Lower-case tokens of a text in order; runs of underscores alone are none, null has none."""
    return F.transform(F.filter(token_column(text), is_token), F.lower)


def _bare(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), TAG, " "), IMAGE, " ")


def token_column(text: Column) -> Column:
    """The tokens of a text as they stand, runs of underscores included: to be exploded, and then told apart by is_token and lower-cased."""
    return F.regexp_extract_all(_bare(text), F.lit(TOKEN), F.lit(0))


def token_line(text: Column) -> Column:
    """The tokens of a text in one string, lower-cased, runs of underscores included, with a space between any two (and maybe at the ends): for what splits them itself."""
    return F.lower(F.regexp_replace(_bare(text), f"[^{TOKEN[1:]}", " "))


def is_token(token: Column) -> Column:
    """Whether a token holds more than underscores."""
    return ~token.startswith("_") | (F.ltrim(token, F.lit("_")) != "")


def highlight(markdown: Column, changed: Column, added: Column) -> Column:
    """Marks changed and added tokens (lower-cased lists) with spans, in one pass, so markup is never marked itself; of both, added holds.

    The text is split at the edges of tokens with what is between them kept. A null list is empty, a null text null.
    """
    none = F.array().cast("array<string>")
    lists = [(kind, F.coalesce(c, none)) for kind, c in (("added", added), ("changed", changed))]

    def mark(part: Column) -> Column:
        out = part
        for kind, known in reversed(lists):
            out = F.when(F.array_contains(known, F.lower(part)), F.concat(F.lit(f'<span class="{kind}">'), part, F.lit("</span>"))).otherwise(out)
        return out

    parts = F.regexp_extract_all(markdown, F.lit(f"{TOKEN}|[^{TOKEN[1:]}"), F.lit(0))
    return F.array_join(F.transform(parts, mark), "")


def similarity_band(similarity: Column) -> Column:
    """Band of a similarity rounded to two places."""
    r = F.round(similarity, 2)
    return F.when(r >= 0.999, "100").when(r >= 0.95, "95").when(r >= 0.9, "90").when(r >= 0.8, "80").when(r.isNotNull(), "00")


def strip_form_feed(text: Column) -> Column:
    """Without exactly one form feed at the end."""
    return F.regexp_replace(text, r"\f\z", "")


def is_blank(text: Column) -> Column:
    """Empty or only white space."""
    return F.length(F.regexp_replace(text, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")) == 0


def is_error_line(line: Column) -> Column:
    """A tool's line that names an error, but for the harmless one about a PDF's cross-reference table."""
    return line.rlike("(?i)error") & ~line.rlike("(?i)error: xref num")


def tool_warnings(output: Column) -> Column:
    """Trimmed lines of a tool's output that aren't empty."""
    # not F.trim by itself: transform would give it the line's number as the characters to trim
    return F.filter(F.transform(F.split(output, "\n"), lambda x: F.trim(x)), lambda x: x != "")


def command_failed(exit_code: Column, stderr: Column, check_lines: bool = True) -> Column:
    """Whether an external command failed: by exit code, or by an error line."""
    bad = exit_code != 0
    return bad | F.exists(F.split(F.coalesce(stderr, F.lit("")), "\n"), is_error_line) if check_lines else bad


def http_transient(status: Column) -> Column:
    """Whether a failed call is worth another attempt: these statuses, or no status at all."""
    return status.isin(429, 502, 503, 504) | status.isNull()
