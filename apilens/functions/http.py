"""HTTP/1.x text parsing on whole messages, as native expressions.

All offsets are taken on the one-character-per-byte view; only the pieces that leave the parser
(header text, body) are decoded.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from apilens.functions.values import byte_view, decode_ignore, decode_replace

# Request methods that are recognised, as prefixes of the message.
METHODS = ("GET", "POST", "PUT", "DELETE", "PATCH", "HEAD", "OPTIONS")
BODY_METHODS = ("POST", "PUT", "PATCH")

HEADER_END = "\r\n\r\n"
# Header lines end at CR LF only and the start line is none; any number of digits.
LENGTH_HEADER = r"(?i)\r\n[ \t]*content-length[ \t]*:[ \t]*0*([0-9]+)[ \t]*(?=\r\n|\z)"
# What a length of more than 18 digits counts as: more than any message has.
UNREACHABLE_LENGTH = (1 << 62) - 1


def is_http_request(text: Column) -> Column:
    return text.rlike("^(?:" + "|".join(METHODS) + ")")


def is_http_response(text: Column) -> Column:
    return text.startswith("HTTP/")


def header_length(message: Column) -> Column:
    """Bytes up to and including the blank line; null while the headers are incomplete."""
    return F.nullif(F.instr(byte_view(message), HEADER_END), F.lit(0)) + 3


def header_text(message: Column, head_length: Column | None = None) -> Column:
    """Header block without the closing blank line."""
    length = header_length(message) if head_length is None else head_length
    return decode_ignore(F.substring(message, F.lit(1), length - 4))


def content_length(head: Column) -> Column:
    """First well-formed Content-Length in the header text; null when there is none.

    Leading zeros do not count. A number beyond 18 digits is announced all the same: such a message is
    never complete.
    """
    digits = F.regexp_extract(head, LENGTH_HEADER, 1)
    return F.when(F.length(digits) > 18, F.lit(UNREACHABLE_LENGTH)).otherwise(digits.try_cast("bigint"))


def message_length(message: Column) -> Column:
    """Bytes a complete message needs: headers plus Content-Length; null if headers are open."""
    return header_length(message) + F.coalesce(content_length(header_text(message)), F.lit(0))


def is_complete(message: Column) -> Column:
    return F.coalesce(F.length(message) >= message_length(message), F.lit(False))


def body_length_ok(method: Column, body: Column, length: Column) -> Column:
    """Body-carrying methods need at least the announced number of bytes."""
    return ~method.isin(*BODY_METHODS) | length.isNull() | (F.length(body) >= length)


def message_body(message: Column, head_length: Column, length: Column) -> Column:
    """Exactly Content-Length bytes of body, or everything that is left."""
    rest = F.length(message) - head_length
    return F.substring(message, head_length + 1, F.least(rest, length).cast("int"))


def decode_body(body: Column) -> Column:
    return decode_replace(body)


def start_line(head: Column) -> Column:
    return F.substring_index(head, "\r\n", 1)


# What stands between the words of a start line, and what is trimmed from text.
_GAP = r"\s+"
_BLANKS = " \t\x0b\f"


def _trim(text: Column) -> Column:
    return F.trim(text, F.lit(_BLANKS))


def request_line(line: Column) -> Column:
    """``struct(method, path, version)``; null when there are fewer than two words."""
    words = F.split(_trim(line), _GAP)
    return F.when(
        F.size(words) >= 2,
        F.struct(
            F.get(words, 0).alias("method"),
            F.get(words, 1).alias("path"),
            F.coalesce(F.get(words, 2), F.lit("HTTP/1.1")).alias("version"),
        ),
    )


def status_line(line: Column) -> Column:
    """``struct(version, code, text)``; null when the code is missing or not a number."""
    words = F.split(F.ltrim(line, F.lit(_BLANKS)), _GAP, 3)
    code = F.when(F.get(words, 1).rlike("^[0-9]+$"), F.get(words, 1)).try_cast("int")
    return F.when(
        code.isNotNull(),
        F.struct(
            F.get(words, 0).alias("version"),
            code.alias("code"),
            F.coalesce(F.get(words, 2), F.lit("")).alias("text"),
        ),
    )


def header_pairs(head: Column) -> Column:
    """``array<struct<key, value>>`` of the header lines; lines without a colon are skipped."""
    lines = F.filter(F.split(head, "\r\n"), lambda line, at: (at > 0) & line.contains(":"))
    return F.transform(
        lines,
        lambda line: F.struct(
            _trim(F.substring_index(line, ":", 1)).alias("key"),
            _trim(F.substring(line, F.instr(line, ":") + 1, F.length(line))).alias("value"),
        ),
    )


def header_map(pairs: Column) -> Column:
    """Headers as a map: names keep their case, the last value of a name wins.

    Names rarely repeat: the plain map is the common case, the scan for later copies the exception.
    """
    names = pairs["key"]
    last_of_name = F.filter(
        pairs, lambda pair, at: ~F.array_contains(F.slice(names, at + 2, F.size(names)), pair["key"])
    )
    return F.when(
        F.size(F.array_distinct(names)) == F.size(pairs), F.map_from_entries(pairs)
    ).otherwise(F.map_from_entries(last_of_name))


def host_of(headers: Column, destination_ip: Column, case_sensitive: bool = True) -> Column:
    """Host header, else the destination address."""
    if case_sensitive:
        host = F.try_element_at(headers, F.lit("Host"))
    else:
        host = F.try_element_at(
            F.map_values(F.map_filter(headers, lambda name, _: F.lower(name) == "host")), F.lit(-1)
        )
    return F.coalesce(host, destination_ip)
