"""Path and key normalisation, templates, parameters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the mark that replaces a concrete identifier in a path.
ID_MARK = "{id}"

_UUID = "[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"
_IDENTIFIER = rf"(?<![^/])(?:[0-9]+|{_UUID})(?![^/])"
# A segment that stands for any value: {name}, :name or @name.
PARAMETER_SEGMENT = r"^(?:\{.*\}|[:@].*)$"


def strip_query(path: Column) -> Column:
    return F.substring_index(path, "?", 1)


def path_template(path: Column) -> Column:
    """Path without its query string, whole-number and UUID segments replaced by ``{id}``.

    One regular expression over the whole path instead of a loop over segments.
    """
    return F.regexp_replace(strip_query(path), _IDENTIFIER, ID_MARK)


def norm_path(path: Column) -> Column:
    return F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))


def norm_method(method: Column) -> Column:
    return F.lower(method)


def catalog_key(method: Column, path: Column) -> Column:
    return F.concat_ws(":", norm_method(method), norm_path(path))


def endpoint_id(method: Column, path: Column) -> Column:
    """Base64 of ``METHOD:path`` in one line."""
    text = F.concat(F.upper(method), F.lit(":"), path)
    return F.regexp_replace(F.base64(F.encode(text, "UTF-8")), "[\r\n]", "")


def segments(path: Column) -> Column:
    return F.split(path, "/")


def parameter_mask(template: Column) -> Column:
    """One character per segment: ``*`` for a parameter, ``=`` for a literal."""
    return F.array_join(
        F.transform(
            segments(template),
            lambda part: F.when(part.rlike(PARAMETER_SEGMENT), F.lit("*")).otherwise(F.lit("=")),
        ),
        "",
    )


def masked(path: Column, mask: Column) -> Column:
    """Path with the segments at the ``*`` positions of ``mask`` blanked out."""
    return F.array_join(
        F.transform(
            segments(path),
            lambda part, at: F.when(F.substring(mask, at + 1, F.lit(1)) == "*", F.lit("*"))
            .otherwise(part),
        ),
        "/",
    )


def query_params(path: Column) -> Column:
    """``array<struct<name, value>>`` of the query string, decoded, in order."""
    query = F.when(
        F.instr(path, "?") > 0, F.substring(path, F.instr(path, "?") + 1, F.length(path))
    )
    parts = F.filter(F.split(query, "&"), lambda part: part != "")

    def plain(text: Column) -> Column:
        return F.coalesce(F.try_url_decode(text), text)

    return F.coalesce(
        F.transform(
            parts,
            lambda part: F.struct(
                plain(F.substring_index(part, "=", 1)).alias("name"),
                F.when(
                    F.instr(part, "=") > 0,
                    plain(F.substring(part, F.instr(part, "=") + 1, F.length(part))),
                ).otherwise(F.lit("")).alias("value"),
            ),
        ),
        F.array().cast("array<struct<name:string,value:string>>"),
    )


def path_params(template: Column, path: Column) -> Column:
    """``array<struct<name, value>>``: each parameter segment of the template with its value.

    An array, not a map: a template may hold ``{id}`` more than once.
    """
    pairs = F.zip_with(
        segments(template),
        segments(strip_query(path)),
        lambda part, value: F.struct(
            F.regexp_replace(part, r"^[{:@]|\}$", "").alias("name"),
            value.alias("value"),
            part.rlike(PARAMETER_SEGMENT).alias("marked"),
        ),
    )
    return F.transform(
        F.filter(pairs, lambda pair: pair["marked"]),
        lambda pair: F.struct(pair["name"].alias("name"), pair["value"].alias("value")),
    )
