"""Ids as column expressions. Their formulas are part of the data model: equal inputs give equal ids everywhere."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def chunk_id(path_key: Column | str, number: Column | str) -> Column:
    return F.md5(F.concat(_c(path_key), F.lit(":"), _c(number).cast("string")))


def entity_key(name: Column | str, kind: Column | str, root_id: Column | str) -> Column:
    """What an entity's id is the hash of: shorter than it, so aggregations go by keys and hash once what is left."""
    return F.concat_ws("|", F.lower(_c(name)), F.lower(F.trim(F.coalesce(_c(kind), F.lit("")))), _c(root_id))


def entity_id(name: Column | str, kind: Column | str, root_id: Column | str) -> Column:
    return F.sha2(entity_key(name, kind, root_id), 256)


def edge_id(source: Column | str, target: Column | str, kind: Column | str, root_id: Column | str) -> Column:
    return F.sha2(F.concat_ws("|", _c(source), _c(target), _c(kind), _c(root_id)), 256)


def as_uuid(digest: Column) -> Column:
    """A 32-digit digest with the dashes of a UUID."""
    return F.regexp_replace(digest, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def community_point(root_id: Column | str, version: Column | str, build_id: Column | str, community: Column | str) -> Column:
    return as_uuid(F.md5(F.concat_ws("|", _c(root_id), _c(version).cast("string"), _c(build_id), _c(community))))


def entity_point(entity: Column | str, root_id: Column | str) -> Column:
    return as_uuid(F.md5(F.concat_ws("|", _c(entity), _c(root_id))))


def community_id(root_id: Column | str, members: Column | str) -> Column:
    """Over the members in order, written as a tuple: ('a', 'b'), or ('a',) for one."""
    ids = F.array_sort(_c(members))
    inner = F.array_join(F.transform(ids, lambda x: F.concat(F.lit("'"), x, F.lit("'"))), ", ")
    return F.sha2(F.concat(_c(root_id), F.lit("|("), inner, F.when(F.size(ids) == 1, F.lit(",")).otherwise(F.lit("")), F.lit(")")), 256)


def singleton_community_id(root_id: Column | str, entity: Column | str) -> Column:
    return F.sha2(F.concat_ws("|", _c(root_id), _c(entity)), 256)


def chunk_hash(text: Column | str) -> Column:
    return F.sha2(_c(text), 256)


def file_hash(content: Column | str) -> Column:
    return F.md5(_c(content))


def extraction_key(texts: Column | str) -> Column:
    """The cache key of a batch of texts: each with its length, NUL between them."""
    return F.sha2(F.array_join(F.transform(_c(texts), lambda t: F.concat(F.length(t).cast("string"), F.lit(":"), t)), "\u0000"), 256)
