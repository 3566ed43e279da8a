"""Record keys, weight text, ownership and label filters, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def format_weight(weight: Column | str) -> Column:
    """The weight as 12 characters with four decimals, so that weights from 0 to 9,999,999.9999 sort as text."""
    return F.format_string("%012.4f", _col(weight))


def quantized(weight: Column | str) -> Column:
    """The weight to four decimals, which is what an edge's identity holds."""
    return F.round(_col(weight), 4)


def node_key(uuid: Column | str) -> Column:
    return F.concat(F.lit("n:{"), _col(uuid), F.lit("}"))


def edge_prefix(src: Column | str, label: Column | str) -> Column:
    return F.concat(F.lit("e:out:{"), _col(src), F.lit("}:"), _col(label), F.lit(":"))


def edge_out_key(src: Column | str, label: Column | str, weight: Column | str, dst: Column | str) -> Column:
    return F.concat(edge_prefix(src, label), format_weight(weight), F.lit(":"), _col(dst))


def edge_in_key(dst: Column | str, label: Column | str, src: Column | str) -> Column:
    return F.concat(F.lit("e:in:{"), _col(dst), F.lit("}:"), _col(label), F.lit(":"), _col(src))


def owner(uuid: Column | str, owners: int | list[int]) -> Column:
    """The owner of a vertex among n partitions, or among the given ids; the same for an id wherever it is asked."""
    ids = list(range(owners)) if isinstance(owners, int) else sorted(owners)
    if not ids:
        raise ValueError("no owners: a graph without a ring is local")
    at = F.pmod(F.xxhash64(_col(uuid)), F.lit(len(ids)))
    return at.cast("int") if ids == list(range(len(ids))) else F.element_at(F.array(*map(F.lit, ids)), at.cast("int") + 1)


def bloom_bit(label: Column | str) -> Column:
    """One of 64 bits for a label; a node's bits are the bit_or over its edges."""
    return F.expr("shiftleft(1L, cast(pmod(xxhash64(__l), 64) as int))".replace("__l", label)) if isinstance(label, str) else F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(label), F.lit(64)).cast("int"))


def might_have_edge(bloom: Column | str, label: str) -> Column:
    """Whether a node may have edges of a label; a bloom of 0 or null says nothing, so maybe."""
    b = F.coalesce(_col(bloom), F.lit(0).cast("long"))
    return (b == 0) | (b.bitwiseAND(bloom_bit(F.lit(label))) != 0)
